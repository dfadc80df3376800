from __future__ import annotations

import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from topicweave.llm import language

WORDS = {"aa": "tion the ing and with that".split(), "bb": "eau les dans pour que être".split(), "ru": "это как так что для при".split()}


def text(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_best_path_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = rng.normal(0, rng.choice([0.3, 2, 5]), (rng.integers(1, 7), 3))
        switch = float(rng.choice([0.5, 3, 8]))

        def value(path, scores=scores, switch=switch):
            return sum(scores[i, s] for i, s in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))

        best = max(value(p) for p in product(range(3), repeat=len(scores)))
        assert abs(value(language.best_path(scores, switch).tolist()) - best) < 1e-9


def test_held_out_accuracy_and_spans(spark, make_docs):
    rng = random.Random(1)
    langs = {i: rng.choice(list(WORDS)) for i in range(150)}
    docs = make_docs({i: text(rng, lang) for i, lang in langs.items()}, lang=langs.get)
    found = language.predict_documents(docs).collect()
    assert len(found) == 150 and {r["held_out"] for r in found} == {True, False}
    assert all(r["lang_pred"] == langs[r["doc_id"]] and r["score"] > 0.99 for r in found)
    model = language.train(docs, "lang", F.lit(True))
    mixed = f"{text(rng, 'aa')} {text(rng, 'ru', 60)} {text(rng, 'aa', 30)}"
    row = language.identify(make_docs({1: mixed}), model, "doc_id").first()
    assert [s["lang"] for s in row["spans"]] == ["aa", "ru", "aa"]
    assert (row["spans"][0]["start"], row["spans"][-1]["end"]) == (0, len(mixed))
    assert mixed[row["spans"][1]["start"]] in "эктчдп" and row["lang_pred"] == "aa"


def test_label_and_id_are_not_looked_at(spark, make_docs):
    rng = random.Random(2)
    docs = make_docs({i: text(rng, "aa" if i % 2 else "bb") for i in range(60)}, lang=lambda i: "aa" if i % 2 else "bb")
    model = language.train(docs, "lang", F.lit(True))
    wrong = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", -F.col("doc_id"))
    plain, swapped = ({abs(r["doc_id"]): r["lang_pred"] for r in language.identify(d, model, "doc_id").collect()} for d in (docs, wrong))
    assert plain == swapped


def test_odd_rows(odd_docs, no_docs):
    found = language.predict_documents(odd_docs.withColumn("lang", F.lit("en"))).collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert len(found) == 11 and all(by_id[i] == ("und", 0.0) for i in (1, 2, 3, 9)) and by_id[6] == ("en", 1.0)
    assert {r["lang_pred"] for r in language.predict_documents(odd_docs).collect()} == {"und"}
    assert language.predict_documents(no_docs).count() == 0
    kept = language.keep_identified(odd_docs.withColumn("lang", F.lit("en")))
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "4", "5", "6", "7", "8", "None"]


def test_long_text_and_long_word(make_docs):
    docs = make_docs({0: "the " * 200_000, 3: "x" * 300_000, 6: "the end"}, lang="en")
    assert {r["lang_pred"] for r in language.predict_documents(docs).collect()} == {"en"}
