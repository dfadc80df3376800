from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from topicweave.functions import text as T
from topicweave.operators.corpus import documents_of_topic, list_topics, normalise_corpus, tokenised_corpus

STOPWORDS = ["the", "a", "inc"]

TRIMMED = {
    '"Oil,"': ["oil"], "(opec)": ["opec"], "U.S.": ["u.s"], "</b>": ["b"], "Inc.": [], "5": [], "--": [],
    "1,000": ["1,000"], "x\ty": ["x\ty"], '")': [], "</": [], "&#": [], '".,': [], "abc.,": ["abc"], 'ab),"': ["ab"],
    ',"': [], 'ab?"': ["ab?"], "''it''": ["'it'"], "\t foo \t": ["foo"], "The theory": ["theory"],
    "oil price\nrises": ["oil", "price", "rises"], "a b\r\ncc\rdd": ["cc", "dd"], "": [], "\n\n": [], "\t\t x": [],
}


def tokens_of(spark, texts, stopwords):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.text_tokens(F.col("t"), stopwords).alias("k")).orderBy("i").collect()
    return [row["k"] for row in rows]


def test_token_trimming(spark):
    assert dict(zip(TRIMMED, tokens_of(spark, TRIMMED, STOPWORDS))) == TRIMMED


def step_by_step(text, stopwords):
    """The token rules applied one token at a time."""
    found = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        controls = "".join(map(chr, range(0x21)))
        for word in line.lower().strip(controls).split(" "):
            if len(word) <= 1:
                continue
            if word[:2] in T.PREFIX_PAIRS:
                word = word[2:]
            if word[:1] in T.PREFIX_CHARS:
                word = word[1:]
            if word[-2:] in T.SUFFIX_PAIRS:
                word = word[:-2]
            if word[-1:] in T.SUFFIX_CHARS:
                word = word[:-1]
            if word and word not in T.SPECIAL_TOKENS and word not in stopwords:
                found.append(word)
    return found


def test_random_texts_match_the_rules(spark):
    rng = random.Random(7)
    alphabet = list(" \t\n\r\"'()<>/&#.,;?!-”“ab\x01é") + ["</", "&#", "), ", "the ", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    expected = [step_by_step(t, STOPWORDS) for t in texts]
    assert tokens_of(spark, texts, STOPWORDS) == expected


def test_long_runs_are_linear(spark):
    text = " " * 400_000 + "word" + "\t" * 400_000 + "\n" + "." * 400_000
    assert tokens_of(spark, [text], [])[0][0] == "word"


def test_corpus_filters_short_documents(spark):
    docs = spark.createDataFrame([("t", 1, "p1", "word " * 20), ("t", 2, "p2", "word " * 19), ("t", 3, "p3", None)],
                                 "topic string, doc_id int, path string, text string")
    assert [r["doc_id"] for r in normalise_corpus(docs, []).collect()] == [1]
    kept = normalise_corpus(docs, [], min_tokens=0)
    assert {r["doc_id"]: r["n_tokens"] for r in kept.collect()} == {1: 20, 2: 19, 3: 0}
    assert [r["topic"] for r in list_topics(kept).collect()] == ["t"]
    assert documents_of_topic(kept, "other").isEmpty()


@pytest.mark.parametrize("min_tokens", [0, 2])
def test_stopword_table_gives_the_same_corpus(spark, min_tokens):
    docs = spark.createDataFrame([("t", 1, "p", "the oil the price"), ("t", 2, "q", "a the"), ("u", 3, "r", "the oil")],
                                 "topic string, doc_id int, path string, text string")
    table = spark.createDataFrame([(w,) for w in STOPWORDS * 2], "word string")
    inline, joined = (normalise_corpus(docs, s, min_tokens) for s in (STOPWORDS, table))
    assert sorted(map(tuple, inline.select(*joined.columns).collect()), key=str) == sorted(
        map(tuple, joined.collect()), key=str)


def test_normalisation_is_narrow_and_evaluated_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("t", 1, "p", "x y", 5)], "topic string, doc_id int, path string, text string, extra int"
                          ).write.parquet(path)
    plan = normalise_corpus(spark.read.parquet(path), STOPWORDS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "extra" not in plan
    assert plan.count("lower(") == 1


def test_content_keeps_inner_empty_lines_only(spark):
    docs = spark.createDataFrame([("t", i, "p", c) for i, c in enumerate(["a\n\nb\n\n", "\n\n", "", "a"])],
                                 "topic string, doc_id int, path string, text string")
    rows = tokenised_corpus(docs).orderBy("doc_id").collect()
    assert [r["tokens"] for r in rows] == [["a", "", "b"], [], [""], ["a"]]
    assert [r["n_tokens"] for r in rows] == [3, 0, 1, 1]
