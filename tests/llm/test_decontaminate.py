from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from topicweave.llm import decontaminate


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j + 1] + 1 if x == y else max(row[j + 2], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontaminate.common_subsequence(decontaminate._masks(a), len(a), b) == longest_common(a, b)


def world():
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(20_000)]
    items = {i: " ".join(rng.choices(words, k=20)).capitalize() + ". " + " ".join(rng.choices(words, k=8)) + "." for i in range(30)}
    docs, planted = {}, set()
    for i in range(300):
        text = rng.choices(words, k=rng.randrange(20, 200))
        if i % 5 == 0:
            number = rng.randrange(30)
            passage = items[number].split()
            if i % 2:
                for _ in range(3):
                    passage[rng.randrange(len(passage))] = rng.choice(words)
                passage.insert(rng.randrange(20), "extra")
                passage = [w.upper().strip(".") for w in passage]
            at = rng.randrange(len(text))
            text[at:at] = passage
            planted.add((i, number))
        docs[i] = " ".join(text)
    return docs, items, planted


def as_items(spark, items):
    return spark.createDataFrame(list(items.items()), "item_id long, text string")


@pytest.mark.parametrize("block", [10_000, 11])
def test_planted_items_are_found(spark, make_docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items, planted = world()
    found = decontaminate.find_items(make_docs(docs, item_id="x"), as_items(spark, items)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    kept = decontaminate.keep_clean(make_docs(docs, cosine="x"), as_items(spark, items))
    assert kept.columns[-1] == "cosine"
    assert {r["doc_id"] for r in kept.collect()} == set(docs) - {i for i, _ in planted}


def test_candidates_cover_brute_force_by_word_order(make_docs):
    docs, items, _ = world()
    benchmark = decontaminate.Benchmark.of(pd.DataFrame({"item_id": list(items), "text": list(items.values())}))
    detector = decontaminate._fit(make_docs(docs), benchmark)
    hits = all_hits = 0
    for text in docs.values():
        ids = benchmark.ids(text)
        found = detector.find(text)
        for number, item in enumerate(benchmark.items):
            n, slack = len(item.words), int(0.15 * len(item.words)) + 1
            best = max(longest_common(item.words, ids[max(0, s - slack):s + n + slack].tolist()) for s in range(0, len(ids), 4))
            if best >= decontaminate.LEAST * n:
                all_hits += 1
                hits += number in found
    assert all_hits >= 50 and hits == all_hits


def test_odd_rows(spark, odd_docs, no_docs):
    items = as_items(spark, {1: "a b c d e f g h", 2: None, 3: "", 4: "?", 5: "One", 6: "A b C d e f g H"})
    found = decontaminate.find_items(odd_docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(7, 1), (8, 1), (7, 6), (8, 6), (4, 5), (5, 5), (None, 5)}
    assert decontaminate.find_items(no_docs, items).count() == 0
    assert decontaminate.find_items(odd_docs, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd_docs, items.limit(0)).count() == 11


def test_space_is_fitted_on_all_documents(make_docs, monkeypatch):
    docs, items, _ = world()
    benchmark = decontaminate.Benchmark.of(pd.DataFrame({"item_id": list(items), "text": list(items.values())}))
    weight = np.random.default_rng(0).random(len(benchmark.vocabulary)) + 0.5
    basis = np.random.default_rng(1).standard_normal((len(weight), 5))
    monkeypatch.setattr(decontaminate, "PASSAGES", 7)
    rows = []
    for text in docs.values():
        ids = benchmark.ids(text)
        for start in range(0, len(ids), decontaminate.PASSAGE):
            part = ids[start:start + decontaminate.PASSAGE]
            rows.append(np.bincount(part[part >= 0], minlength=len(weight)) * weight)
    wanted = np.array(rows).T @ (np.array(rows) @ basis)
    assert decontaminate._gram_product(make_docs(docs), benchmark, weight, basis) == pytest.approx(wanted, rel=1e-9, abs=1e-9)
    monkeypatch.setattr(decontaminate, "FITTED_ROWS", 5, raising=False)
    fitted = []
    monkeypatch.setattr(decontaminate, "_gram_product", lambda docs, *rest: fitted.append(docs.count()) or np.ones(rest[2].shape))
    decontaminate._fit(make_docs(docs), benchmark)
    assert fitted == [len(docs)]


def test_reordered_and_reworded_items_are_found(spark, make_docs):
    docs, items, planted = {}, {}, set()
    rng = random.Random(8)
    words = [f"v{k}" for k in range(1500)]
    for i in range(300, 600):
        docs[i] = " ".join(rng.choices(words, k=100))
    for i in range(20):
        first = rng.sample(words, 14)
        items[100 + i] = " ".join(first) + ". " + " ".join(rng.sample(words, 14)) + "."
        docs[1000 + i] = " ".join(rng.choices(words, k=50 + i) + items[100 + i].split(". ")[1].split() + first + rng.choices(words, k=40))
        planted.add((1000 + i, 100 + i))
        question, answer = rng.sample(words, 20), rng.sample(words, 8)
        items[200 + i] = " ".join(question) + ". " + " ".join(answer) + "."
        for at in rng.sample(range(20), 10):
            question[at] = f"new{rng.randrange(900)}"
        docs[2000 + i] = " ".join(rng.choices(words, k=30 + i) + question + answer + rng.choices(words, k=60))
        planted.add((2000 + i, 200 + i))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(make_docs(docs), as_items(spark, items)).collect()}
    assert found <= planted
    assert {p for p in planted if p[0] < 2000} <= found
    assert len([p for p in found if p[0] >= 2000]) >= 18


def test_item_deep_in_a_very_long_text(spark, make_docs):
    docs, items, _ = world()[0], world()[1], None
    rng = random.Random(9)
    filler = [f"v{rng.randrange(5000)}" for _ in range(60_000)]
    long = " ".join(filler[:40_000] + items[3].split() + filler[40_000:])
    found = decontaminate.find_items(make_docs({9000: long, 9001: " ".join(filler)} | docs), as_items(spark, items)).collect()
    assert {r["item_id"] for r in found if r["doc_id"] == 9000} == {3} and not any(r["doc_id"] == 9001 for r in found)


def test_words_are_numbered_once(spark, make_docs, monkeypatch):
    docs, items, planted = world()
    written, plain = [], decontaminate.materialise
    monkeypatch.setattr(decontaminate, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    found = decontaminate.find_items(make_docs(docs, ids="x"), as_items(spark, items))
    assert written == ["word_numbers"] and "text" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == planted
