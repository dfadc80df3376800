from __future__ import annotations

import random

import numpy as np
import pytest

from topicweave.llm import shingle_join, simhash


def shingles(text):
    found = (text or "").lower().split()
    return {tuple(found[i:i + 5]) for i in range(len(found) - 4)} or {tuple(found)}


def slow_kept(texts):
    """Ids that are the smallest of their component, by comparing every pair."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def near_copies():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=30)
    texts = {}
    for _ in range(6):
        base = rng.choices(words, k=rng.choice([12, 60, 200]))
        for _ in range(25):
            copy = list(rng.choice([base, base, texts and rng.choice(list(texts.values())).split() or base]))
            for _ in range(rng.randrange(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.2:
                copy[len(copy) // 2:len(copy) // 2] = passage
            texts[len(texts)] = rng.choice([" ", "\n"]).join(copy)
    for _ in range(30):
        texts[len(texts)] = " ".join(rng.choices(words, k=rng.randrange(0, 9)) + passage)
    return texts | {len(texts): None, len(texts) + 1: "  ", len(texts) + 2: "w1 w2", len(texts) + 3: "W1\nw2"}


@pytest.mark.parametrize("crowd", [2, 32])
def test_stage_equals_brute_force(make_docs, monkeypatch, crowd):
    monkeypatch.setattr(shingle_join, "CROWD", crowd)
    texts = near_copies()
    wanted = slow_kept(texts)
    assert 30 < len(wanted) < len(texts) - 30
    assert {r["doc_id"] for r in simhash.keep_first(make_docs(texts)).collect()} == wanted


def test_copy_whose_fingerprint_is_far_goes(make_docs):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    copy = list(base)
    copy[20], copy[70] = "other", "changed"
    bits = [simhash.fingerprint(" ".join(t), 5) for t in (base, copy)]
    assert (bits[0] ^ bits[1]).bit_count() > 2
    kept = simhash.keep_first(make_docs({1: " ".join(base), 2: "\n".join(copy)})).collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_very_long_texts(make_docs, monkeypatch):
    rng = random.Random(3)
    found = [f"w{rng.randrange(40_000)}" for _ in range(120_000)]
    near = found[:60_000] + ["changed"] + found[60_001:]
    other = [f"w{rng.randrange(40_000)}" for _ in range(120_000)]
    docs = make_docs({1: " ".join(found), 2: " ".join(near), 3: " ".join(other), 4: "short text"})
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [1, 3, 4]


def test_few_marks_change_nothing(make_docs, monkeypatch):
    docs = make_docs(near_copies())
    wanted = sorted(r["doc_id"] for r in simhash.keep_first(docs).collect())
    monkeypatch.setattr(shingle_join, "BITS", 64)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == wanted


def test_tables_go_when_they_are_read(make_docs, monkeypatch, tmp_path):
    from topicweave.plans import tables

    monkeypatch.setattr(tables, "scratch_folder", lambda spark: str(tmp_path))
    kept = simhash.keep_first(make_docs(near_copies()))
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "topicweave").iterdir()] == ["near_copies"]
    assert kept.count()


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 3000)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, 40).astype(np.uint64)]))
        apart = sum(int(v).bit_count() for v in (shingle_join.sketch(x) ^ shingle_join.sketch(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0


def test_tables_of_marks_are_as_large_as_their_marks_need_and_lose_none(spark, tmp_path, monkeypatch):
    for n in (0, 1, 1000, 10**6, 10**12):
        assert min(8 * n, 1 << 24) <= shingle_join._table_size(n) <= 1 << 24 and shingle_join._table_size(n) % 64 == 0
    of = spark.range(0, 6000, 3).withColumnRenamed("id", "v")
    rows = spark.range(9000).withColumnRenamed("id", "v")
    for most in (1 << 24, 1 << 10):
        monkeypatch.setattr(shingle_join, "BITS", most)
        kept = {r[0] for r in shingle_join._marked(rows, of, "v").collect()}
        assert kept >= set(range(0, 6000, 3)) and (most == 1 << 10 or len(kept) < 4000)
    monkeypatch.setattr(shingle_join, "BITS", 1 << 24)
    written, plain = [], shingle_join.materialise
    monkeypatch.setattr(shingle_join, "materialise", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])
    assert shingle_join._marked(rows, of, "v").count() < 4000
    assert [table.selectExpr("size(marks)").first()[0] for name, table in written if name == "marks"] == [256]


def test_few_pairs_of_a_group_are_compared(make_docs, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(9000)}" for _ in range(700)]
    texts = {i: " ".join([*base[:10 * i], f"x{i}", *base[10 * i:]]) for i in range(30)}
    texts |= {100 + i: " ".join(f"v{rng.randrange(9000)}" for _ in range(50)) for i in range(5)}
    compared, plain = [], shingle_join._similar
    monkeypatch.setattr(shingle_join, "_similar", lambda pairs, texts: (compared.append(pairs.count()), plain(pairs, texts))[1])
    docs = make_docs(texts)
    found = {r["doc_id"] for r in shingle_join.later_copies(docs).collect()}
    assert found == set(range(1, 30))
    assert sum(compared) <= 2 * 30 < 30 * 29 // 2


def test_pairs_in_turns_equal_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(shingle_join, "TEXTS", 0)
    texts = near_copies()
    assert {r["doc_id"] for r in simhash.keep_first(make_docs(texts)).collect()} == slow_kept(texts)


def test_sketches_of_long_texts_drop_pairs_and_lose_none(spark):
    rng = np.random.default_rng(5)
    sizes, pairs, rows = [900, 1100, 3000, 4090, 4200, 20_000, 150_000], [], []
    for n in sizes:
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.9, 0.5):  # of common elements
            y = np.unique(np.concatenate([x[:int(len(x) * share)], rng.integers(0, 1 << 63, int(len(x) * (0.95 - share))).astype(np.uint64)]))
            pairs.append((len(rows), len(rows) + 1, 10 * len(np.intersect1d(x, y)) >= 8 * len(np.union1d(x, y))))
            rows += [(len(rows) + i, len(s), shingle_join.sketch(s, shingle_join.sketch_size(len(s))).tolist()) for i, s in enumerate((x, y))]
    found = spark.createDataFrame(rows, "class long, n int, sketch array<long>")
    assert len({len(r[2]) for r in rows}) > 4 and {p[2] for p in pairs} == {True, False}
    asked = spark.createDataFrame([p[:2] for p in pairs], "x long, y long").union(spark.createDataFrame([p[1::-1] for p in pairs], "x long, y long"))
    kept = {(r["x"], r["y"]) for r in shingle_join._close(asked, found).collect()}
    assert kept == {q for x, y, similar in pairs for q in ((x, y), (y, x)) if similar or rows[x][1] > 140_000}
