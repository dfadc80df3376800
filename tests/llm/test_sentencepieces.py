"""Chunk tables against the library on whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from topicweave.llm import sentencepieces

MODEL = sentencepieces.model()
STRANGE = ["", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a  b ", "\n", "\n\n", " \n", "\n ", " \n \n  x", "a\n\n b\n", "a\tb", "▁", "▁▁ a",
           "x▁ y", "x ▁y\n▁", "\x00a \x00", "ﬁ ①", "é 　 z", "<s> </s> <unk> <0x41>", "\U0001f600\U0001f600 ok", "\r\n x", "Mr. O'Neil's  10,000",
           "日本語 テスト", "a" * 300, " " * 70 + "b", "   x"]


def library(text):
    sp = sentencepieces.processor(MODEL)
    ids = sp.encode(text or "", add_bos=True, add_eos=True)
    octets = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(octets).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), octets, sp.decode(ids)


def found(docs, keep=False):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    return sorted((tuple(bytes(r[c]) if c == "ids" else r[c] for c in names) for r in sentencepieces.encode(docs, keep=keep).collect()), key=repr)


@pytest.mark.parametrize("bounds", [(1 << 19, 32 << 20), (5, 1 << 20), (1 << 19, 40), (0, 0)])
@pytest.mark.parametrize("part", [1, 200, 1 << 20])
def test_equals_the_library(make_docs, monkeypatch, bounds, part):
    monkeypatch.setattr(sentencepieces, "PART", part)
    monkeypatch.setattr(sentencepieces, "TABLE_CHUNKS", bounds[0])
    monkeypatch.setattr(sentencepieces, "TABLE_BYTES", bounds[1])
    rng = np.random.default_rng(1)
    alphabet = ["the", "of", "\n", " ", "  ", "Zürich", "naïve", "x▁", "▁", "10.5", "\t", "word", "\n\n", "'s", "日本"]
    texts = STRANGE + [" ".join(rng.choice(alphabet, 40)) for _ in range(60)] + ["".join(rng.choice(alphabet, 40)) for _ in range(60)]
    pairs = list(enumerate([*texts, *texts[:20]])) + [(3, texts[3]), (3, texts[3])]
    assert found(make_docs(pairs), keep=True) == sorted(((i, *library(t)) for i, t in pairs), key=repr)


def test_odd_rows(odd_docs):
    assert found(odd_docs) == sorted(((i, *library(t)[:3]) for i, t in odd_docs.select("doc_id", "text").collect()), key=repr)


def test_very_long_texts_and_names(make_docs):
    rng = np.random.default_rng(2)
    long = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(200_000))
    pairs = [(1, long), (2, "x" * 200_000), (3, long)]
    docs = make_docs(pairs, **{c: "x" for c in ("key", "check", "at", "ids", "numbers", "fills", "chunk", "n")})
    assert found(docs) == [(i, *library(t)[:3]) for i, t in pairs]


def test_empty_table(no_docs):
    assert found(no_docs) == []


def test_each_distinct_chunk_is_segmented_once(make_docs, monkeypatch):
    monkeypatch.setattr(sentencepieces, "TABLE_CHUNKS", 0)
    monkeypatch.setattr(sentencepieces, "PART", 12)
    docs = make_docs({i: "a b c\nd e" for i in range(50)}).repartition(3)
    table = sentencepieces._table(docs, MODEL)
    assert not table.value.number
    parts = sentencepieces.materialise(sentencepieces.outlines(docs, table), "parts")
    n = parts.count()
    cut = sentencepieces.rest_ids(parts, n, MODEL).collect()
    lists = [sentencepieces._unpack_all(r["rest"]) for r in parts.collect()]
    assert n >= 50 * 5 // 15 and all(sorted(x) == [b"\nd", b"a", b"b", b"c", b"e"] for x in lists)
    by_part = {}
    for r in sorted(cut, key=lambda r: r["start"]):
        by_part.setdefault(r["part"], []).extend(sentencepieces._unpack_all(r["ids"]))
    want = {c: library(c)[3][4:-4] for c in "abce"}
    assert len(by_part) == n and all(by_part[r["part"]][x.index(c.encode())] == want[c] for r, x in zip(parts.collect(), lists, strict=True) for c in "abce")


def test_outlines_are_joined_without_a_shuffle_of_them(spark, make_docs):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sentencepieces.encode(make_docs({i: f"a b {i}" for i in range(50)}).repartition(8))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    outlines = plan[plan.index("SortMergeJoin"):plan.index("SelectedBucketsCount")]
    assert "Exchange" not in outlines


def test_chunks_join_to_the_text():
    for text in STRANGE:
        joined = "".join(c if c[:1] == "\n" else " " + c for c in sentencepieces.chunks(text))
        assert joined[1:] == text.replace("▁", " ")
