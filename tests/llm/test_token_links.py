"""Cross-tokenizer alignment against whole-text encoding and plain loops; the perfect hash."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from topicweave.llm import perfect_hash, sentencepieces, token_links
from topicweave.llm.perfect_hash import PerfectHash
from topicweave.llm.tokens import _slow_plain, token_bytes

PATHS = token_links.default_paths()
STRANGE = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", "a\nb", "a \nb", "a\n b", "a\n\nb", "a\n  b", " \n x", "x\ty", "▁", "x▁ y", "x ▁y",
           "\x00a \x00", "it's o'clock we'll", "<|endoftext|> in it", "<s> </s> <0x41>", "é 　 z", "a b", "1234567 89", "日本語 テスト",
           "\U0001f600\U0001f600 ok", "\x85 x\x85 y", "\x1c x", "...!?  ", "a" * 400, " " * 50 + "b", "x \r\n y"]


def whole(text):
    """Token ids and bytes of a whole text on both sides."""
    a = _slow_plain(PATHS[0][0]).encode(" " + text, add_special_tokens=False).ids
    sp = sentencepieces.processor(PATHS[1])
    b = sp.encode(text)
    octets = token_bytes(PATHS[0][1])
    pieces = [sp.id_to_piece(i) for i in b]
    return a, [octets[i] for i in a], b, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]


def brute_force(rows):
    aligned = []
    for _, text in rows:
        links, groups, sizes = [], [], (0, 0)
        if text:
            a, bytes_a, b, bytes_b = whole(text)
            if b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                sizes = len(a), len(b)
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                for i, x in enumerate(a):
                    for j, y in enumerate(b):
                        if max(ends_a[i] - len(bytes_a[i]), ends_b[j] - len(bytes_b[j])) < min(ends_a[i], ends_b[j]):
                            links.append((x, y))
                before = -1
                for end in sorted(set(ends_a) & set(ends_b)):
                    own = ",".join(str(x) for x, e in zip(a, ends_a, strict=True) if before < e <= end)
                    groups.append(own + "|" + ",".join(str(y) for y, e in zip(b, ends_b, strict=True) if before < e <= end))
                    before = end
        aligned.append((links, groups, sizes))
    df = Counter(pair for links, _, _ in aligned for pair in set(links))
    best = {}
    for (a, _), n in df.items():
        best[a] = max(best.get(a, 0), n)
    return [(doc_id, *sizes, len(groups), len(links), sum(df[p] == best[p[0]] for p in links), sum(df[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if links else "") for (doc_id, _), (links, groups, sizes) in zip(rows, aligned, strict=True)]


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(docs):
    return sorted((tuple(r[c] for c in NAMES) for r in token_links.align(docs).collect()), key=repr)


@pytest.fixture
def texts():
    rng = np.random.default_rng(5)
    words = ["the", "of", "\n", "  ", "Zürich", "naïveté", "▁", "10.5", "\t", "it's", "unbelievable", "\n\n", "日本", "…", "<|endoftext|>", "a"]
    mixed = [" ".join(rng.choice(words, 30)) for _ in range(60)] + ["".join(rng.choice([*words, " "], 30)) for _ in range(60)]
    return list(enumerate([*STRANGE, *mixed, *mixed[:10]])) + [(3, "a"), (3, "a")]


@pytest.mark.parametrize("limits", [{}, {"WORDS": 3, "CHARACTERS": 40, "PAIRS": 20, "FAN": 2}, {"ENTRIES": 100}])
def test_equals_whole_texts(make_docs, monkeypatch, limits, texts):
    for name, value in limits.items():
        monkeypatch.setattr(token_links, name, value)
    assert found(make_docs(texts).repartition(5)) == sorted(brute_force(texts), key=repr)


def test_odd_rows(odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == sorted(brute_force(rows), key=repr)


def test_empty_table(no_docs):
    assert found(no_docs) == []


def test_very_long_text_and_clashing_names(make_docs):
    text = "some words of a very long text, " * 30_000
    docs = make_docs([(1, text), (2, "some words")], **{c: "x" for c in ("n_a", "n_best", "count_sum", "groups", "part", "shard", "pairs")})
    by_id = {r[0]: r for r in found(docs)}
    a, _, b, _ = whole(text)
    assert by_id[1][1:3] == (len(a), len(b)) and by_id[2][6] == by_id[2][4] * 2


def test_counts_and_groups(make_docs):
    docs = make_docs({1: "hello world", 2: "hello there", 3: "hello", 4: None})
    counts = {(r["a"], r["b"]): r["n_docs"] for r in token_links.pair_counts(token_links.pair_table(docs)).collect()}
    a, _, b, _ = whole("hello")
    assert counts[a[0], b[0]] == 3
    shown = {r["doc_id"]: r["groups"] for r in token_links.align(docs, keep=True).collect()}
    assert shown[3] == f"{','.join(map(str, a))}|{','.join(map(str, b))}" and shown[4] == ""


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    values = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n)).astype(np.int64)
    shards = perfect_hash.shard_of(values)
    hashed = PerfectHash.of({int(s): perfect_hash.build(values[shards == s]) for s in np.unique(shards)})
    assert sorted(hashed.places(values).tolist()) == list(range(len(values)))
    if n > 1000:
        assert hashed.words.nbytes * 8 < 6 * len(values)
