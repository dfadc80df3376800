from __future__ import annotations

import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from topicweave.llm import pack_bfd, pack_genetic, tokens
from topicweave.llm.pieces import cut, pieces


@pytest.fixture(scope="module")
def paths():
    return tokens.vocabulary()


@cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text, paths):
    return [*tokenizer(paths[0]).encode(text or "", add_special_tokens=False).ids, 2]


def texts():
    rng = random.Random(3)
    words = ["token", "pack", "é", "ж", "中文", "don't", "\n\n", "  ", "12345", "<|endoftext|>"]
    out = {i: " ".join(rng.choices(words, k=rng.randrange(0, 60))) for i in range(40)}
    return out | {50: None, 51: "", 52: "word " * 3000, 53: "x" * 9000, 54: " " * 4000}


def test_both_libraries_agree(paths):
    rng = random.Random(8)
    alphabet = "aZ é\tЖя'.,!1 2\n–“€ÿŽsdtre"
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(30)))
        assert tokens.encode(text, paths, 2).tolist() == ids_of(text, paths)


def test_pieces_are_lossless(make_docs, paths):
    assert [cut(n, 4) for n in (1, 4, 5, 8, 9)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 4)], [(0, 4), (4, 4)], [(0, 1), (1, 4), (5, 4)]]
    found = defaultdict(list)
    for r in pieces(make_docs(texts()), keep_ids=True).collect():
        found[r["doc_id"]].append(r)
    for i, text in texts().items():
        rows = sorted(found[i], key=lambda r: r["piece"])
        joined = b"".join(r["ids"] for r in rows)
        assert np.frombuffer(joined, "<u4").tolist() == ids_of(text, paths)
        assert [r["start"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows)])[:-1].tolist()
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
        assert all(r["length"] == 1024 for r in rows[1:])


def packed_well(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_genetic_packing_of_documents(make_docs, odd_docs, no_docs):
    rows = pack_genetic.pack_documents(make_docs(texts(), sequence_id="x", item="y")).collect()
    total = sum(r["length"] for r in rows)
    assert packed_well(rows, 1024) <= -(-total // 1024) + 1
    odd = pack_genetic.pack_documents(odd_docs).collect()
    assert len(odd) == 11 and packed_well(odd, 1024) == 1
    assert pack_genetic.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("lengths", [[600] * 50, [1024, 1, 1023, 512, 512], list(range(1, 1000, 7)) * 3])
def test_many_shards(spark, monkeypatch, lengths):
    monkeypatch.setattr(pack_genetic, "SHARD", 60)
    rows = pack_genetic.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long"), 1024).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(lengths)))
    least = len(lengths) if min(lengths) > 512 else -(-sum(lengths) // 1024)
    assert packed_well(rows, 1024) <= least + 1


def fewest(lengths, capacity):
    """Sequences of an exact packing of few pieces: the fewest for each set of them, with the least fill of the last one."""
    n = len(lengths)
    best = {0: (1, 0)}
    for chosen in range(1 << n):
        sequences, fill = best[chosen]
        for i in range(n):
            if not chosen >> i & 1:
                new = (sequences, fill + lengths[i]) if fill + lengths[i] <= capacity else (sequences + 1, lengths[i])
                best[chosen | 1 << i] = min(best.get(chosen | 1 << i, new), new)
    return best[(1 << n) - 1][0]


def test_genetic_packing_equals_an_exact_one(spark, monkeypatch):
    rng = random.Random(8)
    sets = [[rng.choice([rng.randrange(150, 420), rng.randrange(300, 700)]) for _ in range(rng.randrange(4, 12))] for _ in range(30)]
    sets.append([370, 370, 300, 300, 300, 300, 84])
    better = exact = 0
    for lengths in sets:
        sizes = np.array(lengths)
        plain = int(pack_genetic.founder(sizes, 1024, np.random.default_rng(0), 0.0).max()) + 1
        people = [pack_genetic.founder(sizes, 1024, np.random.default_rng(i), 0.1 * i) for i in range(4)]
        for epoch in range(20):
            people = pack_genetic.evolve(sizes, people, 1024, np.random.default_rng(epoch))
        evolved = int(people[0].max()) + 1
        assert fewest(lengths, 1024) <= evolved <= plain
        exact += evolved == fewest(lengths, 1024)
        better += evolved < plain
    assert exact >= len(sets) - 1 and better
    rows = pack_genetic.pack(spark.createDataFrame([(i, n) for i, n in enumerate(sets[0])], "id long, length long"), 1024).collect()
    assert packed_well(rows, 1024) == fewest(sets[0], 1024)


@pytest.mark.parametrize("low, high", [(340, 520), (300, 400)])
def test_genetic_packing_is_not_worse_than_best_fit(spark, monkeypatch, low, high):
    monkeypatch.setattr(pack_genetic, "SHARD", 1000)
    lengths = np.random.default_rng(3).integers(low, high, 4000)
    rows = pack_genetic.pack(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id long, length long"), 1024).collect()
    plain = int(pack_genetic.founder(lengths, 1024, np.random.default_rng(0), 0.0).max()) + 1
    assert packed_well(rows, 1024) <= plain


def test_pieces_keep_their_places_when_the_table_is_scanned_in_other_splits(spark, monkeypatch):
    monkeypatch.setattr(pack_genetic, "SHARD", 500)
    lengths = [(i, 1 + i * 37 % 1024) for i in range(3000)]
    packed = pack_genetic.pack(spark.createDataFrame(lengths, "id long, length long").repartition(12), 1024)
    conf = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "100000000", "spark.sql.leafNodeDefaultParallelism": "1"}
    before = {name: spark.conf.get(name, None) for name in conf}
    first = sorted(tuple(r) for r in packed.collect())
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        again = packed.selectExpr("*").collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert sorted(tuple(r) for r in again) == first and {(r["id"], r["length"]) for r in again} == set(lengths)
    packed_well(again, 1024)


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 100, 200)
        one, two = (pack_genetic.founder(lengths, 100, rng, s) for s in (0.3, 0.6))
        child = pack_genetic.crossover(lengths, one, two, 100, rng)
        assert child.min() == 0 and np.bincount(child, weights=lengths).max() <= 100
    best = pack_genetic.evolve(lengths, [one, two], 100, rng)
    assert pack_genetic.fitness(lengths, best[0], 100) >= max(pack_genetic.fitness(lengths, p, 100) for p in (one, two))


def test_best_fit_decreasing_equals_linear_search():
    rng = random.Random(6)
    for _ in range(50):
        lengths = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 80))]
        rows = pack_bfd.best_fit_decreasing(lengths, 32)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        fill = []
        for length in sorted(lengths, reverse=True):
            able = [(32 - f, i) for i, f in enumerate(fill) if 32 - f >= length]
            if able:
                fill[min(able)[1]] += length
            else:
                fill.append(length)
        assert sorted(sum(lengths[i] for i in row) for row in rows) == sorted(fill)


def test_matrices_round_trip(make_docs, odd_docs, no_docs, paths, tmp_path):
    folder = str(tmp_path / "matrices")
    pack_bfd.write_matrices(pack_bfd.pack_matrices(make_docs(texts()), width=256), folder)
    found = defaultdict(dict)
    for r in make_docs({}).sparkSession.read.parquet(folder).collect():
        ids, positions = (np.frombuffer(r[c], "<u4") for c in ("ids", "positions"))
        assert len(ids) == len(positions) == 256 and r["cu_seqlens"][-1] == r["n_tokens"]
        for doc, piece, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            found[doc][piece] = ids[a:b].tolist()
        assert not ids[r["n_tokens"]:].any() and not positions[r["n_tokens"]:].any()
    for i, text in texts().items():
        assert [x for piece in sorted(found[i]) for x in found[i][piece]] == ids_of(text, paths)
    assert sum(len(r["doc_ids"]) for r in pack_bfd.pack_matrices(odd_docs).collect()) == 11
    assert pack_bfd.pack_matrices(no_docs).count() == 0


def test_query_digests_what_was_written(make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(pack_bfd, "new_path", lambda spark, name: str(tmp_path / name))
    docs = make_docs(texts())
    stored = pack_bfd.digests(pack_bfd.stored_matrices(docs)).collect()
    assert (tmp_path / "matrices").is_dir()
    assert sorted(map(str, stored)) == sorted(map(str, pack_bfd.digests(pack_bfd.pack_matrices(docs)).collect()))
