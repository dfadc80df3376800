from __future__ import annotations

import random

import pytest

from topicweave.llm import hamming


def slow(rows, k, every=1):
    coded = [(i, c) for i, c in rows if c is not None]
    return sorted(
        (q, i, d, place + 1) for q, cq in coded if q % every == 0
        for place, (d, i) in enumerate(sorted((((cq ^ c) % (1 << 64)).bit_count(), i) for i, c in coded)[:k]))


@pytest.mark.parametrize("n, k", [(1, 5), (3, 5), (200, 4), (400, 10)])
def test_nearest_equal_brute_force(spark, n, k):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(8)]
    rows = []
    for i in range(n):
        code = rng.choice(centres) if i % 3 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            code ^= 1 << rng.randrange(64)
        rows.append((i, code - (1 << 64) if code >> 63 else code))
    rows += [(n + i, rows[0][1]) for i in range(k)] + [(9999, None)]
    table = spark.createDataFrame(rows, "id long, code long")
    found = hamming.nearest(table, table.where("id % 7 = 0"), k).collect()
    assert sorted((r["query_id"], r["id"], r["distance"], r["place"]) for r in found) == slow(rows, k, 7)


def test_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)], "x") for i in range(60)]
    rows += [(100, [], "x"), (150, None, "x"), (200, [0.0] * 20, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance string")
    codes = [(i, sum(1 << (63 - j) for j, x in enumerate(v) if x > 0)) for i, v, _ in rows if v]
    found = hamming.nearest_vectors(vectors, k=5, every=50).collect()
    assert sorted((r["query_id"], r["vec_id"], r["distance"], r["rank"]) for r in found) == slow(codes, 5, 50)
    assert hamming.nearest_vectors(vectors.limit(0)).count() == 0
    with pytest.raises(Exception, match="at most 64"):
        hamming.nearest_vectors(spark.createDataFrame([(0, [1.0] * 65)], "vec_id long, embedding array<float>")).count()


def test_join_with_the_index_makes_a_row_for_a_list_not_for_a_code(spark, monkeypatch):
    """1500 codes that differ in one segment only: each probe of another segment meets all of them."""
    rng = random.Random(3)
    rows = [(i, code) for i, code in enumerate(rng.sample(range(1 << 12), 1500))]
    table = spark.createDataFrame(rows, "id long, code long")
    joined, plain = [], hamming._probes
    monkeypatch.setattr(hamming, "_probes", lambda *a: joined.append(plain(*a)) or joined[-1])
    lists, made = [], hamming._lists
    monkeypatch.setattr(hamming, "_lists", lambda *a: lists.append(made(*a)) or lists[-1])
    found = hamming.nearest(table, table.where("id % 50 = 0"), 3).collect()
    assert sorted((r["query_id"], r["id"], r["distance"], r["place"]) for r in found) == slow(rows, 3, 50)
    sizes = [r[0] for r in lists[0].select("segment", "value", "codes").selectExpr("size(codes)").collect()]
    assert max(sizes) <= 2 * hamming.LIST and max(sizes) > hamming.LIST // 2
    assert sum(p.join(lists[0], ["segment", "value"]).count() for p in joined) < 30 * 100
    assert all(p.rdd.getNumPartitions() > 1 for p in joined)
