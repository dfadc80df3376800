"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments, and every code is indexed by the value of each. Two codes
that differ in d bits differ in few bits of some segment: when the segments have been
searched with radii r, every code within (sum of all r + 1) - 1 bits has been met. A step
is one segment at one radius; steps go round the segments, radius by radius. A query
goes on step by step until its kth best distance so far is covered. A code that
is met in several steps counts in the first one only, which its bits alone tell.

The index holds the codes of a value in lists of bounded length. A step meets lists, and of a list only the codes leave
that are no further away than the query's kth best so far; what is compared inside them still grows with the table.

* Ties in distance go to the smaller id. Rows with equal codes are indexed as one code
  with its ``k`` smallest ids and the number of its rows, so a code that very many
  rows have is no hot key. A query is among its own neighbours.
* Null and empty vectors have no code: they are neither queries nor neighbours.
* With fewer than ``k`` rows all are neighbours; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.plans.tables import materialise, materialise_counting

BITS = 64
#: Codes of a list of the index, on the average of the lists of a value.
LIST = 256


def sign_bits(vector: str) -> Column:
    """The signs of a vector of up to 64 numbers as bits of a long; 1 for positive ones."""
    code = F.expr(f"aggregate(transform(`{vector}`, (x, i) -> if(x > 0, shiftleft(1L, {BITS - 1} - i), 0L)), 0L, (a, b) -> a | b)")
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"codes have at most {BITS} bits"))).when(F.size(vector) > 0, code)


def _segments(n: int) -> list[tuple[int, int]]:
    """Shift and width of each segment; not wider than the bits that it takes to number the codes.

    Wider ones have fewer codes for each value but far more values within a radius.
    """
    count = min(16, max(2, math.ceil(BITS / max(math.log2(max(n, 2)), 1))))
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(BITS - b, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def index_codes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct codes with their ``k`` smallest ids and the number of their rows."""
    by_id = Window.partitionBy("code").orderBy("id")
    first = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k)
    ids = first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    counts = rows.groupBy("code").agg(F.count("*").alias("n"))
    return ids.join(counts, "code")


def _lists(index: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """``segment``, ``value`` and ``codes`` (code, rows, smallest id) that have it; values of many codes have several lists."""
    entries = materialise(index.select(
        "code", "n", F.element_at("ids", 1).alias("first"),
        F.posexplode(F.array(*(F.shiftrightunsigned("code", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
                               for shift, width in segments))).alias("segment", "value")), "code_entries")
    sizes = materialise(entries.groupBy("segment", "value").agg(F.count("*").alias("size")), "value_sizes")
    part = F.pmod(F.xxhash64("code"), F.ceil(F.col("size") / LIST))
    return materialise(entries.join(sizes, ["segment", "value"]).groupBy("segment", "value", part.alias("part"))
                       .agg(F.collect_list(F.struct("code", "n", "first")).alias("codes")).drop("part"), "code_lists")


def _probes(queries: DataFrame, segments: list[tuple[int, int]]) -> DataFrame:
    """For each query and step from ``done`` to ``goal``: segment, value to look up, step and the query's ``bound``."""
    count = len(segments)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shells: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples():
                for step in range(row.done, row.goal):
                    segment, radius = step % count, step // count
                    shift, width = segments[segment]
                    if radius > width:
                        continue
                    if (width, radius) not in shells:
                        shells[width, radius] = np.array(
                            [sum(1 << i for i in flipped) for flipped in combinations(range(width), radius)], dtype=np.int64)
                    own = (row.code % (1 << BITS) >> shift) & ((1 << width) - 1)
                    yield pd.DataFrame({"query": row.query, "query_code": row.code, "bound": row.bound, "step": step, "segment": segment,
                                        "value": own ^ shells[width, radius]})

    kind = queries.schema["query"].dataType.simpleString()
    return queries.select("query", "code", "bound", "done", "goal").mapInPandas(
        look, f"query {kind}, query_code long, bound int, step int, segment int, value long")


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of ``rows`` for each of ``queries`` (both ``id`` and ``code``).

    Returns ``query_id``, ``id``, ``distance`` and ``place``, from 1.
    """
    rows = materialise(rows.where("code IS NOT NULL").select("id", "code"), "codes")
    index = materialise(index_codes(rows, k), "code_index")
    n_codes, n_rows = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    segments = _segments(n_codes)
    wanted = min(k, n_rows)
    lists = _lists(index, segments)
    asked = queries.where("code IS NOT NULL").select(F.col("id").alias("query"), "code").distinct()
    todo = materialise(asked.select("query", "code", F.lit(BITS).alias("bound"), F.lit(0).alias("done"), F.lit(2 * len(segments)).alias("goal")), "queries")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    best, more = None, n_rows > 0
    while more:
        # Written first: a few queries make very many probes, and their true size decides the join. The queries are few
        # bytes, which one task would read if it were left to their size.
        probes = materialise(_probes(todo.repartition(tasks, "query"), segments), "probes")
        close = F.expr("filter(codes, c -> bit_count(c.code ^ query_code) <= bound)")
        # explode_outer, so that no filter looks through the list a second time
        met = (probes.join(lists, ["segment", "value"]).select("query", "query_code", "step", F.explode_outer(close).alias("c"))
               .where("c IS NOT NULL").select("query", "query_code", "step", "c.*"))
        differs = F.col("query_code").bitwiseXOR(F.col("code"))
        earliest = F.least(*(F.bit_count(F.shiftrightunsigned(differs, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
                             * len(segments) + i for i, (shift, width) in enumerate(segments)))
        met = met.where(F.col("step") == earliest).select("query", "code", "n", "first", F.bit_count(differs).alias("distance"))
        ranked = Window.partitionBy("query").orderBy("distance", "first")
        kept = met if best is None else best.unionByName(met)
        best = materialise(kept.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).drop("place"), "best")
        running = F.sum("n").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
        kth = (best.withColumn("rows", running).groupBy("query")
               .agg(F.min(F.when(F.col("rows") >= wanted, F.col("distance"))).alias("kth")))
        state = todo.join(kth, "query", "left").select("query", "code", F.col("goal").alias("done"), "kth")
        open_ = state.where(F.col("kth").isNull() | (F.col("kth") >= F.col("done")))
        todo, more = materialise_counting(open_.select(
            "query", "code", F.coalesce("kth", F.lit(BITS)).cast("int").alias("bound"), "done", F.least(F.col("done") + len(segments), F.coalesce(F.col("kth") + 1, F.lit(1 << 30)))
            .cast("int").alias("goal")), "queries")
    if best is None:
        return rows.join(asked, F.lit(False)).select(F.col("query").alias("query_id"), "id", F.lit(0).alias("distance"), F.lit(0).alias("place"))
    by_id = Window.partitionBy("query_id").orderBy("distance", "id")
    near = best.join(index.select("code", "ids"), "code").select(
        F.col("query").alias("query_id"), F.explode("ids").alias("id"), "distance")
    return near.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k)


def nearest_vectors(vectors: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """The nearest rows by sign bits for every row whose id ``every`` divides."""
    coded = vectors.select(F.col("vec_id").alias("id"), sign_bits("embedding").alias("code"))
    found = nearest(coded, coded.where(F.col("id") % every == 0), k)
    return found.select("query_id", F.col("id").alias("vec_id"), "distance", F.col("place").alias("rank"))
