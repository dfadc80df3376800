"""Connected components of a table of links.

Alternates two steps on written tables: every vertex hands the smallest vertex it
is linked with to its larger neighbours, then to its smaller ones. Links only ever
move towards smaller vertices, and the number of rounds grows with the logarithm of
the longest chain. Minima are pre-aggregated and written before they are joined, so
a vertex with very many links is a row of each task in the first and a skewed join
key, which Spark can split, in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.plans.tables import materialise


def _settle(links: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Write the distinct links; also a digest that tells two sets of them apart."""
    table = materialise(links.where("a != b").distinct(), name)
    seen = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return table, tuple(seen)


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (else the smaller) neighbours of each vertex with its smallest one."""
    both = links.union(links.select("b", "a")) if larger else links
    least = materialise(both.groupBy("a").agg(F.min("b").alias("least"))
                        .select(F.col("a").alias("v"), F.least("a", "least").alias("least")), "least")
    joined = both.join(least, F.col("a") == F.col("v"))
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("v", "least"))


def components(links: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex that has a link: ``v``, ``root``.

    ``links`` has the columns ``a`` and ``b`` of one orderable type. Self-links and
    repeated links count for nothing; a vertex without links has no row.
    """
    downward = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    table, before = _settle(downward, "links")
    while before[0]:
        large, _ = _settle(_star(table, larger=True), "large_star")
        table, after = _settle(_star(large, larger=False), "small_star")
        if after == before:
            break
        before = after
    roots = table.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return materialise(roots.union(table.select("b", "b")).groupBy("v").agg(F.min("root").alias("root")), "roots")
