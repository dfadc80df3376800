"""Intermediate tables in the cluster's shared checkpoint folder.

A written table cuts lineage, survives the loss of any executor, and gives the
optimizer its true size: a join with a small table becomes a broadcast join only
when its files are below ``spark.sql.autoBroadcastJoinThreshold``, and a shuffled
join (split by AQE where a key is hot) beyond it. That is why no join in this
package carries a broadcast hint on data that grows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths written in the scopes that are open, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_scopes", default=())


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the session.

    Without ``spark.checkpoint.dir`` it lies in the session's warehouse, the other
    folder that every executor reaches; on a cluster that must not be a folder of one machine.
    """
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR}: {warehouse} is a folder of one machine")
        folder = f"{warehouse}/scratch"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/topicweave/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable]:
    """Delete the tables that are written inside, once their last reader has been written.

    Yields a function that writes a table to stay, by ``materialise`` or the function given: it belongs to the scope around this
    one, or to nobody. Only what was given to it may be used behind the block.
    """
    around = _OPEN.get()
    written: list[str] = []

    def keep(df: DataFrame, name: str, write: Callable = materialise):
        inside = _OPEN.set(around)
        try:
            return write(df, name)
        finally:
            _OPEN.reset(inside)

    token = _OPEN.set((*around, written))
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in written:
            _delete(spark, path)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of every execution inside as soon as it ends, not when the driver happens to collect its garbage.

    A DataFrame that is executed twice inside is shuffled twice.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back. Inside ``scratch`` the table goes with the block."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counting(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, bool]:
    """Write ``df``; also tell whether any row (meeting the condition) was written.

    The rows are counted by the writing job itself, so a loop needs no second job
    to see whether it is done.
    """
    seen = Observation()
    counted = F.lit(1) if condition is None else F.when(condition, 1)
    table = materialise(df.observe(seen, F.count(counted).alias("rows")), name)
    return table, seen.get["rows"] > 0


def with_position(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in a total order.

    The sort is range-partitioned, so no task sees all rows. Positions are made
    of the row number inside a partition plus the number of rows in the
    partitions before it; the table of partition sizes has one row per sort task.
    """
    slot, part, before = f"{name}_slot", f"{name}_part", f"{name}_before"
    placed = materialise(df.orderBy(*order).withColumn(slot, F.monotonically_increasing_id()), name)
    placed = placed.withColumn(part, F.shiftright(slot, 33))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.count("*").alias("rows")).select(
        part, F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias(before))
    row_in_part = F.col(slot) - F.shiftleft(F.col(part), 33)
    return (placed.join(F.broadcast(starts), part)
            .withColumn(name, (F.col(before) + row_in_part).cast("long"))
            .drop(slot, part, before))
