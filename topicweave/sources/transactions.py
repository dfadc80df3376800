"""Graph transaction text: ``t # id``, ``v id label``, ``e from to label``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions import graph as G
from topicweave.plans.tables import materialise
from topicweave.sources.files import _file_path


def _graphs(spark: SparkSession, path: str) -> DataFrame:
    """One row per graph before the end mark of its file: ``(path, graph_id, value)``."""
    chunks = spark.read.option("lineSep", "\nt # ").text(path).select(
        _file_path().alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("place"),
        F.regexp_replace("value", r"\At # ", "").alias("value"))
    graphs = chunks.withColumn("graph_id", F.regexp_extract("value", r"\A\s*(\S+)", 1)).where("graph_id <> ''")
    ends = materialise(graphs.where(F.col("graph_id") == "-1").groupBy("path").agg(F.min("place").alias("end_place")), "file_ends")
    return (graphs.join(ends, "path", "left")
            .where(F.col("end_place").isNull() | (F.col("place") < F.col("end_place"))))


def transaction_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Every graph, also one without a line of its own: ``(topic, doc_id)``."""
    return _graphs(spark, path).select(F.col("path").alias("topic"), F.col("graph_id").alias("doc_id"))


def read_graph_transactions(spark: SparkSession, path: str) -> DataFrame:
    """One row per item: ``(path, graph_id, kind, item)``, ``item`` the words of a line.

    The graph header is the record separator, so a file of any size is split
    between tasks and each record is one graph. A file ends at ``t # -1``: records
    behind that marker are dropped by their place in the file. Graph ids must be
    unique in a file and vertex ids in a graph. Graphs without items have no row
    here; ``transaction_graphs`` lists them.
    """
    lines = _graphs(spark, path).select("path", "graph_id", F.explode(F.split("value", r"\r?\n")).alias("line"))
    items = lines.select("path", "graph_id", F.split("line", " ").alias("item"))
    return items.select("path", "graph_id", F.get("item", 0).alias("kind"), "item").where(
        F.col("kind").isin("v", "e"))


def _labels(items: DataFrame) -> DataFrame:
    return items.where(F.col("kind") == "v").select(
        "path", "graph_id", F.get("item", 1).alias("id"), F.get("item", 2).alias("v"))


def transaction_vertices(items: DataFrame) -> DataFrame:
    """Vertex table ``(topic, doc_id, v)``; the file is the topic, the graph the document.

    Vertices are known by their labels: equal labels are one vertex.
    """
    return _labels(items).select(F.col("path").alias("topic"), F.col("graph_id").alias("doc_id"), "v").distinct()


def transaction_edges(items: DataFrame) -> DataFrame:
    """Edge table ``(topic, doc_id, src, dst)``; edge labels are ignored."""
    arcs = items.where(F.col("kind") == "e").select(
        "path", "graph_id", F.get("item", 1).alias("from_id"), F.get("item", 2).alias("to_id"))
    labels, graph = _labels(items), ["path", "graph_id"]
    src = labels.withColumnsRenamed({"id": "from_id", "v": "src"})
    dst = labels.withColumnsRenamed({"id": "to_id", "v": "dst"})
    return (arcs.join(src, [*graph, "from_id"]).join(dst, [*graph, "to_id"])
            .select(F.col("path").alias("topic"), F.col("graph_id").alias("doc_id"), "src", "dst").distinct())


def _items(value: Column, kind: str) -> Column:
    lines = F.filter(F.split(value, r"\r?\n"), lambda line: line.startswith(f"{kind} "))
    return F.transform(lines, lambda line: F.split(line, " "))


def _label(labels: Column, vertex_id: Column) -> Column:
    """Label of a vertex id: at its own place where ids count from 0, else looked for."""
    at_place = G.let(F.get(labels, vertex_id.try_cast("int")),
                     lambda found: F.when(found["id"] == vertex_id, found["v"]))
    ids = F.transform(labels, lambda one: one["id"])
    return F.coalesce(at_place, F.get(labels, F.array_position(ids, vertex_id).cast("int") - 1)["v"])


def read_transaction_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, doc_id, src, dst)`` of all graphs of transaction files, resolved inside the row of each graph."""
    value = F.col("value")
    labels = F.transform(_items(value, "v"), lambda item: F.struct(F.get(item, 1).alias("id"), F.get(item, 2).alias("v")))
    arcs = G.let(labels, lambda known: F.array_distinct(F.array_compact(F.transform(
        _items(value, "e"), lambda item: G.edge(_label(known, F.get(item, 1)), _label(known, F.get(item, 2)))))))
    pairs = _graphs(spark, path).select(F.col("path").alias("topic"), F.col("graph_id").alias("doc_id"), F.explode_outer(arcs).alias("pair"))
    return pairs.where(F.col("pair").isNotNull()).select(
        "topic", "doc_id", G.edge_source(F.col("pair")).alias("src"), G.edge_target(F.col("pair")).alias("dst"))


def read_transaction_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, doc_id, v)`` of all graphs of transaction files."""
    labels = F.array_distinct(F.array_compact(F.transform(_items(F.col("value"), "v"), lambda item: F.get(item, 2))))
    return _graphs(spark, path).select(F.col("path").alias("topic"), F.col("graph_id").alias("doc_id"), F.explode(labels).alias("v"))
