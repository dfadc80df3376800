"""Stored tables: the corpus, mining results, characteristics, the dictionary.

Tables are Parquet, those read by topic partitioned by it, so a filter on the
topic reads only its files. Writers rebalance by topic first: small topics share
tasks, a topic that holds a third of the rows is split over many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from topicweave.operators.dictionary import Dictionary
from topicweave.operators.mining import MiningResult

_CHARACTERISTIC_TABLES = ["topics", "words", "patterns", "vertices", "edges"]
_DICTIONARY_TABLES = ["topics", "dimensions", "elements", "topic_vectors"]
_MINING_TABLES = ["counts", "vertices", "patterns", "pattern_docs"]


def write_by_topic(df: DataFrame, path: str, mode: str = "append") -> None:
    df.hint("rebalance", "topic").write.mode(mode).partitionBy("topic").parquet(path)


def read_by_topic(spark: SparkSession, path: str) -> DataFrame:
    """Read a topic-partitioned table; topic names stay strings ('007', '1e3')."""
    found = spark.read.parquet(path).schema
    schema = t.StructType([t.StructField(f.name, t.StringType() if f.name == "topic" else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Append normalised documents; one document or many."""
    write_by_topic(corpus, path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_by_topic(spark, path)


def graph_vertex_rows(words: DataFrame, patterns: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices as stored: a word with its document frequency, and the vertices of
    each pattern with the pattern's support, once per pattern."""
    of_words = words.select("topic", F.lit("word").alias("kind"), F.lit(None).cast("string").alias("pattern_id"),
                            F.col("v").alias("name"), F.col("df").alias("frequency"))
    of_patterns = vertices.join(patterns.select("topic", "pattern_id", "support"), ["topic", "pattern_id"]).select(
        "topic", F.lit("graph").alias("kind"), "pattern_id", F.col("v").alias("name"),
        F.col("support").alias("frequency"))
    return of_words.unionByName(of_patterns)


def graph_edge_rows(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the kept patterns, inside their own pattern."""
    kept = patterns.select("topic", "pattern_id")
    return edges.join(kept, ["topic", "pattern_id"]).select("topic", "pattern_id", "src", "dst")


def write_graph_vertices(rows: DataFrame, path: str) -> None:
    write_by_topic(rows, path)


def write_graph_edges(rows: DataFrame, path: str) -> None:
    write_by_topic(rows, path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return read_by_topic(spark, path)


def write_mining_result(result: MiningResult, folder: str) -> None:
    for name in _MINING_TABLES:
        write_by_topic(getattr(result, name), f"{folder}/{name}", mode="errorifexists")


def read_mining_result(spark: SparkSession, folder: str) -> MiningResult:
    return MiningResult(*(read_by_topic(spark, f"{folder}/{name}") for name in _MINING_TABLES))


def write_characteristics(found, folder: str) -> None:
    """Write what is characteristic of the topics as tables, for use in another session."""
    for name in _CHARACTERISTIC_TABLES:
        getattr(found, name).write.parquet(f"{folder}/{name}")


def read_characteristics(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The stored tables, in the order of the fields of ``Characteristics``."""
    return [spark.read.parquet(f"{folder}/{name}") for name in _CHARACTERISTIC_TABLES]


def write_dictionary(dictionary: Dictionary, folder: str) -> None:
    for name in _DICTIONARY_TABLES:
        getattr(dictionary, name).write.parquet(f"{folder}/{name}")


def read_dictionary(spark: SparkSession, folder: str) -> Dictionary:
    return Dictionary(*(spark.read.parquet(f"{folder}/{name}") for name in _DICTIONARY_TABLES))


def prediction_lines(predictions: DataFrame) -> DataFrame:
    """``(doc_id, line)`` with ``file :: topic [:: topic ...]``."""
    listed = predictions.groupBy("doc_id").agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    return listed.select("doc_id", F.concat_ws(" :: ", F.col("doc_id").cast("string"), F.col("topics")).alias("line"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    prediction_lines(predictions).select("line").write.text(path)
