"""The user-level jobs, from folders of text to predicted topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.functions.text import MIN_TOKENS
from topicweave.operators import compare, mining
from topicweave.operators.corpus import list_topics, normalise_corpus, tokenised_corpus
from topicweave.operators.dictionary import Dictionary, build_dictionary
from topicweave.operators.discover import discover_topics
from topicweave.operators.mining import MiningResult, mine_frequent_subgraphs
from topicweave.plans.tables import materialise, scratch
from topicweave.sources import files, reports, store, transactions


@dataclass(frozen=True)
class Characteristics:
    """What is kept of each topic.

    * ``topics``: topic
    * ``words``: topic, v, df, rank
    * ``patterns``: topic, pattern_id, code, n_edges, support, distance
    * ``vertices``, ``edges``: of the kept patterns, in tokens
    """

    topics: DataFrame
    words: DataFrame
    patterns: DataFrame
    vertices: DataFrame
    edges: DataFrame


def prepare_corpus(spark: SparkSession, root: str, stopwords_file: str, store_path: str,
                   min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Normalise a labelled folder of raw texts and add it to the stored corpus."""
    stopwords = files.read_stopwords(spark, stopwords_file)
    store.write_corpus(normalise_corpus(files.read_labelled_corpus(spark, root), stopwords, min_tokens), store_path)
    return store.read_corpus(spark, store_path)


def mine_folder(spark: SparkSession, folder: str, min_support: float, max_edges: int | None = None,
                boundary: str | None = None) -> MiningResult:
    """Mine one folder of tokenised files, one token per line, as one document set."""
    docs = files.read_documents(spark, folder, boundary).withColumn("topic", F.lit(folder)).withColumn("doc_id", F.col("path"))
    return mine_frequent_subgraphs(materialise(tokenised_corpus(docs), "corpus"), min_support, max_edges)


def mine_folders(spark: SparkSession, root: str, min_support: float, max_edges: int | None = None,
                 boundary: str | None = None) -> MiningResult:
    """Mine every sub-folder of tokenised files as a document set of its own, in one job."""
    docs = files.read_document_folders(spark, root, boundary)
    return mine_frequent_subgraphs(materialise(tokenised_corpus(docs), "corpus"), min_support, max_edges)


def mine_transactions(spark: SparkSession, path: str, min_support: float, max_edges: int | None = None) -> MiningResult:
    """Mine graph transaction files, each as one document set; graphs without vertices count."""
    graphs = materialise(transactions.transaction_graphs(spark, path), "transaction_graphs")
    return mine_frequent_subgraphs(graphs, min_support, max_edges, transactions.read_transaction_edges(spark, path),
                                   transactions.read_transaction_vertices(spark, path))


def extract_characteristics(result: MiningResult, min_distance: float,
                            drop_patternless_topics: bool = False) -> Characteristics:
    """Words frequent in one topic only, and patterns far from all other topics'.

    Topics without any pattern take part unless ``drop_patternless_topics``.
    """
    patterns, vertices, topics = result.patterns, result.vertices, result.counts.select("topic")
    key = ["topic", "pattern_id"]
    with scratch(patterns.sparkSession) as keep:
        if drop_patternless_topics:
            topics = patterns.select("topic").distinct()
            vertices = vertices.join(topics, "topic", "left_semi")
        all_vertices = materialise(mining.pattern_vertices(patterns, vertices), "pattern_vertices")
        all_edges = materialise(mining.pattern_edges(patterns, vertices), "pattern_edges")
        nearest = compare.nearest_foreign_pattern(all_vertices, all_edges)
        kept = keep(patterns.join(compare.characteristic_patterns(nearest, min_distance), key), "characteristic_patterns")
        return Characteristics(keep(topics, "topics"), keep(compare.unique_words(vertices), "unique_words"), kept,
                               keep(all_vertices.join(kept.select(*key), key), "graph_vertices"),
                               keep(all_edges.join(kept.select(*key), key), "graph_edges"))


def topic_model(corpus: DataFrame, min_support: float, min_distance: float, max_edges: int | None = None,
                drop_patternless_topics: bool = True) -> Characteristics:
    """Mine all topics of a stored corpus and keep what is characteristic of each; the mining result goes."""
    with scratch(corpus.sparkSession) as keep:
        found = extract_characteristics(mine_frequent_subgraphs(corpus, min_support, max_edges), min_distance,
                                        drop_patternless_topics)
        return Characteristics(*(keep(getattr(found, f.name), f.name) for f in fields(found)))


def store_characteristics(found: Characteristics, folder: str) -> None:
    """Write the graph store: a vertex and an edge table."""
    store.write_graph_vertices(store.graph_vertex_rows(found.words, found.patterns, found.vertices),
                               f"{folder}/graph_vertices")
    store.write_graph_edges(store.graph_edge_rows(found.patterns, found.edges), f"{folder}/graph_edges")


def write_mining_report(result: MiningResult, path: str) -> None:
    reports.write_report(reports.mining_report(result), path)


def write_characteristic_report(found: Characteristics, path: str) -> None:
    reports.write_report(reports.characteristic_report(
        found.topics, found.words, found.patterns, found.vertices, found.edges), path)


def create_dictionary(found: Characteristics, max_dimension: int = -1) -> Dictionary:
    return build_dictionary(found.words, found.patterns, found.vertices, found.edges, found.topics, max_dimension)


def discover_files(spark: SparkSession, folder: str, dictionary: Dictionary, boundary: str | None = None) -> DataFrame:
    """Predicted topics of the tokenised files in a folder, keyed by file name."""
    docs = files.read_document_files(spark, folder, boundary).withColumn("topic", F.lit(None).cast("string"))
    return discover_topics(tokenised_corpus(docs), dictionary)


def discover_texts(docs: DataFrame, stopwords: Sequence[str] | DataFrame, dictionary: Dictionary) -> DataFrame:
    """Predicted topics of raw texts ``(doc_id, text)``, normalised first."""
    raw = docs.select(F.lit(None).cast("string").alias("topic"), "doc_id", F.lit(None).cast("string").alias("path"), "text")
    corpus = materialise(normalise_corpus(raw, stopwords, min_tokens=0), "texts")
    return discover_topics(corpus, dictionary)


__all__ = [
    "Characteristics", "create_dictionary", "discover_files", "discover_texts", "extract_characteristics",
    "list_topics", "mine_folder", "mine_folders", "mine_transactions", "prepare_corpus", "store_characteristics", "topic_model",
    "write_characteristic_report", "write_mining_report",
]
