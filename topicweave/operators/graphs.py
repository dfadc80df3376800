"""Document co-occurrence graphs as long tables, and their text forms.

Graph tables are keyed by any columns the caller names: ``("topic", "doc_id")``
for documents, ``("topic", "pattern_id")`` for patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions import graph as G

DOCUMENT = ("topic", "doc_id")


def document_bigrams(corpus: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Every adjacent token pair with its position."""
    pairs = corpus.select(*key, F.posexplode_outer(G.bigrams(F.col("tokens"))).alias("pos", "pair"))
    return pairs.where(F.col("pair").isNotNull()).select(
        *key, "pos", G.edge_source(F.col("pair")).alias("src"), G.edge_target(F.col("pair")).alias("dst"))


def token_steps(corpus: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Every token of a document as ``src``, with the next one as ``dst``, as often as they occur.

    ``dst`` is null where there is no edge: behind the last token, and for a self-loop made by the very first pair. The pairs come
    by the generator, so none is built as a string in the row.
    """
    steps = corpus.select(*key, "tokens", F.posexplode("tokens").alias("pos", "src"))
    after = F.get("tokens", F.col("pos") + 1)
    return steps.select(*key, "src", F.when((F.col("pos") > 0) | (F.col("src") != after), after).alias("dst"))


def document_edges(corpus: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Distinct directed edges per document. Narrow: documents are whole rows.

    The outer generator keeps the optimizer from adding a non-empty filter below
    it, which would build every graph twice. The ends are marked as never null for
    the like reason: a join on them would cut each pair again to test for null.
    """
    pairs = corpus.select(*key, F.explode_outer(G.graph_edges(F.col("tokens"))).alias("pair"))
    never_null = lambda end: F.coalesce(end, F.lit(""))
    return pairs.where(F.col("pair").isNotNull()).select(
        *key, never_null(G.edge_source(F.col("pair"))).alias("src"), never_null(G.edge_target(F.col("pair"))).alias("dst"))


def document_vertices(corpus: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Distinct vertices per document, sinks included."""
    return (corpus.select(*key, F.explode_outer(G.graph_vertices(F.col("tokens"))).alias("v"))
            .where(F.col("v").isNotNull()))


def graph_size(vertices: DataFrame, edges: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Number of vertices plus number of edges, per graph with any vertex."""
    parts = vertices.select(*key, F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(
        edges.select(*key, F.lit(0).alias("v"), F.lit(1).alias("e")))
    counted = parts.groupBy(*key).agg(F.sum("v").alias("n_vertices"), F.sum("e").alias("n_edges"))
    return counted.withColumn("graph_size", F.col("n_vertices") + F.col("n_edges"))


def adjacency_rows(vertices: DataFrame, edges: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """``(key, v, successors)``: sorted successors of each vertex, maybe none."""
    parts = vertices.select(*key, "v", F.lit(None).cast("string").alias("dst")).unionByName(
        edges.select(*key, F.col("src").alias("v"), "dst"))
    return parts.groupBy(*key, "v").agg(F.array_sort(F.collect_list("dst")).alias("successors"))


def adjacency(vertices: DataFrame, edges: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """One map ``vertex -> successors`` per graph; a lone vertex maps to nothing."""
    rows = adjacency_rows(vertices, edges, key)
    return rows.groupBy(*key).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("v", "successors")))).alias("adjacency"))


def document_adjacency(corpus: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """The same of each document that has a vertex, found inside its row: no shuffle."""
    found = corpus.select(*key, F.explode(F.array(G.successors(F.col("tokens")))).alias("entries"))
    return found.where(F.size("entries") > 0).select(*key, F.map_from_entries("entries").alias("adjacency"))


def _matrix_line() -> Column:
    listed = F.when(F.size("successors") == 0, F.lit("{}")).otherwise(F.array_join("successors", ", "))
    return F.concat("v", F.lit(" ==> "), listed).alias("line")


def graph_to_matrix(vertices: DataFrame, edges: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """One line ``v ==> a, b`` per vertex, ``{}`` where there is no successor."""
    return adjacency_rows(vertices, edges, key).select(*key, "v", _matrix_line())


def document_matrix(corpus: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """The same of documents, found inside their rows: no shuffle."""
    rows = corpus.select(*key, F.explode_outer(G.successors(F.col("tokens"))).alias("entry")).where(F.col("entry").isNotNull())
    return rows.select(*key, "entry.v", "entry.successors").select(*key, "v", _matrix_line())


def graph_to_json(vertices: DataFrame, edges: DataFrame, key: Sequence[str] = DOCUMENT) -> DataFrame:
    """Node-link JSON per graph; always valid, also without links."""
    nodes = F.struct(F.col("v").alias("id"))
    links = F.transform("successors", lambda s: F.struct(F.col("v").alias("source"), s.alias("target")))
    per_vertex = adjacency_rows(vertices, edges, key).select(*key, nodes.alias("node"), links.alias("links"))
    collected = per_vertex.groupBy(*key).agg(
        F.array_sort(F.collect_list("node")).alias("nodes"),
        F.array_sort(F.flatten(F.collect_list("links"))).alias("links"))
    return collected.select(*key, F.to_json(F.struct("nodes", "links")).alias("json"))
