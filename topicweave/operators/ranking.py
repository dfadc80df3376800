"""Support thresholds, frequent vertices with their ranks, frequent edges.

All topics are handled in one job, ``topic`` being a grouping column. Counting
groups by ``(topic, token)`` or ``(topic, edge)`` with map-side combine, so a
topic that holds a third of the corpus is still spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions import bits as B
from topicweave.functions import graph as G
from topicweave.operators.graphs import document_vertices, token_steps
from topicweave.plans.tables import materialise, with_position


#: Slots of the table of frequent tokens.
SLOTS = 1 << 20


def graph_count(corpus: DataFrame) -> DataFrame:
    """Graphs per topic; a document without any pair counts as a graph."""
    return corpus.groupBy("topic").agg(F.count("*").alias("n_graphs"))


def min_support_count(counts: DataFrame, min_support: float) -> DataFrame:
    """Smallest number of documents that makes something frequent, per topic."""
    needed = F.ceil(F.col("n_graphs").cast("double") * F.lit(float(min_support)))
    return counts.select("topic", "n_graphs", needed.cast("int").alias("min_sup"))


def vertex_frequency(vertices: DataFrame) -> DataFrame:
    """Document frequency per topic and token."""
    return vertices.groupBy("topic", "v").agg(F.count("*").cast("int").alias("df"))


def frequent_vertices(vertices: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Tokens in at least ``min_sup`` documents of their topic."""
    return (vertex_frequency(vertices).join(thresholds.select("topic", "min_sup"), "topic")
            .where(F.col("df") >= F.col("min_sup")).drop("min_sup"))


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``: the 0-based place of each row in its topic, by ``order``.

    One range-partitioned sort of all topics: a place is the row's position less that of the topic's first row. No
    task holds a topic.
    """
    placed = materialise(with_position(rows, ["topic", *order], "at"), "placed")
    first = placed.groupBy("topic").agg(F.min("at").alias("first"))
    return placed.join(first, "topic").withColumn(name, (F.col("at") - F.col("first")).cast("int")).drop("at", "first")


def rank_vertices(frequent: DataFrame) -> DataFrame:
    """Rank 0 = highest document frequency, ties by token."""
    return ranked(frequent, [F.desc("df"), "v"], "rank")


def vertex_rank(corpus: DataFrame, thresholds: DataFrame) -> DataFrame:
    return rank_vertices(frequent_vertices(document_vertices(corpus), thresholds))


def relabelled_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges with both ends frequent, tokens replaced by ranks.

    ``ranks`` should be a stored table: its size decides between two broadcast
    joins in the pass over the edges and shuffled joins.
    """
    src = ranks.select("topic", F.col("v").alias("src"), F.col("rank").alias("a"))
    dst = ranks.select("topic", F.col("v").alias("dst"), F.col("rank").alias("b"))
    return (edges.join(src, ["topic", "src"]).join(dst, ["topic", "dst"])
            .select("topic", "doc_id", "a", "b"))


def frequent_marks(ranks: DataFrame) -> DataFrame:
    """One row with ``marks``: 1 at each slot of a table of fixed size that a frequent token of some topic falls into."""
    return marks_of(ranks, "topic", "v")


def marks_of(rows: DataFrame, *columns: str) -> DataFrame:
    """One row with ``marks``: 1 at each slot of a table of fixed size that the columns of some row fall into.

    Slots travel as bitmaps, and become a byte each in the one row only.
    """
    taken = B.bitmaps(rows.select(_slot(*columns).alias("slot")), [], "slot")
    every = rows.sparkSession.range(-(-SLOTS // B.BUCKET)).select(F.col("id").alias("bucket"))
    none = F.array_repeat(F.lit(0).cast("long"), F.lit(B.WORDS))
    filled = every.join(taken, "bucket", "left").select("bucket", F.coalesce("words", none).alias("words"))
    in_order = F.sort_array(F.collect_list(F.struct("bucket", "words")))
    return materialise(filled.agg(in_order.alias("s")).select(B.bytes_of(F.flatten(F.col("s.words"))).alias("marks")), "marks")


def _slot(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def marked(table: Column, *columns) -> Column:
    """Whether the columns fall into a slot that has a mark."""
    return F.get(table, _slot(*columns).cast("int")) == 1


def marked_tokens(table: Column, tokens: Column, *of: Column) -> Column:
    """``tokens`` with null in place of those that have no mark in the table, together with the columns ``of``."""
    return F.transform(tokens, lambda t: F.when(marked(table, *of, t), t))


def possibly_frequent_pairs(corpus: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges of each document whose ends may both be frequent, as often as they occur in it.

    The ends are looked up before anything is joined. Repeats are left in: they are cheaper to carry as numbers than to find as
    strings.
    """
    table = marks.scalar()
    return token_steps(corpus).where(F.col("dst").isNotNull() & marked(table, "topic", "src") & marked(table, "topic", "dst"))


def possibly_frequent_edges(corpus: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct edges per document whose ends may both be frequent.

    Tokens are looked up in a table of one megabyte, whatever the size of the corpus, inside the document's row. Other edges
    are not even built; the few that get through by sharing a slot are dropped by the join with the ranks.
    """
    tokens = F.col("tokens")
    kept = F.flatten(F.transform("tables", lambda table: marked_tokens(table, tokens, F.col("topic"))))
    # the table is used in one expression only, so that no row carries it
    docs = corpus.select("topic", "doc_id", "tokens", F.array(marks.scalar()).alias("tables"))
    pairs = docs.select("topic", "doc_id", F.explode_outer(G.graph_edges_among(tokens, kept)).alias("pair"))
    never_null = lambda end: F.coalesce(end, F.lit(""))
    return pairs.where(F.col("pair").isNotNull()).select(
        "topic", "doc_id", never_null(G.edge_source(F.col("pair"))).alias("src"), never_null(G.edge_target(F.col("pair"))).alias("dst"))


def possibly_frequent(relabelled: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Edges that occur so often that they may be in ``min_sup`` documents, where ``relabelled`` may repeat an edge of a document."""
    return frequent_edges(relabelled, thresholds).select("topic", "a", "b")


def frequent_edges(relabelled: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Edges in at least ``min_sup`` documents, all counted in one aggregation."""
    counted = relabelled.groupBy("topic", "a", "b").agg(F.count("*").cast("int").alias("support"))
    return (counted.join(thresholds.select("topic", "min_sup"), "topic")
            .where(F.col("support") >= F.col("min_sup")).drop("min_sup"))
