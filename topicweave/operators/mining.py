"""Frequent subgraphs of every topic, grown level by level.

Vertex labels are unique inside a document graph, so a pattern occurs in a
document at most once, and exactly when all its edges do. The documents of a topic are
numbered, and the documents of an edge or of a pattern are bitmaps of these numbers. Mining is a loop over
levels: the patterns with k edges, joined with the frequent edges, propose those with
k + 1, whose documents are the common bits of the pattern and the new edge.

There are two classes of patterns. ``mode="connected"`` finds every weakly connected set of frequent edges that is
frequent itself, each once, as its sorted edges. ``mode="rooted"`` finds the smaller class described in the following.

A pattern is a sequence of coded edges ``(i, j, a, b)``: an edge from pattern
vertex ``i`` with rank ``a`` to pattern vertex ``j`` with rank ``b``. Which sets
of edges are found, and found once, follows from these rules:

* a new edge leaves a vertex on the path from the root to the newest vertex, or
  closes a cycle from the newest vertex to one of its ancestors, the parent
  excepted, in ascending order of the ancestors;
* every vertex with an outgoing edge other than the root ranks after the root;
* children of a vertex are added in ascending rank;
* an edge back to ``w`` from ``u`` needs the first child of ``w`` not to rank
  after ``u``.

So edges are followed forwards only: in-stars, diamonds and two-cycles are found
as single edges, but by ``connected`` as a whole. In both classes a self-loop is a pattern of its own and is not extended. A topic
with one document has ranked vertices but no patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions import bits as B
from topicweave.operators import ranking
from topicweave.plans.tables import materialise, materialise_counting, scratch, with_position

_CODE = "array<struct<i:int,j:int,a:int,b:int>>"
_PATH = "array<struct<i:int,lbl:int>>"
_STEP = ["i", "j", "a", "b"]
_EDGES = "array<struct<a:int,b:int>>"


@dataclass(frozen=True)
class MiningResult:
    """Ranked vertices and patterns of all topics.

    * ``counts``: topic, n_graphs, min_sup
    * ``vertices``: topic, v, df, rank
    * ``patterns``: topic, pattern_id, code, n_edges, support
    * ``pattern_docs``: topic, pattern_id, doc_id
    """

    counts: DataFrame
    vertices: DataFrame
    patterns: DataFrame
    pattern_docs: DataFrame


def _step(i: Column, j: Column, a: Column, b: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"),
                    a.cast("int").alias("a"), b.cast("int").alias("b"))


def _node(i: Column, label: Column) -> Column:
    return F.struct(i.cast("int").alias("i"), label.cast("int").alias("lbl"))


def seed_patterns(frequent: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One pattern per frequent edge, in topics with more than one graph."""
    several = thresholds.where(F.col("n_graphs") > 1).select("topic", "min_sup")
    zero, one = F.lit(0), F.lit(1)
    return frequent.join(several, "topic").select(
        "topic", "min_sup", "support",
        F.array(_step(zero, one, F.col("a"), F.col("b"))).cast(_CODE).alias("code"),
        F.array("a", "b").alias("labels"),
        F.array(_node(zero, F.col("a")), _node(one, F.col("b"))).cast(_PATH).alias("path"),
        F.lit(-1).alias("bound"),
        F.monotonically_increasing_id().alias("pid"))


def pattern_extensions(level: DataFrame, frequent: DataFrame) -> DataFrame:
    """Candidate next edges of each pattern, before any document is looked at."""
    arcs = frequent.select("topic", F.col("a").alias("from_label"), F.col("b").alias("to_label"))
    nodes = (level.where(F.get("code", 0)["a"] != F.get("code", 0)["b"])
             .select("*", F.posexplode("path").alias("k", "node"))
             .withColumn("from_label", F.col("node.lbl")))
    last = F.size("path") - 1
    reached = F.filter("path", lambda n: n["lbl"] == F.col("to_label"))
    joined = nodes.join(arcs, ["topic", "from_label"]).withColumn("ancestor", F.get(reached, 0))
    after_root = F.col("from_label") > F.get("path", 0)["lbl"]
    next_on_path = F.get("path", F.col("k") + 1)["lbl"]
    forward = (~F.array_contains("labels", F.col("to_label"))
               & ((F.col("k") == 0) | after_root)
               & ((F.col("k") == last) | (F.col("to_label") > next_on_path)))
    first_child = F.get(F.filter("code", lambda c: (c["i"] == F.col("ancestor.i")) & (c["i"] < c["j"])), 0)["b"]
    parent = F.get("path", last - 1)["i"]
    backward = ((F.col("k") == last) & F.col("ancestor").isNotNull()
                & (F.col("ancestor.i") < parent) & (F.col("ancestor.i") > F.col("bound"))
                & after_root & (first_child <= F.col("from_label")))
    kind = F.when(forward, F.lit("f")).when(backward, F.lit("b"))
    return (joined.withColumn("kind", kind).where(F.col("kind").isNotNull())
            .select("topic", "min_sup", "code", "labels", "path", "bound", F.col("pid").alias("parent"),
                    F.col("k"), "kind", F.col("node.i").alias("i"),
                    F.when(F.col("kind") == "f", F.size("labels")).otherwise(F.col("ancestor.i")).alias("j"),
                    F.col("from_label").alias("a"), F.col("to_label").alias("b")))


def document_numbers(doc_edges: DataFrame) -> DataFrame:
    """``topic``, ``doc_id``, ``doc_no``: a topic's documents have consecutive numbers."""
    return with_position(doc_edges.select("topic", "doc_id").distinct(), ["topic", "doc_id"], "doc_no")


def edge_bitmaps(doc_edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Documents of each edge: ``topic``, ``a``, ``b``, ``bucket``, ``words``."""
    return B.bitmaps(doc_edges.join(numbers, ["topic", "doc_id"]), ["topic", "a", "b"], "doc_no")


def extension_bitmaps(held: DataFrame, extensions: DataFrame, edge_bits: DataFrame, step: list[str] = _STEP) -> DataFrame:
    """Documents that hold a pattern and an edge that extends it, and how many they are, by bucket.

    ``held`` are the patterns' own (``topic``, ``pid``, ``bucket``, ``words``). A candidate costs one row of 64 words for 4096
    documents, however many of them hold it.
    """
    steps = extensions.select("topic", F.col("parent").alias("pid"), *step)
    of_edge = edge_bits.select("topic", "a", "b", "bucket", F.col("words").alias("edge_words"))
    common = B.both(F.col("words"), F.col("edge_words"))
    met = steps.join(held, ["topic", "pid"]).join(of_edge, ["topic", "a", "b", "bucket"])
    return (met.select("topic", F.col("pid").alias("parent"), *step, "bucket", common.alias("words"))
            .withColumn("n", B.ones(F.col("words"))).where("n > 0"))


def extension_support(found: DataFrame, step: list[str] = _STEP) -> DataFrame:
    """Documents per extension."""
    return found.groupBy("topic", "parent", *step).agg(F.sum("n").cast("int").alias("support"))


def grow_patterns(extensions: DataFrame, support: DataFrame) -> DataFrame:
    """Extended patterns that stay frequent."""
    forward = F.col("kind") == "f"
    new_path = F.concat(F.slice("path", 1, F.col("k") + 1), F.array(_node(F.col("j"), F.col("b"))).cast(_PATH))
    return (extensions.join(support, ["topic", "parent", *_STEP]).where(F.col("support") >= F.col("min_sup"))
            .select("topic", "min_sup", "support",
                    F.concat("code", F.array(_step(F.col("i"), F.col("j"), F.col("a"), F.col("b"))).cast(_CODE)).alias("code"),
                    F.when(forward, F.array_append("labels", F.col("b"))).otherwise(F.col("labels")).alias("labels"),
                    F.when(forward, new_path).otherwise(F.col("path")).alias("path"),
                    F.when(forward, F.lit(-1)).otherwise(F.col("j")).alias("bound"),
                    "parent", *_STEP, F.monotonically_increasing_id().alias("pid")))


def pattern_id(code: Column) -> Column:
    """Readable identity of a pattern inside its topic, the same in every run."""
    return F.array_join(F.transform(code, lambda c: F.concat(
        c["i"].cast("string"), F.lit("-"), c["j"].cast("string"), F.lit(":"),
        c["a"].cast("string"), F.lit(">"), c["b"].cast("string"))), ",")


def code_order(code: Column) -> Column:
    """Sort key of a pattern: a pattern comes right before its extensions.

    Between extensions of one pattern, edges back come first, by the ancestor they
    reach; then edges forward, from the newest vertex to the root, by rank.
    """
    return F.transform(code, lambda c: F.struct(
        (c["i"] < c["j"]).cast("int").alias("forward"),
        F.when(c["i"] < c["j"], -c["i"]).otherwise(c["j"]).alias("place"),
        c["a"].alias("a"), c["b"].alias("b")))


def connected_seeds(frequent: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One pattern per frequent edge, as a set of edges."""
    return seed_patterns(frequent, thresholds).select(
        "topic", "min_sup", "support", F.array(F.struct(F.get("code", 0)["a"].alias("a"), F.get("code", 0)["b"].alias("b"))).cast(_EDGES).alias("edges"),
        "pid")


def connected_extensions(level: DataFrame, frequent: DataFrame) -> DataFrame:
    """Sets with one edge more that touches the pattern, whichever way it points.

    A set is proposed by each of its parts that is a pattern; one proposal stays, so every set is counted once.
    """
    arcs = frequent.where("a <> b").select("topic", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    touching = arcs.select("*", F.col("a").alias("at")).unionByName(arcs.select("*", F.col("b").alias("at")))
    ends = F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["a"], e["b"]))))
    nodes = level.where(F.get("edges", 0)["a"] != F.get("edges", 0)["b"]).select("topic", "min_sup", "edges", "pid", F.explode(ends).alias("at"))
    new = F.struct("a", "b")
    grown = F.array_sort(F.array_append("edges", new))
    return (nodes.join(touching, ["topic", "at"]).where(~F.array_contains("edges", new))
            .groupBy("topic", "min_sup", grown.alias("edges")).agg(F.min(F.struct("pid", "a", "b")).alias("by"))
            .select("topic", "min_sup", "edges", F.col("by.pid").alias("parent"), "by.a", "by.b"))


def connected_growth(extensions: DataFrame, support: DataFrame) -> DataFrame:
    """Sets that stay frequent."""
    return (extensions.join(support, ["topic", "parent", "a", "b"]).where(F.col("support") >= F.col("min_sup"))
            .select("topic", "min_sup", "support", "edges", "parent", "a", "b", F.monotonically_increasing_id().alias("pid")))


def edge_code(edges: Column) -> Column:
    """Code of a set of edges in sorted order; its vertices are numbered as they come up in it."""
    labels = F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e["a"], e["b"]))))
    return F.transform(edges, lambda e: _step(F.array_position(labels, e["a"]) - 1, F.array_position(labels, e["b"]) - 1, e["a"], e["b"])).cast(_CODE)


@dataclass(frozen=True)
class _Class:
    """A class of patterns: how its levels begin and grow, and what tells two extensions of a pattern apart."""

    seeds: Callable[[DataFrame, DataFrame], DataFrame]
    extensions: Callable[[DataFrame, DataFrame], DataFrame]
    grown: Callable[[DataFrame, DataFrame], DataFrame]
    step: list[str]
    code: Callable[[], Column]


_CLASSES = {
    "rooted": _Class(seed_patterns, pattern_extensions, grow_patterns, _STEP, lambda: F.col("code")),
    "connected": _Class(connected_seeds, connected_extensions, connected_growth, ["a", "b"], lambda: edge_code(F.col("edges"))),
}


def mine_frequent_subgraphs(corpus: DataFrame, min_support: float, max_edges: int | None = None,
                            edges: DataFrame | None = None, vertices: DataFrame | None = None, mode: str = "rooted") -> MiningResult:
    """Ranked frequent vertices and frequent subgraphs of each topic.

    ``corpus`` should be a stored table, since it is scanned for the counts, the
    vertices and the edges. Graphs that do not come from token sequences are given
    as ``edges`` and ``vertices``; ``corpus`` then only lists them. ``max_edges``
    stops the growth early if the caller wants smaller patterns only; ``connected`` needs it, since every connected
    part of a frequent pattern is a pattern there. Only the tables of the result stay in the scratch folder.
    """
    if mode not in _CLASSES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "connected" and max_edges is None:
        raise ValueError("connected patterns need max_edges")
    kind = _CLASSES[mode]
    spark = corpus.sparkSession
    levels, level_bits = [], []
    with scratch(spark) as keep:
        counts = keep(ranking.min_support_count(ranking.graph_count(corpus), min_support), "counts")
        ranks = keep(ranking.vertex_rank(corpus, counts) if vertices is None
                     else ranking.rank_vertices(ranking.frequent_vertices(vertices, counts)), "vertices")
        all_edges = ranking.possibly_frequent_pairs(corpus, ranking.frequent_marks(ranks)) if edges is None else edges
        relabelled = materialise(ranking.relabelled_edges(all_edges, ranks), "relabelled")
        # few edges occur often enough to be frequent, so repeats in a document are looked for among these only
        often = materialise(ranking.possibly_frequent(relabelled, counts), "often")
        once = materialise(relabelled.join(often, ["topic", "a", "b"], "left_semi").distinct(), "often_once")
        frequent = materialise(ranking.frequent_edges(once, counts), "frequent_edges")
        doc_edges = once.join(frequent.select("topic", "a", "b"), ["topic", "a", "b"], "left_semi")
        numbers = keep(document_numbers(doc_edges), "document_numbers")
        edge_bits = materialise(edge_bitmaps(doc_edges, numbers), "edge_bitmaps")

        level = keep(kind.seeds(frequent, counts), "level")
        first = F.get(kind.code(), 0)
        seeds = level.select("topic", first["a"].alias("a"), first["b"].alias("b"), "pid")
        held = keep(edge_bits.join(seeds, ["topic", "a", "b"]).select("topic", "pid", "bucket", "words"), "bitmaps")
        while True:
            levels.append(level)
            level_bits.append(held.join(level.select("topic", "pid", pattern_id(kind.code()).alias("pattern_id")), ["topic", "pid"]))
            if max_edges is not None and len(levels) >= max_edges:
                break
            with scratch(spark):
                extensions = materialise(kind.extensions(level, frequent), "extensions")
                found = materialise(extension_bitmaps(held, extensions, edge_bits, kind.step), "extension_bitmaps")
                grown, any_grown = keep(kind.grown(extensions, extension_support(found, kind.step)), "level", materialise_counting)
                if not any_grown:
                    break
                same = ["topic", "parent", *kind.step]
                held = keep(found.join(grown.select(*same, "pid"), same).select("topic", "pid", "bucket", "words"), "bitmaps")
                level = grown.drop("parent", *kind.step)

    patterns = reduce(DataFrame.unionByName, [
        one.select("topic", pattern_id(kind.code()).alias("pattern_id"), kind.code().alias("code"), "support") for one in levels]).select(
        "topic", "pattern_id", "code", F.size("code").alias("n_edges"), "support")
    held_in = reduce(DataFrame.unionByName, level_bits).select(
        "topic", "pattern_id", F.explode(B.positions(F.col("bucket"), F.col("words"))).alias("doc_no"))
    return MiningResult(counts, ranks, patterns, held_in.join(numbers, ["topic", "doc_no"]).select("topic", "pattern_id", "doc_id"))


def pattern_edges(patterns: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pattern edges in tokens; a self-loop pattern has none."""
    steps = patterns.select("topic", "pattern_id", F.explode("code").alias("c")).select(
        "topic", "pattern_id", F.col("c.a").alias("a"), F.col("c.b").alias("b")).where("a <> b")
    src = vertices.select("topic", F.col("rank").alias("a"), F.col("v").alias("src"))
    dst = vertices.select("topic", F.col("rank").alias("b"), F.col("v").alias("dst"))
    return steps.join(src, ["topic", "a"]).join(dst, ["topic", "b"]).select("topic", "pattern_id", "src", "dst")


def pattern_vertices(patterns: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct pattern vertices in tokens."""
    ends = F.array_distinct(F.flatten(F.transform("code", lambda c: F.array(c["a"], c["b"]))))
    labels = patterns.select("topic", "pattern_id", F.explode(ends).alias("rank"))
    return labels.join(vertices.select("topic", "rank", "v"), ["topic", "rank"]).select("topic", "pattern_id", "v")
