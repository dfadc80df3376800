"""The feature dictionary and the 0/1 vectors of topics and documents.

Vectors are sparse long tables, or bitmaps of them (``functions.bits``). The dimensions of a topic are consecutive, so a
topic vector is described by its first dimension and their number.

A graph is contained in another when all its elements, vertices and edges, are. Children are found by their rarest
element only: an inverted index has each child at the element that fewest parents hold, so the rows before
verification are the parents that hold it, however frequent the other elements are. The others are looked for inside the parent's row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions import bits as B
from topicweave.functions import graph as G
from topicweave.operators import ranking
from topicweave.operators.graphs import token_steps
from topicweave.operators.mining import code_order
from topicweave.operators.ranking import ranked
from topicweave.plans.tables import materialise, scratch, with_position

WORD, GRAPH = "word", "graph"


@dataclass(frozen=True)
class Dictionary:
    """* ``topics``: topic_id, topic
    * ``dimensions``: dim_id, topic_id, kind, label, n_elements
    * ``elements``: dim_id, element (a vertex, or an edge in its one-string form)
    * ``topic_vectors``: topic_id, first_dim, n_dims; topics with any dimension only
    """

    topics: DataFrame
    dimensions: DataFrame
    elements: DataFrame
    topic_vectors: DataFrame


def topic_ids(topics: DataFrame) -> DataFrame:
    """0-based topic number in order of topic name."""
    return with_position(topics.select("topic").distinct(), ["topic"], "topic_id")


def word_budget(words: DataFrame, graphs: DataFrame, max_dimension: int) -> DataFrame:
    """Words that enter the dictionary, the most frequent ones of each topic first.

    Graphs always enter. ``max_dimension`` is -1 for all words, 0 for none, or the
    size to fill up to with words.
    """
    if max_dimension == -1:
        return words
    if max_dimension == 0:
        return words.where(F.lit(False))
    used = graphs.groupBy("topic").agg(F.count("*").alias("n_graphs"))
    room = F.greatest(F.lit(0), F.lit(max_dimension) - F.coalesce("n_graphs", F.lit(0)))
    return (ranked(words, [F.desc("df"), "v"], "place").join(used, "topic", "left")
            .where(F.col("place") < room).drop("place", "n_graphs"))


def dimensions(words: DataFrame, graphs: DataFrame, ids: DataFrame) -> DataFrame:
    """Numbered dimensions ``(dim_id, topic_id, topic, kind, label)``.

    By topic number; in a topic words by falling frequency, then graphs in mining
    order. The same graph may belong to two topics and is then two dimensions.
    """
    no_code = F.array().cast("array<struct<forward:int,place:int,a:int,b:int>>")
    listed = words.select("topic", F.lit(WORD).alias("kind"), F.col("v").alias("label"),
                          F.lit(0).alias("group"), F.col("rank").alias("place"), no_code.alias("code_place"))
    listed = listed.unionByName(graphs.select(
        "topic", F.lit(GRAPH).alias("kind"), F.col("pattern_id").alias("label"),
        F.lit(1).alias("group"), F.lit(0).alias("place"), code_order(F.col("code")).alias("code_place")))
    numbered = with_position(listed.join(ids, "topic"), ["topic_id", "group", "place", "code_place"], "dim_id")
    return numbered.select("dim_id", "topic_id", "topic", "kind", "label")


def build_dictionary(words: DataFrame, graphs: DataFrame, graph_vertices: DataFrame, graph_edges: DataFrame,
                     topics: DataFrame, max_dimension: int = -1) -> Dictionary:
    """Dictionary of the characteristic words and graphs of all topics.

    A document matches a word by its vertex, and a graph by all its edges (their
    ends follow) and its vertices without an edge.
    """
    ids = materialise(topic_ids(topics), "topics")
    dims = materialise(dimensions(word_budget(words, graphs, max_dimension), graphs, ids), "dimensions")
    graph_dims = dims.where(F.col("kind") == GRAPH).select("dim_id", "topic", F.col("label").alias("pattern_id"))
    key = ["topic", "pattern_id"]
    ends = graph_edges.select(*key, F.col("src").alias("v")).unionByName(graph_edges.select(*key, F.col("dst").alias("v")))
    lone = graph_vertices.join(ends, [*key, "v"], "left_anti")
    parts = (dims.where(F.col("kind") == WORD).select("dim_id", F.col("label").alias("element"))
             .unionByName(graph_dims.join(graph_edges, key).select(
                 "dim_id", G.edge(F.col("src"), F.col("dst")).alias("element")))
             .unionByName(graph_dims.join(lone, key).select("dim_id", F.col("v").alias("element"))))
    elements = materialise(parts, "elements")
    sizes = elements.groupBy("dim_id").agg(F.count("*").cast("int").alias("n_elements"))
    sized = materialise(dims.join(sizes, "dim_id").select("dim_id", "topic_id", "kind", "label", "n_elements"),
                        "dimensions")
    vectors = materialise(topic_vectors(sized), "topic_vectors")
    return Dictionary(ids, sized, elements, vectors)


def topic_vectors(dims: DataFrame) -> DataFrame:
    """Block of ones of each topic. A topic without dimensions has no vector."""
    return dims.groupBy("topic_id").agg(F.min("dim_id").alias("first_dim"), F.count("*").alias("n_dims"))


def topic_bitmaps(dictionary: Dictionary) -> DataFrame:
    """Topic vectors as ``topic_id``, ``bucket``, ``words``."""
    return B.bitmaps(dictionary.dimensions.select("topic_id", "dim_id"), ["topic_id"], "dim_id")


def document_bitmaps(doc_dims: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Document vectors as the key, ``bucket`` and ``words``; a document without a match has no row."""
    return B.bitmaps(doc_dims, key, "dim_id")


def printed(bitmaps: DataFrame, key: Sequence[str], length: int) -> DataFrame:
    """Bitmaps as full vectors: the key and ``digits``, a string of 0 and 1 for all dimensions."""
    empty = F.array_repeat(F.lit("0" * B.BUCKET), F.lit(-(-length // B.BUCKET)))
    by_bucket = bitmaps.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", B.digits(F.col("words"))))).alias("by_bucket"))
    filled = F.transform(empty, lambda none, i: F.coalesce(F.try_element_at("by_bucket", i.cast("long")), none))
    return by_bucket.select(*key, F.substring(F.array_join(filled, ""), 1, length).alias("digits"))


def _as_array(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: d.cast("int"))


def dense_topic_vectors(dictionary: Dictionary) -> DataFrame:
    """The bitmaps of topics as full 0/1 arrays over all dimensions."""
    found = printed(topic_bitmaps(dictionary), ["topic_id"], dictionary.dimensions.count())
    return found.select("topic_id", _as_array(F.col("digits")).alias("vector"))


def element_occurrences(docs: DataFrame, elements: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``key`` and ``element``: vertices and edges of the documents' graphs between tokens of some given elements, as often as they occur.

    Tokens are looked up in a table of one megabyte, so other elements are not built; those that get through by sharing a
    slot are none of the given ones and meet nothing later.
    """
    ends = elements.select(F.explode(F.split("element", G.EDGE_SEPARATOR)).alias("token")).distinct()
    table = ranking.marks_of(ends, "token").scalar()
    steps = token_steps(docs.where(F.size("tokens") >= 2), key).where(ranking.marked(table, "src"))
    edges = steps.where(F.col("dst").isNotNull() & ranking.marked(table, "dst"))
    return steps.select(*key, F.col("src").alias("element")).unionByName(
        edges.select(*key, G.edge(F.col("src"), F.col("dst")).alias("element")))


def known_elements(docs: DataFrame, elements: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each document with ``elements``: those of ``element_occurrences``, each once."""
    listed = element_occurrences(docs, elements, key).groupBy(*key).agg(F.collect_set("element").alias("elements"))
    return docs.select(*key).join(listed, [*key], "left").select(*key, F.coalesce("elements", F.array().cast("array<string>")).alias("elements"))


def rarest_elements(elements: DataFrame, child_key: Sequence[str], frequency: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The inverted index: one row for each child at its rarest ``element``, with the ``rest`` of its elements.

    ``frequency`` has ``element`` and ``n``, its parents; a child with an element that no parent has is in none, and is left out.
    """
    known = elements.join(frequency, "element", "left")
    listed = known.groupBy(*child_key, *carried).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "element"))).alias("by_rarity"))
    return listed.where(F.get("by_rarity", 0)["n"] > 0).select(
        *child_key, *carried, F.get("by_rarity", 0)["element"].alias("element"),
        F.transform(F.slice("by_rarity", 2, F.greatest(F.size("by_rarity") - 1, F.lit(0))), lambda e: e["element"]).alias("rest"))


def _contained(wanted: Column, elements: Column) -> Column:
    """The children whose ``rest`` is among the elements; these are looked through once for all children together."""
    asked = F.array_distinct(F.flatten(F.transform(wanted, lambda child: child["rest"])))
    return G.let(F.array_except(asked, elements), lambda missing: F.filter(wanted, lambda child: ~F.arrays_overlap(child["rest"], missing)))


def _held_and_index(docs: DataFrame, dictionary: Dictionary, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The dictionary's elements that each document holds, as ``key`` and ``element``, and the index of the dimensions by their rarest one.

    Elements are numbers here, so that what is made distinct, shuffled and looked through are longs.
    """
    numbers = materialise(dictionary.elements.select("element").distinct().withColumn("number", F.monotonically_increasing_id()), "element_numbers")

    def numbered(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(numbers, "element").select(*columns, F.col("number").alias("element"))

    held = materialise(numbered(element_occurrences(docs, dictionary.elements, key), *key).distinct(), "known_elements")
    frequency = materialise(held.groupBy("element").agg(F.count("*").alias("n")), "element_frequency")
    of_topic = dictionary.dimensions.select("dim_id", "topic_id")
    parts = numbered(dictionary.elements, "dim_id").join(of_topic, "dim_id")
    return held, materialise(rarest_elements(parts, ["dim_id"], frequency, ["topic_id"]), "rarest_elements")


def candidate_dimensions(docs: DataFrame, dictionary: Dictionary, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Documents and the dimensions whose rarest element they hold: ``key``, ``dim_id``, ``topic_id``, ``rest`` (numbers of elements)."""
    held, index = _held_and_index(docs, dictionary, key)
    return held.join(index, "element").select(*key, "dim_id", "topic_id", "rest")


def document_dimensions(docs: DataFrame, dictionary: Dictionary, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Dimensions each document contains: ``(key, dim_id, topic_id)``.

    The documents are exploded once, and only tokens of the dictionary get any further. A dimension of one element, such as a word,
    is found by the index alone. The others of a document are verified together in one row, which lists the elements that these ask for.
    """
    with scratch(docs.sparkSession) as keep:
        held, index = _held_and_index(docs, dictionary, key)
        alone = held.join(index.where(F.size("rest") == 0), "element").select(*key, "dim_id", "topic_id")
        more = index.where(F.size("rest") > 0)
        wanted = held.join(more, "element").groupBy(*key).agg(F.collect_list(F.struct("dim_id", "topic_id", "rest")).alias("wanted"))
        asked = more.select(F.explode("rest").alias("element")).distinct()
        listed = held.join(asked, "element", "left_semi").groupBy(*key).agg(F.collect_list("element").alias("elements"))
        verified = listed.join(wanted, [*key]).select(
            *key, F.explode(_contained(F.col("wanted"), F.col("elements"))).alias("child"))
        return keep(alone.unionByName(verified.select(*key, "child.dim_id", "child.topic_id")), "document_dimensions")


def graph_contains(parent_edges: DataFrame, parent_vertices: DataFrame, parent_key: Sequence[str],
                   child_edges: DataFrame, child_vertices: DataFrame, child_key: Sequence[str]) -> DataFrame:
    """Pairs of parent and child graph in which the parent contains the child."""
    def parts(vertices: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
        return vertices.select(*key, F.col("v").alias("element")).unionByName(
            edges.select(*key, G.edge(F.col("src"), F.col("dst")).alias("element")))

    with scratch(parent_edges.sparkSession) as keep:
        children = parts(child_vertices, child_edges, child_key)
        # the parents are looked through once, for the elements that any child has
        parents = materialise(parts(parent_vertices, parent_edges, parent_key).join(
            children.select("element").distinct(), "element", "left_semi"), "known_elements")
        frequency = materialise(parents.groupBy("element").agg(F.count("*").alias("n")), "element_frequency")
        index = materialise(rarest_elements(children, child_key, frequency), "rarest_elements")
        found = materialise(parents.join(index, "element").select(*parent_key, *child_key, "rest"), "candidate_graphs")
        alone = found.where(F.size("rest") == 0).select(*parent_key, *child_key)
        more = found.where(F.size("rest") > 0)
        wanted = more.groupBy(*parent_key).agg(F.collect_list(F.struct(*child_key, "rest")).alias("wanted"))
        held = parents.join(more.select(*parent_key).distinct(), [*parent_key], "left_semi").groupBy(*parent_key).agg(
            F.collect_list("element").alias("elements"))
        verified = held.join(wanted, [*parent_key]).select(
            *parent_key, F.explode(_contained(F.col("wanted"), F.col("elements"))).alias("child"))
        return keep(alone.unionByName(verified.select(*parent_key, *(F.col("child")[c].alias(c) for c in child_key))), "contained_graphs")


def document_digits(docs: DataFrame, doc_dims: DataFrame, dictionary: Dictionary, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Full vectors as ``digits``, a string of 0 and 1, one per document, also for documents without a match."""
    length = dictionary.dimensions.count()
    found = printed(document_bitmaps(doc_dims, key), key, length)
    return docs.select(*key).join(found, [*key], "left").select(*key, F.coalesce("digits", F.repeat(F.lit("0"), F.lit(length))).alias("digits"))


def dense_document_vectors(docs: DataFrame, doc_dims: DataFrame, dictionary: Dictionary,
                           key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The same as 0/1 arrays."""
    return document_digits(docs, doc_dims, dictionary, key).select(*key, _as_array(F.col("digits")).alias("vector"))
