"""What is characteristic of a topic: words and subgraphs no other topic has.

Graphs are given as two long tables, ``vertices(topic, pattern_id, v)`` and
``edges(topic, pattern_id, src, dst)``. The size of a graph is its number of
vertices plus its number of edges. The maximum common subgraph of two graphs is
the largest weakly connected part of their common edges; a common vertex alone
counts 1. The distance is ``1 - common size / larger size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.operators.graphs import graph_size
from topicweave.plans.tables import materialise, materialise_counting, scratch

PATTERN = ["topic", "pattern_id"]
PAIR = ["topic_x", "pattern_x", "topic_y", "pattern_y"]


def unique_words(vertices: DataFrame) -> DataFrame:
    """Frequent words of a topic that are frequent in no other topic.

    One aggregation by word instead of an anti-join of the table with itself.
    """
    by_word = vertices.groupBy("v").agg(F.count("*").alias("n_topics"), F.max("topic").alias("topic"),
                                        F.max("df").alias("df"), F.max("rank").alias("rank"))
    return by_word.where(F.col("n_topics") == 1).select("topic", "v", "df", "rank")


def pattern_sizes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return graph_size(vertices, edges, PATTERN).select(*PATTERN, F.col("graph_size").cast("int").alias("graph_size"))


def distance(common: Column, size_x: Column, size_y: Column) -> Column:
    """1 for graphs without a common part, 0 for equal connected graphs."""
    return F.lit(1.0) - common.cast("double") / F.greatest(size_x, size_y).cast("double")


# --- maximum common subgraph of given pairs -------------------------------------------------


def max_common_subgraph_size(pairs: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Common subgraph size of each pair ``(topic_x, pattern_x, topic_y, pattern_y)``.

    The common edges of all pairs are found by one join. Their components come
    from spreading the smallest vertex label along the edges of all pairs at
    once; labels also jump to the label of their label, so the number of rounds
    follows the logarithm of the longest chain.
    """
    key = PAIR
    pairs = materialise(pairs.select(*key).distinct(), "pairs")

    def of(graph: DataFrame, side: str) -> DataFrame:
        return graph.withColumnsRenamed({"topic": f"topic_{side}", "pattern_id": f"pattern_{side}"})

    def common(graph: DataFrame, columns: list[str]) -> DataFrame:
        left = pairs.join(of(graph, "x"), ["topic_x", "pattern_x"])
        return left.join(of(graph, "y"), ["topic_y", "pattern_y", *columns]).select(*key, *columns)

    shared_edges = materialise(common(edges, ["src", "dst"]), "shared_edges")
    shared_vertex = common(vertices, ["v"]).groupBy(*key).agg(F.lit(1).alias("one"))
    both_ways = materialise(shared_edges.select(*key, F.col("src").alias("v"), F.col("dst").alias("other")).unionByName(
        shared_edges.select(*key, F.col("dst").alias("v"), F.col("src").alias("other"))).distinct(), "arcs")
    labels = materialise(both_ways.groupBy(*key, "v").agg(F.min("other").alias("near"))
                         .select(*key, "v", F.least("v", "near").alias("label")), "labels")
    while True:
        offered = labels.withColumnRenamed("v", "other").join(both_ways, [*key, "other"]).select(
            *key, "v", F.col("label").alias("offer"))
        jumped = labels.join(labels.select(*key, F.col("v").alias("label"), F.col("label").alias("offer")),
                             [*key, "label"]).select(*key, "v", "offer")
        best = offered.unionByName(jumped).groupBy(*key, "v").agg(F.min("offer").alias("offer"))
        moved = labels.join(best, [*key, "v"])
        moved, any_moved = materialise_counting(
            moved.select(*key, "v", F.least("label", "offer").alias("label"),
                         (F.col("offer") < F.col("label")).alias("changed")), "labels", F.col("changed"))
        labels = moved.drop("changed")
        if not any_moved:
            break
    part_edges = shared_edges.join(labels.withColumnRenamed("v", "src"), [*key, "src"]).groupBy(*key, "label").agg(
        F.count("*").alias("n_edges"))
    part_vertices = labels.groupBy(*key, "label").agg(F.count("*").alias("n_vertices"))
    largest = (part_vertices.join(part_edges, [*key, "label"]).groupBy(*key)
               .agg(F.max(F.col("n_vertices") + F.col("n_edges")).alias("size")))
    return (pairs.join(largest, key, "left").join(shared_vertex, key, "left")
            .select(*key, F.coalesce(F.col("size"), F.col("one"), F.lit(0)).cast("int").alias("mcs_size")))


def graph_distance(pairs: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Sizes, common size and distance of each given pair."""
    sizes = materialise(pattern_sizes(vertices, edges), "sizes")
    found = max_common_subgraph_size(pairs, vertices, edges)
    x = sizes.toDF("topic_x", "pattern_x", "size_x")
    y = sizes.toDF("topic_y", "pattern_y", "size_y")
    return (found.join(x, ["topic_x", "pattern_x"]).join(y, ["topic_y", "pattern_y"])
            .select(*PAIR, "size_x", "size_y", "mcs_size",
                    distance(F.col("mcs_size"), F.col("size_x"), F.col("size_y")).alias("distance")))


# --- nearest pattern of any other topic -----------------------------------------------------

#: Similarities (1 - distance) down to which pairs are looked at, round by round. The last one takes any common edge.
TIERS = (0.75, 0.5, 0.25, 0.0)


def largest_part(shared: Column) -> Column:
    """Size of the largest connected part of an array of edges ``src``, ``dst``; 0 without an edge.

    One pass over the edges: an edge joins the parts that have one of its ends.
    """
    part = "struct<ends:array<string>,n_edges:int>"

    def add(parts: Column, e: Column) -> Column:
        touched = lambda p: F.array_contains(p["ends"], e["src"]) | F.array_contains(p["ends"], e["dst"])
        mine = F.filter(parts, touched)
        ends = F.array_union(F.flatten(F.transform(mine, lambda p: p["ends"])), F.array(e["src"], e["dst"]))
        n_edges = F.aggregate(mine, F.lit(1), lambda n, p: n + p["n_edges"])
        joined = F.struct(ends.alias("ends"), n_edges.alias("n_edges")).cast(part)
        return F.array_append(F.filter(parts, lambda p: ~touched(p)), joined)

    parts = F.aggregate(shared, F.array().cast(f"array<{part}>"), add)
    return F.coalesce(F.array_max(F.transform(parts, lambda p: F.size(p["ends"]) + p["n_edges"])), F.lit(0))


def _two_smallest(held: DataFrame, part: str) -> DataFrame:
    """Per ``part``, the smallest pattern of each topic, and of those the two smallest: one is foreign to any pattern."""
    smallest = held.groupBy(part, "topic").agg(F.min(F.struct("graph_size", "pattern_id")).alias("least"))
    least = F.sort_array(F.collect_list(F.struct(F.col("least.graph_size").alias("near_size"), F.col("topic").alias("near_topic"),
                                                 F.col("least.pattern_id").alias("near_pattern_id"))))
    return (smallest.groupBy(part).agg(F.slice(least, 1, 2).alias("near"), F.count("*").alias("n_topics"))
            .where("n_topics > 1").select(part, F.explode("near").alias("near")).select(part, "near.*"))


def _nearest_by(held: DataFrame, part: str, part_size: int) -> DataFrame:
    """Best foreign pattern of each pattern that shares a part of a given size, as far as that part tells."""
    met = held.join(materialise(_two_smallest(held, part), "two_smallest"), part).where(F.col("topic") != F.col("near_topic"))
    return met.select(*PATTERN, F.struct(distance(F.lit(part_size), F.col("graph_size"), F.col("near_size")).alias("distance"),
                                         "near_size", "near_topic", "near_pattern_id").alias("best"))


def candidate_pairs(open_patterns: DataFrame, all_patterns: DataFrame, least: float) -> DataFrame:
    """Pairs of topics' patterns whose similarity may be ``least`` or more: ``x`` and ``y``, numbers of patterns.

    A pair of that similarity has a common part of at least ``least`` times the larger size (size filter), which has
    at least half as many edges. So both have one of their rarest edges in common (prefix filter): all but so many as they must
    share, less one.
    """
    def entries(patterns: DataFrame) -> DataFrame:
        needed = F.greatest(F.lit(1), F.ceil((F.ceil(F.lit(least) * F.col("graph_size")) - 1) / 2)).cast("int")
        prefix = F.slice("edges", 1, F.greatest(F.lit(0), F.size("edges") - needed + 1))
        return patterns.select("number", "topic", "graph_size", F.explode(prefix).alias("shared"))

    x, y = entries(open_patterns).alias("x"), entries(all_patterns).alias("y")
    close = F.least("x.graph_size", "y.graph_size") >= F.lit(least) * F.greatest("x.graph_size", "y.graph_size")
    return (x.join(y, F.col("x.shared") == F.col("y.shared")).where((F.col("x.topic") != F.col("y.topic")) & close)
            .select(F.col("x.number").alias("x"), F.col("y.number").alias("y")).distinct())


def _nearest_of(pairs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Best foreign pattern of each first pattern among some pairs."""
    x = patterns.select(F.col("number").alias("x"), *PATTERN, F.col("graph_size").alias("own_size"), F.col("edges").alias("own_edges"))
    y = patterns.select(F.col("number").alias("y"), F.col("topic").alias("near_topic"), F.col("pattern_id").alias("near_pattern_id"),
                        F.col("graph_size").alias("near_size"), F.col("edges").alias("near_edges"))
    # a generated column is computed once, whatever uses it
    both = pairs.join(x, "x").join(y, "y").withColumn("common", F.explode(F.array(largest_part(F.array_intersect("own_edges", "near_edges")))))
    return both.select(*PATTERN, F.struct(distance(F.col("common"), F.col("own_size"), F.col("near_size")).alias("distance"),
                                          "near_size", "near_topic", "near_pattern_id").alias("best"))


def nearest_foreign_pattern(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Distance of each pattern to the nearest pattern of any other topic.

    What one common vertex or edge tells is known without pairs: the smallest foreign pattern that has it. Beyond that, pairs
    of patterns are looked at by falling similarity, in tiers: all pairs that may reach the tier's similarity, for the patterns that
    have not found one so near yet. What a tier finds is exact, since every pair that reaches it has been looked
    at. The common part of a pair is found inside its row. No part of a pattern is listed, so rows grow with the number
    of near pairs and not with the parts of a pattern. Ties go to the smaller pattern, then to the smaller topic
    and pattern name. A pattern that shares nothing has distance 1 and no nearest pattern.
    """
    spark = vertices.sparkSession
    with scratch(spark) as keep:
        sizes = materialise(pattern_sizes(vertices, edges), "sizes")
        sized_edges = materialise(edges.select(*PATTERN, F.struct("src", "dst").alias("shared")).join(sizes, PATTERN), "sized_edges")
        best = _nearest_by(vertices.join(sizes, PATTERN), "v", 1).unionByName(_nearest_by(sized_edges, "shared", 3))
        best = materialise(best.groupBy(*PATTERN).agg(F.min("best").alias("best")), "nearest")
        # edges that one topic has are in no pair
        often = sized_edges.groupBy("shared").agg(F.count("*").alias("n"), F.min("topic").alias("first"), F.max("topic").alias("last"))
        often = materialise(often.where("first <> last").select("shared", "n"), "shared_edges")
        listed = sized_edges.join(often, "shared").groupBy(*PATTERN, "graph_size").agg(
            F.sort_array(F.collect_list(F.struct("n", "shared")))["shared"].alias("edges"))
        patterns = materialise(listed.withColumn("number", F.monotonically_increasing_id()), "patterns")
        for least in TIERS:
            known = best.select(*PATTERN, F.col("best.distance").alias("found"))
            near_enough = F.lit(1.0) - F.col("found") >= F.lit(least) if least else F.lit(False)
            open_patterns, any_open = materialise_counting(patterns.join(known, PATTERN).where(~near_enough).drop("found"), "open_patterns")
            if not any_open:
                break
            pairs = materialise(candidate_pairs(open_patterns, patterns, least), "pairs")
            best = materialise(best.unionByName(_nearest_of(pairs, patterns)).groupBy(*PATTERN).agg(F.min("best").alias("best")), "nearest")
        return keep(sizes.join(best, PATTERN, "left").select(
            *PATTERN, F.coalesce("best.distance", F.lit(1.0)).alias("distance"),
            F.col("best.near_topic").alias("near_topic"), F.col("best.near_pattern_id").alias("near_pattern_id")), "nearest")


def characteristic_patterns(nearest: DataFrame, min_distance: float) -> DataFrame:
    """Patterns farther than ``min_distance`` from every foreign pattern."""
    return nearest.where(F.col("distance") > F.lit(float(min_distance))).select(*PATTERN, "distance")
