"""Readable reports, as tables of lines. Output only: nothing reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.operators.graphs import graph_to_matrix
from topicweave.operators.mining import MiningResult, code_order
from topicweave.plans.tables import materialise, with_position

# The wording of a report.
TOTAL = "%d đồ thị con phổ biến."
N_VERTICES = "Trong đó có %d đỉnh phổ biến."
N_GRAPHS = "Và %d đồ thị con phổ biến được tạo thành từ ít nhất một cạnh."
VERTICES_TITLE = "Các đỉnh phổ biến là:"
GRAPHS_TITLE = "Các đồ thị con phổ biến là:"
GRAPH_TITLE = "Đồ thị con số %d:"
SUPPORT = "Với độ phổ biến là: %d"

_ORDER = ["topic", "section", "place", "part"]


def pattern_paths(patterns: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each pattern on one line: ``a ==> b ==> c, a ==> d``.

    An edge that starts where the last one ended goes on with the chain.
    """
    steps = patterns.select("topic", "pattern_id", F.posexplode("code").alias("pos", "c")).select(
        "topic", "pattern_id", "pos", F.col("c.a").alias("a"), F.col("c.b").alias("b"))
    src = vertices.select("topic", F.col("rank").alias("a"), F.col("v").alias("src"))
    dst = vertices.select("topic", F.col("rank").alias("b"), F.col("v").alias("dst"))
    placed = (steps.join(src, ["topic", "a"]).join(dst, ["topic", "b"]).groupBy("topic", "pattern_id")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "src", "dst"))).alias("steps")))

    def piece(step: Column, i: Column) -> Column:
        chained = F.get("steps", i - 1)["dst"] == step["src"]
        opening = F.when(i == 0, F.lit("")).otherwise(F.lit(", "))
        return F.when(F.coalesce(chained, F.lit(False)), F.concat(F.lit(" ==> "), step["dst"])).otherwise(
            F.concat(opening, step["src"], F.lit(" ==> "), step["dst"]))

    return placed.select("topic", "pattern_id", F.array_join(F.transform("steps", piece), "").alias("path"))


def number_patterns(patterns: DataFrame) -> DataFrame:
    """Add ``graph_no``: the 0-based place of a pattern in its topic, in mining order."""
    placed = materialise(with_position(patterns.withColumn("place_key", code_order(F.col("code"))),
                                       ["topic", "place_key"], "position").drop("place_key"), "numbered")
    first = placed.groupBy("topic").agg(F.min("position").alias("first"))
    return placed.join(first, "topic").withColumn("graph_no", F.col("position") - F.col("first")).drop("position", "first")


def _line(section: int, place: Column | int, part: Column | int, line: Column, *keys: str) -> list:
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    return [*keys, F.lit(section).alias("section"), as_column(place).cast("long").alias("place"),
            as_column(part).cast("long").alias("part"), line.alias("line")]


def _report(topics: DataFrame, words: DataFrame, graphs: DataFrame, bodies: DataFrame, full_head: Column,
            graph_total: Column) -> DataFrame:
    """Lines of all topics; ``bodies`` are the lines under the graph titles.

    ``full_head`` and ``graph_total`` say when the head goes on after its first
    line and when it counts the graphs, in terms of ``n_words`` and ``n_patterns``.
    """
    totals = (topics.select("topic")
              .join(words.groupBy("topic").agg(F.count("*").alias("n_words")), "topic", "left")
              .join(graphs.groupBy("topic").agg(F.count("*").alias("n_patterns")), "topic", "left")
              .select("topic", F.coalesce("n_words", F.lit(0)).alias("n_words"),
                      F.coalesce("n_patterns", F.lit(0)).alias("n_patterns")))
    totals = materialise(totals, "report_totals")
    head = F.array_compact(F.array(
        F.format_string(TOTAL, F.col("n_words") + F.col("n_patterns")),
        F.when(full_head, F.format_string(N_VERTICES, "n_words")),
        F.when(full_head & graph_total, F.format_string(N_GRAPHS, "n_patterns")),
        F.when(full_head, F.lit(VERTICES_TITLE))))
    headers = totals.select("topic", F.posexplode(head).alias("pos", "text")).select(
        *_line(0, F.col("pos"), 0, F.col("text"), "topic"))
    word_lines = words.select(*_line(
        1, F.col("rank"), 0, F.concat("v", F.lit(" :: "), F.col("df").cast("string")), "topic"))
    graph_head = totals.where(F.col("n_patterns") > 0).select(*_line(2, 0, 0, F.lit(GRAPHS_TITLE), "topic"))
    titles = graphs.select(*_line(3, F.col("graph_no"), 0, F.format_string(GRAPH_TITLE, "graph_no"), "topic"))
    return headers.unionByName(word_lines).unionByName(graph_head).unionByName(titles).unionByName(bodies)


def mining_report(result: MiningResult) -> DataFrame:
    """Counts, ``word :: frequency`` lines, then each pattern's path and support.

    Columns ``(topic, section, place, part, line)``, in reading order when sorted.
    """
    graphs = materialise(number_patterns(result.patterns), "numbered_patterns")
    paths = graphs.join(pattern_paths(graphs, result.vertices), ["topic", "pattern_id"])
    bodies = paths.select(*_line(3, F.col("graph_no"), 1, F.col("path"), "topic")).unionByName(
        graphs.select(*_line(3, F.col("graph_no"), 2, F.format_string(SUPPORT, "support"), "topic")))
    return _report(result.counts, result.vertices, graphs, bodies, F.col("n_words") > 0, F.lit(True))


def characteristic_report(topics: DataFrame, words: DataFrame, patterns: DataFrame, vertices: DataFrame,
                          edges: DataFrame) -> DataFrame:
    """The same for the characteristic words and graphs; graphs in matrix form."""
    graphs = materialise(number_patterns(patterns), "numbered_patterns")
    key = ["topic", "pattern_id"]
    kept = graphs.select(*key, "graph_no")
    rows = graph_to_matrix(vertices.join(kept.select(*key), key), edges.join(kept.select(*key), key), key)
    placed = materialise(with_position(rows.join(kept, key), ["topic", "graph_no", "v"], "position"), "matrix_lines")
    bodies = placed.select(*_line(3, F.col("graph_no"), F.col("position") + 1, F.col("line"), "topic"))
    return _report(topics, words, graphs, bodies, F.lit(True), F.col("n_patterns") > 0)


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as text, one folder per topic, in reading order.

    Rows are spread by range, so a long topic spans several files that follow one
    another by name.
    """
    (lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
     .select("topic", "line").write.partitionBy("topic").text(path))
