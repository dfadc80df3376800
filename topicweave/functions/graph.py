"""Co-occurrence graph of one token sequence as column expressions.

An edge is written as ``source + newline + target``: tokens come from lines, so
they never hold a newline and the form is unambiguous. Distinct edges of one
document are found inside its row, by a hash set over strings, so building a
graph needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SEPARATOR = "\n"


def edge(src: Column, dst: Column) -> Column:
    return F.concat(src, F.lit(EDGE_SEPARATOR), dst)


def edge_source(pair: Column) -> Column:
    return F.substring_index(pair, EDGE_SEPARATOR, 1)


def edge_target(pair: Column) -> Column:
    return F.substring_index(pair, EDGE_SEPARATOR, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once in a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _pairs(tokens: Column, first: Column, joined: Callable[[Column, Column], Column] = edge) -> Column:
    n = F.size(tokens) - first
    left = F.slice(tokens, first, F.greatest(n, F.lit(0)))
    right = F.slice(tokens, first + 1, F.greatest(n, F.lit(0)))
    return F.zip_with(left, right, joined)


def bigrams(tokens: Column) -> Column:
    """Every (token, next token) pair of a document, in order."""
    return _pairs(tokens, F.lit(1))


def graph_edges(tokens: Column) -> Column:
    """Distinct directed edges of the document's graph.

    A self-loop made by the very first pair counts only if it recurs.
    """
    return F.array_distinct(_pairs(tokens, _first_pair(tokens)))


def graph_edges_among(tokens: Column, kept: Column) -> Column:
    """The same, of edges between tokens that are not null in ``kept``, which has a place for each token."""
    return let(kept, lambda found: F.array_distinct(F.array_compact(_pairs(found, _first_pair(tokens)))))


def _first_pair(tokens: Column) -> Column:
    opens_with_loop = F.coalesce(F.get(tokens, 0) == F.get(tokens, 1), F.lit(False))
    return F.when(opens_with_loop, 2).otherwise(1)


def graph_vertices(tokens: Column) -> Column:
    """Distinct vertices; a document without any pair has none."""
    return F.when(F.size(tokens) >= 2, F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def _runs(rows: Column, opens: Callable[[Column, Column], Column], body: Callable[[Column, Column, Column], Column]) -> Column:
    """One value for each run of a sorted array: ``body`` of its first row, its rows and its number."""
    def of_run(starts: Column, size: Column) -> Callable[[Column, Column], Column]:
        return lambda at, k: body(F.get(rows, at), F.slice(rows, at + 1, F.coalesce(F.get(starts, k + 1), size) - at), k)

    starts = F.array_compact(F.transform(rows, lambda row, i: F.when(opens(row, i), i)))
    return let(starts, lambda found: F.transform(found, of_run(found, F.size(rows))))


def successors(tokens: Column) -> Column:
    """Each vertex in order with its successors in order: ``array<struct<v, successors>>``.

    Found by sorting the vertices and edges of the row together: a vertex comes right before the edges that leave it.
    """
    def pair(v: Column, dst: Column) -> Column:
        return F.struct(v.alias("v"), dst.alias("dst"))

    marks = F.transform(graph_vertices(tokens), lambda v: pair(v, F.lit(None).cast("string")))
    arcs = F.transform(graph_edges(tokens), lambda e: pair(edge_source(e), edge_target(e)))
    targets = lambda rows: F.transform(F.filter(rows, lambda r: r["dst"].isNotNull()), lambda r: r["dst"])
    return let(F.sort_array(F.concat(marks, arcs)), lambda rows: _runs(
        rows, lambda row, i: row["dst"].isNull(), lambda first, run, k: F.struct(first["v"].alias("v"), targets(run).alias("successors"))))


def vertex_numbers(tokens: Column) -> Column:
    """For each token the place of its vertex among the sorted vertices."""
    placed = F.sort_array(F.transform(tokens, lambda v, i: F.struct(v.alias("v"), i.alias("at"))))
    numbered = let(placed, lambda rows: F.flatten(_runs(
        rows, lambda row, i: (i == 0) | (F.get(rows, i - 1)["v"] != row["v"]),
        lambda first, run, k: F.transform(run, lambda r: F.struct(r["at"].alias("at"), k.alias("number"))))))
    return F.transform(F.sort_array(numbered), lambda r: r["number"])


def transaction_lines(tokens: Column) -> Column:
    """The graph as transaction text: ``v id label`` for each vertex, ``e from to 0`` for each edge."""
    vertices = F.transform(F.array_sort(F.array_distinct(tokens)), lambda v, i: F.concat(F.lit("v "), i.cast("string"), F.lit(" "), v))
    arc = lambda a, b: F.concat(F.lit("e "), a.cast("string"), F.lit(" "), b.cast("string"), F.lit(" 0"))
    return F.concat(vertices, let(vertex_numbers(tokens), lambda ids: F.array_distinct(_pairs(ids, _first_pair(tokens), arc))))
