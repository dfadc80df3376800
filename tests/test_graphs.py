from __future__ import annotations

import json
import random

import brute
from pyspark.sql import functions as F

from topicweave.functions import graph as G
from topicweave.operators import graphs, ranking


def sets(df, *columns):
    return {tuple(row[c] for c in columns) for row in df.collect()}


def test_self_loop_rule(make_corpus):
    texts = ["a a", "a a b", "a a a", "b a a", "a", ""]
    corpus = make_corpus({"t": texts})
    edges = sets(graphs.document_edges(corpus), "doc_id", "src", "dst")
    assert edges == {(1, "a", "b"), (2, "a", "a"), (3, "b", "a"), (3, "a", "a")}
    assert sets(graphs.document_vertices(corpus), "doc_id", "v") == {
        (0, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")}
    assert sets(ranking.graph_count(corpus), "topic", "n_graphs") == {("t", 6)}


def test_random_documents_match_brute_force(make_corpus):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 9))) for _ in range(300)]
    corpus = make_corpus({"t": texts})
    expected = [brute.document_graph(t.split()) for t in texts]
    vertices, edges = graphs.document_vertices(corpus), graphs.document_edges(corpus)
    assert sets(edges, "doc_id", "src", "dst") == {(i, *e) for i, (_, es) in enumerate(expected) for e in es}
    assert sets(vertices, "doc_id", "v") == {(i, v) for i, (vs, _) in enumerate(expected) for v in vs}
    assert sets(graphs.graph_size(vertices, edges), "doc_id", "graph_size") == {
        (i, len(vs) + len(es)) for i, (vs, es) in enumerate(expected) if vs}


def test_text_forms(make_corpus):
    corpus = make_corpus({"t": ["a b a c", "d d"]})
    vertices, edges = graphs.document_vertices(corpus), graphs.document_edges(corpus)
    assert sets(graphs.graph_to_matrix(vertices, edges), "doc_id", "line") == {
        (0, "a ==> b, c"), (0, "b ==> a"), (0, "c ==> {}"), (1, "d ==> {}")}
    maps = {r["doc_id"]: r["adjacency"] for r in graphs.adjacency(vertices, edges).collect()}
    assert maps == {0: {"a": ["b", "c"], "b": ["a"], "c": []}, 1: {"d": []}}
    found = {r["doc_id"]: json.loads(r["json"]) for r in graphs.graph_to_json(vertices, edges).collect()}
    assert found[1] == {"nodes": [{"id": "d"}], "links": []}
    assert found[0]["links"] == [{"source": s, "target": t} for s, t in ["ab", "ac", "ba"]]


def test_ranks_break_ties_by_token(make_corpus):
    corpus = make_corpus({"t": ["b c", "b a", "a b"], "u": ["x y"]})
    counts = ranking.min_support_count(ranking.graph_count(corpus), 0.6)
    assert sets(counts, "topic", "min_sup") == {("t", 2), ("u", 1)}
    assert sets(ranking.vertex_rank(corpus, counts), "topic", "v", "df", "rank") == {
        ("t", "b", 3, 0), ("t", "a", 2, 1), ("u", "x", 1, 0), ("u", "y", 1, 1)}


def test_building_a_graph_needs_no_shuffle(make_corpus):
    corpus = make_corpus({"t": ["a b"]})
    for df in (graphs.document_edges(corpus), graphs.document_vertices(corpus)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("array_distinct") == 1


def test_graphs_of_documents_need_no_shuffle(spark, make_corpus):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("a b c d e f gg hh".split(), k=rng.randrange(0, 40))) for _ in range(40)] + ["", "a", "a a", "a a a", "a a b a a"]
    corpus = make_corpus({"t": texts, "u": texts[::-1]})
    vertices, edges = graphs.document_vertices(corpus), graphs.document_edges(corpus)
    for narrow, wide in ((graphs.document_adjacency(corpus), graphs.adjacency(vertices, edges)),
                         (graphs.document_matrix(corpus), graphs.graph_to_matrix(vertices, edges))):
        assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))
    lines = corpus.select("doc_id", "topic", F.array_join(G.transaction_lines(F.col("tokens")), "|").alias("lines"))
    found = {(r["topic"], r["doc_id"]): r["lines"] for r in lines.collect()}
    assert found["t", 44] == "v 0 a|v 1 b|e 0 1 0|e 1 0 0|e 0 0 0"
    assert found["t", 43] == "v 0 a|e 0 0 0" and found["t", 42] == "v 0 a" and found["t", 40] == ""
