from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from topicweave.operators import mining, ranking
from topicweave.operators.graphs import document_edges, document_vertices
from topicweave.operators.mining import mine_frequent_subgraphs
from topicweave.plans import tables


def mined(result):
    """``{topic: {frozenset of token edges: support}}``; fails on a repeated edge set."""
    words = {(r["topic"], r["rank"]): r["v"] for r in result.vertices.collect()}
    found = {}
    for row in result.patterns.collect():
        edges = frozenset((words[row["topic"], c["a"]], words[row["topic"], c["b"]]) for c in row["code"])
        of_topic = found.setdefault(row["topic"], {})
        assert edges not in of_topic and len(edges) == row["n_edges"]
        of_topic[edges] = row["support"]
    return found


def pairs(*names):
    return frozenset((n[0], n[1]) for n in names)


GOLDEN = {
    "chain": (["a b c", "a b c", "a b d"], 0.6, {pairs("ab"): 3, pairs("bc"): 2, pairs("ab", "bc"): 2}),
    "lost chain": (["b a c", "b a c", "a z"], 0.6, {pairs("ba"): 2, pairs("ac"): 2}),
    "cycle": (["a b c a"] * 2, 1.0, {pairs("ab"): 2, pairs("bc"): 2, pairs("ca"): 2, pairs("ab", "bc"): 2,
                                     pairs("bc", "ca"): 2, pairs("ab", "bc", "ca"): 2}),
    "other cycle": (["a c b a"] * 2, 1.0, {pairs("ac"): 2, pairs("cb"): 2, pairs("ba"): 2, pairs("ac", "cb"): 2}),
    "two-cycle": (["a b a"] * 2, 1.0, {pairs("ab"): 2, pairs("ba"): 2}),
    "self-loop": (["b a a"] * 2, 1.0, {pairs("ba"): 2, pairs("aa"): 2}),
    "single graph": (["a b c"], 1.0, {}),
    "empty graphs count": (["a b", "a", "", "a b"], 0.6, {}),
}


@pytest.mark.parametrize("support", sorted({support for _, support, _ in GOLDEN.values()}))
def test_golden(make_corpus, support):
    cases = {name: (texts, expected) for name, (texts, s, expected) in GOLDEN.items() if s == support}
    found = mined(mine_frequent_subgraphs(make_corpus({name: texts for name, (texts, _) in cases.items()}), support))
    assert {name: found.get(name, {}) for name in cases} == {name: expected for name, (_, expected) in cases.items()}


def random_topics(seed, n_topics, letters="abcdef"):
    rng = random.Random(seed)
    topics = {}
    for t in range(n_topics):
        base = rng.choices(letters, k=8)
        topics[f"t{t}"] = [
            " ".join(rng.choice(letters) if rng.random() < 0.2 else token for token in base[rng.randint(0, 2):])
            for _ in range(rng.randint(1, 7))]
    return topics


@pytest.mark.parametrize("support", [0.3, 0.6])
def test_random_topics_match_brute_force(make_corpus, support):
    topics = random_topics(int(support * 10), 60)
    found = mined(mine_frequent_subgraphs(make_corpus(topics), support, max_edges=4))
    for topic, texts in topics.items():
        assert found.get(topic, {}) == brute.frequent_patterns(texts, support, 4), topic


def test_growth_ends_by_itself(make_corpus):
    topics = random_topics(5, 8, letters="abcde")
    unlimited = mined(mine_frequent_subgraphs(make_corpus(topics), 0.7))
    for topic, texts in topics.items():
        assert unlimited.get(topic, {}) == brute.frequent_patterns(texts, 0.7, 10), topic


def test_pattern_documents_and_ids(spark, make_corpus):
    topics = random_topics(9, 10)
    corpus = make_corpus(topics)
    result = mine_frequent_subgraphs(corpus, 0.5, max_edges=3)
    edges = mining.pattern_edges(result.patterns, result.vertices)
    words = {(r["topic"], r["pattern_id"]): set() for r in result.patterns.collect()}
    for r in edges.collect():
        words[r["topic"], r["pattern_id"]].add((r["src"], r["dst"]))
    docs = {}
    for r in result.pattern_docs.collect():
        docs.setdefault((r["topic"], r["pattern_id"]), set()).add(r["doc_id"])
    for row in result.patterns.where(F.get("code", 0)["a"] != F.get("code", 0)["b"]).collect():
        key = row["topic"], row["pattern_id"]
        holding = {i for i, t in enumerate(topics[key[0]]) if words[key] <= brute.document_graph(t.split())[1]}
        assert docs[key] == holding and len(holding) == row["support"]
    shuffled = mine_frequent_subgraphs(corpus.repartition(3).orderBy(F.rand(1)), 0.5, max_edges=3)
    assert sorted(map(str, shuffled.patterns.collect())) == sorted(map(str, result.patterns.collect()))


def test_given_graphs_equal_token_graphs(make_corpus):
    corpus = make_corpus(random_topics(2, 5))
    graphs = mine_frequent_subgraphs(corpus, 0.5, 3, document_edges(corpus), document_vertices(corpus))
    assert mined(graphs) == mined(mine_frequent_subgraphs(corpus, 0.5, 3))


def test_self_loop_pattern_is_a_single_vertex(make_corpus):
    result = mine_frequent_subgraphs(make_corpus({"t": ["b a a"] * 2}), 1.0)
    assert {(r["src"], r["dst"]) for r in mining.pattern_edges(result.patterns, result.vertices).collect()} == {("b", "a")}
    vertices = {}
    for r in mining.pattern_vertices(result.patterns, result.vertices).collect():
        vertices.setdefault(r["pattern_id"], set()).add(r["v"])
    assert sorted(map(sorted, vertices.values())) == [["a"], ["a", "b"]]


CONNECTED = {
    "in-star": (["b a", "c a"], {pairs("ba"): 2, pairs("ca"): 2, pairs("ba", "ca"): 2}),
    "chain of F5": (["b a c"], {pairs("ba"): 2, pairs("ac"): 2, pairs("ba", "ac"): 2}),
    "two-cycle": (["a b a"], {pairs("ab"): 2, pairs("ba"): 2, pairs("ab", "ba"): 2}),
    "self-loop": (["b a a"], {pairs("ba"): 2, pairs("aa"): 2}),
}


def test_connected_golden(make_corpus, spark):
    for name, (texts, expected) in CONNECTED.items():
        rows = [("t", i) for i in range(2)]
        edges = {e for text in texts for e in brute.document_graph(text.split())[1]}
        corpus = spark.createDataFrame(rows, "topic string, doc_id long")
        table = spark.createDataFrame([("t", i, *e) for i in range(2) for e in edges], "topic string, doc_id long, src string, dst string")
        ends = table.selectExpr("topic", "doc_id", "explode(array(src, dst)) v").distinct()
        found = mined(mine_frequent_subgraphs(corpus, 1.0, 4, table, ends, mode="connected"))
        assert found["t"] == expected, name


def test_connected_diamond(make_corpus, spark):
    diamond = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    corpus = spark.createDataFrame([("t", 0), ("t", 1)], "topic string, doc_id long")
    table = spark.createDataFrame([("t", i, *e) for i in range(2) for e in diamond], "topic string, doc_id long, src string, dst string")
    ends = table.selectExpr("topic", "doc_id", "explode(array(src, dst)) v").distinct()
    found = mined(mine_frequent_subgraphs(corpus, 1.0, 4, table, ends, mode="connected"))["t"]
    assert found[frozenset(diamond)] == 2 and len(found) == 4 + 4 + 4 + 1
    with pytest.raises(ValueError):
        mine_frequent_subgraphs(corpus, 1.0, mode="connected")
    with pytest.raises(ValueError):
        mine_frequent_subgraphs(corpus, 1.0, 2, mode="other")


@pytest.mark.parametrize("support", [0.3, 0.6])
def test_connected_patterns_match_brute_force_and_hold_the_rooted_ones(make_corpus, support):
    topics = random_topics(int(support * 10) + 1, 40)
    corpus = make_corpus(topics)
    connected = mine_frequent_subgraphs(corpus, support, 3, mode="connected")
    found = mined(connected)
    rooted = mined(mine_frequent_subgraphs(corpus, support, 3))
    for topic, texts in topics.items():
        assert found.get(topic, {}) == brute.connected_patterns(texts, support, 3), topic
        assert rooted.get(topic, {}).items() <= found.get(topic, {}).items()
    ids = connected.patterns.select("topic", "pattern_id")
    assert ids.count() == ids.distinct().count()


def test_support_of_many_documents_takes_few_rows(make_corpus):
    topics = {"t": [f"a b c d x{i} y{i}" for i in range(5000)] + ["a b"] * 10}
    corpus = make_corpus(topics)
    edges = document_edges(corpus).withColumnsRenamed({"src": "a", "dst": "b"})
    frequent = edges.groupBy("topic", "a", "b").count().where("count > 100")
    useful = edges.join(frequent, ["topic", "a", "b"], "left_semi")
    bits = mining.edge_bitmaps(useful, mining.document_numbers(useful))
    assert bits.count() == 3 * 2
    shown = bits.select("a", F.explode(mining.B.positions(F.col("bucket"), F.col("words"))).alias("doc_no"))
    assert {r["a"]: r["n"] for r in shown.groupBy("a").agg(F.count_distinct("doc_no").alias("n")).collect()} == {"a": 5010, "b": 5000, "c": 5000}
    result = mine_frequent_subgraphs(corpus, 0.5)
    assert result.pattern_docs.count() == 5010 + 5000 * 5


def test_mining_leaves_its_result_only(make_corpus, tmp_path, monkeypatch):
    corpus = make_corpus(random_topics(4, 5))
    monkeypatch.setattr(tables, "scratch_folder", lambda spark: str(tmp_path))
    result = mine_frequent_subgraphs(corpus, 0.5, 3)
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "topicweave").iterdir()}
    assert left == {"counts", "vertices", "document_numbers", "level", "bitmaps"}
    assert result.patterns.count() and result.pattern_docs.count() and result.vertices.count()


def test_edges_with_a_rare_end_are_not_exploded(make_corpus):
    corpus = make_corpus(random_topics(3, 20) | {"loop": ["a a b a a", "a a", "a a b"], "one": ["x"], "none": [""]})
    counts = ranking.min_support_count(ranking.graph_count(corpus), 0.6)
    ranks = tables.materialise(ranking.vertex_rank(corpus, counts), "ranks")
    found = {tuple(r) for r in ranking.possibly_frequent_edges(corpus, ranking.frequent_marks(ranks)).collect()}
    frequent = {(r["topic"], r["v"]) for r in ranks.collect()}
    every = {tuple(r) for r in document_edges(corpus).collect()}
    assert found == {e for e in every if (e[0], e[2]) in frequent and (e[0], e[3]) in frequent} != every


def test_a_full_table_of_marks_changes_nothing(make_corpus, monkeypatch):
    corpus = make_corpus(random_topics(3, 6))
    wanted = mined(mine_frequent_subgraphs(corpus, 0.5, 3))
    monkeypatch.setattr(ranking, "SLOTS", 2)
    assert mined(mine_frequent_subgraphs(corpus, 0.5, 3)) == wanted


def test_tokens_are_looked_up_once(make_corpus):
    corpus = make_corpus(random_topics(2, 5))
    ranks = tables.materialise(ranking.vertex_rank(corpus, ranking.min_support_count(ranking.graph_count(corpus), 0.6)), "ranks")
    plan = ranking.possibly_frequent_edges(corpus, ranking.frequent_marks(ranks))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Scan parquet")[0].count("xxhash64(") == 1


def test_pairs_are_joined_without_being_built_in_the_row(make_corpus):
    corpus = make_corpus(random_topics(3, 20) | {"loop": ["a a b a a", "a a", "a a b"], "one": ["x"], "none": [""]})
    ranks = tables.materialise(ranking.vertex_rank(corpus, ranking.min_support_count(ranking.graph_count(corpus), 0.6)), "ranks")
    pairs_found = ranking.possibly_frequent_pairs(corpus, ranking.frequent_marks(ranks))
    assert "transform(" not in pairs_found._jdf.queryExecution().executedPlan().toString()
    once = [tuple(r) for r in pairs_found.distinct().collect()]
    assert sorted(once) == sorted(tuple(r) for r in ranking.possibly_frequent_edges(corpus, ranking.frequent_marks(ranks)).collect())


def test_an_edge_repeated_in_few_documents_is_not_frequent(make_corpus):
    corpus = make_corpus({"t": ["a b " * 50, "a x", "b x", "a c b", "b c a"]})
    assert mined(mine_frequent_subgraphs(corpus, 0.6)) == {}


def test_a_mining_level_is_written_once(make_corpus, monkeypatch):
    written = []
    plain = tables.new_path
    monkeypatch.setattr(tables, "new_path", lambda spark, name: (written.append(name), plain(spark, name))[1])
    mine_frequent_subgraphs(make_corpus({"t": ["a b c d e f"] * 4}), 0.5, 3)
    assert written.count("level") == 3 and "grown" not in written and written.count("marks") == 1
