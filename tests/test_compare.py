from __future__ import annotations

import random
from dataclasses import fields

import pytest

import brute
from test_mining import random_topics
from topicweave.operators import compare, mining
from topicweave.operators.mining import mine_frequent_subgraphs
from topicweave.plans import jobs, tables


@pytest.fixture
def as_tables(spark):
    def build(graphs):
        """``{(topic, pattern): edges}`` to vertex and edge tables."""
        full = {key: brute.graph_of(edges) for key, edges in graphs.items()}
        vertices = [(*key, v) for key, (vs, _) in full.items() for v in vs]
        edges = [(*key, *e) for key, (_, es) in full.items() for e in es]
        return (spark.createDataFrame(vertices, "topic string, pattern_id string, v string"),
                spark.createDataFrame(edges, "topic string, pattern_id string, src string, dst string"))

    return build


GOLDEN = {("1", "X"): ["ab", "bc"], ("2", "Y"): ["ab"], ("3", "Z"): ["pq"], ("2", "W"): ["bd"]}


def test_golden_distances(spark, as_tables):
    vertices, edges = as_tables(GOLDEN)
    wanted = {("1", "X", "2", "Y"): (3, 0.4), ("1", "X", "2", "W"): (1, 0.8), ("2", "Y", "3", "Z"): (0, 1.0),
              ("1", "X", "1", "X"): (5, 0.0)}
    pairs = spark.createDataFrame(list(wanted), "topic_x string, pattern_x string, topic_y string, pattern_y string")
    found = compare.graph_distance(pairs, vertices, edges).collect()
    assert {tuple(r[:4]): (r["mcs_size"], r["distance"]) for r in found} == wanted
    nearest = compare.nearest_foreign_pattern(vertices, edges)
    assert {r["pattern_id"]: r["distance"] for r in nearest.collect()} == {"X": 0.4, "Y": 0.4, "Z": 1.0, "W": 0.8}
    for limit, kept in [(0.5, "WZ"), (0.4, "WZ"), (0.3, "WXYZ")]:
        assert "".join(sorted(r["pattern_id"] for r in compare.characteristic_patterns(nearest, limit).collect())) == kept


def test_random_graphs_match_brute_force(spark, as_tables):
    rng = random.Random(11)
    graphs = {}
    for topic in "rstu":
        for i in range(40):
            graphs[topic, f"g{i:02d}"] = ["".join(rng.choices("abcdefgh", k=2)) for _ in range(rng.randint(1, 6))]
    vertices, edges = as_tables(graphs)
    plain = {key: brute.graph_of(es) for key, es in graphs.items()}
    pairs = [(*x, *y) for x in rng.sample(sorted(graphs), 60) for y in rng.sample(sorted(graphs), 20)]
    found = compare.graph_distance(
        spark.createDataFrame(pairs, "topic_x string, pattern_x string, topic_y string, pattern_y string"), vertices, edges)
    for r in found.collect():
        x, y = plain[r["topic_x"], r["pattern_x"]], plain[r["topic_y"], r["pattern_y"]]
        assert (r["mcs_size"], r["distance"]) == (brute.common_size(x, y), brute.graph_distance(x, y))
    size = {key: len(g[0]) + len(g[1]) for key, g in plain.items()}
    for r in compare.nearest_foreign_pattern(vertices, edges).collect():
        key = r["topic"], r["pattern_id"]
        best = min((brute.graph_distance(plain[key], g), size[other], *other) for other, g in plain.items() if other[0] != key[0])
        assert r["distance"] == best[0]
        assert (r["near_topic"], r["near_pattern_id"]) == (best[2:] if best[0] < 1.0 else (None, None))


def test_long_chain_is_one_component(spark, as_tables):
    edges = [(f"v{i}", f"v{i + 1}") for i in range(200)]
    vertices, table = as_tables({("1", "x"): edges, ("2", "y"): edges + [("v0", "w")]})
    pairs = spark.createDataFrame([("1", "x", "2", "y")], "topic_x string, pattern_x string, topic_y string, pattern_y string")
    assert compare.max_common_subgraph_size(pairs, vertices, table).first()["mcs_size"] == 401


def test_lonely_topic_keeps_its_patterns(as_tables):
    vertices, edges = as_tables({("1", "X"): ["ab"], ("1", "Y"): ["ab", "bc"], ("1", "Z"): ["aa"]})
    assert {r["distance"] for r in compare.nearest_foreign_pattern(vertices, edges).collect()} == {1.0}


def test_unique_words(spark):
    rows = [("t", "oil", 3, 0), ("t", "gas", 2, 1), ("u", "oil", 5, 0), ("u", "corn", 4, 1)]
    ranks = spark.createDataFrame(rows, "topic string, v string, df int, rank int")
    assert {tuple(r) for r in compare.unique_words(ranks).collect()} == {("t", "gas", 2, 1), ("u", "corn", 4, 1)}


def test_mined_patterns(make_corpus):
    result = mine_frequent_subgraphs(make_corpus(random_topics(21, 6)), 0.5, max_edges=3)
    words = {(r["topic"], r["rank"]): r["v"] for r in result.vertices.collect()}
    plain = {(r["topic"], r["pattern_id"]): brute.graph_of(
        [(words[r["topic"], c["a"]], words[r["topic"], c["b"]]) for c in r["code"]]) for r in result.patterns.collect()}
    vertices = mining.pattern_vertices(result.patterns, result.vertices)
    edges = mining.pattern_edges(result.patterns, result.vertices)
    for r in compare.nearest_foreign_pattern(vertices, edges).collect():
        key = r["topic"], r["pattern_id"]
        assert r["distance"] == min(
            [1.0] + [brute.graph_distance(plain[key], g) for other, g in plain.items() if other[0] != key[0]])


def star(spark, leaves):
    """``{(topic, pattern): leaves}`` as stars around one hub."""
    rows = [(*key, "hub", leaf) for key, names in leaves.items() for leaf in names]
    edges = spark.createDataFrame(rows, "topic string, pattern_id string, src string, dst string")
    ends = edges.select("topic", "pattern_id", "src").union(edges.select("topic", "pattern_id", "dst"))
    return ends.distinct().toDF("topic", "pattern_id", "v"), edges


def rows_written(monkeypatch):
    """Rows of every table that is written from here on, by name."""
    seen = []
    plain = tables.materialise

    def counting(df, name):
        table = plain(df, name)
        seen.append((name, table.count()))
        return table

    for module in (compare, tables):
        monkeypatch.setattr(module, "materialise", counting)
    return seen


@pytest.mark.parametrize("k", [6, 13, 40])
def test_rows_of_equal_stars_grow_with_their_edges(spark, monkeypatch, k):
    vertices, edges = star(spark, {(topic, "p"): [f"leaf{i}" for i in range(k)] for topic in "ab"})
    seen = rows_written(monkeypatch)
    found = compare.nearest_foreign_pattern(vertices, edges).collect()
    assert [(r["distance"], r["near_pattern_id"]) for r in found] == [(0.0, "p")] * 2
    assert max(n for _, n in seen) <= 4 * k + 4


def test_patterns_that_share_nothing_are_in_no_pair(spark, monkeypatch):
    vertices, edges = star(spark, {(topic, "p"): [f"{topic}{i}" for i in range(13)] for topic in "ab"})
    edges, vertices = edges.withColumn("src", edges["topic"]), vertices.where("v <> 'hub'")
    seen = rows_written(monkeypatch)
    assert {r["distance"] for r in compare.nearest_foreign_pattern(vertices, edges).collect()} == {1.0}
    assert not any(n for name, n in seen if name in ("pairs", "open_patterns", "patterns"))


def test_patterns_with_an_equal_one_are_paired_with_near_ones_only(spark, monkeypatch):
    """All parts of two equal stars as patterns: the first tier settles all but the smallest, and pairs are of near sizes."""
    from itertools import combinations
    k = 6
    parts = {(topic, "".join(map(str, c))): [f"leaf{i}" for i in c] for topic in "ab" for n in range(1, k + 1) for c in combinations(range(k), n)}
    vertices, edges = star(spark, parts)
    seen = rows_written(monkeypatch)
    found = compare.nearest_foreign_pattern(vertices, edges).collect()
    assert all(r["distance"] == 0.0 and r["near_pattern_id"] == r["pattern_id"] for r in found) and len(found) == len(parts)
    assert [name for name, _ in seen].count("pairs") == 1


def test_largest_part_of_an_array(spark):
    rng = random.Random(6)
    cases = [[rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(rng.randint(0, 8))] for _ in range(60)]
    rows = [(i, [(e[0], e[1]) for e in sorted(set(case)) if e[0] != e[1]]) for i, case in enumerate(cases)]
    table = spark.createDataFrame(rows, "i int, edges array<struct<src:string,dst:string>>")
    for r in table.select("i", compare.largest_part("edges").alias("n")).collect():
        graph = brute.graph_of(rows[r["i"]][1])
        assert r["n"] == brute.common_size(graph, graph)


def test_common_size_of_all_pairs_with_a_common_edge(spark, as_tables):
    rng = random.Random(5)
    graphs = {("ab"[i % 2], f"p{i}"): sorted({rng.choice("uvwx") + rng.choice("uvwxy") for _ in range(5)}) for i in range(6)}
    vertices, edges = as_tables(graphs)
    x, y = (edges.toDF(f"topic_{side}", f"pattern_{side}", "src", "dst") for side in "xy")
    pairs = x.join(y, ["src", "dst"]).where("topic_x < topic_y").drop("src", "dst").distinct()
    found = compare.max_common_subgraph_size(pairs, vertices, edges).collect()
    assert found
    for r in found:
        one, two = (brute.graph_of(graphs[key]) for key in ((r["topic_x"], r["pattern_x"]), (r["topic_y"], r["pattern_y"])))
        assert r["mcs_size"] == brute.common_size(one, two)


def test_topic_model_leaves_its_result_only(make_corpus, tmp_path, monkeypatch):
    corpus = make_corpus(random_topics(22, 4))
    plain = jobs.topic_model(corpus, 0.5, 0.5, 3)
    wanted = [sorted(map(repr, getattr(plain, f.name).collect())) for f in fields(plain)]
    monkeypatch.setattr(tables, "scratch_folder", lambda spark: str(tmp_path))
    found = jobs.topic_model(corpus, 0.5, 0.5, 3)
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "topicweave").iterdir()} == {"topics", "words", "patterns", "vertices", "edges"}
    assert [sorted(map(repr, getattr(found, f.name).collect())) for f in fields(found)] == wanted
