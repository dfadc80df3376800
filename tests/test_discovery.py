from __future__ import annotations

import random

import pytest

import brute
from topicweave.functions import bits
from topicweave.operators.dictionary import (build_dictionary, candidate_dimensions, dense_document_vectors, dense_topic_vectors,
                                             document_bitmaps, document_dimensions, graph_contains, printed, topic_bitmaps)
from topicweave.operators.discover import bitmap_distances, discover_topics, topic_distances
from topicweave.sources.store import prediction_lines, read_dictionary, write_dictionary

CODE = "topic string, pattern_id string, code array<struct<i:int,j:int,a:int,b:int>>"


def make_dictionary(spark, words, graphs, max_dimension=-1, more_topics=()):
    """``words``: topic -> {word: df}; ``graphs``: topic -> [(pattern_id, edges)]."""
    word_rows = [(t, v, df, i) for t, ws in words.items()
                 for i, (v, df) in enumerate(sorted(ws.items(), key=lambda x: (-x[1], x[0])))]
    patterns, vertices, edges = [], [], []
    for topic, items in graphs.items():
        for n, (name, es) in enumerate(items):
            patterns.append((topic, name, [(0, 1, n, n + 1)]))
            vs, kept = brute.graph_of(es)
            vertices += [(topic, name, v) for v in vs]
            edges += [(topic, name, *e) for e in kept]
    topics = sorted({*words, *graphs, *more_topics})
    return build_dictionary(
        spark.createDataFrame(word_rows, "topic string, v string, df int, rank int"),
        spark.createDataFrame(patterns, CODE),
        spark.createDataFrame(vertices, "topic string, pattern_id string, v string"),
        spark.createDataFrame(edges, "topic string, pattern_id string, src string, dst string"),
        spark.createDataFrame([(t,) for t in topics], "topic string"), max_dimension)


WORDS = {"t0": {"oil": 9, "gas": 7}, "t1": {"corn": 5}}
GRAPHS = {"t0": [("g", [("oil", "gas")])]}


@pytest.mark.parametrize("max_dimension, labels, vectors", [
    (-1, [("oil", 0), ("gas", 0), ("g", 0), ("corn", 1)], {0: [1, 1, 1, 0], 1: [0, 0, 0, 1]}),
    (0, [("g", 0)], {0: [1]}),
    (2, [("oil", 0), ("g", 0), ("corn", 1)], {0: [1, 1, 0], 1: [0, 0, 1]}),
])
def test_golden_dictionary(spark, max_dimension, labels, vectors):
    found = make_dictionary(spark, WORDS, GRAPHS, max_dimension)
    rows = found.dimensions.orderBy("dim_id").collect()
    assert [r["dim_id"] for r in rows] == list(range(len(labels)))
    assert [(r["label"], r["topic_id"]) for r in rows] == labels
    assert {r["topic_id"]: r["vector"] for r in dense_topic_vectors(found).collect()} == vectors


def corpus_of(spark, texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")


def predictions(docs, dictionary):
    found = {}
    for r in discover_topics(docs, dictionary).collect():
        found.setdefault(r["doc_id"], set()).add(r["topic"])
    return found


def test_golden_classification(spark, tmp_path):
    write_dictionary(make_dictionary(spark, WORDS, GRAPHS), str(tmp_path / "dictionary"))
    dictionary = read_dictionary(spark, str(tmp_path / "dictionary"))
    texts = ["oil gas", "gas oil", "corn meal", "oil corn", "oil corn gas", "foo bar", "oil", ""]
    docs = corpus_of(spark, texts)
    dims = document_dimensions(docs, dictionary)
    vectors = {r["doc_id"]: "".join(map(str, r["vector"])) for r in dense_document_vectors(docs, dims, dictionary).collect()}
    assert [vectors[i] for i in range(8)] == ["1110", "1100", "0001", "1001", "1101", "0000", "0000", "0000"]
    expected = [{"t0"}, {"t0"}, {"t1"}, {"t1"}, {"t0", "t1"}, {"t1"}, {"t1"}, {"t1"}]
    assert predictions(docs, dictionary) == dict(enumerate(expected))
    lines = {r["doc_id"]: r["line"] for r in prediction_lines(discover_topics(docs, dictionary)).collect()}
    assert lines[4] == "4 :: t0 :: t1"
    distances = {(r["doc_id"], r["topic_id"]): r["distance"] for r in topic_distances(dims, dictionary).collect()}
    assert distances[4, 0] == distances[4, 1] == 2 ** 0.5 and distances[0, 0] == 0.0


def test_random_classification_matches_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdefgh"
    words = {f"t{i}": {v: rng.randint(1, 9) for v in rng.sample(letters, rng.randint(1, 2))} for i in range(6)}
    graphs = {f"t{i}": [(f"g{n}", [tuple(rng.choices(letters, k=2)) for _ in range(rng.randint(1, 3))])
                        for n in range(rng.randint(1, 2))] for i in range(4)}
    dictionary = make_dictionary(spark, words, graphs, more_topics=["empty"])
    dims = [(t, {v}, set()) for t, ws in words.items() for v in ws]
    dims += [(t, *brute.graph_of(es)) for t, items in graphs.items() for _, es in items]
    texts = [" ".join(rng.choices(letters, k=rng.randint(0, 7))) for _ in range(300)]
    topics = sorted({t for t, _, _ in dims})
    expected = {}
    for i, text in enumerate(texts):
        vertices, edges = brute.document_graph(text.split())
        has = [vs <= vertices and es <= edges for _, vs, es in dims]
        far = {t: sum(bit != (dim[0] == t) for bit, dim in zip(has, dims)) for t in topics}
        expected[i] = {t for t in topics if far[t] == min(far.values())}
    assert predictions(corpus_of(spark, texts), dictionary) == expected


def test_dictionary_without_dimensions_predicts_nothing(spark):
    empty = make_dictionary(spark, WORDS, {}, max_dimension=0)
    assert predictions(corpus_of(spark, ["oil gas"]), empty) == {}


def test_graph_containment(spark):
    parents = {"p": ["ab", "bc"], "q": ["ab"], "r": ["cb"]}
    children = {"one": ["ab"], "two": ["ab", "bc"], "vertex": ["cc"]}

    def tables(graphs, key):
        full = {name: brute.graph_of(es) for name, es in graphs.items()}
        return (spark.createDataFrame([(n, *e) for n, (_, es) in full.items() for e in es], f"{key} string, src string, dst string"),
                spark.createDataFrame([(n, v) for n, (vs, _) in full.items() for v in vs], f"{key} string, v string"))

    found = graph_contains(*tables(parents, "parent"), ["parent"], *tables(children, "child"), ["child"])
    assert {tuple(r) for r in found.collect()} == {
        ("p", "one"), ("p", "two"), ("q", "one"), ("p", "vertex"), ("r", "vertex")}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_ties_are_not_a_product_of_tables(spark, broadcast):
    dictionary = make_dictionary(spark, WORDS, GRAPHS)
    docs = spark.createDataFrame([("d", ["foo", "bar"])], "doc_id string, tokens array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = discover_topics(docs, dictionary)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_before_verification_are_the_holders_of_the_rarest_element(spark):
    dictionary = make_dictionary(spark, {"t0": {"oil": 9}}, {"t0": [("g", [("oil", "gas"), ("gas", "rare")]), ("h", [("oil", "none")])]})
    texts = ["oil gas rare"] * 3 + ["oil gas x"] * 200 + ["gas rare"] * 2 + ["x y"] * 50
    docs = corpus_of(spark, texts)
    found = candidate_dimensions(docs, dictionary).collect()
    graph = [r["doc_id"] for r in found if r["rest"]]
    assert sorted(graph) == [0, 1, 2, 203, 204]  # the edge to the rare word; nobody holds an element of h that is its rarest
    assert sorted(r["doc_id"] for r in found if not r["rest"]) == list(range(203))
    by_dim = {}
    for r in document_dimensions(docs, dictionary).collect():
        by_dim.setdefault(r["dim_id"], []).append(r["doc_id"])
    assert sorted(map(len, by_dim.values())) == [3, 203]


def test_bitmaps_hold_their_positions(spark):
    rng = random.Random(2)
    sets = {k: sorted(rng.sample(range(20_000), n)) for k, n in enumerate([1, 5, 300, 4096, 9000])}
    rows = spark.createDataFrame([(k, p) for k, ps in sets.items() for p in ps + ps[:3]], "k int, p long")
    found = bits.bitmaps(rows, ["k"], "p")
    shown = {}
    for r in found.select("k", bits.ones("words").alias("n"), bits.positions(found["bucket"], found["words"]).alias("at")).collect():
        assert r["n"] == len(r["at"])
        shown.setdefault(r["k"], []).extend(r["at"])
    assert {k: sorted(v) for k, v in shown.items()} == sets
    for r in printed(found, ["k"], 20_000).collect():
        assert [i for i, d in enumerate(r["digits"]) if d == "1"] == sets[r["k"]] and len(r["digits"]) == 20_000


def test_distances_by_bits_equal_those_by_counts(spark):
    rng = random.Random(9)
    names = [f"w{i}" for i in range(9000)]
    dictionary = make_dictionary(spark, {"t0": {v: 1 for v in names[:5000]}, "t1": {v: 2 for v in names[5000:]}}, GRAPHS | {"t2": [("h", [("a", "b")])]})
    docs = corpus_of(spark, [" ".join(rng.sample(names, rng.randint(1, 60))) for _ in range(40)] + ["a b", ""])
    dims = document_dimensions(docs, dictionary)
    counted = {(r["doc_id"], r["topic_id"]): r["distance"] for r in topic_distances(dims, dictionary).collect()}
    pairs = spark.createDataFrame(list(counted), "doc_id long, topic_id long")
    by_bits = bitmap_distances(pairs, document_bitmaps(dims), topic_bitmaps(dictionary)).collect()
    assert {(r["doc_id"], r["topic_id"]): r["distance"] for r in by_bits} == counted


def test_graphs_of_documents_are_built_of_known_tokens_only(spark, monkeypatch):
    from topicweave.operators import dictionary as operators
    written = []
    plain = operators.materialise
    monkeypatch.setattr(operators, "materialise", lambda df, name: (written.append(name), plain(df, name))[1])
    dictionary = make_dictionary(spark, WORDS, GRAPHS)
    docs = corpus_of(spark, ["oil gas x y", "gas oil", "x y", "oil", "", "a a oil oil"])
    known = {r["doc_id"]: sorted(r["elements"]) for r in operators.known_elements(docs, dictionary.elements).collect()}
    assert known == {0: ["gas", "oil", "oil\ngas"], 1: ["gas", "gas\noil", "oil"], 2: [], 3: [], 4: [], 5: ["oil", "oil\noil"]}
    found = sorted((r["doc_id"], r["dim_id"]) for r in document_dimensions(docs, dictionary).collect())
    assert found == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (5, 0)]
    assert written.count("known_elements") == 1


def test_elements_of_documents_travel_as_numbers(spark, monkeypatch):
    from topicweave.operators import dictionary as operators
    written = {}
    plain = operators.materialise
    monkeypatch.setattr(operators, "materialise", lambda df, name: (written.update({name: dict(df.dtypes)}), plain(df, name))[1])
    dictionary = make_dictionary(spark, WORDS, GRAPHS | {"t2": [("h", [("oil", "gas"), ("gas", "x")])]})
    docs = corpus_of(spark, ["oil gas x " * 40, "gas x oil", "oil oil gas x", "x"])
    rows = document_dimensions(docs, dictionary).collect()
    graph = dictionary.dimensions.where("label = 'h'").first()["dim_id"]
    assert written["known_elements"] == {"doc_id": "bigint", "element": "bigint"}
    assert sorted(r["doc_id"] for r in rows if r["dim_id"] == graph) == [0, 2] and len(rows) == len(set(rows))
