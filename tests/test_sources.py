from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from topicweave.operators.corpus import normalise_corpus
from topicweave.operators.mining import mine_frequent_subgraphs
from topicweave.plans import jobs, tables
from topicweave.sources import files, reports, store, transactions


@pytest.fixture
def root(tmp_path):
    """Two topics of tokenised files, one with an awkward name, and a nested folder."""
    texts = {"oil & gas+1": ["a b c", "a b c", "a b d"], "007": ["x y", "x y z"]}
    for topic, docs in texts.items():
        folder = tmp_path / "my corpus" / topic
        folder.mkdir(parents=True)
        for i, text in enumerate(docs):
            (folder / f"doc {i}.txt").write_text("\n".join(text.split()) + "\n", encoding="utf-8")
    deep = tmp_path / "my corpus" / "007" / "deeper"
    deep.mkdir()
    (deep / "ignored.txt").write_text("no\n")
    return tmp_path / "my corpus"


def test_folders(spark, root):
    found = files.read_labelled_corpus(spark, str(root)).collect()
    assert sorted((r["topic"], r["path"].rsplit("/", 1)[1], r["text"]) for r in found) == [
        ("007", "doc 0.txt", "x\ny\n"), ("007", "doc 1.txt", "x\ny\nz\n"),
        ("oil & gas+1", "doc 0.txt", "a\nb\nc\n"), ("oil & gas+1", "doc 1.txt", "a\nb\nc\n"),
        ("oil & gas+1", "doc 2.txt", "a\nb\nd\n")]
    assert files.read_documents(spark, str(root)).count() == 0
    assert files.read_documents(spark, f"{root}/007").count() == 2
    assert {r["doc_id"] for r in files.read_document_files(spark, f"{root}/007").collect()} == {"doc 0.txt", "doc 1.txt"}
    lines = files.read_lines(spark, f"{root}/007/doc 1.txt").collect()
    assert [r["line"] for r in lines] == ["x", "y", "z"] and lines[0]["path"].endswith("/007/doc 1.txt")


def _write(folder, texts):
    for name, text in texts.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_folder_depth_is_counted_from_the_root(spark, tmp_path, monkeypatch):
    _write(tmp_path, {"news/a.txt": "1", "news/tech/b.txt": "2", "news/tech/news/d.txt": "3", "news/tech/news/2020/e.txt": "4",
                      "news/year=9/f[1].txt": "5", "other/g.txt": "6", "news/.hidden/h.txt": "7"})
    labelled = {(r["topic"], r["text"]) for r in files.read_labelled_corpus(spark, f"{tmp_path}/news").collect()}
    assert labelled == {("tech", "2"), ("year=9", "5")}
    assert [r["doc_id"] for r in files.read_document_files(spark, f"{tmp_path}/news/").collect()] == ["a.txt"]
    assert files.read_document_files(spark, f"{tmp_path}/news/year=9").first()["doc_id"] == "f[1].txt"
    several = files.read_document_files(spark, f"{tmp_path}/{{news,other}}").collect()
    assert sorted(r["text"] for r in several) == ["1", "6"] and all("/" in r["doc_id"] for r in several)
    assert {r["topic"] for r in files.read_labelled_corpus(spark, f"{tmp_path}/*").collect()} == {"tech", "year=9"}
    with pytest.raises(FileNotFoundError):
        files.read_documents(spark, f"{tmp_path}/nothing*")
    assert files.read_document_files(spark, ".").schema == several_schema()


def several_schema():
    from pyspark.sql.types import StringType, StructField, StructType

    return StructType([StructField(name, StringType()) for name in ("doc_id", "path", "text")])


def test_stopwords_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("the\n'tis\nthe\nof\n", encoding="utf-8")
    assert sorted(r["word"] for r in files.read_stopwords(spark, str(tmp_path / "stop.txt")).collect()) == ["'tis", "of", "the"]


def test_stopword_table_and_list_give_the_same(spark):
    rows = [("t", 1, "p", "one stop two"), ("t", 1, "p", "three four stop"), ("t", 1, "p", "one stop two"),
            ("t", None, None, None), ("t", 2, "q", "stop stop")]
    docs = spark.createDataFrame(rows, "topic string, doc_id long, path string, text string")
    table = spark.createDataFrame([("stop",), ("stop",), ("unused",)], "word string")
    listed = normalise_corpus(docs, ["stop", "unused"], min_tokens=0).collect()
    joined = normalise_corpus(docs, table, min_tokens=0).collect()
    assert sorted(map(repr, listed)) == sorted(map(repr, joined))
    assert [list(r["tokens"]) for r in joined].count(["one", "two"]) == 2


def test_graph_transactions(spark, tmp_path):
    (tmp_path / "g1").write_text(
        "t # 0\nv 0 a\nv 1 b\nv 2 a\ne 0 1 9\ne 2 1 9\ne 1 2 9\nt # 1\nv 0 z\nt # -1\nt # 2\nv 0 lost\n")
    (tmp_path / "g2").write_text("t # 0\r\nv 0 p\r\nv 1 q\r\ne 1 0 5\r\nt # 7\r\nv 3 r\r\n")
    items = transactions.read_graph_transactions(spark, str(tmp_path))
    name = F.element_at(F.split("topic", "/"), -1)
    edges = transactions.transaction_edges(items).select(name, "doc_id", "src", "dst").collect()
    assert {tuple(r) for r in edges} == {("g1", "0", "a", "b"), ("g1", "0", "b", "a"), ("g2", "0", "q", "p")}
    vertices = transactions.transaction_vertices(items).select(name, "doc_id", "v").collect()
    assert {tuple(r) for r in vertices} == {
        ("g1", "0", "a"), ("g1", "0", "b"), ("g1", "1", "z"), ("g2", "0", "p"), ("g2", "0", "q"), ("g2", "7", "r")}


def test_mine_graph_transactions(spark, tmp_path):
    graph = "v 0 a\nv 1 b\nv 2 c\ne 0 1 0\ne 1 2 0\n"
    (tmp_path / "g").write_text(f"t # 0\n{graph}t # 1\n{graph}t # 2\nv 0 a\nt # -1\n")
    items = tables.materialise(transactions.read_graph_transactions(spark, str(tmp_path)), "items")
    vertices = transactions.transaction_vertices(items)
    listed = transactions.transaction_graphs(spark, str(tmp_path))
    result = mine_frequent_subgraphs(listed, 0.6, None, transactions.transaction_edges(items), vertices)
    assert sorted((r["n_edges"], r["support"]) for r in result.patterns.collect()) == [(1, 2), (1, 2), (2, 2)]


def test_empty_graphs_count(spark, tmp_path):
    (tmp_path / "g").write_text("t # 0\nv 0 a\nv 1 b\ne 0 1 0\nt # 1\nt # 2\nv 0 a\nt # -1\nt # 9\n")
    graphs = transactions.transaction_graphs(spark, str(tmp_path)).collect()
    assert [r["doc_id"] for r in graphs] == ["0", "1", "2"]
    counts = jobs.mine_transactions(spark, str(tmp_path), 0.5).counts.first()
    assert (counts["n_graphs"], counts["min_sup"]) == (3, 2)


def test_stored_corpus_keeps_topic_names_and_prunes(spark, root, tmp_path):
    path = str(tmp_path / "store")
    corpus = jobs.tokenised_corpus(files.read_labelled_corpus(spark, str(root)))
    store.write_corpus(corpus.where("topic = '007'"), path)
    store.write_corpus(corpus.where("topic <> '007'"), path)
    stored = store.read_corpus(spark, path)
    assert {r["topic"]: r["count"] for r in stored.groupBy("topic").count().collect()} == {"007": 2, "oil & gas+1": 3}
    plan = stored.where(F.col("topic") == "007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan
    assert stored.where(F.col("topic") == "007").count() == 2


def test_folder_jobs(spark, root, tmp_path):
    folders = jobs.mine_folders(spark, str(root), 0.6)
    one = jobs.mine_folder(spark, f"{root}/oil & gas+1", 0.6)
    strip = lambda df: sorted((r["pattern_id"], r["support"]) for r in df.collect())
    assert strip(one.patterns) == strip(folders.patterns.where("topic <> '007'")) == [
        ("0-1:0>1", 3), ("0-1:0>1,1-2:1>2", 2), ("0-1:1>2", 2)]
    report = reports.mining_report(folders).where("topic <> '007'").orderBy("section", "place", "part")
    assert [r["line"] for r in report.collect()] == [
        reports.TOTAL % 6, reports.N_VERTICES % 3, reports.N_GRAPHS % 3, reports.VERTICES_TITLE,
        "a :: 3", "b :: 3", "c :: 2", reports.GRAPHS_TITLE,
        reports.GRAPH_TITLE % 0, "a ==> b", reports.SUPPORT % 3,
        reports.GRAPH_TITLE % 1, "a ==> b ==> c", reports.SUPPORT % 2,
        reports.GRAPH_TITLE % 2, "b ==> c", reports.SUPPORT % 2]
    jobs.write_mining_report(folders, str(tmp_path / "report"))
    parts = sorted((tmp_path / "report" / "topic=007").glob("part-*"))
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert text.splitlines()[0] == reports.TOTAL % 3 and "x ==> y" in text
    store.write_mining_result(folders, str(tmp_path / "mined"))
    again = store.read_mining_result(spark, str(tmp_path / "mined"))
    assert sorted(map(str, again.patterns.select(*folders.patterns.columns).collect())) == sorted(
        map(str, folders.patterns.collect()))


def test_whole_pipeline(spark, tmp_path):
    raw = tmp_path / "raw"
    texts = {"oil": ["Crude oil prices rise (OPEC).", "Crude oil prices fall.", "The crude oil prices."],
             "corn": ["Corn meal exports; corn meal!", "Corn meal imports", "corn meal."]}
    for topic, docs in texts.items():
        (raw / topic).mkdir(parents=True)
        for i, text in enumerate(docs):
            (raw / topic / f"{i}.txt").write_text(text)
    (tmp_path / "stop.txt").write_text("the\n")
    corpus = jobs.prepare_corpus(spark, str(raw), str(tmp_path / "stop.txt"), str(tmp_path / "corpus"), min_tokens=2)
    found = jobs.topic_model(corpus, 0.9, 0.5)
    assert {(r["topic"], r["v"]) for r in found.words.collect()} == {
        ("oil", "crude"), ("oil", "oil"), ("oil", "prices"), ("corn", "corn"), ("corn", "meal")}
    jobs.store_characteristics(found, str(tmp_path / "graphs"))
    edges = store.read_graph(spark, str(tmp_path / "graphs" / "graph_edges")).collect()
    assert {(r["topic"], r["src"], r["dst"]) for r in edges} == {
        ("oil", "crude", "oil"), ("oil", "oil", "prices"), ("corn", "corn", "meal")}
    jobs.write_characteristic_report(found, str(tmp_path / "report"))
    dictionary = jobs.create_dictionary(found)
    new = tmp_path / "new"
    new.mkdir()
    (new / "a.txt").write_text("crude\noil\nprices\n")
    (new / "b.txt").write_text("corn\nmeal\n")
    predicted = jobs.discover_files(spark, str(new), dictionary)
    assert {tuple(r) for r in predicted.collect()} == {("a.txt", "oil"), ("b.txt", "corn")}
    raw_texts = spark.createDataFrame([(1, "Oil: crude oil prices!"), (2, "CORN MEAL.")], "doc_id long, text string")
    assert {tuple(r) for r in jobs.discover_texts(raw_texts, ["the"], dictionary).collect()} == {(1, "oil"), (2, "corn")}
    store.write_predictions(predicted, str(tmp_path / "predictions"))


def test_patternless_topics(spark, make_corpus):
    corpus = make_corpus({"t": ["a b", "a b"], "single": ["a c"]})
    kept = jobs.topic_model(corpus, 1.0, 0.5, drop_patternless_topics=False)
    dropped = jobs.topic_model(corpus, 1.0, 0.5)
    assert {tuple(r) for r in kept.words.select("topic", "v").collect()} == {("t", "b"), ("single", "c")}
    assert {tuple(r) for r in dropped.words.select("topic", "v").collect()} == {("t", "a"), ("t", "b")}


def test_positions_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(6)
    placed = tables.with_position(df, ["x"], "position")
    assert placed.where("x <> position").isEmpty() and placed.count() == 5000


def test_scratch_folder_is_shared(spark):
    assert tables.scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")

    class Conf:
        def get(self, name, default=None):
            return {"spark.sql.warehouse.dir": "hdfs:/warehouse"}.get(name, default)

    class Session:
        conf = Conf()

    assert tables.scratch_folder(Session()) == "hdfs:/warehouse/scratch"


def test_listing_takes_no_call_for_a_file(spark, tmp_path, monkeypatch):
    client = spark._jvm._gateway_client
    plain, calls = client.send_command, []
    monkeypatch.setattr(client, "send_command", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    taken = []
    for n in (3, 400):
        _write(tmp_path / str(n), {f"t{i % 3}/{i}.txt": "x" for i in range(n)})
        _write(tmp_path / str(n), {f"t0/sub/{i}.txt": "x" for i in range(n)})
        calls.clear()
        found = files.read_labelled_corpus(spark, f"{tmp_path}/{n}"), files.read_document_files(spark, f"{tmp_path}/{n}/t0")
        taken.append(len(calls))
        assert found[0].count() == n and found[1].count() == -(-n // 3)
    assert abs(taken[0] - taken[1]) <= 2


def test_files_of_other_levels_are_not_opened(spark, tmp_path):
    _write(tmp_path, {"a/b.txt": "x", "a/deep/c.txt.gz": "opening this fails", "a/deep/deeper/d.gz": "and this"})
    assert [r["text"] for r in files.read_documents(spark, f"{tmp_path}/a").collect()] == ["x"]


def test_bundles_are_read_like_files(spark, tmp_path):
    texts = {("t", "1"): "a\n\nb", ("t", "2"): "", ("u", "1"): "c\r\n--x\n", ("u", "3"): "d", ("u", "4"): None}
    docs = spark.createDataFrame([(t, n, x) for (t, n), x in texts.items()] + [("t", str(i), f"w{i}") for i in range(10, 500)],
                                 "topic string, name string, text string").coalesce(2)
    boundary = files.new_boundary()
    files.write_bundles(docs, f"{tmp_path}/in", boundary)
    found = files.read_labelled_corpus(spark, f"{tmp_path}/in", boundary).collect()
    assert len({r["doc_id"] for r in found}) == len(found) == 495
    assert len(list((tmp_path / "in").glob("*/*.txt"))) <= 4
    named = {(r["topic"], r["path"].rsplit("#", 1)[1]): r["text"] for r in found}
    assert all(named[f"topic={t}", n] == (x or "") + "\n" for (t, n), x in texts.items())
    one = {r["doc_id"]: r["text"] for r in files.read_document_files(spark, f"{tmp_path}/in/topic=u", boundary).collect()}
    assert one == {"1": "c\r\n--x\n\n", "3": "d\n", "4": "\n"}
    assert files.read_documents(spark, f"{tmp_path}/in/topic=u", boundary).count() == 3


def test_transactions_are_read_in_the_row(spark, tmp_path):
    (tmp_path / "g.txt").write_text("t # 1\nv 0 a\nv 1 b\ne 0 1 x\ne 0 1 y\ne 1 1 x\nt # 2\nv 7 c\nv x d\nv 07 e\ne 7 x 0\ne 07 7 0\ne 7 nobody 0\n"
                                    "t # 3\nt # -1\nt # 4\nv 0 z\nv 1 y\ne 0 1 0\n")
    found = transactions.read_transaction_edges(spark, str(tmp_path))
    wide = transactions.transaction_edges(transactions.read_graph_transactions(spark, str(tmp_path)))
    rows = sorted(tuple(r)[1:] for r in found.collect())
    assert rows == [("1", "a", "b"), ("1", "b", "b"), ("2", "c", "d"), ("2", "e", "c")] == sorted(tuple(r)[1:] for r in wide.collect())
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    vertices = transactions.read_transaction_vertices(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[1:] for r in vertices) == [("1", "a"), ("1", "b"), ("2", "c"), ("2", "d"), ("2", "e")]
