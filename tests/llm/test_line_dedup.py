from __future__ import annotations

import random
import re

import pytest

from topicweave.llm import line_dedup


def slow(docs):
    """``{id: removed lines}`` by comparing each line with all before it."""
    seen, gone = [], {}
    for i, text in sorted(docs.items()):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            found = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if found:
                if any(5 * len(found & other) >= 4 * len(found | other) for other in seen):
                    gone.setdefault(i, []).append(k)
                seen.append(found)
    return gone


def random_docs(seed, variants):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 30, 90]))] for _ in range(25)]
    docs = {}
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, variants)):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            rng.shuffle(line)
            lines.append(" ".join(line) + rng.choice(["", " ", "\r"]))
        docs[i] = "\n".join([*lines, "", " "])
    return docs


@pytest.mark.parametrize("crowd", [1, 32])
def test_removed_lines_equal_brute_force(make_docs, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    docs = random_docs(crowd, 12)
    found = {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(make_docs(docs)).collect()}
    assert found == slow(docs)


def test_odd_rows(make_docs, odd_docs, no_docs):
    found = line_dedup.label_documents(odd_docs).collect()
    removed = {(r["doc_id"], r["n_lines"]): r["removed"] for r in found}
    assert len(found) == 11 and removed[1, 0] == [] and removed[2, 1] == [] and removed[3, 2] == []
    assert removed[4, 1] == [] and removed[5, 1] == [0] and removed[8, 1] == [0] and removed[None, 1] == []
    assert line_dedup.label_documents(no_docs).count() == 0
    kept = line_dedup.drop_lines(make_docs({1: "a b c\nx", 2: "y\na b c", 3: "c b a", 4: None, 5: "z"}, removed="r"))
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.orderBy("doc_id").collect()] == [
        (1, "a b c\nx", 7), (2, "y", 1), (4, None, None), (5, "z", 1)]
    assert kept.columns[-1] == "removed"


def test_long_line(make_docs):
    long = " ".join(f"w{i}" for i in range(50_000))
    found = line_dedup.removed_lines(make_docs({1: long, 2: f"new\n{long} more"})).collect()
    assert [(r["doc_id"], r["removed"]) for r in found] == [(2, [1])]


def test_no_python_in_the_plan(make_docs):
    plan = line_dedup.label_documents(make_docs({1: "a b", 2: "a b"}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_tables_of_the_stage_go(spark, make_docs, monkeypatch, tmp_path):
    from topicweave.plans import tables

    monkeypatch.setattr(tables, "scratch_folder", lambda spark: str(tmp_path))
    kept = line_dedup.drop_lines(make_docs(random_docs(3, 9)))
    assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "topicweave").iterdir()] == ["removed_lines"]
    assert kept.count()
