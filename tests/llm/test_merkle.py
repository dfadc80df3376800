"""The Merkle manifest: places in the log, trees of many sizes, proofs and tampering."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from topicweave.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, level, i, out):
    """Nodes of a subtree in the order in which they are complete."""
    if level:
        for child in range(8 * i, min(8 * i + 8, len(levels[level - 1]))):
            walk(levels, level - 1, child, out)
    out.append((level, i))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 72, 73, 513, 600])
def test_places_in_the_log(n):
    levels = tree([str(i) for i in range(n)])
    assert [len(level) for level in levels] == merkle.widths(n)
    order = []
    walk(levels, len(levels) - 1, 0, order)
    assert [merkle.postorder(n, level, i) for level, i in order] == list(range(len(order)))


def brute_force(rows):
    """The manifest of ``(doc_id, text, lang, source, n_chars)``."""
    def leaf(doc_id, text, lang, source, n_chars):
        values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
        return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    def lower(text):
        return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[2] == lang), key=lambda x: x[:3]) for lang in langs]
    trees = [tree([x[2] for x in group]) for group in groups]
    top = tree([levels[-1][0] for levels in trees])
    out = []
    for g, (group, levels) in enumerate(zip(groups, trees, strict=True)):
        for i, (_, _, digest, row) in enumerate(group):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            h, seen = leaf(row[0], lower(row[1]), *row[2:]) if hit else digest, ""
            for some, start in ((levels, i), (top, g)):
                for level in some[:-1]:
                    first = start // 8 * 8
                    before, behind = level[first:start], level[start + 1:first + 8]
                    seen, h, start = seen + "".join(before + behind), sha(*before, h, *behind), start // 8
            out.append((row[0], digest, levels[-1][0], top[-1][0], sha(seen), h, h == top[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(table):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.manifest(table).collect()), key=repr)


@pytest.mark.parametrize("block_height", [1, 2, 4])
def test_manifest_equals_brute_force(spark, make_docs, monkeypatch, block_height):
    monkeypatch.setattr(merkle, "HEIGHT", block_height)
    monkeypatch.setattr(merkle, "BLOCK", 8**block_height)
    sizes = {None: 1, "a": 1, "b": 8, "c": 9, "de": 64, "é": 65, "ü": 150, "z": 2, "zz": 0, "y": 3, "x": 1}
    texts, lang = [], {}
    for name, n in sizes.items():
        for _ in range(n):
            i = len(texts) * 7 % 1009
            texts.append((i, f"Text {i} of A-Z ÜÄ" if i % 5 else None))
            lang[i] = name
    rows = [(i, text, lang[i], "s", None if text is None else len(text)) for i, text in texts]
    assert found(make_docs(texts, lang=lang.get)) == sorted(brute_force(rows), key=repr)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd_docs.collect()]
    assert found(odd_docs) == sorted(brute_force(rows), key=repr)


def test_clashing_names_long_text_and_one_leaf(make_docs):
    names = ("grp", "n", "first", "at", "position", "digest", "block", "path", "altered", "root", "place")
    text = "A long Text. " * 200_000
    assert found(make_docs([(3, text)], **{c: "x" for c in names})) == brute_force([(3, text, None, "s", len(text))])


def test_empty_table(no_docs):
    assert found(no_docs) == []


def test_paths_are_the_siblings(spark, make_docs):
    docs = make_docs({i: f"t{i}" for i in range(100)})
    leaves = merkle.materialise(merkle.numbered(docs.select("doc_id", "lang", merkle.leaf().alias("digest")), "lang", ["doc_id"]), "leaves")
    rounds, sizes = merkle.build_log(leaves), leaves.select("grp", "n").distinct()
    ends = merkle.materialise(merkle.roots(rounds).selectExpr("grp", "round_no", f"cast(array() as {merkle._PATH}) path"), "ends")
    levels = tree([r["digest"] for r in leaves.orderBy("position").collect()])
    for r in merkle.proofs(rounds, sizes, ends).collect():
        i = r["position"]
        assert merkle.fold(levels[0][i], [(e["before"], e["behind"]) for e in r["path"]]) == levels[-1][0]
        assert [len(e["before"]) // 64 for e in r["path"]] == [i % 8, i // 8 % 8, i // 64 % 8]
    log = [tuple(r) for r in rounds[0].orderBy("place").select("place", "digest").collect()]
    order = []
    walk(levels, len(levels) - 1, 0, order)
    assert log == [(k, levels[a][b]) for k, (a, b) in enumerate(order)]
