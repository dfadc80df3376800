from __future__ import annotations

import random

import pytest
import xxhash

import corpus_pipeline
from topicweave.llm import simhash
from topicweave.llm.components import components


def slow_fingerprint(text, n=3):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        found = found.replace(space, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i:i + n]) for i in range(len(found) - n + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(bits, radius=2):
    ids = sorted(bits)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (bits[i] ^ bits[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_of_whole_texts():
    rng = random.Random(4)
    for text in [None, "", "  ", "One", "a\x0bB", "ÄÖ äö  x", *(" ".join(rng.choices("abcdé", k=k)) for k in (3, 4, 50, 3000))]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("crowd", [2, 16, 10_000])
def test_links_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(9)
    values = set()
    for _ in range(6):
        value = rng.getrandbits(64)
        for _ in range(25):
            values.add(value)
            for _ in range(rng.choice([1, 1, 2, 3])):
                value ^= 1 << rng.randrange(64)
    bits = dict(enumerate(values))
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long")
    links = simhash.fingerprint_links(rows)
    number = {(v - (1 << 64) if v >> 63 else v): i for i, v in bits.items()}
    pairs = spark.createDataFrame([(number[r[0]], number[r[1]]) for r in links.collect()], "a long, b long")
    found = {r["v"]: r["root"] for r in components(pairs).collect()}
    assert {i: found.get(i, i) for i in bits} == slow_components(bits)


def test_long_chain_is_one_component(spark):
    rng = random.Random(0)
    order = rng.sample(range(300), 300)
    chain = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(5, 5), (order[0], order[1])], "a long, b long")
    assert {r["root"] for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).isEmpty()


def test_documents(make_docs, odd_docs, no_docs):
    rng = random.Random(7)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(400)]
    texts = {i: " ".join(base if i < 60 else rng.choices(["x", "yy", "z", "w"], k=rng.randrange(1, 90))) for i in range(120)}
    for i in range(1, 60, 7):
        texts[i] = texts[i] + " tail" * i
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.label_documents(make_docs(texts)).collect()}
    bits = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: f for i, (f, _) in found.items()} == {i: f"{b:016x}" for i, b in bits.items()}
    assert {i: c for i, (_, c) in found.items()} == slow_components(bits)
    odd = simhash.label_documents(odd_docs).collect()
    assert len(odd) == 11
    by_id = {r["doc_id"]: r["component_id"] for r in odd}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[5] == by_id[4] == 4 and by_id[8] == 7 and by_id[None] is None
    assert simhash.label_documents(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "4", "6", "7", "9", "None"]


def test_very_long_text(make_docs):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(150_000))
    found = {r["doc_id"]: r for r in simhash.label_documents(make_docs({1: text, 2: text.upper(), 3: "a b"})).collect()}
    assert int(found[1]["fingerprint"], 16) == slow_fingerprint(text) and found[2]["component_id"] == 1


def test_near_copies_start_from_fingerprints(spark, make_docs, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(600)]
    texts = {1: " ".join(base), 2: " ".join([*base, "end"]), 3: " ".join(["new", *base]), 4: " ".join(base[60:]),
             5: " ".join(f"v{rng.randrange(4000)}" for _ in range(600)), 6: " ".join(base)}
    docs = make_docs(texts)
    pairs = {frozenset((r["x"], r["y"])) for r in simhash.likely_copies(docs).collect()}
    number = {r["c"]: r["doc_id"] for r in docs.where("doc_id < 6").select("doc_id", simhash.text_class().alias("c")).collect()}
    bits = {i: slow_fingerprint(t) for i, t in texts.items() if i < 6}
    near = {frozenset((i, j)) for i in bits for j in bits if i < j and (bits[i] ^ bits[j]).bit_count() <= 2}
    found = {frozenset(number[c] for c in pair) for pair in pairs}
    assert found and found <= near
    given = []
    plain = simhash.later_copies
    monkeypatch.setattr(simhash, "later_copies", lambda docs, likely: (given.append(likely.count()), plain(docs, likely))[1])
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == {1, 5}
    assert given == [len(pairs)]


def test_stage_drops_copies_that_the_fingerprints_link_whatever_their_sets_are(spark, make_docs):
    rng = random.Random(2)
    for _ in range(200):
        base = [f"w{rng.randrange(9000)}" for _ in range(400)]
        copy = list(base)
        for i in range(12, 400, 30):
            copy[i] = "other"
        a, b = (simhash.fingerprint(" ".join(t)) for t in (base, copy))
        if 0 < (a ^ b).bit_count() <= 2:
            break
    else:
        raise AssertionError("no copy within 2 bits")
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (base, copy)]
    assert 5 * len(sets[0] & sets[1]) < 4 * len(sets[0] | sets[1])
    near = [*copy[:300], *("new", "words"), *copy[300:]]  # similar to the copy, and so of its group
    spam = ["spam"] * 400
    texts = {3: " ".join(base), 1: " ".join(copy), 2: " ".join(near), 5: " ".join([*spam, "a", "b", "c"]), 4: " ".join([*"defghijklmnopq", *spam]),
             6: " ".join(f"v{rng.randrange(9000)}" for _ in range(400))}
    docs = make_docs(texts)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 4, 6}
    labels = {r["doc_id"]: r["component_id"] for r in simhash.label_documents(docs).collect()}
    assert labels[3] == labels[1] == 1 and labels[5] == 4
