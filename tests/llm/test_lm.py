from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from topicweave.llm import lm


def slow(docs, order):
    """Scores by dictionaries, with weights from exact (unbinned) odds."""
    split = {i: [*(t or "").lower().split(), None] for i, t in docs.items()}
    rest = {i: zlib.crc32(str(i).encode()) % 10 for i in docs}

    def counts(ids):
        found = [Counter() for _ in range(order + 1)]
        for i in ids:
            padded = ["<s>", *split[i]]
            found[1].update(split[i])
            found[1]["<s>"] += 1
            for n in range(2, order + 1):
                found[n].update(tuple(padded[k - n + 1:k + 1]) for k in range(n - 1, len(padded)))
        return found

    def total(c):
        return sum(n for w, n in c[1].items() if w != "<s>")

    every = counts(i for i in docs if rest[i])
    fit = counts(i for i in docs if rest[i] > 1)
    types = len([w for w in every[1] if w != "<s>"])

    def parts(c, i, n):
        """For each token: class of history, relative frequency."""
        padded = ["<s>", *split[i]]
        for k in range(1, len(padded)):
            if k - n + 1 < 0:
                yield 0, 0.0
                continue
            gram = tuple(padded[k - n + 1:k + 1])
            seen = c[1][gram[0]] if n == 2 else c[n - 1][gram[:-1]]
            yield (int(math.log2(seen)) + 1, c[n][gram] / seen) if seen else (0, 0.0)

    def base(c, i):
        return [(c[1][w] + 0.1) / (total(c) + 0.1 * (types + 1)) for w in split[i]]

    def probabilities(c, i, weights):
        p = base(c, i)
        for n, lam in weights.items():
            p = [lam[k] * s + (1 - lam[k]) * q for (k, s), q in zip(parts(c, i, n), p, strict=True)]
        return p

    weights = {}
    for n in range(2, order + 1):
        events = {}
        for i in docs:
            if rest[i] == 1:
                for (k, s), q in zip(parts(fit, i, n), probabilities(fit, i, weights), strict=True):
                    if k:
                        events.setdefault(k, []).append(s / q)
        lam, last = [0.0] * lm.CLASSES, 0.0
        for k in range(1, lm.CLASSES):
            if k in events:
                last = 0.5
                for _ in range(lm.ROUNDS):
                    last = min(max(sum(last * r / (last * r + 1 - last) for r in events[k]) / len(events[k]), 1e-6), 1 - 1e-6)
            lam[k] = last
        weights[n] = lam
    out = {}
    for i in docs:
        p = probabilities(every, i, weights)
        out[i] = (rest[i] == 0, len(split[i]), sum(every[1][w] > 0 for w in split[i]), total(every),
                  sum(map(math.log10, base(every, i))), sum(map(math.log10, p)))
    return out


def corpus(n=150):
    rng = random.Random(5)
    words = [f"W{k}" for k in range(40)]
    docs = {}
    for i in range(n):
        text, word = [], rng.choice(words)
        for _ in range(rng.randrange(0, 60)):
            word = words[(words.index(word) * 3 + rng.choice([0, 0, 0, 1, 2])) % 40] if rng.random() < 0.8 else f"x{rng.randrange(900)}"
            text.append(word)
            word = word if word in words else rng.choice(words)
        docs[i] = " ".join(text)
    return docs | {n: None, n + 1: "", n + 2: "w1 W1\tw1\n"}


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_brute_force(make_docs, monkeypatch, order):
    monkeypatch.setattr(lm, "STEPS", 4096)
    docs = corpus()
    wanted = slow(docs, order)
    found = {r["doc_id"]: tuple(r[1:]) for r in lm.score(make_docs(docs), order).collect()}
    assert set(found) == set(wanted)
    for i, row in wanted.items():
        assert found[i][:4] == row[:4]
        assert found[i][4] == pytest.approx(row[4], rel=1e-9)
        assert found[i][5] == pytest.approx(row[5], rel=2e-3, abs=2e-3)
    held_out = [i for i in docs if wanted[i][0]]
    assert sum(found[i][5] for i in held_out) > sum(found[i][4] for i in held_out)


def test_chunks_and_buckets_do_not_matter(make_docs, monkeypatch):
    docs = corpus(60)
    one = {r["doc_id"]: r["score"] for r in lm.score(make_docs(docs)).collect()}
    monkeypatch.setattr(lm, "BUCKET", 300)
    many = {r["doc_id"]: r["score"] for r in lm.score(make_docs(docs).repartition(5)).collect()}
    assert many == pytest.approx(one, rel=1e-12)


def test_cuts_cover_all_keys():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    for buckets in (1, 2, 7):
        cuts = lm._cuts(keys, buckets)
        assert len(cuts) == buckets + 1 and cuts[0] == 0 and cuts[-1] == 1000 and (np.diff(cuts) >= 0).all()


def test_odd_rows(odd_docs, no_docs):
    found = lm.score(odd_docs).collect()
    assert len(found) == 11 and all(np.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert lm.score(no_docs).count() == 0


def test_query_scores_with_two_words_of_context(make_docs):
    docs = corpus(60)
    default, three, two = ({r["doc_id"]: r["score"] for r in lm.score(make_docs(docs), *order).collect()} for order in ((), (3,), (2,)))
    assert default == pytest.approx(three, rel=1e-12) and default != pytest.approx(two, rel=1e-6)


def test_packed_keys_and_counts_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 200_000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm._unpack_keys(lm._pack_keys(keys)) == keys).all()
        for top in (2, 300, 2**40):
            counts = rng.integers(0, top, n)
            assert (lm._unpack_counts(lm._pack_counts(counts)) == counts).all()
    assert len(lm._pack_keys(keys)) < 0.85 * keys.nbytes


def test_very_long_text_and_clashing_names(make_docs):
    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(100_000))
    docs = make_docs({1: text, 2: "w1 w2", 3: "w3"}, tokens="x", score="y", chunk="z", kind="k", ids="i")
    found = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert found[1]["n_tokens"] == 100_001 and found[2]["n_tokens"] == 3 and all(r["score"] < 0 for r in found.values())


def test_places_take_four_bytes_and_are_left_out_where_only_counts_are_asked_for():
    rng = np.random.default_rng(3)
    hashes = rng.integers(1, 1 << 63, 50, dtype=np.uint64)
    ends, codes = np.array([3, 4, 2000]), rng.integers(1, 50, 2000)
    packed = lm._pack(codes.astype(np.uint32)), lm._pack(ends.astype(np.int64)), hashes.tobytes()
    whole, counted = lm._Grams(*packed, 3), lm._Grams(*packed, 3, places=False)
    assert not counted.history and {a.dtype.itemsize for a in (*whole.at.values(), *whole.history.values())} == {4}
    for n in (1, 2, 3):
        assert whole.keys[n].tolist() == counted.keys[n].tolist() and whole.counts[n].tolist() == counted.counts[n].tolist()
    windows = {2: {}, 3: {}}
    for first, last in zip([0, 3, 4], ends.tolist()):
        text = codes[first:last].tolist()
        for n in (2, 3):
            for i in range(len(text)):
                gram = tuple(([0] * 2 + text)[i + 3 - n:i + 3]) if i >= n - 2 else (None, *text[:i + 1])
                windows[n][gram] = windows[n].get(gram, 0) + 1
    for n in (2, 3):
        assert sorted(windows[n].values()) == sorted(whole.counts[n].tolist())


def test_the_shuffle_of_one_turn_is_on_disk_at_a_time(spark, make_docs, monkeypatch):
    def shuffle_files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {path for path in found.split("\n") if "/shuffle_" in path}

    docs = make_docs(corpus(60))
    plain, turns = lm._answers, []
    monkeypatch.setattr(lm, "_answers", lambda asked, order: turns.append((shuffle_files(), asked)) or plain(asked, order))
    monkeypatch.setattr(lm, "BUCKET", 300)
    before = shuffle_files()
    assert lm.score(docs).count() == 63
    assert len(turns) == lm.PASSES and all(not files - before for files, _ in turns)
    asked = [{r["bucket"] for r in rows.select("bucket").distinct().collect()} for _, rows in turns]
    assert len(set().union(*asked)) == sum(map(len, asked)) > lm.PASSES
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
