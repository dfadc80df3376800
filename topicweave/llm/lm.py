"""Language-model scores by deleted interpolation.

The probability of a token after its history is a mixture of its relative frequency
there and of the next shorter model; the shortest is a smoothed unigram model. The
weights depend on how frequent the history is: histories are put into classes by the
power of two of their count. The weights are learned by expectation-maximisation
on held-out counts: one tenth of the training texts is left out of the counts, and the
others' counts say how well each part of the mixture predicts it. The final counts are
those of all training texts.

How it runs: tasks turn texts into chunks of bounded size with a word list of their own.
Every chunk counts its distinct n-grams and sends the counts to buckets by hash, so a
frequent n-gram is one entry of each chunk. A bucket adds up the counts and answers
every chunk with the totals, in the order that it asked, so that the answers need no
keys. Chunks then score their texts. The driver receives sums and, for the
weights, a histogram whose size does not depend on the corpus. Counts are exchanged, and texts scored, in
``PASSES`` turns, each with its share of the buckets or chunks: the shuffle of one turn is on disk at a time.

* Null and blank texts have one token, the end of the text. Long texts are a chunk.
* Repeated rows are counted and scored like any other rows.
* Rows with a null id are trained on. An empty table gives no rows.
* Words are told apart by 64-bit hashes. Held-out tokens with equal odds are one entry; nothing else has ties.
* Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.words import id_remainder, texts, words
from topicweave.plans.tables import materialise, released_shuffles

#: Longest n-grams.
ORDER = 3
#: Tokens of a chunk and of the corpus for each bucket; they bound the memory of a task.
CHUNK = 1_000_000
BUCKET = 2_000_000
#: Turns in which counts are exchanged and texts scored.
PASSES = 2
ADDED = 0.1
#: Classes of histories: none seen, then by powers of two.
CLASSES = 48
#: Steps of a power of two in which the held-out odds are told apart.
STEPS = 64
ROUNDS = 100

TEST, TUNE, FIT = 0, 1, 2
_START, _END = b" ", b"\n"
_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()),
                    ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])
_CHUNK_SCHEMA = "chunk long, kind int, tokens long, ids array<{}>, ends binary, codes binary, words binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(octets: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(octets), dtype=kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of their rank: the high bytes of the differences are mostly zero."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_keys(octets: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(octets), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, which is named by the first byte."""
    width = np.min_scalar_type(int(counts.max(initial=0))).itemsize
    return bytes([width]) + _pack(counts.astype(f"<u{width}"))


def _unpack_counts(octets: bytes) -> np.ndarray:
    return _unpack(octets[1:], f"<u{octets[0]}").astype(np.int64)


class _Chunk:
    """Texts of one kind that a task has not written yet."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {_START: 0, _END: 1}
        self.ids, self.ends, self.tokens = [], [], []
        self.size = 0

    def add(self, doc_id, found: list[bytes]) -> None:
        code = self.codes
        found.append(_END)
        self.tokens.append(np.array([code.setdefault(word, len(code)) for word in found], dtype=np.uint32))
        self.size += len(found)
        self.ids.append(doc_id)
        self.ends.append(self.size)

    def row(self, number: int, kind: int) -> pd.DataFrame:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.codes), dtype=np.uint64, count=len(self.codes))
        return pd.DataFrame([(number, kind, self.size, self.ids, _pack(np.array(self.ends, dtype=np.int64)),
                              _pack(np.concatenate(self.tokens)), hashes.tobytes())],
                            columns=["chunk", "kind", "tokens", "ids", "ends", "codes", "words"])


def chunks(docs: DataFrame) -> DataFrame:
    """Tokens of all texts, in chunks of one kind each."""
    remainder = id_remainder("doc_id", 10)
    kind = F.when(remainder == 0, TEST).when(remainder == 1, TUNE).otherwise(FIT)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        open_chunks = {kind: _Chunk() for kind in (TEST, TUNE, FIT)}
        for batch in batches:
            for doc_id, text, kind in zip(batch["doc_id"], batch["text"], batch["kind"], strict=True):
                chunk = open_chunks[kind]
                chunk.add(None if pd.isna(doc_id) else doc_id, words(text))
                if chunk.size >= CHUNK:
                    yield chunk.row(number, kind)
                    number += 1
                    open_chunks[kind] = _Chunk()
        for kind, chunk in open_chunks.items():
            if chunk.size:
                yield chunk.row(number, kind)
                number += 1

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs.withColumn("kind", kind), "kind").mapInPandas(build, _CHUNK_SCHEMA.format(id_type))


class _Grams:
    """The distinct n-grams of a chunk by order, sorted by key, and where its tokens are in them.

    ``at[n]`` has the position of the n-gram that ends with each token, ``history[n]``
    that of its first n - 1 tokens; the history of the first token is the start. Without ``places`` only
    keys and counts are kept.
    """

    def __init__(self, codes: bytes, ends: bytes, hashes: bytes, order: int, places: bool = True) -> None:
        tokens = _unpack(codes, "<u4")
        self.ends = _unpack(ends, "<i8")
        hashes = np.frombuffer(hashes, dtype="<u8")
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.starts = starts
        self.keys: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        self.history: dict[int, np.ndarray] = {}
        sorted_words = np.argsort(hashes, kind="stable")
        rank = np.empty(len(hashes), dtype=_place_type(len(hashes)))
        rank[sorted_words] = np.arange(len(hashes))
        self.keys[1] = hashes[sorted_words]
        self.at[1] = rank[tokens]
        self.counts[1] = np.bincount(self.at[1], minlength=len(hashes))
        self.counts[1][rank[0]] = len(self.ends)
        self.start = rank[0]
        for n in range(2, order + 1):
            before = np.empty(len(tokens), dtype=_place_type(len(tokens)))
            before[1:] = self.at[n - 1][:-1]
            before[starts] = rank[0] if n == 2 else -1
            if n > 3:
                before[_within(starts, self.ends, n - 2)] = -1
            if places:
                self.history[n] = before
            pair = before.astype(np.int64)
            pair += 1
            pair *= len(hashes)
            pair += self.at[1]
            if n > 2 and not places:
                del self.at[n - 1]
            del before
            distinct, position = _distinct(pair)
            head, tail = distinct // len(hashes) - 1, distinct % len(hashes)
            older = np.where(head >= 0, self.keys[n - 1][head], np.uint64(0))
            with np.errstate(over="ignore"):
                mixed = (older ^ (older >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + self.keys[1][tail] * np.uint64(2 * n + 1)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
            by_key = np.argsort(mixed, kind="stable")
            moved = np.empty(len(by_key), dtype=position.dtype)
            moved[by_key] = np.arange(len(by_key))
            self.keys[n] = mixed[by_key]
            self.at[n] = moved[position]
            self.counts[n] = np.bincount(self.at[n], minlength=len(by_key))
            del distinct, position, head, tail, older, mixed, by_key, moved


def _place_type(n: int) -> type:
    """The narrowest type of places among ``n``; -1 is none."""
    return np.int32 if n < 1 << 31 else np.int64


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the place of each value among them; ``values`` are sorted in place."""
    order = np.argsort(values).astype(_place_type(len(values)))
    values[:] = values[order]
    new = np.diff(values, prepend=values[:1] - 1) != 0
    position = np.empty(len(values), dtype=order.dtype)
    position[order] = np.cumsum(new, dtype=order.dtype) - 1
    return values[new], position


def _within(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` tokens of each text."""
    return np.concatenate([np.minimum(starts + i, ends - 1) for i in range(n)])


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where in the sorted keys each bucket, a range of keys, begins; and the end."""
    first = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(first, dtype=np.uint64)), [len(keys)]])


def _asked(table: DataFrame, order: int, buckets: int, turn: int) -> DataFrame:
    """Counts of the n-grams of every chunk by bucket, for the buckets of a turn."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("chunk", "kind", "codes", "ends", "words")}
                grams = _Grams(*(row[name].as_buffer() for name in ("codes", "ends", "words")), order, places=False)
                cuts = {n: _cuts(keys, buckets) for n, keys in grams.keys.items()}
                for b in range(turn, buckets, PASSES):
                    yield pa.RecordBatch.from_pydict({
                        "bucket": [b], "chunk": [row["chunk"].as_py()], "kind": [row["kind"].as_py()],
                        "keys": [[_pack_keys(grams.keys[n][cuts[n][b]:cuts[n][b + 1]]) for n in cuts]],
                        "counts": [[_pack_counts(grams.counts[n][cuts[n][b]:cuts[n][b + 1]]) for n in cuts]]}, schema=_ASKED)

    return table.mapInArrow(ask, "bucket int, chunk long, kind int, keys array<binary>, counts array<binary>")


def _answers(asked: DataFrame, order: int) -> DataFrame:
    """Totals of fitted and held-out texts for every chunk and bucket; sums for the driver."""
    start = np.uint64(xxhash.xxh64_intdigest(_START))

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = rows["kind"].to_numpy()
        totals = [[] for _ in range(len(rows))]
        fitted = tuned = types = 0
        for n in range(order):
            keys = [_unpack_keys(of_row[n]) for of_row in rows["keys"]]
            counts = np.concatenate([_unpack_counts(of_row[n]) for of_row in rows["counts"]])
            sizes = [len(k) for k in keys]
            distinct, position = np.unique(np.concatenate(keys), return_inverse=True)
            of_kind = np.repeat(kinds, sizes)
            fit, tune = (np.bincount(position, counts * (of_kind == kind), len(distinct)).astype(np.int64) for kind in (FIT, TUNE))
            for i, part in enumerate(np.split(position, np.cumsum(sizes)[:-1])):
                totals[i] += [_pack_counts(fit[part]), _pack_counts(tune[part])]
            if n == 0:
                token = distinct != start
                fitted, tuned, types = fit[token].sum(), tune[token].sum(), ((fit + tune > 0) & token).sum()
        first = np.arange(len(rows)) == 0
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "totals": totals,
                             "fitted": first * fitted, "tuned": first * tuned, "types": first * types})

    return asked.groupBy("bucket").applyInPandas(
        add_up, "chunk long, bucket int, totals array<binary>, fitted long, tuned long, types long")


class _Model:
    """Probabilities of the tokens of a chunk from the totals it was sent."""

    def __init__(self, grams: _Grams, answers: pd.DataFrame, with_tuning: bool, tokens: int, types: int) -> None:
        self.grams = grams
        self.totals = {}
        rows = answers.sort_values("bucket")["totals"].tolist()
        for n in grams.keys:
            fit = np.concatenate([_unpack_counts(row[2 * n - 2]) for row in rows])
            tune = np.concatenate([_unpack_counts(row[2 * n - 1]) for row in rows]) if with_tuning else 0
            self.totals[n] = fit + tune
        self.known = self.totals[1][grams.at[1]]
        self.base = (self.known + ADDED) / (tokens + ADDED * (types + 1))

    def parts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Class of the history of each token, and the token's relative frequency there."""
        before = self.grams.history[n]
        seen = np.where(before >= 0, self.totals[n - 1][before], 0)
        share = np.where(seen > 0, self.totals[n][self.grams.at[n]] / np.maximum(seen, 1), 0.0)
        return np.where(seen > 0, np.minimum(np.log2(np.maximum(seen, 1)).astype(int) + 1, CLASSES - 1), 0), share

    def probability(self, weights: dict[int, np.ndarray]) -> np.ndarray:
        p = self.base
        for n, of_class in weights.items():
            kind, share = self.parts(n)
            p = of_class[kind] * share + (1 - of_class[kind]) * p
        return p


def _by_chunk(table: DataFrame, answers: DataFrame, use, schema: str) -> DataFrame:
    return (table.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "totals").groupBy("chunk"))
            .applyInPandas(lambda left, right: use(left.iloc[0], right) if len(left) else pd.DataFrame(), schema))


def _odds(table: DataFrame, answers: DataFrame, order: int, n: int, weights: dict[int, np.ndarray],
          tokens: int, types: int) -> pd.DataFrame:
    """Held-out tokens by class of history and by the odds of order ``n`` against the shorter orders."""

    def count(chunk: pd.Series, totals: pd.DataFrame) -> pd.DataFrame:
        model = _Model(_Grams(chunk.codes, chunk.ends, chunk.words, order), totals, False, tokens, types)
        kind, share = model.parts(n)
        with np.errstate(divide="ignore"):
            step = np.maximum(np.round(np.log2(share / model.probability(weights)) * STEPS), -(1 << 20)).astype(int)
        found = pd.DataFrame({"kind": kind, "step": step, "n": 1}).groupby(["kind", "step"], as_index=False).sum()
        return found[found["kind"] > 0]

    held_out = table.where(F.col("kind") == TUNE)
    wanted = answers.join(materialise(held_out.select("chunk"), "held_out_chunks"), "chunk", "left_semi")
    return (_by_chunk(held_out, wanted, count, "kind int, step int, n long")
            .groupBy("kind", "step").agg(F.sum("n").alias("n")).toPandas())


def _learned(odds: pd.DataFrame) -> np.ndarray:
    """Weight of the longer order in each class, by expectation-maximisation; 0 for histories not seen.

    A class without held-out tokens has the weight of the next lower class that has some.
    """
    weights = np.zeros(CLASSES)
    for kind in range(1, CLASSES):
        found = odds[odds["kind"] == kind]
        ratio, n = 2.0 ** (found["step"].to_numpy() / STEPS), found["n"].to_numpy()
        weight = 0.5
        for _ in range(ROUNDS if len(n) else 0):
            weight = float((n * (weight * ratio / (weight * ratio + 1 - weight))).sum() / n.sum())
            weight = min(max(weight, 1e-6), 1 - 1e-6)
        weights[kind] = weight if len(n) else weights[kind - 1]
    return weights


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Score every text of ``docs``: see ``op9`` for the columns."""
    with released_shuffles(docs.sparkSession):
        return _score(docs, order)


def _score(docs: DataFrame, order: int) -> DataFrame:
    table = materialise(chunks(docs), "chunks")
    total = table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = max(1, total // BUCKET)
    answers = reduce(DataFrame.unionByName, [
        materialise(_answers(_asked(table, order, buckets, turn), order), "answers") for turn in range(min(PASSES, buckets))])
    fitted, tuned, types = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("fitted", "tuned", "types"))).first()
    weights: dict[int, np.ndarray] = {}
    for n in range(2, order + 1):
        weights[n] = _learned(_odds(table, answers, order, n, weights, fitted, types))
    tokens = fitted + tuned

    def rate(chunk: pd.Series, totals: pd.DataFrame) -> pd.DataFrame:
        grams = _Grams(chunk.codes, chunk.ends, chunk.words, order)
        model = _Model(grams, totals, True, tokens, types)

        def summed(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, grams.starts)

        return pd.DataFrame({
            "doc_id": list(chunk.ids), "held_out": chunk.kind == TEST, "n_tokens": np.diff(np.concatenate([[0], grams.ends])),
            "n_known": summed((model.known > 0).astype(np.int64)), "train_tokens": tokens,
            "base_score": summed(np.log10(model.base)), "score": summed(np.log10(model.probability(weights)))})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    share = F.pmod(F.xxhash64("chunk"), F.lit(min(PASSES, buckets)))
    return reduce(DataFrame.unionByName, [
        materialise(_by_chunk(table.where(share == turn), answers.where(share == turn), rate, schema), "scores")
        for turn in range(min(PASSES, buckets))])
