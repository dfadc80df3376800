"""Alignment of the tokens of two tokenizers, with corpus-wide counts of linked ids.

A byte-level BPE (A) and a SentencePiece model (B) cut the same bytes, a space and the text. Tokens are linked
where their bytes overlap; the places where tokens of both end cut a text into groups. A pair of ids counts the documents
in which it is linked.

1. *First pass*: every task aligns its documents and adds up the distinct pairs of each. What it has is dealt to
   shards by the pairs' hashes.
2. *Distinct pairs* of a shard are merged as a tree, with a bounded number of parts at each node, and get a minimal perfect
   hash (``perfect_hash``).
3. *Counts*: the parts of a shard become dense vectors indexed by that hash, which are summed as a tree. The number
   of distinct pairs depends on the vocabularies, not on the corpus.
4. *Second pass*: the documents are aligned again and their pairs are looked up by hash; the number that is stored at the place
   is compared. Tables that are too large for a task are taken in blocks of shards, one pass each (``ENTRIES``).

Neither tokenizer joins anything across the space between two words, so texts are aligned word by word, and a task
remembers words that it has seen (``WORDS``, by two generations).

* Null and empty texts, and texts that one tokenizer does not give back byte by byte, have no tokens: zeros, and an empty
  digest. They count for no pair.
* Repeated rows count as documents of their own. Ties for the highest count of an id are all best.
* Very long texts are aligned whole. An empty table has no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm import perfect_hash, sentencepieces
from topicweave.llm.perfect_hash import SHARDS, PerfectHash
from topicweave.llm.tokens import encode_plain, is_plain, token_bytes, vocabulary
from topicweave.plans.tables import materialise

#: Words that a task remembers: between this many and twice as many.
WORDS = 1 << 18
#: Characters of texts that are aligned at once, a text more at most.
CHARACTERS = 1 << 22
#: Distinct pairs that a task collects before it writes them.
PAIRS = 1 << 21
#: Parts that are merged or summed at once.
FAN = 64
#: Pairs of a block of shards whose table is handed to every task: 16 bytes each at most.
ENTRIES = 1 << 22

#: White space that is neither a space nor a line break, and the mark that the library takes for a space.
_RARE = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n") + "▁]")
_CUT = re.compile(r"(?<=[^\s▁])(?=[ \n][^\s▁])")
#: Words up to this long are tokenised many at once, and how many.
SHORT = 200
TOGETHER = 128

Paths = tuple[tuple[str, str], str]


def default_paths() -> Paths:
    """Vocabularies of A, for its two libraries, and of B."""
    return vocabulary("byte_bpe_50k"), sentencepieces.model()


def split(text: str) -> list[str]:
    """Words of a space and the text, in order.

    Cuts are only made where one space or line break stands between other characters, which no token of either side
    crosses. A word comes without its space, or with its line break; what is neither comes whole behind a mark.
    """
    if not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _RARE.search(text)):
        return text.replace("\n", " \n").split(" ")
    words = []
    for part in _CUT.split(" " + text):
        inner = part[1:]
        plain = inner.split() == [inner] and "▁" not in inner
        words.append((inner if part[0] == " " else part) if plain and part[0] in " \n" else "▁" + part)
    return words


def spelt(word: str) -> str:
    """A word as it stands in the text."""
    return word[1:] if word[0] == "▁" else word if word[0] == "\n" else " " + word


@cache
def _piece_bytes(path: str) -> list[bytes]:
    sp = sentencepieces.processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(sentencepieces.MARK, " ").encode()
            for i, piece in enumerate(pieces)]


@cache
def _sizes(paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    a, b = token_bytes(paths[0][1]), _piece_bytes(paths[1])
    return np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)


@cache
def _spellings(paths: Paths) -> list[str]:
    """Ids of A inside and at the end of a group's A, then those of B, each with the sign that follows."""
    a, b = (list(map(str, range(len(sizes)))) for sizes in _sizes(paths))
    return [x + sign for ids, signs in ((a, ",|"), (b, ",;")) for sign in signs for x in ids]


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of bounded size."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= CHARACTERS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _ids_of(words: list[str], paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that follow each other, by A and by B; neither side puts a space before them."""
    sp = sentencepieces.processor(paths[1])
    texts = ["".join(words[i:i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
    # a line break before a text keeps the marker that the library puts there away from it
    b = [ids[1:] if text[0] == "\n" else ids[2:]
         for text, ids in zip(texts, sp.encode([text if text[0] == "\n" else "\n" + text for text in texts], num_threads=1), strict=True)]
    return (np.concatenate([encode_plain(text, paths[0]) for text in texts]).astype(np.int64),
            np.fromiter(chain.from_iterable(b), dtype=np.int64, count=sum(map(len, b))))


class Alignments:
    """Words aligned by a task, in two generations of bounded size.

    An entry has the tokens of A, those of B, groups, links, and what ``judge`` says of the links, two numbers that are
    summed; then the pairs (without ``judge``) and the text of the groups (``with_groups``). A word that is not given back
    has -1 tokens.
    """

    def __init__(self, paths: Paths, judge=None, with_groups: bool = False):
        self.paths, self.judge, self.with_groups = paths, judge, with_groups
        self.width = len(_sizes(paths)[1])
        self.old: dict[str, tuple] = {}
        self.new: dict[str, tuple] = {}

    def of(self, words: list[str]) -> list[tuple]:
        """Entry of each of some distinct words: shape, pairs, groups."""
        if len(self.new) > WORDS:
            self.old, self.new = self.new, {}
        found = [self.new.get(word) for word in words]
        old = self.old
        missing = []
        for i, entry in enumerate(found):
            if entry is None:
                entry = found[i] = old.get(words[i])
                if entry is None:
                    missing.append(i)
                else:
                    self.new[words[i]] = entry
        if missing:
            new = [words[i] for i in missing]
            for i, entry in zip(missing, self._align(new), strict=True):
                found[i] = self.new[words[i]] = entry
        return found

    def _align(self, words: list[str]) -> list[tuple]:
        """Entries of words that are tokenised together where that gives the ids that they have alone."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, word in enumerate(words):
            printable = word.isascii() and (word[1:] if word[0] == "\n" else word).isprintable()
            kinds[2 if word[0] == "▁" or len(word) > SHORT else 0 if printable or is_plain(word) else 1].append(i)
        out: list[tuple] = [()] * len(words)
        for group in (*kinds[:2], *([i] for i in kinds[2])):
            if group:
                for i, entry in zip(group, self._aligned([spelt(words[i]) for i in group]), strict=True):
                    out[i] = entry
        return out

    def _aligned(self, words: list[str]) -> list[tuple]:
        octets = "".join(words).encode()
        ids_a, ids_b = _ids_of(words, self.paths)
        of_a, of_b = token_bytes(self.paths[0][1]), _piece_bytes(self.paths[1])
        if b"".join([of_a[i] for i in ids_a.tolist()]) != octets or b"".join([of_b[i] for i in ids_b.tolist()]) != octets:
            if len(words) == 1:
                return [((-1, 0, 0, 0, 0, 0), None, None)]
            half = len(words) // 2
            return self._aligned(words[:half]) + self._aligned(words[half:])
        size_a, size_b = _sizes(self.paths)
        end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
        word_end = np.cumsum([len(word.encode()) for word in words])
        ends = _unique(np.concatenate([end_a, end_b]))
        pairs = ids_a[np.searchsorted(end_a, ends)] * self.width + ids_b[np.searchsorted(end_b, ends)]
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        stop_a, stop_b, stop_link, stop_group = (np.searchsorted(some, word_end) + 1 for some in (end_a, end_b, ends, both))
        columns = [np.diff(stop, prepend=0) for stop in (stop_a, stop_b, stop_group, stop_link)]
        first = stop_link - columns[3]
        judged = self.judge(pairs) if self.judge else [np.zeros(len(pairs), dtype=np.int64)] * 2
        shapes = zip(*(c.tolist() for c in [*columns, *(np.add.reduceat(c, first) for c in judged)]), strict=True)
        of_words = [None] * len(words) if self.judge else [pairs[i:j] for i, j in zip(first.tolist(), stop_link.tolist(), strict=True)]
        texts = self._groups(ids_a, ids_b, end_a, end_b, both, columns[0] + columns[1]) if self.with_groups else [None] * len(words)
        return list(zip(shapes, of_words, texts, strict=True))

    def _groups(self, ids_a, ids_b, end_a, end_b, both, n_tokens) -> list[str]:
        """Text of the groups of each word: all tokens in order of group and side, each with what follows it."""
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        n = len(_sizes(self.paths)[0])
        spelt_as = np.concatenate([ids_a + n * (end_a == both[group_a]), 2 * n + ids_b + self.width * (end_b == both[group_b])])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        tokens = list(map(_spellings(self.paths).__getitem__, spelt_as[order].tolist()))
        stops = np.cumsum(n_tokens).tolist()
        return ["".join(tokens[i:j])[:-1] for i, j in zip([0, *stops], stops, strict=False)]

    def of_texts(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Entries of the distinct words of some texts, the numbers of all words in order, and where each text ends."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        numbers, ends = [], []
        for text in texts:
            if text:
                numbers += map(number.__getitem__, split(text))
            ends.append(len(numbers))
        return self.of(list(number)), np.array(numbers, dtype=np.int64), np.array(ends, dtype=np.int64)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)


def _unique(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting is faster here than hashing."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=values[0] - 1))] if len(values) else values


def _distinct(entries: list[tuple], numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of some texts, and in how many of them each is; texts with a word that is not given back have none."""
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    lost = np.array([entry[0][0] < 0 for entry in entries], dtype=bool)
    if lost.any():
        kept = ~np.isin(doc, doc[lost[numbers]])
        doc, numbers = doc[kept], numbers[kept]
    found = _unique(doc << 32 | numbers)
    doc, numbers = found >> 32, found & 0xFFFFFFFF
    none = np.zeros(0, dtype=np.int64)
    pairs = np.concatenate([none, *(none if own is None else own for _, own, _ in entries)])
    sizes = np.array([0 if own is None else len(own) for _, own, _ in entries], dtype=np.int64)
    n = sizes[numbers]
    at = np.repeat((np.cumsum(sizes) - sizes)[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum())
    in_doc = np.sort(_unique(np.repeat(doc, n) << 48 | pairs[at]) & ((1 << 48) - 1))
    first = np.flatnonzero(np.diff(in_doc, prepend=-1))
    return in_doc[first], np.diff(first, append=len(in_doc))


def partial_counts(docs: DataFrame, paths: Paths) -> DataFrame:
    """First pass: ``part``, ``shard``, ``pairs`` (differences, packed) and ``counts`` of documents, packed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Alignments(paths)
        values, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        flushed, pending = 0, []

        def rows() -> pd.DataFrame:
            nonlocal flushed
            part = TaskContext.get().partitionId() << 32 | flushed
            flushed += 1
            shards = perfect_hash.shard_of(values)
            order = np.argsort(shards, kind="stable")
            cuts = np.searchsorted(shards[order], np.arange(SHARDS + 1))
            found = [(part, i, _pack(np.diff(values[own], prepend=0)), _pack(counts[own]))
                     for i in range(SHARDS) if len(own := order[cuts[i]:cuts[i + 1]])]
            return pd.DataFrame(found, columns=["part", "shard", "pairs", "counts"])

        for batch in batches:
            for texts in _runs(batch["text"].tolist()):
                pending.append(_distinct(*known.of_texts(texts)))
                if sum(len(p[0]) for p in pending) > PAIRS:
                    values, counts = _summed(*(np.concatenate([x, *(p[i] for p in pending)]) for i, x in enumerate((values, counts))))
                    pending = []
                    if len(values) > PAIRS:
                        yield rows()
                        values = counts = np.zeros(0, dtype=np.int64)
        values, counts = _summed(*(np.concatenate([x, *(p[i] for p in pending)]) for i, x in enumerate((values, counts))))
        if len(values):
            yield rows()

    return docs.select("text").mapInPandas(count, "part long, shard int, pairs binary, counts binary")


def _rounds(table: DataFrame, merge, schema: str, branches: int, name: str) -> DataFrame:
    """Apply ``merge`` to the rows of each shard as a tree: about ``FAN`` rows at a node."""
    table = table.withColumn("branch", F.xxhash64("part"))
    while True:
        branches = -(-branches // FAN)
        table = table.withColumn("branch", F.pmod("branch", F.lit(branches)))
        table = materialise(table.groupBy("shard", "branch").applyInPandas(merge, f"shard int, branch long, {schema}"), name)
        if branches <= 1:
            return table


def pair_table(docs: DataFrame, paths: Paths | None = None) -> DataFrame:
    """A row for each shard: ``shard``, ``n``, ``levels`` (of the hash), ``pairs`` and ``counts`` by place, packed."""
    parts = materialise(partial_counts(docs, paths or default_paths()), "pair_parts")
    branches = parts.select("part").distinct().count()

    def union(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(np.concatenate([np.cumsum(_unpack(p)) for p in rows["pairs"]]))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "branch": rows["branch"].iloc[0], "pairs": [_pack(np.diff(values, prepend=0))]})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for shard, packed in zip(batch["shard"], batch["pairs"], strict=True):
                values = np.cumsum(_unpack(packed))
                levels = perfect_hash.build(values)
                by_place = np.empty_like(values)
                by_place[PerfectHash.of({shard: levels}).places(values)] = values
                rows.append((shard, len(values), [level.tobytes() for level in levels], _pack(by_place)))
            yield pd.DataFrame(rows, columns=["shard", "n", "levels", "by_place"])

    distinct = _rounds(parts.select("part", "shard", "pairs"), union, "pairs binary", branches, "shard_pairs")
    hashes = materialise(distinct.mapInPandas(hashed, "shard int, n long, levels array<binary>, by_place binary"), "pair_hashes")

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([
                (shard, part, _pack(_vector(shard, n, levels, [(np.cumsum(_unpack(pairs)), _unpack(counts))])))
                for shard, part, n, levels, pairs, counts in batch[["shard", "part", "n", "levels", "pairs", "counts"]].itertuples(index=False)],
                columns=["shard", "part", "vector"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([_unpack(v) for v in rows["vector"]], axis=0)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "branch": rows["branch"].iloc[0], "vector": [_pack(total)]})

    vectors = parts.join(hashes.select("shard", "n", "levels"), "shard").mapInPandas(dense, "shard int, part long, vector binary")
    summed = _rounds(vectors, add, "vector binary", branches, "pair_vectors")
    return materialise(hashes.join(summed, "shard").select("shard", "n", "levels", F.col("by_place").alias("pairs"), F.col("vector").alias("counts")),
                       "pair_table")


def _vector(shard: int, n: int, levels, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Dense counts of a shard by place."""
    own = PerfectHash.of({shard: [np.frombuffer(level, dtype="<u8") for level in levels]})
    total = np.zeros(n, dtype=np.int64)
    for values, counts in parts:
        total[own.places(values)] += counts
    return total


def pair_counts(table: DataFrame, paths: Paths | None = None) -> DataFrame:
    """``a``, ``b`` and ``n_docs`` of every linked pair of ids, from a pair table."""
    width = len(_sizes(paths or default_paths())[1])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pairs, counts in zip(batch["pairs"], batch["counts"], strict=True):
                values = _unpack(pairs)
                yield pd.DataFrame({"a": values // width, "b": values % width, "n_docs": _unpack(counts)})

    return table.select("pairs", "counts").mapInPandas(rows, "a long, b long, n_docs long")


class _Lookup:
    """Counts of the pairs of some shards, and whether they are the highest of their A id."""

    def __init__(self, rows: pd.DataFrame, best: np.ndarray, width: int):
        rows = rows.sort_values("shard")
        self.hash = PerfectHash.of({s: [np.frombuffer(level, dtype="<u8") for level in levels] for s, levels in zip(rows["shard"], rows["levels"], strict=True)})
        join = lambda column: np.concatenate([_unpack(v) for v in rows[column]])
        pairs, counts = join("pairs"), join("counts")
        self.best = counts == best[pairs // width]
        self.pairs = pairs.astype(np.min_scalar_type(pairs.max()))
        self.counts = counts.astype(np.min_scalar_type(counts.max()))
        self.shards = np.isin(np.arange(SHARDS), rows["shard"])

    def judge(self, pairs: np.ndarray) -> list[np.ndarray]:
        """For each pair whether its count is best, and its count; zero for pairs of other shards.

        A pair that the first pass did not count is zero too: it is in texts only that are not given back.
        """
        best, counts = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
        own = np.flatnonzero(self.shards[perfect_hash.shard_of(pairs)])
        at = self.hash.places(pairs[own])
        there = at >= 0
        there[there] = self.pairs[at[there]] == pairs[own[there]]
        own, at = own[there], at[there]
        best[own], counts[own] = self.best[at], self.counts[at]
        return [best, counts]


def _blocks(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shards in blocks of at most ``ENTRIES`` pairs, but of one shard at least."""
    blocks, room = [], 0
    for shard, n in sorted(sizes):
        if not blocks or n > room:
            blocks.append([])
            room = ENTRIES
        blocks[-1].append(shard)
        room -= n
    return blocks


def align(docs: DataFrame, paths: Paths | None = None, keep: bool = False) -> DataFrame:
    """One row for each document row, with the counts of its tokens, groups and links and a digest of its groups.

    ``n_best`` are links whose pair has its A id's highest count, ``count_sum`` the counts of all links. With ``keep``, ``groups`` is the
    text of the groups that the digest is of.
    """
    paths = paths or default_paths()
    spark = docs.sparkSession
    table = pair_table(docs.select("text"), paths)
    width = len(_sizes(paths)[1])
    highest = pair_counts(table, paths).groupBy("a").agg(F.max("n_docs").alias("n")).toPandas()
    best = np.zeros(len(_sizes(paths)[0]), dtype=np.int64)
    best[highest["a"].to_numpy(dtype=np.int64)] = highest["n"]
    blocks = _blocks([tuple(r) for r in table.select("shard", "n").collect()]) or [[]]
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in names[1:7])}, groups_sha256 string" + ", groups string" * keep
    zero = F.lit(0).cast("long")
    rows = docs.select("doc_id", "text", zero.alias("n_best"), zero.alias("count_sum"))
    for i, block in enumerate(blocks):
        last = i + 1 == len(blocks)
        shared = spark.sparkContext.broadcast(_Lookup(table.where(F.col("shard").isin(block)).toPandas(), best, width) if block else None)

        def judge(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            known = Alignments(paths, shared.value.judge if shared.value else None, with_groups=last)
            for batch in batches:
                shapes, digests, kept = [np.zeros((0, 6), dtype=np.int64)], [], []
                for texts in _runs(batch.column("text").to_pylist()):
                    entries, numbers, ends = known.of_texts(texts)
                    of_words = np.array([entry[0] for entry in entries], dtype=np.int64).reshape(-1, 6)
                    summed = np.zeros((len(numbers) + 1, 6), dtype=np.int64)
                    np.cumsum(of_words[numbers], axis=0, out=summed[1:])
                    lost = np.concatenate([[0], np.cumsum(of_words[numbers, 0] < 0)])
                    starts = ends - np.diff(ends, prepend=0)
                    whole = (lost[ends] == lost[starts]) & (ends > starts)
                    shapes.append(np.where(whole[:, None], summed[ends] - summed[starts], 0))
                    if last:
                        text_of, listed = [entry[2] for entry in entries], numbers.tolist()
                        for i, j, ok in zip(starts.tolist(), ends.tolist(), whole.tolist(), strict=True):
                            groups = ";".join([text_of[n] for n in listed[i:j]]) if ok else ""
                            digests.append(hashlib.sha256(groups.encode()).hexdigest() if ok else "")
                            kept.append(groups if keep else None)
                columns = np.concatenate(shapes).T
                more = [columns[k] + batch.column(c).to_numpy() for k, c in ((4, "n_best"), (5, "count_sum"))]
                if last:
                    found = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in [*columns[:4], *more]), pa.array(digests, pa.string())]
                    yield pa.RecordBatch.from_arrays(found + [pa.array(kept, pa.string())] * keep, names=names + ["groups"] * keep)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *(pa.array(c, pa.int64()) for c in more)],
                                                     names=["doc_id", "text", "n_best", "count_sum"])

        if last:
            return rows.mapInArrow(judge, schema)
        rows = materialise(rows.mapInArrow(judge, f"doc_id {kind}, text string, n_best long, count_sum long"), "judged_texts")
