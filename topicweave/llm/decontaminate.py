"""Benchmark decontamination by latent semantic retrieval.

Words are weighted by their rarity in the corpus, and a randomised singular value
decomposition of the weighted passages gives a space of few dimensions. A passage of a
document is a candidate for a benchmark item when their cosine there is high, and is
verified by the longest common subsequence of their words and by a look for the item's
answer. An item is in a document when most of its words are there in order, or when a
good part of them and of its answer is; by weight too, so that common words alone are
not enough.

Which passages are looked at: of an item's rarest words, ``ANCHORS`` more than may be
missing, a passage that can pass has at least ``ANCHORS``. Each occurrence of such a word is
laid against its place in the item, and the passage of the item's length around it is
compared when it has that many of them. So every place that can pass is looked at.

Passages near an item by cosine are looked at too, whatever words they share and in which order:
windows of about the item's length over the whole text. They are verified sentence by
sentence, so that sentences may change places, or by the item's answer, word for word, and a
smaller part of the other words.

The benchmark is the query set, taken in blocks of bounded size. Document frequencies are
counted over all documents, and the decomposition is fitted on the passages of all of them.

* A null or empty text holds no item; a null or empty item is in no document.
* Repeated rows are judged one by one. Items with equal texts are all reported.
* Long texts are searched whole. An empty table on either side gives no rows.
* Of several places of one item the one with the largest share of its words is reported, then the one with the larger cosine.
  Words of equal frequency are in the order in which the items have them.
* Other columns are not read, whatever their names; the stage that drops documents hands them on as they are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.words import texts
from topicweave.plans.tables import materialise

#: Items that are searched for at once.
BLOCK = 10_000
RANK = 64
OVERSAMPLED = 8
#: Words of a passage that the space is fitted on.
PASSAGE = 64
#: Texts and passages that are multiplied at once.
TEXTS = 256
PASSAGES = 256
#: Rare words of an item that a passage has to have, where the item is long enough.
ANCHORS = 3
#: Least cosine of a candidate.
LEAST_COSINE = 0.4
#: Least cosine of a window that is a candidate by it alone; ratio of the lengths of items that share windows.
NEAR_COSINE = 0.6
RATIO = 1.4
#: Least share of an item's words, in number and by weight, where its sentences have any order.
LEAST_REORDERED = 0.85
#: Least share of an item's words, in number and by weight, where its answer is there word for word, and that answer's words.
LEAST_REWORDED = 0.4
LONG_ANSWER = 4
#: Words of a text whose windows are compared at once.
STRETCH = 8192
#: Least share of an item's words in order, with its answer and without.
LEAST_WITH_ANSWER = 0.6
LEAST = 0.75
#: Least share of an item's words by weight, in any order.
LEAST_WEIGHT = 0.6
#: Least share of the answer's words in order.
LEAST_ANSWER = 0.6
#: Words more than the item's that a passage has on either side, as share.
SLACK = 0.15

_SPACE = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or c < 33 else c for c in range(256))
_SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words between white space and ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split() if text else []


@dataclass
class Item:
    item_id: object
    words: list[int]
    answer: list[int]
    sentences: list[list[int]]


@dataclass
class Benchmark:
    """A block of items over a vocabulary of their own words."""

    vocabulary: dict[bytes, int]
    items: list[Item]

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Benchmark:
        vocabulary: dict[bytes, int] = {}
        items = []
        for item_id, text in zip(rows["item_id"], rows["text"], strict=True):
            found = [vocabulary.setdefault(word, len(vocabulary)) for word in plain_words(text)]
            if found:
                ends = [m.end() for m in _SENTENCE_END.finditer(text.strip())]
                tail = len(plain_words(text.strip()[ends[-1]:])) if ends else len(found) // 3
                cuts = [0, *ends, len(text.strip())]
                parts = [plain_words(text.strip()[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                items.append(Item(item_id, found, found[len(found) - max(tail, 1):], [[vocabulary[w] for w in part] for part in parts if part]))
        return cls(vocabulary, items)

    def ids(self, text: str | None) -> np.ndarray:
        """Words of a text as numbers; -1 for words of no item."""
        found = plain_words(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), dtype=np.int64, count=len(found))

    @property
    def stored(self) -> str:
        """The type in which the numbers are stored."""
        return "<i2" if len(self.vocabulary) < 1 << 15 else "<i4"


def common_subsequence(masks: dict[int, int], length: int, passage: list[int]) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word of the item."""
    every = (1 << length) - 1
    row = every
    for word in passage:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & every
    return length - row.bit_count()


def _masks(found: list[int]) -> dict[int, int]:
    masks: defaultdict[int, int] = defaultdict(int)
    for i, word in enumerate(found):
        masks[word] |= 1 << i
    return dict(masks)


def _holds(passage: np.ndarray, wanted: list[int]) -> bool:
    """Whether the words ``wanted`` follow each other in the passage."""
    at = np.flatnonzero(passage[:len(passage) - len(wanted) + 1] == wanted[0]) if len(passage) >= len(wanted) else []
    return any(passage[i:i + len(wanted)].tolist() == wanted for i in at)


def _entries(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``n`` of them."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class Detector:
    """Finds the items of a block in a text. ``space`` has a row for each word and a last one of zeros."""

    benchmark: Benchmark
    space: np.ndarray
    frequency: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        self.masks = [(_masks(item.words), _masks(item.answer)) for item in self.benchmark.items]
        self.parts = [[(_masks(part), len(part)) for part in item.sentences] for item in self.benchmark.items]
        self.counts = [Counter(item.words) for item in self.benchmark.items]
        vectors = np.stack([self.space[item.words].sum(axis=0) for item in self.benchmark.items])
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.lengths = np.array([len(item.words) for item in self.benchmark.items])
        scale = np.round(np.log(self.lengths) / np.log(RATIO)).astype(int)
        self.scales = [self._scale(int(round(RATIO**k)), np.flatnonzero(scale == k)) for k in np.unique(scale).tolist()]
        spared = ((1 - LEAST_WITH_ANSWER) * self.lengths + 1e-9).astype(int)
        taken = np.minimum(self.lengths, spared + ANCHORS)
        self.needed = taken - spared
        self.widths = np.array([item_length + 2 * self._slack(number) for number, item_length in enumerate(self.lengths.tolist())])
        anchors = sorted(
            (item.words[place], number, place) for number, item in enumerate(self.benchmark.items)
            for place in sorted(range(len(item.words)), key=lambda i, w=item.words: (self.frequency[w[i]], w[i], i))[:taken[number]])
        words, self.numbers, self.places = np.array(anchors, dtype=np.int64).T
        self.first = np.searchsorted(words, np.arange(len(self.space) + 1))

    def _scale(self, width: int, numbers: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Items whose windows have one width: which items each word is in and how often, and the least weight of each item."""
        word, column = np.array(sorted((w, i) for i, number in enumerate(numbers) for w in self.counts[number]), dtype=np.int64).T
        least = [LEAST_REWORDED * sum(self.weight[w] * n for w, n in self.counts[number].items()) for number in numbers]
        whole = np.array([self.weight[w] * self.counts[numbers[i]][w] for w, i in zip(word.tolist(), column.tolist(), strict=True)])
        return width, numbers, np.searchsorted(word, np.arange(len(self.space) + 1)), column, whole, np.array(least) - 1e-9

    def find(self, text: str | None) -> dict[int, tuple[float, float, bool]]:
        """Numbers of the items in a text, each with cosine, share of its words and whether its answer is there."""
        return self.find_ids(self.benchmark.ids(text))

    def find_ids(self, ids: np.ndarray) -> dict[int, tuple[float, float, bool]]:
        """The same in a text given as the numbers of its words."""
        at = np.flatnonzero(ids >= 0)
        begin, n = self.first[ids[at]], np.diff(self.first)[ids[at]]
        at, begin, n = at[n > 0], begin[n > 0], n[n > 0]
        entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, numbers = np.repeat(at, n), self.numbers[entry]
        order = np.lexsort((at, numbers))
        at, numbers, starts = at[order], numbers[order], (at - self.places[entry])[order]
        last = np.arange(len(at)) + self.needed[numbers] - 1
        first = np.flatnonzero(last < len(at))
        last = last[first]
        close = (numbers[last] == numbers[first]) & (at[last] - at[first] < self.widths[numbers[first]])
        found = {}
        for number in np.unique(numbers[first[close]]).tolist():
            own = slice(*np.searchsorted(numbers, [number, number + 1]))
            hits, candidates = np.unique(at[own]), np.unique(starts[own])
            length, slack = int(self.lengths[number]), self._slack(number)
            inside = np.searchsorted(hits, candidates + length + slack) - np.searchsorted(hits, candidates - slack)
            best = self._verify(number, candidates[inside >= self.needed[number]].tolist(), ids)
            if best:
                found[number] = best
        for number, start, width in self._near(ids):
            if number not in found:
                best = self._verify_near(number, start, width, ids)
                if best:
                    found[number] = best
        return found

    def _near(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items and windows (start, width) of a text that are near each other in the space.

        Cosines are taken where the words around a window can have the least weight that
        ``_verify_near`` asks for: the weights of all of them are summed up by steps of the window. That is done for the items
        only that could have it with all the words that a stretch of the text has at all.
        """
        pad = 3 * max(width for width, *_ in self.scales)
        for low in range(0, len(ids), STRETCH):
            offset = max(0, low - pad)
            part = ids[offset:low + STRETCH + pad]
            at = np.flatnonzero(part >= 0)
            present = np.flatnonzero(np.bincount(part[at], minlength=1))
            for width, numbers, first, columns, whole, least in self.scales:
                entry = _entries(first[present], first[present + 1] - first[present])
                possible = np.bincount(columns[entry], whole[entry], len(numbers)) >= least
                if not possible.any():
                    continue
                numbers, least, k = numbers[possible], least[possible], int(possible.sum())
                step = max(1, width // 4)
                begin, n = first[part[at]], first[part[at] + 1] - first[part[at]]
                entry, place, weight = _entries(begin, n), np.repeat(at // step, n), np.repeat(self.weight[part[at]], n)
                own = possible[columns[entry]]
                column = (np.cumsum(possible) - 1)[columns[entry[own]]]
                steps = -(-len(part) // step)
                weights = np.bincount(place[own] * k + column, weight[own], steps * k)
                sums = np.zeros((steps + 1, k))
                np.cumsum(weights.reshape(steps, k), axis=0, out=sums[1:])
                longest = int(self.lengths[numbers].max())
                around = int(SLACK * longest) + 1 + width // 4
                places = np.arange(steps)
                inside = (sums[np.minimum(places + -(-(max(width, longest) + around) // step), steps)]
                          - sums[np.maximum(places - -(-around // step), 0)])
                for place, number in zip(*(found.tolist() for found in np.nonzero(inside >= least)), strict=True):
                    start = offset + place * step
                    if self._cosine(int(numbers[number]), ids[start:start + width]) >= NEAR_COSINE:
                        yield int(numbers[number]), start, width

    def _verify_near(self, number: int, start: int, width: int, ids: np.ndarray) -> tuple[float, float, bool] | None:
        """As ``_verify``, for a window near the item: each sentence has an order of its own."""
        item = self.benchmark.items[number]
        n, around = len(item.words), self._slack(number) + width // 4
        passage = ids[max(0, start - around):start + max(width, n) + around]
        known = passage[passage >= 0].tolist()
        if len(known) < LEAST_REWORDED * n or not self._weighty(number, known, LEAST_REWORDED):
            return None
        share = sum(common_subsequence(masks, length, known) for masks, length in self.parts[number]) / n
        if share < LEAST_REWORDED:
            return None
        answer = common_subsequence(self.masks[number][1], len(item.answer), known) >= LEAST_ANSWER * len(item.answer)
        if share >= LEAST_REORDERED and self._weighty(number, known, LEAST_REORDERED) or len(item.answer) >= LONG_ANSWER and _holds(passage, item.answer):
            return self._cosine(number, ids[start:start + width]), share, answer
        return None

    def _slack(self, number: int) -> int:
        return int(SLACK * self.lengths[number]) + 1

    def _weighty(self, number: int, passage: list[int], least: float = LEAST_WEIGHT) -> bool:
        """Whether the passage has enough of the item's words by weight."""
        wanted, there = self.counts[number], Counter(passage)
        common = sum(self.weight[word] * min(n, there[word]) for word, n in wanted.items())
        return common >= least * sum(self.weight[word] * n for word, n in wanted.items())

    def _cosine(self, number: int, passage: np.ndarray) -> float:
        """Cosine of an item and a passage in the space; unknown words are its last row."""
        vector = self.space[passage].sum(axis=0)
        return float(vector @ self.vectors[number]) / max(float(np.linalg.norm(vector)), 1e-12)

    def _verify(self, number: int, places: list[int], ids: np.ndarray) -> tuple[float, float, bool] | None:
        item = self.benchmark.items[number]
        n, slack = len(item.words), self._slack(number)
        best = None
        for start in places:
            passage = ids[max(0, start - slack):start + n + slack]
            known = passage[passage >= 0]
            if len(known) < LEAST_WITH_ANSWER * n:
                continue
            cosine = max(self._cosine(number, known), self._cosine(number, ids[max(0, start):start + n]))
            if cosine < LEAST_COSINE:
                continue
            known = known.tolist()
            share = common_subsequence(self.masks[number][0], n, known) / n
            answer = common_subsequence(self.masks[number][1], len(item.answer), known) >= LEAST_ANSWER * len(item.answer)
            if (share >= LEAST or share >= LEAST_WITH_ANSWER and answer) and self._weighty(number, known) and (best is None or (share, cosine) > (best[1], best[0])):
                best = (cosine, share, answer)
        return best


def numbered(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """``doc_id`` and ``ids``, the numbers of all words of each text, written once for all passes over the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        benchmark = shared.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [benchmark.ids(text).astype(benchmark.stored).tobytes() for text in batch["text"]]})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return materialise(texts(docs).mapInPandas(number, f"doc_id {id_type}, ids binary"), "word_numbers")


def _frequencies(stored: DataFrame, benchmark: Benchmark) -> tuple[np.ndarray, int]:
    """In how many documents each word of the benchmark is; the number of documents."""
    size, kind = len(benchmark.vocabulary), benchmark.stored

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for octets in batch["ids"]:
                ids = np.unique(np.frombuffer(octets, dtype=kind))
                total[ids[ids >= 0]] += 1
                total[-1] += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"word": some, "n": total[some]})

    counted = stored.select("ids").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size + 1, dtype=np.int64)
    total[counted["word"]] = counted["n"]
    return total[:-1], int(total[-1])


def _gram_product(docs: DataFrame, benchmark: Benchmark, weight: np.ndarray, basis: np.ndarray, stored: DataFrame | None = None) -> np.ndarray:
    """The product of the weighted passages' Gram matrix with ``basis``, summed over tasks."""
    stored = numbered(docs, benchmark) if stored is None else stored
    shared, kind = stored.sparkSession.sparkContext.broadcast((weight, basis)), benchmark.stored

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, basis = shared.value
        total = np.zeros(basis.shape)
        size = len(basis)
        weighted = weight[:, None] * basis
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                found = [np.frombuffer(octets, dtype=kind) for octets in batch["ids"].iloc[first:first + TEXTS]]
                new = np.concatenate([np.arange(len(ids)) % PASSAGE == 0 for ids in found])
                passages, ids = np.cumsum(new) - 1, np.concatenate(found).astype(np.int64)
                known = ids >= 0
                pair, times = np.unique(passages[known] * size + ids[known], return_counts=True)
                if not len(pair):
                    continue
                passage, word = pair // size, pair % size
                starts = np.flatnonzero(np.diff(passage, prepend=-1))
                for low in range(0, len(starts), PASSAGES):
                    cut = starts[low:low + PASSAGES]
                    part = slice(cut[0], starts[low + PASSAGES] if low + PASSAGES < len(starts) else len(pair))
                    projected = np.add.reduceat(_times(weighted[word[part]], times[part]), cut - cut[0], axis=0)
                    order = np.argsort(word[part], kind="stable")
                    of_passage = np.repeat(np.arange(len(cut)), np.diff([*cut, part.stop]))[order]
                    back = _times(projected[of_passage], times[part][order])
                    by_word = word[part][order]
                    heads = np.flatnonzero(np.diff(by_word, prepend=-1))
                    total[by_word[heads]] += weight[by_word[heads], None] * np.add.reduceat(back, heads, axis=0)
        some = np.flatnonzero(total.any(axis=1))
        if len(some):
            yield pd.DataFrame({"word": some, "row": total[some].tolist()})

    summed = (stored.select("ids").mapInPandas(multiply, "word long, row array<double>")
              .select("word", F.posexplode("row").alias("i", "x")).groupBy("word", "i").agg(F.sum("x").alias("x")).toPandas())
    out = np.zeros(basis.shape)
    out[summed["word"], summed["i"]] = summed["x"]
    return out


def _times(rows: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each row as often as its word is there; most are there once."""
    more = np.flatnonzero(times > 1)
    rows[more] *= times[more, None]
    return rows


def _fit(docs: DataFrame, benchmark: Benchmark, stored: DataFrame | None = None) -> Detector:
    """Weights, the space of the leading right singular vectors, and the detector made of them."""
    stored = numbered(docs, benchmark) if stored is None else stored
    frequency, n = _frequencies(stored, benchmark)
    weight = np.log((n + 1) / (frequency + 1)) + 1e-3
    rng = np.random.default_rng(42)
    size = len(weight)
    basis = np.linalg.qr(rng.standard_normal((size, min(RANK + OVERSAMPLED, size))))[0]
    product = _gram_product(docs, benchmark, weight, basis, stored)
    left, _, _ = np.linalg.svd(product + 1e-9 * basis, full_matrices=False)
    space = np.zeros((size + 1, min(RANK, left.shape[1])), dtype=np.float32)
    space[:-1] = weight[:, None] * left[:, :space.shape[1]]
    return Detector(benchmark, space, frequency, weight)


def detectors(docs: DataFrame, items: DataFrame) -> Iterator[tuple[Detector, DataFrame]]:
    """One detector for each block of items, of ``BLOCK`` items each as expected size, and the documents in numbers of its words."""
    items = items.select("item_id", "text")
    blocks = -(-items.count() // BLOCK)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        benchmark = Benchmark.of(rows)
        if benchmark.items:
            stored = numbered(docs, benchmark)
            yield _fit(docs, benchmark, stored), stored


_FOUND = "cosine double, share double, answer_found boolean"


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``cosine``, ``share``, ``answer_found`` of every item in every document row."""
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
              f"item_id {items.schema['item_id'].dataType.simpleString()}, {_FOUND}")
    found = docs.sparkSession.createDataFrame([], schema)
    for detector, stored in detectors(docs, items):
        shared = docs.sparkSession.sparkContext.broadcast(detector)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known, kind = shared.value.benchmark.items, shared.value.benchmark.stored
            for batch in batches:
                yield pd.DataFrame(
                    [(doc_id, known[number].item_id, *hit) for doc_id, octets in zip(batch["doc_id"], batch["ids"], strict=True)
                     for number, hit in shared.value.find_ids(np.frombuffer(octets, dtype=kind).astype(np.int64)).items()],
                    columns=["doc_id", "item_id", "cosine", "share", "answer_found"])

        found = found.union(stored.mapInPandas(search, schema))
    return found


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Drop the documents that hold an item. All columns stay as they are."""
    text = docs.columns.index("text")
    for detector, _ in detectors(docs, items):
        shared = docs.sparkSession.sparkContext.broadcast(detector)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.find(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
