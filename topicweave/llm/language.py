"""Language identification.

The script of a word narrows the languages it can be in, hashed character n-grams
score it in each of those, and Viterbi over the words, with a penalty for every
switch, labels the spans of a text. The language with the most letters in its spans
is the language of the text, their share of all letters is the score.

* Null texts and texts without a letter are ``und`` with score 0 and no span.
* Words without letters fit every language and belong to the span around them.
* With no labelled row at all nothing is learned and every text is ``und``.
* Repeated rows are labelled one by one; ties go to the language first in the alphabet.
* Very long texts are labelled whole. An empty table gives no rows. Other columns are not read, whatever their names;
  the stage that drops documents hands them on as they are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from topicweave.llm.words import id_remainder

#: Labelled rows that a model is fitted on, as expected value of a sample of all of them.
TRAINING_ROWS = 50_000
#: Slots that n-grams are hashed to; bounds the model by languages x slots.
SLOTS = 1 << 15
#: Log-probability that a switch of language costs.
SWITCH = 20.0
#: One word is never worse by more than this in any language.
WORST = 8.0
#: A language is a candidate for the scripts that have this share of its letters.
SCRIPT_SHARE = 0.01
#: Words that a task remembers the scores of.
REMEMBERED = 300_000
#: Characters of the texts whose words are learned together.
TOGETHER = 4_000_000

# First code points of script ranges (Unicode blocks), and the script there.
SCRIPT_RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])
_WORD = re.compile(r"\S+")

SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                              StructField("lang", StringType())]))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Slots of 64-bit values."""
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (values >> np.uint64(49)).astype(np.int64)


@dataclass
class Grams:
    """Letters of some words, and the slots of their n-grams.

    ``letters``, ``script`` (of the first letter, -1 without one) have an entry for
    each word, ``word`` and ``slot`` one for each 2-gram, 3-gram (the edges of the
    words included) and whole word.
    """

    letters: np.ndarray
    script: np.ndarray
    word: np.ndarray
    slot: np.ndarray


def grams_of(found: list[str]) -> Grams:
    joined = "\n".join(["", *found, ""]).lower()
    joined = joined.translate({ord(c): None for c in set(joined) if c != "\n" and not c.isalpha()})
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    edge = points == 10
    owner = np.cumsum(edge) - 1
    edges = np.flatnonzero(edge)
    letters = np.diff(edges) - 1
    first = points[edges[:-1] + 1]
    script = np.where(letters > 0, _SCRIPT_OF_RANGE[np.maximum(np.searchsorted(_STARTS, first, side="right") - 1, 0)], -1)
    wide = points.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] + wide[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(3)
        place = (np.arange(len(points)) - edges[owner]).astype(np.uint64)
        marked = (wide + np.uint64(7)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x27D4EB2F165667C5))
        whole = np.add.reduceat(marked ^ (marked >> np.uint64(31)), edges[:-1]) if len(found) else wide[:0]
        inner = ~edge[1:-1]
        slot = np.concatenate([_mixed(two), _mixed(three[inner]), _mixed(whole)])
    word = np.concatenate([owner[:-1], owner[:-2][inner], np.arange(len(found))])
    some = (letters > 0)[np.minimum(word, max(len(found) - 1, 0))] if len(found) else np.zeros(len(word), dtype=bool)
    return Grams(letters, script, word[some], slot[some])


@dataclass
class LanguageModel:
    """Languages, log-probabilities by slot and language, and candidates by script and language."""

    languages: list[str]
    slots: np.ndarray
    candidates: np.ndarray


def train(docs: DataFrame, label: str, eligible: Column, rows: int = TRAINING_ROWS) -> LanguageModel:
    """Fit a model on the ``eligible`` rows of ``docs`` that have a text and a label.

    When there are more than ``rows`` of them, a sample by the hash of the id with
    that expected size is used. The driver receives counts by language and slot.
    """
    labelled = docs.where(eligible & F.col(label).isNotNull() & F.col("text").isNotNull())
    total = labelled.count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(rows / total * (1 << 32)))
    counts = (labelled.select("text", F.col(label).cast("string").alias("lang"))
              .mapInPandas(_count_slots, "lang string, slot int, n long")
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts.lang.unique())
    table = np.zeros((SLOTS + len(SCRIPTS), len(languages)))
    table[counts.slot, counts.lang.map({lang: i for i, lang in enumerate(languages)})] = counts.n
    grams, letters = table[:SLOTS], table[SLOTS:]
    return LanguageModel(
        languages, np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * SLOTS)).astype(np.float32),
        letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def _count_slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    seen: defaultdict[str, Counter] = defaultdict(Counter)

    def flush() -> None:
        for lang, found in seen.items():
            grams, n = grams_of(list(found)), np.fromiter(found.values(), dtype=np.int64)
            table = counts.setdefault(lang, np.zeros(SLOTS + len(SCRIPTS), dtype=np.int64))
            table[:SLOTS] += np.bincount(grams.slot, n[grams.word], SLOTS).astype(np.int64)
            some = grams.script >= 0
            table[SLOTS:] += np.bincount(grams.script[some], (n * grams.letters)[some], len(SCRIPTS)).astype(np.int64)
        seen.clear()

    for batch in batches:
        for text, lang in zip(batch.text, batch.lang):
            seen[lang].update(text.split())
            if sum(map(len, seen.values())) > REMEMBERED:
                flush()
    flush()
    for lang, table in counts.items():
        slot = np.flatnonzero(table)
        yield pd.DataFrame({"lang": lang, "slot": slot.astype(np.int32), "n": table[slot]})


@dataclass
class Labeller:
    """Labels texts with a model; one for each task. ``rows`` holds words whose scores are known."""

    model: LanguageModel
    rows: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None

    def _learn(self, found: list[str]) -> None:
        """Score the words that are new."""
        if self.scores is None or len(self.rows) > REMEMBERED:
            self.rows = {}
            self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)
            self.letters = np.zeros(0, dtype=np.int64)
        new = [word for word in dict.fromkeys(found) if word not in self.rows]
        if not new:
            return
        grams = grams_of(new)
        score = np.stack([np.bincount(grams.word, of_language[grams.slot], len(new)) for of_language in self.model.slots.T], axis=1)
        able = self.model.candidates[grams.script]
        score = np.where(able | ~able.any(axis=1, keepdims=True), score, -np.inf)
        score = np.maximum(score - score.max(axis=1, keepdims=True), -WORST)
        score[grams.letters == 0] = 0
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, score.astype(np.float32)])
        self.letters = np.concatenate([self.letters, grams.letters])

    def label_all(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans of each text; words are learned some texts at a time."""
        for some in _by_size(texts):
            found = [text.split() if text and self.model.languages else [] for text in some]
            self._learn([word for of_text in found for word in of_text])
            yield from map(self._label, some, found)

    def _label(self, text: str | None, found: list[str]) -> tuple[str, float, list[tuple[int, int, str]]]:
        languages = self.model.languages
        rows = [self.rows[word] for word in found]
        letters = self.letters[rows] if rows else np.zeros(0, dtype=np.int64)
        total = int(letters.sum())
        if not total:
            return "und", 0.0, []
        path = best_path(self.scores[rows].astype(np.float64), SWITCH)
        share = np.bincount(path, weights=letters, minlength=len(languages))
        best = int(share.argmax())
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
        if len(edges) == 1:
            spans = [(0, len(text), languages[best])]
        else:
            starts = [m.start() for m in _WORD.finditer(text)]
            cuts = [0, *(starts[i] for i in edges[1:]), len(text)]
            spans = [(a, b, languages[path[i]]) for a, b, i in zip(cuts, cuts[1:], edges, strict=False)]
        return languages[best], float(share[best] / total), spans


def _by_size(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``TOGETHER`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The path of states with the highest sum of scores less ``switch`` for each change.

    The state that is best for all words together is the whole path when (1) no
    stretch of words gains more than a switch in another state and (2) no beginning
    and end together do. A path that also uses it needs a switch at least for each
    run elsewhere, so (1) suffices; one of j runs elsewhere needs j - 1, and (2) covers
    its two outer runs.
    """
    total = scores.sum(axis=0)
    lead = int(total.argmax())
    gained = np.cumsum(scores - scores[:, lead:lead + 1], axis=0)
    lowest = np.minimum(np.minimum.accumulate(gained, axis=0), 0)
    if (gained - lowest).max() <= switch and max(gained.max(), 0) + (gained[-1] - lowest[-1]).max() <= switch:
        return np.full(len(scores), lead)
    n, states = scores.shape
    came = np.empty((n, states), dtype=np.int16)
    same = np.arange(states)
    value = scores[0].copy()
    for t in range(1, n):
        top = int(value.argmax())
        jump = value[top] - switch
        stay = value >= jump
        came[t] = np.where(stay, same, top)
        value = np.where(stay, value, jump) + scores[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = value.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def identify(docs: DataFrame, model: LanguageModel, *carried: str) -> DataFrame:
    """Label every text: ``carried`` columns, ``lang_pred``, ``score`` and ``spans``.

    Spans are ranges of character positions. Only ``text`` is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            langs, scores, runs = zip(*labeller.label_all(batch.column(0).to_pylist()), strict=True) if len(batch) else ([],) * 3
            found = [[{"start": a, "end": b, "lang": lang} for a, b, lang in of_text] for of_text in runs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(found, spans)],
                [*batch.schema.names[1:], "lang_pred", "score", "spans"])

    kept = docs.select("text", *carried)
    schema = StructType([*kept.schema.fields[1:], StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), StructField("spans", SPANS)])
    return kept.mapInArrow(label, schema)


def _held_out() -> Column:
    return F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(True))


def predict_documents(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones.

    Rows with a null id are predicted and count as held out.
    """
    model = train(docs.select("doc_id", "text", "lang"), "lang", ~_held_out())
    return (identify(docs, model, "doc_id")
            .select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Drop the documents without a language: no letters, or none that has ``least`` of the letters.

    All columns are kept as they are.
    """
    model = train(docs.select("doc_id", "text", "lang"), "lang", ~_held_out())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            labelled = labeller.label_all(batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _ in labelled], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
