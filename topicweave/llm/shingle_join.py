"""Near copies of whole documents by an exact set-similarity join over word shingles.

Two documents are near copies when the Jaccard similarity of their sets of five-word
shingles is 0.8 or more.

1. Documents with equal texts are a class, with the smallest of their ids.
2. The shingles of a class are ordered from rare to frequent. Sets that are similar enough share
   one of their first fifth (prefix filter); classes that meet there have to have close
   sizes (length filter) and room for enough common shingles (positional filter).
3. Where more than ``CROWD`` classes share a shingle, as copies of one text do, all are first
   compared with a few of them. Two classes that are connected by then need no comparison: what
   is left are classes outside the largest component of the shingle, with all of its classes.
4. Pairs are dropped whose parity sketches (one bit for each slot, with at least as many slots as shingles: whether an odd number
   of them falls into it) differ in more bits than the sets of similar texts differ in elements, which loses no pair. Jaccard is
   verified on the whole sets of what is left. While these pairs hold more text than the classes do, only two pairs of each
   class go first, with its smallest and its closest partner: what these connect needs no comparison any more. Whole sets are
   made where two texts meet; what travels and is written are packed texts.

A caller may name pairs that are likely to be similar, found by a faster method, which are verified first, and pairs that belong
together by another rule, which are links as they stand. Classes that are connected by them need no comparison behind it.

Any order of the shingles is right, a good one is fast: every task reports the slots of a table
of fixed size that it fills far more often than others. Before a join, rows are dropped whose shingle or text has no
mark in a table of bits: most shingles are in one class only, and most texts in no pair. A table has eight bits for each mark up to
a fixed size, since it passes through the driver into every task that reads it; a full one drops less and loses nothing. Written
tables go as soon as they have been read.

* A text of fewer words than a shingle is one shingle. Null texts and texts without words
  are equal to each other.
* Texts are named, and shingles told apart, by 64-bit hashes.
* Repeated rows have one id, so none of them is a later copy of another; a row with a null id is never one, and is the
  first of its text only if all ids are null. A similarity of exactly 0.8 links.
* Very long texts are compared whole. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions import bits as B
from topicweave.llm.components import components
from topicweave.llm.words import words
from topicweave.plans.tables import materialise, scratch

SHINGLE = 5
SEED = 42
#: Slots of the counts of shingles.
SLOTS = 1 << 20
#: Fewest and most bits of a sketch.
SKETCH = 512
LONGEST_SKETCH = 1 << 16
#: Most bits of a table of marks: 2 MB.
BITS = 1 << 24
#: Classes that share a shingle up to which they are compared pair by pair.
CROWD = 32
#: Classes that all classes of a larger group are compared with first.
HUBS = 4
#: Times the text of the classes that pairs compared at once may hold.
TEXTS = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles of a text, in order."""
    found = words(text)
    if not found:
        return np.zeros(1, dtype=np.uint64)
    width = min(SHINGLE, len(found))
    n = len(found) - width + 1
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    shingles = np.full(n, SEED + width, dtype=np.uint64)
    for i in range(width):
        shingles = (shingles ^ hashed[i:i + n]) * _MIX
        shingles ^= shingles >> np.uint64(32)
    return np.unique(shingles)


def sketch_size(n: int) -> int:
    """Bits of the sketch of a set of ``n`` elements, a power of two."""
    return min(LONGEST_SKETCH, max(SKETCH, 1 << (n - 1).bit_length()))


def sketch(found: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Parity of the number of hashes in each slot, as longs: two sketches differ in no more bits than their sets in elements.

    A sketch of half the size is its halves taken together by exclusive or.
    """
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(words: Column, size: Column) -> Column:
    """Sketches of similar texts differ in size by a factor of two at most; the larger one is folded once."""
    half = B.either_only(F.slice(words, F.lit(1), size), F.slice(words, size + 1, size))
    return F.when(F.size(words) > size, half).otherwise(words)


def text_class() -> Column:
    """The class of a text: its hash."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _table_size(marks: int) -> int:
    """Bits of a table of marks, a power of two."""
    return min(BITS, max(1 << 13, 1 << (8 * marks - 1).bit_length()))


def _marked(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` may be one of those in ``of``, a written table: its bit is set in a table of up to ``BITS`` bits."""
    size = _table_size(of.count())
    slot = F.pmod(F.xxhash64(name), F.lit(size))
    word, bit = F.floor(slot / 64), (slot % 64).cast("int")
    taken = of.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    every = of.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = materialise(taken.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits")), "mark_words")
    marks = materialise(words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("s")).select(F.col("s.bits").alias("marks")), "marks")
    return rows.where(F.call_function("getbit", F.get(marks.scalar(), word.cast("int")), bit) == 1)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _levels(docs: DataFrame) -> np.ndarray:
    """A level of frequency for each slot; 0 for those that no task finds frequent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(total, _slots(shingle_set(text)), 1)
        mean = total.mean()
        often = np.flatnonzero(total > mean + 8 * mean**0.5 + 8)
        yield pd.DataFrame({"slot": often, "n": total[often]})

    counted = docs.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    levels = np.zeros(SLOTS, dtype=np.uint8)
    levels[counted["slot"].to_numpy(dtype=np.int64)] = (4 * np.log2(counted["n"].to_numpy(dtype=np.float64) + 1)).astype(np.uint8)
    return levels


def classes(docs: DataFrame) -> DataFrame:
    """``class``, ``first`` (smallest id), ``n`` (its shingles), ``prefix`` and ``sketch`` of each distinct text."""
    shared = docs.sparkSession.sparkContext.broadcast(_levels(docs))

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, prefixes, sketches = [], [], []
            for text in batch["text"]:
                found = shingle_set(text)
                n = len(found)
                ordered = found[np.argsort(shared.value[_slots(found)], kind="stable")]
                sizes.append(n)
                sketches.append(sketch(found, sketch_size(n)))
                prefixes.append(ordered[:n - (4 * n + 4) // 5 + 1].astype(np.int64))
            yield pd.DataFrame({"class": batch["class"], "doc_id": batch["doc_id"], "n": sizes, "prefix": prefixes, "sketch": sketches})

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(text_class().alias("class"), "doc_id", "text").mapInPandas(shown, f"class long, doc_id {ids}, n int, prefix array<long>, sketch array<long>")
    return materialise(rows.groupBy("class").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
                                                F.first("sketch").alias("sketch")), "text_classes")


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of classes that meet at a shingle and pass the length and positional filters."""
    na, nb = F.col("a.n"), F.col("b.n")
    room = F.least(na - F.col("a.at"), nb - F.col("b.at"))
    return (left.alias("a").join(right.alias("b"), "word")
            .where((F.col("a.class") != F.col("b.class")) & (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & (9 * room >= 4 * (na + nb))))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.class", "b.class").alias("x"), F.greatest("a.class", "b.class").alias("y")).distinct()


def _close(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose sketches differ in no more bits than the sets of similar texts in elements: a ninth of both sizes.

    With ``n``, the elements of ``x``, and ``apart``, the bits.
    """
    x, y = (found.select(F.col("class").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")) for side in ("x", "y"))
    size = F.least(F.size("x_sketch"), F.size("y_sketch"))
    apart = B.ones(B.either_only(_folded(F.col("x_sketch"), size), _folded(F.col("y_sketch"), size)))
    both = pairs.join(x, "x").join(y, "y").withColumn("apart", apart)
    return both.where(9 * F.col("apart") <= F.col("x_n") + F.col("y_n")).select("x", "y", F.col("x_n").alias("n"), "apart")


def _packed_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``class`` and ``packed``, its text, of the classes in ``places``, a written table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress((text or "").encode(), 1) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], ["class", "doc_id", "packed"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    texts = _marked(docs.select(text_class().alias("class"), "doc_id", "text"), places, "class")
    packed = texts.mapInArrow(pack, f"class long, doc_id {ids}, packed binary")
    # one row a class, where the join has put it
    rows = packed.join(places, "class").where(F.col("first").eqNullSafe(F.col("doc_id"))).dropDuplicates(["class"])
    return materialise(rows.select("class", "packed"), "packed_texts")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of the pairs whose whole sets are similar enough."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, None
        for batch in batches:
            similar = []
            for y, x_packed, y_packed in zip(batch["y"], batch["x_packed"], batch["y_packed"], strict=True):
                if y != last:  # pairs of one text stand together
                    last, known = y, shingle_set(zlib.decompress(y_packed).decode())
                found = shingle_set(zlib.decompress(x_packed).decode())
                common = len(np.intersect1d(found, known, assume_unique=True))
                similar.append(9 * common >= 4 * (len(found) + len(known)))
            yield batch.loc[similar, ["x", "y"]].rename(columns={"x": "a", "y": "b"})

    x, y = (texts.select(F.col("class").alias(side), F.col("packed").alias(f"{side}_packed")) for side in ("x", "y"))
    both = pairs.select("x", "y").join(x, "x").join(y, "y")
    return both.select("x", "y", "x_packed", "y_packed").mapInPandas(judge, "a long, b long")


def _picked(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each class that with its smallest and that with its closest partner."""
    ends = pairs.select(F.col("x").alias("v"), F.col("y").alias("w"), "apart").union(pairs.select("y", "x", "apart"))
    best = ends.groupBy("v").agg(F.min("w").alias("least"), F.min_by("w", F.struct("apart", "w")).alias("near"))
    chosen = best.select("v", F.explode(F.array("least", "near")).alias("w"))
    return chosen.select(F.least("v", "w").alias("x"), F.greatest("v", "w").alias("y")).distinct()


def _verified(docs: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect the classes as the pairs whose whole sets are similar enough do."""
    with scratch(docs.sparkSession) as keep:
        left = materialise(_close(pairs, found), "text_pairs")
        wanted = materialise(left.select(F.explode(F.array("x", "y")).alias("class")).distinct(), "paired_texts")
        places = materialise(found.select("class", "first", "n").join(wanted, "class", "left_semi"), "text_places")
        texts = _packed_texts(docs, places.select("class", "first"))
        most = TEXTS * (places.agg(F.sum("n")).first()[0] or 0)
        links = []
        while (left.agg(F.sum("n")).first()[0] or 0) > most:
            picked = materialise(_picked(left), "picked_pairs")
            links.append(materialise(_similar(picked, texts), "similar_texts"))
            roots = components(_all(links))
            left = materialise(_apart(left.join(picked, ["x", "y"], "left_anti"), roots), "text_pairs")
        return keep(_all([*links, _similar(left, texts)]), "text_links")


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, links)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not connected yet."""
    x, y = (roots.select(F.col("v").alias(side), F.col("root").alias(f"{side}_root")) for side in ("x", "y"))
    rooted = pairs.join(x, "x", "left").join(y, "y", "left")
    return rooted.where(F.coalesce("x_root", "x") != F.coalesce("y_root", "y")).select(*pairs.columns)


def links(docs: DataFrame, found: DataFrame, likely: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """Links ``a``, ``b`` that connect the classes ``found`` of similarity 0.8 or more.

    ``likely`` are pairs ``x``, ``y`` of classes to be verified first, ``linked`` pairs to be linked whatever their similarity.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        known = None if likely is None else _verified(docs, found, likely)
        if linked is not None:
            as_links = linked.select(F.col("x").alias("a"), F.col("y").alias("b"))
            known = as_links if known is None else known.union(as_links)
        known_roots = None if known is None else components(known)
        with scratch(spark) as near_only:
            entries = found.select("class", "n", F.posexplode("prefix").alias("at", "word"))
            busy = materialise(entries.groupBy("word").agg(F.count("*").alias("crowd")).where("crowd > 1"), "busy_shingles")
            near = near_only(_marked(entries, busy, "word").join(busy, "word"), "near_texts")
        few = near.where(F.col("crowd") <= CROWD).select("word", "class", "n", "at")
        many = near.where(F.col("crowd") > CROWD).select("word", "class", "n", "at")
        hubs = materialise(many.groupBy("word").agg(*(F.min_by("class", F.xxhash64("class", F.lit(i))).alias(f"hub_{i}") for i in range(HUBS))), "hubs")
        hub = many.join(hubs, "word").where(F.col("class").isin(*(F.col(f"hub_{i}") for i in range(HUBS)))).select("word", "class", "n", "at")
        met = _pairs(_paired(few, few).where("a.class < b.class")).union(_pairs(_paired(hub, many))).distinct()
        first = _verified(docs, found, met if known is None else _apart(met, known_roots))
        first = first if known is None else known.union(first)
        roots = components(first)
        rooted = materialise(many.join(roots.withColumnRenamed("v", "class"), "class", "left")
                             .withColumn("root", F.coalesce("root", "class")), "crowded_texts")
        parts = materialise(rooted.groupBy("word", "root").agg(F.count("*").alias("size")), "crowded_parts")
        largest = materialise(parts.groupBy("word").agg(F.max_by("root", "size").alias("largest"), F.count("*").alias("parts"))
                              .where("parts > 1").drop("parts"), "largest_parts")
        split = rooted.join(largest, "word")
        outside = materialise(split.where("root != largest").drop("largest"), "outside_texts")
        rest = _paired(outside, split.drop("largest")).where("a.root != b.root")
        return keep(first.union(_verified(docs, found, _pairs(rest))), "text_links")


def later_copies(docs: DataFrame, likely: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """``doc_id`` of the documents that are connected with one of a smaller id. For ``likely`` and ``linked`` see ``links``."""
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        found = classes(docs)
        roots = components(links(docs, found, likely, linked)).withColumnRenamed("v", "class")
        rooted = materialise(found.select("class", "first").join(roots, "class", "left")
                             .select("class", "first", F.coalesce("root", "class").alias("root")), "rooted_texts")
        least = materialise(rooted.groupBy("root").agg(F.min("first").alias("least")), "least_ids")
        named = materialise(rooted.join(least, "root").select("class", "least"), "text_components")
        gone = docs.select("doc_id", text_class().alias("class")).join(named, "class").where("doc_id != least")
        return keep(gone.select("doc_id").distinct(), "near_copies")
