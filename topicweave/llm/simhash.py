"""Near-duplicate documents by SimHash.

A fingerprint has 64 bits. Cut into 16 segments of 4 bits, its numbers of set bits
by segment are a point in a grid, and the Manhattan distance of two points is at most
the Hamming distance of the fingerprints. Fingerprints within 2 bits are found by a
range join over the grid: every point goes to its own cell and the cells next to it,
points within distance 2 meet in a cell, and the bits are compared there.

Cells in which many different fingerprints meet are not joined. Their fingerprints
go to every value that is 1 bit away from them: fingerprints that meet there are
within 2 bits of each other, and any two within 2 bits meet, so one link to the
smallest of each meeting loses no connection.

* Texts are compared by whole word shingles, repeats included. A text of fewer words
  than a shingle is one shingle; null texts and texts without words have fingerprint
  zero and are linked like any other.
* Repeated rows and equal texts have equal fingerprints and so the same component.
* Rows with a null id get a fingerprint and the component of their fingerprint.
* A bit that half of the shingles have is 0. Very long texts are counted block by block. An empty table gives no rows.
* Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.components import components
from topicweave.llm.shingle_join import later_copies, text_class
from topicweave.llm.words import texts, words
from topicweave.plans.tables import materialise, released_shuffles, scratch

SHINGLE = 3
SEED = 42
#: Fingerprints in a cell up to which they are compared pair by pair.
CROWD = 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
_SEGMENTS = range(0, 64, 4)
_ONES = 0x1111111111111111


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: the bits set in more than half of the shingle hashes."""
    found = words(text)
    if not found:
        return 0
    if len(found) < shingle:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
        n = len(found) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=n)
    octets = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    ones = sum(np.unpackbits(octets[i:i + BLOCK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, BLOCK))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed long, of every row."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(text, shingle) for text in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "bits": bits.astype(np.int64)})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInPandas(of_batches, f"doc_id {ids}, bits long")


def _grid(bits: DataFrame) -> DataFrame:
    """Every fingerprint once for its own cell and once for each cell next to it.

    A cell is a long with the number of set bits of each segment in 4 bits.
    """
    counts = [F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(_ONES)) for i in range(4)]
    placed = bits.select("bits", (counts[0] + counts[1] + counts[2] + counts[3]).alias("own"))
    cells = [F.col("own")]
    for low in _SEGMENTS:
        count = F.shiftright("own", low).bitwiseAND(F.lit(15))
        step = F.lit(1 << low).cast("long")
        cells += [F.when(count < 4, F.col("own") + step), F.when(count > 0, F.col("own") - step)]
    return placed.select("bits", F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL")


def fingerprint_links(bits: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct fingerprints ``bits`` within 2 bits."""
    grid = _grid(bits)
    busy = grid.groupBy("cell").agg(F.count("*").alias("crowd")).where("crowd > 1")
    near = materialise(grid.join(materialise(busy, "busy_cells"), "cell"), "near")
    few = near.where(F.col("crowd") <= CROWD)
    left, right = few.select("cell", F.col("bits").alias("a")), few.select("cell", F.col("bits").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, "cell").where((F.col("a") < F.col("b")) & (apart <= 2)).select("a", "b").distinct()
    around = (near.where(F.col("crowd") > CROWD).select("bits").distinct()
              .select("bits", F.explode(F.expr(
                  "concat(array(bits), transform(sequence(0, 63), i -> bits ^ shiftleft(1L, i)))")).alias("mid")))
    meeting = materialise(around.groupBy("mid").agg(F.min("bits").alias("least"), F.count("*").alias("n"))
                          .where("n > 1"), "meetings")
    stars = around.join(meeting, "mid").where("bits != least").select("bits", "least").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``bits`` and ``component_id``, the smallest id reachable, of every row."""
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    roots = components(fingerprint_links(distinct.select("bits")))
    rooted = distinct.join(roots.withColumnRenamed("v", "bits"), "bits", "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root"))
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least_ids")
    named = materialise(rooted.join(least, "root").select("bits", "component_id"), "components")
    return marked.join(named, "bits").select("doc_id", "bits", "component_id")


def label_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` in 16 hex digits and ``component_id`` of every document."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def likely_copies(docs: DataFrame) -> DataFrame:
    """Pairs ``x``, ``y`` of text classes (``shingle_join``) with linked fingerprints, each text with the smallest one of its fingerprint."""
    named = docs.select(text_class().alias("doc_id"), "text")
    marked = materialise(fingerprints(named).withColumnRenamed("doc_id", "class").distinct(), "text_fingerprints")
    least = materialise(marked.groupBy("bits").agg(F.min("class").alias("least")), "distinct_fingerprints")
    same = marked.join(least, "bits").where("class != least").select("class", "least")
    a, b = (least.select(F.col("bits").alias(side), F.col("least").alias(f"{side}_class")) for side in ("a", "b"))
    near = fingerprint_links(least.select("bits")).join(a, "a").join(b, "b").select("a_class", "b_class")
    both = same.toDF("p", "q").unionByName(near.toDF("p", "q"))
    return both.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct()


def keep_first(docs: DataFrame, linked: bool = False) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. All columns stay.

    Near copies have a Jaccard similarity of 0.8 or more. The pairs come from the fingerprints first and are verified exactly;
    since copies of that similarity can differ in any number of bits, the exact join of ``shingle_join`` adds those that the
    fingerprints do not connect. With ``linked``, documents whose fingerprints are linked, as ``near_duplicates`` links them, are near
    copies whatever their similarity, and a group is what either rule connects. Of repeated rows with one id all stay or go
    together, and rows with a null id stay.
    """
    with scratch(docs.sparkSession) as keep, released_shuffles(docs.sparkSession):
        with scratch(docs.sparkSession) as keep_likely:
            pairs = keep_likely(likely_copies(docs), "likely_copies")
        gone = later_copies(docs, None, pairs) if linked else later_copies(docs, pairs)
        return docs.join(keep(gone, "near_copies"), "doc_id", "left_anti")
