"""Sets of positions as bitmaps: rows of 64 words, one for each run of 4096 positions.

A set is as many rows as it has buckets with a position in them, so a large set is spread over tasks, and two sets are
compared bucket by bucket inside a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
WORDS = 64
BUCKET = WORD * WORDS


def bitmaps(rows: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    """``key``, ``bucket`` and ``words`` of the positions of each key; repeated positions count once.

    Positions of one word are combined before the shuffle, those of a bucket behind it.
    """
    place = f"`{position}`"
    by_word = (rows.where(F.col(position).isNotNull()).groupBy(
        *key, F.expr(f"{place} div {BUCKET}").alias("bucket"), F.expr(f"cast({place} % {BUCKET} div {WORD} as int)").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast({place} % {WORD} as int)))").alias("bits")))
    of_bucket = by_word.groupBy(*key, "bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by_word"))
    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)),
                        lambda w: F.coalesce(F.try_element_at("by_word", w), F.lit(0).cast("long")))
    return of_bucket.select(*key, "bucket", words.alias("words"))


def both(x: Column, y: Column) -> Column:
    """Words of the positions that are in both sets."""
    return F.zip_with(x, y, lambda a, b: a.bitwiseAND(b))


def either_only(x: Column, y: Column) -> Column:
    """Words of the positions that are in one of the sets only."""
    return F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))


def ones(words: Column) -> Column:
    """Number of positions."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, word: n + F.bit_count(word))


def positions(bucket: Column, words: Column) -> Column:
    """The positions of a row as an array of longs."""
    set_bits = F.transform(words, lambda word, i: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda bit: F.call_function("getbit", word, bit) == 1),
        lambda bit: bucket * BUCKET + i * WORD + bit))
    return F.flatten(set_bits)


def bytes_of(words: Column) -> Column:
    """The 0/1 digits of words, lowest position first, as an array of bytes."""
    return F.flatten(F.transform(words, lambda word: F.transform(
        F.sequence(F.lit(0), F.lit(WORD - 1)), lambda bit: F.call_function("getbit", word, bit))))


def digits(words: Column) -> Column:
    """The 0/1 digits of a row, lowest position first, as a string of 4096."""
    return F.array_join(F.transform(words, lambda word: F.reverse(F.lpad(F.bin(word), WORD, "0"))), "")
