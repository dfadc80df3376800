"""Words and the input columns that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of ``text`` with A-Z lower-cased, as UTF-8.

    A null or blank text has none. ``bytes.lower`` and ``bytes.split`` know ASCII
    only, which is the rule.
    """
    return [] if text is None else text.encode().lower().split()


def id_remainder(column: str, divisor: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % divisor


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, whatever else the table has."""
    return docs.select("doc_id", "text", *more)
