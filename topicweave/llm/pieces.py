"""Documents as pieces of tokens that fit into a sequence."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from topicweave.llm.tokens import encode, vocabulary
from topicweave.llm.words import texts

CAPACITY = 1024
END = 2


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` tokens: all full but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, paths: tuple[str, str] | None = None,
           keep_ids: bool = False) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and perhaps ``ids``.

    A null or empty text is the end token alone. ``ids`` are little-endian unsigned
    32-bit numbers. Repeated rows give repeated pieces.
    """
    paths = paths or vocabulary()

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text, paths, end)
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    octets = ids[start:start + length].tobytes()
                    rows.append((doc_id, i, start, length, zlib.crc32(octets), *[octets] * keep_ids))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
            yield pd.DataFrame(rows, columns=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids binary" if keep_ids else ""
    return texts(docs).mapInPandas(tokenise, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")
