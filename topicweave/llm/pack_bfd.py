"""Packed token matrices by best-fit decreasing.

Texts are encoded and cut into pieces that fit a row; only texts longer than a row are
cut, and no token is lost. Pieces are packed in shards of bounded size inside the
task that encoded them, so no text is shuffled. A shard is packed from the longest piece to the
shortest; a segment tree over the room that is left finds the fullest row that still
takes a piece. Every row of the matrix has its ids, padded to the width, the cumulative
lengths of its pieces and the position of each token in its piece.

* A null or empty text is the end token alone. Repeated rows are packed like others.
* Ties in length go by the order of the input, ties in room to the row that got that room first.
* An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.pieces import END, cut
from topicweave.llm.tokens import encode, vocabulary
from topicweave.llm.words import texts
from topicweave.plans.tables import new_path

WIDTH = 2048
PAD = 0
#: Tokens of a shard; bounds the memory of a task.
SHARD = 4_000_000
#: Rows of the matrices that leave a task at once, and bytes that a writer holds back.
ROWS = 128
WRITTEN = 16 << 20


class RoomTree:
    """Rows by the room that they have left; finds the least sufficient room.

    A segment tree over the rooms 0 to ``width``: each node counts the rows below it.
    """

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def push(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def pop_least(self, room: int) -> tuple[int, int] | None:
        """Room and number of the row with the least room of ``room`` or more, taken out."""
        count, node = self.count, room + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        found = node - self.leaves
        row = self.rows[found].pop(0)
        self._add(found, -1)
        return found, row


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers."""
    tree, rows = RoomTree(width), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop_least(lengths[piece])
        if found is None:
            found = width, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > lengths[piece]:
            tree.push(room - lengths[piece], row)
    return rows


_SCHEMA = ("shard long, row int, doc_ids array<{}>, pieces array<int>, lengths array<int>, cu_seqlens array<int>, "
           "n_tokens int, ids binary, positions binary")


def pack_matrices(docs: DataFrame, width: int = WIDTH, end: int = END, pad: int = PAD,
                  paths: tuple[str, str] | None = None) -> DataFrame:
    """One row for each row of the packed matrices.

    ``ids`` and ``positions`` are ``width`` little-endian unsigned 32-bit numbers;
    padding has the id ``pad`` and position 0. ``cu_seqlens`` starts with 0.
    """
    paths = paths or vocabulary()

    def shard_rows(number: int, parts: list[tuple[object, int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in _SCHEMA.split(", ")]
        lengths = [len(ids) for _, _, ids in parts]
        out = []
        for row, members in enumerate(best_fit_decreasing(lengths, width)):
            own = [lengths[i] for i in members]
            ids, positions = np.full(width, pad, dtype="<u4"), np.zeros(width, dtype="<u4")
            ends = np.cumsum([0, *own])
            ids[:ends[-1]] = np.concatenate([parts[i][2] for i in members])
            positions[:ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], own)
            out.append((number, row, [parts[i][0] for i in members], [parts[i][1] for i in members], own,
                        ends.tolist(), int(ends[-1]), ids.tobytes(), positions.tobytes()))
            if len(out) == ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, parts, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text, paths, end)
                doc_id = None if pd.isna(doc_id) else doc_id
                parts += [(doc_id, i, ids[start:start + n]) for i, (start, n) in enumerate(cut(len(ids), width))]
                size += len(ids)
                if size >= SHARD:
                    yield from shard_rows(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield from shard_rows(number, parts)

    return texts(docs).mapInPandas(build, _SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def write_matrices(packed: DataFrame, folder: str) -> None:
    """Write packed rows; ``ids`` of a file in order are its id matrix."""
    packed.write.option("parquet.block.size", WRITTEN).parquet(folder)


def stored_matrices(docs: DataFrame) -> DataFrame:
    """The matrices of all documents, written to the scratch folder and read back."""
    folder = new_path(docs.sparkSession, "matrices")
    write_matrices(pack_matrices(docs), folder)
    return docs.sparkSession.read.parquet(folder)


def digests(packed: DataFrame) -> DataFrame:
    """The rows with checksums in place of the matrices."""
    return packed.select("shard", "row", "doc_ids", "pieces", "lengths", "cu_seqlens", "n_tokens",
                         F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
