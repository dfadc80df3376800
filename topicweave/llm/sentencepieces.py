"""SentencePiece ids of whole texts by a table of distinct chunks, and back.

A text is its words, each marked by the spaces before it. Where no piece of the vocabulary has a
marker behind another character or a line break beside one, merging never looks across the
start of a word or of a line, so a text's ids are those of its chunks one after the other: each distinct chunk is
segmented once, by the library, and the ids are joined back by position. The same holds for decoding.

1. *Counts*: every task counts the chunks of its texts and reports those that it saw often enough. The
   most frequent ones, bounded in number and in bytes (``TABLE_CHUNKS``, ``TABLE_BYTES``), are the table that each task holds.
2. *Outlines*: texts are taken in parts of about ``PART`` chunks. A part is written as the numbers of its chunks, and
   as the list of its distinct chunks that are not in the table, in the order of their hashes.
3. *The rest*: the lists are cut into ranges of hashes, so that a chunk of any part is in one range, and in each range each distinct
   chunk is segmented once. No range is hot: a part names a chunk once, and frequent chunks are in the table.
4. *Join*: the ids go back to the parts they came from. Outlines are stored in buckets by part, so only
   ids are shuffled.

Which chunks are in the table has no influence on the result.

* A null or empty text has no chunks: begin and end alone, decoded as an empty text.
* Long texts are split whole; a text without a space or line break is one chunk.
* Repeated rows are encoded one by one; ties in counts are together in the table or out of it.
* An empty table has no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.plans.tables import materialise, new_path

MARK = "▁"
#: Bounds of the table of frequent chunks.
TABLE_CHUNKS = 1 << 18
TABLE_BYTES = 16 << 20
#: Distinct chunks that a task counts at once; it reports those with a share of 2^-20 of its chunks, and three at least.
COUNTED = 1 << 21
LEAST_REPORTED = 3
#: Chunks of a part, and parts whose lists meet in a range of hashes, as expected size.
PART = 1 << 20
PARTS = 4


def model() -> str:
    """Path of the public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def processor(path: str):
    """The library's processor; raises where its pieces or its normalisation do not allow chunks."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [found.id_to_piece(i) for i in range(found.get_piece_size())]
    if any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in pieces):
        raise ValueError("a piece crosses the start of a word or of a line")
    probe = " a  b\n c\tﬁ① 　é "
    if found.normalize(probe) != (MARK + probe).replace(" ", MARK):
        raise ValueError("the model changes texts before it segments them")
    return found


def chunks(text: str | None) -> list[str]:
    """Chunks of a text in order.

    A chunk that begins with a line break has no marker; any other is one marker, then its own spaces and characters. A run
    of spaces belongs to the word behind it.
    """
    if not text:
        return []
    found = text.replace(MARK, " ").replace("\n", " \n").split(" ")
    if "" not in found:
        return found
    joined, run = [], 0
    for word in found:
        if not word:
            run += 1
        elif word[0] == "\n":
            if run:
                joined.append(" " * (run - 1))
            joined.append(word)
            run = 0
        else:
            joined.append(" " * run + word)
            run = 0
    if run:
        joined.append(" " * (run - 1))
    return joined


def segment(found: list[str], path: str) -> list[bytes]:
    """Ids of chunks, as little-endian unsigned 32-bit numbers."""
    sp = processor(path)
    # a line break before a chunk keeps the marker that the library puts before a text away from it
    ids = sp.encode([chunk if chunk[:1] == "\n" else "\n " + chunk for chunk in found], num_threads=1)
    return [np.array(own[1:] if chunk[:1] == "\n" else own[2:], dtype="<u4").tobytes() for chunk, own in zip(found, ids, strict=True)]


def shown(ids: list[bytes], path: str) -> list[str]:
    """What the ids of chunks decode to, inside a text."""
    sp = processor(path)
    line = sp.encode("\n")[1:]
    return [text[1:] for text in sp.decode([line + np.frombuffer(own, dtype="<u4").tolist() for own in ids], num_threads=1)]


def frequent_chunks(docs: DataFrame) -> DataFrame:
    """``chunk`` and ``n`` of the most frequent chunks, within the bounds of the table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = Counter(), 0

        def reported() -> pd.DataFrame:
            least = max(LEAST_REPORTED, n >> 20)
            kept = [(chunk, k) for chunk, k in total.items() if k >= least]
            return pd.DataFrame(kept, columns=["chunk", "n"])

        for batch in batches:
            for text in batch["text"]:
                found = chunks(text)
                total.update(found)
                n += len(found)
                if len(total) > COUNTED:
                    yield reported()
                    total, n = Counter(), 0
        yield reported()

    counted = docs.select("text").mapInPandas(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "chunk_counts")
    level = F.floor(8 * F.log2("n"))
    sizes = counted.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("chunk")).alias("octets"))
    least, n, octets = 1 << 30, 0, 0
    for row in sorted(sizes.collect(), key=lambda r: -r["level"]):
        n, octets = n + row["n"], octets + row["octets"]
        if n > TABLE_CHUNKS or octets > TABLE_BYTES:
            break
        least = row["level"]
    return counted.where(level >= least)


@dataclass
class _Table:
    """The frequent chunks by number, with their ids."""

    chunks: list[str]
    ids: list[bytes]
    path: str

    @cached_property
    def number(self) -> dict[str, int]:
        return {chunk: i for i, chunk in enumerate(self.chunks)}

    @cached_property
    def texts(self) -> list[str]:
        return shown(self.ids, self.path)


def _table(docs: DataFrame, path: str) -> Broadcast:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=segment(batch["chunk"].tolist(), path))

    found = frequent_chunks(docs).mapInPandas(look, "chunk string, n long, ids binary").toArrow()
    found = found.sort_by([("n", "descending"), ("chunk", "ascending")])
    return docs.sparkSession.sparkContext.broadcast(_Table(found["chunk"].to_pylist(), found["ids"].to_pylist(), path))


def _pack(values: np.ndarray) -> bytes:
    """32-bit numbers with their bytes of one order of magnitude next to each other, which pack better."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _pack_all(values: list[bytes]) -> bytes:
    """Byte strings one after the other, behind their sizes."""
    sizes = _pack(np.array([len(v) for v in values]))
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.ZstdCompressor(level=1).compress(b"".join(values))


def _unpack_all(packed: bytes) -> list[bytes]:
    start = 8 + int.from_bytes(packed[:8], "little")
    ends = np.cumsum(_unpack(packed[8:start]).astype(np.int64)).tolist()
    joined = zstandard.ZstdDecompressor().decompress(packed[start:])
    return [joined[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _place(chunk: bytes) -> int:
    return xxhash.xxh32_intdigest(chunk)


def outlines(docs: DataFrame, table: Broadcast) -> DataFrame:
    """A row for each part: ``part``, ``doc_ids``, ``sizes``, ``numbers`` and ``rest``.

    Numbers beyond the table's are places in the part's list ``rest``.
    """

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = table.value.number
        known = len(number)
        made = 0
        doc_ids, of_docs, total = [], [], 0
        rest: dict[str, int] = {}

        def part() -> pa.RecordBatch:
            nonlocal made, doc_ids, of_docs, total, rest
            listed = [chunk.encode() for chunk in rest]
            order = np.argsort(np.array([_place(chunk) for chunk in listed], dtype=np.uint32), kind="stable")
            final = np.arange(known + len(listed), dtype=np.uint32)
            final[known + order] = known + np.arange(len(listed), dtype=np.uint32)
            numbers = np.concatenate([np.zeros(0, dtype=np.uint32), *of_docs])
            made += 1
            listed_ids = pa.concat_arrays(doc_ids)
            row = [pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()), pa.ListArray.from_arrays([0, len(listed_ids)], listed_ids),
                   pa.array([_pack(np.array([len(x) for x in of_docs]))], pa.binary()), pa.array([_pack(final[numbers])], pa.binary()),
                   pa.array([_pack_all([listed[i] for i in order.tolist()])], pa.binary())]
            doc_ids, of_docs, total, rest = [], [], 0, {}
            return pa.RecordBatch.from_arrays(row, names=["part", "doc_ids", "sizes", "numbers", "rest"])

        for batch in batches:
            ids, first = batch.column("doc_id"), 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = chunks(text)
                found = [number.get(chunk) for chunk in own]
                if None in found:
                    found = [known + rest.setdefault(chunk, len(rest)) if n is None else n for n, chunk in zip(found, own, strict=True)]
                of_docs.append(np.array(found, dtype=np.uint32))
                total += len(found)
                if total >= PART:
                    doc_ids.append(ids.slice(first, i + 1 - first))
                    first = i + 1
                    yield part()
            doc_ids.append(ids.slice(first))
        if of_docs:
            yield part()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(outline, f"part long, doc_ids array<{kind}>, sizes binary, numbers binary, rest binary")


def rest_ids(parts: DataFrame, n_parts: int, path: str) -> DataFrame:
    """``part``, ``start`` and ``ids``: ids of the chunks of a part's list from place ``start`` on, packed."""
    ranges = -(-n_parts // PARTS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, packed in zip(batch["part"], batch["rest"], strict=True):
                listed = _unpack_all(packed)
                if listed:
                    of = np.array([_place(chunk) for chunk in listed], dtype=np.uint64) * np.uint64(ranges) >> np.uint64(32)
                    starts = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1)).tolist()
                    yield pd.DataFrame([(int(of[i]), part, i, _pack_all(listed[i:j])) for i, j in zip(starts, [*starts[1:], len(listed)], strict=True)],
                                       columns=["range", "part", "start", "rest"])

    def once(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [[chunk.decode() for chunk in _unpack_all(packed)] for packed in rows["rest"]]
        distinct = list(dict.fromkeys(chunk for listed in lists for chunk in listed))
        ids = dict(zip(distinct, segment(distinct, path), strict=True))
        return pd.DataFrame({"part": rows["part"], "start": rows["start"], "ids": [_pack_all([ids[chunk] for chunk in listed]) for listed in lists]})

    cuts = parts.select("part", "rest").mapInPandas(cut, "range int, part long, start int, rest binary")
    return cuts.groupBy("range").applyInPandas(once, "part long, start int, ids binary")


def _in_buckets(parts: DataFrame, spark: SparkSession) -> DataFrame:
    """The table, written in buckets by part: later joins on it need no shuffle of it."""
    name = f"outlines_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts.write.bucketBy(buckets, "part").option("path", new_path(spark, name)).option("compression", "none").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def encode(docs: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row; ``ids`` and ``decoded`` too with ``keep``.

    Ids are those of the library with begin and end; ``decoded`` is what its ``decode`` makes of them.
    """
    path = path or model()
    sp = processor(path)
    first, last = (np.array([i], dtype="<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * keep]
    table = _table(docs, path)
    parts = _in_buckets(outlines(docs, table), docs.sparkSession)
    ids = rest_ids(parts, parts.count(), path).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("start", "ids")))["ids"].alias("ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, numbers, packed = (batch.column(c)[row].as_py() for c in ("sizes", "numbers", "ids"))
                rest = [own for some in packed or [] for own in _unpack_all(some)]
                known_ids, known_text = table.value.ids + rest, table.value.texts + shown(rest, path)
                numbers = _unpack(numbers).tolist()
                ends = np.cumsum(_unpack(sizes).astype(np.int64)).tolist()
                n_tokens, digests, of_texts, kept, decodings = [], [], [], [], []
                for i, j in zip([0, *ends], ends, strict=False):
                    own = numbers[i:j]
                    octets = b"".join([first, *[known_ids[n] for n in own], last])
                    decoded = "".join([known_text[n] for n in own])[1:]
                    n_tokens.append(len(octets) // 4)
                    digests.append(hashlib.sha256(octets).hexdigest())
                    of_texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep:
                        kept.append(octets)
                        decodings.append(decoded)
                columns = [batch.column("doc_ids")[row].values, pa.array(n_tokens, pa.int64()), pa.array(digests, pa.string()),
                           pa.array(of_texts, pa.string()), *[pa.array(kept, pa.binary()), pa.array(decodings, pa.string())] * keep]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = parts.select("part", "doc_ids", "sizes", "numbers").join(ids, "part", "left").select("doc_ids", "sizes", "numbers", "ids")
    return joined.mapInArrow(join, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep)
