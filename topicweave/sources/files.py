"""Text folders as DataFrames. Any Hadoop URI works, ``file://`` included.

A folder may be relative or a glob; one that matches nothing raises. Only the level
asked for is read: files directly in a folder, or directly in its sub-folders. Files are listed by Spark's file
index, which drops those of other levels by their paths before any is opened; the driver's Python sees the
folders that were asked for, never a file.

A file for each document costs more than its text once there are many. ``write_bundles`` stores many documents in a
file, as ``name``, newline, text, ``boundary``; with that boundary the readers split the files at it between tasks and give the
same rows. The name stands for the file name: it holds no newline and is unique in its folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_path() -> Column:
    """Path of the row's file; the metadata column holds it URI-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _path_part(path: Column, from_end: int) -> Column:
    return F.element_at(F.split(path, "/"), -from_end)


def _matches(spark: SparkSession, folder: str) -> list:
    """File system entries that a path or glob matches, hidden ones left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [entry for entry in found or [] if not entry.getPath().getName().startswith(("_", "."))]


def _folders(spark: SparkSession, folder: str) -> list:
    found = [entry.getPath() for entry in _matches(spark, folder.rstrip("/") or "/") if entry.isDirectory()]
    if not found:
        raise FileNotFoundError(f"no folder matches {folder}")
    return found


def _escaped(path) -> str:
    """A path as Spark's readers take it: they would read it as a glob."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path.toString())


def _depth(folder) -> int:
    return len([part for part in folder.toUri().getPath().split("/") if part])


def _files_of(spark: SparkSession, folders: list, below: int = 1, boundary: str | None = None) -> DataFrame:
    """``(file, name, path, text)`` of the documents in files that many levels below some folders."""
    by_depth: dict[int, list[str]] = {}
    for folder in folders:
        by_depth.setdefault(_depth(folder), []).append(_escaped(folder))
    parts = F.size(F.split(F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")) - 1
    reader = spark.read.option("recursiveFileLookup", "true")
    found = [reader.text(paths, wholetext=boundary is None, lineSep=boundary).where(parts == depth + below)
             .select(_file_path().alias("file"), "value") for depth, paths in by_depth.items()]
    rows = reduce(DataFrame.unionByName, found)
    if boundary is None:
        return rows.select("file", _path_part(F.col("file"), 1).alias("name"), F.col("file").alias("path"), F.col("value").alias("text"))
    name = F.substring_index("value", "\n", 1)
    return rows.select("file", name.alias("name"), F.concat("file", F.lit("#"), name).alias("path"),
                       F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)").alias("text"))


def new_boundary() -> str:
    """A line that no text holds."""
    return f"--{uuid.uuid4().hex}\n"


def write_bundles(docs: DataFrame, folder: str, boundary: str) -> None:
    """Write ``(topic, name, text)``, one sub-folder for each topic and many documents in a file."""
    body = F.concat("name", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    docs.select("topic", body.alias("value")).write.partitionBy("topic").option("lineSep", boundary).text(folder)


def read_documents(spark: SparkSession, folder: str, boundary: str | None = None) -> DataFrame:
    """One row ``(path, text)`` for each document directly inside a folder."""
    return _files_of(spark, _folders(spark, folder), boundary=boundary).select("path", "text")


def read_document_files(spark: SparkSession, folder: str, boundary: str | None = None) -> DataFrame:
    """The documents directly inside a folder: ``(doc_id, path, text)``.

    ``doc_id`` is the file name; where a glob matches several folders it is the path,
    since names may repeat.
    """
    folders = _folders(spark, folder)
    doc_id = F.col("name") if len(folders) == 1 else F.col("path")
    return _files_of(spark, folders, boundary=boundary).select(doc_id.alias("doc_id"), "path", "text")


def read_labelled_corpus(spark: SparkSession, root: str, boundary: str | None = None) -> DataFrame:
    """Two-level folder: sub-folder name = topic, file = document.

    Returns ``(topic, doc_id, path, text)``; the path identifies the document.
    """
    found = _files_of(spark, _folders(spark, root), below=2, boundary=boundary)
    return found.select(_path_part(F.col("file"), 2).alias("topic"), F.col("path").alias("doc_id"), "path", "text")


def read_document_folders(spark: SparkSession, root: str, boundary: str | None = None) -> DataFrame:
    """Every sub-folder as its own document set, keyed by ``topic`` = folder name.

    The same scan as :func:`read_labelled_corpus`: all sets go through one job.
    """
    return read_labelled_corpus(spark, root, boundary)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(path, line)`` per line."""
    return spark.read.text(path).select(_file_path().alias("path"), F.col("value").alias("line"))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stopwords ``word``, one per line and exact."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()
