"""E-book archives: guarded unzipping, reading order, and text of each document."""

from __future__ import annotations

import io
import lzma
import os
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_content_chapter, strip
from lectern.functions.unicode import extract_text


class Limits(NamedTuple):
    ratio: float = 100.0
    entry_bytes: int = 100 << 20
    total_bytes: int = 500 << 20

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, prefix: str = "LECTERN_EPUB_") -> Limits:
        """Limits from the environment (``LECTERN_EPUB_RATIO`` and so on), else the defaults."""
        kinds = {"ratio": float, "entry_bytes": int, "total_bytes": int}
        return cls(**{f: kind(env[prefix + f.upper()]) for f, kind in kinds.items() if prefix + f.upper() in env})


def guard_error(entries: list[zipfile.ZipInfo], limits: Limits) -> str | None:
    """What is wrong with an archive's declared sizes, if anything."""
    total = 0
    for e in entries:
        if e.compress_size and e.file_size / e.compress_size > limits.ratio:
            return f"{e.filename}: compression ratio above {limits.ratio:g}"
        if e.file_size > limits.entry_bytes:
            return f"{e.filename}: more than {limits.entry_bytes} bytes"
        total += e.file_size
        if total > limits.total_bytes:
            return f"more than {limits.total_bytes} bytes in all"
    return None


def _spine(archive: zipfile.ZipFile, limits: Limits) -> list[str]:
    """Paths of the documents in reading order."""
    local = lambda e: e.tag.rpartition("}")[2]
    container = ElementTree.fromstring(_entry(archive, "META-INF/container.xml", limits.entry_bytes))
    package = next(e.attrib["full-path"] for e in container.iter() if local(e) == "rootfile")
    root = ElementTree.fromstring(_entry(archive, package, limits.entry_bytes))
    items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if local(e) == "item"}
    refs = [e.attrib["idref"] for e in root.iter() if local(e) == "itemref"]
    folder = posixpath.dirname(package)
    return [posixpath.normpath(posixpath.join(folder, unquote(items[r]))) for r in refs if r in items]


#: What reading a broken, cut or encrypted archive can raise.
_BROKEN = (ValueError, KeyError, StopIteration, OSError, EOFError, RuntimeError, NotImplementedError, LookupError, zipfile.BadZipFile,
           zipfile.LargeZipFile, zlib.error, lzma.LZMAError, struct.error, ElementTree.ParseError)


def _entry(archive: zipfile.ZipFile, name: str, limit: int) -> bytes:
    """An entry's bytes; a ValueError if it holds more than ``limit``, whatever its header says."""
    with archive.open(name) as stream:
        raw = stream.read(limit + 1)
    if len(raw) > limit:
        raise ValueError(f"{name}: more than {limit} bytes")
    return raw


def _documents(limits: Limits):
    def documents(path: str, content: bytes) -> Iterator[tuple]:
        """An archive's rows, each as its entry is read; after an error one row with it and no more."""
        left, k = limits.total_bytes, -1
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                if error := guard_error(archive.infolist(), limits):
                    raise ValueError(error)
                names = set(archive.namelist())
                for k, name in enumerate(n for n in _spine(archive, limits) if n in names):
                    raw = _entry(archive, name, min(limits.entry_bytes, left))
                    left -= len(raw)
                    yield path, k, extract_text(raw.decode("utf-8", "replace")), None
        except _BROKEN as e:
            yield path, -1, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows, size = [], 0
                for row in documents(path, content):
                    rows.append(row)
                    size += len(row[2] or "")
                    if size > _ROWS_CHARS:
                        yield pd.DataFrame(rows, columns=["path", "pos", "text", "error"])
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=["path", "pos", "text", "error"])

    return run


#: Characters of text after which a task hands rows over.
_ROWS_CHARS = 4 << 20


def read_epubs(spark: SparkSession, glob: str, limits: Limits = Limits()) -> DataFrame:
    """(path, pos, text, error): the documents of each archive in reading order.

    A bad archive gives a row with its error and position -1, and no documents; a file of no bytes gives none. Limits hold for what is
    unpacked, not only for what headers declare; a task holds one archive's bytes and one entry.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    rows = files.mapInPandas(_documents(limits), "path string, pos int, text string, error string")
    broken = F.max(F.col("error").isNotNull()).over(Window.partitionBy("path"))
    return rows.withColumn("_broken", broken).filter(~F.col("_broken") | F.col("error").isNotNull()).drop("_broken")


def chapters_of(documents: DataFrame) -> DataFrame:
    """(path, chapter, text): documents with chapter content, numbered from 1; all that aren't blank if none has."""
    own = documents.filter("error is null").withColumn("_ok", is_content_chapter(F.col("text")))
    some = F.max("_ok").over(Window.partitionBy("path"))
    own = own.withColumn("_some", some).filter(F.col("_ok") | (~F.col("_some") & (strip(F.col("text")) != "")))
    return own.select("path", F.row_number().over(Window.partitionBy("path").orderBy("pos")).alias("chapter"), "text")


def with_offsets(chapters: DataFrame, book: str = "path") -> DataFrame:
    """Adds start_char and end_char of each chapter in the book's full text with its chapter marks."""
    mark = F.concat(F.lit("=== CHAPTER "), F.col("chapter").cast("string"), F.lit(" ===\n\n"))
    before = Window.partitionBy(book).orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(mark) + F.length("text") + 2).over(before), F.lit(0)) + F.length(mark)
    return chapters.withColumn("start_char", start).withColumn("end_char", start + F.length("text"))


def book_rows(chapters: DataFrame, book: str = "path") -> dict[str, DataFrame]:
    """What a book leaves on disk: its chapters with their places, and its full text with chapter marks.

    For ``tables.write_artifacts``. The full text is the chapters' in order, each after its mark.
    """
    placed = with_offsets(chapters, book)
    mark = F.concat(F.lit("=== CHAPTER "), F.col("chapter").cast("string"), F.lit(" ===\n\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter", F.concat(mark, "text").alias("t")))), lambda x: x["t"])
    return {"chapters": placed, "full_texts": chapters.groupBy(book).agg(F.array_join(parts, "\n\n").alias("text"))}
