"""Readers for gazetteer dumps, CSV tables, Markdown trees and compressed JSON."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from waylake.operators.raw_lines import GAZETTEER, read_lines

_POINTER = b"version https://git-lfs.github.com/spec/"


class SourceError(RuntimeError):
    """A source that is not what it should be."""


def numbered_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """line_id, file_name, file_line, raw_line of a text file, or of the one member ``name`` of a ZIP archive.

    A file that is only a pointer to large-file storage is refused instead of read as data.
    """
    with open(path, "rb") as f:
        head = f.read(len(_POINTER))
    if head == _POINTER:
        raise SourceError(f"{path} is a pointer to large-file storage, not the file")
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        spark.dataSource.register(ZipLines)
        lines = spark.read.format("zip_lines").option("member", name or "").load(path)
    else:
        lines = _text_lines(spark, path)
    return lines.select(F.col("file_line").alias("line_id"), F.lit(os.path.basename(path)).alias("file_name"), "file_line", "raw_line")


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    # The partitions of a text scan of one file are byte ranges in order: a line's number is its place in its
    # partition after the lines of the partitions before, of which there is one count each.
    place = F.monotonically_increasing_id()
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("raw_line"), F.shiftrightunsigned(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    counts = lines.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("part", before.alias("before")))  # one row for each input split
    return lines.join(offsets, "part").select((F.col("before") + F.col("row") + 1).alias("file_line"), "raw_line")


class ZipLines(DataSource):
    """Lines of the one text member of a ZIP archive, streamed; option ``member`` is the member's base name."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "file_line bigint, raw_line string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options.get("path", ""), self.options.get("member", ""))


class _ZipReader(DataSourceReader):
    def __init__(self, path: str, member: str) -> None:
        self.path, self.member = path, member

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            names = [n for n in z.namelist() if not n.endswith("/") and (not self.member or n.rsplit("/", 1)[-1] == self.member)]
        if len(names) != 1:
            raise SourceError(f"{self.path}: expected one member {self.member or 'at all'}, found {len(names)}")
        return [InputPartition(names[0])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z, z.open(partition.value) as raw:
            for number, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8", newline="\n"), 1):
                yield number, line.rstrip("\n")


def gazetteer(spark: SparkSession, path: str, dataset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows as 19 text columns, lines that do not parse with their reason) of one gazetteer file."""
    rows = read_lines(numbered_lines(spark, path, f"{dataset}.txt" if dataset else None), GAZETTEER)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("line_id", "reason")


def csv_table(spark: SparkSession, path: str, columns: list[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """A CSV with header as text columns: missing is the empty text, quoted line breaks are kept, empty rows dropped.

    Short rows are filled up, extra cells ignored. With ``columns`` only these are read. Without ``line_breaks`` in
    quoted cells a large file is read by many tasks; with them one task reads a file.
    """
    df = spark.read.csv(path, header=True, multiLine=line_breaks, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8", enforceSchema=True)
    names = {c: c.lstrip("﻿").strip() for c in df.columns}
    df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in names.items()))
    df = df.where(F.concat(*(F.trim(F.col(f"`{c}`")) for c in df.columns)) != "")
    return df.select(*columns) if columns else df


def commented_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table whose comment lines start with #; the last comment line is its header."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#") & F.contains("value", F.lit("\t"))).agg(F.max("value")).first()[0] or ""
    names = [n.strip().lstrip("#") for n in header.split("\t")]
    cells = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return body.select(*(F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def markdown_tree(spark: SparkSession, root: str, leave_out: tuple[str, ...] = (".git", "raw"), readme: bool = True) -> DataFrame:
    """path (below root) and text of every Markdown file; directories in ``leave_out`` and, if asked, readmes are skipped."""
    pages = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("p"))
    base = os.path.abspath(root).rstrip("/") + "/"
    rel = F.regexp_replace(F.try_url_decode(F.replace("p", F.lit("+"), F.lit("%2B"))), r"^file:/*", "/")
    pages = pages.select(F.substring(rel, len(base) + 1, 1 << 20).alias("path"), F.col("value").alias("text"))
    kept = ~F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda d: d.isin(*leave_out))
    pages = pages.where(kept)
    return pages if readme else pages.where(F.lower(F.element_at(F.split("path", "/"), -1)) != "readme.md")


def gzip_documents(spark: SparkSession, path: str) -> DataFrame:
    """source, archive_sha256, payload_sha256, payload of gzip files; payload is null where one is no gzip or no UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content)
                row = [name, hashlib.sha256(content).hexdigest(), None, None]
                try:
                    data = gzip.decompress(content)
                    row[2:] = hashlib.sha256(data).hexdigest(), data.decode("utf-8")
                except (OSError, EOFError, UnicodeDecodeError, ValueError):
                    row[2:] = None, None
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "archive_sha256", "payload_sha256", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read = files.mapInPandas(run, "path string, archive_sha256 string, payload_sha256 string, payload string")
    return read.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "archive_sha256", "payload_sha256", "payload")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """source and the document of JSON files as a variant; null where a file is no JSON."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("source"), "value")
    return files.select("source", F.try_parse_json("value").alias("document"))
