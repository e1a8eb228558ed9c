"""Sinks that put a result in place whole or not at all."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SinkRefused(RuntimeError):
    """A target that must not be written."""


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def deterministic_gzip(data: bytes) -> bytes:
    """Gzip without name and time: equal data give equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def guard(output: str, inputs: Iterable[str] = (), others: Iterable[str] = (), root: str | None = None) -> None:
    """Refuse an output that is an input or another output, or that lies outside ``root``."""
    real = os.path.realpath(output)
    if real in {os.path.realpath(p) for p in inputs}:
        raise SinkRefused(f"refusing to overwrite an input: {output}")
    if real in {os.path.realpath(p) for p in others}:
        raise SinkRefused(f"two outputs at one place: {output}")
    if root is not None and os.path.commonpath([real, os.path.realpath(root)]) != os.path.realpath(root):
        raise SinkRefused(f"outside {root}: {output}")


def write_whole(path: str, chunks: Iterable[str]) -> None:
    """Text into a temporary file beside the target, which then takes its place; on failure nothing changes."""
    directory = os.path.dirname(os.path.abspath(path))
    os.makedirs(directory, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=directory, prefix=".part-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            for chunk in chunks:
                f.write(chunk)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def write_csv_file(df: DataFrame, path: str, order: list | None = None) -> None:
    """One CSV file with a header and line feeds, rows in ``order``; booleans as true and false, null as nothing.

    Rows stream through the driver partition by partition; for results that fit no single file use ``write_table``.
    """
    shown = df.orderBy(*order) if order else df

    def chunks() -> Iterator[str]:
        buffer = io.StringIO()
        writer = csv.writer(buffer, lineterminator="\n")
        writer.writerow(df.columns)
        for row in shown.toLocalIterator(prefetchPartitions=True):
            writer.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
            if buffer.tell() > 1 << 16:
                yield buffer.getvalue()
                buffer.seek(0)
                buffer.truncate()
        yield buffer.getvalue()

    write_whole(path, chunks())


def write_json_file(value: object, path: str) -> None:
    """JSON with sorted keys, two blanks and a final line feed."""
    write_whole(path, [json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True), "\n"])


def write_table(df: DataFrame, directory: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A table written beside its place and swapped in; the old one comes back if the swap fails."""
    target = os.path.abspath(directory)
    staging, backup = f"{target}.staging", f"{target}.backup"
    shutil.rmtree(staging, ignore_errors=True)
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(staging)
    swap_directory(staging, target, backup)


def swap_directory(staging: str, target: str, backup: str) -> None:
    """Put ``staging`` at ``target``, keeping what was there until that has worked."""
    shutil.rmtree(backup, ignore_errors=True)
    had = os.path.exists(target)
    if had:
        os.rename(target, backup)
    try:
        os.rename(staging, target)
    except OSError:
        if had:
            os.rename(backup, target)
        raise
    shutil.rmtree(backup, ignore_errors=True)


def feature_collection(points: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature as text for each point (id, lon, lat and properties); a collection is their list."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_documents(df: DataFrame, directory: str, name: str, value: str) -> int:
    """One JSON file for each row, named by a column, written by the tasks; the number of files.

    Names may hold letters, digits, dots, hyphens and underscores only, so that no file leaves the directory.
    """
    os.makedirs(directory, exist_ok=True)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for n, v in zip(pdf[name], pdf[value]):
                if not n or n.startswith(".") or not all(c.isalnum() or c in "._-" for c in n):
                    raise SinkRefused(f"not a file name: {n!r}")
                write_whole(os.path.join(directory, f"{n}.json"), [v or "null", "\n"])
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select(F.col(name).cast("string").alias(name), F.col(value).cast("string").alias(value)).mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
