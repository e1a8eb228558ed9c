"""Loading raw delimited lines: valid rows come out typed, the others with the reason for failure.

Blocks of lines go through a columnar CSV parser, as slices of one buffer. A block that does not parse is bisected
down to a few lines, which the strict field reader takes one by one to name the reason. The values of all rows of a
batch, from either reader, are then checked column by column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAZETTEER_FIELDS = (
    "geonameid name asciiname alternatenames latitude longitude feature_class feature_code country_code cc2 "
    "admin1_code admin2_code admin3_code admin4_code population elevation dem timezone modification_date"
).split()
REPORT_FIELDS = "snapshot_date scope filename row_count sha256 note".split()

_BLOCK_FIELD = r'(?:"(?:[^"\r]|"")*"|[^",\r\n]*)'
#: Well-quoted lines that the block parser reads as they are: no line end but inside quotes, and not empty.
FIT_FOR_BLOCKS = rf"\A{_BLOCK_FIELD}(?:,{_BLOCK_FIELD})+\z"
DIGITS = r"\A[0-9]+\z"
DIGITS_OR_EMPTY = r"\A[0-9]*\z"
DECIMAL = r"\A-?[0-9]+(?:\.[0-9]+)?\z"
ISO_DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
SHA256 = r"\A[0-9A-Fa-f]{64}\z"


def _matches(column: pa.Array, pattern: str) -> pa.Array:
    return pc.match_substring_regex(column, pattern)


def _is_day(column: pa.Array) -> pa.Array:
    """True where the text is a calendar date written yyyy-MM-dd (years 0001 to 9999)."""
    shaped = _matches(column, ISO_DAY)
    safe = pc.if_else(shaped, column, "2000-01-01")

    def part(start: int, stop: int) -> pa.Array:
        return pc.cast(pc.utf8_slice_codeunits(safe, start, stop), pa.int32())

    year, month, day = part(0, 4), part(5, 7), part(8, 10)

    def divides(n: int) -> pa.Array:
        return pc.equal(pc.subtract(year, pc.multiply(pc.divide(year, n), n)), 0)

    leap = pc.or_(pc.and_(divides(4), pc.invert(divides(100))), divides(400))
    short = pc.is_in(month, pa.array([4, 6, 9, 11], pa.int32()))
    last = pc.if_else(pc.equal(month, 2), pc.if_else(leap, 29, 28), pc.if_else(short, 30, 31))
    ranges = [pc.greater_equal(year, 1), pc.greater_equal(month, 1), pc.less_equal(month, 12), pc.greater_equal(day, 1), pc.less_equal(day, last)]
    for r in ranges:
        shaped = pc.and_(shaped, r)
    return shaped


def _within(column: pa.Array, most: float) -> pa.Array:
    shaped = _matches(column, DECIMAL)
    value = pc.cast(pc.if_else(shaped, column, "0"), pa.float64())
    return pc.and_(shaped, pc.less_equal(pc.abs(value), most))


def _gazetteer_values(t: pa.Table) -> pa.Array:
    checks = [
        _matches(t["geonameid"], DIGITS),
        _within(t["latitude"], 90.0),
        _within(t["longitude"], 180.0),
        _matches(t["population"], DIGITS_OR_EMPTY),
        _is_day(t["modification_date"]),
    ]
    return _all(checks)


def _report_values(t: pa.Table) -> pa.Array:
    return _all([_is_day(t["snapshot_date"]), _matches(t["row_count"], DIGITS), _matches(t["sha256"], SHA256)])


def _all(checks: list) -> pa.Array:
    out = checks[0]
    for c in checks[1:]:
        out = pc.and_(out, c)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


@dataclass(frozen=True)
class LineFormat:
    """A raw format: its fields, separator, whether quotes have a meaning, and its vectorised value check."""

    name: str
    fields: tuple[str, ...]
    separator: str
    quoted: bool

    def values_ok(self, t: pa.Table) -> pa.Array:
        return _report_values(t) if self.quoted else _gazetteer_values(t)


GAZETTEER = LineFormat("gazetteer_lines", tuple(GAZETTEER_FIELDS), "\t", False)
REPORT = LineFormat("report_lines", tuple(REPORT_FIELDS), ",", True)


#: Failing blocks are halved down to so many lines.
LEAF = 16


@lru_cache(maxsize=8)
def _options(fmt: LineFormat) -> dict:
    return {
        "parse_options": pacsv.ParseOptions(delimiter=fmt.separator, quote_char='"' if fmt.quoted else False, double_quote=fmt.quoted, newlines_in_values=fmt.quoted, ignore_empty_lines=False),
        "convert_options": pacsv.ConvertOptions(column_types={f: pa.string() for f in fmt.fields}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    }


def _read_block(data: pa.Buffer, n_lines: int, fmt: LineFormat) -> pa.Table | None:
    """The block as columns, or None if any of its lines has not the right fields."""
    read = pacsv.ReadOptions(column_names=list(fmt.fields), use_threads=False, block_size=max(data.size + 16, 1 << 12))
    try:
        t = pacsv.read_csv(pa.BufferReader(data), read_options=read, **_options(fmt))
    except pa.ArrowInvalid:
        return None
    return t if t.num_rows == n_lines else None


def strict_fields(line: str, fmt: LineFormat) -> tuple[str | None, list[str]]:
    """(None or ``quoting``, the fields) of one line, read character run by character run."""
    if not fmt.quoted:
        return None, line.split(fmt.separator)
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            at, part = at + 1, []
            while True:
                end = line.find('"', at)
                if end < 0:
                    return "quoting", []
                part.append(line[at:end])
                if line[end + 1 : end + 2] != '"':
                    at = end + 1
                    break
                part.append('"')
                at = end + 2
            if at < n and line[at] != fmt.separator:
                return "quoting", []
            fields.append("".join(part))
        else:
            end = line.find(fmt.separator, at)
            part_text = line[at:] if end < 0 else line[at:end]
            if '"' in part_text:
                return "quoting", []
            fields.append(part_text)
            at = n if end < 0 else end
        if at >= n:
            return None, fields
        at += 1


def diagnose(line: str, fmt: LineFormat) -> tuple[str | None, list[str]]:
    """The first reason that applies to a line but for its values, or None and its fields."""
    reason, fields = strict_fields(line, fmt)
    if reason is None and len(fields) != len(fmt.fields):
        reason = "column_count"
    return reason, [] if reason else fields


def parse_lines(lines: pa.Array, fmt: LineFormat) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """(reason of each line, None for valid ones; numbers of the valid lines; their fields in that order)."""
    n = len(lines)
    reasons = np.full(n, None, dtype=object)
    # The block parser takes a carriage return, or a line feed outside quotes, for a line's end, in a value too.
    fit = (_matches(lines, FIT_FOR_BLOCKS) if fmt.quoted else pc.invert(_matches(lines, r"[\r\n]|\A\z"))).to_numpy(zero_copy_only=False)
    unfit = np.concatenate([[0], np.cumsum(~fit)])
    _, offsets, data = pc.binary_join_element_wise(lines, "", "\n").buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[: n + 1]
    parts, numbers, strict = [], [], []
    todo = [(0, n)] if n else []
    while todo:
        lo, hi = todo.pop()
        t = _read_block(data.slice(ends[lo], ends[hi] - ends[lo]), hi - lo, fmt) if unfit[lo] == unfit[hi] else None
        if t is not None:
            parts.append(t)
            numbers.append(np.arange(lo, hi))
        elif hi - lo <= LEAF:
            strict += range(lo, hi)
        else:
            mid = (lo + hi) // 2
            todo += [(mid, hi), (lo, mid)]
    single, fields = [], []
    for i, line in zip(strict, lines.take(pa.array(strict, pa.int64())).to_pylist()):
        reasons[i], own = diagnose(line, fmt)
        if reasons[i] is None:
            single.append(i)
            fields.append(own)
    numbers.append(np.array(single, dtype=np.int64))
    parts.append(pa.table([pa.array(c, pa.string()) for c in (zip(*fields) if fields else [[]] * len(fmt.fields))], names=list(fmt.fields)))
    rows, number = pa.concat_tables(parts).combine_chunks(), np.concatenate(numbers)
    if not len(number):
        return reasons, number, rows
    good = fmt.values_ok(rows)
    mask = good.to_numpy(zero_copy_only=False)
    reasons[number[~mask]] = "value"
    return reasons, number[mask], rows.filter(good)


def read_lines(lines: DataFrame, fmt: LineFormat, block_rows: int = 2048) -> DataFrame:
    """Every line of ``lines`` (line_id, raw_line) as line_id, reason and the format's fields as text.

    ``reason`` is null for valid lines; fields are null for the others. In an unquoted format, lines of white
    space only are skipped, and a byte-order mark at the start and one carriage return at the end are dropped.
    A null line is skipped in an unquoted format and has too few fields in a quoted one. An empty table gives
    an empty result; other columns of ``lines`` are ignored; repeated lines are each reported.
    """
    names = ["line_id", "reason", *fmt.fields]
    schema = pa.schema([("line_id", pa.int64()), *((n, pa.string()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block_rows):
                batch = whole.slice(at, block_rows)
                ids, raw = batch.column(0), pc.cast(batch.column(1), pa.string())
                if fmt.quoted:
                    raw = pc.fill_null(raw, "")
                else:
                    raw = pc.replace_substring_regex(pc.replace_substring_regex(raw, "\\A\ufeff", ""), r"\r\z", "")
                    full = pc.fill_null(pc.invert(pc.or_(pc.equal(raw, ""), pc.utf8_is_space(raw))), False)
                    ids, raw = ids.filter(full), raw.filter(full)
                ids, raw = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, raw))
                reasons, number, rows = parse_lines(raw, fmt)
                bad = np.flatnonzero(reasons != np.array(None))
                if len(bad):
                    yield _batch(schema, ids.take(pa.array(bad)), pa.array(reasons[bad], pa.string()), None)
                if len(number):
                    yield _batch(schema, ids.take(pa.array(number)), None, [rows[f].combine_chunks() for f in fmt.fields])

    ddl = "line_id bigint, " + ", ".join(f"{n} string" for n in names[1:])
    return lines.select(F.col("line_id").cast("bigint"), F.col("raw_line").cast("string")).mapInArrow(run, ddl)


def _batch(schema: pa.Schema, ids: pa.Array, reason: pa.Array | None, fields: list | None) -> pa.RecordBatch:
    n = len(ids)
    empty = pa.nulls(n, pa.string())
    columns = [ids, empty if reason is None else reason, *(fields or [empty] * (len(schema) - 2))]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    columns = [c if not isinstance(c, pa.ChunkedArray) else pa.concat_arrays(c.chunks) for c in columns]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def rejected(lines: DataFrame, fmt: LineFormat) -> DataFrame:
    """raw_table, line_id and reason of the lines that do not load."""
    return read_lines(lines, fmt).where("reason is not null").select(F.lit(fmt.name).alias("raw_table"), "line_id", "reason")


def gazetteer_rows(lines: DataFrame) -> DataFrame:
    """The valid gazetteer lines with typed columns."""
    typed = {"geonameid": "decimal(38,0)", "latitude": "double", "longitude": "double", "population": "decimal(38,0)", "modification_date": "date"}
    rows = read_lines(lines, GAZETTEER).where("reason is null")
    return rows.select("line_id", *(F.expr(f"try_cast({f} as {typed[f]})").alias(f) if f in typed else F.col(f) for f in GAZETTEER_FIELDS))


def report_rows(lines: DataFrame) -> DataFrame:
    """The valid report lines with typed columns."""
    rows = read_lines(lines, REPORT).where("reason is null")
    return rows.select("line_id", F.to_date("snapshot_date").alias("snapshot_date"), "scope", "filename", F.expr("try_cast(row_count as decimal(38,0))").alias("row_count"), F.lower("sha256").alias("sha256"), "note")
