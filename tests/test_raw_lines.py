"""Raw lines: reasons, typed rows, and agreement of the block path with the strict reader."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from waylake.operators import raw_lines as rl

GOOD = "1\tCity\tCity\t\t31.2\t121.5\tP\tPPL\tCN\t\t01\t\t\t\t1000\t\t\tAsia/Shanghai\t2026-07-30"
SHA = "a" * 64


def gazetteer(**changes):
    fields = GOOD.split("\t")
    for k, v in changes.items():
        fields[rl.GAZETTEER_FIELDS.index(k)] = v
    return "\t".join(fields)


CASES = [
    (GOOD, None), ("﻿" + GOOD, None), (GOOD + "\r", None), (gazetteer(name='"open'), None), (gazetteer(population=""), None),
    (GOOD + "\t", "column_count"), (GOOD.replace("\t", " ", 1), "column_count"), (GOOD + "\r\r", "value"),
    (gazetteer(geonameid="x1"), "value"), (gazetteer(geonameid="１２"), "value"), (gazetteer(geonameid=""), "value"), (gazetteer(latitude="90.1"), "value"),
    (gazetteer(latitude="90"), None), (gazetteer(latitude="-90.0"), None), (gazetteer(latitude="1."), "value"), (gazetteer(latitude="+1"), "value"), (gazetteer(longitude="180.0001"), "value"),
    (gazetteer(longitude=" 1"), "value"), (gazetteer(population="1.5"), "value"), (gazetteer(modification_date="2026-02-29"), "value"), (gazetteer(modification_date="2024-02-29"), None),
    (gazetteer(modification_date="20260101"), "value"), (gazetteer(modification_date="0000-01-01"), "value"), (gazetteer(name="x" * 300_000), None), (gazetteer(name="a\nb"), None),
]
REPORT_CASES = [
    (f"2026-01-01,CN.inventory,a.csv,5,{SHA},note", None), (f'"2026-01-01",s,"a,b",5,{SHA.upper()},"two\nlines"', None), (f'2026-01-01,s,f,5,{SHA},"say ""hi"""', None),
    (f'2026-01-01,s,f,5,{SHA},say "hi"', "quoting"), (f'2026-01-01,s,f,5,{SHA},"open', "quoting"), (f'2026-01-01,s,"f"x,5,{SHA},n', "quoting"), ('"', "quoting"),
    (f"2026-01-01,s,f,5,{SHA}", "column_count"), (f"2026-01-01,s,f,5,{SHA},a,b", "column_count"), ("", "column_count"), (None, "column_count"),
    (f"2026-13-01,s,f,5,{SHA},n", "value"), (f"2026-01-01,s,f,,{SHA},n", "value"), (f"2026-01-01,s,f,5,{SHA[1:]},n", "value"), (f"2026-01-01 ,s,f,5,{SHA},n", "value"), (f"2026-01-01,s,f,5,{SHA},", None),
]


def reasons(spark, fmt, texts, **kw):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "line_id bigint, raw_line string, reason string")
    return {r["line_id"]: r["reason"] for r in rl.read_lines(df, fmt, **kw).collect()}


def test_gazetteer_reasons(spark):
    texts = [t for t, _ in CASES] + [None, "", "   ", "\t \r", "﻿  "]
    got = reasons(spark, rl.GAZETTEER, texts)
    assert got == {i: want for i, (_, want) in enumerate(CASES)}  # blank and null lines are skipped


def test_report_reasons(spark):
    got = reasons(spark, rl.REPORT, [t for t, _ in REPORT_CASES])
    assert got == {i: want for i, (_, want) in enumerate(REPORT_CASES)}


def test_block_size_does_not_matter(spark):
    texts = [t for t, _ in CASES] * 3
    assert reasons(spark, rl.GAZETTEER, texts, block_rows=1) == reasons(spark, rl.GAZETTEER, texts, block_rows=1000)


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id bigint, raw_line string")
    assert rl.read_lines(df, rl.GAZETTEER).count() == 0
    assert rl.rejected(df, rl.REPORT).count() == 0


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, gazetteer(population="12345678901234567890"), None), (2, "x", None)], "line_id bigint, raw_line string, extra string")
    row = rl.gazetteer_rows(df).collect()
    assert len(row) == 1 and row[0]["latitude"] == 31.2 and str(row[0]["modification_date"]) == "2026-07-30" and int(row[0]["population"]) == 12345678901234567890


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=',"ab1\n-', max_size=12), max_size=8))
def test_blocks_agree_with_strict_reader(lines):
    found, number, rows = rl.parse_lines(pa.array(lines, pa.string()), rl.REPORT)
    for i, line in enumerate(lines):
        reason, fields = rl.diagnose(line, rl.REPORT)
        assert found[i] == (reason or (None if rl.REPORT.values_ok(pa.table([[f] for f in fields], names=list(rl.REPORT.fields)))[0].as_py() else "value"))
    assert sorted(number) == [i for i, r in enumerate(found) if r is None] and rows.num_rows == len(number)


def test_bad_lines_among_many_blocks(spark):
    texts = [gazetteer(geonameid=str(i)) if i % 37 else "short\tline" if i % 2 else gazetteer(latitude="x") for i in range(3000)]
    got = reasons(spark, rl.GAZETTEER, texts)
    assert got == {i: None if i % 37 else "column_count" if i % 2 else "value" for i in range(3000)}
    df = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, raw_line string")
    assert all(r["line_id"] == int(r["geonameid"]) for r in rl.gazetteer_rows(df).select("line_id", "geonameid").collect())
