"""Expected values, gates, reports, paths and serialisation of builds."""

import io

import pytest
from pyspark.sql import functions as F

from waylake.operators import builds
from waylake.operators.rules import RulesBroken


def test_all_mismatches_are_listed(spark):
    stats = spark.createDataFrame([("a", 3, "AbC", "x"), ("b", 5, None, "x")], "dataset string, n_rows bigint, sha string, check string")
    actual = builds.long_form(stats.drop("check"), "dataset", ["n_rows", "sha"])
    expected = spark.createDataFrame([("a", "n_rows", "3"), ("a", "sha", "aBc"), ("b", "n_rows", "4"), ("b", "sha", "f"), ("c", "n_rows", "1"), ("a", "size", "1"), ("a", "n_rows", None)], "dataset string, check string, value string")
    got = {(r["dataset"], r["check"], r["problem"]) for r in builds.mismatches(expected, actual, ["n_rows", "sha"]).collect()}
    assert got == {("b", "n_rows", "differs"), ("b", "sha", "missing"), ("c", "n_rows", "missing"), ("a", "size", "unsupported")}
    assert builds.mismatches(expected.limit(0), actual, ["n_rows"]).count() == 0
    builds.gate(expected.limit(0))
    with pytest.raises(RulesBroken, match="7 problems"):
        builds.gate(expected)


def test_report_gives_exit_codes():
    def broken():
        raise RulesBroken("two")

    for build, code, said in ((lambda: {"b": 1, "a": "市"}, 0, '"a": "市"'), (broken, 1, "invalid: two"), (lambda: 1 / 0, 2, "failed")):
        out = io.StringIO()
        assert builds.report(build, out) == code and said in out.getvalue()


def test_paths_and_parents(spark):
    df = spark.createDataFrame([("a/b/c.md",), ("a/d.md",), (None,), ("",)], "path string")
    assert {r[0] for r in builds.with_parents(df).collect()} == {"a", "a/b", "a/b/c.md", "a/d.md"}


def test_scalars(spark):
    df = spark.createDataFrame([("1.5", 7, "</script>\u2028", "HTTPS://x", "/a/b"), ("EMPTY", 123, "ok", "/x", "//evil"), ("NaN", 0, "", "ftp://x", "/\\evil"), ("Infinity", None, None, None, None)], "n string, i int, t string, href string, path string")
    rows = df.select(builds.is_number(F.col("n")), builds.ordinal(F.col("i")), builds.safe_json(F.struct("t")), builds.is_external(F.col("href")), builds.safe_return_path(F.col("path"))).collect()
    assert [r[0] for r in rows] == [True, False, False, False] and [r[1] for r in rows] == ["07", "123", "00", None]
    assert rows[0][2] == '{"t":"\\u003c/script>\\u2028"}' and [r[3] for r in rows] == [True, False, False, None] and [r[4] for r in rows] == ["/a/b", "/", "/", "/"]
