"""Snapshot changes against a plain reading of the rules."""

import random

from pyspark.sql import functions as F

from waylake.operators import snapshot_diff as sd

SCHEMA = "day string, id string, loaded timestamp, v string, n string, names string, rule string, __d string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, "day string, id string, loaded string, v string, n string, names string").withColumn("loaded", F.to_timestamp("loaded")).withColumn("__v", F.lit("clash")).withColumn("step", F.lit(1))
    out = sd.snapshot_changes(df, "day", "id", "loaded", [sd.trimmed(F.col("v")), sd.as_number(F.col("n")), sd.as_name_set(F.col("names"))])
    return {tuple(r) for r in out.collect()}


def test_kinds_and_spelling(spark):
    rows = [
        ("2026-01-01", "1", "2026-01-01 00:00:00", "a", "1.50", "x, y"), ("2026-02-01", "1", "2026-02-01 00:00:00", " a　", "1.5", "y,x,,x "),
        ("2026-01-01", "2", "2026-01-01 00:00:00", "a", "", None), ("2026-02-01", "2", "2026-02-01 00:00:00", "A", None, ""),
        ("2026-01-01", "3", "2026-01-01 00:00:00", "a", "1", ""), ("2026-02-01", "4", "2026-02-01 00:00:00", None, "1", ""), ("2026-03-01", "4", None, "", "01", ""),
        ("2026-02-01", None, "2026-02-01 00:00:00", "a", "1", ""), (None, "9", "2026-02-01 00:00:00", "a", "1", ""), ("2026-02-01", "  ", "2026-02-01 00:00:00", "a", "1", ""),
    ]
    assert changes(spark, rows) == {("2026-02-01", "2", "changed"), ("2026-02-01", "3", "removed"), ("2026-02-01", "4", "added"), ("2026-03-01", "1", "removed"), ("2026-03-01", "2", "removed")}


def test_last_loaded_row_holds(spark):
    rows = [("1", "k", "2026-01-01 00:00:00", "a", "", ""), ("2", "k", "2026-01-02 00:00:00", "b", "", ""), ("2", "k", "2026-05-01 00:00:00", "a", "", ""), ("2", "k", None, "c", "", "")]
    assert changes(spark, rows) == set()
    assert changes(spark, rows[:2]) == {("2", "k", "changed")}


def test_empty_and_single(spark):
    assert changes(spark, [("1", "k", "2026-01-01 00:00:00", "a", "", "")]) == set()
    empty = spark.createDataFrame([], "day string, id string, loaded timestamp, v string")
    assert sd.snapshot_changes(empty, "day", "id", "loaded", [F.col("v")]).count() == 0


def test_hot_key_and_random_against_plain(spark):
    rng = random.Random(4)
    rows = [(f"2026-0{rng.randint(1, 4)}-01", "hot" if rng.random() < 0.3 else str(rng.randint(1, 40)), f"2026-05-01 00:{i // 60:02}:{i % 60:02}", rng.choice("ab"), "", "") for i in range(600)]
    held = {}
    for d, k, t, v, _, _ in sorted(rows, key=lambda r: r[2]):
        held[d, k] = v
    days = sorted({r[0] for r in rows})
    want = set()
    for a, b in zip(days, days[1:]):
        for k in {r[1] for r in rows}:
            old, new = held.get((a, k)), held.get((b, k))
            if old != new:
                want.add((b, k, "added" if old is None else "removed" if new is None else "changed"))
    assert changes(spark, rows) == want
