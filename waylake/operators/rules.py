"""Data-quality rules: each is a predicate that gives violations as rows, and all are gathered in one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIOLATION = ["rule", "record_key", "message"]


class RulesBroken(RuntimeError):
    """Raised by ``enforce`` with the counts of the broken rules."""


@dataclass(frozen=True)
class Rule:
    """A named predicate that holds for good rows; rows where it is false or null are violations."""

    name: str
    holds: Column
    message: Column


def check_rows(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """rule, record_key, message of every row and rule that it breaks, in one pass over the rows."""
    broken = F.array(*(F.when(~F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), r.message.cast("string").alias("message"))) for r in rules))
    return rows.select(F.col(key).alias("record_key"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("b")).select("b.rule", "record_key", "b.message")


def unique(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Violations for every key that more than one row has."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("record_key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("rule"), "record_key", F.concat(F.lit("rows: "), F.col("n").cast("string")).alias("message"))


def references(rows: DataFrame, key: str, reference: str, target: DataFrame, target_key: str, name: str) -> DataFrame:
    """Violations for every row whose reference the target lacks."""
    known = target.select(F.col(target_key).alias("__k")).distinct()
    lost = rows.join(known, F.col(reference) == F.col("__k"), "left_anti")
    return lost.select(F.lit(name).alias("rule"), F.col(key).alias("record_key"), F.coalesce(F.col(reference).cast("string"), F.lit("null")).alias("message"))


def gather(*parts: DataFrame) -> DataFrame:
    """All violations in one table."""
    out = parts[0].select(*VIOLATION)
    for p in parts[1:]:
        out = out.unionByName(p.select(*VIOLATION))
    return out


def summary(violations: DataFrame) -> DataFrame:
    """rule, n and the least key of each broken rule."""
    return violations.groupBy("rule").agg(F.count("*").alias("n"), F.min("record_key").alias("first_key"))


def enforce(violations: DataFrame) -> None:
    """Fail with the rules' counts if there is any violation: the gate before a build is published."""
    rows = summary(violations).orderBy("rule").collect()  # one row for each rule
    if rows:
        raise RulesBroken("; ".join(f"{r['rule']}: {r['n']} (first {r['first_key']})" for r in rows))


def first_in_order(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, and ``is_repeated`` for keys that had more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).withColumn("is_repeated", F.count("*").over(Window.partitionBy(*keys)) > 1).where("__n = 1").drop("__n")
