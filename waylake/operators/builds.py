"""What a build needs around its tables: expected values, reports, path checks, safe serialisation, a gate."""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylake.operators.rules import RulesBroken


def long_form(stats: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """dataset, check, value (text) of each check column of one row a dataset."""
    pairs = F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("string").alias("value")) for c in checks))
    return stats.select(F.col(key).alias("dataset"), F.inline(pairs))


def mismatches(expected: DataFrame, actual: DataFrame, supported: list[str]) -> DataFrame:
    """dataset, check, expected, actual, problem of every expected value that does not hold.

    Both sides are dataset, check, value. Values are compared without case; ``problem`` is ``unsupported`` for a check
    that is none of ``supported``, ``missing`` where nothing was measured, else ``differs``. All mismatches come out,
    not the first only; nulls expected are no expectation; repeated expectations are each reported.
    """
    both = expected.where("value is not null").withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), ["dataset", "check"], "left")
    problem = F.when(~F.col("check").isin(*supported), "unsupported").when(F.col("actual").isNull(), "missing").when(F.lower("expected") != F.lower("actual"), "differs")
    return both.withColumn("problem", problem).where("problem is not null").select("dataset", "check", "expected", "actual", "problem")


def gate(problems: DataFrame, show: int = 10) -> None:
    """Refuse to publish if there is any problem; the message has their number and the first few."""
    first = problems.limit(show + 1).collect()
    if first:
        raise RulesBroken(f"{problems.count()} problems: " + "; ".join(str(tuple(r)) for r in first[:show]))


def report(build, out=None) -> int:
    """Run ``build()``, print its report as JSON with sorted keys, and give the exit code: 0, 1 for broken rules, 2 for anything else."""
    out = out or sys.stdout
    try:
        print(json.dumps(build(), ensure_ascii=False, indent=2, sort_keys=True, default=str), file=out)
        return 0
    except RulesBroken as e:
        print(f"invalid: {e}", file=out)
        return 1
    except Exception as e:  # the program's last resort: the caller wants an exit code
        print(f"failed: {e}", file=out)
        return 2


def with_parents(paths: DataFrame, column: str = "path") -> DataFrame:
    """path: every path and every directory above one."""
    parts = F.split(column, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where(F.col(column) != "").select(F.explode(every).alias("path")).distinct()


def is_number(c: Column) -> Column:
    """True for texts that are finite numbers; the marks ``EMPTY`` and the empty text are none."""
    n = c.try_cast("double")
    return F.coalesce(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))


def safe_json(value: Column) -> Column:
    """A struct, map or array as JSON that may stand inside a script: no ``<``, U+2028 or U+2029."""
    out = F.to_json(value)
    for ch, escape in (("<", r"\u003c"), ("\u2028", r"\u2028"), ("\u2029", r"\u2029")):
        out = F.replace(out, F.lit(ch), F.lit(escape))
    return out


def ordinal(n: Column, width: int = 2) -> Column:
    """A number with leading zeros; longer numbers stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def is_external(href: Column) -> Column:
    """True for links with a web scheme, in any case."""
    return href.rlike(r"(?i)^https?://")


def safe_return_path(path: Column) -> Column:
    """A path within the site, ``/`` for anything that leads elsewhere."""
    return F.when(path.rlike(r"^/(?![/\\])") & ~path.rlike(r"[\x00-\x1f]"), path).otherwise("/")
