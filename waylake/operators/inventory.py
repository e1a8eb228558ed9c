"""Nested gazetteer tiers to one inventory, and figures on how the tiers nest."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers from the smallest set to the largest; a record belongs to the first that holds it.
TIERS = ("cities15000", "cities5000", "cities1000", "cities500")


def flag(tier: str) -> str:
    return f"in_{tier}"


def merge_tiers(rows: DataFrame, key: str, tier: str, fields: list[str]) -> DataFrame:
    """One row per key: fields, a flag for each tier, assigned_phase and n_versions (more than one is a conflict).

    A full outer merge of any number of tiers in one aggregation. Of differing versions the least is kept, so the
    result does not depend on row order. Null keys are left out.
    """
    version = F.struct(*(F.col(f) for f in fields))
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(version).alias("v"), F.count_distinct(version).alias("n_versions"), *(F.max(F.col(tier) == t).alias(flag(t)) for t in TIERS)
    )
    return merged.select(key, "v.*", *(flag(t) for t in TIERS), assigned_phase().alias("assigned_phase"), "n_versions")


def assigned_phase() -> Column:
    """The first tier that holds a record."""
    return F.coalesce(*(F.when(F.col(flag(t)), F.lit(t)) for t in TIERS))


def with_flags(inventory: DataFrame) -> DataFrame:
    """Distinct ids of an inventory with its text flags as booleans."""
    return inventory.where("geonameid is not null and geonameid <> ''").groupBy("geonameid").agg(*(F.max(F.lower(F.trim(flag(t))) == "true").alias(flag(t)) for t in TIERS))


def pairwise_overlap(flags: DataFrame) -> DataFrame:
    """left_tier, right_tier, both, left_only, right_only of all pairs of tiers, counted in one pass."""
    sums = []
    for a, b in combinations(TIERS, 2):
        x, y = F.coalesce(F.col(flag(a)), F.lit(False)), F.coalesce(F.col(flag(b)), F.lit(False))
        sums.append(F.struct(F.lit(a).alias("left_tier"), F.lit(b).alias("right_tier"), F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("left_only"), F.count_if(~x & y).alias("right_only")))
    return flags.agg(F.array(*sums).alias("pairs")).select(F.inline("pairs"))


def nesting_violations(flags: DataFrame) -> DataFrame:
    """violation, geonameid: records of a tier that the next tier, or of the first three that the last, lacks."""
    rules = [(f"{a}_not_in_{b}", F.col(flag(a)) & ~F.col(flag(b))) for a, b in zip(TIERS, TIERS[1:])]
    rules += [(f"{a}_not_in_{TIERS[-1]}", F.col(flag(a)) & ~F.col(flag(TIERS[-1]))) for a in TIERS[:-2]]
    return flags.select("geonameid", F.explode(F.array(*(F.when(c, F.lit(n)) for n, c in rules))).alias("violation")).where("violation is not null")


def duplicate_keys(rows: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """n_duplicated and the ``shown`` least of the keys that occur more than once, as numbers where they are."""
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    number = F.col(key).try_cast("decimal(38,0)")
    least = twice.orderBy(number, key).limit(shown).select(F.lit(None).cast("bigint").alias("n"), F.struct(number.alias("number"), F.col(key).alias("text")).alias("k"))
    whole = twice.agg(F.count("*").alias("n")).select("n", F.lit(None).cast(least.schema["k"].dataType).alias("k"))
    both = least.unionByName(whole)  # at most shown + 1 rows
    return both.agg(F.max("n").alias("n_duplicated"), F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["text"]), ",").alias("least_keys"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys of only one of two tables, which are equal as sets if this is empty."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
