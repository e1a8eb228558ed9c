"""What changed between full deliveries: one aggregation shuffle over rows tagged by side.

Each row of delivery d is the later side of the comparison d-1 -> d and the earlier side of d -> d+1. Rows are
reduced to a hash of their compared values before the shuffle; per comparison and key, the hash of the row that
holds (the last loaded one) is kept for each side by a partial aggregation, so a key that holds a third of all
rows is pre-aggregated where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space as Unicode has it, at either end.
_ENDS = r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"


def trimmed(c: Column) -> Column:
    """The text without white space at its ends; null gives the empty text."""
    return F.coalesce(F.regexp_replace(c.cast("string"), _ENDS, ""), F.lit(""))


def as_number(c: Column) -> Column:
    """Equal numbers as equal text, other text trimmed."""
    t = trimmed(c)
    return F.when(t.rlike(_NUMBER), F.concat(F.lit("#"), (t.cast("double") + F.lit(0.0)).cast("string"))).otherwise(t)


def as_name_set(c: Column) -> Column:
    """A comma-separated list as a set: trimmed, without empty names, in one order."""
    names = F.transform(F.split(trimmed(c), ","), lambda x: trimmed(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), "\u0001")


def row_hash(values: list[Column]) -> Column:
    """96 bits over the values in order; the two parts come from unrelated hash functions."""
    return F.struct(F.xxhash64(*values).alias("a"), F.hash(*values).alias("b"))


def snapshot_changes(rows: DataFrame, delivery: str, key: str, loaded: str, values: list[Column]) -> DataFrame:
    """snapshot_date, record_key, change_type for each delivery against the one before it.

    Of several rows of one key in one delivery the one with the greatest ``loaded`` holds; among equal times the
    greater hash, so that the result does not depend on row order, and null times come first. Rows without
    delivery or key (null, or only white space) are not compared. The first delivery gives no row; an empty table
    gives an empty result. Extra columns are ignored, whatever they are called.
    """
    slim = rows.select(
        trimmed(F.col(delivery)).alias("__d"),
        trimmed(F.col(key)).alias("__k"),
        F.struct(F.coalesce(F.col(loaded).cast("timestamp").cast("double"), F.lit(float("-inf"))).alias("t"), row_hash(values).alias("h")).alias("__v"),
    ).where("__d <> '' and __k <> ''")
    days = rows.select(trimmed(F.col(delivery)).alias("__d")).where("__d <> ''").distinct()  # one row per delivery
    order = Window.orderBy("__d")
    steps = days.select("__d", F.lead("__d").over(order).alias("__next"), F.lag("__d").over(order).alias("__prev"))
    # Per delivery at most two rows: (comparison it ends, side 1) and (comparison it begins, side 0).
    sides = steps.select("__d", F.explode(F.array(F.struct(F.when(F.col("__prev").isNotNull(), F.col("__d")).alias("step"), F.lit(1).alias("side")), F.struct(F.col("__next").alias("step"), F.lit(0).alias("side")))).alias("s")).select("__d", "s.step", "s.side").where("step is not null")
    tagged = slim.join(F.broadcast(sides), "__d")  # as many rows as deliveries, twice
    both = tagged.groupBy("step", "__k").agg(F.max(F.when(F.col("side") == 0, F.col("__v"))).alias("old"), F.max(F.when(F.col("side") == 1, F.col("__v"))).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.h") != F.col("new.h"), "changed")
    return both.select(F.col("step").alias("snapshot_date"), F.col("__k").alias("record_key"), kind.alias("change_type")).where("change_type is not null")


_NUMERIC = ("latitude", "longitude", "population", "elevation", "dem")
_UNCOMPARED = ("snapshot_date", "loaded_at", "modification_date", "geonameid", "alternatenames", *_NUMERIC)


def gazetteer_changes(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Changes of the gazetteer deliveries by geonameid; ``fields`` are its columns in order."""
    texts = [trimmed(F.col(f)) for f in fields if f not in _UNCOMPARED]
    values = [*texts, *(as_number(F.col(f)) for f in _NUMERIC), as_name_set(F.col("alternatenames"))]
    return snapshot_changes(rows, "snapshot_date", "geonameid", "loaded_at", values)


def manifest_changes(rows: DataFrame) -> DataFrame:
    """Changes of the source files by filename: the payload hash, trimmed and lower-cased."""
    return snapshot_changes(rows, "source_cutoff", "filename", "retrieved_at_utc", [F.lower(trimmed(F.col("payload_sha256")))])
