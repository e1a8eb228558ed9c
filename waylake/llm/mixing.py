"""Mixing sources to target shares of all tokens, with a cap on repeats.

Documents of a source are put in blocks by a hash, which is a random order. A mix draws every block as often as
whole passes over the source fit its quota, and then blocks in an order of the mix's own until the quota is
reached; the block that would overshoot is drawn in part, up to the document nearest the quota. A splitting tree
hands the exact numbers of drawn blocks to the output shards: each node gives its left half a multivariate
hypergeometric draw of its blocks, so that shards are as mixed as if all blocks had been shuffled, without any
shuffle of the whole. The driver splits only the top of the tree; its subtrees are split in tasks. Each shard is then
permuted by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waylake.llm.tokens import VOCABULARY, token_count
from waylake.session import cut, spread


def sized_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of the documents that have a source and at least one token, cut from its lineage."""
    docs = documents.select(F.col("doc_id").cast("bigint"), F.trim("source").alias("source"), "text").where("doc_id is not null and source <> '' and text is not null")
    # Texts are read once and counted in small tasks, whatever the files' size.
    return cut(spread(docs).select("doc_id", "source", token_count(F.col("text"), path).alias("n_tokens")).where("n_tokens > 0"))


def mix_plan(totals: dict[str, tuple[int, int]], targets: list[tuple[str, str, float, int]]) -> list[dict]:
    """Quota of each (mix, source): the largest mix in which no source is used more than its cap.

    ``totals`` has tokens and documents by source. Sources of share 0 are not drawn; sources without documents
    can't be, and the others then keep their proportions among themselves.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        own = {s: (share or 0.0, max(0, int(repeats or 0))) for m, s, share, repeats in sorted(targets) if m == mix}
        usable = {s: share for s, (share, repeats) in own.items() if share > 0 and repeats > 0 and totals.get(s, (0, 0))[0] > 0}
        whole = sum(usable.values())
        size = min((totals[s][0] * own[s][1] / (share / whole) for s, share in usable.items()), default=0.0)
        for s, (share, repeats) in own.items():
            quota = usable[s] / whole * size if s in usable else 0.0
            tokens = totals.get(s, (0, 0))[0]
            passes = min(int(quota / tokens + 1e-9), repeats) if tokens else 0
            out.append({"mix_name": mix, "source": s, "target_share": share, "max_repeats": repeats, "quota": quota, "passes": passes, "rest": max(0.0, quota - passes * tokens) if passes < repeats else 0.0})
    return out


#: Above so many blocks a node is halved in proportion: numpy draws from at most 10**9, and chance is negligible there.
MOST_DRAWN = 900_000_000


def _left_half(have: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """How many of a node's blocks of each source go to the left half of its shards ``lo`` to ``hi`` (exclusive)."""
    mid, total = (lo + hi) // 2, int(have.sum())
    take = round(total * (mid - lo) / (hi - lo))
    if not total:
        return have
    if total <= MOST_DRAWN:
        return np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals")
    exact = have * (take / total)
    left = np.floor(exact).astype(np.int64)
    for i in np.argsort(left - exact, kind="stable")[: take - int(left.sum())]:
        left[i] += 1
    return left


def _split(nodes: list[tuple[int, int, np.ndarray, np.ndarray]], seed: int, shards: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The nodes (lo, hi, blocks of each source, ranks where they begin) below ``nodes`` that have at most ``shards`` shards."""
    todo = list(reversed(nodes))
    while todo:
        lo, hi, have, first = todo.pop()
        if hi - lo <= shards:
            yield lo, hi, have, first
            continue
        mid, left = (lo + hi) // 2, _left_half(have, lo, hi, seed)
        todo += [(mid, hi, have - left, first + left), (lo, mid, left, first)]


def splitting_tree(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source every shard gets; columns add up to ``blocks`` exactly."""
    have = np.asarray(blocks, dtype=np.int64)
    return np.stack([own for _, _, own, _ in _split([(0, shards, have, np.zeros_like(have))], seed, 1)])


#: The driver splits the tree into at most about so many nodes a mix; tasks go on from there.
TOP_NODES = 512


def shard_ranks(spark: SparkSession, numbers: dict[tuple[str, str], int], shards: dict[str, int], seed: int) -> DataFrame:
    """mix_name, source, shard, lo, hi: the ranks of drawn blocks (both ends included) that each shard gets.

    ``numbers`` has the drawn blocks by mix and source, ``shards`` the number of shards by mix.
    """
    top = []
    for i, mix in enumerate(sorted(shards)):
        sources = sorted(s for m, s in numbers if m == mix)
        have = np.array([numbers[mix, s] for s in sources], dtype=np.int64)
        for lo, hi, own, first in _split([(0, shards[mix], have, np.zeros_like(have))], seed + i, max(1, math.ceil(shards[mix] / TOP_NODES))):
            top.append((mix, seed + i, sources, lo, hi, own.tolist(), first.tolist()))
    schema = "mix_name string, seed bigint, sources array<string>, lo bigint, hi bigint, have array<bigint>, first array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = []
                for shard, _, own, first in _split([(int(r.lo), int(r.hi), np.asarray(r.have), np.asarray(r.first))], int(r.seed), 1):
                    rows += [(r.mix_name, s, shard, int(f), int(f + n - 1)) for s, n, f in zip(r.sources, own, first) if n]
                yield pd.DataFrame(rows, columns=["mix_name", "source", "shard", "lo", "hi"])

    return spark.createDataFrame(top, schema).mapInPandas(run, "mix_name string, source string, shard int, lo bigint, hi bigint")


def _running(rows: DataFrame, keys: list[str], order: list[Column], weight: Column, name: str, buckets: Column) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over all rows before each one of its keys, in the order of a hash.

    The hash's range is cut into ``buckets`` buckets; sums are made within a bucket, and over the few buckets before
    it, so that no task sorts all rows of a key.
    """
    place = F.floor(F.shiftrightunsigned(order[0], 12).cast("double") / float(1 << 52) * buckets)
    rows = rows.withColumn("_bucket", place).withColumn("_weight", weight)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_all"))
    # ``order[0]`` is compared as its unsigned number, as the buckets are.
    by_hash = [F.shiftrightunsigned(order[0], 1), *order]
    earlier = sums.withColumn("_before", F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    own = F.coalesce(F.sum("_weight").over(Window.partitionBy(*keys, "_bucket").orderBy(*by_hash).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(earlier, [*keys, "_bucket"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_weight", "_own", "_before")


def draw_mixes(sized: DataFrame, targets: DataFrame, block_tokens: int = 20_000, shard_tokens: int = 5_000_000, bucket_blocks: int = 100_000, seed: int = 42) -> DataFrame:
    """mix_name, shard, position, source, doc_id, copy, n_tokens: every draw of every mix.

    ``sized`` is doc_id, source, n_tokens; ``targets`` mix_name, source, target_share, max_repeats. A block has about
    ``block_tokens`` (more only if single documents have), a shard about ``shard_tokens``; blocks are ranked in buckets
    of about ``bucket_blocks``. Only counts of named sources reach the driver. No document is drawn more often than its
    source's ``max_repeats`` in a mix. Empty tables give an empty result.
    """
    spark = sized.sparkSession
    totals = {r["source"]: (int(r["t"]), int(r["n"])) for r in sized.join(targets.select(F.trim("source").alias("source")).distinct(), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}  # one row per named source
    wanted = targets.select("mix_name", F.trim("source").alias("source"), "target_share", "max_repeats").where("mix_name is not null and source is not null")
    plan = [p for p in mix_plan(totals, [tuple(r) for r in wanted.groupBy("mix_name", "source").agg(F.sum("target_share"), F.max("max_repeats")).collect()]) if p["quota"] > 0]
    schema = "mix_name string, shard int, position bigint, source string, doc_id bigint, copy int, n_tokens bigint"
    if not plan:
        return spark.createDataFrame([], schema)
    count = [(s, math.ceil(t / block_tokens)) for s, (t, _) in totals.items()]
    sizes = F.broadcast(spark.createDataFrame(count, "source string, n_blocks bigint"))  # one row per named source
    share = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12).cast("double")) / float(1 << 52)
    docs = sized.join(sizes, "source").select("source", F.floor(share * F.col("n_blocks")).alias("block"), "doc_id", "n_tokens")
    stats = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    quotas = F.broadcast(spark.createDataFrame([(p["mix_name"], p["source"], p["passes"], float(p["rest"])) for p in plan], "mix_name string, source string, passes int, rest double"))
    buckets = F.ceil(F.col("n_blocks") / bucket_blocks)
    every = stats.join(quotas, "source").join(sizes, "source")
    before = _running(every, ["mix_name", "source"], [F.xxhash64(F.lit(seed), "mix_name", "source", "block"), F.col("block")], F.col("block_tokens"), "before", buckets)
    blocks = cut(before.withColumn("room", F.col("rest") - F.col("before")).select("mix_name", "source", "block", "block_tokens", "passes", "room", "n_blocks"))
    # A drawn block: its pass, and the tokens to take from it if not all.
    whole = blocks.select("mix_name", "source", "block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("copy"), F.lit(None).cast("double").alias("room"), "n_blocks").where("passes > 0")
    more = blocks.where("room > 0").select("mix_name", "source", "block", (F.col("passes") + 1).alias("copy"), F.when(F.col("room") < F.col("block_tokens"), F.col("room")).alias("room"), "n_blocks")
    drawn = cut(_running(whole.unionByName(more), ["mix_name", "source"], [F.xxhash64(F.lit(seed + 1), "mix_name", "source", "block", "copy"), F.col("block"), F.col("copy")], F.lit(1), "rank", buckets).drop("n_blocks"))
    numbers = {(r["mix_name"], r["source"]): int(r["count"]) for r in drawn.groupBy("mix_name", "source").count().collect()}  # one row per target
    shards = {mix: max(1, math.ceil(sum(p["quota"] for p in plan if p["mix_name"] == mix) / shard_tokens)) for mix in {m for m, _ in numbers}}
    ranks = shard_ranks(spark, numbers, shards, seed).select("mix_name", "source", "shard", F.explode(F.sequence("lo", "hi")).alias("rank"))
    units = drawn.join(ranks, ["mix_name", "source", "rank"])
    draws = docs.join(units, ["source", "block"])
    entire = draws.where("room is null").drop("room")
    in_block = Window.partitionBy("mix_name", "source", "block", "copy").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    partial = draws.where("room is not null").withColumn("upto", F.sum("n_tokens").over(in_block)).where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("room")).drop("room", "upto")
    local = Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "mix_name", "shard", "doc_id", "copy"), "doc_id", "copy")
    return entire.unionByName(partial).select("mix_name", "shard", F.row_number().over(local).cast("bigint").alias("position"), "source", "doc_id", "copy", "n_tokens")


def mix_report(draws: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, max_repeats, n_docs, n_draws, most_repeats, n_tokens, actual_share.

    One row for each target, also for sources of which nothing is drawn.
    """
    per_doc = draws.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("times"), F.sum("n_tokens").alias("n_tokens"))
    got = per_doc.groupBy("mix_name", "source").agg(F.count("*").alias("n_docs"), F.sum("times").alias("n_draws"), F.max("times").alias("most_repeats"), F.sum("n_tokens").alias("n_tokens"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", F.trim("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(got, ["mix_name", "source"], "left").na.fill(0, ["n_docs", "n_draws", "most_repeats", "n_tokens"])
    return both.withColumn("actual_share", F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0)))
