"""Trees: nested JSON of administrative units, and parent-child tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylake.session import cut

# Node types that are cities, and the level each must have.
CITY_TYPES = {"直辖市": ("direct_municipality", 1), "地级市": ("prefecture_level_city", 2), "县级市": ("county_level_city", 3)}

NODE = "source string, position int, code string, name string, level int, type string, parent_code string, prefecture_code string, prefecture_name string, depth int, problem string"


def walk_json_trees(sources: DataFrame) -> DataFrame:
    """Every node of each tree in pre-order, with its parent and its nearest ancestor of level 2.

    ``sources`` is source, payload (JSON text: ``{"status": 200, "data": {"code", "name", "level", "type",
    "children"}}``). A payload that is no such tree gives one row with a problem; so does a node that is no object or
    whose children are no list. Null children are none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODE.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for source, payload in zip(pdf["source"], pdf["payload"]):
                rows += _tree_rows(source, payload)
            yield pd.DataFrame(rows, columns=names)

    return sources.select("source", "payload").mapInPandas(run, NODE)


def _tree_rows(source: str, payload: str | None) -> list[tuple]:
    def failed(problem: str) -> list[tuple]:
        return [(source, 0, None, None, None, None, None, None, None, 0, problem)]

    try:
        document = json.loads(payload or "")
    except ValueError:
        return failed("invalid_json")
    if not isinstance(document, dict) or document.get("status") != 200:
        return failed("status")
    rows: list[tuple] = []
    # A stack instead of recursion: trees may be deep. Entries: node, parent's code, level-2 ancestor, depth.
    stack: list[tuple] = [(document.get("data"), None, (None, None), 0)]
    while stack:
        node, parent, prefecture, depth = stack.pop()
        if not isinstance(node, dict):
            rows.append((source, len(rows), None, None, None, None, parent, *prefecture, depth, "node_not_object"))
            continue
        children = node.get("children")
        level = node.get("level") if isinstance(node.get("level"), int) and not isinstance(node.get("level"), bool) else None
        problem = None if children is None or isinstance(children, list) else "children_not_list"
        code, name = (None if node.get(k) is None else str(node[k]) for k in ("code", "name"))
        rows.append((source, len(rows), code, name, level, None if node.get("type") is None else str(node["type"]), parent, *prefecture, depth, problem))
        below = (code, name) if level == 2 else prefecture
        if isinstance(children, list):
            stack += [(c, code, below, depth + 1) for c in reversed(children)]
    return rows


def cities_of(nodes: DataFrame) -> DataFrame:
    """The nodes that are cities, with their kind and, if they break a rule, the problem.

    Codes are filled up with zeros to six digits. Rules: the level of the kind, a name, a code within the province
    (the source), no other city with the code.
    """
    from pyspark.sql.window import Window

    from waylake.functions.text import padded_code

    kinds = F.create_map(*(F.lit(x) for k, (v, _) in CITY_TYPES.items() for x in (k, v)))
    levels = F.create_map(*(F.lit(x) for k, (_, v) in CITY_TYPES.items() for x in (k, v)))
    c = nodes.withColumn("city_level", kinds[F.col("type")]).where("city_level is not null").withColumn("administrative_code", padded_code(F.col("code")))
    several = F.count("*").over(Window.partitionBy("administrative_code")) > 1
    problem = (
        F.when(F.col("level") != levels[F.col("type")], "level").when(F.coalesce(F.trim("name"), F.lit("")) == "", "name").when(F.col("administrative_code").isNull(), "code")
        .when(~F.col("administrative_code").startswith(F.col("source")), "prefix").when(several, "duplicate")
    )
    return c.select("administrative_code", "name", "city_level", F.col("type").alias("source_type"), F.col("source").alias("province"), F.coalesce("prefecture_code", F.lit("")).alias("prefecture_administrative_code"), F.coalesce("prefecture_name", F.lit("")).alias("prefecture_name"), problem.alias("problem"))


def walk_edges(edges: DataFrame, root: str) -> DataFrame:
    """node, depth, path of all nodes below ``root``, however deep; ``edges`` is parent_key, key, child.

    A level is one join; the levels' tables are cut from their lineage, so depth does not deepen the plan. An edge back
    to a node above is not followed, so a walk over edges with a circle ends too.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("parent_key", F.col("key").alias("below"), "child"))
    level = spark.createDataFrame([(root, root, root, [root])], "key string, node string, path string, above array<string>")
    out = level.select("node", F.lit(0).alias("depth"), "path")
    depth = 0
    while not level.isEmpty():
        depth += 1
        met = level.join(edges, (level["key"] == edges["parent_key"]) & ~F.array_contains("above", F.col("below")))
        level = cut(met.select(F.col("below").alias("key"), F.col("child").alias("node"), F.concat("path", F.lit("/"), "child").alias("path"), F.concat("above", F.array("below")).alias("above")))
        out = out.unionByName(level.select("node", F.lit(depth).alias("depth"), "path"))
    return out
