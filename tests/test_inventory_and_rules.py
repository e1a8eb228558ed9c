"""Tiers, reductions, trees and rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from waylake.operators import inventory as inv
from waylake.operators import relational as rel
from waylake.operators import rules, trees
from waylake.plans import registry

TIERS = {"cities15000": [1], "cities5000": [1, 2], "cities1000": [1, 2, 3], "cities500": [1, 2, 3, 4]}


def tiers(spark, sets):
    rows = [(str(i), t, f"City {i}", "clash") for t, ids in sets.items() for i in ids]
    return spark.createDataFrame([*rows, (None, "cities500", "x", "")], "geonameid string, tier string, name string, assigned_phase string")


def test_nested_tiers(spark):
    m = inv.merge_tiers(tiers(spark, TIERS), "geonameid", "tier", ["name"])
    assert {r["geonameid"]: r["assigned_phase"] for r in m.collect()} == {"1": "cities15000", "2": "cities5000", "3": "cities1000", "4": "cities500"}
    assert m.where("n_versions > 1").count() == 0 and inv.nesting_violations(m).count() == 0
    pairs = {(r[0], r[1]): (r[2], r[3], r[4]) for r in inv.pairwise_overlap(m).collect()}
    assert pairs["cities15000", "cities500"] == (1, 0, 3) and len(pairs) == 6


def test_not_nested_and_conflicts(spark):
    df = tiers(spark, {"cities15000": [1], "cities5000": [], "cities1000": [], "cities500": []}).unionByName(tiers(spark, {"cities15000": [1]}).withColumn("name", F.lit("other")))
    m = inv.merge_tiers(df, "geonameid", "tier", ["name"])
    assert {(r["geonameid"], r["violation"]) for r in inv.nesting_violations(m).collect()} == {("1", "cities15000_not_in_cities5000"), ("1", "cities15000_not_in_cities500")}
    assert m.first()["n_versions"] == 2
    twice = inv.duplicate_keys(df, "geonameid").first()
    assert (twice["n_duplicated"], twice["least_keys"]) == (1, "1")
    assert inv.duplicate_keys(df.limit(0), "geonameid").first()["n_duplicated"] == 0


def test_reductions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 5, "z")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in rel.keep_one(df, ["k"], [F.col("n").desc_nulls_last() * 0 if False else -F.col("n")]).collect()} == {("a", "y"), ("b", None), (None, "z")}
    assert [tuple(r) for r in rel.zero_filled(df, "v", ["x", "q"]).collect()] == [(0, "x", 1), (1, "q", 0)]
    assert [tuple(r) for r in rel.pivot_counts(df, "k", "v", ["a", "c"], ["x", "y"]).collect()] == [("a", 1, 1, 2), ("c", 0, 0, 0)]
    assert df.select(rel.share(F.lit(1), F.lit(0)).alias("s")).first()["s"] == 0.0
    found, lost = rel.lookup(df.select("k", "n"), spark.createDataFrame([("a", 9)], "k string, extra int"), "k")
    assert found.count() == 4 and lost.count() == 2
    assert {tuple(r) for r in inv.set_difference(df.select("k").where("k is not null"), spark.createDataFrame([("b",), ("c",)], "k string"), "k").collect()} == {("a", "left"), ("c", "right")}
    first = rel.search_first(df, "Y", [["k"], ["k", "v"]], ["n"]).first()
    assert (first["k"], first["stage"]) == ("a", 1)
    pick = rel.random_pick(df.where("k is not null"), "k", 1, df.where("k = 'b'"))
    assert pick.first()["k"] == "b" and rel.random_pick(df.where("k = 'a'"), "k", 1, leave_out="a").count() == 0


def test_viewport_over_the_antimeridian(spark):
    p = spark.createDataFrame([("a", 179.5, 0.0), ("b", -179.5, 0.0), ("c", 0.0, 0.0)], "id string, lon double, lat double")
    assert {r["id"] for r in rel.in_viewport(p, 179.0, -1.0, -179.0, 1.0).collect()} == {"a", "b"}


TREE = {"status": 200, "data": {"code": "11", "name": "省", "level": 1, "type": "省", "children": [
    {"code": "1101", "name": "甲市", "level": 2, "type": "地级市", "children": [{"code": "110181", "name": "乙市", "level": 3, "type": "县级市", "children": None}, "bad"]},
    {"code": "1201", "name": "", "level": 3, "type": "地级市", "children": {}}]}}


def test_trees(spark):
    df = spark.createDataFrame([("11", json.dumps(TREE)), ("12", "{"), ("13", '{"status": 500}'), ("14", None)], "source string, payload string")
    nodes = trees.walk_json_trees(df)
    rows = {(r["source"], r["position"]): r for r in nodes.collect()}
    assert [rows["11", i]["code"] for i in range(3)] == ["11", "1101", "110181"] and rows["11", 2]["prefecture_code"] == "1101" and rows["11", 1]["prefecture_code"] is None
    assert rows["11", 3]["problem"] == "node_not_object" and rows["11", 4]["problem"] == "children_not_list"
    assert rows["12", 0]["problem"] == "invalid_json" and rows["13", 0]["problem"] == "status" and rows["14", 0]["problem"] == "invalid_json"
    cities = {r["administrative_code"]: r for r in trees.cities_of(nodes).collect()}
    assert cities["110100"]["city_level"] == "prefecture_level_city" and cities["110100"]["prefecture_name"] == "" and cities["110181"]["prefecture_name"] == "甲市"
    assert cities["120100"]["problem"] == "level" and cities["110100"]["problem"] is None


def test_edges(spark):
    e = spark.createDataFrame([("r", "r/a", "a"), ("r", "r/b", "b"), ("r/a", "r/a/c", "c")], "parent_key string, key string, child string")
    assert {(r["node"], r["depth"], r["path"]) for r in trees.walk_edges(e, "r").collect()} == {("r", 0, "r"), ("a", 1, "r/a"), ("b", 1, "r/b"), ("c", 2, "r/a/c")}


def test_rules(spark):
    df = spark.createDataFrame([("1", "5", "clash"), ("2", "x", ""), ("2", None, "")], "id string, n string, rule string")
    v = rules.gather(rules.check_rows(df, "id", [rules.Rule("digits", F.col("n").rlike("^[0-9]+$"), F.col("n"))]), rules.unique(df, "id", "unique"), rules.references(df, "id", "n", spark.createDataFrame([("5",)], "k string"), "k", "known"))
    assert sorted((r["rule"], r["record_key"]) for r in v.collect()) == [("digits", "2"), ("digits", "2"), ("known", "2"), ("known", "2"), ("unique", "2")]
    with pytest.raises(rules.RulesBroken, match="digits: 2"):
        rules.enforce(v)
    rules.enforce(v.limit(0))
    first = rules.first_in_order(df, ["id"], [F.col("n").asc_nulls_last()])
    assert {(r["id"], r["n"], r["is_repeated"]) for r in first.collect()} == {("1", "5", False), ("2", "x", True)}


def test_every_id_has_its_numeric_position(spark, tmp_path):
    rng = random.Random(3)
    ids = {str(rng.randrange(10 ** rng.randint(1, 25))) for _ in range(3000)} | {"007", "7", "0", "00", "9" * 19, "1" + "0" * 30}
    spark.createDataFrame([(i,) for i in [*ids, "7", None, "", "x1"]], "geonameid string").write.parquet(str(tmp_path / "cn_inventory.parquet"))
    got = {r["geonameid"]: r["position"] for r in registry.QUERIES["ord01_numeric_positions"](spark, str(tmp_path)).collect()}
    assert got == {x: n for n, x in enumerate(sorted(ids, key=lambda x: (int(x), x)), 1)}
