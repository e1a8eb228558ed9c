"""Core queries against their SQL in DuckDB, where the small test tables are there."""

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from waylake.plans import registry

ROOT = os.environ.get("WAYLAKE_TESTDATA", "/root/testdata/sf0.001")
NAMES = ["p2_found", "p3_found", "p5_found", "jn01_tier_merge", "agg03_pairwise_overlap", "agg11_coverage", "jn16_nearest_three", "mth03_wgs84", "src15_front_matter", "dq20_inventory_rules", "evt02_sessions", "hie01_admin_tree"]


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = registry.QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    result = con.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) == sum(len(m.QUERIES) for m in registry.MODULES)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_plans_read_only_what_they_need(spark):
    plan = registry.QUERIES["agg07_counts_by_type"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<admin1_code:string,feature_code:string>" in plan or "ReadSchema: struct<feature_code:string,admin1_code:string>" in plan
    plan = registry.QUERIES["flt06_researched"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(content_status), EqualTo(content_status,researched)]" in plan
