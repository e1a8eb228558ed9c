"""Column functions on edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from waylake.functions import dates, geo, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.wiki_links_as_text, "见 [[a/b.md|标签]]、![[图片/塔.MD]]、[[页#^ 节]] 与 [[x]]", "见 标签、塔、节 与 x"),
        (text.without_relative_links, "[a](b.md) ![i](p.png) [w](https://a.cn) [r](/x) [h](#y)", "a i [w](https://a.cn) [r](/x) [h](#y)"),
        (text.plain_summary, "**a** <br> `b` [c](d) ![e](f) <i>g</i>\\", "a b c e g"),
        (text.plain_card, "> - [x] **a** &amp;&nbsp;b\\", "a & b"),
        (text.plain_summary, "", ""), (text.plain_summary, None, None),
        (text.slug, "Ａ b!", "a-b"), (text.slug, "!!!", "section"), (text.matching_key, "**Ｃity** 速览！", "city速览"),
        (text.padded_code, "11", "110000"), (text.padded_code, "1100001", None), (text.padded_code, "1a", None),
        (text.suggested_stay, "> 建议停留：2–3 天\\\n> x", "2–3 天"), (text.suggested_stay, "| 建议停留 | **4 天** |", "4 天"), (text.suggested_stay, "x", ""), (text.suggested_stay, None, ""),
        (text.keywords, "> 旅行关键词：a、b， ,c", ["a", "b", "c"]), (text.keywords, "x", []),
        (text.first_prose, "# h\n\n> q\n\n| t |\n\n1. x\n\n**Text** here\nmore\n\nlater", "Text here more"), (text.first_prose, "# h", ""),
        (text.local_links, "[a](b) ![c](d)", ["b"]), (text.percent_decoded, "a+b%20c", "a+b c"), (text.percent_decoded, "%zz", None),
        (text.resolved_path, "a/./b/../c", "a/c"), (text.resolved_path, "a/../../c", None),
        (text.table_cells, "| a | b |", ["a", "b"]), (text.table_cells, "a | b", []), (text.table_cells, "|", []),
        (text.short_city, "东市区", "东市"), (dates.dotted, "2026-01-02", "2026.01.02"), (dates.dotted, "x", "x"), (dates.first_ten, None, ""),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_front_matter(spark):
    get = lambda v: one(spark, v, text.front_matter)
    assert get('---\na: "x"\nb: \'y\'\na: z\nno line\n---\nbody') == {"a": "z", "b": "y"}
    assert get("---\na: 1\n") is None and get("body") is None and get(None) is None


def test_web_links(spark):
    got = one(spark, '[a](https://x.cn "t") [b](http://y.cn) [c](https://x.cn) [d](ftp://z)', text.web_links)
    assert [(r["label"], r["href"]) for r in got] == [("a", "https://x.cn"), ("b", "http://y.cn")]


def test_dates(spark):
    assert str(one(spark, "2024-02-29", dates.iso_date)) == "2024-02-29"
    for bad in ("2026-02-30", "2026-2-3", "20260203", "", None):
        assert one(spark, bad, dates.iso_date) is None
    assert str(one(spark, "截至 2025年 1月31日", dates.chinese_date)) == "2025-01-31" and one(spark, "2025年13月1日", dates.chinese_date) is None


@pytest.mark.parametrize(("km", "want"), [(0.2, "约 1 km"), (19.4, "约 19 km"), (22.0, "约 20 km"), (97.6, "约 100 km"), (104.0, "约 100 km"), (106.0, "约 110 km")])
def test_distance_text(spark, km, want):
    assert one(spark, km, geo.distance_text, "double") == want


def test_projection_and_shift(spark):
    df = spark.createDataFrame([(116.404, 39.915)], "lon double, lat double")
    lon, lat = geo.gcj02_to_wgs84(F.col("lon"), F.col("lat"))
    x, y = geo.mercator_pixel(F.lit(0.0), F.lit(0.0), 0)
    r = df.select(lon.alias("a"), lat.alias("b"), x.alias("x"), y.alias("y")).first()
    assert math.isclose(r["a"], 116.39776, abs_tol=1e-4) and math.isclose(r["b"], 39.91360, abs_tol=1e-4) and (r["x"], r["y"]) == (256.0, 256.0)
    assert one(spark, 5.0, lambda c: geo.interpolated(c, [(0, 0.0), (10, 1.0)]), "double") == 0.5 and one(spark, 12.0, lambda c: geo.interpolated(c, [(0, 0.0), (10, 1.0)]), "double") == 1.0
    assert one(spark, 10.0, lambda c: geo.stepped(c, 1.0, [(10, 2.0), (20, 3.0)]), "double") == 2.0
