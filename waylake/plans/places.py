"""Queries on points: neighbours, viewports, search, clusters and projections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylake.functions import geo
from waylake.operators import relational, spatial
from waylake.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _places(spark, root):
    p = spatial.located(table(spark, root, "cn_inventory"), "geonameid")
    return p.groupBy("id").agg(F.min(F.struct("lon", "lat")).alias("p")).select("id", "p.lon", "p.lat")


def _centres(spark, root):
    p = spatial.located(table(spark, root, "cn_legal_city_centers"), "administrative_code")
    return p.groupBy("id").agg(F.min(F.struct("lon", "lat")).alias("p")).select("id", "p.lon", "p.lat")


def _located_sql(source: str, key: str) -> str:
    def c(name: str, most: int) -> str:
        t = rf"regexp_replace({name}, '^\s+|\s+$', '', 'g')"
        return f"CASE WHEN regexp_full_match({t}, '-?[0-9]+([.][0-9]+)?') AND abs(try_cast({t} AS DOUBLE)) <= {most} THEN CAST({t} AS DOUBLE) END"

    return f"(SELECT id, m.lon AS lon, m.lat AS lat FROM (SELECT id, min(struct_pack(lon := lon, lat := lat)) AS m FROM (SELECT {key} AS id, {c('longitude', 180)} AS lon, {c('latitude', 90)} AS lat FROM {source}) WHERE id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY id))"


_KM = "2 * 6371 * atan2(sqrt({h}), sqrt(1 - {h}))"


def _km(a: str, b: str) -> str:
    h = f"least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return _KM.format(h=h)


_I, _C = _located_sql("cn_inventory", "geonameid"), _located_sql("cn_legal_city_centers", "administrative_code")


@query("jn16_nearest_three", f"""WITH g AS (SELECT i.* FROM {_I} i WHERE id IN (SELECT geonames_id FROM guide_page)), c AS {_C},
d AS (SELECT c.id AS point_id, g.id AS target_id, {_km('c', 'g')} AS km FROM c, g)
SELECT point_id, target_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY km, target_id) AS INTEGER) AS "rank", round(km, 6) AS km FROM d QUALIFY "rank" <= 3""")
def jn16_nearest_three(spark, root):
    guided = table(spark, root, "guide_page").select(F.col("geonames_id").alias("id")).where("id is not null").distinct()
    targets = _places(spark, root).join(guided, "id", "left_semi")
    n = relational.nearest_k(_centres(spark, root), targets, 3, first_km=200.0)
    return n.select("point_id", "target_id", "rank", F.round("distance_km", 6).alias("km"))


@query("jn16_nearest_to_point", f"SELECT id, round({_km('q', 'i')}, 6) AS km FROM {_I} i, (SELECT 110.0 AS lon, 34.0 AS lat) q ORDER BY {_km('q', 'i')}, id LIMIT 5")
def jn16_nearest_to_point(spark, root):
    return relational.nearest_to(_places(spark, root), 110.0, 34.0, 5).select("id", F.round("distance_km", 6).alias("km"))


@query("flt07_viewport", f"SELECT id, lon, lat FROM {_I} WHERE lon BETWEEN 99.5 AND 110.5 AND lat BETWEEN 29.5 AND 40.5")
def flt07_viewport(spark, root):
    return relational.in_viewport(_places(spark, root), 100.0, 30.0, 110.0, 40.0, pad=0.5)


@query("flt08_scoped", f"SELECT c.id FROM {_C} c WHERE c.lon BETWEEN 100 AND 110 AND c.lat BETWEEN 30 AND 40 AND c.id IN (SELECT administrative_code FROM cn_legal_city_centers WHERE right(name, 1) = '市')")
def flt08_scoped(spark, root):
    scope = table(spark, root, "cn_legal_city_centers").where(F.col("name").endswith("市")).select(F.col("administrative_code").alias("id"))
    return relational.in_viewport(_centres(spark, root), 100.0, 30.0, 110.0, 40.0).join(scope, "id", "left_semi").select("id")


@query("flt10_search", "SELECT guide_id, city, CASE WHEN contains(lower(concat(coalesce(city, ''), coalesce(admin_area, ''))), '市') THEN 0 ELSE 1 END AS stage FROM guide_page WHERE contains(lower(concat(coalesce(city, ''), coalesce(admin_area, ''))), '市') OR contains(lower(coalesce(title, '')), '市') ORDER BY stage, guide_id LIMIT 1")
def flt10_search(spark, root):
    found = relational.search_first(table(spark, root, "guide_page"), "市", [["city", "admin_area"], ["title"]], ["guide_id"])
    return found.select("guide_id", "city", "stage")


_SIZE = 512 * 2**5


@query("mth04_mercator", f"SELECT id, round((lon / 360 + 0.5) * {_SIZE}, 6) AS x, round((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {_SIZE}, 6) AS y FROM {_I} WHERE abs(lat) < 85")
def mth04_mercator(spark, root):
    x, y = geo.mercator_pixel(F.col("lon"), F.col("lat"), 5)
    return _places(spark, root).where("abs(lat) < 85").select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_CELL = f"CAST(floor((lon / 360 + 0.5) * {_SIZE} / 42) AS BIGINT) AS cx, CAST(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * {_SIZE} / 42) AS BIGINT) AS cy"


@query("agg16_clusters", f"SELECT cx, cy, count(*) AS point_count, count(*) FILTER (g.geonames_id IS NULL) AS missing_count FROM (SELECT id, {_CELL} FROM {_I} WHERE abs(lat) < 85) i LEFT JOIN (SELECT DISTINCT geonames_id FROM guide_page) g ON g.geonames_id = i.id GROUP BY 1, 2")
def agg16_clusters(spark, root):
    g = table(spark, root, "guide_page").select(F.col("geonames_id").alias("id"), F.lit(True).alias("has")).where("id is not null").distinct()
    p = _places(spark, root).where("abs(lat) < 85").join(g, "id", "left")
    return relational.clusters(p, 5, missing=F.col("has").isNull()).select("cx", "cy", "point_count", "missing_count")


@query("agg17_expansion_zoom")
def agg17_expansion_zoom(spark, root):
    """For each cluster of zoom 3 the zoom at which it falls apart."""
    return relational.expansion_zoom(_places(spark, root).where("abs(lat) < 85"), 3)


@query("mth01_province_distances", f"WITH c AS {_C} SELECT a.id AS a, b.id AS b, round({_km('a', 'b')}, 6) AS km, '约 ' || CAST(CASE WHEN {_km('a', 'b')} < 20 THEN greatest(1, round({_km('a', 'b')})) WHEN {_km('a', 'b')} < 100 THEN round({_km('a', 'b')} / 5) * 5 ELSE round({_km('a', 'b')} / 10) * 10 END AS BIGINT) || ' km' AS shown FROM c a JOIN c b ON left(a.id, 4) = left(b.id, 4) AND a.id < b.id")
def mth01_province_distances(spark, root):
    """Distances of the centres whose codes share four digits, exact and as shown."""
    c = _centres(spark, root).withColumn("p4", F.left("id", F.lit(4)))
    a, b = c.select("p4", *(F.col(x).alias(f"a_{x}") for x in ("id", "lon", "lat"))), c.select("p4", *(F.col(x).alias(f"b_{x}") for x in ("id", "lon", "lat")))
    km = spatial.haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    return a.join(b, "p4").where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(km, 6).alias("km"), geo.distance_text(km).alias("shown"))


def _shift_sql() -> str:
    x, y = "(lon - 105)", "(lat - 35)"
    wave = lambda terms: " + ".join(f"2.0 / 3 * {a} * sin({x if v == 'x' else y} * {3.141592653589793 / d!r})" for a, v, d in terms)

    def poly(p: tuple) -> str:
        return f"{p[0]} + {p[1]} * {x} + {p[2]} * {y} + {p[3]} * {x} * {x} + {p[4]} * {y} * {y} + {p[5]} * {x} * {y} + {p[6]} * sqrt(abs({x}))"

    w = f"(1 - {geo.ECCENTRICITY2} * sin(radians(lat)) * sin(radians(lat)))"
    dlat = f"({poly(geo._LAT_POLY)} + {wave(geo._LAT_WAVES)}) * 180 / (pi() * {geo.SEMI_MAJOR} * (1 - {geo.ECCENTRICITY2}) / ({w} * sqrt({w})))"
    dlon = f"({poly(geo._LON_POLY)} + {wave(geo._LON_WAVES)}) * 180 / (pi() * {geo.SEMI_MAJOR} / sqrt({w}) * cos(radians(lat)))"
    return f"SELECT id, printf('%.6f', lon - {dlon}) AS lon6, printf('%.6f', lat - {dlat}) AS lat6 FROM {_C}"


@query("mth03_wgs84", _shift_sql())
def mth03_wgs84(spark, root):
    lon, lat = geo.gcj02_to_wgs84(F.col("lon"), F.col("lat"))
    return _centres(spark, root).select("id", F.format_string("%.6f", lon).alias("lon6"), F.format_string("%.6f", lat).alias("lat6"))


@query("mth05_styles", "SELECT geonameid, CASE WHEN p >= 100000 THEN 9.0 WHEN p >= 10000 THEN 6.0 WHEN p >= 1000 THEN 4.0 ELSE 2.0 END AS radius, CASE WHEN p <= 0 THEN 0.2 WHEN p < 50000 THEN 0.2 + p * (0.8 / 50000) ELSE 1.0 END AS opacity FROM (SELECT DISTINCT geonameid, coalesce(try_cast(population AS DOUBLE), 0) AS p FROM cn_inventory WHERE regexp_full_match(coalesce(population, ''), '[0-9]*'))")
def mth05_styles(spark, root):
    i = table(spark, root, "cn_inventory").where(F.coalesce("population", F.lit("")).rlike("^[0-9]*$")).select("geonameid", F.coalesce(F.col("population").try_cast("double"), F.lit(0.0)).alias("p")).distinct()
    return i.select("geonameid", geo.stepped(F.col("p"), 2.0, [(1000, 4.0), (10000, 6.0), (100000, 9.0)]).alias("radius"), geo.interpolated(F.col("p"), [(0.0, 0.2), (50000.0, 1.0)]).alias("opacity"))


@query("snk11_geojson", f"SELECT id, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || printf('%.6f', lon) || ',' || printf('%.6f', lat) || ']}}}}' AS feature FROM {_C}")
def snk11_geojson(spark, root):
    """Every centre as a GeoJSON feature."""
    return _centres(spark, root).select("id", F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%.6f,%.6f]}}', F.col("lon"), F.col("lat")).alias("feature"))
