"""Queries on the deliveries, raw lines and places of the data directory, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylake.operators import raw_lines, snapshot_diff, spatial
from waylake.session import cut, table

NEAR_KM = 2.0


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of both raw tables that do not load, with the first reason."""
    gazetteer = raw_lines.rejected(table(spark, root, "gazetteer_lines"), raw_lines.GAZETTEER)
    return gazetteer.unionByName(raw_lines.rejected(table(spark, root, "report_lines"), raw_lines.REPORT)).distinct()


def p2_gazetteer_rows(spark: SparkSession, root: str) -> DataFrame:
    """Valid gazetteer lines as typed rows."""
    rows = raw_lines.gazetteer_rows(table(spark, root, "gazetteer_lines"))
    return rows.select("line_id", F.col("geonameid").cast("string").alias("geonameid"), "name", "latitude", "longitude", F.col("population").cast("string").alias("population"), "modification_date")


def p2_report_rows(spark: SparkSession, root: str) -> DataFrame:
    """Valid report lines as typed rows."""
    rows = raw_lines.report_rows(table(spark, root, "report_lines"))
    return rows.withColumn("row_count", F.col("row_count").cast("string"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """What each delivery of the gazetteer and of the manifest changed against the one before it."""
    gazetteer = snapshot_diff.gazetteer_changes(table(spark, root, "gazetteer_snapshot"), raw_lines.GAZETTEER_FIELDS)
    manifest = snapshot_diff.manifest_changes(table(spark, root, "source_manifest"))
    return gazetteer.select(F.lit("gazetteer").alias("feed"), "*").unionByName(manifest.select(F.lit("manifest").alias("feed"), "*"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Places at most 2 km from a centre, and survey regions that contain a place."""
    places = cut(spatial.located(table(spark, root, "cn_inventory"), "geonameid"))  # coordinates are read from text once
    centres = spatial.located(table(spark, root, "cn_legal_city_centers"), "administrative_code").distinct()
    near = spatial.within_distance(places, centres, NEAR_KM).select(F.lit("near").alias("match_kind"), F.col("point_id").alias("geonameid"), F.col("centre_id").alias("code"))
    regions = table(spark, root, "survey_region").select(F.col("region_code").alias("code"), "boundary")
    within = spatial.containing_regions(places, regions).select(F.lit("within").alias("match_kind"), F.col("point_id").alias("geonameid"), "code")
    return near.distinct().unionByName(within)


_TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c)


_NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_matches({_trim(c)}, '{_NUM}') THEN '#' || CAST(CAST({_trim(c)} AS DOUBLE) + 0.0 AS VARCHAR) ELSE {_trim(c)} END"


def _changes_sql(source: str, delivery: str, key: str, loaded: str, values: list[str]) -> str:
    listed = ", ".join(values)
    return f"""
    (WITH held AS (
        SELECT {delivery} AS d, {key} AS k, [{listed}] AS v FROM {source}
        QUALIFY row_number() OVER (PARTITION BY {delivery}, {key} ORDER BY {loaded} DESC) = 1),
      days AS (SELECT d, lead(d) OVER (ORDER BY d) AS nxt FROM (SELECT DISTINCT d FROM held)),
      later AS (SELECT * FROM held), earlier AS (SELECT days.nxt AS d, k, v FROM held JOIN days USING (d) WHERE nxt IS NOT NULL)
    SELECT coalesce(a.d, b.d) AS snapshot_date, coalesce(a.k, b.k) AS record_key,
           CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change_type
    FROM (SELECT * FROM later WHERE d > (SELECT min(d) FROM days)) a FULL JOIN earlier b ON a.d = b.d AND a.k = b.k
    WHERE b.k IS NULL OR a.k IS NULL OR a.v <> b.v)"""


def _p3_sql() -> str:
    numeric = ("latitude", "longitude", "population", "elevation", "dem")
    texts = [c for c in raw_lines.GAZETTEER_FIELDS if c not in ("geonameid", "modification_date", "alternatenames", *numeric)]
    names = f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({_trim('alternatenames')}, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''))), '|')"
    gazetteer = _changes_sql("gazetteer_snapshot", "snapshot_date", "geonameid", "loaded_at", [*map(_trim, texts), *map(_number, numeric), names])
    manifest = _changes_sql("source_manifest", "source_cutoff", "filename", "retrieved_at_utc", [f"lower({_trim('payload_sha256')})"])
    return f"SELECT 'gazetteer' AS feed, * FROM {gazetteer} UNION ALL SELECT 'manifest' AS feed, * FROM {manifest}"


_DAY_OK = "regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({0} AS DATE) IS NOT NULL AND {0} >= '0001'"
_DEC_OK = "regexp_full_match({0}, '-?[0-9]+([.][0-9]+)?') AND abs(try_cast({0} AS DOUBLE)) <= {1}"

_P2_SQL = f"""
WITH g AS (SELECT line_id, regexp_replace(regexp_replace(raw_line, '^' || chr(65279), ''), chr(13) || '$', '') AS t FROM gazetteer_lines),
g2 AS (SELECT line_id, string_split(t, chr(9)) AS f FROM g WHERE regexp_matches(t, '\\S')),
g3 AS (SELECT line_id, CASE WHEN len(f) <> 19 THEN 'column_count'
    WHEN NOT (regexp_full_match(f[1], '[0-9]+') AND {_DEC_OK.format('f[5]', 90)} AND {_DEC_OK.format('f[6]', 180)}
      AND regexp_full_match(f[15], '[0-9]*') AND {_DAY_OK.format('f[19]')}) THEN 'value' END AS reason FROM g2),
r AS (SELECT line_id, regexp_full_match(raw_line, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS ok,
    list_transform(regexp_extract_all(',' || raw_line, '(?s),(?:"(?:[^"]|"")*"|[^",]*)'), lambda x: CASE WHEN x[2:2] = '"' THEN replace(x[3:len(x) - 1], '""', '"') ELSE x[2:] END) AS f FROM report_lines),
r2 AS (SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 6 THEN 'column_count'
    WHEN NOT ({_DAY_OK.format('f[1]')} AND regexp_full_match(f[4], '[0-9]+') AND regexp_full_match(f[5], '[0-9A-Fa-f]{{64}}')) THEN 'value' END AS reason FROM r)
SELECT DISTINCT 'gazetteer_lines' AS raw_table, line_id, reason FROM g3 WHERE reason IS NOT NULL
UNION SELECT DISTINCT 'report_lines', line_id, reason FROM r2 WHERE reason IS NOT NULL"""


def _located(source: str, key: str) -> str:
    def c(name: str, most: int) -> str:
        t = rf"regexp_replace({name}, '^\s+|\s+$', '', 'g')"
        return f"CASE WHEN regexp_full_match({t}, '-?[0-9]+([.][0-9]+)?') AND abs(try_cast({t} AS DOUBLE)) <= {most} THEN CAST({t} AS DOUBLE) END"

    return f"(SELECT DISTINCT * FROM (SELECT {key} AS id, {c('longitude', 180)} AS lon, {c('latitude', 90)} AS lat FROM {source}) WHERE id IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL)"


_P5_SQL = f"""
WITH p AS {_located('cn_inventory', 'geonameid')}, c AS {_located('cn_legal_city_centers', 'administrative_code')},
poly AS (SELECT region_code, CASE WHEN boundary ->> '$.type' = 'Polygon' THEN [boundary -> '$.coordinates'] ELSE CAST(boundary -> '$.coordinates' AS JSON[]) END AS polygons FROM survey_region),
one AS (SELECT region_code, unnest(polygons) AS polygon, unnest(range(len(polygons))) AS part FROM poly),
ring AS (SELECT region_code, part, unnest(CAST(polygon AS DOUBLE[][][])) AS pts FROM one),
edge AS (SELECT region_code, part, unnest(list_zip(pts, list_concat(pts[2:], pts[1:1]))) AS e FROM ring),
e2 AS (SELECT region_code, part, e[1][1] AS xa, e[1][2] AS ya, e[2][1] AS xb, e[2][2] AS yb FROM edge),
hit AS (SELECT id, lon, lat, region_code, part, count(*) AS n FROM p JOIN e2 ON lon >= least(xa, xb) AND lon < greatest(xa, xb) AND ya + (yb - ya) * (lon - xa) / (xb - xa) <= lat GROUP BY ALL)
SELECT 'near' AS match_kind, p.id AS geonameid, c.id AS code FROM p JOIN c ON abs(p.lat - c.lat) <= 0.0181
WHERE 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) <= 2
UNION SELECT 'within', id, region_code FROM hit WHERE n % 2 = 1"""

QUERIES = {"p2_found": p2_found, "p2_gazetteer_rows": p2_gazetteer_rows, "p2_report_rows": p2_report_rows, "p3_found": p3_found, "p5_found": p5_found}
SQL = {"p2_found": _P2_SQL, "p3_found": _p3_sql(), "p5_found": _P5_SQL}
