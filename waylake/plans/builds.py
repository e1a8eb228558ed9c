"""Queries of builds: expected values, reports, references between tables, paths and serialisation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waylake.functions import text
from waylake.operators import builds, relational
from waylake.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_STATS = "SELECT snapshot_date AS dataset, count(*) AS n_rows, count(DISTINCT geonameid) AS n_ids, max(feature_code) AS last_code FROM gazetteer_snapshot WHERE snapshot_date IS NOT NULL GROUP BY 1"
CHECKS = ["n_rows", "n_ids", "last_code"]


def _stats(spark, root):
    g = table(spark, root, "gazetteer_snapshot").where("snapshot_date is not null")
    return g.groupBy(F.col("snapshot_date").alias("dataset")).agg(F.count("*").alias("n_rows"), F.count_distinct("geonameid").alias("n_ids"), F.max("feature_code").alias("last_code"))


@query("dq05_delivery_checks", f"""WITH s AS ({_STATS}), l AS (SELECT dataset, "check", value FROM (SELECT dataset, n_rows::VARCHAR AS n_rows, n_ids::VARCHAR AS n_ids, last_code FROM s) UNPIVOT (value FOR "check" IN (n_rows, n_ids, last_code))),
e AS (SELECT n.dataset, l."check", l.value FROM l JOIN (SELECT dataset, lag(dataset) OVER (ORDER BY dataset) AS before FROM s) n ON n.before = l.dataset)
SELECT e.dataset, e."check", e.value AS expected, l.value AS actual, 'differs' AS problem FROM e JOIN l USING (dataset, "check") WHERE lower(e.value) <> lower(l.value)""")
def dq05_delivery_checks(spark, root):
    """Each delivery against the figures of the one before: every figure that differs."""
    stats = _stats(spark, root)
    order = stats.select("dataset", F.lag("dataset").over(Window.orderBy("dataset")).alias("before"))  # one row a delivery
    actual = builds.long_form(stats, "dataset", CHECKS)
    expected = actual.withColumnRenamed("dataset", "before").join(order, "before").select("dataset", "check", "value")
    return builds.mismatches(expected, actual, CHECKS)


@query("dq04_boundary_shapes", """SELECT region_code, json_valid(boundary) AND json_type(boundary) = 'OBJECT' AS is_object, json_exists(boundary, '$.type') AS has_type, coalesce(json_type(boundary, '$.coordinates') = 'ARRAY', false) AS has_coordinates FROM survey_region""")
def dq04_boundary_shapes(spark, root):
    """Whether each boundary is a JSON object with the required keys."""
    v = F.try_parse_json("boundary")
    kind = lambda path: F.try_variant_get(v, path, "string")
    return table(spark, root, "survey_region").select("region_code", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"), kind("$.type").isNotNull().alias("has_type"), F.coalesce(F.schema_of_variant(F.expr("try_variant_get(try_parse_json(boundary), '$.coordinates', 'variant')")).startswith("ARRAY"), F.lit(False)).alias("has_coordinates"))


@query("rpt01_build_report", """SELECT (SELECT count(DISTINCT snapshot_date) FROM gazetteer_snapshot) AS n_sources, (SELECT count(*) FROM gazetteer_snapshot) AS n_source_rows, (SELECT count(DISTINCT geonameid) FROM cn_inventory) AS n_inventory,
(SELECT count(DISTINCT geonameid) FROM cn_inventory WHERE in_cities15000 = 'true') AS n_cities15000, (SELECT count(DISTINCT geonameid) FROM cn_inventory WHERE in_cities500 = 'true') AS n_cities500""")
def rpt01_build_report(spark, root):
    """One row: sources, their rows, places of the inventory and of its outer tiers."""
    g = table(spark, root, "gazetteer_snapshot").agg(F.count_distinct("snapshot_date").alias("n_sources"), F.count("*").alias("n_source_rows"))
    member = lambda tier: F.count_distinct(F.when(F.col(f"in_{tier}") == "true", F.col("geonameid")))
    i = table(spark, root, "cn_inventory").agg(F.count_distinct("geonameid").alias("n_inventory"), member("cities15000").alias("n_cities15000"), member("cities500").alias("n_cities500"))
    return g.crossJoin(F.broadcast(i))  # one row each


@query("rpt02_cutoff_report", """SELECT source_cutoff, count(*) AS n_files, sum(payload_size_bytes) AS payload_bytes, sha256(string_agg(filename || ':' || sha, chr(10) ORDER BY filename || ':' || sha)) AS content_sha256
FROM (SELECT DISTINCT source_cutoff, filename, lower(trim(payload_sha256)) AS sha, payload_size_bytes FROM source_manifest WHERE filename IS NOT NULL AND payload_sha256 IS NOT NULL) GROUP BY 1""")
def rpt02_cutoff_report(spark, root):
    """Files, bytes and one hash over the sorted file hashes of each cutoff (a cutoff has some hundred files)."""
    m = table(spark, root, "source_manifest").where("filename is not null and payload_sha256 is not null").select("source_cutoff", "filename", F.lower(F.trim("payload_sha256")).alias("sha"), "payload_size_bytes").distinct()
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "filename", "sha"))), "\n")
    return m.groupBy("source_cutoff").agg(F.count("*").alias("n_files"), F.sum("payload_size_bytes").alias("payload_bytes"), F.sha2(lines, 256).alias("content_sha256"))


@query("rpt06_sync_counts", """SELECT count(DISTINCT guide_id) AS n_guides, count(DISTINCT admin_area) AS n_areas, count(DISTINCT guide_id) FILTER (EXISTS (SELECT 1 FROM place_queue q WHERE q.geonameid = g.geonames_id)) AS n_queued, count(DISTINCT guide_id) FILTER (NOT EXISTS (SELECT 1 FROM place_queue q WHERE q.geonameid = g.geonames_id)) AS n_unqueued FROM guide_page g""")
def rpt06_sync_counts(spark, root):
    """Guides, their areas, and how many of them are queued."""
    queued = table(spark, root, "place_queue").select(F.col("geonameid").alias("geonames_id"), F.lit(True).alias("queued")).where("geonames_id is not null").distinct()
    g = table(spark, root, "guide_page").select("guide_id", "admin_area", "geonames_id").join(queued, "geonames_id", "left")
    return g.agg(F.count_distinct("guide_id").alias("n_guides"), F.count_distinct("admin_area").alias("n_areas"), F.count_distinct(F.when(F.col("queued"), F.col("guide_id"))).alias("n_queued"), F.count_distinct(F.when(F.col("queued").isNull(), F.col("guide_id"))).alias("n_unqueued"))


_CENTRES = "(SELECT DISTINCT administrative_code, name, longitude, latitude, rpad(left(administrative_code, 2), 6, '0') AS code6 FROM cn_legal_city_centers WHERE administrative_code IS NOT NULL)"


def _centres(spark, root):
    return table(spark, root, "cn_legal_city_centers").where("administrative_code is not null").distinct().withColumn("code6", F.rpad(F.left("administrative_code", F.lit(2)), 6, "0"))


@query("jn03_queue_pages", "SELECT DISTINCT q.geonameid, q.target_page, g.guide_id FROM place_queue q LEFT JOIN (SELECT DISTINCT guide_id, geonames_id FROM guide_page) g ON 'destinations/cn/' || split_part(q.target_page, '/', 3) || '/' || g.geonames_id || '.md' = q.target_page WHERE q.target_page <> ''")
def jn03_queue_pages(spark, root):
    """The guide of each queued page by its path, null without one."""
    q = table(spark, root, "place_queue").where("target_page <> ''").select("geonameid", "target_page", F.regexp_extract("target_page", r"([^/]+)\.md$", 1).alias("geonames_id")).distinct()
    g = table(spark, root, "guide_page").select("guide_id", "geonames_id").distinct()
    found, _ = relational.lookup(q, g, "geonames_id")
    return found.select("geonameid", "target_page", "guide_id")


@query("jn04_centre_provinces", f"SELECT c.administrative_code, x.official_admin_name, x.official_code6 IS NULL AS is_missing FROM (SELECT DISTINCT administrative_code, code6 FROM {_CENTRES}) c LEFT JOIN (SELECT DISTINCT official_code6, official_admin_name FROM admin1_crosswalk) x ON x.official_code6 = c.code6")
def jn04_centre_provinces(spark, root):
    """The province of every centre by its code, and whether the crosswalk lacks it."""
    x = table(spark, root, "admin1_crosswalk").select(F.col("official_code6").alias("code6"), "official_admin_name").distinct()
    found, missing = relational.lookup(_centres(spark, root).select("administrative_code", "code6").distinct(), x, "code6", must_exist=True)
    return found.select("administrative_code", "official_admin_name", F.lit(False).alias("is_missing")).unionByName(missing.select("administrative_code", F.lit(None).cast("string").alias("official_admin_name"), F.lit(True).alias("is_missing")))


@query("jn05_queue_guides", "SELECT DISTINCT q.geonameid, q.batch, g.guide_id FROM place_queue q LEFT JOIN guide_page g ON g.geonames_id = nullif(q.geonameid, '')")
def jn05_queue_guides(spark, root):
    """Queue entries with the guide of their id; an empty id meets none."""
    q = table(spark, root, "place_queue").select("geonameid", "batch").distinct().withColumn("geonames_id", F.nullif("geonameid", F.lit("")))
    return q.join(table(spark, root, "guide_page").select("geonames_id", "guide_id").distinct(), "geonames_id", "left").select("geonameid", "batch", "guide_id")


@query("jn06_guides_not_queued", "SELECT DISTINCT guide_id FROM guide_page g WHERE NOT EXISTS (SELECT 1 FROM place_queue q WHERE q.geonameid = g.geonames_id)")
def jn06_guides_not_queued(spark, root):
    q = table(spark, root, "place_queue").select(F.col("geonameid").alias("geonames_id"))
    return table(spark, root, "guide_page").join(q, "geonames_id", "left_anti").select("guide_id").distinct()


@query("jn11_uncovered_pages", """SELECT DISTINCT guide_id, 'inventory' AS missing_in FROM guide_page g WHERE geonames_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cn_inventory i WHERE i.geonameid = g.geonames_id)
UNION ALL SELECT DISTINCT guide_id, 'queue' FROM guide_page g WHERE geonames_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM place_queue q WHERE q.geonameid = g.geonames_id)""")
def jn11_uncovered_pages(spark, root):
    """Pages whose place the inventory, or the queue, lacks."""
    g = table(spark, root, "guide_page").select("guide_id", "geonames_id").where("geonames_id is not null").distinct()
    lost = lambda name, label: relational.lookup(g, table(spark, root, name).select(F.col("geonameid").alias("geonames_id")), "geonames_id")[1].select("guide_id", F.lit(label).alias("missing_in")).distinct()
    return lost("cn_inventory", "inventory").unionByName(lost("place_queue", "queue"))


@query("jn12_missing_pages", """SELECT DISTINCT target_page FROM place_queue WHERE target_page <> '' AND target_page NOT IN (SELECT DISTINCT 'destinations/cn/' || i.admin1_code || '/' || g.geonames_id || '.md' FROM guide_page g JOIN cn_inventory i ON i.geonameid = g.geonames_id WHERE i.admin1_code IS NOT NULL)""")
def jn12_missing_pages(spark, root):
    """Target pages that are neither a page nor a directory of one; a page's path is that of its place."""
    i = table(spark, root, "cn_inventory").select(F.col("geonameid").alias("geonames_id"), "admin1_code").where("admin1_code is not null").distinct()
    paths = table(spark, root, "guide_page").select("geonames_id").distinct().join(i, "geonames_id").select(F.concat(F.lit("destinations/cn/"), "admin1_code", F.lit("/"), "geonames_id", F.lit(".md")).alias("path"))
    q = table(spark, root, "place_queue").where("target_page <> ''").select(F.col("target_page").alias("path")).distinct()
    return q.join(builds.with_parents(paths), "path", "left_anti").withColumnRenamed("path", "target_page")


@query("jn13_centre_province_set", """SELECT code, 'left' AS side FROM (SELECT DISTINCT left(administrative_code, 2) AS code FROM cn_legal_city_centers WHERE administrative_code IS NOT NULL) WHERE code NOT IN (SELECT province_code FROM source_manifest WHERE province_code IS NOT NULL)
UNION ALL SELECT code, 'right' FROM (SELECT DISTINCT province_code AS code FROM source_manifest WHERE province_code IS NOT NULL) WHERE code NOT IN (SELECT left(administrative_code, 2) FROM cn_legal_city_centers WHERE administrative_code IS NOT NULL)
UNION ALL SELECT code, 'both' FROM (SELECT DISTINCT province_code AS code FROM source_manifest WHERE province_code IS NOT NULL) WHERE code IN (SELECT left(administrative_code, 2) FROM cn_legal_city_centers WHERE administrative_code IS NOT NULL)""")
def jn13_centre_province_set(spark, root):
    """Provinces of the centres against those of the manifest: in which side each is."""
    left = _centres(spark, root).select(F.left("administrative_code", F.lit(2)).alias("code")).distinct().withColumn("l", F.lit(1))
    right = table(spark, root, "source_manifest").where("province_code is not null").select(F.col("province_code").alias("code")).distinct().withColumn("r", F.lit(1))
    return left.join(right, "code", "full").select("code", F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("side"))


@query("dq12_utf8", "SELECT 'guide_page' AS source_table, count(markdown) AS n_texts, 0::BIGINT AS n_invalid FROM guide_page UNION ALL SELECT 'gazetteer_lines', count(raw_line), 0 FROM gazetteer_lines")
def dq12_utf8(spark, root):
    """Texts and how many of them are no valid UTF-8."""
    parts = [table(spark, root, t).where(F.col(c).isNotNull()).agg(F.lit(t).alias("source_table"), F.count(c).alias("n_texts"), F.count_if(~F.is_valid_utf8(F.col(c))).alias("n_invalid")) for t, c in (("guide_page", "markdown"), ("gazetteer_lines", "raw_line"))]
    return parts[0].select("source_table", "n_texts", "n_invalid").unionByName(parts[1].select("source_table", "n_texts", "n_invalid"))


@query("dq19_link_targets")
def dq19_link_targets(spark, root):
    """Local links of pages with what they resolve to, and whether a queued page or a directory above one is there."""
    known = builds.with_parents(table(spark, root, "place_queue").select(F.col("target_page").alias("path"))).withColumn("exists", F.lit(True))
    pages = table(spark, root, "guide_page").where("markdown is not null").select("guide_id", "markdown").distinct()
    links = pages.select("guide_id", F.explode(text.local_links(F.col("markdown"))).alias("target")).where(~F.col("target").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|#|//)")).distinct()
    resolved = links.withColumn("path", text.resolved_path(text.percent_decoded(F.regexp_replace("target", "#.*$", ""))))
    return resolved.join(known, "path", "left").select("guide_id", "target", F.col("path").alias("resolved"), F.coalesce("exists", F.lit(False)).alias("is_there"))


@query("dq30_provinces_without_centre", """SELECT official_code6 FROM (SELECT DISTINCT official_code6 FROM admin1_crosswalk) WHERE official_code6 NOT IN (SELECT rpad(left(administrative_code, 4), 6, '0') FROM cn_legal_city_centers WHERE administrative_code IS NOT NULL)""")
def dq30_provinces_without_centre(spark, root):
    """Codes of the crosswalk that no centre's four-digit prefix, padded, gives."""
    held = _centres(spark, root).select(F.rpad(F.left("administrative_code", F.lit(4)), 6, "0").alias("official_code6"))
    return table(spark, root, "admin1_crosswalk").select("official_code6").distinct().join(held, "official_code6", "left_anti")


@query("flt04_required_centres", f"SELECT administrative_code, name FROM {_CENTRES} WHERE code6 IN (SELECT official_code6 FROM admin1_crosswalk) AND regexp_full_match(trim(longitude), '[+-]?[0-9]+(\\.[0-9]*)?') AND regexp_full_match(trim(latitude), '[+-]?[0-9]+(\\.[0-9]*)?')")
def flt04_required_centres(spark, root):
    """Centres of known provinces whose coordinates are finite numbers."""
    known = table(spark, root, "admin1_crosswalk").select(F.col("official_code6").alias("code6"))
    return _centres(spark, root).where(builds.is_number(F.col("longitude")) & builds.is_number(F.col("latitude"))).join(known, "code6", "left_semi").select("administrative_code", "name")


@query("agg19_names_of_many_codes", "SELECT name, count(DISTINCT administrative_code) AS n_codes, min(administrative_code) AS first_code FROM cn_legal_city_centers WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT administrative_code) > 1")
def agg19_names_of_many_codes(spark, root):
    """Names that are no key of the centres, with the first code of each."""
    c = table(spark, root, "cn_legal_city_centers").where("name <> ''").groupBy("name").agg(F.count_distinct("administrative_code").alias("n_codes"), F.min("administrative_code").alias("first_code"))
    return c.where("n_codes > 1")


@query("str28_safe_json", """SELECT DISTINCT guide_id, replace(replace(replace(to_json({'guide_id': guide_id, 'title': title, 'markup': '<b>' || coalesce(city, '') || '</b>'})::VARCHAR, '<', chr(92) || 'u003c'), chr(8232), chr(92) || 'u2028'), chr(8233), chr(92) || 'u2029') AS json FROM guide_page WHERE guide_id IS NOT NULL AND title IS NOT NULL""")
def str28_safe_json(spark, root):
    """Pages as JSON that may stand inside a script."""
    p = table(spark, root, "guide_page").where("guide_id is not null and title is not null")
    return p.select("guide_id", builds.safe_json(F.struct("guide_id", "title", F.concat(F.lit("<b>"), F.coalesce("city", F.lit("")), F.lit("</b>")).alias("markup"))).alias("json")).distinct()


@query("str30_ordinals", "SELECT administrative_code, CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS ordinal FROM (SELECT administrative_code, row_number() OVER (PARTITION BY left(administrative_code, 2) ORDER BY administrative_code) AS n FROM (SELECT DISTINCT administrative_code FROM cn_legal_city_centers WHERE administrative_code IS NOT NULL))")
def str30_ordinals(spark, root):
    """Each centre's number within its province, with two digits at least."""
    c = _centres(spark, root).select("administrative_code").distinct()
    n = F.row_number().over(Window.partitionBy(F.left("administrative_code", F.lit(2))).orderBy("administrative_code"))
    return c.select("administrative_code", builds.ordinal(n).alias("ordinal"))


@query("str31_links", r"""SELECT DISTINCT url, regexp_matches(url, '(?i)^https?://') AS is_external, CASE WHEN regexp_matches(regexp_replace(url, '^https?://[^/]+', ''), '^/[^/\\]') THEN regexp_replace(url, '^https?://[^/]+', '') ELSE '/' END AS return_path FROM source_manifest WHERE url IS NOT NULL""")
def str31_links(spark, root):
    """Whether links lead outside, and the path within the site that is safe to return to."""
    u = table(spark, root, "source_manifest").select("url").where("url is not null").distinct()
    return u.select("url", builds.is_external(F.col("url")).alias("is_external"), builds.safe_return_path(F.regexp_replace("url", "^https?://[^/]+", "")).alias("return_path"))


@query("ord02_code_positions", "SELECT administrative_code, row_number() OVER (PARTITION BY left(administrative_code, 2) ORDER BY administrative_code) AS position FROM (SELECT DISTINCT administrative_code FROM cn_legal_city_centers WHERE administrative_code IS NOT NULL)")
def ord02_code_positions(spark, root):
    """Codes in lexical order within each province."""
    c = _centres(spark, root).select("administrative_code").distinct()
    return c.select("administrative_code", F.row_number().over(Window.partitionBy(F.left("administrative_code", F.lit(2))).orderBy("administrative_code")).cast("bigint").alias("position"))


@query("ord05_path_positions", "SELECT target_page, row_number() OVER (PARTITION BY split_part(target_page, '/', 3) ORDER BY target_page) AS position FROM (SELECT DISTINCT target_page FROM place_queue WHERE target_page <> '')")
def ord05_path_positions(spark, root):
    """Paths in byte order within their directory."""
    p = table(spark, root, "place_queue").where("target_page <> ''").select("target_page").distinct()
    return p.select("target_page", F.row_number().over(Window.partitionBy(F.split_part("target_page", F.lit("/"), F.lit(3))).orderBy("target_page")).cast("bigint").alias("position"))


@query("ord06_stable_order", "SELECT batch, geonameid, target_page, row_number() OVER (PARTITION BY batch ORDER BY length(target_page), target_page, geonameid) AS position FROM (SELECT DISTINCT batch, geonameid, target_page FROM place_queue)")
def ord06_stable_order(spark, root):
    """Entries of a batch by the length of their path; ties keep the order of the input, here that of path and id."""
    q = table(spark, root, "place_queue").select("batch", "geonameid", "target_page").distinct()
    return q.select("*", F.row_number().over(Window.partitionBy("batch").orderBy(F.length("target_page").asc_nulls_last(), F.col("target_page").asc_nulls_last(), F.col("geonameid").asc_nulls_last())).cast("bigint").alias("position"))
