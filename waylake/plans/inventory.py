"""Queries on tiers, inventories, ledgers and their reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylake.functions import dates, text
from waylake.operators import inventory as inv
from waylake.operators import raw_lines, relational
from waylake.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_T = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"
_VALID = """(SELECT line_id, file_name, string_split(regexp_replace(regexp_replace(raw_line, '^' || chr(65279), ''), chr(13) || '$', ''), chr(9)) AS f FROM gazetteer_lines WHERE regexp_matches(raw_line, '[^\\s' || chr(65279) || ']')) AS raw"""
_OK = """len(f) = 19 AND regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[5], '-?[0-9]+([.][0-9]+)?') AND abs(try_cast(f[5] AS DOUBLE)) <= 90
 AND regexp_full_match(f[6], '-?[0-9]+([.][0-9]+)?') AND abs(try_cast(f[6] AS DOUBLE)) <= 180 AND regexp_full_match(f[15], '[0-9]*')
 AND regexp_full_match(f[19], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(f[19] AS DATE) IS NOT NULL"""


def _tier_rows(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "gazetteer_lines")
    rows = raw_lines.read_lines(lines, raw_lines.GAZETTEER).where("reason is null")
    return rows.join(lines.select("line_id", F.regexp_replace("file_name", r"\.txt$", "").alias("tier")), "line_id")


@query("src01_scan_statistics", f"""SELECT file_name, count(*) AS n_rows, count(DISTINCT f[1]) AS n_ids, count(*) - count(DISTINCT f[1]) AS n_repeated, count(*) FILTER (f[9] = 'CN') AS n_cn
FROM {_VALID} WHERE {_OK} GROUP BY file_name""")
def src01_scan_statistics(spark, root):
    rows = _tier_rows(spark, root)
    return rows.groupBy(F.concat("tier", F.lit(".txt")).alias("file_name")).agg(F.count("*").alias("n_rows"), F.count_distinct("geonameid").alias("n_ids"), (F.count("*") - F.count_distinct("geonameid")).alias("n_repeated"), F.count_if(F.col("country_code") == "CN").alias("n_cn"))


@query("jn01_tier_merge", f"""SELECT f[1] AS geonameid, max(file_name = 'cities15000.txt') AS in_cities15000, max(file_name = 'cities5000.txt') AS in_cities5000, max(file_name = 'cities1000.txt') AS in_cities1000,
 max(file_name = 'cities500.txt') AS in_cities500, CASE WHEN max(file_name = 'cities15000.txt') THEN 'cities15000' WHEN max(file_name = 'cities5000.txt') THEN 'cities5000' WHEN max(file_name = 'cities1000.txt') THEN 'cities1000' WHEN max(file_name = 'cities500.txt') THEN 'cities500' END AS assigned_phase,
 count(DISTINCT concat_ws(chr(1), f[2], f[5], f[6], f[15])) AS n_versions FROM {_VALID} WHERE {_OK} AND f[9] = 'CN' GROUP BY f[1]""")
def jn01_tier_merge(spark, root):
    cn = _tier_rows(spark, root).where("country_code = 'CN'")
    return inv.merge_tiers(cn, "geonameid", "tier", ["name", "latitude", "longitude", "population"]).drop("name", "latitude", "longitude", "population")


@query("agg02_duplicate_ids", f"""WITH d AS (SELECT f[1] AS k FROM {_VALID} WHERE {_OK} GROUP BY 1 HAVING count(*) > 1)
SELECT (SELECT count(*) FROM d) AS n_duplicated, (SELECT coalesce(string_agg(k, ',' ORDER BY CAST(k AS HUGEINT), k), '') FROM (SELECT k FROM d ORDER BY CAST(k AS HUGEINT), k LIMIT 10)) AS least_keys""")
def agg02_duplicate_ids(spark, root):
    return inv.duplicate_keys(_tier_rows(spark, root), "geonameid")


_FLAGS = "(SELECT geonameid, " + ", ".join(f"max(lower(trim({inv.flag(t)})) = 'true') AS {inv.flag(t)}" for t in inv.TIERS) + " FROM cn_inventory WHERE geonameid <> '' GROUP BY geonameid)"


def _pair_sql() -> str:
    parts = []
    for i, a in enumerate(inv.TIERS):
        for b in inv.TIERS[i + 1 :]:
            x, y = f"coalesce({inv.flag(a)}, false)", f"coalesce({inv.flag(b)}, false)"
            parts.append(f"SELECT '{a}' AS left_tier, '{b}' AS right_tier, count(*) FILTER ({x} AND {y}) AS n_both, count(*) FILTER ({x} AND NOT {y}) AS left_only, count(*) FILTER (NOT {x} AND {y}) AS right_only FROM {_FLAGS}")
    return " UNION ALL ".join(parts)


@query("agg03_pairwise_overlap", _pair_sql())
def agg03_pairwise_overlap(spark, root):
    return inv.pairwise_overlap(inv.with_flags(table(spark, root, "cn_inventory")))


def _nest_sql() -> str:
    pairs = [*zip(inv.TIERS, inv.TIERS[1:]), *((a, inv.TIERS[-1]) for a in inv.TIERS[:-2])]
    return " UNION ALL ".join(f"SELECT geonameid, '{a}_not_in_{b}' AS violation FROM {_FLAGS} WHERE {inv.flag(a)} AND NOT {inv.flag(b)}" for a, b in pairs)


@query("agg04_nesting_violations", _nest_sql())
def agg04_nesting_violations(spark, root):
    return inv.nesting_violations(inv.with_flags(table(spark, root, "cn_inventory")))


@query("agg05_is_nested", f"SELECT count(*) = 0 AS is_strictly_nested FROM ({_nest_sql()})")
def agg05_is_nested(spark, root):
    return agg04_nesting_violations(spark, root).agg((F.count("*") == 0).alias("is_strictly_nested"))


@query("prj01_public_columns", "SELECT DISTINCT geonameid, name, country_code, admin1_code, population FROM cn_inventory WHERE geonameid IS NOT NULL")
def prj01_public_columns(spark, root):
    return table(spark, root, "cn_inventory").select("geonameid", "name", "country_code", "admin1_code", "population").where("geonameid is not null").distinct()


@query("prj04_identifiers", "SELECT DISTINCT 'cn-' || geonameid AS guide_key, 'geonames:' || geonameid AS source_key, 'legal-' || c.administrative_code AS legal_key FROM place_queue q JOIN cn_legal_city_centers c ON c.name = q.geonames_name")
def prj04_identifiers(spark, root):
    q, c = table(spark, root, "place_queue"), table(spark, root, "cn_legal_city_centers")
    return q.join(c, c.name == q.geonames_name).select(F.concat(F.lit("cn-"), "geonameid").alias("guide_key"), F.concat(F.lit("geonames:"), "geonameid").alias("source_key"), F.concat(F.lit("legal-"), "administrative_code").alias("legal_key")).distinct()


@query("prj05_optional_guide", "SELECT DISTINCT i.geonameid, g.guide_id FROM cn_inventory i LEFT JOIN guide_page g ON g.geonames_id = i.geonameid AND g.geonames_id <> '' WHERE i.geonameid <> ''")
def prj05_optional_guide(spark, root):
    g = table(spark, root, "guide_page").select(F.nullif("geonames_id", F.lit("")).alias("geonameid"), "guide_id").where("geonameid is not null").distinct()
    return table(spark, root, "cn_inventory").select("geonameid").where("geonameid <> ''").distinct().join(g, "geonameid", "left")


@query("flt02_kinds", "SELECT CASE right(name, 1) WHEN '市' THEN 'city' WHEN '县' THEN 'county' WHEN '区' THEN 'district' WHEN '旗' THEN 'banner' END AS city_kind, count(*) AS n FROM cn_legal_city_centers WHERE right(name, 1) IN ('市', '县', '区', '旗') GROUP BY 1")
def flt02_kinds(spark, root):
    kinds = F.create_map(*(F.lit(x) for kv in {"市": "city", "县": "county", "区": "district", "旗": "banner"}.items() for x in kv))
    return table(spark, root, "cn_legal_city_centers").select(kinds[F.right("name", F.lit(1))].alias("city_kind")).where("city_kind is not null").groupBy("city_kind").agg(F.count("*").alias("n"))


@query("flt05_finite_coordinates", """SELECT DISTINCT geonameid, CASE WHEN trim(latitude) = '' THEN 0.0 ELSE try_cast(trim(latitude) AS DOUBLE) END AS lat, CASE WHEN trim(longitude) = '' THEN 0.0 ELSE try_cast(trim(longitude) AS DOUBLE) END AS lon
FROM cn_inventory WHERE (trim(latitude) = '' OR regexp_full_match(trim(latitude), '[+-]?[0-9]+([.][0-9]*)?')) AND (trim(longitude) = '' OR regexp_full_match(trim(longitude), '[+-]?[0-9]+([.][0-9]*)?'))""")
def flt05_finite_coordinates(spark, root):
    def number(c):
        t = F.trim(c)
        return F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?[0-9]+([.][0-9]*)?$"), t.try_cast("double"))

    return table(spark, root, "cn_inventory").select("geonameid", number("latitude").alias("lat"), number("longitude").alias("lon")).where("lat is not null and lon is not null").distinct()


@query("flt06_researched", "SELECT guide_id, content_status FROM guide_page WHERE content_status = 'researched'")
def flt06_researched(spark, root):
    return table(spark, root, "guide_page").where("content_status = 'researched'").select("guide_id", "content_status")


@query("jn02_inventory_left_ledger", """WITH last AS (SELECT geonameid, max(struct_pack(b := coalesce(batch, ''), t := coalesce(target_page, ''))) AS m FROM place_queue WHERE geonameid <> '' GROUP BY 1)
SELECT i.geonameid, l.m.b AS batch, l.m.t AS target_page FROM (SELECT DISTINCT geonameid FROM cn_inventory WHERE geonameid <> '') i LEFT JOIN last l USING (geonameid)""")
def jn02_inventory_left_ledger(spark, root):
    last = table(spark, root, "place_queue").where("geonameid <> ''").groupBy("geonameid").agg(F.max(F.struct(F.coalesce("batch", F.lit("")).alias("batch"), F.coalesce("target_page", F.lit("")).alias("target_page"))).alias("m")).select("geonameid", "m.*")
    return table(spark, root, "cn_inventory").select("geonameid").where("geonameid <> ''").distinct().join(last, "geonameid", "left")


@query("jn06_guides_not_in_inventory", "SELECT DISTINCT guide_id FROM guide_page g WHERE NOT EXISTS (SELECT 1 FROM cn_inventory i WHERE i.geonameid = g.geonames_id)")
def jn06_guides_not_in_inventory(spark, root):
    ids = table(spark, root, "cn_inventory").select(F.col("geonameid").alias("geonames_id"))
    return table(spark, root, "guide_page").select("guide_id", "geonames_id").join(ids, "geonames_id", "left_anti").select("guide_id").distinct()


@query("jn07_guide_coordinates", "SELECT DISTINCT g.guide_id, i.latitude, i.longitude FROM guide_page g JOIN cn_inventory i ON i.geonameid = g.geonames_id")
def jn07_guide_coordinates(spark, root):
    found, _ = relational.lookup(table(spark, root, "guide_page").select("guide_id", F.col("geonames_id").alias("geonameid")), table(spark, root, "cn_inventory").select("geonameid", "latitude", "longitude"), "geonameid", must_exist=True)
    return found.select("guide_id", "latitude", "longitude").distinct()


@query("jn08_unknown_references", "SELECT DISTINCT batch, geonameid FROM place_queue q WHERE geonameid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cn_inventory i WHERE i.geonameid = q.geonameid)")
def jn08_unknown_references(spark, root):
    _, lost = relational.lookup(table(spark, root, "place_queue").select("batch", "geonameid").where("geonameid is not null"), table(spark, root, "cn_inventory").select("geonameid"), "geonameid")
    return lost.select("batch", "geonameid").distinct()


@query("jn09_ledger_phase", "SELECT DISTINCT q.geonameid, i.assigned_phase FROM place_queue q JOIN cn_inventory i USING (geonameid)")
def jn09_ledger_phase(spark, root):
    return table(spark, root, "place_queue").select("geonameid").distinct().join(table(spark, root, "cn_inventory").select("geonameid", "assigned_phase").distinct(), "geonameid")


@query("jn10_id_and_path", "SELECT DISTINCT q.geonameid, q.target_page, g.guide_id FROM place_queue q JOIN guide_page g ON g.geonames_id = q.geonameid AND q.target_page LIKE '%/' || g.geonames_id || '.md'")
def jn10_id_and_path(spark, root):
    q, g = table(spark, root, "place_queue"), table(spark, root, "guide_page")
    return q.join(g, (g.geonames_id == q.geonameid) & q.target_page.endswith(F.concat(F.lit("/"), g.geonames_id, F.lit(".md")))).select("geonameid", "target_page", "guide_id").distinct()


@query("jn13_province_set", "SELECT DISTINCT province_code AS code, 'left' AS side FROM source_manifest WHERE province_code NOT IN (SELECT left(official_code6, 2) FROM admin1_crosswalk WHERE official_code6 IS NOT NULL) UNION ALL SELECT DISTINCT left(official_code6, 2), 'right' FROM admin1_crosswalk WHERE left(official_code6, 2) NOT IN (SELECT province_code FROM source_manifest WHERE province_code IS NOT NULL)")
def jn13_province_set(spark, root):
    a = table(spark, root, "source_manifest").select(F.col("province_code").alias("code")).where("code is not null")
    b = table(spark, root, "admin1_crosswalk").select(F.left("official_code6", F.lit(2)).alias("code")).where("code is not null")
    return inv.set_difference(a, b, "code")


@query("jn14_prefix_key", "SELECT DISTINCT c.administrative_code, w.official_admin_name FROM cn_legal_city_centers c JOIN admin1_crosswalk w ON w.official_code6 = rpad(left(c.administrative_code, 2), 6, '0')")
def jn14_prefix_key(spark, root):
    c = table(spark, root, "cn_legal_city_centers").select("administrative_code", text.padded_code(F.left("administrative_code", F.lit(2))).alias("official_code6"))
    return c.join(table(spark, root, "admin1_crosswalk").select("official_code6", "official_admin_name"), "official_code6").select("administrative_code", "official_admin_name").distinct()


@query("jn18_ordered_names", "SELECT v.pos, v.name, min(c.administrative_code) AS administrative_code FROM (VALUES (0, '石关县'), (1, '溪长市'), (2, '黑崖市')) v(pos, name) LEFT JOIN cn_legal_city_centers c ON c.name = v.name GROUP BY 1, 2")
def jn18_ordered_names(spark, root):
    names = spark.createDataFrame([(0, "石关县"), (1, "溪长市"), (2, "黑崖市")], "pos int, name string")
    return names.join(table(spark, root, "cn_legal_city_centers").select("name", "administrative_code"), "name", "left").groupBy("pos", "name").agg(F.min("administrative_code").alias("administrative_code"))


@query("agg07_counts_by_type", "SELECT feature_code, admin1_code, count(*) AS n FROM cn_inventory GROUP BY 1, 2")
def agg07_counts_by_type(spark, root):
    return table(spark, root, "cn_inventory").groupBy("feature_code", "admin1_code").agg(F.count("*").alias("n"))


@query("agg08_zero_filled_levels", "SELECT v.position, v.assigned_phase, (SELECT count(*) FROM cn_inventory i WHERE i.assigned_phase = v.assigned_phase) AS n FROM (VALUES (0, 'cities15000'), (1, 'cities5000'), (2, 'cities1000'), (3, 'cities500'), (4, 'cities100')) v(position, assigned_phase)")
def agg08_zero_filled_levels(spark, root):
    return relational.zero_filled(table(spark, root, "cn_inventory"), "assigned_phase", [*inv.TIERS, "cities100"])


@query("agg09_zero_filled_statuses", "SELECT v.position, v.content_status, (SELECT count(*) FROM guide_page g WHERE g.content_status = v.content_status) AS n FROM (VALUES (0, 'researched'), (1, 'draft'), (2, 'merged'), (3, 'duplicate')) v(position, content_status)")
def agg09_zero_filled_statuses(spark, root):
    return relational.zero_filled(table(spark, root, "guide_page"), "content_status", ["researched", "draft", "merged", "duplicate"])


_PHASES = "(VALUES ('cities15000'), ('cities5000'), ('cities1000'), ('cities500')) v(assigned_phase)"


@query("agg10_phase_pivot", "SELECT v.assigned_phase, " + ", ".join(f"count(*) FILTER (i.feature_code = '{c}') AS \"{c}\"" for c in ("PPL", "PPLA", "PPLA2", "PPLC")) + f", count(i.assigned_phase) AS total FROM {_PHASES} LEFT JOIN cn_inventory i ON i.assigned_phase = v.assigned_phase GROUP BY 1")
def agg10_phase_pivot(spark, root):
    return relational.pivot_counts(table(spark, root, "cn_inventory"), "assigned_phase", "feature_code", list(inv.TIERS), ["PPL", "PPLA", "PPLA2", "PPLC"])


_COVER = f"""SELECT v.assigned_phase, count(DISTINCT i.geonameid) AS denominator, count(DISTINCT q.geonameid) AS processed FROM {_PHASES}
 LEFT JOIN cn_inventory i ON i.assigned_phase = v.assigned_phase AND i.geonameid <> '' LEFT JOIN (SELECT DISTINCT geonameid FROM place_queue) q ON q.geonameid = i.geonameid GROUP BY 1"""


def _coverage(spark, root):
    ids = table(spark, root, "cn_inventory").where("geonameid <> ''").select("geonameid", "assigned_phase").distinct()
    done = table(spark, root, "place_queue").select("geonameid").distinct().withColumn("done", F.lit(True))
    both = ids.join(done, "geonameid", "left")
    phases = F.array(*(F.struct(F.lit(p).alias("assigned_phase"), F.count_distinct(F.when(F.col("assigned_phase") == p, F.col("geonameid"))).alias("denominator"), F.count_distinct(F.when((F.col("assigned_phase") == p) & F.col("done"), F.col("geonameid"))).alias("processed")) for p in inv.TIERS))
    return both.agg(phases.alias("c")).select(F.inline("c"))


@query("agg11_coverage", f"SELECT assigned_phase, denominator, processed, denominator - processed AS unprocessed, CASE WHEN denominator = 0 THEN 0.0 ELSE processed / denominator END AS coverage FROM ({_COVER})")
def agg11_coverage(spark, root):
    c = _coverage(spark, root)
    return c.withColumn("unprocessed", F.col("denominator") - F.col("processed")).withColumn("coverage", relational.share(F.col("processed"), F.col("denominator")))


@query("agg12_totals", f"SELECT CAST(sum(denominator) AS BIGINT) AS denominator, CAST(sum(processed) AS BIGINT) AS processed FROM ({_COVER})")
def agg12_totals(spark, root):
    return _coverage(spark, root).agg(F.sum("denominator").alias("denominator"), F.sum("processed").alias("processed"))


@query("rpt04_phase_table", f"SELECT assigned_phase, '| ' || assigned_phase || ' | ' || denominator || ' | ' || processed || ' | ' || denominator - processed || ' | ' || printf('%.6f%%', CASE WHEN denominator = 0 THEN 0.0 ELSE 100.0 * processed / denominator END) || ' |' AS row_text FROM ({_COVER})")
def rpt04_phase_table(spark, root):
    c = agg11_coverage(spark, root)
    cells = [F.col("assigned_phase"), F.col("denominator").cast("string"), F.col("processed").cast("string"), F.col("unprocessed").cast("string"), text.percentage(F.col("coverage") * 100.0)]
    return c.select("assigned_phase", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row_text"))


@query("agg13_distinct_provinces", "SELECT count(DISTINCT admin_area) AS n_areas, count(DISTINCT city) AS n_cities FROM guide_page")
def agg13_distinct_provinces(spark, root):
    return table(spark, root, "guide_page").agg(F.count_distinct("admin_area").alias("n_areas"), F.count_distinct("city").alias("n_cities"))


@query("agg14_covered_and_missing", "SELECT count(*) FILTER (g.geonames_id IS NOT NULL) AS covered, count(*) FILTER (g.geonames_id IS NULL) AS missing FROM (SELECT DISTINCT geonameid FROM cn_inventory WHERE geonameid <> '') i LEFT JOIN (SELECT DISTINCT geonames_id FROM guide_page WHERE geonames_id <> '') g ON g.geonames_id = i.geonameid")
def agg14_covered_and_missing(spark, root):
    g = table(spark, root, "guide_page").select(F.col("geonames_id").alias("geonameid"), F.lit(True).alias("has")).where("geonameid <> ''").distinct()
    i = table(spark, root, "cn_inventory").select("geonameid").where("geonameid <> ''").distinct().join(g, "geonameid", "left")
    return i.agg(F.count_if(F.col("has")).alias("covered"), F.count_if(F.col("has").isNull()).alias("missing"))


@query("agg15_directory", "SELECT admin_area, count(*) AS n, min_by(city, struct_pack(a := city, b := guide_id)) AS first_item, max_by(city, struct_pack(a := city, b := guide_id)) AS last_item FROM guide_page WHERE admin_area IS NOT NULL AND city IS NOT NULL AND guide_id IS NOT NULL GROUP BY 1")
def agg15_directory(spark, root):
    g = table(spark, root, "guide_page").where("admin_area is not null and city is not null and guide_id is not null")
    return relational.ordered_groups(g, "admin_area", F.col("city"), [F.col("city"), F.col("guide_id")])


@query("agg18_first_and_last", """SELECT geonameid, min_by(geonames_name, o) AS first_name, max_by(geonames_name, o) AS last_name FROM (SELECT geonameid, geonames_name, coalesce(batch, '') || chr(1) || geonames_name AS o FROM place_queue WHERE geonameid IS NOT NULL AND geonames_name IS NOT NULL) GROUP BY 1""")
def agg18_first_and_last(spark, root):
    q = table(spark, root, "place_queue").where("geonameid is not null and geonames_name is not null").withColumn("o", F.concat(F.coalesce("batch", F.lit("")), F.lit("\u0001"), "geonames_name"))
    first = relational.keep_one(q.select("geonameid", "geonames_name", "o"), ["geonameid"], [F.col("o")]).select("geonameid", F.col("geonames_name").alias("first_name"))
    last = q.groupBy("geonameid").agg(F.max_by("geonames_name", "o").alias("last_name"))
    return first.join(last, "geonameid")


@query("agg19_one_to_one", "SELECT geonames_id, count(DISTINCT guide_id) AS n_guides, min(guide_id) AS first_guide FROM guide_page WHERE geonames_id <> '' GROUP BY 1 HAVING count(DISTINCT guide_id) > 1")
def agg19_one_to_one(spark, root):
    g = table(spark, root, "guide_page").where("geonames_id <> ''")
    return g.groupBy("geonames_id").agg(F.count_distinct("guide_id").alias("n_guides"), F.min("guide_id").alias("first_guide")).where("n_guides > 1")


@query("agg20_repeated_cities", "SELECT city, count(DISTINCT guide_id) AS n FROM guide_page WHERE city <> '' GROUP BY 1 HAVING count(DISTINCT guide_id) > 1")
def agg20_repeated_cities(spark, root):
    return table(spark, root, "guide_page").where("city <> ''").groupBy("city").agg(F.count_distinct("guide_id").alias("n")).where("n > 1")


@query("agg21_exact_cover", "SELECT count(geonames_id) AS n_references, count(DISTINCT geonames_id) AS n_distinct, (SELECT count(DISTINCT guide_id) FROM guide_page) AS n_guides FROM guide_page")
def agg21_exact_cover(spark, root):
    return table(spark, root, "guide_page").agg(F.count("geonames_id").alias("n_references"), F.count_distinct("geonames_id").alias("n_distinct"), F.count_distinct("guide_id").alias("n_guides"))


@query("agg22_content_hash", "SELECT guide_id, sha256(markdown) AS content_sha256, octet_length(encode(markdown)) AS n_bytes FROM guide_page WHERE markdown IS NOT NULL")
def agg22_content_hash(spark, root):
    return table(spark, root, "guide_page").where("markdown is not null").select("guide_id", F.sha2("markdown", 256).alias("content_sha256"), F.octet_length("markdown").cast("bigint").alias("n_bytes"))


@query("ord01_numeric_positions", "SELECT geonameid, row_number() OVER (ORDER BY length(ltrim(geonameid, '0')), ltrim(geonameid, '0'), geonameid) AS position FROM (SELECT DISTINCT geonameid FROM cn_inventory WHERE regexp_full_match(geonameid, '[0-9]+'))")
def ord01_numeric_positions(spark, root):
    """Every id of digits, of any length, with its position in numeric order over the whole table."""
    ids = table(spark, root, "cn_inventory").select("geonameid").where(F.col("geonameid").rlike("^[0-9]+$")).distinct()
    return relational.numeric_positions(ids, "geonameid")


@query("ord03_locale_order", "SELECT admin_area, city, guide_id FROM guide_page")
def ord03_locale_order(spark, root):
    """Areas and cities in the order of a Chinese dictionary (pinyin), whole table."""
    return table(spark, root, "guide_page").select("admin_area", "city", "guide_id").orderBy(F.expr("admin_area COLLATE zh"), F.expr("city COLLATE zh"), "guide_id")


@query("ord08_latest_twenty", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def ord08_latest_twenty(spark, root):
    return table(spark, root, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("ord09_random_pick")
def ord09_random_pick(spark, root):
    """One guide at random among the researched ones, or else among all."""
    g = table(spark, root, "guide_page").select("guide_id", "city", "content_status").where("guide_id is not null").distinct()
    return relational.random_pick(g, "guide_id", 42, g.where("content_status = 'researched'"))


@query("set01_union", "SELECT geonameid AS id FROM cn_inventory WHERE geonameid IS NOT NULL UNION SELECT geonameid FROM place_queue WHERE geonameid IS NOT NULL UNION SELECT geonames_id FROM guide_page WHERE geonames_id IS NOT NULL")
def set01_union(spark, root):
    a, b, c = (table(spark, root, t).select(F.col(k).alias("id")) for t, k in (("cn_inventory", "geonameid"), ("place_queue", "geonameid"), ("guide_page", "geonames_id")))
    return a.unionByName(b).unionByName(c).where("id is not null").distinct()


@query("set02_intersection", "SELECT geonameid AS id FROM cn_inventory WHERE geonameid IS NOT NULL INTERSECT SELECT geonames_id FROM guide_page")
def set02_intersection(spark, root):
    return table(spark, root, "cn_inventory").select(F.col("geonameid").alias("id")).where("id is not null").intersect(table(spark, root, "guide_page").select("geonames_id"))


@query("set03_difference", "SELECT geonameid AS id FROM cn_inventory WHERE geonameid IS NOT NULL EXCEPT SELECT geonameid FROM place_queue")
def set03_difference(spark, root):
    return table(spark, root, "cn_inventory").select(F.col("geonameid").alias("id")).where("id is not null").exceptAll(spark.createDataFrame([], "id string")).subtract(table(spark, root, "place_queue").select("geonameid"))


@query("set04_union_all", "SELECT 0 AS source_order, 'legal-' || administrative_code AS id, name FROM cn_legal_city_centers UNION ALL SELECT 1, 'geonames:' || geonameid, geonames_name FROM place_queue UNION ALL SELECT 2, 'guide-' || guide_id, city FROM guide_page")
def set04_union_all(spark, root):
    parts = [("cn_legal_city_centers", "legal-", "administrative_code", "name"), ("place_queue", "geonames:", "geonameid", "geonames_name"), ("guide_page", "guide-", "guide_id", "city")]
    frames = [table(spark, root, t).select(F.lit(i).alias("source_order"), F.concat(F.lit(p), k).alias("id"), F.col(n).alias("name")) for i, (t, p, k, n) in enumerate(parts)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("str02_padded_codes", "SELECT DISTINCT c AS code, CASE WHEN regexp_full_match(c, '[0-9]+') AND length(c) <= 6 THEN rpad(c, 6, '0') END AS padded FROM (SELECT admin2_code AS c FROM cn_inventory UNION ALL SELECT administrative_code FROM cn_legal_city_centers) WHERE c IS NOT NULL")
def str02_padded_codes(spark, root):
    c = table(spark, root, "cn_inventory").select(F.col("admin2_code").alias("code")).unionByName(table(spark, root, "cn_legal_city_centers").select(F.col("administrative_code").alias("code")))
    return c.where("code is not null").distinct().withColumn("padded", text.padded_code(F.col("code")))


@query("str04_prefix_counts", "SELECT left(administrative_code, 2) AS p2, left(administrative_code, 4) AS p4, count(*) AS n, count(*) FILTER (starts_with(administrative_code, '11')) AS n_eleven FROM cn_legal_city_centers GROUP BY 1, 2")
def str04_prefix_counts(spark, root):
    c = table(spark, root, "cn_legal_city_centers")
    return c.groupBy(F.left("administrative_code", F.lit(2)).alias("p2"), F.left("administrative_code", F.lit(4)).alias("p4")).agg(F.count("*").alias("n"), F.count_if(F.col("administrative_code").startswith("11")).alias("n_eleven"))


@query("prj06_short_city", "SELECT DISTINCT administrative_code, regexp_replace(name, '[市区]$', '') AS short_name FROM cn_legal_city_centers")
def prj06_short_city(spark, root):
    return table(spark, root, "cn_legal_city_centers").select("administrative_code", text.short_city(F.col("name")).alias("short_name")).distinct()


@query("str29_formatted", "SELECT feature_code, format('{:,}', count(*)) AS shown, printf('%.6f%%', 100.0 * count(*) / (SELECT count(*) FROM cn_inventory)) AS share_text FROM cn_inventory GROUP BY 1")
def str29_formatted(spark, root):
    from pyspark.sql.window import Window

    n = table(spark, root, "cn_inventory").groupBy("feature_code").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a few feature codes
    return n.select("feature_code", text.grouped_number(F.col("n")).alias("shown"), text.percentage(100.0 * F.col("n") / whole).alias("share_text"))


@query("dat01_dates", "SELECT guide_id, last_researched, CASE WHEN regexp_full_match(last_researched, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(last_researched AS DATE) END AS day, left(coalesce(last_researched, ''), 10) AS first_ten, CASE WHEN regexp_full_match(last_researched, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN replace(last_researched, '-', '.') ELSE last_researched END AS shown FROM guide_page")
def dat01_dates(spark, root):
    c = F.col("last_researched")
    return table(spark, root, "guide_page").select("guide_id", "last_researched", dates.iso_date(c).alias("day"), dates.first_ten(c).alias("first_ten"), dates.dotted(c).alias("shown"))


@query("dat02_chinese_dates", "SELECT doc_id, make_date(CAST(regexp_extract(t, '(\\d{4})年(\\d{1,2})月(\\d{1,2})日', 1) AS BIGINT), CAST(regexp_extract(t, '(\\d{4})年(\\d{1,2})月(\\d{1,2})日', 2) AS BIGINT), CAST(regexp_extract(t, '(\\d{4})年(\\d{1,2})月(\\d{1,2})日', 3) AS BIGINT)) AS day FROM (SELECT doc_id, strftime(collected_at, '%Y年%-m月%-d日') AS t FROM documents WHERE collected_at IS NOT NULL)")
def dat02_chinese_dates(spark, root):
    d = table(spark, root, "documents").where("collected_at is not null")
    written = F.concat(F.year("collected_at"), F.lit("年"), F.month("collected_at"), F.lit("月"), F.dayofmonth("collected_at"), F.lit("日"))
    return d.select("doc_id", dates.chinese_date(written).alias("day"))


@query("dat05_stamps", "SELECT source_cutoff, filename, strftime(retrieved_at_utc, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM source_manifest")
def dat05_stamps(spark, root):
    return table(spark, root, "source_manifest").select("source_cutoff", "filename", dates.utc_stamp(F.col("retrieved_at_utc")).alias("stamp"))


@query("bin01_hash_compare", "SELECT filename, source_cutoff, lower(trim(payload_sha256)) = lower(trim(archive_sha256)) AS same, regexp_full_match(lower(trim(payload_sha256)), '[0-9a-f]{64}') AS well_formed FROM source_manifest")
def bin01_hash_compare(spark, root):
    p, a = F.lower(F.trim("payload_sha256")), F.lower(F.trim("archive_sha256"))
    return table(spark, root, "source_manifest").select("filename", "source_cutoff", (p == a).alias("same"), p.rlike("^[0-9a-f]{64}$").alias("well_formed"))


@query("jsn01_json_checks", "SELECT region_code, boundary ->> '$.type' AS shape, CASE boundary ->> '$.type' WHEN 'Polygon' THEN 1 ELSE json_array_length(boundary, '$.coordinates') END AS n_polygons FROM survey_region WHERE json_valid(boundary)")
def jsn01_json_checks(spark, root):
    r = table(spark, root, "survey_region").withColumn("v", F.try_parse_json("boundary")).where("v is not null")
    shape = F.try_variant_get("v", "$.type", "string")
    several = F.size(F.try_variant_get("v", "$.coordinates", "array<variant>"))
    return r.select("region_code", shape.alias("shape"), F.when(shape == "Polygon", F.lit(1)).otherwise(several).cast("bigint").alias("n_polygons"))


@query("map01_counters", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def map01_counters(spark, root):
    return table(spark, root, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("hie01_admin_tree", """WITH n AS (SELECT DISTINCT 'CN' AS root, admin1_code AS a1, admin2_code AS a2 FROM cn_inventory WHERE admin1_code <> '')
SELECT root AS node, 0 AS depth, root AS path FROM n GROUP BY ALL UNION SELECT a1, 1, root || '/' || a1 FROM n UNION SELECT a2, 2, root || '/' || a1 || '/' || a2 FROM n WHERE a2 <> ''""")
def hie01_admin_tree(spark, root):
    from waylake.operators.trees import walk_edges

    i = table(spark, root, "cn_inventory").select("admin1_code", "admin2_code").where("admin1_code <> ''").distinct()
    first = i.select(F.lit("CN").alias("parent"), F.col("admin1_code").alias("child"), F.concat(F.lit("CN/"), "admin1_code").alias("key"), F.lit("CN").alias("parent_key"))
    second = i.where("admin2_code <> ''").select(F.col("admin1_code").alias("parent"), F.col("admin2_code").alias("child"), F.concat(F.lit("CN/"), "admin1_code", F.lit("/"), "admin2_code").alias("key"), F.concat(F.lit("CN/"), "admin1_code").alias("parent_key"))
    return walk_edges(first.unionByName(second).distinct(), "CN")
