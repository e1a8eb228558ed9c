"""Queries on guide pages: text functions, sections, tables, cards and rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waylake.functions import dates, text
from waylake.operators import documents as docs
from waylake.operators import rules
from waylake.session import table

QUERIES, SQL = {}, {}

# Required keys and headings, and copy that no page may hold.
REQUIRED_KEYS = ["schema_version", "title", "country_code", "admin_area", "city", "geonames_id", "wikidata_id", "last_researched", "content_status"]
REQUIRED_HEADINGS = ["城市速览", "城市格局与游览区域", "主要景点", "美食与餐饮", "经典行程", "住宿区域", "市内交通", "不同旅行者须知", "行前核对", "来源与更新记录"]
BANNED_PHRASES = ["对用户", "适合你", "与妈妈同行", "根据已有画像", "清图范围"]
MOJIBAKE_MARKERS = ["ä¸", "å±", "æ—", "ç›", "â€", "Ã", "Â"]
DIALOGUE_HEADING = r"^#{2,3}\s+(?:先|怎样|怎么|是否|适不适合)"
PLACEHOLDERS = {"example": r"https://example\.com", "date": r"YYYY-MM-DD", "todo": r"(?iU)\bTODO\b", "comment": r"(?s)<!--.*?-->"}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _pages(spark, root):
    return table(spark, root, "guide_page").where("markdown is not null").select("guide_id", "title", "city", "admin_area", "geonames_id", "markdown").distinct()


_P = "(SELECT DISTINCT guide_id, title, city, admin_area, geonames_id, markdown FROM guide_page WHERE markdown IS NOT NULL) p"


def _plain_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '!?\[\[[^\]|]+\|\s*([^\]]*?)\s*\]\]', '\1', 'g')"
    x = rf"regexp_replace({x}, '!?\[\[[^\]|#]*#\^?\s*([^\]|]*?)\s*\]\]', '\1', 'g')"
    x = rf"regexp_replace({x}, '(?i)!?\[\[(?:[^\]|]*[/\\])?\s*([^\]|/\\]*?)(?:\.md)?\s*\]\]', '\1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?i)<br\s*/?\s*>', ' ', 'g'), '<[^>]+>', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[`*_~]', '', 'g'), '\\\s*$', '')"
    return rf"trim(regexp_replace({x}, '[\s\x{{00a0}}\x{{0085}}\x{{3000}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"


#: The pages without their closed fenced blocks, as far as a regular expression without back references goes.
_UNFENCED = r"regexp_replace(regexp_replace(markdown, '(?ms)^ {0,3}```[^\n]*\n.*?^ {0,3}```+[ \t]*$', '', 'g'), '(?ms)^ {0,3}~~~[^\n]*\n.*?^ {0,3}~~~+[ \t]*$', '', 'g')"


def _card_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '!?\[\[(?:[^\]|]+\|)?\s*([^\]|]*?)\s*\]\]', '\1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(?i)<br\s*/?\s*>|\\\s*$', ' ', 'g'), '<[^>]+>', '', 'g')"
    x = rf"regexp_replace({x}, '^[>\s]*[-*+]\s+(?:\[[ xX]\]\s*)?|^\[[ xX]\]\s*', '')"
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '[`*_~]', '', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g')"
    return rf"trim(regexp_replace({x}, '[\s\x{{00a0}}\x{{0085}}\x{{3000}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"


_LINK_SQL = r"""'(?i)\[([^\]]+)\]\((https?://[^)\s]+)(?:\s+["''][^"'']*["''])?\)'"""
_BODY = r"regexp_replace(markdown, '(?s)\A---\n.*?\n---\n', '')"


def _callout_sql(label: str) -> str:
    t = r"regexp_replace(regexp_replace(markdown, '(?i)<br\s*/?\s*>', chr(10), 'g'), '(?m)^>\s?', '', 'g')"
    return _plain_sql(rf"regexp_extract({t}, '(?m)^(?:[-*+]\s+)?(?:\*\*|__)?{label}(?:\*\*|__)?\s*[：:]\s*(.+)$', 1)")


@query("src15_front_matter", r"""SELECT guide_id, regexp_extract(m, '(?m)^title:\s*"?([^"\n]*?)"?\s*$', 1) AS fm_title, regexp_extract(m, '(?m)^geonames_id:\s*(.*?)\s*$', 1) AS fm_geonames_id, regexp_extract(m, '(?m)^content_status:\s*(.*?)\s*$', 1) AS fm_status
FROM (SELECT guide_id, regexp_extract(markdown, '(?s)\A---\n(.*?)\n---\n', 1) AS m FROM """ + _P + r") WHERE m <> ''")
def src15_front_matter(spark, root):
    f = _pages(spark, root).withColumn("fm", text.front_matter(F.col("markdown"))).where("fm is not null")
    get = lambda k: F.coalesce(F.col("fm")[k], F.lit(""))
    return f.select("guide_id", get("title").alias("fm_title"), get("geonames_id").alias("fm_geonames_id"), get("content_status").alias("fm_status"))


@query("str06_wiki_links", "SELECT guide_id, regexp_replace(regexp_replace(regexp_replace(markdown, '!?\\[\\[[^\\]|]+\\|\\s*([^\\]]*?)\\s*\\]\\]', '\\1', 'g'), '!?\\[\\[[^\\]|#]*#\\^?\\s*([^\\]|]*?)\\s*\\]\\]', '\\1', 'g'), '(?i)!?\\[\\[(?:[^\\]|]*[/\\\\])?\\s*([^\\]|/\\\\]*?)(?:\\.md)?\\s*\\]\\]', '\\1', 'g') AS cleaned FROM " + _P)
def str06_wiki_links(spark, root):
    return _pages(spark, root).select("guide_id", text.wiki_links_as_text(F.col("markdown")).alias("cleaned"))


@query("str07_web_markdown")
def str07_web_markdown(spark, root):
    """Pages without wiki links and relative link targets."""
    return _pages(spark, root).select("guide_id", text.without_relative_links(F.col("markdown")).alias("cleaned"))


@query("str08_plain_title", f"SELECT DISTINCT guide_id, {_plain_sql('title')} AS plain_title FROM {_P} WHERE title IS NOT NULL")
def str08_plain_title(spark, root):
    return _pages(spark, root).where("title is not null").select("guide_id", text.plain_summary(F.col("title")).alias("plain_title")).distinct()


@query("str09_plain_lines", f"SELECT guide_id, line_no, {_card_sql('line')} AS plain_line FROM (SELECT guide_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS line_no FROM {_P})")
def str09_plain_lines(spark, root):
    """Every line of every page as plain text."""
    lines = _pages(spark, root).select("guide_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    return lines.select("guide_id", "line_no", text.plain_card(F.col("line")).alias("plain_line"))


@query("str11_all_matching_keys", r"SELECT DISTINCT city, regexp_replace(lower(city), '[^\p{L}\p{N}]+', '', 'g') AS city_key FROM guide_page WHERE city IS NOT NULL")
def str11_all_matching_keys(spark, root):
    """The key of every city, also of those that NFKC changes."""
    return table(spark, root, "guide_page").select("city").where("city is not null").distinct().select("city", text.matching_key(F.col("city")).alias("city_key"))


@query("str13_keywords", f"SELECT guide_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_callout_sql('旅行关键词')}, '[、，,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM {_P}")
def str13_keywords(spark, root):
    return _pages(spark, root).select("guide_id", F.array_join(text.keywords(F.col("markdown")), "|").alias("keywords"))


@query("str15_suggested_stay", f"SELECT guide_id, coalesce(nullif({_callout_sql('建议停留')}, ''), " + _plain_sql(r"regexp_extract(markdown, '(?m)^\|\s*(?:\*\*|__)?建议停留(?:\*\*|__)?\s*\|\s*([^|\n]+?)\s*\|\s*$', 1)") + f", '') AS stay FROM {_P}")
def str15_suggested_stay(spark, root):
    return _pages(spark, root).select("guide_id", text.suggested_stay(F.col("markdown")).alias("stay"))


@query("str16_first_prose", rf"SELECT guide_id, coalesce({_plain_sql("b")}, '') AS summary FROM (SELECT guide_id, list_filter(list_transform(regexp_split_to_array(replace({_BODY}, chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:#{{1,6}}\s|>|```|~~~|\||[-*+]\s|\d+[.)]\s)'))[1] AS b FROM {_P})")
def str16_first_prose(spark, root):
    """The summary of each page: its first paragraph of prose after the front matter."""
    return _pages(spark, root).select("guide_id", text.first_prose(text.without_front_matter(F.col("markdown"))).alias("summary"))


@query("str18_web_links", rf"""SELECT guide_id, coalesce(nullif({_card_sql("l.label")}, ''), '官方入口') AS label, l.href AS href FROM (SELECT guide_id, unnest(list_filter(list_transform(list_zip(ls, hs), lambda x, i: {{'label': x[1], 'href': x[2], 'first': list_position(hs, x[2]) = i}}), lambda y: y.first)) AS l
FROM (SELECT guide_id, regexp_extract_all(markdown, {_LINK_SQL}, 1) AS ls, regexp_extract_all(markdown, {_LINK_SQL}, 2) AS hs FROM {_P}))""")
def str18_web_links(spark, root):
    """label and href of every link to the web."""
    return _pages(spark, root).select("guide_id", F.explode(text.web_links(F.col("markdown"))).alias("l")).select("guide_id", "l.label", "l.href")


@query("str19_local_links")
def str19_local_links(spark, root):
    """Link targets without a scheme, decoded and resolved; null where they leave the repository."""
    links = _pages(spark, root).select("guide_id", F.explode(text.local_links(F.col("markdown"))).alias("target")).where(~F.col("target").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|#|//)"))
    return links.select("guide_id", "target", text.resolved_path(text.percent_decoded(F.regexp_replace("target", "#.*$", ""))).alias("resolved"))


@query("str20_paths", "SELECT DISTINCT target_page, regexp_replace('a/./b/../' || target_page, '^a/\\./b/\\.\\./', 'a/') AS resolved FROM place_queue WHERE target_page <> ''")
def str20_paths(spark, root):
    q = table(spark, root, "place_queue").select("target_page").where("target_page <> ''").distinct()
    return q.select("target_page", text.resolved_path(text.percent_decoded(F.concat(F.lit("a/./b/../"), F.col("target_page")))).alias("resolved"))


@query("str22_markers", "SELECT guide_id, " + " OR ".join(f"contains(markdown, '{m}')" for m in MOJIBAKE_MARKERS) + " AS has_marker FROM " + _P)
def str22_markers(spark, root):
    found = F.exists(F.array(*(F.lit(m) for m in MOJIBAKE_MARKERS)), lambda m: F.contains(F.col("markdown"), m))
    return _pages(spark, root).select("guide_id", found.alias("has_marker"))


@query("str23_placeholders", " UNION ALL ".join(f"SELECT guide_id, '{n}' AS placeholder FROM {_P} WHERE regexp_matches(markdown, '{p.replace('(?iU)', '(?i)')}')" for n, p in PLACEHOLDERS.items()))
def str23_placeholders(spark, root):
    """guide_id, placeholder of every pattern a page holds."""
    hits = F.array(*(F.when(F.col("markdown").rlike(p), F.lit(n)) for n, p in PLACEHOLDERS.items()))
    return _pages(spark, root).select("guide_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("placeholder"))


@query("str26_table_cells", r"""SELECT guide_id, line_no, len(cells) AS n_cells, trim(cells[1]) AS first_cell FROM (SELECT guide_id, line_no, string_split(t[2:len(t) - 1], '|') AS cells FROM (SELECT guide_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(len(string_split(markdown, chr(10))))) AS line_no, trim(line) AS t FROM """ + _P + r""") WHERE t LIKE '|%|' AND len(t) >= 2)""")
def str26_table_cells(spark, root):
    lines = _pages(spark, root).select("guide_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    cells = lines.select("guide_id", F.col("line_no").cast("bigint").alias("line_no"), text.table_cells(F.col("line")).alias("cells")).where(F.size("cells") > 0)
    return cells.select("guide_id", "line_no", F.size("cells").cast("bigint").alias("n_cells"), F.get("cells", F.lit(0)).alias("first_cell"))


@query("doc03_sections")
def doc03_sections(spark, root):
    return docs.page_sections(_pages(spark, root))


@query("doc03_all_section_counts", f"SELECT guide_id, n_sections FROM (SELECT guide_id, len(list_filter(string_split({_UNFENCED}, chr(10)), lambda x: regexp_matches(x, '^ {{0,3}}##[ \t]+[^ \t]'))) AS n_sections FROM {_P}) WHERE n_sections > 0")
def doc03_all_section_counts(spark, root):
    """Number of H2 sections of every page that has some, pages with fenced blocks too."""
    return docs.page_sections(_pages(spark, root)).groupBy("guide_id").agg(F.count("*").alias("n_sections"))


@query("doc06_tables")
def doc06_tables(spark, root):
    return docs.page_tables(_pages(spark, root))


@query("doc21_cards")
def doc21_cards(spark, root):
    return docs.page_cards(_pages(spark, root))


@query("doc22_outline")
def doc22_outline(spark, root):
    return docs.page_outline(_pages(spark, root))


@query("doc23_first_h1", r"SELECT guide_id, nullif(list_position(list_transform(string_split(replace(markdown, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_matches(x, '^ {0,3}#(?:[ \t]|$)')), true), 0) AS h1_line FROM " + _P)
def doc23_first_h1(spark, root):
    return docs.page_first_h1(_pages(spark, root))


@query("doc25_guides")
def doc25_guides(spark, root):
    """The public guide table: page fields, summary, stay, keywords, outline and coordinates."""
    p = _pages(spark, root)
    body = text.without_front_matter(F.col("markdown"))
    own = p.select("guide_id", "title", "city", "admin_area", "geonames_id", text.first_prose(body).alias("summary"), text.suggested_stay(body).alias("suggested_stay"), text.keywords(body).alias("keywords"))
    at = table(spark, root, "cn_inventory").where("geonameid <> ''").groupBy(F.col("geonameid").alias("geonames_id")).agg(F.min(F.struct("longitude", "latitude")).alias("coordinates"))
    sections = docs.page_outline(p).groupBy("guide_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("anchor").alias("id"), "title", "level"))).alias("sections"))  # headings of one page
    return own.join(at, "geonames_id").join(sections, "guide_id", "left")


@query("jn17_resolved_sections")
def jn17_resolved_sections(spark, root):
    """The first section of each kind in a page."""
    s = docs.page_sections(_pages(spark, root)).where("section is not null")
    return s.groupBy("guide_id", "section").agg(F.min_by("title", "position").alias("title"), F.min("position").alias("position"))


@query("agg23_card_totals")
def agg23_card_totals(spark, root):
    """Cards by section, and the most badges and fields that any has."""
    return docs.page_cards(_pages(spark, root)).groupBy("section").agg(F.count("*").alias("n_cards"), F.count_distinct("guide_id").alias("n_guides"), F.max(F.size("badges")).alias("most_badges"), F.max(F.size("fields")).alias("most_fields"))


@query("ord11_heading_rules", f"""WITH h AS (SELECT guide_id, list_transform(list_filter(string_split(markdown, chr(10)), lambda x: starts_with(x, '## ')), lambda x: trim(x[4:], ' ')) AS h FROM {_P}), r AS (SELECT {REQUIRED_HEADINGS} AS r),
q AS (SELECT guide_id, h, r, list_filter(list_transform(r, lambda x: coalesce(list_position(h, x), 0)), lambda x: x > 0) AS places FROM h, r)
SELECT guide_id, 'missing' AS problem, x AS heading FROM (SELECT guide_id, h, unnest(r) AS x FROM q) WHERE NOT list_contains(h, x)
UNION ALL SELECT guide_id, 'repeated', x FROM (SELECT guide_id, h, unnest(r) AS x FROM q) WHERE len(list_filter(h, lambda y: y = x)) > 1
UNION ALL SELECT guide_id, 'unexpected', x FROM (SELECT guide_id, r, unnest(h) AS x FROM q) WHERE NOT list_contains(r, x)
UNION ALL SELECT guide_id, 'order', '' FROM q WHERE len(places) = len(r) AND list_sort(places) <> places""")
def ord11_heading_rules(spark, root):
    """Required headings: missing, repeated, out of order, and unexpected ones."""
    required = F.array(*(F.lit(h) for h in REQUIRED_HEADINGS))
    heads = F.transform(F.filter(F.split("markdown", "\n"), lambda x: x.startswith("## ")), lambda x: F.trim(F.substring(x, 4, 1 << 30)))
    p = _pages(spark, root).select("guide_id", heads.alias("h"))
    places = F.filter(F.transform(required, lambda r: F.array_position(F.col("h"), r)), lambda x: x > 0)
    found = F.concat(
        F.transform(F.filter(required, lambda r: ~F.array_contains(F.col("h"), r)), lambda r: F.struct(F.lit("missing").alias("problem"), r.alias("heading"))),
        F.transform(F.filter(required, lambda r: F.size(F.filter(F.col("h"), lambda x: x == r)) > 1), lambda r: F.struct(F.lit("repeated").alias("problem"), r.alias("heading"))),
        F.transform(F.filter(F.col("h"), lambda x: ~F.array_contains(required, x)), lambda x: F.struct(F.lit("unexpected").alias("problem"), x.alias("heading"))),
        F.when((F.size(places) == F.size(required)) & (F.array_sort(places) != places), F.array(F.struct(F.lit("order").alias("problem"), F.lit("").alias("heading")))).otherwise(F.array().cast("array<struct<problem:string,heading:string>>")),
    )
    return p.select("guide_id", F.explode(found).alias("f")).select("guide_id", "f.problem", "f.heading")


@query("dq13_unterminated", f"SELECT guide_id FROM {_P} WHERE starts_with(markdown, '---' || chr(10)) AND position(chr(10) || '---' || chr(10) IN markdown[5:]) = 0")
def dq13_unterminated(spark, root):
    return _pages(spark, root).where(F.col("markdown").startswith("---\n") & (F.instr(F.substring("markdown", 5, 1 << 30), "\n---\n") == 0)).select("guide_id")


@query("dq14_copy", " UNION ALL ".join(f"SELECT guide_id, '{b}' AS phrase FROM {_P} WHERE contains(markdown, '{b}')" for b in BANNED_PHRASES))
def dq14_copy(spark, root):
    hits = F.array(*(F.when(F.contains("markdown", F.lit(b)), F.lit(b)) for b in BANNED_PHRASES))
    return _pages(spark, root).select("guide_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("phrase"))


@query("dq14_dialogue_headings", r"SELECT guide_id, line FROM (SELECT guide_id, unnest(string_split(markdown, chr(10))) AS line FROM " + _P + rf") WHERE regexp_matches(line, '{DIALOGUE_HEADING}')")
def dq14_dialogue_headings(spark, root):
    return _pages(spark, root).select("guide_id", F.explode(F.split("markdown", "\n")).alias("line")).where(F.col("line").rlike(DIALOGUE_HEADING))


@query("dq15_missing_keys", r"SELECT guide_id, k AS missing_key FROM (SELECT guide_id, regexp_extract(markdown, '(?s)\A---\n(.*?)\n---\n', 1) AS m FROM " + _P + r") CROSS JOIN (SELECT unnest(" + str(REQUIRED_KEYS) + r") AS k) WHERE m <> '' AND NOT regexp_matches(m, '(?m)^' || k || ':[ \t]*[^ \t\n]') OR m <> '' AND regexp_matches(m, '(?m)^' || k || ':[ \t]*[\x22\x27]+[ \t]*$')")
def dq15_missing_keys(spark, root):
    """Required front-matter keys that a page lacks or leaves empty."""
    fm = _pages(spark, root).select("guide_id", text.front_matter(F.col("markdown")).alias("fm")).where("fm is not null")
    required = F.array(*(F.lit(k) for k in REQUIRED_KEYS))
    return fm.select("guide_id", F.explode(F.filter(required, lambda k: F.coalesce(F.try_element_at("fm", k), F.lit("")) == "")).alias("missing_key"))


@query("dq16_page_rules", f"""SELECT 'geonames_id_digits' AS rule, guide_id AS record_key, coalesce(geonames_id, 'null') AS message FROM {_P} WHERE NOT coalesce(regexp_full_match(geonames_id, '[0-9]+'), false)
UNION ALL SELECT 'title_names_city', guide_id, coalesce(title, 'null') FROM {_P} WHERE NOT coalesce(contains(title, city), false)""")
def dq16_page_rules(spark, root):
    checks = [
        rules.Rule("geonames_id_digits", F.col("geonames_id").rlike(text.DIGITS), F.coalesce("geonames_id", F.lit("null"))),
        rules.Rule("title_names_city", F.contains("title", F.col("city")), F.coalesce("title", F.lit("null"))),
    ]
    return rules.check_rows(_pages(spark, root), "guide_id", checks)


@query("dq18_table_widths")
def dq18_table_widths(spark, root):
    return docs.page_table_errors(_pages(spark, root))


@query("dq20_inventory_rules", r"""WITH r AS (SELECT DISTINCT geonameid, population, geonames_modified_at FROM cn_inventory WHERE geonameid IS NOT NULL)
SELECT 'id_digits' AS rule, geonameid AS record_key, geonameid AS message FROM r WHERE NOT regexp_full_match(geonameid, '[0-9]+')
UNION ALL SELECT 'population_digits', geonameid, coalesce(population, 'null') FROM r WHERE NOT coalesce(regexp_full_match(population, '[0-9]*'), false)
UNION ALL SELECT 'modified_date', geonameid, coalesce(geonames_modified_at, 'null') FROM r WHERE NOT coalesce(regexp_full_match(geonames_modified_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(geonames_modified_at AS DATE) IS NOT NULL, false)
UNION ALL SELECT 'unique_id', geonameid, 'rows: ' || count(*) FROM (SELECT DISTINCT * FROM cn_inventory) WHERE geonameid IS NOT NULL GROUP BY geonameid HAVING count(*) > 1
UNION ALL SELECT 'known_id', batch, coalesce(geonameid, 'null') FROM place_queue q WHERE NOT EXISTS (SELECT 1 FROM cn_inventory i WHERE i.geonameid = q.geonameid)""")
def dq20_inventory_rules(spark, root):
    i = table(spark, root, "cn_inventory")
    slim = i.select("geonameid", "population", "geonames_modified_at").where("geonameid is not null").distinct()
    checks = [
        rules.Rule("id_digits", F.col("geonameid").rlike(text.DIGITS), F.col("geonameid")),
        rules.Rule("population_digits", F.col("population").rlike("^[0-9]*$"), F.coalesce("population", F.lit("null"))),
        rules.Rule("modified_date", dates.iso_date(F.col("geonames_modified_at")).isNotNull(), F.coalesce("geonames_modified_at", F.lit("null"))),
    ]
    return rules.gather(rules.check_rows(slim, "geonameid", checks), rules.unique(i.distinct(), "geonameid", "unique_id"), rules.references(table(spark, root, "place_queue"), "batch", "geonameid", i, "geonameid", "known_id"))


@query("rpt03_validation_report", "SELECT rule, count(*) AS n, min(record_key) AS first_key FROM (" + SQL["dq20_inventory_rules"] + ") GROUP BY 1")
def rpt03_validation_report(spark, root):
    return rules.summary(dq20_inventory_rules(spark, root))


@query("dq25_centre_rules", r"""SELECT 'code_digits' AS rule, administrative_code AS record_key, administrative_code AS message FROM (SELECT DISTINCT administrative_code FROM cn_legal_city_centers) WHERE NOT regexp_full_match(administrative_code, '[0-9]{9}')
UNION ALL SELECT 'province', administrative_code, left(administrative_code, 2) FROM (SELECT DISTINCT administrative_code FROM cn_legal_city_centers) WHERE rpad(left(administrative_code, 2), 6, '0') NOT IN (SELECT official_code6 FROM admin1_crosswalk)
UNION ALL SELECT 'coordinates', administrative_code, 'missing' FROM cn_legal_city_centers GROUP BY administrative_code HAVING max(coalesce(longitude, '')) = ''""")
def dq25_centre_rules(spark, root):
    c = table(spark, root, "cn_legal_city_centers")
    codes = c.select("administrative_code", F.rpad(F.left("administrative_code", F.lit(2)), 6, "0").alias("code6"), F.left("administrative_code", F.lit(2)).alias("p")).where("administrative_code is not null").distinct()
    digits = rules.check_rows(codes, "administrative_code", [rules.Rule("code_digits", F.col("administrative_code").rlike("^[0-9]{9}$"), F.col("administrative_code"))])
    lost = rules.references(codes, "administrative_code", "code6", table(spark, root, "admin1_crosswalk"), "official_code6", "province").select("rule", "record_key", F.left("record_key", F.lit(2)).alias("message"))
    bare = c.groupBy(F.col("administrative_code").alias("record_key")).agg(F.max(F.coalesce("longitude", F.lit(""))).alias("x")).where("x = ''").select(F.lit("coordinates").alias("rule"), "record_key", F.lit("missing").alias("message"))
    return rules.gather(digits, lost, bare)


@query("dq07_manifest_rules", r"""SELECT 'payload_hash' AS rule, filename AS record_key, coalesce(payload_sha256, 'null') AS message FROM source_manifest WHERE NOT coalesce(regexp_full_match(lower(trim(payload_sha256)), '[0-9a-f]{64}'), false)
UNION ALL SELECT 'filename_province', filename, coalesce(province_code, 'null') FROM source_manifest WHERE NOT coalesce(starts_with(filename, province_code || '-'), false)
UNION ALL SELECT 'size', filename, coalesce(CAST(payload_size_bytes AS VARCHAR), 'null') FROM source_manifest WHERE NOT coalesce(payload_size_bytes > 0 AND archive_size_bytes <= payload_size_bytes, false)""")
def dq07_manifest_rules(spark, root):
    checks = [
        rules.Rule("payload_hash", F.lower(F.trim("payload_sha256")).rlike("^[0-9a-f]{64}$"), F.coalesce("payload_sha256", F.lit("null"))),
        rules.Rule("filename_province", F.col("filename").startswith(F.concat("province_code", F.lit("-"))), F.coalesce("province_code", F.lit("null"))),
        rules.Rule("size", (F.col("payload_size_bytes") > 0) & (F.col("archive_size_bytes") <= F.col("payload_size_bytes")), F.coalesce(F.col("payload_size_bytes").cast("string"), F.lit("null"))),
    ]
    return rules.check_rows(table(spark, root, "source_manifest"), "filename", checks)
