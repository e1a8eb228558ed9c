"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylake.llm import encodings, leakage, matching, mixing, quality, residue
from waylake.session import table


def p6_matches(spark: SparkSession, root: str) -> DataFrame:
    """Every candidate pair of queue entry and centre, with its confidence."""
    centres = table(spark, root, "cn_legal_city_centers")
    names = centres.select(F.lit("center").alias("kind"), F.col("administrative_code").alias("record_key"), F.col("name").alias("text"))
    return matching.match_entries(table(spark, root, "place_queue"), table(spark, root, "cn_inventory"), centres, table(spark, root, "admin1_crosswalk"), table(spark, root, "hanzi_reading"), encodings.restored_records(names))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Queue entries that denote the city or county of a centre."""
    return p6_matches(spark, root).where("confidence >= 0.5").select("administrative_code", "geonameid").distinct()


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that share a run of at least 50 letters and digits with a held-out item."""
    return leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_item")).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Documents with leaked spans, the spans cut out."""
    documents = table(spark, root, "documents")
    return leakage.without_leaks(documents, leakage.find_leaks(documents, table(spark, root, "eval_item")))


def p8_draws(spark: SparkSession, root: str) -> DataFrame:
    """Every draw of every mix."""
    return mixing.draw_mixes(mixing.sized_documents(table(spark, root, "documents")), table(spark, root, "mix_target"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual shares of every source in every mix."""
    targets = table(spark, root, "mix_target")
    return mixing.mix_report(mixing.draw_mixes(mixing.sized_documents(table(spark, root, "documents")), targets), targets)


def _garblable(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "guide_page").select(F.lit("guide").alias("kind"), F.col("guide_id").alias("record_key"), F.col("markdown").alias("text"))
    centres = table(spark, root, "cn_legal_city_centers").select(F.lit("center").alias("kind"), F.col("administrative_code").alias("record_key"), F.col("name").alias("text"))
    return pages.unionByName(centres)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages and centres that hold text decoded with a wrong character encoding."""
    return encodings.garbled_records(_garblable(spark, root)).withColumnRenamed("kind", "garbled_in")


def p1_restored(spark: SparkSession, root: str) -> DataFrame:
    """The garbled texts and what can be restored of them."""
    return encodings.restored_records(_garblable(spark, root)).withColumnRenamed("kind", "garbled_in")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pages in which residue stands in place of content."""
    return residue.residue_pages(table(spark, root, "guide_page"))


def p4_kept(spark: SparkSession, root: str) -> DataFrame:
    """The pages without residue."""
    return residue.without_residue(table(spark, root, "guide_page"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents most of which is not natural prose."""
    return p9_statistics(spark, root).where("text_kind <> 'prose'").select("doc_id", "text_kind").distinct()


def p9_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of every document's text."""
    documents = table(spark, root, "documents")
    return quality.document_statistics(documents, quality.fit_profiles(documents, table(spark, root, "doc_label")))


QUERIES = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p4_found": p4_found,
    "p4_kept": p4_kept,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
    "p6_found": p6_found,
    "p6_matches": p6_matches,
    "p7_found": p7_found,
    "p7_cleaned": p7_cleaned,
    "p8_draws": p8_draws,
    "p8_shares": p8_shares,
}
SQL = {}
