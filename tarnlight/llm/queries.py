"""Queries of the operators for language-model training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import canonical_values, contamination, mixing, product_linkage, residue, subjects
from tarnlight.runtime import table


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every listing with the size of the class."""
    classes = product_linkage.same_products(table(spark, sf_dir, "products"), table(spark, sf_dir, "brand_reference"))
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("n_listings"), F.min("listing_id").alias("first_listing"))
    return classes.join(sizes, "class_id").select("listing_id", "first_listing", "n_listings")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_linkage.pairs_of(product_linkage.same_products(table(spark, sf_dir, "products"), table(spark, sf_dir, "brand_reference")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.main_bodies(table(spark, sf_dir, "pages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.judge_pages(table(spark, sf_dir, "pages")).select("page_id").distinct()


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and size of every substitute."""
    return residue.judge_pages(table(spark, sf_dir, "pages"))


def p5_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfilled slots of all pages, ordinary ones included."""
    return residue.slot_places(table(spark, sf_dir, "pages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = table(spark, sf_dir, "products").select(F.lit("products").alias("origin"), F.col("listing_id").alias("record_id"), "brand")
    mentions = table(spark, sf_dir, "brand_mentions").select(F.lit("brand_mentions").alias("origin"), F.col("mention_id").alias("record_id"), "brand")
    rows = listings.unionByName(mentions)
    found = canonical_values.map_values(rows, "brand", table(spark, sf_dir, "brand_reference"), "brand_id", "canonical_brand", "aliases")
    return found.select("origin", "record_id", F.col("entry_id").alias("brand_id")).distinct()


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the values that mean no entry, with their rows."""
    listings = table(spark, sf_dir, "products").select("brand")
    mentions = table(spark, sf_dir, "brand_mentions").select("brand")
    rows = listings.unionByName(mentions)
    found = canonical_values.map_values(rows, "brand", table(spark, sf_dir, "brand_reference"), "brand_id", "canonical_brand", "aliases")
    return found.filter("entry_id = 0").groupBy("brand").agg(F.count("*").alias("n_rows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share and number of passages of every leak."""
    found = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id", "share", F.size("passages").alias("n_passages"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without leaked passages."""
    documents = table(spark, sf_dir, "documents")
    found = contamination.leaks(documents, table(spark, sf_dir, "eval_items"))
    return contamination.remove_spans(documents, found).select("doc_id", "text")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def _main_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).filter("rank = 1").select("doc_id", "subject")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), _main_subjects(spark, sf_dir))[1]


def p9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), _main_subjects(spark, sf_dir))[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus by subject: documents and weighted share."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("share").alias("weight"))


def p10_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of the areas against the labels that were held out."""
    return subjects.calibration_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_classes": p1_classes, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_clean": p8_clean, "p9_mix": p9_mix, "p9_sample": p9_sample, "p10_found": p10_found, "p10_composition": p10_composition, "p10_calibration": p10_calibration,
        "p3_found": p3_found, "p5_found": p5_found, "p5_kinds": p5_kinds, "p5_slots": p5_slots, "p7_found": p7_found, "p7_unmatched": p7_unmatched}


def oracle_sql() -> dict[str, str]:
    return {}
