"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polka.llm import canon, encoding, entity, listings, mixing, quality, tokenise
from polka.session import cut, table


def p1_matched(spark: SparkSession, d: str) -> DataFrame:
    return entity.match_tags(table(spark, d, "price_tags"), table(spark, d, "catalog_items"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matched(spark, d).where("sku is not null").select("tag_id", "sku").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_texts(table(spark, d, "catalog_items")).where("damaged").select("row_id").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore_texts(table(spark, d, "catalog_items")).select("row_id", "sku", "restored", "damaged", "restorable")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return listings.group_listings(table(spark, d, "listings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return listings.group_pairs(cut(p6_groups(spark, d), "groups")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    mapped = canon.canonical_brands(table(spark, d, "price_tags"), table(spark, d, "brand_list"))
    return mapped.where("not exact").select("tag_id", "brand_id").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_documents(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(p10_kinds(spark, d)).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_matched, p2_found, p2_restored, p6_found, p6_groups, p7_found, p8_ids, p9_mix, p9_shares, p10_found, p10_kinds)}
SQL: dict[str, str] = {}
