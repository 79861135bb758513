"""Queries of the general data problems (units, rejects, schema drift)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polka.operators import feeds, units
from polka.session import cut, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # the pairs rest on stated units alone, so nothing is guessed for them
    return units.same_price_in_other_units(units.convert_units(table(spark, d, "price_tags"), guess=False)).distinct()


def p3_units(spark: SparkSession, d: str) -> DataFrame:
    return units.convert_units(table(spark, d, "price_tags"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = feeds.load_feed_lines(table(spark, d, "feed_files"), table(spark, d, "feed_lines"))
    return rejected.select("file_id", "line_no").distinct()


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    return feeds.load_feed_lines(table(spark, d, "feed_files"), table(spark, d, "feed_lines"))[1]


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return feeds.load_feed_lines(table(spark, d, "feed_files"), table(spark, d, "feed_lines"))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    versions = feeds.schema_versions(table(spark, d, "feed_files"), table(spark, d, "feed_lines"))
    return feeds.schema_changes(cut(versions, "versions")).select("file_id", "change_kind", "column_header").distinct()


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    df = feeds.unified_table(table(spark, d, "feed_files"), table(spark, d, "feed_lines"))
    return df.withColumn("other", F.to_json("other"))


QUERIES = {f.__name__: f for f in (p3_found, p3_units, p4_found, p4_rejected, p4_loaded, p5_found, p5_unified)}
