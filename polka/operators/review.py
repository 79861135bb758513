"""Manual review and the report: filters, search, deviations, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polka.functions.numeric import finite, number_text
from polka.functions.text import sanitize_cell
from polka.operators.pricing import COMPETITOR_CHEAPER, OWN_CHEAPER, PARITY

REPORT = ["sku", "name", "recognised", "purchase_price", "sale_price", "promo_price", "competitor_price", "competitor_promo", "difference", "price_index", "status", "warnings"]


def by_status(rows: DataFrame, choice: str | None) -> DataFrame:
    """All rows, those of a status, or the dumping alerts."""
    if not choice or choice == "all":
        return rows
    return rows.where("is_dumping") if choice == "dumping" else rows.where(F.col("status") == choice)


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where the columns, joined by spaces, contain the text in any letter case."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return rows.where(hay.contains(text.lower()))


def metric_value(x: Column, suffix: str = "%", none: str = "Н/Д") -> Column:
    """A figure as it is shown: one decimal and a suffix, ``none`` for NULL."""
    return F.coalesce(F.concat(number_text(x, "0.0"), F.lit(suffix)), F.lit(none))


def status_distribution(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isin(OWN_CHEAPER, COMPETITOR_CHEAPER, PARITY)).groupBy("status").agg(F.count("*").alias("items"))


def largest_deviations(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The ``n`` rows of largest absolute effective difference (a top-k report), ties by ``order``."""
    return rows.where("effective_diff is not null").orderBy(F.desc(F.abs("effective_diff")), *order).limit(n).orderBy("effective_diff", *order)


def report_rows(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The twelve columns of the report as they are written to a sheet."""
    have = rows.columns
    first = lambda a, b: F.coalesce(a, b) if b in have else F.col(a)
    said = F.filter(F.concat(F.array(F.col("alert")), F.col("data_quality_warnings")), lambda w: F.coalesce(w != "", F.lit(False)))
    return rows.select(
        *(keep or []), sanitize_cell(F.coalesce(F.nullif("matched_sku", F.lit("")), F.lit("-")), 100).alias("sku"),
        sanitize_cell(F.coalesce(F.nullif("matched_name", F.lit("")), F.lit("-")), 500).alias("name"), sanitize_cell(F.col("product_name"), 500).alias("recognised"),
        finite(F.col("our_purchase_price")).alias("purchase_price"), finite(F.col("our_sale_price")).alias("sale_price"), finite(F.col("our_promo_price")).alias("promo_price"),
        finite(first("comp_regular_price", "regular_price")).alias("competitor_price"), finite(first("comp_promo_price", "promo_price")).alias("competitor_promo"),
        finite(F.col("effective_diff")).alias("difference"), (finite(F.col("price_index_effective")) / 100.0).alias("price_index"), sanitize_cell(F.col("status"), 200).alias("status"),
        F.array_join(F.array_distinct(F.transform(said, lambda w: sanitize_cell(w, 500))), " | ").alias("warnings"),
    )


def summary_lines(summary: DataFrame) -> DataFrame:
    """A one-row summary as ``label, value`` lines; shares and indices as fractions."""
    per = {"match_rate", "avg_price_index", "basket_price_index"}
    cols = [c for c in summary.columns if c != "failed_recognitions"]
    pairs = ", ".join(f"'{c}', cast({c} as double){' / 100' if c in per else ''}" for c in cols)
    return summary.select(F.expr(f"stack({len(cols)}, {pairs}) as (label, value)"))


def bot_text(summary: DataFrame) -> DataFrame:
    """The short text report; ``no data`` for an index that is missing."""
    pi = lambda c: F.coalesce(F.concat(number_text(finite(F.col(c)), "0.0"), F.lit("%")), F.lit("no data"))
    return summary.select(F.concat_ws("; ", F.concat(F.lit("items "), "total_items"), F.concat(F.lit("matched "), "matched_items"), F.concat(F.lit("average index "), pi("avg_price_index")), F.concat(F.lit("basket index "), pi("basket_price_index")), F.concat(F.lit("dumping "), "dumping_alerts_count")).alias("report"))
