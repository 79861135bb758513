"""Price metrics of matched tags and their summaries; all row-wise expressions and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polka.functions.numeric import exact_round, positive_price
from polka.functions.text import attributes, valid_sku

OWN_CHEAPER, COMPETITOR_CHEAPER, PARITY, UNKNOWN = "own_cheaper", "competitor_cheaper", "parity", "unknown"
PARITY_BAND = (98.0, 102.0)
ALERT = "dumping: competitor below purchase price"
# Fixed value: conditions that a promo price is only had in a set.
MULTIBUY = r"(?iuU)(?:\bот\s*\d+|\d+\s*[+хx×]\s*\d+|при\s+покупке|за\s*\d+\s*шт|\d+\s*по\s*цене)"


def conditional_promo(condition: Column) -> Column:
    return F.coalesce(condition.rlike(MULTIBUY), F.lit(False))


def tidy_unit(unit: Column) -> Column:
    u = F.translate(F.lower(F.trim(F.coalesce(F.nullif(unit, F.lit("")), F.lit("шт")))), " ", "")
    return F.when(u.isin("упаковка", "уп"), "упак").when(u == "100гр", "100г").otherwise(u)


def effective(regular: Column, promo: Column, conditional: Column | bool = False) -> tuple[Column, Column, Column]:
    """(price that counts, whether it is the promo price, whether a promo above the regular price was ignored)."""
    cond = F.lit(conditional) if isinstance(conditional, bool) else conditional
    usable = promo.isNotNull() & ~cond
    applied = usable & (regular.isNull() | (promo <= regular))
    price = F.when(F.coalesce(applied, F.lit(False)), promo).otherwise(regular)
    return price, F.coalesce(applied, F.lit(False)), F.coalesce(usable & (promo > regular), F.lit(False))


def price_metrics(df: DataFrame) -> DataFrame:
    """Adds the metrics to rows with ``matched_sku, matched_name, our_*_price, regular_price, promo_price, unit``.

    Optional columns: ``promo_condition, weight_volume, data_quality_warnings`` (kept first in
    the warnings), ``matched_attrs`` (attributes of the matched item, read once per catalogue row;
    they stand where ``weight_volume`` is absent or blank). Unusable prices (NULL, NaN, not positive, above ten million) are NULL and
    everything that needs them is NULL. Status compares the unrounded index.
    """
    have = set(df.columns)
    opt = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    keep = [c for c in df.columns if c not in ("our_purchase_price", "our_sale_price", "our_promo_price", "data_quality_warnings")]
    text = F.concat_ws(" ", F.coalesce("matched_name", F.lit("")), F.coalesce(opt("weight_volume"), F.lit("")))
    df = df.withColumns({
        "_unit": tidy_unit(opt("unit")), "_prev": F.coalesce(opt("data_quality_warnings", "array<string>"), F.array().cast("array<string>")),
        "_cond": conditional_promo(opt("promo_condition")),
        "our_purchase_price": positive_price(F.col("our_purchase_price")), "our_sale_price": positive_price(F.col("our_sale_price")),
        "our_promo_price": positive_price(F.col("our_promo_price")),
        "_reg": positive_price(F.col("regular_price")), "_pro": positive_price(opt("promo_price", "double")),
    })
    said = F.coalesce(F.trim(opt("weight_volume")), F.lit("")) != ""
    if "matched_attrs" in have:
        read = F.when(said, attributes(text)).otherwise(F.col("matched_attrs")) if "weight_volume" in have else F.col("matched_attrs")
    else:
        read = attributes(text)
    df = df.withColumn("_attrs", F.when(F.col("_unit").isin("кг", "100г", "л"), read))
    w, v = F.nullif("_attrs.weight_g", F.lit(0)), F.nullif("_attrs.volume_ml", F.lit(0))
    df = df.withColumn("_factor", F.when(F.col("_unit").isin("шт", "упак"), 1.0).when(F.col("_unit") == "100г", w / 100.0).when(F.col("_unit") == "кг", w / 1000.0).when(F.col("_unit") == "л", v / 1000.0))
    df = df.withColumns({"comp_regular_price": exact_round(F.col("_reg") * F.col("_factor"), 2), "comp_promo_price": exact_round(F.col("_pro") * F.col("_factor"), 2)})
    ours, theirs = effective(F.col("our_sale_price"), F.col("our_promo_price")), effective(F.col("comp_regular_price"), F.col("comp_promo_price"), F.col("_cond"))
    df = df.withColumns({
        "our_effective_price": ours[0], "our_promo_applied": ours[1], "_ow": ours[2],
        "comp_effective_price": theirs[0], "comp_promo_applied": theirs[1], "_cw": theirs[2],
    })
    df = df.withColumns({
        "price_index_effective_raw": F.try_divide("comp_effective_price", "our_effective_price") * 100.0,
        "price_index_regular_raw": F.try_divide("comp_regular_price", "our_sale_price") * 100.0,
        "is_dumping": F.coalesce(F.col("comp_effective_price") < F.col("our_purchase_price"), F.lit(False)),
    })
    pi = F.col("price_index_effective_raw")
    warn = F.array(
        F.when(F.col("_factor").isNull() & valid_sku(F.col("matched_sku")), F.when(F.col("_unit").isin("кг", "100г"), "no mass for the unit").when(F.col("_unit") == "л", "no volume for the unit").otherwise(F.concat(F.lit("unknown unit: "), "_unit"))),
        F.when(F.col("_cond") & F.col("comp_promo_price").isNotNull(), "conditional promo not applied"),
        F.when(F.col("_ow"), "own promo above regular"), F.when(F.col("_cw"), "competitor promo above regular"),
    )
    return df.select(
        *[F.col(c) for c in keep], "our_purchase_price", "our_sale_price", "our_promo_price",
        F.col("_reg").alias("comp_regular_unit_price"), F.col("_pro").alias("comp_promo_unit_price"),
        exact_round(F.col("_factor"), 6).alias("comp_pack_factor"), "comp_regular_price", "comp_promo_price",
        "comp_effective_price", "our_effective_price", "our_promo_applied", "comp_promo_applied", F.col("_cond").alias("conditional_promo"),
        exact_round(F.col("comp_regular_price") - F.col("our_sale_price"), 2).alias("regular_diff"),
        exact_round(F.col("comp_promo_price") - F.col("our_promo_price"), 2).alias("promo_diff"),
        exact_round(F.col("comp_effective_price") - F.col("our_effective_price"), 2).alias("effective_diff"),
        exact_round(F.col("price_index_regular_raw"), 1).alias("price_index_regular"),
        exact_round(pi, 1).alias("price_index_effective"), "price_index_effective_raw",
        F.when(pi > PARITY_BAND[1], OWN_CHEAPER).when(pi < PARITY_BAND[0], COMPETITOR_CHEAPER).when(pi.isNotNull(), PARITY).otherwise(UNKNOWN).alias("status"),
        F.when(F.col("is_dumping"), ALERT).alias("alert"), "is_dumping",
        F.array_distinct(F.concat("_prev", F.filter(warn, lambda x: x.isNotNull()))).alias("data_quality_warnings"),
    )


def summary_columns(columns: list[str]) -> list[Column]:
    """The 14 aggregates of a summary, for a global or a grouped aggregation."""
    ours, comp = positive_price(F.col("our_effective_price")), positive_price(F.col("comp_effective_price"))
    both = ours.isNotNull() & comp.isNotNull()
    ok = F.coalesce(F.col("extraction_status"), F.lit("")) == "ok" if "extraction_status" in columns else F.lit(True)
    n = lambda c: F.count_if(c)
    so, sc = F.sum(F.when(both, ours)), F.sum(F.when(both, comp))
    return [
        F.count("*").alias("total_items"), n(ok).alias("successful_recognitions"), (F.count("*") - n(ok)).alias("failed_recognitions"),
        n(valid_sku(F.col("matched_sku"))).alias("matched_items"),
        F.coalesce(exact_round(F.try_divide(n(valid_sku(F.col("matched_sku"))) * 100.0, F.count("*")), 1), F.lit(0.0)).alias("match_rate"),
        n(both).alias("comparable_items"), exact_round(F.avg(F.when(both, comp / ours * 100.0)), 1).alias("avg_price_index"),
        n(F.col("status") == OWN_CHEAPER).alias("own_cheaper_count"), n(F.col("status") == COMPETITOR_CHEAPER).alias("competitor_cheaper_count"),
        n(F.col("status") == PARITY).alias("parity_count"), n(F.col("is_dumping")).alias("dumping_alerts_count"),
        F.coalesce(exact_round(so, 2), F.lit(0.0)).alias("total_our_basket"), F.coalesce(exact_round(sc, 2), F.lit(0.0)).alias("total_comp_basket"),
        exact_round(F.try_divide(sc, so) * 100.0, 1).alias("basket_price_index"),
    ]


def summarize(metrics: DataFrame, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """One row (or one per group) of summary figures; an empty input gives zeros and NULL indices."""
    cols = summary_columns(metrics.columns)
    if not by:
        return metrics.agg(*cols)
    return (metrics.rollup(*by) if rollup else metrics.groupBy(*by)).agg(*cols)
