"""Recognition payloads: strict JSON, semantic checks, the mock provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polka.functions.numeric import MAX_PRICE, exact_round, strict_double
from polka.functions.text import clean_text

UNITS = ["шт", "кг", "100г", "упак", "л"]
FIELDS = "struct<product_name:string,brand:string,weight_volume:string,regular_price:string,promo_price:string,promo_condition:string,unit:string,confidence:string,notes:string>"


def json_object(text: Column, limit: int = 100_000) -> Column:
    """The text of a strict JSON object without its code fence; NULL for anything else."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    good = (F.length(text) <= limit) & bare.startswith("{") & F.try_parse_json(bare).isNotNull()
    return F.when(good, bare)


def validate_payloads(df: DataFrame, text: str = "payload") -> DataFrame:
    """Adds the recognised fields and ``error_code`` (NULL if the payload is valid); nothing is raised.

    The first failing check names the error: ``json, confidence, unit, regular_price, promo_price,
    product_name``. Fields of a failing row are NULL.
    """
    df = df.withColumn("_o", F.from_json(json_object(F.col(text)), FIELDS))
    number = lambda c: strict_double(F.replace(F.trim(F.col(c)), F.lit(","), F.lit(".")))
    unit = F.lower(clean_text(F.col("_o.unit"), 20))
    df = df.withColumns({
        "_conf": strict_double(F.trim(F.col("_o.confidence"))), "_reg": number("_o.regular_price"), "_pro": number("_o.promo_price"),
        "_unit": F.when(unit.isin("упаковка", "уп"), "упак").when(unit == "100 г", "100г").otherwise(unit), "_name": clean_text(F.col("_o.product_name"), 300),
    })
    price_ok = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) <= MAX_PRICE), F.lit(False))
    promo_said = F.coalesce(F.col("_o.promo_price") != "", F.lit(False))
    error = (
        F.when(F.col("_o").isNull(), "json").when(~F.coalesce(F.col("_conf").between(0, 1), F.lit(False)), "confidence")
        .when(~F.coalesce(F.col("_unit").isin(*UNITS), F.lit(False)), "unit").when(~price_ok("_reg"), "regular_price")
        .when(promo_said & ~price_ok("_pro"), "promo_price").when(F.col("_name").isNull(), "product_name")
    )
    df = df.withColumn("error_code", error)
    ok = F.col("error_code").isNull()
    return df.select(
        *[c for c in df.columns if not c.startswith("_") and c != "error_code"], "error_code", F.when(ok, F.col("_name")).alias("product_name"),
        F.when(ok, clean_text(F.col("_o.brand"), 120)).alias("brand"), F.when(ok, clean_text(F.col("_o.weight_volume"), 80)).alias("weight_volume"),
        F.when(ok, exact_round(F.col("_reg"), 2)).alias("regular_price"), F.when(ok & promo_said, exact_round(F.col("_pro"), 2)).alias("promo_price"),
        F.when(ok, clean_text(F.col("_o.promo_condition"), 200)).alias("promo_condition"), F.when(ok, F.col("_unit")).alias("unit"),
        F.when(ok, exact_round(F.col("_conf"), 3)).alias("confidence"), F.when(ok, F.coalesce(clean_text(F.col("_o.notes"), 500), F.lit(""))).alias("notes"),
        F.when(ok, "ok").otherwise("error").alias("extraction_status"),
    )


def mock_choice(filename: Column, n: int = 4) -> Column:
    """Which of ``n`` fixed rows stands for a file: the sum of its code points modulo ``n``."""
    return F.aggregate(F.transform(F.split(filename, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c))), F.lit(0), lambda a, x: a + x) % n
