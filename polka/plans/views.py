"""Domain views over the star schema, in Spark; :mod:`polka.plans.oracles` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polka.functions.text import attributes
from polka.session import table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def catalog(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("row_idx"), F.col("p_partkey").cast("string").alias("sku"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat((F.col("p_size") * 10).cast("string"), F.lit("g"))).alias("name"),
        (F.col("p_retailprice") * 0.8).alias("purchase_price"), F.col("p_retailprice").alias("sale_price"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") * 0.95).alias("promo_price"), "p_brand", "p_type",
    )


def observation(spark: SparkSession, d: str) -> DataFrame:
    """A competitor's tag for each line item: price per piece, kg, 100 g or litre by line number."""
    c = catalog(spark, d).withColumn("attrs", attributes(F.col("name"))).select("row_idx", "name", "attrs", "purchase_price", "sale_price", F.col("promo_price").alias("our_promo"), "p_brand", "p_type")
    df = table(spark, d, "lineitem").join(c, F.col("l_partkey") == F.col("row_idx"))
    unit = F.element_at(F.array(*[F.lit(u) for u in ("шт", "кг", "100 г", "упаковка", "л")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    pack = F.col("sale_price") * (0.92 + 2.0 * F.col("l_discount"))
    price = F.when(F.col("l_linenumber") % 5 == 1, pack * 4.0).when(F.col("l_linenumber") % 5 == 2, pack * 0.4).otherwise(pack)
    return df.select(
        *KEY, "p_brand", "p_type", F.col("row_idx").cast("string").alias("matched_sku"), F.col("name").alias("matched_name"), F.col("name").alias("product_name"),
        F.col("purchase_price").alias("our_purchase_price"), F.col("sale_price").alias("our_sale_price"), F.col("our_promo").alias("our_promo_price"),
        price.alias("regular_price"), F.when(F.col("l_returnflag") == "R", price * 0.9).when(F.col("l_returnflag") == "A", price * 1.1).alias("promo_price"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 1), "1+1 при покупке двух").when(F.col("l_returnflag") == "R", "по карте").alias("promo_condition"),
        F.col("attrs").alias("matched_attrs"), unit.alias("unit"), F.when(F.col("l_quantity") > 49, 1.5).when(F.col("l_quantity") == 48, None).otherwise(1.0 - F.col("l_tax") * 6.0).alias("confidence"),
        F.when(F.col("l_quantity") == 1, "error").otherwise("ok").alias("extraction_status"),
    )


# opening, brand and amount of the goods below, by the number of the part
OPENINGS = ["Мол. у/паст", "М-ло слив.", "Сок ст/б", "Чай пак.", "Вода пл/бут", "Мука фас.", "Сыр в/с", "Колб. в/к"]
BRANDS = ["Danone", "Hochland", "Dobry", "Greenfield", "President", "Makfa", "Alpen Gold", "Milka"]


def goods(spark: SparkSession, d: str) -> DataFrame:
    """Parts under abbreviated Russian names with fat, volumes, weights, multipacks and counts: ``row_idx, p_type, name``."""
    p = table(spark, d, "part")
    kind, s = (F.col("p_partkey") % 8 + 1).cast("int"), F.col("p_size")
    amounts = [
        F.format_string("%d,%d%% %d мл", F.floor(s / 2), s % 2 * 5, s * 20), F.format_string("82,5 %% %d г", s * 10), F.format_string("%d x 200 мл", s), F.format_string("%d шт", s),
        F.format_string("%d,5 л", s), F.format_string("%d кг", s), F.format_string("100%% %dгр", s * 10), F.format_string("1 %03d г", s),
    ]
    pick = lambda xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), kind)
    return p.select(F.col("p_partkey").alias("row_idx"), "p_type", F.concat_ws(" ", pick(OPENINGS), "p_name", pick(BRANDS), pick(amounts)).alias("name"))
