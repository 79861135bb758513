"""Contents and price units as they stand on tags, in many notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first three letters of a unit word, its base dimension, how many base units one is.
UNITS = {
    "кг": ("g", 1000.0), "kg": ("g", 1000.0), "кил": ("g", 1000.0),
    "г": ("g", 1.0), "гр": ("g", 1.0), "гра": ("g", 1.0), "g": ("g", 1.0), "gr": ("g", 1.0),
    "мл": ("ml", 1.0), "ml": ("ml", 1.0), "мил": ("ml", 1.0),
    "сл": ("ml", 10.0), "cl": ("ml", 10.0), "сан": ("ml", 10.0),
    "л": ("ml", 1000.0), "l": ("ml", 1000.0), "лит": ("ml", 1000.0),
    "шт": ("pcs", 1.0), "шту": ("pcs", 1.0), "pcs": ("pcs", 1.0), "pc": ("pcs", 1.0), "дес": ("pcs", 10.0),
}
ANY = (
    r"кг|kg|кило(?:грамм\w*)?|грамм\w*|гр|gr|г|g|миллилитр\w*|мл|ml|сантилитр\w*|сл|cl|литр\w*|л|l|"
    r"шт(?:ук\w*)?|pcs|pc|десят\w*"
)
_NUM = r"(\d+(?:\.\d+)?)"


def tidy(text: Column) -> Column:
    """Lower case, ё as е, decimal commas as points, thousands joined (``1 000 г``)."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё\u00a0\u202f\u2009", "е   ")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d)", ".")
    return F.regexp_replace(t, r"(?U)(?<![\w.№#/])(\d{1,3}) (\d{3})(?![\d.])(?=\s*(?:" + ANY + r")(?!\w))", "$1$2")


def _unit(word: Column, part: int) -> Column:
    pairs = [F.lit(x) for stem, unit in UNITS.items() for x in (stem, unit[part])]
    return F.try_element_at(F.create_map(*pairs), F.substring(word, 1, 3))


def unit_dim(word: Column) -> Column:
    return _unit(word, 0)


def unit_factor(word: Column) -> Column:
    return _unit(word, 1)


def with_contents(df: DataFrame, text: str, dim: str, total: str) -> DataFrame:
    """Adds what a text says a product holds: ``dim`` (g, ml or pcs) and ``total``.

    ``8 шт по 17 г``, ``6х500мл`` and ``1/2 л`` are multiplied out; mass and volume come
    before pieces; of several the largest counts. NULLs where nothing is said. The
    steps are columns of their own, so that each pattern is met once a row.
    """
    pack = rf"(?U)(?<![\w.])(\d{{1,4}})\s*(?:шт\w*\.?|пак\w*\.?)?\s*(?:[xх×*]|по)\s*{_NUM}\s*({ANY})(?!\w)"
    frac = rf"(?U)(?<![\w./])(\d{{1,2}})/(\d{{1,2}})\s*({ANY})(?!\w)"
    one = rf"(?U)(?<![\w./])(?:\d{{1,4}}[xх×*])?{_NUM}\s*({ANY})(?!\w)"
    kept = df.columns
    df = df.withColumn("_t", tidy(F.col(text)))
    df = df.withColumns({
        "_p1": F.regexp_extract("_t", pack, 1).try_cast("double"), "_p2": F.regexp_extract("_t", pack, 2).try_cast("double"),
        "_pu": F.regexp_extract("_t", pack, 3),
        "_f1": F.regexp_extract("_t", frac, 1).try_cast("double"), "_f2": F.regexp_extract("_t", frac, 2).try_cast("double"),
        "_fu": F.regexp_extract("_t", frac, 3),
        "_n": F.regexp_extract_all("_t", F.lit(one), F.lit(1)), "_w": F.regexp_extract_all("_t", F.lit(one), F.lit(2)),
        "_half": F.when(F.col("_t").rlike(r"(?U)(?<!\w)(?:полкило|пол[- ]?кило(?:грамма)?)(?!\w)"), "g")
        .when(F.col("_t").rlike(r"(?U)(?<!\w)пол[- ]?литра(?!\w)"), "ml"),
    })
    df = df.withColumns({
        "_pd": unit_dim(F.col("_pu")), "_pt": F.col("_p1") * F.col("_p2") * unit_factor(F.col("_pu")),
        "_fd": unit_dim(F.col("_fu")), "_ft": F.try_divide("_f1", "_f2") * unit_factor(F.col("_fu")),
        "_all": F.zip_with("_n", "_w", lambda n, w: F.struct((n.try_cast("double") * unit_factor(w)).alias("t"), unit_dim(w).alias("d"))),
    })
    df = df.withColumns({
        "_big": F.array_max(F.filter("_all", lambda s: s["d"].isin("g", "ml") & (s["t"] > 0))),
        "_few": F.array_max(F.filter("_all", lambda s: (s["d"] == "pcs") & (s["t"] > 0))),
    })
    df = df.withColumn("_best", F.coalesce(
        F.when(F.col("_pt") > 0, F.struct(F.col("_pt").alias("t"), F.col("_pd").alias("d"))),
        F.when(F.col("_ft") > 0, F.struct(F.col("_ft").alias("t"), F.col("_fd").alias("d"))),
        F.when(F.col("_half").isNotNull(), F.struct(F.lit(500.0).alias("t"), F.col("_half").alias("d"))),
        "_big", "_few",
    ))
    return df.select(*[F.col(c) for c in kept if c not in (dim, total)], F.col("_best.d").alias(dim), F.col("_best.t").alias(total))


def with_price_unit(df: DataFrame, text: str, dim: str, amount: str) -> DataFrame:
    """Adds what a price is for: ``dim`` (g, ml, pcs, or ``whole`` for a piece or pack) and ``amount``.

    Takes both the short texts of a unit field (``руб/кг``, ``за 100 г``) and sentences
    (``указана цена за килограмм``). NULLs where the text names no unit.
    """
    word = rf"(?:{ANY}|упаковк\w*|упак|уп|пачк\w*)"
    alone = rf"(?U)^\s*(?:за\s+)?{_NUM}?\s*({word})\.?\s*$"
    said = rf"(?U)(?:(?<!\w)за|стоимость)\s+{_NUM}?\s*({word})(?!\w)"
    kept = df.columns
    df = df.withColumn("_t", F.regexp_replace(tidy(F.col(text)), r"(?U)\b(?:руб\w*|коп\w*|р)\.?\s*/\s*", "за "))
    df = df.withColumns({
        "_n": F.coalesce(F.regexp_extract("_t", alone, 1).try_cast("double"), F.regexp_extract("_t", said, 1).try_cast("double"), F.lit(1.0)),
        "_u": F.coalesce(F.nullif(F.regexp_extract("_t", alone, 2), F.lit("")), F.regexp_extract("_t", said, 2)),
    })
    df = df.withColumns({"_d": unit_dim(F.col("_u")), "_a": F.col("_n") * unit_factor(F.col("_u"))})
    df = df.withColumn("_whole", F.col("_u").rlike(r"(?U)^(?:упаковк\w*|упак|уп|пачк\w*)$") | (F.col("_d").eqNullSafe("pcs") & (F.col("_a") == 1.0)))
    return df.select(
        *[F.col(c) for c in kept if c not in (dim, amount)],
        F.when(F.col("_whole"), "whole").otherwise(F.col("_d")).alias(dim),
        F.when(F.col("_whole"), 1.0).when(F.col("_a") > 0, F.col("_a")).alias(amount),
    )


def in_kopecks(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"(?U)(?<!\w)коп"), F.lit(False))
