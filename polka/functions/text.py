"""Text normalisation and attribute extraction as Column expressions.

Every pattern starts with ``(?U)`` since Java's classes are ASCII otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from polka.functions.numeric import number_text

# Abbreviations and what they stand for, applied in this order.
ABBREVIATIONS = [
    (r"(?:мол\.?|м-ко)", "молоко"),
    (r"(?:масл\.?|м-ло)", "масло"),
    (r"слив(?:\.|очн)?", "сливочное"),
    (r"(?:у/паст\.?|у/п\.?|ультрапаст\.?|ульт\.)", "ультрапастеризованное"),
    (r"(?:паст\.?|пастериз)", "пастеризованное"),
    (r"(?:твор\.?|творож)", "творог"),
    (r"смет\.?", "сметана"),
    (r"колб\.?", "колбаса"),
    (r"(?:с/к|сырокопч)", "сырокопченая"),
    (r"(?:в/к|варенокопч)", "варено копченая"),
    (r"(?:п/к|полукопч)", "полукопченая"),
    (r"(?:пл/бут|пл\.бут|пэт)", "пэт бутылка"),
    (r"(?:т/пак|тетра|тетрапак)", "тетрапак"),
    (r"(?:ст/б|ст\.б|стекло)", "стекло"),
    (r"(?:ж/б|ж\.б|жесть)", "жесть"),
    (r"(?:упак\.?|уп\.)", "упаковка"),
    (r"(?:пак\.?|пакетик(?:ов)?)", "пакет"),
    (r"(?:в/с|высш\.с)", "высший сорт"),
    (r"сублим(?:ир)?\.?", "сублимированный"),
    (r"раств\.?", "растворимый"),
    (r"брусок", "брус"),
    (r"фас\.?", "фасованный"),
]

# Latin spellings of brands and their Cyrillic ones.
BRAND_SPELLINGS = {
    "nescafe": "нескафе", "greenfield": "гринфилд", "ritter sport": "риттер спорт", "ritter": "риттер",
    "makfa": "макфа", "uvelka": "увелка", "prostokvashino": "простоквашино", "jacobs": "якобс",
    "tess": "тесс", "richard": "ричард", "lipton": "липтон", "barilla": "барилла", "milka": "милка",
    "alpen gold": "альпен гольд", "hochland": "хохланд", "president": "президент", "danone": "данон",
    "vyazanka": "вязанка", "dobry": "добрый",
}

MAX_MEASURE = 10_000_000.0
MASS = r"(кг|kg|гр|г|g)"
VOLUME = r"(мл|ml|л|l)"


def decimal_text(text: Column) -> Column:
    t = F.translate(F.lower(text), "ё", "е")
    t = F.regexp_replace(t, r"(?<=\d),(?=\d)", ".")
    return F.regexp_replace(t, r"(?U)(?<=\d)\s+(?=\d{3}(?:\D|$))", "")


def normalize_header(text: Column) -> Column:
    t = F.translate(F.lower(F.trim(F.translate(text, "\ufeff", ""))), "ё", "е")
    t = F.regexp_replace(t, r"\.\d+$", "")
    return F.trim(F.regexp_replace(t, r"(?U)[\W_]+", " "))


def normalize_sku(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", None).otherwise(t)


def sku_of_number(x: Column) -> Column:
    """An integral number loses its fraction (``123.0`` is ``123``); NaN and infinities are NULL."""
    fin = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return F.when(fin == F.floor(fin), fin.cast("decimal(38,0)").cast("string")).otherwise(fin.cast("string"))


def measure(number: Column, unit: Column) -> Column:
    """Grams or millilitres; NULL beyond ten million or for numbers of over 32 characters."""
    x = F.when(F.length(number) <= 32, number.try_cast("double"))
    factor = F.when(unit.isin("кг", "kg", "л", "l"), 1000.0).otherwise(1.0)
    return F.when((x > 0) & (x <= MAX_MEASURE) & (x * factor <= MAX_MEASURE), x * factor)


def _measures(clean: Column, unit: str) -> Column:
    pattern = rf"(?U)(?<![\d.])(\d+(?:\.\d+)?)\s*{unit}\b"
    numbers = F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(clean, F.lit(pattern), F.lit(2))
    return F.filter(F.zip_with(numbers, units, measure), lambda v: v.isNotNull())


def attributes(text: Column) -> Column:
    """``struct<fat,volume_ml,weight_g,count>``; NULL members where the text has none.

    100 % is no fat content; the largest measure counts, with the total of the first
    multipack ``N x M unit`` among them. NULL text gives NULL members.
    """
    clean = decimal_text(F.coalesce(text, F.lit("")))
    fats = F.regexp_extract_all(clean, F.lit(r"(?U)(?<![\d.])(\d{1,2}(?:\.\d+)?)\s*%"), F.lit(1))
    fats = F.filter(F.transform(fats, lambda x: x.try_cast("double")), lambda v: (v > 0) & (v <= 90))
    pack = r"(?U)(?<!\d)(\d{1,3})\s*[xх×]\s*(\d+(?:\.\d+)?)\s*(кг|kg|мл|ml|л|l|гр|г|g)\b"
    n = F.regexp_extract(clean, pack, 1).try_cast("int")
    unit = F.regexp_extract(clean, pack, 3)
    total = measure(F.regexp_extract(clean, pack, 2), unit) * n
    total = F.when(total <= MAX_MEASURE, total)
    heavy = unit.isin("кг", "kg", "гр", "г", "g")
    none = F.array().cast("array<double>")
    weights = F.concat(_measures(clean, MASS), F.when(heavy & total.isNotNull(), F.array(total)).otherwise(none))
    volumes = F.concat(_measures(clean, VOLUME), F.when(~heavy & total.isNotNull(), F.array(total)).otherwise(none))
    pieces = F.regexp_extract(clean, r"(?U)(?<!\d)(\d{1,4})\s*(?:шт(?:ук)?|пак(?:етик(?:ов)?)?|таб(?:леток)?|капсул)(?!\w)", 1)
    return F.struct(
        F.try_element_at(fats, F.lit(1)).alias("fat"),
        F.rint(F.array_max(volumes)).cast("int").alias("volume_ml"),
        F.rint(F.array_max(weights)).cast("int").alias("weight_g"),
        F.coalesce(F.when(total.isNotNull(), n), pieces.try_cast("int")).alias("count"),
    )


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out a single time however often ``f`` uses it: it is bound to a lambda's variable."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def _whole_units(clean: Column) -> Column:
    """Litres to ``мл`` and kilograms to ``г``, then units are glued to their numbers.

    The text is cut at its large measures; the pieces between are kept verbatim.
    """
    def smaller(clean: Column, *, unit: str, small: str) -> Column:
        pattern = rf"(?U)(\d+(?:\.\d+)?)\s*{unit}\b"
        whole = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
        numbers = F.regexp_extract_all(clean, F.lit(pattern), F.lit(1))
        between = F.split(clean, pattern, -1)
        large = F.lit("л" if small == "мл" else "кг")
        done = F.zip_with(whole, numbers, lambda w, x: F.coalesce(F.concat(number_text(measure(x, large), "0"), F.lit(small)), w))
        glued = F.array_join(F.zip_with(between, F.concat(done, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(clean.rlike(pattern), glued).otherwise(clean)

    for unit, small in ((r"(?:л|l)", "мл"), (r"(?:кг|kg)", "г")):
        clean = once(clean, partial(smaller, unit=unit, small=small))
    clean = F.regexp_replace(clean, r"(?U)(\d+(?:\.\d+)?)\s*(?:мл|ml)\b", "$1мл")
    return F.regexp_replace(clean, r"(?U)(\d+(?:\.\d+)?)\s*(?:гр|г|g)\b", "$1г")


def normalize_product_text(text: Column) -> Column:
    """Comparable form of a product name; '' for NULL or blank text.

    The replacements run only on texts that some pattern is in: where none is, none of them changes anything.
    """
    def abbreviations(t: Column) -> Column:
        full = t
        for pattern, word in ABBREVIATIONS:
            full = F.regexp_replace(full, rf"(?U)(?<!\w){pattern}(?!\w)", word)
        return F.when(t.rlike(rf"(?U)(?<!\w)(?:{'|'.join(p for p, _ in ABBREVIATIONS)})(?!\w)"), full).otherwise(t)

    def brands(t: Column) -> Column:
        full = t
        for latin in sorted(BRAND_SPELLINGS, key=lambda b: -len(b)):
            full = F.regexp_replace(full, rf"(?U)(?<!\w){re.escape(latin)}(?!\w)", BRAND_SPELLINGS[latin])
        return F.when(t.rlike("[a-z]{4}"), full).otherwise(t)

    t = once(once(decimal_text(F.coalesce(text, F.lit(""))), abbreviations), brands)
    t = _whole_units(t)
    t = F.regexp_replace(t, r"""[,/\\()\[\]{}"'«»№#;:_+—–-]""", " ")
    t = F.regexp_replace(t, r"(?U)(\d+(?:\.\d+)?)\s*%", "$1%")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def trigrams(text: Column) -> Column:
    """Distinct windows of three characters; none for shorter texts."""
    t = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(
        F.length(t) >= 3,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: t.substr(i, F.lit(3)))),
    ).otherwise(F.array().cast("array<string>"))


def clean_text(text: Column, limit: int) -> Column:
    """Control characters dropped, white space collapsed, cut; NULL where nothing is left."""
    t = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    t = F.substring(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), 1, limit)
    return F.when(t != "", t)


def has_source_value(text: Column) -> Column:
    """FALSE for NULL, blanks and the placeholders of price lists."""
    return F.coalesce(~F.lower(F.trim(text)).isin(*PLACEHOLDERS), F.lit(False))


# Cells that stand for "no value".
PLACEHOLDERS = ["", "-", "—", "нет", "n/a", "na", "nan", "none"]


def valid_sku(text: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(text)).isin("", "-", "nan", "none", "null", "<na>"), F.lit(False))


def sanitize_cell(text: Column, limit: int = 5000) -> Column:
    """Text that a spreadsheet cannot take for a formula."""
    t = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), 1, limit)
    return F.when(F.regexp_replace(t, r"(?U)^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)
