"""Loading a catalogue of unknown headers: header resolution, cleaning, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polka.functions.numeric import localized_number
from polka.functions.text import has_source_value, normalize_header, normalize_sku
from polka.operators.feeds import FIELD_HEADERS

FIELDS = ("sku", "name", "purchase_price", "sale_price", "promo_price")
PRICES = FIELDS[2:]
MAX_HEADER_SCAN = 25


class CatalogError(ValueError):
    """A catalogue that cannot be loaded without ambiguity."""


def header_key(text: object) -> str:
    """Driver-side twin of ``normalize_header`` for the few header cells of a file."""
    import re

    t = str(text).lstrip("﻿").strip().casefold().replace("ё", "е")
    return re.sub(r"[\W_]+", " ", re.sub(r"\.\d+$", "", t)).strip()


def field_targets(cells: list[object]) -> dict[str, list[int]]:
    """Which columns name each catalogue field; exact look-ups only."""
    names = {h: f for f in FIELDS for h in [*FIELD_HEADERS[f], f.replace("_", " ")]}
    out: dict[str, list[int]] = {}
    for i, c in enumerate(cells):
        if c is not None and (f := names.get(header_key(c))):
            out.setdefault(f, []).append(i)
    return out


def usable(targets: dict[str, list[int]]) -> bool:
    return "sku" in targets and "name" in targets and bool({"sale_price", "promo_price"} & targets.keys())


def resolve(df: DataFrame, order: str = "row_idx") -> tuple[DataFrame, int]:
    """The five catalogue columns as text, by header names or by a header found among the first rows.

    Returns them with ``row_idx`` and the number of rows that the header took. Of usable
    rows the one with the fewest doubled fields, then the most fields, then the first is the
    header. Raises :class:`CatalogError` for missing or doubled fields.
    """
    columns = [c for c in df.columns if c != order]
    targets, skipped, rows = field_targets(columns), 0, df
    if not usable(targets):
        head = df.orderBy(order).limit(MAX_HEADER_SCAN).collect()  # 25 rows
        ranked = []
        for k, r in enumerate(head):
            t = field_targets([r[c] for c in columns])
            if usable(t):
                ranked.append(((-sum(len(x) - 1 for x in t.values()), len(t), -k), t, r[order], k))
        if ranked:
            _, targets, at, k = max(ranked, key=lambda x: x[0])
            rows, skipped = df.where(F.col(order) > at), k + 1
    if not usable(targets):
        raise CatalogError("no usable header: sku, name and a price are needed")
    if any(len(x) > 1 for x in targets.values()):
        raise CatalogError("two columns for one field")
    cell = lambda f: F.col(f"`{columns[targets[f][0]]}`").cast("string") if f in targets else F.lit(None).cast("string")
    return rows.select(F.col(order).alias("row_idx"), *[cell(f).alias(f) for f in FIELDS]), skipped


def is_repeated_header(df: DataFrame) -> Column:
    named = lambda f: normalize_header(F.col(f)).isin(*FIELD_HEADERS[f])
    return F.coalesce(named("sku") & named("name") & (named("sale_price") | named("promo_price")), F.lit(False))


def _has_price(df: DataFrame) -> Column:
    return has_source_value(F.col("sale_price")) | has_source_value(F.col("promo_price")) | has_source_value(F.col("purchase_price"))


def skipped(df: DataFrame) -> DataFrame:
    """One row, ``skipped``: how many rows :func:`clean` leaves out, those with no cell filled not counted."""
    filled = df.na.drop("all", subset=list(FIELDS))
    return filled.agg(F.count_if(~_has_price(filled) | is_repeated_header(filled)).alias("skipped"))


def clean(df: DataFrame) -> DataFrame:
    """Rows with any price, without repeated headers; ``price_ok`` tells finite prices of 0 and more, 0 becomes NULL."""
    df = df.na.drop("all", subset=list(FIELDS))
    kept = df.where(_has_price(df) & ~is_repeated_header(df))
    values = {f"_{p}": F.when(has_source_value(F.col(p)), localized_number(F.col(p))) for p in PRICES}
    kept = kept.withColumns(values)
    ok = F.lit(True)
    for p in PRICES:
        ok = ok & (~has_source_value(F.col(p)) | F.coalesce(F.col(f"_{p}") >= 0, F.lit(False)))
    name = F.substring(F.trim("name"), 1, 500)
    return kept.select("row_idx", F.when(has_source_value(F.col("sku")), normalize_sku(F.col("sku"))).alias("sku"), F.when(has_source_value(F.col("name")), name).alias("name"), *[F.when(F.col(f"_{p}") > 0, F.col(f"_{p}")).alias(p) for p in PRICES], ok.alias("price_ok"))


def violations(cleaned: DataFrame) -> DataFrame:
    """One row: how many rows break each constraint, and up to five doubled skus."""
    doubled = cleaned.where(F.col("sku").isNotNull()).groupBy("sku").count().where("count > 1")
    top = doubled.orderBy("sku").limit(5).agg(F.array_join(F.array_sort(F.collect_list("sku")), ",").alias("doubled_skus"))
    n = doubled.agg(F.count("*").alias("doubled"))
    base = cleaned.agg(
        F.count("*").alias("rows"), F.count_if(F.col("sku").isNull() | F.col("name").isNull()).alias("no_identity"),
        F.count_if(~F.col("price_ok")).alias("bad_price"), F.count_if(F.col("sale_price").isNull() & F.col("promo_price").isNull()).alias("no_price"))
    return base.join(n).join(top)


def load_catalog(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """Resolve, clean and check; raises before anything is returned if a constraint is broken."""
    resolved, _ = resolve(df, order)
    out = clean(resolved)
    v = violations(out).first()
    if not v["rows"]:
        raise CatalogError("no rows with a price")
    for name in ("no_identity", "doubled", "bad_price", "no_price"):
        if v[name]:
            raise CatalogError(f"{name}: {v[name]} {v['doubled_skus'] if name == 'doubled' else ''}".strip())
    return out.drop("price_ok")
