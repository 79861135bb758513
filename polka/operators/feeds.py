"""Delivered price lists as raw lines: strict parsing, rejects with reasons, drifting schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polka.functions.numeric import localized_number, localized_text
from polka.functions.text import has_source_value, normalize_header
from polka.session import cut, salted_join

# Header texts of each field, normalised (lower case, single spaces, no signs).
FIELD_HEADERS = {
    "sku": [
        "код товара", "код", "код номенклатуры", "код позиции", "код sku", "sku", "артикул", "арт",
        "product code", "product id", "item id", "code",
    ],
    "name": [
        "наименование товара", "наименование", "название товара", "товар", "номенклатура", "номенклатура товара",
        "наим", "наим товара", "описание товара", "продукт", "product name", "item name", "name",
    ],
    "purchase_price": [
        "цена закупки", "закупочная цена", "себестоимость", "себес", "закуп", "закупка", "закупочная",
        "закуп руб", "цена закуп", "purchase price", "purchaseprice", "cost price", "cost",
    ],
    "sale_price": [
        "цена продажи", "розничная цена", "регулярная цена", "цена", "цена продажи руб", "розница", "розничная",
        "цена розничная", "цена розн", "отпускная цена", "sale price", "saleprice", "retail price", "regular price", "price",
    ],
    "promo_price": [
        "цена на промо", "промо цена", "акционная цена", "цена по акции", "промо", "промо руб", "акция руб",
        "цена акция", "promo price", "promoprice", "discount price",
    ],
    "category": ["категория", "category", "раздел", "группа товара", "группа"],
    "barcode": ["штрихкод", "шк", "ean", "barcode"],
    "vat": ["ставка ндс", "ндс", "vat"],
    "country": ["страна", "страна происхождения", "country"],
    "stock": ["остаток", "остаток на складе", "наличие", "stock qty", "stock"],
    "pack_qty": ["кратность", "в коробе", "pack qty"],
    "shelf_life": ["срок годности", "годность", "shelf life"],
}
PRICES = ("purchase_price", "sale_price", "promo_price")
#: How many of the characters before a cell's text are no part of it.
_FIELD = r'("[^"]*+(?:""[^"]*+)*+"|[^"{sep}]*+)'


def field_of(header: Column) -> Column:
    """The field a header names; an unknown header is a field of its own (``x:<header>``)."""
    norm = normalize_header(header)
    pairs = [F.lit(x) for field, names in FIELD_HEADERS.items() for h in names for x in (h, field)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), norm), F.concat(F.lit("x:"), norm))


def _class_of(sep: Column) -> Column:
    return F.concat(F.lit(r"\x{"), F.lower(F.hex(F.ascii(sep))), F.lit("}"))


def _well_quoted(line: Column, sep: Column) -> Column:
    """Every cell is free of double quotes or quoted as a whole, and the line is complete."""
    one = F.replace(F.lit(_FIELD), F.lit("{sep}"), _class_of(sep))
    return F.rlike(F.concat(sep, line), F.concat(F.lit(r"^(?:"), _class_of(sep), one, F.lit(r")*+\z")))


def _cells(line: Column, sep: Column) -> Column:
    """Raw cells of a well-quoted line, unquoted."""
    one = F.replace(F.lit(_FIELD), F.lit("{sep}"), _class_of(sep))
    raw = F.regexp_extract_all(F.concat(sep, line), F.concat(_class_of(sep), one), F.lit(1))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def _header_text(cell: Column) -> Column:
    return F.regexp_replace(cell, r'^[\s"\x{feff}\x{a0}]+|[\s"\x{feff}\x{a0}]+$', "")


def read_headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file: ``file_id, feed_id, price_date, sep, header (array), fields (array)``.

    ``header`` is as written, without surrounding blanks, quotes and byte order mark.
    """
    first = lines.where(F.col("line_no") == 1).groupBy("file_id").agg(F.min("raw_text").alias("raw_text"))
    meta = files.groupBy("file_id").agg(F.min("feed_id").alias("feed_id"), F.min("price_date").alias("price_date"), F.min("sep_char").alias("sep"))
    h = meta.join(first, "file_id")
    text = F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"^\x{feff}", "")
    plain = F.split(text, F.concat(F.lit(r"\Q"), F.col("sep"), F.lit(r"\E")), -1)
    cells = F.when(_well_quoted(text, F.col("sep")), _cells(text, F.col("sep"))).otherwise(plain)
    h = h.withColumn("header", F.transform(cells, _header_text))
    return h.select("file_id", "feed_id", "price_date", "sep", "header", F.transform("header", field_of).alias("fields"))


def scan_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every distinct line after the header with its verdict; the base of all that follows.

    Adds ``well_quoted, cells, n_cells_ok, bad_price, heading, repeated_header``. A line
    stored twice counts once. Lines of files without a header line or without a row in
    ``files`` cannot be judged and are left to :func:`orphan_lines`.
    """
    body = lines.where(F.col("line_no") > 1).dropDuplicates(["file_id", "line_no"]).select("file_id", "line_no", "raw_text")
    df = salted_join(body, read_headers(files, lines), ["file_id"], F.col("line_no"))
    df = df.withColumn("_text", F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"^\x{feff}", ""))
    df = df.withColumn("well_quoted", _well_quoted(F.col("_text"), F.col("sep")))
    df = df.withColumn("cells", F.when(F.col("well_quoted"), _cells(F.col("_text"), F.col("sep"))))
    df = df.withColumn("n_cells_ok", F.col("well_quoted") & (F.size("cells") == F.size("header")))
    price = F.transform(F.arrays_zip(F.col("fields").alias("f"), F.col("cells").alias("c")), lambda z: F.when(z["f"].isin(*PRICES), z["c"]))
    bad = F.exists(price, lambda c: has_source_value(_bare(c)) & ~F.coalesce(localized_number(_bare(c)) >= 0, F.lit(False)))
    filled = F.filter(F.arrays_zip(F.col("fields").alias("f"), F.col("cells").alias("c")), lambda z: _bare(z["c"]) != "")
    same = F.array_join(F.transform("cells", lambda c: F.lower(_header_text(c))), "\x01") == F.array_join(F.transform("header", F.lower), "\x01")
    return df.select(
        "file_id", "line_no", "raw_text", "feed_id", "price_date", "header", "fields", "cells", "well_quoted", "n_cells_ok",
        F.coalesce(F.col("n_cells_ok") & bad, F.lit(False)).alias("bad_price"),
        F.coalesce(F.col("n_cells_ok") & (F.size(filled) == 1) & (filled[0]["f"] == "name"), F.lit(False)).alias("heading"),
        F.coalesce(F.col("n_cells_ok") & same, F.lit(False)).alias("repeated_header"),
    )


def _cell_of(field: str) -> Column:
    """A field's value in a conforming line; NULL where the file lacks it or the cell is a placeholder."""
    raw = F.filter(F.arrays_zip(F.col("fields").alias("f"), F.col("cells").alias("c")), lambda z: (z["f"] == field) & has_source_value(_bare(z["c"])))
    return _bare(F.try_element_at(raw, F.lit(1))["c"])


def _bare(cell: Column) -> Column:
    return F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")


def conforming(scan: DataFrame) -> DataFrame:
    """Strict load: lines that are well quoted, of the header's width and with usable prices."""
    return scan.where(F.col("well_quoted") & F.col("n_cells_ok") & ~F.col("bad_price") & ~F.col("heading") & ~F.col("repeated_header"))


def load_feed_lines(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(loaded, rejected)``: typed rows, and failing lines with the reason.

    The strict load keeps (file_id, line_no) offsets; what it did not take is the raw offsets
    minus the loaded ones (anti-join) and is diagnosed: ``quoting``, ``cell_count`` or
    ``price:<header>=<value>``. Section headings and repeated headers are neither loaded nor
    rejected. A NULL line has one empty cell. Empty tables give empty results.
    """
    scan = cut(scan_lines(files, lines), "feed-scan")
    good = conforming(scan)
    good = good.withColumns({f: _cell_of(f) for f in ("sku", "name", *PRICES)})
    loaded = good.select("file_id", "line_no", "feed_id", "price_date", "sku", "name", *[localized_number(F.col(p)).alias(p) for p in PRICES])
    rest = scan.join(conforming(scan).select("file_id", "line_no"), ["file_id", "line_no"], "left_anti").where(~F.col("heading") & ~F.col("repeated_header"))
    return loaded, diagnose(rest)


def diagnose(rest: DataFrame) -> DataFrame:
    """The first thing wrong with each line: ``file_id, line_no, raw_text, reason``."""
    cells = F.filter(
        F.arrays_zip(F.col("fields").alias("f"), F.col("cells").alias("c"), F.col("header").alias("h")),
        lambda z: z["f"].isin(*PRICES) & has_source_value(_bare(z["c"])) & ~F.coalesce(localized_number(_bare(z["c"])) >= 0, F.lit(False)),
    )
    first = F.try_element_at(cells, F.lit(1))
    reason = F.when(~F.col("well_quoted"), "quoting").when(~F.col("n_cells_ok"), "cell_count").otherwise(F.concat(F.lit("price:"), first["h"], F.lit("="), first["c"]))
    return rest.select("file_id", "line_no", "raw_text", reason.alias("reason"))


def orphan_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose file is not described or has no header line: ``file_id, line_no, raw_text, reason``."""
    known = files.select("file_id").distinct().join(lines.where("line_no = 1").select("file_id").distinct(), "file_id")
    return lines.dropDuplicates(["file_id", "line_no"]).join(known, "file_id", "left_anti").select("file_id", "line_no", "raw_text", F.lit("no header").alias("reason"))


def value_kind(cell: Column) -> Column:
    """``whole``, ``decimal``, ``date`` or ``text``; NULL for blanks and placeholders."""
    v = _bare(cell)
    number = localized_text(v)
    return F.when(~has_source_value(v), None).when(
        v.rlike(r"^(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}|\d{1,2}[-./]\d{1,2}[-./]\d{2})(?:[T ].*)?$"), "date"
    ).when(number.rlike(r"^[+-]?\d+$"), "whole").when(number.rlike(r"^[+-]?(?:\d+\.\d*|\.\d+)$"), "decimal").otherwise("text")


def field_kinds(scan: DataFrame) -> DataFrame:
    """``file_id, field, kind``: what most values of a field are, over its conforming lines.

    Of equally frequent kinds the later of whole, decimal, date, text is taken.
    """
    cells = conforming(scan).select("file_id", F.explode(F.arrays_zip(F.col("fields").alias("field"), F.col("cells").alias("cell"))).alias("z"))
    kinds = cells.select("file_id", F.col("z.field").alias("field"), value_kind(F.col("z.cell")).alias("kind")).where(F.col("kind").isNotNull())
    n = kinds.groupBy("file_id", "field", "kind").count()
    rank = F.array_position(F.array(*[F.lit(k) for k in ("whole", "decimal", "date", "text")]), F.col("kind"))
    return n.groupBy("file_id", "field").agg(F.max_by("kind", F.struct("count", rank)).alias("kind"))


def schema_versions(files: DataFrame, lines: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Versioned fingerprints: one row per file and field, ``version`` counts a feed's schemas.

    ``fingerprint`` covers the fields, headers (ignoring letter case) and kinds, not their order.
    Columns: ``feed_id, file_id, price_date, file_no, field, header, kind, fingerprint, version``.
    """
    scan = cut(scan_lines(files, lines), "feed-scan") if scan is None else scan
    heads = read_headers(files, lines)
    wide = heads.select("feed_id", "file_id", "price_date", F.explode(F.arrays_zip(F.col("fields").alias("field"), F.col("header").alias("header"))).alias("z"))
    cols = wide.select("feed_id", "file_id", "price_date", F.col("z.field").alias("field"), F.col("z.header").alias("header"))
    # two columns of one file may name the same field: the first counts, ties by header text
    cols = cols.groupBy("feed_id", "file_id", "price_date", "field").agg(F.min("header").alias("header"))
    cols = cut(cols.join(field_kinds(scan), ["file_id", "field"], "left"), "columns")
    sign = F.concat_ws("=", "field", F.lower("header"), F.coalesce("kind", F.lit("?")))
    prints = cols.groupBy("feed_id", "file_id", "price_date").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(sign))), 256).alias("fingerprint"))
    order = Window.partitionBy("feed_id").orderBy("price_date", "file_id")
    prints = prints.withColumn("file_no", F.row_number().over(order)).withColumn("_new", (~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order))).cast("int"))
    prints = prints.withColumn("version", F.sum("_new").over(order)).drop("_new")
    return cols.join(prints.drop("price_date"), ["feed_id", "file_id"])


def schema_changes(versions: DataFrame) -> DataFrame:
    """Migration steps from each file to the next of its feed by ``price_date``.

    ``feed_id, file_id, step, change_kind, field, column_header, old_header, old_kind,
    new_kind``; steps are ordered: renames, then defaults for removed fields, additions,
    casts. A kind is compared only where both files have values. The first file of a feed
    has no steps.
    """
    new = versions.select("feed_id", "file_no", "file_id", "field", F.col("header").alias("new_header"), F.col("kind").alias("new_kind"))
    old = versions.select("feed_id", (F.col("file_no") + 1).alias("file_no"), "field", F.col("header").alias("old_header"), F.col("kind").alias("old_kind"))
    ids = versions.select("feed_id", "file_no", F.col("file_id").alias("to_file")).distinct()
    both = new.join(old, ["feed_id", "file_no", "field"], "full").join(ids, ["feed_id", "file_no"]).where(F.col("file_no") > 1)
    kinds = F.filter(F.array(
        F.when(F.lower("new_header") != F.lower("old_header"), F.struct(F.lit(1).alias("n"), F.lit("renamed").alias("k"))),
        F.when(F.col("new_header").isNull(), F.struct(F.lit(2).alias("n"), F.lit("removed").alias("k"))),
        F.when(F.col("old_header").isNull(), F.struct(F.lit(3).alias("n"), F.lit("added").alias("k"))),
        F.when(F.col("new_kind") != F.col("old_kind"), F.struct(F.lit(4).alias("n"), F.lit("retyped").alias("k"))),
    ), lambda x: x.isNotNull())
    out = both.withColumn("c", F.explode(kinds))
    return out.select(
        "feed_id", F.col("to_file").alias("file_id"), F.col("c.n").alias("step"), F.col("c.k").alias("change_kind"), "field",
        F.coalesce("new_header", "old_header").alias("column_header"), "old_header", "old_kind", "new_kind",
    )


def unified_table(files: DataFrame, lines: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """All conforming lines of all files in one schema.

    Chained rules per file: rename headers to fields, default NULL for fields the file
    lacks, cast by kind. A feed whose prices turn from decimals to whole numbers of about a
    hundred times the size reports kopecks; these are cast back to roubles
    (``price_scale``). Unknown fields are kept in the map ``other``.
    """
    scan = cut(scan_lines(files, lines), "feed-scan") if scan is None else scan
    good = conforming(scan)
    typed = good.withColumns({f: _cell_of(f) for f in FIELD_HEADERS}).select(
        "file_id", "line_no", "feed_id", "price_date", "sku", "name",
        *[localized_number(F.col(p)).alias(p) for p in PRICES], *[value_kind(F.col(p)).alias(f"_{p}") for p in PRICES],
        *[f for f in FIELD_HEADERS if f not in (*PRICES, "sku", "name")],
        F.map_from_entries(F.filter(F.arrays_zip(F.col("fields").alias("k"), F.col("cells").alias("v")), lambda z: z["k"].startswith("x:"))).alias("other"),
    )
    # per feed and field, the usual size of decimal and of whole values
    stack = F.explode(F.array(*[F.struct(F.lit(p).alias("field"), F.col(p).alias("v"), F.col(f"_{p}").alias("kind")) for p in PRICES])).alias("z")
    sizes = typed.select("feed_id", "file_id", stack).select("feed_id", "file_id", "z.*").where("v > 0")
    by_file = sizes.groupBy("feed_id", "file_id", "field").agg(F.percentile_approx("v", 0.5, 200).alias("median"), F.avg((F.col("kind") == "whole").cast("double")).alias("whole_share"))
    normal = by_file.where("whole_share <= 0.5").groupBy("feed_id", "field").agg(F.percentile_approx("median", 0.5, 200).alias("usual"))
    scale = by_file.join(normal, ["feed_id", "field"], "left").withColumn("s", F.when((F.col("whole_share") > 0.5) & (F.col("median") > 20 * F.col("usual")), 0.01).otherwise(1.0))
    scale = scale.groupBy("file_id").agg(*[F.max(F.when(F.col("field") == p, F.col("s"))).alias(f"scale_{p}") for p in PRICES])
    out = salted_join(typed, scale, ["file_id"], F.col("line_no"), how="left")
    priced = [F.when(F.col(f"_{p}") == "whole", F.col(p) * F.coalesce(f"scale_{p}", F.lit(1.0))).otherwise(F.col(p)).alias(p) for p in PRICES]
    rest = [f for f in FIELD_HEADERS if f not in (*PRICES, "sku", "name")]
    return out.select("file_id", "line_no", "feed_id", "price_date", "sku", "name", *priced, *rest, "other", F.coalesce("scale_sale_price", F.lit(1.0)).alias("price_scale"))
