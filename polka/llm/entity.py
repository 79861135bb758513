"""Tags and catalogue items without a common key: candidates, evidence, belief propagation.

Candidates share a product-line word up to two edits, or are a candidate of another tag of the shelf place. Each candidate pair gets log-odds from
line, brand, kind, flavour, fat, contents and price. Loopy belief propagation with
one-to-one factors (a shelf place shows at most one item, an item stands at one place of
a visit) turns the odds into marginal probabilities; messages are exchanged through joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polka.llm.encoding import restore_texts
from polka.llm.forms import distance
from polka.llm.fuzzyjoin import similar_words
from polka.llm.product import Parser
from polka.functions.measures import in_kopecks, with_price_unit
from polka.operators.units import deliveries_once
from polka.session import cut, no_broadcasts

#: Pairs of one visit that a task solves in memory.
VISIT_PAIRS = 500_000

#: Dimensions by their codes; a price may also be for the whole contents.
DIMS, WHOLE = ("g", "ml", "pcs"), 3
CODED = "kind int, flavour int, fat double, dim int, total double, names string, joined string"
SHAPES = {"int": "int32", "double": "float64", "string": object}
#: What of an item decides whether a tag conflicts with it, and what else its evidence needs.
TRAITS = ["kind", "flavour", "fat", "dim", "total"]
ITEM = [*(f"i_{c}" for c in TRAITS), "i_names", "sale_price"]
SOUND = """
    not coalesce(flavour >= 0 and i_flavour >= 0 and kind = i_kind and flavour != i_flavour, false)
    and not coalesce(abs(fat - i_fat) > 0.05, false)
    and not coalesce(dim >= 0 and i_dim >= 0 and not (dim = i_dim and abs(total - i_total) <= 0.011 * greatest(total, i_total)), false)
"""

PARSED = "kind string, flavour string, fat double, dim string, total double, names array<string>, joined array<string>"


@dataclass(frozen=True)
class Evidence:
    """Log-odds that each observation adds; all are parameters."""

    base: float = 2.0
    per_edit: float = -1.5
    brand_same: float = 2.0
    brand_other: float = -4.0
    kind_same: float = 1.0
    kind_other: float = -6.0
    flavour_same: float = 2.0
    flavour_other: float = -12.0
    fat_same: float = 2.0
    fat_other: float = -12.0
    total_same: float = 2.0
    total_other: float = -12.0
    price_weight: float = 2.0
    price_sigma: float = 0.12
    none: float = 0.0


def parse_names(df: DataFrame, name: str, size: str | None = None) -> DataFrame:
    """Adds the columns of ``PARSED`` read from a product name (and a contents field)."""
    cols = [name] if size is None else [name, size]

    def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        parser = Parser()
        for batch in it:
            names, sizes = batch[0], batch[1] if len(batch) > 1 else [None] * len(batch[0])
            rows = []
            for n, s in zip(names, sizes, strict=True):
                p = parser.parse(n, s)
                rows.append((p.kind, parser.flavour(p.words, p.kind), p.fat, p.dim, p.total, p.names, parser.joined(p.words)))
            yield pd.DataFrame(rows, columns=["kind", "flavour", "fat", "dim", "total", "names", "joined"])

    def run1(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run((s,) for s in it)

    if size is None:
        def one(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from run1(it)
        udf = F.pandas_udf(one, PARSED)
    else:
        def two(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            yield from run(it)
        udf = F.pandas_udf(two, PARSED)
    return df.withColumn("_p", udf(*cols)).select(*df.columns, "_p.*")


def read_names(df: DataFrame, name: str, size: str | None = None) -> DataFrame:
    """As :func:`parse_names`, in few bytes: kind, flavour and dimension as numbers (-1 for none), words joined by spaces."""

    def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        parser = Parser()
        kinds = {k: i for i, k in enumerate(dict.fromkeys(k for k, _, _ in parser.ways))}
        flavours = {(k, f): i for k, fs in parser.flavours.items() for i, f in enumerate(fs)}
        dims = {d: i for i, d in enumerate(DIMS)}
        for batch in it:
            names, sizes = batch[0], batch[1] if len(batch) > 1 else [None] * len(batch[0])
            rows = []
            for n, s in zip(names, sizes, strict=True):
                p = parser.parse(n, s)
                f = parser.flavour(p.words, p.kind)
                rows.append((kinds.get(p.kind, -1), flavours.get((p.kind, f), -1), p.fat, dims.get(p.dim, -1), p.total, " ".join(p.names), " ".join(parser.joined(p.words))))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            shapes = [x.split() for x in CODED.split(", ")]
            yield pd.DataFrame({c: np.array(x, dtype=SHAPES[kind]) for (c, kind), x in zip(shapes, columns, strict=True)})

    def two(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from run(it)

    def one(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run((s,) for s in it)

    udf = F.pandas_udf(one, CODED)(name) if size is None else F.pandas_udf(two, CODED)(name, size)
    return df.withColumn("_p", udf).select(*df.columns, "_p.*")


def _words(names: str) -> Column:
    return F.explode(F.filter(F.split(names, " "), lambda w: w != ""))


def catalogue(items: DataFrame) -> DataFrame:
    """One row per sku: the restored name (of rows loaded twice the soundest, then latest), read by :func:`read_names`."""
    restored = restore_texts(items.select("row_id", "sku", "product_name", "sale_price", "loaded_at"))
    best = F.struct(F.col("restorable").cast("int"), "loaded_at", "row_id")
    one = restored.where(F.col("sku").isNotNull()).groupBy("sku").agg(F.max_by(F.struct("restored", "sale_price"), best).alias("b")).select("sku", F.col("b.restored").alias("name"), "b.sale_price")
    coded = read_names(one, "name")
    return coded.select("sku", "sale_price", *[F.col(c).alias(f"i_{c}") for c in (*TRAITS, "names")])


def line_words(cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lines, others)``: the words that name product lines, with their items, and all other words.

    A line's items are of one kind and share one more word, their brand; the words of
    brands and descriptions go with many kinds or with many other words.
    """
    words = cat.select(_words("i_names").alias("word"), "sku", *ITEM)
    beside = words.select("word", "i_names", "i_kind").select("word", "i_kind", F.explode(F.concat(F.array(F.lit("")), F.filter(F.split("i_names", " "), lambda w: w != F.col("word")))).alias("other"))
    # other = '': the word itself, once an item
    counted = beside.groupBy("word", "other").agg(F.count("*").alias("n"), F.min(F.when(F.col("i_kind") >= 0, F.col("i_kind"))).alias("low"), F.max("i_kind").alias("high"))
    own = F.col("other") == ""
    spread = counted.groupBy("word").agg(
        F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(~own, F.col("n"))).alias("together"), F.max(F.when(own, F.col("low"))).alias("low"), F.max(F.when(own, F.col("high"))).alias("high"))
    one_kind = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    spread = cut(spread.select("word", (one_kind & (F.coalesce("together", "n") == F.col("n"))).alias("line")), "spread")
    return words.join(spread.where("line"), "word").drop("line"), spread.where("not line").select("word")


def exact_candidates(tags: DataFrame, lines: DataFrame) -> DataFrame:
    """``tag_id, sku, line, edits`` and the ``ITEM`` columns: items one of whose line words a tag has.

    Of items that the tag conflicts with it only says that there are some, in rows without ``sku``.
    A line word of many tags is a skewed key of the join; adaptive execution splits it.
    """
    # three small numbers travel as one
    three = F.shiftleft(F.col("kind") + 1, 16) + F.shiftleft(F.col("flavour") + 1, 8) + F.col("dim") + 1
    said = tags.select("tag_id", three.alias("three"), "fat", "total", _words("names").alias("word"))
    part = lambda at: F.shiftright("three", at).bitwiseAND(F.lit(255)) - 1
    met = said.join(lines, "word").withColumns({"kind": F.shiftright("three", 16) - 1, "flavour": part(8), "dim": part(0)}).withColumn("sound", F.expr(SOUND))
    sound = lambda c: F.when(F.col("sound"), F.col(c))
    return met.select("tag_id", sound("sku").alias("sku"), sound("word").alias("line"), F.lit(0).alias("edits"), *[sound(c).alias(c) for c in ITEM])


def near_candidates(rest: DataFrame, lines: DataFrame, others: DataFrame) -> DataFrame:
    """As :func:`exact_candidates`, for line words that a tag has nearly, without items that it conflicts with.

    Tags that this finds nothing for are looked up by neighbouring words taken together.
    """
    single, known = _near(rest.select("tag_id", *TRAITS, _words("names").alias("word")), lines, others)
    broken = rest.where("joined != ''")
    found = broken.select("tag_id", _words("names").alias("word")).join(known, "word", "left_semi").select("tag_id").distinct()
    lost = broken.join(found, "tag_id", "left_anti")
    split, _ = _near(lost.select("tag_id", *TRAITS, _words("joined").alias("word")), lines, others)
    return single.unionByName(split)


def _near(said: DataFrame, lines: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates, and the words that any line word is near to."""
    loose = cut(said.where(F.length("word") >= 4).join(others, "word", "left_anti"), "loose")
    near = cut(similar_words(loose, lines), "near")
    items = near.join(lines.withColumnRenamed("word", "right_word"), "right_word").select(F.col("left_word").alias("word"), F.col("right_word").alias("line"), "edits", "sku", *ITEM)
    return loose.join(items, "word").where(SOUND).select("tag_id", "sku", "line", "edits", *ITEM), near.select(F.col("left_word").alias("word")).distinct()


def _verdict():
    """Whether the brands of a tag and an item agree (1), conflict (-1) or one is unsaid (0)."""

    def brand_words(brand: str | None) -> list[str]:
        from polka.llm.canon import readings

        if not brand or not brand.strip():
            return []
        return [w for how, text in readings(brand) if how in ("as", "key", "as1", "key1", "cut") for w in text.split()]

    def likeness(b: str, w: str) -> float:
        if abs(len(b) - len(w)) <= 3 and (d := distance(b, w, 3)) <= 3:
            return 1 - d / max(len(b), len(w), 1)
        return 0.8 if len(w) >= 3 and b.startswith(w) else 0.0

    def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        typed_of, alike = lru_cache(20_000)(brand_words), lru_cache(50_000)(likeness)

        def verdict(names: str | None, line: str, brand: str | None, said: str) -> int:
            same = [w for w in (names or "").split() if w != line]
            if not same:
                return 0
            typed, said = typed_of(brand), said.split()
            if any(b in said or b in typed for b in same) or any(alike(b, w) >= 0.6 for b in same for w in (*typed, *said)):
                return 1
            joined = "".join(same)
            if any(abs(len(joined) - len(w)) <= 3 and (d := distance(joined, w, 3)) <= 3 and 1 - d / max(len(joined), len(w)) >= 0.6 for w in typed):
                return 1
            return -1 if typed else 0

        for batch in it:
            yield pd.Series([verdict(*x) for x in zip(*batch, strict=True)], dtype="int32")

    def brand(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from run(it)

    return F.pandas_udf(brand, "int")


def parsed_tags(price_tags: DataFrame) -> DataFrame:
    """Tags with a name, each once, with what they say (contents, price unit) and their name as :func:`read_names` reads it.

    Rows are spread by ``tag_id``, read before that: what is shuffled is short.
    """
    df = price_tags.where(F.trim(F.coalesce("product_name", F.lit(""))) != "")
    df = df.select("tag_id", "store_id", "captured_at", "shelf_ref", "product_name", "brand", "weight_volume", "regular_price", "unit", "notes")
    kopecks, price = in_kopecks(F.col("unit")) | in_kopecks(F.col("notes")), F.col("regular_price")
    roubles = F.when((price > 0) & (price < float("inf")), F.when(kopecks, price / 100.0).otherwise(price))
    df = df.withColumn("stated_roubles", roubles).withColumn("_said", F.coalesce(F.nullif(F.trim("unit"), F.lit("")), "notes"))
    df = with_price_unit(df, "_said", "stated_dim", "stated_amount")
    codes = F.create_map(*[F.lit(x) for d in [*enumerate(DIMS), (WHOLE, "whole")] for x in d[::-1]])
    place = F.coalesce("shelf_ref", F.concat(F.lit("tag:"), F.col("tag_id").cast("string")))
    visit = F.concat_ws("/", F.col("store_id").cast("string"), F.col("day").cast("string"))
    df = df.withColumn("stated_dim", F.coalesce(F.try_element_at(codes, F.col("stated_dim")), F.lit(-1)))
    read = read_names(df, "product_name", "weight_volume")
    said = ["brand", "stated_roubles", "stated_dim", "stated_amount", *TRAITS, "names", "joined"]
    once = deliveries_once(_by_tag(read.select("tag_id", "shelf_ref", "store_id", F.to_date("captured_at").alias("day"), *said)))
    return once.select("tag_id", place.alias("place"), visit.alias("visit"), *said)


def _by_tag(df: DataFrame) -> DataFrame:
    """The rows where those of :func:`parsed_tags` of the same tag are, for joins without another shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tag_id")


def score_candidates(pairs: DataFrame, tags: DataFrame, evidence: Evidence = Evidence()) -> DataFrame:
    """``tag_id, place, sku, log_odds, brand_ok, kind_ok`` of candidate pairs without conflict (verdicts: 1 agrees, -1 conflicts, 0 unsaid).

    ``pairs`` must be spread by :func:`_by_tag`; of several line words of a pair the nearest counts.
    """
    e, c = evidence, F.col
    once = pairs.groupBy("tag_id", "sku").agg(F.min_by(F.struct("line", "edits", *ITEM), F.struct("edits", "line")).alias("b")).select("tag_id", "sku", "b.*")
    both = once.join(tags.drop("joined", "visit"), "tag_id")
    both = both.withColumn("brand_ok", _verdict()("i_names", "line", "brand", "names"))
    say = lambda ok, same, other: F.when(ok > 0, same).when(ok < 0, other).otherwise(0.0)
    kind = F.when((c("kind") >= 0) & (c("i_kind") >= 0), F.when(c("kind") == c("i_kind"), 1).otherwise(-1)).otherwise(0)
    # a tag read by its line word alone has no word that edits could count against
    s = F.lit(e.base) + F.lit(e.per_edit) * c("edits") * (8.0 / F.greatest(F.lit(5), F.when(c("line") == "", 9).otherwise(F.length("line"))))
    s = s + say(c("brand_ok"), e.brand_same, e.brand_other) + say(kind, e.kind_same, e.kind_other)
    s = s + F.when((c("flavour") >= 0) & (c("i_flavour") >= 0) & (c("kind") == c("i_kind")), e.flavour_same).otherwise(0.0)
    s = s + F.when(c("fat").isNotNull() & c("i_fat").isNotNull(), e.fat_same).otherwise(0.0)
    s = s + F.when((c("dim") >= 0) & (c("i_dim") >= 0) & c("total").isNotNull() & c("i_total").isNotNull(), e.total_same).otherwise(0.0)
    price, roubles = F.nullif(F.nanvl("sale_price", F.lit(None)), F.lit(0.0)), F.nullif(c("stated_roubles"), F.lit(0.0))
    per_amount = F.when((c("stated_dim") == c("i_dim")) & (c("i_dim") >= 0), F.try_divide(roubles * F.nullif(c("i_total"), F.lit(0.0)), c("stated_amount")))
    ratio = F.log(F.try_divide(F.when(c("stated_dim") == WHOLE, roubles).otherwise(per_amount), price))
    s = s + F.when(ratio.isNotNull(), e.price_weight * (1.0 - F.least(F.lit(4.0), F.pow(ratio / e.price_sigma / 2, 2)))).otherwise(0.0)
    return both.select("tag_id", "place", "sku", s.alias("log_odds"), "brand_ok", kind.alias("kind_ok"))


def _settle(rounds: int, tolerance: float, again: float):
    """The messages of whole visits, those of a batch at a time; the rows of a visit must be neighbours."""

    def codes(visit: np.ndarray, values: pd.Series) -> np.ndarray:
        return np.unique(visit * len(values) + pd.factorize(values)[0], return_inverse=True)[1]

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        visit = pd.factorize(df["visit"])[0]
        place, sku, w = codes(visit, df["place"]), codes(visit, df["sku"]), df["w"].to_numpy()
        back, settled, rows = np.ones(len(w)), np.zeros(len(w), bool), np.arange(len(w))
        v, p, i, x, b = visit, place, sku, w, back
        for _ in range(rounds):
            # place to item: belief in the item against all others the place may show
            believed = x * b
            to_item = x / (1.0 + np.maximum(np.bincount(p, believed)[p] - believed, 0.0))
            # item to place: how free the item is of the visit's other places
            others = np.maximum(np.bincount(i, to_item)[i] - to_item, 0.0)
            new = (1.0 + again * others) / (1.0 + others)
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            still = np.maximum.reduceat(np.abs(new - b), starts) <= tolerance
            b = 0.5 * b + 0.5 * new
            if still.any():
                still = np.repeat(still, np.diff(np.r_[starts, len(v)]))
                back[rows[still]], settled[rows[still]] = b[still], True
                rows, v, x, b = rows[~still], v[~still], x[~still], b[~still]
                if not len(rows):
                    break
                p, i = np.unique(p[~still], return_inverse=True)[1], np.unique(i[~still], return_inverse=True)[1]
        believed = w * back
        return df[["visit", "place", "sku"]].assign(probability=believed / (1.0 + np.bincount(place, believed)[place]), settled=settled)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for df in it:
            if not len(df):
                continue
            # the last visit of a batch may go on in the next
            other = df["visit"].to_numpy() != df["visit"].iat[-1]
            if other.any() or (held and held[-1]["visit"].iat[-1] != df["visit"].iat[-1]):
                n = int(other.sum())
                yield solve(pd.concat([*held, df.iloc[:n]], ignore_index=True))
                held = [df.iloc[n:]]
            else:
                held.append(df)
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def propagate(odds: DataFrame, rounds: int = 500, tolerance: float = 1e-3, again: float = 0.05, whole: int = VISIT_PAIRS) -> DataFrame:
    """Marginals of a matching by loopy belief propagation.

    ``odds`` has ``place`` (takes at most one item), ``visit``, ``sku`` (an item stands at one place
    of a visit; each further place costs the factor ``again``, since an item may be put up
    twice and tags without a shelf place repeat one) and ``log_odds`` against showing none. Each round sends place-to-item and
    item-to-place messages. A visit leaves when none of its messages moves by more than
    ``tolerance``; visits do not act on each other, so one of up to ``whole`` pairs is solved by one task, in memory; larger
    ones by aggregations and joins, round by round. ``rounds`` is only a
    safety bound: visits still moving after it raise ``RuntimeError``. Returns ``place, sku, probability``.
    """
    w = odds.select("place", "visit", "sku", F.exp(F.least(F.greatest("log_odds", F.lit(-30.0)), F.lit(30.0))).alias("w"))
    w = cut(w, "bp-odds")
    large = cut(w.groupBy("visit").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("visit"), "bp-large")
    any_large = bool(large.limit(1).count())
    small = w.join(large, "visit", "left_anti") if any_large else w
    runs = small.select("visit", "place", "sku", "w").repartition("visit").sortWithinPartitions("visit", "place", "sku")
    solved = cut(runs.mapInPandas(_settle(rounds, tolerance, again), "visit string, place string, sku string, probability double, settled boolean"), "bp-solved")
    moving = solved.where(~F.col("settled")).select("visit").distinct().count()
    if moving:
        raise RuntimeError(f"messages of {moving} visits still move by more than {tolerance} after {rounds} rounds")
    solved = solved.select("place", "sku", "probability")
    return solved.unionByName(_by_joins(w.join(large, "visit", "left_semi"), rounds, tolerance, again)) if any_large else solved


def _by_joins(w: DataFrame, rounds: int, tolerance: float, again: float) -> DataFrame:
    """As :func:`propagate`, for visits (``place, visit, sku, w``) too large for one task.

    Places that share no item with another of their visit need no messages; they are solved at once.
    """
    w = cut(w, "bp-large-odds")
    rivals = w.groupBy("visit", "sku").agg(F.count("*").alias("n")).where("n > 1").select("visit", "sku")
    tied = w.join(rivals, ["visit", "sku"], "left_semi").select("place").distinct()
    loopy = cut(w.join(tied, "place", "left_semi").withColumn("back", F.lit(1.0)), "bp-0")
    total = Window.partitionBy("place")
    by_item = Window.partitionBy("visit", "sku")
    settled, moving = [], None
    for k in range(1, rounds + 1):
        # place to item: belief in the item against all others the place may show
        sent = loopy.withColumn("all", F.sum(F.col("w") * F.col("back")).over(total))
        sent = sent.withColumn("to_item", F.col("w") / (1.0 + F.greatest(F.col("all") - F.col("w") * F.col("back"), F.lit(0.0))))
        # item to place: how free the item is of the visit's other places
        sent = sent.withColumn("load", F.sum("to_item").over(by_item))
        others = F.greatest(F.col("load") - F.col("to_item"), F.lit(0.0))
        sent = sent.withColumn("new", (1.0 + again * others) / (1.0 + others))
        sent = sent.select("place", "visit", "sku", "w", (0.5 * F.col("back") + 0.5 * F.col("new")).alias("back"), F.abs(F.col("new") - F.col("back")).alias("moved"))
        sent = cut(sent, f"bp-{k}")
        restless = cut(sent.groupBy("visit").agg(F.max("moved").alias("moved")).where(F.col("moved") > tolerance).select("visit"), f"restless-{k}")
        before, moving = moving, restless.count()
        sent = sent.drop("moved")
        if moving != before:
            settled.append(sent.join(restless, "visit", "left_anti").select(*w.columns, "back") if moving else sent.select(*w.columns, "back"))
        if not moving:
            break
        loopy = sent.join(restless, "visit", "left_semi")
    if moving:
        raise RuntimeError(f"messages of {moving} visits still move by more than {tolerance} after {rounds} rounds")
    every = w.join(tied, "place", "left_anti").withColumn("back", F.lit(1.0))
    for part in settled:
        every = every.unionByName(part)
    every = every.withColumn("all", F.sum(F.col("w") * F.col("back")).over(total))
    return every.select("place", "sku", (F.col("w") * F.col("back") / (1.0 + F.col("all"))).alias("probability"))


def match_tags(price_tags: DataFrame, items: DataFrame, evidence: Evidence = Evidence(), accept: float = 0.5) -> DataFrame:
    """``tag_id, sku, probability``: each tag with a name and its item, ``sku`` NULL if the catalogue lacks it.

    Tags without a name (failed recognitions) give no row. Ties in probability go to the smaller
    sku. A pair that conflicts in flavour, fat or contents is never accepted.
    """
    # all sides grow with the data; those of words are repeated for some 40 keys each
    with no_broadcasts(items.sparkSession):
        cat = cut(catalogue(items), "catalogue")
        lines, others = line_words(cat)
        lines = cut(lines, "lines")
        # read by several joins, which find the tags spread already
        tags = parsed_tags(price_tags).persist()
        try:
            return _matched(tags, cat, lines, others, evidence, accept)
        finally:
            tags.unpersist()


def _matched(tags: DataFrame, cat: DataFrame, lines: DataFrame, others: DataFrame, evidence: Evidence, accept: float) -> DataFrame:
    score = lambda pairs: score_candidates(pairs, tags, evidence)
    met = cut(exact_candidates(tags, lines), "met")
    exact = cut(score(_by_tag(met.where("sku is not null"))), "exact")
    # tags for which no item with exactly one of their words will do
    hits = _by_tag(met.select("tag_id", F.col("sku").isNotNull().alias("sound"))).groupBy("tag_id").agg(F.max("sound").alias("sound"))
    rest = tags.join(hits, "tag_id", "left").where("sound is null or not sound")
    rest = cut(rest.select("tag_id", *TRAITS, "names", "joined", F.col("sound").isNotNull().alias("hit")), "rest")
    near = score(_by_tag(near_candidates(rest, lines, others))).join(_by_tag(rest.select("tag_id", "hit")), "tag_id")
    # a tag that has a line word exactly may have misspelt another one, but then kind and brand must speak for that
    near = cut(near.where(~F.col("hit") | ((F.col("brand_ok") > 0) & (F.col("kind_ok") > 0))).drop("hit"), "near-scored")
    scored = exact.unionByName(near)
    places = cut(tags.groupBy("place").agg(F.count("*").alias("size"), F.min("visit").alias("visit"), F.collect_list("tag_id").alias("all")), "places")
    # a shelf place is recorded by a few tags that show one item: what one of them may show the others may, their line word lost
    shown = scored.groupBy("place", "sku").agg(F.collect_list("tag_id").alias("by"))
    missing = shown.join(places.where("size > 1").select("place", "all"), "place").select("sku", F.explode(F.array_except("all", "by")).alias("tag_id"))
    missing = missing.join(cat, "sku").select("tag_id", "sku", F.lit("").alias("line"), F.lit(3).alias("edits"), *ITEM)
    alike = _by_tag(missing).join(tags.select("tag_id", *TRAITS), "tag_id").where(SOUND).drop(*TRAITS)
    faint = cut(score(alike).where("kind_ok >= 0 and brand_ok >= 0"), "faint")
    located = scored.unionByName(faint).select("tag_id", "place", "sku", "log_odds")
    # the place adds up their evidence; a tag that nothing speaks for speaks against
    placed = located.groupBy("place", "sku").agg(F.sum("log_odds").alias("log_odds"), F.count("*").alias("tags"))
    placed = placed.join(places.drop("all"), "place").withColumn("log_odds", F.col("log_odds") - 4.0 * (F.col("size") - F.col("tags")))
    pairs = located.join(propagate(placed), ["place", "sku"])
    best = _by_tag(pairs).groupBy("tag_id").agg(F.max_by(F.struct("sku", "probability"), F.struct(F.col("probability"), F.col("log_odds"))).alias("b"))
    out = tags.select("tag_id").join(best.select("tag_id", "b.sku", "b.probability"), "tag_id", "left")
    return cut(out.select("tag_id", F.when(F.col("probability") >= accept, F.col("sku")).alias("sku"), "probability"), "matched")
