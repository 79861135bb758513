"""Free-entered values mapped to a canonical list: token repair, then soft TF-IDF over whole entries.

Every distinct typed value is read in several ways (as written, look-alikes replaced, on the
other keyboard layout). Its words are repaired against the vocabulary of the list by
edit distance; entries are ranked by the weight of the words they share with the value.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polka.llm.forms import fold, one_script, retyped, to_cyrillic, to_latin
from polka.llm.fuzzyjoin import edits, keys_within, similar_words
from polka.session import cut

ACCEPT = 0.7
# Words that go with a brand and are no part of it.
WRAPPERS = re.compile(r"(?<!\w)(?:т\.\s?м\.|тм|завод|бренд|марка|торговая марка|россия|ооо|оао|ао)(?!\w)")
_WORDS = re.compile(r"[a-zа-я0-9&\-]+")


def _tokens(text: str) -> list[str]:
    t = WRAPPERS.sub(" ", text)
    out = []
    for w in _WORDS.findall(t):
        w = one_script(w.strip("-"))
        out += [x for x in re.split("-", w) if x] if re.search("[a-zа-я0-9]", w) else []
    return out


def readings(value: str) -> list[tuple[str, str]]:
    """(how, text) of the ways to read a typed value; words are separated by one space.

    ``as`` is as written, ``key`` on the Russian keyboard, each also joined to one word
    (``as1``, ``key1``); ``cut`` is a value that breaks off, ``head`` one that might, ``ini``
    one that begins with an initial.
    """
    low = fold(value.replace("\xa0", " ")).strip()
    out: dict[tuple[str, str], None] = {}
    stump = bool(re.search(r"(?:…|\.\.\.|[а-яa-z]\.)\W*$", low))
    tokens = _tokens(low)
    if tokens:
        cyr = [to_cyrillic(t) if re.search("[a-z]", t) else t for t in tokens]
        out["as", " ".join(cyr)] = None
        out["as1", "".join(cyr)] = None
        if stump or len("".join(cyr)) >= 5:
            out["cut" if stump else "head", "".join(cyr)] = None
        if len(tokens) > 1 and len(tokens[0]) == 1 and re.match(r"\W*\w\.", low):
            out["ini", cyr[0] + " " + "".join(cyr[1:])] = None
    if re.search(r"[a-z\[\];',.`]", low) and not re.search("[а-я]", low):
        key = _tokens(retyped(low))
        if key:
            out["key", " ".join(key)] = None
            out["key1", "".join(key)] = None
            if stump:  # a final point may be a letter or the end of a stump
                out["cut", "".join(_tokens(retyped(low.rstrip(". …"))))] = None
    return list(out)


def entry_forms(name: str) -> list[str]:
    """Words of a list entry in Cyrillic letters, also as they come back from Latin ones."""
    tokens = _tokens(fold(name))
    plain = [to_cyrillic(t) if re.search("[a-z]", t) else t for t in tokens]
    back = [to_cyrillic(to_latin(t)) if not re.search("[a-z]", t) else to_cyrillic(t) for t in tokens]
    return list(dict.fromkeys([" ".join(plain), " ".join(back)]))


def _readings(column: str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"how": h, "text": t} for h, t in readings(v)])

    return F.pandas_udf(run, "array<struct<how:string,text:string>>")(column)


def _forms(column: Column) -> Column:
    def run(names: pd.Series) -> pd.Series:
        return names.map(entry_forms)

    return F.pandas_udf(run, "array<string>")(column)


def map_values(values: DataFrame, entries: DataFrame, value: str = "brand", entry_id: str = "brand_id", entry: str = "brand_name", accept: float = ACCEPT) -> DataFrame:
    """One row per distinct non-blank value: ``value, entry_id, score``; ``entry_id`` 0 is unmatched.

    NULL and blank values give no row. Ties go to the smaller id. The soft TF-IDF of a reading
    and an entry is the sum over the reading's words of weight times similarity to the
    entry's nearest word, over the larger of both total weights; ``1 - edits/length`` is the
    similarity. An entry that begins with a broken-off value scores by the length of that.
    """
    typed = values.select(F.col(value).alias("value")).where(F.trim(F.translate("value", " ", " ")) != "").groupBy("value").agg(F.count("*").alias("n"))
    read = typed.withColumn("r", F.explode(_readings("value"))).select("value", "n", "r.how", "r.text")
    read = cut(read.where(F.length("text") > 0), "canon-readings")
    listed = entries.select(F.col(entry_id).cast("int").alias("entry_id"), F.explode(_forms(F.coalesce(F.col(entry), F.lit("")))).alias("form")).where(F.length("form") > 0)
    # one word forms: the whole entry without spaces; word forms: each word
    whole = listed.select("entry_id", "form", F.translate("form", " ", "").alias("word"), F.lit(True).alias("one"))
    words = listed.select("entry_id", "form", F.explode(F.split("form", " ")).alias("word"), F.lit(False).alias("one"))
    vocabulary = whole.unionByName(words).distinct()
    one = F.col("how").endswith("1")
    split = read.select("value", "how", "text", one.alias("one"), F.posexplode(F.when(one, F.array("text")).otherwise(F.split("text", " "))).alias("at", "word"))
    split = split.where("how not in ('cut', 'head', 'ini')")
    pairs = similar_words(split, vocabulary)
    longest = F.greatest(F.length("left_word"), F.length("right_word"))
    pairs = pairs.select(F.col("left_word").alias("word"), F.col("right_word"), (1.0 - F.col("edits") / longest).alias("sim"))
    # weights over all entries: rarer words of the list say more
    n_entries = F.lit(float(max(1, entries.count())))
    idf = words.select("entry_id", "word").distinct().groupBy("word").agg(F.log1p(n_entries / F.count("*")).alias("idf"))
    total = words.join(idf, "word").groupBy("entry_id", "form").agg(F.sum("idf").alias("entry_weight"))
    hit = split.join(pairs, "word").join(vocabulary.withColumnRenamed("word", "right_word"), ["right_word", "one"])
    hit = hit.join(idf.withColumnRenamed("word", "right_word"), "right_word", "left").withColumn("idf", F.coalesce("idf", F.lit(1.0)))
    best = hit.groupBy("value", "how", "text", "one", "entry_id", "form", "at").agg(F.max(F.struct(F.col("idf") * F.col("sim"), F.col("idf"))).alias("b"))
    score = best.groupBy("value", "how", "text", "one", "entry_id", "form").agg(F.sum("b.col1").alias("got"), F.sum("b.idf").alias("seen"), F.count("*").alias("k"))
    score = score.join(total, ["entry_id", "form"])
    n_words = F.size(F.split("text", " "))
    stray = F.greatest(n_words - F.col("k"), F.lit(0)) * F.log1p(n_entries)
    score = score.withColumn("score", F.when(F.col("one"), F.col("got")/F.col("seen")).otherwise(F.col("got") / (F.greatest("entry_weight", "seen") + stray)))
    # values that break off: entries that begin with them, up to an edit where a sign says so;
    # they meet the beginnings of nearby length on equal deletions
    n_cut = F.length("text")
    few = F.when((n_cut <= 5) | (F.col("how") == "head"), 0).when(n_cut <= 8, 1).otherwise(2)
    stump = read.where("how in ('cut', 'head')").select("value", "how", "text", few.alias("allowed"))
    stump = stump.withColumn("k", F.explode(keys_within(F.col("text"), F.col("allowed"))))
    starts = whole.where("length(word) > 1").select("entry_id", F.col("word").alias("whole"), F.explode(F.expr("transform(sequence(1, length(word) - 1), n -> substring(word, 1, n))")).alias("start")).distinct()
    n_start = F.length("start")
    # a value may be longer than the beginning by its edits: 6 letters may have one, 9 two
    starts = starts.withColumn("k", F.explode(keys_within(F.col("start"), F.when(n_start <= 4, 0).when(n_start <= 6, 1).otherwise(2))))
    cuts = stump.join(starts, "k").select("value", "text", "allowed", "entry_id", "start").distinct()
    cuts = cuts.where(F.abs(n_cut - n_start) <= F.col("allowed")).withColumn("e", edits(F.col("text"), F.col("start"))).where("e <= allowed")
    # of one or two letters only those that a single entry begins with say which is meant
    cuts = cuts.withColumn("meant", F.size(F.collect_set("entry_id").over(Window.partitionBy("value", "text")))).where("length(text) >= 3 or meant = 1")
    cuts = cuts.select("value", "entry_id", (0.9 - 0.1 * F.col("e") + 0.001 * n_cut).alias("score"))
    # an initial for the first word: the other words in full
    initial = read.where("how = 'ini'").select("value", F.substring("text", 1, 1).alias("i"), F.expr("substring(text, 3)").alias("rest"))
    tails = listed.where("form like '% %'").select("entry_id", F.substring("form", 1, 1).alias("i"), F.translate(F.expr("substring(form, locate(' ', form) + 1)"), " ", "").alias("tail"))
    initials = initial.join(tails, "i").withColumn("e", edits(F.col("rest"), F.col("tail")))
    initials = initials.where((F.col("e") <= 1) & (F.col("e") * 3 < F.length("tail"))).select("value", "entry_id", (0.95 - 0.1 * F.col("e")).alias("score"))
    every = score.select("value", "entry_id", "score").unionByName(cuts).unionByName(initials).groupBy("value", "entry_id").agg(F.max("score").alias("score"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), "entry_id"))).where("rank = 1")
    out = typed.join(ranked, "value", "left")
    ok = F.coalesce(F.col("score") >= accept, F.lit(False))
    return out.select("value", F.when(ok, F.col("entry_id")).otherwise(0).alias("entry_id"), "score", "n")


def canonical_brands(tags: DataFrame, brands: DataFrame) -> DataFrame:
    """``tag_id, brand, brand_id`` of every tag with a non-blank brand; 0 where the list lacks it."""
    once = tags.select("tag_id", "brand").where(F.trim(F.translate("brand", " ", " ")) != "").distinct()
    mapped = map_values(once, brands)
    exact = brands.groupBy(F.col("brand_name").alias("brand")).agg(F.min("brand_id").cast("int").alias("exact_id"))
    out = once.join(mapped.select(F.col("value").alias("brand"), "entry_id"), "brand").join(exact, "brand", "left")
    return out.select("tag_id", "brand", F.coalesce("exact_id", "entry_id").cast("int").alias("brand_id"), F.col("exact_id").isNotNull().alias("exact"))


