"""Listings of the same item: multi-pass sorted neighbourhoods of titles, soft token alignment, correlation clustering.

A title is the set of name words of a listing of one kind of goods. What words are to titles is learned
from the table itself: brands go with many kinds of goods and are loyal to product lines, advertising
goes with many kinds and is not, descriptions go with one kind and with many brands, and a product
line goes with one kind and one brand. Distinct titles are sorted in several token orders and
neighbours are aligned softly; the alignments, and an exact search for alike words that no
window brought together, say which spellings may be one word. Correlation clustering joins
spellings to product lines, and the distinct attribute signatures of a line to products.

Hot items do not matter: what is sorted are distinct titles and what is clustered are distinct
words and signatures, each with its counts.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polka.llm.entity import parse_names
from polka.llm.forms import distance
from polka.llm.fuzzyjoin import edits, keys_within
from polka.session import cut, salted_join

WINDOW = 8


def parsed_listings(listings: DataFrame) -> DataFrame:
    """Each listing once, parsed; rows without a name are left out."""
    once = listings.dropDuplicates(["listing_id"]).where(F.trim(F.coalesce("product_name", F.lit(""))) != "")
    df = parse_names(once.select("listing_id", "product_name", "weight_volume", "list_price"), "product_name", "weight_volume")
    return df.select("listing_id", "list_price", "kind", "fat", "dim", F.round("total", 0).alias("total"), "flavour", F.array_sort("names").alias("names"), "joined")


def with_kinds(df: DataFrame, least: int = 20) -> DataFrame:
    """Listings whose kind was not read get the kind that most listings with one of their words have.

    If there is none, the most used of their words stands for the kind if ``least`` listings have it, else ``?``.
    Adds ``title``, a digest of kind and name words.
    """
    words = df.select("listing_id", "kind", F.explode("names").alias("word"))
    usual = words.where("kind is not null").groupBy("word", "kind").count().groupBy("word").agg(F.max_by("kind", F.struct("count", "kind")).alias("usual"), F.count("*").alias("kinds"))
    lost = words.where("kind is null").select("listing_id", "word")
    guess = salted_join(lost, usual.where("kinds = 1"), ["word"], F.col("listing_id"), broadcast=False).groupBy("listing_id").agg(F.min("usual").alias("usual"))
    own = salted_join(lost, lost.groupBy("word").count().where(F.col("count") >= least), ["word"], F.col("listing_id"), broadcast=False).groupBy("listing_id").agg(F.max_by("word", F.struct("count", "word")).alias("common"))
    out = df.join(guess, "listing_id", "left").join(own, "listing_id", "left").withColumn("kind", F.coalesce("kind", "usual", "common", F.lit("?"))).drop("usual", "common")
    return out.withColumn("title", F.md5(F.concat_ws("\x1f", "kind", F.concat_ws(" ", "names"), F.concat_ws(" ", "joined"))))


def title_words(df: DataFrame) -> DataFrame:
    """``title, kind, n, word, own``: the words of each distinct title and how many listings have it.

    Two neighbouring words taken together count as a word (not ``own``) where the kind has that word.
    """
    titles = cut(df.groupBy("title").agg(F.first("kind").alias("kind"), F.first("names").alias("names"), F.first("joined").alias("joined"), F.count("*").alias("n")), "titles")
    own = titles.select("title", "kind", "n", F.explode("names").alias("word")).withColumn("own", F.lit(True))
    known = own.select("kind", "word").distinct()
    both = titles.select("title", "kind", "n", F.explode(F.array_except("joined", "names")).alias("word")).join(known, ["kind", "word"], "left_semi")
    return own.unionByName(both.select("title", "kind", "n", "word", F.lit(False).alias("own")))


def word_roles(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, used, kinds, top, role, brand`` and ``kind, word, n, role`` of all words.

    Of words in three or more kinds, none of which has over 0.8 of the uses, ``brand`` is the role of those
    that a product line they stand beside keeps (mean share of the line's listings at least 0.45; the line is
    stood for by the rarest word of a title), ``noise`` that of others. Of words of a kind used twelve
    times or more, those whose most frequent companion (among words of many kinds) goes with under 0.34 of them are
    ``description``; all others may be a ``line``. ``brand`` names brands of several words by one of them.
    """
    by_kind = words.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    used = cut(by_kind.groupBy("word").agg(F.sum("n").alias("used"), F.count("*").alias("kinds"), (F.max("n") / F.sum("n")).alias("top")), "word-use")
    spread = (F.col("kinds") >= 3) & (F.col("top") <= 0.8)
    own = salted_join(words.where("own").select("title", "kind", "n", "word"), used.select("word", "used", spread.alias("many")), ["word"], F.col("title"), broadcast=False)
    lists = cut(own.groupBy("title").agg(F.first("kind").alias("kind"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("used", "word", "many"))).alias("w")), "title-lists")
    # the companion of a word: the commonest other word of the title that many kinds have
    common = lists.select("kind", "n", "w", F.filter("w", lambda x: x["many"]).alias("m"))
    size = F.size("m")
    each = common.select("kind", "n", F.explode("w").alias("x"), F.get("m", size - 1)["word"].alias("last"), F.get("m", size - 2)["word"].alias("before"))
    word = F.col("x")["word"]
    beside = each.select("kind", word.alias("word"), F.when(word == F.col("last"), F.col("before")).otherwise(F.col("last")).alias("other"), "n").where("other is not null")
    firm = beside.groupBy("kind", "word", "other").agg(F.sum("n").alias("n")).groupBy("kind", "word").agg((F.max("n") / F.sum("n")).alias("firm"))
    lists = lists.select("title", "kind", "n", F.transform("w", lambda x: x["word"]).alias("w"))
    # how much of a line's listings have a word that stands beside it
    anchored = lists.select("kind", F.get("w", F.lit(0)).alias("line"), "n", "w")
    lines = anchored.groupBy("kind", "line").agg(F.sum("n").alias("of")).where("of >= 4")
    shares = anchored.select("kind", "line", "n", F.explode("w").alias("word")).where("word != line").groupBy("kind", "line", "word").agg(F.sum("n").alias("n"))
    loyal = shares.join(lines, ["kind", "line"]).groupBy("word").agg((F.sum(F.col("n") * F.col("n") / F.col("of")) / F.sum("n")).alias("loyal"))
    role = F.when(spread & (F.col("loyal") >= 0.45), "brand").when(spread, "noise")
    roles = cut(used.join(loyal, "word", "left").select("word", "used", "kinds", "top", role.alias("role")), "roles")
    # brands of several words: the word that goes with most uses of a word
    brands = roles.where("role = 'brand'").select("word")
    said = words.where("own").join(brands, "word", "left_semi").groupBy("title").agg(F.first("n").alias("n"), F.collect_set("word").alias("w")).where(F.size("w") > 1)
    pairs = said.select("n", F.explode("w").alias("word"), "w").select("n", "word", F.explode("w").alias("other")).where("word != other").groupBy("word", "other").agg(F.sum("n").alias("n"))
    partner = pairs.groupBy("word").agg(F.max_by("other", F.struct("n", "other")).alias("other"), F.max("n").alias("n"))
    roles = roles.join(partner, "word", "left").withColumn("partner", F.when(F.col("n") >= 0.6 * F.col("used"), F.col("other"))).drop("other", "n")
    roles = cut(roles.withColumn("brand", F.when(F.col("role") == "brand", F.least("word", F.coalesce("partner", "word")))), "word-roles")
    local = by_kind.join(firm, ["kind", "word"], "left").join(roles.select("word", "role"), "word")
    what = F.coalesce("role", F.when((F.col("n") >= 12) & (F.coalesce("firm", F.lit(1.0)) < 0.34), "description").otherwise("line"))
    return roles, cut(local.select("kind", "word", "n", what.alias("role")), "kind-words")


def _letters(word: str) -> int:
    mask = 0
    for ch in word:
        mask |= 1 << (ord(ch) & 63)
    return mask


def align(left: list[str], right: list[str], letters=_letters, most: int = 3) -> list[tuple[str, str, int]]:
    """Soft alignment of the words two titles do not share: ``(word, word, edits)`` of the spellings aligned.

    Each word of the shorter list takes the nearest free word of the other within ``most`` edits, at most a third
    of its letters; of equally near ones the first in the alphabet.
    """
    met = []
    if len(left) > len(right):
        left, right = right, left
    free = list(right)
    for x in left:
        best = None
        for y in free:
            n = max(len(x), len(y))
            limit = min(most, n // 3)
            if abs(len(x) - len(y)) <= limit and (letters(x) ^ letters(y)).bit_count() <= 2 * limit:
                d = distance(x, y, limit)
                if d <= limit and (best is None or (d, y) < best):
                    best = (d, y)
        if best:
            d, y = best
            free.remove(y)
            met.append((x, y, d))
    return met


def neighbours(lists: DataFrame, window: int = WINDOW, alike: float = 0.75) -> DataFrame:
    """``kind, a, b, edits, votes``: spellings that soft alignment of neighbouring titles brought together.

    ``lists`` has ``title, kind, words`` (struct of word and weight, rarest first). Four passes sort all
    titles of all kinds by kind and their words: rarest first, commonest first, letters from the end, and
    consonants only. Partitions are ranges of the sort key; the first ``window`` titles of
    each are also given to the one before, so that the window crosses their borders. Titles are alike if at most
    ``1 - alike`` of the weight of their words is lost, equal words losing none and aligned ones by their edits.
    """
    lists = lists.select("title", "kind", F.transform("words", lambda x: x["word"]).alias("names"), F.transform("words", lambda x: x["weight"]).alias("weights"))
    w = F.col("names")
    orders = {"r": w, "c": F.reverse(w), "e": F.transform(w, F.reverse), "k": F.transform(w, lambda x: F.concat(F.regexp_replace(x, "[аеиоуыэюяйь]", ""), F.lit("~"), x))}
    passes = lists.select("title", "kind", "names", "weights", F.explode(F.array(*[F.concat(F.lit(p), F.col("kind"), F.lit("\x1f"), F.concat_ws(" ", o)) for p, o in orders.items()])).alias("key"))
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(passes.repartitionByRange(4 * tasks, "key", "title").withColumn("part", F.spark_partition_id()).withColumn("again", F.lit(False)), "ranges")
    first = Window.partitionBy("part").orderBy("key", "title")
    heads = ranged.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= window).drop("rank")
    order = ranged.select("part").distinct().withColumn("before", F.lag("part").over(Window.orderBy("part")))  # one row per partition
    heads = heads.join(F.broadcast(order), "part").where("before is not null").select("title", "kind", "names", "weights", "key", F.col("before").alias("part"), F.lit(True).alias("again"))
    runs = ranged.unionByName(heads).repartition("part").sortWithinPartitions("part", "again", "key", "title")

    def run(it):
        letters = lru_cache(100_000)(_letters)
        held: deque = deque(maxlen=window)
        last = None
        for df in it:
            out = []
            for kind, names, weights, key, part, again in zip(df["kind"], df["names"], df["weights"], df["key"], df["part"], df["again"], strict=True):
                if part != last:
                    held.clear()
                    last = part
                mine, order = dict(zip(names, weights, strict=True)), (key[0], kind)
                words, total = mine.keys(), sum(weights)
                for other_order, theirs, other_total, seen in held:
                    if (again and seen) or other_order != order:
                        continue
                    left, right = [x for x in theirs if x not in mine], [y for y in words if y not in theirs]
                    if not left or not right:
                        continue
                    met = align(left, right, letters)
                    if met:
                        lost = sum(theirs[x] for x in left) + sum(mine[y] for y in right)
                        for x, y, d in met:
                            pair = theirs.get(x, 0.0) + mine.get(x, 0.0) + theirs.get(y, 0.0) + mine.get(y, 0.0)
                            lost -= pair * (1 - d / max(len(x), len(y)))
                        if lost <= (1 - alike) * (total + other_total):
                            out += [(kind, min(x, y), max(x, y), d, 1) for x, y, d in met]
                held.append((order, mine, total, again))
            yield pd.DataFrame(out, columns=["kind", "a", "b", "edits", "votes"])

    met = runs.select("kind", "names", "weights", "key", "part", "again").mapInPandas(run, "kind string, a string, b string, edits int, votes bigint")
    return met.groupBy("kind", "a", "b", "edits").agg(F.sum("votes").alias("votes"))


def alike_words(words: DataFrame) -> DataFrame:
    """``kind, a, b, edits``: all distinct words of a kind that one edit parts, by equal deletions.

    Finds what no window brought together; words under four letters are alike to none.
    """
    cuts = words.where(F.length("word") >= 4).select("kind", "word", F.explode(keys_within(F.col("word"), F.lit(1))).alias("k"))
    met = cuts.withColumnRenamed("word", "a").join(cuts.withColumnRenamed("word", "b"), ["kind", "k"]).where("a < b").select("kind", "a", "b").distinct()
    return met.where(F.abs(F.length("a") - F.length("b")) <= 1).withColumn("edits", edits(F.col("a"), F.col("b"))).where("edits <= 1")


def pivots(words: DataFrame, links: DataFrame) -> DataFrame:
    """``kind, word, canon``: correlation clustering of words by pivots, in rounds.

    ``links`` (``kind, word, up, edits, m``) lead from a word to the alike words that come before it. In each round the
    undecided words that no undecided word comes before are pivots, and the undecided words alike to one
    join the nearest, of several the most used; so every member is alike to its own pivot.
    """
    linked = links.select("kind", "word").union(links.select("kind", F.col("up").alias("word"))).distinct()
    open_, done = cut(linked, "open"), []
    while open_.limit(1).count():
        undecided = open_.withColumnRenamed("word", "up")
        above = links.join(open_, ["kind", "word"], "left_semi").join(undecided, ["kind", "up"], "left_semi")
        above = cut(above, "above")
        top = cut(open_.join(above.select("kind", "word").distinct(), ["kind", "word"], "left_anti"), "pivots")
        joined = above.join(top.withColumnRenamed("word", "up"), ["kind", "up"], "left_semi").groupBy("kind", "word")
        joined = cut(joined.agg(F.max_by("up", F.struct(-F.col("edits"), "m", "up")).alias("canon")), "joined")
        done += [top.withColumn("canon", F.col("word")), joined]
        open_ = cut(open_.join(top.unionByName(joined.drop("canon")), ["kind", "word"], "left_anti"), "open")
    canon = None
    for part in done:
        canon = part if canon is None else canon.unionByName(part)
    if canon is None:
        return words.select("kind", "word", F.col("word").alias("canon"))
    return words.select("kind", "word").join(canon, ["kind", "word"], "left").select("kind", "word", F.coalesce("canon", "word").alias("canon"))


def spellings(words: DataFrame, roles: DataFrame, local: DataFrame, window: int = WINDOW) -> DataFrame:
    """``kind, word, canon``: the word each word of a kind is a spelling of.

    A rare word is a misspelt brand or description only if it does not stand beside a brand of its own (but for the other
    word of that brand). Two words of product lines are one if they go with the same brand, if the
    alignment of neighbouring titles brought them together, or if a brand is unknown and one edit parts them;
    never if they go with different brands.
    """
    own = words.where("own")
    # rare words weigh more: common ones are brands and advertising
    weighed = salted_join(own.select("title", "kind", "word"), roles.select("word", "used", "brand"), ["word"], F.col("title"), broadcast=False)
    weight = 1.0 + 4.0 / (1.0 + F.log1p("used"))
    lists = weighed.groupBy("title").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("used", "word", weight.alias("weight")))).alias("words"))
    lists = lists.select("title", "kind", F.transform("words", lambda x: F.struct(x["word"].alias("word"), x["weight"].alias("weight"))).alias("words"))
    aligned = neighbours(lists, window)
    alike = alike_words(local).withColumn("votes", F.lit(0).cast("bigint")).unionByName(aligned)
    alike = cut(alike.groupBy("kind", "a", "b").agg(F.min("edits").alias("edits"), F.sum("votes").alias("votes")), "alike")
    # the brand words beside a word, of its own titles
    brands = weighed.where("brand is not null").groupBy("title").agg(F.min("brand").alias("brand"))
    said = own.select("title", "kind", "word", "n").join(roles.where("role = 'brand'").select("word"), "word", "left_anti").join(brands, "title", "left")
    beside = said.groupBy("kind", "word", "brand").agg(F.sum("n").alias("c"))
    beside = beside.groupBy("kind", "word").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("brand").isNotNull(), F.col("c"))).alias("known"), F.max_by("brand", F.when(F.col("brand").isNotNull(), F.struct("c", "brand"))).alias("brand"), F.max(F.when(F.col("brand").isNotNull(), F.col("c"))).alias("most"))
    beside = beside.select("kind", "word", (F.coalesce("known", F.lit(0)) / F.col("all")).alias("branded"), F.when(F.col("most") >= 0.6 * F.col("known"), F.col("brand")).alias("with"))
    facts = local.join(beside, ["kind", "word"], "left").join(roles.select("word", "brand", "used"), "word")
    facts = cut(facts.select("kind", "word", "n", "role", "branded", "with", "brand", "used"), "facts")
    both = alike.select("kind", F.col("a").alias("word"), F.col("b").alias("up"), "edits", "votes").unionByName(alike.select("kind", F.col("b").alias("word"), F.col("a").alias("up"), "edits", "votes"))
    up = facts.select("kind", F.col("word").alias("up"), F.col("n").alias("m"), F.col("role").alias("up_role"), F.col("with").alias("up_with"), F.col("brand").alias("up_brand"), F.col("used").alias("up_used"))
    both = both.join(facts, ["kind", "word"]).join(up, ["kind", "up"])
    within = F.col("edits") <= F.when(F.greatest(F.length("word"), F.length("up")) <= 6, 1).otherwise(2)
    rare = F.col("used") * 3 <= F.col("up_used")
    to_brand = (F.col("up_role") == "brand") & F.col("role").isin("line", "noise") & rare & within & ((F.coalesce("branded", F.lit(0.0)) < 0.5) | (F.col("with") == F.col("up_brand")))
    to_plain = F.col("up_role").isin("description", "noise") & (F.col("role") == "line") & rare & within
    before = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("up") < F.col("word")))
    unknown = F.col("with").isNull() | F.col("up_with").isNull()
    same = (F.col("with") == F.col("up_with")) | (unknown & ((F.col("edits") <= 1) | (F.col("votes") > 0)))
    seldom = (F.col("n") <= 2) | (F.col("n") * 3 <= F.col("m"))  # what is misspelt is rarer than what is meant
    to_line = (F.col("up_role") == "line") & (F.col("role") == "line") & before & seldom & same
    links = cut(both.where(to_brand | to_plain | to_line).select("kind", "word", "up", "edits", F.col("up_used").alias("m")), "links")
    return cut(pivots(local, links), "spellings")


def _cluster(rows: list[tuple]) -> list[int]:
    """Cluster ids of the signatures ``(brand, flavour, fat, dim, total, n, first_id, log_price)`` of one line.

    Two signatures agree if no attribute that both state differs. Pivots are taken in the order of
    how much they state, then how many listings have them; of several agreeing products the
    one of the nearest mean price is joined.
    """
    def own(r):
        d = {"brand": r[0], "flavour": r[1], "fat": r[2], "dim": r[3] if r[4] is not None else None, "total": r[4]}
        return {k: v for k, v in d.items() if v is not None}

    def agrees(p, q):
        return all(k not in p or (abs(p[k] - v) <= 0.011 * max(p[k], v) if k in ("fat", "total") else p[k] == v) for k, v in q.items())

    mine = [own(r) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (-len(mine[i]), -rows[i][5], rows[i][6]))
    pivots: list[tuple[dict, float | None, int]] = []
    out = [0] * len(rows)
    for i in order:
        price = rows[i][7]
        fits = []
        for p, other, cid in pivots:
            if agrees(p, mine[i]):
                gap = abs(other - price) if other is not None and price is not None else 9.0
                fits.append((gap, -sum(k in mine[i] for k in p), cid))
        near = min(fits) if fits else None
        if near and (near[0] <= 0.6 or near[0] == 9.0):
            out[i] = near[2]
        else:
            out[i] = rows[i][6]
            pivots.append((mine[i], price, rows[i][6]))
    return out


SIGNATURE = ["kind", "line", "brand", "flavour", "fat", "dim", "total", "price_bin"]


def cluster_signatures(signatures: DataFrame) -> DataFrame:
    """Adds ``cluster``; the signatures of a line are read together, line after line, by sorted partitions."""

    def run(it):
        def clean(v):
            return None if v is None or v != v else v

        held: list[tuple] = []

        def flush():
            ids = _cluster([(*r[2:7], *r[8:11]) for r in held])
            return [(*r[:8], c) for r, c in zip(held, ids, strict=True)]

        for df in it:
            done = []
            for r in df.itertuples(index=False):
                r = tuple(clean(v) for v in r)
                if held and held[0][:2] != r[:2]:
                    done += flush()
                    held = []
                held.append(r)
            yield pd.DataFrame(done, columns=[*SIGNATURE, "cluster"])
        yield pd.DataFrame(flush(), columns=[*SIGNATURE, "cluster"])

    ordered = signatures.select(*SIGNATURE, "n", "first_id", "log_price").repartition("kind", "line").sortWithinPartitions("kind", "line", "first_id")
    return ordered.mapInPandas(run, "kind string, line string, brand string, flavour string, fat double, dim string, total double, price_bin double, cluster bigint")


def group_listings(listings: DataFrame, window: int = WINDOW) -> DataFrame:
    """``listing_id, product_id``: each listing once, ``product_id`` is the smallest signature's first listing.

    Listings with an empty or NULL name, or with no word that may name a product line, are groups of their own.
    Repeated rows count once; extra columns are ignored; an empty table gives an empty result.
    """
    df = cut(with_kinds(cut(parsed_listings(listings), "parsed")), "listings")
    words = cut(title_words(df), "title-words")
    roles, local = word_roles(words)
    canon = spellings(words, roles, local, window)
    said = salted_join(words, canon, ["kind", "word"], F.col("title"), broadcast=False)
    size = canon.join(local, ["kind", "word"]).groupBy("kind", "canon").agg(F.sum("n").alias("size"))
    spread = size.groupBy("canon").agg((F.max("size") / F.sum("size")).alias("top"))
    what = local.select("kind", F.col("word").alias("canon"), "role").join(size, ["kind", "canon"]).join(spread, "canon").join(roles.select(F.col("word").alias("canon"), "brand"), "canon")
    said = salted_join(said.select("title", "kind", "canon", "own"), cut(what, "canon-roles"), ["kind", "canon"], F.col("title"), broadcast=False)
    # of several words that may name the line: one of one kind and used again, the most used, then the longest
    steady = ((F.col("top") >= 0.75) & (F.col("size") >= 2)).cast("int")
    line = F.max_by("canon", F.when(F.col("role") == "line", F.struct(steady, "size", "own", F.length("canon"), "canon")))
    lines = cut(said.groupBy("title").agg(line.alias("line"), F.min("brand").alias("brand")), "title-lines")
    full = df.join(lines, "title", "left")
    # only signatures that leave something out need prices to be told apart
    full = full.withColumn("price_bin", F.round(F.log("list_price") * 10)).withColumn("line", F.coalesce("line", F.concat(F.lit("id:"), F.col("listing_id").cast("string"))))
    full = cut(full.select("listing_id", *SIGNATURE, "list_price"), "signed")
    keys = SIGNATURE
    signatures = full.groupBy(*keys).agg(F.count("*").alias("n"), F.min("listing_id").alias("first_id"), F.avg(F.log("list_price")).alias("log_price"))
    clusters = cluster_signatures(signatures)
    right = clusters.select(*[F.col(k).alias(f"_{k}") for k in keys], "cluster")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = full.join(right, same)
    unnamed = listings.where(F.trim(F.coalesce("product_name", F.lit(""))) == "").select("listing_id").distinct()
    return out.select("listing_id", F.col("cluster").alias("product_id")).unionByName(unnamed.select("listing_id", F.col("listing_id").alias("product_id")))


def group_pairs(groups: DataFrame, salts: int = 16) -> DataFrame:
    """All pairs of each group, smaller id first; a large group is spread over ``salts`` tasks."""
    a = groups.select("product_id", F.col("listing_id").alias("listing_id_a")).withColumn("s", F.pmod(F.xxhash64("listing_id_a"), F.lit(salts)))
    b = groups.select("product_id", F.col("listing_id").alias("listing_id_b")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, ["product_id", "s"]).where("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
