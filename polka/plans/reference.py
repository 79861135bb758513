"""One query per operator family, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polka.functions import numeric, text
from polka.operators import catalog as cat
from polka.operators import guardrails, match, payload, pricing, review
from polka.plans.views import KEY, catalog, goods, observation
from polka.session import cut, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price_metrics(observation(spark, d))


def stored_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics written once: filters on derived columns then read them instead of repeating the formulas."""
    return cut(metrics(spark, d), "metrics")


@query
def price_index_summary(spark, d):
    return pricing.summarize(metrics(spark, d))


@query
def price_index_by_brand(spark, d):
    return pricing.summarize(metrics(spark, d), ["p_brand"]).select("p_brand", "total_items", "comparable_items", "avg_price_index", "own_cheaper_count", "competitor_cheaper_count", "parity_count", "dumping_alerts_count", "basket_price_index")


@query
def price_index_rollup(spark, d):
    return pricing.summarize(metrics(spark, d), ["p_type", "p_brand"], rollup=True).select("p_type", "p_brand", "total_items", "comparable_items", "parity_count", "basket_price_index")


@query
def price_metrics_rows(spark, d):
    df = metrics(spark, d).select(*KEY, "comp_pack_factor", "comp_regular_price", "comp_promo_price", "regular_diff", "promo_diff", "effective_diff", "price_index_regular", "price_index_effective", F.array_join("data_quality_warnings", "|").alias("warnings"))
    return df


@query
def effective_price(spark, d):
    return metrics(spark, d).select(*KEY, "our_effective_price", "our_promo_applied", "comp_effective_price", "comp_promo_applied")


@query
def pack_factor(spark, d):
    return metrics(spark, d).groupBy("unit", "comp_pack_factor").agg(F.count("*").alias("n"))


@query
def status_band(spark, d):
    return metrics(spark, d).select(*KEY, "status")


@query
def dumping_alerts(spark, d):
    return stored_metrics(spark, d).where("is_dumping").select(*KEY, "comp_effective_price", "our_purchase_price")


@query
def conditional_promo_flag(spark, d):
    return table(spark, d, "price_tags").dropDuplicates(["tag_id"]).select("tag_id", pricing.conditional_promo(F.col("promo_condition")).alias("conditional"))


@query
def status_distribution(spark, d):
    return review.status_distribution(stored_metrics(spark, d))


@query
def top20_deviations(spark, d):
    return review.largest_deviations(stored_metrics(spark, d), KEY).select(*KEY, "effective_diff")


@query
def review_filter_search(spark, d):
    rows = review.by_status(stored_metrics(spark, d), "own_cheaper")
    return review.search(rows, "RED wid", ["matched_sku", "matched_name", "product_name"]).select(*KEY, "matched_sku")


@query
def review_dumping_filter(spark, d):
    return review.by_status(stored_metrics(spark, d), "dumping").groupBy("p_brand").agg(F.count("*").alias("n"))


@query
def report_rows(spark, d):
    return review.report_rows(metrics(spark, d), KEY)


@query
def report_summary_unpivot(spark, d):
    return review.summary_lines(pricing.summarize(metrics(spark, d)))


@query
def bot_report(spark, d):
    return review.bot_text(pricing.summarize(metrics(spark, d)))


def feed_rows(spark, d):
    """Catalogue rows as text, from the items table; after some rows come a heading, a repeated header, a row without sku, with bad or zero prices, or nothing."""
    c = table(spark, d, "catalog_items")
    names = ("Код товара", "Наименование товара", "Закуп", "Розница", "Промо")
    cells = [F.col("sku"), F.col("product_name"), F.col("purchase_price").cast("string"), F.col("sale_price").cast("string"), F.coalesce(F.col("promo_price").cast("string"), F.lit("нет"))]
    rows = c.select(F.col("row_id").alias("row_idx"), *[x.alias(n) for x, n in zip(cells, names, strict=True)])
    r = F.col("row_id").cast("string")
    more = {
        1: (None, F.concat(F.lit("Раздел "), r), None, None, None), 2: ("Код товара", "Наименование товара", "Цена закупки", "Цена продажи", "Цена на промо"), 3: (" - ", "Без кода", "10,50", "1 200,00", "нет"),
        4: (F.concat(F.lit("bad"), r), "Плохая цена", "abc", "12", "-5"), 5: (F.concat(F.lit("zero"), r), "Ноль", "0", "0.00", "n/a"), 6: (None,) * 5,
    }
    text_of = lambda x: x if not isinstance(x, (str, type(None))) else F.lit(x).cast("string")
    for k, values in more.items():
        rows = rows.unionByName(c.where(F.col("row_id") % 10 == k).select((F.col("row_id") + 10_000_000).alias("row_idx"), *[text_of(x).alias(n) for x, n in zip(values, names, strict=True)]))
    return rows


@query
def catalog_clean(spark, d):
    return cat.clean(cat.resolve(feed_rows(spark, d))[0])


@query
def catalog_skipped(spark, d):
    return cat.skipped(cat.resolve(feed_rows(spark, d))[0])


@query
def metric_values(spark, d):
    """The mean index of each brand as it is shown, NULL for the brands of an odd number."""
    by = pricing.summarize(metrics(spark, d), ["p_brand"])
    return by.select("p_brand", review.metric_value(F.when(F.substring("p_brand", -1, 1).cast("int") % 2 == 0, F.col("avg_price_index"))).alias("shown"))


@query
def catalog_constraints(spark, d):
    return cat.violations(cat.clean(cat.resolve(feed_rows(spark, d))[0]))


@query
def catalog_dup_skus(spark, d):
    return cat.clean(cat.resolve(feed_rows(spark, d))[0]).groupBy("sku").count().where("count > 1").select("sku", F.col("count").alias("n"))


@query
def localized_number(spark, d):
    lines = table(spark, d, "feed_lines").dropDuplicates(["file_id", "line_no"])
    cells = lines.select("file_id", "line_no", F.posexplode(F.split("raw_text", r"[;|\t]")).alias("pos", "cell"))
    return cells.select("file_id", "line_no", "pos", numeric.localized_number(F.col("cell")).alias("number"))


@query
def sku_normalize(spark, d):
    return table(spark, d, "catalog_items").select("row_id", text.normalize_sku(F.concat(F.lit(" "), "sku", F.lit("  "))).alias("sku"))


@query
def header_normalize(spark, d):
    first = table(spark, d, "feed_lines").where("line_no = 1").dropDuplicates(["file_id"])
    cells = first.select("file_id", F.posexplode(F.split("raw_text", r"[;|,\t]")).alias("pos", "cell"))
    return cells.select("file_id", "pos", text.normalize_header(F.col("cell")).alias("header"))


@query
def source_values(spark, d):
    lines = table(spark, d, "feed_lines").dropDuplicates(["file_id", "line_no"])
    cells = lines.select("file_id", "line_no", F.explode(F.split("raw_text", ";")).alias("cell"))
    return cells.groupBy("file_id").agg(F.count_if(text.has_source_value(F.col("cell"))).alias("filled"), F.count("*").alias("cells"))


@query
def sku_valid(spark, d):
    raw = F.element_at(F.array(*[F.lit(x).cast("string") for x in ("-", "NaN", " None ", "<NA>", "", None)], F.col("sku"), F.concat(F.lit(" "), "sku")), (F.col("row_id") % 8 + 1).cast("int"))
    return table(spark, d, "catalog_items").select("row_id", text.valid_sku(raw).alias("valid"))


@query
def sku_of_number(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sku_of_number(F.col("p_partkey") + F.when(F.col("p_size") % 2 == 0, 0.0).otherwise(0.5)).alias("sku"))


@query
def decimal_text(spark, d):
    raw = F.format_string("Цена %d %03d,%d руб, ЁЛКА", "p_size", F.col("p_partkey") % 1000, F.col("p_size") % 10)
    return table(spark, d, "part").select("p_partkey", text.decimal_text(raw).alias("text"))


@query
def attrs_extract(spark, d):
    c = goods(spark, d).withColumn("a", text.attributes(F.col("name")))
    return c.select("row_idx", "a.fat", "a.volume_ml", "a.weight_g", "a.count")


@query
def attrs_items(spark, d):
    c = table(spark, d, "catalog_items").withColumn("a", text.attributes(F.col("product_name")))
    return c.select("row_id", "a.fat", "a.volume_ml", "a.weight_g", "a.count")


@query
def text_normalize(spark, d):
    return goods(spark, d).select("row_idx", text.normalize_product_text(F.col("name")).alias("norm"))


@query
def text_normalize_tags(spark, d):
    return table(spark, d, "price_tags").dropDuplicates(["tag_id"]).select("tag_id", text.normalize_product_text(F.col("product_name")).alias("norm"))


@query
def token_sets(spark, d):
    return goods(spark, d).select("row_idx", F.array_join(F.array_sort(match.index_tokens(text.normalize_product_text(F.col("name")))), " ").alias("tokens"))


@query
def trigram_sets(spark, d):
    return catalog(spark, d).select("row_idx", F.size(text.trigrams(F.lower("name"))).cast("bigint").alias("n"), F.array_join(F.array_sort(text.trigrams(F.lower("name"))), "|").alias("grams"))


@query
def trigram_hash(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.crc32(F.encode("p_brand", "UTF-8")).alias("crc"))


@query
def token_postings(spark, d):
    return match.postings(match.prepare_catalog(catalog(spark, d))).groupBy("bucket").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


@query
def token_postings_bounded(spark, d):
    """The index with bounds that the table reaches: three tokens of a name, five rows of a bucket."""
    return match.postings(match.prepare_catalog(catalog(spark, d)), most=5, names=3)


@query
def candidate_shortlist_parts(spark, d):
    """Every twentieth part asked for by name and type: the four rarest tokens, a pool of fifty."""
    items = cut(match.prepare_catalog(catalog(spark, d).select("row_idx", "name")), "prepared")
    asked = table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("obs_id"), F.concat_ws(" ", "p_name", "p_type").alias("product_name"))
    pool = match.pools(match.queries_of(asked), match.postings(items), match.postings(items, "gram"), take=4, most=50)
    total = F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pool.select("obs_id", F.size("rows").cast("bigint").alias("candidates"), F.get("hits", F.lit(0)).cast("bigint").alias("most_hits"), total.alias("row_sum"))


@query
def ngram_postings(spark, d):
    return match.postings(match.prepare_catalog(catalog(spark, d)), "gram").groupBy("bucket").agg(F.count("*").alias("n"), F.max("row_idx").alias("last_row"))


def _tags(spark, d):
    t = table(spark, d, "price_tags").dropDuplicates(["tag_id"]).withColumnRenamed("tag_id", "obs_id")
    return match.confidence_gate(t).where("gate = 'match'").select("obs_id", "product_name", "brand", "weight_volume")


def _items(spark, d):
    c = table(spark, d, "catalog_items")
    one = c.groupBy("sku").agg(F.max_by(F.struct("row_id", "product_name", "purchase_price", "sale_price", "promo_price"), F.struct("loaded_at", "row_id")).alias("c"))
    return one.select(F.col("c.row_id").alias("row_idx"), "sku", F.col("c.product_name").alias("name"), "c.purchase_price", "c.sale_price", "c.promo_price")


@query
def candidate_shortlist(spark, d):
    items = cut(match.prepare_catalog(_items(spark, d)), "prepared")
    queries = cut(match.queries_of(_tags(spark, d)), "queries")
    return match.candidate_numbers(queries, items)


@query
def match_resolution(spark, d):
    out = match.match_all(_tags(spark, d), _items(spark, d), details=False)
    return out.select("obs_id", "matched_sku", "match_score", "match_reason", F.size("candidates").alias("n_candidates"))


@query
def brand_subset_filter(spark, d):
    c = catalog(spark, d).select("row_idx", "p_brand", text.normalize_product_text(F.col("name")).alias("norm"))
    wanted = F.array_distinct(F.filter(text.tokens(text.normalize_product_text(F.lit("Brand#17"))), lambda t: F.length(t) >= 2))
    return c.where(match.brand_present(wanted, F.col("norm"))).select("row_idx", "p_brand")


@query
def attribute_conflict(spark, d):
    c = goods(spark, d).select("row_idx", "p_type", text.attributes(F.col("name")).alias("attrs"))
    lead = c.groupBy("p_type").agg(F.min_by("attrs", "row_idx").alias("first"))
    return c.join(lead, "p_type").select("row_idx", match.attribute_conflict(F.col("first"), F.col("attrs")).alias("conflict"))


@query
def fuzzy_ratios(spark, d):
    """Each part name against the first name of its type."""
    p = table(spark, d, "part").select("p_name", "p_type").distinct()
    lead = p.groupBy("p_type").agg(F.min("p_name").alias("first_name"))
    df = p.join(lead, "p_type").withColumn("f", match.fuzzy_ratios(F.col("p_name"), F.col("first_name")))
    return df.select("p_name", "p_type", numeric.exact_round(F.col("f.sort"), 3).alias("sort_ratio"), numeric.exact_round(F.col("f.set"), 3).alias("set_ratio"))


@query
def manual_override(spark, d):
    rows = catalog(spark, d).select("row_idx", "sku", "name", "sale_price", "promo_price")
    fixes = rows.where("row_idx % 7 = 0").select("row_idx", F.upper("name").alias("name"), F.lit(None).cast("double").alias("promo_price"))
    return match.override_rows(rows, fixes, "row_idx", ["name", "promo_price"])


@query
def manual_sku_lookup(spark, d):
    items = table(spark, d, "catalog_items").select(F.col("row_id").alias("row_idx"), "sku", "product_name")
    return match.lookup_sku(items, items.select(F.upper("sku").alias("sku"))).select("wanted", "row_idx", "product_name")


@query
def payload_validate(spark, d):
    t = table(spark, d, "price_tags").dropDuplicates(["tag_id"])
    body = F.to_json(F.struct(F.col("product_name"), F.col("brand"), F.col("weight_volume"), F.col("regular_price"), F.col("promo_price"), F.col("promo_condition"), F.col("unit"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), F.col("notes")))
    raw = t.select("tag_id", F.when(F.col("tag_id") % 11 == 0, F.concat(F.lit("answer: "), body)).when(F.col("tag_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("payload"))
    return payload.validate_payloads(raw).select("tag_id", "error_code", "regular_price", "unit", "extraction_status")


@query
def confidence_gate(spark, d):
    return match.confidence_gate(observation(spark, d)).groupBy("gate", "extraction_status").agg(F.count("*").alias("n"), F.count("confidence").alias("with_confidence"))


@query
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sanitize_cell(F.col("text"), 500).alias("cell"))


@query
def mock_provider(spark, d):
    return table(spark, d, "feed_files").select("file_id", payload.mock_choice(F.col("file_name")).cast("bigint").alias("choice"))


@query
def rate_limit_global(spark, d):
    return guardrails.rate_limit(table(spark, d, "events"), 8, 6 * 3600.0, by=None).groupBy("accepted").agg(F.count("*").alias("n"))


@query
def rate_limit_per_user(spark, d):
    out = guardrails.rate_limit(table(spark, d, "events"), 3, 24 * 3600.0)
    return out.select("event_id", F.col("who").cast("bigint").alias("user_id"), "accepted")


@query
def quota_with_gap(spark, d):
    return guardrails.rate_limit(table(spark, d, "events"), 6, 72 * 3600.0, gap=1800.0).select("event_id", "accepted", "retry_after")


@query
def session_ttl(spark, d):
    s = guardrails.sessions(table(spark, d, "events"), 6 * 3600.0)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query
def session_budget(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.floor("value").cast("bigint").alias("bytes"))
    return guardrails.within_budget(e, "bytes", ["ts", "event_id"], 150, 50, 2000, by=["user_id"]).select("event_id", "items_so_far", "bytes_so_far", "problem")


@query
def circuit_breaker_runs(spark, d):
    return guardrails.breaker_runs(table(spark, d, "events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"]).select("user_id", F.unix_micros(F.col("run_start").cast("timestamp")).alias("run_start_us"), "run_length", "tripped")


@query
def upload_manifest_running_budget(spark, d):
    f = table(spark, d, "feed_files").select("file_id", "feed_id", F.col("n_lines").cast("bigint").alias("bytes"))
    return guardrails.within_budget(f, "bytes", ["file_id"], 70, 8, 400, by=["feed_id"]).select("file_id", "items_so_far", "bytes_so_far", "problem")


@query
def unique_filenames(spark, d):
    from pyspark.sql.window import Window

    f = table(spark, d, "feed_files").select("file_id", F.concat(F.regexp_extract("file_name", r"^[^0-9]*", 0), "feed_id", F.lit(".csv")).alias("name"))
    n = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("file_id"))
    return f.withColumn("n", n).select("file_id", F.when(F.col("n") == 1, F.col("name")).otherwise(F.regexp_replace("name", r"(\.[^.]*)$", "")).alias("stem"), F.when(F.col("n") > 1, F.col("n")).cast("bigint").alias("suffix"))


@query
def fingerprint_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256).alias("fingerprint"))


@query
def allow_list(spark, d):
    e = table(spark, d, "events")
    ids = e.where("event_type = 'signup'").select(F.col("user_id").alias("id"))
    return guardrails.authorized(e, ids).groupBy("user_id").agg(F.count("*").alias("n"))


@query
def id_list_parse(spark, d):
    from polka.operators.guardrails import allowed_ids

    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat_ws("; ", "user_id", "event_id")).when(F.col("event_id") % 3 == 1, F.concat_ws(",", "user_id", F.lit("x1"))).otherwise(F.concat_ws(" ", F.lit("0"), "user_id")).alias("text"))
    return allowed_ids(t).select("event_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
