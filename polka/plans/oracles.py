"""The same queries in SQL, written independently of the Spark expressions."""

from __future__ import annotations

CATALOG = """catalog AS (SELECT p_partkey AS row_idx, cast(p_partkey AS varchar) AS sku,
  p_name || ' ' || p_brand || ' ' || p_type || ' ' || (p_size * 10) || 'g' AS name, p_size * 10 AS grams,
  p_retailprice * 0.8 AS purchase_price, p_retailprice AS sale_price,
  CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 0.95 END AS promo_price, p_name, p_brand, p_type FROM part)"""

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

OBSERVATION = CATALOG + """, obs0 AS (SELECT l.*, c.*, l_linenumber % 5 AS u,
  sale_price * (0.92 + 2.0 * l_discount) AS pack FROM lineitem l JOIN catalog c ON l_partkey = row_idx),
obs1 AS (SELECT *, CASE u WHEN 1 THEN pack * 4.0 WHEN 2 THEN pack * 0.4 ELSE pack END AS price FROM obs0),
observation AS (SELECT *, CASE l_returnflag WHEN 'R' THEN price * 0.9 WHEN 'A' THEN price * 1.1 END AS comp_promo_in,
  l_returnflag = 'R' AND l_linenumber % 2 = 1 AS cond,
  CASE WHEN l_quantity > 49 THEN 1.5 WHEN l_quantity = 48 THEN NULL ELSE 1.0 - l_tax * 6.0 END AS confidence,
  CASE WHEN l_quantity = 1 THEN 'error' ELSE 'ok' END AS extraction_status FROM obs1)"""

R2 = "cast(printf('%.2f', {}) AS double) + 0.0"
R1 = "cast(printf('%.1f', {}) AS double) + 0.0"

METRICS = OBSERVATION + f""", m1 AS (SELECT *, CASE u WHEN 0 THEN 1.0 WHEN 3 THEN 1.0 WHEN 1 THEN grams / 1000.0::double WHEN 2 THEN grams / 100.0::double END::double AS factor FROM observation),
m2 AS (SELECT *, CASE WHEN factor IS NOT NULL THEN {R2.format('price * factor')} END AS comp_regular,
  CASE WHEN factor IS NOT NULL AND comp_promo_in IS NOT NULL THEN {R2.format('comp_promo_in * factor')} END AS comp_promo FROM m1),
m3 AS (SELECT *, promo_price IS NOT NULL AND promo_price <= sale_price AS our_applied,
  coalesce(NOT cond AND comp_promo <= comp_regular, false) AS comp_applied FROM m2),
m4 AS (SELECT *, CASE WHEN our_applied THEN promo_price ELSE sale_price END AS our_eff,
  CASE WHEN comp_applied THEN comp_promo ELSE comp_regular END AS comp_eff FROM m3),
metrics AS (SELECT *, comp_eff / our_eff * 100.0::double AS pi, coalesce(comp_eff < purchase_price, false) AS dump,
  CASE WHEN comp_eff / our_eff * 100.0::double > 102 THEN 'own_cheaper' WHEN comp_eff / our_eff * 100.0::double < 98 THEN 'competitor_cheaper'
    WHEN comp_eff IS NULL THEN 'unknown' ELSE 'parity' END AS status,
  array_to_string(list_filter([CASE WHEN factor IS NULL THEN 'no volume for the unit' END,
    CASE WHEN cond AND comp_promo IS NOT NULL THEN 'conditional promo not applied' END,
    CASE WHEN NOT cond AND comp_promo > comp_regular THEN 'competitor promo above regular' END], lambda x: x IS NOT NULL), '|') AS warnings FROM m4)"""


def rounded(x: str, places: int) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN cast(printf('%.{places}f', {x}) AS double) + 0.0 END"


FIGURES = {
    "total_items": "count(*)",
    "successful_recognitions": "count(*) FILTER (WHERE extraction_status = 'ok')",
    "failed_recognitions": "count(*) FILTER (WHERE extraction_status <> 'ok')",
    "matched_items": "count(sku)",
    "match_rate": rounded("(count(sku) * 100.0::double / count(*))", 1),
    "comparable_items": "count(comp_eff)",
    "avg_price_index": rounded("avg(pi)", 1),
    "own_cheaper_count": "count(*) FILTER (WHERE status = 'own_cheaper')",
    "competitor_cheaper_count": "count(*) FILTER (WHERE status = 'competitor_cheaper')",
    "parity_count": "count(*) FILTER (WHERE status = 'parity')",
    "dumping_alerts_count": "count(*) FILTER (WHERE dump)",
    "total_our_basket": rounded("sum(our_eff) FILTER (WHERE comp_eff IS NOT NULL)", 2),
    "total_comp_basket": rounded("sum(comp_eff)", 2),
    "basket_price_index": rounded("(sum(comp_eff) / sum(our_eff) FILTER (WHERE comp_eff IS NOT NULL) * 100.0::double)", 1),
}


def figures(*names: str) -> str:
    return ", ".join(f"{FIGURES[n]} AS {n}" for n in names)


def with_metrics(body: str) -> str:
    return f"WITH {METRICS} {body}"


SUMMARY = f"SELECT {figures(*FIGURES)} FROM metrics"
LINES = "WITH lines AS (SELECT DISTINCT file_id, line_no, raw_text FROM feed_lines)"
WS = "regexp_replace({}, '[\\s\\x{{a0}}\\x{{202f}}\\x{{2009}}]+', '', 'g')"
FEED = """feed AS (SELECT row_id AS row_idx, nullif(trim(sku), '') AS sku, nullif(left(trim(product_name), 500), '') AS name,
  CASE WHEN purchase_price > 0 THEN purchase_price END AS purchase_price, CASE WHEN sale_price > 0 THEN sale_price END AS sale_price,
  CASE WHEN promo_price > 0 THEN promo_price END AS promo_price,
  coalesce(purchase_price >= 0, true) AND coalesce(sale_price >= 0, true) AND coalesce(promo_price >= 0, true) AS price_ok FROM catalog_items
  WHERE purchase_price IS NOT NULL OR sale_price IS NOT NULL OR promo_price IS NOT NULL
  UNION ALL SELECT row_id + 10000000, NULL, 'Без кода', 10.5, 1200, NULL, true FROM catalog_items WHERE row_id % 10 = 3
  UNION ALL SELECT row_id + 10000000, 'bad' || row_id, 'Плохая цена', NULL, 12, NULL, false FROM catalog_items WHERE row_id % 10 = 4
  UNION ALL SELECT row_id + 10000000, 'zero' || row_id, 'Ноль', NULL, NULL, NULL, true FROM catalog_items WHERE row_id % 10 = 5)"""
GOODS = """kinds(k, opening, brand) AS (VALUES (0, 'молоко ультрапастеризованное', 'данон'), (1, 'масло сливочное', 'хохланд'), (2, 'сок стекло', 'добрый'), (3, 'чай пакет', 'гринфилд'),
  (4, 'вода пэт бутылка', 'президент'), (5, 'мука фасованный', 'макфа'), (6, 'сыр высший сорт', 'альпен гольд'), (7, 'колбаса варено копченая', 'милка')),
goods AS (SELECT p_partkey AS row_idx, p_type, k, p_size AS s, opening || ' ' || lower(p_name) || ' ' || brand || ' ' || CASE k WHEN 0 THEN (s // 2) || '.' || (s % 2 * 5) || '% ' || (s * 20) || 'мл' WHEN 1 THEN '82.5% ' || (s * 10) || 'г'
    WHEN 2 THEN s || ' x 200мл' WHEN 3 THEN s || ' шт' WHEN 4 THEN (s * 1000 + 500) || 'мл' WHEN 5 THEN (s * 1000) || 'г' WHEN 6 THEN '100% ' || (s * 10) || 'г' ELSE (1000 + s) || 'г' END AS norm,
  CASE k WHEN 0 THEN s / 2.0 WHEN 1 THEN 82.5 END::double AS fat, CASE k WHEN 0 THEN s * 20 WHEN 2 THEN s * 200 WHEN 4 THEN s * 1000 + 500 END::integer AS volume_ml,
  CASE k WHEN 1 THEN s * 10 WHEN 5 THEN s * 1000 WHEN 6 THEN s * 10 WHEN 7 THEN 1000 + s END::integer AS weight_g, CASE WHEN k IN (2, 3) THEN s END::integer AS count FROM part JOIN kinds ON k = p_partkey % 8)"""
NORM = CATALOG + """, normed AS (SELECT *, lower(p_name) || ' ' || lower(replace(p_brand, '#', ' ')) || ' ' || lower(p_type) || ' ' || grams || 'г' AS norm FROM catalog)"""
#: CRC-32 over the bytes of a text, bit by bit.
CRC = """list_reduce([4294967295::ubigint] || list_transform(range(1, length(hex(encode({0})))::bigint, 2), lambda i: ('0x' || substr(hex(encode({0})), i, 2))::ubigint),
  lambda c, b: list_reduce([xor(c, b)::ubigint] || list_transform(range(8), lambda k: 0::ubigint), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::ubigint) ELSE x // 2 END))"""
LCS = """list_reduce([list_transform(range(length({1}) + 1), lambda q: 0::bigint)] || list_transform(string_split({0}, ''), lambda ch: [unicode(ch)::bigint]),
  lambda prev, ca: list_reduce([[0::bigint]] || list_transform(range(1, length({1}) + 1), lambda j: [j::bigint]),
    lambda row, j: list_append(row, CASE WHEN unicode(substr({1}, j[1]::integer, 1)) = ca[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], row[j[1]]) END)))[-1]"""
LIMIT = """WITH RECURSIVE e AS ({source}), r AS (
  SELECT event_id, who, n, t, true AS accepted, [t] AS acc FROM e WHERE n = 1 UNION ALL
  SELECT e.event_id, e.who, e.n, e.t, len(list_filter(r.acc, lambda a: a > e.t - {window})) < {most},
    CASE WHEN len(list_filter(r.acc, lambda a: a > e.t - {window})) < {most} THEN list_append(list_filter(r.acc, lambda a: a > e.t - {window}), e.t)
      ELSE list_filter(r.acc, lambda a: a > e.t - {window}) END
  FROM r JOIN e ON e.who = r.who AND e.n = r.n + 1)"""
EVENTS = "SELECT event_id, {who} AS who, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {who} ORDER BY ts, event_id) AS n FROM events"

SQL = {
    "price_index_summary": with_metrics(SUMMARY),
    "price_index_by_brand": with_metrics("SELECT p_brand, " + figures("total_items", "comparable_items", "avg_price_index", "own_cheaper_count", "competitor_cheaper_count", "parity_count", "dumping_alerts_count", "basket_price_index") + " FROM metrics GROUP BY p_brand"),
    "price_index_rollup": with_metrics("SELECT p_type, p_brand, " + figures("total_items", "comparable_items", "parity_count", "basket_price_index") + " FROM metrics GROUP BY ROLLUP (p_type, p_brand)"),
    "price_metrics_rows": with_metrics(f"SELECT {KEY}, {rounded('factor', 6)} AS comp_pack_factor, comp_regular AS comp_regular_price, comp_promo AS comp_promo_price, {rounded('(comp_regular - sale_price)', 2)} AS regular_diff, {rounded('(comp_promo - promo_price)', 2)} AS promo_diff, {rounded('(comp_eff - our_eff)', 2)} AS effective_diff, {rounded('(comp_regular / sale_price * 100.0::double)', 1)} AS price_index_regular, {rounded('pi', 1)} AS price_index_effective, warnings FROM metrics"),
    "effective_price": with_metrics(f"SELECT {KEY}, our_eff AS our_effective_price, our_applied AS our_promo_applied, comp_eff AS comp_effective_price, comp_applied AS comp_promo_applied FROM metrics"),
    "pack_factor": with_metrics(f"SELECT CASE u WHEN 0 THEN 'шт' WHEN 1 THEN 'кг' WHEN 2 THEN '100 г' WHEN 3 THEN 'упаковка' ELSE 'л' END AS unit, {rounded('factor', 6)} AS comp_pack_factor, count(*) AS n FROM metrics GROUP BY ALL"),
    "status_band": with_metrics(f"SELECT {KEY}, status FROM metrics"),
    "dumping_alerts": with_metrics(f"SELECT {KEY}, comp_eff AS comp_effective_price, purchase_price AS our_purchase_price FROM metrics WHERE dump"),
    "conditional_promo_flag": "SELECT DISTINCT tag_id, coalesce(regexp_matches(lower(promo_condition), '(^|[^\\p{L}\\p{N}_])от\\s*[0-9]+|[0-9]+\\s*[+хx×]\\s*[0-9]+|при\\s+покупке|за\\s*[0-9]+\\s*шт|[0-9]+\\s*по\\s*цене'), false) AS conditional FROM price_tags",
    "status_distribution": with_metrics("SELECT status, count(*) AS items FROM metrics WHERE status <> 'unknown' GROUP BY status"),
    "top20_deviations": with_metrics(f"SELECT {KEY}, {rounded('(comp_eff - our_eff)', 2)} AS effective_diff FROM metrics WHERE comp_eff IS NOT NULL ORDER BY abs(effective_diff) DESC, {KEY} LIMIT 20"),
    "review_filter_search": with_metrics(f"SELECT {KEY}, sku AS matched_sku FROM metrics WHERE status = 'own_cheaper' AND contains(lower(sku || ' ' || name || ' ' || name), 'red wid')"),
    "review_dumping_filter": with_metrics("SELECT p_brand, count(*) AS n FROM metrics WHERE dump GROUP BY p_brand"),
    "report_rows": with_metrics(f"""SELECT {KEY}, sku, name, name AS recognised, purchase_price, sale_price, promo_price, coalesce(comp_regular, price) AS competitor_price,
      coalesce(comp_promo, comp_promo_in) AS competitor_promo, {rounded('(comp_eff - our_eff)', 2)} AS difference, ({rounded('pi', 1)}) / 100.0::double AS price_index, status,
      array_to_string(list_filter([CASE WHEN dump THEN 'dumping: competitor below purchase price' END, nullif(replace(warnings, '|', ' | '), '')], lambda x: x IS NOT NULL), ' | ') AS warnings FROM metrics"""),
    "report_summary_unpivot": with_metrics(f", s AS ({SUMMARY}) SELECT label, value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS label, {c}::double{' / 100' if c in ('match_rate', 'avg_price_index', 'basket_price_index') else ''} AS value FROM s" for c in FIGURES if c != "failed_recognitions") + ")"),
    "bot_report": with_metrics(f", s AS ({SUMMARY}) SELECT 'items ' || total_items || '; matched ' || matched_items || '; average index ' || coalesce(printf('%.1f', avg_price_index) || '%', 'no data') || '; basket index ' || coalesce(printf('%.1f', basket_price_index) || '%', 'no data') || '; dumping ' || dumping_alerts_count AS report FROM s"),
    "catalog_clean": f"WITH {FEED} SELECT * FROM feed",
    "catalog_skipped": "SELECT count(*) FILTER (WHERE row_id % 10 = 1) + count(*) FILTER (WHERE row_id % 10 = 2) + count(*) FILTER (WHERE purchase_price IS NULL AND sale_price IS NULL AND promo_price IS NULL) AS skipped FROM catalog_items",
    "metric_values": with_metrics("SELECT p_brand, CASE WHEN right(p_brand, 1)::integer % 2 = 0 THEN printf('%.1f', avg(pi)) || '%' ELSE 'Н/Д' END AS shown FROM metrics GROUP BY p_brand"),
    "catalog_constraints": f"""WITH {FEED}, d AS (SELECT sku FROM feed WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 1)
      SELECT count(*) AS rows, count(*) FILTER (WHERE sku IS NULL OR name IS NULL) AS no_identity, count(*) FILTER (WHERE NOT price_ok) AS bad_price,
      count(*) FILTER (WHERE sale_price IS NULL AND promo_price IS NULL) AS no_price, (SELECT count(*) FROM d) AS doubled,
      (SELECT string_agg(sku, ',' ORDER BY sku) FROM (SELECT sku FROM d ORDER BY sku LIMIT 5)) AS doubled_skus FROM feed""",
    "catalog_dup_skus": f"WITH {FEED} SELECT sku, count(*) AS n FROM feed GROUP BY sku HAVING count(*) > 1",
    "localized_number": LINES + ", cells AS (SELECT file_id, line_no, unnest(string_split_regex(raw_text, '[;|\\t]')) AS cell, generate_subscripts(string_split_regex(raw_text, '[;|\\t]'), 1) - 1 AS pos FROM lines), t AS (SELECT *, " + WS.format("cell") + """ AS w FROM cells),
      v AS (SELECT *, CASE WHEN contains(w, ',') AND contains(w, '.') THEN CASE WHEN instr(reverse(w), ',') < instr(reverse(w), '.') THEN replace(replace(w, '.', ''), ',', '.') ELSE replace(w, ',', '') END ELSE replace(w, ',', '.') END AS n FROM t)
      SELECT file_id, line_no, pos::integer AS pos, CASE WHEN regexp_full_match(n, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(n AS double) END AS number FROM v""",
    "sku_normalize": "SELECT row_id, nullif(trim(sku), '') AS sku FROM catalog_items",
    "header_normalize": "WITH lines AS (SELECT DISTINCT file_id, raw_text FROM feed_lines WHERE line_no = 1), cells AS (SELECT file_id, unnest(string_split_regex(raw_text, '[;|,\\t]')) AS cell, generate_subscripts(string_split_regex(raw_text, '[;|,\\t]'), 1) - 1 AS pos FROM lines) SELECT file_id, pos::integer AS pos, trim(regexp_replace(regexp_replace(replace(lower(trim(replace(cell, chr(65279), ''))), 'ё', 'е'), '\\.[0-9]+$', ''), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS header FROM cells",
    "source_values": LINES + ", cells AS (SELECT file_id, unnest(string_split(raw_text, ';')) AS cell FROM lines) SELECT file_id, count(*) FILTER (WHERE lower(trim(cell, ' ')) NOT IN ('', '-', '—', 'нет', 'n/a', 'na', 'nan', 'none')) AS filled, count(*) AS cells FROM cells GROUP BY file_id",
    "sku_valid": "SELECT row_id, row_id % 8 >= 6 AS valid FROM catalog_items",
    "sku_of_number": "SELECT p_partkey, p_partkey || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.5' END AS sku FROM part",
    "decimal_text": "SELECT p_partkey, 'цена ' || p_size || lpad((p_partkey % 1000)::varchar, 3, '0') || '.' || (p_size % 10) || ' руб, елка' AS text FROM part",
    "attrs_extract": f"WITH {GOODS} SELECT row_idx, fat, volume_ml, weight_g, count FROM goods",
    "text_normalize": f"WITH {GOODS} SELECT row_idx, norm FROM goods",
    "token_sets": f"WITH {GOODS}, t AS (SELECT DISTINCT row_idx, unnest(string_split(norm, ' ')) AS t FROM goods) SELECT row_idx, coalesce(string_agg(t, ' ' ORDER BY t) FILTER (WHERE length(t) >= 3 AND t NOT IN ('товар', 'продукт', 'упаковка', 'фасованный', 'высший', 'сорт', 'шт')), '') AS tokens FROM t GROUP BY row_idx",
    "token_postings_bounded": f"WITH {NORM}, t AS (SELECT DISTINCT row_idx, unnest(string_split(norm, ' ')) AS t FROM normed), h AS (SELECT t, xor(" + CRC.format("t") + ", 4294967295::ubigint)::bigint AS crc FROM (SELECT DISTINCT t FROM t WHERE length(t) >= 3)), c AS (SELECT row_idx, crc, row_number() OVER (PARTITION BY row_idx ORDER BY crc, t) AS k FROM t JOIN h USING (t)), p AS (SELECT DISTINCT (crc % 8192)::integer AS bucket, row_idx FROM c WHERE k <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_idx) AS k FROM p) SELECT bucket, row_idx FROM r WHERE k <= 5",
    "candidate_shortlist_parts": f"WITH {NORM}, t AS (SELECT DISTINCT row_idx, unnest(string_split(norm, ' ')) AS t FROM normed), q AS (SELECT DISTINCT p_partkey AS obs_id, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part WHERE p_partkey % 20 = 0), h AS (SELECT t, (xor(" + CRC.format("t") + """, 4294967295::ubigint) % 8192)::integer AS bucket FROM (SELECT t FROM t UNION SELECT t FROM q) WHERE length(t) >= 3),
      p AS (SELECT bucket, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_idx) AS k FROM (SELECT DISTINCT bucket, row_idx FROM t JOIN h USING (t))) WHERE k <= 2048), n AS (SELECT bucket, count(*) AS n FROM p GROUP BY bucket),
      a AS (SELECT obs_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY coalesce(n, 0), bucket) AS k FROM (SELECT DISTINCT obs_id, bucket FROM q JOIN h USING (t)) LEFT JOIN n USING (bucket)) WHERE k <= 4),
      f AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY hits DESC, row_idx) AS k FROM (SELECT obs_id, row_idx, count(*) AS hits FROM a JOIN p USING (bucket) GROUP BY obs_id, row_idx))
      SELECT obs_id, count(*) AS candidates, max(hits) AS most_hits, sum(row_idx)::bigint AS row_sum FROM f WHERE k <= 50 GROUP BY obs_id""",
    "trigram_sets": f"WITH {CATALOG}, g AS (SELECT DISTINCT row_idx, substr(lower(name), i::integer, 3) AS g FROM catalog, unnest(range(1, length(name) - 1)) AS r(i)) SELECT row_idx, count(*) AS n, string_agg(g, '|' ORDER BY g) AS grams FROM g GROUP BY row_idx",
    "trigram_hash": "SELECT p_brand, xor(" + CRC.format("p_brand") + ", 4294967295::ubigint)::bigint AS crc FROM (SELECT DISTINCT p_brand FROM part)",
    "token_postings": f"WITH {NORM}, t AS (SELECT DISTINCT row_idx, unnest(string_split(norm, ' ')) AS t FROM normed), h AS (SELECT t, (xor(" + CRC.format("t") + ", 4294967295::ubigint) % 8192)::integer AS bucket FROM (SELECT DISTINCT t FROM t WHERE length(t) >= 3)), p AS (SELECT DISTINCT bucket, row_idx FROM t JOIN h USING (t)), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_idx) AS k FROM p) SELECT bucket, count(*) AS n, min(row_idx) AS first_row, max(row_idx) AS last_row FROM r WHERE k <= 2048 GROUP BY bucket",
    "ngram_postings": f"WITH {NORM}, g AS (SELECT DISTINCT row_idx, substr(norm, i::integer, 3) AS g FROM normed, unnest(range(1, length(norm) - 1)) AS r(i)), h AS (SELECT g, xor(" + CRC.format("g") + ", 4294967295::ubigint)::bigint AS crc FROM (SELECT DISTINCT g FROM g)), c AS (SELECT row_idx, crc, row_number() OVER (PARTITION BY row_idx ORDER BY crc, g) AS k FROM g JOIN h USING (g)), p AS (SELECT DISTINCT (crc % 8192)::integer AS bucket, row_idx FROM c WHERE k <= 12), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY row_idx) AS k FROM p) SELECT bucket, count(*) AS n, max(row_idx) AS last_row FROM r WHERE k <= 2048 GROUP BY bucket",
    "brand_subset_filter": f"WITH {CATALOG} SELECT row_idx, p_brand FROM catalog WHERE p_brand = 'Brand#17'",
    "attribute_conflict": f"""WITH {GOODS}, f AS (SELECT p_type, min(row_idx) AS row_idx FROM goods GROUP BY p_type), q AS (SELECT goods.* FROM goods JOIN f USING (row_idx))
      SELECT c.row_idx, CASE WHEN abs(q.fat - c.fat) > 0.05 THEN 'fat' WHEN (q.weight_g IS NOT NULL AND c.volume_ml IS NOT NULL) OR (q.volume_ml IS NOT NULL AND c.weight_g IS NOT NULL) THEN 'dimension'
        WHEN abs(q.weight_g - c.weight_g) > 1 THEN 'weight' WHEN abs(q.volume_ml - c.volume_ml) > 1 THEN 'volume' WHEN q.count <> c.count THEN 'count' END AS conflict FROM goods c JOIN q ON q.p_type = c.p_type""",
    "fuzzy_ratios": """WITH p AS (SELECT DISTINCT p_name, p_type FROM part), f AS (SELECT p_type, min(p_name) AS first_name FROM p GROUP BY p_type), x AS (SELECT *, list_sort(string_split(p_name, ' ')) AS ta, list_sort(string_split(first_name, ' ')) AS tb FROM p JOIN f USING (p_type)),
      y AS (SELECT *, array_to_string(ta, ' ') AS a, array_to_string(tb, ' ') AS b, list_sort(list_filter(list_distinct(ta), lambda t: NOT list_contains(tb, t))) AS da, list_sort(list_filter(list_distinct(tb), lambda t: NOT list_contains(ta, t))) AS db, list_sort(list_filter(list_distinct(ta), lambda t: list_contains(tb, t))) AS i FROM x),
      z AS (SELECT *, coalesce(array_to_string(da, ' '), '') AS sa, coalesce(array_to_string(db, ' '), '') AS sb, length(coalesce(array_to_string(i, ' '), '')) AS s FROM y),
      w AS (SELECT *, s + CASE WHEN s > 0 THEN 1 ELSE 0 END + length(sa) AS la, s + CASE WHEN s > 0 THEN 1 ELSE 0 END + length(sb) AS lb, """ + LCS.format("a", "b") + """ AS lcs_sort, CASE WHEN sa = '' OR sb = '' THEN 0 ELSE """ + LCS.format("sa", "sb") + """ END AS lcs_set FROM z),
      r AS (SELECT *, 100.0::double * (1.0::double - (length(a) + length(b) - 2 * lcs_sort)::double / (length(a) + length(b))) AS r1, 100.0::double * (1.0::double - (length(sa) + length(sb) - 2 * lcs_set)::double / (la + lb)) AS r0 FROM w)
      SELECT p_name, p_type, cast(printf('%.3f', r1) AS double) AS sort_ratio, cast(printf('%.3f', CASE WHEN s > 0 AND (sa = '' OR sb = '') THEN 100.0::double WHEN s = 0 THEN r0 ELSE greatest(r0, 100.0::double * (1.0::double - (1 + length(sa))::double / (s + la)), 100.0::double * (1.0::double - (1 + length(sb))::double / (s + lb))) END) AS double) AS set_ratio FROM r""",
    "manual_override": f"WITH {CATALOG} SELECT row_idx, sku, CASE WHEN row_idx % 7 = 0 THEN upper(name) ELSE name END AS name, sale_price, CASE WHEN row_idx % 7 <> 0 THEN promo_price END AS promo_price FROM catalog",
    "manual_sku_lookup": "SELECT upper(sku) AS wanted, min(row_id) AS row_idx, arg_min(product_name, row_id) AS product_name FROM catalog_items GROUP BY upper(sku)",
    "payload_validate": """WITH t AS (SELECT DISTINCT tag_id, product_name, regular_price, promo_price, lower(trim(unit)) AS u, confidence FROM price_tags),
      k AS (SELECT *, CASE WHEN u IN ('упаковка', 'уп') THEN 'упак' WHEN u = '100 г' THEN '100г' ELSE u END AS unit2 FROM t),
      e AS (SELECT *, CASE WHEN tag_id % 11 = 0 THEN 'json' WHEN NOT coalesce(confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence), false) THEN 'confidence'
        WHEN NOT coalesce(unit2 IN ('шт', 'кг', '100г', 'упак', 'л'), false) THEN 'unit' WHEN NOT coalesce(regular_price > 0 AND regular_price <= 10000000, false) THEN 'regular_price'
        WHEN promo_price IS NOT NULL AND NOT (promo_price > 0 AND promo_price <= 10000000) THEN 'promo_price' WHEN coalesce(trim(product_name), '') = '' THEN 'product_name' END AS error_code FROM k)
      SELECT tag_id, error_code, CASE WHEN error_code IS NULL THEN cast(printf('%.2f', regular_price) AS double) END AS regular_price, CASE WHEN error_code IS NULL THEN unit2 END AS unit, CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS extraction_status FROM e""",
    "confidence_gate": f"""WITH {OBSERVATION}, g AS (SELECT confidence, CASE WHEN extraction_status <> 'ok' THEN 'failed' WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'bad confidence' WHEN confidence < 0.55 THEN 'low confidence' ELSE 'match' END AS gate FROM observation)
      SELECT gate, CASE WHEN gate IN ('failed', 'bad confidence') THEN 'error' ELSE 'ok' END AS extraction_status, count(*) AS n, CASE WHEN gate = 'bad confidence' THEN 0 ELSE count(confidence) END AS with_confidence FROM g GROUP BY gate""",
    "sanitize_text": "WITH t AS (SELECT doc_id, left(regexp_replace(coalesce(text, ''), '[\\x{00}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}]', '', 'g'), 500) AS c FROM documents) SELECT doc_id, CASE WHEN regexp_matches(regexp_replace(c, '^[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ''), '^[=+\\-@]') THEN '''' || c ELSE c END AS cell FROM t",
    "mock_provider": "SELECT file_id, (list_sum(list_transform(string_split(file_name, ''), lambda c: unicode(c))) % 4)::bigint AS choice FROM feed_files",
    "rate_limit_global": LIMIT.format(source=EVENTS.format(who="'all'"), window="21600000000", most=8) + " SELECT accepted, count(*) AS n FROM r GROUP BY accepted",
    "rate_limit_per_user": LIMIT.format(source=EVENTS.format(who="user_id"), window="86400000000", most=3) + " SELECT event_id, who AS user_id, accepted FROM r",
    "quota_with_gap": "WITH RECURSIVE e AS (" + EVENTS.format(who="user_id") + """), r AS (SELECT event_id, who, n, t, true AS accepted, 0.0::double AS retry_after, [t] AS acc FROM e WHERE n = 1 UNION ALL
      SELECT event_id, who, n, t, ok, CASE WHEN ok THEN 0.0 WHEN near THEN greatest(1.0, ceil((1800000000 - (t - kept[-1])) / 1e6)) ELSE greatest(1.0, ceil((kept[1] + 259200000000 - t) / 1e6)) END::double, CASE WHEN ok THEN list_append(kept, t) ELSE kept END
      FROM (SELECT *, coalesce(t - kept[-1] < 1800000000, false) AS near, NOT coalesce(t - kept[-1] < 1800000000, false) AND len(kept) < 6 AS ok FROM (SELECT e.event_id, e.who, e.n, e.t, list_filter(r.acc, lambda a: a > e.t - 259200000000) AS kept FROM r JOIN e ON e.who = r.who AND e.n = r.n + 1)))
      SELECT event_id, accepted, retry_after FROM r""",
    "session_ttl": "WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000)::integer, 1) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, (sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id))::bigint AS session FROM g) SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, session",
    "session_budget": "WITH e AS (SELECT event_id, user_id, ts, floor(value)::bigint AS b FROM events), r AS (SELECT *, (row_number() OVER w)::integer AS k, (sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::bigint AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, k AS items_so_far, total AS bytes_so_far, CASE WHEN b IS NULL OR b < 0 THEN 'size' WHEN b > 150 THEN 'item_bytes' WHEN k > 50 THEN 'item_count' WHEN total > 2000 THEN 'total_bytes' END AS problem FROM r",
    "circuit_breaker_runs": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events) SELECT user_id, epoch_us(min(ts)) AS run_start_us, count(*) AS run_length, count(*) >= 3 AS tripped FROM n WHERE event_type = 'error' GROUP BY user_id, island",
    "upload_manifest_running_budget": "WITH r AS (SELECT file_id, n_lines AS b, (row_number() OVER (PARTITION BY feed_id ORDER BY file_id))::integer AS k, (sum(n_lines) OVER (PARTITION BY feed_id ORDER BY file_id ROWS UNBOUNDED PRECEDING))::bigint AS total FROM feed_files) SELECT file_id, k AS items_so_far, total AS bytes_so_far, CASE WHEN b IS NULL OR b < 0 THEN 'size' WHEN b > 70 THEN 'item_bytes' WHEN k > 8 THEN 'item_count' WHEN total > 400 THEN 'total_bytes' END AS problem FROM r",
    "unique_filenames": "WITH f AS (SELECT file_id, regexp_extract(file_name, '^[^0-9]*') || feed_id || '.csv' AS name FROM feed_files), r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY file_id) AS n FROM f) SELECT file_id, CASE WHEN n = 1 THEN name ELSE left(name, length(name) - 4) END AS stem, CASE WHEN n > 1 THEN n END AS suffix FROM r",
    "fingerprint_sha256": "SELECT doc_id, sha256(coalesce(source, '') || ':' || coalesce(text, '')) AS fingerprint FROM documents",
    "allow_list": "SELECT user_id, count(*) AS n FROM events WHERE user_id > 0 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY user_id",
    "id_list_parse": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id > 0 AND event_id > 0 THEN CASE WHEN user_id = event_id THEN user_id::varchar ELSE user_id || ',' || event_id END END AS ids FROM events",
}
SQL = {k: v.replace(" , s AS (", ", s AS (") for k, v in SQL.items()}
