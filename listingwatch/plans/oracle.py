"""DuckDB SQL for the listing queries; written from the rules, not from the Spark plans."""

from __future__ import annotations

OBS = """obs AS (
    SELECT event_id AS seq, user_id AS offer_id, user_id % 10 AS source_id, ts AS observed_at, value AS price,
           CASE event_type WHEN 'purchase' THEN 'in_stock' WHEN 'error' THEN 'out_of_stock' WHEN 'click' THEN 'preorder' WHEN 'signup' THEN 'coming_soon' ELSE 'unknown' END AS availability
    FROM events
)"""

# The stable state as the sequential rule states it: fold each offer's observations one after the other.
STABLE = f"""{OBS}, numbered AS (
    SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY observed_at, seq) AS nth, lag(price) OVER (PARTITION BY offer_id ORDER BY observed_at, seq) AS price_before FROM obs
), folded AS (
    SELECT offer_id, nth, availability AS stable, CAST(NULL AS VARCHAR) AS candidate, 0 AS candidate_count, CAST(NULL AS VARCHAR) AS from_state FROM numbered WHERE nth = 1
    UNION ALL
    SELECT n.offer_id, n.nth,
           CASE WHEN n.availability <> f.stable AND f.candidate IS NOT DISTINCT FROM n.availability AND f.candidate_count + 1 >= 2 THEN n.availability ELSE f.stable END,
           CASE WHEN n.availability = f.stable THEN NULL WHEN f.candidate IS NOT DISTINCT FROM n.availability AND f.candidate_count + 1 >= 2 THEN NULL ELSE n.availability END,
           CASE WHEN n.availability = f.stable THEN 0 WHEN f.candidate IS NOT DISTINCT FROM n.availability THEN CASE WHEN f.candidate_count + 1 >= 2 THEN 0 ELSE f.candidate_count + 1 END ELSE 1 END,
           f.stable
    FROM folded f JOIN numbered n ON n.offer_id = f.offer_id AND n.nth = f.nth + 1
), st AS (
    SELECT n.*, f.stable, f.candidate, f.candidate_count, f.from_state FROM numbered n JOIN folded f USING (offer_id, nth)
)"""

EVENTS = f"""{STABLE}, ev AS (
    SELECT seq, offer_id, source_id, observed_at, CASE
        WHEN nth = 1 THEN CASE stable WHEN 'in_stock' THEN 'became_available' WHEN 'preorder' THEN 'preorder_open' WHEN 'coming_soon' THEN 'coming_soon' END
        WHEN from_state = stable THEN NULL
        WHEN stable = 'in_stock' THEN CASE WHEN from_state IN ('out_of_stock', 'unknown', 'discovered') THEN 'back_in_stock' ELSE 'became_available' END
        WHEN stable = 'preorder' THEN 'preorder_open' WHEN stable = 'coming_soon' THEN 'coming_soon'
        WHEN stable = 'out_of_stock' AND from_state IN ('in_stock', 'preorder') THEN 'out_of_stock' END AS type, from_state, stable AS to_state, price FROM st
    UNION ALL
    SELECT seq, offer_id, source_id, observed_at, 'price_change', from_state, stable, price FROM st
    WHERE nth > 1 AND stable IN ('in_stock', 'preorder') AND ((price IS NULL) <> (price_before IS NULL)
        OR (greatest(abs(price), abs(price_before)) > 0 AND abs(price - price_before) / greatest(abs(price), abs(price_before)) >= 0.05))
), emitted AS (SELECT * FROM ev WHERE type IS NOT NULL)"""

COOLED = f"""{EVENTS}, ordered AS (
    SELECT *, row_number() OVER (PARTITION BY offer_id, type ORDER BY observed_at, seq) AS k FROM emitted
), cool AS (
    SELECT offer_id, type, k, observed_at AS last_at, true AS kept FROM ordered WHERE k = 1
    UNION ALL
    SELECT o.offer_id, o.type, o.k, CASE WHEN o.observed_at <= c.last_at + INTERVAL 72 HOUR THEN c.last_at ELSE o.observed_at END, o.observed_at > c.last_at + INTERVAL 72 HOUR
    FROM cool c JOIN ordered o ON o.offer_id = c.offer_id AND o.type = c.type AND o.k = c.k + 1
)"""

OPS = """ops AS (
    SELECT event_id AS seq, ['parser', 'source', 'notification', 'discovery', 'scheduler', 'worker'][1 + user_id % 6] AS component, 's' || user_id AS source_key,
           CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status, ts AS created_at, CASE WHEN event_type = 'error' THEN 'http_' || (user_id % 7 + 400) END AS error_class,
           event_id % 50 AS valid_count, event_id % 7 AS invalid_count, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS failed_count, event_id % 10 + 1 AS page_count,
           CASE WHEN event_id % 1001 = 7 THEN -1 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END::BIGINT AS page_failed_count FROM events
)"""

METRICS = f"""{OPS}, since AS (SELECT max(created_at) - INTERVAL 7 DAY AS since FROM ops), m AS (
    SELECT component, count(*) FILTER (created_at >= since) AS total, count(*) FILTER (created_at >= since AND status = 'success') AS success,
           count(*) FILTER (created_at >= since AND status = 'failed') AS failed, count(*) FILTER (created_at >= since AND status = 'skipped') AS skipped,
           max(created_at) FILTER (status = 'success') AS latest_success, arg_max(source_key, (created_at, seq)) FILTER (status = 'failed') AS last_failed_source,
           arg_max(error_class, (created_at, seq)) FILTER (status = 'failed') AS last_error_class, max(created_at) FILTER (status = 'failed') AS last_failure,
           coalesce(sum(valid_count) FILTER (created_at >= since), 0)::BIGINT AS valid_count, coalesce(sum(invalid_count) FILTER (created_at >= since), 0)::BIGINT AS invalid_count,
           coalesce(sum(failed_count) FILTER (created_at >= since), 0)::BIGINT AS failed_count, coalesce(sum(page_count) FILTER (created_at >= since), 0)::BIGINT AS page_count,
           coalesce(sum(page_failed_count) FILTER (created_at >= since AND page_failed_count >= 0), 0)::BIGINT AS page_failed_count
    FROM ops, since GROUP BY component
), metrics AS (SELECT *, CASE WHEN total > 0 THEN least(1.0, failed / total) ELSE 0.0 END::DOUBLE AS failure_rate,
    CASE WHEN valid_count + invalid_count + failed_count > 0 THEN (invalid_count + failed_count) / (valid_count + invalid_count + failed_count) ELSE 0.0 END::DOUBLE AS item_failure_rate,
    CASE WHEN page_count > 0 THEN least(1.0, page_failed_count / page_count) ELSE 0.0 END::DOUBLE AS page_failure_rate FROM m)"""

HEALTH = """health AS (
    SELECT source_key AS source, count(*) FILTER (status = 'failed' AND (ok_at IS NULL OR (created_at, seq) > (ok_at, ok_seq))) AS failures, min(ok_at) AS last_success
    FROM (SELECT *, arg_max(created_at, (created_at, seq)) FILTER (status = 'success') OVER (PARTITION BY source_key) AS ok_at,
                 arg_max(seq, (created_at, seq)) FILTER (status = 'success') OVER (PARTITION BY source_key) AS ok_seq FROM ops WHERE status <> 'skipped') GROUP BY source_key
)"""

FEED = """feed AS (
    SELECT l_partkey * 100000 + l_suppkey AS listing_id, l_suppkey AS source_id, p_name || ' ' || p_type AS title, 'CX-' || (p_partkey % 900 + 100) AS model, p_name, p_brand AS brand,
           CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(4900000000000 + p_partkey AS VARCHAR) END AS barcode, upper(replace(p_type || p_size, ' ', '')) AS sku, p_retailprice AS price,
           ['In Stock', 'SOLD OUT', '予約受付中', 'coming soon', 'x'][1 + l_suppkey % 5] AS stated, ['in_stock', 'out_of_stock', 'preorder', NULL][1 + l_partkey % 4] AS schema_state,
           ['in_stock', 'out_of_stock', 'preorder', 'coming_soon', NULL][1 + l_suppkey % 5] AS text_state, l_partkey % 2 = 0 AS button, p_partkey AS part
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON l_partkey = p_partkey
)"""

COLOURS = "['clear', 'red', 'blue', 'black', 'white', 'gold', 'silver', 'green', 'purple', 'pink']"
VARIANT = f"""nullif(array_to_string(list_sort(list_filter({COLOURS}, lambda c: regexp_matches(title, '(?i)\\b' || c || '\\b')
    AND (regexp_matches(title, '(?i)limited|exclusive|rare color|color|colour') OR regexp_matches(title, '(?i)\\b' || c || '$')))
    || CASE WHEN regexp_matches(title, '(?i)limited|exclusive') THEN ['limited'] ELSE [] END || CASE WHEN regexp_matches(title, '(?i)rare color') THEN ['rare-color'] ELSE [] END), '|'), '')"""

STATE = """states AS (
    SELECT *, coalesce(schema_state, text_state, 'unknown') AS s,
           CASE WHEN schema_state IS NULL THEN CASE WHEN text_state IS NULL THEN 0.2 ELSE 0.6 END WHEN text_state IS NULL THEN 0.85 WHEN text_state = schema_state THEN 0.95 ELSE 0.7 END AS c FROM feed
), judged AS (
    SELECT *, CASE WHEN button AND s = 'unknown' THEN 'in_stock' ELSE s END AS state,
           round(CAST(least(0.98, 0.05 + CASE WHEN button AND s = 'unknown' THEN greatest(c, 0.5) WHEN button AND s = 'in_stock' THEN least(0.98, c + 0.05) ELSE c END) AS DOUBLE), 2) AS confidence FROM states
)"""

# Parts as watched products, and a rule for each part.
CONTEXT = """numbered AS (SELECT *, p_partkey % 900 + 100 AS num, p_name || ' ' || p_type || ' CX-' || (p_partkey % 900 + 100) AS own_title FROM part), entries AS (
    SELECT num, list_sort(list(DISTINCT 'Line ' || p_brand)) AS aliases, list_sort(list(DISTINCT p_size)) AS sizes, list_sort(list(DISTINCT 'P' || p_size)) AS codes, list_sort(list(DISTINCT 'size ' || p_size)) AS names FROM numbered GROUP BY num
), titled AS (
    SELECT p_partkey AS product_id, num, CASE WHEN p_partkey % 10 < 9 THEN own_title ELSE aliases[1] END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'B-' || (p_partkey % 50 + 10) END AS model,
           CAST(4900000000000 + p_partkey AS VARCHAR) AS barcode, aliases, sizes, codes, names FROM numbered JOIN entries USING (num)
), ctx AS (
    SELECT *, list_filter([title, model, 'CX-' || num, barcode], lambda x: x IS NOT NULL) AS base, aliases || codes || names AS syn,
           list_filter([CASE WHEN product_id % 10 < 9 THEN 'CX-' || num END, model, 'CX-' || num], lambda x: x IS NOT NULL) AS models, array_to_string(base || syn, ' ') AS txt,
           trim(regexp_replace(lower(txt), '[^a-z0-9-]+', ' ', 'g')) AS hay, list_transform(base || syn, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9-]+', ' ', 'g'))) AS folded FROM titled
)"""
RULES = "rules AS (SELECT p_partkey AS rule_id, p_partkey % 7 AS k, num AS r_num, own_title AS r_title, p_type AS r_type, p_name AS r_name, p_size AS r_size FROM numbered)"

SQL = {
    "o1_latest_offer": f"""WITH RECURSIVE {STABLE}
        SELECT offer_id, source_id, arg_max(price, (observed_at, seq)) AS price, arg_max(availability, (observed_at, seq)) AS availability, arg_max(stable, (observed_at, seq)) AS stable,
               min(observed_at) AS first_seen, max(observed_at) AS last_seen, max(CASE WHEN nth = 1 OR from_state <> stable THEN observed_at END) AS last_changed, count(*) AS observations
        FROM st GROUP BY offer_id, source_id""",
    "o2_stable_state": f"WITH RECURSIVE {STABLE} SELECT seq, offer_id, stable, candidate, CAST(candidate_count AS BIGINT) AS candidate_count FROM st",
    "e4_events": f"WITH RECURSIVE {EVENTS} SELECT * FROM emitted",
    "e5_cooldown": f"WITH RECURSIVE {COOLED} SELECT o.* EXCLUDE (k) FROM ordered o JOIN cool c USING (offer_id, type, k) WHERE c.kept",
    "e6_event_feed": f"WITH RECURSIVE {EVENTS} SELECT seq, offer_id, type, to_state FROM emitted ORDER BY seq DESC, type LIMIT 200",
    "f1_scan_presence": """WITH seen AS (
            SELECT l_suppkey AS source_id, strftime(l_shipdate, '%Y-%m') AS scan_id, l_partkey AS offer_id, bool_and(l_returnflag = 'R') AS terminal FROM lineitem GROUP BY ALL
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY scan_id) AS rank FROM (SELECT DISTINCT source_id, scan_id FROM seen)
        ), o AS (
            SELECT source_id, offer_id, coalesce(max(rank) FILTER (NOT terminal), min(rank) - 1) AS good, arg_max(terminal, rank) AS terminal FROM seen JOIN ranked USING (source_id, scan_id) GROUP BY ALL
        ), l AS (SELECT source_id, max(rank) AS last FROM ranked GROUP BY ALL)
        SELECT o.source_id, o.offer_id, last - good AS misses, CASE WHEN last = good THEN 'fresh' WHEN last - good < 3 THEN 'stale' ELSE 'archived' END AS freshness,
               r.scan_id AS archived_scan, CASE WHEN last - good >= 3 THEN CASE WHEN terminal THEN 'terminal_signal' ELSE 'missing_from_successful_scan' END END AS archive_reason
        FROM o JOIN l USING (source_id) LEFT JOIN ranked r ON r.source_id = o.source_id AND r.rank = good + 3""",
    "f8_source_health": f"WITH {OPS}, {HEALTH} SELECT *, failures >= 3 AS unhealthy FROM health",
    "q3_component_metrics": f"WITH {METRICS} SELECT * FROM metrics",
    "q6_top_error_sources": f"WITH {OPS} SELECT component, source_key, count(*) AS failures FROM ops WHERE status = 'failed' GROUP BY ALL ORDER BY failures DESC, component, source_key LIMIT 20",
    "q7_slo_alerts": f"""WITH {METRICS}, {HEALTH}, a AS (
            SELECT concat_ws(',', CASE WHEN (SELECT max(failures) FROM health) >= 3 THEN 'source_failure_streak' END,
                   CASE WHEN (SELECT greatest(failure_rate, item_failure_rate, page_failure_rate) FROM metrics WHERE component = 'parser') >= 0.1 THEN 'parser_failure_rate' END,
                   CASE WHEN (SELECT failure_rate FROM metrics WHERE component = 'notification') >= 0.1 THEN 'notification_failure_rate' END) AS alerts)
        SELECT alerts, CASE WHEN alerts = '' THEN 'ok' ELSE 'degraded' END AS status FROM a""",
    "n6_page_urls": r"""WITH u AS (
            SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
                   list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '') AS params FROM pages
        ), q AS (
            SELECT *, array_to_string(list_sort(list_filter(params, lambda p: split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'ref_', 'spm', '_ga'))), '&') AS query FROM u
        ), c AS (
            SELECT *, 'https://' || regexp_replace(host, '^www\.', '') || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM q
        )
        SELECT page_id, scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/$', '') END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS normalized,
               canonical, sha256(canonical) AS fingerprint, array_to_string(string_split(host, '.')[-2:], '.') AS domain, true AS public FROM c""",
    "n15_listing_fields": f"WITH {FEED} SELECT listing_id, model, {VARIANT} AS variant, barcode, sku, trim(regexp_replace(lower(title), '[^a-z0-9-]+', ' ', 'g')) AS alias FROM feed",
    "n14_prices": "SELECT p_partkey, CAST(round(p_retailprice, 2) AS DOUBLE) AS price, ['TWD', 'USD', 'JPY', 'EUR', 'GBP'][1 + p_partkey % 5] AS currency FROM part",
    "c7_availability": f"WITH {FEED}, {STATE} SELECT listing_id, state, confidence, CASE stated WHEN '予約受付中' THEN 'ja' ELSE 'en' END AS locale, CASE WHEN regexp_matches(title, '(?i)\\bused\\b') THEN 'used' END AS excluded FROM judged",
    "i3_product_match": f"""WITH {FEED}, v AS (SELECT *, {VARIANT} AS variant FROM feed), p AS (
            SELECT part AS product_id, r.barcode, r.sku, r.model, r.brand, r.variant FROM (
                SELECT part, arg_min(struct_pack(barcode := barcode, sku := sku, model := model, brand := brand, variant := variant), listing_id) AS r
                FROM v GROUP BY part)
        ), l AS (SELECT * FROM v),
        b AS (SELECT listing_id, min(product_id) AS id FROM l JOIN p ON l.barcode = p.barcode GROUP BY ALL),
        s AS (SELECT listing_id, min(product_id) AS id FROM l JOIN p ON l.sku = p.sku AND l.model = p.model AND lower(l.brand) = lower(p.brand) GROUP BY ALL HAVING count(*) = 1),
        m AS (SELECT listing_id, min(product_id) FILTER (lower(l.brand) = lower(p.brand)) AS id FROM l JOIN p ON l.model = p.model AND l.variant IS NOT DISTINCT FROM p.variant AND l.sku = p.sku
              GROUP BY ALL HAVING count(*) FILTER (lower(l.brand) = lower(p.brand)) = 1)
        SELECT l.listing_id, coalesce(b.id, s.id, m.id) AS product_id, CASE WHEN b.id IS NOT NULL THEN 'barcode' WHEN s.id IS NOT NULL THEN 'sku' WHEN m.id IS NOT NULL THEN 'model' END AS matched_by
        FROM l LEFT JOIN b USING (listing_id) LEFT JOIN s USING (listing_id) LEFT JOIN m USING (listing_id)""",
    "w1_match_context": f"WITH {CONTEXT} SELECT product_id, num AS catalog_product_id, 'en' AS locale, array_to_string(base, '|') AS base_values, array_to_string(syn, '|') AS synonym_values, array_to_string(models, '|') AS models, barcode AS barcodes, array_to_string(sizes, '|') AS catalog_part_ids FROM ctx",
    "w3_rule_matches": f"""WITH {CONTEXT}, {RULES}, hit AS (
            SELECT rule_id, product_id, k FROM ctx, rules WHERE NOT (rule_id % 2 = 0 AND contains(hay, 'red')) AND CASE k
                WHEN 0 THEN list_contains(folded, lower(r_title)) WHEN 1 THEN contains(hay, lower(r_type) || ' cx-' || r_num)
                WHEN 2 THEN rule_id % 35 <> 2 AND regexp_matches(txt, '(?i)' || split_part(r_name, ' ', 2) || ' \\w+ cx-' || (r_num // 10) || '[0-4]')
                WHEN 3 THEN product_id = rule_id WHEN 4 THEN list_contains(list_transform(models, lambda m: lower(m)), 'cx-' || r_num)
                WHEN 5 THEN list_contains(sizes, r_size) AND contains(hay, 'cx-' || r_num) ELSE num = r_num AND rule_id % 3 <> 2 END)
        SELECT rule_id, product_id, CASE WHEN k IN (1, 2, 5) THEN 0.85 ELSE 0.99 END::DOUBLE AS confidence, ['keyword_exact', 'keyword_contains', 'regex', 'barcode_exact', 'model_exact', 'catalog_part_contains', 'catalog_product_exact'][1 + k] AS match_type,
            ['keyword_exact', 'keyword_contains', 'regex', 'barcode_exact', 'model_exact', 'catalog_part_contains|keyword_contains', 'catalog_product_exact'][1 + k] AS reasons FROM hit""",
    "w11_rule_checks": "SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 7 IN (1, 5) THEN 'contains' WHEN p_partkey % 7 = 2 THEN 'regex' ELSE 'exact' END AS mode, p_partkey % 35 <> 2 AS valid FROM part",
    "s14_snapshot_upsert": f"""WITH {OBS}, used AS (SELECT * FROM obs WHERE seq % 2 = 0 OR offer_id % 3 <> 0), late AS (SELECT * FROM used QUALIFY (seq % 2) = max(seq % 2) OVER (PARTITION BY offer_id))
        SELECT offer_id, p.price, first_seen, last_seen, seen FROM (SELECT offer_id, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS seen FROM used GROUP BY offer_id)
        JOIN (SELECT offer_id, arg_max(price, (observed_at, seq)) AS price FROM late GROUP BY offer_id) p USING (offer_id)""",
    "a2_product_digest": f"""WITH {FEED}, {STATE} SELECT part AS product_id, max(brand) AS title,
            string_agg('shop' || source_id || ' ' || state || ' ' || coalesce(printf('%.2f', price), '-'), chr(10)
                ORDER BY coalesce(list_position(['in_stock', 'preorder', 'coming_soon', 'out_of_stock'], state), 9), price IS NULL, price, 'shop' || source_id) AS body FROM judged GROUP BY part""",
    "r3_offer_board": f"""WITH RECURSIVE {STABLE}, o AS (
            SELECT offer_id, source_id, arg_max(stable, (observed_at, seq)) AS stable, arg_max(price, (observed_at, seq)) AS price, max(observed_at) AS last_seen FROM st GROUP BY ALL)
        SELECT *, stable IN ('in_stock', 'preorder') AS purchasable FROM o ORDER BY purchasable DESC, last_seen DESC, offer_id LIMIT 200""",
    "k4_catalog_listing": "SELECT p_brand, count(*) AS products, min(p_retailprice) AS lowest, count(DISTINCT lower(p_type)) AS aliases, array_to_string(list_sort(list_distinct(list(lower(p_type)))), ' | ') AS alias_list FROM part GROUP BY p_brand",
    "d5_budgeted_pick": r"""WITH p AS (
            SELECT page_id, array_to_string(string_split(regexp_extract(url, '://([^/?#:]*)', 1), '.')[-2:], '.') AS site, octet_length(encode(html)) AS bytes,
                   lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || ' ' || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '\?([^#]*)', 1) END || ' ') AS hay FROM pages
        ), s AS (
            SELECT *, CAST(least(100, 35 + 45 * CAST(regexp_matches(hay, 'shop|store') AS INT) + 45 * CAST(regexp_matches(hay, '\b[a-z]{2}-?[0-9]{2,3}\b') AS INT)
                   + 20 * CAST(regexp_matches(hay, '/g/g|/product|/item|/goods|/p/') AS INT) + 10 * CAST(regexp_matches(hay, 'category|collection|search|catalog|c/c|page=|pageno=') AS INT)
                   - 100 * CAST(regexp_matches(hay, 'login|signin|account|cart|checkout|privacy|terms|contact|javascript:|mailto:') AS INT)) AS INT) AS priority FROM p
        ), r AS (
            SELECT *, row_number() OVER w AS place, coalesce(sum(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM s WINDOW w AS (PARTITION BY site ORDER BY priority DESC, page_id)
        )
        SELECT page_id, site, priority, place, CAST(spent AS BIGINT) AS spent FROM r WHERE place <= 100 AND spent < 200000""",
    "m6_post_signals": r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), l AS (
            SELECT *, len(list_distinct(list_filter(list_transform(regexp_extract_all(t, 'https?://[^\s<>"'']+'), lambda x: rtrim(x, '),.!?。、，')), lambda x: NOT contains(x, '@')))) AS n FROM c)
        SELECT conv_id, turn, n AS n_links, round(CAST(least(1.0, CASE WHEN length(t) - length(replace(t, '#', '')) >= 8 THEN 0.35 ELSE 0 END + CASE WHEN n >= 5 THEN 0.35 ELSE 0 END
                   + CASE WHEN length(t) > 9 AND len(list_filter(range(1, length(t) - 8), lambda i: t[i] <> chr(10) AND t[i:i + 9] = repeat(t[i], 10))) > 0 THEN 0.35 ELSE 0 END
                   + CASE WHEN length(t) < 8 THEN 0.25 ELSE 0 END) AS DOUBLE), 2) AS spam,
               concat_ws(',', CASE WHEN regexp_matches(lower(t), 'new[^a-z0-9-]+product') THEN 'new_product' END, CASE WHEN contains(lower(t), 'lottery') THEN 'lottery' END,
                   CASE WHEN regexp_matches(lower(t), 'pre-?order') THEN 'preorder' END, CASE WHEN contains(lower(t), 'restock') THEN 'restock' END, CASE WHEN n > 0 THEN 'store_link' END) AS leads FROM l""",
}
