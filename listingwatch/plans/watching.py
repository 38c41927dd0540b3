"""Registered queries of watching, catalog, operations, pages and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import catalog, classify, community, frontier, identity, matching, operations, pages, timeline, watch
from ..sources.tables import cut
from . import queries as base
from .oracle import COOLED, EVENTS, FEED, HEALTH, METRICS, OPS, SQL, STABLE, STATE
from .views import feed, observations, table
from .views import operations as ops_view

TYPES = ("price_anomaly", "preorder_open", "in_stock")
FOUND = f"found AS ({SQL['w3_rule_matches']})"


def at(when: str):
    return F.expr(f"timestamp_ntz'{when}'")


def named(rows: DataFrame, **columns) -> DataFrame:
    return rows.select(*[c.alias(n) for n, c in columns.items()])


# --- watching


def w5_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(base.w3_rule_matches(spark, sf_dir).select("rule_id", "product_id", "confidence"), "matches")
    known = found.where("product_id % 3 <> 0").select("*", at("2024-01-01").alias("first_matched"), at("2024-01-01").alias("last_matched"))
    return watch.match_table(known, found.where("product_id % 5 <> 0"), at("2024-01-02"))


W5 = f"""WITH {FOUND} SELECT rule_id, product_id, confidence, CASE WHEN product_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS first_matched,
    CASE WHEN product_id % 5 <> 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS last_matched FROM found WHERE product_id % 3 <> 0 OR product_id % 5 <> 0"""


def product_events(spark, sf_dir):
    found = base.e5_cooldown(spark, sf_dir)
    return found.select(F.col("seq").alias("event_id"), F.col("offer_id").alias("product_id"), "offer_id", "type", "to_state", "observed_at")


def alerts_of(spark, sf_dir, events):
    """Alerts of product_events' rows. Only products that they speak of meet the rules; an event in seven was told before."""
    context = base.watched_context(spark, sf_dir).join(events.select("product_id").distinct(), "product_id", "left_semi")
    matches = cut(watch.match_rules(context, base.watch_rules(spark, sf_dir)).select("rule_id", "product_id"), "matches")
    wanted = matches.select("rule_id").distinct().select("rule_id", F.explode(F.array(*map(F.lit, TYPES))).alias("alert_type")).where("rule_id % 2 = 1 or alert_type <> 'price_anomaly'")
    known = watch.alerts(events.where("event_id % 7 = 0"), matches, wanted, None)
    return watch.alerts(events, matches, wanted, known)


def w7_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(spark, sf_dir, cut(product_events(spark, sf_dir), "told-events"))


def newest_alerts(spark, sf_dir, n):
    return watch.newest_alerts(product_events(spark, sf_dir), n, lambda events: alerts_of(spark, sf_dir, events))


W7 = f"""WITH RECURSIVE {COOLED}, {FOUND}, e AS (
    SELECT o.seq AS event_id, o.offer_id AS product_id, CASE o.type WHEN 'price_change' THEN 'price_anomaly' WHEN 'preorder_open' THEN 'preorder_open' WHEN 'back_in_stock' THEN 'in_stock' WHEN 'became_available' THEN 'in_stock' END AS alert_type
    FROM ordered o JOIN cool c USING (offer_id, type, k) WHERE c.kept)
    SELECT 'watch:' || rule_id || ':event:' || event_id || ':' || alert_type AS dedup_key, rule_id, event_id, product_id, alert_type FROM e JOIN found USING (product_id)
    WHERE alert_type IS NOT NULL AND (rule_id % 2 = 1 OR alert_type <> 'price_anomaly') AND event_id % 7 <> 0"""


def a1_stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = timeline.latest_offers(base.stable(spark, sf_dir))
    offers = offers.select("offer_id", F.when(F.col("last_seen") < at("2024-01-28"), "stale").otherwise("fresh").alias("freshness"))
    return watch.split_stale(product_events(spark, sf_dir), offers).select("event_id", "offer_id", "type", "to_state", "suppressed")


A1 = f"""WITH RECURSIVE {COOLED}, seen AS (SELECT offer_id, max(observed_at) AS last FROM obs GROUP BY ALL)
    SELECT o.seq AS event_id, o.offer_id, o.type, o.to_state, o.to_state IN ('in_stock', 'preorder') AND last < TIMESTAMP '2024-01-28' AS suppressed
    FROM ordered o JOIN cool c USING (offer_id, type, k) JOIN seen s ON s.offer_id = o.offer_id WHERE c.kept"""


def deliveries(spark, sf_dir):
    groups = product_events(spark, sf_dir).groupBy("product_id").agg(F.array_sort(F.collect_set("event_id")).alias("ids"))  # one product's pending events
    pending = groups.select("product_id", F.concat_ws(":", "product_id", F.array_join(F.col("ids").cast("array<string>"), ",")).alias("dedup_key"))
    channels = spark.createDataFrame([("chat", True), ("mail", False), ("log", True)], "channel string, configured boolean")
    tried = pending.where("product_id % 3 <> 0").select(F.lit("chat").alias("channel"), "dedup_key", F.when(F.col("product_id") % 3 == 1, "sent").otherwise("failed").alias("status"))
    return watch.outbox(pending, channels, tried)


def a3_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir)


A3 = f"""WITH RECURSIVE {COOLED}, g AS (
    SELECT offer_id, offer_id || ':' || array_to_string(list_sort(list(DISTINCT o.seq)), ',') AS dedup_key FROM ordered o JOIN cool c USING (offer_id, type, k) WHERE c.kept GROUP BY offer_id)
    SELECT dedup_key, channel, CASE WHEN channel = 'mail' THEN 'unconfigured' WHEN channel = 'chat' AND offer_id % 3 = 1 THEN 'skipped' WHEN channel = 'chat' AND offer_id % 3 = 2 THEN 'retry' ELSE 'queued' END AS state
    FROM g, (VALUES ('chat'), ('mail'), ('log')) AS t(channel)"""


def a3_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.completed(deliveries(spark, sf_dir))


# --- catalog


def catalog_rows(spark, sf_dir, **given):
    return feed(spark, sf_dir, model=text.model_code(F.col("model_text")), **given).select(
        F.col("listing_id").alias("seq"), "source_id", "model", "brand", text.barcode(F.col("barcode")).alias("barcode"), "title", F.lit("en").alias("locale"), (F.col("source_id") % 10 == 0).alias("official"), "price", "part"
    )


def k1_catalog_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.link_listings(catalog_rows(spark, sf_dir))


K1 = f"""WITH {FEED} SELECT model, arg_min(brand, listing_id) FILTER (brand IS NOT NULL) AS brand, arg_min(barcode, listing_id) FILTER (barcode IS NOT NULL) AS barcode,
    CASE WHEN bool_or(source_id % 10 = 0) THEN 'verified' ELSE 'pending' END AS verification, count(*) AS listings, 'CX' AS system, 'X' AS generation FROM feed GROUP BY model"""


def k3_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.aliases(catalog_rows(spark, sf_dir))


K3 = f"""WITH {FEED} SELECT model, 'en' AS locale, trim(regexp_replace(lower(title), '[^a-z0-9-]+', ' ', 'g')) AS alias_key, arg_max(title, listing_id) AS alias, bool_or(source_id % 10 = 0) AS verified, count(*) AS seen
    FROM feed GROUP BY model, alias_key"""


def with_msrp(rows):
    return rows.withColumn("msrp", F.when(F.col("source_id") % 4 != 0, F.col("price")))


def official(spark, sf_dir, **given):
    return with_msrp(catalog_rows(spark, sf_dir, **given).withColumn("title", F.when(F.col("part") % 11 != 0, F.col("title"))))


def k6_official_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.official_items(official(spark, sf_dir)).select("model", "barcode", "msrp", "title", "verification")


K6 = f"""WITH {FEED} SELECT model, arg_min(barcode, listing_id) FILTER (barcode IS NOT NULL) AS barcode, arg_max(price, listing_id) FILTER (source_id % 4 <> 0) AS msrp, arg_max(title, listing_id) AS title,
    CASE WHEN count(DISTINCT barcode) > 1 THEN 'conflict' ELSE 'verified' END AS verification FROM feed WHERE part % 11 <> 0 GROUP BY model"""


def k6_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.review_items(official(spark, sf_dir)).select("seq", "model", "confidence")


def c10_term_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    found = classify.availability(F.col("availability_raw"), F.col("availability_text"), none, none, F.col("has_buy_button"), F.col("price"))
    unknown = feed(spark, sf_dir).where(found["state"] == "unknown")
    return catalog.term_queue(named(unknown, seq=F.col("listing_id"), kind=F.lit("availability"), raw=F.concat_ws(" / ", "availability_text", "brand"), locale=F.lit("en"), suggestion=F.col("title")))


C10 = f"""WITH {FEED}, {STATE} SELECT 'availability' AS kind, 'x ' || replace(lower(brand), '#', ' ') AS term, 'en' AS locale, arg_min(title, listing_id) AS suggestion, max(listing_id) AS last_seen, count(*) AS occurrences
    FROM judged WHERE state = 'unknown' GROUP BY term"""


def c3_exclusion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = classify.exclusion_reason(F.col("title"), F.lit(None).cast("string"), (("colour", "red|blue"), ("size", r"\bsmall\b")))
    rows = feed(spark, sf_dir).select("source_id", F.concat(F.lit("https://shop.example/"), F.col("part") % 20).alias("url"), reason.alias("reason"), F.col("listing_id").alias("seq"), "title")
    return catalog.exclusion_log(rows.where("reason is not null"))


C3 = f"""WITH {FEED}, r AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)red|blue') THEN 'colour' WHEN regexp_matches(title, '(?i)\\bsmall\\b') THEN 'size' END AS reason FROM feed)
    SELECT source_id, 'https://shop.example/' || (part % 20) AS url, reason, count(*) AS occurrences, min(listing_id) AS first_seen, max(listing_id) AS last_seen, arg_max(title, listing_id) AS title
    FROM r WHERE reason IS NOT NULL GROUP BY source_id, url, reason"""


def x1_candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("purchase", "approve", "error", "exclude", "click", "defer", "signup", "reopen")))
    events = table(spark, sf_dir, "events")
    decisions = events.where("event_type <> 'view'").select(F.col("user_id").alias("candidate_id"), kinds[F.col("event_type")].alias("decision"), F.col("event_id").alias("seq"))
    queue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), "p_brand")
    return catalog.decide(queue, decisions, "candidate_id")


X1 = """WITH d AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_type <> 'view' GROUP BY ALL)
    SELECT p_partkey AS candidate_id, p_brand, CASE t WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'exclude' WHEN 'click' THEN 'defer' ELSE 'pending' END AS status FROM part LEFT JOIN d ON user_id = p_partkey"""


def i8_merge_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    products = part.select(key.alias("product_id"), F.when(key % 2 == 1, F.col("p_brand")).alias("brand"), F.when(key % 3 == 1, F.col("p_name")).alias("name"))
    merges = part.where("p_size % 3 = 0 and p_partkey > 0").select(key.alias("source"), F.expr("p_partkey & (p_partkey - 1)").alias("target"))
    return frontier.merge_products(products, merges, ["brand", "name"])


I8 = """WITH RECURSIVE m AS (SELECT p_partkey AS s, p_partkey & (p_partkey - 1) AS t FROM part WHERE p_size % 3 = 0 AND p_partkey > 0),
    chain AS (SELECT p_partkey AS id, p_partkey AS now FROM part UNION ALL SELECT id, t FROM chain JOIN m ON s = now),
    kept AS (SELECT id, min(now) AS product_id FROM chain GROUP BY id)
    SELECT product_id, arg_min(p_brand, id) FILTER (id % 2 = 1) AS brand, arg_min(p_name, id) FILTER (id % 3 = 1) AS name, count(*) AS merged FROM kept JOIN part ON p_partkey = id GROUP BY product_id"""


# --- operations


def q1_parser_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.date_format("l_shipdate", "yyyy-MM").alias("scan_id"), "l_discount", "l_tax", "l_orderkey")
    scans = items.groupBy("source_id", "scan_id").agg(
        F.count("*").alias("parsed"), F.count("*").alias("pages"), F.count_if(F.col("l_discount") > 0.05).alias("invalid"), F.count_if(F.col("l_tax") == 0).alias("bad_pages"), F.count_if((F.col("l_tax") == 0) & (F.col("l_orderkey") % 2 == 0)).alias("maintenance")
    )
    scans = scans.withColumn("valid", F.col("parsed") - F.col("invalid"))
    return operations.parser_outcomes(scans).select("source_id", "scan_id", "valid", "status", "error_class")


Q1 = """WITH s AS (SELECT l_suppkey AS source_id, strftime(l_shipdate, '%Y-%m') AS scan_id, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS invalid, count(*) FILTER (l_tax = 0) AS bad,
        count(*) FILTER (l_tax = 0 AND l_orderkey % 2 = 0) AS maintenance FROM lineitem GROUP BY ALL)
    SELECT source_id, scan_id, n - invalid AS valid, CASE WHEN n = invalid THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN n = invalid THEN CASE WHEN maintenance > 0 AND bad = n THEN 'maintenance' ELSE 'parse' END WHEN invalid > 0 OR bad > 0 THEN 'partial' END AS error_class FROM s"""


def f9_run_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.date_format("l_shipdate", "yyyy-MM").alias("scan_id"), (F.col("l_returnflag") == "R").alias("excluded"), F.col("l_linenumber").cast("long").alias("n_events"))
    return operations.run_accounts(items)


def f6_recrawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 7 * 600).cast("int").alias("base_seconds"), (F.col("s_suppkey") % 12).cast("int").alias("failures"))
    item = table(spark, sf_dir, "lineitem")
    offers = item.select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 97 == 0).alias("watched"), (F.col("l_quantity") > 49).alias("buyable"), F.col("l_shipdate").alias("released"))
    return operations.recrawl_plan(supplier, offers, at("1996-06-01")).select("source_id", F.col("seconds").cast("long").alias("seconds"), F.col("freshness_seconds").cast("long").alias("freshness_seconds"))


F6 = """WITH o AS (SELECT l_suppkey AS k, bool_or(l_partkey % 97 = 0) AS w, bool_or(l_quantity > 49 OR l_shipdate BETWEEN TIMESTAMP '1996-05-31' AND TIMESTAMP '1996-06-08') AS b FROM lineitem GROUP BY ALL),
    s AS (SELECT s_suppkey, greatest(60, s_suppkey % 7 * 600) AS base, s_suppkey % 12 AS f, coalesce(w, false) AS w, coalesce(b, false) AS b FROM supplier LEFT JOIN o ON k = s_suppkey),
    i AS (SELECT *, least(base, CASE WHEN w THEN 300 WHEN b THEN 900 ELSE base END) AS soon FROM s)
    SELECT s_suppkey AS source_id, CAST(greatest(30, soon, least(base, 300), CASE WHEN f > 0 THEN least(21600, 60 * pow(2, f - 1)) ELSE 0 END) AS BIGINT) AS seconds, CAST(greatest(2 * base, 1800) AS BIGINT) AS freshness_seconds FROM i"""


def f7_due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda s: F.max(F.when(F.col("status") == s, F.col("created_at")))
    sources = ops_view(spark, sf_dir).groupBy("source_key").agg(last("success").alias("last_success"), last("failed").alias("last_failure"))
    return operations.due_sources(sources.withColumnRenamed("source_key", "source_id").withColumn("base_seconds", F.lit(43200)), at("2024-01-31"))


F7 = f"""WITH {OPS}, l AS (SELECT source_key AS source_id, max(created_at) FILTER (status <> 'skipped') AS last_try FROM ops GROUP BY ALL)
    SELECT source_id, last_try, last_try + INTERVAL 12 HOUR AS next_due FROM l WHERE last_try IS NULL OR last_try + INTERVAL 12 HOUR <= TIMESTAMP '2024-01-31'"""


def q4_current_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.current_errors(ops_view(spark, sf_dir))


Q4 = f"""WITH {OPS} SELECT source_key, arg_max(component, (created_at, seq)) AS component, max(created_at) AS created_at FROM ops WHERE component IN ('source', 'parser')
    GROUP BY source_key HAVING arg_max(status, (created_at, seq)) = 'failed'"""


def q5_freshness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.freshness_counts(base.f1_scan_presence(spark, sf_dir))


Q5 = f"SELECT count(*) FILTER (freshness = 'fresh') AS fresh, count(*) FILTER (freshness = 'stale') AS stale, count(*) FILTER (freshness = 'archived') AS archived, 0::BIGINT AS unknown FROM ({SQL['f1_scan_presence']})"


def q8_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.concat(F.lit("HTTP 503 at https://shop.example/"), "source_key", F.lit(" token=abc"), "seq", F.lit(" bot12345:AA-b"), "seq", F.lit(" Authorization: Bearer abc"), "seq", F.lit(", password=x;y"))
    return operations.safe_diagnostics(ops_view(spark, sf_dir).withColumn("detail", detail), text.redact)


Q8 = f"WITH {OPS} SELECT seq, component, source_key, created_at, 'HTTP 503 at [url] token=[secret] bot[token] Authorization=[secret], password=[secret];y' AS detail FROM ops WHERE status = 'failed' ORDER BY created_at DESC, seq DESC LIMIT 50"


def t1_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.keep_newest(ops_view(spark, sf_dir), 5000, "seq")


def t2_blank_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return operations.blank_older(orders, "o_orderpriority", "o_orderdate", at("1997-01-01"))


# --- pages


def s2_structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written from the feed with a Product in a graph, read back."""
    price = F.format_string("%.2f", "price")
    offer = F.struct(F.lit("AggregateOffer").alias("@type"), price.alias("lowPrice"), F.array(F.struct(F.lit("TWD").alias("priceCurrency"), F.col("availability_raw").alias("availability"))).alias("offers"))
    product = F.struct(F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.col("title").alias("name"), F.struct(F.col("brand").alias("name")).alias("brand"), F.col("barcode").alias("gtin"), F.col("sku").alias("mpn"), offer.alias("offers"))
    graph = F.to_json(F.struct(F.array(F.struct(product.alias("mainEntity"))).alias("@graph")))
    html = F.concat(F.lit("<html><script type='application/ld+json'>{broken</script><script type=\"application/ld+json\">"), graph, F.lit("</script></html>"))
    rows = feed(spark, sf_dir, together=True).select("listing_id", pages.structured_product(html).alias("p"))
    return rows.select("listing_id", "p.*").drop("release_date", "description")


S2 = f"""WITH {FEED} SELECT listing_id, title, brand, barcode, p_type_size AS sku, printf('%.2f', price) AS price, 'TWD' AS currency, ['https://schema.org/InStock', 'http://schema.org/OutOfStock', 'PreOrder', ''][1 + part % 4] AS availability_raw
    FROM feed JOIN (SELECT p_partkey, p_type || ' ' || p_size AS p_type_size FROM part) ON p_partkey = part"""


def s9_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(table(spark, sf_dir, "pages"))


S9 = r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
    r AS (SELECT page_id, host, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN 'https://' || host || href END AS target FROM h),
    c AS (SELECT page_id, host, regexp_replace(regexp_extract(target, '://([^/?#]*)', 1), '^www\.', '') AS to_host, rtrim(regexp_extract(target, '://[^/?#]*([^?#]*)', 1), '/') AS path FROM r WHERE target IS NOT NULL)
    SELECT DISTINCT page_id, 'https://' || to_host || CASE WHEN path = '' THEN '/' ELSE path END AS target FROM c
    WHERE array_to_string(string_split(host, '.')[-2:], '.') = array_to_string(string_split(to_host, '.')[-2:], '.')"""

ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/1\nAllow: /en/12 # longer\nDisallow: /*page=\nDisallow:"


def d1_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url")
    robots = found.select(urls.bare_host(F.col("url")).alias("host")).distinct().withColumn("body", F.lit(ROBOTS))
    return pages.robots_allowed(found, pages.robots_rules(robots, "watcher"), count_signs=True).select("page_id", "allowed")


D1 = r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN starts_with(path, '/en/12') AND NOT contains(path, 'page=') THEN true WHEN contains(path, 'page=') THEN NOT regexp_matches(path, '^/.*page=') ELSE NOT starts_with(path, '/en/1') END AS allowed FROM p"""


def d4_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: each line of an order links to the next line's part."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    line = table(spark, sf_dir, "lineitem")
    links = line.select(F.col("l_partkey").alias("page_id"), F.lead("l_partkey").over(w).alias("target"), F.col("l_quantity").alias("score")).where("target is not null")
    seeds = table(spark, sf_dir, "part").where("p_partkey % 500 = 7").select(F.col("p_partkey").alias("page_id"), F.lit("seed").alias("method"))
    return frontier.expand(seeds, links, 3)


D4 = """WITH RECURSIVE l AS (SELECT l_partkey AS page_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target, l_quantity FROM lineitem),
    d AS (SELECT DISTINCT page_id, target FROM l WHERE target IS NOT NULL AND l_quantity >= 10),
    f AS (SELECT p_partkey AS page_id, 0 AS depth FROM part WHERE p_partkey % 500 = 7 UNION SELECT target, depth + 1 FROM f JOIN d USING (page_id) WHERE depth < 3)
    SELECT page_id, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'seed' ELSE 'link' END AS method FROM f GROUP BY page_id"""


def d6_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).withColumn("model", F.when(F.col("part") % 2 == 0, text.model_code(F.col("model_text"))))
    score = classify.candidate_confidence(F.col("title"), F.col("model"), F.concat_ws(" ", "title", "brand"), F.col("availability_raw") != "", "widget|ring", "brand#1")
    return rows.select("listing_id", score.alias("confidence"))


D6 = f"""WITH {FEED} SELECT listing_id, round(CAST(least(0.99, CASE WHEN part % 2 = 0 THEN 0.45 ELSE 0 END + CASE WHEN regexp_matches(title || ' ' || brand, '(?i)widget|ring') THEN 0.4 ELSE 0 END
    + CASE WHEN regexp_matches(title || ' ' || brand, '(?i)brand#1') THEN 0.1 ELSE 0 END + CASE WHEN part % 4 <> 3 THEN 0.15 ELSE 0 END) AS DOUBLE), 2) AS confidence FROM feed"""


# --- reports


def r1_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = timeline.latest_offers(base.stable(spark, sf_dir)).agg(F.count("*").alias("offers"), F.count_if(F.col("stable").isin(*timeline.BUYABLE)).alias("purchasable"))
    health = timeline.source_health(base.runs(spark, sf_dir)).agg(F.count("*").alias("sources"), F.count_if("unhealthy").alias("unhealthy"))
    return offers.crossJoin(health)  # one row each


R1 = f"""WITH RECURSIVE {STABLE}, {OPS}, {HEALTH}, o AS (SELECT offer_id, source_id, arg_max(stable, (observed_at, seq)) AS s FROM st GROUP BY ALL)
    SELECT (SELECT count(*) FROM o) AS offers, (SELECT count(*) FROM o WHERE s IN ('in_stock', 'preorder')) AS purchasable, (SELECT count(*) FROM health) AS sources, (SELECT count(*) FROM health WHERE failures >= 3) AS unhealthy"""


def r2_product_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog_rows(spark, sf_dir).groupBy("part").agg(F.count("*").alias("offers"), F.min("model").alias("model"), F.min("price").alias("lowest"))
    return matching.newest(rows, 200, F.desc("offers"), F.col("part"))


def r4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = feed(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("offers"), F.count_if(F.col("barcode").isNotNull()).alias("with_barcode"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name")
    return names.join(counts, "source_id", "left").select("source_id", "s_name", F.coalesce("offers", F.lit(0)).alias("offers"), F.coalesce("with_barcode", F.lit(0)).alias("with_barcode"))


def r5_product_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name")
    return feed(spark, sf_dir).join(names, "source_id").select("part", "listing_id", "s_name", "price")


def o5_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's newest 300 observations."""
    newest = F.row_number().over(Window.partitionBy("offer_id").orderBy(F.desc("observed_at"), F.desc("seq")))
    return observations(spark, sf_dir).withColumn("nth", newest).where("nth <= 300").select("offer_id", "seq", "observed_at", "price", "availability")


# --- identity, posts


def i6_batch_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing of the feed in the order of its id; three parts share a SKU, a third of the listings has no barcode."""
    part = F.col("part")
    prefix = F.element_at(F.array(*map(F.lit, text.MODEL_PREFIXES)), ((part / 900).cast("int") % len(text.MODEL_PREFIXES)) + 1)
    keys = {"sku_key": text.sku(F.concat_ws("-", F.lit("P"), (part / 3).cast("long"))), "model": F.concat_ws("-", prefix, part % 900 + 100), "variant": text.variant_key(F.col("title"))}
    rows = feed(spark, sf_dir, **keys).select(
        "listing_id", F.col("listing_id").alias("seq"), text.barcode(F.col("barcode")).alias("barcode"), F.when(F.col("source_id") % 2 == 0, F.col("sku_key")).alias("sku"), "model", "brand", "variant",
    )
    return identity.resolve_batch(rows)


def i7_split_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).select(F.col("listing_id").alias("offer_id"), F.col("part").alias("product_id"), "source_id")
    splits = rows.where("product_id % 10 = 3 and (source_id % 2 = 0 or product_id % 20 = 3)").select("offer_id", (F.col("product_id") + 10_000_000).alias("new_product_id"))
    return identity.split_products(rows.drop("source_id"), splits)


I7 = f"""WITH {FEED}, c AS (SELECT listing_id AS offer_id, part, part % 10 = 3 AND (source_id % 2 = 0 OR part % 20 = 3) AS chosen FROM feed), p AS (SELECT *, chosen AND NOT bool_and(chosen) OVER (PARTITION BY part) AS moved FROM c)
    SELECT offer_id, CASE WHEN moved THEN part + 10000000 ELSE part END AS product_id, moved FROM p"""

HAY = r"trim(regexp_replace(replace(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), ' - ', '-'), '[^\p{L}\p{N}-]+', ' ', 'g'))"


def m8_post_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_matches(spark, sf_dir)


def post_matches(spark, sf_dir, asked=None):
    """Conversation turns (all, or those with a post_id in asked) against rules whose keyword is the first word of a benchmark item."""
    item = table(spark, sf_dir, "benchmark")
    word = F.nullif(F.element_at(F.split(text.alias_form(F.col("text")), " "), 1), F.lit(""))
    rules = item.select(F.col("item_id").alias("rule_id"), word.alias("keyword"), F.when(F.col("item_id") % 2 == 0, "exact").otherwise("contains").alias("mode"), F.lit(None).cast("string").alias("exclude"), F.lit(None).cast("string").alias("model"))
    posts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("post_id"), "text")
    posts = posts if asked is None else posts.join(F.broadcast(asked), "post_id", "left_semi")  # a report's posts, 500 at most
    return community.post_matches(posts, rules)


M8 = f"""WITH r AS (SELECT item_id, string_split({HAY}, ' ')[1] AS kw FROM benchmark), p AS (SELECT conv_id * 1000 + turn AS post_id, {HAY} AS hay, list_transform(regexp_split_to_array(coalesce(text, ''), '[\\s、，。,:：/]+'), lambda x: trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}-]+', ' ', 'g'))) AS words FROM conversations)
    SELECT DISTINCT item_id AS rule_id, post_id, 0.8::DOUBLE AS confidence FROM p, r WHERE kw <> '' AND CASE WHEN item_id % 2 = 0 THEN list_contains(words, kw) ELSE contains(hay, kw) END"""


def n2_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_unicode(F.col("text")), 256).alias("sha256"))


N2 = "SELECT doc_id, sha256(translate(nfc_normalize(text), '‐‑‒–—―−‘’“”', repeat('-', 7) || repeat(chr(39), 2) || repeat(chr(34), 2))) AS sha256 FROM documents"


def e1_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.discoveries(base.stable(spark, sf_dir).withColumn("product_id", F.col("offer_id") % 40))


E1 = """SELECT user_id % 40 AS product_id, arg_min(event_id, (ts, event_id)) AS seq, arg_min(user_id, (ts, event_id)) AS offer_id, min(ts) AS observed_at, 'product_discovered' AS type,
    arg_min(CASE event_type WHEN 'purchase' THEN 'in_stock' WHEN 'error' THEN 'out_of_stock' WHEN 'click' THEN 'preorder' WHEN 'signup' THEN 'coming_soon' ELSE 'unknown' END, (ts, event_id)) AS to_state FROM events GROUP BY 1"""


PAIRS = [
    (w5_match_table, W5), (w7_alerts, W7), (a1_stale_events, A1), (a3_outbox, A3),
    (a3_completed, f"SELECT dedup_key, count(*) FILTER (state IN ('queued', 'retry')) AS open, count(*) FILTER (state IN ('queued', 'retry')) = 0 AS done FROM ({A3}) GROUP BY dedup_key"),
    (k1_catalog_link, K1), (k3_aliases, K3), (k6_official_items, K6), (k6_review_items, f"WITH {FEED} SELECT listing_id AS seq, model, 0.55::DOUBLE AS confidence FROM feed WHERE part % 11 = 0"),
    (c10_term_queue, C10), (c3_exclusion_log, C3), (x1_candidate_decisions, X1), (i8_merge_products, I8), (q1_parser_outcome, Q1),
    (f9_run_accounts, "SELECT l_suppkey AS source_id, strftime(l_shipdate, '%Y-%m') AS scan_id, count(*) AS seen, count(*) FILTER (l_returnflag = 'R') AS excluded, CAST(sum(l_linenumber) AS BIGINT) AS events FROM lineitem GROUP BY ALL"),
    (f6_recrawl_plan, F6), (f7_due_sources, F7), (q4_current_errors, Q4), (q5_freshness_counts, Q5), (q8_diagnostics, Q8),
    (t1_keep_newest, f"WITH {OPS} SELECT * FROM ops ORDER BY seq DESC LIMIT 5000"),
    (t2_blank_old, "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN o_orderpriority END AS o_orderpriority FROM orders"),
    (s2_structured_data, S2), (s9_page_links, S9), (d1_robots, D1), (d4_frontier, D4), (d6_candidates, D6), (r1_health, R1),
    (r2_product_board, f"WITH {FEED} SELECT part, count(*) AS offers, min(model) AS model, min(price) AS lowest FROM feed GROUP BY part ORDER BY offers DESC, part LIMIT 200"),
    (r4_sources, f"WITH {FEED} SELECT s_suppkey AS source_id, s_name, count(listing_id) AS offers, count(barcode) AS with_barcode FROM supplier LEFT JOIN feed ON source_id = s_suppkey GROUP BY ALL"),
    (r5_product_offers, f"WITH {FEED} SELECT part, listing_id, s_name, price FROM feed JOIN supplier ON s_suppkey = source_id"),
    (i7_split_products, I7), (m8_post_matches, M8), (e1_discoveries, E1), (n2_unicode, N2),
    (i6_batch_resolution, None), (o5_timeline, f"WITH {STABLE.split(', numbered')[0]} SELECT offer_id, seq, observed_at, price, availability FROM obs QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY observed_at DESC, seq DESC) <= 300"),
]
QUERIES = {f.__name__: f for f, _ in PAIRS}
ORACLE_SQL = {f.__name__: sql for f, sql in PAIRS if sql}

BARE = r"""regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://[^\s<>"'']+', ' ', 'g'), '^\s*RT\s+@[^:\s]+:\s*', ''), '#[^\s#]+', ' ', 'g')"""
ORACLE_SQL["m2_first_posts"] = f"SELECT min(doc_id) AS post_id, count(*) - 1 AS duplicate_count FROM documents GROUP BY {HAY.replace("coalesce(text, '')", BARE)}"
