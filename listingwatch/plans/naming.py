"""Registered queries of products after resolution, reports with names, links and addresses as pages give them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import community, identity, matching, operations, pages, timeline, watch
from ..sources.tables import cut
from . import covering, reviewing, watching
from . import queries as base
from .oracle import EVENTS, FEED, HEALTH, OPS, SQL, STABLE
from .views import feed, observations, table
from .views import operations as ops_view

# --- products


def details(spark, sf_dir):
    """The feed with what a product keeps: every listing has a title or a code, some have a series, an image, a date."""
    n, source = F.col("listing_id"), F.col("source_id")
    keys = {"sku_key": text.sku(F.col("sku")), "model": text.model_code(F.col("model_text")), "variant": text.variant_key(F.col("title"))}
    return feed(spark, sf_dir, **keys).select(
        "listing_id", n.alias("seq"), "part", F.when(source % 7 != 0, F.col("title")).otherwise("").alias("title"), "model", text.barcode(F.col("barcode")).alias("barcode"), F.col("sku_key").alias("sku"),
        F.when(source % 2 == 0, F.col("brand")).alias("brand"), "variant", F.when(source % 4 == 0, F.concat(F.lit("series "), source)).when(source % 4 == 1, "").alias("series"),
        F.when(source % 5 == 0, F.concat(F.lit("https://img.example/"), n)).alias("image"), F.when(source % 3 == 0, F.lit("2024-05-01")).alias("release_date"),
    )


def i5_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the batch that i6 resolves, all of them made by their first listing."""
    return identity.product_rows(details(spark, sf_dir), watching.i6_batch_resolution(spark, sf_dir))


def i5_enriched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as known products, of which every other lacks its brand and series and some are missing; matches are i3's, but for
    parts that an earlier resolution made products of their own."""
    p = F.col("p_partkey")
    known = table(spark, sf_dir, "part").where(p % 17 != 5).select(
        p.alias("product_id"), F.col("p_name").alias("name"), F.when(p % 2 == 0, F.col("p_brand")).otherwise(F.when(p % 3 == 0, "")).alias("brand"), F.when(p % 2 == 0, F.concat(F.lit("known "), p)).alias("series"), F.when(p % 4 == 0, F.lit("https://img.example/known")).alias("image")
    )
    listings = details(spark, sf_dir)
    matched = base.i3_product_match(spark, sf_dir).join(listings.select("listing_id", "part"), "listing_id")
    resolved = matched.select("listing_id", F.when(F.col("part") % 13 == 0, F.col("part") + 10_000_000).otherwise(F.col("product_id")).alias("product_id"))
    return identity.product_rows(listings, resolved, known, ("brand", "series", "image", "release_date"))


def filled(column: str, known: str = "NULL") -> str:
    return f"coalesce({known}, arg_min(l.{column}, l.listing_id) FILTER (l.{column} IS NOT NULL)) AS {column}, CASE WHEN {known} IS NULL THEN min(l.listing_id) FILTER (l.{column} IS NOT NULL) END AS {column}_from"


I5 = f"""WITH m AS ({SQL["i3_product_match"]}), {FEED}, l AS (
        SELECT listing_id, CASE WHEN part % 13 = 0 THEN part + 10000000 ELSE product_id END AS product_id, CASE WHEN source_id % 7 <> 0 THEN title ELSE model END AS title, CASE WHEN source_id % 2 = 0 THEN brand END AS brand,
            CASE WHEN source_id % 4 = 0 THEN 'series ' || source_id END AS series, CASE WHEN source_id % 5 = 0 THEN 'https://img.example/' || listing_id END AS image, CASE WHEN source_id % 3 = 0 THEN '2024-05-01' END AS release_date FROM feed JOIN m USING (listing_id)),
    k AS (SELECT p_partkey AS product_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'known ' || p_partkey END AS series, CASE WHEN p_partkey % 4 = 0 THEN 'https://img.example/known' END AS image FROM part WHERE p_partkey % 17 <> 5)
    SELECT product_id, CASE WHEN bool_or(k.name IS NOT NULL) THEN any_value(k.name) ELSE arg_min(l.title, l.listing_id) END AS name, NOT bool_or(k.name IS NOT NULL) AS created,
        {filled("brand", "any_value(k.brand)")}, {filled("series", "any_value(k.series)")}, {filled("image", "any_value(k.image)")}, {filled("release_date")}
    FROM (SELECT * FROM l WHERE product_id IS NOT NULL) l FULL JOIN k USING (product_id) GROUP BY product_id"""


# --- watching


def w5_catalog_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches kept by catalog entry; every fourth product has none and is kept by itself."""
    p = F.col("product_id")
    found = base.w3_rule_matches(spark, sf_dir).select(
        "rule_id", F.when(p % 4 != 1, p % 900 + 100).alias("catalog_product_id"), "product_id", F.when(p % 6 != 0, p * 10).alias("offer_id"), "match_type", "confidence", F.concat_ws(" ", "reasons", "product_id").alias("reasons"), p.alias("seq")
    )
    found = cut(found, "matches")  # both batches read it
    none = spark.createDataFrame([], "rule_id long, identity_key string, product_id long, offer_id long, match_type string, confidence double, reasons string, first_matched timestamp_ntz, last_matched timestamp_ntz")
    known = watch.keyed_match_table(none, found.where("product_id % 3 <> 0"), watching.at("2024-01-01"))
    return watch.keyed_match_table(known, found.where("product_id % 5 <> 0"), watching.at("2024-01-02"))


W5 = f"""WITH f AS (SELECT *, CASE WHEN product_id % 4 <> 1 THEN 'catalog:' || (product_id % 900 + 100) ELSE 'product:' || product_id END AS identity_key, CASE WHEN product_id % 6 <> 0 THEN product_id * 10 END AS offer_id, reasons || ' ' || product_id AS why FROM ({SQL["w3_rule_matches"]})),
    b AS (SELECT *, 1 AS batch FROM f WHERE product_id % 3 <> 0 UNION ALL SELECT *, 2 FROM f WHERE product_id % 5 <> 0)
    SELECT rule_id, identity_key, arg_max(product_id, (batch, product_id)) AS product_id, arg_max(offer_id, (batch, product_id)) FILTER (offer_id IS NOT NULL) AS offer_id, arg_min(match_type, (batch, product_id)) AS match_type, max(confidence) AS confidence,
        arg_max(why, (batch, product_id)) AS reasons, CASE WHEN min(batch) = 1 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS first_matched, CASE WHEN max(batch) = 2 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS last_matched FROM b GROUP BY ALL"""


def codes(spark, sf_dir):
    """Catalog products of the parts' numbers; one in ten is unknown."""
    number = F.col("p_partkey") % 900 + 100
    return table(spark, sf_dir, "part").select(number.alias("catalog_product_id")).distinct().where("catalog_product_id % 10 <> 0").withColumn("product_code", F.concat(F.lit("CX-"), "catalog_product_id"))


def w12_named_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = base.watch_rules(spark, sf_dir).select("rule_id", "catalog_product_id", "catalog_part_id")
    wanted = rules.where("rule_id % 3 <> 0").select("rule_id", F.explode(F.array(*map(F.lit, reversed(reviewing.ALERTS)))).alias("alert_type"))
    parts = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("catalog_part_id")).distinct().withColumn("part_name", F.concat(F.lit("size "), "catalog_part_id"))
    found = watch.rules_named(rules, wanted, codes(spark, sf_dir), parts)
    return found.select("rule_id", "selected_product_code", "selected_part_name", F.array_join("alert_types", ",").alias("alert_types"))


W12 = """SELECT p_partkey AS rule_id, CASE WHEN p_partkey % 7 = 6 AND (p_partkey % 900 + 100) % 10 <> 0 THEN 'CX-' || (p_partkey % 900 + 100) END AS selected_product_code, CASE WHEN p_partkey % 7 = 5 THEN 'size ' || p_size END AS selected_part_name,
    CASE WHEN p_partkey % 3 <> 0 THEN 'in_stock,official_announcement,preorder_open,release' ELSE '' END AS alert_types FROM part"""


def w12_coded_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("rule_name"))
    found = watching.newest_alerts(spark, sf_dir, 500).withColumn("catalog_product_id", F.col("product_id") % 900 + 100)
    return watch.alerts_named(found, names, codes(spark, sf_dir), 500)


W12_ALERTS = f"""SELECT a.*, product_id % 900 + 100 AS catalog_product_id, p_name AS rule_name, CASE WHEN (product_id % 900 + 100) % 10 <> 0 THEN 'CX-' || (product_id % 900 + 100) END AS product_code
    FROM (SELECT * FROM ({watching.W7}) ORDER BY event_id DESC, dedup_key LIMIT 500) a JOIN part ON p_partkey = rule_id"""


# --- reports


def product_names(spark, sf_dir):
    """Every seventh product is unknown."""
    return table(spark, sf_dir, "part").where("p_partkey % 7 <> 3").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("product_model"))


def e6_named_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.events(base.stable(spark, sf_dir)).select("seq", F.col("offer_id").alias("product_id"), "source_id", "type", "to_state")
    sources = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 4").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    return matching.event_feed(found, product_names(spark, sf_dir).drop("product_model"), sources)


E6 = f"""WITH RECURSIVE {EVENTS}, e AS (SELECT seq, offer_id AS product_id, source_id, type, to_state FROM emitted ORDER BY seq DESC, type LIMIT 200)
    SELECT e.*, CASE WHEN product_id % 7 <> 3 THEN p_name END AS product_name, CASE WHEN source_id % 5 <> 4 THEN s_name END AS source_name FROM e LEFT JOIN part ON p_partkey = product_id LEFT JOIN supplier ON s_suppkey = source_id"""


def r3_named_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers by how often they were seen: every fifth number is archived, those of three are stale; a fifth of the sources is off."""
    n = F.col("observations")
    offers = timeline.latest_offers(base.stable(spark, sf_dir)).select(
        "offer_id", F.col("offer_id").alias("product_id"), "source_id", (n % 5 == 0).alias("archived"), F.when(n % 3 == 0, "stale").otherwise("fresh").alias("freshness"), F.col("stable").isin(*timeline.BUYABLE).alias("purchasable"), "price", "last_seen"
    )
    s = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(s.alias("source_id"), F.col("s_name").alias("source_name"), F.when(s % 2 == 0, "official").alias("source_class"), (s % 5 != 4).alias("enabled"))
    return matching.offer_board(offers, product_names(spark, sf_dir), sources)


R3 = f"""WITH RECURSIVE {STABLE}, o AS (
        SELECT offer_id, offer_id AS product_id, source_id, count(*) % 5 = 0 AS archived, CASE WHEN count(*) % 3 = 0 THEN 'stale' ELSE 'fresh' END AS freshness, arg_max(stable, (observed_at, seq)) IN ('in_stock', 'preorder') AS purchasable, arg_max(price, (observed_at, seq)) AS price, max(observed_at) AS last_seen
        FROM st WHERE source_id % 5 <> 4 GROUP BY ALL),
    t AS (SELECT * FROM o ORDER BY archived, freshness = 'fresh' DESC, purchasable DESC, last_seen DESC, offer_id LIMIT 200)
    SELECT t.*, s_name AS source_name, CASE WHEN source_id % 2 = 0 THEN 'official' END AS source_class, CASE WHEN product_id % 7 <> 3 THEN p_name END AS product_name, CASE WHEN product_id % 7 <> 3 THEN p_brand END AS product_model
    FROM t JOIN supplier ON s_suppkey = source_id LEFT JOIN part ON p_partkey = product_id"""


def r7_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = reviewing.i7_split_audit(spark, sf_dir).withColumn("audit_id", F.col("product_id") * 2)
    merges = reviewing.i8_merge_audit(spark, sf_dir).withColumn("audit_id", F.col("source") * 2 + 1)
    return identity.audits_listed(splits, merges, 100)


R7 = f"""SELECT * FROM (SELECT product_id * 2 AS audit_id, 'split' AS action, product_id AS source_product_id, new_product_id AS target_product_id FROM ({reviewing.I7}) UNION ALL SELECT source * 2 + 1, 'merge', source, target_id FROM ({reviewing.I8}))
    ORDER BY audit_id DESC, action, source_product_id LIMIT 100"""


def q8_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.table_counts(sources=table(spark, sf_dir, "supplier"), products=table(spark, sf_dir, "part"), offers=feed(spark, sf_dir), events=timeline.events(base.stable(spark, sf_dir)), observations=observations(spark, sf_dir))


Q8_COUNTS = f"""WITH RECURSIVE {EVENTS}, {FEED} SELECT 'sources' AS name, count(*) AS rows FROM supplier UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'offers', count(*) FROM feed
    UNION ALL SELECT 'events', count(*) FROM emitted UNION ALL SELECT 'observations', count(*) FROM events"""


def q8_source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources, of which the operations know some; every ninth has a key that gives something away."""
    s = F.col("s_suppkey")
    odd = F.concat(F.lit("token="), s)
    sources = table(spark, sf_dir, "supplier").select(F.when(s % 9 == 0, odd).otherwise(F.concat(F.lit("s"), s)).alias("source"), F.concat(F.lit("html password=x"), s).alias("connector"), F.when(s % 4 != 0, s % 4 != 1).alias("enabled"))
    return operations.source_states(sources, timeline.source_health(base.runs(spark, sf_dir)), text.redact)


Q8_STATES = f"""WITH {OPS}, {HEALTH} SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'source' ELSE 's' || s_suppkey END AS source_key, 'html password=[secret]' AS connector, s_suppkey % 4 IN (2, 3) AS enabled, coalesce(failures, 0) AS failures, last_success
    FROM supplier LEFT JOIN health ON s_suppkey % 9 <> 0 AND source = 's' || s_suppkey"""


# --- posts


def m3_post_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as posts that name their address twice, one of a shop for some, and two that don't count."""
    said = F.concat(F.lit("見て "), "url", F.lit("。 again: ("), "url", F.lit("), ftp://shop.example/1 http://me@shop.example/2 <"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://www.Store"), F.col("page_id") % 5, F.lit(".example/x/?utm_source=a!"))).otherwise(""), F.lit(">"))
    return community.link_rows(table(spark, sf_dir, "pages").select(F.col("page_id").alias("post_id"), said.alias("text")))


M3 = f"""WITH u AS (SELECT page_id AS post_id, canonical AS url FROM ({SQL["n6_page_urls"]}) UNION SELECT page_id, 'https://store' || (page_id % 5) || '.example/x' FROM pages WHERE page_id % 3 = 0)
    SELECT post_id, url, CASE WHEN regexp_matches(url, 'shop|store|mall') THEN 'store' ELSE 'external' END AS kind FROM u"""


def m10_post_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest posts among documents, which an earlier post may repeat; a source is muted."""
    n = F.col("doc_id")
    posts = table(spark, sf_dir, "documents").select(n.alias("post_id"), F.col("source").alias("source_id"), n.alias("external_id"), (n % 1009).alias("posted_at"), (n % 4 == 3).alias("hidden"), F.when(n % 5 != 0, n % 5 == 1).alias("muted"))
    return community.origins_listed(posts, covering.m2_post_origins(spark, sf_dir), 500)


M10 = f"""WITH p AS (SELECT doc_id AS post_id, source AS source_id, doc_id AS external_id FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 5 <> 1 ORDER BY doc_id % 1009 DESC, doc_id DESC LIMIT 500)
    SELECT * FROM p UNION ALL SELECT first_id, m.source_id, m.external_id FROM ({covering.M2}) m JOIN p ON p.post_id = first_id"""


# --- pages

HREFS = ("../b/./p/?z=1&a=x%20y&utm_source=q&a=b", "/a/%2E/b/../c/.", "//CDN.example.com/x?q=%E3%81%82+1&ok", "?Z=1&y=", "https://shop.example.com:443/p/#f", " plain text ", "#part", "")


def hrefs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return rows.select("page_id", "url", F.posexplode(F.array(*map(F.lit, HREFS))).alias("nth", "href"))


def n6_based_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_url = F.when(F.col("nth") != 5, F.col("url"))
    return hrefs(spark, sf_dir).select("page_id", F.col("nth").cast("long").alias("nth"), pages.normalized_at(F.col("href"), base_url).alias("url"))


N6 = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    b AS (SELECT *, string_split(path, '/') AS seg, scheme || '://' || host AS site, CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END AS own FROM p),
    f AS (SELECT *, array_to_string(seg[:greatest(len(seg) - 2, 1)], '/') AS up FROM b)
    SELECT page_id, nth, CASE nth WHEN 0 THEN site || up || '/b/p?a=x+y&a=b&z=1' WHEN 1 THEN site || '/a/c' WHEN 2 THEN scheme || '://cdn.example.com/x?ok=&q=%E3%81%82+1' WHEN 3 THEN site || own || '?Z=1&y=' WHEN 4 THEN 'https://shop.example.com/p'
        WHEN 5 THEN 'plain text' WHEN 6 THEN site || own ELSE '' END AS url FROM f, range(8) AS r(nth)"""


def s7_invalid_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of which some lack an address, or have one that is relative to their shop, and some say nothing."""
    n = F.col("listing_id")
    url = F.when(n % 5 == 1, "").when(n % 5 == 2, None).when(n % 5 == 3, "  ").otherwise(F.concat(F.lit("/p/"), n))
    usable = pages.is_usable(F.when(n % 3 == 0, F.col("title")), F.when(n % 3 == 1, ""))
    return feed(spark, sf_dir).select("listing_id", pages.invalid_reason(url, F.when(n % 2 == 0, F.lit("https://shop.example")), usable).alias("reason"))


S7 = f"""WITH {FEED} SELECT listing_id, CASE WHEN listing_id % 5 IN (1, 2) OR (listing_id % 5 = 3 AND listing_id % 2 = 1) THEN 'missing-url' WHEN listing_id % 3 <> 0 THEN 'no-product-fields' END AS reason FROM feed"""

LINK_RULES = "User-agent: *\nDisallow: /a\nAllow: /an\nDisallow: /*e$"


def s9_scored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    robots = found.select(pages.urls.bare_host(F.col("url")).alias("host")).distinct().withColumn("body", F.lit(LINK_RULES))
    return pages.scored_links(found, pages.robots_rules(robots, "watcher"), "th", r"\b[a-z]{2}-?\d{2,3}\b", include=("la",), exclude=("die",))


S9 = r"""WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#:]*)', 1) AS host, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>[^<]*', 1)) AS href,
        unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>([^<]*)', 1)) AS said FROM pages),
    t AS (SELECT *, CASE WHEN regexp_matches(href, '^https?://') THEN lower(regexp_extract(href, '://([^/?#:]*)', 1)) ELSE host END AS to_host, rtrim(CASE WHEN regexp_matches(href, '^https?://') THEN regexp_extract(href, '://[^/?#]*([^?#]*)', 1) ELSE regexp_extract(href, '^([^?#]*)', 1) END, '/') AS path FROM h WHERE regexp_matches(href, '^(https?://|/)')),
    s AS (SELECT page_id, 'https://' || to_host || CASE WHEN path = '' THEN '/' ELSE path END AS target, CASE WHEN path = '' THEN '/' ELSE path END AS p, lower(p || '  ' || trim(regexp_replace(said, '\s+', ' ', 'g'))) AS hay FROM t WHERE array_to_string(string_split(host, '.')[-2:], '.') = array_to_string(string_split(to_host, '.')[-2:], '.')),
    c AS (SELECT *, 45 * contains(hay, 'th')::INT + 45 * regexp_matches(hay, '\b[a-z]{2}-?[0-9]{2,3}\b')::INT + 20 * regexp_matches(hay, '/g/g|/product|/item|/goods|/p/')::INT + 10 * regexp_matches(hay, 'category|collection|search|catalog|c/c|page=|pageno=')::INT
        - 100 * regexp_matches(hay, 'login|signin|account|cart|checkout|privacy|terms|contact|javascript:|mailto:')::INT - 100 * contains(hay, 'die')::INT + 30 * contains(hay, 'la')::INT AS score FROM s)
    SELECT page_id, target, max(score)::INT AS score, least(100, max(score) + 35)::INT AS priority FROM c WHERE score >= 10 AND NOT (starts_with(p, '/a') AND NOT starts_with(p, '/an')) AND NOT (ends_with(p, 'e') AND NOT starts_with(p, '/an')) GROUP BY page_id, target"""


PAIRS = [
    (i5_products, None), (i5_enriched_products, I5), (w5_catalog_matches, W5), (w12_named_rules, W12), (w12_coded_alerts, W12_ALERTS), (e6_named_feed, E6), (r3_named_offers, R3), (r7_audits, R7), (q8_table_counts, Q8_COUNTS),
    (q8_source_states, Q8_STATES), (m3_post_links, M3), (m10_post_origins, M10), (n6_based_urls, N6), (s7_invalid_listings, S7), (s9_scored_links, S9),
]
QUERIES = {f.__name__: f for f, _ in PAIRS}
ORACLE_SQL = {f.__name__: sql for f, sql in PAIRS if sql}
