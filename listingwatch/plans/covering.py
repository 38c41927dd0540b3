"""Registered queries of readers, scalars and smaller steps, each beside its SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import catalog, classify, community, frontier, identity, matching, operations, pages, timeline, watch
from ..sources import tables
from ..sources.tables import cut
from . import queries as base
from . import watching
from .oracle import COOLED, EVENTS, FEED, METRICS, OPS, SQL, STABLE, STATE
from .views import feed, observations, table
from .views import operations as ops_view


def one(values: tuple, n):
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return tables.new_folder(spark, name)


# --- readers


def s1_listing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed written as lines of JSON and read as listings: prices as text, what is absent null."""
    path = fresh_path(spark, "frames")
    rows = feed(spark, sf_dir).select(F.col("source_id").cast("string").alias("source_id"), F.lit(7).alias("scan_id"), F.col("part").alias("seq"), "title", "brand", "barcode", "sku", "price", "availability_raw", "availability_text", "has_buy_button")
    rows.write.json(path)
    return tables.listing_frames(spark, path).select("source_id", "scan_id", F.col("seq").cast("long").alias("seq"), "title", "brand", "model", "barcode", F.col("price").cast("double").alias("price"), "availability_text", "has_buy_button")


S1 = f"WITH {FEED} SELECT CAST(source_id AS VARCHAR) AS source_id, 7::BIGINT AS scan_id, part AS seq, title, brand, CAST(NULL AS VARCHAR) AS model, barcode, price, stated AS availability_text, button AS has_buy_button FROM feed"


def s11_official_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each brand with its parts as items, read back in the order of the list."""
    path = fresh_path(spark, "official")
    part = table(spark, sf_dir, "part")
    item = F.struct(F.col("p_partkey").cast("string").alias("externalId"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.concat(F.lit("CX-"), F.col("p_partkey") % 900 + 100).alias("productCode"), F.col("p_retailprice").alias("msrp"))
    documents = part.groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most 1,000 items
    documents.select(F.col("p_brand").alias("source"), "items").write.json(path)
    return tables.official_feed(spark, path, lines=True).select("source", F.col("seq").cast("long").alias("seq"), "externalId", "title", "productCode", "msrp", "image")


S11 = """SELECT p_brand AS source, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS seq, CAST(p_partkey AS VARCHAR) AS externalId, p_name || ' ' || p_type AS title,
    'CX-' || (p_partkey % 900 + 100) AS productCode, p_retailprice AS msrp, CAST(NULL AS VARCHAR) AS image FROM part"""


def s12_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as posts and read back; every fifth has another site's address, every seventh no id."""
    path = fresh_path(spark, "posts")
    n = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.when(n % 7 > 0, n.cast("string")).otherwise("").alias("id"), "text", F.concat(F.when(n % 5 > 0, "https://x.com/").otherwise("https://y.com/"), n.cast("string")).alias("url"), F.col("role").alias("author"))
    rows.write.json(path)
    accepted, rejected = tables.posts(spark, path)
    return accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False))).select("id", "url", "author", "accepted")


S12 = """WITH n AS (SELECT conv_id * 1000 + turn AS n, role FROM conversations) SELECT CASE WHEN n % 7 > 0 THEN CAST(n AS VARCHAR) ELSE '' END AS id, CASE WHEN n % 5 > 0 THEN 'https://x.com/' ELSE 'https://y.com/' END || n AS url, role AS author,
    n % 7 > 0 AND n % 5 > 0 AS accepted FROM n"""


def s13_observation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations appended in two batches, counted by the day that partitions them."""
    path = fresh_path(spark, "observations")
    obs = observations(spark, sf_dir)
    tables.append_observations(obs.where("seq % 3 = 0"), path)
    tables.append_observations(obs.where("seq % 3 <> 0"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("observations"), F.min("price").alias("lowest"))


S13 = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS observations, min(value) AS lowest FROM events GROUP BY 1"


def s15_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    settings = lambda v: F.create_map(F.lit("interval"), F.lit(v), F.lit("api_key"), F.lit("x"))
    supplier = table(spark, sf_dir, "supplier")
    known = supplier.where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("source_key"), (key % 2 == 0).alias("managed"), (key % 3 > 0).alias("enabled"), F.create_map(F.lit("interval"), F.lit("old")).alias("settings"))
    defined = supplier.where("s_suppkey % 4 <> 1").select(F.col("s_name").alias("source_key"), settings("new").alias("settings"))
    return tables.sync_registry(known, defined).select("source_key", "managed", "enabled", F.col("settings")["interval"].alias("interval"), F.size("settings").cast("long").alias("settings"))


S15 = """SELECT s_name AS source_key, s_suppkey % 4 <> 1 OR s_suppkey % 2 = 0 AS managed, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey % 5 = 0 OR s_suppkey % 3 > 0 ELSE s_suppkey % 3 > 0 AND s_suppkey % 2 <> 0 END AS enabled,
    CASE WHEN s_suppkey % 4 <> 1 THEN 'new' ELSE 'old' END AS interval, 1::BIGINT AS settings FROM supplier WHERE s_suppkey % 4 <> 1 OR s_suppkey % 5 <> 0"""


# --- pages


def s6_page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every fourth says that it is under maintenance and every third gave a listing."""
    n = F.col("page_id")
    html = F.concat(F.when(n % 4 == 0, "<h1>Site  maintenance</h1>").otherwise("<h1>Shop</h1>"), "html")
    return table(spark, sf_dir, "pages").select("page_id", pages.outcome(html, n % 3 == 0).alias("outcome"))


MAINTENANCE = pages.MAINTENANCE.replace("'", "''")
S6 = f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '<h1>Site  maintenance</h1>' ELSE '<h1>Shop</h1>' END || html AS h FROM pages),
    v AS (SELECT *, regexp_replace(regexp_replace(h, '<script\\b.*?</script>', ' ', 'gis'), '<style\\b.*?</style>', ' ', 'gis') AS bare FROM p),
    t AS (SELECT *, trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) || ' ' || regexp_extract(h, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1) || ' ' || substr(trim(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 2000) AS head FROM v)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ok' WHEN regexp_matches(head, '{MAINTENANCE}') THEN 'maintenance' ELSE 'empty' END AS outcome FROM t"""


def s7_usable_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("listing_id")
    title, price = F.when(n % 3 == 0, F.col("title")).when(n % 3 == 1, ""), F.when(n % 2 == 0, F.when(n % 4 == 0, "").otherwise("5"))
    return feed(spark, sf_dir).select("listing_id", pages.is_usable(title, F.lit(None).cast("string"), price=price).alias("usable"))


def s8_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of up to 50 of the pages' addresses each, every tenth address naming a further sitemap."""
    n = F.col("page_id")
    loc = F.concat(F.lit("<loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"))
    entry = F.when(n % 10 == 0, F.concat(F.lit("<sitemap>"), loc, F.lit("</sitemap>"))).otherwise(F.concat(F.lit("<url>"), loc, F.lit("</url>")))
    rows = table(spark, sf_dir, "pages").where("url is not null").select(F.floor(n / 50).alias("sitemap_id"), entry.alias("entry"))
    body = F.array_join(F.collect_list("entry"), "")  # 50 entries
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>"))
    return pages.sitemap_urls(rows.groupBy("sitemap_id").agg(xml.alias("xml")))


S8 = "SELECT page_id // 50 AS sitemap_id, CASE WHEN page_id % 10 = 0 THEN 'sitemap' ELSE 'url' END AS kind, url AS loc FROM pages WHERE url IS NOT NULL"


def s10_search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.concat(F.lit('<form method="'), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("get"), F.lit('" action="/find?x=1"><input type=text name="keyword"></form><form><input name="email"></form>'))
    return pages.search_urls(table(spark, sf_dir, "pages").withColumn("html", F.concat("html", form)), "red widget")


S10 = r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || '/find?keyword=red+widget' AS target FROM pages WHERE page_id % 3 <> 0"


# --- scalars


def n8_fetchable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, url = F.col("page_id"), F.col("url")
    given = F.when(n % 7 == 0, F.regexp_replace(url, "^https?", "ftp")).when(n % 7 == 1, F.regexp_replace(url, "://", "://user:pw@")).when(n % 7 == 2, F.regexp_replace(url, "^https?://", "")).otherwise(F.concat(url, F.when(url.contains("?"), "&").when(url.contains("#"), "").otherwise("?"), F.when(~url.contains("#"), "wovn=ja").otherwise("")))
    return table(spark, sf_dir, "pages").select("page_id", urls.fetchable(given).alias("fetchable"), urls.refused(given).alias("refused"))


N8 = r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path, CASE WHEN contains(url, '#') THEN '' ELSE '&wovn=ja' END AS more,
        list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref', 'ref_', 'spm', '_ga')) AS params FROM pages),
    q AS (SELECT *, array_to_string(list_sort(params || CASE WHEN more = '' THEN [] ELSE ['wovn=ja'] END), '&') AS query FROM u)
    SELECT page_id, CASE WHEN page_id % 7 > 2 THEN 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS fetchable,
        CASE page_id % 7 WHEN 0 THEN 'unsupported_protocol' WHEN 1 THEN 'credentials_not_allowed' WHEN 2 THEN 'invalid_url' END AS refused FROM q"""


def n16_listing_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("part")
    stated = F.when(part % 3 == 0, F.lower(F.regexp_extract("model_text", r"^CX-\d+", 0))).when(part % 3 == 1, " Special one ").when(part % 2 == 0, "")
    code = F.when(part % 5 == 0, F.concat(F.lit("bx "), part % 90 + 10)).otherwise(F.col("sku"))
    return feed(spark, sf_dir).select("listing_id", text.listing_model(stated, code, F.col("model_text")).alias("model"))


N16 = f"WITH {FEED} SELECT listing_id, CASE part % 3 WHEN 0 THEN model WHEN 1 THEN 'SPECIAL ONE' ELSE CASE WHEN part % 5 = 0 THEN 'BX-' || (part % 90 + 10) ELSE model END END AS model FROM feed"


def n20_tax_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = one(("1,000円（税込）", "Tax Excluded", "Inc. VAT", "x", "ＴＡＸ　ＩＮＣＬＵＤＥＤ", "未稅", "Inc VAT, tax excluded"), F.col("l_linenumber") % 7)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.tax_included(said).alias("included"))


N20 = f"""WITH s AS (SELECT l_orderkey, l_linenumber, translate(['1,000円（税込）', 'Tax Excluded', 'Inc. VAT', 'x', 'ＴＡＸ　ＩＮＣＬＵＤＥＤ', '未稅', 'Inc VAT, tax excluded'][1 + l_linenumber % 7], 'ＡＣＤＥＩＬＮＴＵＸ　（）', 'ACDEILNTUX ()') AS said FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(said, '{text.TAX_IN}') THEN true WHEN regexp_matches(said, '{text.TAX_OUT}') THEN false END AS included FROM s"""


def n21_release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(n % 5 == 0, F.date_format(day, "yyyy年M月d日")).when(n % 5 == 1, F.date_format(day, " yyyy/M/d ")).when(n % 5 == 2, F.translate(F.date_format(day, "yyyy.MM.dd"), "0123456789.", "０１２３４５６７８９．")).when(n % 5 == 3, F.date_format(day, "yyyy-02-30"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(text.release_date(written), "yyyy-MM-dd").alias("day"))


N21 = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"


def n23_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" ,"), "p_name", F.lit(","), "p_type", F.lit(",　"), "p_name", F.lit("  x ,"), "p_type", F.lit(",,"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.terms(said, 3), "|").alias("terms"))


# --- listings


def c7_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each listing's state rests on, and whether it can be bought if preorders count."""
    none = F.lit(None).cast("string")
    found = classify.availability(F.col("availability_raw"), F.col("availability_text"), F.col("title"), none, F.col("has_buy_button"), F.when(F.col("part") % 3 > 0, F.col("price")))
    rows = feed(spark, sf_dir, of_stated={"a": found})
    return rows.select("listing_id", F.array_join("a.signals", ",").alias("signals"), "a.term", classify.is_purchasable(F.col("a.state"), True).alias("purchasable"))


C7 = f"""WITH {FEED}, {STATE} SELECT listing_id, concat_ws(',', CASE WHEN schema_state IS NOT NULL THEN 'schema' END, CASE WHEN text_state IS NULL THEN NULL WHEN schema_state IS NULL THEN 'text' WHEN schema_state = text_state THEN 'text-agree' ELSE 'text-conflict' END,
    CASE WHEN button THEN 'buy-button' END, CASE WHEN part % 3 > 0 THEN 'price' END) AS signals, [ 'in stock', 'sold out', '予約受付中', 'coming soon', NULL][1 + source_id % 5] AS term, state IN ('in_stock', 'preorder') AS purchasable FROM judged"""


def d2_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), one(("", "/item/7", "?page=2", "/cart", "/bx-38"), F.col("page_id") % 5))
    args = (url, F.lit(""), "shop|store", r"\b[a-z]{2}-?\d{2,3}\b", ("item",), ("cart",))
    return table(spark, sf_dir, "pages").select("page_id", urls.hint_score(*args).cast("long").alias("score"), F.array_join(urls.hint_reasons(*args), ",").alias("reasons"))


D2 = r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) || ['', '/item/7', ' ?page=2', '/cart', '/bx-38'][1 + page_id % 5] AS hay FROM pages), h AS (
        SELECT page_id, regexp_matches(hay, 'shop|store') AS b, regexp_matches(hay, '\b[a-z]{2}-?[0-9]{2,3}\b') AS m, regexp_matches(hay, '/g/g|/product|/item|/goods|/p/') AS pp,
               regexp_matches(hay, 'category|collection|search|catalog|c/c|page=|pageno=') AS lp, regexp_matches(hay, 'login|signin|account|cart|checkout|privacy|terms|contact|javascript:|mailto:') AS off, contains(hay, 'cart') AS ex, contains(hay, 'item') AS inc FROM p)
    SELECT page_id, 45 * b::BIGINT + 45 * m::BIGINT + 20 * pp::BIGINT + 10 * lp::BIGINT - 100 * off::BIGINT - 100 * ex::BIGINT + 30 * inc::BIGINT AS score,
        concat_ws(',', CASE WHEN b THEN 'brand' END, CASE WHEN m THEN 'model' END, CASE WHEN pp THEN 'product_path' END, CASE WHEN lp THEN 'listing_path' END, CASE WHEN ex THEN 'excluded' END, CASE WHEN inc THEN 'included' END) AS reasons FROM h"""


def d6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).withColumn("model", F.when(F.col("part") % 2 == 0, text.model_code(F.col("model_text"))))
    said = F.when(F.col("source_id") % 3 == 0, "Used, spare parts")
    found = classify.candidate_reasons(F.col("title"), F.col("model"), F.concat_ws(" ", "title", "brand"), F.col("availability_raw") != "", "widget|ring", "brand#1", said)
    return rows.select("listing_id", F.array_join(found, ",").alias("reasons"))


D6 = f"""WITH {FEED} SELECT listing_id, concat_ws(',', CASE WHEN part % 2 = 0 THEN 'model' END, CASE WHEN regexp_matches(title || ' ' || brand, '(?i)widget|ring') THEN 'words' END, CASE WHEN regexp_matches(brand, '(?i)brand#1') THEN 'maker' END,
    CASE WHEN part % 4 <> 3 THEN 'structured' END, CASE WHEN source_id % 3 = 0 THEN 'excluded:used' END) AS reasons FROM feed"""


def c9_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = one(("Discontinued item", "販売終了しました", "in stock", "已停售", "廃番"), F.col("part") % 5)
    return feed(spark, sf_dir).select("listing_id", classify.is_terminal(F.col("title"), said).alias("terminal"))


def e2_first_sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty products with many offers each: what created a product is its discovery, other offers have a first sight."""
    rows = base.stable(spark, sf_dir).withColumn("product_id", F.col("offer_id") % 40)
    columns = ["seq", "offer_id", "type", "to_state"]
    return timeline.events(rows).where("from_state is null").select(columns).unionByName(timeline.discoveries(rows).select(columns))


E2 = f"""WITH RECURSIVE {STABLE}, c AS (SELECT arg_min(seq, (observed_at, seq)) AS seq FROM st GROUP BY offer_id % 40)
    SELECT seq, offer_id, CASE WHEN seq IN (SELECT seq FROM c) THEN 'product_discovered' ELSE CASE stable WHEN 'in_stock' THEN 'became_available' WHEN 'preorder' THEN 'preorder_open' ELSE 'coming_soon' END END AS type, stable AS to_state
    FROM st WHERE nth = 1 AND (seq IN (SELECT seq FROM c) OR stable IN ('in_stock', 'preorder', 'coming_soon'))"""


def f3_failed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other offer is a source of its own, the others share their supplier's."""
    own = F.when(F.col("offer_id") % 2 == 0, F.col("offer_id") * 100_000 + F.col("source_id")).otherwise(F.col("source_id"))
    offers = cut(base.f1_scan_presence(spark, sf_dir).select(own.alias("source_id"), "offer_id", "misses", "freshness"), "presence")  # read three times
    failures = offers.select("source_id").distinct().withColumn("error_class", one(("not_found", "http_404", "timeout", "http_410"), F.col("source_id") % 4)).where("source_id % 5 <> 0")
    return timeline.failed_scan(offers, failures)


F3 = f"""WITH o AS (SELECT CASE WHEN offer_id % 2 = 0 THEN offer_id * 100000 + source_id ELSE source_id END AS source_id, offer_id, misses, freshness FROM ({SQL["f1_scan_presence"]})),
    n AS (SELECT *, count(*) OVER (PARTITION BY source_id) = 1 AND source_id % 4 <> 2 AND source_id % 5 <> 0 AS gone FROM o)
    SELECT source_id, offer_id, misses + CAST(gone AS INT) AS misses, CASE WHEN gone AND misses >= 2 THEN 'archived' WHEN gone THEN 'stale' ELSE freshness END AS freshness, CASE WHEN gone AND misses >= 2 THEN 'http_not_found' END AS archive_reason FROM n"""


def i1_known_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rescan of the feed: two thirds of its listings are offers already, those of every tenth part split off by hand."""
    found = cut(base.keyed_listings(spark, sf_dir).withColumn("url", F.concat(F.lit("https://shop.example/"), "listing_id")), "listings")
    offers = found.where("listing_id % 3 <> 0").select("source_id", "url", F.when(F.col("part") % 10 == 0, F.col("part") + 10_000_000).otherwise(F.col("part")).alias("product_id"))
    return matching.resolve_known(found, offers, base.first_products(found))


I1 = f"""WITH m AS ({SQL["i3_product_match"]}) SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN product_id WHEN listing_id // 100000 % 10 = 0 THEN listing_id // 100000 + 10000000 ELSE listing_id // 100000 END AS product_id,
    CASE WHEN listing_id % 3 = 0 THEN matched_by ELSE 'offer' END AS matched_by FROM m"""


# --- watching


def w9_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owners of all rules hear if their rules are new."""
    none = F.lit(None).cast("string")
    found = classify.availability(F.col("availability_raw"), F.col("availability_text"), none, none, F.col("has_buy_button"), F.col("price"))
    offers = feed(spark, sf_dir).select(F.col("listing_id").alias("offer_id"), F.col("part").alias("product_id"), found["state"].alias("state"), one(("fresh", "fresh", "stale", "archived"), F.col("source_id") % 4).alias("freshness"), F.col("listing_id").alias("last_seen"))
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"))
    return watch.backfill_new(new, base.watched_context(spark, sf_dir), base.watch_rules(spark, sf_dir), offers)


W9 = f"""WITH {FEED}, {STATE}, o AS (SELECT part AS product_id, max(listing_id) AS offer_id, arg_max(state, listing_id) AS state, arg_max(source_id % 4, listing_id) AS f FROM judged WHERE source_id % 4 <> 3 GROUP BY part)
    SELECT rule_id, product_id, offer_id, state FROM ({SQL["w3_rule_matches"]}) JOIN o USING (product_id) WHERE f < 2 AND state IN ('in_stock', 'preorder')"""


def w10_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), (F.col("p_size") % 10 / 10).alias("confidence"))
    found = watch.match_rules(base.watched_context(spark, sf_dir), base.watch_rules(spark, sf_dir), first_only=True)  # the first rule is all that boost asks for
    return watch.boost(candidates, found.select("rule_id", F.col("product_id").alias("candidate_id")))


W10 = f"""WITH m AS (SELECT product_id, min(rule_id) AS rule_id FROM ({SQL["w3_rule_matches"]}) GROUP BY product_id)
    SELECT p_partkey AS candidate_id, round(least(0.99, p_size % 10 / 10 + CASE WHEN rule_id IS NOT NULL THEN 0.2 ELSE 0.0 END)::DOUBLE, 2) AS confidence, rule_id FROM part LEFT JOIN m ON product_id = p_partkey"""


def a4_alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = watching.w7_alerts(spark, sf_dir)
    channels = spark.createDataFrame([("chat", True), ("mail", False)], "channel string, configured boolean")
    tried = alerts.where("rule_id % 3 <> 0").select(F.lit("chat").alias("channel"), "dedup_key", F.when(F.col("rule_id") % 3 == 1, "sent").otherwise("failed").alias("status"))
    return watch.outbox(alerts.select("dedup_key"), channels, tried)


A4 = f"SELECT dedup_key, channel, CASE WHEN channel = 'mail' THEN 'unconfigured' ELSE ['queued', 'skipped', 'retry'][1 + rule_id % 3] END AS state FROM ({watching.W7}), (VALUES ('chat'), ('mail')) AS t(channel)"


def a2_event_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending events of forty products with offers of ten shops, some unpriced, some without an address."""
    found = base.e5_cooldown(spark, sf_dir).withColumn("product_id", F.col("offer_id") % 40)
    offers = timeline.latest_offers(base.stable(spark, sf_dir)).select("offer_id", F.when(F.col("offer_id") % 7 > 0, F.col("price")).alias("price"), F.when(F.col("offer_id") % 3 > 0, "JPY").alias("currency"), F.when(F.col("offer_id") % 2 == 0, F.concat(F.lit("https://shop.example/"), "offer_id")).alias("url"))
    products = spark.range(40).select(F.col("id").alias("product_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("Item "), "id")).alias("name"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("BX-"), F.col("id") + 10)).alias("model"))
    sources = spark.range(9).select(F.col("id").alias("source_id"), F.concat(F.lit("shop"), "id").alias("source_name"))
    return matching.event_digests(found, offers, products, sources)


A2 = f"""WITH RECURSIVE {COOLED}, last AS (SELECT offer_id, arg_max(price, (observed_at, seq)) AS last_price FROM obs GROUP BY offer_id),
    r AS (SELECT offer_id % 40 AS product_id, CASE WHEN offer_id % 7 > 0 THEN last_price END AS p, CASE WHEN source_id < 9 THEN 'shop' || source_id ELSE 'unknown store' END AS shop, coalesce(list_position(['in_stock', 'preorder', 'coming_soon'], to_state), 4) AS rank,
        CASE type WHEN 'became_available' THEN '✅ Available' WHEN 'back_in_stock' THEN '🔁 Back in stock' WHEN 'preorder_open' THEN '📦 Pre-order open' WHEN 'coming_soon' THEN '🔜 Coming soon' WHEN 'out_of_stock' THEN '⛔ Out of stock' ELSE '💲 Price change' END AS label, offer_id
        FROM ordered o JOIN cool c USING (offer_id, type, k) JOIN last USING (offer_id) WHERE c.kept),
    l AS (SELECT *, label || ' @ ' || shop || CASE WHEN p IS NULL THEN '' ELSE ' — ' || printf('%.2f', p) || CASE WHEN offer_id % 3 > 0 THEN ' JPY' ELSE '' END END || CASE WHEN offer_id % 2 = 0 THEN chr(10) || '    https://shop.example/' || offer_id ELSE '' END AS line FROM r)
    SELECT product_id, CASE WHEN product_id % 5 > 0 THEN 'Item ' || product_id ELSE 'Product' END || CASE WHEN product_id % 2 = 0 THEN ' (BX-' || (product_id + 10) || ')' ELSE '' END AS title,
        string_agg(line, chr(10) ORDER BY rank, p IS NULL, p, CASE WHEN shop = 'unknown store' THEN '' ELSE shop END, line COLLATE "binary") AS body FROM l GROUP BY product_id"""


# --- catalog and review


def k1_series_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries of the feed with the first series and release date that a listing states."""
    part = F.col("part")
    rows = watching.catalog_rows(spark, sf_dir).withColumns({"series": F.when(F.col("seq") % 3 == 1, F.concat(F.lit("S"), part % 7)), "release_date": F.when(F.col("source_id") % 2 == 1, F.concat(F.lit("2024-01-"), F.lpad((part % 28 + 1).cast("string"), 2, "0")))})
    return catalog.link_listings(rows).select("model", "series", "release_date", "listings")


K1 = f"""WITH {FEED} SELECT model, arg_min('S' || (part % 7), listing_id) FILTER (listing_id % 3 = 1) AS series, arg_min('2024-01-' || lpad(CAST(part % 28 + 1 AS VARCHAR), 2, '0'), listing_id) FILTER (source_id % 2 = 1) AS release_date, count(*) AS listings
    FROM feed GROUP BY model"""


def k4_catalog_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = watching.catalog_rows(spark, sf_dir)
    known = rows.withColumns({"url": F.concat(F.lit("https://shop.example/"), F.col("source_id") % 7), "source_class": F.lit("retailer"), "verification": F.lit("pending")})
    return catalog.catalog_listing(catalog.link_listings(rows).select("model", "listings"), catalog.aliases(rows), catalog.evidence(known))


K4 = f"""WITH {FEED}, n AS (SELECT model, trim(regexp_replace(lower(title), '[^a-z0-9-]+', ' ', 'g')) AS key, arg_max(title, listing_id) AS alias FROM feed GROUP BY ALL)
    SELECT f.model, f.listings, f.evidence, n.aliases, n.alias_list FROM (SELECT model, count(*) AS listings, count(DISTINCT source_id % 7) AS evidence FROM feed GROUP BY model) f
    JOIN (SELECT model, count(*) AS aliases, string_agg(DISTINCT 'en:' || alias, ' | ' ORDER BY 'en:' || alias) AS alias_list FROM n GROUP BY model) n USING (model)"""


def k6_official_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    rows = watching.official(spark, sf_dir).withColumns({"brand": F.when(n % 4 > 0, F.col("brand")), "series": F.when(n % 3 == 0, F.concat(F.lit("S"), n % 11)), "release_date": F.when(n % 5 == 0, "2024-05-01"), "image": F.when(n % 2 == 0, F.concat(F.lit("i"), n % 13)), "currency": F.when(n % 6 == 0, "USD").when(n % 6 == 1, "JPY")})
    return catalog.official_items(rows, "the maker").select("model", "brand", "series", "release_date", "image", "currency", "verification")


K6 = f"""WITH {FEED} SELECT model, coalesce(arg_max_null(CASE WHEN listing_id % 4 > 0 THEN brand END, listing_id), 'the maker') AS brand, arg_max('S' || (listing_id % 11), listing_id) FILTER (listing_id % 3 = 0) AS series,
    max('2024-05-01') FILTER (listing_id % 5 = 0) AS release_date, arg_max('i' || (listing_id % 13), listing_id) FILTER (listing_id % 2 = 0) AS image, arg_max(CASE WHEN listing_id % 6 = 0 THEN 'USD' ELSE 'JPY' END, listing_id) FILTER (listing_id % 6 < 2) AS currency,
    CASE WHEN count(DISTINCT barcode) > 1 THEN 'conflict' ELSE 'verified' END AS verification FROM feed WHERE part % 11 <> 0 GROUP BY model"""


def i7_moved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of forty products after every third offer of the even ones was split off."""
    found = base.e4_events(spark, sf_dir).withColumn("product_id", F.col("offer_id") % 40).select("seq", "type", "offer_id", "product_id")
    offers = timeline.latest_offers(base.stable(spark, sf_dir)).select("offer_id", (F.col("offer_id") % 40).alias("product_id"))
    splits = offers.where("product_id % 2 = 0 and offer_id % 3 = 0").select("offer_id", (F.col("product_id") + 1000).alias("new_product_id"))
    return identity.facts_after_split(found, identity.split_products(offers, splits))


I7 = f"""WITH RECURSIVE {EVENTS}, o AS (SELECT DISTINCT offer_id, offer_id % 40 AS p, offer_id % 2 = 0 AND offer_id % 3 = 0 AS chosen FROM obs), m AS (SELECT *, chosen AND NOT bool_and(chosen) OVER (PARTITION BY p) AS moved FROM o)
    SELECT seq, type, e.offer_id, CASE WHEN moved THEN p + 1000 ELSE p END AS product_id FROM emitted e JOIN m USING (offer_id)"""


def i8_merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of the feed after merges of their products, with each target's catalog link."""
    part = table(spark, sf_dir, "part")
    merges = part.where("p_size % 3 = 0 and p_partkey > 0").select(F.col("p_partkey").alias("source"), F.expr("p_partkey & (p_partkey - 1)").alias("target"))
    targets = frontier.merge_targets(merges)
    links = part.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("CX-"), F.col("p_partkey") % 900 + 100).alias("model"))
    offers = feed(spark, sf_dir).select("listing_id", F.col("part").alias("product_id"))
    return identity.facts_after_merge(offers, targets).join(identity.links_after_merge(links, targets), "product_id", "left")


I8 = f"""WITH RECURSIVE {FEED}, m AS (SELECT p_partkey AS s, p_partkey & (p_partkey - 1) AS t FROM part WHERE p_size % 3 = 0 AND p_partkey > 0),
    chain AS (SELECT p_partkey AS id, p_partkey AS now FROM part UNION ALL SELECT id, t FROM chain JOIN m ON s = now), kept AS (SELECT id, min(now) AS product_id FROM chain GROUP BY id),
    link AS (SELECT product_id, arg_min('CX-' || (id % 900 + 100), (id <> product_id, id)) AS model FROM kept WHERE id % 5 > 0 GROUP BY product_id)
    SELECT listing_id, k.product_id, link.model FROM feed JOIN kept k ON id = part LEFT JOIN link USING (product_id)"""


def x1_approved_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a reviewer let in, resolved against the products of the other parts like any listing."""
    rows = cut(base.keyed_listings(spark, sf_dir).drop("source_id"), "listings")
    n = F.col("listing_id")
    decisions = rows.select("listing_id", F.when(n % 3 == 0, "exclude").otherwise("approve").alias("decision"), F.lit(1).alias("seq")).unionByName(rows.where("listing_id % 4 = 0").select("listing_id", F.lit("reopen").alias("decision"), F.lit(2).alias("seq")))
    return matching.match_products(catalog.approved(rows, decisions, "listing_id"), base.first_products(rows))


X1 = f"SELECT * FROM ({SQL['i3_product_match']}) WHERE listing_id % 3 <> 0 AND listing_id % 4 <> 0"


def k9_source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "pages").select("page_id", urls.registrable_domain(urls.bare_host(F.col("url"))).alias("site"))
    registry = sites.select("site").distinct().where(F.length("site") % 2 == 0).withColumn("source_class", F.when(F.length("site") % 4 == 0, "official_store").otherwise("maker"))
    return catalog.source_classes(sites, registry)


K9 = r"""WITH s AS (SELECT page_id, array_to_string(string_split(regexp_extract(url, '://([^/?#:]*)', 1), '.')[-2:], '.') AS site FROM pages)
    SELECT *, CASE length(site) % 4 WHEN 0 THEN 'official_store' WHEN 2 THEN 'maker' ELSE 'retailer' END AS source_class FROM s"""


def k10_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    products = table(spark, sf_dir, "part").select(key.alias("product_id"), F.when(key % 5 > 0, F.concat(F.lit("CX-"), key % 900 + 100)).alias("model"))
    links = products.where("product_id % 3 = 0").select("product_id")
    offers = feed(spark, sf_dir).select(F.col("listing_id").alias("offer_id"), F.col("part").alias("product_id"), (F.col("source_id") % 7).alias("last_seen"))
    return catalog.backfill(products, links, offers)


K10 = f"WITH {FEED} SELECT part AS product_id, any_value(model) AS model, arg_max(listing_id, (source_id % 7, listing_id)) AS offer_id FROM feed WHERE part % 5 > 0 AND part % 3 > 0 GROUP BY part"


def k11_unidentified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).select(F.col("listing_id").alias("seq"), F.when(F.col("part") % 2 == 0, F.col("model_text")).alias("model"), "title", F.lit("en").alias("locale"))
    return catalog.term_queue(catalog.unidentified(rows, "widget|ring")).drop("suggestion")


K11 = f"""WITH {FEED} SELECT 'catalog_identity' AS kind, trim(regexp_replace(lower(title), '[^a-z0-9-]+', ' ', 'g')) AS term, 'en' AS locale, max(listing_id) AS last_seen, count(*) AS occurrences
    FROM feed WHERE part % 2 = 1 AND regexp_matches(title, '(?i)widget|ring') GROUP BY term"""


def x4_term_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that a reviewer has named a state for, by the terms' own counts; the newest decision holds."""
    queue = watching.c10_term_queue(spark, sf_dir)
    n = F.col("occurrences")
    first = queue.where(n % 3 > 0).select("kind", "term", "locale", F.lit("out_of_stock").alias("decision"), F.lit(1).alias("seq"))
    second = queue.where(n % 3 == 2).select("kind", "term", "locale", F.when(n % 2 == 0, "reopen").otherwise("in_stock").alias("decision"), F.lit(2).alias("seq"))
    return catalog.decide(queue, first.unionByName(second), "kind", "term", "locale").select("kind", "term", "locale", "occurrences", "status")


X4 = f"SELECT kind, term, locale, occurrences, CASE WHEN occurrences % 3 = 1 THEN 'out_of_stock' WHEN occurrences % 3 = 2 AND occurrences % 2 = 1 THEN 'in_stock' ELSE 'pending' END AS status FROM ({watching.C10})"


# --- posts


def m2_post_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts of their sources; the id is the source's own, and every tenth comes a second time."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("external_id"), F.col("doc_id").alias("posted_at"), F.coalesce("text", F.lit("")).alias("text"))
    again = rows.where("post_id % 10 = 0").withColumns({"post_id": F.col("post_id") + 10_000_000, "posted_at": F.col("posted_at") + 10_000_000})
    return community.post_origins(rows.unionByName(again))


M2 = f"""WITH f AS (SELECT doc_id, source, {watching.HAY.replace("coalesce(text, '')", watching.BARE)} AS form FROM documents), g AS (SELECT *, min(doc_id) OVER (PARTITION BY form) AS first_id FROM f)
    SELECT first_id, doc_id AS post_id, source AS source_id, doc_id AS external_id FROM g WHERE doc_id <> first_id"""


def m7_hidden_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    spam = community.spam_score(F.col("text"), F.size(community.links(F.col("text")))) + F.when(F.col("turn") % 4 == 3, 0.7).otherwise(0.0)
    n = F.col("conv_id")
    hidden = community.hidden((F.col("role") == "assistant") & (n % 5 == 0), F.col("text").contains("http"), n % 7 == 0, spam, n % 2 == 0, n % 3 == 0)
    return posts.select("conv_id", "turn", hidden.alias("hidden"))


M7 = f"""SELECT s.conv_id, s.turn, (role = 'assistant' AND s.conv_id % 5 = 0) OR contains(coalesce(text, ''), 'http') OR (s.conv_id % 7 = 0 AND s.conv_id % 2 = 0) OR (round(spam + CASE WHEN s.turn % 4 = 3 THEN 0.7 ELSE 0 END, 2) >= 0.7 AND s.conv_id % 3 = 0) AS hidden
    FROM ({SQL["m6_post_signals"]}) s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn = s.turn"""


def m9_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("fetched_at"), (F.col("user_id") % 400 - 5).cast("int").alias("retention_days"))
    return community.unexpired(posts, watching.at("2024-01-28")).select("event_id", F.col("retention_days").cast("long").alias("retention_days"))


M9 = "SELECT event_id, user_id % 400 - 5 AS retention_days FROM events WHERE ts + to_days(CAST(least(365, greatest(7, user_id % 400 - 5)) AS INTEGER)) > TIMESTAMP '2024-01-28'"


# --- operations


def q5_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("event_type")
    rows = table(spark, sf_dir, "events")
    requests = rows.select(F.when(status == "click", "queued").when(status == "signup", "running").otherwise("done").alias("status"))
    return matching.queue_counts(rows.select((F.col("event_id") % 9 > 0).alias("notified")), rows.select(F.when(status == "error", "failed").otherwise("sent").alias("status")), requests, watching.x1_candidate_decisions(spark, sf_dir))


Q5 = f"""SELECT count(*) FILTER (event_id % 9 = 0) AS pending_notifications, count(*) FILTER (event_type = 'error') AS failed_notifications, count(*) FILTER (event_type = 'click') AS monitor_queued, count(*) FILTER (event_type = 'signup') AS monitor_running,
    (SELECT count(*) FROM ({watching.X1}) WHERE status = 'pending') AS pending_candidates FROM events"""


def q6_top_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ops_view(spark, sf_dir)
    since = ops.agg((F.max("created_at") - F.expr("interval 7 days")).alias("since"))
    return matching.top_error_classes(ops.crossJoin(F.broadcast(since)), F.col("since"))  # one row


Q6 = f"""WITH {OPS} SELECT component, error_class, count(*) AS failures FROM ops WHERE status = 'failed' AND created_at >= (SELECT max(created_at) - INTERVAL 7 DAY FROM ops)
    GROUP BY ALL ORDER BY failures DESC, component, error_class LIMIT 20"""


def q7_all_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = timeline.source_health(base.runs(spark, sf_dir)).withColumn("enabled", F.substring("source", -1, 1) != "3")
    return matching.slo_alerts(base.metrics(spark, sf_dir), health, q5_queue_counts(spark, sf_dir), watching.q5_freshness_counts(spark, sf_dir), {"parser": 0.9})


Q7 = f"""WITH {METRICS}, runs AS (SELECT *, max(CASE WHEN status = 'success' THEN (created_at, seq) END) OVER (PARTITION BY source_key) AS ok FROM ops WHERE status <> 'skipped' AND source_key NOT LIKE '%3'),
    streak AS (SELECT max(n) AS n FROM (SELECT count(*) FILTER (status = 'failed' AND (ok IS NULL OR (created_at, seq) > ok)) AS n FROM runs GROUP BY source_key)), q AS ({Q5}), f AS ({watching.Q5}),
    a AS (SELECT concat_ws(',', CASE WHEN streak.n >= 3 THEN 'source_failure_streak' END, CASE WHEN (SELECT greatest(failure_rate, item_failure_rate, page_failure_rate) FROM metrics WHERE component = 'parser') >= 0.9 THEN 'parser_failure_rate' END,
        CASE WHEN (SELECT failure_rate FROM metrics WHERE component = 'notification') >= 0.1 THEN 'notification_failure_rate' END, CASE WHEN failed_notifications >= 1 THEN 'notification_queue_failed' END,
        CASE WHEN monitor_queued + monitor_running >= 50 THEN 'monitor_queue_backlog' END, CASE WHEN stale / greatest(1, fresh + stale + unknown) >= 0.2 THEN 'stale_offer_rate' END) AS alerts FROM streak, q, f)
    SELECT alerts, CASE WHEN alerts = '' THEN 'ok' ELSE 'degraded' END AS status FROM a"""


def f9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the scans: every sixth never ended, every fourth failed with a long message."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.date_format("l_shipdate", "yyyy-MM").alias("scan_id"), (F.col("l_returnflag") == "R").alias("excluded"), F.col("l_linenumber").cast("long").alias("n_events"), "l_shipdate")
    month = F.substring("scan_id", 6, 2).cast("int") + F.col("source_id")
    ended = item.groupBy("source_id", "scan_id").agg(F.max("l_shipdate").alias("last"))
    status = F.when(month % 6 == 0, "running").when(month % 4 == 0, "failed").otherwise("success")
    scans = ended.select("source_id", "scan_id", status.alias("status"), F.when(month % 6 > 0, F.col("last").cast("timestamp_ntz")).alias("finished_at"), F.when((month % 4 == 0) & (month % 6 > 0), F.repeat(F.lit("x"), F.lit(600))).alias("error"))
    found = operations.run_accounts(item, scans, watching.at("1999-01-01"))
    return found.withColumn("error", F.when(F.col("error") == "interrupted", F.col("error")).otherwise(F.length("error").cast("string")))


F9 = """WITH s AS (SELECT l_suppkey AS source_id, strftime(l_shipdate, '%Y-%m') AS scan_id, max(l_shipdate) AS last, any_value(month(l_shipdate) + l_suppkey) AS m, count(*) AS seen, count(*) FILTER (l_returnflag = 'R') AS excluded,
        coalesce(CAST(sum(l_linenumber) AS BIGINT), 0) AS events FROM lineitem GROUP BY ALL)
    SELECT source_id, scan_id, CASE WHEN m % 6 = 0 OR m % 4 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN m % 6 = 0 THEN TIMESTAMP '1999-01-01' ELSE CAST(last AS TIMESTAMP) END AS finished_at,
        CASE WHEN m % 6 = 0 THEN 'interrupted' WHEN m % 4 = 0 THEN '500' END AS error, seen, excluded, events FROM s"""


PAIRS = [
    (s1_listing_frames, S1), (s11_official_feed, S11), (s12_posts, S12), (s13_observation_days, S13), (s15_registry, S15), (s6_page_outcomes, S6),
    (s7_usable_listings, f"""WITH {FEED}, l AS (SELECT listing_id, CASE listing_id % 3 WHEN 0 THEN title WHEN 1 THEN '' END AS t, CASE listing_id % 4 WHEN 0 THEN '' WHEN 2 THEN '5' END AS p FROM feed)
        SELECT listing_id, coalesce(t <> '', false) OR p IS NOT NULL AS usable FROM l"""),
    (s8_sitemap_urls, S8), (s10_search_urls, S10), (n8_fetchable_urls, N8), (n16_listing_models, N16), (n20_tax_notes, N20), (n21_release_dates, N21),
    (n23_terms, "SELECT p_partkey, p_name || '|' || p_type || '|' || p_name || ' x' AS terms FROM part"),
    (c9_terminal, f"""WITH {FEED} SELECT listing_id, regexp_matches(title || ' ' || ['Discontinued item', '販売終了しました', 'in stock', '已停售', '廃番'][1 + part % 5], '{classify.TERMINAL}') AS terminal FROM feed"""),
    (c7_signals, C7), (d2_hints, D2), (d6_reasons, D6), (e2_first_sights, E2), (f3_failed_scans, F3), (i1_known_offers, I1), (w9_backfill, W9), (w10_boost, W10), (a4_alert_outbox, A4), (a2_event_digests, A2), (k1_series_dates, K1), (k4_catalog_products, K4), (k6_official_details, K6), (i7_moved_events, I7), (i8_merged_facts, I8), (x1_approved_listings, X1), (m2_post_origins, M2), (k9_source_classes, K9), (k10_backfill, K10), (k11_unidentified, K11), (x4_term_decisions, X4),
    (m7_hidden_posts, M7), (m9_unexpired, M9), (q5_queue_counts, Q5), (q6_top_error_classes, Q6), (q7_all_limits, Q7), (f9_runs, F9),
]
QUERIES = {f.__name__: f for f, _ in PAIRS}
ORACLE_SQL = {f.__name__: sql for f, sql in PAIRS}
