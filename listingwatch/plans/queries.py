"""The registered queries of the listing pipeline and the same questions in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import classify, community, matching, rules, timeline
from ..sources.tables import cut
from . import oracle
from .views import feed, observations, operations, table

COOLDOWN_HOURS = 72


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e5_cooldown(spark, sf_dir).where("type = 'back_in_stock'")


def stable(spark, sf_dir):
    return timeline.stable_states(observations(spark, sf_dir))


def o1_latest_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest_offers(stable(spark, sf_dir))


def o2_stable_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable(spark, sf_dir).select("seq", "offer_id", "stable", "candidate", F.col("candidate_count").cast("long"))


def e4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.events(stable(spark, sf_dir))


def e5_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.cooled(timeline.events(stable(spark, sf_dir)), COOLDOWN_HOURS)


def e6_event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.events(stable(spark, sf_dir)).select("seq", "offer_id", "type", "to_state")
    return matching.newest(found, 200, F.desc("seq"), F.col("type"))


def scans(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.date_format("l_shipdate", "yyyy-MM").alias("scan_id"), F.col("l_partkey").alias("offer_id"), (F.col("l_returnflag") == "R").alias("returned")
    )
    return seen.groupBy("source_id", "scan_id", "offer_id").agg(F.min("returned").alias("terminal"))


def f1_scan_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = scans(spark, sf_dir)
    return timeline.presence(seen, seen.select("source_id", "scan_id")).withColumn("misses", F.col("misses").cast("long"))


def runs(spark, sf_dir):
    ops = operations(spark, sf_dir).where("status <> 'skipped'")
    return ops.select(F.col("source_key").alias("source"), F.col("created_at").alias("at"), "seq", (F.col("status") == "success").alias("ok"))


def f8_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.source_health(runs(spark, sf_dir))


def q3_component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


def metrics(spark, sf_dir):
    ops = operations(spark, sf_dir)
    since = ops.agg((F.max("created_at") - F.expr("interval 7 days")).alias("since"))
    with_since = ops.crossJoin(F.broadcast(since))  # one row
    return matching.component_metrics(with_since, F.col("since"))


def q6_top_error_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = operations(spark, sf_dir).where("status = 'failed'").groupBy("component", "source_key").count()
    return matching.newest(failed.withColumnRenamed("count", "failures"), 20, F.desc("failures"), F.col("component"), F.col("source_key"))


def q7_slo_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.slo_alerts(metrics(spark, sf_dir), timeline.source_health(runs(spark, sf_dir)))


def n6_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    host = urls.bare_host(url)
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.normalized(url).alias("normalized"), urls.canonical(url).alias("canonical"), urls.fingerprint(url).alias("fingerprint"), urls.registrable_domain(host).alias("domain"), urls.is_public(host).alias("public")
    )


def n15_listing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"model": text.model_code(F.col("model_text")), "variant": text.variant_key(F.col("title")), "sku_key": text.sku(F.col("sku")), "alias": text.alias_form(F.col("title"))}
    return feed(spark, sf_dir, **fields).select("listing_id", "model", "variant", text.barcode(F.col("barcode")).alias("barcode"), F.col("sku_key").alias("sku"), "alias")


def n14_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.element_at(F.array(*map(F.lit, ("NT$ ", "US$", "¥", "EUR ", "£"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    price = text.price_of(F.concat(sign, F.format_number("p_retailprice", 2)))
    return table(spark, sf_dir, "part").select("p_partkey", price["price"].alias("price"), price["currency"].alias("currency"))


def c7_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    found = classify.availability(F.col("availability_raw"), F.col("availability_text"), F.col("title"), none, F.col("has_buy_button"), F.col("price"))
    rows = feed(spark, sf_dir, of_stated={"a": found, "excluded": classify.exclusion_reason(F.col("title"), F.col("availability_text"))})
    return rows.select("listing_id", "a.state", "a.confidence", "a.locale", "excluded")


def keyed_listings(spark, sf_dir):
    """The feed with the keys that listings are resolved by. They depend on the part, but for the barcode, and so are made once a part."""
    keys = {"sku_key": text.sku(F.col("sku")), "model": text.model_code(F.col("model_text")), "variant": text.variant_key(F.col("title"))}
    found = feed(spark, sf_dir, **keys)
    return found.select("listing_id", "source_id", "part", text.barcode(F.col("barcode")).alias("barcode"), F.col("sku_key").alias("sku"), "model", "brand", "variant")


def i3_product_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(keyed_listings(spark, sf_dir), "listings")
    return matching.match_products(found, first_products(found))


def first_products(found: DataFrame) -> DataFrame:
    """Each part as a product with the keys of its first listing."""
    first = found.groupBy("part").agg(F.min(F.struct("listing_id", "barcode", "sku", "model", "brand", "variant")).alias("row"))
    return first.select(F.col("part").alias("product_id"), "row.barcode", "row.sku", "row.model", "row.brand", "row.variant")


def watched_context(spark, sf_dir):
    """Each part as a product with a catalog entry of its number: brands are the entry's other names, sizes its parts."""
    part = table(spark, sf_dir, "part").withColumn("number", F.col("p_partkey") % 900 + 100)
    number = F.col("number").alias("catalog_product_id")
    code = F.concat(F.lit("CX-"), "number")
    products = part.select(
        F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 10 < 9, F.concat_ws(" ", "p_name", "p_type", code)).alias("title"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("B-"), F.col("p_partkey") % 50 + 10)).alias("model"),
        (F.lit(4900000000000) + F.col("p_partkey")).cast("string").alias("barcode"), F.lit(None).cast("string").alias("listing_model"), F.lit(None).cast("string").alias("listing_barcode"), number,
    )
    catalog = part.select(number, code.alias("product_code"), F.lit(None).cast("string").alias("barcode")).distinct()
    aliases = part.select(number, F.concat(F.lit("Line "), "p_brand").alias("alias")).distinct()
    parts = part.select(number, F.col("p_size").cast("long").alias("catalog_part_id"), F.concat(F.lit("P"), "p_size").alias("code"), F.concat(F.lit("size "), "p_size").alias("name")).distinct()
    return rules.product_context(products, catalog, aliases, parts)


def w1_match_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c, "|").alias(c)
    return watched_context(spark, sf_dir).select("product_id", "catalog_product_id", "locale", *map(joined, ("base_values", "synonym_values", "models", "barcodes")), F.array_join(F.col("catalog_part_ids").cast("array<string>"), "|").alias("catalog_part_ids"))


def watch_rules(spark, sf_dir):
    """A rule for each part, of seven kinds: a whole title, a part of one, an expression (some of them invalid), a barcode, a
    model, a catalog part with a keyword, a catalog product with a language; every other one excludes `red`."""
    part = table(spark, sf_dir, "part").withColumn("number", F.col("p_partkey") % 900 + 100)
    key, code = F.col("p_partkey"), F.concat(F.lit("CX-"), "number")
    kind = key % 7
    expression = F.when(key % 35 == 2, "(").otherwise(F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(r" \w+ cx-"), (F.col("number") / 10).cast("int"), F.lit("[0-4]")))
    word = F.when(kind == 0, F.upper(F.concat_ws(" ", "p_name", "p_type", code))).when(kind == 1, F.concat("p_type", F.lit(" CX - "), "number")).when(kind == 2, expression).when(kind == 5, code)
    return part.select(
        key.alias("rule_id"), F.array_compact(F.array(F.lit("no such thing"), word)).alias("keywords"), F.when(kind.isin(1, 5), "contains").when(kind == 2, "regex").otherwise("exact").alias("mode"),
        F.when(key % 2 == 0, F.array(F.lit("RED "))).alias("exclude_terms"), F.when(kind == 3, (F.lit(4900000000000) + key).cast("string")).alias("barcode"), F.when(kind == 4, F.lower(code)).alias("model"),
        F.when(kind == 5, F.col("p_size").cast("long")).alias("catalog_part_id"), F.when(kind == 6, F.col("number")).alias("catalog_product_id"),
        F.when(kind == 6, F.element_at(F.array(*map(F.lit, ("any", "en", "ja"))), (key % 3 + 1).cast("int"))).alias("locale"), kind.alias("kind"),
    ).withColumn("keywords", F.when(kind_has_words(), F.col("keywords"))).drop("kind")


def kind_has_words():
    return F.col("kind").isin(0, 1, 2, 5)


def w3_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_rules(watched_context(spark, sf_dir), watch_rules(spark, sf_dir)).select("rule_id", "product_id", "confidence", "match_type", F.array_join("reasons", "|").alias("reasons"))


def w11_rule_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.valid_rules(watch_rules(spark, sf_dir)).select("rule_id", "mode", "valid")


def s14_snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    order = F.struct("observed_at", "seq")
    batch = lambda df: df.groupBy("offer_id").agg(F.max_by("price", order).alias("price"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count("*").alias("seen"))
    rules = {"price": "overwrite", "first_seen": "least", "last_seen": "greatest", "seen": "sum"}
    return matching.upsert(batch(obs.where("seq % 2 = 0")), batch(obs.where("seq % 2 = 1 and offer_id % 3 <> 0")), ["offer_id"], rules)


def a2_product_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    found = classify.availability(F.col("availability_raw"), F.col("availability_text"), none, none, F.col("has_buy_button"), F.col("price"))
    offers = feed(spark, sf_dir).select(F.col("part").alias("product_id"), F.col("brand").alias("name"), found["state"].alias("state"), "price", F.concat(F.lit("shop"), F.col("source_id")).alias("source"))
    return matching.digests(offers)


def r3_offer_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = timeline.latest_offers(stable(spark, sf_dir)).withColumn("purchasable", F.col("stable").isin(*timeline.BUYABLE))
    return matching.newest(offers.select("offer_id", "source_id", "stable", "price", "purchasable", "last_seen"), 200, F.desc("purchasable"), F.desc("last_seen"), F.col("offer_id"))


def k4_catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select("p_brand", F.lower("p_type").alias("alias")).distinct().groupBy("p_brand").agg(F.count("*").alias("aliases"), F.array_join(F.array_sort(F.collect_list("alias")), " | ").alias("alias_list"))
    counts = part.groupBy("p_brand").agg(F.count("*").alias("products"), F.min("p_retailprice").alias("lowest"))
    return counts.join(names, "p_brand", "left")


def m2_first_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("doc_id").alias("posted_at"), F.coalesce("text", F.lit("")).alias("text"))
    return community.first_posts(posts).select("post_id", "duplicate_count")


def m6_post_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    n = F.size(community.links(F.col("text")))
    rows = posts.withColumn("n_links", n)
    return rows.select("conv_id", "turn", F.col("n_links").cast("long").alias("n_links"), community.spam_score(F.col("text"), F.col("n_links")).alias("spam"), F.array_join(community.leads(F.col("text"), F.col("n_links")), ",").alias("leads"))


def d5_budgeted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = urls.hint_score(F.col("url"), F.lit(""), r"shop|store", r"\b[a-z]{2}-?\d{2,3}\b")
    pages = table(spark, sf_dir, "pages").select("page_id", urls.registrable_domain(urls.bare_host(F.col("url"))).alias("site"), F.least(F.lit(100), score + 35).alias("priority"), F.octet_length("html").cast("long").alias("bytes"))
    return matching.within_budget(pages, 100, 200_000).select("page_id", "site", "priority", F.col("place").cast("long"), "spent")


QUERIES = {
    f.__name__: f
    for f in (
        o1_latest_offer, o2_stable_state, e4_events, e5_cooldown, e6_event_feed, f1_scan_presence, f8_source_health, q3_component_metrics, q6_top_error_sources, q7_slo_alerts, n6_page_urls,
        n15_listing_fields, n14_prices, c7_availability, i3_product_match, w1_match_context, w3_rule_matches, w11_rule_checks, s14_snapshot_upsert, a2_product_digest, r3_offer_board, k4_catalog_listing, m2_first_posts, m6_post_signals, d5_budgeted_pick,
    )
}
ORACLE_SQL = oracle.SQL
