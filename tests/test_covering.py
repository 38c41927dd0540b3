"""Hand-made cases of redaction, folding, first sights, known offers, limits, runs, facts after reviews, digests and origins."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from listingwatch.functions import text, urls
from listingwatch.operators import catalog, classify, community, identity, matching, operations, pages, timeline
from listingwatch.sources import tables


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column).first()[0]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def t():
    return F.col("t")


def test_secrets_become_marks(spark):
    cases = {
        "authorization=abc def": "authorization=[secret] def", "Authorization: Bearer a.b-c, x": "Authorization=[secret], x", "via bot12345:AA-b_c!": "via bot[token]!", "api-key = q;z": "api-key=[secret];z",
        "123456789:AAAAAAAAAAAAAAAAAAAAAAAA": "[token]", "HTTPS://x.example/?t=1'>": "[url]'>", "a" * 24: "[token]", "plain": "plain",
    }
    assert {k: one(spark, k, text.redact(t())) for k in cases} == cases


def test_folding_goes_through_nfkc(spark):
    cases = {"BX- 38": "bx-38", "BX -38": "bx-38", "ＢＸ　－　３８": "bx-38", "①ｶﾞｲｱ": "1ガイア", "é!!é": "é é", "  ": ""}
    assert {k: one(spark, k, text.alias_form(t())) for k in cases} == cases
    assert one(spark, "ab①-ｶﾞ c", text.sku(t())) == "AB1-ガC"
    assert one(spark, "ﾚｯﾄﾞ", text.variant_key(t())) == "red"
    assert one(spark, "２０２６年０３月０７日", F.date_format(text.release_date(t()), "yyyy-MM-dd")) == "2026-03-07"
    assert one(spark, "ﾖﾔｸ ｶｰﾄに入れる", classify.text_match(t())["state"]) == "in_stock"
    assert one(spark, "a,, b ,a，b,c", F.array_join(text.terms(t(), 3), "|")) == "a|b|a，b".replace("，", ",")


def test_listing_models(spark):
    df = spark.createDataFrame([("bx 38", None, None), (" x1 ", "BX-01", None), ("", "bx-02 z", "CX-09"), (None, "z", "the CX 09"), (None, None, None)], "m string, s string, t string")
    assert [r[0] for r in df.select(text.listing_model(F.col("m"), F.col("s"), F.col("t"))).collect()] == ["BX-38", "X1", "BX-02", "CX-09", None]


def test_addresses(spark):
    cases = {"ftp://x.com": "unsupported_protocol", "https://u:p@x.com/": "credentials_not_allowed", "x.com/a": "invalid_url", "https:///a": "invalid_url", "http://x.com": None}
    assert {k: one(spark, k, urls.refused(t())) for k in cases} == cases
    assert one(spark, "HTTP://www.X.com:80/a/?wovn=ja&utm_source=q&b=1#z", urls.fetchable(t())) == "https://www.x.com/a?b=1&wovn=ja"
    assert one(spark, "www.shop.co.jp.", urls.registrable_domain(t())) == "shop.co.jp"
    assert one(spark, "a.b.c.org", urls.registrable_domain(t(), {"a.b.c.org": "b.c.org"})) == "b.c.org"
    assert one(spark, "https://x.com/item/login", F.array_join(urls.hint_reasons(t(), F.lit(""), "item", "zz", ("log",), ("ITEM".lower(),)), ",")) == "brand,product_path,excluded,included"


def test_a_products_first_offer_is_only_its_discovery(spark):
    obs = [(1, 1, 0, 1, 5.0, "in_stock", 9), (2, 2, 0, 2, 5.0, "in_stock", 9), (3, 3, 0, 3, 5.0, "preorder", None)]
    df = spark.createDataFrame([(s, o, src, datetime(2024, 1, d), p, a, prod) for s, o, src, d, p, a, prod in obs], "seq int, offer_id int, source_id int, observed_at timestamp, price double, availability string, product_id int")
    stable = timeline.stable_states(df)
    assert rows(timeline.events(stable), "seq", "type") == [(2, "became_available"), (3, "preorder_open")]
    assert rows(timeline.events(stable.drop("product_id")), "seq", "type") == [(1, "became_available"), (2, "became_available"), (3, "preorder_open")]


def test_reviewed_terms_replace_states(spark):
    listings = spark.createDataFrame([(1, "Ships soon", None, "unknown", 0.2), (2, None, "now: SHIPS  soon-ish", "in_stock", 0.9), (3, None, None, "in_stock", 0.9), (4, "x", None, "unknown", 0.2)], "listing_id int, stated string, raw_text string, state string, confidence double")
    terms = spark.createDataFrame([("ships soon", "preorder"), ("soon-ish", "coming_soon"), ("x", "out_of_stock"), ("", "in_stock")], "term string, state string")
    assert rows(classify.reviewed_states(listings, terms), "listing_id", "state", "confidence") == [(1, "preorder", 0.75), (2, "preorder", 0.75), (3, "in_stock", 0.9), (4, "out_of_stock", 0.75)]


def test_known_offers_keep_their_product(spark):
    fields = "listing_id int, source_id int, url string, barcode string, sku string, model string, brand string, variant string"
    listings = spark.createDataFrame([(1, 1, "a", "49", None, None, None, None), (2, 1, "b", "49", None, None, None, None), (3, 2, "a", None, "S", None, "X", None)], fields)
    products = spark.createDataFrame([(70, "49", "S", None, "x", None), (71, None, "S", None, None, None)], "product_id int, barcode string, sku string, model string, brand string, variant string")
    offers = spark.createDataFrame([(1, "a", 99)], "source_id int, url string, product_id int")
    found = {r.listing_id: (r.product_id, r.matched_by) for r in matching.resolve_known(listings, offers, products).collect()}
    assert found == {1: (99, "offer"), 2: (70, "barcode"), 3: (None, None)}


def test_limits(spark):
    metrics = spark.createDataFrame([("parser", 10, 0.0, 0.05, 0.2), ("notification", 5, 0.1, 0.0, 0.0), ("source", 5, 1.0, 1.0, 1.0)], "component string, total long, failure_rate double, item_failure_rate double, page_failure_rate double")
    health = spark.createDataFrame([(5, False), (2, True)], "failures long, enabled boolean")
    queues = spark.createDataFrame([(1, 1, 20, 30, 0)], "pending_notifications long, failed_notifications long, monitor_queued long, monitor_running long, pending_candidates long")
    fresh = spark.createDataFrame([(8, 2, 90, 0)], "fresh long, stale long, archived long, unknown long")
    assert matching.slo_alerts(metrics, health, queues, fresh).first().alerts == "parser_failure_rate,notification_failure_rate,notification_queue_failed,monitor_queue_backlog,stale_offer_rate"
    assert matching.slo_alerts(metrics.where("total > 99"), health, queues.withColumn("failed_notifications", F.lit(0)).withColumn("monitor_queued", F.lit(0)), fresh.withColumn("stale", F.lit(0))).first().status == "ok"


def test_runs(spark):
    items = spark.createDataFrame([(1, "a", True, 2), (1, "a", False, 1)], "source_id int, scan_id string, excluded boolean, n_events int")
    runs = spark.createDataFrame([(1, "a", "running", None, None), (1, "b", "failed", datetime(2024, 1, 1), "x" * 600)], "source_id int, scan_id string, status string, finished_at timestamp, error string")
    out = {r.scan_id: r for r in operations.run_accounts(items, runs, F.lit(datetime(2024, 2, 1))).collect()}
    assert (out["a"].status, out["a"].error, out["a"].seen, out["a"].excluded, out["a"].events) == ("failed", "interrupted", 2, 1, 3)
    assert (out["b"].status, len(out["b"].error), out["b"].seen) == ("failed", 500, 0)
    assert operations.run_accounts(items, runs).where("status = 'running'").count() == 1


def test_facts_follow_reviews(spark):
    facts = spark.createDataFrame([(1, 5, 7), (2, 6, 7), (3, None, 8)], "event_id int, offer_id int, product_id int")
    after = spark.createDataFrame([(5, 70, True), (6, 7, False)], "offer_id int, product_id int, moved boolean")
    assert rows(identity.facts_after_split(facts, after), "event_id", "product_id") == [(1, 70), (2, 7), (3, 8)]
    targets = spark.createDataFrame([(7, 1), (9, 1)], "source int, target int")
    assert rows(identity.facts_after_merge(facts, targets), "event_id", "product_id") == [(1, 1), (2, 1), (3, 8)]
    links = spark.createDataFrame([(9, "n"), (7, "s"), (8, "e")], "product_id int, model string")
    assert rows(identity.links_after_merge(links, targets), "product_id", "model") == [(1, "s"), (8, "e")]
    own = links.unionByName(spark.createDataFrame([(1, "own")], "product_id int, model string"))
    assert rows(identity.links_after_merge(own, targets), "product_id", "model") == [(1, "own"), (8, "e")]


def test_event_digests(spark):
    events = spark.createDataFrame([(1, 1, 1, "price_change", "in_stock"), (1, 2, 2, "odd", None), (1, 3, 1, "preorder_open", "preorder"), (2, None, None, "coming_soon", "coming_soon")], "product_id int, offer_id int, source_id int, type string, to_state string")
    offers = spark.createDataFrame([(1, 5.0, "JPY", "https://x"), (2, None, "JPY", None), (3, 4.5, None, None)], "offer_id int, price double, currency string, url string")
    products = spark.createDataFrame([(1, "Dran", "BX-01")], "product_id int, name string, model string")
    sources = spark.createDataFrame([(1, "Shop")], "source_id int, source_name string")
    out = {r.product_id: (r.title, r.body) for r in matching.event_digests(events, offers, products, sources).collect()}
    assert out == {1: ("Dran (BX-01)", "💲 Price change @ Shop — 5.00 JPY\n    https://x\n📦 Pre-order open @ Shop — 4.50\nodd @ unknown store"), 2: ("Product", "🔜 Coming soon @ unknown store")}


def test_post_origins(spark):
    posts = spark.createDataFrame([(1, "s", "a", 1, "New item #x"), (2, "s", "a", 2, "New item"), (3, "t", "a", 3, "new  item"), (4, "t", "b", 4, "other")], "post_id int, source_id string, external_id string, posted_at int, text string")
    assert rows(community.post_origins(posts), "first_id", "post_id", "source_id", "external_id") == [(1, 3, "t", "a")]


def test_official_items_and_feed(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"source": "m", "items": [{"title": "A", "productCode": "BX-01", "msrp": 5, "series": "S"}, {"title": "B"}]}, indent=1))
    items = tables.official_feed(spark, str(tmp_path))
    assert rows(items, "source", "seq", "title", "msrp") == [("m", 0, "A", 5.0), ("m", 1, "B", None)]
    more = spark.createDataFrame([(1, "BX-01", "A", "49", 5.0, "Own", "S", "JPY"), (2, "BX-01", "B", "50", None, None, None, None)], "seq int, model string, title string, barcode string, msrp double, brand string, series string, currency string")
    out = catalog.official_items(more, "own").first()
    assert (out.brand, out.series, out.currency, out.msrp, out.title, out.barcode, out.verification) == ("own", "S", "JPY", 5.0, "B", "49", "conflict")


def test_usable_and_links(spark):
    assert [one(spark, p, pages.is_usable(F.lit(""), price=t())) for p in ("", "5", None)] == [True, True, False]
    html = """<a href=/a>x</a><a class=q href='/b?x=1&amp;y=2'>y</a><A HREF="https://www.s.com/c">z</A><a href=javascript:1>n</a>"""
    page = spark.createDataFrame([(1, "https://s.com/x", html)], "page_id int, url string, html string")
    assert rows(pages.page_links(page), "target") == [("https://s.com/a",), ("https://s.com/b?x=1&y=2",), ("https://s.com/c",)]
