"""Watching, catalog, pages, frontier and operations on hand-made rows."""

import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from listingwatch.functions import text
from listingwatch.operators import catalog, community, frontier, identity, operations, pages, timeline, watch
from listingwatch.sources import tables


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_structured_product(spark):
    html = [
        '<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": ["X", "product"], "name": "A", "gtin": "1", "gtin13": "2", "offers": [{"price": 5, "availability": "InStock"}]}]}</script>',
        "<script type='application/ld+json'>nonsense</script><script type='application/ld+json'>{\"@type\": \"Product\", \"name\": \"B\", \"offers\": {\"@type\": \"AggregateOffer\", \"price\": \"9\", \"offers\": {\"priceCurrency\": \"JPY\"}}}</script>",
        "<p>no data</p>", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string").select("i", pages.structured_product("html").alias("p"))
    out = {r.i: (r.p.title, r.p.barcode, r.p.price, r.p.currency, r.p.availability_raw) for r in df.collect()}
    assert out == {0: ("A", "2", "5", None, "InStock"), 1: ("B", None, "9", "JPY", None), 2: (None,) * 5, 3: (None,) * 5, 4: (None,) * 5}


def test_page_outcome(spark):
    html = [("<title>x</title>", True), ("<h1>Site  maintenance</h1>", False), ("<title>shop</title><script>under maintenance</script><p>hi</p>", False), ("<p>メンテナンス中</p>", False)]
    df = spark.createDataFrame(html, "html string, usable boolean")
    assert [r[0] for r in df.select(pages.outcome(F.col("html"), F.col("usable"))).collect()] == ["ok", "maintenance", "empty", "maintenance"]


def test_links_forms_sitemaps(spark):
    html = '<a class=x href="b?utm_source=1">t</a> <a href="/c/">t</a><a href="//other.com/z">t</a><a href="mailto:q@x.com">m</a><a href="https://shop.x.com/d#top">d</a><form action="/find"><input type=text name="q"></form><form method="post"><input name="q"></form>'
    df = spark.createDataFrame([(1, "https://www.x.com/a/i.html", html), (2, None, None)], "page_id int, url string, html string")
    assert rows(pages.page_links(df), "target") == [("https://shop.x.com/d",), ("https://x.com/a/b",), ("https://x.com/c",)]
    assert rows(pages.search_urls(df, "spinning top"), "target") == [("https://www.x.com/find?q=spinning+top",)]
    xml = '<urlset xmlns="http://s/"><url><loc> https://x.com/1 </loc></url><url><loc>https://x.com/2</loc></url></urlset>'
    maps = spark.createDataFrame([(1, xml), (2, "<sitemapindex><sitemap><loc>https://x.com/m.xml</loc></sitemap></sitemapindex>")], "sitemap_id int, xml string")
    assert rows(pages.sitemap_urls(maps), "sitemap_id", "kind", "loc") == [(1, "url", "https://x.com/1"), (1, "url", "https://x.com/2"), (2, "sitemap", "https://x.com/m.xml")]


def test_robots(spark):
    body = "User-agent: watcher\nUser-agent: also\nDisallow: /shop\nAllow: /shop/open$\n\nUser-agent: *\nDisallow: /"
    robots = spark.createDataFrame([("x.com", body), ("y.com", "User-agent: *\nDisallow: /a.b*c\nAllow: /a.b*c")], "host string, body string")
    links = spark.createDataFrame([(u,) for u in ("https://x.com/", "https://x.com/shop/1", "https://x.com/shop/open", "https://x.com/shop/open1", "https://y.com/a.bxc", "https://y.com/aXbc", "https://z.com/")], "url string")
    out = dict(rows(pages.robots_allowed(links, pages.robots_rules(robots, "Watcher/1.0")), "url", "allowed"))
    assert list(out.values()).count(False) == 2 and not out["https://x.com/shop/1"] and not out["https://x.com/shop/open1"]


def test_frontier(spark):
    links = spark.createDataFrame([(1, 2, 10), (2, 3, 50), (3, 1, 50), (3, 4, 50), (1, 9, 5), (4, 5, 50)], "page_id int, target int, score int")
    seeds = spark.createDataFrame([(1, "seed"), (1, "sitemap")], "page_id int, method string")
    assert rows(frontier.expand(seeds, links, 3), "page_id", "depth", "method") == [(1, 0, "seed"), (2, 1, "link"), (3, 2, "link"), (4, 3, "link")]
    assert frontier.expand(seeds.where("false"), links, 3).count() == 0


def test_merges(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(2, 12)] + [(20, 1), (30, 30)], "source int, target int")
    assert rows(frontier.merge_targets(chain), "source", "target") == sorted([(i, 1) for i in range(2, 12)] + [(20, 1)], key=repr)
    products = spark.createDataFrame([(1, None, "n1"), (3, "b3", None), (2, "b2", "n2"), (7, None, None), (30, "x", "y")], "product_id int, brand string, name string")
    assert rows(frontier.merge_products(products, chain, ["brand", "name"]), "product_id", "brand", "name", "merged") == [(1, "b2", "n1", 4), (30, "x", "y", 1)]


def test_alerts(spark):
    events = spark.createDataFrame([(1, 5, "price_change", "in_stock"), (2, 5, "coming_soon", "coming_soon"), (3, 6, "product_discovered", "preorder"), (4, 5, "back_in_stock", "in_stock")], "event_id int, product_id int, type string, to_state string")
    matches = spark.createDataFrame([(9, 5), (9, 5), (8, 6), (7, 5)], "rule_id int, product_id int")
    wanted = spark.createDataFrame([(9, "price_anomaly"), (9, "in_stock"), (8, "preorder_open")], "rule_id int, alert_type string")
    known = spark.createDataFrame([("watch:9:event:4:in_stock",)], "dedup_key string")
    assert rows(watch.alerts(events, matches, wanted, known), "dedup_key") == [("watch:8:event:3:preorder_open",), ("watch:9:event:1:price_anomaly",)]


def test_outbox(spark):
    pending = spark.createDataFrame([("a",), ("b",), ("b",)], "dedup_key string")
    channels = spark.createDataFrame([("chat", True), ("mail", False)], "channel string, configured boolean")
    sent = spark.createDataFrame([("chat", "a", "failed"), ("chat", "a", "sent"), ("chat", "b", "failed")], "channel string, dedup_key string, status string")
    out = watch.outbox(pending, channels, sent)
    assert rows(out, "dedup_key", "channel", "state") == [("a", "chat", "skipped"), ("a", "mail", "unconfigured"), ("b", "chat", "retry"), ("b", "mail", "unconfigured")]
    assert rows(watch.completed(out), "dedup_key", "open", "done") == [("a", 0, True), ("b", 1, False)]


def test_catalog(spark):
    items = spark.createDataFrame([(1, "BX-01", "a", None, 5.0), (2, "BX-01", "b", "111", None), (3, "BX-01", "c", "222", None), (4, None, "d", "1", 1.0), (5, "UX-02", " ", "1", 1.0), (6, "UX-03", "e", None, None)], "seq int, model string, title string, barcode string, msrp double")
    assert rows(catalog.official_items(items), "model", "barcode", "msrp", "title", "verification") == [("BX-01", "111", 5.0, "c", "conflict"), ("UX-03", None, None, "e", "verified")]
    assert rows(catalog.review_items(items), "seq") == [(4,), (5,)]
    decisions = spark.createDataFrame([(1, "approve", 1), (1, "reopen", 2), (2, "exclude", 3), (2, "approve", 5), (2, "defer", 4)], "id int, decision string, seq int")
    assert rows(catalog.decide(spark.createDataFrame([(1,), (2,), (3,)], "id int"), decisions, "id"), "id", "status") == [(1, "pending"), (2, "approve"), (3, "pending")]


def test_operations(spark):
    scans = spark.createDataFrame([(0, 0, 0, 0, 0, 0), (2, 2, 0, 2, 0, 0), (2, 0, 0, 0, 2, 2), (2, 3, 2, 1, 0, 0), (1, 1, 1, 0, 0, 0), (None, 0, 0, 0, 0, 0)], "pages int, parsed int, valid int, invalid int, bad_pages int, maintenance int")
    assert [tuple(r) for r in operations.parser_outcomes(scans).select("status", "error_class").collect()] == [("skipped", "no_url"), ("failed", "parse"), ("failed", "maintenance"), ("success", "partial"), ("success", None), ("skipped", "no_url")]
    sources = spark.createDataFrame([(1, 3600, 0), (2, 3600, 0), (3, 30, 9), (4, 200000, 0)], "source_id int, base_seconds int, failures int")
    offers = spark.createDataFrame([(1, True, False, None), (2, False, False, datetime(2024, 1, 5))], "source_id int, watched boolean, buyable boolean, released timestamp_ntz")
    plan = operations.recrawl_plan(sources, offers, F.expr("timestamp_ntz'2024-01-01'"))
    assert rows(plan, "source_id", "seconds", "freshness_seconds") == [(1, 300, 7200), (2, 900, 7200), (3, 15360, 1800), (4, 200000, 400000)]
    jittered = operations.recrawl_plan(sources, offers, F.expr("timestamp_ntz'2024-01-01'"), 0.1)
    assert all(abs(a[1] - b[1]) <= 0.1 * a[1] + 1e-9 for a, b in zip(rows(plan, "source_id", "seconds"), rows(jittered, "source_id", "seconds")))


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "1", "url": "https://x.com/a"}\n{"id": "", "url": "https://x.com/a"}\n{"id": "2", "url": "https://evil.example/x.com/"}\n')
    good, bad = tables.posts(spark, str(tmp_path / "p.json"))
    assert rows(good, "id") == [("1",)] and bad.count() == 2
    (tmp_path / "l.json").write_text('{"source_id": "s", "scan_id": 1, "seq": 0, "title": "t", "price": "5"}\n')
    assert rows(tables.listing_frames(spark, str(tmp_path / "l.json")), "title", "price", "model") == [("t", "5", None)]
    obs = spark.createDataFrame([(1, datetime(2024, 1, 1))], "offer_id int, observed_at timestamp_ntz")
    for _ in range(2):
        tables.append_observations(obs, str(tmp_path / "obs"))
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 2


def fold_globally(listings):
    """The sequential rule over all listings at once."""
    products, out = [], {}
    ok = lambda a, b: a is None or b is None or a.lower() == b.lower()
    for i, barcode, sku, model, brand, variant in listings:
        hit = None
        if barcode:
            hit = next(((p, "barcode") for p in products if p["barcode"] == barcode), None)
        if not hit and sku:
            c = [p for p in products if p["sku"] == sku and ok(p["model"], model) and ok(p["brand"], brand)]
            hit = (c[0], "sku") if len(c) == 1 else None
        if not hit and model:
            c = [p for p in products if p["model"] == model and p["variant"] == variant and ok(p["sku"], sku)]
            if len(c) == 1:
                hit = (c[0], "model") if ok(c[0]["brand"], brand) else None
            elif brand:
                c = [p for p in c if ok(p["brand"], brand)]
                hit = (c[0], "model") if len(c) == 1 else None
        if hit:
            p, how = hit
            for field, value in (("barcode", barcode), ("sku", sku), ("model", model), ("brand", brand), ("variant", variant)):
                if p[field] is None:
                    p[field] = value
        else:
            p, how = {"id": i, "barcode": barcode, "sku": sku, "model": model, "brand": brand, "variant": variant}, None
            products.append(p)
        out[i] = (p["id"], how)
    return out


def test_batch_resolution_equals_the_sequence(spark):
    rng = random.Random(11)
    pick = lambda values, null: rng.choice(values) if rng.random() > null else None
    listings = [(i, pick([f"b{k}" for k in range(60)], 0.6), pick([f"s{k}" for k in range(90)], 0.5), pick([f"BX-{k}" for k in range(120)], 0.4), pick(("A", "a", "B"), 0.4), pick(("red", "blue"), 0.6)) for i in range(700)]
    df = spark.createDataFrame([(r[0], *r) for r in listings], "seq int, listing_id long, barcode string, sku string, model string, brand string, variant string")
    out = {r.listing_id: (r.product_id, r.matched_by) for r in identity.resolve_batch(df.repartition(5)).collect()}
    assert out == fold_globally(listings)
    assert identity.resolve_batch(df.where("false")).count() == 0


def test_split(spark):
    offers = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "offer_id int, product_id int")
    splits = spark.createDataFrame([(2, 70), (3, 80)], "offer_id int, new_product_id int")
    assert rows(identity.split_products(offers, splits), "offer_id", "product_id", "moved") == [(1, 7, False), (2, 70, True), (3, 8, False), (4, 9, False)]


def test_rules_backfill_boost(spark):
    rules = spark.createDataFrame([(1, "a", "odd", None, None), (2, "(", "regex", None, None), (3, "x" * 121, "regex", None, None), (4, None, "exact", None, ""), (5, "a+", "regex", None, None), (6, None, None, "BX-01", None)], "rule_id int, keyword string, mode string, model string, barcode string")
    assert rows(watch.valid_rules(rules), "rule_id", "mode", "valid") == [(1, "exact", True), (2, "regex", False), (3, "regex", False), (4, "exact", False), (5, "regex", True), (6, "exact", True)]
    offers = spark.createDataFrame([(1, 7, "in_stock", "fresh", 1), (2, 7, "preorder", "fresh", 2), (3, 7, "in_stock", "archived", 3), (4, 8, "in_stock", "stale", 1)], "offer_id int, product_id int, state string, freshness string, last_seen int")
    matches = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "rule_id int, product_id int")
    assert rows(watch.backfill(rules.where("rule_id = 1"), offers, matches), "rule_id", "product_id", "offer_id", "state") == [(1, 7, 2, "preorder")]
    candidates = spark.createDataFrame([(7, 0.45), (9, 0.9)], "candidate_id int, confidence double")
    hits = spark.createDataFrame([(5, 7), (3, 7)], "rule_id int, candidate_id int")
    assert rows(watch.boost(candidates, hits), "candidate_id", "confidence", "rule_id") == [(7, 0.65, 3), (9, 0.9, None)]


def test_posts(spark):
    df = spark.createDataFrame([(1, "BX_38 and ux-01, BX 38"), (2, "CX-1"), (3, None)], "post_id int, text string")
    assert [r[0] for r in df.orderBy("post_id").select(community.mentions(F.col("text"))).collect()] == [["UX-01", "BX-38"], [], None]
    rules = spark.createDataFrame([(1, "and", "exact", None, "UX-01"), (2, None, "exact", "bx", "BX-38"), (3, "x-1", "contains", None, None)], "rule_id int, keyword string, mode string, exclude string, model string")
    assert rows(community.post_matches(df, rules), "rule_id", "post_id", "confidence") == [(1, 1, 0.95), (3, 2, 0.8)]
    flags = spark.createDataFrame([(True, None, None, 0.0, True, True), (None, False, True, 0.0, False, True), (False, False, True, 0.0, True, True), (False, False, False, 0.7, True, True), (False, False, False, 0.7, True, False)], "m boolean, e boolean, s boolean, p double, fs boolean, fp boolean")
    assert [r[0] for r in flags.select(community.hidden(*map(F.col, flags.columns))).collect()] == [True, False, True, True, False]
    posts = spark.createDataFrame([(datetime(2024, 1, 1), 1), (datetime(2024, 1, 1), 30)], "fetched_at timestamp_ntz, retention_days int")
    assert rows(community.unexpired(posts, F.expr("timestamp_ntz'2024-01-09'")), "retention_days") == [(30,)]


def test_unicode(spark):
    df = spark.createDataFrame([("ﬁ１—“x”",), ("plain",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.normalize_unicode(F.col("t"))).collect()] == ['fi1-"x"', "plain", None, ""]


def test_failed_scan_and_registry(spark):
    offers = spark.createDataFrame([(1, 10, 2, "stale"), (2, 20, 0, "fresh"), (2, 21, 0, "fresh"), (3, 30, 0, "fresh"), (4, 40, 0, "fresh")], "source_id int, offer_id int, misses int, freshness string")
    failures = spark.createDataFrame([(1, "http_404"), (2, "http_404"), (3, "timeout"), (4, "not_found")], "source_id int, error_class string")
    assert rows(timeline.failed_scan(offers, failures), "offer_id", "misses", "freshness", "archive_reason") == [(10, 3, "archived", "http_not_found"), (20, 0, "fresh", None), (21, 0, "fresh", None), (30, 0, "fresh", None), (40, 1, "stale", None)]
    known = spark.createDataFrame([("a", True, True, {"x": "1"}), ("b", False, True, {}), ("c", True, True, {})], "source_key string, managed boolean, enabled boolean, settings map<string,string>")
    defined = spark.createDataFrame([("c", {"ApiKey": "s", "path": "/"}), ("d", {})], "source_key string, settings map<string,string>")
    assert rows(tables.sync_registry(known, defined), "source_key", "managed", "enabled", "settings") == [("a", True, False, {"x": "1"}), ("b", False, True, {}), ("c", True, True, {"path": "/"}), ("d", True, True, {})]


def test_discoveries(spark):
    df = spark.createDataFrame([(1, 5, 1, datetime(2024, 1, 2), "in_stock"), (2, 6, 1, datetime(2024, 1, 1), "preorder"), (3, 7, None, datetime(2024, 1, 1), "unknown")], "seq int, offer_id int, product_id int, observed_at timestamp_ntz, stable string")
    assert rows(timeline.discoveries(df), "product_id", "seq", "offer_id", "to_state") == [(1, 2, 6, "preorder")]


def test_catalog_backfill(spark):
    products = spark.createDataFrame([(1, "BX-01"), (2, None), (3, "BX-03"), (4, "BX-04")], "product_id int, model string")
    offers = spark.createDataFrame([(10, 1, 5), (11, 1, 5), (12, 1, 4), (13, 3, 1)], "offer_id int, product_id int, last_seen int")
    assert rows(catalog.backfill(products, spark.createDataFrame([(3,)], "product_id int"), offers), "product_id", "offer_id") == [(1, 11)]
    sources = spark.createDataFrame([("a.com",), ("b.com",), (None,)], "site string")
    assert rows(catalog.source_classes(sources, spark.createDataFrame([("a.com", "official")], "site string, source_class string")), "site", "source_class") == [("a.com", "official"), ("b.com", "retailer"), (None, "retailer")]
    listings = spark.createDataFrame([(1, None, "Ring  thing", "en"), (2, None, "ring thing", "en"), (3, "BX-01", "ring", "en"), (4, None, "other", "en")], "seq int, model string, title string, locale string")
    assert rows(catalog.term_queue(catalog.unidentified(listings, "ring")), "kind", "term", "occurrences") == [("catalog_identity", "ring thing", 2)]


def test_pairs_of_alerts_meet_without_repeats(spark):
    """What is told under one id of two subjects is still told once; all others need no pass over the pairs."""
    events = spark.createDataFrame([(1, 5, "price_change", None), (1, 5, "price_change", None), (1, 6, "price_change", None), (2, 6, "price_change", None)], "event_id int, product_id int, type string, to_state string")
    matches = spark.createDataFrame([(9, 5), (9, 6), (8, 6)], "rule_id int, product_id int")
    wanted = spark.createDataFrame([(9, "price_anomaly"), (8, "price_anomaly")], "rule_id int, alert_type string")
    none = spark.createDataFrame([], "dedup_key string")
    assert [r.dedup_key for r in watch.alerts(events, matches, wanted, none).orderBy("dedup_key").collect()] == [f"watch:{r}:event:{e}:price_anomaly" for r, e in ((8, 1), (8, 2), (9, 1), (9, 2))]
    plan = watch.alerts(events.where("event_id = 2"), matches, wanted, none)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [dedup_key" not in plan


def test_known_keys_are_taken_out_of_what_some_were_told(spark):
    """Told to all who want it: no pairs; to some, or under odd keys: the others still hear of it, and the pairs aren't sent on."""
    events = spark.createDataFrame([(i, 5, "price_change", None) for i in (1, 2, 3)], "event_id int, product_id int, type string, to_state string")
    matches = spark.createDataFrame([(7, 5), (8, 5), (9, 5)], "rule_id int, product_id int")
    wanted = spark.createDataFrame([(r, "price_anomaly") for r in (7, 8, 9)], "rule_id int, alert_type string")
    all_of_1, some_of_2 = [f"watch:{r}:event:1:price_anomaly" for r in (7, 8, 9)], ["watch:8:event:2:price_anomaly"]
    known = lambda keys: spark.createDataFrame([(k,) for k in keys], "dedup_key string")
    told = lambda found: [(r, e) for r, e in rows(found, "rule_id", "event_id")]
    odd = ["watch:07:event:3:price_anomaly", "watch:7:official:3:price_anomaly", "watch:x:event:3:price_anomaly", "else", "watch:5:event:3:price_anomaly"]
    found = watch.alerts(events, matches, wanted, known(all_of_1 * 2 + some_of_2 + odd))
    assert told(found) == [(7, 2), (7, 3), (8, 3), (9, 2), (9, 3)]
    earlier = watch.alerts(events.where("event_id = 1"), matches, wanted, None)
    found = watch.alerts(events, matches, wanted, earlier)
    assert told(found) == [(r, e) for r in (7, 8, 9) for e in (2, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # who wants what, and the pairs; none with known keys


def test_a_key_of_many_products_is_not_searched():
    """Listings that fit several products of a model are products of their own, and none of them is held against all others."""
    products = identity.Products()
    for i in range(2):
        products.learn(i, (None, f"s{i}", "M-1", "b", "v"))
    began = time.monotonic()
    for i in range(2, 40_000):
        row = (None, None, "M-1", "b", "v")
        assert products.find(*row) == (None, None)
        products.learn(i, row)
    assert time.monotonic() - began < 20


def test_products_move_when_they_learn():
    products = identity.Products()
    products.learn(1, (None, None, "M-1", None, None))
    products.learn(1, (None, "s", None, "Ring", None))
    assert products.find(None, "s", "M-2", None, None) == (None, None) and products.find(None, "s", None, "RING", "v") == (1, "sku")
    products.learn(1, ("code", None, None, None, "v"))
    products.learn(2, ("code", None, "M-1", "Other", None))
    assert products.find("code", "t", "M-3", "x", None) == (1, "barcode")
    assert products.find(None, None, "M-1", None, "v") == (1, "model") and products.find(None, None, "M-1", None, None) == (2, "model")
    assert products.find(None, None, "M-1", "ring", None) == (None, None) and products.find(None, "t", "M-1", "other", None) == (2, "model")


def test_backfill_matches_only_what_can_be_told(spark, monkeypatch):
    met = []
    matched = watch.match_rules
    monkeypatch.setattr(watch, "match_rules", lambda context, rules: met.append((rows(context, "product_id"), rows(rules, "rule_id"))) or matched(context, rules))
    offers = spark.createDataFrame([(1, 5, "in_stock", "fresh", 1), (2, 5, "in_stock", "archived", 2), (3, 6, "in_stock", "fresh", 1), (4, 6, "in_stock", "stale", 2), (5, 7, "out_of_stock", "fresh", 1)], "offer_id int, product_id int, state string, freshness string, last_seen int")
    context = spark.createDataFrame([(i, ["ring"]) for i in (5, 6, 7, 8)], "product_id int, base_values array<string>")
    asked = spark.createDataFrame([(1, ["ring"]), (2, ["ring"]), (3, ["bolt"])], "rule_id int, keywords array<string>")
    new = spark.createDataFrame([(2,), (3,), (3,)], "rule_id int")
    found = watch.backfill_new(new, context, asked, offers)
    assert rows(found, "rule_id", "product_id", "offer_id", "state") == [(2, 5, 1, "in_stock")]
    assert met == [([(5,)], [(2,), (3,)])]
    assert rows(found, *found.columns) == rows(watch.backfill(new, offers, matched(context, asked)), *found.columns)
