"""Discovery, review, parts, announcements, audits, recipes and expiry on hand-made rows."""

import uuid
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from listingwatch.functions import text, urls
from listingwatch.operators import catalog, classify, community, discovery, frontier, identity, operations, pages, watch
from listingwatch.plans import views
from listingwatch.streaming import jobs


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


FOUND = "site string, url string, seq int, title string, model string, confidence double, excluded_reason string, method string"
KNOWN = "site string, url string, title string, model string, confidence double, method string, status string, first_seen int, last_seen int"


def test_candidates(spark):
    found = spark.createDataFrame([
        ("a", "u1", 1, "x", None, 0.9, None, "link"), ("a", "u1", 2, "y", "BX-01", 0.45, "used", "seed"), ("a", "u2", 3, " ", None, 0.9, None, "link"), ("a", "u3", 4, None, None, 0.9, None, "link"),
        ("a", "u4", 5, "z", None, 0.44, None, "link"), ("a", "u5", 6, "new", None, 0.5, "used", "link"), ("a", "u6", 7, "null", None, None, None, "link"),
    ], FOUND)
    known = spark.createDataFrame([("a", "u1", "old", None, 0.6, "seed", "approved", 0, 0), ("b", "u9", "old", None, 0.6, "seed", "deferred", 0, 0)], KNOWN)
    out = discovery.save_candidates(known, found)
    assert rows(out, "site", "url", "title", "model", "confidence", "status", "first_seen", "last_seen") == [
        ("a", "u1", "y", "BX-01", 0.45, "approved", 0, 2), ("a", "u5", "new", None, 0.5, "excluded", 6, 6), ("b", "u9", "old", None, 0.6, "deferred", 0, 0),
    ]
    assert [r.url for r in discovery.candidate_queue(out.withColumn("status", F.when(F.col("url") == "u5", "pending").otherwise(F.col("status"))), 2).collect()] == ["u5", "u9"]
    assert discovery.save_candidates(known, found.where("false")).count() == 2


def test_runs_and_sites(spark):
    visits = spark.createDataFrame([(1, "visited", 60), (1, "visited", None), (1, "pending", 9), (2, "visited", 100), (3, "failed", 1)], "run_id int, status string, bytes long")
    found = spark.createDataFrame([(1, "a", "u"), (1, "a", "u"), (1, "a", "v")], "run_id int, site string, url string")
    runs = discovery.run_summaries(visits, found, 2, 100)
    assert rows(runs, "run_id", "pages", "bytes", "pending", "candidates", "stop_reason", "status", "recipe") == [
        (1, 2, 60, 1, 2, "page_budget", "budget_exhausted", "active"), (2, 1, 100, 0, 0, "byte_budget", "budget_exhausted", "needs_review"), (3, 0, 0, 0, 0, None, "success", "needs_review"),
    ]
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    candidates = spark.createDataFrame([("a", "pending"), ("a", "approved")], "site string, status string")
    last = spark.createDataFrame([("a", 2, "stopped"), ("a", 1, "success")], "site string, run_id int, status string")
    assert rows(discovery.site_overview(sites, candidates, last), "site", "pending", "total", "last_status") == [("a", 1, 2, "stopped"), ("b", 0, 0, None)]
    on = spark.createDataFrame([(None,), ("https://x/sitemap_1",), ("https://x/a.XML?b",), ("https://x/a",)], "u string")
    assert [r[0] for r in on.select(discovery.method_of(F.col("u"))).collect()] == ["seed", "sitemap", "sitemap", "link"]


def test_walk(spark):
    links = spark.createDataFrame([(1, 2, 10), (1, 2, 30), (1, 5, 9), (2, 3, 80), (3, 4, 50), (2, 1, 90), (7, 8, 10)], "page_id int, target int, score int")
    maps = spark.createDataFrame([(2, 15), (7, 60), (3, 25), (1, 90)], "page_id int, score int")
    seeds = spark.createDataFrame([(1,), (1,)], "page_id int")
    assert rows(frontier.walk(seeds, links, maps, 2), "page_id", "depth", "method", "priority") == [(1, 0, "seed", 100), (2, 1, "link", 65), (3, 1, "sitemap", 70), (4, 2, "link", 85), (7, 1, "sitemap", 95), (8, 2, "link", 45)]
    assert rows(frontier.walk(seeds, links, maps, 0), "page_id") == [(1,)]


def test_catalog_tables(spark):
    proof = spark.createDataFrame([(1, "M", "u", "official_store", "ja", "verified"), (2, "M", "u", "retailer", "en", "pending"), (3, None, "u", "retailer", "en", "pending"), (4, "M", None, None, None, None)], "seq int, model string, url string, source_class string, locale string, verification string")
    assert rows(catalog.evidence(proof), "model", "url", "source_class", "locale", "confidence", "verification") == [("M", "u", "retailer", "en", 0.98, "verified")]
    named = spark.createDataFrame([(1, "bit", " A ", "x  y", "pending"), (2, "bit", "A", "x y", "verified"), (3, "bit", None, "x y", "pending"), (4, "bit", "", "x y", None), (5, "odd", "A", "x", "pending"), (6, "bit", "A", " ", "pending")], "seq int, part_type string, code string, name string, verification string")
    assert rows(catalog.parts(named, ("bit",)), "part_type", "code", "name", "verification") == [("bit", "A", "x y", "verified"), ("bit", None, "x y", "pending")]
    links = spark.createDataFrame([(1, "M", 1, 3, 1), (2, "M", 1, None, 2), (2, "M", 2, -4, None), (2, "M", 2, -4, None)], "seq int, model string, part_id int, quantity int, position int")
    assert rows(catalog.product_parts(links), "model", "part_id", "quantity", "position") == [("M", 1, 1, 2), ("M", 2, 1, None)]
    items = spark.createDataFrame([(1, 9, "u", "M", "a", None, 10, 1.0), (2, 9, "u", "M", "b", "announced", 20, None), (3, 9, "u", None, "c", "restock", 1, 1.0), (4, 9, "u", "M", "d", "restock", None, 2.0)], "seq int, source_id int, url string, model string, title string, event_type string, published_at int, msrp double")
    told = catalog.announcements(items)
    assert rows(told, "announcement_id", "event_type", "title", "msrp", "published_at") == [(1, "announced", "b", None, 10), (4, "restock", "d", 2.0, None)]
    wanted = spark.createDataFrame([(5, "in_stock"), (5, "in_stock"), (6, "official_announcement")], "rule_id int, alert_type string")
    matches = spark.createDataFrame([(5, "M"), (6, "M"), (7, "M"), (5, None)], "rule_id int, model string")
    known = spark.createDataFrame([("watch:6:official:1:official_announcement",)], "dedup_key string")
    assert rows(watch.announcement_alerts(told, matches, wanted, known), "dedup_key") == [("watch:5:official:4:in_stock",)]
    assert rows(watch.rules_listed(spark.createDataFrame([(5,), (8,)], "rule_id int"), wanted), "rule_id", "alert_types") == [(5, ["in_stock"]), (8, [])]
    assert rows(catalog.official_sources_listed(spark.createDataFrame([(9,), (10,)], "source_id int"), told), "source_id", "announcements") == [(10, 0), (9, 2)]


def test_reviewed(spark):
    listings = spark.createDataFrame([(1, "Sold  OUT soon"), (2, "fine"), (3, None), (4, ""), (5, "sold out soon")], "listing_id int, stated string")
    terms = spark.createDataFrame([("sold", "a"), ("sold out", "b"), ("", "c")], "term string, state string")
    assert rows(classify.reviewed_states(listings, terms), "listing_id", "override_state", "override_term") == [(1, "b", "sold out"), (2, None, None), (3, None, None), (4, None, None), (5, "b", "sold out")]
    allowed = spark.createDataFrame([(1, "u"), (1, "u")], "source_id int, url string")
    assert rows(classify.with_allowed(spark.createDataFrame([(1, "u"), (1, None), (2, "u")], "source_id int, url string"), allowed), "source_id", "url", "is_allowed") == [(1, "u", True), (1, None, False), (2, "u", False)]


def test_audits(spark):
    before = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "offer_id int, product_id int")
    after = identity.split_products(before, spark.createDataFrame([(2, 70), (3, 71), (4, 80)], "offer_id int, new_product_id int"))
    audit = identity.split_audit(before, after)
    assert rows(audit, "product_id", "new_product_id", "offers_before", "offers_after", "moved_offers", "first_offer", "last_offer") == [(7, 70, 3, 1, 1, 2, 2), (7, 71, 3, 1, 1, 3, 3)]
    assert rows(identity.catalog_links_after(spark.createDataFrame([(7, "M")], "product_id int, model string"), audit), "product_id", "model") == [(7, "M"), (70, "M"), (71, "M")]
    products = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "product_id int, brand string")
    merged = frontier.merge_audit(products, spark.createDataFrame([(3, 2), (2, 1)], "source int, target int"), ["brand"])
    assert rows(merged, "source", "target_id", "source_before.brand", "target_before.brand", "target_after.brand") == [(2, 1, "b", None, "b"), (3, 1, "c", None, "b")]


def test_operation_events(spark):
    columns = "seq int, component string, operation string, source_key string, status string, error string, duration_ms long, created_at string, " + ", ".join(f"{c} long" for c in operations.COUNTS)
    raw = spark.createDataFrame([
        (1, "parser", "extract", "shop-a", "failed", None, -5, "t", 1, -1, None, 2_000_000, 0), (2, "hacker", "rm", "https://x", "odd", "HTTP 404 for https://secret", None, "t", *[0] * 5),
        (3, "source", "send", "my-token", "success", "", 10**9, "t", *[0] * 5), (4, None, None, None, None, "http_503", 5, "t", *[None] * 5), (5, "source", "crawl", "a" * 65, "failed", "something odd", 5, "t", *[0] * 5),
    ], columns)
    out = operations.operation_events(raw)
    assert rows(out, "seq", "component", "operation", "source_key", "status", "error_class", "duration_ms") == [
        (1, "parser", "extract", "shop-a", "failed", "error", 0), (2, "monitor", "other", None, "skipped", "http_404", None), (3, "source", "other", None, "success", None, 86_400_000),
        (4, "monitor", "other", None, "skipped", "http_503", 5), (5, "source", "crawl", None, "failed", "error", 5),
    ]
    assert tuple(out.where("seq = 1").select(*operations.COUNTS).first()) == (1, 0, 0, 1_000_000, 0)
    assert rows(operations.recent_events(out, 2), "seq") == [(4,), (5,)]


def test_selected_fields(spark):
    html = '<body><h1>a</h1><div class="x y" id=m><h1>T <b>&amp;</b> u<br>v</h1><p data-k="1">p</p><img src=i.png></div><button class=buy disabled>b</button><button class=buy aria-disabled=" TRUE ">b</button></body>'
    recipe = '{"title": ".none, #m.x h1", "price": "p[data-k=1]", "currency": "p[data-k=2]", "image": "div.y img", "buy_button": ".buy"}'
    cases = [(1, html, recipe), (2, html.replace(" disabled", ""), recipe), (3, None, recipe), (4, html, None), (5, "", recipe), (6, "<p data-k=1>open <i>end", recipe)]
    df = spark.createDataFrame(cases, "i int, html string, recipe string").select("i", pages.selected_fields("html", "recipe").alias("c"))
    assert rows(df, "i", "c.title", "c.price", "c.currency", "c.image", "c.buy_button") == [(1, "T & uv", "p", None, "i.png", "false"), (2, "T & uv", "p", None, "i.png", "true"), (3, *[None] * 5), (4, *[None] * 5), (5, *[None] * 5), (6, None, "open end", None, None, "false")]


def test_parsed_pages(spark):
    data = '<title>Shop</title><script type="application/ld+json">{"@type": "Product", "name": "N", "description": "D", "offers": {"price": 0, "availability": "%s"}}</script><b id=a>gone</b><i id=t>other</i>'
    recipe = '{"title": "#t", "availability_text": "#a"}'
    stored = spark.createDataFrame([(1, 1, data % "InStock"), (2, 1, data % ""), (3, 1, "<title> Only </title><i id=t>other</i>"), (4, 2, data % ""), (5, 1, None)], "page_id int, source_id int, html string")
    recipes = spark.createDataFrame([(1, recipe)], "source_id int, recipe string")
    assert rows(pages.parsed_pages(stored, recipes), "page_id", "title", "price", "availability_text", "raw_text") == [(1, "N", "0", None, "N D"), (2, "N", "0", "gone", "N D"), (3, "other", None, None, "Only"), (4, "N", "0", None, "N D"), (5, None, None, None, None)]


def test_names_and_moments(spark):
    df = spark.createDataFrame([("my.shop-x.co.jp",), ("a",), (None,), ("--",)], "d string")
    assert rows(df, urls.source_key(F.col("d")), urls.display_name(F.col("d"))) == sorted([("my-shop-x-co-jp", "My"), ("a", "A"), (None, None), ("", "--")], key=repr)
    said = ["2024/1/2 3:04", "2024.01.02 03:04:05", "2024-01-02T03:04:05Z", "2024-02-30 1:00", "soon", "", None, "2024-01-02"]
    out = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(text.date_time(F.col("s"), "+09:00")).collect()]
    assert out == [datetime(2024, 1, 1, 18, 4), datetime(2024, 1, 1, 18, 4, 5), datetime(2024, 1, 2, 3, 4, 5), None, None, None, None, datetime(2024, 1, 2)]


def test_posts_listed(spark):
    posts = spark.createDataFrame([(1, 5, "see https://a.example/x.", False), (2, 6, None, None), (3, 9, "x", True)], "post_id long, posted_at int, text string, hidden boolean")
    matches = spark.createDataFrame([(8, 1), (7, 1), (7, 1), (7, 3)], "rule_id long, post_id long")
    assert rows(community.visible_posts(posts, matches), "post_id", F.size("links"), "rules")[0][::2] == (1, [7, 8])
    assert rows(community.visible_posts(posts, matches, 1), "post_id") == [(2,)]
    counts = community.source_counts(spark.createDataFrame([(1,), (2,)], "source_id int"), posts.withColumn("source_id", F.lit(1)))
    assert rows(counts, "source_id", "posts", "hidden_posts") == [(1, 3, 1), (2, 0, 0)]


def test_expiry_timer(spark, tmp_path):
    """An offer expires by the timer, without a row of its own, when others move the watermark; state outlives a restart."""
    at = lambda m: datetime(2024, 1, 1, 12, m)
    schema, table = "offer_id int, observed_at timestamp_ntz", f"{tmp_path}/{uuid.uuid4().hex}"
    seen = []
    for batch in ([(1, at(0)), (1, at(1)), (2, at(0)), (2, at(20)), (None, at(0)), (3, None)], [(2, at(50)), (4, at(50))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        seen.append(rows(jobs.drain(jobs.freshness_changes(stream, 600, "1 minute"), "f", table), "offer_id", "freshness", F.minute("at")))
    assert seen[0] == sorted([(1, "fresh", 0), (1, "stale", 11), (2, "fresh", 0), (2, "stale", 10), (2, "fresh", 20)], key=repr)
    assert seen[1] == sorted([*seen[0], (2, "stale", 30), (2, "fresh", 50), (4, "fresh", 50)], key=repr)
def test_equal_pages_of_a_batch_are_read_once():
    read = []
    rows = [(h, r) for h in ("<b>1</b>", "<b>2</b>", None) for r in ('{"title": "b"}', None)] * 50
    columns = [pa.array(column, pa.string()) for column in zip(*rows)]
    found = pages.read_once(lambda html, recipe: read.append((html, recipe)) or pages.parsed(html, recipe), pages.PARSED, *columns)
    assert found.field("c_title").to_pylist() == ["1", None, "2", None, None, None] * 50
    assert sorted(read, key=repr) == sorted(set(rows), key=repr)
    assert len(pages.read_once(pages.parsed, pages.PARSED, *[c.slice(0, 0) for c in columns])) == 0


def test_what_depends_on_a_stated_text_is_made_once_a_text(spark):
    made, sf_dir = F.concat_ws(":", "part", F.coalesce("availability_text", F.lit("none"))), "/root/testdata/sf0.001"
    got = views.feed(spark, sf_dir, of_stated={"made": made})
    expected = views.feed(spark, sf_dir).withColumn("made", made)
    assert sorted(map(tuple, got.select(*expected.columns).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_listings_of_a_part_follow_each_other(spark):
    rows = lambda together: views.feed(spark, "/root/testdata/sf0.001", together)
    parts = rows(True).select(F.spark_partition_id().alias("at"), "part").collect()
    assert sum(a != b for a, b in zip(parts, parts[1:])) + 1 == len({r["part"] for r in parts})
    assert sorted(map(tuple, rows(True).collect()), key=str) == sorted(map(tuple, rows(False).collect()), key=str)


