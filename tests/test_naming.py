"""Products after resolution, reports with names, links and addresses of pages, on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from listingwatch.functions import text, urls
from listingwatch.operators import community, identity, matching, operations, pages, watch


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


LISTINGS = "listing_id long, seq long, title string, model string, barcode string, brand string, image string"
FOUND = [
    (5, 1, "", "CX-10", "490", None, ""), (3, 2, "late title", "CX-11", None, "b", "i3"), (7, 3, "x", None, "491", "c", "i7"), (8, 4, None, None, None, None, None), (9, 5, "lost", None, None, "z", None),
]
RESOLVED = [(5, 100), (3, 100), (7, 1), (8, 101), (9, None), (999, 1)]


def test_products_are_made_and_enriched(spark):
    listings, resolved = spark.createDataFrame(FOUND, LISTINGS), spark.createDataFrame(RESOLVED, "listing_id long, product_id long")
    known = spark.createDataFrame([(1, "one", None, "own", ""), (2, "two", "b2", None, None)], "product_id long, name string, brand string, barcode string, image string")
    columns = ("product_id", "name", "created", "brand", "brand_from", "barcode", "barcode_from", "image", "image_from", "model")
    assert rows(identity.product_rows(listings, resolved, known), *columns) == [
        (1, "one", False, "c", 7, "own", None, "i7", 7, None),
        (100, "CX-10", True, "b", 3, "490", 5, "i3", 3, "CX-10"),
        (101, "Unknown product", True, None, None, None, None, None, None, None),
        (2, "two", False, "b2", None, None, None, None, None, None),
    ]
    assert rows(identity.product_rows(listings, resolved), "product_id", "name", "created", "brand", "brand_from") == [(1, "x", True, "c", 7), (100, "CX-10", True, "b", 3), (101, "Unknown product", True, None, None)]
    assert identity.product_rows(listings.limit(0), resolved).count() == 0
    assert rows(identity.product_rows(listings.limit(0), resolved, known), "product_id", "created") == [(1, False), (2, False)]


def test_products_of_a_batch_equal_a_fold(spark):
    listed = [(i, i, f"t{i}" if i % 3 else "", f"CX-{i % 7 + 10}", str(49000000 + i % 5) if i % 2 else None, ("a", "b", None)[i % 3] and "a", None) for i in range(60)]
    listings = spark.createDataFrame(listed, LISTINGS).withColumns({"sku": F.lit(None).cast("string"), "variant": F.lit(None).cast("string")})
    found = identity.resolve_batch(listings)
    of = dict(rows(found, "listing_id", "product_id"))
    want = {}
    for i, _, title, model, barcode, brand, _ in listed:
        p = want.setdefault(of[i], {"name": title or model or barcode, "model": None, "barcode": None, "brand": None})
        for field, value in (("model", model), ("barcode", barcode), ("brand", brand)):
            if p[field] is None and value:
                p[field] = value
    assert rows(identity.product_rows(listings, found), "product_id", "name", "model", "barcode", "brand") == sorted(((k, *v.values()) for k, v in want.items()), key=repr)


def test_audits(spark):
    splits = spark.createDataFrame([(1, 10, 11), (4, 12, 13)], "audit_id int, product_id long, new_product_id long")
    merges = spark.createDataFrame([(3, 20, 21)], "audit_id int, source long, target_id long")
    assert [tuple(r) for r in identity.audits_listed(splits, merges, 2).orderBy(F.desc("audit_id")).collect()] == [(4, "split", 12, 13), (3, "merge", 20, 21)]


def test_matches_are_kept_by_catalog_entry(spark):
    schema = "rule_id int, catalog_product_id long, product_id long, offer_id long, match_type string, confidence double, reasons string, seq int"
    none = spark.createDataFrame([], "rule_id int, identity_key string, product_id long, offer_id long, match_type string, confidence double, reasons string, first_matched int, last_matched int")
    one = watch.keyed_match_table(none, spark.createDataFrame([(1, 7, 10, 100, "exact", 0.99, "a", 1), (1, 7, 11, None, "regex", 0.85, "b", 2), (1, None, 10, None, "exact", 0.99, "c", 3)], schema), F.lit(1))
    columns = ("identity_key", "product_id", "offer_id", "match_type", "confidence", "reasons", "first_matched", "last_matched")
    assert rows(one, *columns) == [("catalog:7", 11, 100, "exact", 0.99, "b", 1, 1), ("product:10", 10, None, "exact", 0.99, "c", 1, 1)]
    two = watch.keyed_match_table(one, spark.createDataFrame([(1, 7, None, 101, "contains", 0.85, "d", 1)], schema), F.lit(2))
    assert rows(two, *columns) == [("catalog:7", 11, 101, "exact", 0.99, "d", 1, 2), ("product:10", 10, None, "exact", 0.99, "c", 1, 1)]


def test_named_rules_and_reports(spark):
    rules = spark.createDataFrame([(1, 7, None), (2, None, 5), (3, 8, None), (4, None, None)], "rule_id int, catalog_product_id long, catalog_part_id long")
    wanted = spark.createDataFrame([(1, "in_stock")], "rule_id int, alert_type string")
    products, parts = spark.createDataFrame([(7, "CX-7")], "catalog_product_id long, product_code string"), spark.createDataFrame([(5, "gear")], "catalog_part_id long, part_name string")
    assert rows(watch.rules_named(rules, wanted, products, parts), "rule_id", "selected_product_code", "selected_part_name", "alert_types") == [(1, "CX-7", None, ["in_stock"]), (2, None, "gear", []), (3, None, None, []), (4, None, None, [])]
    events = spark.createDataFrame([(1, 10, 1, "a"), (2, 11, None, "a"), (3, None, 2, "b")], "seq int, product_id int, source_id int, type string")
    names, shops = spark.createDataFrame([(10, "ten")], "product_id int, product_name string"), spark.createDataFrame([(1, "one"), (2, "two")], "source_id int, source_name string")
    assert rows(matching.event_feed(events, names, shops), "seq", "product_name", "source_name") == [(1, "ten", "one"), (2, None, None), (3, None, "two")]
    assert rows(matching.event_feed(events, names, shops, 1), "seq", "source_name") == [(3, "two")]
    offers = spark.createDataFrame([(1, 10, 1, False, "stale", True, 9), (2, 10, 1, True, "fresh", True, 9), (3, 11, 1, None, "fresh", None, 1), (4, 10, 2, False, "fresh", True, 9)], "offer_id int, product_id int, source_id int, archived boolean, freshness string, purchasable boolean, last_seen int")
    switched = shops.withColumns({"source_class": F.lit("official"), "enabled": F.col("source_id") == 1})
    assert rows(matching.offer_board(offers, names, switched, 2), "offer_id", "product_name", "source_name") == [(1, "ten", "one"), (3, None, "one")]
    alerts = spark.createDataFrame([("k1", 1, 5, 7), ("k2", 1, 6, None)], "dedup_key string, rule_id int, event_id int, catalog_product_id long")
    assert rows(watch.alerts_named(alerts, rules.withColumn("rule_name", F.lit("r")), products, 9), "dedup_key", "rule_name", "product_code") == [("k1", "r", "CX-7"), ("k2", "r", None)]


def test_diagnostics(spark):
    empty = spark.createDataFrame([], "x int")
    assert rows(operations.table_counts(a=empty, b=spark.range(3)), "name", "rows") == [("a", 0), ("b", 3)]
    sources = spark.createDataFrame([("shop", "html", True), ("https://x", "password=abc", None), ("my-token", None, False)], "source string, connector string, enabled boolean")
    health = spark.createDataFrame([("shop", 2, datetime(2024, 1, 1))], "source string, failures int, last_success timestamp")
    assert rows(operations.source_states(sources, health, text.redact), "source_key", "connector", "enabled", "failures") == [("shop", "html", True, 2), ("source", "password=[secret]", False, 0), ("source", None, False, 0)]


def test_links_and_origins(spark):
    posts = spark.createDataFrame([(1, "https://x.org/mall/a, https://x.org/mall/a and http://y.org"), (2, None)], "post_id int, text string")
    assert rows(community.link_rows(posts), "post_id", "url", "kind") == [(1, "https://x.org/mall/a", "store"), (1, "https://y.org/", "external")]
    shown = spark.createDataFrame([(1, "s", "e1", 5, False, None), (2, "s", "e2", 9, True, False), (3, "t", "e3", 7, None, True), (4, "t", "e4", 6, False, False)], "post_id int, source_id string, external_id string, posted_at int, hidden boolean, muted boolean")
    origins = spark.createDataFrame([(1, 8, "u", "e8"), (4, 9, "u", "e9"), (2, 7, "u", "e7")], "first_id int, post_id int, source_id string, external_id string")
    assert rows(community.origins_listed(shown, origins), "post_id", "source_id", "external_id") == [(1, "s", "e1"), (1, "u", "e8"), (4, "t", "e4"), (4, "u", "e9")]
    assert rows(community.origins_listed(shown, origins, 1), "post_id", "external_id") == [(4, "e4"), (4, "e9")]


ADDRESSES = [
    ("p", "https://a.org/x/y?q=1", "https://a.org/x/p"), ("../p/", "https://a.org/x/y/z", "https://a.org/x/p"), ("../../../p", "https://a.org/x", "https://a.org/p"), ("./", "https://a.org/x/y", "https://a.org/x"),
    ("a/..", "https://a.org/x/y", "https://a.org/x"), ("#f", "https://a.org/x?q=1#g", "https://a.org/x?q=1"), ("", "https://a.org/", ""), (None, "https://a.org/", None), ("?b=%41&a=1&a=0&REF=x", "https://a.org/x", "https://a.org/x?a=1&a=0&b=A"),
    ("/p?x=a b&y=%zz", "https://a.org", "https://a.org/p?x=a+b&y=%25zz"), ("mailto:x@a.org", "https://a.org/", "mailto:x@a.org"), (" words ", None, "words"), ("HTTP://A.org:80", None, "http://a.org/"), ("x", None, "x"), ("/.well-known/x", "https://a.org", "https://a.org/.well-known/x"),
]


def test_addresses_against_a_base(spark):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(ADDRESSES)], "i int, href string, base string, want string")
    assert [r[0] for r in df.withColumn("got", pages.normalized_at(F.col("href"), F.col("base"))).orderBy("i").select("got").collect()] == [a[2] for a in ADDRESSES]
    reason = pages.invalid_reason(F.col("href"), F.col("base"), F.col("i") % 2 == 0)
    got = [r[0] for r in df.withColumn("r", reason).orderBy("i").select("r").collect()]
    assert got == ["missing-url" if not a[2] else None if i % 2 == 0 else "no-product-fields" for i, a in enumerate(ADDRESSES)]


HTML = "<p><A class=x href='/shop/th-1'> The <b>thing</b></a><a name=n>th</a><a href=/private/th>th<a href=\"//b.a.org/th?x=1&amp;y=2#f\">one\n two</a><a href='https://else.org/th'>th</a><a href='/shop/th-1'>x</a><a href='/login/th'>th</a><abbr href='/th'>th"


def test_scored_links(spark):
    page = spark.createDataFrame([(1, "https://www.a.org/x", HTML), (2, "https://www.a.org/x", None), (3, "https://www.a.org/x", "")], "page_id int, url string, html string")
    assert rows(pages.page_anchors(page), "href", "text") == [("//b.a.org/th?x=1&y=2#f", "one two"), ("/login/th", "th"), ("/private/th", "th"), ("/shop/th-1", "The thing"), ("/shop/th-1", "x"), ("https://else.org/th", "th")]
    rules = spark.createDataFrame([("www.a.org", False, "/private")], "host string, allow boolean, pattern string")
    found = rows(pages.scored_links(page, rules, "th", r"\bthe thing\b"), "page_id", "target", "score", "priority")
    assert found == [(1, "https://b.a.org/th?x=1&y=2", 45, 80), (1, "https://www.a.org/shop/th-1", 90, 100)]
    assert pages.scored_links(page.limit(0), rules, "th", "x").count() == 0


def test_dots(spark):
    cases = {"/a/b": "/a/b", "/./a": "/a", "/a/../../b": "/b", "/a/%2e%2E/b/.": "/b/", "/..": "/", "/a/...": "/a/..."}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert dict(df.select("p", urls.without_dots(F.col("p"))).collect()) == cases
