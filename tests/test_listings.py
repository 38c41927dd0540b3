"""Listing operators on hand-made rows, and every registered query against its SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from listingwatch.functions import text, urls
from listingwatch.operators import classify, community, matching, timeline
from listingwatch.plans import queries as core
from listingwatch.plans import registry

SF = "/root/testdata/sf0.001"


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("i").select(*columns).collect()]


def t():
    return F.col("t")


def test_text_scalars(spark):
    assert values(spark, ["ＢＸ－３８", "商品BX-38", "UX 01 x", "ABX-38", "BX-1234", None], text.model_code(t())) == ["BX-38", "BX-38", "UX-01", None, None, None]
    price = text.price_of(t())
    assert values(spark, ["NT$ 1,690", "￥3,300", "12,99 €", "abc", "", "USD 5.5"], price["price"], price["currency"]) == [(1690.0, "TWD"), (3300.0, "JPY"), (1299.0, "EUR"), (None, None), (None, None), (5.5, "USD")]
    assert values(spark, ["2026年3月7日", "2026/2/30", "2026.1.2", "2026-1/2", None], F.date_format(text.release_date(t()), "yyyy-MM-dd")) == ["2026-03-07", None, "2026-01-02", None, None]
    assert values(spark, ["red widget", "widget red", "limited red blue", "カラー レッド", "(赤)"], text.variant_key(t())) == [None, "red", "blue|limited|red", "red", "red"]
    assert values(spark, ["税込 500", "tax excluded", "x"], text.tax_included(t())) == [True, False, None]
    assert values(spark, ["か", "漢", "a"], text.locale_of(t())) == ["ja", "zh-TW", "en"]
    assert values(spark, ["HTTP 503", "response exceeds 100 bytes", "status 404 x", "fetch failed", "", "odd", "robots.txt says no"], text.error_class(t())) == ["http_503", "too_large", "http_404", "connection", "unknown", "error", "robots_blocked"]
    assert values(spark, ["Ａ - Ｂ　!!  c"], text.alias_form(t())) == ["a-b c"]
    assert values(spark, ["4900-0000 00001", "12"], text.barcode(t())) == ["4900000000001", None]


def test_urls(spark):
    assert values(spark, ["HTTP://Shop.Example.COM:80/a/?b=2&utm_source=x&a=1#t", "not a url ", "https://x.jp"], urls.normalized(t())) == ["http://shop.example.com/a?a=1&b=2", "not a url", "https://x.jp/"]
    assert values(spark, ["http://www.x.co.jp:8080/p//?wovn=ja&k=1", "ftp://x/y", "http://u:p@x.com/", None], urls.canonical(t())) == ["https://x.co.jp/p?k=1", None, None, None]
    assert values(spark, ["a.b.co.jp", "www.x.com", "1.2.3.4", "localhost"], urls.registrable_domain(t())) == ["b.co.jp", "x.com", "1.2.3.4", "localhost"]
    assert values(spark, ["10.1.1.1", "100.64.0.1", "8.8.8.8", "x.local", "a.com", "172.16.0.1"], urls.is_public(t())) == [False, False, True, False, True, False]


def test_classification(spark):
    df = spark.createDataFrame(
        [("https://schema.org/InStock", "in stock", None, True, 5.0), ("InStock", "sold out", None, None, None), (None, "予約受付中", None, None, 5.0), (None, "x", None, True, None), (None, None, "中古 品", None, None)],
        "raw string, stated string, title string, button boolean, price double",
    )
    none = F.lit(None).cast("string")
    a = classify.availability(F.col("raw"), F.col("stated"), F.col("title"), none, F.col("button"), F.col("price"))
    rows = df.select(a.alias("a"), classify.exclusion_reason(F.col("title"), none).alias("x")).collect()
    assert [(r.a.state, r.a.confidence) for r in rows] == [("in_stock", 0.98), ("in_stock", 0.7), ("preorder", 0.65), ("in_stock", 0.5), ("unknown", 0.2)]
    assert [r.x for r in rows] == [None] * 4 + ["used"]


def fold_states(states, k):
    """The sequential rule: (stable, candidate, count) after each observation."""
    out, stable, candidate, n = [], None, None, 0
    for s in states:
        if stable is None:
            stable = s
        elif s == stable:
            candidate, n = None, 0
        else:
            n = n + 1 if s == candidate else 1
            candidate = s
            if n >= k:
                stable, candidate, n = s, None, 0
        out.append((stable, candidate, n))
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_stable_states_equal_the_fold(spark, k):
    rng = random.Random(k)
    series = {o: [rng.choice("abc") for _ in range(rng.randint(1, 40))] for o in range(60)}
    rows = [(o, 0, i, datetime(2024, 1, 1) + timedelta(hours=i), 1.0, s) for o, ss in series.items() for i, s in enumerate(ss)]
    obs = spark.createDataFrame(rows, "offer_id int, source_id int, seq int, observed_at timestamp, price double, availability string")
    out = {}
    for r in timeline.stable_states(obs, k).orderBy("offer_id", "seq").collect():
        out.setdefault(r.offer_id, []).append((r.stable, r.candidate, r.candidate_count))
    assert out == {o: fold_states(ss, k) for o, ss in series.items()}


def test_cooldown_is_greedy(spark):
    at = [0, 5, 6, 7, 12, 13, 30]
    rows = [(i, 1, 0, datetime(2024, 1, 1) + timedelta(hours=h), "price_change", "a", "b", 1.0) for i, h in enumerate(at)]
    df = spark.createDataFrame(rows, "seq int, offer_id int, source_id int, observed_at timestamp, type string, from_state string, to_state string, price double")
    assert sorted(r.seq for r in timeline.cooled(df, 6).collect()) == [0, 3, 6]


def test_presence(spark):
    scans = spark.createDataFrame([(1, s) for s in "abcdef"], "source_id int, scan_id string")
    seen = spark.createDataFrame([(1, "a", 1, False), (1, "b", 1, False), (1, "a", 2, False), (1, "f", 2, False), (1, "e", 3, True), (1, "d", 4, False)], "source_id int, scan_id string, offer_id int, terminal boolean")
    out = {r.offer_id: (r.misses, r.freshness, r.archived_scan) for r in timeline.presence(seen, scans).collect()}
    assert out == {1: (4, "archived", "e"), 2: (0, "fresh", None), 3: (2, "stale", None), 4: (2, "stale", None)}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 5, "verified"), (2, "b", 7, "x")], "k int, v string, n int, s string")
    new = spark.createDataFrame([(2, None, 3, "verified"), (3, "c", 1, "y"), (1, "z", 1, "no")], "k int, v string, n int, s string")
    out = matching.upsert(old, new, ["k"], {"v": "overwrite", "n": "sum", "s": "sticky:verified"})
    assert sorted(map(tuple, out.collect())) == [(1, "z", 6, "verified"), (2, None, 10, "verified"), (3, "c", 1, "y")]


def test_community(spark):
    posts = spark.createDataFrame([(1, 1, "RT @a: New  item! https://x.com/a #tag"), (2, 2, "new item"), (3, 3, "other")], "post_id int, posted_at int, text string")
    assert sorted(map(tuple, community.first_posts(posts).select("post_id", "duplicate_count").collect())) == [(1, 1), (3, 0)]
    assert values(spark, ["see https://www.X.com/a/, http://x.com/a?utm_source=1", "none"], community.links(t())) == [["https://x.com/a"], []]


def test_entry(spark):
    assert core.flagship(spark, SF).columns == ["seq", "offer_id", "source_id", "observed_at", "type", "from_state", "to_state", "price"]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for name_ in ("events", "lineitem", "orders", "supplier", "part", "pages", "documents", "conversations", "benchmark"):
        db.execute(f"create view {name_} as select * from '{SF}/{name_}.parquet'")
    cursor = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))
