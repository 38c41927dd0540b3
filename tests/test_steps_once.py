"""What several steps read is made once, and equal rows are brought together before texts are sorted."""

import re

import pytest
from pyspark.sql import functions as F

from listingwatch.operators import carried, catalog, community, frontier, matching
from listingwatch.plans import covering, reviewing, storing, views, watching
from listingwatch.sources import stored
from listingwatch.sources.tables import cut

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("made", [catalog.link_listings, catalog.aliases, lambda rows: catalog.evidence(rows.withColumns({"url": F.lit("u"), "source_class": F.lit("c"), "verification": F.lit("verified")}))])
def test_equal_statements_are_counted_by_hash_before_texts_are_sorted(spark, made):
    physical = made(watching.catalog_rows(spark, SF))._jdf.queryExecution().sparkPlan().toString()
    kinds = [line.split("Aggregate(")[0].split()[-1] for line in physical.split("\n") if "Aggregate(" in line and "model" in line]
    assert kinds[-1] == "Hash" and "Sort" in kinds


def test_links_of_walks_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    walks = spark.createDataFrame([(1, "a", "r", "m", 9, 9, 10**9, 1e9, 1.0, False)], "walk_id long, seed string, robots_url string, sitemap_url string, max_pages int, max_depth int, max_bytes long, max_seconds double, min_interval double, active_recipe boolean")
    pages = spark.createDataFrame([(u, 200, 1, 1.0, True, False) for u in "rmabcd"], "url string, status int, bytes long, seconds double, allowed boolean, candidate boolean")
    links = spark.createDataFrame([("a", 0, "b", "page", 50), ("b", 0, "c", "page", 50), ("c", 0, "d", "page", 50)], "url string, nth long, target string, kind string, priority int")
    found, _ = frontier.best_first(walks, pages, links.mapInPandas(counted, links.schema))
    assert sorted((r["url"], r["place"]) for r in found.collect()) == [("a", 3), ("b", 4), ("c", 5), ("d", 6), ("m", 2), ("r", 1)]
    assert made.value == 3


def test_carried_events_are_folded_once(spark):
    rows = spark.createDataFrame([(1, 1, i, f"2024-01-0{i + 1} 00:00:00", 1.0, "in_stock") for i in range(3)], "offer_id long, source_id long, seq long, observed_at string, price double, availability string")
    events, state, _ = carried.advance(carried.nothing_carried(spark), rows.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz")))
    assert "MapInArrow" not in plan(events) and "MapInArrow" not in plan(state) and "Window" not in plan(state)
    assert [r["type"] for r in events.collect()] == ["became_available"]


def test_offers_of_failed_scans_are_made_once(spark):
    assert not [f for f in covering.f3_failed_scans(spark, SF).inputFiles() if "lineitem" in f]


def test_stored_frames_are_parsed_once_for_all_triggers(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(stored, "replay", lambda found, start: seen.append(found) or found.withColumn("step", F.lit(0)))
    monkeypatch.setattr(storing.jobs, "drain", lambda *args: None)
    storing.s1_replayed_frames(spark, SF)
    assert all(f.endswith(".parquet") for f in seen[0].inputFiles())


def test_a_text_is_laid_bare_once(spark):
    posts = spark.createDataFrame([(1, 1, "s", 1, "é a - b https://x.example/1 #tag"), (2, 2, "s", 2, "RT @x: É  A-B\t")], "post_id long, posted_at long, source_id string, external_id long, text string")
    assert plan(community.first_posts(posts)).count("https?://") == 1
    assert [(r["post_id"], r["duplicate_count"]) for r in community.first_posts(cut(posts, "posts")).collect()] == [(1, 1)]


def test_only_posts_of_the_report_are_matched(spark):
    posts = spark.createDataFrame([(i, i, "text", i == 9) for i in range(10)], "post_id long, posted_at long, text string, hidden boolean")
    asked = []
    found = community.visible_posts(posts, lambda shown: asked.extend(r[0] for r in shown.collect()) or shown.select(F.lit(7).alias("rule_id"), "post_id"), 3)
    assert sorted(asked) == [6, 7, 8] and sorted((r["post_id"], r["rules"]) for r in found.collect()) == [(i, [7]) for i in (6, 7, 8)]


def test_announcements_are_aggregated_by_hash_without_texts(spark):
    physical = reviewing.k7_announcements(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    over = [line for line in physical.split("\n") if "Aggregate(" in line and "event_type" in line]
    assert over and all("HashAggregate" in line and "title" not in line for line in over)


def test_tasks_of_announcements_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(reviewing, "LINES_A_TASK", 1000)
    physical = reviewing.k7_announcements(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(l_partkey#\d+L, (\d+)\)", physical) == [str(spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000)]


def test_announcements_of_repeated_and_blank_lines(spark, tmp_path):
    line = [(3, 1), (3, 1), (53, 1), (103, 1), (11, 1), (4, 1), (7, 1), (None, 1), (3, None)]
    part = [(3, "a", "T", 10.0), (53, "b", "T", 20.0), (53, None, "T", 30.0), (103, None, "T", 1.0), (11, "c", "T", 1.0), (4, " ", " ", 1.0)]
    spark.createDataFrame(line, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_retailprice double").selectExpr("*", "'B' as p_brand", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = sorted(map(tuple, reviewing.k7_announcements(spark, str(tmp_path)).collect()), key=repr)
    assert found == [(300001, 1, "https://maker.example/3", "preorder", "CX-153", "b T", 20.0, 1), (None, None, "https://maker.example/3", "announced", None, None, None, None)]


def test_listings_of_any_number_are_joined_by_sort(spark):
    """By the size of their files Spark would broadcast parts with their texts, and listings with their keys."""
    texts = views.feed(spark, SF, of_stated={"made": F.upper("availability_text")})
    rows = cut(texts.select("listing_id", "source_id", F.col("listing_id").cast("string").alias("url"), "barcode", "sku", F.lit("m").alias("model"), "brand", F.lit("v").alias("variant"), "part"), "rows")
    offers = rows.where("listing_id % 3 = 0").select("source_id", "url", F.col("part").alias("product_id"))
    products = rows.select(F.col("listing_id").alias("product_id"), *matching.ASKED)
    for made in (texts, matching.match_products(rows, products), matching.resolve_known(rows, offers, products)):
        physical = made._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in physical and "Broadcast" not in physical
