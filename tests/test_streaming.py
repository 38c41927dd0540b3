"""Streaming forms against their batch forms, in several micro-batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from listingwatch.operators import timeline
from listingwatch.streaming import jobs

COLUMNS = ["seq", "offer_id", "source_id", "observed_at", "type", "from_state", "to_state", "price"]


def collected(df):
    return sorted(map(repr, (tuple(r) for r in df.select(COLUMNS).collect())))


def test_offer_events_over_micro_batches(spark, tmp_path):
    rng = random.Random(5)
    states = ("in_stock", "out_of_stock", "preorder", "coming_soon", "unknown")
    rows = [(i, rng.randrange(12), 3, datetime(2024, 1, 1) + timedelta(minutes=37 * (i // 2)), rng.choice((None, 0.0, 10.0, 10.2, 30.0)), rng.choice(states[: rng.choice((2, 5))])) for i in range(900)]
    obs = spark.createDataFrame(rows, "seq long, offer_id long, source_id long, observed_at timestamp_ntz, price double, availability string")
    folder, table = str(tmp_path / "in"), str(tmp_path / "out")
    for at in range(0, 900, 300):
        obs.where(f"seq between {at} and {at + 299}").coalesce(1).write.mode("append").parquet(folder)
        # a later call goes on from the state of the one before
        found = jobs.drain(jobs.offer_events(jobs.read_parquet(spark, folder, 1)), "t", table)
    assert collected(found) == collected(timeline.cooled(timeline.events(timeline.stable_states(obs)), 6))
    late = [(1000, rows[0][1], 3, datetime(2023, 1, 1), 1.0, "in_stock"), (1001, None, 3, datetime(2025, 1, 1), 1.0, "in_stock")]
    spark.createDataFrame(late, obs.schema).write.mode("append").parquet(folder)
    again = jobs.drain(jobs.offer_events(jobs.read_parquet(spark, folder, 1)), "t", table)
    assert [(r.seq, r.type) for r in again.where("type = 'late'").collect()] == [(1000, "late")] and again.count() == found.count() + 1


def test_fresh_posts(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, datetime(2024, 1, 1), "RT @a: New item"), (2, datetime(2024, 1, 1, 1), "other")], [(3, datetime(2024, 1, 1, 2), "new  item!"), (4, datetime(2024, 1, 1, 3), None)]]
    for rows in batches:
        spark.createDataFrame(rows, "post_id long, posted_at timestamp, text string").coalesce(1).write.mode("append").parquet(folder)
        found = jobs.drain(jobs.fresh_posts(jobs.read_parquet(spark, folder), "1 day"), "t", table)
    assert sorted(r.post_id for r in found.collect()) == [1, 2, 4]


def test_component_windows(spark, tmp_path):
    rows = [("parser", "failed", datetime(2024, 1, 1)), ("parser", "success", datetime(2024, 1, 2)), ("parser", "success", datetime(2024, 2, 1))]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "component string, status string, created_at timestamp_ntz").write.parquet(folder)
    found = jobs.drain(jobs.component_windows(jobs.read_parquet(spark, folder)), "t", str(tmp_path / "out"))
    out = {r.since: (r.total, r.failed) for r in found.collect()}
    assert out[datetime(2024, 1, 1)] == (2, 1) and out[datetime(2024, 1, 2)] == (1, 0) and len(out) == 8
    assert found.where(F.col("since") > datetime(2024, 1, 20)).count() == 0
