"""Carried offers, snapshots by batch, deliveries, matches after changes, and retention, against one pass over everything."""

import datetime
import os
import random

from pyspark.sql import functions as F

from listingwatch.operators import carried, rules, timeline, watch
from listingwatch.plans import carrying
from listingwatch.sources import tables
from listingwatch.streaming import jobs, sinks

OBSERVED = "offer_id long, source_id long, seq long, observed_at timestamp_ntz, price double, availability string"


def made_observations(seed=1, n=700):
    rng = random.Random(seed)
    at, rows = datetime.datetime(2024, 1, 1), []
    for seq in range(n):
        at += datetime.timedelta(minutes=rng.choice([0, 1, 30, 200, 500]))
        rows.append((rng.randrange(6), 1, seq, at, rng.choice([None, 10.0, 10.2, 12.0, 0.0]), rng.choice(["in_stock", "in_stock", "out_of_stock", "preorder", "unknown", "coming_soon"])))
    return rows


def test_any_split_of_a_history_equals_one_pass(spark):
    rows = made_observations()
    for confirmations, ends in ((2, [1, 250, 251, 700]), (3, [90, 700])):
        whole = timeline.events(timeline.stable_states(spark.createDataFrame(rows, OBSERVED), confirmations))
        expected = sorted(map(tuple, timeline.cooled(whole, 6).collect()), key=str)
        state, found, start = carried.nothing_carried(spark), [], 0
        for end in ends:
            events, after, late = carried.advance(state, spark.createDataFrame(rows[start:end], OBSERVED), confirmations)
            assert late.count() == 0
            found += map(tuple, events.select(*timeline.cooled(whole, 6).columns).collect())
            state, start = tables.cut(after, "state"), end
        assert sorted(found, key=str) == expected
        last = {r["offer_id"]: r for r in timeline.stable_states(spark.createDataFrame(rows, OBSERVED), confirmations).orderBy("observed_at", "seq").collect()}
        for r in state.collect():
            one = last[r["offer_id"]]
            assert (r["stable"], r["candidate"], r["candidate_count"], r["price"], r["seq"]) == (one["stable"], one["candidate"], one["candidate_count"], one["price"], one["seq"])


def test_observations_that_are_not_newer_change_nothing(spark):
    rows = made_observations(n=40)
    _, state, _ = carried.advance(carried.nothing_carried(spark), spark.createDataFrame(rows, OBSERVED))
    state = tables.cut(state, "state")
    events, after, late = carried.advance(state, spark.createDataFrame(rows[5:], OBSERVED))
    assert events.count() == 0 and late.count() == 35
    assert sorted(map(str, after.collect())) == sorted(map(str, state.collect()))
    events, after, late = carried.advance(state, spark.createDataFrame([], OBSERVED))
    assert events.count() == 0 and late.count() == 0 and after.count() == state.count()


SNAP, RULES = "k long, n long, low long", {"n": "sum", "low": "least"}


def test_a_repeated_batch_changes_no_snapshot(spark):
    table = tables.new_folder(spark, "snapshot")
    batch = lambda rows: spark.createDataFrame(rows, SNAP)
    assert sinks.snapshot(spark, table, SNAP).count() == 0
    assert sinks.upsert_batch(batch([(i, 1, i) for i in range(20)]), 0, table, SNAP, ["k"], RULES, 4)
    assert not sinks.upsert_batch(batch([(i, 1, i) for i in range(20)]), 0, table, SNAP, ["k"], RULES, 4)
    before = sinks.snapshot(spark, table, SNAP)
    assert sinks.upsert_batch(batch([(3, 5, 1), (99, 1, 1)]), 1, table, SNAP, ["k"], RULES, 4)
    assert before.count() == 20  # a reader of the version before goes on
    now = {r["k"]: (r["n"], r["low"]) for r in sinks.snapshot(spark, table, SNAP).collect()}
    assert len(now) == 21 and now[3] == (6, 1) and now[99] == (1, 1) and now[4] == (1, 4)
    assert sinks.upsert_batch(batch([]), 2, table, SNAP, ["k"], RULES, 4)
    assert sinks.snapshot(spark, table, SNAP).count() == 21


def test_a_batch_cut_off_before_its_version_is_written_is_done_again(spark):
    table = tables.new_folder(spark, "snapshot")
    sinks.upsert_batch(spark.createDataFrame([(1, 1, 1)], SNAP), 0, table, SNAP, ["k"], RULES, 2)
    sinks.upsert_batch(spark.createDataFrame([(1, 1, 0)], SNAP), 1, table, SNAP, ["k"], RULES, 2)
    os.remove(f"{table.removeprefix('file://')}/versions/batch=1/_SUCCESS")  # as if the driver had died before
    assert [tuple(r) for r in sinks.snapshot(spark, table, SNAP).collect()] == [(1, 1, 1)]
    assert sinks.upsert_batch(spark.createDataFrame([(1, 1, 0)], SNAP), 1, table, SNAP, ["k"], RULES, 2)
    assert [tuple(r) for r in sinks.snapshot(spark, table, SNAP).collect()] == [(1, 2, 0)]


def receiver_of(folder, faults=0):
    """Keeps a line for each call, and a file for each key."""

    def take(row):
        key = f"{row['channel']}-{row['dedup_key']}"
        with open(f"{folder}/calls", "a") as calls:
            calls.write(key + "\n")
        if row["channel"] == "bad" and row["attempt"] <= faults:
            raise ConnectionError("busy")
        open(f"{folder}/{key}", "w").close()
        return "skipped" if row["channel"] == "off" else None

    return take


def test_a_delivery_cut_off_between_call_and_record_is_made_once(spark, tmp_path):
    folder, receiver = tables.new_folder(spark, "outbox"), receiver_of(str(tmp_path), faults=2)
    rows = lambda *keys: spark.createDataFrame([(c, k, "t", "b") for k in keys for c in ("good", "bad", "off")], sinks.DELIVERY)
    assert sinks.deliver_batch(rows("a", "b"), 0, folder, receiver)
    os.remove(f"{folder.removeprefix('file://')}/results/batch=0/_SUCCESS")  # called, but never recorded
    assert sinks.deliver_batch(rows("a", "b"), 0, folder, receiver)
    assert not sinks.deliver_batch(rows("a", "b"), 0, folder, receiver)
    assert sinks.deliver_batch(rows("b", "c"), 1, folder, receiver)  # b is known
    assert sinks.deliver_batch(rows(), 2, folder, receiver)  # nothing new: what failed is tried again
    assert sinks.deliver_batch(rows(), 3, folder, receiver)
    calls = open(tmp_path / "calls").read().split()
    assert calls.count("good-a") == 2 and calls.count("good-c") == 1  # at least once; the keys make it once
    assert calls.count("bad-a") == 2 + 2 and calls.count("bad-c") == 3
    tries = sinks.results(spark, folder)
    assert tries.where("status = 'sent'").groupBy("channel", "dedup_key").count().where("count > 1").count() == 0
    assert tries.where("status in ('sent', 'skipped')").count() == 9 and sinks.open_deliveries(spark, folder).count() == 0


def test_streams_go_on_over_restarts(spark, tmp_path):
    source, table, folder = str(tmp_path / "in"), tables.new_folder(spark, "snapshot"), tables.new_folder(spark, "outbox")
    receiver = receiver_of(str(tmp_path), faults=1)
    for n in range(3):
        spark.createDataFrame([(n, 1, n), (7, 1, n)], SNAP).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SNAP).parquet(source)
        sinks.upsert_stream(stream, table, SNAP, ["k"], RULES, lambda b: b.groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low")))
        letters = stream.select(F.lit("bad").alias("channel"), F.col("k").cast("string").alias("dedup_key"), F.lit("t").alias("title"), F.lit("b").alias("body"))
        sinks.delivery_stream(letters, folder, receiver)
    assert {tuple(r) for r in sinks.snapshot(spark, table, SNAP).collect()} == {(0, 1, 0), (1, 1, 1), (2, 1, 2), (7, 3, 0)}
    assert {r["dedup_key"] for r in sinks.open_deliveries(spark, folder).collect()} == {"2"}


def test_rematching_equals_matching_anew_after_each_of_three_changes(spark):
    rng = random.Random(6)
    words = ["dran", "hells", "sword", "chain", "red", "wand"]
    product = lambda i: (i, [" ".join(rng.choices(words, k=3))], [f"49{i % 5}"])
    rule = lambda i: (i, rng.choices(words, k=2), rng.choice(["contains", "regex", "exact"]), rng.choice([None, f"49{i % 5}"]))
    products, asked = {i: product(i) for i in range(60)}, {i: rule(i) for i in range(30)}
    context = lambda: spark.createDataFrame(list(products.values()), "product_id long, base_values array<string>, barcodes array<string>")
    wanted = lambda: spark.createDataFrame(list(asked.values()), "rule_id long, keywords array<string>, mode string, barcode string")
    known = tables.cut(rules.match_rules(context(), wanted()), "known")
    for step in range(3):
        before = context(), wanted()
        if step != 1:
            products |= {i: product(i) for i in rng.sample(range(70), 12)}
            del products[rng.choice(list(products))]
        if step != 0:
            asked |= {i: rule(i) for i in rng.sample(range(36), 6)}
            del asked[rng.choice(list(asked))]
        now = context(), wanted()
        known = tables.cut(watch.rematch(known, *now, watch.changed_keys(before[0], now[0], "product_id"), watch.changed_keys(before[1], now[1], "rule_id")), "known")
        assert sorted(map(str, known.collect())) == sorted(map(str, rules.match_rules(*now).collect()))


def test_retention_goes_on_over_restarts(spark, tmp_path):
    at = lambda day: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
    batches = [
        [(1, at(0), "Same text", 7), (2, at(3), "same  TEXT", 7), (3, at(1), "other", 400), (4, None, "x", 7)],
        [(1, at(4), "same text", 7), (5, at(8), "same text", 1), (6, at(9), "third", None)],
        [(7, at(40), "fourth", 7), (7, at(41), "fourth", 7)],
    ]
    table, source = str(tmp_path / "kept"), str(tmp_path / "posts")
    for rows in batches:
        spark.createDataFrame(rows, "post_id long, posted_at timestamp, text string, retention_days int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("post_id long, posted_at timestamp, text string, retention_days int").parquet(source)
        out = jobs.drain(jobs.retained_posts(stream), "kept", table)
    got = sorted((r["post_id"], r["what"], (r["at"] - at(0)).days) for r in out.collect())
    assert got == [(1, "deleted", 7), (1, "kept", 0), (3, "kept", 1), (5, "deleted", 15), (5, "kept", 8), (6, "deleted", 16), (6, "kept", 9), (7, "kept", 40)]


def test_retention_of_a_table_in_many_files_without_order(spark, tmp_path):
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    posts = [(i, start + datetime.timedelta(hours=rng.randrange(720)), f"text {i % 3}", 7) for i in range(70)]
    ends = datetime.timedelta(days=7)
    posts += [(70, start + datetime.timedelta(days=40) - ends, "ends with the watermark", 7), (71, start + datetime.timedelta(days=40, hours=1), "newest", 7)]
    path = f"file://{tmp_path}/posts"
    for part in range(2):
        spark.createDataFrame(posts[part::2], "post_id long, posted_at timestamp, text string, retention_days int").repartition(36, "post_id").write.option("maxRecordsPerFile", 1).mode("append").parquet(path)
    assert spark.read.parquet(path).select("_metadata.file_name").distinct().count() > 64
    out = jobs.drain(jobs.retained_posts(jobs.read_parquet(spark, path)), "kept", str(tmp_path / "kept"))
    expected, kept = set(), {}
    for i, at, text, _ in sorted(posts, key=lambda p: (p[1], p[0])):
        if text in kept and at < kept[text][1] + ends:
            continue
        if text in kept:
            expected.add((kept[text][0], kept[text][1] + ends, "deleted"))
        kept[text] = (i, at)
        expected.add((i, at, "kept"))
    watermark = max(p[1] for p in posts) - datetime.timedelta(hours=1)
    expected |= {(i, at + ends, "deleted") for i, at in kept.values() if at + ends < watermark}
    assert {(r["post_id"], r["at"], r["what"]) for r in out.collect()} == expected


def test_registered_names():
    assert set(carrying.ORACLE_SQL) == set(carrying.QUERIES)
