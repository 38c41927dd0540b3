"""Streaming forms: change events of offers, sliding component metrics, posts without repeats.

Each takes a streaming DataFrame and returns one; `drain` runs a stream over what has arrived, into a table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.community import content_fingerprint
from ..sources.tables import new_folder

EVENT = {"seq": "long", "offer_id": "long", "source_id": "long", "at": "long", "type": "string", "from_state": "string", "to_state": "string", "price": "double"}
# stable, candidate and its count, last price (and whether there was one), last (at, seq), types with their last emission
STATE = "stable string, candidate string, count int, price double, at long, seq long, types array<string>, emitted array<long>"
# What a change to a state is called; a return to stock depends on where it comes from.
FIRST = {"in_stock": "became_available", "preorder": "preorder_open", "coming_soon": "coming_soon"}
GONE = ("out_of_stock", "unknown", "discovered")
BUYABLE = ("in_stock", "preorder")


def change(before: str, after: str) -> str | None:
    if after == "in_stock" and before in GONE:
        return "back_in_stock"
    if after == "out_of_stock":
        return "out_of_stock" if before in BUYABLE else None
    return FIRST.get(after)


def moved(price: float | None, before: float | None, threshold: float) -> bool:
    if price is None or before is None:
        return price is not before
    most = max(abs(price), abs(before))
    return most > 0 and abs(price - before) / most >= threshold


def offer_events(observations: DataFrame, confirmations: int = 2, threshold: float = 0.05, cooldown_hours: int = 6) -> DataFrame:
    """Change events after confirmation and cooldown, as the batch form finds them, from a stream of observations.

    State is one small row an offer. A micro-batch's rows of an offer are taken in the order of (observed_at, seq). A row
    older than what its offer has already seen changes no state; it comes out with type `late`, for a batch repair.
    """
    cooldown = cooldown_hours * 3_600_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stable = candidate = last_price = None
        n, last, emitted = 0, None, {}
        if state.exists:
            stable, candidate, n, last_price, at, seq, types, times = state.get
            last, emitted = (at, seq), dict(zip(types, times))
        out = []
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        for at, seq, source, price, seen in rows[["at", "seq", "source_id", "price", "availability"]].itertuples(index=False):
            at, seq, price = int(at), int(seq), None if pd.isna(price) else float(price)
            if last is not None and (at, seq) < last:
                out.append((seq, key[0], source, at, "late", None, seen, price))
                continue
            found = []
            before = stable
            if stable is None:
                stable = seen
                found.append(FIRST.get(seen))
            else:
                n = 0 if seen == stable else n + 1 if seen == candidate else 1
                candidate = None if seen == stable else seen
                if n >= confirmations:
                    stable, candidate, n = seen, None, 0
                    found.append(change(before, stable))
                if stable in BUYABLE and moved(price, last_price, threshold):
                    found.append("price_change")
            for kind in filter(None, found):
                if kind not in emitted or at > emitted[kind] + cooldown:
                    emitted[kind] = at
                    out.append((seq, key[0], source, at, kind, before, stable, price))
            last, last_price = (at, seq), price
        if last is not None:
            state.update((stable, candidate, n, last_price, *last, list(emitted), list(emitted.values())))
        yield pd.DataFrame(out, columns=list(EVENT))

    rows = observations.where("offer_id is not null and observed_at is not null and availability is not null").select(
        F.col("offer_id").cast("long"), F.col("source_id").cast("long"), F.col("seq").cast("long"), F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"), "price", "availability"
    )
    found = rows.groupBy("offer_id").applyInPandasWithState(step, ", ".join(f"{c} {t}" for c, t in EVENT.items()), STATE, "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("observed_at", F.timestamp_micros("at").cast("timestamp_ntz")).drop("at")


FRESHNESS = "offer_id long, at long, freshness string"


def freshness_changes(sightings: DataFrame, seconds: int, delay: str = "1 hour") -> DataFrame:
    """(offer_id, at, freshness): when offers become fresh, and when they expire for want of a sighting.

    sightings: (offer_id, observed_at). State is one time an offer: until when it is fresh. A timer on event time lets it
    expire once the watermark has passed that time, without any further row; a gap within a micro-batch shows as well.
    Rows older than the watermark don't count. Times are taken to the millisecond, as timers are.
    """
    length = seconds * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        out = []
        if not state.hasTimedOut:
            for at in sorted(int(t) for frame in frames for t in frame["ms"]):
                if until is not None and at > until:
                    out.append((key[0], until, "stale"))
                    until = None
                if until is None:
                    out.append((key[0], at, "fresh"))
                until = max(until or 0, at + length)
        if until is not None and until < state.getCurrentWatermarkMs():
            out.append((key[0], until, "stale"))
            until = None
        if until is not None:
            state.update((until,))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["offer_id", "at", "freshness"])

    rows = sightings.where("offer_id is not null and observed_at is not null").select(F.col("offer_id").cast("long"), F.col("observed_at").cast("timestamp").alias("seen"))
    rows = rows.withWatermark("seen", delay).withColumn("ms", F.unix_millis("seen"))
    found = rows.groupBy("offer_id").applyInPandasWithState(step, FRESHNESS, "until long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("at", F.timestamp_millis("at").cast("timestamp_ntz"))


def component_windows(ops: DataFrame, delay: str = "1 hour", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Totals by component and sliding window; a window comes out once the watermark has passed its end."""
    rows = ops.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", delay)
    counts = rows.groupBy("component", F.window("at", size, slide).alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.select("component", F.col("w.start").cast("timestamp_ntz").alias("since"), "total", "failed")


def fresh_posts(posts: DataFrame, delay: str) -> DataFrame:
    """Posts whose content no earlier post within the watermark's delay had. posts: (post_id, posted_at timestamp, text)."""
    rows = posts.withColumn("fingerprint", content_fingerprint(F.coalesce("text", F.lit(""))))
    return rows.withWatermark("posted_at", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def read_parquet(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream: one micro-batch of all that is there, or micro-batches of so many files.

    A table's files are in no order of time: cut into micro-batches, rows of a later one are late for the watermark that an
    earlier one has left. `files` is for folders whose files came one after the other. The path is written as a pattern that
    fits only itself: Spark takes a plain path for a folder.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, table: str | None = None, mode: str = "append") -> DataFrame:
    """Runs the stream over all that has arrived and returns its table. With the same `table` a later call goes on where
    this one ended."""
    folder = table or new_folder(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/_checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


KEPT = "fingerprint string, post_id long, at long, what string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retention(StatefulProcessor):
    """State of one content: the post that is kept for it, and until when; a timer of the next millisecond ends both, as timers
    go off when the watermark has come to their time, and a post ends when it has passed."""

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("post_id", T.LongType()), T.StructField("until", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        kept = self.kept.get() if self.kept.exists() else None
        before = kept
        came = itertools.chain.from_iterable(frame[["ms", "post_id", "length"]].itertuples(index=False, name=None) for frame in rows)
        for at, post_id, length in sorted((int(a), int(p), int(n)) for a, p, n in came):
            if kept is not None and at >= kept[1]:
                out.append((key[0], kept[0], kept[1], "deleted"))
                kept = None
            if kept is None:
                kept = (post_id, at + length)
                out.append((key[0], post_id, at, "kept"))
        if kept != before:
            if before is not None:
                self.handle.deleteTimer(before[1] + 1)
            self.kept.update(kept)
            self.handle.registerTimer(kept[1] + 1)
        yield pd.DataFrame(out, columns=["fingerprint", "post_id", "at", "what"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.kept.exists():
            post_id, until = self.kept.get()
            out.append((key[0], post_id, until, "deleted"))
            self.kept.clear()
        yield pd.DataFrame(out, columns=["fingerprint", "post_id", "at", "what"])

    def close(self) -> None:
        pass


def retained_posts(posts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(fingerprint, post_id, at, what): posts as they are kept, and as their retention ends them (`deleted`).

    posts: (post_id, posted_at, text, retention_days), retention being held between 7 and 365 days. Of posts with one content
    the first is kept as long as its retention lasts; others within that time are dropped, a later one is kept anew. An event
    timer deletes a post, and its state, once the watermark has passed its end (a life time by the clock, which the state store
    offers too, wouldn't agree with the times of posts). Times are taken to the millisecond. Timers need RocksDB's state store,
    which is set for the session.
    """
    spark = posts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    days = F.least(F.lit(365), F.greatest(F.lit(7), F.coalesce("retention_days", F.lit(7))))
    rows = posts.where("post_id is not null and posted_at is not null").select(content_fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"), F.col("post_id").cast("long"), F.col("posted_at").cast("timestamp").alias("seen"), (days.cast("long") * 86_400_000).alias("length"))
    rows = rows.withWatermark("seen", delay).withColumn("ms", F.unix_millis("seen"))
    found = rows.groupBy("fingerprint").transformWithStateInPandas(Retention(), T.StructType.fromDDL(KEPT), "Append", "EventTime")
    return found.withColumn("at", F.timestamp_millis("at").cast("timestamp_ntz"))
