"""Offers over time: stable state, price significance, events, cooldown, freshness, health.

An observation is (offer_id, source_id, seq, observed_at, price, availability); (observed_at, seq) is its order.
All windows share the partitioning on the offer, so Catalyst sorts and shuffles once. One offer's history is
bounded by how often a shop is scanned, so an offer is never a hot key in the way a source or a type is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUYABLE = ("in_stock", "preorder")


def history(*keys: str):
    return Window.partitionBy(*(keys or ("offer_id",))).orderBy("observed_at", "seq")


def stable_states(obs: DataFrame, confirmations: int = 2) -> DataFrame:
    """Adds stable (changes only after so many equal observations in a row), candidate and candidate_count.

    The window form: rows of equal availability in a row are a run; a row confirms its state if it is the first of the
    offer or at least the k-th of its run; the stable state is the last confirmed one.
    """
    w = history()
    changed = F.coalesce(F.lag("availability").over(w) != F.col("availability"), F.lit(True))
    runs = obs.withColumn("run", F.sum(changed.cast("int")).over(w)).withColumn("nth", F.row_number().over(w))
    length = F.row_number().over(history("offer_id", "run"))
    runs = runs.withColumn("run_length", length)
    confirmed = F.when((F.col("nth") == 1) | (F.col("run_length") >= confirmations), F.col("availability"))
    stable = F.last(confirmed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    pending = F.col("availability") != F.col("stable")
    out = runs.withColumn("stable", stable)
    return out.withColumns({"candidate": F.when(pending, F.col("availability")), "candidate_count": F.when(pending, F.col("run_length")).otherwise(0)}).drop("run", "run_length")


def price_moved(price: Column, before: Column, threshold: float) -> Column:
    most = F.greatest(F.abs(price), F.abs(before))
    both = F.when(most == 0, False).otherwise(F.abs(price - before) / most >= threshold)
    return F.when(price.isNull() & before.isNull(), False).when(price.isNull() | before.isNull(), True).otherwise(both)


def events(stable: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Change events of stable_states' rows: first sight, transitions, price changes; at most two a row.

    Where rows have a product_id, the observation that created its product is a discovery (`discoveries`) and no first sight.
    """
    w = history()
    before = F.lag("stable").over(w)
    seen = stable.withColumns({"from_state": before, "price_before": F.lag("price").over(w)})
    to = F.col("stable")
    first = F.when(to == "in_stock", "became_available").when(to == "preorder", "preorder_open").when(to == "coming_soon", "coming_soon")
    back = F.col("from_state").isin("out_of_stock", "unknown", "discovered")
    moved = (
        F.when((to == "in_stock") & back, "back_in_stock")
        .when(to == "in_stock", "became_available")
        .when(to == "preorder", "preorder_open")
        .when(to == "coming_soon", "coming_soon")
        .when((to == "out_of_stock") & F.col("from_state").isin(*BUYABLE), "out_of_stock")
    )
    created = F.lit(False)
    if "product_id" in stable.columns:
        creators = discoveries(stable.where("nth = 1")).select(F.col("product_id").alias("of_product"), F.col("seq").alias("created_by"))
        seen = seen.join(creators, F.col("product_id") == F.col("of_product"), "left")
        created = F.col("seq").eqNullSafe(F.col("created_by"))
    change = F.when(F.col("nth") == 1, F.when(~created, first)).when(F.col("from_state") != to, moved)
    price = F.when((F.col("nth") > 1) & to.isin(*BUYABLE) & price_moved(F.col("price"), F.col("price_before"), threshold), "price_change")
    kinds = F.array_compact(F.array(change, price))
    return seen.withColumn("type", F.explode(kinds)).select("seq", "offer_id", "source_id", "observed_at", "type", "from_state", F.col("stable").alias("to_state"), "price")


def cooled(found: DataFrame, hours: int = 6) -> DataFrame:
    """Events that no emitted event of the same offer and type precedes within the cooldown; suppressed ones do not
    extend it, so this is a fold over an offer's events of a type, in order. It keeps the time of one event as it streams
    through sorted partitions; equal times are in the order of seq."""
    pause = hours * 3_600_000_000

    def run(batches):
        key, last = None, None
        for batch in batches:
            kept = []
            times = batch.column("observed_at").cast(pa.timestamp("us")).cast(pa.int64())
            for offer, kind, at in zip(batch.column("offer_id").to_pylist(), batch.column("type").to_pylist(), times.to_pylist(), strict=True):
                emit = (offer, kind) != key or at is None or last is None or at > last + pause
                if emit:
                    key, last = (offer, kind), at
                kept.append(emit)
            yield batch.filter(pa.array(kept, pa.bool_()))

    columns = ["seq", "offer_id", "source_id", "observed_at", "type", "from_state", "to_state", "price"]
    rows = found.select(*columns).repartition("offer_id", "type").sortWithinPartitions("offer_id", "type", "observed_at", "seq")
    return rows.mapInArrow(run, rows.schema)


def latest_offers(stable: DataFrame) -> DataFrame:
    """One row an offer: newest price and state, first and last sight, last change of the stable state."""
    w = history()
    changed = F.coalesce(F.lag("stable").over(w) != F.col("stable"), F.lit(True))
    rows = stable.withColumn("changed_at", F.when(changed, F.col("observed_at")))
    order = F.struct("observed_at", "seq")
    newest = lambda c: F.max_by(c, order).alias(c)
    return rows.groupBy("offer_id", "source_id").agg(
        newest("price"), newest("availability"), newest("stable"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.max("changed_at").alias("last_changed"), F.count("*").alias("observations")
    )


def presence(seen: DataFrame, scans: DataFrame, most_misses: int = 3) -> DataFrame:
    """Misses of each offer after its source's last successful scan, without pairing offers with scans.

    seen: (source_id, scan_id, offer_id, terminal), scans: (source_id, scan_id) that succeeded. Misses are scans since the
    last sighting that was not terminal; an offer never well seen counts from its first sighting. Archived from the
    scan that makes most_misses.
    """
    ranked = scans.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy("scan_id")))
    last = ranked.groupBy("source_id").agg(F.max("rank").alias("last_rank"))
    good = F.max(F.when(~F.col("terminal"), F.col("rank")))
    offers = seen.join(ranked, ["source_id", "scan_id"]).groupBy("source_id", "offer_id").agg(F.coalesce(good, F.min("rank") - 1).alias("good_rank"), F.max_by("terminal", "rank").alias("terminal"))
    out = offers.join(last, "source_id").withColumn("misses", F.col("last_rank") - F.col("good_rank"))
    gone = ranked.select("source_id", F.col("rank").alias("gone_rank"), F.col("scan_id").alias("archived_scan"))
    out = out.withColumn("gone_rank", F.col("good_rank") + most_misses).join(gone, ["source_id", "gone_rank"], "left")
    state = F.when(F.col("misses") == 0, "fresh").when(F.col("misses") < most_misses, "stale").otherwise("archived")
    reason = F.when(F.col("misses") >= most_misses, F.when(F.col("terminal"), "terminal_signal").otherwise("missing_from_successful_scan"))
    return out.select("source_id", "offer_id", "misses", state.alias("freshness"), "archived_scan", reason.alias("archive_reason"))


def source_health(runs: DataFrame, unhealthy: int = 3) -> DataFrame:
    """(source, at, seq, ok) -> consecutive failures since the last success, and whether that is too many.

    Two aggregates over the runs and no window: a source may hold any share of the rows.
    """
    order = F.struct("at", "seq")
    success = runs.where("ok").groupBy("source").agg(F.max(order).alias("last_ok"))
    known = runs.select("source").distinct().join(success, "source", "left")
    after = runs.join(success, "source", "left").where(~F.col("ok") & (F.col("last_ok").isNull() | (order > F.col("last_ok"))))
    failures = after.groupBy("source").agg(F.count("*").alias("failures"))
    n = F.coalesce("failures", F.lit(0))
    return known.join(failures, "source", "left").select("source", n.alias("failures"), F.col("last_ok.at").alias("last_success"), (n >= unhealthy).alias("unhealthy"))


def expire(offers: DataFrame, now: Column) -> DataFrame:
    """Fresh offers past their fresh_until (or without one) become stale and not purchasable, as of `now`."""
    over = (F.col("freshness") == "fresh") & (F.col("fresh_until").isNull() | (F.col("fresh_until") <= now))
    return offers.withColumns({"freshness": F.when(over, "stale").otherwise(F.col("freshness")), "purchasable": F.when(over, False).otherwise(F.col("purchasable"))})


def discoveries(stable: DataFrame) -> DataFrame:
    """One `product_discovered` a product: its first observation. stable_states' rows with a product_id."""
    order = F.struct("observed_at", "seq")
    first = stable.where("product_id is not null").groupBy("product_id").agg(F.min_by(F.struct("seq", "offer_id", "observed_at", "stable"), order).alias("o"))
    return first.select("product_id", "o.seq", "o.offer_id", "o.observed_at", F.lit("product_discovered").alias("type"), F.col("o.stable").alias("to_state"))


def failed_scan(offers: DataFrame, failures: DataFrame, most_misses: int = 3) -> DataFrame:
    """Misses after failed scans: only `not_found` of a source with exactly one offer counts, as then the page is the offer.

    offers: (source_id, offer_id, misses, freshness), failures: (source_id, error_class), one row a source.
    """
    only = offers.groupBy("source_id").agg((F.count("*") == 1).alias("only"))
    gone = F.coalesce(F.col("only") & F.col("error_class").isin("not_found", "http_404", "http_410"), F.lit(False))
    joined = offers.join(only, "source_id").join(failures.select("source_id", "error_class"), "source_id", "left").withColumn("misses", F.col("misses") + gone.cast("int"))
    state = F.when(gone & (F.col("misses") >= most_misses), "archived").when(gone, "stale").otherwise(F.col("freshness"))
    return joined.select("source_id", "offer_id", "misses", state.alias("freshness"), F.when(gone & (F.col("misses") >= most_misses), "http_not_found").alias("archive_reason"))
