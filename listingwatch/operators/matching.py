"""Identity joins, watch rules, upserts, digests and reports over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


#: What stands in a key for a product's null, and for any value.
ABSENT, ANY = "absent", "any"
ASKED = ("barcode", "sku", "model", "brand", "variant")
#: Tables between steps are a tenth of their rows' size, and keys grow sixfold after them: by the files' size Spark would broadcast
#: more than a driver can build.
BY_SORT = "shuffle_merge"


def stated(value: Column) -> Column:
    """A value as a part of a key, in which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(ABSENT))


def lookups(name: str) -> Column:
    """The keys of the products that agree with a listing's value: equal ones and those without one; all, if the listing has none."""
    return F.when(F.col(name).isNull(), F.array(F.lit(ANY))).otherwise(F.array(stated(F.lower(name)), F.lit(ABSENT)))


def counted(products: DataFrame, same: dict[str, Column], optional: tuple[str, str]) -> DataFrame:
    """(the names of same, a, b, n, first): how many products have these values, and the first; the two optional values stand
    under their own key and under ANY."""
    row = [c.alias(name) for name, c in same.items()] + [stated(F.lower(c)).alias(x) for c, x in zip(optional, "ab", strict=True)]
    found = products.groupBy(*row).agg(F.count("*").alias("n"), F.min("product_id").alias("first"))
    for x in "ab":
        found = found.withColumn(x, F.explode(F.array(x, F.lit(ANY))))
    return found.groupBy(*same, "a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def match_products(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Listings against a frozen product snapshot: barcode first, then SKU, then model with variant.

    listings: (listing_id, barcode, sku, model, brand, variant), products: the same with product_id. A barcode takes the
    first product; SKU and model need exactly one candidate. Listings that ask the same are resolved once. What may be absent
    on either side is written into the keys: products are counted under their values and under ANY, and whoever asks looks up
    six keys at most. So each join is on whole keys, with one row a key, and a common SKU or model multiplies nothing.
    """
    asked = cut(listings.select(*ASKED).distinct(), "asked")
    barcode = asked.join(products.where("barcode is not null").groupBy("barcode").agg(F.min("product_id").alias("by_barcode")).hint(BY_SORT), "barcode").select(*ASKED, "by_barcode")
    by = lambda rows, kinds, value: rows.groupBy(*ASKED).agg(*kinds).where(value)
    keys = asked.where("sku is not null").withColumn("a", F.explode(lookups("model"))).withColumn("b", F.explode(lookups("brand")))
    sku = keys.join(counted(products.where("sku is not null"), {"sku": F.col("sku")}, ("model", "brand")).hint(BY_SORT), ["sku", "a", "b"])
    sku = by(sku, [F.sum("n").alias("n"), F.min("first").alias("by_sku")], "n = 1").drop("n")
    # an absent variant is equal to an absent one only; under ANY stand all candidates, and a listing without a brand agrees with those
    keys = asked.where("model is not null").withColumn("same_variant", stated(F.col("variant"))).withColumn("a", F.explode(lookups("sku")))
    keys = keys.withColumn("b", F.explode(F.array_distinct(F.concat(F.array(F.lit(ANY)), lookups("brand")))))
    model = keys.join(counted(products.where("model is not null"), {"model": F.col("model"), "same_variant": stated(F.col("variant"))}, ("sku", "brand")).hint(BY_SORT), ["model", "same_variant", "a", "b"])
    every, fits = F.col("b") == ANY, (F.col("b") != ANY) | F.col("brand").isNull()
    counts = [F.sum(F.when(every, F.col("n"))).alias("n"), F.sum(F.when(fits, F.col("n"))).alias("n_fit"), F.min(F.when(fits, F.col("first"))).alias("by_model")]
    model = by(model, counts, (F.col("n_fit") == 1) & ((F.col("n") == 1) | F.col("brand").isNotNull())).drop("n", "n_fit")
    of = asked
    for found in (barcode, sku, model):
        of = joined_same(of, found)
    how = F.when(F.col("by_barcode").isNotNull(), "barcode").when(F.col("by_sku").isNotNull(), "sku").when(F.col("by_model").isNotNull(), "model")
    of = cut(of.select(*ASKED, F.coalesce("by_barcode", "by_sku", "by_model").alias("product_id"), how.alias("matched_by")).where("matched_by is not null"), "resolved")
    return joined_same(listings.select("listing_id", *ASKED), of).select("listing_id", "product_id", "matched_by")


def joined_same(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with found's other columns where all of ASKED are the same, absent ones included."""
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ASKED]
    return rows.alias("l").join(found.alias("r").hint(BY_SORT), same, "left").select("l.*", *[f"r.{c}" for c in found.columns if c not in ASKED])


def resolve_known(listings: DataFrame, offers: DataFrame, products: DataFrame) -> DataFrame:
    """match_products for listings that are no offer yet; a known offer keeps its product (matched_by `offer`), so that
    what a reviewer split or merged outlasts the next scan.

    listings: as in match_products, with (source_id, url); offers: (source_id, url, product_id), one row an offer.
    """
    known = listings.select("listing_id", "source_id", "url").join(offers.select("source_id", "url", F.col("product_id").alias("by_offer")).hint(BY_SORT), ["source_id", "url"])
    rest = listings.join(known.select("listing_id").hint(BY_SORT), "listing_id", "left_anti")
    return known.select("listing_id", F.col("by_offer").alias("product_id"), F.lit("offer").alias("matched_by")).unionByName(match_products(rest, products))


RULES = {
    "overwrite": lambda old, new: F.when(F.col("is_new"), new).otherwise(old),
    "keep_old": lambda old, new: F.when(F.col("is_old"), old).otherwise(new),
    "coalesce_new": lambda old, new: F.coalesce(new, old),
    "coalesce_old": lambda old, new: F.coalesce(old, new),
    "greatest": F.greatest,
    "least": F.least,
    "sum": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """A snapshot after a batch that has one row a key: for each column a rule of RULES, or `sticky:value`."""

    def column(name: str, rule: str) -> Column:
        a, b = F.col(f"old.{name}"), F.col(f"new.{name}")
        if rule.startswith("sticky:"):
            value = F.lit(rule.partition(":")[2])
            return F.when(a.cast("string") == value, a).otherwise(F.coalesce(b, a))
        return RULES[rule](a, b)

    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    joined = old.withColumn("is_old", F.lit(True)).alias("old").join(new.withColumn("is_new", F.lit(True)).alias("new"), same, "full")
    return joined.select(*[F.coalesce(f"new.{k}", f"old.{k}").alias(k) for k in keys], *[column(c, r).alias(c) for c, r in rules.items()])


def digests(offers: DataFrame) -> DataFrame:
    """One text a product: its offers by state, price (null last) and source. offers: (product_id, name, state, price, source)."""
    rank = F.array_position(F.array(*map(F.lit, ("in_stock", "preorder", "coming_soon", "out_of_stock"))), F.col("state"))
    line = F.concat_ws(" ", "source", "state", F.coalesce(F.format_string("%.2f", "price"), F.lit("-")))
    entry = F.struct(F.when(rank == 0, 9).otherwise(rank).alias("rank"), F.col("price").isNull().alias("unpriced"), "price", "source", line.alias("line"))
    return offers.groupBy("product_id").agg(F.max("name").alias("title"), F.array_sort(F.collect_list(entry)).alias("rows")).select("product_id", "title", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))


# How a digest names an event.
EVENT_LABELS = {
    "product_discovered": "🆕 New product", "became_available": "✅ Available", "back_in_stock": "🔁 Back in stock", "preorder_open": "📦 Pre-order open",
    "coming_soon": "🔜 Coming soon", "out_of_stock": "⛔ Out of stock", "price_change": "💲 Price change",
}


def event_digests(events: DataFrame, offers: DataFrame, products: DataFrame, sources: DataFrame) -> DataFrame:
    """(product_id, title, body): one text a product of its pending events: buyable ones first, then by price (null last) and
    source. The title has the model; a line has the event's label, the source, price with currency, and the address below.

    events: (product_id, offer_id, source_id, type, to_state), offers: (offer_id, price, currency, url), products: (product_id,
    name, model), sources: (source_id, source_name).
    """
    events = events.select("product_id", "offer_id", "source_id", "type", "to_state")
    rows = events.join(offers.select("offer_id", "price", "currency", "url"), "offer_id", "left").join(sources.select("source_id", "source_name"), "source_id", "left")
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT_LABELS.items() for x in kv])[F.col("type")], F.col("type"))
    price = F.when(F.col("price").isNotNull(), F.concat(F.lit(" — "), F.rtrim(F.concat_ws(" ", F.format_string("%.2f", "price"), "currency")))).otherwise("")
    line = F.concat(label, F.lit(" @ "), F.coalesce("source_name", F.lit("unknown store")), price, F.coalesce(F.concat(F.lit("\n    "), "url"), F.lit("")))
    rank = F.array_position(F.array(*map(F.lit, ("in_stock", "preorder", "coming_soon"))), F.coalesce("to_state", F.lit("")))
    entry = F.struct(F.when(rank == 0, 4).otherwise(rank).alias("rank"), F.col("price").isNull().alias("unpriced"), "price", F.coalesce("source_name", F.lit("")).alias("source"), line.alias("line"))
    bodies = rows.groupBy("product_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))  # one product's pending events
    title = F.concat(F.coalesce(F.nullif("name", F.lit("")), F.lit("Product")), F.coalesce(F.concat(F.lit(" ("), F.nullif("model", F.lit("")), F.lit(")")), F.lit("")))
    named = bodies.join(products.select("product_id", title.alias("title")), "product_id", "left")
    return named.select("product_id", F.coalesce("title", F.lit("Product")).alias("title"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))


#: Counts of an operation event, and the largest that is believed.
EVENT_COUNTS = ("valid_count", "invalid_count", "failed_count", "page_count", "page_failed_count")
MOST_COUNT = 1_000_000


def rate_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1.0), part / whole)).otherwise(0.0)


def component_metrics(ops: DataFrame, since: Column) -> DataFrame:
    """Per component within the window: totals by status, sums of the five counts (each if it is 0 to MOST_COUNT), rates of failed
    events, items and pages; and of all time the last success, and when, where and of what class the last failure was.

    ops: (seq, component, source_key, status, created_at), and error_class and EVENT_COUNTS, which count as null if absent.
    """
    optional = {"error_class": "string"} | dict.fromkeys(EVENT_COUNTS, "long")
    ops = ops.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in ops.columns})
    inside = F.col("created_at") >= since
    status = lambda s: F.count_if(inside & (F.col("status") == s)).alias(s)
    order = F.struct("created_at", "seq")
    failed = F.col("status") == "failed"
    last = lambda c: F.max_by(F.when(failed, F.col(c)), F.when(failed, order))
    sums = [F.coalesce(F.sum(F.when(inside & F.col(c).between(0, MOST_COUNT), F.col(c))), F.lit(0)).cast("long").alias(c) for c in EVENT_COUNTS]
    out = ops.groupBy("component").agg(
        F.count_if(inside).alias("total"), status("success"), status("failed"), status("skipped"), *sums,
        F.max(F.when(F.col("status") == "success", F.col("created_at"))).alias("latest_success"),
        last("source_key").alias("last_failed_source"), last("error_class").alias("last_error_class"), F.max(F.when(failed, F.col("created_at"))).alias("last_failure"),
    )
    bad = F.col("invalid_count") + F.col("failed_count")
    return out.withColumns({"failure_rate": rate_of(F.col("failed"), F.col("total")), "item_failure_rate": rate_of(bad, bad + F.col("valid_count")), "page_failure_rate": rate_of(F.col("page_failed_count"), F.col("page_count"))})


def top_error_classes(ops: DataFrame, since: Column, n: int = 20) -> DataFrame:
    """The n most frequent (component, error_class) of failures in the window."""
    found = ops.where((F.col("status") == "failed") & F.col("error_class").isNotNull() & (F.col("created_at") >= since)).groupBy("component", "error_class").agg(F.count("*").alias("failures"))
    return newest(found, n, F.desc("failures"), F.col("component"), F.col("error_class"))


def queue_counts(events: DataFrame, notifications: DataFrame, requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: what waits. events: (notified), the others: (status)."""
    one = lambda df, name, hit: df.agg(F.count_if(F.coalesce(hit, F.lit(False))).alias(name))
    status = F.col("status")
    busy = requests.agg(F.count_if(status == "queued").alias("monitor_queued"), F.count_if(status == "running").alias("monitor_running"))
    rows = [one(events, "pending_notifications", ~F.col("notified")), one(notifications, "failed_notifications", status == "failed"), busy, one(candidates, "pending_candidates", status == "pending")]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2]).crossJoin(rows[3])  # one row each


# Limits beyond which operation is degraded.
LIMITS = {"streak": 3, "parser": 0.10, "notification": 0.10, "failed_notifications": 1, "monitor_queue": 50, "stale": 0.20}


def slo_alerts(metrics: DataFrame, health: DataFrame, queues: DataFrame | None = None, freshness: DataFrame | None = None, limits: dict | None = None) -> DataFrame:
    """One row: names of the limits that are passed, in a fixed order, and ok or degraded.

    metrics: component_metrics, health: (failures, and enabled if sources can be switched off), queues: queue_counts, freshness:
    freshness_counts. The parser's rate is the worst of events, items and pages; the stale rate leaves archived offers out.
    """
    limit = LIMITS | (limits or {})
    has_rates = {"item_failure_rate", "page_failure_rate"} <= set(metrics.columns)
    worst = F.greatest("failure_rate", "item_failure_rate", "page_failure_rate") if has_rates else F.col("failure_rate")
    of = lambda name, value: F.max(F.when((F.col("component") == name) & (F.col("total") > 0), value))
    row = metrics.agg(of("parser", worst).alias("parser_rate"), of("notification", F.col("failure_rate")).alias("notification_rate"))
    enabled = health.where("enabled") if "enabled" in health.columns else health
    row = row.crossJoin(enabled.agg(F.max("failures").alias("longest")))
    rules = [("source_failure_streak", F.col("longest") >= limit["streak"]), ("parser_failure_rate", F.col("parser_rate") >= limit["parser"]), ("notification_failure_rate", F.col("notification_rate") >= limit["notification"])]
    if queues is not None:
        row = row.crossJoin(queues)
        waiting = F.col("monitor_queued") + F.col("monitor_running")
        rules += [("notification_queue_failed", F.col("failed_notifications") >= limit["failed_notifications"]), ("monitor_queue_backlog", waiting >= limit["monitor_queue"])]
    if freshness is not None:
        row = row.crossJoin(freshness)
        live = F.col("fresh") + F.col("stale") + F.col("unknown")
        rules.append(("stale_offer_rate", (live > 0) & (F.col("stale") / F.greatest(live, F.lit(1)) >= limit["stale"])))
    named = F.array_compact(F.array(*[F.when(passed, name) for name, passed in rules]))
    return row.select(F.array_join(named, ",").alias("alerts"), F.when(F.size(named) > 0, "degraded").otherwise("ok").alias("status"))


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a report; a top-k, not a sort of all rows."""
    return df.orderBy(*order).limit(n)


def with_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """A report's rows with the columns of names, one row a key; null where there is none. Names are read for the rows' keys only,
    so rows must be a top-k, which is broadcast."""
    return rows.join(names.join(F.broadcast(rows.select(key).distinct()), key, "left_semi"), key, "left")


def event_feed(events: DataFrame, products: DataFrame, sources: DataFrame, n: int = 200) -> DataFrame:
    """The newest n events with the names of their product and source. events: (seq, product_id, source_id, type, …), products:
    (product_id, product_name), sources: (source_id, source_name). An event whose product is unknown stays, without a name."""
    top = cut(newest(events, n, F.desc("seq"), F.col("type")), "feed")
    return with_names(with_names(top, products, "product_id"), sources, "source_id")


def offer_board(offers: DataFrame, products: DataFrame, sources: DataFrame, n: int = 200) -> DataFrame:
    """The first n offers of enabled sources with names: those not archived first, then fresh, purchasable, seen last.

    offers: (offer_id, product_id, source_id, archived, freshness, purchasable, last_seen, …), products: (product_id, product_name,
    product_model), sources: (source_id, source_name, source_class, enabled).
    """
    shown = offers.join(sources.where("enabled").drop("enabled"), "source_id")
    order = (F.coalesce("archived", F.lit(False)), F.desc(F.coalesce(F.col("freshness") == "fresh", F.lit(False))), F.desc(F.coalesce("purchasable", F.lit(False))), F.desc("last_seen"), F.col("offer_id"))
    return with_names(cut(newest(shown, n, *order), "board"), products, "product_id")


def within_budget(pages: DataFrame, most_pages: int, most_bytes: int) -> DataFrame:
    """Pages of a site in the order of priority, until the page or the byte budget is spent.

    A page is taken if fewer than most_pages precede it and their bytes stay below most_bytes.
    """
    w = Window.partitionBy("site").orderBy(F.desc("priority"), "page_id")
    ranked = pages.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_pages)
    spent = F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("spent", spent).where(F.col("spent") < most_bytes)
