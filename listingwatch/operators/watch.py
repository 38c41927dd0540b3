"""Watch rules over time: match table, alerts from events, suppression of stale events, outbox of deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut, drop
from .matching import BY_SORT, upsert, with_names
from .rules import match_rules, valid_rules  # noqa: F401 (valid_rules: a watch operator that lives with the matching)


def match_table(known: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """The table of matches after a batch: first and last time, and the highest confidence, of (rule_id, product_id).

    known: (rule_id, product_id, confidence, first_matched, last_matched), found: (rule_id, product_id, confidence).
    """
    batch = found.groupBy("rule_id", "product_id").agg(F.max("confidence").alias("confidence")).withColumns({"first_matched": at, "last_matched": at})
    return upsert(known, batch, ["rule_id", "product_id"], {"confidence": "greatest", "first_matched": "least", "last_matched": "greatest"})


def identity_key(catalog_id: Column, product_id: Column) -> Column:
    """What a match is kept under: the catalog's entry where there is one, so that an entry's products share it; else the product."""
    return F.when(catalog_id.isNotNull(), F.concat(F.lit("catalog:"), catalog_id)).otherwise(F.concat(F.lit("product:"), product_id))


def keyed_match_table(known: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """As match_table, under (rule_id, identity_key): the last product, offer and reasons count, the first match type stays.

    known: (rule_id, identity_key, product_id, offer_id, match_type, confidence, reasons, first_matched, last_matched), found:
    (rule_id, catalog_product_id, product_id, offer_id, match_type, confidence, reasons, seq), in the order of seq, then product_id.
    A batch's rows of one key are an aggregate; a match without a product or offer keeps those of before.
    """
    order = F.struct("seq", "product_id", "offer_id")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", "product_id", "offer_id", F.col(c).alias("value"))))["value"].alias(c)
    rows = found.withColumn("identity_key", identity_key(F.col("catalog_product_id"), F.col("product_id")))
    batch = rows.groupBy("rule_id", "identity_key").agg(last("product_id"), last("offer_id"), F.min_by("match_type", order).alias("match_type"), F.max("confidence").alias("confidence"), F.max_by("reasons", order).alias("reasons"))
    rules = {"product_id": "coalesce_new", "offer_id": "coalesce_new", "match_type": "keep_old", "confidence": "greatest", "reasons": "overwrite", "first_matched": "least", "last_matched": "greatest"}
    return upsert(known, batch.withColumns({"first_matched": at, "last_matched": at}), ["rule_id", "identity_key"], rules)


def alert_type(event_type: Column, state: Column) -> Column:
    """What an event is to a watcher; null if it is nothing."""
    bought = F.when(state.isin("in_stock"), "in_stock").when(state == "preorder", "preorder_open")
    return (
        F.when(event_type == "price_change", "price_anomaly")
        .when(event_type == "preorder_open", "preorder_open")
        .when(event_type.isin("back_in_stock", "became_available"), "in_stock")
        .when(event_type == "product_discovered", bought)
    )


def alerts(events: DataFrame, matches: DataFrame, preferences: DataFrame, known: DataFrame | None) -> DataFrame:
    """New alerts: one a rule, event and type, for rules that match the event's product and want the type.

    events: (event_id, product_id, type, to_state), matches: (rule_id, product_id), preferences: (rule_id, alert_type) that
    are switched on, known: (dedup_key) of earlier alerts, or their rows; None if there are none.
    """
    typed = events.withColumn("alert_type", alert_type(F.col("type"), F.col("to_state"))).where("alert_type is not null")
    wanted = matches.select("rule_id", "product_id").distinct().join(preferences.select("rule_id", "alert_type").distinct().hint(BY_SORT), "rule_id")
    return told_once(typed, wanted, known, "event_id", "product_id", "event")


def told_once(typed: DataFrame, wanted: DataFrame, known: DataFrame | None, told: str, subject: str, kind: str) -> DataFrame:
    """(dedup_key, rule_id, told, subject, alert_type) of the pairs of what is told and who wants it, without known keys.

    typed: (told, subject, alert_type), wanted: (rule_id, subject, alert_type) without repeats, known: (dedup_key), or rows of an
    earlier result. Pairs are many and are not sent on: repeats are dropped before they meet, and so is what all who want it have
    been told, which the number of their rules and two hashes of 64 bits say. Only pairs of what some have been told meet known keys,
    and only what is told under one id of several subjects can still give a key twice.
    """
    key = F.concat_ws(":", F.lit("watch"), "rule_id", F.lit(kind), told, "alert_type").alias("dedup_key")
    rows = typed.select(told, subject, "alert_type").distinct()
    earlier = None
    if known is not None:
        earlier = told_before(known, told, kind, wanted.schema["rule_id"].dataType, typed.schema[told].dataType)
        asked = rules_of(wanted, subject).withColumnRenamed("of", "asked")
        rows = rows.join(asked.hint(BY_SORT), [subject, "alert_type"]).join(rules_of(earlier, told).withColumnRenamed("of", "has").hint(BY_SORT), [told, "alert_type"], "left")
        rows = rows.where("has is null or has <> asked").select(told, subject, "alert_type", F.col("has").isNotNull().alias("partly"))
    else:
        rows = rows.withColumn("partly", F.lit(False))
    rows = cut(rows, "told")
    several = cut(rows.groupBy(told, "alert_type").count().where("count > 1").select(told, "alert_type"), "told-of-several")
    pairs = lambda some: some.join(wanted.hint(BY_SORT), [subject, "alert_type"]).select(key, "rule_id", told, subject, "alert_type")

    def once(some: DataFrame) -> DataFrame:
        if several.isEmpty():
            return pairs(some)
        found = pairs(some.join(several, [told, "alert_type"], "left_anti"))
        return found.unionByName(pairs(some.join(several, [told, "alert_type"], "left_semi")).dropDuplicates(["dedup_key"]))

    partly = rows.where("partly")
    if earlier is None or partly.isEmpty():
        return once(rows)
    left = once(partly).join(earlier.join(partly.select(told, "alert_type").distinct(), [told, "alert_type"], "left_semi"), ["rule_id", told, "alert_type"], "left_anti")
    return once(rows.where("not partly")).unionByName(left)


def rules_of(rows: DataFrame, subject: str) -> DataFrame:
    """(subject, alert_type, of: how many rules there are and what all of them are, in two hashes)."""
    hashes = [F.bit_xor(F.xxhash64(*salt, "rule_id")) for salt in ((), (F.lit("again"),))]
    return rows.groupBy(subject, "alert_type").agg(F.struct(F.count("*").alias("n"), hashes[0].alias("one"), hashes[1].alias("other")).alias("of"))


def told_before(known: DataFrame, told: str, kind: str, rule_type: T.DataType, told_type: T.DataType) -> DataFrame:
    """(rule_id, told, alert_type) of known keys; keys of another kind, or that no alert could have, are none."""
    if {"rule_id", told, "alert_type"} <= set(known.columns):
        return known.select("rule_id", told, "alert_type")
    part = lambda i: F.regexp_extract("dedup_key", f"^watch:(.*):{kind}:(.*):([^:]*)$", i)
    found = known.select("dedup_key", part(1).try_cast(rule_type).alias("rule_id"), part(2).try_cast(told_type).alias(told), part(3).alias("alert_type"))
    return found.where(F.concat_ws(":", F.lit("watch"), "rule_id", F.lit(kind), told, "alert_type") == F.col("dedup_key")).drop("dedup_key").distinct()


def split_stale(events: DataFrame, offers: DataFrame) -> DataFrame:
    """Adds `suppressed`: a buyable event whose offer has gone stale or is archived is consumed unsent.

    offers: (offer_id, freshness), one row an offer. Events of unknown offers stay pending.
    """
    old = F.coalesce(F.col("freshness").isin("stale", "archived"), F.lit(False))
    joined = events.join(offers.select("offer_id", "freshness"), "offer_id", "left")
    return joined.withColumn("suppressed", F.coalesce(F.col("to_state").isin("in_stock", "preorder"), F.lit(False)) & old).drop("freshness")


def outbox(pending: DataFrame, channels: DataFrame, sent: DataFrame) -> DataFrame:
    """What each channel has still to deliver of each dedup_key, and whether the key is then done.

    channels: (channel, configured), a handful by definition; sent: (channel, dedup_key, status) of earlier tries. Sent
    ones are skipped, failed ones are queued again, a channel without configuration is recorded and doesn't hold up others.
    """
    pairs = pending.select("dedup_key").distinct().crossJoin(F.broadcast(channels))
    tried = sent.groupBy("channel", "dedup_key").agg(F.max_by("status", F.when(F.col("status") == "sent", 2).otherwise(1)).alias("status"))
    joined = pairs.join(tried, ["channel", "dedup_key"], "left")
    state = F.when(F.col("status") == "sent", "skipped").when(~F.col("configured"), "unconfigured").when(F.col("status") == "failed", "retry").otherwise("queued")
    return joined.select("dedup_key", "channel", state.alias("state"))


def completed(outbox_rows: DataFrame) -> DataFrame:
    """Per dedup_key: how many deliveries are open, and whether none is."""
    open_ = F.count_if(F.col("state").isin("queued", "retry"))
    return outbox_rows.groupBy("dedup_key").agg(open_.alias("open"), (open_ == 0).alias("done"))


def backfill(rules: DataFrame, offers: DataFrame, matches: DataFrame) -> DataFrame:
    """What a new rule's owner hears at once: of each matched product its newest offer that isn't archived, if buyable.

    offers: (offer_id, product_id, state, freshness, last_seen), matches: (rule_id, product_id), rules: (rule_id) that are new.
    """
    return matches.join(rules.select("rule_id").distinct(), "rule_id", "left_semi").join(buyable(offers), "product_id").select("rule_id", "product_id", "offer_id", "state")


def buyable(offers: DataFrame) -> DataFrame:
    """(product_id, offer_id, state) of products whose newest offer that isn't archived can be bought. offers: as in backfill."""
    latest = offers.where("freshness <> 'archived'").groupBy("product_id").agg(F.max_by(F.struct("offer_id", "state", "freshness"), F.struct("last_seen", "offer_id")).alias("o"))
    return latest.where("o.freshness = 'fresh' and o.state in ('in_stock', 'preorder')").select("product_id", "o.offer_id", "o.state")


def backfill_new(new: DataFrame, context: DataFrame, rules: DataFrame, offers: DataFrame) -> DataFrame:
    """backfill for rules that have no matches yet: only new rules meet products, and only products of which there is something to tell.

    new: (rule_id), context and rules: as in match_rules, offers: as in backfill.
    """
    good = cut(buyable(offers), "buyable")
    asked = rules.join(new.select("rule_id").distinct(), "rule_id", "left_semi")
    matches = match_rules(context.join(good.select("product_id"), "product_id", "left_semi"), asked)
    return matches.join(good.hint(BY_SORT), "product_id").select("rule_id", "product_id", "offer_id", "state")


def boost(candidates: DataFrame, matches: DataFrame, points: float = 0.2) -> DataFrame:
    """Candidates (candidate_id, confidence) with the points added where any rule matches, and the first such rule."""
    first = matches.groupBy("candidate_id").agg(F.min("rule_id").alias("rule_id"))
    joined = candidates.join(first, "candidate_id", "left")
    return joined.withColumn("confidence", F.round(F.least(F.lit(0.99), F.col("confidence") + F.when(F.col("rule_id").isNotNull(), points).otherwise(0.0)), 2))


# What an official announcement is to a watcher.
ANNOUNCED = {"announced": "official_announcement", "preorder": "preorder_open", "released": "release", "restock": "in_stock"}


def announcement_alerts(announcements: DataFrame, matches: DataFrame, preferences: DataFrame, known: DataFrame | None) -> DataFrame:
    """New alerts of official announcements: one a rule and announcement, for rules that match its model and want the type.

    announcements: (announcement_id, model, event_type), matches: (rule_id, model), preferences and known as in `alerts`.
    """
    kinds = F.create_map(*[F.lit(x) for kv in ANNOUNCED.items() for x in kv])
    typed = announcements.where("model is not null").withColumn("alert_type", F.coalesce(kinds[F.col("event_type")], F.lit("official_announcement")))
    wanted = matches.select("rule_id", "model").distinct().join(preferences.select("rule_id", "alert_type").distinct().hint(BY_SORT), "rule_id")
    return told_once(typed, wanted, known, "announcement_id", "model", "official")


def rules_listed(rules: DataFrame, preferences: DataFrame) -> DataFrame:
    """Rules with the alert types they want, sorted. preferences: (rule_id, alert_type) that are switched on."""
    wanted = preferences.groupBy("rule_id").agg(F.array_sort(F.collect_set("alert_type")).alias("alert_types"))  # a handful of types by definition
    return rules.join(wanted, "rule_id", "left").withColumn("alert_types", F.coalesce("alert_types", F.array().cast("array<string>")))


def alerts_listed(found: DataFrame, rules: DataFrame, n: int = 100) -> DataFrame:
    """The newest n (500 at most) alerts with their rule's name. rules: (rule_id, rule_name). The names join after the top-k."""
    newest = found.orderBy(F.desc("event_id"), "dedup_key").limit(min(500, max(1, n)))
    return newest.join(rules.select("rule_id", "rule_name"), "rule_id")


def newest_alerts(events: DataFrame, n: int, alerts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Alerts among which are the newest n of all, by event_id and then dedup_key.

    events: (event_id, …), alerts_of: the alerts of some of them. Events are asked from the newest on, n and then sixteen times
    as many each time, until they have n alerts or there are no more; an older event's alerts all come after those.
    """
    events, some = cut(events, "told-events"), n
    total = events.count()
    while True:
        asked = events
        if some < total:
            least = events.select("event_id").orderBy(F.desc("event_id")).limit(some).agg(F.min("event_id").alias("event_id")).first()["event_id"]
            asked = events.where(F.col("event_id") >= least)
        found = cut(alerts_of(asked), "newest-alerts")
        if some >= total or found.count() >= n:
            return found
        drop(found)
        some *= 16


def rules_named(rules: DataFrame, preferences: DataFrame, products: DataFrame, parts: DataFrame) -> DataFrame:
    """As rules_listed, with the code of the catalog product and the name of the part that a rule has selected, or null.

    products: (catalog_product_id, product_code), parts: (catalog_part_id, part_name), one row an id. Rules that have selected
    nothing, as most do, take no part in the join.
    """
    rows = rules_listed(rules, preferences)
    for names, key, name in ((products, "catalog_product_id", "product_code"), (parts, "catalog_part_id", "part_name")):
        with_key = rows.where(F.col(key).isNotNull()).join(names.select(key, name), key, "left")
        rows = with_key.unionByName(rows.where(F.col(key).isNull()).withColumn(name, F.lit(None).cast(names.schema[name].dataType)))
    return rows.withColumnsRenamed({"product_code": "selected_product_code", "part_name": "selected_part_name"})


def alerts_named(found: DataFrame, rules: DataFrame, products: DataFrame, n: int = 100) -> DataFrame:
    """As alerts_listed, with the code of the alert's catalog product, or null. found: (…, catalog_product_id), products:
    (catalog_product_id, product_code)."""
    top = cut(found.orderBy(F.desc("event_id"), "dedup_key").limit(min(500, max(1, n))), "alerts")
    return with_names(top.join(rules.select("rule_id", "rule_name"), "rule_id"), products, "catalog_product_id")


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of rows that are new, gone, or have another value in any column. One row a key on either side."""
    digest = lambda df, name: df.select(key, F.xxhash64(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)))).alias(name))
    both = digest(before, "was").join(digest(after, "is"), key, "full")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select(key)


def rematch(known: DataFrame, context: DataFrame, rules: DataFrame, products: DataFrame, changed: DataFrame) -> DataFrame:
    """The matches after a change, from those before: changed rules meet all products, the other rules the changed products
    only, and matches of what has changed or gone are given up.

    known: match_rules' rows before; context and rules: the tables after; products: (product_id) and changed: (rule_id) that
    are new, gone or different (changed_keys).
    """
    products, changed = products.select("product_id").distinct(), changed.select("rule_id").distinct()
    stays = known.join(products, "product_id", "left_anti").join(changed, "rule_id", "left_anti")
    by_rule = match_rules(context, rules.join(changed, "rule_id", "left_semi"))
    by_product = match_rules(context.join(products, "product_id", "left_semi"), rules.join(changed, "rule_id", "left_anti"))
    return stays.select(*by_rule.columns).unionByName(by_rule).unionByName(by_product)
