"""Catalog of models: links from listings, official items with barcode conflicts, review queues, decisions.

All of it aggregates by model code or term with map-side combining, so a code that a third of all rows carry is one
row a partition before anything is shuffled. Listings repeat what they state: equal statements are counted by hash first, so
that only different ones are sorted for the aggregates whose values are texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_form, squeeze

# Model prefixes of the newest generation.
GENERATION_X = ("BX", "UX", "CX")

# What an official item must have.
TOLD = "model is not null and trim(title) <> ''"


def first_known(value: str, order: Column) -> Column:
    """The value of the first row, in this order, that has one."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), order)).alias(value)


def last_known(value: str, order: Column) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), order)).alias(value)


def stated(rows: DataFrame, *keys: str) -> DataFrame:
    """Equal statements as one row, with seq of the first and last time, how often, and whether any was official."""
    official = [F.bool_or("official").alias("official")] if "official" in rows.columns else []
    return rows.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("seq"), F.count("*").alias("times"), *official)


def link_listings(listings: DataFrame) -> DataFrame:
    """One catalog row a model code: what was known first stays. listings: (seq, model, brand, barcode, official), and series and
    release_date where there are such columns."""
    system = F.substring_index("model", "-", 1)
    order, more = F.col("first_seq"), [c for c in ("series", "release_date") if c in listings.columns]
    out = stated(listings.where("model is not null"), "model", "brand", "barcode", *more).groupBy("model").agg(
        first_known("brand", order), first_known("barcode", order), F.when(F.bool_or("official"), "verified").otherwise("pending").alias("verification"), F.sum("times").alias("listings"),
        *[first_known(c, order) for c in more],
    )
    return out.withColumns({"system": system, "generation": F.when(system.isin(*GENERATION_X), "X")})


def aliases(listings: DataFrame) -> DataFrame:
    """One row a model, locale and folded alias: its newest spelling. listings: (seq, model, locale, title, official)."""
    rows = stated(listings.where("model is not null and title is not null"), "model", "locale", "title").withColumn("alias_key", alias_form(F.col("title")))
    return rows.groupBy("model", "locale", "alias_key").agg(F.max_by("title", "seq").alias("alias"), F.bool_or("official").alias("verified"), F.sum("times").alias("seen"))


def official_items(items: DataFrame, maker: str | None = None) -> DataFrame:
    """One row a code of an official feed: newest known values, the first barcode, and whether barcodes disagree.

    items: (seq, model, title, barcode, msrp), and brand, series, release_date, image, currency where there are such columns:
    the newest known ones count, but a brand that the newest item doesn't state is `maker`. Rows without code or title are
    not taken; see `review_items`.
    """
    order = F.col("seq")
    rows = items.where(TOLD)
    differ = F.min("barcode") != F.max("barcode")
    return rows.groupBy("model").agg(
        first_known("barcode", order), last_known("msrp", order), F.max_by("title", "seq").alias("title"), F.when(F.coalesce(differ, F.lit(False)), "conflict").otherwise("verified").alias("verification"),
        *[last_known(c, order) for c in ("series", "release_date", "image", "currency") if c in items.columns],
        *([F.coalesce(F.max_by("brand", order), F.lit(maker)).alias("brand")] if "brand" in items.columns else []),
    )


def review_items(items: DataFrame) -> DataFrame:
    """Official items that lack code or title, as candidates of confidence 0.55."""
    return items.where("model is null or title is null or trim(title) = ''").withColumn("confidence", F.lit(0.55))


def term_queue(terms: DataFrame) -> DataFrame:
    """Terms to review: one row a kind, folded term and locale. terms: (seq, kind, raw, locale, suggestion)."""
    order = F.col("seq")
    rows = terms.withColumn("term", alias_form(F.col("raw"))).where("term <> ''")
    return rows.groupBy("kind", "term", "locale").agg(first_known("suggestion", order), F.max("seq").alias("last_seen"), F.count("*").alias("occurrences"))


def exclusion_log(excluded: DataFrame) -> DataFrame:
    """One row a (source_id, url, reason): how often, first and last time, newest title."""
    return excluded.groupBy("source_id", "url", "reason").agg(F.count("*").alias("occurrences"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"), F.max_by("title", "seq").alias("title"))


def latest_decisions(decisions: DataFrame, *keys: str) -> DataFrame:
    """The decision that holds for each key: the newest; `reopen` undoes those before it."""
    newest = decisions.groupBy(*keys).agg(F.max_by("decision", "seq").alias("decision"))
    return newest.where("decision <> 'reopen'")


def decide(queue: DataFrame, decisions: DataFrame, *keys: str) -> DataFrame:
    """The queue with each row's status: the decision that holds, else pending."""
    return queue.join(latest_decisions(decisions, *keys), list(keys), "left").withColumn("status", F.coalesce("decision", F.lit("pending"))).drop("decision")


def backfill(products: DataFrame, links: DataFrame, offers: DataFrame) -> DataFrame:
    """(product_id, model, offer_id) of products with a model and no link: their newest offer gives the catalog's fields.

    products: (product_id, model), links: (product_id), offers: (offer_id, product_id, last_seen).
    """
    newest = offers.groupBy("product_id").agg(F.max_by("offer_id", F.struct("last_seen", "offer_id")).alias("offer_id"))
    return products.where("model is not null").join(links.select("product_id"), "product_id", "left_anti").join(newest, "product_id").select("product_id", "model", "offer_id")


def source_classes(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds `source_class`: the registry's by site, else retailer. registry: (site, source_class), one row a site."""
    known = registry.groupBy("site").agg(F.min("source_class").alias("source_class"))
    return sources.join(known, "site", "left").withColumn("source_class", F.coalesce("source_class", F.lit("retailer")))


def unidentified(listings: DataFrame, words: str) -> DataFrame:
    """Listings whose title has a word of the watched kind but that have no model, as terms for `term_queue`."""
    rows = listings.where(F.col("model").isNull() & F.col("title").rlike(f"(?iu){words}"))
    return rows.select("seq", F.lit("catalog_identity").alias("kind"), F.col("title").alias("raw"), "locale", F.lit(None).cast("string").alias("suggestion"))


# How sure a shop's and a maker's own page make an entry.
SHOP_CONFIDENCE = 0.85
MAKER_CONFIDENCE = 0.98


def sticky_verified(status: str) -> Column:
    """verified once any row said so; else what the newest row says, pending if it says nothing. Within a groupBy of rows with seq."""
    return F.when(F.bool_or(F.col(status) == "verified"), "verified").otherwise(F.coalesce(F.max_by(status, "seq"), F.lit("pending"))).alias(status)


def evidence(rows: DataFrame) -> DataFrame:
    """One row a model and url: newest class and locale, highest confidence, sticky verification.

    rows: (seq, model, url, source_class, locale, verification).
    """
    sure = F.when(F.col("source_class") == "official_store", MAKER_CONFIDENCE).otherwise(SHOP_CONFIDENCE)
    rows = stated(rows.where("model is not null and url is not null"), "model", "url", "source_class", "locale", "verification")
    return rows.groupBy("model", "url").agg(
        F.max_by("source_class", "seq").alias("source_class"), F.max_by("locale", "seq").alias("locale"), F.max(sure).alias("confidence"), sticky_verified("verification")
    )


def parts(rows: DataFrame, part_types: tuple[str, ...]) -> DataFrame:
    """One row a part: (part_type, code, name) with its verification. rows: (seq, part_type, code, name, verification).

    Rows of another type or with a blank name aren't parts. A blank code is none, and parts without a code are one by name.
    """
    named = rows.withColumns({"name": squeeze(F.col("name")), "code": F.nullif(squeeze(F.col("code")), F.lit(""))})
    return named.where(F.col("part_type").isin(*part_types) & (F.col("name") != "")).groupBy("part_type", "code", "name").agg(sticky_verified("verification"))


def product_parts(links: DataFrame) -> DataFrame:
    """One row a (model, part_id): newest quantity, at least 1, and position; of equal seq the greatest of both.

    links: (seq, model, part_id, quantity, position).
    """
    newest = links.groupBy("model", "part_id").agg(F.max(F.struct("seq", "quantity", "position")).alias("l"))
    return newest.select("model", "part_id", F.greatest(F.lit(1), F.coalesce("l.quantity", F.lit(1))).alias("quantity"), "l.position")


def announcements(items: DataFrame, *said: str) -> DataFrame:
    """One row a (source_id, url, event_type) of official items with a code: as last told, but published when first told.

    items: (seq, source_id, url, model, title, event_type, published_at, msrp). An item without a type is `announced`.
    said: the columns that hold what was told last; by themselves model, title and msrp. With texts among them all items are
    sorted; with a number alone, by which the caller looks the rest up afterwards, they are aggregated by hash.
    """
    said = said or ("model", "title", "msrp")
    rows = items.where(TOLD).withColumn("event_type", F.coalesce("event_type", F.lit("announced")))
    last = [F.max_by(c, "seq").alias(c) for c in said]
    found = rows.groupBy("source_id", "url", "event_type").agg(F.min("seq").alias("announcement_id"), *last, F.min_by("published_at", "seq").alias("published_at"))
    return found.select("announcement_id", "source_id", "url", "event_type", *said, "published_at")


def exclusions_listed(log: DataFrame, decisions: DataFrame, sources: DataFrame, status: str | None = None, n: int = 200) -> DataFrame:
    """The n exclusions seen last, with their decision and the source's name; all, or those of one status.

    log: `exclusion_log`'s rows, decisions: (source_id, url, reason, decision, seq), sources: (source_id, source_name).
    """
    rows = decide(log, decisions, "source_id", "url", "reason")
    rows = rows if status is None else rows.where(F.col("status") == status)
    return rows.join(sources, "source_id").orderBy(F.desc("last_seen"), "source_id", "url", "reason").limit(n)


def official_sources_listed(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Official sources with the number of their announcements."""
    counts = found.groupBy("source_id").agg(F.count("*").alias("announcements"))
    return sources.join(counts, "source_id", "left").withColumn("announcements", F.coalesce("announcements", F.lit(0)))


def catalog_listing(products: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """Catalog rows with how many names and pieces of evidence each has, and the names as `locale:alias`, sorted.

    products: (model, …) as of link_listings, names: (model, locale, alias), known: (model, url).
    """
    spelt = names.groupBy("model").agg(F.count("*").alias("aliases"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "locale", "alias"))), " | ").alias("alias_list"))  # names of one model
    counted = known.groupBy("model").agg(F.count("*").alias("evidence"))
    out = products.join(spelt, "model", "left").join(counted, "model", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("aliases", "evidence")})


def approved(queue: DataFrame, decisions: DataFrame, *keys: str) -> DataFrame:
    """The queue's rows that a reviewer let in, as listings: they take part in matching like any other."""
    return decide(queue, decisions, *keys).where("status = 'approve'").drop("status")
