"""Posts of a community: fingerprints, two-level dedup, links, leads, spam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_form, model_code
from ..functions.urls import canonical
from ..sources.tables import cut
from .rules import RULE_COLUMNS, complete, match_rules, with_lists

# Words of each kind of lead.
LEADS = (
    ("new_product", ("新商品", "新品", "new product", "発売予定")),
    ("lottery", ("抽選", "lottery")),
    ("preorder", ("予約", "pre-order", "preorder")),
    ("restock", ("再入荷", "入荷", "restock")),
)
LINK = r"https?://[^\s<>\"']+"


def content_fingerprint(text: Column) -> Column:
    """Hash of the text without links, repost marks and hashtags."""
    return F.sha2(alias_form(bare_text(text)), 256)


def bare_text(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, LINK, " "), r"^\s*RT\s+@[^:\s]+:\s*", "")
    return F.regexp_replace(bare, r"#[^\s#]+", " ")


def fingerprinted(posts: DataFrame) -> DataFrame:
    """Posts with the content_fingerprint of their text. The bare text is a column first: folding reads it more than once."""
    return posts.withColumn("fingerprint", bare_text(F.col("text"))).withColumn("fingerprint", F.sha2(alias_form(F.col("fingerprint")), 256))


def links(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({LINK})")), lambda u: canonical(F.regexp_replace(u, "[),.!?。、，]+$", "")))
    return F.array_distinct(F.array_compact(found))


def link_rows(posts: DataFrame) -> DataFrame:
    """(post_id, url, kind) of the distinct links of posts (post_id, text): `store` if the address speaks of one, else `external`."""
    rows = posts.select("post_id", F.explode(links(F.col("text"))).alias("url"))
    return rows.withColumn("kind", F.when(F.col("url").rlike("(?i)shop|store|mall"), "store").otherwise("external"))


def leads(text: Column, n_links: Column) -> Column:
    form = alias_form(text)
    kinds = []
    for kind, terms in LEADS:
        hit = F.lit(False)
        for t in terms:
            hit = hit | form.contains(t)
        kinds.append(F.when(hit, kind))
    return F.array_compact(F.array(*kinds, F.when(n_links > 0, "store_link")))


def spam_score(text: Column, n_links: Column) -> Column:
    marks = F.length(text) - F.length(F.replace(text, F.lit("#"), F.lit("")))
    points = [(marks >= 8, 0.35), (n_links >= 5, 0.35), (text.rlike(r"(.)\1{9,}"), 0.35), (F.length(text) < 8, 0.25)]
    score = F.lit(0.0)
    for hit, p in points:
        score = score + F.when(hit, p).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 2)


def first_posts(posts: DataFrame) -> DataFrame:
    """(post_id, posted_at, text) -> one row a fingerprint: the earliest post and how many repeat it.

    An aggregate, not a window: a text that a third of all posts repeat is counted on the map side.
    """
    order = F.struct("posted_at", "post_id")
    return fingerprinted(posts).groupBy("fingerprint").agg(F.min_by("post_id", order).alias("post_id"), (F.count("*") - 1).alias("duplicate_count"))


def post_origins(posts: DataFrame) -> DataFrame:
    """(first_id, post_id, source_id, external_id): where each post that repeats another's text came from; first_id is the
    earliest post with that text.

    posts: (post_id, source_id, external_id, posted_at, text). A source's post that comes again under its own id is the same
    post and no origin: of equal (source_id, external_id) only the earliest counts.
    """
    order = F.struct("posted_at", "post_id")
    same = posts.groupBy("source_id", "external_id").agg(F.min(F.struct("posted_at", "post_id", "text")).alias("p")).select("source_id", "external_id", "p.*")
    marked = cut(fingerprinted(same).drop("text").select("post_id", "source_id", "external_id", "posted_at", "fingerprint"), "posts")
    first = cut(marked.groupBy("fingerprint").agg(F.min_by("post_id", order).alias("first_id")), "first-posts")
    return marked.join(first, "fingerprint").where("post_id <> first_id").select("first_id", "post_id", "source_id", "external_id")


def mentions(text: Column, prefixes: tuple[str, ...] = ("BX", "UX", "CX")) -> Column:
    """Distinct model codes that a post names; codes of one digit aren't any."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![0-9A-Za-z_])((?:{'|'.join(prefixes)})[\s_-]?[0-9]{{1,3}})(?![0-9A-Za-z_])"))
    return F.array_distinct(F.array_compact(F.transform(found, lambda m: model_code(m, prefixes))))


def hidden(muted: Column, excluded: Column, sensitive: Column, spam: Column, filter_sensitive: Column, filter_spam: Column) -> Column:
    """A muted author, a term that the source excludes, or sensitive content or spam where the source filters it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(muted) | yes(excluded) | (yes(sensitive) & yes(filter_sensitive)) | ((F.round(spam, 2) >= 0.7) & yes(filter_spam))


def post_matches(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, post_id, confidence) where a post names a rule's model or has one of its keywords; the better of the two counts.

    posts: (post_id, text, locale), rules: (rule_id and RULE_COLUMNS of the rules module). A model is one of those that the
    post names and counts 0.95; a keyword counts 0.8: a whole word, a part of the folded text or an expression, as the mode
    says. Exclude terms and a rule's language hold for both.
    """
    text = F.coalesce("text", F.lit(""))
    named = mentions(text)
    context = complete(posts, {"locale": "string"}).select(
        F.col("post_id").alias("product_id"), F.concat(text, F.lit(" "), F.array_join(named, " ")).alias("raw_text"), F.split(text, r"[\s、，。,:：/]+").alias("base_values"), named.alias("models"), "locale"
    )
    asked = with_lists(rules).select("rule_id", *RULE_COLUMNS).withColumns({c: F.lit(None).cast(RULE_COLUMNS[c]) for c in ("barcode", "catalog_product_id", "catalog_part_id")})
    no_words, no_model = F.array().cast("array<string>"), F.lit(None).cast("string")
    by_model = match_rules(context, asked.withColumn("keywords", no_words)).select("rule_id", "product_id", F.lit(0.95).alias("confidence"))
    by_word = match_rules(context, asked.withColumn("model", no_model)).select("rule_id", "product_id", F.lit(0.8).alias("confidence"))
    return by_model.unionByName(by_word).groupBy("rule_id", F.col("product_id").alias("post_id")).agg(F.max("confidence").alias("confidence"))


def unexpired(posts: DataFrame, now: Column) -> DataFrame:
    """Posts within their source's retention, which is held between 7 and 365 days. posts: (fetched_at, retention_days, …)."""
    days = F.least(F.lit(365), F.greatest(F.lit(7), F.col("retention_days")))
    return posts.where(F.col("fetched_at") + F.make_dt_interval(days) > now)


def source_counts(sources: DataFrame, posts: DataFrame) -> DataFrame:
    """Sources with the number of their posts and of hidden ones. posts: (source_id, hidden)."""
    counts = posts.groupBy("source_id").agg(F.count("*").alias("posts"), F.count_if("hidden").alias("hidden_posts"))
    return sources.join(counts, "source_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("posts", "hidden_posts")})


def visible_posts(posts: DataFrame, matches: DataFrame | Callable[[DataFrame], DataFrame], n: int = 100) -> DataFrame:
    """The newest n (500 at most) posts that aren't hidden, with links and the rules they match, sorted.

    posts: (post_id, posted_at, text, hidden), matches: (rule_id, post_id), or what makes them of the report's posts (post_id), so
    that no others need be matched. Only the rows of the report meet the matches.
    """
    shown = posts.where(~F.coalesce("hidden", F.lit(False))).orderBy(F.desc("posted_at"), F.desc("post_id")).limit(min(500, max(1, n)))
    if callable(matches):
        shown = cut(shown, "shown")
        matches = matches(shown.select("post_id"))
    rules = matches.join(F.broadcast(shown.select("post_id")), "post_id").groupBy("post_id").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))  # at most 500 ids
    return shown.join(rules, "post_id", "left").select("post_id", "posted_at", links(F.col("text")).alias("links"), F.coalesce("rules", F.array().cast("array<bigint>")).alias("rules"))


def origins_listed(posts: DataFrame, origins: DataFrame, n: int = 100) -> DataFrame:
    """(post_id, source_id, external_id) of the newest n (500 at most) visible posts: where each came from, itself first of all.

    posts: (post_id, source_id, external_id, posted_at, hidden, muted), origins: `post_origins`' rows. A post may have any number of
    origins, so they are rows, not a list.
    """
    seen = ~F.coalesce("hidden", F.lit(False)) & ~F.coalesce("muted", F.lit(False))
    shown = cut(posts.where(seen).orderBy(F.desc("posted_at"), F.desc("post_id")).limit(min(500, max(1, n))), "shown")
    others = origins.join(F.broadcast(shown.select(F.col("post_id").alias("first_id"))), "first_id")  # at most 500 ids
    return shown.select("post_id", "source_id", "external_id").unionByName(others.select(F.col("first_id").alias("post_id"), "source_id", "external_id"))
