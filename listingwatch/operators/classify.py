"""Exclusion and availability of listings, as one expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import AFTER, BEFORE, alias_form, grams, locale_of, normalize_unicode, to_half_width

# Schema.org availability, terms by state and language in the order they are tried, exclusions.
SCHEMA = {
    "instock": "in_stock", "limitedavailability": "in_stock", "onlineonly": "in_stock", "instoreonly": "in_stock", "outofstock": "out_of_stock",
    "soldout": "out_of_stock", "discontinued": "out_of_stock", "preorder": "preorder", "backorder": "preorder", "presale": "coming_soon",
}
TERMS = (
    ("out_of_stock", "zh-TW", ("缺貨", "售罄", "完售", "補貨中", "無庫存")),
    ("out_of_stock", "ja", ("品切", "在庫なし", "入荷待ち", "販売休止中", "販売終了", "予約終了", "再入荷予定なし")),
    ("out_of_stock", "en", ("out of stock", "sold out", "no longer", "discontinued")),
    ("preorder", "zh-TW", ("預購", "預訂")),
    ("preorder", "ja", ("予約受付中", "予約販売", "予約")),
    ("preorder", "en", ("pre-order", "preorder")),
    ("coming_soon", "zh-TW", ("即將推出", "即將發售")),
    ("coming_soon", "ja", ("近日発売", "発売予定")),
    ("coming_soon", "en", ("coming soon",)),
    ("in_stock", "zh-TW", ("現貨", "有貨", "可購買", "加入購物車")),
    ("in_stock", "ja", ("在庫あり", "販売中", "カートに入れる")),
    ("in_stock", "en", ("in stock", "add to cart", "buy now")),
)
EXCLUSIONS = (
    ("used", f"{BEFORE}used{AFTER}|中古|二手|中古品|ジャンク"),
    ("parts_only", "parts only|拆售|拆賣|單賣零件|バラ売り|パーツのみ"),
    ("accessory", "replacement part|spare parts|收納|display case|stand only"),
    ("non_target_product", f"ポケモンカード|寶可夢卡|宝可梦卡|pokemon cards?|遊戯王|one piece card|{BEFORE}lego{AFTER}|レゴ|bakugan|爆丸"),
)
TERMINAL = "(?i)discontinued|販売終了|終売|廃番|已停產|已停售"


def exclusion_reason(title: Column, raw_text: Column, rules: tuple = EXCLUSIONS) -> Column:
    """First rule (reason, pattern) that fits, or null."""
    hay = to_half_width(F.concat_ws(" ", title, raw_text))
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(rules):
        out = F.when(hay.rlike(f"(?i){pattern}"), reason).otherwise(out)
    return out


def schema_state(raw: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(raw), r"^https?://schema\.org/", ""), "[^a-z]", "")
    return F.create_map(*[F.lit(x) for kv in SCHEMA.items() for x in kv])[key]


def text_match(text: Column) -> Column:
    """struct<state, locale, term> of the first term, in the order of TERMS; null if none occurs."""

    def first(low: Column) -> Column:
        out = F.lit(None).cast("struct<state:string,locale:string,term:string>")
        for state, locale, terms in reversed(TERMS):
            for term in reversed(terms):
                out = F.when(low.contains(term), F.struct(F.lit(state).alias("state"), F.lit(locale).alias("locale"), F.lit(term).alias("term"))).otherwise(out)
        return out

    # a lambda's argument is computed once, not again in each of the terms' conditions
    return F.transform(F.array(F.lower(normalize_unicode(text))), first)[0]


def availability(raw: Column, stated: Column, title: Column, raw_text: Column, buy_button: Column, price: Column) -> Column:
    """struct<state, confidence, locale, signals, term>: schema.org data counts most, then the text, a buy button and a price;
    the signals in that order, and the term that the text was known by."""
    text = to_half_width(F.concat_ws(" ", stated, title, raw_text))
    schema, found = schema_state(raw), text_match(text)
    said = found["state"]
    agree = F.when(said.isNull(), 0.0).when(said == schema, 0.10).otherwise(-0.15)
    state = F.coalesce(schema, said, F.lit("unknown"))
    base = F.when(schema.isNotNull(), F.least(F.lit(0.98), F.greatest(F.lit(0.5), 0.85 + agree))).when(said.isNotNull(), 0.60).otherwise(0.2)
    button = F.coalesce(buy_button, F.lit(False))
    with_button = F.when(button & (state == "unknown"), F.greatest(base, F.lit(0.5))).when(button & (state == "in_stock"), F.least(F.lit(0.98), base + 0.05)).otherwise(base)
    confidence = F.when(price.isNotNull(), F.least(F.lit(0.98), with_button + 0.05)).otherwise(with_button)
    final = F.when(button & (state == "unknown"), "in_stock").otherwise(state)
    of_text = F.when(said.isNotNull(), F.when(schema.isNull(), "text").when(said == schema, "text-agree").otherwise("text-conflict"))
    signals = F.array_compact(F.array(F.when(schema.isNotNull(), "schema"), of_text, F.when(button, "buy-button"), F.when(price.isNotNull(), "price")))
    return F.struct(final.alias("state"), F.round(confidence, 2).alias("confidence"), F.coalesce(found["locale"], locale_of(text)).alias("locale"), signals.alias("signals"), found["term"].alias("term"))


def is_terminal(*texts: Column) -> Column:
    return F.concat_ws(" ", *texts).rlike(TERMINAL)


def candidate_evidence(title: Column, model: Column, hay: Column, structured: Column, words: str, maker: str) -> list[tuple[Column, float, str]]:
    """What speaks for a page being a product of the watched kind, with its points and name."""
    return [(model.isNotNull(), 0.45, "model"), (hay.rlike(f"(?i){words}"), 0.40, "words"), (hay.rlike(f"(?i){maker}"), 0.10, "maker"), (structured, 0.15, "structured")]


def candidate_confidence(title: Column, model: Column, hay: Column, structured: Column, words: str, maker: str) -> Column:
    """How surely a page is a product of the watched kind: model code, its words, its maker, structured data."""
    score = F.lit(0.0)
    for hit, p, _ in candidate_evidence(title, model, hay, structured, words, maker):
        score = score + F.when(hit, p).otherwise(0.0)
    return F.when(F.coalesce(title, F.lit("")) != "", F.round(F.least(F.lit(0.99), score), 2)).otherwise(0.0)


def candidate_reasons(title: Column, model: Column, hay: Column, structured: Column, words: str, maker: str, raw_text: Column, rules: tuple = EXCLUSIONS) -> Column:
    """Names of what speaks for a candidate, and `excluded:` with the exclusion rule that speaks against it."""
    named = [F.when(hit, name) for hit, _, name in candidate_evidence(title, model, hay, structured, words, maker)]
    return F.array_compact(F.array(*named, F.concat(F.lit("excluded:"), exclusion_reason(title, raw_text, rules))))


def is_purchasable(state: Column, preorder: bool = False) -> Column:
    """In stock, and preorders where they count."""
    return F.coalesce(state.isin("in_stock", *(["preorder"] if preorder else [])), F.lit(False))


def with_allowed(listings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds `is_allowed`: the exclusion rules don't hold for this (source_id, url), as a reviewer said."""
    known = allowed.select("source_id", "url").distinct().withColumn("is_allowed", F.lit(True))
    return listings.join(known, ["source_id", "url"], "left").withColumn("is_allowed", F.coalesce("is_allowed", F.lit(False)))


#: How sure a state is that a reviewer gave to a term.
REVIEWED = 0.75


def reviewed_states(listings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds `override_state` and `override_term`: the longest reviewed term that the folded text holds, ties by term. Where
    listings have a state and a confidence, an override replaces both (confidence REVIEWED).

    listings: (listing_id, stated, raw_text if there is one, …), overrides: (term, state), folded. Terms are looked up by the
    rarest three characters that they have, shorter ones by themselves; each distinct text is folded and compared once.
    """
    said = F.nullif(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in ("stated", "raw_text") if c in listings.columns]), F.lit(""))
    listings = listings.withColumn("said", said)
    texts = listings.select("said").where("said is not null").distinct().withColumn("hay", alias_form(F.col("said")))
    terms = overrides.where("term <> ''").groupBy("term").agg(F.max("state").alias("override_state"))
    longest = F.max_by(F.struct("override_state", "term"), F.struct(F.length("term"), "term"))
    hits = None
    for n in (1, 2, 3):
        some = terms.where(F.length("term") == n) if n < 3 else terms.where(F.length("term") >= 3)
        held = texts.select("said", "hay", F.explode(grams(F.col("hay"), n)).alias("gram"))
        counts = held.groupBy("gram").count()
        rarest = some.withColumn("gram", F.explode(grams(F.col("term"), n))).join(counts, "gram").groupBy("term", "override_state").agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
        met = held.join(rarest, "gram").where(F.col("hay").contains(F.col("term"))).select("said", "term", "override_state")
        hits = met if hits is None else hits.union(met)
    found = hits.groupBy("said").agg(longest.alias("o")).select("said", "o.override_state", F.col("o.term").alias("override_term"))
    out = listings.join(found, "said", "left").drop("said")
    if {"state", "confidence"} <= set(listings.columns):
        over = F.col("override_state").isNotNull()
        out = out.withColumns({"state": F.coalesce("override_state", "state"), "confidence": F.when(over, REVIEWED).otherwise(F.col("confidence"))})
    return out
