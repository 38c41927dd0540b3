"""Stored pages: structured data, links, search forms, sitemaps, robots rules, outcome of a page."""

from __future__ import annotations

import functools
import json
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..sources.tables import cut

PRODUCT = ("title", "brand", "barcode", "sku", "release_date", "price", "currency", "availability_raw", "description")
BLOCK = re.compile(r"<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>", re.I | re.S)
# Barcode fields, best first; what an outage page says; search fields.
BARCODES = ("gtin13", "gtin", "gtin12", "gtin14", "gtin8")
MAINTENANCE = r"(?i)under\s+maintenance|scheduled\s+maintenance|site\s+maintenance|we['’]?ll\s+be\s+back|temporarily\s+unavailable|service\s+unavailable|メンテナンス|臨時休業|系統維護|網站維護|服務維護|維護中|暫停(?:服務|營業)|施工中"
SEARCH_FIELDS = "q|query|keywords?|search|searchword"


def first_product(node):
    """The first node, in document order, whose @type is or holds Product; an explicit stack, as depth is the page's choice."""
    stack = [node]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            kinds = node.get("@type")
            if "product" in [str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])]:
                return node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))
    return None


def pick(node, *names):
    return next((node[n] for n in names if node.get(n) is not None), None)


def offer_fields(offer) -> tuple:
    """(price, currency, availability) of an offer; of an aggregate its low price, and the inner offer's for the rest."""
    if isinstance(offer, list):
        offer = offer[0] if offer else None
    if not isinstance(offer, dict):
        return None, None, None
    if str(offer.get("@type", "")).lower() != "aggregateoffer":
        return pick(offer, "price", "lowPrice"), offer.get("priceCurrency"), offer.get("availability")
    inner = offer.get("offers")
    inner = inner[0] if isinstance(inner, list) and inner else inner
    inner = inner if isinstance(inner, dict) else {}
    return pick(offer, "lowPrice", "price") or pick(inner, "price", "lowPrice"), pick(offer, "priceCurrency") or inner.get("priceCurrency"), pick(offer, "availability") or inner.get("availability")


def product_of(html: str | None) -> tuple:
    for block in BLOCK.findall(html or ""):
        try:
            found = first_product(json.loads(block.strip().lstrip("﻿")))
        except (ValueError, RecursionError):  # a block that isn't JSON is the page's, not ours
            continue
        if found:
            brand = found.get("brand")
            brand = brand.get("name") if isinstance(brand, dict) else brand
            fields = (found.get("name"), brand, pick(found, *BARCODES), pick(found, "sku", "mpn"), found.get("releaseDate"), *offer_fields(found.get("offers")), found.get("description"))
            return tuple(None if f is None else f if isinstance(f, str) else json.dumps(f, ensure_ascii=False) for f in fields)
    return (None,) * len(PRODUCT)


def read_once(read, names: list[str], *columns: pa.Array) -> pa.Array:
    """Structs of what `read` gives, as texts under the names, for the rows of a batch; equal rows are read once."""
    coded = [column.dictionary_encode(null_encoding="encode") for column in columns]
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for c in coded:
        key = key * len(c.dictionary) + c.indices.to_numpy()
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    found = [read(*row) for row in zip(*[column.take(pa.array(first)).to_pylist() for column in columns])]
    fields = zip(*found) if found else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(field, pa.string()) for field in fields], names).take(pa.array(which))


def texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


@F.arrow_udf(texts(*PRODUCT))
def structured_product(html: pa.Array) -> pa.Array:
    """The page's first Product of JSON-LD; every field null where there is none."""
    return read_once(product_of, list(PRODUCT), html)


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def outcome(html: Column, usable: Column) -> Column:
    """ok if the page gave a listing; else maintenance if title, heading or the body's beginning say so; else empty."""
    head = F.concat_ws(" ", title_of(html), F.regexp_extract(html, r"(?is)<h[12][^>]*>(.*?)</h[12]>", 1), F.substring(visible_text(html), 1, 2000))
    return F.when(usable, "ok").when(head.rlike(MAINTENANCE), "maintenance").otherwise("empty")


def is_usable(*fields: Column, price: Column | None = None) -> Column:
    """Some field has a value: an empty text is none, but a price is one unless it is null."""
    out = F.lit(False) if price is None else price.isNotNull()
    for f in fields:
        out = out | F.coalesce(f.cast("string") != "", F.lit(False))
    return out


def resolve(href: Column, base: Column) -> Column:
    """A link's address against the page's: absolute, //host, /path, ?query or relative; null for other schemes."""
    href = F.trim(href)
    site = F.concat(F.lower(urls.piece(base, 1)), F.lit("://"), F.lower(urls.piece(base, 2)))
    path = urls.piece(base, 3)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(F.lower(urls.piece(base, 1)), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, path, href))
        .when((href == "") | href.startswith("#"), F.concat(site, path))
        .otherwise(F.concat(site, folder, href))
    )


def normalized_at(href: Column, base: Column) -> Column:
    """urls.normalized of a link's address against its page's, without dot segments, and with parameters encoded anew. A text
    that is no address is trimmed; an empty one or null stays so."""

    def parts(url: Column) -> Column:
        scheme, host, path = F.lower(urls.piece(url, 1)), F.lower(urls.piece(url, 2)), urls.piece(url, 3)
        host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
        path = F.regexp_replace(urls.without_dots(F.when(path == "", "/").otherwise(path)), "(?<=.)/$", "")
        return F.struct(scheme.alias("scheme"), F.concat(scheme, F.lit("://"), host, path, urls.form_query(urls.piece(url, 4), urls.TRACKING)).alias("url"))

    own = F.trim(href)
    url = F.when(own.startswith("#"), base).otherwise(F.coalesce(resolve(own, base), own))
    return F.when((href == ""), own).otherwise(urls.once(urls.once(url, parts), lambda p: F.when(p["scheme"] == "", own).otherwise(p["url"])))


def invalid_reason(url: Column, base: Column, usable: Column) -> Column:
    """Why a listing can't be taken: `missing-url`, `no-product-fields`, or null. url may be relative to its source's base."""
    return F.when(F.coalesce(normalized_at(url, base), F.lit("")) == "", "missing-url").when(~usable, "no-product-fields")


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (page_id, target) of a[href] that stay on the page's site, as identities. pages: (page_id, url, html)."""
    # quoted or bare; entities in an address stand for their characters
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"))
    found = pages.select("page_id", "url", F.explode(F.array_distinct(hrefs)).alias("href"))
    bare = F.regexp_replace("href", "^[\"']|[\"']$", "")
    found = found.withColumn("href", F.regexp_replace(F.regexp_replace(bare, "(?i)&(amp|#38|#x26);", "&"), "(?i)&(quot|#34);", "\""))
    found = found.withColumn("target", urls.canonical(resolve(F.col("href"), F.col("url"))))
    site = lambda c: urls.registrable_domain(urls.bare_host(F.col(c)))
    return found.where(F.col("target").isNotNull() & (site("target") == site("url"))).select("page_id", "target").distinct()


def page_anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, href, text) of a[href], as often as they occur. A link's text goes up to its end tag or the next link,
    with white space folded, and 200 characters at most. pages: (page_id, url, html)."""
    piece = F.explode(F.filter(F.split("html", r"(?i)(?=<a\b)"), lambda p: p.rlike(r"(?i)^<a\b")))
    rows = pages.select("page_id", "url", piece.alias("piece"))
    href = F.regexp_extract("piece", r"(?i)^<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "(?i)&(amp|#38|#x26);", "&"), "(?i)&(quot|#34);", "\"")
    text = F.regexp_replace(F.regexp_replace("piece", r"(?i)^<a\b[^>]*>?", ""), r"(?is)</a\b.*$", "")
    text = F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\s+", " ")), 1, 200)
    return rows.where(href != "").select("page_id", "url", plain(F.regexp_replace(href, "^[\"']|[\"']$", "")).alias("href"), plain(text).alias("text"))


def scored_links(pages: DataFrame, rules: DataFrame, brand: str, model: str, include: tuple = (), exclude: tuple = (), least: int = 10) -> DataFrame:
    """(page_id, target, score, priority) of the links that a walk follows: on the page's site, allowed by robots rules, and with
    hints of `least` points or more. A target that a page links to more than once takes its best score.

    rules: `robots_rules`' rows. Robots and hints see the address as it would be fetched.
    """
    site = lambda c: urls.registrable_domain(urls.bare_host(c))
    target = urls.once(resolve(F.col("href"), F.col("url")), urls.fetchable)
    score = urls.once(F.struct(F.col("target"), F.col("text")), lambda s: urls.hint_score(s["target"], s["text"], brand, model, include, exclude))
    found = page_anchors(pages).select("page_id", F.col("url").alias("base"), target.alias("target"), "text")
    scored = found.select("page_id", F.col("target").alias("url"), F.when(urls.once(F.col("target"), site) == site(F.col("base")), score).alias("score")).where(F.col("score") >= least)
    best = cut(scored.groupBy("page_id", "url").agg(F.max("score").alias("score")), "scored-links")  # read twice below
    kept = robots_allowed(best, rules).where("allowed")
    return kept.select("page_id", F.col("url").alias("target"), "score", F.least(F.lit(100), F.col("score") + 35).alias("priority"))


def search_urls(pages: DataFrame, term: str) -> DataFrame:
    """(page_id, target) of GET forms with a search field, filled with the term."""
    form = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<form\b.*?</form>)")))
    rows = pages.select("page_id", "url", form.alias("form"))
    attribute = lambda name: F.regexp_extract("form", rf"(?is)^<form\b[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    field = F.regexp_extract("form", rf"(?i)<input\b[^>]*?\bname\s*=\s*[\"']({SEARCH_FIELDS})[\"']", 1)
    rows = rows.select("page_id", "url", attribute("action").alias("action"), F.lower(attribute("method")).alias("method"), field.alias("field"))
    target = F.concat(F.regexp_replace(resolve(F.col("action"), F.col("url")), r"[?#].*$", ""), F.lit("?"), "field", F.lit("="), F.url_encode(F.lit(term)))
    return rows.where("field <> '' and method in ('', 'get')").select("page_id", target.alias("target")).where("target is not null")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_id, kind, loc) of sitemaps (sitemap_id, xml): pages and further sitemaps."""
    locs = lambda kind: F.transform(F.xpath("xml", F.lit(f"//*[local-name()='{kind}']/*[local-name()='loc']/text()")), lambda u: F.struct(F.lit(kind).alias("kind"), F.trim(u).alias("loc")))
    return sitemaps.select("sitemap_id", F.inline(F.concat(locs("url"), locs("sitemap"))))


def robots_lines(robots: DataFrame) -> DataFrame:
    """(host, nth, key, value) of the lines of robots files (host, body), without comments; keys in lower case."""
    rows = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("nth", "line"))
    rows = rows.select("host", "nth", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where(F.col("line").contains(":"))
    return rows.select("host", "nth", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Distinct (host, sitemap) that robots files (host, body) name; they hold for every agent."""
    return robots_lines(robots).where("key = 'sitemap' and value <> ''").select("host", F.col("value").alias("sitemap")).distinct()


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern) that hold for the agent: its own groups if it has any, else those of `*`.

    robots: (host, body). Consecutive user-agent lines open one group.
    """
    rows = robots_lines(robots).where("key in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("host").orderBy("nth")  # one file's lines, a few hundred by convention
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    grouped = rows.withColumn("group", F.sum(opens.cast("int")).over(w))
    agents = grouped.where("key = 'user-agent'").select("host", "group", F.lower("value").alias("name")).where((F.col("name") == "*") | F.lit(agent.lower()).contains(F.col("name")))
    own = agents.groupBy("host").agg(F.bool_or(F.col("name") != "*").alias("own"))
    used = agents.join(own, "host").where((F.col("name") != "*") == F.col("own")).select("host", "group").distinct()
    return grouped.where("key <> 'user-agent' and value <> ''").join(used, ["host", "group"]).select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def path_rules(rules: DataFrame, count_signs: bool = False) -> DataFrame:
    """(host, prefix, rest, allow, length) of rules (host, allow, pattern): the literal text before the first wildcard, and for
    a rule with wildcards or an anchor a regular expression of what has to follow it (else null). A rule is as long as its
    pattern without `*` and `$`, or with them if count_signs."""
    literal = F.regexp_replace(F.regexp_extract("pattern", r"^([^*]*)", 1), r"\$$", "")
    literal = F.when(F.col("pattern").contains("*"), F.regexp_extract("pattern", r"^([^*]*)", 1)).otherwise(literal)
    left = F.substring("pattern", F.length(literal) + 1, F.length("pattern"))
    escaped = F.regexp_replace(F.regexp_replace(left, r"([\\.\[\]{}()+?^|])", r"\\$1"), r"\*", ".*")
    rest = F.when(left != "", F.concat(F.lit("^"), F.regexp_replace(escaped, r"\$(?!$)", r"\\\$")))
    return rules.select("host", literal.alias("prefix"), rest.alias("rest"), "allow", F.length("pattern" if count_signs else F.regexp_replace("pattern", r"[*$]", "")).alias("length")).distinct()


def robots_allowed(links: DataFrame, rules: DataFrame, count_signs: bool = False) -> DataFrame:
    """Adds `allowed` to (url, …): the longest rule of the host that fits the path decides, allow wins ties. With count_signs
    wildcards and anchors count as length, as crawlers that follow RFC 9309 have it.

    Rules are a trie of literal prefixes: a path is looked up by its own beginnings, of the lengths that its host has rules
    of, so it only meets rules whose prefix it has. The rest of a rule with wildcards is then searched in the rest of the path.
    """
    path = F.concat(F.when(urls.piece(F.col("url"), 3) == "", "/").otherwise(urls.piece(F.col("url"), 3)), F.when(F.col("url").contains("?"), F.concat(F.lit("?"), urls.piece(F.col("url"), 4))).otherwise(""))
    asked = links.select("url").distinct().select("url", urls.bare_host(F.col("url")).alias("host"), path.alias("path"))
    trie = path_rules(rules, count_signs)
    sizes = trie.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("sizes"))  # lengths, not rules: as many as the longest path has characters
    begun = asked.join(sizes, "host").withColumn("size", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))))
    begun = begun.withColumn("prefix", F.expr("substring(path, 1, size)"))
    hits = begun.join(trie, ["host", "prefix"]).where(F.expr("rest is null or substring(path, size + 1, length(path)) rlike rest"))
    verdict = hits.groupBy("url").agg(F.max_by("allow", F.struct("length", "allow")).alias("allow"))
    return links.join(verdict, "url", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


# Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
STEP = re.compile(r"([#.]?[\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\]\"']*)[\"']?\s*)?\]")
SELECTED = ("title", "price", "currency", "availability_text", "image", "buy_button")


@functools.lru_cache(maxsize=4096)
def recipe_paths(recipe: str) -> dict[str, list]:
    """Fields of a recipe with their choices of paths; a path is its steps, a step its (name, attribute, value) conditions."""
    return {n: [[STEP.findall(step) for step in choice.split()] for choice in s.split(",") if choice.strip()] for n, s in json.loads(recipe).items() if s and n in SELECTED}


def fits(step: list, tag: str, attrs: dict) -> bool:
    """Whether an element fits one step of a selector: tag, #id, .class, [attribute] and [attribute=value], in any mix."""
    for name, attribute, value in step:
        if attribute:
            if attribute not in attrs or (value and attrs[attribute] != value):
                return False
        elif name[0] == "#" and attrs.get("id") != name[1:] or name[0] == "." and name[1:] not in (attrs.get("class") or "").split() or name[0] not in "#." and name.lower() != tag:
            return False
    return True


class Selected(HTMLParser):
    """The text or address of the first element that each selector of a recipe fits; for buttons, whether one is enabled."""

    def __init__(self, paths: dict):
        super().__init__(convert_charrefs=True)
        self.recipe = paths
        self.open, self.found, self.reading = [], {}, {}

    def chosen(self, paths: list) -> bool:
        """Whether the innermost open element ends a path whose other steps fit elements around it, in order."""
        for path in paths:
            if not fits(path[-1], *self.open[-1]):
                continue
            around = iter(self.open[:-1])
            if all(any(fits(step, *e) for e in around) for step in path[:-1]):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.open.append((tag, attrs))
        for name, paths in self.recipe.items():
            if name == "buy_button":
                off = "disabled" in attrs or (attrs.get("aria-disabled") or "").strip().lower() == "true"
                if not off and self.chosen(paths):
                    self.found[name] = "true"
            elif name not in self.found and self.chosen(paths):
                self.found[name] = (attrs.get("src") or attrs.get("content") or "") if name == "image" else ""
                if name != "image" and tag not in VOID:
                    self.reading[name] = len(self.open)
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is not None:
            del self.open[depth:]
            self.reading = {n: d for n, d in self.reading.items() if d <= depth}

    def handle_data(self, data):
        for name in self.reading:
            self.found[name] += data


def selected(html: str | None, recipe: str | None) -> tuple:
    if not html or not recipe:
        return (None,) * len(SELECTED)
    reader = Selected(recipe_paths(recipe))
    reader.feed(html)
    reader.close()
    button = reader.found.get("buy_button", "false") if "buy_button" in reader.recipe else None
    return (*[(reader.found.get(n) or "").strip() or None for n in SELECTED[:-1]], button)


@F.arrow_udf(texts(*SELECTED))
def selected_fields(html: pa.Array, recipe: pa.Array) -> pa.Array:
    """What a recipe (JSON of field to selector) finds on a page: steps of `fits`, descendants by spaces, choices by commas."""
    return read_once(selected, list(SELECTED), html, recipe)


def parsed(html: str | None, recipe: str | None) -> tuple:
    """The fields of the page's structured data, then those that the recipe finds. It is asked only where there is no product
    or it lacks title, price or availability."""
    product = product_of(html)
    title, price, raw = (product[PRODUCT.index(name)] for name in ("title", "price", "availability_raw"))
    return product + selected(html if title is None or price is None or not raw else None, recipe)


PARSED = [f"p_{name}" for name in PRODUCT] + [f"c_{name}" for name in SELECTED]


@F.arrow_udf(texts(*PARSED))
def parsed_fields(html: pa.Array, recipe: pa.Array) -> pa.Array:
    """`parsed` of pages and their recipes (JSON of field to selector)."""
    return read_once(parsed, PARSED, html, recipe)


def parsed_pages(pages: DataFrame, recipes: DataFrame) -> DataFrame:
    """(page_id, fields of a listing, raw_text): structured data first, then the source's recipe for what is missing.

    pages: (page_id, source_id, html), recipes: (source_id, recipe). The recipe is asked only where there is no product or it
    lacks title, price or availability; it fills blanks, but its availability text and button are always taken. raw_text is
    the product's title and the beginning of its description, without a product the page's title. Recipes, one a source, go to
    the pages, which are wide and stay in their partitions: equal ones of a partition are brought together and read once a batch.
    """
    # Spark drops an order that pages came with at the join
    joined = pages.join(F.broadcast(recipes.select("source_id", "recipe")), "source_id", "left").sortWithinPartitions(F.xxhash64("html"))
    rows = joined.withColumn("f", parsed_fields("html", "recipe"))
    filled = lambda c: F.coalesce(F.nullif(F.col(f"f.p_{c}"), F.lit("")), F.col(f"f.c_{c}")).alias(c)
    is_product = F.coalesce(*[F.col(f"f.p_{c}") for c in PRODUCT]).isNotNull()
    title = F.coalesce(F.nullif("f.p_title", F.lit("")), "f.c_title")
    about = F.trim(F.concat_ws(" ", title, F.substring("f.p_description", 1, 300)))
    own = lambda c: F.col(f"f.p_{c}").alias(c)
    return rows.select(
        "page_id", "source_id", filled("title"), F.coalesce("f.p_price", "f.c_price").alias("price"), filled("currency"), own("availability_raw"), F.col("f.c_availability_text").alias("availability_text"),
        F.col("f.c_buy_button").cast("boolean").alias("has_buy_button"), own("brand"), own("barcode"), own("sku"), F.when(is_product, about).otherwise(title_of(F.col("html"))).alias("raw_text"),
    )
