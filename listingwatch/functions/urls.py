"""Column builders for URLs: identity form, registrable domain, hints. Built from pattern pieces, as strict URI parsing
rejects much of what pages hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track or only change the display, and suffixes of two labels.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "ref_", "spm", "_ga")
MAILING = ("mc_cid", "mc_eid")
DISPLAY = ("wovn",)
SUFFIXES = ("co.jp", "ne.jp", "or.jp", "com.tw", "net.tw", "org.tw", "co.uk", "org.uk", "com.au", "net.au", "co.nz", "com.sg", "com.hk", "com.my", "co.kr", "co.th")
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used; large expressions stay small to compile."""
    return F.element_at(F.transform(F.array(value), use), 1)


def piece(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), URL, i)


def query_without(query: Column, dropped: tuple[str, ...]) -> Column:
    """Parameters in the order of their names, without the dropped ones; with its question mark, or empty."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*dropped))
    named = F.transform(kept, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), p.alias("param")))
    text = F.array_join(F.transform(F.array_sort(named), lambda p: p["param"]), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def bare_host(url: Column) -> Column:
    """Host in lower case, without port."""
    return F.regexp_replace(F.lower(piece(url, 2)), r":\d+$", "")


def normalized(url: Column) -> Column:
    """Without fragment, tracking parameters and one trailing slash, parameters sorted; other text only trimmed."""
    scheme, host = F.lower(piece(url, 1)), F.lower(piece(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = piece(url, 3)
    path = F.when(path == "", "/").when(path != "/", F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(scheme == "", F.trim(url)).otherwise(F.concat(scheme, F.lit("://"), host, path, query_without(piece(url, 4), TRACKING)))


def refused(url: Column) -> Column:
    """Why an address can't be watched: unsupported_protocol, credentials_not_allowed, invalid_url; or null."""
    scheme = F.lower(piece(url, 1))
    no_url = F.coalesce((scheme == "") | (bare_host(url) == ""), F.lit(True))
    return F.when(no_url, "invalid_url").when(~scheme.isin("http", "https"), "unsupported_protocol").when(piece(url, 2).contains("@"), "credentials_not_allowed")


def _seed(url: Column, host: Column, dropped: tuple[str, ...]) -> Column:
    path = F.regexp_replace(piece(url, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.when(refused(url).isNull(), F.concat(F.lit("https://"), host, path, query_without(piece(url, 4), dropped)))


def canonical(url: Column) -> Column:
    """Identity of a page: https, host without www and port, no fragment, tracking or display parameters, no trailing
    slashes. Null if it is refused."""
    return _seed(url, F.regexp_replace(bare_host(url), r"^www\.", ""), TRACKING + MAILING + DISPLAY)


def fetchable(url: Column) -> Column:
    """The address to fetch a page by: as its identity, but with www and display parameters."""
    return _seed(url, bare_host(url), TRACKING + MAILING)


def fingerprint(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def registrable_domain(host: Column, overrides: dict[str, str] | None = None) -> Column:
    """The domain that a host belongs to; `overrides` names it for hosts that the suffix rule gets wrong."""
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.$", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    address = host.rlike(r"^\d+\.\d+\.\d+\.\d+$") | host.contains(":") | (host == "localhost")
    found = F.when(address, host).when(two.isin(*SUFFIXES), three).otherwise(two)
    if not overrides:
        return found
    return F.coalesce(F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])[host], found)


def is_public(host: Column) -> Column:
    """False for loopback, private, link-local, shared and multicast addresses and for local names. Only literal addresses are
    read as such: four numbers, or a text with a colon (in brackets or not, with or without a zone); a name that looks like the
    start of one is a name."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"\.$", ""), r"^\[|\]$|%.*$", "")
    number = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    private = rf"^((0|10|127)\.{number}|169\.254|192\.168|172\.(1[6-9]|2\d|3[01])|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])|(22[4-9]|2[34]\d|25[0-5])\.{number})\.{number}\.{number}$"
    inner = host.contains(":") & host.rlike(r"^(::1?$|fe80:|f[cd])")
    named = host.rlike(r"(^|\.)localhost$|\.local$|\.internal$")
    return ~(host.rlike(private) | inner | named) & (host != "")


def decoded(text: Column) -> Column:
    """Percent-encoded bytes as characters; a text that isn't well encoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def hints(url: Column, text: Column, brand: str, model: str, include: tuple = (), exclude: tuple = ()) -> list[tuple[Column, int, str]]:
    """What a link's address and text say of where it leads, with points and a name. The path counts as people read it: decoded."""
    hay = F.lower(F.concat_ws(" ", decoded(piece(url, 3)), F.when(piece(url, 4) != "", F.concat(F.lit("?"), piece(url, 4))).otherwise(""), text))
    anyone = lambda ts: F.exists(F.array(*map(F.lit, ts)), lambda t: hay.contains(t)) if ts else F.lit(False)
    # The path patterns and points.
    return [
        (hay.rlike(brand), 45, "brand"),
        (hay.rlike(model), 45, "model"),
        (hay.rlike(r"/g/g|/product|/products|/item|/goods|/p/"), 20, "product_path"),
        (hay.rlike(r"category|collection|search|catalog|c/c|page=|pageno="), 10, "listing_path"),
        (hay.rlike(r"login|signin|account|cart|checkout|privacy|terms|contact|javascript:|mailto:"), -100, ""),
        (anyone(exclude), -100, "excluded"),
        (anyone(include), 30, "included"),
    ]


def hint_score(url: Column, text: Column, brand: str, model: str, include: tuple = (), exclude: tuple = ()) -> Column:
    """How likely a link leads to a product: brand and model words, product and category paths, account pages."""
    score = F.lit(0)
    for hit, points, _ in hints(url, text, brand, model, include, exclude):
        score = score + F.when(hit, points).otherwise(0)
    return score


def hint_reasons(url: Column, text: Column, brand: str, model: str, include: tuple = (), exclude: tuple = ()) -> Column:
    """Names of the hints that hold."""
    return F.array_compact(F.array(*[F.when(hit, name) for hit, _, name in hints(url, text, brand, model, include, exclude) if name]))


def source_key(domain: Column) -> Column:
    """A domain as a key: letters and digits with single hyphens between, at most 60 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(domain), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)


def display_name(domain: Column) -> Column:
    """A domain's first label with a capital; the domain itself if that label is empty."""
    label = F.coalesce(F.nullif(F.substring_index(domain, ".", 1), F.lit("")), domain)
    return F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 2**31 - 1))


def form_query(query: Column, dropped: tuple[str, ...]) -> Column:
    """As query_without, with every name and value decoded and encoded again the way forms do it: a space is `+`, a name without
    a value gets an empty one. Parameters of one name stay in their order."""
    plain = lambda t: F.coalesce(F.try_url_decode(t), F.replace(t, F.lit("+"), F.lit(" ")))
    pair = lambda p, i: F.struct(plain(F.substring_index(p, "=", 1)).alias("name"), i.alias("at"), plain(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(*dropped)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` segments, encoded or not: the second takes the segment before it along."""
    dots = lambda s: F.regexp_replace(s, "(?i)%2e", ".")
    step = lambda done, s: F.when(dots(s) == ".", done).when(dots(s) == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    def folded(segments: Column) -> Column:
        kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), step)
        # a dot at the end leaves its folder's slash
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(dots(F.element_at(segments, -1)).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))

    return once(path, lambda p: F.when(p.rlike(r"(?i)/(\.|%2e)"), once(F.split(p, "/", -1), folded)).otherwise(p))
