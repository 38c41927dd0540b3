"""Column builders for titles, prices, codes and dates of multilingual shop listings.

A word boundary is written with look-arounds over ASCII letters and digits, as Java's own also counts CJK characters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Full-width forms U+FF01-FF5E stand 0xFEE0 above ASCII; U+3000 is the wide space.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
SPACES = r"[\s   -     　﻿]+"
#: Runs of white space that are anything else than one plain space, runs with hyphens to close, and runs of other signs: what
#: replacing by one space (or hyphen) changes. Most runs of a text are one plain space and are passed over.
ODD_SPACES = SPACES[:-1] + "{2,}|" + SPACES[:-2] + "&&[^ ]]"
HYPHENS = " +- *|- +"
SIGNS = r"[^\p{L}\p{N} -][^\p{L}\p{N}-]*| [^\p{L}\p{N}-]+"
BEFORE, AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# Currency signs and codes.
CURRENCIES = {
    "$": "USD", "US$": "USD", "NT$": "TWD", "HK$": "HKD", "A$": "AUD", "¥": "JPY", "￥": "JPY", "円": "JPY",
    "€": "EUR", "£": "GBP", "₩": "KRW", "RM": "MYR", "S$": "SGD", "฿": "THB", "₫": "VND", "₱": "PHP",
}
CURRENCY_IN_TEXT = r"US\$|NT\$|HK\$|A\$|S\$|RM|[A-Z]{3}|[$¥￥€£₩฿₫₱]|円"
# Model prefixes, words of editions, colours and taxes, as shops write them.
MODEL_PREFIXES = ("BX", "CX", "UX", "B", "CB", "SB", "BB", "BBG", "WBBA", "GT", "SL")
EDITIONS = {
    "limited": r"限定|limited(?: edition)?|exclusive|イベント限定|會場限定|会場限定",
    "rare-color": r"レアカラー|rare color|稀有色",
}
COLOURS = {
    "clear": ("clear", "クリア|透明"),
    "red": ("red", "レッド|紅色|赤色?"),
    "blue": ("blue", "ブルー|藍色|青色?"),
    "black": ("black", "ブラック|黑色|黒色?"),
    "white": ("white", "ホワイト|白色?"),
    "gold": ("gold", "ゴールド|金色"),
    "silver": ("silver", "シルバー|銀色"),
    "green": ("green", "グリーン|綠色|緑色?"),
    "purple": ("purple", "パープル|紫色?"),
    "pink": ("pink", "ピンク|粉紅色|桃色"),
}
COLOUR_CONTEXT = r"color|colour|カラー|色違い|異色|配色"
TAX_IN = r"(?i)(税込|含稅|含税|tax included|including tax|inc\.? vat)"
TAX_OUT = r"(?i)(税抜|稅前|未稅|未税|tax excluded|excluding tax|excl\.? vat)"


# Dashes and curly quotes with their plain forms.
FANCY = "‐‑‒–—―−" + "‘’“”"
PLAIN = "-------" + "''" + '""'


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_unicode(text: Column) -> Column:
    """NFKC, which Spark has no function for, then plain dashes and quotes. Texts of ASCII only don't go to Python."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.translate(F.when(other, nfkc(F.when(other, text))).otherwise(text), FANCY, PLAIN)


def to_half_width(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def squeeze(text: Column) -> Column:
    """NFKC and half width, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(to_half_width(normalize_unicode(text)), ODD_SPACES, " "))


def fold(text: Column) -> Column:
    """Lower case without spaces around hyphens; all but letters, digits and hyphens becomes a space."""
    joined = F.regexp_replace(F.lower(F.regexp_replace(text, ODD_SPACES, " ")), HYPHENS, "-")
    return F.trim(F.regexp_replace(joined, SIGNS, " "))


def alias_form(text: Column) -> Column:
    """The folded form by which names are compared, of the text in NFKC."""
    return fold(squeeze(text))


def grams(text: Column, n: int) -> Column:
    """The different runs of n characters; null if the text is shorter. The text is taken apart once, so the work is of its length."""
    runs = lambda signs: F.transform(F.sequence(F.lit(1), F.size(signs) - n + 1), lambda i: F.array_join(F.slice(signs, i, n), ""))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.array(F.split(text, "")), runs)[0]))


def locale_of(text: Column) -> Column:
    return F.when(text.rlike("[぀-ヿ]"), "ja").when(text.rlike(r"\p{IsHan}"), "zh-TW").otherwise("en")


def currency_code(text: Column) -> Column:
    """Three letters are a code; else the longest sign that occurs; else the text in upper case."""
    trimmed = F.trim(text)
    out = F.upper(trimmed)
    for sign in sorted(CURRENCIES, key=len):
        out = F.when(to_half_width(trimmed).contains(sign), CURRENCIES[sign]).otherwise(out)
    return F.when(trimmed == "", None).when(trimmed.rlike("^[A-Za-z]{3}$"), F.upper(trimmed)).otherwise(out)


def price_of(text: Column, hint: Column | None = None) -> Column:
    """struct<price: double, currency: string>; commas are taken for thousands separators."""
    narrow = F.trim(to_half_width(text))
    sign = F.nullif(F.regexp_extract(narrow, f"({CURRENCY_IN_TEXT})", 1), F.lit(""))
    number = F.regexp_extract(F.regexp_replace(narrow, "[, ]", ""), r"(-?\d+(?:\.\d+)?)", 1)
    given = currency_code(hint) if hint is not None else F.lit(None).cast("string")
    return F.struct(F.nullif(number, F.lit("")).cast("double").alias("price"), F.coalesce(given, currency_code(sign)).alias("currency"))


def model_code(text: Column, prefixes=MODEL_PREFIXES) -> Column:
    """First model code in the text as PREFIX-NN, or null."""
    pattern = f"(?i){BEFORE}({'|'.join(sorted(prefixes, key=len, reverse=True))})[-\\s]?(\\d{{2,3}}){AFTER}"
    narrow = to_half_width(text)
    code = F.concat(F.upper(F.regexp_extract(narrow, pattern, 1)), F.lit("-"), F.regexp_extract(narrow, pattern, 2))
    return F.nullif(code, F.lit("-"))


def listing_model(model: Column, code: Column, title: Column) -> Column:
    """A listing's model: the one it states (as a code if it is one, else in upper case), else a code in its SKU or title."""
    stated = F.nullif(F.trim(model), F.lit(""))
    return F.when(stated.isNotNull(), F.coalesce(model_code(stated), F.upper(stated))).otherwise(F.coalesce(model_code(code), model_code(title)))


def barcode(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits).between(8, 14), digits)


def sku(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(normalize_unicode(text)), r"[^\p{L}\p{N}-]+", ""), F.lit(""))


def variant_key(text: Column) -> Column:
    """Edition marks, and colours where the text speaks of an edition or a colour or ends with the colour."""
    text = normalize_unicode(text)
    editions = [F.when(text.rlike(f"(?iu)(?:{p})"), k) for k, p in EDITIONS.items()]
    context = text.rlike(f"(?iu)(?:{COLOUR_CONTEXT})")
    for p in EDITIONS.values():
        context = context | text.rlike(f"(?iu)(?:{p})")
    colours = []
    for k, (latin, other) in COLOURS.items():
        one = f"(?:{BEFORE}{latin}{AFTER}|{other})"
        colours.append(F.when(text.rlike(f"(?iu){one}") & (context | text.rlike(f"(?iu){one}[\\s）)\\]】]*$")), k))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*editions, *colours))))
    return F.nullif(F.array_join(found, "|"), F.lit(""))


def tax_included(text: Column) -> Column:
    text = normalize_unicode(text)
    return F.when(text.rlike(TAX_IN), True).when(text.rlike(TAX_OUT), False)


def release_date(text: Column) -> Column:
    """A date written with 年月日, slashes, dots or hyphens; null if there is no such day."""
    plain = F.regexp_replace(F.trim(normalize_unicode(text)), r"(\d{4})年(\d{1,2})月(\d{1,2})日", "$1-$2-$3")
    parts = [F.regexp_extract(plain, r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", i) for i in (1, 3, 4)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(parts[0] != "", F.try_to_date(iso, "yyyy-MM-dd"))


def date_time(text: Column, offset: str = "+00:00") -> Column:
    """A moment written as Y/M/D H:M[:S], with dots or hyphens too, at the given offset; or ISO 8601. Else null."""
    plain = F.trim(normalize_unicode(text))
    # Fixed value: how shops write a date with a time.
    local = r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})[ T](\d{1,2}):(\d{2})(?::(\d{2}))?$"
    part = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(plain, local, i), F.lit("")), F.lit("0")), 2, "0")
    written = F.concat(F.regexp_extract(plain, local, 1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit(offset))
    iso = F.when(plain.rlike(local), written).when(plain.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}.*)?$"), plain)
    return F.to_utc_timestamp(F.try_to_timestamp(iso), F.current_timezone()).cast("timestamp_ntz")


def terms(text: Column, most: int = 20) -> Column:
    """Comma-separated terms, squeezed, distinct, at most `most` of them."""
    # NFKC must not see the commas, as it makes others of wide ones; and a lambda can't call Python
    plain = F.split(to_half_width(normalize_unicode(F.translate(text, ",", "\x01"))), "\x01")
    split = F.transform(plain, lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    return F.slice(F.array_distinct(F.filter(split, lambda x: x != "")), 1, most)


def redact(text: Column, most: int = 2000) -> Column:
    """Bot tokens, URLs, key=value secrets and long tokens become marks."""
    out = F.regexp_replace(text, r"bot\d+:[A-Za-z0-9_-]+", "bot[token]")
    out = F.regexp_replace(out, r"\b\d{6,}:[A-Za-z0-9_-]{20,}", "[token]")
    out = F.regexp_replace(out, r"(?i)https?://[^\s'\"<>]+", "[url]")
    secret = r"(?i)\b(token|secret|password|api[_-]?key|authorization|webhook)\s*[=:]\s*(?:(?:bearer|basic)\s+)?[^\s,;&]+"
    out = F.regexp_replace(out, secret, "$1=[secret]")
    out = F.regexp_replace(out, r"[A-Za-z0-9_-]{24,}", "[token]")
    return F.substring(out, 1, most)


# What an error's text says, the first that fits.
ERROR_CLASSES = (
    (r"exceeds \d+ bytes|too large|size limit|超過.*大小", "too_large"),
    (r"timeout|timed out|ETIMEDOUT|ESOCKETTIMEDOUT", "timeout"),
    (r"ENOTFOUND|EAI_AGAIN|getaddrinfo", "dns"),
    (r"ECONNREFUSED|ECONNRESET|EHOSTUNREACH|ENETUNREACH|EPIPE|socket hang up|network|fetch failed", "connection"),
    (r"certificate|self[- ]signed|TLS|SSL|ERR_TLS|DEPTH_ZERO", "tls"),
    (r"no candidates recognised|沒有辨識到候選商品", "no_candidates"),
    (r"robots", "robots_blocked"),
    (r"CAPTCHA|queue-?it|access denied|forbidden|paywall", "access_blocked"),
    (r"暫停|paused|network.*disabled|disabled.*network", "network_paused"),
    (r"parse|selector|cheerio|json-?ld|unexpected token|invalid json|no listings|0 items|failed to process", "parse"),
    (r"找不到|not found|見つかり", "not_found"),
    (r"invalid|格式|validation|無效|schema", "validation"),
)
# Fixed value: how a message states an HTTP status.
HTTP_STATUS = r"(?i)\b(?:HTTP\s*|status\s*|status[_-]?code[=:\s]*)(\d{3})\b"


def error_class(text: Column) -> Column:
    """Bounded label of an error message."""
    out = F.lit("error")
    for pattern, label in reversed(ERROR_CLASSES[1:]):
        out = F.when(text.rlike(f"(?i){pattern}"), label).otherwise(out)
    loose = F.regexp_extract(text, r"\b([45]\d\d)\b", 1)
    out = F.when((loose != "") & text.rlike("(?i)http|status|response|request"), F.concat(F.lit("http_"), loose)).otherwise(out)
    out = F.when(text.rlike(f"(?i){ERROR_CLASSES[0][0]}"), ERROR_CLASSES[0][1]).otherwise(out)
    status = F.regexp_extract(text, HTTP_STATUS, 1)
    return F.when(text.isNull() | (text == ""), "unknown").when(status != "", F.concat(F.lit("http_"), status)).otherwise(out)
