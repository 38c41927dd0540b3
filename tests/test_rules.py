"""Watch rules with every criterion against a plain loop over rules and products."""

import re

import pytest

from listingwatch.operators import community, rules

CONTEXT = "product_id long, base_values array<string>, synonym_values array<string>, models array<string>, barcodes array<string>, catalog_product_id long, catalog_part_ids array<long>, locale string"
RULE = "rule_id long, keywords array<string>, mode string, exclude_terms array<string>, model string, barcode string, catalog_product_id long, catalog_part_id long, locale string, synonyms boolean"
PRODUCTS = [
    (1, ["Dran Sword BX-01 Red", "BX-01"], ["ドランソード"], ["BX-01"], ["491"], 7, [70, 71], "en"),
    (2, ["Hells Chain", "BX-21"], ["Ｈｅｌｌｓ　Chain 5-60HT", "Ratchet"], ["BX-21"], ["492"], 8, [71], "ja"),
    (3, ["ab"], None, None, None, None, None, None),
    (4, ["Dran Dagger", "bx - 01"], None, ["bx - 01"], ["491", "494"], 9, [72], "en"),
    (5, ["Kick ſtart"], [], [], [], None, [], "en"),
    (6, None, None, None, None, None, None, None),
]
RULES = [
    (1, None, "exact", None, "bx-01", None, None, None, None, None),
    (2, None, "exact", None, None, "492", None, None, None, None),
    (3, ["dran sword"], "contains", None, "BX- 01", None, None, None, None, None),
    (4, ["hells  CHAIN!"], "exact", None, None, None, None, None, None, None),
    (5, None, "exact", None, None, None, None, 71, None, None),
    (6, None, "exact", None, None, None, 8, None, "ja", None),
    (7, None, "exact", None, None, None, 8, None, "en", None),
    (8, ["WORD"], "contains", ["red"], None, None, None, None, None, None),
    (9, ["ain 5"], "contains", None, None, None, None, None, "any", None),
    (10, ["b"], "contains", None, None, None, None, None, None, None),
    (11, ["d[ra]+n (sword|dagger)"], "regex", None, None, "491", None, None, None, None),
    (12, ["agger"], "regex", None, None, None, None, None, None, None),
    (13, None, "exact", None, None, None, None, None, "en", None),
    (14, ["dran dagger", "no"], "exact", None, None, "494", 9, 72, "en", None),
    (15, ["dran"], "contains", None, None, None, None, 70, None, None),
    (16, [r"BX-\d+"], "regex", None, None, None, None, None, None, None),
    (17, ["("], "regex", None, None, None, None, None, None, None),
    (18, ["x" * 121], "regex", None, None, None, None, None, None, None),
    (19, ["ratchet"], "exact", None, None, None, None, None, None, False),
    (20, ["ratchet"], "exact", None, None, None, None, None, None, True),
    (21, ["dran"], "exact", None, None, None, None, None, None, None),
    (22, ["ドラン"], "contains", None, None, None, None, None, None, None),
    (23, [r"\d{3}|sword"], "regex", None, None, None, None, None, None, None),
    (24, ["kick start"], "regex", None, None, None, None, None, None, None),
    (25, ["", None], "contains", None, None, None, None, None, None, None),
    (26, ["zz", "ab"], "odd", ["", None], None, None, None, None, None, None),
]


def folded(text):
    import unicodedata

    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).lower()
    return re.sub(r"(?:[^\w-]|_)+", " ", re.sub(r"\s*-\s*", "-", text)).strip()


def matched_plain(p, r):
    _, base, synonyms, models, barcodes, catalog, parts, locale = p
    _, words, mode, excluded, model, barcode, of, part, wanted, expand = r
    base, synonyms, words = base or [], synonyms or [], [w for w in words or [] if w]
    hay = folded(" ".join(base + synonyms))
    if any(x and folded(x) in hay for x in excluded or []) or wanted not in (None, "any", locale):
        return None
    reasons = []
    for asked, holds, reason in (
        (of, of == catalog, "catalog_product_exact"), (part, part in (parts or []), "catalog_part_contains"),
        (model, folded(model or "") in map(folded, models or []), "model_exact"), (barcode, barcode in (barcodes or []), "barcode_exact"),
    ):
        if asked:
            if not holds:
                return None
            reasons.append(reason)
    values = base if expand is False else base + synonyms
    if words:
        if mode == "regex":
            if any(len(w) > 120 for w in words):
                return None
            try:
                hit = any(re.search(w, " ".join(values), re.IGNORECASE) for w in words)
            except re.error:
                return None
        elif mode == "contains":
            hit = any(folded(w) in folded(" ".join(values)) for w in words)
        else:
            mode, hit = "exact", any(folded(w) in map(folded, values) for w in words)
        if not hit:
            return None
        reasons.append("regex" if mode == "regex" else f"keyword_{mode}")
    if not reasons:
        return None
    return 0.99 if any("exact" in x for x in reasons) else 0.85, reasons[0], reasons


def test_every_criterion_narrows(spark):
    out = rules.match_rules(spark.createDataFrame(PRODUCTS, CONTEXT), spark.createDataFrame(RULES, RULE))
    expected = {(r[0], p[0]): matched_plain(p, r) for p in PRODUCTS for r in RULES if matched_plain(p, r)}
    assert {r for r, _ in expected} == {r[0] for r in RULES} - {7, 8, 13, 17, 18, 19, 21, 25}
    assert {(r.rule_id, r.product_id): (r.confidence, r.match_type, r.reasons) for r in out.collect()} == expected
    assert out.count() == len(expected)


@pytest.mark.parametrize("kind", ["exact", "contains", "regex"])
def test_no_products_or_rules(spark, kind):
    context, some = spark.createDataFrame(PRODUCTS, CONTEXT), spark.createDataFrame([r for r in RULES if r[2] == kind], RULE)
    assert rules.match_rules(context.limit(0), some).count() == 0
    assert rules.match_rules(context, some.limit(0)).count() == 0


def test_no_plan_pairs_all_products_with_keywords(spark):
    """Only expressions without required characters meet all products, in blocks of rules."""
    keyed = spark.createDataFrame([r for r in RULES if r[0] not in (11, 23, 24)], RULE)
    plan = rules.match_rules(spark.createDataFrame(PRODUCTS, CONTEXT), keyed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner\n" not in plan and "Join Cross" not in plan


def test_required_characters(spark):
    patterns = [r"BX-\d+", "agger", "a|agger", "(abc)?def", "colou?red", "x{2}yz", "abc*de", "kiss", "^Dran.*ger$", "[abc]def", r"\bword\b", "(?i)dran", "ab+cd"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "i int, p string")
    found = [r.w for r in df.select("i", rules.required("p").alias("w")).orderBy("i").collect()]
    assert found == ["bx-", "agger", None, "def", "colo", None, None, None, "dran", "def", "word", None, None]


def test_context(spark):
    products = spark.createDataFrame([(1, None, None, "49", "bx 1", None, 7), (2, "Set BX-02", "B-1", None, None, "50", None), (3, "", None, None, None, None, 8)], "product_id long, title string, model string, barcode string, listing_model string, listing_barcode string, catalog_product_id long")
    catalog = spark.createDataFrame([(7, "BX-01", "99"), (8, "BX-08", None)], "catalog_product_id long, product_code string, barcode string")
    aliases = spark.createDataFrame([(7, "Zed"), (7, "ドラン"), (7, None)], "catalog_product_id long, alias string")
    parts = spark.createDataFrame([(7, 70, "P1", "Bit")], "catalog_product_id long, catalog_part_id long, code string, name string")
    out = {r.product_id: r for r in rules.product_context(products, catalog, aliases, parts).collect()}
    assert (out[1].base_values, out[1].synonym_values, out[1].models, out[1].barcodes, out[1].catalog_part_ids, out[1].locale) == (["Zed", "bx 1", "BX-01", "49", "99"], ["Zed", "ドラン", "P1", "Bit"], ["bx 1", "BX-01"], ["49", "99"], [70], "en")
    assert (out[2].base_values, out[2].synonym_values, out[2].models, out[2].barcodes) == (["Set BX-02", "B-1", "50"], [], ["BX-02", "B-1"], ["50"])
    assert out[3].base_values == ["BX-08", "BX-08"]


def test_post_matches(spark):
    posts = spark.createDataFrame([(1, "New bx 38、Dran!", "en"), (2, "drandrop", "ja"), (3, None, None)], "post_id long, text string, locale string")
    asked = spark.createDataFrame([(1, "dran", "exact", None, None, None), (2, "dran", "contains", None, None, None), (3, None, "exact", None, "BX-38", None), (4, "dran", "exact", None, "BX-38", None), (5, "dran", "contains", "new", None, None), (6, "dran", "contains", None, None, "ja")], "rule_id long, keyword string, mode string, exclude string, model string, locale string")
    out = community.post_matches(posts, asked)
    assert sorted(map(tuple, out.select("rule_id", "post_id", "confidence").collect())) == [(1, 1, 0.8), (2, 1, 0.8), (2, 2, 0.8), (3, 1, 0.95), (4, 1, 0.95), (5, 2, 0.8), (6, 2, 0.8)]
