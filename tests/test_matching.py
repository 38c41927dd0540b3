"""Product matching on whole keys against a plain loop."""

import random

from listingwatch.operators import matching

FIELDS = "barcode string, sku string, model string, brand string, variant string"


def plain(listing, products):
    def same(a, b):
        return a is None or b is None or a.lower() == b.lower()

    barcode, sku, model, brand, variant = listing
    hits = [p[0] for p in products if barcode is not None and p[1] == barcode]
    if hits:
        return min(hits), "barcode"
    hits = [p[0] for p in products if sku is not None and p[2] == sku and same(p[3], model) and same(p[4], brand)]
    if len(hits) == 1:
        return hits[0], "sku"
    every = [p for p in products if model is not None and p[3] == model and p[5] == variant and same(p[2], sku)]
    fits = [p[0] for p in every if same(p[4], brand)]
    if len(fits) == 1 and (len(every) == 1 or brand is not None):
        return fits[0], "model"
    return None, None


def test_match_products_equals_a_plain_loop(spark):
    rng = random.Random(5)
    pick = lambda values, null: rng.choice(values) if rng.random() > null else None
    row = lambda: (pick([f"b{k}" for k in range(200)], 0.7), pick(["s1", "S1", "s2", "s3", "s4", "", "any", "absent"], 0.4), pick([f"BX-{k}" for k in range(40)] + ["bx-1"], 0.3), pick(("A", "a", "B", "any"), 0.4), pick(("red", "absent"), 0.5))
    products = [(i, *row()) for i in range(120)]
    listings = [(i, *row()) for i in range(600)]
    out = matching.match_products(spark.createDataFrame(listings, f"listing_id long, {FIELDS}"), spark.createDataFrame(products, f"product_id long, {FIELDS}"))
    found = {r.listing_id: (r.product_id, r.matched_by) for r in out.collect()}
    assert found == {r[0]: plain(r[1:], products) for r in listings}
    assert {how for _, how in found.values()} == {"barcode", "sku", "model", None}
    assert out.count() == len(listings)


def test_a_common_sku_meets_no_pairs(spark):
    """Every join is on whole keys: no condition is left that pairs of one SKU or model would be held against."""
    one = spark.createDataFrame([(1, None, "s", "m", "b", None)], f"listing_id long, {FIELDS}")
    plan = matching.match_products(one, one.withColumnRenamed("listing_id", "product_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and " OR " in line]
