"""Listings of a whole batch to products, in the order in which they came."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

FIELDS = ("barcode", "sku", "model", "brand", "variant")
RESOLVED = "listing_id long, product_id long, matched_by string"


def linked_listings(listings: DataFrame) -> DataFrame:
    """(listing_id, component): listings that share a barcode, SKU or model, directly or over others.

    Distinct key triples are the nodes, so copies count once. A round lowers each node's label to the least of its keys'
    nodes and then to its label's label, and is written down; rounds grow with the logarithm of the longest chain.
    """
    triple = ["barcode", "sku", "model"]
    nodes = cut(listings.groupBy(*triple).agg(F.min("listing_id").alias("node")), "nodes")
    typed = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), F.col(c).alias("key"))) for c in triple]))
    members = cut(nodes.select("node", F.explode(typed).alias("k")).select("node", "k.kind", "k.key"), "members")
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:
        lowest = members.join(labels, "node").groupBy("kind", "key").agg(F.min("label").alias("low"))
        near = members.join(lowest, ["kind", "key"]).groupBy("node").agg(F.min("low").alias("low"))
        step = labels.join(near, "node", "left").select("node", "label", F.coalesce("low", "label").alias("low"))
        step = cut(step, "labels")
        ahead = step.select(F.col("node").alias("low"), F.col("low").alias("further"))
        step = cut(step.join(ahead, "low").select("node", "label", F.col("further").alias("now")), "labels")
        labels = step.select("node", F.col("now").alias("label"))
        if step.where("now <> label").isEmpty():
            break
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"n.{c}")) for c in triple]
    placed = nodes.join(labels, "node").select(*triple, F.col("label").alias("component"))
    return listings.alias("l").join(placed.alias("n"), same).select("l.*", "component")


def only(by_brand: dict, brand: str | None, other: str | None) -> int | None:
    """The one product that agrees in brand and in another detail, where an absent value agrees with any; none if there are several.

    by_brand: brand -> other detail -> products. No more than two products are looked at.
    """
    found = None
    for by_other in by_brand.values() if brand is None else (by_brand.get(brand), by_brand.get(None)):
        if by_other is None:
            continue
        for products in by_other.values() if other is None else (by_other.get(other), by_other.get(None)):
            for product in products or ():
                if found is not None:
                    return None
                found = product
    return found


class Products:
    """The products of one component so far, by key. Those of one SKU, or of one model and variant, lie by what a listing has to
    agree in besides, so a key of any number of products is not searched."""

    def __init__(self):
        self.fields: dict[int, list] = {}
        self.by_barcode: dict[str, int] = {}
        self.by_sku: dict[str, dict] = {}
        self.by_model: dict[tuple, dict] = {}

    def find(self, barcode, sku, model, brand, variant) -> tuple[int | None, str | None]:
        brand = brand and brand.lower()
        if barcode is not None and barcode in self.by_barcode:
            return self.by_barcode[barcode], "barcode"
        if sku is not None and (product := only(self.by_sku.get(sku, {}), brand, model)) is not None:
            return product, "sku"
        if model is not None and (product := only(self.by_model.get((model, variant), {}), brand, sku)) is not None:
            return product, "model"
        return None, None

    def places(self, fields: list) -> list[tuple[dict, object, object, object]]:
        """Where a product of these fields lies: index, key, brand and the other detail."""
        _, sku, model, brand, variant = fields
        brand = brand and brand.lower()
        found = [(self.by_sku, sku, brand, model)] if sku is not None else []
        return found + ([(self.by_model, (model, variant), brand, sku)] if model is not None else [])

    def learn(self, product: int, row: tuple) -> None:
        """A new product, or the empty fields of a known one. row: FIELDS."""
        have = self.fields.get(product)
        if have is None:
            have = [None] * len(FIELDS)
        elif all(new is None or old is not None for old, new in zip(have, row, strict=True)):
            return
        fields = [new if old is None else old for old, new in zip(have, row, strict=True)]
        for index, key, brand, other in self.places(have):
            of_brand = index[key][brand]
            del of_brand[other][product]
            if not of_brand[other]:
                del of_brand[other]
        for index, key, brand, other in self.places(fields):
            index.setdefault(key, {}).setdefault(brand, {}).setdefault(other, {})[product] = None
        if have[0] is None and fields[0] is not None:
            self.by_barcode.setdefault(fields[0], product)
        self.fields[product] = fields


def resolve_batch(listings: DataFrame) -> DataFrame:
    """(listing_id, product_id, matched_by) of the first listings of offers; each sees the products that earlier ones made.

    listings: (listing_id unique, seq, barcode, sku, model, brand, variant), normalised. A product is named by the listing that made
    it. A listing without barcode, SKU and model matches nothing and is a product of its own. The others are sorted by
    component and seq inside their partition and folded as they stream by: memory holds one component's products, never
    its listings. A component is a sequence by definition and can't be split over tasks.
    """
    has_key = F.coalesce("barcode", "sku", "model").isNotNull()
    alone = listings.where(~has_key).select(F.col("listing_id").cast("long"), F.col("listing_id").cast("long").alias("product_id"), F.lit(None).cast("string").alias("matched_by"))
    linked = linked_listings(listings.where(has_key).select("listing_id", "seq", *FIELDS))
    ordered = linked.repartition("component").sortWithinPartitions("component", "seq", "listing_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, products = None, Products()
        for batch in batches:
            ids, components, *fields = (batch.column(c).to_pylist() for c in ("listing_id", "component", *FIELDS))
            places, hows = [], []
            for listing_id, component, row in zip(ids, components, zip(*fields, strict=True), strict=True):
                if component != current:
                    current, products = component, Products()
                product, how = products.find(*row)
                product = listing_id if product is None else product
                products.learn(product, row)
                places.append(product)
                hows.append(how)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(hows, pa.string())], names=["listing_id", "product_id", "matched_by"])

    return ordered.mapInArrow(fold, RESOLVED).unionByName(alone)


def split_products(offers: DataFrame, splits: DataFrame) -> DataFrame:
    """Offers after splits: the chosen offers go to the new product. offers: (offer_id, product_id), splits: (offer_id, new_product_id).

    A split that takes all offers of a product, or none, is no split and changes nothing.
    """
    chosen = offers.join(splits.select("offer_id", "new_product_id"), "offer_id", "left")
    proper = chosen.groupBy("product_id").agg((F.count_if(F.col("new_product_id").isNull()) > 0).alias("proper"))
    joined = chosen.join(proper, "product_id")
    return joined.select("offer_id", F.when(F.col("proper"), F.coalesce("new_product_id", "product_id")).otherwise(F.col("product_id")).alias("product_id"), (F.col("proper") & F.col("new_product_id").isNotNull()).alias("moved"))


def split_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """One audit row a (product, new product) of a split: how many offers the old one had and has, how many went.

    before: (offer_id, product_id), after: `split_products`' rows. The ids themselves are the rows of `after` that moved; a
    product may have any number of them, so they are counted, not gathered.
    """
    had = before.groupBy("product_id").agg(F.count("*").alias("offers_before"))
    went = after.where("moved").withColumnRenamed("product_id", "new_product_id").join(before, "offer_id")
    went = went.groupBy("product_id", "new_product_id").agg(F.count("*").alias("moved_offers"), F.min("offer_id").alias("first_offer"), F.max("offer_id").alias("last_offer"))
    total = went.groupBy("product_id").agg(F.sum("moved_offers").alias("all_moved"))
    joined = went.join(had, "product_id").join(total, "product_id")
    return joined.select(F.lit("split").alias("action"), "product_id", "new_product_id", "offers_before", (F.col("offers_before") - F.col("all_moved")).alias("offers_after"), "moved_offers", "first_offer", "last_offer")


def catalog_links_after(links: DataFrame, audit: DataFrame) -> DataFrame:
    """Catalog links with copies for the products that splits made. links: (product_id, model)."""
    copies = links.join(audit.select("product_id", "new_product_id").distinct(), "product_id").select(F.col("new_product_id").alias("product_id"), "model")
    return links.select("product_id", "model").unionByName(copies)


def facts_after_split(facts: DataFrame, after: DataFrame) -> DataFrame:
    """Events, matches or alerts (offer_id, product_id, …) after splits: those of an offer that moved go with it.

    after: `split_products`' rows.
    """
    moved = after.where("moved").select("offer_id", F.col("product_id").alias("new_product_id"))
    return facts.join(moved, "offer_id", "left").withColumn("product_id", F.coalesce("new_product_id", "product_id")).drop("new_product_id")


def facts_after_merge(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Events, matches, alerts, candidates or offers (product_id, …) after merges. targets: (source, target), one row a source."""
    return facts.join(targets.select(F.col("source").alias("product_id"), "target"), "product_id", "left").withColumn("product_id", F.coalesce("target", "product_id")).drop("target")


def links_after_merge(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Catalog links (product_id, model) after merges: a target keeps its own link, else it takes the one of its lowest source."""
    placed = links.join(targets.select(F.col("source").alias("product_id"), "target"), "product_id", "left")
    return placed.groupBy(F.coalesce("target", "product_id").alias("product_id")).agg(F.min_by("model", F.struct(F.col("target").isNotNull(), F.col("product_id"))).alias("model"))


DETAILS = ("brand", "series", "model", "barcode", "sku", "variant", "release_date", "image")


def product_rows(listings: DataFrame, resolved: DataFrame, products: DataFrame | None = None, details: tuple[str, ...] = DETAILS) -> DataFrame:
    """(product_id, name, created, each detail and `<detail>_from`): the products after a batch was resolved.

    listings: (listing_id, seq, title, and any of the details), resolved: (listing_id, product_id), products: (product_id, name,
    details) of before. A product that isn't among those is made by its first listing, whose title, else model, else barcode is its
    name. A detail that is null or empty takes the first listing that has one, by seq; `_from` is that listing, null where
    the value was there before or there is none. A detail that a side lacks counts as null. Products that no listing met stay as
    they are; listings without a product are left out. One aggregate, combined on the map side, so a product may have any
    number of listings.
    """
    details = tuple(c for c in details if c in listings.columns or (products is not None and c in products.columns))
    null = F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    text = lambda c: filled(c) if c in listings.columns else null
    read = listings.select("listing_id", "seq", F.coalesce(*[text(c) for c in ("title", "model", "barcode")], F.lit("Unknown product")).alias("name"), *[text(c).alias(c) for c in details])
    found = resolved.where("product_id is not null").select("listing_id", "product_id").join(read, "listing_id")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", "listing_id", F.col(c).alias("value")))).alias(f"n_{c}")
    new = found.groupBy("product_id").agg(*[first(c) for c in ("name", *details)])
    if products is None:
        return new.select("product_id", F.col("n_name.value").alias("name"), F.lit(True).alias("created"), *[x for c in details for x in (F.col(f"n_{c}.value").alias(c), F.col(f"n_{c}.listing_id").alias(f"{c}_from"))])
    old = products.select("product_id", F.col("name").cast("string").alias("o_name"), F.lit(True).alias("known"), *[(filled(c) if c in products.columns else null).alias(f"o_{c}") for c in details])
    both = old.join(new, "product_id", "full")
    columns = [x for c in details for x in (F.coalesce(f"o_{c}", f"n_{c}.value").alias(c), F.when(F.col(f"o_{c}").isNull(), F.col(f"n_{c}.listing_id")).alias(f"{c}_from"))]
    return both.select("product_id", F.when(F.col("known"), F.col("o_name")).otherwise(F.col("n_name.value")).alias("name"), F.col("known").isNull().alias("created"), *columns)


def audits_listed(splits: DataFrame, merges: DataFrame, n: int = 100) -> DataFrame:
    """The newest n audits of both kinds. splits: (audit_id, product_id, new_product_id), merges: (audit_id, source, target_id)."""
    kind = lambda df, action, a, b: df.select("audit_id", F.lit(action).alias("action"), F.col(a).alias("source_product_id"), F.col(b).alias("target_product_id"))
    both = kind(splits, "split", "product_id", "new_product_id").unionByName(kind(merges, "merge", "source", "target_id"))
    return both.orderBy(F.desc("audit_id"), "action", "source_product_id").limit(n)
