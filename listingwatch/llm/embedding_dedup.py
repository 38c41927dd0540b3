"""Operator 3: embedding near-dedup by random-hyperplane signs in several tables and exact cosine checks.

Each table gives a vector the signs of its products with BITS random hyperplanes; vectors of one label that agree in
all signs of a table are compared exactly. At cosine 0.98 two vectors agree in a table with probability
(1 - acos(0.98) / pi) ** BITS = 0.348, so all TABLES miss such a pair with probability 3.5e-5, and closer pairs far less.

Equal vectors are one class with a weight. A bucket returns, for each member, the weight of its links and one link of a
spanning forest: a pair is counted only by the first table in which it meets, so no pairs leave a task. Buckets of
more than BLOCK vectors are dealt out as pairs of blocks, and the largest are dealt where their entries lie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARE, components, cut, key_groups, map_rows, roots

BITS, TABLES, SEED = 16, 24, 7
BLOCK = 2_048


def signatures(vectors: np.ndarray, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Rows of vectors -> (rows, tables) bucket numbers; the hyperplanes follow from the dimension and the seed."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits))


def describe(bits: int, tables: int, seed: int):
    def run(b):
        n = len(b["vec_id"])
        out = {"vec_id": b["vec_id"], "label": b["label"], "dim": [0] * n, "digest": [None] * n, "buckets": [None] * n, "vector": [None] * n}
        usable: dict[int, list[int]] = {}
        for i, (label, x) in enumerate(zip(b["label"], b["embedding"], strict=True)):
            if label is not None and x and None not in x:
                v = np.array(x, np.float64)
                if np.isfinite(v).all() and v.any():
                    usable.setdefault(len(x), []).append(i)
        for dim, at in usable.items():
            vectors = np.array([b["embedding"][i] for i in at], np.float64) + 0.0  # -0.0 becomes 0.0
            found = signatures(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), bits, tables, seed)
            for i, v, s in zip(at, vectors, found, strict=True):
                out["dim"][i], out["digest"][i], out["buckets"][i], out["vector"][i] = dim, hashlib.blake2b(v.tobytes(), digest_size=16).digest(), s.tolist(), v.tolist()
        return out

    return run


def compare(least: float):
    """Sorted bucket rows -> for each member: the weight of links that this bucket counts, and its root in the bucket."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def one(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rep, weight, block = (table.column(c).to_numpy() for c in ("rep", "weight", "block"))
        vectors = np.stack(table.column("vector").to_pylist())
        buckets = np.stack(table.column("buckets").to_pylist())
        t, lo, hi = (table.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        norms = np.sqrt((vectors * vectors).sum(1))
        links, a_all, b_all = np.zeros(len(rep), np.int64), [], []
        for at in range(0, len(rep), 512):
            a, b = np.nonzero(vectors[at : at + 512] @ vectors.T / (norms[at : at + 512, None] * norms) >= least)
            a += at
            keep = (a < b) & ((lo == hi) | (block[a] != block[b]))
            a, b = a[keep], b[keep]
            first = (buckets[a] == buckets[b]).argmax(1) == t
            np.add.at(links, a[first], weight[b[first]])
            np.add.at(links, b[first], weight[a[first]])
            root = roots(len(rep), np.concatenate([*a_all, a]), np.concatenate([*b_all, b]))
            moved = np.flatnonzero(root != np.arange(len(rep)))
            a_all, b_all = [root[moved]], [moved]
        return rep, links, rep[roots(len(rep), np.concatenate(a_all), np.concatenate(b_all))]

    def run(batches):
        for table, starts in key_groups(batches, ["label", "dim", "t", "bucket", "lo", "hi"]):
            ends = np.append(starts[1:], table.num_rows)
            found = [one(table.slice(a, b - a)) for a, b in zip(starts, ends, strict=True) if b - a > 1]
            if found:
                rep, links, root = map(np.concatenate, zip(*found, strict=True))
                keep = (links > 0) | (rep != root)
                yield pa.RecordBatch.from_pydict({"rep": rep[keep], "links": links[keep], "root": root[keep]}, schema=schema)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, bits: int = BITS, tables: int = TABLES, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors are compared within a label and a dimension; labels of any atomic type are equal if their texts are. Null, empty or zero vectors, vectors with null or
    non-finite components and vectors without a label have no links. Repeated rows are vectors of their own, linked to
    each other. A null vec_id is kept as a row; its links count, but it is never a component_id of others. Other
    columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    described = cut(map_rows(rows, describe(bits, tables, seed), "vec_id long, label string, dim int, digest binary, buckets array<int>, vector array<double>", 1024), "vectors")
    same = ["label", "dim", "digest"]
    classes = described.where("digest is not null").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("buckets").alias("buckets"), F.first("vector").alias("vector"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")

    where = ["label", "dim", "t", "bucket"]
    entries = classes.select("rep", "label", "dim", F.posexplode("buckets").alias("t", "bucket"))
    shared = cut(entries.groupBy(*where).count().where("count > 1"), "vector-buckets")
    # the largest buckets, a share of all entries each and so never more than 1 / SHARE, are broadcast; no task gets one of them whole
    large = max(block, int((shared.agg(F.sum("count")).first()[0] or 0) * SHARE))
    hot = F.broadcast(shared.where(F.col("count") >= large))
    rest = entries.join(hot.select(*where), where, "left_anti").join(shared.where(F.col("count") < large), where)
    dealt = rest.unionByName(entries.join(hot, where)).withColumn("blocks", F.ceil(F.col("count") / block)).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    with_other = dealt.withColumn("other", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    # two blocks meet once, and a block meets itself once
    pairs = with_other.select("rep", *where, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    filled = pairs.join(classes.select("rep", "weight", "buckets", "vector"), "rep")
    groups = [*where, "lo", "hi"]
    found = cut(filled.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(compare(least), "rep long, links long, root long"), "vector-links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = components(found.where("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v")), "vector-stars")
    known = classes.select(*same, "rep", "first", "weight").join(links, "rep", "left").join(member, F.col("rep") == F.col("node"), "left")
    known = cut(known.select(*same, "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("near"), F.coalesce("root", "rep").alias("root")), "vector-known")
    smallest = cut(known.groupBy("root").agg(F.min("first").alias("component")), "vector-components")
    known = cut(known.join(smallest, "root").select(*same, "near", "component"), "vector-of")
    out = described.select("vec_id", *same).join(known, same, "left")
    n_links = F.coalesce("near", F.lit(0))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
