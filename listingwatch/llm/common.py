"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import cut, drop

#: A word, wherever a contract speaks of words; as a Java and as a DuckDB pattern.
WORD = r"[^\x20\x09-\x0D]+"


def map_rows(df: DataFrame, fn, schema: str, step: int = 256) -> DataFrame:
    """Apply fn (dict of column lists -> dict of column lists) to slices of at most `step` rows, over Arrow."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(i, step).to_pydict()), schema=arrow)

    return df.mapInArrow(run, struct)


def add_columns(df: DataFrame, inputs: list[str], fn, schema: str, step: int = 256) -> DataFrame:
    """df with the columns that fn makes of `inputs`; a column of df that has such a name is replaced."""
    new = T.StructType.fromDDL(schema)
    names = {f.name for f in new}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names or c in inputs])
    struct = T.StructType([f for f in kept.schema if f.name not in names] + list(new))
    arrow = to_arrow_schema(struct)
    own = [f.name for f in kept.schema if f.name not in names]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                made = fn({c: part.column(c).to_pylist() for c in inputs})
                columns = [part.column(c).cast(arrow.field(c).type) for c in own]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(made[f.name], arrow.field(f.name).type) for f in new], schema=arrow)

    return kept.mapInArrow(run, struct)


def key_groups(batches, keys: list[str]):
    """Whole key groups of a partition that is sorted by keys: tables of one or more complete groups, with the
    start of each group. A group that goes on in the next batches is carried over, and looked at once it is whole."""
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        if carried and all(carried[0].column(k)[0] == x for k, x in zip(keys, last, strict=True)):
            carried.append(batch)
            continue
        table = pa.Table.from_batches([*carried, batch])
        starts = group_starts(table, keys)
        at = int(starts[-1])
        if at:
            yield table.slice(0, at), starts[:-1]
        # rows before the last group's start all lie in the new batch or are done
        carried = table.slice(at).combine_chunks().to_batches()
    if carried:
        table = pa.Table.from_batches(carried)
        yield table, group_starts(table, keys)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the connected component of each of n nodes, for links a-b held in memory."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


#: A node with at least this many links is a hub; of many links, this share of all. So there are never more than 2 / SHARE hubs,
#: and a key that is joined by a shuffle has fewer rows than that.
HUB, SHARE = 128, 1 / 50_000


def with_lowest(links: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """links (u, v) with u's row of low (u, m, degree). A hub's links stay where they are: as n links have at most
    2 / SHARE hubs, those are broadcast; the links of all other nodes are joined by a shuffle that no node weighs down."""
    hub = max(HUB, int(n * SHARE))
    hubs = F.broadcast(low.where(F.col("degree") >= hub).select("u", "m"))
    rest = links.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("degree") < hub).select("u", "m"), "u")
    return rest.unionByName(links.join(hubs, "u"))


def long_lists(entries: DataFrame, counts: DataFrame, keys: list[str], n: int, block: int) -> tuple[DataFrame, DataFrame]:
    """entries of an index (n in all) -> (those of lists of at most `block` entries, those of longer lists with the list's count).

    counts: (keys, count) of the lists longer than block. Lists that hold a share of all entries, never more than 1 / SHARE,
    are broadcast, so that their entries stay where they are; a task of the shuffle for the others gets no list that large.
    """
    large = max(block + 1, int(n * SHARE))
    hot = F.broadcast(counts.where(F.col("count") >= large))
    rest, dealt = entries.join(hot.select(*keys), keys, "left_anti"), entries.join(hot, keys)
    if large > block + 1:  # else every long list is one of the broadcast ones
        others = counts.where(F.col("count") < large)
        dealt = dealt.unionByName(rest.join(others, keys))
        rest = rest.join(others.select(*keys), keys, "left_anti")
    return rest, dealt


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of links (u, v: long), distributed: rows (node, root) with root the smallest node.

    Alternates large-star and small-star steps, each a join on the smallest neighbour, until the links are
    stars. Nodes without links have no row. Nothing but a count and a checksum comes to the driver; each round
    is written to the shared folder, so a lost executor costs at most one round. A star's centre is a hub, whose links
    are joined where they are (with_lowest).
    """

    def lowest(e):
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))

    def large_star(e, n):
        both = e.union(e.select("v", "u"))
        low = lowest(both).withColumn("m", F.least("u", "m"))
        return with_lowest(both, low, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e, n):
        low = lowest(e)
        inner = with_lowest(e, low, n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return inner.union(low.select("u", F.col("m").alias("v"))).distinct()

    def checksum(e):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())

    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = cut(edges, name)
    seen = checksum(edges)
    while seen[0]:
        large = cut(large_star(edges, seen[0]), name)
        after = cut(small_star(large, seen[0]), name)
        now = checksum(after)
        drop(large)
        drop(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
