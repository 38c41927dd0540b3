"""Operator 2: SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 4 bits have at least 8 - 4 = 4 of their 8 positional bytes in common: the
guaranteed minimum. The inverted index lists fingerprints by the bytes at some positions. Lists of one byte would make a
pair of every 32nd, so a list here goes by three positional bytes (GRAM), and by as few choices of positions as hold one
inside every choice of four (20 of the 56): no pair with the minimum is missed. In each list the shared positional
bytes of its pairs are tallied, pairs that reach the minimum are retained, and those are verified on all bits.

Only distinct fingerprints are indexed. A task links the fingerprints of its lists among themselves and returns a
spanning forest, not pairs. Lists of more than BLOCK fingerprints are counted beforehand and dealt out as pairs of
blocks. The forests' components are found with distributed star contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, group_starts, key_groups, long_lists, map_rows, roots

BLOCK = 4_096
#: Positional bytes in a key of the index; up to the guaranteed minimum of shared bytes.
GRAM = 3
#: Entries up to this size are compared for all entries at once, offset by offset.
SMALL = 32
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text's word shingles (A-Z lower-cased); 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def choices(size: int, within: int, positions: int = 8) -> list[tuple[int, ...]]:
    """Choices of `size` byte positions of which every choice of `within` positions contains one, few of them.

    Positions are dealt into groups; for three of four, Turan's construction (three in one group, or two in a group and one in
    the next of a ring of three); for fewer, choices inside one of as many groups as leave none of them empty; else all.
    """
    if (size, within) == (3, 4):
        of = [p % 3 for p in range(positions)]
        fits = lambda c: len({of[p] for p in c}) == 1 or any(sorted(of[p] for p in c) == sorted((g, g, (g + 1) % 3)) for g in range(3))
        return [c for c in combinations(range(positions), 3) if fits(c)]
    groups = (within - 1) // (size - 1) if size > 1 else 0
    if size > 1 and groups * (size - 1) < within:  # of `within` positions, `size` lie in one group
        return [c for c in combinations(range(positions), size) if len({p % groups for p in c}) == 1]
    if size == 1:
        return [(p,) for p in range(positions - within + 1)]
    return list(combinations(range(positions), size))


def masks(chosen: list[tuple[int, ...]]) -> list[int]:
    """Choices of byte positions as signed 64-bit masks."""
    found = [sum(0xFF << 8 * p for p in c) for c in chosen]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of the positions at which two fingerprints have the same byte."""
    return (np.ascontiguousarray(a ^ b)[..., None].view(np.uint8) == 0).sum(-1)


def close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs reach the guaranteed minimum of shared bytes and, verified, differ in at most `most` bits."""
    a, b = np.broadcast_arrays(a, b)
    hit = shared_bytes(a, b) >= 8 - most
    hit[hit] = np.bitwise_count((a[hit] ^ b[hit]).view(np.uint64)) <= most  # of signed numbers it would count the absolute value's bits
    return hit


def forest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values (by index) -> as many links as a spanning forest of them has."""
    nodes, at = np.unique(values, return_inverse=True)
    root = roots(len(nodes), at[a], at[b])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def link_lists(most: int):
    """Sorted index entries -> links (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for table, starts in key_groups(batches, ["mask", "key"]):
            fp = table.column("fp").to_numpy()
            sizes = np.diff(np.append(starts, len(fp)))
            entry = np.repeat(np.arange(len(starts)), sizes)
            small = sizes <= SMALL
            a_all, b_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            inside = small[entry]
            for d in range(1, min(SMALL, int(sizes.max()))):
                a = np.flatnonzero(inside[:-d] & (entry[:-d] == entry[d:]))
                if not len(a):
                    break
                hit = close(fp[a], fp[a + d], most)
                a_all.append(a[hit])
                b_all.append(a[hit] + d)
            for e in np.flatnonzero(~small):
                a, b = pairs_within(fp[starts[e] : starts[e] + sizes[e]], most)
                a_all.append(a + starts[e])
                b_all.append(b + starts[e])
            u, v = forest(fp, np.concatenate(a_all), np.concatenate(b_all))
            yield pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=schema)

    return run


def pairs_within(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within one entry: each row is compared with those not yet joined to it."""
    found = [(np.empty(0, np.int64),) * 2]
    for at in range(0, len(fp), 256):
        a, b = np.nonzero(close(fp[at : at + 256, None], fp[None, :], most))
        keep = a + at < b
        found.append((a[keep] + at, b[keep]))
        if len(found) > 16:
            found = [_thin(len(fp), found)]
    return _thin(len(fp), found)


def _thin(n: int, found: list) -> tuple[np.ndarray, np.ndarray]:
    root = roots(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    moved = np.flatnonzero(root != np.arange(n))
    return root[moved], moved


def link_blocks(most: int):
    """Rows sorted by pairs of blocks (mask, key, lo, hi) -> links; a pair of one block twice is linked within it."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for table, starts in key_groups(batches, ["mask", "key", "lo", "hi"]):
            fp = table.column("fp").to_numpy()
            for a, z in zip(starts, np.append(starts[1:], len(fp)), strict=True):
                i, j = pairs_within(fp[a:z], most)
                yield pa.RecordBatch.from_pydict({"u": fp[a:z][j], "v": fp[a:z][i]}, schema=schema)

    return run


def link_fingerprints(distinct: DataFrame, most: int = 4, block: int = BLOCK, gram: int = GRAM) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) with the same components as all pairs of at most `most` bits."""
    if not 0 <= most < 8:
        raise ValueError("fingerprints of 8 bytes share one for certain if at most 7 bits differ")
    chosen = masks(choices(min(gram, 8 - most), 8 - most))
    index = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in chosen])).alias("mask", "m")).select("mask", F.expr("fp & m").alias("key"), "fp")
    long = cut(index.groupBy("mask", "key").count().where(F.col("count") > block), "simhash-long")
    has_long = bool(long.limit(1).count())
    short, lists = long_lists(index, long, ["mask", "key"], distinct.count() * len(chosen), block) if has_long else (index, None)
    links = short.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(link_lists(most), "u long, v long")
    if has_long:
        dealt = lists.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        pairs = ["mask", "key", "lo", "hi"]
        dealt = dealt.select("mask", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp")
        links = links.union(dealt.repartition(*pairs).sortWithinPartitions(*pairs).mapInArrow(link_blocks(most), "u long, v long"))
    return cut(links, "simhash-links").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and repeated doc_ids
    each give a row; a null doc_id is a row too, but is only a component_id where all its component's are null.
    Other columns are not read.
    """

    def prints(b):
        return {"doc_id": b["doc_id"], "fp": [x - (1 << 64) if x >> 63 else x for x in (fingerprint(t, shingle, seed) for t in b["text"])]}

    marked = cut(map_rows(docs.select("doc_id", "text"), prints, "doc_id long, fp long"), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    member = components(link_fingerprints(distinct.select("fp"), most), "simhash-stars")
    rooted = distinct.join(member, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "simhash-roots")
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-smallest")
    of = cut(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-of")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
