"""The pipeline's near-dedup: operator 2's method over sets of five-word shingles, verified by Jaccard similarity.

SimHash, a byte-position inverted index, count filtering, and a check on the bits. At similarity 0.8 a fingerprint's bits differ
with probability acos(8 / 9) / pi = 0.15 at most, more than one in a byte, so that no number of equal bytes is certain and
operator 2's guarantee can't be had; numbers are chosen so that a pair at 0.8 is missed about once in two thousand. A fingerprint has
128 positional bytes. As in operator 2 a list of the index goes by more than one of them: by two neighbours in a ring, for
the 128 pairs of neighbours, and for short texts, whose bits vary more, by further pairs. A byte is shared with
probability 0.27 at 0.8, so one of the 128 lists at least is with 0.9996. In each list the shared ones of the first 32 bytes are
tallied, pairs that reach SHARED are retained, and those that differ in at most MOST of these 256 bits (4.4 standard
deviations at 0.8; MOST_SHORT where both texts have less than SHORT shingles) are candidates. A list is sorted by the number of
shingles, and only texts whose numbers allow the similarity are compared.

Candidates are not listed, as a crowd of similar texts has any number of them. An entry returns a spanning forest of its
candidates; the forests' components are clusters. Within a cluster all whole shingle sets are compared where they lie, so
nothing below 0.8 is linked, and a spanning forest of the true links comes back. A cluster of more than SET_BLOCK
shingles is dealt out: first its forest's links are verified, then texts outside the largest component found that way are
compared with all others, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, components, cut, key_groups, long_lists
from .simhash import _BITS, SMALL, _thin, forest

SHINGLE = 5
LEAST = 0.8
MOST, MOST_SHORT, SHORT = 64, 80, 64
#: The least number of shared bytes among the first 32: at 0.8 none is shared once in 20,000 pairs, of two that don't belong together in 88 of 100.
SHARED = 1
BLOCK = 2_048
#: Shingles of a cluster that one task compares.
SET_BLOCK = 600_000
POSITIONS = 128
NODE = ["node", "n", "f0", "f1", "f2", "f3"]
#: Pairs of byte positions that a list goes by: of all texts, and of those with up to VERY_SHORT shingles besides.
PAIRS = np.array([(p, (p + 1) % POSITIONS) for p in range(POSITIONS)])
MORE_PAIRS = np.array([(p, (p + d) % POSITIONS) for d in (5, 19) for p in range(POSITIONS)])
VERY_SHORT = 16



def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (A-Z lower-cased); of fewer words, of the whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), last)], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.ascontiguousarray(x ^ (x >> np.uint64(31)))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """1,024 bits as bytes: a bit is the majority of the shingles' bits."""
    counts = np.zeros((POSITIONS, 256), np.int64)
    for at in range(0, len(found), 8_192):
        x = _mix(found[at : at + 8_192, None] + np.arange(1, POSITIONS // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        counts += np.bincount((x.view(np.uint8).reshape(-1, POSITIONS) + np.arange(POSITIONS) * 256).ravel(), minlength=POSITIONS * 256).reshape(POSITIONS, 256)
    return np.packbits((counts.astype(np.float64) @ _BITS.astype(np.float64)).ravel() * 2 > len(found), bitorder="little")


def index_keys(octets: np.ndarray, pairs: np.ndarray, first: int = 0) -> np.ndarray:
    """The lists of fingerprints (a row of bytes each): a pair of positions by its number, and the two bytes there."""
    number = np.arange(first, first + len(pairs), dtype=np.int64)
    return (number << 16) | (octets[:, pairs[:, 0]].astype(np.int64) << 8) | octets[:, pairs[:, 1]]


def prints(b: dict) -> dict:
    """node: a hash of the shingle set, n: its size, wide: the fingerprint."""
    sets = [shingles(t) for t in b["text"]]
    node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
    return {"node": node, "n": [len(s) for s in sets], "wide": [fingerprint(s).tobytes() for s in sets]}


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, rows, bits): which lists the rows of a batch are in, and the first 256 bits of each row as four words."""
    octets = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint8).reshape(-1, POSITIONS)
    short = np.flatnonzero(batch.column("n").to_numpy() <= VERY_SHORT)
    keys = np.concatenate([index_keys(octets, PAIRS).ravel(), index_keys(octets[short], MORE_PAIRS, len(PAIRS)).ravel()])
    rows = np.concatenate([np.repeat(np.arange(len(octets)), len(PAIRS)), np.repeat(short, len(MORE_PAIRS))])
    return keys, rows, np.ascontiguousarray(octets[:, :32]).view(np.int64)


def _entries(batches):
    schema = pa.schema([("key", pa.int64()), *[(c, pa.int64()) for c in NODE]])
    for batch in batches:
        for at in range(0, batch.num_rows, 1_024):
            part = batch.slice(at, 1_024)
            keys, rows, bits = _lists(part)
            columns = [part.column(c).to_numpy() for c in NODE[:2]] + [bits[:, i] for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(c[rows]) for c in columns]], schema=schema)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y (columns as NODE) are candidates: sizes that allow LEAST, enough shared bytes, and few differing bits."""
    more, less = np.maximum(x[:, 1], y[:, 1]), np.minimum(x[:, 1], y[:, 1])
    hit = np.flatnonzero(less >= LEAST * more)
    short = more[hit] < SHORT
    apart = np.ascontiguousarray(x[hit, 2:] ^ y[hit, 2:])
    shared = (apart.view(np.uint8) == 0).sum(1) >= SHARED
    hit, short, apart = hit[shared], short[shared], apart[shared]
    found = np.zeros(len(x), bool)
    found[hit] = np.bitwise_count(apart.view(np.uint64)).sum(1, dtype=np.int64) <= np.where(short, MOST_SHORT, MOST)
    return found


def _within(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates among rows sorted by n: no row is compared with one too large for LEAST."""
    found = [(np.empty(0, np.int64),) * 2]
    for at in range(0, len(x), 128):
        end = np.searchsorted(x[:, 1], x[min(at + 127, len(x) - 1), 1] / LEAST, "right")
        a, b = np.triu_indices(min(128, end - at), 1, end - at)
        a, b = a + at, b + at
        keep = _near(x[a], x[b])
        found.append((a[keep], b[keep]))
        if len(found) > 16:
            found = [_thin(len(x), found)]
    return _thin(len(x), found)


def _link_entries(keys: list[str]):
    """Entries sorted by keys and n -> links (u, v) between candidates, a spanning forest of each list's."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for table, starts in key_groups(batches, keys):
            x = np.stack([table.column(c).to_numpy() for c in NODE], 1)
            sizes = np.diff(np.append(starts, len(x)))
            entry = np.repeat(np.arange(len(starts)), sizes)
            inside = (sizes <= SMALL)[entry]
            found = [(np.empty(0, np.int64),) * 2]
            for d in range(1, min(SMALL, int(sizes.max()))):
                a = np.flatnonzero(inside[:-d] & (entry[:-d] == entry[d:]))
                if not len(a):
                    break
                a = a[_near(x[a], x[a + d])]
                found.append((a, a + d))
            for e in np.flatnonzero(sizes > SMALL):
                a, b = _within(x[starts[e] : starts[e] + sizes[e]])
                found.append((a + starts[e], b + starts[e]))
            u, v = forest(x[:, 0].copy(), *map(np.concatenate, zip(*found, strict=True)))
            yield pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=schema)

    return run


def candidates(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """nodes (node, n, wide) -> links (u, v) with the same components as all candidates. Long entries are dealt out as
    pairs of blocks."""
    types = ", ".join(f"{c} long" for c in ["key", *NODE])
    entries = nodes.select(*NODE[:2], "wide").mapInArrow(_entries, types)
    keys = nodes.select("n", "wide").mapInArrow(_keys, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    long = cut(keys.where(F.col("count") > block), "near-long")
    has_long = bool(long.limit(1).count())
    short, lists = long_lists(entries, long, ["key"], nodes.count() * len(PAIRS), block) if has_long else (entries, None)
    links = short.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_link_entries(["key"]), "u long, v long")
    if has_long:
        dealt = lists.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *NODE)
        pairs = ["key", "lo", "hi"]
        links = links.union(dealt.repartition(*pairs).sortWithinPartitions(*pairs, "n").mapInArrow(_link_entries(pairs), "u long, v long"))
    return links.distinct()


def _keys(batches):
    """How often each key of the index occurs in a batch."""
    for batch in batches:
        key, count = np.unique(_lists(batch)[0], return_counts=True)
        yield pa.RecordBatch.from_pydict({"key": key, "count": count}, schema=pa.schema([("key", pa.int64()), ("count", pa.int64())]))


def _similar(both: np.ndarray, n: np.ndarray, m) -> np.ndarray:
    return (both > 0) & (both >= LEAST * (n + m - both))


def _compare(keys: list[str]):
    """Rows (node, label, side, shingles) sorted by keys -> links (u, v) of similarity LEAST or more between different
    labels, a spanning forest of each group's. Texts of side 0 are compared with all, those of side 1 only with side 0."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def group(node, label, side, lengths, values):
        rows = np.repeat(np.arange(len(node)), lengths)
        # texts of one label are linked already
        known = np.unique(label, return_index=True, return_inverse=True)
        found = [(known[1][known[2]], np.arange(len(node)))]
        order = np.argsort(values, kind="stable")
        number = np.empty(len(values), np.int64)
        number[order] = np.cumsum(np.append(0, np.diff(values[order]) != 0))
        mark, starts = np.zeros(number.max() + 1, bool), np.append(0, np.cumsum(lengths))
        for i in np.flatnonzero(side == 0):
            own = number[starts[i] : starts[i + 1]]
            mark[own] = True
            both = np.bincount(rows[mark[number]], minlength=len(node))
            mark[own] = False
            hit = np.flatnonzero(_similar(both, lengths, lengths[i]) & (label != label[i]))
            found.append((np.full(len(hit), i), hit))
            if len(found) > 64:
                found = [_thin(len(node), found)]
        a, b = _thin(len(node), found)
        new = label[a] != label[b]
        return node[a[new]], node[b[new]]

    def run(batches):
        for table, starts in key_groups(batches, keys):
            table = table.combine_chunks()
            node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
            shingles = table.column("shingles").combine_chunks()
            shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
            at, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            for a, z in zip(starts, np.append(starts[1:], len(node)), strict=True):
                if z - a > 1:
                    u, v = group(node[a:z], label[a:z], side[a:z], np.diff(at[a : z + 1]), values[at[a] : at[z]])
                    yield pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=schema)

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose shingle sets have a Jaccard similarity of LEAST or more. sets: (node, shingles), sorted."""

    def run(batches):
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy() for c in ("a", "b"))
                kept.append(bool(_similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("shingles").alias(name))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def links(marked: DataFrame, block: int = BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """Links (u, v) with the same components as all candidates that have the similarity."""
    nodes = cut(marked.where("n > 0").select("node", F.col("n").cast("long").alias("n"), "wide").dropDuplicates(["node"]), "near-nodes")
    met = cut(candidates(nodes, block), "near-candidates")
    cluster = cut(components(met, "near-stars"), "near-clusters")
    texts = marked.select("node", "n", "text").join(cluster.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = add_columns(texts, ["text"], lambda b: {"shingles": [shingles(t).view(np.int64) for t in b["text"]]}, "shingles array<long>")
    sizes = cut(texts.select("node", "n").join(cluster, "node").groupBy("root").agg(F.sum("n").alias("all")), "near-sizes")
    blocks = F.ceil(F.col("all") / set_block).cast("int").alias("blocks")
    sets = cut(sets.select("node", "shingles").join(cluster, "node").join(sizes.select("root", blocks), "root"), "near-sets")
    compared = "u long, v long"
    whole = sets.where("blocks = 1").select("root", "node", F.col("node").alias("label"), F.lit(0).alias("side"), "shingles")
    found = whole.repartition("root").sortWithinPartitions("root").mapInArrow(_compare(["root"]), compared)
    large = sets.where("blocks > 1")
    if not large.limit(1).count():
        return cut(found, "near-links")
    of_large = met.join(large.select(F.col("node").alias("u")), "u", "left_semi")
    first = cut(verified(of_large, large), "near-first")
    label = cut(components(first, "near-stars").withColumnRenamed("root", "label"), "near-labels")
    large = cut(large.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-large")
    counts = large.groupBy("root", "label").count()
    most = cut(counts.groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("most")), "near-most")
    large = large.join(most, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    row = ["root", "node", "label", "shingles"]
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    others = large.where("label <> most").select(*row, F.lit(0).alias("side"), F.col("block").alias("lo"), every.alias("hi"))
    alls = large.select(*row, F.lit(1).alias("side"), every.alias("lo"), F.col("block").alias("hi"))
    keys = ["root", "lo", "hi"]
    rest = others.unionByName(alls).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(keys), compared)
    return cut(found.union(first).union(rest), "near-links")


def drop_copies(docs: DataFrame, block: int = BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """docs (doc_id, text and others) with one row of each component: the one with the smallest doc_id.

    Rows without a doc_id all stay. Rows may share a doc_id; each is judged by its own text. Texts without words are copies of each other.
    """
    marked = cut(add_columns(docs, ["text"], prints, "node long, n int, wide binary").withColumn("row", F.xxhash64("text")), "near-marked")
    root = cut(components(links(marked, block, set_block), "near-stars"), "near-roots")
    rows = marked.where("doc_id is not null").select("node", F.struct("doc_id", "row").alias("r"))
    best = rows.groupBy("node").agg(F.min("r").alias("r")).join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "r")
    best = cut(best, "near-best")
    kept = cut(best.groupBy("root").agg(F.min("r").alias("kept")), "near-kept")
    of = best.join(kept, "root").select("node", "kept")
    gone = rows.join(of, "node").where("r <> kept").select("r.doc_id", "r.row").distinct()
    return marked.join(gone, ["doc_id", "row"], "left_anti").select(docs.columns)
