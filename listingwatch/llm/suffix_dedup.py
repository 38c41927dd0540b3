"""Operator 9: suffix-array dedup of repeated byte strings.

Every byte that lies in a string of LENGTH bytes which also starts earlier is removed. A suffix array over all
positions would shuffle every text a hundred times, so the array is sparse, without losing a match: each window of
LENGTH bytes names one of its GRAM-byte strings by its content alone (the smallest hash, leftmost of equals), so equal
windows name the same place. The named places, about 1 in 40 bytes, are the suffixes; each answers for the run of
windows that name it.

1. Anchors. A suffix with its run of windows is one region. Equal regions are the same suffix repeated: all but the
   earliest are removed at once, in the reading task where it can be seen and else after a shuffle by the leading
   GRAM bytes' hash. A suffix whose leading bytes occur in no other region cannot match anything and ends here.
2. Suffix array. What is left is range-partitioned by sampled splitters of the leading bytes; a bucket is sorted
   by multikey quicksort (words of eight bytes, only ties go on), with the bytes on the left sorted the same way from right to
   left. Neighbours' common prefixes give, for each place in a window, the ranges of suffixes that agree on all LENGTH
   bytes; all but the earliest are removed. Splitters never part equal leading bytes, so no match crosses a boundary.
3. A leading string with more than CROWD different regions (the edge of a passage that many documents share) would fill
   one bucket; its windows become suffixes of their own, which the splitters part by all LENGTH bytes. The most frequent
   of them are found beforehand in one text of SAMPLED, so that their regions are not dealt out by the leading bytes at
   all but by the whole content. That only decides the way: either way gives the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut, key_groups

LENGTH = 100
GRAM = 24
CROWD = 2_048
SAMPLED = 64
#: Leading strings that are known as crowded beforehand, the most frequent ones: what each task is sent is bounded by it.
KNOWN = 50_000
_BLOCK = 1 << 16
_INDEX = np.uint64((1 << 17) - 1)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_R32, _R29 = np.uint64(32), np.uint64(29)


def mix_words(words: np.ndarray) -> np.ndarray:
    """Each word of eight bytes scrambled, in place."""
    words ^= words >> _R32
    words *= _A
    words ^= words >> _R29
    return words


def join_words(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """Hash of GRAM bytes from its three scrambled words."""
    h = third * _C
    h += second * _B
    h += first
    h ^= h >> _R32
    h *= _D
    h ^= h >> _R29
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position of contiguous bytes."""
    words = mix_words(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy())
    return join_words(words[:-16], words[8:-8], words[16:])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places named by the windows of a text: hash of the leading bytes, place, first and last window that name it."""
    windows = len(data) - length + 1
    if windows <= 0:
        return (np.empty(0, np.int64),) * 4
    width = length - GRAM + 1
    named = np.empty(windows, np.int64)
    for at in range(0, windows, _BLOCK):
        n = min(_BLOCK, windows - at)
        h = gram_hashes(data[at : at + n + length - 1])
        h &= ~_INDEX
        h |= np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        h = np.minimum(h[:n], h[width - span : width - span + n])
        named[at : at + n] = (h & _INDEX).astype(np.int64) + at
    first = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    last = np.append(first[1:], windows) - 1
    place = named[first]
    words = mix_words(np.lib.stride_tricks.sliding_window_view(data, GRAM)[place].view("<u8"))
    return join_words(words[:, 0], words[:, 1], words[:, 2]).view(np.int64), place, first, last


def pack_span(place, first, last):
    return place << 16 | (place - first) << 8 | (last - first)


def unpack_span(span):
    place = span >> 16
    first = place - (span >> 8 & 255)
    return place, first, first + (span & 255)


def pack_range(start, end):
    return start << 31 | end


def merge_ranges(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ranges of one text in any order -> starts and ends of the maximal covered runs."""
    ranges = np.sort(ranges)
    start, end = ranges >> 31, np.maximum.accumulate(ranges & 0x7FFFFFFF)
    new = np.append(True, start[1:] > end[:-1])
    return start[new], np.append(end[:-1][new[1:]], end[-1])


def read_anchors(length: int, crowded=None):
    """Texts -> (k, ctx, doc, at, crowd): a region by the hash of its leading bytes and of its content; or, with ctx null, a
    range to remove that the task has found itself (k then only spreads the rows). Where the leading bytes are known as
    crowded (a broadcast array of their hashes), crowd is set and k is a hash of all the content."""
    schema = pa.schema([("k", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("crowd", pa.bool_())])

    def run(batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            texts = batch.column("text")
            keys, contexts, owners, spans = [], [], [], []
            for i in np.argsort(docs, kind="stable").tolist():
                raw = texts[i].as_buffer()
                if raw is None or raw.size < length:
                    continue
                data = np.frombuffer(raw, np.uint8)
                key, place, first, last = anchors(data, length)
                whole, digest = raw.to_pybytes(), xxhash.xxh3_64_intdigest
                contexts.append(np.array([digest(whole[a:b], s) for a, b, s in zip(first.tolist(), (last + length).tolist(), (place - first).tolist(), strict=True)], np.uint64).view(np.int64))
                keys.append(key)
                owners.append(np.full(len(key), docs[i]))
                spans.append(pack_span(place, first, last))
            if not keys:
                continue
            k, ctx, doc, span = map(np.concatenate, (keys, contexts, owners, spans))
            both = k.view(np.uint64) * _B + ctx.view(np.uint64)
            order = np.argsort(both, kind="stable")  # rows stand in the order of (doc, place)
            k, ctx, doc, span = k[order], ctx[order], doc[order], span[order]
            again = np.append(False, (k[1:] == k[:-1]) & (ctx[1:] == ctx[:-1]))
            crowd = np.isin(k, crowded.value) if crowded is not None else np.zeros(len(k), bool)
            route = np.where(crowd, mix_words(both[order].copy()).view(np.int64), k)
            yield pa.RecordBatch.from_pydict({"k": route[~again], "ctx": ctx[~again], "doc": doc[~again], "at": span[~again], "crowd": crowd[~again]}, schema=schema)
            if again.any():
                _, first, last = unpack_span(span[again])
                owner, ranges = merge_by_doc(doc[again], pack_range(first, last + length))
                spread = (owner.view(np.uint64) * _A).view(np.int64)
                yield pa.RecordBatch.from_pydict({"k": spread, "ctx": pa.nulls(len(owner), pa.int64()), "doc": owner, "at": ranges, "crowd": np.zeros(len(owner), bool)}, schema=schema)

    return run


def merge_by_doc(doc: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ranges, doc))
    doc, ranges = doc[order], ranges[order]
    start, end = ranges >> 31, ranges & 0x7FFFFFFF
    new_doc = np.append(True, doc[1:] != doc[:-1])
    # ends run on within a document only
    base = np.cumsum(new_doc) << 32
    end = np.maximum.accumulate(base + end)
    new = new_doc | np.append(True, base[1:] + start[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], pack_range(start[new], (end - base)[last])


def compare_regions(length: int, crowd: int):
    """Anchors sorted by (k, ctx, doc, at) -> (doc, at, kind): 0 a range to remove, 1 a region to compare, 2 one of a crowd."""
    schema = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("kind", pa.int8())])

    def run(batches):
        for table, _ in key_groups(batches, ["k"]):
            found = table.column("ctx").is_null().to_numpy()
            done = table.filter(pa.array(found))
            if done.num_rows:
                yield pa.RecordBatch.from_pydict({"doc": done.column("doc").combine_chunks(), "at": done.column("at").combine_chunks(), "kind": np.zeros(done.num_rows, np.int8)}, schema=schema)
            table = table.filter(pa.array(~found))
            if not table.num_rows:
                continue
            k, ctx, doc, at, known = (table.column(c).to_numpy() for c in ("k", "ctx", "doc", "at", "crowd"))
            new_key = np.append(True, k[1:] != k[:-1])
            earliest = new_key | np.append(True, ctx[1:] != ctx[:-1])
            regions = np.add.reduceat(earliest, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
            regions = np.where(known, crowd + 1, regions)
            compared = earliest & (regions > 1)
            _, first, last = unpack_span(at)
            out = np.where(earliest, at, pack_range(first, last + length))
            keep = compared | ~earliest
            kind = np.where(~earliest, 0, np.where(regions > crowd, 2, 1)).astype(np.int8)
            yield pa.RecordBatch.from_pydict({"doc": doc[keep], "at": out[keep], "kind": kind[keep]}, schema=schema)

    return run


def read_suffixes(length: int):
    """(doc, text, compared: spans, crowded: spans) -> suffixes; a crowd's windows that the task has seen become ranges."""
    schema = pa.schema([("lead", pa.binary()), ("suffix", pa.binary()), ("before", pa.binary()), ("doc", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: r["doc"])
            seen: set[bytes] = set()
            out: dict[str, list] = {c: [] for c in schema.names}

            def put(lead, suffix, before, doc, at, out=out):
                for c, v in zip(out, (lead, suffix, before, doc, at), strict=True):
                    out[c].append(v)

            for row in rows:
                raw = row["text"].encode()
                for place, first, last in map(unpack_span, row["compared"] or ()):
                    put(raw[place : place + GRAM], raw[place : last + length], raw[first:place], row["doc"], place)
                for _, first, last in map(unpack_span, sorted(row["crowded"] or ())):
                    for p in range(first, last + 1):
                        window = raw[p : p + length]
                        if window in seen:
                            put(None, None, None, row["doc"], pack_range(p, p + length))
                        else:
                            seen.add(window)
                            put(window, window, b"", row["doc"], p)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def padded(values: pa.ChunkedArray, width: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as zero-padded rows, and their lengths."""
    values = values.to_pylist()
    out = b"".join((v[::-1] if backward else v).ljust(width, b"\0") for v in values)
    return np.frombuffer(out, np.uint8).reshape(len(values), width), np.fromiter(map(len, values), np.int64, len(values))


def multikey_sort(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group and bytes, and how many leading bytes each has in common with the one before (-1: other group).

    Sorts by words of eight bytes from the left; after each word only rows that still tie are sorted on.
    """
    words = np.ascontiguousarray(text).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    start = np.append(True, np.diff(group[order]) != 0)
    for w in range(words.shape[1]):
        run = np.cumsum(start)
        tied = np.flatnonzero(~start | ~np.append(start[1:], True))
        if not len(tied):
            break
        rows = order[tied]
        by_word = np.lexsort((words[rows, w], run[tied]))
        order[tied] = rows[by_word]
        value = words[order, w]
        start[1:] |= value[1:] != value[:-1]
    common = np.full(len(order), -1)
    equal = text[order[1:]] == text[order[:-1]]
    common[1:] = np.where(equal.all(1), text.shape[1], equal.argmin(1))
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def repeats(group: np.ndarray, suffix: np.ndarray, suffix_len: np.ndarray, before: np.ndarray, before_len: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (group, doc, place) -> for each row the leftmost and rightmost window that an earlier row of
    its group has too, as bytes before the place (-1: none)."""
    n = len(group)
    order, common = multikey_sort(group, suffix)
    left_order, left_common = multikey_sort(group, before)
    most, least = np.full(n, -1), np.full(n, length)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(before_len.max()) + 1):
        rows = np.flatnonzero((before_len >= o) & (suffix_len >= length - o))
        if len(rows) < 2:
            continue
        right[order] = np.cumsum(common < length - o)
        left[left_order] = np.cumsum(left_common < o)
        key = right[rows] * (n + 1) + left[rows]
        by_key = np.argsort(key, kind="stable")
        same = np.append(False, key[by_key[1:]] == key[by_key[:-1]])
        again = rows[by_key[same]]
        most[again] = o
        least[again] = np.minimum(least[again], o)
    return most, least


def sort_bucket(length: int):
    schema = pa.schema([("doc", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for table, starts in key_groups(batches, ["lead"]):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            suffix, suffix_len = padded(table.column("suffix"), (length + 7) // 8 * 8)
            before, before_len = padded(table.column("before"), (length - GRAM + 8) // 8 * 8, backward=True)
            most, least = repeats(group, suffix, suffix_len, before, before_len, length)
            hit = most >= 0
            doc, at = table.column("doc").to_numpy()[hit], table.column("at").to_numpy()[hit]
            yield pa.RecordBatch.from_pydict({"doc": doc, "at": pack_range(at - most[hit], at - least[hit] + length)}, schema=schema)

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with `doc`, a number in the order of doc_id: doc_id itself if that is unique and never null.

    Else equal rows (doc_id and text) share a number, rows of one doc_id with different texts follow each other in the
    order of a hash of the text, and null doc_ids come last. The flag says whether every row has its own number.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn("doc", F.col("doc_id").cast("long")), True
    keyed = docs.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = keyed.select("doc_id", "text_hash").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    index = keys.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("number_id long, number_hash string, doc long")
    index = cut(index, "numbers")
    return keyed.join(index, F.col("doc_id").eqNullSafe(F.col("number_id")) & (F.col("text_hash") == F.col("number_hash"))).drop("number_id", "number_hash", "text_hash"), False


def crowded_leads(texts: DataFrame, length: int, crowd: int, sampled: int = SAMPLED) -> np.ndarray:
    """Hashes of the leading bytes that have the most different regions in one text of `sampled`, KNOWN at most."""
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(sampled)) == 0).mapInArrow(read_anchors(length), "k long, ctx long, doc long, at long, crowd boolean")
    regions = some.where("ctx is not null").select("k", "ctx").distinct().groupBy("k").count()
    most = regions.where(F.col("count") > max(1, crowd // sampled)).orderBy(F.desc("count"), "k").limit(KNOWN)
    return np.sort(np.array([r["k"] for r in most.collect()], np.int64))


def find_repeats(texts: DataFrame, length: int = LENGTH, crowd: int = CROWD, sampled: int = SAMPLED) -> DataFrame:
    """(doc: unique long, text) -> (doc, ranges: array of packed ranges to remove), for the documents that have any."""
    crowded = texts.sparkSession.sparkContext.broadcast(crowded_leads(texts, length, crowd, sampled))
    regions = texts.mapInArrow(read_anchors(length, crowded), "k long, ctx long, doc long, at long, crowd boolean")
    sorted_regions = regions.repartition("k").sortWithinPartitions("k", "ctx", "doc", "at")
    found = cut(sorted_regions.mapInArrow(compare_regions(length, crowd), "doc long, at long, kind byte"), "repeats")
    chosen = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("at")))
    to_compare = found.where("kind > 0").groupBy("doc").agg(chosen(1).alias("compared"), chosen(2).alias("crowded"))
    suffixes = texts.join(to_compare, "doc").mapInArrow(read_suffixes(length), "lead binary, suffix binary, before binary, doc long, at long")
    suffixes = cut(suffixes, "suffixes")
    buckets = suffixes.where("lead is not null").repartitionByRange("lead").sortWithinPartitions("lead", "doc", "at")
    ranges = found.where("kind = 0").select("doc", "at").union(suffixes.where("lead is null").select("doc", "at"))
    ranges = ranges.union(buckets.mapInArrow(sort_bucket(length), "doc long, at long"))
    return ranges.groupBy("doc").agg(F.collect_list("at").alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, sampled: int = SAMPLED) -> DataFrame:
    """All columns of docs (doc_id, text, ...) and n_bytes, n_removed, n_spans, kept_sha256, kept_text (what is
    left; half characters at a cut are left out of kept_text, not of the hash).

    A text's bytes are removed if a string of `length` bytes that covers them also starts earlier, in a smaller doc_id or
    before in the same text. Null and empty texts have no bytes. Equal rows count as one document and have the same
    result; rows of one doc_id with different texts are documents in a fixed order; null doc_ids are the last.
    Columns of docs that are named like results or `doc` are replaced.
    """
    if length != LENGTH and not GRAM < length <= LENGTH:
        raise ValueError(f"length can be {GRAM + 1} to {LENGTH}")
    docs = docs.drop("doc", "ranges", "text_hash", "number_id", "number_hash", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    all_docs, unique = numbered(docs)
    texts = all_docs.select("doc", "text").where(F.octet_length("text") >= length)
    if not unique:
        texts = texts.dropDuplicates(["doc"])
    with_ranges = all_docs.join(find_repeats(texts, length, crowd, sampled), "doc", "left")

    def remove(b):
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for text, ranges in zip(b["text"], b["ranges"], strict=True):
            raw = (text or "").encode()
            start, end = merge_ranges(np.array(ranges, np.int64)) if ranges else (np.empty(0, np.int64),) * 2
            cuts = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))
            for c, v in zip(out, (len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")), strict=True):
                out[c].append(v)
        return out

    out = add_columns(with_ranges, ["text", "ranges"], remove, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.drop("doc", "ranges")
