"""Operator 12: ranked lexical search over a length-stratified index.

The index holds every document, in blocks. A block's documents are grouped by equal length normaliser m (strata); within a
stratum a term's postings stand by tf, so a posting's impact is worked out once for each tf. The largest tf of a list gives
the most that a term can add in a stratum, and the sum over an item's terms bounds its documents' scores. Strata are visited by
falling bound until none can reach the k-th best score that the task has found; what is left out can't be among the
best. Each task keeps the k best of each item over all its blocks, and Spark ranks the tasks' finds.

Documents are never shuffled: postings of the asked terms are written once, and only finds (k a task and item) move.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: A term in UTF-8, where all bytes of other than ASCII characters are above 0x7F; only A-Z are lower-cased.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of text that are cut into terms at a time.
PIECE = 1 << 20
#: A block of the index ends with so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 1_000_000
#: Items are asked in blocks of about so many, and so many bytes of text: what is broadcast and what a task keeps is bounded.
ITEMS, ITEM_BYTES = 4_000, 8 << 20
#: Strata visited first; each further step visits twice as many.
FIRST_STRATA = 4
INDEX = "doc_ids array<long>, lengths array<long>, terms array<int>, tfs array<int>, docs array<int>"


def tally(text: bytes | None) -> tuple[int, Counter]:
    """Number of terms, and how often each occurs, of a whole text in pieces that part no term."""
    n, found, at = 0, Counter(), 0
    while text and at < len(text):
        gap = GAP.search(text, at + PIECE)
        until = gap.start() if gap else len(text)
        terms = TERM.findall(text[at:until].lower())
        n, at = n + len(terms), until
        found.update(terms)
    return n, found


def index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Blocks of the index: ids and lengths of all documents, and postings of the terms that `number` names.

    A posting is (term, tf, document's place in the block). Rows are written to the shared folder, as lengths of all documents
    must be known before normalisers are.
    """
    known = docs.sparkSession.sparkContext.broadcast(number)
    schema = pa.schema([(n, pa.list_(pa.int64() if n in ("doc_ids", "lengths") else pa.int32())) for n in ("doc_ids", "lengths", "terms", "tfs", "docs")])

    def run(batches):
        numbers = known.value
        doc_ids, lengths, terms, tfs, counts = [], [], [], [], []

        def block():
            places = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            return pa.RecordBatch.from_pydict({"doc_ids": [doc_ids], "lengths": [lengths], "terms": [terms], "tfs": [tfs], "docs": [places]}, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = tally(text.as_py())
                asked = [(i, tf) for i, tf in ((numbers.get(t), tf) for t, tf in found.items()) if i is not None]
                doc_ids.append(doc_id)
                lengths.append(n)
                terms.extend(i for i, _ in asked)
                tfs.extend(tf for _, tf in asked)
                counts.append(len(asked))
                if len(doc_ids) >= BLOCK_DOCS or len(terms) >= BLOCK_POSTINGS:
                    yield block()
                    doc_ids, lengths, terms, tfs, counts = [], [], [], [], []
        if doc_ids:
            yield block()

    return cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX), "postings")


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = ends - starts
    offsets = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return offsets + np.arange(sizes.sum())


class Strata:
    """One block of the index, ordered for search. weights: of each term; n_docs, n_terms: of the whole table."""

    def __init__(self, lengths, terms, tfs, docs, weights, n_docs: int, n_terms: int):
        m = 100 - 50 + 50 * lengths * n_docs // max(n_terms, 1)
        self.m, stratum = np.unique(m, return_inverse=True)
        stratum = stratum[docs]
        order = np.lexsort((tfs, stratum, terms))
        terms, tfs, stratum, self.docs = terms[order], tfs[order].astype(np.int64), stratum[order], docs[order]
        new_list = np.ones(len(terms), bool)
        new_list[1:] = (terms[1:] != terms[:-1]) | (stratum[1:] != stratum[:-1])
        new_tf = new_list.copy()
        new_tf[1:] |= tfs[1:] != tfs[:-1]
        runs = np.flatnonzero(new_tf)
        once = weights[terms[runs]] * (1_000_000_000 * tfs[runs] // (1000 * tfs[runs] + 20 * self.m[stratum[runs]]))
        self.impacts = np.repeat(once, np.diff(np.append(runs, len(terms))))
        self.starts = np.flatnonzero(new_list)
        self.ends = np.append(self.starts[1:], len(terms))
        self.strata = stratum[self.starts]
        self.most = self.impacts[self.ends - 1] if len(terms) else np.zeros(0, np.int64)
        self.of_term = np.searchsorted(terms[self.starts], np.arange(len(weights) + 1))
        self.sums = np.zeros(len(lengths), np.int64)

    def best(self, item: np.ndarray, k: int, have: tuple[np.ndarray, np.ndarray], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, doc_id) of this block and `have`, by falling score and rising doc_id."""
        lists = spans(self.of_term[item], self.of_term[item + 1])
        bounds = np.zeros(len(self.m), np.int64)
        np.add.at(bounds, self.strata[lists], self.most[lists])
        ranked = np.argsort(-bounds, kind="stable")
        at, step = 0, FIRST_STRATA
        while at < len(ranked):
            floor = max(1, have[0][-1] if len(have[0]) == k else 1)
            group = ranked[at : at + step]
            group = group[bounds[group] >= floor]
            if not len(group):
                break
            visited = np.zeros(len(self.m), bool)
            visited[group] = True
            now = lists[visited[self.strata[lists]]]
            postings = spans(self.starts[now], self.ends[now])
            np.add.at(self.sums, self.docs[postings], self.impacts[postings])
            found = np.flatnonzero(self.sums >= floor)
            scores, ids = np.append(have[0], self.sums[found]), np.append(have[1], doc_ids[found])
            order = np.lexsort((ids, -scores))[:k]
            have = scores[order], ids[order]
            self.sums[self.docs[postings]] = 0
            at, step = at + step, 2 * step
        return have


#: Stands for a null doc_id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


def search(blocks: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item, an item being its terms' numbers."""
    asked = blocks.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = asked.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        have = [none] * len(items)
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, terms, tfs, docs = (batch.column(c)[row].values for c in range(5))
                ids = doc_ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                block = Strata(*(x.to_numpy(zero_copy_only=False) for x in (lengths, terms, tfs, docs)), weights, n_docs, n_terms)
                have = [block.best(item, k, h, ids) for item, h in zip(items, have, strict=True)]
        ids = np.concatenate([h[1] for h in have])
        yield pa.RecordBatch.from_pydict(
            {"item": np.repeat(np.arange(len(items), dtype=np.int32), [len(h[0]) for h in have]), "doc_id": pa.array(ids, mask=ids == NO_ID), "score": np.concatenate([h[0] for h in have])},
            schema=pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())]),
        )

    return blocks.mapInArrow(run, "item int, doc_id long, score long")


def ask(docs: DataFrame, items: list, k: int) -> DataFrame:
    """rank() for one block of items: rows of (item_id, text)."""
    spark = docs.sparkSession
    terms = [sorted(tally(r["text"])[1]) for r in items]
    number = {t: i for i, t in enumerate(sorted({t for x in terms for t in x}))}
    blocks = index(docs, number)
    n_docs, n_terms = blocks.select(F.expr("size(filter(lengths, x -> x > 0))").alias("n"), F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    holding = np.zeros(len(number), np.int64)
    for r in blocks.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as asked terms
        holding[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    asked = [np.array([number[t] for t in x], np.int64) for x in terms]
    found = search(blocks, asked, weights, n_docs, n_terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item with a score above 0.

    docs: (doc_id, text), items: (item_id, text); other columns are not read. A null text has no terms, an item without terms
    or without a document that has one of them no rows. Each row of docs is a document of its own, whatever its doc_id; a null
    doc_id comes after all others of its score. Equal rows of items are asked once; texts that share an item_id are ranked
    each for itself. Items are asked in blocks, and each block reads docs once.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n = max(1, math.ceil(max(count / ITEMS, size / ITEM_BYTES)))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    found = [ask(docs, asked.where(place == b).orderBy("item_id", "text").collect(), k) for b in range(n)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
