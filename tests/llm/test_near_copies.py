"""The pipeline's near-dedup against Jaccard similarity by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from listingwatch.llm import common, near_copies

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard_plain(a, b):
    def parts(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b)


def altered(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"other{rng.getrandbits(40)}"
    return words


def kept_plain(texts):
    low = {i: i for i in texts}
    near = [(a, b) for a in texts for b in texts if a < b and jaccard_plain(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    return {i for i in texts if low[i] == i}


@pytest.mark.parametrize("block, set_block", [(near_copies.BLOCK, near_copies.SET_BLOCK), (40, 1_000), (40, 300)])
def test_copies_of_similarity_80_to_95(spark, block, set_block):
    rng = random.Random(5)
    texts = {}
    for _ in range(30):
        words = [f"w{rng.getrandbits(30)}" for _ in range(rng.choice([120, 200, 400]))]
        for share in (0, 0.006, 0.012, 0.018, 0.022, 0.03, 0.05):
            texts[len(texts)] = " ".join(altered(rng, words, round(share * len(words))))
    crowd = [f"w{rng.getrandbits(30)}" for _ in range(150)]
    for _ in range(60):
        texts[len(texts)] = " ".join(altered(rng, crowd, rng.choice([1, 2, 3, 6])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOC)
    assert {r.doc_id for r in near_copies.drop_copies(docs, block, set_block).collect()} == kept_plain(texts)


def test_pipeline_stage_drops_copies_of_ten_bits(spark):
    import corpus_pipeline

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect() if r.text}
    assert 0.8 <= jaccard_plain(texts[1], texts[177]) < 0.85
    kept = {r.doc_id for r in common.cut(corpus_pipeline.drop_near_copies(spark, rows, None), "test").collect()}
    assert 1 in kept and 177 not in kept
    assert kept & set(texts) == kept_plain(texts)


def test_rows_that_share_a_doc_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (3, b + " stop"), (None, a), (None, b)]
    out = near_copies.drop_copies(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted([(1, a), (2, b), (0, a), (0, b)])


def test_index_lists_go_by_bytes_of_the_fingerprint():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 2**40, n)) for n in (9, 300)]
    found = near_copies.prints({"text": texts})
    batch = pa.RecordBatch.from_pydict({"node": found["node"], "n": pa.array(found["n"], pa.int64()), "wide": found["wide"]})
    entries = pa.Table.from_batches(near_copies._entries([batch])).to_pylist()
    pairs = np.concatenate([near_copies.PAIRS, near_copies.MORE_PAIRS]).tolist()
    for node, octets, lists in zip(found["node"].tolist(), found["wide"], (len(pairs), len(near_copies.PAIRS)), strict=True):
        own = {(a, b): (octets[a], octets[b]) for a, b in pairs[:lists]}
        assert {tuple(pairs[e["key"] >> 16]): (e["key"] >> 8 & 255, e["key"] & 255) for e in entries if e["node"] == node} == own


def test_pairs_below_the_least_shared_bytes_are_no_candidates():
    rows = np.array([[0, 100, 0, 0, 0, 0]])
    spread, gathered = rows.copy(), rows.copy()
    spread[0, 2:] = 0x0101010101010101  # 32 bits, one in each byte
    gathered[0, 2:4] = 0x0101010101010101, 0x0303030303030303  # 24 bits, 16 bytes shared
    assert near_copies._near(rows, spread).tolist() == [False] and near_copies._near(rows, gathered).tolist() == [True]
