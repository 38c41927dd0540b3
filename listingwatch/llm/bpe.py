"""Operator 1: byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to CHUNK characters are pre-tokenised and encoded where they are read. A longer text is cut into
chunks that overlap; chunks are pre-tokenised in parallel by any executor, and where two neighbours have a
pre-token boundary in common inside their overlap, they agree from there on (the pattern never looks back), so
that boundary becomes the seam. Neighbours without a common boundary (one run of letters across the whole
overlap) are joined into one piece first. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows

CHUNK = 32_768
OVERLAP = 1_024
#: A match that ends so near to a chunk's end could be longer with more text (contractions take two letters).
UNSURE = 4
#: Pre-tokens whose ids each Python worker remembers.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PieceIds(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; remembers what it has encoded."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self.encode = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(piece), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


@cache
def compiled(pattern: str):
    return regex.compile(pattern)


def encode_text(text: str, path: str, pattern: str) -> bytes:
    return b"".join(map(piece_ids(path).__getitem__, compiled(pattern).findall(text)))


def decode_ids(ids: bytes, path: str) -> bytes:
    return piece_ids(path).decode(ids)


def boundaries(text: str, pattern: str, last: bool) -> np.ndarray:
    """Offsets where pre-tokens start, as far as text beyond the chunk cannot move them."""
    starts = np.fromiter((m.start() for m in compiled(pattern).finditer(text)), np.int64)
    return starts if last else starts[starts <= len(text) - UNSURE]


def encode(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids: binary), and the
    columns of docs that `carry` names.

    Null and empty texts give no tokens and the hashes of no bytes. A null or repeated doc_id is kept: one row
    out for each row in. Other columns of docs are not read. Long texts are written out with a row number first, as their
    chunks and seams must agree on it even if an executor is lost and its rows are read again.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("none"), *carry).alias("kept"))
    kept_type = texts.schema["kept"].dataType.simpleString()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def digest(doc_ids, all_ids):
        out = {
            "doc_id": doc_ids,
            "n_tokens": [len(x) // 4 for x in all_ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in all_ids],
            "decoded_sha256": [hashlib.sha256(decode_ids(x, ranks)).hexdigest() for x in all_ids],
        }
        return out | {"ids": all_ids} if keep_ids else out

    def encode_short(b):
        return digest(b["doc_id"], [encode_text(t, ranks, pattern) for t in b["text"]]) | {"kept": b["kept"]}

    short = map_rows(texts.where(F.length("text") <= chunk), encode_short, f"{schema}, kept {kept_type}")

    def chunks(b):
        out = {"row": [], "doc_id": [], "no": [], "last": [], "text": []}
        for row, doc_id, text in zip(b["row"], b["doc_id"], b["text"], strict=True):
            for no, at in enumerate(range(0, len(text), chunk)):
                for k, v in zip(out, (row, doc_id, no, at + chunk >= len(text), text[at : at + chunk + overlap]), strict=True):
                    out[k].append(v)
        return out

    long = cut(texts.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "bpe-long")
    parts = map_rows(long.select("row", "doc_id", "text"), chunks, "row long, doc_id long, no int, last boolean, text string", 16).repartition("row", "no")

    def ends(b):
        found = [boundaries(t, pattern, last) for t, last in zip(b["text"], b["last"], strict=True)]
        return {
            "row": b["row"],
            "no": b["no"],
            "head": [x[x < overlap].tolist() for x in found],
            "tail": [(x[x >= chunk] - chunk).tolist() for x in found],
        }

    by_row = Window.partitionBy("row").orderBy("no")
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(by_row)))
    seams = map_rows(parts, ends, "row long, no int, head array<int>, tail array<int>", 32)
    seams = seams.select("row", "no", F.when(F.col("no") == 0, 0).otherwise(common).alias("seam"))
    seams = seams.withColumn("segment", F.count("seam").over(by_row)).withColumn("until", F.lead("seam").over(by_row))
    segments = parts.join(seams, ["row", "no"])

    def encode_segment(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        text = "".join(r["text"][:chunk] for r in rows[:-1])
        stop = rows[-1]["until"]
        text += rows[-1]["text"][: chunk + (stop or 0)] if not rows[-1]["last"] else rows[-1]["text"]
        ids = encode_text(text[rows[0]["seam"] :], ranks, pattern)
        return pa.table({"row": [rows[0]["row"]], "doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "segment": [rows[0]["segment"]], "ids": pa.array([ids], pa.binary())})

    def join_segments(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        out = digest([rows[0]["doc_id"]], [b"".join(r["ids"] for r in rows)]) | {"row": [rows[0]["row"]]}
        return pa.table({k: pa.array(v, pa.int64()) if k in ("doc_id", "n_tokens", "row") else pa.array(v) for k, v in out.items()})

    encoded = segments.groupBy("row", "segment").applyInArrow(encode_segment, "row long, doc_id long, segment long, ids binary")
    joined = encoded.groupBy("row").applyInArrow(join_segments, f"{schema}, row long").join(long.select("row", "kept"), "row").drop("row")
    return short.unionByName(joined).select("*", *[F.col(f"kept.{c}").alias(c) for c in carry]).drop("kept")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes binary); null ids give null bytes."""
    return map_rows(encoded.select("doc_id", "ids"), lambda b: {"doc_id": b["doc_id"], "bytes": [None if x is None else decode_ids(x, ranks) for x in b["ids"]]}, "doc_id long, bytes binary")


def pack(ids: list[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    return np.asarray(array("L", ids), "<u4").tobytes()
