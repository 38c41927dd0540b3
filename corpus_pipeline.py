"""Corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. A stage's docs are a table that is written, so each begins by deleting what the stages before it
in the same run have put between their steps (not what its docs read, and nothing of other work). A run begins with the
first stage; runs over different folders don't touch each other's tables.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingwatch.llm import bpe, common, mixing, near_copies, suffix_dedup, toxicity
from listingwatch.sources.tables import Scratch, cut, drop

#: What the stages of the newest run over a folder have put between their steps.
RUNS: dict[str | None, Scratch] = {}


def stage(first: bool = False):
    """A stage whose tables between steps belong to its run: the next stage deletes them."""

    def wrap(function):
        @functools.wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = RUNS.get(sf_dir)
            if first or before is None or before.spark is not spark:
                RUNS[sf_dir] = Scratch(spark)  # an earlier run's last result may still be read: its tables stay
            else:
                before.clear(docs)
                spark._jvm.System.gc()  # the driver drops the shuffle files of frames that nothing holds
            with_tables = RUNS[sf_dir]
            with_tables.__enter__()
            try:
                return function(spark, docs, sf_dir)
            finally:
                with_tables.leave()

        return run_stage

    return wrap


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@stage(first=True)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict toxic; it learns from `labels` of the documents it is given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.classify(docs.select(COLUMNS), labels).where("predicted = 0").select(COLUMNS)


@stage()
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with 0.8 of their five-word shingles in common: the smallest doc_id's.

    Equal rows (doc_id and text) count as one document. Documents without a doc_id all stay.
    """
    docs = docs.select(COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    return near_copies.drop_copies(docs).select(COLUMNS)


@stage()
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that start earlier; documents of which no word is left go."""
    cleaned = suffix_dedup.remove_repeats(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cleaned.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(common.WORD))
    return left.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


@stage()
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in training order."""
    mixed = mixing.mix(docs.select(COLUMNS), columns=["text", "lang", "source", "n_chars"])
    return mixing.training_order(mixed).select(COLUMNS)


@stage()
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and its place in training order: the mix's range-sorted
    file and the row in it (null where docs are not read from files)."""
    if docs.inputFiles():
        docs = docs.withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")})
    else:
        docs = docs.withColumns({"file": F.lit(None).cast("string"), "row": F.lit(None).cast("long")})
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=("file", "row"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
            if before is not None:
                drop(before)
            before = docs
    return docs
