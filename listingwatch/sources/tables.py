"""Readers of listing frames, posts and official items; tables in the shared folder."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = """source_id string, scan_id long, seq int, url string, title string, brand string, series string, model string,
    barcode string, sku string, price string, currency string, price_text string, availability_raw string,
    availability_text string, has_buy_button boolean, price_tax_included boolean, image string, release_date string, raw_text string"""
ITEM = """externalId: string, url: string, title: string, productCode: string, brand: string, series: string, barcode: string, locale: string, eventType: string,
    publishedAt: string, updatedAt: string, releaseDate: string, msrp: double, currency: string, image: string, summary: string"""
POST = "id string, text string, created_at timestamp, author string, url string, lang string, repost boolean, sensitive boolean"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset: tables between steps go to the warehouse, which all executors must share", stacklevel=2)
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for at in paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """The tables between steps of one piece of work.

    `with Scratch(spark): result(...).write...` deletes on leaving what cut() and new_folder() have made inside, and nothing
    that other work has made. Results that are still lazy must be written inside.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *error) -> None:
        self.leave()
        self.clear()

    def leave(self) -> None:
        """End the block, but keep its tables."""
        Scratch._open.remove(self)

    def clear(self, *but: DataFrame) -> None:
        """Delete the tables so far, apart from those that `but` reads."""
        read = {folder_name(f) for df in but for f in df.inputFiles()}
        gone = [p for p in self.paths if p.rpartition("/")[2] not in read]
        self.paths = [p for p in self.paths if p not in gone]
        delete(self.spark, gone)


def folder_name(file: str) -> str:
    return file.rpartition("/")[0].rpartition("/")[2]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it belongs to the innermost open Scratch."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: ends the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a cut table that nothing reads any more."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    names = {f.rpartition("/")[2] for f in folders}
    for scratch in Scratch._open:
        scratch.paths = [p for p in scratch.paths if p.rpartition("/")[2] not in names]
    delete(df.sparkSession, sorted(folders))


def listing_frames(spark: SparkSession, path: str) -> DataFrame:
    """One listing a JSON line."""
    return spark.read.schema(LISTING).json(path)


def posts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) posts of JSON lines: a post needs an id and an address on its platform."""
    rows = spark.read.schema(POST).json(path)
    fits = F.coalesce((F.col("id") != "") & F.col("url").rlike(r"(?i)^https?://(www\.|mobile\.)?(x|twitter)\.com/"), F.lit(False))
    return rows.where(fits), rows.where(~fits)


def official_feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of an official feed's JSON documents ({source, items: []}; one a file, or one a line), numbered in the order of the list."""
    rows = spark.read.schema(f"source string, items array<struct<{ITEM}>>").option("multiLine", not lines).json(path)
    return rows.select("source", F.posexplode("items").alias("seq", "item")).select("source", "seq", "item.*")


def append_observations(observations: DataFrame, path: str) -> None:
    """Appends raw observations, partitioned by day."""
    observations.withColumn("day", F.to_date("observed_at")).write.mode("append").partitionBy("day").parquet(path)


def sync_registry(known: DataFrame, defined: DataFrame) -> DataFrame:
    """Sources after a new set of definitions: defined ones are set, managed ones that are gone are switched off, others stay.

    known: (source_key, managed, enabled, settings map), defined: (source_key, settings), one row a key. Settings named like
    secrets are dropped.
    """
    new = defined.select("source_key", F.map_filter("settings", lambda k, _: ~F.lower(k).rlike("token|secret|webhook|password|api_?key")).alias("now"), F.lit(True).alias("is_defined"))
    joined = known.join(new, "source_key", "full")
    here = F.coalesce("is_defined", F.lit(False))
    enabled = F.when(here, F.coalesce("enabled", F.lit(True))).otherwise(F.col("enabled") & ~F.col("managed"))
    return joined.select("source_key", F.when(here, True).otherwise(F.col("managed")).alias("managed"), enabled.alias("enabled"), F.coalesce("now", "settings").alias("settings"))
