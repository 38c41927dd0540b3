"""Streaming sinks that keep state in tables: snapshots that repeated batches don't change, and deliveries with an outbox.

Both are functions of a micro-batch and its id, for foreachBatch. What a batch writes lies in folders named by its id, and
counts once Spark has put its _SUCCESS mark there; a batch that is run again finds its own mark, or writes its folder anew.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import upsert
from ..sources.tables import delete

#: Parts of a snapshot; a batch rewrites the parts that hold its keys.
BUCKETS = 64
#: Versions of a snapshot that are kept for readers that have begun.
VERSIONS = 2


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the batches whose folders under this one are complete, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, table: str, version: int) -> dict[int, int]:
    """Bucket -> batch that wrote it last; BUCKETS rows at most."""
    return {r["bucket"]: r["batch_id"] for r in spark.read.schema("bucket int, batch_id long").parquet(f"{table}/versions/batch={version}").collect()}


def read_buckets(spark: SparkSession, table: str, parts: dict[int, int], schema: str) -> DataFrame:
    paths = [f"{table}/rows/batch={batch}/bucket={bucket}" for bucket, batch in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The snapshot after the last complete batch."""
    versions = committed(spark, f"{table}/versions")
    return read_buckets(spark, table, manifest(spark, table, versions[-1]) if versions else {}, schema)


def upsert_batch(batch: DataFrame, batch_id: int, table: str, schema: str, keys: list[str], rules: dict[str, str], buckets: int = BUCKETS) -> bool:
    """Puts a batch, one row a key, into the snapshot by upsert's rules; False if the snapshot has it already.

    Parts without a key of the batch are not read or written. The new version is a small table of which batch each part is
    from; it is written last, so a reader sees all of a batch or nothing. Parts and versions that no kept version names go.
    """
    spark = batch.sparkSession
    versions = committed(spark, f"{table}/versions")
    if versions and versions[-1] >= batch_id:
        return False
    parts = manifest(spark, table, versions[-1]) if versions else {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = batch.withColumn("bucket", bucket).persist()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    old = read_buckets(spark, table, {b: parts[b] for b in touched if b in parts}, schema)
    after = upsert(old, new.drop("bucket"), keys, rules).withColumn("bucket", bucket)
    after.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/rows/batch={batch_id}")
    new.unpersist()
    parts |= dict.fromkeys(touched, batch_id)
    spark.createDataFrame(sorted(parts.items()), "bucket int, batch_id long").coalesce(1).write.mode("overwrite").parquet(f"{table}/versions/batch={batch_id}")
    kept = [*versions, batch_id][-VERSIONS:]
    named = set().union(*(set(manifest(spark, table, v).values()) for v in kept))
    gone = [f"{table}/versions/batch={v}" for v in versions if v not in kept]
    gone += [f"{table}/rows/batch={b}" for b in committed(spark, f"{table}/rows") if b not in named and b <= batch_id]
    delete(spark, gone)
    return True


def upsert_stream(stream: DataFrame, table: str, schema: str, keys: list[str], rules: dict[str, str], prepare: Callable[[DataFrame], DataFrame]) -> None:
    """Runs the stream over what has arrived into the snapshot; prepare makes one row a key of a micro-batch. The checkpoint lies
    with the table, as its batch ids do."""
    run = stream.writeStream.foreachBatch(lambda batch, batch_id: upsert_batch(prepare(batch), batch_id, table, schema, keys, rules) and None)
    run.option("checkpointLocation", f"{table}/_checkpoint").trigger(availableNow=True).start().awaitTermination()


DELIVERY = "channel string, dedup_key string, title string, body string"
RESULT = "channel string, dedup_key string, attempt int, status string, detail string"


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All tries of deliveries so far."""
    done = committed(spark, f"{folder}/results")
    return spark.read.schema(RESULT).parquet(*[f"{folder}/results/batch={b}" for b in done]) if done else spark.createDataFrame([], RESULT)


def open_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Queued deliveries that no try has settled, with the number of their next attempt. Sent and skipped ones are settled."""
    queued = committed(spark, f"{folder}/queue")
    if not queued:
        return spark.createDataFrame([], DELIVERY + ", attempt int")
    rows = spark.read.schema(DELIVERY).parquet(*[f"{folder}/queue/batch={b}" for b in queued]).dropDuplicates(["channel", "dedup_key"])
    tries = results(spark, folder).groupBy("channel", "dedup_key").agg(F.max("attempt").alias("tried"), F.bool_or(F.col("status").isin("sent", "skipped")).alias("settled"))
    joined = rows.join(tries, ["channel", "dedup_key"], "left").where("not coalesce(settled, false)")
    return joined.select(*rows.columns, (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))


def deliver_batch(batch: DataFrame, batch_id: int, folder: str, send: Callable[[dict], str | None]) -> bool:
    """Queues a batch of deliveries (channel, dedup_key, title, body) and tries all that are open, those that failed before
    included; False if this batch's tries are recorded already.

    send is called in tasks with a delivery's values and attempt, and returns its status: sent (also for None), skipped or failed;
    an exception is a failure with its text. A try that is cut off before it is recorded is made again, so a delivery is called
    at least once: a receiver that keeps the dedup_keys it has seen takes each once.
    """
    spark = batch.sparkSession
    if batch_id in committed(spark, f"{folder}/results"):
        return False
    batch.select("channel", "dedup_key", "title", "body").write.mode("overwrite").parquet(f"{folder}/queue/batch={batch_id}")
    schema = pa.schema([("channel", pa.string()), ("dedup_key", pa.string()), ("attempt", pa.int32()), ("status", pa.string()), ("detail", pa.string())])

    def call(batches):
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                try:
                    status, detail = send(row) or "sent", None
                except Exception as error:  # a receiver's fault is a result
                    status, detail = "failed", f"{type(error).__name__}: {error}"[:500]
                out.append({"channel": row["channel"], "dedup_key": row["dedup_key"], "attempt": row["attempt"], "status": status, "detail": detail})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    open_deliveries(spark, folder).mapInArrow(call, RESULT).write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")
    return True


def delivery_stream(stream: DataFrame, folder: str, send: Callable[[dict], str | None]) -> None:
    """Runs a stream of deliveries over what has arrived; what fails is tried again with every later batch, over restarts."""
    run = stream.writeStream.foreachBatch(lambda batch, batch_id: deliver_batch(batch, batch_id, folder, send) and None)
    run.option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
