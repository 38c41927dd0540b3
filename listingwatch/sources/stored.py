"""Readers of stored frames, posts and sitemaps in their several shapes, and retention that leaves untouched partitions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from .tables import LISTING, POST, cut, delete

# Names of a listing's fields where they differ from the column, how posts may be had, and their hosts.
FIELDS = {
    "price_text": "priceText", "availability_raw": "availabilityRaw", "availability_text": "availabilityText", "has_buy_button": "hasBuyButton", "price_tax_included": "priceTaxIncluded",
    "release_date": "releaseDate", "raw_text": "rawText",
}
METHODS = ("fixture", "x_api", "rss", "public_api")
POST_HOSTS = ("x.com", "twitter.com")
LISTED = [c.strip().split(" ") for c in LISTING.split(",") if c.split()[0] not in ("source_id", "scan_id", "seq")]


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_frames, frame, seq and a listing's columns) of JSON documents, one a file: {"frames": [frame, …]}, [frame, …] or
    {"listings": [listing, …]}, where a frame is a list of listings, and in a bare list may be a single one.

    A document of another shape, or one that isn't JSON, has no frames. Values of another type than the column's are null.
    """
    documents = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    of = lambda where, kind: F.try_variant_get("v", where, kind)
    listings = of("$.listings", "array<variant>")
    shape = F.coalesce(of("$.frames", "array<variant>"), F.when(listings.isNotNull(), F.array(of("$.listings", "variant"))), of("$", "array<variant>"))
    rows = documents.select("file", F.size(shape).alias("n_frames"), F.posexplode(shape).alias("frame", "content"))
    listed = F.coalesce(F.try_variant_get("content", "$", "array<variant>"), F.array("content"))
    rows = rows.select("file", "n_frames", "frame", F.posexplode(listed).alias("seq", "listing"))
    return rows.select("file", "n_frames", "frame", "seq", *[F.coalesce(*[F.try_variant_get("listing", f"$.{n}", t) for n in dict.fromkeys((FIELDS.get(c, c), c))]).alias(c) for c, t in LISTED])


def at_frame(found: DataFrame, index: Column) -> DataFrame:
    """The rows of each file's frame of this number; a number beyond the frames is the nearest that there is. A frame without
    listings has no rows, but counts."""
    return found.where(F.col("frame") == nearest(index))


def nearest(index: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("n_frames") - 1, F.coalesce(index, F.lit(0))))


def replay(found: DataFrame, start: int = 0) -> DataFrame:
    """Stored frames as a stream: its k-th trigger brings the frame start + k of each file (column `step`), and after a file's
    last frame that one again. A stream that goes on from its checkpoint goes on with the next step.

    The steps are a stream of one row a trigger, which is broadcast; the frames stay where they are.
    """
    steps = found.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    steps = F.broadcast(steps.select((F.col("value") + start).alias("step")))
    return found.join(steps, F.col("frame") == nearest(F.col("step")))


def checked_posts(spark: SparkSession, path: str, profile: str, method: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) of lines of JSON: the posts, and what is none, with the line and a reason.

    Reasons, the first that holds: malformed (a line that is no post), method_not_allowed, no_id, wrong_host (the address isn't on
    the platform), no_text. A post without an address has the one that its id gives under `profile`. method is how each was
    had, by the columns of a post and the file's metadata; null if all are fixtures.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", f"{POST}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("p")).where(F.trim("line") != "")
    rows = lines.select("line", "p.*").withColumn("id", F.trim("id"))
    rows = rows.withColumn("url", F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.when(F.col("id") != "", F.concat(F.lit(f"{profile}/status/"), "id"))))
    host = urls.bare_host(urls.canonical(F.col("url")))
    reason = (
        F.when(F.col("broken").isNotNull(), "malformed").when(~(F.lit("fixture") if method is None else F.coalesce(method, F.lit(""))).isin(*METHODS), "method_not_allowed").when(F.coalesce("id", F.lit("")) == "", "no_id")
        .when(~F.coalesce(host.isin(*POST_HOSTS), F.lit(False)), "wrong_host").when(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == "", "no_text")
    )
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason", "broken", "line"), judged.where("reason is not null").select("id", "url", "reason", "line")


def sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, loc) of sitemap files: pages (`url`) and further maps (`sitemap`). Files are read by row tag, so a large one is
    split over tasks and none is held as one text."""
    found = []
    for kind in ("url", "sitemap"):
        rows = spark.read.format("xml").option("rowTag", kind).schema("loc string").load(path)
        found.append(rows.select(F.col("_metadata.file_path").alias("file"), F.lit(kind).alias("kind"), F.trim("loc").alias("loc")).where("loc <> ''"))
    return reduce(DataFrame.unionByName, found)


def sitemap_pages(entries: DataFrame, files: DataFrame, roots: DataFrame, most_depth: int = 50) -> DataFrame:
    """Distinct (root, loc) of the pages that each root's map and the maps that it names, directly or not, lead to.

    entries: sitemap_entries, files: (loc, file), where the map of an address is stored; roots: (root, loc). Maps are followed
    level by level until no new one is found; a map is read once a root, so maps that name each other end.
    """
    named = entries.join(files.withColumnRenamed("loc", "map"), "file").select("map", "kind", "loc")
    seen = newest = cut(roots.select("root", F.col("loc").alias("map")).distinct(), "maps")
    for _ in range(most_depth):
        found = newest.join(named.where("kind = 'sitemap'"), "map").select("root", F.col("loc").alias("map")).distinct().join(seen, ["root", "map"], "left_anti")
        newest = cut(found, "maps")
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen.join(named.where("kind = 'url'"), "map").select("root", "loc").distinct()


def partition_folders(spark: SparkSession, path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if "=" in s.getPath().getName()]


def rewrite_partitions(changed: DataFrame, path: str, part: str) -> None:
    """Puts rows in the place of the partitions they belong to; the files of all others stay as they are."""
    spark = changed.sparkSession
    staged = cut(changed, "partitions")  # what is read lies in what is overwritten
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    delete(spark, sorted({f.rpartition("/")[0] for f in staged.inputFiles()}))


def keep_newest_rows(spark: SparkSession, path: str, part: str, order: str, n: int) -> int:
    """Retention by count in a table whose partitions rise with `order`: only the n rows of highest order stay; returns how many
    went. The partition that the n-th row is in is found by counting; older ones are deleted, it alone is rewritten."""
    rows = spark.read.parquet(path)
    left, gone = n, 0
    for value, size in sorted(((r[0], r[1]) for r in rows.groupBy(part).count().collect()), reverse=True):  # a row a partition
        if size > left:
            inside = rows.where(F.col(part) == F.lit(value))
            if left:
                rewrite_partitions(inside.orderBy(F.desc(order)).limit(left), path, part)
            else:
                delete(spark, [f"{path}/{f}" for f in partition_folders(spark, path) if f == f"{part}={value}"])
            gone += size - left
        left = max(0, left - size)
    return gone


def blank_old_values(spark: SparkSession, path: str, part: str, column: str, at: str, cutoff: Column) -> int:
    """Retention by age: the column of rows before the cutoff becomes null; returns how many were. Partitions without such a
    value are not written."""
    rows = spark.read.parquet(path)
    old = F.col(column).isNotNull() & (F.col(at) < cutoff)
    touched = rows.where(old).groupBy(part).count().collect()  # a row a partition
    if touched:
        rewrite_partitions(rows.where(F.col(part).isin(*[r[0] for r in touched])).withColumn(column, F.when(~old, F.col(column))), path, part)
    return sum(r["count"] for r in touched)
