"""Registered queries of stored frames, posts and sitemaps, and of retention by partitions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stored
from ..sources.tables import cut, new_folder
from ..streaming import jobs
from .oracle import OPS
from .views import operations, table


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's file holds the lowest and highest part of each line number as frames, in one of four shapes."""
    path = new_folder(spark, "frame-files")
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))
    listing = lambda c: F.concat(F.lit('{"title":"part '), c, F.lit('","price":"'), c, F.lit('.50","hasBuyButton":'), F.when(F.col(c) % 2 == 0, "true").otherwise("false"), F.lit("}"))
    frame = F.concat(F.lit("["), listing("low"), F.lit(","), listing("high"), F.lit("]"))
    kind = F.col("l_suppkey") % 4
    row = part.select("l_suppkey", "l_linenumber", F.when(kind == 2, listing("low")).otherwise(frame).alias("frame"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "frame"))), lambda x: x["frame"]), ",")  # seven frames
    files = row.groupBy("l_suppkey").agg(body.alias("b"), F.min(F.struct("l_linenumber", "frame"))["frame"].alias("one"))
    text = F.when(kind == 0, F.concat(F.lit('{"frames":['), "b", F.lit("]}"))).when(kind == 3, F.concat(F.lit('{"listings":'), "one", F.lit("}"))).otherwise(F.concat(F.lit("["), "b", F.lit("]")))
    files.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_suppkey").alias("supplier"), text.alias("value")).repartition("supplier").write.partitionBy("supplier").option("maxRecordsPerFile", 1).text(path)
    return stored.frames(spark, f"{path}/supplier=*").withColumn("supplier", F.regexp_extract("file", "supplier=([0-9]+)", 1).cast("long"))


def s1_stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame asked for goes by the supplier's number, so that some are clamped."""
    found = frame_files(spark, sf_dir)
    return stored.at_frame(found, (F.col("supplier") % 9 - 1).cast("int")).select("supplier", "frame", "seq", "title", "price", "has_buy_button")


S1 = """WITH g AS (SELECT l_suppkey AS supplier, l_linenumber, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY l_linenumber) - 1 AS frame, count(*) OVER (PARTITION BY supplier) - 1 AS last FROM g),
    w AS (SELECT *, CASE WHEN supplier % 4 = 3 THEN 0 ELSE greatest(0, least(last, supplier % 9 - 1)) END AS wanted FROM p), l AS (SELECT supplier, frame, unnest(CASE WHEN supplier % 4 = 2 THEN [{'seq': 0, 'n': low}] ELSE [{'seq': 0, 'n': low}, {'seq': 1, 'n': high}] END) AS x FROM w WHERE frame = wanted)
    SELECT supplier, CAST(frame AS INTEGER) AS frame, x.seq, 'part ' || x.n AS title, x.n || '.50' AS price, x.n % 2 = 0 AS has_buy_button FROM l"""


def s1_replayed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' frames as a stream from the fifth on, one a trigger; each of four runs goes on where the one before ended."""
    found = cut(frame_files(spark, sf_dir), "frames")  # a trigger reads all frames: files are opened and parsed once
    stream = stored.replay(found, 4).select("supplier", "step", "frame", "seq", "title", "price")
    table = new_folder(spark, "replayed")
    for _ in range(4):
        rows = jobs.drain(stream, "replayed", table)
    return rows


S1_REPLAYED = """WITH g AS (SELECT l_suppkey AS supplier, l_linenumber, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY l_linenumber) - 1 AS frame, CASE WHEN supplier % 4 = 3 THEN 0 ELSE count(*) OVER (PARTITION BY supplier) - 1 END AS last FROM g),
    l AS (SELECT supplier, step, frame, unnest(CASE WHEN supplier % 4 = 2 THEN [{'seq': 0, 'n': low}] ELSE [{'seq': 0, 'n': low}, {'seq': 1, 'n': high}] END) AS x FROM p, (SELECT unnest(range(4, 8)) AS step) WHERE frame = least(last, step))
    SELECT supplier, step, CAST(frame AS INTEGER) AS frame, x.seq, 'part ' || x.n AS title, x.n || '.50' AS price FROM l"""

PROFILE = "https://x.com/someone"


def s12_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as posts: some lines broken, some without id, address or text, from other hosts, had by other means."""
    path = new_folder(spark, "post-lines")
    n = F.col("conv_id") * 1000 + F.col("turn")
    url = F.when(n % 5 == 0, F.concat(F.lit("https://y.com/"), n)).when(n % 5 == 1, F.lit(None)).otherwise(F.concat(F.lit("https://mobile.twitter.com/a/"), n))
    url = F.when(n % 5 == 2, F.concat(F.lit("http://www.X.com/a/"), n)).otherwise(url)
    how = F.element_at(F.array(*map(F.lit, ("fixture", "rss", "public_html", "x_api"))), (n % 4 + 1).cast("int"))
    line = F.to_json(F.struct(F.when(n % 7 > 0, n.cast("string")).otherwise(" ").alias("id"), F.when(n % 11 > 0, F.lit("a text")).otherwise("  ").alias("text"), url.alias("url"), how.alias("author")))
    table(spark, sf_dir, "conversations").select(F.when(n % 13 == 0, F.concat(F.lit('{"id": "'), n)).otherwise(line).alias("value")).write.text(path)
    accepted, refused = stored.checked_posts(spark, path, PROFILE, F.col("author"))
    return accepted.select("id", "url", F.lit(None).cast("string").alias("reason")).unionByName(refused.where("reason <> 'malformed'").select("id", "url", "reason")).unionByName(
        refused.where("reason = 'malformed'").select(F.regexp_extract("line", "([0-9]+)", 1).alias("id"), F.lit(None).cast("string").alias("url"), "reason")
    )


S12 = """WITH n AS (SELECT conv_id * 1000 + turn AS n FROM conversations), p AS (SELECT n, CASE WHEN n % 7 > 0 THEN CAST(n AS VARCHAR) ELSE '' END AS id,
        CASE n % 5 WHEN 0 THEN 'https://y.com/' || n WHEN 1 THEN CASE WHEN n % 7 > 0 THEN 'https://x.com/someone/status/' || n END WHEN 2 THEN 'http://www.X.com/a/' || n ELSE 'https://mobile.twitter.com/a/' || n END AS url FROM n)
    SELECT CASE WHEN n % 13 = 0 THEN CAST(n AS VARCHAR) ELSE id END AS id, CASE WHEN n % 13 > 0 THEN url END AS url,
        CASE WHEN n % 13 = 0 THEN 'malformed' WHEN n % 4 = 2 THEN 'method_not_allowed' WHEN n % 7 = 0 THEN 'no_id' WHEN n % 5 IN (0, 3, 4) THEN 'wrong_host' WHEN n % 11 = 0 THEN 'no_text' END AS reason FROM p"""


def s8_nested_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of 50 pages each; a map names the maps of twice its number and one more, and itself, so all lead on from the first."""
    path = new_folder(spark, "maps")
    n = F.col("page_id")
    loc = lambda c: F.concat(F.lit("<loc> "), c, F.lit(" </loc>"))
    rows = table(spark, sf_dir, "pages").where("url is not null").select(F.floor(n / 50).alias("map"), F.concat(F.lit("<url>"), loc(F.replace("url", F.lit("&"), F.lit("&amp;"))), F.lit("</url>")).alias("entry"))
    further = F.concat(*[F.concat(F.lit("<sitemap>"), loc(F.concat(F.lit("map:"), x)), F.lit("</sitemap>\n")) for x in (F.col("map") * 2 + 1, F.col("map") * 2 + 2, F.col("map"))])
    maps = rows.groupBy("map").agg(F.array_join(F.collect_list("entry"), "\n").alias("body"))  # 50 entries
    text = F.concat(F.lit("<urlset>\n"), further, "body", F.lit("\n</urlset>"))
    maps.select(text.alias("value"), "map").repartition("map").write.partitionBy("map").option("maxRecordsPerFile", 1).text(path)
    entries = stored.sitemap_entries(spark, f"{path}/map=*")
    files = entries.select("file").distinct().select(F.concat(F.lit("map:"), F.regexp_extract("file", "map=([0-9]+)", 1)).alias("loc"), "file")
    roots = spark.createDataFrame([("first", "map:0"), ("second", "map:1"), ("none", "map:x")], "root string, loc string")
    return stored.sitemap_pages(entries, files, roots)


S8 = """WITH RECURSIVE p AS (SELECT page_id // 50 AS map, url FROM pages WHERE url IS NOT NULL), m(root, map) AS (SELECT * FROM (VALUES ('first', 0::BIGINT), ('second', 1::BIGINT))
        UNION SELECT root, x FROM (SELECT root, unnest([map * 2 + 1, map * 2 + 2]) AS x FROM m) WHERE x IN (SELECT map FROM p))
    SELECT DISTINCT root, url AS loc FROM m JOIN p USING (map)"""


def stored_operations(spark, sf_dir):
    path = new_folder(spark, "operations")
    operations(spark, sf_dir).withColumn("day", F.to_date("created_at").cast("string")).write.partitionBy("day").parquet(path)
    return path


def t1_newest_by_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_operations(spark, sf_dir)
    stored.keep_newest_rows(spark, path, "day", "seq", 5000)
    return spark.read.parquet(path).select("seq", "component", "status", "created_at")


T1 = f"WITH {OPS} SELECT seq, component, status, created_at FROM ops ORDER BY CAST(created_at AS DATE) DESC, seq DESC LIMIT 5000"


def t2_blanked_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_operations(spark, sf_dir)
    stored.blank_old_values(spark, path, "day", "error_class", "created_at", F.expr("timestamp_ntz'2024-01-10 12:00:00'"))
    return spark.read.parquet(path).select("seq", "created_at", "error_class")


T2 = f"WITH {OPS} SELECT seq, created_at, CASE WHEN created_at >= TIMESTAMP '2024-01-10 12:00:00' THEN error_class END AS error_class FROM ops"

QUERIES = {f.__name__: f for f in (s1_stored_frames, s1_replayed_frames, s12_quarantine, s8_nested_sitemaps, t1_newest_by_partitions, t2_blanked_partitions)}
ORACLE_SQL = {"s1_stored_frames": S1, "s1_replayed_frames": S1_REPLAYED, "s12_quarantine": S12, "s8_nested_sitemaps": S8, "t1_newest_by_partitions": T1, "t2_blanked_partitions": T2}
