"""Registered queries: walks by priority, path rules, addresses and hints, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import frontier, pages
from .views import table

PATH_RULES = "\n".join(
    (
        "User-agent: *", "Crawl-delay: 3", "Disallow: /en/1*", "Allow: /en/1", "Disallow: /*.html$", "Allow: /de/*.html$", "Disallow: /fr/3$", "Disallow: /fr/*?page=*ref",
        "Disallow: /es/", "Allow: /es/*$", "Sitemap: https://maps.example.org/one.xml", "User-agent: someone", "Disallow: /", "sitemap:/two.xml # relative", "Sitemap:",
    )
)


def robots_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(urls.bare_host(F.col("url")).alias("host")).distinct().withColumn("body", F.lit(PATH_RULES))


def d1_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.robots_allowed(found, pages.robots_rules(robots_files(spark, sf_dir), "watcher")).select("page_id", "allowed")


D1 = r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages),
    r(allow, fits, size) AS (VALUES (false, '^/en/1', 5), (true, '^/en/1', 5), (false, '^/.*[.]html$', 6), (true, '^/de/.*[.]html$', 9), (false, '^/fr/3$', 5), (false, '^/fr/.*[?]page=.*ref', 14), (false, '^/es/', 4), (true, '^/es/.*$', 4))
    SELECT page_id, coalesce(arg_max(allow, size * 2 + allow::INT), true) AS allowed FROM p LEFT JOIN r ON regexp_matches(path, fits) GROUP BY page_id"""


def d1_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.robots_sitemaps(robots_files(spark, sf_dir))


D1_MAPS = r"""SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':[0-9]+$', '') AS host, unnest(['https://maps.example.org/one.xml', '/two.xml']) AS sitemap FROM pages"""


def n11_public_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as a host: a number for each of its columns, in six spellings."""
    line = table(spark, sf_dir, "lineitem")
    a, b, c, d = (F.col(x) % 256 for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    numbers = F.concat_ws(".", a, b, c, d)
    host = (
        F.when(kind == 0, numbers).when(kind == 1, F.concat_ws(".", a, F.lit("example.com"))).when(kind == 2, F.concat(F.lit("fc"), a, F.lit("club.com")))
        .when(kind == 3, F.concat(F.lit("["), F.lower(F.hex(64000 + a * 4)), F.lit("::"), F.lower(F.hex(b)), F.lit("]"))).when(kind == 4, F.concat(numbers, F.lit("."))).otherwise(F.concat(F.lit("fd"), b, F.lit(".Local")))
    )
    return line.select("l_orderkey", "l_linenumber", host.alias("host")).withColumn("public", urls.is_public(F.col("host")))


N11 = r"""WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 256 AS a, l_partkey % 256 AS b, l_suppkey % 256 AS c, l_linenumber % 256 AS d, (l_orderkey + l_linenumber) % 6 AS kind FROM lineitem),
    j AS (SELECT *, a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224 AS inner_net FROM l)
    SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN concat_ws('.', a, b, c, d) WHEN 1 THEN a || '.example.com' WHEN 2 THEN 'fc' || a || 'club.com' WHEN 3 THEN '[' || lower(to_hex(64000 + a * 4)) || '::' || lower(to_hex(b)) || ']'
        WHEN 4 THEN concat_ws('.', a, b, c, d) || '.' ELSE 'fd' || b || '.Local' END AS host,
        CASE WHEN kind IN (0, 4) THEN NOT inner_net WHEN kind = 3 THEN NOT (64000 + a * 4 BETWEEN 64512 AND 65023) WHEN kind = 5 THEN false ELSE true END AS public FROM j"""


def d2_decoded_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path names a product in another script, percent-encoded; some not well encoded."""
    word = F.element_at(F.array(*map(F.lit, ("/%E3%83%99%E3%82%A4/x", "/%e6%88%b0%E9%AC%A5?q=1", "/%E3%83", "/a+b%2Bc"))), (F.col("page_id") % 4 + 1).cast("int"))
    args = (F.concat(F.regexp_replace("url", "[?#].*$", ""), word), F.lit(None).cast("string"), "ベイ|戰鬥", r"\b[a-z]\+[a-z]\b")
    return table(spark, sf_dir, "pages").select("page_id", urls.hint_score(*args).cast("long").alias("score"))


D2 = r"""SELECT page_id, [45, 45, 0, 45][1 + page_id % 4] + CASE WHEN regexp_matches(path, '/g/g|/product|/item|/goods|/p/') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(path, 'category|collection|search|catalog|c/c') THEN 10 ELSE 0 END
    - CASE WHEN regexp_matches(path, 'login|signin|account|cart|checkout|privacy|terms|contact') THEN 100 ELSE 0 END AS score FROM (SELECT page_id, lower(url_decode(regexp_extract(url, '://[^/?#]*([^?#]*)', 1))) AS path FROM pages)"""


def walk_tables(spark, sf_dir):
    """Suppliers walk over parts: a line of an order leads to the line of its number in the next order, by quantity. A supplier's
    map names its parts, its robots file further maps; some parts fail, one in many refuses."""
    line = table(spark, sf_dir, "lineitem")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    part_url = lambda c: F.concat(F.lit("p"), c)
    key = F.col("s_suppkey")
    seeds = line.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_partkey").alias("seed"))
    walks = supplier.join(seeds, "s_suppkey").select(
        key.alias("walk_id"), part_url("seed").alias("seed"), F.concat(F.lit("r"), key).alias("robots_url"), F.concat(F.lit("m"), key).alias("sitemap_url"), (key % 19 + 6).cast("int").alias("max_pages"), (key % 3 + 1).cast("int").alias("max_depth"),
        (key % 7 * 9_000 + 15_000).alias("max_bytes"), (key % 11 * 3 + 8.0).cast("double").alias("max_seconds"), F.lit(1.0).alias("min_interval"), (key % 5 == 0).alias("active_recipe"),
    )
    n = F.col("p_partkey")
    fetched = part.select(
        part_url("p_partkey").alias("url"), F.when(n % 13 == 0, 404).when(n % 97 == 0, 403).otherwise(200).alias("status"), (F.col("p_size") * 200).cast("long").alias("bytes"), (n % 4).cast("double").alias("seconds"), (n % 17 != 0).alias("allowed"), (n % 6 == 0).alias("candidate")
    )
    of_site = lambda letter, size: supplier.select(F.concat(F.lit(letter), key).alias("url"), F.lit(200).alias("status"), F.lit(size).cast("long").alias("bytes"), F.lit(0.5).alias("seconds"), F.lit(True).alias("allowed"), F.lit(False).alias("candidate"))
    fetched = fetched.unionByName(of_site("r", 100)).unionByName(of_site("m", 900)).unionByName(of_site("n", 700))
    there = line.select((F.col("l_orderkey") - 1).alias("l_orderkey"), "l_linenumber", F.col("l_partkey").alias("to"))
    along = line.join(there, ["l_orderkey", "l_linenumber"]).groupBy(part_url("l_partkey").alias("url"), part_url("to").alias("target")).agg(F.min("l_orderkey").alias("nth"), F.max(F.col("l_quantity").cast("int")).alias("score"))
    along = along.where("score >= 10").select("url", "nth", "target", F.lit("page").alias("kind"), F.least(F.lit(100), 35 + F.col("score")).cast("int").alias("priority"))
    named = line.groupBy("l_suppkey", "l_partkey").agg(F.max(F.col("l_quantity").cast("int")).alias("score")).where("score >= 20")
    mapped = named.select(F.concat(F.lit("m"), "l_suppkey").alias("url"), F.col("l_partkey").alias("nth"), part_url("l_partkey").alias("target"), F.lit("page").alias("kind"), F.least(F.lit(95), 45 + F.col("score")).cast("int").alias("priority"))
    site = lambda letter, to, priority: supplier.select(F.concat(F.lit(letter), key).alias("url"), F.lit(0).cast("long").alias("nth"), F.concat(F.lit(to), key).alias("target"), F.lit("sitemap").alias("kind"), F.lit(priority).alias("priority"))
    further = mapped.where("target is not null and priority % 2 = 0").withColumn("url", F.concat(F.lit("n"), F.substring("url", 2, 20)))
    links = along.unionByName(mapped).unionByName(further).unionByName(site("r", "n", frontier.ROBOTS_MAP)).unionByName(site("m", "n", frontier.FURTHER_MAP))
    return walks, fetched, links


def d4_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.best_first(*walk_tables(spark, sf_dir))[0].select("walk_id", "url", "kind", "priority", "depth", "status", "place", "found_on")


def d9_walk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.best_first(*walk_tables(spark, sf_dir))[1]


QUERIES = {f.__name__: f for f in (d1_path_rules, d1_sitemaps, n11_public_hosts, d2_decoded_hints, d4_best_first, d9_walk_summaries)}
ORACLE_SQL = {"d1_path_rules": D1, "d1_sitemaps": D1_MAPS, "n11_public_hosts": N11, "d2_decoded_hints": D2}
