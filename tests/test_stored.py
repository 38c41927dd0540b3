"""Stored frames, posts and sitemaps in their shapes, and retention that leaves files alone."""

import os

from pyspark.sql import functions as F

from listingwatch.sources import stored
from listingwatch.streaming import jobs


def written(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    return str(folder)


def test_frames_of_all_shapes(spark, tmp_path):
    path = written(
        tmp_path / "f", a='{"frames": [[{"title": "x", "price": 5}], [], [{"title": "y", "hasBuyButton": true}, {"title": null}]]}', b='[{"title": "one"}, [{"title": "two"}, {"title": "three", "price": "3.5"}]]',
        c='{"listings": [{"title": "l", "priceText": "NT$ 5", "raw_text": "r"}]}', d="not json", e="[]", f='{"other": 1}', g="",
    )
    found = stored.frames(spark, path).withColumn("f", F.substring_index("file", "/", -1))
    rows = {(r["f"], r["frame"], r["seq"]): r for r in found.collect()}
    assert {k: v["title"] for k, v in rows.items()} == {("a", 0, 0): "x", ("a", 2, 0): "y", ("a", 2, 1): None, ("b", 0, 0): "one", ("b", 1, 0): "two", ("b", 1, 1): "three", ("c", 0, 0): "l"}
    assert rows["a", 0, 0]["price"] == "5" and rows["a", 2, 0]["has_buy_button"] and rows["c", 0, 0]["price_text"] == "NT$ 5" and rows["c", 0, 0]["raw_text"] == "r"
    titles = lambda n: {(r["f"], r["title"]) for r in stored.at_frame(found, F.lit(n)).collect()}
    assert titles(-3) == titles(None) == {("a", "x"), ("b", "one"), ("c", "l")}
    assert titles(99) == {("a", "y"), ("a", None), ("b", "two"), ("b", "three"), ("c", "l")}


def test_an_empty_frame_counts(spark, tmp_path):
    found = stored.frames(spark, written(tmp_path / "f", a='[[{"title": "x"}], [{"title": "y"}], []]', b='{"listings": []}'))
    at = lambda n: [r["title"] for r in stored.at_frame(found, F.lit(n)).collect()]
    assert (at(0), at(1), at(2), at(9)) == (["x"], ["y"], [], [])


def test_replay_goes_on_by_a_frame_a_run(spark, tmp_path):
    path = written(tmp_path / "f", a='[[{"title": "x"}, {"title": "x2"}], [], [{"title": "y"}]]', b='{"listings": [{"title": "l"}]}', c="not json")
    stream = stored.replay(stored.frames(spark, path)).select("step", "frame", "title")
    table, seen = f"file://{tmp_path}/replayed", []
    for _ in range(4):
        seen.append(sorted(tuple(r) for r in jobs.drain(stream, "replayed", table).collect()))
    new = [sorted(set(b) - set(a)) for a, b in zip([[], *seen], seen)]
    assert new == [[(0, 0, "l"), (0, 0, "x"), (0, 0, "x2")], [(1, 0, "l")], [(2, 0, "l"), (2, 2, "y")], [(3, 0, "l"), (3, 2, "y")]]


def test_every_refused_post_has_its_reason(spark, tmp_path):
    lines = {
        '{"id": "1", "text": "t", "url": "https://x.com/a/1"}': None, '{"id": " 2 ", "text": "t"}': None, '{"id": "3", "text": "t", "url": "http://mobile.twitter.com/3"}': "wrong_host", '{"id": "4", "text": "t", "url": "https://www.x.com/4"}': None,
        '{"id": "", "text": "t"}': "no_id", '{"text": "t", "url": "https://x.com/5"}': "no_id", '{"id": "6", "text": "  "}': "no_text", '{"id": "7"}': "no_text", '{"id": "8", "text"': "malformed", "[]": "malformed", "text": "malformed",
        '{"id": "9", "text": "t", "url": "https://xx.com/9"}': "wrong_host", '{"id": "10", "text": "t", "url": "no address"}': "wrong_host", '{"id": "11", "text": "t", "lang": "html"}': "method_not_allowed",
    }
    path = written(tmp_path / "p", a="\n".join(lines) + "\n\n")
    accepted, refused = stored.checked_posts(spark, path, "https://x.com/me", F.when(F.col("lang") == "html", "public_html").otherwise("rss"))
    assert {r["id"]: r["url"] for r in accepted.collect()} == {"1": "https://x.com/a/1", "2": "https://x.com/me/status/2", "4": "https://www.x.com/4"}
    assert {r["line"]: r["reason"] for r in refused.collect()} == {k: v for k, v in lines.items() if v}


def test_maps_that_name_each_other_end(spark, tmp_path):
    entry = lambda kind, loc: f"<{kind}><loc>\n {loc} </loc><lastmod>2024</lastmod></{kind}>"
    path = written(
        tmp_path / "m", a=f"<sitemapindex>{entry('sitemap', 'B')}{entry('sitemap', 'C')}{entry('sitemap', 'gone')}</sitemapindex>", b=f"<urlset>{entry('url', 'p1')}{entry('url', 'p2')}{entry('sitemap', 'A')}</urlset>",
        c=f"<urlset>{entry('url', 'p2')}{entry('url', 'p3&amp;x')}{entry('sitemap', 'C')}</urlset>",
    )
    entries = stored.sitemap_entries(spark, path)
    files = entries.select("file").distinct().select(F.upper(F.substring_index("file", "/", -1)).alias("loc"), "file")
    roots = spark.createDataFrame([("r", "A"), ("s", "C"), ("t", "none")], "root string, loc string")
    got = sorted((r["root"], r["loc"]) for r in stored.sitemap_pages(entries, files, roots).collect())
    assert got == [("r", "p1"), ("r", "p2"), ("r", "p3&x"), ("s", "p2"), ("s", "p3&x")]


def files_of(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def test_retention_leaves_untouched_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").alias("seq"), F.concat(F.lit("2024-01-0"), (F.col("id") / 20).cast("int") + 1).alias("day"), F.lit("x").alias("raw"))
    rows.write.partitionBy("day").parquet(path)
    before = files_of(path)
    assert stored.blank_old_values(spark, path, "day", "raw", "seq", F.lit(30)) == 30
    after = files_of(path)
    assert [d for d in before if before[d] != after[d]] and {d for d in before if before[d] != after[d]} == {"day=2024-01-01", "day=2024-01-02"}
    assert spark.read.parquet(path).where("raw is null").count() == 30 and spark.read.parquet(path).count() == 100
    assert stored.blank_old_values(spark, path, "day", "raw", "seq", F.lit(30)) == 0 and files_of(path) == after
    assert stored.keep_newest_rows(spark, path, "day", "seq", 50) == 50
    last = files_of(path)
    assert set(last) == {"day=2024-01-03", "day=2024-01-04", "day=2024-01-05"} and all(last[d] == after[d] for d in ("day=2024-01-04", "day=2024-01-05"))
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == list(range(50, 100))
    assert stored.keep_newest_rows(spark, path, "day", "seq", 500) == 0 and files_of(path) == last
    assert stored.keep_newest_rows(spark, path, "day", "seq", 40) == 10 and set(files_of(path)) == {"day=2024-01-04", "day=2024-01-05"}
