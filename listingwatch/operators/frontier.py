"""Walks over a table of links, by levels and by priorities, and chains of merged products."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import cut, drop


def expand(seeds: DataFrame, links: DataFrame, most_depth: int) -> DataFrame:
    """(page_id, depth, method) of pages within most_depth links of a seed, each at its smallest depth.

    seeds: (page_id, method), links: (page_id, target, score). A link is followed if its score is 10 or more. Each level
    joins only the newest pages with their links, drops visited ones and is written down, so a lost executor repeats one
    level; the loop's length is most_depth, whatever the data.
    """
    start = seeds.groupBy("page_id").agg(F.min("method").alias("method")).select("page_id", F.lit(0).alias("depth"), "method")
    visited = newest = cut(start, "frontier")
    good = links.where("score >= 10").select("page_id", "target")
    for depth in range(1, most_depth + 1):
        found = newest.select("page_id").join(good, "page_id").select(F.col("target").alias("page_id")).distinct()
        found = found.join(visited.select("page_id"), "page_id", "left_anti").select("page_id", F.lit(depth).alias("depth"), F.lit("link").alias("method"))
        newest = cut(found, "frontier")
        if newest.isEmpty():
            break
        visited = visited.unionByName(newest)
    return visited


def priorities(found: DataFrame) -> DataFrame:
    """Priority of a page to visit by its score and how it was found: sitemap pages start higher and end lower."""
    from_map = F.least(F.lit(95), 45 + F.col("score"))
    return found.withColumn("priority", F.when(F.col("method") == "sitemap", from_map).otherwise(F.least(F.lit(100), 35 + F.col("score"))))


def merge_targets(merges: DataFrame) -> DataFrame:
    """(source, target) of product merges with chains resolved to their ends, by pointer doubling.

    merges: (source, target), one row a source, without cycles (a merged product is gone, so it can't be a target later).
    The number of rounds is the logarithm of the longest chain.
    """
    now = cut(merges.where("source <> target").select("source", "target"), "merges")
    while True:
        ahead = now.select(F.col("source").alias("target"), F.col("target").alias("further"))
        then = cut(now.join(ahead, "target", "left").select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")), "merges")
        now = then.select("source", "target")
        if then.where("moved").isEmpty():
            return now


def merge_products(products: DataFrame, merges: DataFrame, columns: list[str]) -> DataFrame:
    """Products after merges: a target fills its empty columns from its sources, lowest product_id first."""
    placed = products.join(merge_targets(merges).withColumnRenamed("source", "product_id"), "product_id", "left")
    order = F.struct(F.col("target").isNotNull(), F.col("product_id"))
    best = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    rows = placed.withColumn("kept_id", F.coalesce("target", "product_id"))
    return rows.groupBy("kept_id").agg(*map(best, columns), F.count("*").alias("merged")).withColumnRenamed("kept_id", "product_id")


def merge_audit(products: DataFrame, merges: DataFrame, columns: list[str]) -> DataFrame:
    """One audit row a merged product: its target, its fields as they were, and the target's before and after."""
    targets = merge_targets(merges).withColumnRenamed("target", "target_id")
    was = products.select(F.col("product_id").alias("source"), F.struct(*columns).alias("source_before"))
    had = products.select(F.col("product_id").alias("target_id"), F.struct(*columns).alias("target_before"))
    has = merge_products(products, merges, columns).select(F.col("product_id").alias("target_id"), F.struct(*columns).alias("target_after"))
    return targets.join(was, "source").join(had, "target_id", "left").join(has, "target_id").select(F.lit("merge").alias("action"), "source", "target_id", "source_before", "target_before", "target_after")


def walk(seeds: DataFrame, links: DataFrame, sitemaps: DataFrame, most_depth: int) -> DataFrame:
    """(page_id, depth, method, priority) of a walk that also reads sitemaps: each page as it was first found, and best.

    seeds: (page_id), links: (page_id, target, score), sitemaps: (page_id, score) of the pages that sitemaps name. A sitemap's
    page counts if its score is 20 or more, at depth 1 as if a seed linked to it. A page found in more than one way at its
    smallest depth takes the highest priority, and its method. Seeds have priority 100. Links of 10 or more are followed.
    """
    best = lambda rows: rows.groupBy("page_id").agg(F.max_by("method", F.struct("priority", "method")).alias("method"), F.max("priority").cast("int").alias("priority"))
    start = seeds.select("page_id").distinct().withColumns({"depth": F.lit(0), "method": F.lit("seed"), "priority": F.lit(100)})
    visited = newest = cut(start, "walk")
    good = links.where("score >= 10").groupBy("page_id", "target").agg(F.max("score").alias("score"))
    for depth in range(1, most_depth + 1):
        found = newest.select("page_id").join(good, "page_id").select(F.col("target").alias("page_id"), "score", F.lit("link").alias("method"))
        if depth == 1:
            found = found.unionByName(sitemaps.where("score >= 20").select("page_id", "score", F.lit("sitemap").alias("method")))
        fresh = best(priorities(found)).join(visited.select("page_id"), "page_id", "left_anti")
        newest = cut(fresh.select("page_id", F.lit(depth).alias("depth"), "method", "priority"), "walk")
        if newest.isEmpty():
            break
        visited = visited.unionByName(newest)
    return visited


ITEM = "url string, kind string, priority int, depth int, seq long"
#: How many of a walk's best pending items are looked up at a time.
WINDOW = 16
# Priorities of a walk's first items, and when a recipe that finds nothing is given up.
ROBOTS, ROBOTS_MAP, MAP, FURTHER_MAP, SEED = 120, 115, 110, 105, 100
FRUITLESS_PAGES = 10
REFUSED = (401, 403, 429)
TOTALS = "pages int, bytes long, seconds double, next_seq long, candidates int, stop_reason string"
STEP = f"walk_id long, what string, {ITEM}, status string, place int, found_on string, {TOTALS}"


def first_items(walks: DataFrame) -> DataFrame:
    """Each walk's first frontier: robots file, sitemap and seed, in that order."""
    kinds = (("robots", "robots_url", ROBOTS), ("sitemap", "sitemap_url", MAP), ("page", "seed", SEED))
    items = F.array(*[F.struct(F.col(c).alias("url"), F.lit(kind).alias("kind"), F.lit(p).alias("priority"), F.lit(0).alias("depth"), F.lit(i).cast("long").alias("seq")) for i, (kind, c, p) in enumerate(kinds)])
    given = F.filter(items, lambda x: x["url"].isNotNull())
    return walks.select("walk_id", F.inline(given)).dropDuplicates(["walk_id", "url"])


def take_steps(walk: dict, items: list[dict], pages: dict[str, dict], links: dict[str, list[dict]], complete: bool) -> tuple[list[dict], dict]:
    """A walk's next steps in exact order, as far as `items`, its best pending ones, lead.

    Returns changed and new items, and the walk's totals. complete: whether `items` are all that is pending; if not, nothing
    that ranks behind the last of them can be taken, nor anything found on the way before it has been looked up.
    """
    looked_up = {i["url"] for i in items}
    queue = [(-i["priority"], i["seq"], i["url"], i) for i in items]
    heapq.heapify(queue)
    floor = max(queue)[:2] if queue and not complete else None
    pages_read, size, seconds, seq, candidates, stop = (walk[c] for c in ("pages", "bytes", "seconds", "next_seq", "candidates", "stop_reason"))
    changed, known = {}, set(looked_up)
    while stop is None:
        if pages_read >= walk["max_pages"]:
            stop = "page_budget"
        elif size >= walk["max_bytes"]:
            stop = "byte_budget"
        elif seconds >= walk["max_seconds"]:
            stop = "time_budget"
        if stop or not queue or (floor is not None and queue[0][:2] > floor) or queue[0][2] not in looked_up:
            break
        item = heapq.heappop(queue)[3]
        page = pages.get(item["url"])
        changed[item["url"]] = item
        if item["depth"] > walk["max_depth"] or (page is not None and item["kind"] == "page" and not page["allowed"]):
            item["status"] = "skipped"
            continue
        seconds += max(walk["min_interval"], page["seconds"] if page else 0.0)
        if page is None or page["status"] >= 400:
            item["status"] = "failed"
            if page is not None and page["status"] in REFUSED:
                stop = "refused"
            continue
        pages_read, size = pages_read + 1, size + page["bytes"]
        item["status"], item["place"] = "visited", pages_read
        candidates += bool(page["candidate"]) and item["kind"] == "page"
        if item["kind"] != "page" or item["depth"] < walk["max_depth"]:
            for link in links.get(item["url"], ()):
                if link["target"] in known:
                    continue
                known.add(link["target"])
                # a robots file's maps are as deep as itself, a map's maps too; a map's pages are one link from the site
                depth = item["depth"] if link["kind"] == "sitemap" else 1 if item["kind"] == "sitemap" else item["depth"] + 1
                found = {"url": link["target"], "kind": link["kind"], "priority": link["priority"], "depth": depth, "seq": seq, "status": "pending", "place": None, "found_on": item["url"]}
                seq += 1
                changed[found["url"]] = found
                heapq.heappush(queue, (-found["priority"], found["seq"], found["url"], found))
        if item["kind"] == "page" and walk["active_recipe"] and pages_read >= FRUITLESS_PAGES and candidates == 0:
            stop = "fruitless_recipe"
    # a walk whose queue is empty has ended; so has one that is stopped
    ended = stop or ("" if complete and not queue else None)
    return list(changed.values()), {"pages": pages_read, "bytes": size, "seconds": seconds, "next_seq": seq, "candidates": candidates, "stop_reason": ended}


def best_first(walks: DataFrame, pages: DataFrame, links: DataFrame, window: int = WINDOW, most_rounds: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Walks over pages by one queue of priorities each: (frontier, summary).

    walks: (walk_id, seed, robots_url, sitemap_url, max_pages, max_depth, max_bytes, max_seconds, min_interval, active_recipe).
    pages: (url, status, bytes, seconds, allowed, candidate), what fetching a url gives; a url without a row fails. links:
    (url, nth, target, kind, priority), what a page, map (`sitemap`) or robots file leads to, in order.

    A walk takes its pending item of highest priority, of those the one found first, until none is left or a budget of pages,
    bytes or seconds is used up, a site refuses (401, 403, 429), or an active recipe has found no candidate on ten pages. Items
    beyond the depth or forbidden by robots are skipped, failed ones cost time only; a url is queued once a walk.

    All walks go on side by side. In a round the best `window` pending items of each walk are looked up by joins on the url,
    and each walk takes the steps that these decide; a step that depends on anything else waits for the next round, so the
    order is exact. A task holds one walk's window and its links, never a frontier. Rounds are written down.

    frontier: (walk_id, url, kind, priority, depth, seq, status, place, found_on), place being the number of the visit.
    summary: (walk_id, pages, bytes, seconds, candidates, pending, stop_reason, status, recipe).
    """
    pages, links = cut(pages, "walk-pages"), cut(links, "walk-links")  # every round reads them
    limits = ["max_pages", "max_depth", "max_bytes", "max_seconds", "min_interval", "active_recipe"]
    frontier = cut(first_items(walks).select("walk_id", "url", "kind", "priority", "depth", "seq", F.lit("pending").alias("status"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("found_on")), "walk-frontier")
    begun = [F.lit(0).alias("pages"), F.lit(0).cast("long").alias("bytes"), F.lit(0.0).alias("seconds"), F.lit(3).cast("long").alias("next_seq"), F.lit(0).alias("candidates"), F.lit(None).cast("string").alias("stop_reason")]
    totals = cut(walks.select("walk_id", *[F.col(c) for c in limits], *begun), "walk-totals")
    best = Window.partitionBy("walk_id").orderBy(F.desc("priority"), "seq")
    total_columns = [c.split()[0] for c in TOTALS.split(", ")]

    shape = to_arrow_schema(T.StructType.fromDDL(STEP))

    def steps(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        walk = {c: rows[0][c] for c in ("walk_id", *limits, *total_columns)}
        queued = [r for r in rows if r["url"] is not None]
        items = [{c: r[c] for c in ("url", "kind", "priority", "depth", "seq", "found_on")} | {"status": "pending", "place": None} for r in queued]
        found = {r["url"]: {"status": r["fetched"], "bytes": r["size"], "seconds": r["took"], "allowed": r["allowed"], "candidate": r["candidate"]} for r in queued if r["fetched"] is not None}
        follow = {}
        for r in sorted(right.to_pylist(), key=lambda r: (r["nth"], r["target"])):
            follow.setdefault(r["found_on"], []).append(r)
        changed, now = take_steps(walk, items, found, follow, rows[0]["whole"])
        out = [{"walk_id": walk["walk_id"], "what": "item", **x} for x in changed] + [{"walk_id": walk["walk_id"], "what": "totals", **now}]
        return pa.Table.from_pylist(out, schema=shape)

    fetched = pages.select("url", F.col("status").alias("fetched"), F.col("bytes").alias("size"), F.col("seconds").alias("took"), "allowed", "candidate")
    for _ in range(most_rounds):
        going = totals.where("stop_reason is null")
        if going.isEmpty():
            break
        waiting = frontier.where("status = 'pending'").join(going.select("walk_id"), "walk_id", "left_semi").withColumns({"nth_best": F.row_number().over(best)})
        top = waiting.where(F.col("nth_best") <= window + 1)
        more = F.max("nth_best").over(Window.partitionBy("walk_id")) <= window
        top = cut(top.withColumn("whole", more).where(F.col("nth_best") <= window).drop("nth_best", "status", "place"), "walk-window")
        asked = going.join(top.join(fetched, "url", "left"), "walk_id", "left").withColumn("whole", F.coalesce("whole", F.lit(True)))
        # what a walk has queued before is not found again
        new = top.select("walk_id", "url").join(links, "url").join(frontier.select("walk_id", F.col("url").alias("target")), ["walk_id", "target"], "left_anti")
        new = new.select("walk_id", "url", "nth", "target", "kind", "priority").toDF("of_walk", "found_on", "nth", "target", "kind", "priority")
        made = cut(asked.groupBy("walk_id").cogroup(new.groupBy("of_walk")).applyInArrow(steps, STEP), "walk-steps")
        changed = made.where("what = 'item'").select(*frontier.columns)
        after = frontier.join(changed.select("walk_id", "url"), ["walk_id", "url"], "left_anti").select(*frontier.columns).unionByName(changed)
        renewed = made.where("what = 'totals'").select("walk_id", *total_columns)
        totals_after = totals.join(renewed.select("walk_id"), "walk_id", "left_anti").unionByName(totals.drop(*total_columns).join(renewed, "walk_id").select(*totals.columns))
        frontier, totals, gone = cut(after, "walk-frontier"), cut(totals_after, "walk-totals"), (frontier, totals, top, made)
        for table in gone:
            drop(table)
    pending = frontier.groupBy("walk_id").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    reason = F.nullif("stop_reason", F.lit(""))
    summary = totals.join(pending, "walk_id").select("walk_id", "pages", "bytes", "seconds", "candidates", "pending", reason.alias("stop_reason"))
    status = F.when(F.col("stop_reason").endswith("budget"), "budget_exhausted").when(F.col("stop_reason").isNotNull(), "stopped").otherwise("success")
    return frontier, summary.withColumns({"status": status, "recipe": F.when(F.col("candidates") > 0, "active").otherwise("needs_review")})
