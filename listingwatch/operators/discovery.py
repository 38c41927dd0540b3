"""Candidates that a walk over pages finds, their queue, and what a walk came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import newest, upsert

LEAST_CONFIDENCE = 0.45
# Pages a walk may visit, and bytes it may read.
MOST_PAGES = 100
MOST_BYTES = 50 * 1024 * 1024
QUEUE_ORDER = ("pending", "deferred")


def save_candidates(known: DataFrame, found: DataFrame) -> DataFrame:
    """The table of candidates after a walk, one row a (site, url).

    found: (site, url, seq, title, model, confidence, excluded_reason, method); rows without a title or below 0.45 are no
    candidates. A page found twice counts as last found. New candidates are pending, or excluded if they have a reason;
    of known ones everything but the status and the first sighting is renewed, so that a decision outlives later walks.
    known: (site, url, title, model, confidence, method, status, first_seen, last_seen).
    """
    good = found.where((F.trim("title") != "") & (F.col("confidence") >= LEAST_CONFIDENCE))
    status = F.when(F.col("excluded_reason").isNotNull(), "excluded").otherwise("pending")
    row = F.struct("title", "model", "confidence", "method", status.alias("status"))
    batch = good.groupBy("site", "url").agg(F.max_by(row, "seq").alias("row"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen")).select("site", "url", "row.*", "first_seen", "last_seen")
    rules = {"title": "overwrite", "model": "overwrite", "confidence": "overwrite", "method": "overwrite", "status": "keep_old", "first_seen": "keep_old", "last_seen": "overwrite"}
    return upsert(known, batch, ["site", "url"], rules)


def candidate_queue(candidates: DataFrame, n: int = 200) -> DataFrame:
    """The first n candidates to review: pending, deferred, others; the surest first, then by site and url."""
    place = F.when(F.col("status") == QUEUE_ORDER[0], 0).when(F.col("status") == QUEUE_ORDER[1], 1).otherwise(2)
    return newest(candidates, n, place, F.desc("confidence"), F.col("site"), F.col("url"))


def method_of(found_on: Column) -> Column:
    """seed without a page it was found on; sitemap if that page is one; else link."""
    return F.when(found_on.isNull(), "seed").when(found_on.rlike(r"(?i)sitemap|\.xml($|\?)"), "sitemap").otherwise("link")


def run_summaries(frontier: DataFrame, candidates: DataFrame, most_pages: int = MOST_PAGES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What each walk came to: pages, bytes, candidates, pages left, why it stopped, and whether its recipe needs review.

    frontier: (run_id, status, bytes), candidates: (run_id, site, url). Both are aggregated before they meet.
    """
    visited = F.col("status") == "visited"
    pages = frontier.groupBy("run_id").agg(
        F.count_if(visited).alias("pages"), F.coalesce(F.sum(F.when(visited, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    found = candidates.select("run_id", "site", "url").distinct().groupBy("run_id").agg(F.count("*").alias("candidates"))
    reason = F.when(F.col("pages") >= most_pages, "page_budget").when(F.col("bytes") >= most_bytes, "byte_budget")
    out = pages.join(found, "run_id", "left").withColumns({"candidates": F.coalesce("candidates", F.lit(0)), "stop_reason": reason})
    return out.withColumns({
        "status": F.when(F.col("stop_reason").isNotNull(), "budget_exhausted").otherwise("success"),
        "recipe": F.when(F.col("candidates") > 0, "active").otherwise("needs_review"),
    })


def site_overview(sites: DataFrame, candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Sites with their pending and total candidates and their last walk's status. runs: (site, run_id, status)."""
    counts = candidates.groupBy("site").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("total"))
    last = runs.groupBy("site").agg(F.max_by("status", "run_id").alias("last_status"))
    joined = sites.join(counts, "site", "left").join(last, "site", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pending", "total")})
