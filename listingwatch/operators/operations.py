"""Scans and sources in operation: outcomes, plans of the next visit, health figures, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ERROR_CLASSES, error_class


def parser_outcomes(scans: DataFrame) -> DataFrame:
    """status and error_class of each scan. scans: (source_id, scan_id, pages, parsed, valid, invalid, bad_pages, maintenance).

    `valid` counts excluded listings too. A scan of nothing is skipped; one without a valid listing failed.
    """
    nothing = (F.col("parsed") == 0) & (F.col("valid") == 0) & (F.coalesce("pages", F.lit(0)) == 0) & (F.col("bad_pages") == 0)
    only_maintenance = (F.col("maintenance") > 0) & (F.col("pages") == F.col("bad_pages"))
    status = F.when(nothing, "skipped").when(F.col("valid") == 0, "failed").otherwise("success")
    partly = (F.col("invalid") > 0) | (F.col("bad_pages") > 0)
    error = F.when(nothing, "no_url").when(F.col("valid") == 0, F.when(only_maintenance, "maintenance").otherwise("parse")).when(partly, "partial")
    return scans.withColumns({"status": status, "error_class": error})


def run_accounts(items: DataFrame, runs: DataFrame | None = None, restarted: Column | None = None) -> DataFrame:
    """Per scan: listings seen, excluded, with events; with runs also status, finished_at and error.

    items: (source_id, scan_id, excluded, n_events), runs: (source_id, scan_id, status, finished_at, error). A run that was still
    running when the service came up again (`restarted`) was abandoned: it failed then, as `interrupted`. Errors keep 500 characters.
    """
    counts = items.groupBy("source_id", "scan_id").agg(F.count("*").alias("seen"), F.count_if("excluded").alias("excluded"), F.sum("n_events").alias("events"))
    if runs is None:
        return counts
    abandoned = (F.col("status") == "running") & F.col("finished_at").isNull() & F.lit(restarted is not None)
    at = F.lit(None) if restarted is None else restarted
    accounts = runs.select(
        "source_id", "scan_id", F.when(abandoned, "failed").otherwise(F.col("status")).alias("status"), F.when(abandoned, at).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(abandoned, "interrupted").otherwise(F.substring("error", 1, 500)).alias("error"),
    )
    return accounts.join(counts, ["source_id", "scan_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("seen", "excluded", "events")})


def jitter(key: Column, ratio: float) -> Column:
    """A reproducible factor within 1 - ratio and 1 + ratio: the key's hash in place of a random number."""
    return 1 + ratio * (F.pmod(F.xxhash64(key), F.lit(2001)) - 1000) / 1000


def recrawl_plan(sources: DataFrame, offers: DataFrame, now: Column, ratio: float = 0.0) -> DataFrame:
    """Seconds until each source's next visit.

    sources: (source_id, base_seconds, failures), offers: (source_id, watched, buyable, released). Watched offers pull the
    interval down to 300 s, buyable ones and releases from a day ago to a week ahead to 900 s; bounds are 300 s (or less, if
    the base is) and a day (or more); failures back off from 60 s, doubling, to six hours.
    """
    near = F.col("released").between(now - F.expr("interval 1 day"), now + F.expr("interval 7 days"))
    pulls = offers.groupBy("source_id").agg(F.bool_or("watched").alias("watched"), F.bool_or("buyable").alias("buyable"), F.bool_or(near).alias("near"))
    base = F.greatest(F.lit(60), F.col("base_seconds"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    soon = F.least(base, F.when(yes("watched"), 300), F.when(yes("buyable") | yes("near"), 900))
    bounded = F.least(F.greatest(soon, F.least(base, F.lit(300))), F.greatest(base, F.lit(86400)))
    backoff = F.least(F.lit(21600), F.expr("60 * shiftleft(1, least(failures - 1, 20))"))
    seconds = F.when(F.col("failures") > 0, F.greatest(bounded, backoff)).otherwise(bounded)
    planned = F.greatest(F.lit(30.0), seconds * jitter(F.col("source_id"), ratio)) if ratio else F.greatest(F.lit(30), seconds)
    freshness = F.greatest(2 * base, F.lit(1800))
    return sources.join(pulls, "source_id", "left").select("source_id", planned.alias("seconds"), freshness.alias("freshness_seconds"))


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Sources whose last try, of either outcome, is an interval ago, or that were never tried.

    sources: (source_id, base_seconds, last_success, last_failure).
    """
    last = F.greatest("last_success", "last_failure")
    due = last + F.make_dt_interval(secs=F.col("base_seconds"))
    return sources.select("source_id", last.alias("last_try"), due.alias("next_due")).where(F.col("last_try").isNull() | (F.col("next_due") <= now))


def current_errors(ops: DataFrame) -> DataFrame:
    """Sources whose latest source or parser event failed. ops: (seq, component, source_key, status, created_at)."""
    latest = ops.where("component in ('source', 'parser')").groupBy("source_key").agg(F.max_by(F.struct("status", "component", "created_at"), F.struct("created_at", "seq")).alias("last"))
    return latest.where("last.status = 'failed'").select("source_key", "last.component", "last.created_at")


def freshness_counts(offers: DataFrame) -> DataFrame:
    """One row: offers by freshness. offers: (freshness)."""
    known = ("fresh", "stale", "archived")
    return offers.agg(*[F.count_if(F.col("freshness") == k).alias(k) for k in known], F.count_if(~F.coalesce(F.col("freshness").isin(*known), F.lit(False))).alias("unknown"))


def keep_newest(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Retention by count: the n rows of highest `order`."""
    return rows.orderBy(F.desc(order)).limit(n)


def blank_older(rows: DataFrame, column: str, at: str, cutoff: Column) -> DataFrame:
    """Retention by age: the column of rows before the cutoff becomes null."""
    return rows.withColumn(column, F.when(F.col(at) >= cutoff, F.col(column)))


def safe_diagnostics(ops: DataFrame, redact, n: int = 50) -> DataFrame:
    """The newest n failures with their free text redacted. ops: (seq, component, source_key, created_at, detail, status)."""
    failed = ops.where("status = 'failed'").orderBy(F.desc("created_at"), F.desc("seq")).limit(n)
    return failed.select("seq", "component", "source_key", "created_at", redact(F.col("detail")).alias("detail"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table, an empty one included."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def safe_key(key: Column) -> Column:
    """Whether a source's key can be shown: a short name, without words that speak of secrets."""
    return key.rlike("^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}$") & ~key.rlike("(?i)^(https?|ftp):|token|secret|password|credential|api[_-]?key")


def source_states(sources: DataFrame, health: DataFrame, redact) -> DataFrame:
    """What diagnostics tell of sources: a key that could hold anything but a name is just `source`, free text is redacted.

    sources: (source, connector, enabled), health: `source_health`'s rows. A source that never ran has no failures.
    """
    rows = sources.join(health.select("source", "failures", "last_success"), "source", "left")
    safe = F.when(safe_key(F.col("source")), F.col("source")).otherwise("source")
    return rows.select(safe.alias("source_key"), redact(F.col("connector")).alias("connector"), F.coalesce("enabled", F.lit(False)).alias("enabled"), F.greatest(F.lit(0), F.coalesce("failures", F.lit(0))).cast("long").alias("failures"), "last_success")


# Parts of the system and what they do; outcomes; error labels that aren't derived from a text.
ACTIONS = {
    "source": ("monitor", "crawl", "refresh"),
    "parser": ("extract",),
    "notification": ("send",),
    "update": ("check", "check_available", "defer", "resume", "apply", "install", "rollback_accepted", "rollback_running", "rollback_succeeded", "rollback_failed"),
    "discovery": ("scan", "candidate"),
    "monitor": ("run", "enqueue"),
}
STATUSES = ("success", "failed", "skipped")
LABELS = ("unknown", "no_url", "maintenance", "empty", "partial", "error", *(label for _, label in ERROR_CLASSES))
COUNTS = ("valid_count", "invalid_count", "failed_count", "page_count", "page_failed_count")
MOST_COUNT = 1_000_000
DAY_MS = 86_400_000


def one_of(value: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(otherwise)


def operation_events(raw: DataFrame) -> DataFrame:
    """Operation events of which nothing is left that could carry a secret: every text is a known label or null.

    raw: (seq, component, operation, source_key, status, error, duration_ms, created_at and COUNTS). An unknown component
    is `monitor`, an unknown status `skipped`, an operation that its component doesn't have `other`. An error that is a
    known label stays, any other text becomes its class; a failure without one is `error`. Counts and durations are clamped.
    """
    component, status = one_of(F.col("component"), tuple(ACTIONS), "monitor"), one_of(F.col("status"), STATUSES, "skipped")
    operation = F.lit("other")
    for name, actions in ACTIONS.items():
        operation = F.when((component == name) & F.col("operation").isin(*actions), F.col("operation")).otherwise(operation)
    opaque = safe_key(F.col("source_key"))
    said = F.nullif("error", F.lit(""))
    label = F.when(said.isNull(), None).when(said.isin(*LABELS) | said.rlike(r"^http_\d{3}$"), said).otherwise(error_class(said))
    clamp = lambda c, most: F.least(F.lit(most), F.greatest(F.lit(0), F.col(c)))
    return raw.select(
        "seq", component.alias("component"), operation.alias("operation"), F.when(opaque, F.col("source_key")).alias("source_key"), status.alias("status"),
        F.coalesce(label, F.when(status == "failed", "error")).alias("error_class"), F.when(F.col("duration_ms").isNotNull(), clamp("duration_ms", DAY_MS)).alias("duration_ms"),
        *[F.coalesce(F.when(F.col(c).isNotNull(), clamp(c, MOST_COUNT)), F.lit(0)).alias(c) for c in COUNTS], "created_at",
    )


def recent_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The newest n (500 at most) operation events."""
    return keep_newest(events, min(500, max(1, n)), "seq")
