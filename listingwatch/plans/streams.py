"""Registered streaming queries: events are read as a stream, run over all that has arrived, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs
from .oracle import OPS, SQL
from .queries import COOLDOWN_HOURS
from .views import observations, operations


FRESH_SECONDS = 86_400


def events(spark, sf_dir):
    return jobs.read_parquet(spark, f"{sf_dir}/events.parquet")


def st_offer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.offer_events(observations(spark, sf_dir, events(spark, sf_dir)), cooldown_hours=COOLDOWN_HOURS)
    return jobs.drain(found, "offer-events")


def st_component_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.component_windows(operations(spark, sf_dir, events(spark, sf_dir))), "component-windows")


def st_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings = observations(spark, sf_dir, events(spark, sf_dir)).withColumn("observed_at", F.date_trunc("second", "observed_at"))
    return jobs.drain(jobs.freshness_changes(sightings, FRESH_SECONDS), "freshness")


QUERIES = {f.__name__: f for f in (st_offer_events, st_component_windows, st_freshness)}
ORACLE_SQL = {
    "st_offer_events": SQL["e5_cooldown"],
    "st_component_windows": f"""WITH {OPS}, w AS (SELECT *, unnest(range(7)) AS back FROM ops)
        SELECT component, date_trunc('day', created_at) - to_days(CAST(back AS INTEGER)) AS since, count(*) AS total, count(*) FILTER (status = 'failed') AS failed
        FROM w GROUP BY component, since HAVING since + INTERVAL 7 DAY <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM ops)""",
    "st_freshness": f"""WITH s AS (SELECT DISTINCT user_id AS offer_id, date_trunc('second', ts) AS t FROM events), w AS (SELECT *, lag(t) OVER o AS before, lead(t) OVER o AS later FROM s WINDOW o AS (PARTITION BY offer_id ORDER BY t)),
        u AS (SELECT *, t + INTERVAL {FRESH_SECONDS} SECOND AS until FROM w)
        SELECT offer_id, t AS "at", 'fresh' AS freshness FROM u WHERE before IS NULL OR t - before > INTERVAL {FRESH_SECONDS} SECOND
        UNION ALL SELECT offer_id, until, 'stale' FROM u WHERE later > until OR (later IS NULL AND until < (SELECT max(t) - INTERVAL 1 HOUR FROM s))""",
}
