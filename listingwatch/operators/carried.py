"""Offers over time without their past: change events of new observations, from the state that earlier ones left.

carried: (offer_id, source_id, stable, candidate, candidate_count, price, observed_at, seq, emitted), one row an offer: its
stable state, the candidate and how often it was seen in a row, the last observation's price and place, and when each type of
event was last emitted. Only the offers that have new observations are read from it, and only their windows run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import timeline

CARRIED = "offer_id long, source_id long, stable string, candidate string, candidate_count long, price double, observed_at timestamp_ntz, seq long, emitted map<string, timestamp_ntz>"
OBSERVED = ["offer_id", "source_id", "seq", "observed_at", "price", "availability"]
PLACE = ("observed_at", "seq")


def nothing_carried(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CARRIED)


def restated(carried: DataFrame) -> DataFrame:
    """Observations that lead to the carried state: one of the stable state, then the candidate as often as it was seen.
    They stand before everything new, and carry the last price."""
    seen = F.concat(F.array("stable"), F.array_repeat(F.coalesce("candidate", F.lit("")), F.col("candidate_count").cast("int")))
    rows = carried.select("*", F.posexplode(seen).alias("nth", "availability"))
    return rows.withColumn("seq", F.col("seq") - F.col("candidate_count") + F.col("nth")).select(*OBSERVED)


def advance(carried: DataFrame, observations: DataFrame, confirmations: int = 2, threshold: float = 0.05, cooldown_hours: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, carried, late): what new observations change, the state after them, and the observations that are not newer
    than their offer's carried place, which change nothing.

    Any split of a history into batches in order gives the events of one pass (timeline's stable_states, events, cooled).
    """
    observations = observations.select(*[F.col(c).cast("long") if c in ("offer_id", "source_id", "seq") else F.col(c) for c in OBSERVED])
    before = carried.select("offer_id", F.struct(*PLACE).alias("place"))
    placed = observations.join(before, "offer_id", "left")
    newer = F.coalesce(F.struct(*PLACE) > F.col("place"), F.lit(True))
    late, fresh = placed.where(~newer).select(*OBSERVED), placed.where(newer).select(*OBSERVED)
    touched = carried.join(fresh.select("offer_id").distinct(), "offer_id", "left_semi")
    states = cut(timeline.stable_states(fresh.unionByName(restated(touched)), confirmations), "carried-states")  # for events and the last state
    found = timeline.events(states, threshold).join(before, "offer_id", "left").where(newer).drop("place")
    # a restated emission has no seq; it opens its cooldown and goes
    emitted = touched.select("offer_id", F.explode("emitted").alias("type", "observed_at"))
    none = {"seq": "long", "source_id": "long", "from_state": "string", "to_state": "string", "price": "double"}
    emitted = emitted.select("offer_id", "type", "observed_at", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    kept = cut(timeline.cooled(found.unionByName(emitted), cooldown_hours), "carried-kept")  # events, and the times that are carried on
    times = kept.groupBy("offer_id", "type").agg(F.max("observed_at").alias("at")).groupBy("offer_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "at"))).alias("emitted"))  # an offer's types: seven at most
    last = states.groupBy("offer_id").agg(F.max_by(F.struct("source_id", "stable", "candidate", F.col("candidate_count").cast("long").alias("candidate_count"), "price", "observed_at", "seq"), F.struct(*PLACE)).alias("s"))
    after = last.select("offer_id", "s.*").join(times, "offer_id", "left").withColumn("emitted", F.coalesce("emitted", F.create_map().cast("map<string, timestamp_ntz>")))
    untouched = carried.join(fresh.select("offer_id").distinct(), "offer_id", "left_anti")
    return kept.where("seq is not null"), untouched.unionByName(after), late
