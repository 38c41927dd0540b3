"""Operator 5: mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: piecewise linear, given by its values at equal
steps. Its integral is the source's cumulative demand for tokens, scaled so that the whole demand is the source's
target. A document copy's tokens take up a stretch of its source's cumulative tokens; inverting the demand at the
stretch's middle gives the copy's training position, and documents are range-sorted by position.

Within a source documents come in the order of a hash of id and text. Running sums split a source by the hash's
leading digits, so that a source with a third of all rows is spread over 4,096 keys. Texts stay out of all this: rows
are numbered, sizes and hashes move, and a text is joined to its positions once, if it is wanted at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Weight over training time of the sources, repeating like the weights: constant, rising, falling.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> source, place, source_size, weight, target.

    Sources take the weights in code point order, null last. A target never exceeds `most` times the source's size; what
    is over is shared by weight among the others, until none is above. Each round is one aggregate over the table of
    sources; one row comes to the driver. A source's place is counted by ranges of sources, not in one task.
    """
    n = len(weights)
    # code point order is the order of UTF-8 bytes; the place comes from range partitions and their counts
    spark = sizes.sparkSession
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = cut(ordered, "sources")
    parts = sorted(ordered.groupBy("part").count().collect())  # one row for each partition
    before, offsets = 0, []
    for part, count in parts:
        offsets.append((part, before))
        before += count
    starts = spark.createDataFrame(offsets, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    # a weight times the tokens of all sources doesn't fit an int beyond some hundred million tokens
    whole = "long" if all(isinstance(w, int) for w in weights) else "double"
    weight = F.element_at(F.array(*[F.lit(w).cast(whole) for w in weights]), (F.col("place") % n + 1).cast("int"))
    placed = ordered.join(F.broadcast(starts), "part").withColumn("place", F.col("before") + rank).select("source", "source_size", "place", weight.alias("weight"))
    placed = cut(placed, "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    rest, shared, limit = total, None, most
    while True:
        over = F.lit(False) if shared is None else F.col("source_size") * limit * shared <= F.col("weight") * F.lit(rest)
        open_weight, capped = placed.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, F.col("source_size") * limit))).first()
        after = (total - (capped or 0), open_weight)
        if after == (rest, shared) or not open_weight:
            break
        rest, shared = after
    if shared is None:
        return placed.withColumn("target", F.lit(0.0))
    share = F.col("weight") * F.lit(rest) / F.lit(shared)
    return placed.withColumn("target", F.when(over, F.col("source_size") * F.lit(float(limit))).otherwise(share).cast("double"))


def position(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """Inverse of the cumulative demand: the training time at which a share (0 to 1) of a source's demand is met."""

    def inverse(values):
        steps = len(values) - 1
        mean = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        total, done, out = sum(mean), 0.0, None
        if min(values) < 0 or not total > 0:
            raise ValueError("a schedule needs weights of zero or more, some above zero")
        for i, (a, b) in enumerate(zip(values, values[1:], strict=False)):
            need = share * F.lit(total) - F.lit(done)  # (a + (b - a) x / 2) x = need, x in [0, 1]
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + need * F.lit(2 * (b - a))))
            x = F.when(need <= 0, 0.0).otherwise(need * 2 / F.greatest(F.lit(1e-300), F.lit(a) + root))
            at = (F.lit(float(i)) + F.least(F.lit(1.0), x)) / F.lit(float(steps))
            done += mean[i]
            out = at if out is None else F.when(share * F.lit(total) < F.lit(done - mean[i]), out).otherwise(at)
        return out

    expr = inverse(schedules[-1])
    for k in range(len(schedules) - 2, -1, -1):
        expr = F.when(place % len(schedules) == k, inverse(schedules[k])).otherwise(expr)
    return expr


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES, columns: list[str] | None = None) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target, taken, repeats, position (of the first copy; null if the
    mix takes none), place and middle (of its source, of its stretch) and `columns`.

    A source whose target is r times its size takes every document floor(r) times, and once more those that come first in
    hash order until their sizes fill what is left of the target; the document on the edge is taken if its middle lies
    before it. A null text has size 0; null is a source of its own, the last. Repeated rows and null doc_ids are rows like
    any other. The result is not sorted; order by position for training order.
    """
    columns = columns or []
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(columns)]
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("key"), *kept)
    # the number of a row must not change when it is read again
    sized = cut(sized.withColumn("part", F.substring("key", 1, 3)).withColumn("row", F.monotonically_increasing_id()), "mixing")
    ids = sized.select("row", "doc_id", "source", "size", "key", "part")
    sums = cut(ids.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mixing-parts")
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most)
    targets = cut(targets, "mixing-targets")
    before = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), "before", "source_size", "target", "place")
    # a part is a key of its own: at most 1 in 4,096 of a source's documents, equal rows aside
    run = F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    summed = ids.withColumn("run", run).join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - F.col("full") * F.col("source_size")
    middle = F.col("before") + F.col("run") - F.col("size") / 2
    out = summed.withColumn("full", full).withColumn("repeats", (F.col("full") + F.when(middle < left, 1).otherwise(0)).cast("int"))
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), middle / F.col("target"))).otherwise(F.lit(0.0))
    mixed = out.select(
        "row",
        "doc_id",
        "size",
        F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.col("target"),
        (F.col("size") * F.col("repeats")).alias("taken"),
        "repeats",
        F.when(F.col("repeats") > 0, position(share, F.col("place"), schedules)).alias("position"),
        "place",
        middle.alias("middle"),
    )
    if not columns:
        return mixed.drop("row")
    names = {f"kept_{i}": c if c not in OWN else f"doc_{c}" for i, c in enumerate(columns)}
    return mixed.join(sized.select("row", *names), "row").drop("row").withColumnsRenamed(names)


OWN = ("doc_id", "size", "source_size", "target", "taken", "repeats", "position", "place", "middle")


def in_training_order(mixed: DataFrame, *ties: str) -> DataFrame:
    """Range-sorted by position, rows that the mix takes not at all last; ties by doc_id and the columns named."""
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), *map(F.col, ties)]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(mixed: DataFrame, schedules=SCHEDULES) -> DataFrame:
    """A row for each copy that the mix takes, with the copy's own position, range-sorted by position."""
    copies = mixed.where("repeats > 0").withColumn("copy", F.explode(F.expr("sequence(0, repeats - 1)")))
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("middle") + F.col("copy") * F.col("source_size")) / F.col("target"))).otherwise(F.lit(0.0))
    return in_training_order(copies.withColumn("position", position(share, F.col("place"), schedules)), "copy")
