"""Attributes as known at event time: validity intervals, time buckets and an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votaria.session import cut

#: Days in a bucket: intervals are repeated once for each bucket they touch.
BUCKET_DAYS = 8
#: Interval rows (about 50 bytes each) up to which the interval side is broadcast; beyond it, the join is salted.
BROADCAST_ROWS = 500_000
SALTS = 16


def validity_intervals(attributes: DataFrame, entity: list[str], available: str, best: Column) -> DataFrame:
    """Half-open intervals ``[valid_from, valid_to)`` of days in which one row per entity was the best one known.

    ``available`` is the day (int) from which a row may be used, ``best`` a struct; the greatest struct among the
    available rows holds. Rows with a null in ``available`` never count. Before the window, rows are reduced to one
    per entity and day, so a window partition is bounded by the calendar, whatever share of the rows one entity has.
    ``valid_to`` is null for the last interval. An empty table gives no intervals.
    """
    daily = attributes.where(F.col(available).isNotNull()).groupBy(*entity, F.col(available).alias("valid_from")).agg(F.max(best).alias("best"))
    order = Window.partitionBy(*entity).orderBy("valid_from")
    running = daily.withColumn("best", F.max("best").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    changed = running.withColumn("before", F.lag("best").over(order)).where("before is null or best <> before").drop("before")
    return changed.withColumn("valid_to", F.lead("valid_from").over(order))


def asof_join(events: DataFrame, intervals: DataFrame, day: str, entity: list[str] = (), bucket_days: int = BUCKET_DAYS, broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Each event with every interval that contains its ``day`` (int), matched on ``entity`` (may be empty).

    Intervals are exploded into buckets of ``bucket_days`` and clipped to the span of the events; events meet them in
    an equi-join on entity and bucket. Events without a day match nothing. When the intervals are too many to
    broadcast, events are salted by a hash of the whole row, so that a hot bucket or entity is spread over ``salts`` tasks.
    Columns of ``intervals`` other than ``entity`` must not clash with those of ``events``.
    """
    entity = list(entity)
    span = events.agg(F.min(day).alias("low"), F.max(day).alias("high")).first()
    low, high = (span["low"], span["high"]) if span and span["high"] is not None else (0, -1)
    clipped = intervals.withColumn("valid_to", F.coalesce("valid_to", F.lit(high + 1))).where((F.col("valid_from") <= high) & (F.col("valid_to") > low) & (F.col("valid_from") < F.col("valid_to")))
    bucket = lambda c: F.floor(c / F.lit(bucket_days)).cast("int")
    first, last = F.greatest("valid_from", F.lit(low)), F.least(F.col("valid_to") - 1, F.lit(high))
    exploded = cut(clipped.withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last)))))
    keyed = events.where(F.col(day).isNotNull()).withColumn("_bucket", bucket(F.col(day)))
    on = [*entity, "_bucket"]
    if exploded.count() <= broadcast_rows:
        exploded = F.broadcast(exploded)
    else:
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*events.columns), F.lit(salts)).cast("int"))
        exploded = exploded.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append("_salt")
    joined = keyed.join(exploded, on).where((F.col(day) >= F.col("valid_from")) & (F.col(day) < F.col("valid_to")))
    return joined.drop("_bucket", "_salt", "valid_from", "valid_to")
