"""Row-shaping operators: latest and first rows, capped lists, islands, forward fill, chunks, samples, dense spines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votaria.session import cut


#: Rows of counts per group up to which they are broadcast.
BROADCAST_ROWS = 100_000


def latest_per_key(df: DataFrame, key: list[str], order: Column, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``order`` for each key, null orders last.

    Rows of equal order are told apart by the columns ``ties``, greatest first; rows equal in these too should be copies.
    Each task keeps one row of a key before the shuffle, and columns that are not asked for later are not read.
    """
    return capped(df, key, [order.desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties]], 1)


def first_per_key(df: DataFrame, key: list[str], order: Column, ties: Sequence[str] = ()) -> DataFrame:
    """First wins: the row with the least ``order`` for each key; nulls come last, ``ties`` as in ``latest_per_key``."""
    return capped(df, key, [order.asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]], 1)


def capped(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group (the limit is the feature); Spark keeps only ``n`` per task before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def capped_twice(df: DataFrame, by: list[str], source: str, order: list[Column], per_source: int, total: int) -> DataFrame:
    """At most ``per_source`` rows of each source, then at most ``total`` of each group."""
    return capped(capped(df, [*by, source], order, per_source), by, order, total)


def islands(df: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """Runs of consecutive rows that agree in ``same``: first, last and length."""
    w = Window.partitionBy(*by).orderBy(order)
    within = Window.partitionBy(*by, *same).orderBy(order)
    numbered = df.withColumn("_run", F.row_number().over(w) - F.row_number().over(within))
    return numbered.groupBy(*by, *same, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def forward_fill(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last known value of each column, up to and including the row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def chunks(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """Numbers rows into chunks of ``size`` in order, from 0; a null group is a group."""
    return ordered(df, by, order).withColumn("chunk", F.floor(F.col("_row") / F.lit(size)).cast("int")).drop("_row", "_size")


def every_kth(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Systematic sample: about ``k`` rows of each group, evenly spaced in order."""
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / F.lit(k)))
    return ordered(df, by, order).where((F.col("_row") % step == 0) & (F.floor(F.col("_row") / step) < k)).drop("_row", "_size")


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """About ``n`` rows, each stratum in proportion but never empty; picks depend on ``key`` and ``seed`` alone."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    few = sizes.count() <= BROADCAST_ROWS
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("_quota", F.greatest(F.lit(1), F.round(F.lit(n) * F.col("_size") / F.col("_total"))))  # one total row
    quota = quota.select(*strata, "_quota")
    ranked = df.join(F.broadcast(quota) if few else quota, strata).withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(key, F.lit(seed)), key)))
    return ranked.where(F.col("_r") <= F.col("_quota")).drop("_r", "_quota")


def apportion(df: DataFrame, weight: str, seats: int, have: str | None = None) -> DataFrame:
    """Largest-remainder shares of ``seats`` by ``weight``, never below ``have``; one row per group expected."""
    everything = Window.partitionBy(F.lit(1))
    exact = F.try_divide(F.col(weight) * F.lit(float(seats)), F.sum(weight).over(everything))
    cut = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(seats) - F.sum("_floor").over(everything)
    names = [c for c in df.columns if c != weight]
    rank = F.row_number().over(everything.orderBy((F.col("_exact") - F.col("_floor")).desc(), *names))
    share = F.col("_floor") + F.when(rank <= left, 1).otherwise(0)
    return cut.withColumn("share", F.greatest(share, F.col(have)) if have else share).drop("_exact", "_floor")


def dense(counts: DataFrame, spine: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Every combination of the spine, with zeros where ``counts`` has none. The spine is a small frame of dimensions."""
    return F.broadcast(spine).join(counts, on, "left").fillna(0, values)


def ordered(df: DataFrame, by: list[str], order: list[Column], row: str = "_row", size: str = "_size", running: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """Numbers the rows of each group in order from 0 (``row``) and adds the size of the group, without one task for a group.

    Rows are laid out in ranges of group and order. Each range is numbered by itself, and the counts of the ranges before
    it (one row for each range of a group) are added; these are broadcast while they are few. ``running`` maps names to columns whose sums up to the row are
    wanted as well. Ties in ``order`` should be broken by a key, else their numbers may differ between runs.
    """
    sums = running or {}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    laid = cut(laid)
    within = Window.partitionBy(*by, "_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({row: F.row_number().over(within) - 1} | {name: F.sum(c).over(upto) for name, c in sums.items()})
    totals = laid.groupBy(*by, "_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    shift = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(size), *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums], *[F.sum(f"_sum_{name}").over(whole).alias(f"{name}_total") for name in sums])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_range") == F.col("_at"))
    joined = local.join(F.broadcast(shift) if totals.count() <= BROADCAST_ROWS else shift, same)
    return joined.withColumns({row: F.col(row) + F.col("_before")} | {name: F.col(name) + F.col(f"_before_{name}") for name in sums}).drop("_range", "_at", "_before", *[f"_before_{name}" for name in sums], *[f"_by_{c}" for c in by])


def balanced_groups(df: DataFrame, by: list[str], order: list[Column], cost: str, limit: float, most: int = 150) -> DataFrame:
    """Deals the rows of each bucket, in order, into groups of equal cost: the fewest that ``limit`` allows, none over ``most`` rows.

    A bucket of total cost T and n rows gets ``k = max(ceil(T / limit), ceil(n / most))`` groups. A row goes to the group
    in which the middle of its cost falls when T is divided into k equal parts, by a running sum; where rows are so
    cheap that a part would hold more than ``most`` of them, it is divided again by row number. So group numbers depend
    on sums alone, and no bucket is packed in one task. Null costs count as zero. Adds ``group_no`` from 0.
    """
    priced = df.withColumn("_cost", F.coalesce(F.col(cost), F.lit(0.0)).cast("double"))
    numbered = ordered(priced, by, order, running={"_spent": "_cost"})
    groups = F.greatest(F.lit(1), F.ceil(F.col("_spent_total") / F.lit(limit)), F.ceil(F.col("_size") / F.lit(most)))
    middle = F.col("_spent") - F.col("_cost") / 2
    part = F.least(groups - 1, F.floor(F.coalesce(F.try_divide(middle * groups, F.col("_spent_total")), F.lit(0.0)))).cast("int")
    placed = numbered.withColumn("_part", part)
    starts = placed.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    slots = starts.withColumn("_slots", F.ceil(F.col("_rows") / F.lit(most))).withColumn("_base", F.coalesce(F.sum("_slots").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = [*by, "_part"]
    named = slots.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_first", "_base")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    out = placed.join(named, same).withColumn("group_no", (F.col("_base") + F.floor((F.col("_row") - F.col("_first")) / F.lit(most))).cast("int"))
    return out.select(*df.columns, "group_no")
