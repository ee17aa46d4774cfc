"""References to records that do not exist, or were not in force when the referring record came in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votaria.expr import key_form
from votaria.session import cut

#: Undecided months of keys (about 200 bytes each) up to which they are broadcast to the records; beyond it the join is salted.
BROADCAST_ROWS = 100_000
SALTS = 16
_END = "9999-12-31 00:00:00"
_START = "0001-01-01 00:00:00"


@dataclass
class Reference:
    """A column of ``rows`` that refers to ``parent`` by key; ``came_in`` is the record's arrival time."""

    rows: DataFrame
    src_table: str
    ref_field: str
    parent: str
    came_in: str = "inkom_ts"


@dataclass
class Target:
    """The table ``name`` whose rows are in force from ``came_in`` until ``withdrawn`` (null: for ever)."""

    rows: DataFrame
    name: str
    key: str
    came_in: str = "inkom_ts"
    withdrawn: str = "borttagen_ts"


def _ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping or touching spans ``[start, end)`` within ``by``."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _targets(targets: Sequence[Target]) -> DataFrame:
    """Per target key: first arrival and the merged spans in force.

    Spans are merged within a key and month first, so a key with very many rows is spread over months.
    """
    rows = [
        t.rows.select(F.lit(t.name).alias("parent"), key_form(t.key).alias("key"), F.col(t.came_in).cast("timestamp_ntz").alias("start"), F.coalesce(F.col(t.withdrawn).cast("timestamp_ntz"), _ntz(_END)).alias("end"))
        for t in targets
    ]
    spans = reduce(DataFrame.unionByName, rows).where("key is not null")
    # rows without arrival, and empty spans, are targets all the same
    seen = spans.groupBy("parent", "key").agg(F.min("start").alias("first_in"))
    alive = spans.where("start is not null and end > start").groupBy("parent", "key", "start").agg(F.max("end").alias("end"))
    monthly = _islands(alive.withColumn("month", F.date_format("start", "yyyy-MM")), ["parent", "key", "month"]).drop("month")
    merged = _islands(monthly, ["parent", "key"]).groupBy("parent", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return seen.join(merged, ["parent", "key"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:timestamp_ntz,end:timestamp_ntz>>")))


def _children(references: Sequence[Reference]) -> DataFrame:
    rows = [
        r.rows.select(
            F.lit(r.parent).alias("parent"), key_form(r.ref_field).alias("key"), F.lit(r.src_table).alias("src_table"), F.lit(r.ref_field).alias("ref_field"),
            F.date_format(r.came_in, "yyyy-MM").alias("period"), F.coalesce(F.col(r.came_in).cast("timestamp_ntz"), _ntz(_START)).alias("at"),
        )
        for r in references
    ]
    return reduce(DataFrame.unionByName, rows).where("key is not null")


def orphan_references(references: Sequence[Reference], targets: Sequence[Target], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Orphans as ``src_table, ref_field, ref_value, period, reason, n`` (``n``: referring rows).

    Keys of parents and children are united in long form and grouped by parent table and key. Children enter this
    group as one row per source, key and month (map-side combined), with their first and last arrival; so a key held
    by a third of all rows is a handful of rows there. A group without the parent flag is ``missing``. Where all
    arrivals of a month fall on one side of every change of the parent, the month is settled from the group alone;
    only the other months are joined back to single records, by a broadcast while they are few, else salted. Null and blank references are no references; a record
    without arrival time counts as coming in before every target, with a null period. Empty tables give no rows.
    """
    children = _children(references)
    by = ["parent", "key", "src_table", "ref_field", "period"]
    monthly = children.groupBy(*by).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
    span_type = "array<struct<start:timestamp_ntz,end:timestamp_ntz>>"
    child_type = "struct<src_table:string,ref_field:string,period:string,low:timestamp_ntz,high:timestamp_ntz,n:bigint>"
    long = (
        _targets(targets)
        .select("parent", "key", F.lit(1).alias("is_parent"), F.lit(None).cast(child_type).alias("child"), F.col("first_in"), "spans")
        .unionByName(monthly.select("parent", "key", F.lit(0).alias("is_parent"), F.struct("src_table", "ref_field", "period", "low", "high", "n").cast(child_type).alias("child"), F.lit(None).cast("timestamp_ntz").alias("first_in"), F.lit(None).cast(span_type).alias("spans")))
    )
    # at most one child row per source and month, one parent row: the list is bounded by the calendar
    groups = long.groupBy("parent", "key").agg(F.max("is_parent").alias("has_parent"), F.max("first_in").alias("first_in"), F.max("spans").alias("spans"), F.collect_list("child").alias("children"))
    each = groups.select("parent", "key", "has_parent", "first_in", "spans", F.inline("children"))
    covered = F.exists("spans", lambda s: (s["start"] <= F.col("low")) & (F.col("high") < s["end"]))
    touched = F.exists("spans", lambda s: (s["start"] <= F.col("high")) & (F.col("low") < s["end"]))
    verdict = (
        F.when(F.col("has_parent") == 0, "missing")
        .when(covered, "ok")
        .when(F.col("first_in").isNull() | (F.col("high") < F.col("first_in")), "late")
        .when(~touched & (F.col("first_in") <= F.col("low")), "deleted")
        .otherwise("mixed")
    )
    settled = cut(each.withColumn("reason", verdict).where("reason <> 'ok'"))
    out = ["src_table", "ref_field", F.col("key").alias("ref_value"), "period", "reason", "n"]
    mixed = settled.where("reason = 'mixed'").select("parent", "key", "src_table", "ref_field", F.col("period").alias("_period"), "first_in", "spans")
    on = ["parent", "key", "src_table", "ref_field"]
    if mixed.count() <= broadcast_rows:
        mixed = F.broadcast(mixed)
    else:  # a key with very many records is dealt over several tasks
        children = children.withColumn("_salt", F.pmod(F.xxhash64("at", "period"), F.lit(SALTS)).cast("int"))
        mixed = mixed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = [*on, "_salt"]
    records = children.join(mixed, on).where(F.col("period").eqNullSafe(F.col("_period")))
    alive = F.exists("spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") < s["end"]))
    single = records.where(~alive).withColumn("reason", F.when(F.col("first_in") <= F.col("at"), "deleted").otherwise("late"))
    single = single.groupBy("src_table", "ref_field", "key", "period", "reason").agg(F.count("*").alias("n"))
    return settled.where("reason <> 'mixed'").select(*out).unionByName(single.select(*out))
