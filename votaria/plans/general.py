"""Queries of the general data problems 1, 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votaria.expr import day_number, day_of, key_form, period_start
from votaria.operators.asof import asof_join, validity_intervals
from votaria.operators.packed import split_packed
from votaria.operators.references import Reference, Target, orphan_references
from votaria.tables import table


def _known_figures(spark: SparkSession, root: str) -> DataFrame:
    vintage, start = day_number(day_of("vintage_date")), day_number(period_start("period"))
    figures = table(spark, root, "indicators").select("series", "obs_id", "period", "value", vintage.alias("v"), start.alias("p")).where("series is not null and v is not null and p is not null")
    # usable from the day after publication, and not before its period has begun
    figures = figures.withColumn("available", F.greatest(F.col("v") + 1, F.col("p")))
    best = F.struct(F.col("p"), F.col("v"), (-F.col("obs_id")).alias("o"), F.col("value"), F.col("period"))
    intervals = validity_intervals(figures, ["series"], "available", best)
    divisions = table(spark, root, "cases").select(key_form("votering_id").alias("votering_id"), day_number(day_of("datum")).alias("day")).where("votering_id is not null").distinct()
    return asof_join(divisions, intervals, "day")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """For each division and series, the figure known before the division's day."""
    return _known_figures(spark, root).select("votering_id", (-F.col("best.o")).alias("obs_id")).distinct()


def p1_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Per series: divisions with a known figure, and its mean age in days since publication."""
    known = _known_figures(spark, root)
    return known.groupBy("series").agg(F.count_distinct("votering_id").alias("n_divisions"), F.avg((F.col("day") - F.col("best.v")).cast("double")).alias("mean_age"))


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    t = lambda name: table(spark, root, name)
    references = [Reference(t(n), n, "votering_id", "cases") for n in ("votes", "alternatives", "decisions")] + [Reference(t("cases"), "cases", "dok_id", "dokstatus")]
    return orphan_references(references, [Target(t("cases"), "cases", "votering_id"), Target(t("dokstatus"), "dokstatus", "dok_id")])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """References to divisions and reports that were not in force when the record came in."""
    return _orphans(spark, root).select("src_table", "ref_field", "ref_value", "period", "reason").distinct()


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references per table, field, month and reason: rows and distinct ids."""
    return _orphans(spark, root).groupBy("src_table", "ref_field", "period", "reason").agg(F.sum("n").alias("n_rows"), F.count_distinct("ref_value").alias("n_ids"))


def _packed(spark: SparkSession, root: str, least: int) -> DataFrame:
    votering_id = key_form("votering_id").alias("votering_id")
    parties = table(spark, root, "alternatives").select(F.lit("source_partier").alias("field"), votering_id, F.trim("alt_id").alias("alt_id"), F.col("source_partier").alias("text"))
    numbers = table(spark, root, "cases").select(F.lit("motforslag_nummer").alias("field"), votering_id, F.lit("").alias("alt_id"), F.col("motforslag_nummer").alias("text"))
    rows = parties.unionByName(numbers).where("votering_id is not null")
    return split_packed(rows, "text", ["field", "votering_id", "alt_id"], least)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """One row per value of the fields that hold two or more."""
    return _packed(spark, root, 2).distinct()


def p4_profile(spark: SparkSession, root: str) -> DataFrame:
    """Per field and value: how many records hold it, and at which first position."""
    each = _packed(spark, root, 1).distinct()
    return each.groupBy("field", F.upper("value").alias("value")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p2_report, p4_found, p4_profile)}

_FIGURES = """
fig as (
  select obs_id, series, try_strptime(left(regexp_replace(vintage_date, '[^0-9]', '', 'g'), 8), '%Y%m%d')::date as v,
    case when regexp_matches(trim(period), '^\\d{4}-?[KkQq][1-4]$') then make_date(left(trim(period), 4)::int, (right(trim(period), 1)::int - 1) * 3 + 1, 1)
         when regexp_matches(trim(period), '^\\d{4}-?[Mm]?\\d{2}$') then make_date(left(trim(period), 4)::int, right(trim(period), 2)::int, 1)
         else try_strptime(left(regexp_replace(period, '[^0-9]', '', 'g'), 8), '%Y%m%d')::date end as p
  from indicators where series is not null),
dv as (
  select distinct upper(trim(votering_id)) as votering_id, try_strptime(left(regexp_replace(datum, '[^0-9]', '', 'g'), 8), '%Y%m%d')::date as d
  from cases where trim(votering_id) <> ''),
known as (
  select dv.votering_id, dv.d, fig.series, fig.obs_id, fig.v
  from dv join fig on fig.v < dv.d and fig.p <= dv.d
  qualify row_number() over (partition by dv.votering_id, dv.d, fig.series order by fig.p desc, fig.v desc, fig.obs_id) = 1)"""

_REFS = """
refs as (
  select 'votes' as src_table, 'votering_id' as ref_field, 'cases' as parent, upper(trim(votering_id)) as k, inkom_ts as at from votes
  union all select 'alternatives', 'votering_id', 'cases', upper(trim(votering_id)), inkom_ts from alternatives
  union all select 'decisions', 'votering_id', 'cases', upper(trim(votering_id)), inkom_ts from decisions
  union all select 'cases', 'dok_id', 'dokstatus', upper(trim(dok_id)), inkom_ts from cases),
targets as (
  select 'cases' as parent, upper(trim(votering_id)) as k, inkom_ts, borttagen_ts from cases
  union all select 'dokstatus', upper(trim(dok_id)), inkom_ts, borttagen_ts from dokstatus),
child as (select row_number() over () as rid, * from refs where k <> ''),
judged as (
  select c.rid, any_value(c.src_table) as src_table, any_value(c.ref_field) as ref_field, any_value(c.k) as ref_value, any_value(strftime(c.at, '%Y-%m')) as period,
    bool_or(coalesce(t.inkom_ts <= c.at and (t.borttagen_ts is null or t.borttagen_ts > c.at), false)) as alive,
    case when count(t.k) = 0 then 'missing' when bool_or(coalesce(t.inkom_ts <= c.at, false)) then 'deleted' else 'late' end as reason
  from child c left join targets t on t.parent = c.parent and t.k = c.k group by c.rid),
orphan as (select * from judged where not alive)"""

ORACLE = {
    "p1_found": f"with {_FIGURES} select distinct votering_id, obs_id from known",
    "p1_coverage": f"with {_FIGURES} select series, count(distinct votering_id) as n_divisions, avg(date_diff('day', v, d)::double) as mean_age from known group by series",
    "p2_found": f"with {_REFS} select distinct src_table, ref_field, ref_value, period, reason from orphan",
    "p2_report": f"with {_REFS} select src_table, ref_field, period, reason, count(*) as n_rows, count(distinct ref_value) as n_ids from orphan group by all",
}

_ITEMS = """items as (
  select 'source_partier' as field, upper(trim(votering_id)) as votering_id, trim(alt_id) as alt_id, source_partier as t from alternatives where trim(votering_id) <> ''
  union select 'motforslag_nummer', upper(trim(votering_id)), '', motforslag_nummer from cases where trim(votering_id) <> ''),
tk as (select field, votering_id, alt_id, t, list_filter(list_transform(
    regexp_extract_all(t, '"(?:[^"\\\\]|\\\\.|"")*"|''[^'']*''|[^,;|/&+\\s\\[\\](){}"'']+'),
    lambda x: case when x[1] = '"' then trim(replace(replace(x[2:-2], '\\"', '"'), '""', '"')) when x[1] = '''' then trim(x[2:-2]) when lower(x) = 'och' then '' else x end), lambda x: x <> '') as vs from items where t is not null)"""


ORACLE["p4_found"] = f"with {_ITEMS} select distinct field, votering_id, alt_id, generate_subscripts(vs, 1)::int as pos, unnest(vs) as value from tk where len(vs) >= 2"
ORACLE["p4_profile"] = f"with {_ITEMS} select field, upper(value) as value, count(*) as n, min(pos) as first_pos from (select distinct field, votering_id, alt_id, generate_subscripts(vs, 1)::int as pos, unnest(vs) as value from tk) group by all"
