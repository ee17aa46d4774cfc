"""Queries that make requests: units, packets, snapshots at month ends, lean rows, and cleaned markup of other kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votaria.expr import day_number, day_of, period_start
from votaria.functions import text as tx
from votaria.operators.asof import asof_join, validity_intervals
from votaria.plans import context, documents
from votaria.plans import parliament as pl
from votaria.plans.documents import _COVER, _RES, _alternatives
from votaria.plans.general import _FIGURES
from votaria.plans.parliament import Frames, _with
from votaria.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        def run(spark, root):
            return build(Frames(spark, root))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            ORACLE[build.__name__] = f"with {pl.BASE} {sql}"
        return run

    return register


@query(_with(f"{_FIGURES}, me as (select distinct month, last_day(datum) as day from c where datum is not null), sn as (select me.month, me.day, fig.series, fig.obs_id from me join fig on fig.v <= me.day and fig.p <= me.day qualify row_number() over (partition by me.month, fig.series order by fig.p desc, fig.v desc, fig.obs_id) = 1)", "select month, series, obs_id from sn"))
def month_snapshots(f: Frames) -> DataFrame:
    """For each month with divisions and each series, the figure known by the month's end (as-of, inclusive)."""
    vintage, start = day_number(day_of("vintage_date")), day_number(period_start("period"))
    figures = table(f.spark, f.root, "indicators").select("series", "obs_id", vintage.alias("v"), start.alias("p")).where("series is not null and v is not null and p is not null")
    figures = figures.withColumn("available", F.greatest("v", "p"))
    intervals = validity_intervals(figures, ["series"], "available", F.struct(F.col("p"), F.col("v"), (-F.col("obs_id")).alias("o")))
    ends = f.cases.where("datum is not null").select("month", F.unix_date(F.last_day("datum")).alias("day")).distinct()
    return asof_join(ends, intervals, "day").select("month", "series", (-F.col("best.o")).alias("obs_id"))


@query(_with("x as (select series, left(period, 7) as month, period, value from indicators where length(period) = 10 and value is not null and series is not null)", "select series, month, round(avg(value), 1) as mean, count(*) as n, max(period) as latest from x group by all"))
def monthly_means(f: Frames) -> DataFrame:
    """Mean, number and latest day of daily figures per month."""
    rows = table(f.spark, f.root, "indicators").where("length(period) = 10 and value is not null and series is not null")
    return rows.groupBy("series", F.substring("period", 1, 7).alias("month")).agg(F.round(F.avg("value"), 1).alias("mean"), F.count("*").alias("n"), F.max("period").alias("latest"))


@query(_with(f"{_RES}, rs as (select votering_id, list(alt_id || ': ' || left(text, 600) order by alt_id) as reservations from a1 where alt_id like 'res-%' and text is not null group by votering_id)", f"select votering_id, concat_ws(' — ', rubrik, left(forslag_text, 2000)) as display, left({context._SCRUBBED}, 2000) as agent, reservations from c left join rs using (votering_id) where forslag_text is not null"))
def request_units(f: Frames) -> DataFrame:
    """One unit of work for each case: what may be shown, what an agent may see (scrubbed), and its reservations, each cut to its size."""
    res = _alternatives(f).where("alt_id like 'res-%' and text is not null").groupBy("votering_id").agg(F.array_sort(F.collect_list(F.struct("alt_id", F.concat("alt_id", F.lit(": "), F.substring("text", 1, 600)).alias("t")))).alias("l"))
    rows = f.cases.where("forslag_text is not null").join(res, "votering_id", "left")
    return rows.select("votering_id", F.concat_ws(" — ", "rubrik", F.substring("forslag_text", 1, 2000)).alias("display"), F.substring(tx.scrub(F.col("forslag_text")), 1, 2000).alias("agent"), F.transform("l", lambda x: x["t"]).alias("reservations"))


@query(_with(f"{_RES}, {_COVER}, top as (select votering_id, doc_id, score from sc qualify row_number() over (partition by votering_id order by score desc, doc_id) = 1), tx as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id), rs as (select votering_id, count(*) as n from a1 where alt_id like 'res-%' group by votering_id)", "select c.votering_id, left(coalesce(case when score > 0 then tx.text end, nullif(trim(notis), ''), forslag_text), 2200) as body, case when score > 0 then 'document' when trim(notis) <> '' then 'note' else 'proposal' end as source, coalesce(rs.n, 0) as n_reservations from c left join top using (votering_id) left join tx using (doc_id) left join rs using (votering_id)"))
def packets(f: Frames) -> DataFrame:
    """What a worker gets on each case: the best document where one names its motions, else the note, else the proposal, cut to 2,200 characters."""
    best = documents.QUERIES["covering_documents"](f.spark, f.root).where("rank = 1 and score > 0").select("votering_id", "doc_id")
    texts = table(f.spark, f.root, "documents").where("text is not null").groupBy("doc_id").agg(F.any_value("text").alias("text"))
    many = _alternatives(f).where("alt_id like 'res-%'").groupBy("votering_id").agg(F.count("*").alias("n"))
    rows = f.cases.join(best.join(texts, "doc_id"), "votering_id", "left").join(many, "votering_id", "left")
    note = F.nullif(F.trim("notis"), F.lit(""))
    source = F.when(F.col("text").isNotNull(), "document").when(note.isNotNull(), "note").otherwise("proposal")
    return rows.select("votering_id", F.substring(F.coalesce("text", note, "forslag_text"), 1, 2200).alias("body"), source.alias("source"), F.coalesce("n", F.lit(0)).alias("n_reservations"))


@query("select votering_id, json_merge_patch('{}'::json, to_json({'id': votering_id, 'rubrik': rubrik, 'vinnare': nullif(trim(vinnare), ''), 'month': month}))::varchar as row from c")
def lean_rows(f: Frames) -> DataFrame:
    """The row of each case as JSON, without the keys it has no value for."""
    return f.cases.select("votering_id", F.to_json(F.struct(F.col("votering_id").alias("id"), "rubrik", F.nullif(F.trim("vinnare"), F.lit("")).alias("vinnare"), "month")).alias("row"))


_CODES = tx._CODES


@query(f"select votering_id, list_sort(list_distinct(regexp_extract_all(forslag_text, '{tx._BY}({_CODES})(?:$|[^\\p{{L}}\\p{{N}}_])', 1))) as parties from c where len(regexp_extract_all(forslag_text, '{tx._BY}({_CODES})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)) > 0")
def scraped_parties(f: Frames) -> DataFrame:
    """Parties that a proposal names as authors."""
    found = F.regexp_extract_all("forslag_text", F.lit(rf"{tx._BY}({_CODES})(?:$|[^\p{{L}}\p{{N}}_])"), F.lit(1))
    return f.cases.select("votering_id", F.array_sort(F.array_distinct(found)).alias("parties")).where("size(parties) > 0")


@query("select rm, replace(rm, '/', '-') as slug, 'budget-' || replace(rm, '/', '') || '.txt' as file, count(*) as n from c where rm is not null group by rm")
def session_files(f: Frames) -> DataFrame:
    """File names of each session."""
    return f.cases.where("rm is not null").groupBy("rm").agg(F.count("*").alias("n")).select("rm", F.replace("rm", F.lit("/"), F.lit("-")).alias("slug"), F.concat(F.lit("budget-"), F.replace("rm", F.lit("/"), F.lit("")), F.lit(".txt")).alias("file"), "n")


@query("select votering_id, trim(rubrik) || ' är ' || trim(utskott) || ' slut' as text from c where trim(rubrik) <> '' and trim(utskott) <> ''")
def cleaned_wikitext(f: Frames) -> DataFrame:
    """Titles written as wiki markup and read back as plain text."""
    wiki = F.concat(F.lit("'''"), F.trim("rubrik"), F.lit("'''<ref name=\"a\">x</ref> är [[Sida|"), F.trim("utskott"), F.lit("]] {{mall|{{inre|{{djup}}}}}}<!-- dold -->[https://x.se slut]"))
    return f.cases.where("trim(rubrik) <> '' and trim(utskott) <> ''").select("votering_id", tx.clean_wikitext(wiki).alias("text"))


@query("select votering_id, trim(rubrik) || chr(10) || trim(rubrik) as text from c where trim(rubrik) <> '' and length(trim(rubrik)) > 4")
def cleaned_narrative(f: Frames) -> DataFrame:
    """Titles written as a page of tables and numbers, and read back as its running text."""
    page = F.concat(F.lit("<style>p{}</style><table><tr><td>Tabell 1</td></tr></table><h1>"), F.trim("rubrik"), F.lit("</h1><p>12 345,6</p>\n<p>"), F.trim("rubrik"), F.lit("</p>"))
    return f.cases.where("trim(rubrik) <> '' and length(trim(rubrik)) > 4").select("votering_id", F.trim(F.regexp_replace(tx.narrative(page), r"\s*\n\s*", "\n")).alias("text"))


_SUBST = context._SCRUBBED.replace("forslag_text", "text")
for _pattern, _by in ((tx.PARTY_TAG, ""), (tx.PARTY_NAME, "\\1partiet\\2")):
    _SUBST = f"regexp_replace({_SUBST}, '{context._q(_pattern)}', '{_by}', 'g')"


@query(_with(f"{_RES}, {_COVER}, top as (select votering_id, doc_id, row_number() over (partition by votering_id order by score desc, doc_id) as r from sc qualify r <= 3), tx as (select doc_id, any_value(text) as text from documents where text is not null group by doc_id), bd as (select doc_id, left(trim(regexp_replace({_SUBST}, '{context._WS}', ' ', 'g')), 2600) as body from tx where doc_id in (select doc_id from top)), cd as (select votering_id, list(body order by r) as candidates from top join bd using (doc_id) group by votering_id), nj as (select votering_id, arg_min(text, alt_id) as nej_demand from a1 where alt_id like 'res-%' and text is not null group by votering_id)", "select votering_id, punkt, rubrik as topic, nej_demand, candidates from c join cd using (votering_id) left join nj using (votering_id)"))
def committee_units(f: Frames) -> DataFrame:
    """One unit for each division: its topic, what the other side asks for, and the scrubbed texts that may hold the committee's answer."""
    best = documents.QUERIES["covering_documents"](f.spark, f.root).select("votering_id", "doc_id", "rank")
    texts = table(f.spark, f.root, "documents").where("text is not null").groupBy("doc_id").agg(F.any_value("text").alias("text"))
    bodies = best.join(texts, "doc_id").select("votering_id", "rank", F.substring(tx.scrub_substance(F.col("text")), 1, 2600).alias("body"))
    # three at most
    listed = bodies.groupBy("votering_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]).alias("candidates"))
    demand = _alternatives(f).where("alt_id like 'res-%' and text is not null").groupBy("votering_id").agg(F.min_by("text", "alt_id").alias("nej_demand"))
    return f.cases.join(listed, "votering_id").join(demand, "votering_id", "left").select("votering_id", "punkt", F.col("rubrik").alias("topic"), "nej_demand", "candidates")
