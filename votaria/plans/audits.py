"""Data-quality gates over derived data, and round trips of sources and sinks over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votaria import domain
from votaria.expr import day_of, key_form, period_start
from votaria.functions import text as tx
from votaria.operators import counterfactual as cf
from votaria.operators import quality as ql
from votaria.plans import context, documents
from votaria.plans import parliament as pl
from votaria.plans.context import _q
from votaria.plans.documents import _RES, _alternatives
from votaria.plans.parliament import Frames, _with
from votaria.session import shared_dir
from votaria.sources import readers, sinks
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


def _union(checks: dict[str, str], extra: str = "") -> str:
    each = " union all ".join(f"select '{name}' as name, ({sql}) as n_bad" for name, sql in checks.items())
    return _with(f"{extra}{', ' if extra else ''}k as ({each})", "select name, n_bad, n_bad = 0 as ok from k")


# ---- snapshots ----

_PERIODS = "fg as (select series, length(period) as k, left(regexp_replace(period, '[^0-9]', '', 'g'), 6) as ym, try_strptime(left(regexp_replace(vintage_date, '[^0-9]', '', 'g'), 8), '%Y%m%d')::date as v, case when length(period) = 7 then strptime(left(regexp_replace(period, '[^0-9]', '', 'g'), 6), '%Y%m')::date when length(period) = 10 then left(period, 10)::date end as p, vintage_date from indicators where length(period) in (7, 10))"


@query(_union({
    "months without snapshot": "select count(*) from (select distinct strftime(datum, '%Y%m') as ym from c where datum is not null) m where ym not in (select ym from fg)",
    "month end passed": "select count(*) from fg where v is not null and p > v and k = 7",
    "day of vintage unreadable": "select count(*) from fg where vintage_date is not null and v is null",
    "series without figures": "select count(*) from (select series from indicators group by series having count(value) = 0)",
    "monthly vintage in its own month": "select count(*) from fg where k = 7 and v is not null and strftime(v, '%Y%m') = ym",
}, _PERIODS))
def audit_snapshots(f: Frames) -> DataFrame:
    """Snapshots: every month of a division has one, vintages can be read and lie after what they tell."""
    rows = table(f.spark, f.root, "indicators").where("length(period) in (7, 10)").select("series", F.length("period").alias("k"), F.substring(F.regexp_replace("period", "[^0-9]", ""), 1, 6).alias("ym"), day_of("vintage_date").alias("v"), period_start("period").alias("p"), "vintage_date")
    months = f.cases.where("datum is not null").select(F.date_format("datum", "yyyyMM").alias("ym")).distinct()
    values = table(f.spark, f.root, "indicators").groupBy("series").agg(F.count("value").alias("n"))
    known, monthly = F.col("v").isNotNull(), F.col("k") == 7
    return ql.report([
        ql.missing("months without snapshot", months, rows, ["ym"]),
        ql.counts(rows, {"month end passed": known & monthly & (F.col("p") > F.col("v")), "day of vintage unreadable": F.col("vintage_date").isNotNull() & ~known, "monthly vintage in its own month": known & monthly & (F.date_format("v", "yyyyMM") == F.col("ym"))}),
        ql.counts(values, {"series without figures": F.col("n") == 0}),
    ])


# ---- prompts, decisions, translations ----

_LEAKY = " or ".join(f"regexp_matches(s, '{_q(p)}')" for k in ("tag", "author", "reference", "report", "division", "date") for p in tx.LEAKS[k])


@query(_union({
    "identifiers in rendered texts": f"select count(*) from (select {context._SCRUBBED} as s from c where forslag_text is not null) where {_LEAKY}",
    "repeated decision ids": "select coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from d group by run_id, cid)",
    "documents out of context": "select count(*) from d, unnest(citations) as u(x) where prompt_version = 'p6' and x.document not in ('valmanifest', 'partiprogram')",
    "ids of four parts": "select count(*) from d where len(string_split(cid, ':')) <> 4",
    "unknown parties": "select count(*) from d where parti not in (select parti from party)",
    "quotes without text": "select count(*) from d, unnest(citations) as u(x) where coalesce(trim(x.quote), '') = ''",
    "factors without effect": "select count(*) from d, unnest(omvarld.faktorer) as u(x) where omvarld.paverkar and (x.faktor is null or x.effekt is null)",
}))
def audit_decisions(f: Frames) -> DataFrame:
    """Decisions and what they were asked: no identifiers, no repeats, only documents in context, whole ids, parallel parts filled."""
    d = f.decisions
    cited = d.select("prompt_version", F.inline("citations"))
    factors = d.where("omvarld.paverkar").select(F.inline("omvarld.faktorer"))
    leaky = F.lit(False)
    for k in ("tag", "author", "reference", "report", "division", "date"):
        for p in tx.LEAKS[k]:
            leaky = leaky | F.col("s").rlike(p)
    rendered = f.cases.where("forslag_text is not null").select(tx.scrub(F.col("forslag_text")).alias("s"))
    return ql.report([
        ql.counts(rendered, {"identifiers in rendered texts": leaky}), ql.repeated("repeated decision ids", d, ["run_id", "cid"]),
        ql.counts(cited, {"documents out of context": (F.col("prompt_version") == "p6") & ~F.col("document").isin("valmanifest", "partiprogram"), "quotes without text": F.coalesce(F.trim("quote"), F.lit("")) == ""}),
        ql.counts(d, {"ids of four parts": F.size(F.split("cid", ":")) != 4, "unknown parties": ~F.col("parti").isin(list(domain.PARTIES))}),
        ql.counts(factors, {"factors without effect": F.col("faktor").isNull() | F.col("effekt").isNull()}),
    ])


@query(_union({
    "unknown areas": f"select count(*) from c left join area on area.utskott_key = upper(trim(c.utskott)) where policy_area is null",
    "month differs from day": "select count(*) from cm where kb_month is distinct from month",
    "reservations without division": "select count(*) from a1 where alt_id like 'res-%' and votering_id not in (select votering_id from c)",
    "reservations not listed": "select count(*) from a1 join (select votering_id, list_filter(regexp_split_to_array(coalesce(motforslag_nummer, ''), '[^0-9a-z]+'), lambda x: x <> '') as nos from c) q using (votering_id) where alt_id like 'res-%' and len(nos) > 0 and not list_contains(nos, substr(alt_id, 5))",
    "reservations without text": "select count(*) from a1 where alt_id like 'res-%' and coalesce(trim(text), '') = ''",
    "contested without reservation": "select count(*) from (select votering_id from p where position <> 'Frånvarande' group by votering_id having min(position) <> max(position)) q where votering_id in (select votering_id from c) and votering_id not in (select votering_id from a1 where alt_id like 'res-%')",
    "index rows without division": "select (select count(*) from c) - (select count(distinct votering_id) from c)",
    "batches of several versions": "select count(*) from (select run_id, batch_id from d where batch_id is not null group by all having count(distinct prompt_version) > 1)",
    "unknown versions": "select count(*) from d where not regexp_full_match(coalesce(prompt_version, ''), 'p[0-9]+')",
}, f"{_RES}, cm as (select kb_month, left(datum, 7) as month from cases where trim(votering_id) <> '' and datum is not null qualify row_number() over (partition by upper(trim(votering_id)) order by inkom_ts desc) = 1)").replace("cm where kb_month", "(select kb_month, strftime(datum, '%Y-%m') as month from (select upper(trim(votering_id)) as v, kb_month, left(datum, 10)::date as datum from cases where trim(votering_id) <> '' qualify row_number() over (partition by upper(trim(votering_id)) order by inkom_ts desc) = 1) where datum is not null) where kb_month"))
def audit_facts(f: Frames) -> DataFrame:
    """Derived facts: areas known, months equal to days, reservations keyed, listed and with text, contested cases with a counter-proposal, batches of one version."""
    cases = cf.with_area(f.cases, domain.areas(f.spark))
    res = _alternatives(f).where("alt_id like 'res-%'")
    listed = F.filter(F.split(F.coalesce("motforslag_nummer", F.lit("")), r"[^0-9a-z]+"), lambda x: x != "")
    keyed = res.join(f.cases.select("votering_id", listed.alias("nos")), "votering_id", "left")
    lines = f.pos.where("position <> 'Frånvarande'").groupBy("votering_id").agg((F.min("position") != F.max("position")).alias("contested")).where("contested").join(f.cases.select("votering_id"), "votering_id", "left_semi")
    batches = f.decisions.where("batch_id is not null").groupBy("run_id", "batch_id").agg(F.count_distinct("prompt_version").alias("n"))
    return ql.report([
        ql.counts(cases, {"unknown areas": F.col("policy_area") == domain.OTHER_AREA, "month differs from day": F.col("datum").isNotNull() & ~F.col("kb_month").eqNullSafe(F.col("month"))}),
        ql.counts(keyed, {"reservations without division": F.col("nos").isNull(), "reservations not listed": (F.size("nos") > 0) & ~F.array_contains("nos", F.substring("alt_id", 5, 100)), "reservations without text": F.coalesce(F.trim("text"), F.lit("")) == ""}),
        ql.missing("contested without reservation", lines, res, ["votering_id"]), ql.repeated("index rows without division", f.cases, ["votering_id"]),
        ql.counts(batches, {"batches of several versions": F.col("n") > 1}), ql.counts(f.decisions, {"unknown versions": ~F.coalesce("prompt_version", F.lit("")).rlike("^p[0-9]+$")}),
    ])


@query(_with(f"{documents._SERVED}, {documents._CONTEXT}, tx as (select cx.context, sha256(string_agg(sv.document || '=' || sv.slug, '|' order by sv.document, sv.slug)) as digest from cx join sv using (prompt_version, votering_id, parti) where cx.prompt_version = 'p6' group by cx.context, cx.votering_id, cx.parti)", "select context, count(*) as n, count(distinct digest) as n_texts, count(distinct digest) = 1 as ok from tx group by context"))
def single_contexts(f: Frames) -> DataFrame:
    """Whether all divisions of a context are served the same documents, by the digest of what is rendered."""
    named = documents._contexts(f).where("prompt_version = 'p6'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document", "slug"))), lambda x: F.concat(x["document"], F.lit("="), x["slug"])), "|")
    shown = documents._served(f).join(named, ["prompt_version", "votering_id", "parti"]).groupBy("context", "votering_id", "parti").agg(F.sha2(text, 256).alias("digest"))
    return shown.groupBy("context").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("n_texts")).withColumn("ok", F.col("n_texts") == 1)


# ---- round trips ----


def _place(f: Frames, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(f.spark)}/{name}-{uuid.uuid4().hex}"


@query("select votering_id, parti, run_id, rost, hallning, [x.document for x in citations] as documents from d where citations is not null".replace("[x.document for x in citations]", "list_transform(citations, lambda x: x.document)"))
def decisions_as_lines(f: Frames) -> DataFrame:
    """Decisions written as lines of JSON, and read again from files that may hold lists, objects or lines."""
    place = _place(f, "lines")
    sinks.write_lines(f.decisions.where("citations is not null").select("cid", "votering_id", "parti", "run_id", "rost", "hallning", F.transform("citations", lambda c: F.struct(c["document"].alias("document"), c["slug"].alias("slug"), c["quote"].alias("quote"), c["princip"].alias("princip"), c["svag"].alias("svag"))).alias("citations")), place)
    rows = readers.tolerant_records(f.spark, place)
    return rows.select("votering_id", "parti", "run_id", "rost", "hallning", F.transform("citations", lambda c: c["document"]).alias("documents"))


@query("select votering_id, rm, beteckning, punkt, utskott from c")
def cases_as_csv(f: Frames) -> DataFrame:
    """Cases written as CSV without nested columns, and read again."""
    place = _place(f, "csv")
    sinks.write_csv(f.cases.select("votering_id", "rm", "beteckning", "punkt", "utskott", F.array("rm").alias("nested")), place)
    return f.spark.read.option("header", True).schema("votering_id string, rm string, beteckning string, punkt int, utskott string").csv(place)


@query("select dok_id, titel, organ from (select upper(trim(dok_id)) as dok_id, titel, organ, row_number() over (partition by upper(trim(dok_id)) order by inkom_ts desc) as r from dokstatus where trim(dok_id) <> '') where r = 1")
def reports_as_documents(f: Frames) -> DataFrame:
    """Reports written as one JSON document each into a shared folder, and read again."""
    place = _place(f, "documents")
    sinks.write_documents(pl.QUERIES["current_reports"](f.spark, f.root).select("dok_id", "titel", "organ"), "dok_id", place)
    return readers.json_documents(f.spark, place, "dok_id string, titel string, organ string")


@query("select votering_id, vinnare, month from c")
def replaced_table(f: Frames) -> DataFrame:
    """A table replaced by a new version in one step, read through its pointer."""
    place = _place(f, "table")
    sinks.replace_table(f.cases.select("votering_id", "vinnare", "month").where("month < '2023'"), place)
    sinks.replace_table(f.cases.select("votering_id", "vinnare", "month"), place)
    return sinks.read_current(f.spark, place)


@query("select run_id, count(*) as n from d group by run_id")
def ingested_decisions(f: Frames) -> DataFrame:
    """Decisions appended twice, keyed by id and partitioned by run: the second time adds none."""
    place = _place(f, "ingest")
    rows = f.decisions.select("run_id", "cid", "rost", "inkom_ts")
    sinks.append_new(rows, place, ["run_id", "cid"], F.col("inkom_ts"), "run_id")
    sinks.append_new(rows, place, ["run_id", "cid"], F.col("inkom_ts"), "run_id")
    return f.spark.read.parquet(place).groupBy("run_id").agg(F.count("*").alias("n"))


@query("select slug, text from (select slug, string_agg(trim(text), chr(10) order by seq, block_id) as text from (select distinct slug, seq, block_id, text from docblocks where kind in ('heading', 'subheading') and slug is not null and trim(text) <> '') group by slug)")
def headings_as_text(f: Frames) -> DataFrame:
    """Headings of each document written as a text, and read again as whole files."""
    rows = table(f.spark, f.root, "docblocks").where("kind in ('heading', 'subheading') and slug is not null and trim(text) <> ''").select("slug", "seq", "block_id", "text").distinct()
    # a document's headings
    whole = rows.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block_id", F.trim("text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    place = _place(f, "texts")
    whole.select(F.to_json(F.struct("slug", "text")).alias("value")).write.text(place)
    return f.spark.read.schema("slug string, text string").json(place)


@query(_with("m as (select series, left(regexp_replace(period, '[^0-9]', '', 'g'), 6) as ym, max_by(value, obs_id) as value from indicators where length(period) = 7 and value is not null and series is not null group by all)", "select ym[:4] || '-' || ym[5:] as period, value from m"))
def figures_as_json_stat(f: Frames) -> DataFrame:
    """Monthly figures written as a cube of positions and values for each series, and decoded again."""
    rows = table(f.spark, f.root, "indicators").where("length(period) = 7 and value is not null and series is not null").select("series", period_start("period").alias("m"), "value", "obs_id")
    one = rows.groupBy("series", "m").agg(F.max_by("value", "obs_id").alias("value"))
    at = F.row_number().over(Window.partitionBy("series").orderBy("m")) - 1
    # a calendar of months for each series
    cube = one.withColumn("i", at).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("i", F.date_format("m", "yyyy'M'MM").alias("p"), "value"))).alias("l"))
    index = F.map_from_entries(F.transform("l", lambda x: F.struct(x["p"], x["i"])))
    text = F.to_json(F.struct(F.struct(F.struct(F.struct(index.alias("index")).alias("category")).alias("Tid")).alias("dimension"), F.transform("l", lambda x: x["value"]).alias("value")))
    place = _place(f, "cubes")
    cube.select("series", text.alias("value")).repartition("series").write.partitionBy("series").text(place)
    return readers.json_stat(f.spark, f"{place}/*/*.txt", "Tid")


@query("select split_part(period, '-', 1) as year, count(*) as n from indicators where length(period) = 10 and value is not null group by all")
def figures_as_rows(f: Frames) -> DataFrame:
    """Daily figures written as rows of keys and values, those without a number as two dots, and read again without them."""
    rows = table(f.spark, f.root, "indicators").where("length(period) = 10")
    one = rows.select(F.to_json(F.struct(F.array("series", "period").alias("key"), F.array(F.coalesce(F.col("value").cast("string"), F.lit(".."))).alias("values"))).alias("r"), F.pmod(F.xxhash64("obs_id"), F.lit(8)).alias("g"))
    place = _place(f, "rows")
    one.groupBy("g").agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value")).drop("g").repartition(8).write.text(place)
    figures = readers.pxweb(f.spark, f"{place}/*.txt")
    return figures.groupBy(F.substring_index(F.get("keys", F.lit(1)), "-", 1).alias("year")).agg(F.count("*").alias("n"))


@query("select case when reason is null then 'good' else reason end as verdict, count(*) as n from (select votering_id, case when any_value(k) is null then 'no case' when any_value(t) is null then 'no text' end as reason from vw left join (select votering_id, 1 as k, case when trim(forslag_text) <> '' then 1 end as t from c) using (votering_id) group by votering_id) group by all")
def quarantined(f: Frames) -> DataFrame:
    """Divisions written apart by whether they can become cases, and both parts counted."""
    from votaria.operators import roll

    good, bad = _place(f, "good"), _place(f, "bad")
    sinks.quarantine(roll.split_orphans(roll.divisions(f.votes.distinct()), f.cases).select("votering_id", "reason"), "reason", good, bad)
    read = lambda p, c: f.spark.read.parquet(p).select(c.alias("verdict"))
    return read(good, F.lit("good")).union(read(bad, F.col("reason"))).groupBy("verdict").agg(F.count("*").alias("n"))


@query("select key_form, count(*) as n from (select upper(trim(votering_id)) as key_form from alternatives where trim(votering_id) <> '') group by all")
def alternative_counts(f: Frames) -> DataFrame:
    """Rows of alternatives per division."""
    return table(f.spark, f.root, "alternatives").select(key_form("votering_id").alias("key_form")).where("key_form is not null").groupBy("key_form").agg(F.count("*").alias("n"))


# ---- streams ----


def _streamed(f: Frames, rows: DataFrame, parts: int = 4) -> tuple[DataFrame, str]:
    """The rows as a stream of files in the shared folder, and a folder for what comes of it."""
    from votaria.streaming import flows

    source = _place(f, "stream")
    rows.repartition(parts).write.parquet(source)
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    return flows.file_stream(f.spark, source, schema, "parquet"), _place(f, "streamed")


def _finished(f: Frames, stream: DataFrame, place: str) -> DataFrame:
    """The state of an aggregating stream when all its files are read."""
    written = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(place)).option("checkpointLocation", f"{place}-checkpoint").trigger(availableNow=True)
    written.start().awaitTermination()
    return f.spark.read.parquet(place)


@query("select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(avg(value), 3) as mean from events where ts is not null group by all")
def streamed_days(f: Frames) -> DataFrame:
    """Events in tumbling windows of a day, as a stream with a watermark."""
    from votaria.streaming import flows

    stream, place = _streamed(f, table(f.spark, f.root, "events").where("ts is not null").select("ts", "event_type", "value"))
    done = _finished(f, flows.tumbling(stream, "ts", "1 day", "31 days", ["event_type"], "value"), place)
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 3).alias("mean"))


@query("select run_id, max(usage['output_tokens']) as most from d where usage is not null group by run_id")
def streamed_usage(f: Frames) -> DataFrame:
    """The greatest output of each run, kept as the state of a stream."""
    from votaria.streaming import flows

    stream, place = _streamed(f, f.decisions.where("usage is not null").select("run_id", F.element_at("usage", "output_tokens").alias("most")))
    return _finished(f, flows.latest_usage(stream, ["run_id"], "most"), place)


@query("select run_id, count(*) as n from d group by run_id")
def streamed_ingest(f: Frames) -> DataFrame:
    """Decisions delivered twice by a stream and appended once each."""
    from votaria.streaming import flows

    once = f.decisions.select("run_id", "cid", "rost", "inkom_ts")
    stream, place = _streamed(f, once.union(once))
    flows.ingest(stream, place, ["run_id", "cid"], "inkom_ts", f"{place}-checkpoint").awaitTermination()
    return f.spark.read.parquet(place).groupBy("run_id").agg(F.count("*").alias("n"))


@query(_with("dn as (select distinct votering_id, parti from d where run_id = 'run-p6-1')", "select parti, count(*) as n from c, party where not exists (select 1 from dn where dn.votering_id = c.votering_id and dn.parti = party.parti) group by parti"))
def streamed_pending(f: Frames) -> DataFrame:
    """Issued work as a stream, without what a run has already decided, counted per party."""
    from votaria.streaming import flows

    issued = f.cases.select("votering_id").crossJoin(F.broadcast(f.parties.select("parti")))  # eight parties
    stream, place = _streamed(f, issued)
    wanted = flows.still_wanted(stream, f.decisions.where("run_id = 'run-p6-1'"), ["votering_id", "parti"])
    wanted.writeStream.format("parquet").option("path", place).option("checkpointLocation", f"{place}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f.spark.read.schema("votering_id string, parti string").parquet(place).groupBy("parti").agg(F.count("*").alias("n"))
