"""Queries on point-in-time context, citations, work queues, texts, browsing and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votaria import domain
from votaria.expr import day_number, day_of, key_form, period_start, rounded
from votaria.functions import text as tx
from votaria.operators import match
from votaria.operators import quality as ql
from votaria.operators.shape import capped, forward_fill
from votaria.plans import parliament as pl
from votaria.plans.parliament import Frames, _with
from votaria.session import cut
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


# ---- as-of and windows in time ----

_EDITIONS = "ed as (select slug, upper(parti) as parti, document, make_date(regexp_extract(slug, '-(\\d{4})-', 1)::int, 1, 1) as start from (select distinct slug, parti, document from docblocks where slug is not null))"


def _editions(f: Frames) -> DataFrame:
    rows = table(f.spark, f.root, "docblocks").where("slug is not null").select("slug", F.upper("parti").alias("parti"), "document").distinct()
    return rows.withColumn("start", F.try_to_timestamp(F.concat(F.regexp_extract("slug", r"-(\d{4})-", 1), F.lit("0101")), F.lit("yyyyMMdd")).cast("date"))


def _probes(f: Frames) -> DataFrame:
    return f.pos.select("votering_id", "parti").join(f.cases.where("datum is not null").select("votering_id", "datum"), "votering_id").withColumn("day", F.unix_date("datum"))


def _edition_sql(condition: str, extra: str = "") -> str:
    return _with(f"{_EDITIONS}, one as (select parti, document, start, max(slug) as slug from ed group by all), pr as (select votering_id, parti, datum from p join c using (votering_id) where datum is not null)", f"select votering_id, parti, document, slug from pr join one using (parti) where {condition} qualify row_number() over (partition by votering_id, parti, document order by start desc) = 1 {extra}")


def _edition(f: Frames, **options) -> DataFrame:
    held = match.versions(_editions(f).select("parti", "document", "slug", "start"), ["parti", "document"], "start").drop("start")
    return match.asof_version(_probes(f), held, "day", ["parti"], **options).select("votering_id", "parti", "document", "slug")


@query(_edition_sql("start <= datum"))
def edition_in_force(f: Frames) -> DataFrame:
    """Each party's edition of each document in force on the day of the division (as-of, inclusive)."""
    return _edition(f)


@query(_edition_sql("start < datum and date_diff('day', start, datum) <= 1500").replace("where start < datum and date_diff('day', start, datum) <= 1500", "where start < datum").replace("select votering_id, parti, document, slug from pr", "select votering_id, parti, document, slug from (select * from pr").replace("order by start desc) = 1 ", "order by start desc) = 1) where date_diff('day', start, datum) <= 1500"))
def edition_strict_recent(f: Frames) -> DataFrame:
    """The edition that began before the day, unless it is older than 1,500 days (strict, bounded staleness)."""
    return _edition(f, strict=True, most_days=1500)


@query(_with(f"{_EDITIONS}, one as (select parti, document, start, max(slug) as slug from ed group by all), pr as (select votering_id, parti, datum from p join c using (votering_id) where datum is not null)", "select votering_id, parti, document, slug from pr join one using (parti) qualify row_number() over (partition by votering_id, parti, document order by start <= datum desc, case when start <= datum then start end desc nulls last, start) = 1"))
def edition_or_first(f: Frames) -> DataFrame:
    """The edition in force, or the first one before there was any."""
    return _edition(f, fallback_first=["parti", "document"])


def _daily(f: Frames) -> DataFrame:
    rows = table(f.spark, f.root, "indicators").where("value is not null and length(period) = 10")
    return rows.select("series", "value", "obs_id", day_number(period_start("period")).alias("at"))


@query(_with("x as (select series, value, left(period, 10)::date as dy from indicators where value is not null and length(period) = 10)", "select votering_id, series, count(*) as n, round(avg(value), 6) as mean_30d, max(dy) as last_day from c join x on x.dy < c.datum and x.dy >= c.datum - 30 where c.datum is not null group by votering_id, series"))
def trailing_means(f: Frames) -> DataFrame:
    """Mean of each daily series over the 30 days before each division."""
    probes = f.cases.where("datum is not null").select("votering_id", F.unix_date("datum").alias("day"))
    pairs = match.within_window(probes, _daily(f), [], "day", "at", 30)
    return pairs.groupBy("votering_id", "series").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_30d"), F.date_from_unix_date(F.max("at")).alias("last_day"))


@query(_with("m as (select series, left(regexp_replace(period, '[^0-9]', '', 'g'), 6) as ym, value, obs_id from indicators where value is not null and (length(period) = 7)), o as (select series, strptime(ym, '%Y%m')::date as month, max_by(value, obs_id) as value from m group by all)", "select a.series, strftime(a.month, '%Y-%m') as month, a.value, b.value as lag_1, d.value as lag_12, round(a.value - b.value, 6) as change from o a left join o b on b.series = a.series and b.month = a.month - interval 1 month left join o d on d.series = a.series and d.month = a.month - interval 12 month"))
def lagged_months(f: Frames) -> DataFrame:
    """Each monthly figure beside those of one and twelve months before (equi-joins on shifted keys)."""
    rows = table(f.spark, f.root, "indicators").where("value is not null and length(period) = 7").select("series", period_start("period").alias("month"), "value", "obs_id")
    one = rows.groupBy("series", "month").agg(F.max_by("value", "obs_id").alias("value"))
    lag = lambda n: one.select("series", F.add_months("month", n).cast("date").alias("month"), F.col("value").alias(f"lag_{n}"))
    joined = one.join(lag(1), ["series", "month"], "left").join(lag(12), ["series", "month"], "left")
    return joined.select("series", F.date_format("month", "yyyy-MM").alias("month"), "value", "lag_1", "lag_12", F.round(F.col("value") - F.col("lag_1"), 6).alias("change"))


@query(_with("q as (select series, strptime(left(regexp_replace(period, '[^0-9]', '', 'g'), 6), '%Y%m')::date as month, obs_id, value from indicators where length(period) = 7), g as (select series, month, max_by(value, obs_id) as value from q group by all), sp as (select s.series, m.month from (select distinct series from g) s cross join (select distinct month from g) m)", "select series, strftime(month, '%Y-%m') as month, last_value(value ignore nulls) over (partition by series order by month rows unbounded preceding) as value from sp left join g using (series, month)"))
def filled_series(f: Frames) -> DataFrame:
    """Monthly series on a dense calendar, gaps filled with the last known figure."""
    rows = table(f.spark, f.root, "indicators").where("length(period) = 7").select("series", period_start("period").alias("month"), "value", "obs_id")
    one = rows.groupBy("series", "month").agg(F.max_by("value", "obs_id").alias("value"))
    spine = one.select("series").distinct().crossJoin(F.broadcast(one.select("month").distinct()))  # series by months: dimensions
    return forward_fill(spine.join(one, ["series", "month"], "left"), ["series"], "month", ["value"]).select("series", F.date_format("month", "yyyy-MM").alias("month"), "value")


@query(_with("x as (select votering_id, parti, source, doc_id, row_number() over (partition by votering_id, source order by n_chars desc, doc_id) as a from (select upper(trim(c.votering_id)) as votering_id, doc_id, n_chars, lower(trim(source)) as source, parti from c join documents on upper(trim(documents.dok_id)) = c.dok_id where source is not null)), y as (select *, row_number() over (partition by votering_id order by a, source, doc_id) as b from x where a <= 2)", "select votering_id, source, doc_id from y where b <= 5"))
def capped_context(f: Frames) -> DataFrame:
    """Documents of each division's report: two of each source at most, five in all (a capped context)."""
    docs = table(f.spark, f.root, "documents").where("source is not null").select(key_form("dok_id").alias("dok_id"), "doc_id", "n_chars", F.lower(F.trim("source")).alias("source")).where("dok_id is not null")
    # the caps depend on the report alone: they come before the join, so a large report is five rows in it
    two = docs.withColumn("a", F.row_number().over(Window.partitionBy("dok_id", "source").orderBy(F.desc("n_chars"), "doc_id"))).where("a <= 2")
    five = capped(two, ["dok_id"], [F.col("a"), F.col("source"), F.col("doc_id")], 5)
    return f.cases.select("votering_id", "dok_id").join(five, "dok_id").select("votering_id", "source", "doc_id")


# ---- citations ----

_CIT = "ct as (select distinct run_id, cid, x.cite_id, x.slug, x.document, x.quote from (select run_id, cid, unnest(citations) as x from d))"


def _citations(f: Frames, decisions: DataFrame | None = None) -> DataFrame:
    return (f.decisions if decisions is None else decisions).select("run_id", "cid", F.inline("citations")).select("run_id", "cid", "cite_id", "slug", "document", "quote").distinct()


def _blocks(f: Frames) -> DataFrame:
    return table(f.spark, f.root, "docblocks").where("kind = 'para' and slug is not null").select("slug", "text")


# blanks of any kind, as the engine's Unicode class has them
_WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{0b}\x{1c}-\x{1f}]+"
# composed, collapsed and case-folded (the folds that differ from lower case and occur here)
_KEY = "replace(replace(replace(lower(trim(regexp_replace(nfc_normalize({0}), '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))), 'ς', 'σ'), 'ß', 'ss'), 'µ', 'μ')"
for _a, _b in tx.LIGATURES.items():
    _KEY = f"replace({_KEY}, '{_a}', '{_b}')"


@query(_with(f"{_CIT}, h as (select distinct ct.slug, ct.quote from ct join docblocks b on b.slug = ct.slug and b.kind = 'para' where trim(ct.quote) <> '' and contains({_KEY.format('b.text')}, {_KEY.format('ct.quote')}))", "select ct.run_id, ct.cid, ct.cite_id, h.slug is not null as verbatim from ct left join h using (slug, quote)"))
def verbatim_citations(f: Frames) -> DataFrame:
    """Whether each quote stands word for word in a paragraph of its document."""
    return match.verbatim(_citations(f), _blocks(f), ["slug"], "quote", "text").select("run_id", "cid", "cite_id", "verbatim")


#: Quotes of a document searched by one row; the document is shuffled once for so many.
QUOTES_AT_ONCE = 8
#: The ratio from which a span stands in for a quote; lower ones are not looked for.
LEAST_RATIO = 0.75
#: Words of a document in one segment.
SEGMENT_WORDS = 20_000


def quote_verdicts(f: Frames, decisions: DataFrame | None = None) -> DataFrame:
    """``slug, quote, verbatim, span, ratio`` of each distinct quote; the nearest span of its document where it is not verbatim."""
    quotes = cut(_citations(f, decisions).where("trim(quote) <> ''").select("slug", "quote").distinct())
    checked = cut(match.verbatim(quotes, _blocks(f), ["slug"], "quote", "text"))
    missed = checked.where("not verbatim and slug is not null").select("slug", "quote")
    # whole documents are searched, in overlapping segments: a document's paragraphs in order, beside some of its quotes at a time
    paras = table(f.spark, f.root, "docblocks").where("kind = 'para' and slug is not null and text is not null").select("slug", "page", "seq", "block_id", "text").distinct()
    widest = missed.agg(F.coalesce(F.max(F.size(F.split("quote", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    parts = match.segments(paras, ["slug"], [F.col("page"), F.col("seq"), F.col("block_id"), F.col("text")], "text", SEGMENT_WORDS, widest + 8)
    group = F.pmod(F.xxhash64("quote"), F.greatest(F.lit(1), F.ceil(F.col("n") / QUOTES_AT_ONCE)))
    many = missed.groupBy("slug").agg(F.count("*").alias("n"))
    groups = missed.join(many, "slug").withColumn("group", group).groupBy("slug", "group").agg(F.collect_list("quote").alias("quotes")).join(parts, "slug")
    # few bytes, much work: keep one task per core, which adaptive execution would merge
    groups = groups.repartition(max(f.spark.sparkContext.defaultParallelism, int(f.spark.conf.get("spark.sql.shuffle.partitions"))), "slug", "group", "segment")
    found = groups.select("slug", "segment", F.explode(match.closest_spans("quotes", "text", LEAST_RATIO)).alias("found"))
    best = F.max_by(F.struct("found.span", F.round("found.ratio", 4).alias("ratio")), F.struct("found.ratio", -F.col("segment")))
    spans = found.groupBy("slug", F.col("found.quote").alias("quote")).agg(best.alias("b")).select("slug", "quote", "b.span", "b.ratio")
    return checked.join(spans, ["slug", "quote"], "left")


@query()
def repaired_citations(f: Frames) -> DataFrame:
    """Quotes that are not verbatim, with the closest span of their document and the verdict; the ratio is 0 where no span reaches 0.75."""
    rows = _citations(f).where("trim(quote) <> ''").join(quote_verdicts(f).where("not verbatim").withColumnsRenamed({"slug": "_slug", "quote": "_quote"}), F.col("slug").eqNullSafe(F.col("_slug")) & (F.col("quote") == F.col("_quote")))
    return rows.select("run_id", "cid", "cite_id", F.when(F.col("ratio") >= 0.75, F.col("span")).alias("span"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.when(F.col("ratio") >= 0.75, "corrected").otherwise("unverifiable").alias("verdict"))


# Invented broad phrases, per kind of document.
PHRASES = [("partiprogram", "står inför stora prov"), ("valmanifest", "väntas vara klar"), ("avtal", "inte minst för")]
_PHRASES = ", ".join(f"('{d}', '{p}')" for d, p in PHRASES)


@query(_with(f"{_CIT}, ph(document, phrase) as (values {_PHRASES})", f"select run_id, cid, count(*) as n_cites, count(*) filter (exists (select 1 from ph where ph.document = ct.document and trim(ct.quote) <> '' and (contains({_KEY.format('ct.quote')}, ph.phrase) or contains(ph.phrase, {_KEY.format('ct.quote')})))) as n_weak from ct group by run_id, cid"))
def weak_citations(f: Frames) -> DataFrame:
    """Citations that quote a listed broad phrase, per decision."""
    phrases = f.spark.createDataFrame(PHRASES, "document string, phrase string")
    marked = match.phrase_match(_citations(f), phrases, "document", "quote", "weak")
    return marked.groupBy("run_id", "cid").agg(F.count("*").alias("n_cites"), F.count_if("weak").alias("n_weak"))


@query("select run_id, cid, list_transform(list_filter(citations, lambda x: x.document <> 'avtal'), lambda x: x.cite_id) as kept, case when len(list_filter(citations, lambda x: x.document = 'avtal')) > 0 then list_concat(coalesce(flags, []), ['citat_blockerat']) else coalesce(flags, []) end as flags from (select run_id, cid, citations, list_filter(flags, lambda x: x <> 'citat_blockerat') as flags from d) where citations is not null")
def stripped_citations(f: Frames) -> DataFrame:
    """Decisions without the citations of one kind of document; a flag tells which lost some."""
    blocked = F.exists("citations", lambda c: c["document"] == "avtal")
    kept = F.transform(F.filter("citations", lambda c: c["document"] != "avtal"), lambda c: c["cite_id"])
    return f.decisions.where("citations is not null").select("run_id", "cid", kept.alias("kept"), match.with_flag(F.col("flags"), "citat_blockerat", blocked).alias("flags"))


@query(_with(_CIT, "select document, regexp_extract(cid, '^[^:]*') as parti, count(*) as n_cites, count(distinct slug) as n_docs, round(count(*)::double / sum(count(*)) over (partition by regexp_extract(cid, '^[^:]*')), 4) as share from ct group by document, regexp_extract(cid, '^[^:]*')"))
def citation_profile(f: Frames) -> DataFrame:
    """Citations per kind of document and party, with the share of the party's citations."""
    rows = _citations(f).withColumn("parti", F.substring_index("cid", ":", 1)).groupBy("document", "parti").agg(F.count("*").alias("n_cites"), F.count_distinct("slug").alias("n_docs"))
    return rows.withColumn("share", F.round(F.col("n_cites") / F.sum("n_cites").over(Window.partitionBy("parti")), 4))


# ---- work queues ----


@query(_with("dn as (select distinct votering_id, parti from d where run_id = 'run-p6-1')", "select c.votering_id, party.parti from c, party where not exists (select 1 from dn where dn.votering_id = c.votering_id and dn.parti = party.parti)"))
def pending_work(f: Frames) -> DataFrame:
    """Divisions by party that a run has not decided."""
    wanted = f.cases.select("votering_id").crossJoin(F.broadcast(f.parties.select("parti")))  # eight parties
    return match.pending(wanted, f.decisions.where("run_id = 'run-p6-1'"), ["votering_id", "parti"])


@query("select run_id, count(*) as total, count(distinct votering_id) as n_divisions, min(collected_at) as first_at, max(collected_at) as last_at from d group by run_id")
def run_progress(f: Frames) -> DataFrame:
    """Decisions collected per run."""
    return f.decisions.groupBy("run_id").agg(F.count("*").alias("total"), F.count_distinct("votering_id").alias("n_divisions"), F.min("collected_at").alias("first_at"), F.max("collected_at").alias("last_at"))


@query("select reason, count(*) as n from (select case when trim(votering_id) = '' or votering_id is null then 'no id' when upper(trim(parti)) not in (select parti from party) or parti is null then 'unknown party' when upper(trim(votering_id)) not in (select votering_id from c) then 'unknown division' when rost not in ('Ja', 'Nej', 'Avstår') or rost is null then 'bad vote' when row_number() over (partition by run_id, upper(trim(parti)), upper(trim(votering_id)), prompt_version, coalesce(arm, 'anonymous') order by inkom_ts) > 1 then 'repeated' else 'ok' end as reason from decisions) group by reason")
def ingest_verdicts(f: Frames) -> DataFrame:
    """What an ingest of the decisions accepts, and why it rejects the rest."""
    rows = table(f.spark, f.root, "decisions").withColumns({"k": key_form("votering_id"), "pt": key_form("parti"), "arm": F.coalesce("arm", F.lit("anonymous"))})
    rows = rows.join(f.cases.select(F.col("votering_id").alias("k"), F.lit(True).alias("known")), "k", "left")
    nth = F.row_number().over(Window.partitionBy("run_id", "pt", "k", "prompt_version", "arm").orderBy("inkom_ts"))
    good_party, good_vote = F.coalesce(F.col("pt").isin(list(domain.PARTIES)), F.lit(False)), F.coalesce(F.col("rost").isin(domain.CAST), F.lit(False))
    reason = F.when(F.col("k").isNull(), "no id").when(~good_party, "unknown party").when(F.col("known").isNull(), "unknown division").when(~good_vote, "bad vote").when(nth > 1, "repeated").otherwise("ok")
    return rows.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n"))


@query("select run_id, model, count(*) as n, sum(usage['input_tokens'])::bigint as input_tokens, sum(usage['output_tokens'])::bigint as output_tokens, date_diff('second', min(inkom_ts), max(inkom_ts)) as wall_s from d group by run_id, model")
def metering(f: Frames) -> DataFrame:
    """Tokens and elapsed time per run and model."""
    wall = F.unix_timestamp(F.date_trunc("second", F.max("inkom_ts"))) - F.unix_timestamp(F.date_trunc("second", F.min("inkom_ts")))
    return f.decisions.groupBy("run_id", "model").agg(F.count("*").alias("n"), F.sum(F.element_at("usage", "input_tokens")).alias("input_tokens"), F.sum(F.element_at("usage", "output_tokens")).alias("output_tokens"), wall.alias("wall_s"))


# ---- texts ----

def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_SCRUBBED = "forslag_text"
for _pattern, _by in ((tx.AUTHOR_CLAUSE, ""), (tx.AUTHOR_CODE, "\\1"), (tx.DOCUMENT_REF, "\\1[nr]"), (tx.DATE, "\\1[datum]")):
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_q(_pattern)}', '{_by}', 'g')"


@query(f"select votering_id, {_SCRUBBED} as text from c where forslag_text is not null")
def scrubbed(f: Frames) -> DataFrame:
    """Proposals without author clauses, document numbers and dates."""
    return f.cases.select("votering_id", "forslag_text").where("forslag_text is not null").select("votering_id", tx.scrub(F.col("forslag_text")).alias("text"))


@query(f"select kind, count(*) as n from (select case when regexp_matches(forslag_text, '{tx.BUDGET}') or trim(beteckning) = '{tx.BUDGET_REPORT}' then 'budget' when regexp_matches(forslag_text, '{tx.BILL}') then 'proposition' when regexp_matches(forslag_text, '{tx.MOTION}') then 'motion' else 'other' end as kind from c) group by kind")
def proposal_kinds(f: Frames) -> DataFrame:
    """Proposals by class."""
    return f.cases.select(tx.proposal_kind(F.col("forslag_text"), F.col("beteckning")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"select votering_id, list_filter(ids, lambda x, i: list_position(ids, x) = i) as ids from (select votering_id, regexp_extract_all(forslag_text, '{tx.MOTION_REF}') as ids from c where forslag_text is not null) where len(ids) > 0")
def motion_numbers(f: Frames) -> DataFrame:
    """Motion numbers of each proposal that names any, in order of appearance."""
    rows = f.cases.select("votering_id", "forslag_text").select("votering_id", tx.motion_ids(F.col("forslag_text")).alias("ids"))
    return rows.where("size(ids) > 0")


_LEAK = "case " + " ".join(f"when {' or '.join(f'regexp_matches(forslag_text, {chr(39)}{_q(p)}{chr(39)})' for p in patterns)} then '{name}'" for name, patterns in tx.LEAKS.items()) + " end"


@query(f"select leak, count(*) as n from (select {_LEAK} as leak from c where forslag_text is not null) group by leak")
def leak_labels(f: Frames) -> DataFrame:
    """What gives proposals away."""
    return f.cases.select("forslag_text").where("forslag_text is not null").select(tx.leak_label(F.col("forslag_text")).alias("leak")).groupBy("leak").agg(F.count("*").alias("n"))


@query("select votering_id, case when length(rubrik) <= 20 then rubrik else regexp_replace(left(rubrik, 19), ' [^ ]*$', '') || '…' end as short from c where rubrik is not null")
def short_titles(f: Frames) -> DataFrame:
    """Titles cut at a word."""
    return f.cases.where("rubrik is not null").select("votering_id", tx.shorten(F.col("rubrik"), 20).alias("short"))


@query("select kind, n_blocks, parti from (select kind, count(*) as n_blocks, list_filter(string_split(upper(slug), '-'), lambda x: x in (" + ", ".join(f"'{p}'" for p in domain.PARTIES) + "))[1] as parti from (select distinct slug, kind, block_id from docblocks) group by all)")
def blocks_by_party(f: Frames) -> DataFrame:
    """Blocks by kind and the party in their slug."""
    rows = table(f.spark, f.root, "docblocks").select("slug", "kind", "block_id").distinct()
    return rows.groupBy("kind", tx.party_of_slug(F.col("slug")).alias("parti")).agg(F.count("*").alias("n_blocks"))


# ---- browsing ----

_GAPS = "f.implied is not null and f.position in ('Ja', 'Nej') and f.implied <> f.position"
_INDEX = f"ix as (select c.votering_id, c.datum, c.month, c.utskott, c.rubrik, lower(concat_ws(' ', c.rubrik, c.rm, c.beteckning, c.utskott)) as search, list(f.parti order by seat_order, f.cid) filter ({_GAPS}) as miss, list(f.parti order by seat_order, f.cid) filter ({_GAPS} and f.tier = 'explicit') as missx, count(f.cid) as compared, count(f.cid) filter (f.agree) as agree from c left join (select f.*, party.seat_order from f join party using (parti)) f on f.votering_id = c.votering_id and f.arm = 'anonymous' and f.run_id = 'run-p6-1' group by all)"


def _index(f: Frames) -> DataFrame:
    facts = f.facts.where("arm = 'anonymous' and run_id = 'run-p6-1'").join(F.broadcast(f.parties.select("parti", "seat_order")), "parti")
    gap = F.col("implied").isNotNull() & F.col("position").isin(domain.DECIDED) & (F.col("implied") != F.col("position"))
    # parties in the order of their seats
    seated = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("seat_order", "cid", "parti")))), lambda x: x["parti"])
    per = facts.groupBy("votering_id").agg(seated(gap).alias("miss"), seated(gap & (F.col("tier") == "explicit")).alias("missx"), F.count("*").alias("compared"), F.count_if("agree").alias("agree"))
    rows = f.cases.select("votering_id", "datum", "month", "utskott", "rubrik", tx.search_blob(F.col("rubrik"), F.col("rm"), F.col("beteckning"), F.col("utskott")).alias("search")).join(per, "votering_id", "left")
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    return rows.withColumns({"miss": full("miss"), "missx": full("missx"), "compared": F.coalesce("compared", F.lit(0)), "agree": F.coalesce("agree", F.lit(0))})


@query(_with(_INDEX, "select * from ix"))
def case_index(f: Frames) -> DataFrame:
    """The lean row of each division that a browser filters on; empty lists are null."""
    return _index(f)


@query(_with(_INDEX, "select parti, count(*) as n from (select unnest(miss) as parti from ix where month like '2024%' and contains(search, 'u')) group by parti"))
def facet_counts(f: Frames) -> DataFrame:
    """Per party, divisions that match all other filters."""
    return _index(f).where("month like '2024%' and contains(search, 'u')").select(F.explode("miss").alias("parti")).groupBy("parti").agg(F.count("*").alias("n"))


@query(_with(_INDEX, "select votering_id, datum, rubrik from ix where utskott = 'EnU' order by datum desc nulls last, votering_id limit 20 offset 20"))
def second_page(f: Frames) -> DataFrame:
    """The second page of twenty of one committee's divisions, newest first (pagination is the feature)."""
    return _index(f).where("utskott = 'EnU'").select("votering_id", "datum", "rubrik").orderBy(F.desc_nulls_last("datum"), "votering_id").offset(20).limit(20)


# ---- quality ----


@query(_with("k as (select 'vote values' as name, count(*) as n_bad from votes where rost is null or lower(trim(rost)) not in ('ja', 'nej', 'avstår', 'frånvarande') union all select 'id length', count(*) from votes where votering_id is null or length(trim(votering_id)) <> 36 union all select 'members per division', count(*) from (select votering_id from v group by votering_id having count(distinct intressent_id) > 349) union all select 'seats', count(*) from (select votering_id from p group by votering_id having sum(seats) > 349) union all select 'position values', count(*) from p where position not in ('Ja', 'Nej', 'Avstår', 'Frånvarande') union all select 'cases without text', count(*) from c where forslag_text is null or trim(forslag_text) = '' union all select 'month length', count(*) from c where month is null or length(month) <> 7 union all select 'positions without case', count(*) from (select distinct votering_id from p) where votering_id not in (select votering_id from c) union all select 'repeated decisions', (select count(*) from decisions where trim(votering_id) <> '' and trim(parti) <> '') - (select count(*) from d) union all select 'vintage before period', count(*) from indicators where length(period) = 10 and vintage_date is not null and regexp_replace(vintage_date, '[^0-9]', '', 'g')[:8] < regexp_replace(period, '[^0-9]', '', 'g')[:8])", "select name, n_bad, n_bad = 0 as ok from k"))
def checks(f: Frames) -> DataFrame:
    """Data-quality constraints: name, number of violations, verdict."""
    from votaria.operators.roll import vote_form

    votes, indicators = table(f.spark, f.root, "votes"), table(f.spark, f.root, "indicators")
    decisions = table(f.spark, f.root, "decisions").where("trim(votering_id) <> '' and trim(parti) <> ''").select("run_id", "prompt_version", key_form("votering_id").alias("k"), key_form("parti").alias("pt"), F.coalesce("arm", F.lit("anonymous")).alias("arm"))
    # one pass over each table
    members = f.main.groupBy("votering_id").agg(F.count_distinct("intressent_id").alias("n"))
    per = f.pos.groupBy("votering_id").agg(F.sum("seats").alias("s"), F.count_if(~F.col("position").isin(domain.VOTES)).alias("odd")).join(f.cases.select("votering_id", F.lit(True).alias("_known")), "votering_id", "left")
    divided = per.agg(F.count_if(F.col("s") > 349).alias("a"), F.coalesce(F.sum("odd"), F.lit(0)).alias("b"), F.count_if(F.col("_known").isNull()).alias("c"))
    divided = divided.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("n_bad")) for name, c in (("seats", "a"), ("position values", "b"), ("positions without case", "c"))])))
    return ql.report([
        ql.counts(votes, {"vote values": vote_form("rost").isNull(), "id length": F.coalesce(F.length(F.trim("votering_id")) != 36, F.lit(True))}), ql.counts(members, {"members per division": F.col("n") > 349}), divided,
        ql.counts(f.cases, {"cases without text": F.coalesce(F.trim("forslag_text"), F.lit("")) == "", "month length": F.coalesce(F.length("month") != 7, F.lit(True))}),
        ql.repeated("repeated decisions", decisions, ["run_id", "pt", "k", "prompt_version", "arm"]),
        ql.counts(indicators.where("length(period) = 10"), {"vintage before period": F.coalesce(day_of("vintage_date") < period_start("period"), F.lit(False))}),
    ])


@query("select rm, n, abs(n - expected) <= greatest(2, 0.02 * expected) as ok from (select rm, count(*) as n, 60 as expected from c where rm is not null group by rm)")
def year_counts(f: Frames) -> DataFrame:
    """Divisions per year against an expected number, within two or two per cent."""
    return f.cases.where("rm is not null").groupBy("rm").agg(F.count("*").alias("n")).select("rm", "n", (F.abs(F.col("n") - 60) <= F.greatest(F.lit(2.0), F.lit(0.02 * 60))).alias("ok"))


# ---- the star tables at volume ----


@query("select r_name, date_trunc('month', o_orderdate)::date as month, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, grouping_id(r_name, date_trunc('month', o_orderdate)::date) as level from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, date_trunc('month', o_orderdate)::date)")
def revenue_rollup(f: Frames) -> DataFrame:
    """Revenue by region and month with totals, over the star schema."""
    t = lambda n: table(f.spark, f.root, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("r_name", F.trunc("o_orderdate", "month").alias("month"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rows.rollup("r_name", "month").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("revenue"), F.grouping_id().alias("level"))


@query("select date_trunc('day', ts)::date as day, event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 4) as mean from events group by all")
def daily_events(f: Frames) -> DataFrame:
    """Events per day and type."""
    rows = table(f.spark, f.root, "events").withColumn("day", F.to_date("ts"))
    # beside a distinct count the engine would add values up by user, and the sums of doubles would differ from SQL's
    means = rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), rounded(F.avg("value"), 4).alias("mean"))
    users = rows.groupBy(F.col("day").alias("_day"), F.col("event_type").alias("_type")).agg(F.count_distinct("user_id").alias("users"))
    return means.join(users, F.col("day").eqNullSafe(F.col("_day")) & F.col("event_type").eqNullSafe(F.col("_type"))).select("day", "event_type", "n", "users", "mean")


@query("select user_id, session, min(ts) as first_ts, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end as new from events)) group by user_id, session")
def user_sessions(f: Frames) -> DataFrame:
    """Sessions of each user, parted by six hours of rest."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval '6' hour"), 0).otherwise(1)
    rows = table(f.spark, f.root, "events").withColumn("new", fresh)
    return rows.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
