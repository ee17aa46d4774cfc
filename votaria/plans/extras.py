"""Queries on distributions, cross-checks, zipped arrays, set tests and rendered context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votaria import domain
from votaria.expr import key_form, period_start, rate
from votaria.functions import dates as dt
from votaria.functions import text as tx
from votaria.operators import roll
from votaria.plans import context, general
from votaria.plans import parliament as pl
from votaria.plans.parliament import Frames, _with, r4
from votaria.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    def register(build):
        def run(spark, root):
            return build(Frames(spark, root))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            ORACLE[build.__name__] = f"with {pl.BASE} {sql}" if base else sql
        return run

    return register


@query("select rost, count(*) filter (position = 'Ja') as ja, count(*) filter (position = 'Nej') as nej, count(*) filter (position = 'Avstår') as avstar from f group by rost")
def vote_crosstab(f: Frames) -> DataFrame:
    """Decisions by position as a table (pivot with fixed columns)."""
    wide = f.facts.groupBy("rost").pivot("position", domain.CAST).count().fillna(0, domain.CAST)
    return wide.select("rost", F.col("Ja").alias("ja"), F.col("Nej").alias("nej"), F.col("Avstår").alias("avstar"))


@query("select slug, count(*) as n, l[greatest(1, ceil(0.9 * len(l)))::int] as p90, l[len(l) // 2 + 1] as upper_median from (select slug, list(length(line) order by length(line)) as l from (select slug, unnest(string_split(text, chr(10))) as line from (select distinct slug, block_id, text from docblocks where kind = 'para' and slug is not null)) where line <> '' group by slug), unnest(l) group by slug, l")
def line_widths(f: Frames) -> DataFrame:
    """Nearest-rank 90th percentile and upper median of line lengths per document."""
    rows = table(f.spark, f.root, "docblocks").where("kind = 'para' and slug is not null").select("slug", "block_id", "text").distinct()
    widths = rows.select("slug", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("slug", F.length("line").alias("w")).agg(F.count("*").alias("c"))
    # counts per width, not widths per line: a document's list is bounded by the longest line
    w = Window.partitionBy("slug").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    ranked = widths.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("slug")))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("w")))
    return ranked.groupBy("slug").agg(F.max("n").alias("n"), at(F.greatest(F.lit(1), F.ceil(F.col("n") * 9 / 10))).alias("p90"), at(F.floor(F.col("n") / 2) + 1).alias("upper_median"))


@query("select run_id, k, count(*) as n, sum(v)::bigint as total, max(v) as most from (select run_id, unnest(map_keys(usage)) as k, unnest(map_values(usage)) as v from d) group by run_id, k")
def usage_by_kind(f: Frames) -> DataFrame:
    """Usage maps as rows: totals per run and kind."""
    return f.decisions.select("run_id", F.explode("usage").alias("k", "v")).groupBy("run_id", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"))


@query("select run_id, cid, list_transform(citations, lambda c, i: chr((64 + i)::int) || '=' || coalesce(c.document, '?')) as labels from d where citations is not null")
def labelled_citations(f: Frames) -> DataFrame:
    """Citations of each decision with letters in order."""
    return f.decisions.where("citations is not null").select("run_id", "cid", F.transform("citations", lambda c, i: F.concat(tx.letter_label(i), F.lit("="), F.coalesce(c["document"], F.lit("?")))).alias("labels"))


@query("select vinnare, outcome, count(*) as n, count(*) filter (case vinnare when 'utskottet' then 'Ja' when 'reservation' then 'Nej' end <> outcome) as n_differ from c join (select votering_id, case when sum(n_ja) > sum(n_nej) then 'Ja' else 'Nej' end as outcome from p group by votering_id) using (votering_id) group by all")
def winner_crosscheck(f: Frames) -> DataFrame:
    """The recorded winner against the outcome counted from votes."""
    said = F.when(F.col("vinnare") == "utskottet", "Ja").when(F.col("vinnare") == "reservation", "Nej")
    rows = f.cases.join(roll.chamber(f.pos), "votering_id")
    return rows.groupBy("vinnare", "outcome").agg(F.count("*").alias("n"), F.count_if(said != F.col("outcome")).alias("n_differ"))


@query(_with("a as (select distinct votering_id from c), b as (select distinct votering_id from p)", "select (select count(*) from (from a intersect from b)) as n_both, (select count(*) from (from a except from b)) as only_cases, (select count(*) from (from b except from a)) as only_votes"))
def key_sets(f: Frames) -> DataFrame:
    """Ids in cases and in votes: shared, and in one only."""
    a, b = f.cases.select("votering_id").withColumn("a", F.lit(1)), f.pos.select("votering_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "votering_id", "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("only_cases"), F.count_if(F.col("a").isNull()).alias("only_votes"))


@query(_with("r as (select run_id, parti, votering_id, min(rost) as rost from d group by all)", f"select a.run_id as run_a, b.run_id as run_b, count(*) as n, {r4('count(*) filter (a.rost = b.rost)', 'count(*)')} as agreement from r a join r b using (parti, votering_id) where a.run_id < b.run_id group by all"))
def run_pairs(f: Frames) -> DataFrame:
    """Agreement between every two runs on the decisions they share."""
    one = f.decisions.groupBy("run_id", "parti", "votering_id").agg(F.min("rost").alias("rost"))
    a, b = one.withColumnsRenamed({"run_id": "run_a", "rost": "rost_a"}), one.withColumnsRenamed({"run_id": "run_b", "rost": "rost_b"})
    return a.join(b, ["parti", "votering_id"]).where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("n"), rate(F.count_if(F.col("rost_a") == F.col("rost_b")), F.count("*")).alias("agreement"))


@query(_with(context._CIT, f"select d.run_id, count(*) as n, {r4(chr(39).join(['count(*) filter (coverage = ', 'explicit', ')']), 'count(*)')} as explicit_share, round(avg(coalesce(k, 0)), 4) as cites_per_decision from d left join (select run_id, cid, count(*) as k from ct group by all) using (run_id, cid) group by d.run_id"))
def run_scores(f: Frames) -> DataFrame:
    """Per run: share of explicit coverage and citations per decision."""
    cites = context._citations(f).groupBy("run_id", "cid").agg(F.count("*").alias("k"))
    rows = f.decisions.join(cites, ["run_id", "cid"], "left")
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), rate(F.count_if(F.col("coverage") == "explicit"), F.count("*")).alias("explicit_share"), F.round(F.avg(F.coalesce("k", F.lit(0))), 4).alias("cites_per_decision"))


@query(_with("m as (select series, strptime(left(regexp_replace(period, '[^0-9]', '', 'g'), 6), '%Y%m')::date as month, max_by(value, obs_id) as value from indicators where length(period) = 7 and value is not null group by all), pr as (select votering_id, date_trunc('month', datum)::date as month from c where datum is not null)", "select votering_id, series, min(date_diff('month', m.month, pr.month)) as lag, arg_min(value, date_diff('month', m.month, pr.month)) as value from pr join m on date_diff('month', m.month, pr.month) between 1 and 3 group by votering_id, series"))
def recent_months(f: Frames) -> DataFrame:
    """The last monthly figure of the three months before each division (bounded look-back)."""
    rows = table(f.spark, f.root, "indicators").where("length(period) = 7 and value is not null").select("series", period_start("period").alias("m"), "value", "obs_id")
    one = rows.groupBy("series", "m").agg(F.max_by("value", "obs_id").alias("value"))
    probes = f.cases.where("datum is not null").select("votering_id", F.explode(F.array(*[F.struct(F.lit(i).alias("lag"), F.add_months(F.trunc("datum", "month"), -i).alias("m")) for i in (1, 2, 3)])).alias("x")).select("votering_id", "x.*")
    return probes.join(one, "m").groupBy("votering_id", "series").agg(F.min("lag").cast("bigint").alias("lag"), F.min_by("value", "lag").alias("value"))


@query(_with("x as (select obs_id, series, case when length(period) = 10 then left(period, 10)::date else (strptime(left(regexp_replace(period, '[^0-9]', '', 'g'), 6), '%Y%m') + interval 1 month + interval 14 day)::date end as due, try_strptime(left(regexp_replace(vintage_date, '[^0-9]', '', 'g'), 8), '%Y%m%d')::date as v from indicators where length(period) in (7, 10) and vintage_date is not null)", "select series, count(*) as n, count(*) filter (v < due) as early, max(date_diff('day', due, v)) as longest_delay from x group by series"))
def publication_delays(f: Frames) -> DataFrame:
    """Figures against the day they were due: daily ones at once, monthly ones on the 15th of the next month."""
    from votaria.expr import day_of

    rows = table(f.spark, f.root, "indicators").where("length(period) in (7, 10) and vintage_date is not null")
    start = period_start("period")
    due = F.when(F.length("period") == 10, dt.published(start, "same_day")).otherwise(dt.published(start, "next_15"))
    rows = rows.select("series", due.alias("due"), day_of("vintage_date").alias("v"))
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("v") < F.col("due")).alias("early"), F.max(F.datediff("v", "due")).cast("bigint").alias("longest_delay"))


@query(f"with {general._FIGURES} select votering_id, list(series || '#' || obs_id order by series) as known from (select distinct votering_id, series, obs_id from known) group by votering_id", base=False)
def point_in_time(f: Frames) -> DataFrame:
    """All figures known at each division, as one list in the order of series."""
    known = general._known_figures(f.spark, f.root).select("votering_id", "series", (-F.col("best.o")).alias("obs_id")).distinct()
    return known.groupBy("votering_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("series", "obs_id"))), lambda x: F.concat(x["series"], F.lit("#"), x["obs_id"].cast("string"))).alias("known"))


@query("select votering_id, concat_ws(chr(10), 'Ärende: ' || rubrik, 'Utskott: ' || utskott, 'Förslag: ' || forslag_text) as prompt, sha256(concat_ws(chr(10), 'Ärende: ' || rubrik, 'Utskott: ' || utskott, 'Förslag: ' || forslag_text)) as digest from c")
def rendered(f: Frames) -> DataFrame:
    """The text a worker gets for each division, with its digest; missing lines are left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    prompt = F.concat_ws("\n", line("Ärende", "rubrik"), line("Utskott", "utskott"), line("Förslag", "forslag_text"))
    return f.cases.select("votering_id", prompt.alias("prompt"), F.sha2(prompt, 256).alias("digest"))


_SV, _EN = (", ".join(f"'{w}'" for w in words) for words in (tx.SWEDISH_WORDS, tx.ENGLISH_WORDS))


@query(f"with w as (select lang, list_filter(string_split(lower(trim(regexp_replace(text, '[\\s\\x{{a0}}]+', ' ', 'g'))), ' '), lambda x: x in ({_SV})) as sv, list_filter(string_split(lower(trim(regexp_replace(text, '[\\s\\x{{a0}}]+', ' ', 'g'))), ' '), lambda x: x in ({_EN})) as en from documents where text is not null) select left(lower(trim(lang)), 2) as lang, case when len(sv) > len(en) then 'sv' when len(en) > len(sv) then 'en' end as guess, count(*) as n from w group by all", base=False)
def language_check(f: Frames) -> DataFrame:
    """Stated language against the one its function words show."""
    rows = table(f.spark, f.root, "documents").where("text is not null")
    return rows.groupBy(F.substring(F.lower(F.trim("lang")), 1, 2).alias("lang"), tx.language_guess(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query("select rm, dok_id, list(beteckning || '.' || punkt order by punkt, votering_id) as points from c where dok_id is not null group by all")
def report_points(f: Frames) -> DataFrame:
    """The points of each report in order, one list per report."""
    items = F.array_sort(F.collect_list(F.struct("punkt", "votering_id", F.concat("beteckning", F.lit("."), F.col("punkt").cast("string")).alias("label"))))
    return f.cases.where("dok_id is not null").groupBy("rm", "dok_id").agg(F.transform(items, lambda x: x["label"]).alias("points"))


@query("select a.votering_id, a.alt_id, len(list_filter(regexp_split_to_array(upper(a.source_partier), '[^A-ZÅÄÖ]+'), lambda x: x in (select parti from party))) > 0 as has_code from (select distinct upper(trim(votering_id)) as votering_id, alt_id, source_partier from alternatives where trim(votering_id) <> '') a where source_partier is not null".replace("x in (select parti from party)", "x in (" + ", ".join(f"'{p}'" for p in domain.PARTIES) + ")"))
def alternatives_with_codes(f: Frames) -> DataFrame:
    """Alternatives whose packed field names a party by its code."""
    from votaria.operators.packed import packed_values

    rows = table(f.spark, f.root, "alternatives").where("source_partier is not null").select(key_form("votering_id").alias("votering_id"), "alt_id", "source_partier").where("votering_id is not null").distinct()
    codes = F.array(*[F.lit(p) for p in domain.PARTIES])
    return rows.select("votering_id", "alt_id", F.arrays_overlap(F.transform(packed_values("source_partier"), F.upper), codes).alias("has_code"))
