"""Queries behind pages: browsing with filters, lists in the order of seats, flips by area, league tables and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votaria import domain
from votaria.expr import rate
from votaria.operators import counterfactual as cf
from votaria.operators.shape import ordered, stratified
from votaria.plans import context
from votaria.plans import parliament as pl
from votaria.plans.parliament import Frames, _with, r4
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


# ---- browsing ----

_BROWSE = f"{pl._FLIP}, {context._INDEX}, br as (select ix.*, coalesce(area.policy_area, '{domain.OTHER_AREA}') as policy_area, coalesce(fx.flips, false) as flips from ix left join area on area.utskott_key = upper(trim(ix.utskott)) left join fx using (votering_id))"


def _browse(f: Frames) -> DataFrame:
    flips = cf.flips(f.pos, pl._stances(f)).select("votering_id", "flips")
    rows = cf.with_area(context._index(f), domain.areas(f.spark)).join(flips, "votering_id", "left")
    return rows.withColumn("flips", F.coalesce("flips", F.lit(False)))


def matching(rows: DataFrame, month: str | None = None, committee: str | None = None, area: str | None = None, text: str | None = None, disagree: bool = False, explicit: bool = False, flip: bool = False, party: str | None = None) -> DataFrame:
    """Rows of the index that match every given filter; a party's scope is its explicit gaps where ``explicit`` is asked for."""
    if month:
        rows = rows.where(F.col("month").startswith(month))
    if committee:
        rows = rows.where(F.col("utskott") == committee)
    if area:
        rows = rows.where(F.col("policy_area") == area)
    if text:
        rows = rows.where(F.contains("search", F.lit(text.lower())))
    if disagree:
        rows = rows.where("miss is not null")
    if explicit:
        rows = rows.where("missx is not null")
    if flip:
        rows = rows.where("flips")
    if party:
        rows = rows.where(F.array_contains("missx" if explicit else "miss", party))
    return rows


@query(_with(_BROWSE, "select votering_id, policy_area, miss, missx, flips from br where month like '202%' and contains(search, 'e') and miss is not null"))
def browsed(f: Frames) -> DataFrame:
    """Divisions of a period with a word in their text in which some party left its plan."""
    return matching(_browse(f), month="202", text="E", disagree=True).select("votering_id", "policy_area", "miss", "missx", "flips")


@query(_with(_BROWSE, "select votering_id, missx from br where missx is not null and list_contains(missx, 'KS')"))
def browsed_party(f: Frames) -> DataFrame:
    """Divisions in which one party left what its plan says explicitly."""
    return matching(_browse(f), explicit=True, party="KS").select("votering_id", "missx")


@query(_with(_BROWSE, "select votering_id, policy_area from br where flips"))
def browsed_flips(f: Frames) -> DataFrame:
    """Divisions that the plans would have turned."""
    return matching(_browse(f), flip=True).select("votering_id", "policy_area")


@query(_with("x as (select distinct 'utskott' as field, trim(utskott) as value from c where trim(utskott) <> '' union select distinct 'month', month from c where month is not null)", "select field, value, (row_number() over (partition by field order by case when field = 'month' then value end desc, value) - 1)::int as place from x"))
def filter_values(f: Frames) -> DataFrame:
    """What can be filtered by: committees by name, months from the newest."""
    rows = f.cases.select(F.explode(F.array(F.struct(F.lit("utskott").alias("field"), F.trim("utskott").alias("value")), F.struct(F.lit("month").alias("field"), F.col("month").alias("value")))).alias("x")).select("x.*").where("value <> ''").distinct()
    # a calendar and a list of committees
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.when(F.col("field") == "month", F.col("value")).desc(), "value")) - 1
    return rows.withColumn("place", place)


# ---- in the order of seats ----

_SEATED = "mb as (select distinct upper(trim(parti)) as parti, namn, intressent_id, rm from votes where namn is not null and rm is not null and trim(parti) <> '')"


@query(_with(_SEATED, "select rm, parti, namn, intressent_id, row_number() over (partition by rm order by coalesce(seat_order, 99), parti, namn, intressent_id) - 1 as place from mb left join party using (parti)"))
def members_in_order(f: Frames) -> DataFrame:
    """Members of each session by the seats of their party, then by name; unknown parties last."""
    rows = table(f.spark, f.root, "votes").where("namn is not null and rm is not null").select(F.upper(F.trim("parti")).alias("parti"), "namn", "intressent_id", "rm").where("parti <> ''").distinct()
    seated = rows.join(F.broadcast(f.parties.select("parti", "seat_order")), "parti", "left").withColumn("seat_order", F.coalesce("seat_order", F.lit(99)))
    order = [F.col("seat_order"), F.col("parti"), F.col("namn"), F.asc_nulls_last("intressent_id")]
    return ordered(seated, ["rm"], order).select("rm", "parti", "namn", "intressent_id", F.col("_row").cast("bigint").alias("place"))


@query(_with("ds as (select v.votering_id, v.parti, v.namn, v.rost, seat_order from v join p using (votering_id, parti) join party using (parti) where v.rost <> 'Frånvarande' and p.position <> 'Frånvarande' and v.rost <> p.position and v.namn is not null), g as (select votering_id, list(namn || ' (' || parti || ')' order by seat_order, namn, rost) as l from ds group by votering_id)", "select votering_id, case when len(l) <= 3 then array_to_string(l, ', ') else array_to_string(l[:3], ', ') || ' +' || (len(l) - 3) end as label, len(l) as n from g"))
def division_dissenters(f: Frames) -> DataFrame:
    """Who voted against the own party in each division: the first three in the order of seats, and how many more."""
    line = f.pos.where("position <> 'Frånvarande'").select("votering_id", "parti", "position")
    rows = f.main.where(F.col("rost").isin(domain.CAST) & F.col("namn").isNotNull()).join(line, ["votering_id", "parti"]).where("rost <> position").join(F.broadcast(f.parties.select("parti", "seat_order")), "parti")
    # at most the members of a chamber
    who = F.array_sort(F.collect_list(F.struct("seat_order", "namn", "rost", F.concat("namn", F.lit(" ("), "parti", F.lit(")")).alias("label"))))
    listed = rows.groupBy("votering_id").agg(F.transform(who, lambda x: x["label"]).alias("l"))
    first = F.array_join(F.slice("l", 1, 3), ", ")
    return listed.select("votering_id", F.when(F.size("l") <= 3, first).otherwise(F.concat(first, F.lit(" +"), (F.size("l") - 3).cast("string"))).alias("label"), F.size("l").cast("bigint").alias("n"))


# ---- flips and areas ----

_AREAS_OF = f"ca as (select c.votering_id, c.datum, c.rubrik, c.utskott, coalesce(area.policy_area, '{domain.OTHER_AREA}') as policy_area from c left join area on area.utskott_key = upper(trim(c.utskott)))"


@query(_with(f"{pl._FLIP}, {_AREAS_OF}", "select votering_id, datum, rubrik, utskott, policy_area, movers, len(movers) = 1 as solo, real_outcome as outcome, cf_outcome as counterfactual, abs(real_ja - real_nej) as margin, (row_number() over (order by datum desc nulls last, votering_id desc) - 1) as place from fx join ca using (votering_id) where flips"))
def flips_newest(f: Frames) -> DataFrame:
    """The divisions that would have turned, the newest first, with the real margin."""
    rows = cf.flips(f.pos, pl._stances(f)).where("flips").join(cf.with_area(f.cases, domain.areas(f.spark)).select("votering_id", "datum", "rubrik", "utskott", "policy_area"), "votering_id")
    shown = rows.select("votering_id", "datum", "rubrik", "utskott", "policy_area", "movers", (F.size("movers") == 1).alias("solo"), F.col("real_outcome").alias("outcome"), F.col("cf_outcome").alias("counterfactual"), F.abs(F.col("real_ja") - F.col("real_nej")).alias("margin"))
    return ordered(shown, [], [F.desc_nulls_last("datum"), F.desc("votering_id")]).withColumn("place", F.col("_row").cast("bigint")).drop("_row", "_size")


@query(_with(f"{pl._FLIP}, {_AREAS_OF}, ag as (select policy_area, count(*) as n_cases, count(fx.votering_id) as with_movers, count(*) filter (flips) as flipped from ca left join fx using (votering_id) group by policy_area)", f"select *, {r4('flipped', 'n_cases')} as flip_rate, (row_number() over (order by flipped desc, policy_area) - 1)::int as place from ag"))
def flip_areas(f: Frames) -> DataFrame:
    """Per policy area: divisions, those with movers, those that turn; most turned first."""
    flipped = cf.flips(f.pos, pl._stances(f)).select("votering_id", "flips")
    rows = cf.with_area(f.cases, domain.areas(f.spark)).join(flipped, "votering_id", "left").groupBy("policy_area").agg(F.count("*").alias("n_cases"), F.count("flips").alias("with_movers"), F.count_if("flips").alias("flipped"))
    # one row for each area
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("flipped"), "policy_area")) - 1
    return rows.withColumn("flip_rate", rate(F.col("flipped"), F.col("n_cases"))).withColumn("place", place)


@query(_with(f"{pl._CUBE}, own as (select parti, follow_rate as own_rate from cub where level = 2), cl as (select x.parti, x.policy_area, x.n, x.follow_rate, round(x.follow_rate - own_rate, 4) as delta from cub x join own using (parti) where x.level = 0 and x.n >= 10)", "select parti, arg_max(policy_area, (delta, policy_area)) as best_area, max(delta) as best_delta, arg_min(policy_area, (delta, policy_area)) as worst_area, min(delta) as worst_delta from cl group by parti"))
def area_extremes(f: Frames) -> DataFrame:
    """Per party the areas in which it follows its plan most and least against its own mean, of those with ten votes or more."""
    cube = cf.area_cube(f.area_facts)
    own = cube.where("level = 2").select("parti", F.col("follow_rate").alias("own_rate"))
    cells = cube.where("level = 0 and n >= 10").join(F.broadcast(own), "parti").withColumn("delta", F.round(F.col("follow_rate") - F.col("own_rate"), 4))
    key = F.struct("delta", "policy_area")
    return cells.groupBy("parti").agg(F.max_by("policy_area", key).alias("best_area"), F.max("delta").alias("best_delta"), F.min_by("policy_area", key).alias("worst_area"), F.min("delta").alias("worst_delta"))


@query(_with("pr as (select parti, count(*) filter (implied is not null and position in ('Ja', 'Nej')) as n, count(*) filter (implied is not null and position in ('Ja', 'Nej') and implied <> position) as n_gap, count(*) as n_all, count(*) filter (agree) as hit, count(*) filter (position = 'Ja') as ja from f group by parti)", f"select parti, {r4('n_gap', 'n')} as gap_rate, {r4('hit - ja', 'n_all')} as lift, (row_number() over (order by {r4('n_gap', 'n')} desc nulls last, parti) - 1)::int as by_gap, (row_number() over (order by {r4('hit - ja', 'n_all')} nulls last, parti) - 1)::int as by_lift from pr"))
def party_ranking(f: Frames) -> DataFrame:
    """Parties by gap, the largest first, and by lift, the least first."""
    decided = F.col("implied").isNotNull() & F.col("position").isin(domain.DECIDED)
    per = f.facts.groupBy("parti").agg(F.count_if(decided).alias("n"), F.count_if(decided & (F.col("implied") != F.col("position"))).alias("g"), F.count("*").alias("a"), F.count_if("agree").alias("hit"), F.count_if(F.col("position") == "Ja").alias("ja"))
    rows = per.select("parti", rate(F.col("g"), F.col("n")).alias("gap_rate"), rate(F.col("hit") - F.col("ja"), F.col("a")).alias("lift"))
    everything = Window.partitionBy(F.lit(1))  # eight parties
    return rows.withColumns({"by_gap": F.row_number().over(everything.orderBy(F.desc_nulls_last("gap_rate"), "parti")) - 1, "by_lift": F.row_number().over(everything.orderBy(F.asc_nulls_last("lift"), "parti")) - 1})


@query(_with("k as (select votering_id, count(distinct parti) as p, min(hallning) as lo, max(hallning) as hi, count(*) as n from f where hallning is not null group by votering_id)", "select p::int as n_parties, count(*) as n_cases, count(*) filter (lo = hi) as n_unanimous, sum(n)::bigint as n_decisions from k group by p"))
def stance_spread(f: Frames) -> DataFrame:
    """Divisions by how many parties took a stance, up to all eight, and those in which they took one."""
    case = f.facts.where("hallning is not null").groupBy("votering_id").agg(F.count_distinct("parti").cast("int").alias("n_parties"), F.min("hallning").alias("lo"), F.max("hallning").alias("hi"), F.count("*").alias("n"))
    return case.groupBy("n_parties").agg(F.count("*").alias("n_cases"), F.count_if(F.col("lo") == F.col("hi")).alias("n_unanimous"), F.sum("n").alias("n_decisions"))


# ---- runs ----

_DECISIVE = "case when len(citations) > 0 then citations[1].document || ':' || coalesce(citations[1].slug, '') end"


@query(_with(f"x as (select parti, votering_id, rost, {_DECISIVE} as decisive, omvarld.paverkar as w from d where run_id = 'run-p6-1' and arm = 'anonymous'), y as (select parti, votering_id, rost, {_DECISIVE} as decisive, omvarld.paverkar as w from d where run_id = 'run-p6-2' and arm = 'anonymous'), pos2 as (select votering_id, parti, position from p)", f"select parti, count(*) as n, count(*) filter (x.decisive is not distinct from y.decisive) as same_decisive, {r4('count(*) filter (x.rost = position)', 'count(position)')} as agreement_a, {r4('count(*) filter (y.rost = position)', 'count(position)')} as agreement_b, count(*) filter (x.rost = 'Avstår') as abstained_a, count(*) filter (y.rost = 'Avstår') as abstained_b, count(*) filter (x.w) as influenced_a, count(*) filter (y.w) as influenced_b from x join y using (parti, votering_id) left join pos2 using (votering_id, parti) group by parti"))
def compare_runs_closely(f: Frames) -> DataFrame:
    """Two runs on what both decided: same decisive source, agreement of each with the floor, abstentions, outside influence."""
    decisive = F.when(F.size("citations") > 0, F.concat(F.get("citations", F.lit(0))["document"], F.lit(":"), F.coalesce(F.get("citations", F.lit(0))["slug"], F.lit(""))))
    side = lambda run, s: f.decisions.where(f"run_id = '{run}' and arm = 'anonymous'").select("parti", "votering_id", F.col("rost").alias(f"rost_{s}"), decisive.alias(f"decisive_{s}"), F.col("omvarld.paverkar").alias(f"w_{s}"))
    both = side("run-p6-1", "a").join(side("run-p6-2", "b"), ["parti", "votering_id"]).join(f.pos.select("votering_id", "parti", "position"), ["votering_id", "parti"], "left")
    agree = lambda s: rate(F.count_if(F.col(f"rost_{s}") == F.col("position")), F.count("position")).alias(f"agreement_{s}")
    count = lambda c, n: F.count_if(c).alias(n)
    return both.groupBy("parti").agg(F.count("*").alias("n"), count(F.col("decisive_a").eqNullSafe(F.col("decisive_b")), "same_decisive"), agree("a"), agree("b"), count(F.col("rost_a") == "Avstår", "abstained_a"), count(F.col("rost_b") == "Avstår", "abstained_b"), count(F.col("w_a"), "influenced_a"), count(F.col("w_b"), "influenced_b"))


@query(_with(f"{context._CIT}, tk as (select slug, ceil(sum(length(text)) / 3.6)::bigint as tokens from (select distinct slug, block_id, text from docblocks where slug is not null) group by slug), ci as (select slug, count(*) as n_cites from ct group by slug)", "select slug, tokens, coalesce(n_cites, 0) as n_cites, round(1000.0::double * coalesce(n_cites, 0) / nullif(tokens, 0), 4) as per_1k from tk left join ci using (slug)"))
def citation_density(f: Frames) -> DataFrame:
    """Documents by their size in tokens and how often a thousand of them is cited."""
    blocks = table(f.spark, f.root, "docblocks").where("slug is not null").select("slug", "block_id", "text").distinct()
    sizes = blocks.groupBy("slug").agg(F.ceil(F.sum(F.length("text")) / 3.6).alias("tokens"))
    cites = context._citations(f).groupBy("slug").agg(F.count("*").alias("n_cites"))
    rows = sizes.join(cites, "slug", "left").withColumn("n_cites", F.coalesce("n_cites", F.lit(0)))
    return rows.withColumn("per_1k", F.round(F.try_divide(F.lit(1000.0) * F.col("n_cites"), F.col("tokens")), 4))


@query(_with(f"{context._CIT}, q as (select run_id, length(quote) as w, row_number() over (partition by run_id order by length(quote)) - 1 as i, count(*) over (partition by run_id) as n from ct where trim(quote) <> '')", "select run_id, n, min(w) filter (i = n // 2) as median_quote, max(w) as longest from q group by run_id, n"))
def quote_lengths(f: Frames) -> DataFrame:
    """Per run the upper median length of quotes, and the longest (counts per length, no list of all)."""
    counts = context._citations(f).where("trim(quote) <> ''").groupBy("run_id", F.length("quote").alias("w")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("run_id")
    ranked = counts.withColumn("upto", F.sum("c").over(by.orderBy("w").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by))
    return ranked.groupBy("run_id", "n").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("w"))).alias("median_quote"), F.max("w").alias("longest"))


@query(_with("s as (select utskott, rm, count(*) as n from c group by all), t as (select sum(n) as total from s)", "select utskott, rm, n, greatest(1, round(40 * n::double / total))::bigint as quota from s, t"))
def strata(f: Frames) -> DataFrame:
    """Strata with the quota that a sample of 40 takes of each, never none."""
    sizes = f.cases.groupBy("utskott", "rm").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("utskott", "rm", "n", F.greatest(F.lit(1), F.round(F.lit(40) * F.col("n").cast("double") / F.col("total"))).cast("bigint").alias("quota"))  # one total row


@query(_with("s as (select utskott, rm, count(*) as n from c group by all), t as (select sum(n) as total from s)", "select utskott, rm, least(n, greatest(1, round(40 * n::double / total)))::bigint as picked from s, t"))
def stratified_sample(f: Frames) -> DataFrame:
    """How many a seeded stratified sample of 40 took of each stratum (which ones depends on the hash of the engine)."""
    return stratified(f.cases.select("votering_id", "utskott", "rm"), ["utskott", "rm"], "votering_id", 40, 7).groupBy("utskott", "rm").agg(F.count("*").alias("picked"))


@query(_with("o as (select user_id, event_type, count(*) as n, count(distinct ts::date) as days from events where not regexp_matches(event_type, '^(?:error|view)') group by all)", "select * from o"))
def events_without(f: Frames) -> DataFrame:
    """Events but those whose type matches a pattern, per user and type."""
    return table(f.spark, f.root, "events").where(~F.col("event_type").rlike("^(?:error|view)")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"))

