"""Queries on votes, divisions and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votaria import domain
from votaria.operators import counterfactual as cf
from votaria.operators import decisions as dc
from votaria.operators import roll
from votaria.operators.shape import apportion, capped, chunks, dense, every_kth, islands, latest_per_key, ordered
from votaria.tables import table


class Frames:
    """The shared frames, built lazily; each query uses those it needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.votes = roll.main_votes(table(spark, root, "votes"))
        self.main = roll.member_votes(table(spark, root, "votes"))
        self.pos = roll.positions(self.main)
        self.cases = roll.current_cases(table(spark, root, "cases"))
        self.parties = domain.parties(spark)

    @property
    def decisions(self) -> DataFrame:
        return dc.clean_decisions(table(self.spark, self.root, "decisions"))

    @property
    def facts(self) -> DataFrame:
        return dc.decision_facts(self.decisions, self.pos, self.cases)

    @property
    def area_facts(self) -> DataFrame:
        return cf.with_area(self.facts, domain.areas(self.spark))

    @property
    def lines(self) -> DataFrame:
        return self.pos.where("position <> 'Frånvarande'").join(self.cases.select("votering_id", "rm"), "votering_id")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_PARTIES = ", ".join(f"('{p}', '{b}', {i})" for i, (p, b) in enumerate(domain.PARTIES.items()))
_AREAS = ", ".join(f"('{k.upper()}', '{v}')" for k, v in domain.AREAS.items())
_GOV = ", ".join(f"'{p}'" for p in domain.GOVERNMENT)
BASE = f"""
party(parti, bloc, seat_order) as (values {_PARTIES}),
area(utskott_key, policy_area) as (values {_AREAS}),
vw as (select distinct * from (
  select upper(trim(votering_id)) as votering_id, upper(trim(parti)) as parti, intressent_id, namn,
    case lower(trim(rost)) when 'ja' then 'Ja' when 'nej' then 'Nej' when 'avstår' then 'Avstår' when 'frånvarande' then 'Frånvarande' end as rost,
    rm, beteckning, punkt, left(datum, 10)::date as datum, nullif(upper(trim(dok_id)), '') as dok_id
  from votes where avser = 'sakfrågan' and votering = 'huvud')
  where votering_id <> '' and rost is not null and parti in (select parti from party)),
v as (select distinct votering_id, parti, intressent_id, namn, rost from vw),
pn as (select votering_id, parti, count(*) filter (rost = 'Ja') as n_ja, count(*) filter (rost = 'Nej') as n_nej, count(*) filter (rost = 'Avstår') as n_avstar, count(*) filter (rost = 'Frånvarande') as n_franvarande from v group by all),
p as (select *, case when n_ja + n_nej + n_avstar = 0 then 'Frånvarande' when n_ja >= n_nej and n_ja >= n_avstar then 'Ja' when n_nej >= n_avstar then 'Nej' else 'Avstår' end as position,
    case when n_ja + n_nej + n_avstar = 0 then 1.0 else greatest(n_ja, n_nej, n_avstar)::double / (n_ja + n_nej + n_avstar) end as cohesion, n_ja + n_nej + n_avstar + n_franvarande as seats from pn),
c as (select upper(trim(votering_id)) as votering_id, rm, beteckning, punkt, nullif(upper(trim(dok_id)), '') as dok_id, left(datum, 10)::date as datum, left(datum, 7) as month, utskott, rubrik, forslag_text, notis, vinnare, motforslag_nummer
  from cases where trim(votering_id) <> '' qualify row_number() over (partition by upper(trim(votering_id)) order by inkom_ts desc) = 1),
d as (select * exclude (votering_id, parti, arm), upper(trim(votering_id)) as votering_id, upper(trim(parti)) as parti, coalesce(arm, 'anonymous') as arm, upper(trim(parti)) || ':' || upper(trim(votering_id)) || ':' || prompt_version || ':' || coalesce(arm, 'anonymous') as cid
  from decisions where trim(votering_id) <> '' and trim(parti) <> ''
  qualify row_number() over (partition by run_id, upper(trim(parti)), upper(trim(votering_id)), prompt_version, coalesce(arm, 'anonymous') order by inkom_ts) = 1),
f as (select d.*, p.position, c.datum, c.month, c.rubrik, c.utskott, c.vinnare, d.rost = p.position as agree,
    case when coverage = 'explicit' and confidence in ('high', 'medium') then 'explicit' when plan_tacker_utskottets_skal = 'nej' then 'off_axis' else 'extrapolated' end as tier,
    case hallning when 'stodjer' then 'Nej' when 'avvisar' then 'Ja' end as implied
  from d join p using (votering_id, parti) left join c using (votering_id) where p.position <> 'Frånvarande'),
fa as (select f.*, coalesce(area.policy_area, '{domain.OTHER_AREA}') as policy_area from f left join area on area.utskott_key = upper(trim(f.utskott))),
line as (select p.*, c.rm from p join c using (votering_id) where position <> 'Frånvarande')"""


def query(sql: str | None = None):
    """Registers a query on the shared frames, with its SQL over BASE."""

    def register(build):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return build(Frames(spark, root))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            ORACLE[build.__name__] = f"with {BASE} {sql}"
        return run

    return register


def r4(n: str, d: str) -> str:
    return f"round(({n})::double / nullif({d}, 0), 4)"


@query("select * from p")
def party_positions(f: Frames) -> DataFrame:
    """Counts, majority position, cohesion and seats per division and party."""
    return f.pos


@query("select votering_id, min(dok_id) as dok_id, min(rm) as rm, min(beteckning) as beteckning, min(punkt) as punkt, max(datum) as datum, count(*) as n_members from vw group by votering_id")
def divisions(f: Frames) -> DataFrame:
    """Roll-up of member votes to divisions."""
    return roll.divisions(f.votes.distinct())


@query("select votering_id, count(*) as n_members, case when any_value(k) is null then 'no case' when any_value(t) is null then 'no text' end as reason from vw left join (select votering_id, 1 as k, case when trim(forslag_text) <> '' then 1 end as t from c) using (votering_id) group by votering_id having reason is not null")
def orphan_divisions(f: Frames) -> DataFrame:
    """Divisions that cannot become cases, with the reason."""
    return roll.split_orphans(roll.divisions(f.votes.distinct()), f.cases).where("reason is not null").select("votering_id", "n_members", "reason")


@query("select votering_id, rm, beteckning, punkt, dok_id, datum, month, utskott, vinnare from c")
def current_cases(f: Frames) -> DataFrame:
    """Latest version of each division."""
    return f.cases.select("votering_id", "rm", "beteckning", "punkt", "dok_id", "datum", "month", "utskott", "vinnare")


@query(f"select parti, month, round(avg(cohesion), 4) as cohesion, round(avg(n_franvarande::double / seats), 4) as absence, count(*) as n from p join (select votering_id, month from c) using (votering_id) where position <> 'Frånvarande' group by parti, month")
def cohesion_series(f: Frames) -> DataFrame:
    """Cohesion and absence per party and month."""
    return roll.cohesion_series(f.pos, f.cases)


@query("select votering_id, sum(n_ja)::bigint as ja, sum(n_nej)::bigint as nej, case when sum(n_ja) > sum(n_nej) then 'Ja' else 'Nej' end as outcome from p group by votering_id")
def chamber_outcome(f: Frames) -> DataFrame:
    """Totals and outcome per division."""
    return roll.chamber(f.pos)


@query(f"select votering_id, datum, coalesce(case when trim(rubrik) <> '' then rubrik end, beteckning) as rubrik, rm || ':' || beteckning || ' p.' || punkt as bet, gov_pos, outcome, (row_number() over (order by datum desc nulls last, votering_id) - 1) as place from (select votering_id, min(position) as gov_pos from p where parti in ({_GOV}) group by votering_id having min(position) = max(position) and min(position) in ('Ja', 'Nej')) join (select votering_id, case when sum(n_ja) > sum(n_nej) then 'Ja' else 'Nej' end as outcome from p group by votering_id) using (votering_id) join c using (votering_id) where gov_pos <> outcome")
def gov_defeats(f: Frames) -> DataFrame:
    """Divisions the government line lost, the newest first."""
    return ordered(roll.defeats(f.pos, f.cases), [], [F.desc_nulls_last("datum"), F.col("votering_id")]).withColumn("place", F.col("_row").cast("bigint")).drop("_row", "_size")


def _pairs(source: str, line: str) -> str:
    return f"""select a.parti as party_a, b.parti as party_b, a.rm as rm, count(*) as n, count(*) filter (a.{line} = b.{line}) as n_agree, round((count(*) filter (a.{line} = b.{line}))::double / count(*), 3) as rate
from {source} a join {source} b using (votering_id) group by grouping sets ((a.parti, b.parti), (a.parti, b.parti, a.rm))"""


@query(_pairs("line", "position"))
def pairs_matrix(f: Frames) -> DataFrame:
    """Share of divisions with one line, per pair of parties, over all and per year."""
    return roll.pair_rates(f.lines)


def _stances(f: Frames) -> DataFrame:
    """One stance per division and party: the first by decision id of the current prompt's anonymous arm."""
    rows = f.facts.where("implied is not null and arm = 'anonymous' and prompt_version = 'p6'")
    return rows.groupBy("votering_id", "parti").agg(F.min_by(F.struct("implied", "tier", "rost"), F.concat_ws(":", "run_id", "cid")).alias("s")).select("votering_id", "parti", "s.*")


_STANCE = "stance as (select votering_id, parti, implied, tier, rost from f where implied is not null and arm = 'anonymous' and prompt_version = 'p6' qualify row_number() over (partition by votering_id, parti order by run_id || ':' || cid) = 1)"


def _with(extra: str, sql: str) -> str:
    return f"select * from (with {extra} {sql})"


@query(_with(f"{_STANCE}, sr as (select stance.*, c.rm from stance join c using (votering_id))", _pairs("sr", "implied")))
def ai_pairs_matrix(f: Frames) -> DataFrame:
    """The same matrix over implied votes."""
    return roll.pair_rates(_stances(f).join(f.cases.select("votering_id", "rm"), "votering_id"), "implied")


@query(_with(f"{_STANCE}, sr as (select stance.*, c.rm from stance join c using (votering_id)), a as ({_pairs('line', 'position')}), b as ({_pairs('sr', 'implied')})", "select a.party_a, a.party_b, a.rate as real_rate, b.rate as implied_rate, round(100 * (b.rate - a.rate), 1) as delta_pp from a join b on a.party_a = b.party_a and a.party_b = b.party_b where a.rm is null and b.rm is null"))
def pairs_delta(f: Frames) -> DataFrame:
    """Implied minus real agreement of each pair, in percentage points."""
    real = roll.pair_rates(f.lines).where("rm is null").select("party_a", "party_b", F.col("rate").alias("real_rate"))
    implied = roll.pair_rates(_stances(f).join(f.cases.select("votering_id", "rm"), "votering_id"), "implied").where("rm is null").select("party_a", "party_b", F.col("rate").alias("implied_rate"))
    return real.join(implied, ["party_a", "party_b"]).withColumn("delta_pp", F.round(100 * (F.col("implied_rate") - F.col("real_rate")), 1))


_DISSENT = "select {by}, count(*) as n_cast, count(*) filter (v.rost <> p.position) as n_dissent, round((count(*) filter (v.rost <> p.position))::double / count(*), 4) as rate from v join p using (votering_id, parti) where v.rost <> 'Frånvarande' and p.position <> 'Frånvarande' group by {by} having n_dissent > 0"


@query(_DISSENT.format(by="namn, parti") + " order by n_dissent desc, rate desc, namn, parti limit 30")
def dissenter_league(f: Frames) -> DataFrame:
    """The 30 members who vote against their party most often (a top-k report)."""
    return roll.dissenters(f.main, f.pos, ["namn", "parti"]).orderBy(F.desc("n_dissent"), F.desc("rate"), "namn", "parti").limit(30)


@query(_DISSENT.format(by="intressent_id, parti"))
def dissenters_by_id(f: Frames) -> DataFrame:
    """Dissent per member id, so that namesakes stay apart."""
    return roll.dissenters(f.main, f.pos, ["intressent_id", "parti"])


@query("select votering_id, bool_or(a <> b) as contested from (select votering_id, min(position) over (partition by votering_id) as a, position as b from p where position <> 'Frånvarande') group by votering_id")
def contested(f: Frames) -> DataFrame:
    """Divisions in which parties took different lines."""
    return f.pos.where("position <> 'Frånvarande'").groupBy("votering_id").agg((F.min("position") != F.max("position")).alias("contested"))


@query("select votering_id, map_from_entries(list((parti, position) order by parti)) as lines from p group by votering_id")
def position_maps(f: Frames) -> DataFrame:
    """Party to position, one map per division."""
    return f.pos.groupBy("votering_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parti", "position")))).alias("lines"))


@query("select policy_area, rm, count(*) as n, grouping_id(policy_area, rm) as level from (select c.rm, coalesce(area.policy_area, 'Övrigt') as policy_area from c left join area on area.utskott_key = upper(trim(c.utskott))) group by cube (policy_area, rm)")
def cases_by_area(f: Frames) -> DataFrame:
    """Number of cases by policy area and year, with all totals (cube)."""
    return cf.with_area(f.cases, domain.areas(f.spark)).cube("policy_area", "rm").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


# ---- decisions ----


@query(f"select run_id, parti, count(*) as n, {r4('count(*) filter (agree)', 'count(*)')} as agreement, {r4(chr(39).join(['count(*) filter (position = ', 'Avstår', ' and rost = ', 'Avstår', ')']), chr(39).join(['count(*) filter (position = ', 'Avstår', ')']))} as avstar_recall from f group by all")
def agreement(f: Frames) -> DataFrame:
    """Agreement of decisions with positions per run and party."""
    return dc.agreement(f.facts, ["run_id", "parti"])


@query(f"select run_id, count(*) as n, {r4('count(*) filter (agree)', 'count(*)')} as overall_agreement, list_sort(list(distinct model)) as models, list_sort(list(distinct arm)) as arms from f group by run_id")
def run_summary(f: Frames) -> DataFrame:
    """Per run: decisions, overall agreement, models and arms."""
    return f.facts.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if("agree").cast("double"), F.count("*").cast("double")), 4).alias("overall_agreement"), F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("arm")).alias("arms"))


@query(_with("pr as (select parti, rost as a, position as b, count(*)::double as n from f group by all), t as (select parti, sum(n) as n, sum(n) filter (a = b) as same from pr group by parti), e as (select x.parti, sum(x.n * y.n) as s from (select parti, a as l, sum(n) as n from pr group by all) x join (select parti, b as l, sum(n) as n from pr group by all) y using (parti, l) group by x.parti)", "select t.parti, t.n::bigint as n, round(case when coalesce(s, 0) / (n * n) = 1 then 1.0 else (coalesce(same, 0) / n - coalesce(s, 0) / (n * n)) / (1 - coalesce(s, 0) / (n * n)) end, 4) as kappa from t left join e using (parti)"))
def kappa(f: Frames) -> DataFrame:
    """Cohen's kappa of decisions and positions per party."""
    return dc.kappa(f.facts, ["parti"])


@query("select parti, predicted, actual, count(f.parti) as n from party cross join (values ('Ja'), ('Nej'), ('Avstår')) x(predicted) cross join (values ('Ja'), ('Nej'), ('Avstår')) y(actual) left join (select parti, rost, position from f) f using (parti) where f.parti is null or (f.rost = predicted and f.position = actual) group by all union all select party.parti, predicted, actual, 0 from party cross join (values ('Ja'), ('Nej'), ('Avstår')) x(predicted) cross join (values ('Ja'), ('Nej'), ('Avstår')) y(actual) where exists (select 1 from f where f.parti = party.parti) and not exists (select 1 from f where f.parti = party.parti and f.rost = predicted and f.position = actual)")
def confusion(f: Frames) -> DataFrame:
    """Dense predicted-by-actual counts per party."""
    return dc.confusion(f.facts, f.parties)


@query(f"select parti, month, count(*) as n, {r4('count(*) filter (agree)', 'count(*)')} as agreement from f group by parti, month")
def agreement_series(f: Frames) -> DataFrame:
    """Agreement per party and month."""
    return dc.agreement(f.facts, ["parti", "month"]).drop("avstar_recall")


_GAP = "g as (select *, implied <> position as gap from f where implied is not null and position in ('Ja', 'Nej'))"


@query(_with(_GAP, f"select parti, tier, grouping_id(parti, tier) as level, count(*) as n, count(*) filter (gap) as n_gap, count(*) filter (gap and implied = 'Nej') as plan_nej_voted_ja, count(*) filter (gap and implied = 'Ja') as plan_ja_voted_nej, count(*) - count(*) filter (gap) as aligned, {r4('count(*) filter (gap)', 'count(*)')} as gap_rate from g group by cube (parti, tier)"))
def gap_blocks(f: Frames) -> DataFrame:
    """Plan against behaviour, by tier and party with all totals."""
    return dc.gap_blocks(f.facts)


@query("select parti, tier, count(*) as n from f where hallning is not null group by parti, tier")
def tier_counts(f: Frames) -> DataFrame:
    """Decisions per evidence tier and party, abstentions included."""
    return f.facts.where("hallning is not null").groupBy("parti", "tier").agg(F.count("*").alias("n"))


@query(_with(_GAP, f"select field, coalesce(level, 'None') as level, count(*) as n, {r4('count(*) filter (gap)', 'count(*)')} as gap_rate from (select gap, 'coverage' as field, coverage as level from g union all select gap, 'confidence', confidence from g union all select gap, 'plan_tacker_utskottets_skal', plan_tacker_utskottets_skal from g) group by all"))
def gap_validity(f: Frames) -> DataFrame:
    """Gap rate by self-reported strength."""
    return dc.validity(f.facts)


@query(_with("k as (select votering_id, count(distinct parti) as p, min(hallning) as lo, max(hallning) as hi, count(*) as n, count(*) filter (hallning = 'stodjer') as s, count(*) filter (position = 'Avstår') as a from f where hallning is not null group by votering_id)", f"select {r4('sum(s)', 'sum(n)')} as stodjer_rate, count(*) filter (p = 2) as n_cases_all_parties, count(*) filter (p = 2 and lo = hi and lo = 'stodjer') as unanimous_stodjer, count(*) filter (p = 2 and lo = hi and lo = 'avvisar') as unanimous_avvisar, coalesce(sum(a), 0)::bigint as n_abstentions from k"))
def stance_skew(f: Frames) -> DataFrame:
    """How one-sided stances are, over divisions with two parties' decisions."""
    return dc.stance_skew(f.facts, 2)


_RIVAL = f"count(*) as n, {r4(chr(39).join(['count(*) filter (position = ', 'Ja', ')']), 'count(*)')} as coalition_baseline, {r4('count(*) filter (agree)', 'count(*)')} as programme_accuracy, {r4(chr(39).join(['count(*) filter (agree) - count(*) filter (position = ', 'Ja', ')']), 'count(*)')} as programme_lift"


@query(f"select parti, {_RIVAL} from f group by parti")
def rivals(f: Frames) -> DataFrame:
    """Implied votes against 'always Ja', per party."""
    return dc.rivals(f.facts, ["parti"])


@query(f"select parti, month, {_RIVAL} from f group by parti, month")
def rivals_by_month(f: Frames) -> DataFrame:
    """The same per month."""
    return dc.rivals(f.facts, ["parti", "month"])


def _authored(f: Frames) -> DataFrame:
    who = dc.authors(table(f.spark, f.root, "alternatives"), list(domain.PARTIES))
    return f.facts.join(who.withColumn("_authored", F.lit(True)), ["votering_id", "parti"], "left").withColumn("authored", F.coalesce("_authored", F.lit(False))).drop("_authored")


# parties behind reservations: whole-word party codes in the field
_AUTHORS = """aut as (select distinct upper(trim(a.votering_id)) as votering_id, party.parti from alternatives a, party
  where trim(a.alt_id) like 'res%' and trim(a.votering_id) <> '' and list_contains(regexp_split_to_array(upper(a.source_partier), '[^A-ZÅÄÖ]+'), party.parti))"""


@query(_with(_AUTHORS, "select * from aut"))
def reservation_authors(f: Frames) -> DataFrame:
    """Parties behind each division's reservations."""
    return dc.authors(table(f.spark, f.root, "alternatives"), list(domain.PARTIES))


_OV = f"{_AUTHORS}, o as (select f.*, aut.parti is not null as authored, coalesce(rost in ('Nej', 'Avstår') and coverage = 'explicit', false) as loose, coalesce(rost in ('Nej', 'Avstår') and coverage = 'explicit' and confidence = 'high', false) as strict from f left join aut using (votering_id, parti))"


@query(_with(_OV, " union all ".join(f"select parti, '{t}' as threshold, '{w}' as authorship, count(*) filter ({t} and {x}) as den, count(*) filter ({t} and {x} and position = 'Ja') as num, {r4(f'count(*) filter ({t} and {x} and position = ' + chr(39) + 'Ja' + chr(39) + ')', f'count(*) filter ({t} and {x})')} as rate from o group by parti" for t in ("loose", "strict") for w, x in (("all", "true"), ("authored", "authored"), ("not_authored", "not authored")))))
def override_buckets(f: Frames) -> DataFrame:
    """Overrides by threshold and authorship; the buckets overlap."""
    return dc.override_buckets(_authored(f))


@query(_with(_OV, "select run_id, cid, votering_id, parti, datum, rubrik, utskott, rost as ai_rost, strict, authored from o where loose and position = 'Ja'"))
def override_cases(f: Frames) -> DataFrame:
    """The decisions behind the overrides, the strict ones first, by day and party."""
    counts, strict = dc.override()
    rows = _authored(f).where(counts & (F.col("position") == "Ja")).withColumn("strict", strict)
    return rows.select("run_id", "cid", "votering_id", "parti", "datum", "rubrik", "utskott", F.col("rost").alias("ai_rost"), "strict", "authored").orderBy(F.desc("strict"), "datum", "parti", "run_id", "cid")


@query(_with("x as (select parti, votering_id, any_value(rost) as rost, any_value(coverage) as coverage, any_value(confidence) as confidence from d where run_id = 'run-p6-1' and arm = 'anonymous' group by all), y as (select parti, votering_id, any_value(rost) as rost, any_value(coverage) as coverage, any_value(confidence) as confidence from d where run_id = 'run-p6-2' and arm = 'anonymous' group by all)", "select parti, count(*) filter (x.votering_id is not null and y.votering_id is not null) as n_both, count(*) filter (y.votering_id is null) as only_a, count(*) filter (x.votering_id is null) as only_b, count(*) filter (x.votering_id is not null and y.votering_id is not null and x.rost is not distinct from y.rost) as same_rost, count(*) filter (x.votering_id is not null and y.votering_id is not null and x.coverage is not distinct from y.coverage) as same_coverage, count(*) filter (x.votering_id is not null and y.votering_id is not null and x.confidence is not distinct from y.confidence) as same_confidence from x full join y using (parti, votering_id) group by parti"))
def compare_runs(f: Frames) -> DataFrame:
    """Two runs side by side, with what only one of them has."""
    run = lambda r: f.decisions.where(f"run_id = '{r}' and arm = 'anonymous'")
    return dc.compare_runs(run("run-p6-1"), run("run-p6-2"))


@query(_with("pr as (select actual, max(n) as top, sum(n) as n, sum(n) filter (predicted = actual) as hit from (select rost as predicted, position as actual, count(*) as n from f group by all) group by actual)", f"select {r4('sum(hit)', 'sum(n)')} as accuracy, {r4('max(n)', 'sum(n)')} as majority_baseline, sum(n)::bigint as n from pr"))
def accuracy_vs_majority(f: Frames) -> DataFrame:
    """Accuracy beside the rate of the commonest position."""
    counts = f.facts.groupBy("position").agg(F.count("*").alias("n"), F.count_if("agree").alias("hit"))
    return counts.agg(F.round(F.sum("hit") / F.sum("n"), 4).alias("accuracy"), F.round(F.max("n") / F.sum("n"), 4).alias("majority_baseline"), F.sum("n").alias("n"))


@query(f"select confidence, coverage, count(*) as n, {r4('count(*) filter (agree)', 'count(*)')} as agreement from f group by all")
def calibration(f: Frames) -> DataFrame:
    """Agreement by stated confidence and coverage."""
    return dc.agreement(f.facts, ["confidence", "coverage"]).drop("avstar_recall")


# ---- counterfactuals ----

_FLIP = f"""{_STANCE},
mv as (select p.*, s.implied, coalesce(s.tier = 'explicit' and p.position in ('Ja', 'Nej') and s.implied <> p.position, false) as moves from p left join stance s using (votering_id, parti)),
fl as (select votering_id, sum(n_ja)::bigint as real_ja, sum(n_nej)::bigint as real_nej, sum(case when moves then case when implied = 'Ja' then n_ja + n_nej + n_avstar else 0 end else n_ja end)::bigint as cf_ja, sum(case when moves then case when implied = 'Nej' then n_ja + n_nej + n_avstar else 0 end else n_nej end)::bigint as cf_nej, list(parti order by parti) filter (moves) as movers from mv group by votering_id having count(*) filter (moves) > 0),
fo as (select *, case when real_ja > real_nej then 'Ja' when real_nej > real_ja then 'Nej' end as real_outcome, case when cf_ja > cf_nej then 'Ja' when cf_nej > cf_ja then 'Nej' end as cf_outcome from fl),
fx as (select *, coalesce(real_outcome <> cf_outcome, false) as flips from fo)"""


@query(_with(_FLIP, "select * from fx"))
def flips(f: Frames) -> DataFrame:
    """Divisions re-run with explicit commitments."""
    return cf.flips(f.pos, _stances(f))


@query(_with(_FLIP, "select count(*) as n_with_movers, count(*) filter (flips) as n_flipped, count(*) filter (flips and len(movers) = 1) as n_solo, count(*) filter (real_outcome is null or cf_outcome is null) as n_indeterminate, count(*) filter (flips and real_outcome = 'Ja') as ja_to_nej, count(*) filter (flips and real_outcome = 'Nej') as nej_to_ja from fx"))
def flip_summary(f: Frames) -> DataFrame:
    """Totals of the counterfactual."""
    return cf.flip_summary(cf.flips(f.pos, _stances(f)))


@query(_with(_FLIP, "select parti, count(*) as movers, count(*) filter (flips) as n_flips, count(*) filter (flips and solo) as n_solo from (select unnest(movers) as parti, flips, len(movers) = 1 as solo from fx) group by parti"))
def flip_parties(f: Frames) -> DataFrame:
    """Movers and flips per party."""
    return cf.flip_parties(cf.flips(f.pos, _stances(f)))


_CUBE = f"""cu as (select policy_area, parti, grouping_id(policy_area, parti) as level, count(*) filter (position in ('Ja', 'Nej')) as n, count(*) filter (position in ('Ja', 'Nej') and implied = position) as follows, count(*) filter (position = 'Avstår') as abstained,
 count(*) filter (position in ('Ja', 'Nej') and tier = 'explicit') as explicit_n, count(*) filter (position in ('Ja', 'Nej') and tier = 'explicit' and implied <> position) as explicit_gap, count(distinct votering_id) as n_cases from fa where implied is not null group by cube (policy_area, parti)),
cub as (select *, {r4("follows", "n")} as follow_rate, {r4("explicit_gap", "explicit_n")} as explicit_gap_rate from cu)"""


@query(_with(_CUBE, "select * from cub"))
def area_cube(f: Frames) -> DataFrame:
    """Area by party at four grains."""
    return cf.area_cube(f.area_facts)


@query(_with(_CUBE, "select x.policy_area, x.parti, x.n, x.follow_rate, round(1.96 * sqrt(x.follow_rate * (1 - x.follow_rate) / x.n), 4) as half_width, x.n < 40 as thin, case when x.follow_rate - y.follow_rate > 0.05 then 'strong' when x.follow_rate - y.follow_rate < -0.05 then 'weak' else 'even' end as verdict from cub x left join cub y on y.level = 2 and y.parti = x.parti where x.level = 0 and x.n > 0"))
def area_verdicts(f: Frames) -> DataFrame:
    """Areas in which a party follows its plan more or less than it does in all."""
    return cf.interval_verdict(cf.area_cube(f.area_facts))


# ---- shapes ----


@query("select parti, min(seat_order) as first, max(seat_order) as last, bloc, count(*) as n from party group by parti, bloc")
def seat_ranges(f: Frames) -> DataFrame:
    """Contiguous seats of each party (runs of equal neighbours)."""
    return islands(f.parties.withColumn("hall", F.lit(1)), ["hall"], "seat_order", ["parti", "bloc"]).drop("hall")


@query(_with("t as (select votering_id, parti, row_number() over (partition by parti order by datum, votering_id) - 1 as i, count(*) over (partition by parti) as a from p join (select votering_id, datum from c) using (votering_id)), s as (select *, greatest(1, a // 20) as step from t)", "select votering_id, parti from s where i % step = 0 and i // step < 20"))
def systematic_sample(f: Frames) -> DataFrame:
    """Every k-th division of each party, 20 in all (a sampling operator)."""
    return every_kth(f.pos.join(f.cases.select("votering_id", "datum"), "votering_id"), ["parti"], [F.col("datum"), F.col("votering_id")], 20).select("votering_id", "parti")


@query("select votering_id, ((row_number() over (partition by utskott order by datum, votering_id) - 1) // 25)::int as chunk from c")
def work_chunks(f: Frames) -> DataFrame:
    """Divisions of each committee in chunks of 25 in order."""
    return chunks(f.cases, ["utskott"], [F.col("datum"), F.col("votering_id")], 25).select("votering_id", "chunk")


@query(_with("w as (select utskott, count(*) as n, count(*) * 100.0::double / sum(count(*)) over () as e from c group by utskott), z as (select *, floor(e) as fl, row_number() over (order by e - floor(e) desc, utskott) as rk, 100 - sum(floor(e)) over () as lft from w)", "select utskott, n, (fl + case when rk <= lft then 1 else 0 end)::bigint as share from z"))
def apportioned(f: Frames) -> DataFrame:
    """A sample of 100 apportioned to committees by largest remainder."""
    return apportion(f.cases.groupBy("utskott").agg(F.count("*").alias("n")), "n", 100).withColumn("share", F.col("share").cast("bigint"))


@query(_with("s as (select votering_id, datum, utskott, row_number() over (partition by utskott order by datum desc, votering_id) as r from c)", "select votering_id, datum, utskott from s where r <= 3"))
def newest_per_committee(f: Frames) -> DataFrame:
    """The three newest divisions of each committee (a top-k report)."""
    return capped(f.cases, ["utskott"], [F.desc("datum"), F.col("votering_id")], 3).select("votering_id", "datum", "utskott")


@query("select policy_area, bloc, count(*) filter (x) as n from (select coalesce(area.policy_area, 'Övrigt') as policy_area, party.bloc as bloc, true as x from p join party using (parti) join c using (votering_id) left join area on area.utskott_key = upper(trim(c.utskott)) where position = 'Nej') group by all union all select a.policy_area, b.bloc, 0 from (select policy_area from area union select 'Övrigt') a cross join (select distinct bloc from party) b where not exists (select 1 from p join party using (parti) join c using (votering_id) left join area on area.utskott_key = upper(trim(c.utskott)) where position = 'Nej' and coalesce(area.policy_area, 'Övrigt') = a.policy_area and party.bloc = b.bloc)")
def nej_by_area_bloc(f: Frames) -> DataFrame:
    """Dense counts of Nej lines by area and bloc."""
    area = domain.areas(f.spark).select("policy_area").union(f.spark.createDataFrame([(domain.OTHER_AREA,)], "policy_area string")).distinct()
    spine = area.crossJoin(F.broadcast(f.parties.select("bloc").distinct()))  # 11 x 3 rows of dimensions
    counts = cf.with_area(f.pos.where("position = 'Nej'").join(f.cases.select("votering_id", "utskott"), "votering_id"), domain.areas(f.spark)).join(F.broadcast(f.parties), "parti").groupBy("policy_area", "bloc").agg(F.count("*").alias("n"))
    return dense(counts, spine, ["policy_area", "bloc"], ["n"])


@query("select dok_id, rm, titel, organ, inkom_ts from (select upper(trim(dok_id)) as dok_id, rm, titel, organ, inkom_ts, row_number() over (partition by upper(trim(dok_id)) order by inkom_ts desc) as r from dokstatus where trim(dok_id) <> '') where r = 1")
def current_reports(f: Frames) -> DataFrame:
    """The latest version of each report."""
    from votaria.expr import key_form

    rows = table(f.spark, f.root, "dokstatus").select(key_form("dok_id").alias("dok_id"), "rm", "titel", "organ", "inkom_ts").where("dok_id is not null")
    return latest_per_key(rows, ["dok_id"], F.col("inkom_ts"), ["titel", "organ", "rm"])
