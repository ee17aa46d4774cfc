"""Queries on documents in force, nested documents, mended citations and work dealt by context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votaria import domain
from votaria.expr import key_form
from votaria.functions import text as tx
from votaria.operators import match, nested, repair, served
from votaria.operators.packed import packed_values
from votaria.operators.shape import balanced_groups, capped
from votaria.plans import context
from votaria.plans import parliament as pl
from votaria.plans.context import PHRASES
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


# ---- documents in force ----

#: Kinds of document from each version on, and the parties to whom the agreement is shown.
SETS = {1: ["valmanifest", "avtal"], 5: ["valmanifest", "avtal", "partiprogram", "budgetmotion"], 6: ["valmanifest", "partiprogram"]}
SHOWN = ["LTH", "ÖP", "HV", "N"]
VERSIONS = ["p4", "p5", "p6", "p10"]


def _probes(f: Frames) -> DataFrame:
    versions = f.spark.createDataFrame([(v,) for v in VERSIONS], "prompt_version string")
    cases = f.cases.where("datum is not null").select("votering_id", "rm", F.unix_date("datum").alias("day"))
    return cases.crossJoin(F.broadcast(f.parties.select("parti"))).crossJoin(F.broadcast(versions))  # eight parties, four versions


def _budgets(f: Frames) -> DataFrame:
    rows = context._editions(f).where("document = 'budgetmotion'")
    year, number = F.regexp_extract("slug", r"-(\d{4})-", 1), F.regexp_extract("slug", r"-(\d+)$", 1)
    rm = F.concat(year, F.lit("/"), F.lpad(((year.cast("int") + 1) % 100).cast("string"), 2, "0"))
    return rows.select("parti", rm.alias("rm"), "slug", F.make_date(year.cast("int"), F.lit(10), F.lit(15)).alias("start"), F.concat(rm, F.lit(":"), number).alias("motion"))


def _decided(f: Frames) -> DataFrame:
    """``votering_id, motion``: what each division decides on."""
    return f.cases.select("votering_id", F.explode(tx.motion_ids(F.col("forslag_text"))).alias("motion"))


def _served(f: Frames) -> DataFrame:
    return served.served(_probes(f), context._editions(f), _budgets(f), _decided(f), SETS, "avtal", "budgetmotion", SHOWN)


_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_SETS = ", ".join(f"({n}, '{k}')" for n, ks in SETS.items() for k in ks)
_SERVED = f"""{context._EDITIONS},
vers(prompt_version) as (values {", ".join(f"('{v}')" for v in VERSIONS)}),
setk(first, document) as (values {_SETS}),
ask as (select v.prompt_version, s.document from vers v join setk s on s.first = (select max(first) from setk where first <= regexp_extract(v.prompt_version, '([0-9]+)$', 1)::int)),
pb as (select c.votering_id, c.rm, party.parti, c.datum, ask.prompt_version, ask.document from c, party, ask where c.datum is not null),
ed1 as (select parti, document, start, max(slug) as slug from ed where document not in ('avtal', 'budgetmotion') group by all),
av as (select start, max(slug) as slug from ed where document = 'avtal' group by start),
bu as (select parti, slug, regexp_extract(slug, '-(\\d{{4}})-', 1)::int as y, regexp_extract(slug, '-(\\d+)$', 1) as no from ed where document = 'budgetmotion'),
bud as (select parti, slug, y || '/' || lpad(((y + 1) % 100)::varchar, 2, '0') as rm, make_date(y, 10, 15) as start, y || '/' || lpad(((y + 1) % 100)::varchar, 2, '0') || ':' || no as motion from bu),
decided as (select distinct votering_id, unnest(regexp_extract_all(forslag_text, '{tx.MOTION_REF}')) as motion from c),
sv as (
  select pb.prompt_version, pb.votering_id, pb.parti, pb.document, ed1.slug from pb join ed1 using (parti, document) where ed1.start <= pb.datum qualify row_number() over (partition by pb.prompt_version, pb.votering_id, pb.parti, pb.document order by ed1.start desc) = 1
  union all select pb.prompt_version, pb.votering_id, pb.parti, pb.document, av.slug from pb join av on av.start <= pb.datum where pb.document = 'avtal' and pb.parti in ({_IN(SHOWN)}) qualify row_number() over (partition by pb.prompt_version, pb.votering_id, pb.parti order by av.start desc) = 1
  union all select pb.prompt_version, pb.votering_id, pb.parti, pb.document, bud.slug from pb join bud using (parti, rm) where pb.document = 'budgetmotion' and bud.start <= pb.datum and not exists (select 1 from decided where decided.votering_id = pb.votering_id and decided.motion = bud.motion))"""


@query(_with(_SERVED, "select prompt_version, votering_id, parti, document, slug from sv"))
def served_documents(f: Frames) -> DataFrame:
    """What each party may see at each division, per version of the document set."""
    return _served(f).select("prompt_version", "votering_id", "parti", "document", "slug")


@query(_with(_SERVED, "select votering_id, parti, slug, motion from c join bud using (rm) join decided using (votering_id, motion) where bud.start <= c.datum"))
def excluded_budgets(f: Frames) -> DataFrame:
    """Budgets left out because the division decides on them."""
    rows = served.keyed_since(f.cases.where("datum is not null").select("votering_id", "rm", F.unix_date("datum").alias("day")), _budgets(f).withColumn("_start", F.unix_date("start")), ["rm"], "day", "_start")
    return rows.join(_decided(f).distinct(), ["votering_id", "motion"]).select("votering_id", "parti", "slug", "motion")


_YEAR = "regexp_extract(slug, '-(\\d{4})-', 1)"
_CONTEXT = f"cx as (select prompt_version, votering_id, parti, concat_ws('-', parti, coalesce(max({_YEAR}) filter (document = 'partiprogram'), 'noprog'), max('avtal') filter (document = 'avtal'), max(regexp_extract(slug, '(\\d{{4}}-\\d+)$', 1)) filter (document = 'budgetmotion')) as context from sv group by prompt_version, votering_id, parti)"


def _contexts(f: Frames) -> DataFrame:
    year = F.regexp_extract("slug", r"-(\d{4})-", 1)
    parts = {"partiprogram": year, "avtal": F.lit("avtal"), "budgetmotion": F.regexp_extract("slug", r"(\d{4}-\d+)$", 1)}
    return served.context_key(_served(f), ["prompt_version", "votering_id", "parti"], parts, {"partiprogram": "noprog"})


@query(_with(f"{_SERVED}, {_CONTEXT}", "select prompt_version, context, count(*) as n, count(distinct votering_id) as n_divisions from cx group by all"))
def party_contexts(f: Frames) -> DataFrame:
    """Contexts (what is served, as one key), with the divisions that share each."""
    return _contexts(f).groupBy("prompt_version", "context").agg(F.count("*").alias("n"), F.count_distinct("votering_id").alias("n_divisions"))


# ---- work dealt by context ----

BATCH, LIMIT, MOST = 240, 6_000.0, 30
_COST = "ceil(length(coalesce(forslag_text, '')) / 3.6) + 700"
_PACKED = f"""{_SERVED}, {_CONTEXT},
dn as (select distinct votering_id, parti from d where run_id = 'run-p6-1'),
todo as (select c.votering_id, cx.parti, cx.context, c.datum, ({_COST})::double as cost from cx join c using (votering_id) where cx.prompt_version = 'p6' and not exists (select 1 from dn where dn.votering_id = cx.votering_id and dn.parti = cx.parti)),
pk(votering_id, parti, context, datum, cost) as ({{rows}}),
ru as (select *, sum(cost) over w - cost / 2 as middle, sum(cost) over (partition by context) as total, count(*) over (partition by context) as n, row_number() over w - 1 as i from pk window w as (partition by context order by datum, votering_id rows unbounded preceding)),
pt as (select *, least(greatest(1, ceil(total / {LIMIT}), ceil(n / {MOST})) - 1, floor(coalesce(middle * greatest(1, ceil(total / {LIMIT}), ceil(n / {MOST})) / total, 0)))::int as part from ru),
st as (select context, part, min(i) as first, ceil(count(*) / {MOST})::int as slots from pt group by all),
sb as (select *, coalesce(sum(slots) over (partition by context order by part rows between unbounded preceding and 1 preceding), 0) as base from st),
gr as (select pt.votering_id, pt.parti, pt.context, (sb.base + floor((pt.i - sb.first) / {MOST}))::int as group_no from pt join sb using (context, part))"""


def _todo(f: Frames) -> DataFrame:
    wanted = _contexts(f).where("prompt_version = 'p6'").select("votering_id", "parti", "context")
    rows = match.pending(wanted, f.decisions.where("run_id = 'run-p6-1'"), ["votering_id", "parti"])
    cost = F.ceil(F.length(F.coalesce("forslag_text", F.lit(""))) / 3.6) + 700
    return rows.join(f.cases.select("votering_id", "datum", cost.cast("double").alias("cost")), "votering_id")


def _dealt(rows: DataFrame) -> DataFrame:
    return balanced_groups(rows, ["context"], [F.col("datum"), F.col("votering_id")], "cost", LIMIT, MOST).select("votering_id", "parti", "context", "group_no")


@query(_with(_PACKED.replace("{rows}", "select * from todo"), "select * from gr"))
def balanced_work(f: Frames) -> DataFrame:
    """Pending divisions of each party and context, dealt into balanced groups by token cost."""
    return _dealt(_todo(f))


@query(_with(_PACKED.replace("{rows}", f"select * from todo order by datum, votering_id, parti limit {BATCH}"), "select context, group_no, count(*) as n, list(parti || ':' || votering_id order by votering_id) as cids from gr group by all"))
def prepared_batch(f: Frames) -> DataFrame:
    """The next batch: the first 240 pending decisions (the size of a batch), then bucketed by context and dealt."""
    rows = _todo(f).orderBy("datum", "votering_id", "parti").limit(BATCH)
    return _dealt(rows).groupBy("context", "group_no").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("votering_id", "parti"))).alias("l")).select("context", "group_no", "n", F.transform("l", lambda x: F.concat(x["parti"], F.lit(":"), x["votering_id"])).alias("cids"))


@query("select run_id, batch_id, count(*) as n_claimed, count(*) filter (votering_id in (select votering_id from c)) as n_known, count(distinct prompt_version) = 1 as one_version, max(regexp_extract(batch_id, '([0-9]+)$', 1)::int) as batch_no from d where batch_id is not null group by run_id, batch_id")
def batch_receipts(f: Frames) -> DataFrame:
    """Per batch: decisions claimed and of known divisions, whether all have one version, and its number."""
    known = f.decisions.where("batch_id is not null").join(f.cases.select("votering_id", F.lit(True).alias("_known")), "votering_id", "left")
    return known.groupBy("run_id", "batch_id").agg(F.count("*").alias("n_claimed"), F.count_if("_known").alias("n_known"), (F.count_distinct("prompt_version") == 1).alias("one_version"), F.max(F.expr("try_cast(regexp_extract(batch_id, '([0-9]+)$', 1) as int)")).alias("batch_no"))


@query("select run_id, count(*) as n, round(sum(usage['input_tokens'] * 5e-6::double + usage['output_tokens'] * 25e-6::double), 6) as cost, round(sum(usage['input_tokens'] * 5e-6::double + usage['output_tokens'] * 25e-6::double) / count(*), 8) as cost_per_decision, ceil(sum(length(motivering)) / 3.6)::bigint as token_estimate from d where usage is not null group by run_id")
def cost_estimate(f: Frames) -> DataFrame:
    """Cost of each run from its tokens at stated prices, and tokens estimated from characters."""
    spent = F.element_at("usage", "input_tokens") * F.lit(0.000005) + F.element_at("usage", "output_tokens") * F.lit(0.000025)
    return f.decisions.where("usage is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum(spent), 6).alias("cost"), F.round(F.sum(spent) / F.count("*"), 8).alias("cost_per_decision"), F.ceil(F.sum(F.length("motivering")) / 3.6).alias("token_estimate"))


# ---- nested documents ----

_RES = "alt as (select upper(trim(votering_id)) as votering_id, trim(alt_id) as alt_id, text, source_partier, inkom_ts from alternatives where trim(votering_id) <> '' and trim(alt_id) <> ''), a1 as (select * from alt qualify row_number() over (partition by votering_id, alt_id order by inkom_ts desc nulls last, text desc nulls last) = 1)"


def _alternatives(f: Frames) -> DataFrame:
    rows = table(f.spark, f.root, "alternatives").select(key_form("votering_id").alias("votering_id"), F.trim("alt_id").alias("alt_id"), "text", "source_partier", "inkom_ts").where("votering_id is not null and alt_id <> ''")
    return capped(rows, ["votering_id", "alt_id"], [F.desc_nulls_last("inkom_ts"), F.desc_nulls_last("text")], 1)


@query(_with(f"{_RES}, q as (select votering_id, list_filter(regexp_split_to_array(coalesce(motforslag_nummer, ''), '[^0-9a-z]+'), lambda x: x <> '') as nos from c)", "select votering_id, ['utskottet'] || coalesce(list('res-' || no order by no) filter (no is not null), []) as alts from (select q.votering_id, case when a1.alt_id like 'res-%' and (len(nos) = 0 or list_contains(nos, substr(a1.alt_id, 5))) then substr(a1.alt_id, 5) end as no from q left join a1 using (votering_id)) group by votering_id"))
def assembled_alternatives(f: Frames) -> DataFrame:
    """The proposals each division chose between: the committee's first, then the reservations it lists (all, where it lists none)."""
    numbers = F.filter(F.split(F.coalesce("motforslag_nummer", F.lit("")), r"[^0-9a-z]+"), lambda x: x != "")
    cases = f.cases.select("votering_id", numbers.alias("nos"))
    rows = _alternatives(f).where("alt_id like 'res-%'").select("votering_id", F.substring("alt_id", 5, 100).alias("no"))
    joined = cases.join(rows, "votering_id", "left").withColumn("no", F.when((F.size("nos") == 0) | F.array_contains("nos", F.col("no")), F.col("no")))
    return joined.groupBy("votering_id").agg(F.concat(F.array(F.lit("utskottet")), F.transform(F.array_sort(F.collect_list("no")), lambda x: F.concat(F.lit("res-"), x))).alias("alts"))


@query(_with(_RES, "select votering_id, map_from_entries(list((k, len) order by k)) as entries from (select votering_id, upper(alt_id) as k, arg_max(length(text), (coalesce(inkom_ts, timestamp '1970-01-01'), length(text))) as len from alt where text is not null group by all) group by votering_id"))
def alternatives_map(f: Frames) -> DataFrame:
    """Per division a map from the upper-cased alternative to the length of its text; the last row wins."""
    rows = table(f.spark, f.root, "alternatives").where("text is not null").select(key_form("votering_id").alias("votering_id"), "alt_id", F.length("text").alias("len"), F.coalesce(F.unix_micros(F.col("inkom_ts").cast("timestamp")), F.lit(0)).alias("at")).where("votering_id is not null")
    return nested.last_by_key(rows, ["votering_id"], F.col("alt_id"), "len", "at")


@query("select run_id, cid, trim(list_filter(citations, lambda x: x.document = 'valmanifest')[1].quote) as quote from d where citations is not null")
def first_manifesto_quote(f: Frames) -> DataFrame:
    """The first citation of one kind in each decision, null where it has none."""
    return f.decisions.where("citations is not null").select("run_id", "cid", nested.first_by(F.col("citations"), "valmanifest", "quote", "document").alias("quote"))


@query("select run_id, cid, case when len(flags) > 0 then flags else flatten(list_transform(citations, lambda x: [x.document, x.princip])) end as marks from d")
def flat_marks(f: Frames) -> DataFrame:
    """A decision's flags where it has any, else what its citations name, put together in order."""
    return f.decisions.select("run_id", "cid", nested.flat_or_chunks(F.col("flags"), F.transform("citations", lambda c: F.array(c["document"], c["princip"]))).alias("marks"))


@query(f"select votering_id, list_slice(ids, 1, 20) as refs, len(list_filter(ids, lambda x: x[:4] = rm[:4])) as n_same_session from (select votering_id, rm, list_filter(i, lambda x, k: list_position(i, x) = k) as ids from (select votering_id, rm, regexp_extract_all(concat_ws(' ', forslag_text, notis), '{tx.MOTION_REF}') as i from c)) where len(ids) > 0")
def case_references(f: Frames) -> DataFrame:
    """The first twenty documents a division deals with (the number is the contract), and how many are of its session."""
    ids = tx.motion_ids(F.concat_ws(" ", "forslag_text", "notis"))
    rows = f.cases.select("votering_id", "rm", ids.alias("ids")).where(F.size("ids") > 0)
    return rows.select("votering_id", F.slice("ids", 1, 20).alias("refs"), F.size(F.filter("ids", lambda x: F.substring(x, 1, 4) == F.substring("rm", 1, 4))).cast("bigint").alias("n_same_session"))


_KIND = f"case when regexp_matches(forslag_text, '{tx.BUDGET}') or trim(beteckning) = '{tx.BUDGET_REPORT}' then 'budget' when regexp_matches(forslag_text, '{tx.BILL}') then 'proposition' when regexp_matches(forslag_text, '{tx.MOTION}') then 'motion' else 'other' end"


@query(_with(f"{_RES}, rs as (select votering_id, count(*) as n_reservations from a1 where alt_id <> 'utskottet' group by votering_id), {pl._AUTHORS}, ap as (select votering_id, list(parti order by seat_order) as parties from aut join party using (parti) group by votering_id)", f"select votering_id, {_KIND} as kind, coalesce(policy_area, '{domain.OTHER_AREA}') as policy_area, trim(utskott) as committee, len(list_distinct(regexp_extract_all(coalesce(forslag_text, ''), '{tx.MOTION_REF}'))) as n_motions, coalesce(n_reservations, 0) as n_reservations, coalesce(regexp_matches(forslag_text, '{tx.BUDGET}'), false) or coalesce(trim(beteckning) = '{tx.BUDGET_REPORT}', false) as is_budget, coalesce(parties, []) as parties from c left join area on area.utskott_key = upper(trim(c.utskott)) left join rs using (votering_id) left join ap using (votering_id)"))
def case_facts(f: Frames) -> DataFrame:
    """What can be told of a case without reading it: kind, area, motions, reservations, parties in the order of their seats."""
    from votaria.operators import counterfactual as cf
    from votaria.operators import decisions as dc

    many = _alternatives(f).where("alt_id <> 'utskottet'").groupBy("votering_id").agg(F.count("*").alias("n_reservations"))
    who = dc.authors(table(f.spark, f.root, "alternatives"), list(domain.PARTIES)).join(F.broadcast(f.parties.select("parti", "seat_order")), "parti")
    who = who.groupBy("votering_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seat_order", "parti"))), lambda x: x["parti"]).alias("parties"))
    rows = cf.with_area(f.cases, domain.areas(f.spark)).join(many, "votering_id", "left").join(who, "votering_id", "left")
    return rows.select(
        "votering_id", tx.proposal_kind(F.col("forslag_text"), F.col("beteckning")).alias("kind"), "policy_area", F.trim("utskott").alias("committee"), F.greatest(F.lit(0), F.size(tx.motion_ids(F.coalesce("forslag_text", F.lit(""))))).cast("bigint").alias("n_motions"),
        F.coalesce("n_reservations", F.lit(0)).alias("n_reservations"), tx.is_budget(F.col("forslag_text"), F.col("beteckning")).alias("is_budget"), F.coalesce("parties", F.array().cast("array<string>")).alias("parties"),
    )


@query(_with("p8 as (select distinct left(upper(trim(votering_id)), 8) as prefix from decisions where trim(votering_id) <> ''), two as (select * from p8 union select distinct left(prefix, 2) from p8)", "select prefix, count(c.votering_id) as n, case when count(c.votering_id) = 1 then min(c.votering_id) end as votering_id, case when count(c.votering_id) = 0 then 'none' when count(c.votering_id) = 1 then 'one' else 'many' end as verdict from two left join c on left(c.votering_id, length(prefix)) = prefix group by prefix"))
def prefix_lookup(f: Frames) -> DataFrame:
    """Divisions found by the first signs of their id; only a single hit is an answer."""
    ids = table(f.spark, f.root, "decisions").select(F.substring(key_form("votering_id"), 1, 8).alias("prefix")).where("prefix is not null").distinct()
    asked = ids.union(ids.select(F.substring("prefix", 1, 2))).distinct()
    return match.prefix_lookup(asked, f.cases.select("votering_id"), "prefix", "votering_id", [2, 8])


# ---- matches within a division or report ----


@query(_with(f"{_RES}, own as (select party.parti, a1.votering_id, a1.alt_id, list_contains(regexp_split_to_array(upper(coalesce(a1.source_partier, '')), '[^A-ZÅÄÖ]+'), party.parti)::int as n from a1, party where a1.alt_id like 'res-%')", "select votering_id, parti, alt_id, n as n_shared from own qualify row_number() over (partition by votering_id, parti order by n desc, alt_id) = 1"))
def own_reservation(f: Frames) -> DataFrame:
    """For each division with reservations and each party, the reservation it shares most authors with, else the first."""
    rows = _alternatives(f).where("alt_id like 'res-%'").select("votering_id", "alt_id", F.transform(packed_values("source_partier"), F.upper).alias("authors"))
    asked = rows.select("votering_id").distinct().crossJoin(F.broadcast(f.parties.select("parti"))).withColumn("want", F.array("parti"))  # eight parties
    best = match.best_overlap(asked, rows.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))), ["votering_id"], "want", "authors", "alt_id")
    return best.select("votering_id", "parti", "alt_id", F.col("n_shared").cast("int").alias("n_shared"))


_COVER = f"""want as (select votering_id, dok_id, list_distinct(regexp_extract_all(forslag_text, '{tx.MOTION_REF}')) as w from c where dok_id is not null and forslag_text is not null),
have as (select upper(trim(dok_id)) as dok_id, doc_id, list_distinct(regexp_extract_all(text, '{tx.MOTION_REF}')) as h from documents where trim(dok_id) <> '' and text is not null),
sc as (select votering_id, doc_id, case when len(w) = 0 then 0 else len(list_intersect(w, h))::double / len(w) end as score from want join have using (dok_id))"""


@query(_with(_COVER, "select votering_id, doc_id, score, row_number() over (partition by votering_id order by score desc, doc_id)::int as rank from sc qualify rank <= 3"))
def covering_documents(f: Frames) -> DataFrame:
    """The three documents of a division's report that name most of the motions it decides on (a top-k report)."""
    want = f.cases.where("dok_id is not null and forslag_text is not null").select("votering_id", "dok_id", tx.motion_ids(F.col("forslag_text")).alias("want"))
    have = table(f.spark, f.root, "documents").where("text is not null").select(key_form("dok_id").alias("dok_id"), "doc_id", tx.motion_ids(F.col("text")).alias("have"), F.col("doc_id").alias("at")).where("dok_id is not null")
    return match.top_coverage(want, have, ["dok_id"], ["votering_id"], "want", "doc_id", "have", "at", 3).select("votering_id", "doc_id", "score", "rank")


@query("select distinct x.votering_id, coalesce(e.v, l.v) as rubrik from decisions x left join (select votering_id, min(rubrik) as v from cases group by votering_id) e using (votering_id) left join (select lower(votering_id) as k, min(rubrik) as v from cases group by lower(votering_id)) l on l.k = lower(x.votering_id) where x.votering_id is not null")
def fallback_titles(f: Frames) -> DataFrame:
    """Titles under the id as written, else under the id without regard to case."""
    ids = table(f.spark, f.root, "decisions").where("votering_id is not null").select("votering_id").distinct()
    return match.fallback_join(ids, table(f.spark, f.root, "cases").where("votering_id is not null").select("votering_id", "rubrik"), "votering_id", "rubrik")


@query(_with("daily as (select left(period, 10)::date as day, min(obs_id) as o from indicators where length(period) = 10 group by all), monthly as (select left(regexp_replace(period, '[^0-9]', '', 'g'), 6) as ym, min(obs_id) as o from indicators where length(period) = 7 group by all)", "select votering_id, coalesce(daily.o, monthly.o) as obs_id, case when daily.o is not null then 'day' when monthly.o is not null then 'month' else 'none' end as source from c left join daily on daily.day = c.datum left join monthly on monthly.ym = strftime(c.datum, '%Y%m')"))
def fallback_sources(f: Frames) -> DataFrame:
    """A figure of the division's day, else of its month, else none."""
    rows = table(f.spark, f.root, "indicators").where("length(period) in (7, 10)").select("obs_id", F.length("period").alias("k"), F.substring(F.regexp_replace("period", "[^0-9]", ""), 1, 8).alias("p"))
    day = rows.where("k = 10").groupBy(F.to_date("p", "yyyyMMdd").alias("datum")).agg(F.min("obs_id").alias("_day"))
    month = rows.where("k = 7").groupBy(F.substring("p", 1, 6).alias("ym")).agg(F.min("obs_id").alias("_month"))
    joined = f.cases.select("votering_id", "datum", F.date_format("datum", "yyyyMM").alias("ym")).join(F.broadcast(day), "datum", "left").join(F.broadcast(month), "ym", "left")  # indicators do not grow
    return joined.select("votering_id", F.coalesce("_day", "_month").alias("obs_id"), F.when(F.col("_day").isNotNull(), "day").when(F.col("_month").isNotNull(), "month").otherwise("none").alias("source"))


# ---- citations mended ----

BROAD = [("partiprogram", "väntas vara klar"), ("budgetmotion", "inte minst för")]
_KEY = context._KEY
_BLOCK, _WEAK = (", ".join(f"('{d}', '{p}')" for d, p in xs) for xs in (PHRASES, BROAD))
_HIT = "len(list_filter({list}, lambda p: p.document = x.document and x.q <> '' and (contains(x.q, p.phrase) or contains(p.phrase, x.q)))) > 0"
_MARKED = f"""bl as (select list({{'document': document, 'phrase': phrase}}) as b from (values {_BLOCK}) t(document, phrase)), wk as (select list({{'document': document, 'phrase': phrase}}) as w from (values {_WEAK}) t(document, phrase)),
ex as (select d.run_id, d.cid, d.flags, i, {{'cite_id': x.cite_id, 'document': x.document, 'q': coalesce({_KEY.format("x.quote")}, '')}} as x from d, unnest(citations) with ordinality as u(x, i)),
hit as (select run_id, cid, i, x.cite_id as cite_id, {_HIT.format(list="b")} as blocked, {_HIT.format(list="w")} as weak from ex, bl, wk)"""


def _marked(f: Frames) -> DataFrame:
    return repair.marked(repair.stripped(f.decisions, PHRASES), BROAD)


@query(_with(_MARKED, "select d.run_id, d.cid, coalesce(n_blocked, 0) as n_blocked, coalesce(n_weak, 0) as n_weak, coalesce(kept, []) as kept, coalesce(weak, []) as weak, list_sort(list_concat(list_filter(coalesce(flags, []), lambda x: x not in ('citat_blockerat', 'citat_svagt')), case when n_blocked > 0 then ['citat_blockerat'] else [] end, case when n_weak > 0 then ['citat_svagt'] else [] end)) as flags from d left join (select run_id, cid, count(*) filter (blocked) as n_blocked, count(*) filter (weak and not blocked) as n_weak, list(cite_id order by i) filter (not blocked) as kept, list(cite_id order by i) filter (weak and not blocked) as weak from hit group by run_id, cid) using (run_id, cid)"))
def marked_citations(f: Frames) -> DataFrame:
    """Decisions without citations of listed phrases, weak ones marked, and the flags that go with it."""
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["cite_id"]), F.array().cast("array<bigint>"))
    weak = F.filter("citations", lambda c: F.coalesce(c["svag"], F.lit(False)))
    return _marked(f).select("run_id", "cid", F.col("n_blocked").cast("bigint").alias("n_blocked"), F.col("n_weak").cast("bigint").alias("n_weak"), ids(F.col("citations")).alias("kept"), ids(weak).alias("weak"), F.sort_array("flags").alias("flags"))


@query()
def repaired_decisions(f: Frames) -> DataFrame:
    """Decisions with their citations aligned with the cited document, then stripped and marked, and the counts of each step."""
    rows = cut(f.decisions.select("run_id", "cid", "citations", "flags"))
    done = repair.aligned(rows, context.quote_verdicts(f, rows), ["run_id", "cid"])
    done = repair.marked(repair.stripped(done, PHRASES), BROAD)
    return done.select("run_id", "cid", "n_ok", "n_fixed", "n_failed", "n_blocked", "n_weak", F.transform("citations", lambda c: F.struct(c["cite_id"].alias("cite_id"), c["document"].alias("document"), c["quote"].alias("quote"), c["quote_ej_verifierad"].alias("quote_ej_verifierad"), c["svag"].alias("svag"))).alias("citations"), "flags")

