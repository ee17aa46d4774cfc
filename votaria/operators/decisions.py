"""Decisions against positions: agreement, kappa, confusion, gaps by evidence tier, rival predictors, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votaria.domain import CAST, DECIDED, IMPLIED, TIERS
from votaria.expr import key_form, rate
from votaria.operators.shape import dense, first_per_key

CID = ["run_id", "parti", "votering_id", "prompt_version", "arm"]


def implied_vote(stance: Column) -> Column:
    """The vote that a stance on the demand implies."""
    return F.when(stance == "stodjer", IMPLIED["stodjer"]).when(stance == "avvisar", IMPLIED["avvisar"])


def evidence_tier() -> Column:
    """How well the plan reaches the case: explicit, off_axis, or extrapolated (also for nulls)."""
    explicit = (F.col("coverage") == "explicit") & F.col("confidence").isin("high", "medium")
    return F.when(explicit, TIERS[0]).when(F.col("plan_tacker_utskottets_skal") == "nej", TIERS[2]).otherwise(TIERS[1])


def override() -> tuple[Column, Column]:
    """Own documents explicitly imply opposing the committee: the case counts, and it counts strictly."""
    counts = F.col("rost").isin("Nej", "Avstår") & (F.col("coverage") == "explicit")
    return F.coalesce(counts, F.lit(False)), F.coalesce(counts & (F.col("confidence") == "high"), F.lit(False))


def clean_decisions(decisions: DataFrame) -> DataFrame:
    """One row per decision id (first wins); a missing arm is the anonymous one."""
    rows = decisions.withColumns({"votering_id": key_form("votering_id"), "parti": key_form("parti"), "arm": F.coalesce("arm", F.lit("anonymous"))}).where("votering_id is not null and parti is not null")
    return first_per_key(rows, CID, F.col("inkom_ts"), ["collected_at", "batch_id", "rost", "hallning"]).withColumn("cid", F.concat_ws(":", "parti", "votering_id", "prompt_version", "arm"))


def decision_facts(decisions: DataFrame, pos: DataFrame, cases: DataFrame) -> DataFrame:
    """Decisions joined to positions and cases, absences left out: the frame of all agreement statistics."""
    joined = decisions.join(pos.where("position <> 'Frånvarande'").select("votering_id", "parti", "position"), ["votering_id", "parti"])
    joined = joined.join(cases.select("votering_id", "datum", "month", "rubrik", "utskott", "vinnare"), "votering_id", "left")
    return joined.withColumn("agree", F.col("rost") == F.col("position")).withColumn("tier", evidence_tier()).withColumn("implied", implied_vote(F.col("hallning")))


def agreement(facts: DataFrame, by: list[str]) -> DataFrame:
    """n, agreement, and the share of real abstentions foreseen (null where there are none)."""
    real = F.col("position") == "Avstår"
    return facts.groupBy(*by).agg(F.count("*").alias("n"), rate(F.count_if("agree"), F.count("*")).alias("agreement"), rate(F.count_if(real & (F.col("rost") == "Avstår")), F.count_if(real)).alias("avstar_recall"))


def kappa(facts: DataFrame, by: list[str], a: str = "rost", b: str = "position") -> DataFrame:
    """Cohen's kappa per group from pair counts and marginals; 1 where chance agreement is complete. Null labels are left out."""
    pairs = facts.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    rows = pairs.groupBy(*by, F.col("_a").alias("_label")).agg(F.sum("_n").alias("_na"))
    columns = pairs.groupBy(*by, F.col("_b").alias("_label")).agg(F.sum("_n").alias("_nb"))
    chance = rows.join(columns, [*by, "_label"]).groupBy(*by).agg(F.sum(F.col("_na").cast("double") * F.col("_nb")).alias("_s"))
    seen = pairs.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    expected = F.coalesce(F.col("_s"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    observed = F.col("_same") / F.col("n")
    value = F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected))
    return seen.join(chance, by, "left").select(*by, "n", F.round(value, 4).alias("kappa"))


def confusion(facts: DataFrame, parties: DataFrame) -> DataFrame:
    """Dense counts of predicted by actual vote per party; labels outside the cast votes are dropped."""
    spark = facts.sparkSession
    labels = spark.createDataFrame([(a, b) for a in CAST for b in CAST], "predicted string, actual string")
    spine = parties.select("parti").crossJoin(F.broadcast(labels))  # 8 x 9 rows of dimensions
    counts = facts.groupBy("parti", F.col("rost").alias("predicted"), F.col("position").alias("actual")).agg(F.count("*").alias("n"))
    return dense(counts, spine, ["parti", "predicted", "actual"], ["n"])


def gap_blocks(facts: DataFrame) -> DataFrame:
    """Plan against behaviour over decided votes: in all, per tier, per party, and both (grouping sets)."""
    rows = facts.where(F.col("implied").isNotNull() & F.col("position").isin(DECIDED)).withColumn("gap", F.col("implied") != F.col("position"))
    block = rows.cube("parti", "tier").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if("gap").alias("n_gap"),
        F.count_if(F.col("gap") & (F.col("implied") == "Nej")).alias("plan_nej_voted_ja"), F.count_if(F.col("gap") & (F.col("implied") == "Ja")).alias("plan_ja_voted_nej"),
    )
    return block.withColumn("aligned", F.col("n") - F.col("n_gap")).withColumn("gap_rate", rate(F.col("n_gap"), F.col("n")))


def validity(facts: DataFrame) -> DataFrame:
    """Gap rate by the level of each self-reported field; a missing level is called None."""
    rows = facts.where(F.col("implied").isNotNull() & F.col("position").isin(DECIDED)).withColumn("gap", F.col("implied") != F.col("position"))
    long = rows.select("gap", "coverage", "confidence", "plan_tacker_utskottets_skal").unpivot("gap", ["coverage", "confidence", "plan_tacker_utskottets_skal"], "field", "level")
    return long.groupBy("field", F.coalesce("level", F.lit("None")).alias("level")).agg(F.count("*").alias("n"), rate(F.count_if("gap"), F.count("*")).alias("gap_rate"))


def stance_skew(facts: DataFrame, n_parties: int) -> DataFrame:
    """How one-sided stances are: shares, and divisions in which all parties took one stance."""
    rows = facts.where("hallning is not null")
    case = rows.groupBy("votering_id").agg(F.count_distinct("parti").alias("p"), F.min("hallning").alias("lo"), F.max("hallning").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("hallning") == "stodjer").alias("s"), F.count_if(F.col("position") == "Avstår").alias("a"))
    full, one = F.col("p") == n_parties, F.col("lo") == F.col("hi")
    return case.agg(rate(F.sum("s"), F.sum("n")).alias("stodjer_rate"), F.count_if(full).alias("n_cases_all_parties"), F.count_if(full & one & (F.col("lo") == "stodjer")).alias("unanimous_stodjer"), F.count_if(full & one & (F.col("lo") == "avvisar")).alias("unanimous_avvisar"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_abstentions"))


def rivals(facts: DataFrame, by: list[str]) -> DataFrame:
    """The implied vote against the rule 'always Ja'."""
    rows = facts.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("position") == "Ja").alias("_ja"), F.count_if("agree").alias("_hit"))
    return rows.select(*by, "n", rate(F.col("_ja"), F.col("n")).alias("coalition_baseline"), rate(F.col("_hit"), F.col("n")).alias("programme_accuracy"), rate(F.col("_hit") - F.col("_ja"), F.col("n")).alias("programme_lift"))


def override_buckets(facts: DataFrame) -> DataFrame:
    """Per party: overrides over cases, strict and loose, by authorship. Buckets overlap, so each is a conditional count."""
    counts, strict = override()
    done = F.col("position") == "Ja"
    who = {"all": F.lit(True), "authored": F.col("authored"), "not_authored": ~F.col("authored")}
    each = {"loose": counts, "strict": strict}
    cells = [(t, w, F.count_if(c & x), F.count_if(c & x & done)) for t, c in each.items() for w, x in who.items()]
    wide = facts.groupBy("parti").agg(*[a.alias(f"{t}_{w}_{k}") for t, w, den, num in cells for k, a in (("den", den), ("num", num))])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(w).alias("authorship"), F.col(f"{t}_{w}_den").alias("den"), F.col(f"{t}_{w}_num").alias("num")) for t, w, _, _ in cells])
    return wide.select("parti", F.inline(rows)).withColumn("rate", rate(F.col("num"), F.col("den")))


def authors(alternatives: DataFrame, parties: list[str]) -> DataFrame:
    """``votering_id, parti``: parties behind a reservation; packed party fields are split."""
    from votaria.operators.packed import packed_values

    rows = alternatives.where(F.trim("alt_id").startswith("res")).select(key_form("votering_id").alias("votering_id"), F.explode(packed_values("source_partier")).alias("parti"))
    return rows.select("votering_id", F.upper("parti").alias("parti")).where(F.col("parti").isin(parties) & F.col("votering_id").isNotNull()).distinct()


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per party: decisions in both runs and in one only, and how often the fields agree (null-safe)."""
    fields = ["rost", "coverage", "confidence"]
    left = a.select("parti", "votering_id", F.lit(True).alias("_a"), *[F.col(f).alias(f"{f}_a") for f in fields])
    right = b.select("parti", "votering_id", F.lit(True).alias("_b"), *[F.col(f).alias(f"{f}_b") for f in fields])
    both = left.join(right, ["parti", "votering_id"], "full_outer")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = [F.count_if(shared & F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))).alias(f"same_{f}") for f in fields]
    return both.groupBy("parti").agg(F.count_if(shared).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), *same)
