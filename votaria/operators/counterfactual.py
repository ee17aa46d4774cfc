"""Divisions re-run with stated commitments in place of the floor votes, and statistics per area and party."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votaria.domain import DECIDED, OTHER_AREA
from votaria.expr import rate


def _outcome(ja: Column, nej: Column) -> Column:
    """Ja or Nej; null for a tie, which has no determinate result."""
    return F.when(ja > nej, "Ja").when(nej > ja, "Nej")


def flips(pos: DataFrame, stances: DataFrame) -> DataFrame:
    """One row per division with movers: real and counterfactual totals and outcomes.

    ``stances`` has ``votering_id, parti, implied, tier``. A party moves when its plan is explicit, it voted Ja or Nej
    and its plan says the other; then all who voted go to the implied side. Other parties keep their counts.
    """
    rows = pos.join(stances.select("votering_id", "parti", "implied", "tier"), ["votering_id", "parti"], "left")
    moves = F.coalesce((F.col("tier") == "explicit") & F.col("position").isin(DECIDED) & (F.col("implied") != F.col("position")), F.lit(False))
    cast = F.col("n_ja") + F.col("n_nej") + F.col("n_avstar")
    to = lambda side, own: F.when(moves, F.when(F.col("implied") == side, cast).otherwise(0)).otherwise(F.col(own))
    sums = rows.groupBy("votering_id").agg(
        F.sum("n_ja").alias("real_ja"), F.sum("n_nej").alias("real_nej"), F.sum(to("Ja", "n_ja")).alias("cf_ja"), F.sum(to("Nej", "n_nej")).alias("cf_nej"),
        F.array_sort(F.collect_list(F.when(moves, F.col("parti")))).alias("movers"),
    )
    out = sums.where(F.size("movers") > 0).withColumn("real_outcome", _outcome(F.col("real_ja"), F.col("real_nej"))).withColumn("cf_outcome", _outcome(F.col("cf_ja"), F.col("cf_nej")))
    return out.withColumn("flips", F.coalesce(F.col("real_outcome") != F.col("cf_outcome"), F.lit(False)))


def flip_summary(flipped: DataFrame) -> DataFrame:
    """Totals over all divisions with movers."""
    tie = F.col("real_outcome").isNull() | F.col("cf_outcome").isNull()
    return flipped.agg(F.count("*").alias("n_with_movers"), F.count_if("flips").alias("n_flipped"), F.count_if(F.col("flips") & (F.size("movers") == 1)).alias("n_solo"), F.count_if(tie).alias("n_indeterminate"), F.count_if(F.col("flips") & (F.col("real_outcome") == "Ja")).alias("ja_to_nej"), F.count_if(F.col("flips") & (F.col("real_outcome") == "Nej")).alias("nej_to_ja"))


def flip_parties(flipped: DataFrame) -> DataFrame:
    """Per party: divisions in which it moves, those that flip, and those it flips alone."""
    return flipped.select(F.explode("movers").alias("parti"), "flips", (F.size("movers") == 1).alias("_solo")).groupBy("parti").agg(F.count("*").alias("movers"), F.count_if("flips").alias("n_flips"), F.count_if(F.col("flips") & F.col("_solo")).alias("n_solo"))


def with_area(cases: DataFrame, areas: DataFrame) -> DataFrame:
    """Cases with their policy area, by committee without regard to case; others get OTHER_AREA."""
    return cases.withColumn("utskott_key", F.upper(F.trim("utskott"))).join(F.broadcast(areas), "utskott_key", "left").withColumn("policy_area", F.coalesce("policy_area", F.lit(OTHER_AREA))).drop("utskott_key")


def area_cube(facts: DataFrame) -> DataFrame:
    """Area by party at four grains: how often the vote follows the plan, abstentions beside it, explicit gaps.

    ``facts`` has ``policy_area, parti, position, implied, tier, votering_id``.
    """
    decided = F.col("position").isin(DECIDED)
    follows = F.col("implied") == F.col("position")
    explicit = decided & (F.col("tier") == "explicit")
    cube = facts.where("implied is not null").cube("policy_area", "parti").agg(
        F.grouping_id().alias("level"), F.count_if(decided).alias("n"), F.count_if(decided & follows).alias("follows"), F.count_if(F.col("position") == "Avstår").alias("abstained"),
        F.count_if(explicit).alias("explicit_n"), F.count_if(explicit & ~follows).alias("explicit_gap"), F.count_distinct("votering_id").alias("n_cases"),
    )
    return cube.withColumn("follow_rate", rate(F.col("follows"), F.col("n"))).withColumn("explicit_gap_rate", rate(F.col("explicit_gap"), F.col("explicit_n")))


def interval_verdict(cube: DataFrame) -> DataFrame:
    """95 % half-width of the follow rate, whether it is thin, and the verdict against the party's own rate (0.05)."""
    own = cube.where("level = 2").select("parti", F.col("follow_rate").alias("own_rate"))
    p = F.col("follow_rate")
    cells = cube.where("level = 0 and n > 0").join(F.broadcast(own), "parti", "left")
    half = F.round(1.96 * F.sqrt(p * (1 - p) / F.col("n")), 4)
    delta = p - F.col("own_rate")
    return cells.select("policy_area", "parti", "n", "follow_rate", half.alias("half_width"), (F.col("n") < 40).alias("thin"), F.when(delta > 0.05, "strong").when(delta < -0.05, "weak").otherwise("even").alias("verdict"))
