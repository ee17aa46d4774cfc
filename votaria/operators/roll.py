"""From member votes to party positions, divisions, outcomes, pairs and dissent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votaria.domain import CAST, DECIDED, GOVERNMENT, PARTIES, VOTES
from votaria.expr import day_of, filled, key_form
from votaria.operators.shape import latest_per_key


def vote_form(col: str) -> Column:
    """The vote as one of VOTES, whatever its case and blanks; null otherwise."""
    c = F.initcap(F.trim(col))
    return F.when(c.isin(VOTES), c)


def main_votes(votes: DataFrame) -> DataFrame:
    """Member votes of the main vote on the matter itself, in clean form; repeated rows are still in it."""
    party = F.upper(F.trim("parti"))
    rows = votes.where("avser = 'sakfrågan' and votering = 'huvud'").select(
        key_form("votering_id").alias("votering_id"), party.alias("parti"), "intressent_id", "namn", vote_form("rost").alias("rost"), "rm", "beteckning", "punkt", day_of("datum").alias("datum"), key_form("dok_id").alias("dok_id"),
    )
    return rows.where(F.col("parti").isin(list(PARTIES)) & F.col("votering_id").isNotNull() & F.col("rost").isNotNull())


def member_votes(votes: DataFrame) -> DataFrame:
    """One row per member, division and vote: five columns are read, and repeated rows go."""
    return main_votes(votes).select("votering_id", "parti", "intressent_id", "namn", "rost").distinct()


def positions(main: DataFrame) -> DataFrame:
    """``votering_id, parti`` with counts per vote, the majority position (Ja before Nej before Avstår), cohesion and seats."""
    counted = main.groupBy("votering_id", "parti").agg(*[F.count_if(F.col("rost") == v).alias(n) for v, n in zip(VOTES, ["n_ja", "n_nej", "n_avstar", "n_franvarande"], strict=True)])
    most, cast = F.greatest("n_ja", "n_nej", "n_avstar"), F.col("n_ja") + F.col("n_nej") + F.col("n_avstar")
    position = F.when(cast == 0, "Frånvarande").when(F.col("n_ja") == most, "Ja").when(F.col("n_nej") == most, "Nej").otherwise("Avstår")
    return counted.withColumn("position", position).withColumn("cohesion", F.when(cast == 0, 1.0).otherwise(most / cast)).withColumn("seats", cast + F.col("n_franvarande"))


def divisions(main: DataFrame) -> DataFrame:
    """One row per division: report, year, point and the latest day."""
    return main.groupBy("votering_id").agg(F.min("dok_id").alias("dok_id"), F.min("rm").alias("rm"), F.min("beteckning").alias("beteckning"), F.min("punkt").alias("punkt"), F.max("datum").alias("datum"), F.count("*").alias("n_members"))


def current_cases(cases: DataFrame) -> DataFrame:
    """The latest version of each division, with clean id, day and month."""
    rows = cases.withColumn("votering_id", key_form("votering_id")).where("votering_id is not null")
    rows = latest_per_key(rows, ["votering_id"], F.col("inkom_ts"), ["borttagen_ts", "datum", "beteckning", "punkt"])
    return rows.withColumn("datum", day_of("datum")).withColumn("month", F.date_format("datum", "yyyy-MM")).withColumn("dok_id", key_form("dok_id"))


def split_orphans(divided: DataFrame, cases: DataFrame) -> DataFrame:
    """Divisions with the reason why they cannot become cases, null where they can: no report, or no text."""
    known = cases.select("votering_id", F.lit(True).alias("_known"), filled("forslag_text").alias("_text"))
    reason = F.when(F.col("_known").isNull(), "no case").when(F.col("_text").isNull(), "no text")
    return divided.join(known, "votering_id", "left").withColumn("reason", reason).drop("_known", "_text")


def chamber(pos: DataFrame) -> DataFrame:
    """Totals and outcome per division; a tie counts as Nej."""
    totals = pos.groupBy("votering_id").agg(F.sum("n_ja").alias("ja"), F.sum("n_nej").alias("nej"))
    return totals.withColumn("outcome", F.when(F.col("ja") > F.col("nej"), "Ja").otherwise("Nej"))


def pair_rates(lines: DataFrame, line: str = "position") -> DataFrame:
    """Share of divisions in which two parties took one line, over all years and per ``rm`` (null: all), dense.

    A self-join on the division: a division has one row per party, so the pairs are bounded by the parties squared.
    """
    a = lines.select("votering_id", "rm", F.col("parti").alias("party_a"), F.col(line).alias("_a"))
    b = lines.select("votering_id", F.col("parti").alias("party_b"), F.col(line).alias("_b"))
    agree = F.count_if(F.col("_a") == F.col("_b"))
    pairs = a.join(b, "votering_id").groupBy("party_a", "party_b", "rm").agg(F.count("*").alias("n"), agree.alias("n_agree"))
    both = pairs.rollup("party_a", "party_b", "rm").agg(F.sum("n").alias("n"), F.sum("n_agree").alias("n_agree"), F.grouping_id().alias("_g")).where("_g <= 1").drop("_g")
    return both.withColumn("rate", F.round(F.try_divide(F.col("n_agree").cast("double"), F.col("n").cast("double")), 3))


def defeats(pos: DataFrame, cases: DataFrame, government: list[str] = GOVERNMENT) -> DataFrame:
    """Divisions in which the government parties shared a line, and the chamber went the other way; a null line counts as a line."""
    line = pos.where(F.col("parti").isin(government)).groupBy("votering_id").agg(F.min("position").alias("gov_pos"), F.max("position").alias("_other"), F.count_if(F.col("position").isNull()).alias("_nulls"))
    line = line.where((F.col("gov_pos") == F.col("_other")) & (F.col("_nulls") == 0) & F.col("gov_pos").isin(DECIDED)).drop("_other", "_nulls")
    lost = line.join(chamber(pos), "votering_id").where("gov_pos <> outcome")
    return lost.join(cases, "votering_id").select("votering_id", "datum", F.coalesce(filled("rubrik"), F.col("beteckning")).alias("rubrik"), F.format_string("%s:%s p.%d", "rm", "beteckning", "punkt").alias("bet"), "gov_pos", "outcome")


def cohesion_series(pos: DataFrame, cases: DataFrame) -> DataFrame:
    """Per party and month: mean cohesion and absence."""
    rows = pos.where("position <> 'Frånvarande'").join(cases.select("votering_id", "month"), "votering_id")
    return rows.groupBy("parti", "month").agg(F.round(F.avg("cohesion"), 4).alias("cohesion"), F.round(F.avg(F.col("n_franvarande") / F.col("seats")), 4).alias("absence"), F.count("*").alias("n"))


def dissenters(main: DataFrame, pos: DataFrame, by: list[str]) -> DataFrame:
    """Per member (by name, or by id): votes cast, votes against the party's line, and the rate; members without dissent are left out."""
    line = pos.where("position <> 'Frånvarande'").select("votering_id", "parti", "position")
    rows = main.where(F.col("rost").isin(CAST)).join(line, ["votering_id", "parti"])
    per = rows.groupBy(*by).agg(F.count("*").alias("n_cast"), F.count_if(F.col("rost") != F.col("position")).alias("n_dissent"))
    return per.where("n_dissent > 0").withColumn("rate", F.round(F.col("n_dissent") / F.col("n_cast"), 4))
