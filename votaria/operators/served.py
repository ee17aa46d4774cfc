"""Which documents a party may see at a division: editions in force, gates by date and key, and exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votaria.operators.match import asof_version, versions


def document_sets(df: DataFrame, sets: Mapping[int, Sequence[str]], version: str) -> DataFrame:
    """Every row with the kinds of document its version may use, one row each.

    ``sets`` names the first version of each set by number; versions are written with a letter and a number and are
    compared as numbers, so that p10 comes after p9. Versions before the first set, or without a number, give no rows.
    """
    number = F.expr(f"try_cast(regexp_extract({version}, '([0-9]+)$', 1) as int)")
    chosen = F.coalesce(*[F.when(number >= first, F.array(*[F.lit(k) for k in sets[first]])) for first in sorted(sets, reverse=True)])
    return df.withColumn("document", F.explode(chosen))


def gated(df: DataFrame, column: str, members: Sequence[str], day: str, since: Column) -> DataFrame:
    """Rows of the listed members, from a day on."""
    return df.where(F.col(column).isin(list(members)) & (F.col(day) >= since))


def keyed_since(probes: DataFrame, documents: DataFrame, on: list[str], day: str, start: str) -> DataFrame:
    """Documents under the same key that had been handed in by the probe's day (equality and order)."""
    return probes.join(documents, on).where(F.col(start) <= F.col(day))


def without_own(served: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Leaves out a document that is itself among the references of the division (anti-join on the exploded references)."""
    return served.join(references.select(*on).distinct(), on, "left_anti")


def served(probes: DataFrame, editions: DataFrame, budgets: DataFrame, references: DataFrame, sets: Mapping[int, Sequence[str]], agreement: str, budget: str, members: Sequence[str]) -> DataFrame:
    """``probes`` columns with ``document, slug``: what each party may see.

    ``probes`` has ``votering_id, rm, parti, day (int), prompt_version``; ``editions`` ``parti, document, slug, start`` (date);
    ``budgets`` ``parti, rm, slug, start, motion``; ``references`` ``votering_id, motion`` (what the division decides on).
    A party's own documents are those in force on the day; the ``agreement`` in force is shown to its ``members``; a
    ``budget`` belongs to one session, must have been handed in, and is left out where the division decides on it.
    """
    asked = document_sets(probes, sets, "prompt_version")
    columns = [*probes.columns, "document"]
    own = versions(editions.where(~F.col("document").isin(agreement, budget)).select("parti", "document", "slug", "start"), ["parti", "document"], "start").drop("start")
    pairs = asked.where(~F.col("document").isin(agreement, budget))
    mine = asof_version(pairs, own, "day", ["parti", "document"]).select(*columns, "slug")
    shared = versions(editions.where(F.col("document") == agreement).select("document", "slug", "start"), ["document"], "start").drop("start")
    party = asked.where((F.col("document") == agreement) & F.col("parti").isin(list(members)))
    common = asof_version(party, shared, "day", ["document"]).select(*columns, "slug")
    plans = keyed_since(asked.where(F.col("document") == budget), budgets.withColumn("_start", F.unix_date("start")).select("parti", "rm", "slug", "motion", "_start"), ["parti", "rm"], "day", "_start")
    plans = without_own(plans, references, ["votering_id", "motion"]).select(*columns, "slug")
    return mine.unionByName(common).unionByName(plans)


def context_key(df: DataFrame, by: list[str], parts: Mapping[str, Column], none: Mapping[str, str]) -> DataFrame:
    """One key for each group of served documents: the party, then a part for each kind; kinds with a word in ``none`` show it where they are missing."""
    each = [F.max(F.when(F.col("document") == k, c)).alias(f"_{k}") for k, c in parts.items()]
    wide = df.groupBy(*by).agg(*each)
    return wide.select(*by, F.concat_ws("-", "parti", *[F.coalesce(F.col(f"_{k}"), F.lit(none[k])) if k in none else F.col(f"_{k}") for k in parts]).alias("context"))
