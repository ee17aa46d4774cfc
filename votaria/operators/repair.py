"""Citations mended in place: aligned with their document, stripped of listed phrases, weak ones marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votaria.functions.text import match_keys
from votaria.operators.match import with_flag

CORRECTED, UNVERIFIED, BLOCKED, WEAK = "citat_korrigerat", "citat_ej_verifierat", "citat_blockerat", "citat_svagt"


def aligned(decisions: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Decisions with their quotes aligned; counts ``n_ok, n_fixed, n_failed``.

    ``verdicts`` has ``slug, quote, verbatim, span, ratio`` (the nearest span where a quote is not verbatim). A quote that
    reaches the ratio 0.75 is replaced by its span; any other is blanked, kept in ``quote_ej_verifierad``, and the
    decision is flagged. Empty quotes stay. Null arrays stay null. Order is kept.
    """
    rows = decisions.select(*key, F.posexplode("citations").alias("_i", "c")).withColumns({"slug": F.col("c.slug"), "quote": F.col("c.quote")})
    known = rows.join(verdicts.select("slug", "quote", "verbatim", "span", "ratio").distinct(), ["slug", "quote"], "left")
    empty = F.coalesce(F.trim("quote"), F.lit("")) == ""
    state = F.when(empty, "empty").when(F.col("verbatim"), "ok").when(F.col("ratio") >= 0.75, "fixed").otherwise("failed")
    quote = F.when(F.col("_state") == "fixed", F.col("span")).when(F.col("_state") == "failed", F.lit("")).otherwise(F.col("quote"))
    made = known.withColumn("_state", state).withColumn("_new", F.struct("_i", F.col("c").withField("quote", quote).withField("quote_ej_verifierad", F.when(F.col("_state") == "failed", F.col("quote"))).alias("c")))
    # as many rows as the decision has citations
    count = lambda s: F.count_if(F.col("_state") == s)
    built = made.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("_new")), lambda x: x["c"]).alias("_citations"), count("ok").alias("n_ok"), count("fixed").alias("n_fixed"), count("failed").alias("n_failed"))
    out = decisions.join(built, key, "left").withColumn("citations", F.coalesce("_citations", F.transform("citations", lambda c: c.withField("quote_ej_verifierad", F.lit(None).cast("string"))))).drop("_citations").fillna(0, ["n_ok", "n_fixed", "n_failed"])
    flags = F.when(F.col("n_fixed") > 0, with_flag(F.col("flags"), CORRECTED, F.lit(True))).otherwise(F.coalesce("flags", F.array().cast("array<string>")))
    return out.withColumn("flags", F.when(F.col("n_failed") > 0, F.array_union(flags, F.array(F.lit(UNVERIFIED)))).otherwise(flags))


def _hit(c: Column, quote: Column, phrases: list[tuple[str, str]]) -> Column:
    found = F.lit(False)
    for document, phrase in phrases:  # a short list kept by hand
        found = found | ((c["document"] == document) & (F.contains(quote, F.lit(phrase)) | F.contains(F.lit(phrase), quote)))
    return F.coalesce((quote != "") & found, F.lit(False))


def _keyed(decisions: DataFrame) -> DataFrame:
    """Adds ``_keys``: the form in which each quote is matched."""
    return decisions.withColumn("_keys", match_keys(F.transform("citations", lambda c: c["quote"])))


def stripped(decisions: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """Drops citations of listed phrases, either text holding the other; flags the decision and counts ``n_blocked``."""
    kept = F.filter("citations", lambda c, i: ~_hit(c, F.get("_keys", i), phrases))
    rows = _keyed(decisions).withColumn("_kept", kept)
    n = F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0)) - F.greatest(F.coalesce(F.size("_kept"), F.lit(0)), F.lit(0))
    none = F.array().cast("array<string>")
    return rows.withColumn("n_blocked", n).withColumn("citations", F.col("_kept")).withColumn("flags", F.when(F.col("n_blocked") > 0, with_flag(F.col("flags"), BLOCKED, F.lit(True))).otherwise(F.coalesce("flags", none))).drop("_kept", "_keys")


def marked(decisions: DataFrame, phrases: list[tuple[str, str]]) -> DataFrame:
    """Sets or clears ``svag`` of each citation, and the flag of the decision, so that a second run changes nothing; counts ``n_weak``."""
    new = F.transform("citations", lambda c, i: c.withField("svag", F.when(_hit(c, F.get("_keys", i), phrases), True)))
    out = _keyed(decisions).withColumn("citations", new).withColumn("n_weak", F.greatest(F.lit(0), F.coalesce(F.size(F.filter("citations", lambda c: F.coalesce(c["svag"], F.lit(False)))), F.lit(0))))
    return out.withColumn("flags", with_flag(F.col("flags"), WEAK, F.col("n_weak") > 0)).drop("_keys")
