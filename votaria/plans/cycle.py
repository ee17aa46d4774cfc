"""One round of a run: worker files are merged, new decisions ingested, citations mended, and the whole is verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votaria.operators import match, quality, repair
from votaria.session import cut
from votaria.sources import sinks


def run_cycle(spark: SparkSession, files: str, issued: DataFrame, blocks: DataFrame, run: str, mended: str, blocked: list[tuple[str, str]], weak: list[tuple[str, str]], least: float = 0.75) -> DataFrame:
    """Merge the files of a batch into ``run``, write the mended decisions to a new version of ``mended``, return what was checked.

    ``issued`` has ``file, cid``, ``blocks`` ``slug, text`` (paragraphs), the lists ``document, phrase``. Running the same
    batch again changes nothing. The result is ``name, n_bad, ok``: work that is missing or foreign, repeated ids, and
    quotes that stand in no document after the repair.
    """
    merged = sinks.merge_files(spark, files, issued, run)
    decisions = cut(spark.read.parquet(run))
    quotes = decisions.select(F.inline("citations")).where("trim(quote) <> '' and slug is not null").select("slug", "quote").distinct()
    checked = cut(match.verbatim(quotes, blocks, ["slug"], "quote", "text"))
    missed = checked.where("not verbatim").groupBy("slug").agg(F.collect_set("quote").alias("quotes"))
    widest = missed.select(F.explode("quotes").alias("q")).agg(F.coalesce(F.max(F.size(F.split("q", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    parts = match.segments(blocks.where("text is not null"), ["slug"], [F.col("text")] if "place" not in blocks.columns else [F.col("place"), F.col("text")], "text", 20_000, widest + 8)
    found = missed.join(parts, "slug").select("slug", F.explode(match.closest_spans("quotes", "text", least)).alias("f")).groupBy("slug", F.col("f.quote").alias("quote")).agg(F.max_by(F.struct("f.span", "f.ratio"), "f.ratio").alias("b"))
    verdicts = checked.join(found, ["slug", "quote"], "left").select("slug", "quote", "verbatim", F.col("b.span").alias("span"), F.col("b.ratio").alias("ratio"))
    done = repair.marked(repair.stripped(repair.aligned(decisions, verdicts, ["cid"]), blocked), weak)
    sinks.replace_table(done, mended)
    final = sinks.read_current(spark, mended)
    left = final.select(F.inline("citations")).where("trim(quote) <> ''").select("slug", "quote").distinct()
    astray = match.verbatim(left, blocks, ["slug"], "quote", "text")
    wrong = merged.where("verdict in ('foreign', 'missing')").select(F.col("verdict").alias("name"), F.col("n").alias("n_bad"))
    return quality.report([wrong, quality.repeated("repeated", final, ["cid"]), quality.counts(astray, {"not verbatim": ~F.col("verbatim")})])


