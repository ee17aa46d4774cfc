"""Readers with declared schemas; unreadable records are skipped or set apart, never guessed."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from votaria.expr import day_of
from votaria.functions.text import plain
from votaria.operators.shape import capped, latest_per_key
from votaria.session import ship_package

# Fields of a member vote in the source, all strings.
VOTE_FIELDS = ["rm", "beteckning", "votering_id", "punkt", "namn", "intressent_id", "parti", "valkrets", "rost", "avser", "votering", "banknummer", "datum"]
CITATION = "struct<document:string,slug:string,quote:string,princip:string,svag:boolean>"
DECISION = f"cid string, votering_id string, parti string, run_id string, prompt_version string, model string, arm string, rost string, hallning string, confidence string, coverage string, motivering string, citations array<{CITATION}>, flags array<string>, collected_at string"
_ENTRY = re.compile(r"(?P<dok>[0-9A-Za-zÅÄÖåäö]+)-(?P<punkt>\d+)-(?P<id>[0-9A-Fa-f-]{36})\.json$")


def votes_from_archives(spark: SparkSession, path: str) -> DataFrame:
    """Member votes from ZIP files of JSON, one row per vote.

    Entries whose name is not report-point-division are skipped, so are unreadable ones; a division with a single
    vote may hold an object in place of a list. ``punkt`` is an int, ids are in upper case.
    """
    ship_package(spark)

    def unzip(frames):
        for frame in frames:
            rows = []
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(m["dok"], z.read(name).decode("utf-8-sig", "replace")) for name in z.namelist() if (m := _ENTRY.search(name))]
            yield pd.DataFrame(rows, columns=["dok_id", "text"])

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "dok_id string, text string")
    row = T.StructType([T.StructField(f, T.StringType()) for f in VOTE_FIELDS])
    raw = F.get_json_object("text", "$.dokvotering.votering")
    listed = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    votes = texts.select("dok_id", F.explode(F.from_json(listed, T.ArrayType(row))).alias("v")).select("dok_id", "v.*")
    return votes.withColumns({"punkt": F.expr("try_cast(punkt as int)"), "votering_id": F.upper("votering_id")}).where("votering_id is not null")


def tolerant_records(spark: SparkSession, path: str, schema: str = DECISION) -> DataFrame:
    """Records from worker files: a JSON array, an object with ``decisions``, one object, or lines of objects.

    Trailing commas are cut; malformed or truncated lines are dropped. Adds ``file``.
    """
    text = F.trim(F.regexp_replace("value", "^﻿", ""))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), text.alias("t"))
    nested = F.get_json_object("t", "$.decisions")
    lines = F.transform(F.split("t", "\n"), lambda x: F.regexp_replace(F.trim(x), r",\s*$", ""))
    # within brackets nothing may follow the value, so a file of lines is not taken for its first one
    inside = F.concat(F.lit("["), F.regexp_replace("t", r",\s*$", ""), F.lit("]"))
    whole = F.call_function("try_parse_json", inside).isNotNull()
    items = F.when(whole & F.col("t").startswith("["), F.from_json("t", "array<string>")).when(whole & nested.isNotNull(), F.from_json(nested, "array<string>")).when(whole, F.from_json(inside, "array<string>")).otherwise(lines)
    each = files.select("file", F.explode(items).alias("j")).where(F.col("j").startswith("{") & F.expr("try_parse_json(j)").isNotNull())
    return each.select("file", F.from_json("j", schema).alias("r")).select("file", "r.*")


def keyed_log(spark: SparkSession, path: str, schema: str, key: list[str], sequence: str) -> DataFrame:
    """Append-only JSON lines, the latest record of each key by ``sequence``; unreadable lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return latest_per_key(rows, key, F.col(sequence))


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty frame of ``schema`` where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """``slug, text``: whole files without byte-order mark and outer blanks."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("slug"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("text"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; unreadable files are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def json_stat(spark: SparkSession, path: str, dimension: str) -> DataFrame:
    """``period, value`` of json-stat files: values by position, as a list or keyed by their index; nulls are left out."""
    rows = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    index = F.from_json(F.get_json_object("value", f"$.dimension.{dimension}.category.index"), "map<string,int>")
    raw = F.get_json_object("value", "$.value")
    listed = F.transform(F.from_json(raw, "array<double>"), lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("v")))
    sparse = F.transform(F.map_entries(F.from_json(raw, "map<string,double>")), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].alias("v")))
    values = F.when(raw.startswith("["), listed).otherwise(sparse)
    keys = rows.select(F.monotonically_increasing_id().alias("f"), index.alias("index"), values.alias("values"))
    one = keys.select("values", F.explode("index").alias("period", "i"))
    hit = F.try_element_at(F.filter("values", lambda x: x["i"] == F.col("i")), F.lit(1))
    return one.select(F.regexp_replace("period", "M", "-").alias("period"), hit["v"].alias("value")).where("value is not null")


def pxweb(spark: SparkSession, path: str) -> DataFrame:
    """``keys, value`` of table files with rows of ``key`` and ``values``; values that are no numbers are passed over."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("t"))
    each = rows.select(F.explode(F.from_json(F.get_json_object("t", "$.data"), "array<struct<key:array<string>,values:array<string>>>")).alias("r"))
    figures = each.select(F.col("r.key").alias("keys"), F.expr("try_cast(trim(get(r.values, 0)) as double)").alias("value"))
    return figures.where("value is not null and not isnan(value)")


def notices(spark: SparkSession, path: str) -> DataFrame:
    """``day, text, source`` of feeds of notices: a list, or a list under ``items``; the title stands in for a missing text.

    Notices without a day or any text are left out; repeated ones count once.
    """
    schema = "array<struct<published:string,title:string,preamble:string,url:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("t"))
    items = F.coalesce(F.from_json(F.when(F.col("t").startswith("["), F.col("t")).otherwise(F.get_json_object("t", "$.items")), schema), F.array().cast(schema))
    each = rows.select(F.explode(items).alias("n"))
    text = F.coalesce(F.nullif(F.trim("n.preamble"), F.lit("")), F.nullif(F.trim("n.title"), F.lit("")))
    return each.select(day_of(F.col("n.published")).alias("day"), text.alias("text"), F.col("n.url").alias("source")).where("day is not null and text is not null").distinct()


def daily_pages(spark: SparkSession, path: str, least: int = 40, most: int = 400, per_day: int = 6) -> DataFrame:
    """``day, place, text`` of event pages in markup: day anchors (``id="2024_March_5"``), then list items.

    Items under ``least`` characters, or that run over more than two line ends, are left out; texts are cut to ``most``
    characters, and a day shows its first ``per_day`` items (the numbers are the contract).
    """
    pages = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    parts = pages.select(F.explode(F.slice(F.split("t", r'(?=id="\d{4}_[A-Z][a-z]+_\d{1,2}")'), 2, 1_000_000)).alias("part"))
    anchor = F.regexp_extract("part", r'^id="(\d{4}_[A-Z][a-z]+_\d{1,2})"', 1)
    months = F.create_map(*[F.lit(x) for i, m in enumerate(["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"], 1) for x in (m, i)])
    pieces = F.split(anchor, "_")
    day = F.make_date(F.get(pieces, F.lit(0)).cast("int"), F.element_at(months, F.get(pieces, F.lit(1))), F.get(pieces, F.lit(2)).cast("int"))
    items = parts.select(day.alias("day"), F.posexplode(F.regexp_extract_all("part", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("place", "raw"))
    kept = items.where(F.regexp_count(F.trim("raw"), F.lit("\n")) <= 2).select("day", "place", plain(F.col("raw")).alias("text")).where(F.length("text") >= least)
    return capped(kept, ["day"], [F.col("place"), F.col("text")], per_day).select("day", "place", F.substring("text", 1, most).alias("text"))


def run_decisions(spark: SparkSession, path: str, schema: str = DECISION) -> DataFrame:
    """Decisions of a run, one file of lines for each party; an empty run is an error."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("cid is not null")
    if rows.limit(1).isEmpty():
        raise ValueError(f"no decisions under {path}")
    return rows


def polls(spark: SparkSession, path: str, parties: list[str], least: int = 6) -> DataFrame:
    """``day, parti, support`` of a poll table with a column per party; rows with under ``least`` figures are left out."""
    rows = spark.read.option("header", True).csv(path)
    figures = F.array(*[F.struct(F.lit(p).alias("parti"), F.expr(f"try_cast(`{p}` as double)").alias("support")) for p in parties])
    known = rows.where(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}")).select(F.substring("day", 1, 10).alias("day"), F.filter(figures, lambda x: x["support"].isNotNull()).alias("f"))
    return known.where(F.size("f") >= least).select("day", F.inline("f"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Worker transcripts: of several copies of a worker's run the one with most turns, its usage counted once per message."""
    schema = "run string, worker string, session string, message string, output_tokens long, input_tokens long, at timestamp"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    message = rows.groupBy("run", "worker", "session", "message").agg(F.max("output_tokens").alias("output_tokens"), F.max("input_tokens").alias("input_tokens"), F.min("at").alias("first"), F.max("at").alias("last"))
    session = message.groupBy("run", "worker", "session").agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output_tokens"), F.sum("input_tokens").alias("input_tokens"), F.min("first").alias("first"), F.max("last").alias("last"))
    return latest_per_key(session, ["run", "worker"], F.struct("turns", "session"))


def dated_lines(lines: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Items of a year article: section, month and day of each line, carried forward from the headings above it."""
    from votaria.operators.shape import forward_fill

    t = F.col(text)
    section, month = F.regexp_extract(t, r"^==([^=].*?)==\s*$", 1), F.regexp_extract(t, r"^===(.+?)===\s*$", 1)
    day, item = F.regexp_extract(t, r"^\*\s*(\d{1,2})\b", 1), F.regexp_extract(t, r"^\*+\s*(?:\d{1,2}\s*[–-]\s*)?(.+)$", 1)
    none = lambda c: F.when(c != "", F.trim(c))
    marked = lines.withColumns({"section": none(section), "month": none(month), "day": none(day)})
    filled = forward_fill(marked, by, order, ["section", "month", "day"])
    return filled.withColumn("item", none(item)).where("item is not null")


def made_decisions(cases: DataFrame, parties: DataFrame, run_id: str, seed: int) -> DataFrame:
    """Seeded synthetic decisions for dry runs: Ja, Nej, Avstår at 0.72, 0.16, 0.12."""
    u = F.rand(seed)
    rows = cases.select("votering_id").crossJoin(F.broadcast(parties.select("parti"))).withColumn("_u", u)  # eight parties
    vote = F.when(F.col("_u") < 0.72, "Ja").when(F.col("_u") < 0.88, "Nej").otherwise("Avstår")
    return rows.select("votering_id", "parti", F.lit(run_id).alias("run_id"), vote.alias("rost"))
