"""Nested documents: one value or many, first by code, lists with gaps, maps by key, official tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(json: Column, path: str, kind: str) -> Column:
    """The values at ``path`` of a JSON text as ``array<kind>``; a single value is a list of one, a missing one an empty list."""
    raw = F.get_json_object(json, path)
    text = F.when(F.trim(raw).startswith("["), raw).when(F.trim(raw).startswith("{"), F.concat(F.lit("["), raw, F.lit("]"))).otherwise(F.to_json(F.array(raw)))
    return F.when(raw.isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.from_json(text, f"array<{kind}>"))


def first_by(items: Column, code: str, value: str, field: str = "kod") -> Column:
    """The trimmed ``field`` value of the first item with that code; null when there is none."""
    hit = F.try_element_at(F.filter(items, lambda x: x[field] == code), F.lit(1))
    return F.trim(hit[value])


def flat_or_chunks(flat: Column, chunks: Column) -> Column:
    """A flat list where it holds anything, else the chunks put together."""
    return F.coalesce(F.when(F.size(flat) > 0, flat), F.flatten(chunks))


def last_by_key(df: DataFrame, by: list[str], key: Column, value: str, order: str) -> DataFrame:
    """One map for each group, from the upper-cased key to the value of its last row; empty keys are left out."""
    rows = df.withColumn("_key", F.upper(F.trim(key))).where("_key <> ''")
    last = rows.groupBy(*by, "_key").agg(F.max_by(value, F.struct(F.coalesce(order, F.lit(0)), value)).alias("_value"))
    return last.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias("entries"))


REFERENCE = "struct<referenstyp:string,ref_dok_id:string,ref_dok_typ:string,ref_dok_dokumentnamn:string,ref_dok_rm:string,ref_dok_bet:string,ref_dok_titel:string,ref_dok_subtitel:string>"
POINT = "struct<votering_id:string,punkt:string,rubrik:string,forslag:string,vinnare:string,motforslag_nummer:string>"
COUNTER = "struct<nummer:string,utskottsforslag_punkt:string,rubrik:string,partier:string>"
NOTE = "struct<kod:string,text:string>"


def status_points(documents: DataFrame, json: str = "json") -> DataFrame:
    """The points of status documents with the lists of their report: ``votering_id`` (upper case), ``point``, ``counters``, ``references``, ``notes``.

    Points without a division id are left out; unreadable documents give nothing.
    """
    j = F.col(json)
    rows = documents.where(F.call_function("try_parse_json", j).isNotNull()).withColumns({
        "counters": listed(j, "$.dokumentstatus.dokmotforslag.motforslag", COUNTER), "references": listed(j, "$.dokumentstatus.dokreferens.referens", REFERENCE), "notes": listed(j, "$.dokumentstatus.dokuppgift.uppgift", NOTE),
        "_points": listed(j, "$.dokumentstatus.dokutskottsforslag.utskottsforslag", POINT),
    })
    each = rows.select(*[c for c in documents.columns if c != json], "counters", "references", "notes", F.explode("_points").alias("point"))
    return each.withColumn("votering_id", F.upper(F.trim("point.votering_id"))).where("votering_id <> ''")


def alternatives(points: DataFrame, clean=lambda c: c) -> Column:
    """The proposals a division chose between: the committee's, then the counter-proposals on the same point.

    Where the point lists numbers of counter-proposals, only those count. Each is ``alt_id, text, source_partier``.
    """
    numbers = F.filter(F.transform(F.split(F.coalesce("point.motforslag_nummer", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    mine = F.filter("counters", lambda m: (F.coalesce(m["utskottsforslag_punkt"], F.lit("")) == F.coalesce("point.punkt", F.lit(""))) & ((F.size(numbers) == 0) | F.array_contains(numbers, m["nummer"])))
    made = F.transform(mine, lambda m: F.struct(F.concat(F.lit("res-"), F.coalesce(m["nummer"], F.lit(""))).alias("alt_id"), F.coalesce(F.nullif(clean(m["rubrik"]), F.lit("")), F.concat(F.lit("Reservation "), m["nummer"])).alias("text"), m["partier"].alias("source_partier")))
    first = F.struct(F.lit("utskottet").alias("alt_id"), clean(F.col("point.forslag")).alias("text"), F.lit(None).cast("string").alias("source_partier"))
    return F.concat(F.array(first), made)


def references(column: str = "references", kind: str = "behandlar", most: int = 20) -> Column:
    """The first ``most`` documents under consideration (the number is the contract), with type, label and titles."""
    text = lambda c: F.coalesce(c, F.lit(""))
    known = F.filter(column, lambda r: (r["referenstyp"] == kind) & (text(r["ref_dok_id"]) != ""))
    label = lambda r: F.trim(F.concat(text(r["ref_dok_dokumentnamn"]), F.lit(" "), text(r["ref_dok_rm"]), F.lit(":"), text(r["ref_dok_bet"])))
    return F.slice(F.transform(known, lambda r: F.struct(r["ref_dok_id"].alias("dok_id"), text(r["ref_dok_typ"]).alias("typ"), label(r).alias("label"), F.trim(text(r["ref_dok_titel"])).alias("titel"), F.trim(text(r["ref_dok_subtitel"])).alias("undertitel"))), 1, most)


ROW = "struct<th:string,td:array<string>>"


def official_counts(json: Column) -> Column:
    """Official counts of a point's summary as ``array<struct<parti, counts array<int>>>``; null where none can be read.

    Of several tables the one captioned with the matter itself is taken, else the first. Totals and rows under four
    figures are passed over; one figure that is no number makes the whole table unreadable.
    """
    tables = listed(json, "$.table", "string")
    wanted = F.coalesce(F.try_element_at(F.filter(tables, lambda t: F.contains(F.coalesce(F.get_json_object(t, "$.caption"), F.lit("")), F.lit("sakfrågan"))), F.lit(1)), F.try_element_at(tables, F.lit(1)))
    rows = F.filter(listed(wanted, "$.tbody.tr", ROW), lambda r: ~F.upper(F.trim(F.coalesce(r["th"], F.lit("")))).isin("", "TOTALT") & (F.size(r["td"]) >= 4))
    number = lambda c: F.regexp_extract(F.trim(c), r"^([+-]?[0-9]{1,9})$", 1)
    texts = F.transform(rows, lambda r: F.struct(F.upper(F.trim(r["th"])).alias("parti"), F.transform(F.slice(r["td"], 1, 4), number).alias("d")))
    whole = F.forall(texts, lambda r: F.forall(r["d"], lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.when((F.size(texts) > 0) & whole, F.transform(texts, lambda r: F.struct(r["parti"].alias("parti"), r["d"].cast("array<int>").alias("counts"))))


def count_check(official: DataFrame, positions: DataFrame) -> DataFrame:
    """``n_checked, n_mismatch``: divisions with an official table, and those where a party's counts differ from ours.

    ``official`` has ``votering_id, official`` (see ``official_counts``). Parties we do not know are passed over.
    """
    rows = official.where("official is not null").select("votering_id", F.inline("official"))
    ours = positions.select("votering_id", "parti", F.array("n_ja", "n_nej", "n_avstar", "n_franvarande").cast("array<int>").alias("_ours"))
    wrong = F.col("_ours").isNotNull() & (F.col("_ours") != F.col("counts"))
    per = rows.join(ours, ["votering_id", "parti"], "left").groupBy("votering_id").agg(F.max(F.coalesce(wrong, F.lit(False))).alias("_wrong"))
    return per.agg(F.count("*").alias("n_checked"), F.count_if("_wrong").alias("n_mismatch"))
