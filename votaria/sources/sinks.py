"""Sinks: tables, documents, lines, quarantine, ledgers and keyed appends."""

from __future__ import annotations

import gzip
import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from votaria.operators.shape import first_per_key
from votaria.session import cut
from votaria.sources.readers import tolerant_records


def write_table(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Replace a Parquet table, partitioned by ``by``."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version of a table beside the others, then point to it in one step; readers see the old one until then.

    Returns the version's path. A write that fails leaves the pointer, and so the table, as it was.
    """
    version = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    fs, root = _files(df.sparkSession, path)
    fresh = f"{path}/{_POINTER}-{uuid.uuid4().hex}"
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.text(fresh)
    path_of = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    pointer = path_of(f"{path}/{_POINTER}")
    fs.delete(pointer, True)
    fs.rename(path_of(fresh), pointer)
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that ``replace_table`` last pointed to."""
    return spark.read.parquet(spark.read.text(f"{path}/{_POINTER}").first()["value"])


_POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_documents(df: DataFrame, key: str, folder: str, head: str | None = None) -> None:
    """One JSON file per row, named after ``key``, in a folder that is emptied first; null fields are left out.

    Files are written by the tasks through the file system the folder's address names, so ``folder`` must be one that
    all executors share. Rows of one key write one file (the last wins). ``head`` names a column of text to put before.
    """
    fs, at = _files(df.sparkSession, folder)
    fs.delete(at, True)
    fs.mkdirs(at)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(head), F.lit("")).alias("h") if head else F.lit("").alias("h"), F.to_json(F.struct(*[c for c in df.columns if c != head])).alias("j"))
    address = str(fs.makeQualified(at).toString())

    def write(part) -> None:
        from pyarrow import fs as files

        store, root = files.FileSystem.from_uri(address)
        for row in part:
            with store.open_output_stream(f"{root}/{row.k.replace('/', '_')}.json") as out:
                out.write((f"{row.h}\n" if row.h else "").encode() + row.j.encode())

    rows.foreachPartition(write)


def write_lines(df: DataFrame, path: str, order: list[Column] = ()) -> None:
    """JSON lines, in order if one is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns are left out."""
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_gzip(df: DataFrame, order: list[Column], path: str) -> int:
    """One gzip file of JSON lines, the same bytes for the same rows; streamed to the driver partition by partition."""
    n = 0
    with open(path, "wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as out:
        for row in df.orderBy(*order).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            out.write((row.j + "\n").encode())
            n += 1
    return n


def write_summary(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small aggregate as one JSON document; more than ``most`` rows are an error."""
    rows = [json.loads(j) for (j,) in df.select(F.to_json(F.struct("*"))).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; not a summary")
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")


def quarantine(df: DataFrame, reason: str, good: str, bad: str) -> None:
    """Rows without a reason to ``good``, the others to ``bad``."""
    write_table(df.where(F.col(reason).isNull()).drop(reason), good)
    write_table(df.where(F.col(reason).isNotNull()), bad)


def append_new(df: DataFrame, path: str, key: list[str], order: Column, within: str | None = None) -> int:
    """Append the rows whose key the table lacks, the first of each key; returns how many. Runs again without effect.

    For one writer at a time: two that run at once may both add a key. ``within`` names a column by which the table is
    partitioned and which a key does not change; then only the partitions that the new rows touch are read.
    """
    fresh = cut(first_per_key(df, key, order))
    try:
        done = df.sparkSession.read.parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = None
    if done is not None:
        keys = done
        if within:
            touched = fresh.select(within).distinct()
            keys = done.join(F.broadcast(touched) if touched.count() <= 100_000 else touched, within, "left_semi")
        fresh = cut(fresh.join(keys.select(*key), key, "left_anti"))
    n = fresh.count()
    if n:
        writer = fresh.write.mode("append")
        (writer.partitionBy(within) if within else writer).parquet(path)
    return n


def merge_files(spark: SparkSession, path: str, issued: DataFrame, target: str) -> DataFrame:
    """Worker files read, checked against what was issued (``file, cid``) and appended; returns counts per verdict.

    A decision is ``added``, ``repeated`` (another of its id came first), ``foreign`` (not issued to its file) or, for what
    was issued and is not there, ``missing``.
    """
    rows = tolerant_records(spark, path).where("cid is not null")
    marked = rows.join(issued.select("file", "cid", F.lit(True).alias("_issued")).distinct(), ["file", "cid"], "left")
    mine = cut(marked.where("_issued").drop("_issued"))
    added = append_new(mine, target, ["cid"], F.col("file"))
    foreign = marked.where("_issued is null").count()
    missing = issued.select("cid").distinct().join(mine.select("cid").distinct(), "cid", "left_anti").count()
    return spark.createDataFrame([("added", added), ("repeated", mine.count() - added), ("foreign", foreign), ("missing", missing)], "verdict string, n long")


def next_batch(ledger: DataFrame, batch: str = "batch_no") -> int:
    """The number after the last batch of an append-only ledger; 1 where there is none."""
    return (ledger.agg(F.max(batch)).first()[0] or 0) + 1
