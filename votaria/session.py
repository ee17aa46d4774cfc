"""Session helpers: shared checkpoint folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if all work runs in this process (tests); on a cluster
    that is an error, as the executors could not read it.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="votaria-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so later uses neither recompute it nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, wherever they run, once for each Spark context.

    The archive is built beside the driver and served by it; no worker reads the driver's disk.
    """
    context = spark.sparkContext
    if getattr(context, "_votaria_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="votaria-package-")) / "votaria.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, Path(package.name) / source.relative_to(package))
    context.addPyFile(str(archive))
    context._votaria_shipped = True
