"""Session helpers: a local session for tests and the shared working folder of a job."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sqltally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, for Python functions that run there.

    Needless where it is installed or submitted with the job, and harmless there.
    """
    context = spark.sparkContext
    if not getattr(context, "_sqltally_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="sqltally-"), "sqltally")
        context.addPyFile(shutil.make_archive(name, "zip", root, "sqltally"))
        context._sqltally_shipped = True


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path under the cluster's shared ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the executors
    would each see a different one.
    """
    context = spark.sparkContext
    base = getattr(context, "_sqltally_work", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = context._sqltally_work = tempfile.mkdtemp(prefix="sqltally-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def work_folder(spark: SparkSession, base: str | None = None) -> Iterator[str]:
    """A folder for the intermediate tables of one run, below ``base`` or the shared folder; it is deleted at the end.

    Results that are still to be read must be written elsewhere before.
    """
    context = spark.sparkContext
    before = getattr(context, "_sqltally_work", None)
    folder = os.path.join(base, f"run-{uuid.uuid4().hex[:12]}") if base else work_dir(spark, "run")
    context._sqltally_work = folder
    try:
        yield folder
    finally:
        context._sqltally_work = before
        delete(spark, folder)


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared working folder and read back.

    Later steps do not repeat the work, a lost executor costs no lineage, and the size on disk tells
    the planner whether the table is small enough to broadcast.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
