"""Question/SQL splits: JSON in, parquet out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_arrays import read_objects

# File (or folder of part files) of each split, the optional second part of train last.
SPLIT_FILES: Mapping[str, Sequence[str]] = {
    "train": ("train.json", "train_others.json"),
    "dev": ("dev.json",),
    "test": ("test.json",),
}

EXAMPLE = ["idx", "db_id", "question", "gold_sql", "split"]
RECORD = "db_id string, question string, query string, sql string"


def path_exists(spark: SparkSession, path: str, source: str = "text") -> bool:
    try:
        spark.read.format(source).load(path)
        return True
    except AnalysisException:
        return False


def read_json_arrays(spark: SparkSession, paths: Sequence[str], record: str = RECORD) -> DataFrame:
    """Elements of JSON-array files with a dense ``idx`` in reading order.

    A path is one file or a folder of part files, read in name order. Files are read in splits and parsed object by
    object, so a file may be larger than the memory of a task.
    """
    rows = read_objects(spark, paths).select("idx", "part", F.from_json("text", f"struct<{record}>").alias("row"))
    return rows.select("idx", "part", "row.*")


def read_split(
    spark: SparkSession,
    split: str,
    data_dir: str,
    include_others: bool = True,
    files: Mapping[str, Sequence[str]] = SPLIT_FILES,
) -> DataFrame:
    """``idx, part, db_id, question, gold_sql, sql, split`` of one split.

    ``sql`` is the raw JSON of the parsed query and stays text until it is needed.
    """
    if split not in files:
        raise ValueError(f"unknown split {split!r}, expected one of {sorted(files)}")
    first, *others = [f"{data_dir.rstrip('/')}/{name}" for name in files[split]]
    paths = [first] + [p for p in others if include_others and path_exists(spark, p)]
    rows = read_json_arrays(spark, paths)
    return rows.withColumnRenamed("query", "gold_sql").withColumn("split", F.lit(split))


def append_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def read_filtered_or_raw(
    spark: SparkSession, filtered_path: str | None, data_dir: str, split: str = "train", **options
) -> DataFrame:
    """The filtered corpus when it is configured and present, else the raw split; ``EXAMPLE`` columns either way."""
    if filtered_path and path_exists(spark, filtered_path, "parquet"):
        return spark.read.parquet(filtered_path).select(*EXAMPLE)
    return read_split(spark, split, data_dir, **options).select(*EXAMPLE)


PREDICTION = (
    "index bigint, db_id string, question string, gold_sql string, pred_sql string, "
    "correct boolean, difficulty string, pred_error string"
)


def read_predictions(spark: SparkSession, path: str, record: str = PREDICTION, lines: bool = False) -> DataFrame:
    """Prediction records from JSON: an object with ``predictions``, or a bare list.

    Files are read in splits, see ``json_arrays``. ``lines=True`` reads one record per line instead.
    """
    if lines:
        return spark.read.schema(record).json(path)
    objects = read_objects(spark, [path], key="predictions")
    return objects.select(F.from_json("text", f"struct<{record}>").alias("p")).select("p.*")


def write_filtered(df: DataFrame, path: str, results: DataFrame | None = None) -> None:
    """The filtered rows by split, and beside them the cached results of their references, by ``gold_key``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    if results is not None:
        results.withColumnRenamed("key", "gold_key").write.mode("overwrite").parquet(f"{path}-results")


def write_eval(predictions: DataFrame, summary: DataFrame, path: str) -> None:
    """Predictions and the one-row summary, each partitioned by split and mode."""
    predictions.write.mode("overwrite").partitionBy("split", "mode").parquet(f"{path}/predictions")
    summary.write.mode("overwrite").partitionBy("split", "mode").parquet(f"{path}/summary")
