"""Block-wise running totals and ranks against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sqltally.operators.running import first_rows, rank_rows, running


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds most rows, positions have gaps, one key is NULL.
    return spark.range(500).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "cold").alias("k"),
        (F.col("id") * 3).alias("at"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 11).alias("v"),
    )


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 20])
@pytest.mark.parametrize("how", ["sum", "max"])
def test_running(rows, how, block):
    fold = {"sum": F.sum, "max": F.max}[how]
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.withColumn("total", F.coalesce(fold("v").over(w), F.lit(0)) if how == "sum" else fold("v").over(w))
    found = running(rows, ["k"], "at", {"total": "v"}, how, block)
    assert collected(found) == collected(plain)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rank_rows(rows, digits):
    keyed = rows.withColumn("h", F.md5(F.col("at").cast("string")))
    plain = keyed.withColumn("rk", F.row_number().over(Window.partitionBy("k").orderBy("h")).cast("bigint"))
    found = rank_rows(keyed, ["k"], [F.col("h")], F.substring("h", 1, digits), "rk")
    assert collected(found) == collected(plain)


@pytest.mark.parametrize("k, salts", [(1, 1), (5, 3), (1000, 8)])
def test_first_rows(rows, k, salts):
    rk = F.row_number().over(Window.partitionBy("k").orderBy("at"))
    plain = rows.withColumn("rk", rk).where(F.col("rk") <= k)
    assert collected(first_rows(rows, ["k"], [F.col("at")], k, salts=salts)) == collected(plain)
