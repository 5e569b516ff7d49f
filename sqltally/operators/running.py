"""Running totals, dense positions and first-k rows that never sort one big group in one task.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends a whole key to one task. Here the
key is cut into blocks, each block is summarised first, the few block summaries are scanned in
order, and every block then continues from what the blocks before it add up to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

BLOCK = 1 << 16


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, str],
    how: str = "sum",
    block: int | Column = BLOCK,
) -> DataFrame:
    """Replace each column ``totals[name]`` by its running ``sum`` or ``max`` as ``name``.

    ``order`` is a whole-number column, unique per key. ``block`` is its width per task, or a
    column that rises with the order. Equal to a window over ``keys`` ordered by ``order``, the
    current row included.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    cut = block if isinstance(block, Column) else F.floor(F.col(order) / block).cast("bigint")
    cut_rows = df.withColumn("_block", cut)

    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        cut_rows.groupBy(*keys, "_block")
        .agg(*[fold(source).alias(f"_total_{name}") for name, source in totals.items()])
        .select(*keys, "_block", *[fold(f"_total_{name}").over(before).alias(f"_carry_{name}") for name in totals])
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_block").alias("_at"),
                *[f"_carry_{name}" for name in totals])
    )

    inside = (
        Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut_rows.withColumns({f"_local_{name}": fold(source).over(inside) for name, source in totals.items()})
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = local.join(carries, same, "left")
    if how == "sum":
        results = {
            name: F.coalesce(F.col(f"_local_{name}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0))
            for name in totals
        }
    else:
        results = {name: F.greatest(F.col(f"_local_{name}"), F.col(f"_carry_{name}")) for name in totals}
    return joined.withColumns(results).select(*df.columns, *[n for n in totals if n not in df.columns])


def totals_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before each row in the order of some columns, unique together.

    The rows are sorted over many tasks and written; only one total per task is scanned in order.
    """
    placed = df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = kept(placed, "ordered")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(F.sum(value).alias("_total")).select(
        F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(totals, F.col("_range") == F.col("_of"))
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def carried(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` strictly before each row in ``order``, per ``keys``.

    Equal to ``lag(value) IGNORE NULLS``. Values enter half a step after their own row, and the latest one seen
    so far is a running maximum over pairs of place and value.
    """
    place = F.struct(F.col(order).alias("at"), F.col(value).alias("value"))
    own = df.withColumns({"_place": 2 * F.col(order), "_seen": F.lit(None).cast(f"struct<at:{df.schema[order].dataType.simpleString()},value:{df.schema[value].dataType.simpleString()}>"), "_own": F.lit(True)})
    seen = df.where(F.col(value).isNotNull()).withColumns({"_place": 2 * F.col(order) + 1, "_seen": place, "_own": F.lit(False)})
    latest = running(own.unionByName(seen), keys, "_place", {"_latest": "_seen"}, "max", 2 * BLOCK)
    return latest.where("_own").select(*df.columns, F.col("_latest.value").alias(name))


def rank_rows(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Exact ``row_number`` over ``keys`` ordered by ``order``, spread over buckets.

    ``bucket`` must rise with ``order`` (for a hash key: its leading digits), so a row's rank is the
    size of all earlier buckets plus its rank inside its own.
    """
    tagged = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_bucket").alias("_at"), "_before")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    same = F.col("_bucket") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return (
        tagged.withColumn("_rank", F.row_number().over(inside))
        .join(sizes, same)
        .withColumn(name, (F.col("_rank") + F.col("_before")).cast("bigint"))
        .select(*df.columns, name)
    )


def first_rows(
    df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rk", salts: int = 32
) -> DataFrame:
    """First ``k`` rows per key, ranked from 1.

    For a small ``k`` the planner limits each group before the shuffle, so at most ``k`` rows per key
    and task are moved. Beyond its limit a first pass does the same per key and salt: a key holding
    much of the data is sorted by many tasks, and ``k * salts`` of its rows meet in the second pass.
    """
    kept = df
    pushed = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > pushed:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        per_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
        kept = salted.withColumn("_rank", F.row_number().over(per_salt)).where(F.col("_rank") <= k)
    per_key = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(name, F.row_number().over(per_key)).where(F.col(name) <= k).select(*df.columns, name)
