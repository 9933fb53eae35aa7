"""Running sums and exact percentiles over keys of any size.

A window over a few hot keys would order each of them in one task. Here Spark's range
partitioner deals rows by key and order at once, so a hot key spans many partitions; sums of the
partitions, carried along each key, give every partition what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Adds the sum of value over all rows of the same keys up to and with the row, in the given order.

    The order should tell the rows of a key apart; rows that it does not are taken one after
    the other. Null keys are a key of their own.
    """
    n = parts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("__value", value).repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id())
    rows = stored(rows, "parts")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__part").agg(F.sum("__value").alias("__sum")).withColumn("__before", F.sum("__sum").over(before))
    same = F.col("r.__part") == F.col("s.__part")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    met = rows.alias("r").join(sums.alias("s"), same).select("r.*", "s.__before")
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(out, F.coalesce("__before", F.lit(0)) + F.sum("__value").over(inside)).drop("__value", "__part", "__before")


def exact_percentiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """key, n and p0, p1, ...: the interpolated percentiles of a numeric column, nulls left out.

    Equal values are counted first; of the running counts only the two values on either side of
    each percentile go on.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    ends = running_sum(counts, [key], [value], F.col("c"), "end")
    total = counts.groupBy(key).agg(F.sum("c").alias("n"))
    met = ends.alias("e").join(total.alias("t"), F.col(f"e.{key}").eqNullSafe(F.col(f"t.{key}"))).select("e.*", "t.n")
    columns = []
    for i, p in enumerate(shares):
        at = F.lit(p) * (F.col("n") - 1)
        holds = lambda k: F.max(F.when((F.col("end") > k) & (F.col("end") - F.col("c") <= k), F.col(value)))
        low, high = holds(F.floor(at)), holds(F.ceil(at))
        part = F.max(at - F.floor(at))
        columns.append((low + (high - low) * part).alias(f"p{i}"))
    return met.groupBy(key).agg(F.max("n").alias("n"), *columns)
