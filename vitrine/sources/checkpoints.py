"""Stored checkpoints, read a page at a time by keyset.

Checkpoints lie in folders by a hash of their run, and inside a file in the order of run, attempt
and batch. A page of one run is a filter with constants, so Spark reads one folder, and of its
files the row groups that hold the run. Pages of many runs are one join with the cursors;
folders that no cursor names are pruned while it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDERS = 64
FIELDS = "run string, attempt int, batch long, payload string, folder int"


def folder_of(run: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(folders)).cast("int")


def write_checkpoints(df: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Writes run, attempt, batch, payload. A hot run's rows are divided by range, so no task writes them alone."""
    rows = df.select("run", F.col("attempt").cast("int").alias("attempt"), F.col("batch").cast("long").alias("batch"), "payload").withColumn("folder", folder_of(F.col("run"), folders))
    rows.repartitionByRange("folder", "run", "attempt", "batch").sortWithinPartitions("folder", "run", "attempt", "batch").write.partitionBy("folder").parquet(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIELDS).parquet(path)


def page(spark: SparkSession, path: str, run: str, after: tuple[int, int] | None = None, size: int = 100, folders: int = FOLDERS) -> DataFrame:
    """The size checkpoints of a run that come after (attempt, batch), later attempts first, then batches in order; more tells if others follow."""
    rows = read_checkpoints(spark, path).filter((F.col("folder") == folder_of(F.lit(run), folders)) & (F.col("run") == run))
    if after is not None:
        rows = rows.filter((F.col("attempt") < after[0]) | ((F.col("attempt") == after[0]) & (F.col("batch") > after[1])))
    some = rows.orderBy(F.col("attempt").desc(), "batch").limit(size + 1)
    n = Window.orderBy(F.col("attempt").desc(), "batch")  # size + 1 rows
    return some.withColumn("n", F.row_number().over(n)).withColumn("more", F.max("n").over(Window.partitionBy()) > size).filter(F.col("n") <= size).select("run", "attempt", "batch", "payload", "more")


def pages(checkpoints: DataFrame, cursors: DataFrame, size: int, folders: int = FOLDERS) -> DataFrame:
    """run, attempt, batch, payload, more: one page for each cursor (run; attempt and batch, null for the first page). A run has one cursor."""
    asked = cursors.select(F.col("run").alias("r"), F.col("attempt").alias("a"), F.col("batch").alias("b"), folder_of(F.col("run"), folders).alias("f"))
    after = F.col("a").isNull() | (F.col("attempt") < F.col("a")) | ((F.col("attempt") == F.col("a")) & (F.col("batch") > F.col("b")))
    met = checkpoints.join(asked, (F.col("folder") == F.col("f")) & (F.col("run") == F.col("r")) & after)
    order = Window.partitionBy("run").orderBy(F.col("attempt").desc(), "batch")
    few = met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= size + 1)
    few = few.withColumn("more", F.max("n").over(Window.partitionBy("run")) > size)
    return few.filter(F.col("n") <= size).select("run", "attempt", "batch", "payload", "more")
