"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the session names in spark.checkpoint.dir. Where that is unset and everything runs
    in one process, as in tests, a temporary folder is made and set as the checkpoint folder; on
    a cluster a folder of one machine would not do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vitrine-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the application's part of the shared folder, which can be removed once the application has ended."""
    return f"{shared_dir(spark)}/vitrine-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs no more than reading files again. Unlike
    checkpoint() it computes df only once.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def uniform(*cols, seed: int):
    """A number in [0, 1) that depends on the columns and the seed alone."""
    mask = (1 << 53) - 1
    return F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit(mask)).cast("double") / F.lit(float(1 << 53))
