"""Sinks: idempotent fact chunks, snapshots, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame, *cols: str) -> DataFrame:
    """df with the SHA-256 of its canonical JSON: fields in order of their names."""
    return df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(cols))), 256))


def new_rows(incoming: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """The first of each key that is not stored yet; the order column is `ord`."""
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct("*"), "ord").alias("__row")).select("__row.*")
    return first.join(stored.select(*keys), list(keys), "left_anti")


def upserted(stored: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """The table after an upsert, as a rewrite: the last incoming row of a key replaces the stored one."""
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*stored.columns), "ord").alias("__row")).select("__row.*")
    return stored.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def save_chunk(spark: SparkSession, df: DataFrame, path: str, manifest: str, kind: str, index: int) -> bool:
    """Writes a chunk of facts to its own partition unless the same chunk is there; returns whether it wrote.

    A repeat with the same content changes nothing; a repeat with other content replaces the chunk.
    """
    target = f"{path}/manifest={manifest}/kind={kind}/chunk={index}"
    hashed = content_hash(df, *df.columns)
    mark = hashed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("content_hash").cast("decimal(38,0)"))).first()
    try:
        there = spark.read.parquet(target)
        if there.agg(F.count(F.lit(1)), F.sum(F.xxhash64("content_hash").cast("decimal(38,0)"))).first() == mark:
            return False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    hashed.write.mode("overwrite").parquet(target)
    return True


def manifest_state(chunks: DataFrame, expected: int) -> DataFrame:
    """manifest, chunks, facts, complete of chunk rows (manifest, chunk, facts, hash): all indexes there, none with two hashes."""
    g = chunks.groupBy("manifest").agg(F.count_distinct("chunk").alias("chunks"), F.max("chunk").alias("last"), F.sum("facts").alias("facts"), F.count_distinct("chunk", "hash").alias("hashes"))
    return g.select("manifest", "chunks", "facts", ((F.col("chunks") == expected) & (F.col("last") == expected - 1) & (F.col("hashes") == F.col("chunks"))).alias("complete"))


def import_snapshot(spark: SparkSession, path: str, known_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of a JSON snapshot that are valid and not known yet, and those that are not valid."""
    rows = spark.read.schema("run_id STRING, status STRING, created_at STRING, document STRING").json(path)
    good = F.col("run_id").rlike("^[0-9a-f]{32}$") & F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$") & F.coalesce(F.try_parse_json("document").isNotNull(), F.lit(False))
    good = F.coalesce(good, F.lit(False))
    return rows.filter(good).join(known_runs.select("run_id"), "run_id", "left_anti"), rows.filter(~good)


def write_summary(df: DataFrame, path: str, kind: str) -> None:
    """A small table as csv or json."""
    if kind == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.coalesce(1).write.mode("overwrite").json(path)
