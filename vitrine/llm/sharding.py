"""Sharding by sampled splitters (native: DataFrame functions only).

A record's place is its key (hash of the text, hash of the id, a random tie-break), so equal
texts stand next to each other. Size-weighted samples of keys give quantile boundaries;
records are range-partitioned by them; ranges that turn out overfull (one hot text, or very
many tiny records) are sampled again and subdivided. Exact sums of the ranges, carried over
all ranges in key order, then place every record: shard = which of n equal spans of the total
bytes holds the record's midpoint. Shards differ by less than the size of one record at
either end, whatever the samples were.

Defined cases: a null text counts as empty (size = overhead); null ids hash like any value;
repeated rows are told apart by the tie-break; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, uniform

#: Cells of equal width on the first key column, to find a record's range without a search
#: over all boundaries.
CELL_BITS = 12
KEY = ("k1", "k2", "tie")
#: Most ranges before overfull ones are subdivided, which bounds samples and what is broadcast.
MOST_RANGES = 100_000


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """id, size, crc32 and key of each record; the text itself goes no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.col(id_col), F.lit(1)).alias("k2"),
        F.rand(17).alias("tie"),
    )


def sample_splitters(records: DataFrame, weight, total: float, ranges: int, per_range: int, seed: int) -> DataFrame:
    """About `ranges` boundaries at the weighted quantiles of a sample of ranges * per_range keys.

    A record is drawn with a probability in proportion to its weight; one that would be drawn
    for certain stands for its own weight. The sample has about ranges * per_range keys, and
    ranges is at most MOST_RANGES, so one task orders it.
    """
    step = total / (ranges * per_range)
    p = F.least(F.lit(1.0), weight / F.lit(step))
    drawn = records.filter(uniform(*KEY, seed=seed) < p).select(*KEY, F.greatest(weight, F.lit(step)).alias("w"))
    order = Window.orderBy(*KEY)
    at = F.floor(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(total / ranges))
    return drawn.withColumn("q", at).withColumn("before", F.lag("q").over(order)).filter("q > before").select(*KEY)


def with_range(records: DataFrame, splitters: DataFrame) -> DataFrame:
    """Adds `range`: the number of boundaries at or below the record's key.

    Boundaries are looked up by cell: how many lie in lower cells, and a short list of those
    in the cell itself. The broadcast holds 2^CELL_BITS cells and the boundaries, of which
    there are a few times MOST_RANGES at most (some 20 MB).
    """
    spark = records.sparkSession
    half = 1 << (CELL_BITS - 1)
    cell = (F.shiftright("k1", 64 - CELL_BITS) + F.lit(half)).cast("long")
    own = splitters.groupBy(cell.alias("cell")).agg(F.collect_list(F.struct(*KEY)).alias("bounds"))
    cells = (
        spark.range(0, 2 * half, 1, 1)
        .withColumnRenamed("id", "cell")
        .join(own, "cell", "left")
        .withColumn("n", F.coalesce(F.size("bounds"), F.lit(0)))
        .withColumn("n", F.greatest("n", F.lit(0)))
    )
    lower = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cells = cells.withColumn("lower", lower).select("cell", "lower", "n", "bounds")
    here = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.size(F.filter("bounds", lambda b: b <= F.struct(*KEY))))
    return (
        records.withColumn("cell", cell)
        .join(F.broadcast(cells), "cell")
        .withColumn("range", (F.col("lower") + here).cast("long"))
        .drop("cell", "lower", "n", "bounds")
    )


def assign_shards(
    df: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    least_ranges: int = 512,
    range_rows: int = 1_000_000,
    per_range: int = 16,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record.

    The number of ranges grows with the rows (range_rows each) up to MOST_RANGES, so that tasks
    order about range_rows slim records each up to 10^11 records, and more beyond.
    """
    records = materialize(keyed(df, id_col, text_col, overhead), "keys")
    total, n = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(least_ranges, min(MOST_RANGES, -(-n // range_rows)))
    splitters = sample_splitters(records, F.col("size").cast("double"), max(total, 1), ranges, per_range, seed=3)
    splitters = materialize(splitters, "splitters")
    for seed in (5, 7, 9):
        placed = with_range(records, splitters)
        sums = materialize(placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "sums")
        over = (F.col("rows") > 4 * max(n / ranges, 64)) | (F.col("bytes") > 4 * max(total / ranges, 1))
        # A range of one record cannot be subdivided.
        overfull = sums.filter(over & (F.col("rows") > 1)).select("range")
        if overfull.isEmpty():
            break
        crowded = placed.join(F.broadcast(overfull), "range", "left_semi")
        share = F.col("size") / F.lit(2.0 * max(total, 1)) + F.lit(0.5 / max(n, 1))
        finer = sample_splitters(crowded, share, 1.0, 2 * ranges, per_range, seed)
        splitters = materialize(splitters.union(finer).distinct(), "splitters")
    else:
        placed = with_range(records, splitters)
        sums = materialize(placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "sums")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select(
        "range",
        (F.sum("rows").over(before) - F.col("rows")).alias("rows_before"),
        (F.sum("bytes").over(before) - F.col("bytes")).alias("bytes_before"),
    )
    inside = Window.partitionBy("range").orderBy(*KEY)
    end = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    twice = F.lit(2) * F.col("end") - F.col("size")
    out = (
        placed.join(F.broadcast(offsets), "range")
        .withColumn("end", end)
        .withColumn("nth", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), (twice * F.lit(n_shards) / F.lit(2 * max(total, 1))).cast("long")).cast("int"))
    )
    firsts = out.groupBy("shard").agg(F.min("nth").alias("first"))
    return out.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).cast("long").alias("slot")
    )


def write_shards(df: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the records, with all their columns, to one folder per shard, and returns the assignment.

    Every row is written once, whatever its id: rows are numbered, and the numbers stand for ids until
    the shards are known. A column named shard takes the assignment.
    """
    rows = materialize(df.drop("shard").withColumn("__row", F.monotonically_increasing_id()), "records")
    assigned = materialize(assign_shards(rows, n_shards, "__row", text_col).withColumnRenamed("doc_id", "__row"), "assigned")
    met = rows.join(assigned.select("__row", "shard"), "__row")
    met.drop("__row").write.partitionBy("shard").parquet(path)
    return assigned.join(rows.select("__row", F.col(id_col).alias("doc_id")), "__row").select("doc_id", "size", "text_crc32", "shard", "slot")


def op1_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 of nearly equal bytes."""
    return assign_shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
