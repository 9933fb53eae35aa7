import zlib
from collections import Counter

from pyspark.sql import functions as F

from vitrine.llm.sharding import assign_shards, write_shards


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check(rows, n_shards, total_tolerance):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < n_shards for s in by)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(n_shards):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / n_shards) <= most + total_tolerance


def test_odd_rows(odd_docs, no_docs):
    rows = rows_of(assign_shards(odd_docs, 4))
    source = odd_docs.select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in source)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in source)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    check(rows, 4, 1)
    assert assign_shards(no_docs, 4).collect() == []


def test_sizes_are_near_equal_with_a_hot_group_and_tiny_rows(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same long text " * 20).alias("text"))
    tiny = spark.range(3000, 9000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rest = spark.range(9000, 12000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 500).cast("int")).alias("text"))
    rows = rows_of(assign_shards(hot.union(tiny).union(rest), 16, least_ranges=64))
    assert len(rows) == 12000
    check(rows, 16, 1)


def test_write_shards(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"] for r in back.collect()} == set(range(50)) and back.select("shard").distinct().count() == 5


def test_write_shards_keeps_rows_without_an_id_and_repeated_ones(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), (3, "c"), (3, "d"), (5, None), (6, "a"), (6, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit(1))
    assigned = write_shards(df, str(tmp_path / "out"), 3)
    back = [(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(back, key=str) == sorted(rows, key=str)
    assert sorted((str(r["doc_id"]) for r in assigned.collect())) == sorted(str(i) for i, _ in rows)
