"""Pages of stored checkpoints: all rows once, and no other folder is read."""

import re

from pyspark.sql import functions as F

from vitrine.sources import checkpoints as C
from vitrine.sources.shared import new_shared


def test_pages_go_through_a_run_and_read_its_folder_alone(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 200)).alias("run"), (F.col("id") % 5).alias("attempt"), F.col("id").alias("batch"), F.concat(F.lit("p"), "id").alias("payload"))
    path = new_shared(spark, "checkpoints")
    C.write_checkpoints(df, path)
    want = [(r["attempt"], r["batch"]) for r in df.filter("run = 'r7'").orderBy(F.col("attempt").desc(), "batch").collect()]
    got, after, more = [], None, True
    while more:
        rows = C.page(spark, path, "r7", after, size=6).collect()
        got += [(r["attempt"], r["batch"]) for r in rows]
        after, more = got[-1], rows[0]["more"]
    assert got == want and len(want) == 20
    one = C.page(spark, path, "r7", (3, 5), 6)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(run,r7\)", plan)
    folder = spark.range(1).select(C.folder_of(F.lit("r7"))).first()[0]
    read = {r["folder"] for r in C.read_checkpoints(spark, path).filter(F.col("folder") == folder).select("folder").distinct().collect()}
    assert read == {folder} and len(C.read_checkpoints(spark, path).select("folder").distinct().collect()) > 30
    assert C.page(spark, path, "none").collect() == []


def test_pages_of_many_runs(spark):
    df = spark.range(300).select(F.concat(F.lit("r"), F.col("id") % 9).alias("run"), (F.col("id") % 4).alias("attempt"), F.col("id").alias("batch"), F.lit("p").alias("payload"))
    path = new_shared(spark, "checkpoints")
    C.write_checkpoints(df, path, 4)
    cursors = [(f"r{k}", None if k % 3 == 0 else k % 4, None if k % 3 == 0 else 100) for k in range(7)] + [("gone", None, None)]
    got = {}
    for r in C.pages(C.read_checkpoints(spark, path), spark.createDataFrame(cursors, "run string, attempt int, batch long"), 5, 4).collect():
        got.setdefault(r["run"], []).append((-r["attempt"], r["batch"], r["more"]))
    all_rows = [(r["run"], r["attempt"], r["batch"]) for r in df.collect()]
    for run, a, b in cursors[:-1]:
        rows = sorted((-x, y) for r, x, y in all_rows if r == run and (a is None or x < a or (x == a and y > b)))
        assert sorted(got.get(run, [])) == [(*x, len(rows) > 5) for x in rows[:5]]
