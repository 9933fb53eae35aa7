"""The trigger stream: order, batches, replays."""

from pyspark.sql import functions as F

from vitrine.sources.shared import new_shared
from vitrine.streaming import triggers as G

ROWS = [
    (1, 1, "insert", "deterministic", None, 1), (1, 2, "update", "complete", None, 2), (1, 3, "update", "failed", None, 3), (1, 4, "receipt", None, "k", 4), (1, 5, "receipt", None, "k", 5),
    (2, 6, "insert", "failed", None, 6), (3, 7, "update", "x", None, 7), (2, 8, "insert", "x", None, 8), (4, 9, "receipt", None, "z", 9), (None, 10, "insert", "failed", None, 10), (5, 11, "insert", "dispatching", None, 600),
]
WANT = [(1, 1, "applied", "deterministic"), (1, 2, "applied", "complete"), (1, 2, "outbox", "complete"), (1, 3, "refused", "immutable"), (1, 4, "acknowledged", "k"), (1, 5, "refused", "repeated receipt"), (2, 6, "applied", "failed"), (2, 6, "outbox", "failed"), (2, 6, "overdue", "failed"), (2, 8, "refused", "exists"), (3, 7, "refused", "unknown"), (4, 9, "refused", "nothing pending"), (5, 11, "applied", "dispatching")]


def changes(spark, folder):
    schema = "id long, seq long, change string, status string, receipt string, at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def write(spark, rows, folder):
    df = spark.createDataFrame(rows, "id long, seq long, change string, status string, receipt string, m long").withColumn("at", F.timestamp_seconds(F.col("m") * 60)).drop("m")
    df.coalesce(1).write.mode("append").parquet(folder)


def test_effects_over_batches_and_a_replayed_one(spark):
    folder = new_shared(spark, "t")
    for part in (ROWS[:3], ROWS[3:7], ROWS[7:]):
        write(spark, part, f"{folder}/in")
    got = G.run(changes(spark, f"{folder}/in"), folder)
    rows = sorted((r["id"], r["seq"], r["effect"], r["detail"]) for r in got.collect())
    assert rows == WANT and got.select("batch").distinct().count() > 2
    # A batch that is run again replaces its own rows.
    got.filter("batch = 0").drop("batch").write.mode("overwrite").parquet(f"{folder}/again")
    spark.read.parquet(f"{folder}/again").write.mode("overwrite").parquet(f"{folder}/effects/batch=0")
    # A restart with nothing new, and one with a late number, add nothing and a refusal.
    assert sorted((r["id"], r["seq"], r["effect"], r["detail"]) for r in G.run(changes(spark, f"{folder}/in"), folder).collect()) == WANT
    write(spark, [(5, 3, "update", "complete", None, 601)], f"{folder}/in")
    assert sorted((r["id"], r["seq"], r["effect"], r["detail"]) for r in G.run(changes(spark, f"{folder}/in"), folder).collect()) == sorted([*WANT, (5, 3, "refused", "late")])
