import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vitrine.llm.mixing import P, mix, mixed_rows


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > most * sizes[s]}
        if not over:
            target |= {s: unit * w[s] for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r[P + "size"]
        taken[r["source"]] += r[P + "taken"]
        assert 0 <= r[P + "taken"] <= 3 * r[P + "size"] and r[P + "size"] == words(r["text"])
    target = fill(sizes)
    for r in rows:
        assert r[P + "source_size"] == sizes[r["source"]] and abs(r[P + "target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_odd_rows(odd_docs, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows)
    assert mix(no_docs).collect() == [] and mixed_rows(no_docs).columns == no_docs.columns


def test_targets_epochs_and_reruns(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "tiny").when(F.col("id") % 7 == 0, "Zed").otherwise("ä").alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 90).cast("int")).alias("text"),
    )
    a = mix(df).collect()
    check(a)
    b = {r["doc_id"]: r[P + "taken"] for r in mix(df.repartition(9)).collect()}
    assert b == {r["doc_id"]: r[P + "taken"] for r in a}
    assert max(r[P + "epochs"] for r in a) == 3


def test_mixed_rows_hold_the_words_taken(odd_docs):
    want = Counter()
    for r in mix(odd_docs).collect():
        want[r["doc_id"]] += r[P + "taken"]
    got = Counter()
    for r in mixed_rows(odd_docs).collect():
        got[r["doc_id"]] += words(r["text"])
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_rows_without_an_id_or_with_a_common_one_are_divided_and_reruns_agree(spark, monkeypatch):
    """A third of the rows have no id and a third share one: no task orders more than a few, and other partitions give the same texts."""
    from vitrine.llm import mixing

    k = F.col("id")
    df = spark.range(6000).select(
        F.when(k % 3 == 0, None).when(k % 3 == 1, 7).otherwise(k).alias("doc_id"), F.lit("one").alias("source"), F.concat(F.repeat(F.lit("w "), (k % 50).cast("int")), (k % 500).cast("string")).alias("text"), F.create_map(F.lit("a"), k).alias("m")
    ).union(spark.range(600).selectExpr("id + 10000", "'two'", "concat('t ', id)", "map('a', id)"))
    monkeypatch.setattr(mixing, "LEAST_BITS", 1)
    monkeypatch.setattr(mixing, "MOST_BITS", 1)
    a = Counter(r["text"] for r in mixed_rows(df.drop("m")).collect())
    for n in (1, 5):
        assert Counter(r["text"] for r in mixed_rows(df.drop("m").repartition(n)).collect()) == a
    check(mix(df).collect())
    widths = []
    real = mixing.running_sum

    def watched(rows, *args, **options):
        out = real(rows, *args, parts=16, **options)
        order = [args[0][0], *args[1]]
        parts = rows.repartitionByRange(16, *order).groupBy(F.spark_partition_id()).count().collect()
        widths.extend(r["count"] for r in parts)
        return out

    monkeypatch.setattr(mixing, "running_sum", watched)
    mix(df.drop("m")).collect()
    assert len(widths) > 8 and max(widths) < 0.25 * sum(widths)
