"""Mixing sources to target weights.

Every document gets a hash-random key; within a source, documents in the order of their keys
are taken until the source's budget is used up exactly: whole epochs first, then a part of
one. The order is never sorted as a whole. Key space is cut into ranges of equal width (spans,
which hash-random keys fill evenly, about span_rows documents each), sums of the spans give
each source's prefix sums, and only the one span where a source's budget ends is ordered, to
find the document that is cut and how many of its words are still taken. That span is ordered by
key, then by a hash of the whole row, over Spark's range partitions: rows that share a key, such as
those without an id or with one common id, are divided like any others, and a rerun on other
partitions takes the same texts.

Defined cases: a null text has size 0 and is never short of its zero words; null sources form
one source, last in the order of weights; sources of size 0 get nothing; an empty table gives
no rows; rows that repeat an id, or have none, share a key and are taken one after the other in the
order of their contents; extra columns pass through (those of type map don't count as content). The
targets are computed over one row a source in one task, which holds some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from .common import WORD, materialize, table

#: Bits of a span's number: at least, and at most.
LEAST_BITS, MOST_BITS = 12, 26
#: Names for working columns that no table has.
P = "__mix_"


def word_count(col: str):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """Adds `target` to a table of source, source_size: shares of the total by weight, none above most_epochs times its size.

    Excess goes to the others by weight until none is above: in the order of limit / weight,
    the sources up to some place get their limits and all later ones the same level times
    their weights. The table has one row a source.
    """
    nth = F.row_number().over(Window.orderBy(F.col(P + "source").asc_nulls_last()))
    weight = F.array(*(F.lit(float(w)) for w in weights))[(nth - 1) % F.lit(len(weights))]
    limit = F.lit(float(most_epochs)) * F.col(P + "source_size")
    order = Window.orderBy((F.col("limit") / F.col("w")), F.col(P + "source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum(F.col(P + "source_size").cast("double")).over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    rows = sizes.withColumn("w", weight).withColumn("limit", limit).withColumn("level", level)
    capped = F.col("level") * F.col("w") > F.col("limit")
    rows = rows.withColumn("capped", capped)
    # Past the first source that keeps its level, levels only fall.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(F.least(F.col("limit"), final * F.col("w")))).drop(
        "w", "limit", "level", "capped"
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size=None,
    weights: tuple[int, ...] = (1, 2, 3),
    most_epochs: int = 3,
    seed: int = 11,
    span_rows: int = 20_000,
) -> DataFrame:
    """df's rows with __mix_size, __mix_source_size, __mix_target, __mix_epochs (times the whole text is taken), __mix_part (words of it taken once more) and __mix_taken.

    size: a column of words per row; by default the words of `text`.
    """
    size = word_count("text") if size is None else size
    bits = min(MOST_BITS, max(LEAST_BITS, (df.count() // span_rows).bit_length()))
    rows = df.withColumn(P + "key", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn(P + "size", size)
    rows = rows.withColumn(P + "span", (F.shiftright(P + "key", 64 - bits) + F.lit(1 << (bits - 1))).cast("int")).withColumn(P + "source", F.col(source_col))
    spans = materialize(rows.groupBy(P + "source", P + "span").agg(F.sum(P + "size").alias("words")), "spans")
    sizes = targets(spans.groupBy(P + "source").agg(F.sum("words").alias(P + "source_size")), weights, most_epochs)
    budget = F.least(F.round("target").cast("long"), F.lit(most_epochs) * F.col(P + "source_size"))
    full = F.when(F.col(P + "source_size") > 0, F.floor(budget / F.col(P + "source_size"))).otherwise(F.lit(0)).cast("long")
    sizes = sizes.withColumn("full", full).withColumn("rest", budget - F.col("full") * F.col(P + "source_size"))
    order = Window.partitionBy(P + "source").orderBy(P + "span").rowsBetween(Window.unboundedPreceding, 0)
    ends = spans.withColumn("end", F.sum("words").over(order)).withColumn("begin", F.col("end") - F.col("words"))
    same = F.col("s." + P + "source").eqNullSafe(F.col("e." + P + "source"))
    plan = (
        sizes.alias("s")
        .join(ends.alias("e"), same & (F.col("begin") < F.col("rest")) & (F.col("end") >= F.col("rest")), "left")
        .select(
            F.col("s." + P + "source").alias(P + "own"),
            P + "source_size",
            F.col("target").alias(P + "target"),
            F.col("full").alias(P + "full"),
            F.col("rest").alias(P + "rest"),
            F.col(P + "span").alias(P + "cut"),
            F.col("begin").alias(P + "begin"),
        )
    )
    plan = materialize(plan, "budgets")
    plan = F.broadcast(plan) if plan.count() <= 10_000 else plan
    rows = rows.join(plan, F.col(P + "source").eqNullSafe(F.col(P + "own")))
    span, cut = F.col(P + "span"), F.col(P + "cut")
    whole = rows.filter(cut.isNull() | (span != cut))
    whole = whole.withColumn(P + "epochs", F.col(P + "full") + F.when(span < cut, 1).otherwise(0)).withColumn(P + "part", F.lit(0).cast("long"))
    # Only the span in which a source's budget ends is ordered.
    content = [F.struct(F.col(f.name)) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    last = rows.filter(span == cut).withColumn(P + "tie", F.xxhash64(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(content)))))).withColumn(P + "row", F.monotonically_increasing_id())
    last = running_sum(last, [P + "source"], [P + "key", P + "tie", P + "row"], F.col(P + "size"), P + "sum").drop(P + "tie", P + "row")
    before = F.col(P + "begin") + F.col(P + "sum") - F.col(P + "size")
    last = last.withColumn(P + "got", F.greatest(F.lit(0), F.least(F.col(P + "size"), F.col(P + "rest") - before)))
    all_of_it = (F.col(P + "got") == F.col(P + "size")) & (F.col(P + "size") > 0)
    last = (
        last.withColumn(P + "epochs", F.col(P + "full") + F.when(all_of_it, 1).otherwise(0))
        .withColumn(P + "part", F.when(all_of_it, F.lit(0)).otherwise(F.col(P + "got")).cast("long"))
        .drop(P + "got", P + "sum")
    )
    taken = F.col(P + "epochs") * F.col(P + "size") + F.col(P + "part")
    out = whole.unionByName(last).withColumn(P + "taken", taken)
    return out.drop(*(P + c for c in ("own", "full", "rest", "cut", "begin", "key", "span", "source")))


def mixed_rows(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: df's columns, each row as often as it is taken; where a budget ends inside a text, one more row holds the words taken from it."""
    rows = mix(df, **options)
    part = F.col(P + "part")
    texts = F.concat(
        F.array_repeat(F.col(text_col), F.col(P + "epochs").cast("int")),
        F.when(part > 0, F.array(F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})")), F.lit(1), part.cast("int")), " "))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    copies = rows.withColumn(P + "text", F.explode(texts))
    return copies.select(*(F.col(P + "text").alias(c) if c == text_col else F.col(c) for c in df.columns))


def op8_prefix_sum_mix(spark, sf_dir: str) -> DataFrame:
    """The words that the mix takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    out = mix(materialize(docs, "sizes"), size=F.col("size"))
    return out.select(
        "doc_id",
        "size",
        F.col(P + "source_size").alias("source_size"),
        F.col(P + "target").alias("target"),
        F.col(P + "taken").cast("long").alias("taken"),
    )
