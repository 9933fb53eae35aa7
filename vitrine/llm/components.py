"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(both: DataFrame, least: DataFrame, condition) -> DataFrame:
    """Links each neighbour v of u that meets the condition to the least node around u."""
    return both.join(least, "u").filter(condition).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, root of every node that has an edge; the root is the least node of its component.

    Each round is two aggregations and two joins over the edges; nothing is gathered by
    component, and rounds grow with the logarithm of the longest chain. Self-loops and
    repeated edges are allowed; a null end drops the edge; no edges give no rows.
    """
    e = (
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    mark = None
    for _ in range(most_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = _stars(both, least, F.col("v") > F.col("u")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        e = materialize(e.distinct(), "edges")
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
