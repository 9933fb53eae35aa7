"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into blocks of bounded size; every block of queries meets
every block of candidates. Inside, each dimension (term) has a posting list of the candidates
whose weight there is not zero; a query's terms scatter their weighted postings into dense
score arrays, one term after the other. A partition selection keeps k candidates a query and
block, ties by the smaller id, and a window merges the blocks. Scores are exact 64-bit integers.

Defined cases: vectors that are null or hold null or non-finite components take no part; a
vector without components scores zero with all; missing dimensions count as zero; rows that
repeat an id are candidates of their own, but not for the query of that id; a query row that
repeats an id is a query of its own, with its own ranks; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table


def quantized(df: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id and floor(scale * x) of every component x, of the sound vectors; and the columns of keep."""
    v = F.col(vector_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    sound = F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(v, odd), F.lit(True)) & F.col(id_col).isNotNull()
    return df.filter(sound).select(*keep, F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("w"))


def accumulate(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of a block for each query of a block."""
    ids = candidates["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, weights = ids[order], candidates["w"].to_numpy()[order]
    dims = max([0, *map(len, weights), *map(len, queries["w"])])
    dense = np.zeros((dims, len(ids)), dtype=np.int64)
    for j, w in enumerate(weights):
        dense[: len(w), j] = w
    postings = [(at := np.flatnonzero(row), row[at]) for row in dense]
    full = [len(at) == len(ids) for at, _ in postings]
    out = []
    for asked, query, w in zip(queries["asked"].tolist(), queries["vec_id"].tolist(), queries["w"]):
        scores = np.zeros(len(ids), dtype=np.int64)
        for term in np.flatnonzero(w).tolist():
            at, values = postings[term]
            if full[term]:
                scores += w[term] * values
            else:
                scores[at] += w[term] * values
        own = np.flatnonzero(ids != query)
        scores = scores[own]
        if len(own) > k:
            least = np.partition(scores, len(own) - k)[len(own) - k]
            above = np.flatnonzero(scores > least)
            level = np.flatnonzero(scores == least)[: k - len(above)]  # in order of ids
            keep = np.concatenate([above, level])
        else:
            keep = np.arange(len(own))
        out.append(pd.DataFrame({"asked": asked, "query_id": query, "vec_id": ids[own[keep]], "score": scores[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"asked": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int, query_block: int = 2048, candidate_block: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score from two tables of vec_id, w (array of long)."""
    n_q, n_c = (max(1, math.ceil(df.count() / size)) for df, size in ((queries, query_block), (candidates, candidate_block)))
    mix = F.xxhash64("vec_id", "w")
    queries = materialize(queries.withColumn("asked", F.monotonically_increasing_id()), "queries")
    q = queries.withColumn("q", F.pmod(mix, F.lit(n_q)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = candidates.withColumn("c", F.pmod(mix, F.lit(n_c)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return accumulate(left, right, k)

    best = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInPandas(meet, "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_term_at_a_time(spark, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for every query."""
    vectors = materialize(quantized(table(spark, sf_dir, "embeddings"), 256), "quantized")
    return top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
