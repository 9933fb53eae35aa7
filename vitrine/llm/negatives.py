"""Hard-negative mining by product quantisation with stored residual norms.

The dimensions are cut into subspaces of two; k-means codebooks for them are learned from a
bounded sample (`most_rows` rows, drawn by a hash of their content), and every row is stored as
its codes and the norm of what the codes leave over. A table of products of an anchor with all
codewords gives a row's score but for the anchor's product with that rest, which is at most the
product of both norms (Cauchy-Schwarz). So each score has a lower and an upper bound that
hold whatever the sample was; float rounding is covered by a margin.

Anchors meet rows in blocks. For the positives, rows of the anchor's label stay if their upper
bound reaches the k-th largest lower bound; for a window of a positive, rows of other labels stay if
their bounds meet the window and their upper bound reaches the k-th largest lower bound of
those surely inside. What stays is scored again in exact 64-bit integers, so each block gives
its k best, and merging the blocks gives the k best of all rows. Nothing is left to chance.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part; missing
dimensions count as zero; a row is not its own positive, and rows that repeat its id are neither its positives nor its negatives;
rows that repeat an id are rows and anchors of their own, and equal rows give equal results each; ties
go to the smaller id; components beyond 2^62 are cut to it; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .topk import quantized

SUB = 2
#: Relative margin for rounding in sums of products of doubles.
MARGIN = 1e-9
#: Score cells held at once, and pairs scored exactly at once.
CELLS, PAIRS = 2_000_000, 65_536


def dense(weights, dims: int, dtype=np.float64) -> np.ndarray:
    """One row for each list of weights, zeros after its end."""
    out = np.zeros((len(weights), dims), dtype=dtype)
    for i, w in enumerate(weights):
        out[i, : len(w)] = w
    return out


def k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centres; to begin with, rows at even places of the order along the first axis."""
    order = np.lexsort(x.T[::-1])
    centres = x[order[(np.arange(k) * len(x)) // k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            sums = np.bincount(near, weights=x[:, d], minlength=k)
            centres[n > 0, d] = sums[n > 0] / n[n > 0]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    for s in range(0, len(x), 16_384):
        out[s : s + 16_384] = np.argmin(half - x[s : s + 16_384] @ centres.T, axis=1)
    return out


def fit(rows: DataFrame, dims: int, words: int = 256, most_rows: int = 8192, rounds: int = 8) -> np.ndarray:
    """Codebooks (subspace, word, dimension) learned from at most most_rows rows."""
    sample = rows.select("w").orderBy(F.xxhash64("w", F.lit(5)), "w").limit(most_rows).toPandas()["w"]
    x = dense(sample, dims)
    return np.stack([k_means(x[:, s : s + SUB], words, rounds) for s in range(0, dims, SUB)])


def encoded(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """Adds code (a byte a subspace) and rest (norm of the residual, rounded up)."""

    def encode(batches):
        for pdf in batches:
            x = dense(pdf["w"], dims)
            codes = np.stack([nearest(x[:, s * SUB : (s + 1) * SUB], b) for s, b in enumerate(books)], axis=1) if len(x) else np.zeros((0, len(books)), dtype=np.int64)
            rest = x - np.concatenate([b[codes[:, s]] for s, b in enumerate(books)], axis=1)
            yield pdf.assign(code=[c.tobytes() for c in codes.astype(np.uint8)], rest=np.sqrt((rest**2).sum(axis=1)) * (1 + MARGIN))

    return rows.mapInPandas(encode, "row long, vec_id long, label long, w array<long>, code binary, rest double")


class Block:
    """Rows of a block, with bounds and exact scores for anchors."""

    def __init__(self, rows: pd.DataFrame, books: np.ndarray, dims: int):
        rows = rows.sort_values(["vec_id", "row"])
        self.ids, self.label = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.w = dense(rows["w"], dims, np.int64)
        self.codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), len(books))
        self.rest = rows["rest"].to_numpy()
        self.size = np.sqrt((self.w.astype(np.float64) ** 2).sum(axis=1)) + self.rest
        self.books = books

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores, a row for each row of the block and a column for each anchor."""
        a = anchors.astype(np.float64)
        score = np.zeros((len(self.ids), len(a)))
        for s, book in enumerate(self.books):
            score += (book @ a[:, s * SUB : (s + 1) * SUB].T)[self.codes[:, s]]
        norm = np.sqrt((a**2).sum(axis=1))
        slack = np.outer(self.rest, norm) + MARGIN * (np.outer(self.size, norm) + 1)
        return score - slack, score + slack

    def exact(self, at: np.ndarray, anchors: np.ndarray, column: np.ndarray) -> np.ndarray:
        return np.concatenate([(self.w[at[s : s + PAIRS]] * anchors[column[s : s + PAIRS]]).sum(axis=1) for s in range(0, len(at), PAIRS)] or [np.zeros(0, dtype=np.int64)])


def reaching(low: np.ndarray, high: np.ndarray, may: np.ndarray, sure: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) that may be among the k best of their column: sure marks rows that certainly count, may those that perhaps do."""
    if len(low) > k:
        least = np.partition(np.where(sure, low, -np.inf), len(low) - k, axis=0)[len(low) - k]
        may = may & (high >= least)
    return np.nonzero(may)


def best(column: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each column, ties by the smaller id."""
    order = np.lexsort((ids, -score, column))
    c = column[order]
    first = np.searchsorted(c, c)
    return order[np.arange(len(c)) - first < k]


def mined(anchors: DataFrame, rows: DataFrame, schema: str, meet, query_block: int, row_block: int) -> DataFrame:
    """meet(anchors, rows) for every block of anchors and every block of rows."""
    n_q, n_c = (max(1, math.ceil(df.count() / size)) for df, size in ((anchors, query_block), (rows, row_block)))
    q = anchors.withColumn("q", F.pmod(F.xxhash64("a"), F.lit(n_q)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = rows.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(n_c)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInPandas(meet, schema)


def hard_negatives(
    vectors: DataFrame,
    is_anchor,
    least_percent: int = 80,
    most_percent: int = 100,
    k_positive: int = 5,
    k_negative: int = 5,
    query_block: int = 8192,
    row_block: int = 4096,
    words: int = 256,
    most_rows: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, w (array of long).

    An anchor's positives are its k_positive best others of its label; a positive's negatives are the first k_negative
    rows of other labels whose score is between the two percentages of the positive's.
    """
    bound = F.lit(1 << 62)
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND w IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), F.transform("w", lambda x: F.least(F.greatest(x, -bound), bound)).alias("w")
    )
    rows = materialize(rows, "vectors")
    dims = max(1, rows.agg(F.max(F.size("w"))).first()[0] or 0)
    dims += -dims % SUB
    if rows.isEmpty():
        books = np.zeros((dims // SUB, 1, SUB))
    else:
        books = fit(rows, dims, words, most_rows)
    rows = materialize(encoded(rows, books, dims), "codes")
    anchors = rows.filter(is_anchor).select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("w").alias("anchor_w"))

    def positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, block = [], Block(right, books, dims)
        step = max(1, CELLS // max(1, len(right)))
        for s in range(0, len(left), step):
            part = left.iloc[s : s + step]
            w = dense(part["anchor_w"], dims, np.int64)
            same = (block.label[:, None] == part["anchor_label"].to_numpy()) & (block.ids[:, None] != part["anchor_id"].to_numpy())
            low, high = block.bounds(w)
            at, column = reaching(low, high, same, same, k_positive)
            score = block.exact(at, w, column)
            keep = best(column, score, block.ids[at], k_positive)
            out.append(pd.DataFrame({"a": part["a"].to_numpy()[column[keep]], "positive_id": block.ids[at[keep]], "positive_score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "positive_id": [], "positive_score": []}).astype("int64")

    found = mined(anchors, rows, "a long, positive_id long, positive_score long", positives, query_block, row_block)
    order = Window.partitionBy("a").orderBy(F.col("positive_score").desc(), "positive_id")
    found = materialize(found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k_positive), "positives")
    windows = found.groupBy("a").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))
    asked = anchors.join(windows, "a")

    def negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, block = [], Block(right, books, dims)
        step = max(1, CELLS // max(1, len(right)))
        width = np.array([len(x) for x in left["scores"]], dtype=np.int64)
        which, tops = np.repeat(np.arange(len(left)), width), np.concatenate([*left["scores"], np.zeros(0, dtype=np.int64)]).astype(np.int64)
        for s in range(0, len(which), step):
            own, top = which[s : s + step], tops[s : s + step]
            part = left.iloc[own[0] : own[-1] + 1]
            own = own - own[0]
            w = dense(part["anchor_w"], dims, np.int64)
            low, high = (x[:, own] for x in block.bounds(w))
            other = ((block.label[:, None] != part["anchor_label"].to_numpy()) & (block.ids[:, None] != part["anchor_id"].to_numpy()))[:, own]
            # Rounded outwards for what may count, inwards for what surely counts.
            from_, to = top * (least_percent / 100), top * (most_percent / 100)
            gap = MARGIN * np.abs(top) + 1e-6
            may = other & (high >= from_ - gap) & (low <= to + gap)
            sure = other & (low >= from_ + gap) & (high <= to - gap)
            at, column = reaching(low, high, may, sure, k_negative)
            score = block.exact(at, w, own[column])
            inside = [least_percent * p <= 100 * n <= most_percent * p for n, p in zip(score.tolist(), top[column].tolist())]
            at, column, score = at[inside], column[inside], score[inside]
            keep = best(column, score, block.ids[at], k_negative)
            out.append(pd.DataFrame({"a": part["a"].to_numpy()[own[column[keep]]], "positive_score": top[column[keep]], "negative_id": block.ids[at[keep]], "negative_score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "positive_score": [], "negative_id": [], "negative_score": []}).astype("int64")

    got = mined(asked, rows, "a long, positive_score long, negative_id long, negative_score long", negatives, query_block, row_block)
    order = Window.partitionBy("a", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    got = got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k_negative)
    named = found.join(anchors.select("a", "anchor_id"), "a")
    return named.join(got, ["a", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_product_quantised(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives among all embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    vectors = quantized(vectors.withColumn("label", label).filter(F.col("label").isNotNull()), 256, keep=("label",))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other_id, q.label = c.label AS same, coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
