"""Near-duplicate embeddings by random-hyperplane hashing in several tables.

Equal vectors of one label form a class and are compared once. Every class's vector is hashed
by the signs of its products with random hyperplanes, in so many tables that a pair at the
threshold is missed with a probability below `miss`. Rows that share a table's hash and label
meet in blocks of bounded size (a full bucket is dealt into blocks, and all pairs of blocks
meet), where exact cosines in double precision decide. A pair counts in the first table in
which its hashes agree and in no other, so link counts add up without listing pairs; only the
links of a spanning forest leave a block, for the connected components.

Defined cases: vectors that are null, zero, or hold null, NaN or infinite components, and rows
without a label, link with nothing and are components of their own; vectors of different
lengths never link; copies link with each other; rows that repeat a vec_id count as vectors of
their own and share its component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

BLOCK = 1024


def hash_plan(n: int, threshold: float, miss: float, per_bucket: float = 0.25) -> tuple[int, int]:
    """Bits of a hash and tables: so many tables that at most `miss` of the pairs at the threshold share none.

    Four buckets a vector leave most vectors without chance company, and a vector goes to the
    next step only in tables where it has company.
    """
    bits = max(6, min(30, math.ceil(math.log2(max(n, 2) / per_bucket))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def signs(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """[row, table] hashes: the signs of products with hyperplanes that depend on the dimension and the seed alone."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    on = (x @ planes > 0).reshape(len(x), tables, bits)
    return (on * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at or above the threshold that meet in table t first."""
    i, j = np.nonzero(a @ b.T >= threshold)
    if t and len(i):
        first = np.ones(len(i), dtype=bool)
        for lo in range(0, len(i), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            first[own] = ~(ha[i[own], :t] == hb[j[own], :t]).any(axis=1)
        i, j = i[first], j[first]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of links that form a spanning forest of n nodes."""
    parent = list(range(n))

    def find(u: int) -> int:
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        return u

    kept = []
    for k, (u, v) in enumerate(zip(i.tolist(), j.tolist())):
        u, v = find(u), find(v)
        if u != v:
            parent[u] = v
            kept.append(k)
    return kept


def compared(classes: DataFrame, bits: int, tables: int, threshold: float, seed: int) -> DataFrame:
    """Counts and links of all classes: rows (class, n, other): n vectors that link to the class, or a link to another class."""

    def hashed(batches):
        for b in batches:
            # Rows of one dimension at a time.
            size = np.array([len(v) for v in b.column(2).to_pylist()])
            for d in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == d)))
                h = signs(unit(part.column(2).to_pylist()), bits, tables, seed)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * tables, pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([int(d)] * len(part), pa.int32()), cells], names=["class", "copies", "v", "label", "dim", "hashes"])

    kind = classes.schema["label"].dataType.simpleString()
    element = classes.schema["v"].dataType.simpleString()
    rows = materialize(
        classes.select("class", "copies", "v", "label").mapInArrow(hashed, f"class long, copies long, v {element}, label {kind}, dim int, hashes array<int>"), "hashes"
    )
    cells = rows.select("label", "dim", F.posexplode("hashes").alias("t", "h"), "class")
    counts = cells.groupBy("label", "dim", "t", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Only buckets with company go on.
    busy = cells.join(counts, ["label", "dim", "t", "h"]).join(rows.select("class", "copies", "v", "hashes"), "class")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    met = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi")))
    dealt = busy.withColumn("own", own).withColumn("met", F.explode(met)).select("label", "dim", "t", "h", "met", "own", "class", "copies", "v", "hashes")
    # Small buckets share a group: a group per bucket would be nearly empty.
    crowded = F.col("met.hi") > 0
    share = F.pmod(F.xxhash64("label", "dim", "t", "h"), F.lit(1 << 20))
    dealt = dealt.withColumn("g", F.when(crowded, F.xxhash64("label", "dim", "t", "h", "met")).otherwise(share))
    parts = max(8, math.ceil(rows.count() * tables / 20_000))
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", "label", "dim", "t", "h", "met")

    def block(own: np.ndarray, cls: np.ndarray, copies: np.ndarray, x: np.ndarray, h: np.ndarray, t: int, lo: int, hi: int):
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        i, j = linked(x[a], x[b], h[a], h[b], t, threshold)
        i, j = a[i], b[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        n = np.bincount(i, weights=copies[j], minlength=len(cls)) + np.bincount(j, weights=copies[i], minlength=len(cls))
        some = np.flatnonzero(n)
        links = forest(len(cls), i, j)
        yield cls[some], n[some].astype(np.int64), None
        yield cls[i[links]], None, cls[j[links]]

    def run(batches):
        def finished(rows: pd.DataFrame):
            """Results of whole buckets."""
            key = rows.groupby(["label", "dim", "t", "h", "lo", "hi"], sort=False)
            out = []
            for (_, _, t, _, lo, hi), g in key:
                if len(g) > 1:
                    out += block(g["own"].to_numpy(), g["class"].to_numpy(), g["copies"].to_numpy(), unit(g["v"].to_list()), np.stack(g["hashes"].to_list()), t, lo, hi)
            for cls, n, other in out:
                if len(cls):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cls), pa.array(n if n is not None else [None] * len(cls), pa.int64()), pa.array(other if other is not None else [None] * len(cls), pa.int64())],
                        names=["class", "n", "other"],
                    )

        held = []
        for b in batches:
            pdf = b.to_pandas()
            pdf["lo"], pdf["hi"] = [m["lo"] for m in pdf["met"]], [m["hi"] for m in pdf["met"]]
            held.append(pdf.drop(columns="met"))
            last = held[-1]["g"].iloc[-1]
            if held[0]["g"].iloc[0] != last:
                rows = pd.concat(held)
                yield from finished(rows[rows["g"] != last])
                held = [rows[rows["g"] == last]]
        if held:
            yield from finished(pd.concat(held))

    return dealt.mapInArrow(run, "class long, n long, other long")


def near_duplicates(
    df: DataFrame, threshold: float = 0.98, miss: float = 1e-5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 19
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col(vector_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    sound = F.col(vector_col).isNotNull() & F.col(label_col).isNotNull() & ~F.coalesce(F.exists(v, odd), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"), sound.alias("sound")
    ).withColumn("k1", F.when(F.col("sound"), F.xxhash64("v", "label"))).withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(1), "label", "v")))
    classes = (
        rows.filter("sound")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
        .withColumn("class", F.col("k1"))
    )
    classes = materialize(classes, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = hash_plan(most, threshold, miss)
    found = materialize(compared(classes, bits, tables, threshold, seed), "found")
    links = found.filter("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b"))
    roots = components(links, "a", "b")
    counts = found.filter("n IS NOT NULL").groupBy("class").agg(F.sum("n").alias("others"))
    rooted = classes.select("class", "k1", "k2", "least", "copies").join(roots, classes["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class"))
    rooted = materialize(rooted.drop("node"), "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    full = rooted.join(component, "root").join(counts, "class", "left").select("k1", "k2", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "k1", "k2").join(full, ["k1", "k2"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), component_id.eqNullSafe(F.col("vec_id")).alias("kept")
    )


def op6_hyperplane_tables(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.98 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings
), n AS (
  SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v
  WHERE e IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
), ok AS (SELECT * FROM n WHERE norm > 0), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum([p[1] * p[2] FOR p IN list_zip(a.e, b.e)]) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT c.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN degree d ON c.vec_id = d.vec_id
"""
