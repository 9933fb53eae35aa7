"""Hard negatives against an exhaustive search; bounds against exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import negatives
from vitrine.llm.topk import quantized

SCHEMA = "vec_id long, embedding array<float>, label int, row string, w string, code string, rest string, a string"


def brute(rows):
    sound = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, w in sound:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(w, v)), j, m) for j, m, v in sound if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            some = [(n, t) for t, n, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, k + 1, n, -s, -t) for k, (n, t) in enumerate(some)]
    return sorted(out)


def mine(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c", "c", "c", "c", "c") for r in rows], SCHEMA)
    vectors = quantized(df, 256, keep=("label",)).filter(F.col("label").isNotNull())
    return sorted(tuple(r) for r in negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, **options).collect())


def some_rows(seed, n=120, dims=7):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dims))
    rows = [(i, (centres[i % 4] + r.normal(size=dims) * 0.7).tolist(), int(r.integers(3))) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(60)]  # one vector a third of all rows
    rows += [(900, None, 1), (910, [1.0, None], 1), (920, [float("nan")] * dims, 1), (930, [float("inf")] * dims, 2), (None, [1.0] * dims, 1), (940, [0.0] * dims, 0), (950, [], 0), (960, [1.0, 1.0], 0), (970, [1.0] * dims, None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"query_block": 5, "row_block": 16, "words": 4, "most_rows": 20}])
def test_is_the_exhaustive_search(spark, options):
    rows = some_rows(1)
    random.Random(2).shuffle(rows)
    got = mine(spark, rows, **options)
    assert got == brute(rows) and len(got) > 50


def test_repeated_ids_and_empty_table(spark):
    rows = some_rows(3, 40)
    rows += [(10, rows[5][1], 1), (20, rows[7][1], 0), (20, rows[7][1], 0)]
    assert mine(spark, rows, row_block=16) == brute(rows)
    assert mine(spark, []) == []
    assert mine(spark, [(10, [1.0], 1)]) == []


def test_bounds_hold_whatever_the_codebooks_are():
    import pandas as pd

    r = np.random.default_rng(5)
    for scale in (1, 300, 10**8):
        w = (r.normal(size=(200, 6)) * scale).astype(np.int64)
        books = r.normal(size=(3, 8, 2)) * scale
        codes = np.stack([negatives.nearest(w[:, 2 * s : 2 * s + 2].astype(float), b) for s, b in enumerate(books)], axis=1)
        rest = w - np.concatenate([b[codes[:, s]] for s, b in enumerate(books)], axis=1)
        pdf = pd.DataFrame({"row": range(200), "vec_id": range(200), "label": 0, "w": list(w), "code": [c.tobytes() for c in codes.astype(np.uint8)], "rest": np.sqrt((rest**2).sum(axis=1)) * (1 + negatives.MARGIN)})
        block = negatives.Block(pdf, books, 6)
        low, high = block.bounds(w[:50])
        exact = w @ w[:50].T
        assert (low <= exact).all() and (exact <= high).all() and (high - low).max() < 40 * np.abs(exact).max()


def test_learned_codebooks_rule_most_rows_out(spark):
    r = np.random.default_rng(7)
    x = np.floor(256 * r.normal(size=(4000, 16)) / 4).astype(np.int64)
    books = np.stack([negatives.k_means(x[:2000, s : s + 2].astype(float), 256, 8) for s in range(0, 16, 2)])
    codes = np.stack([negatives.nearest(x[:, 2 * s : 2 * s + 2].astype(float), b) for s, b in enumerate(books)], axis=1)
    rest = x - np.concatenate([b[codes[:, s]] for s, b in enumerate(books)], axis=1)
    import pandas as pd

    block = negatives.Block(pd.DataFrame({"row": range(4000), "vec_id": range(4000), "label": 0, "w": list(x), "code": [c.tobytes() for c in codes.astype(np.uint8)], "rest": np.sqrt((rest**2).sum(axis=1))}), books, 16)
    low, high = block.bounds(x[:20])
    every = np.ones_like(low, dtype=bool)
    at, _ = negatives.reaching(low, high, every, every, 5)
    assert len(at) < 0.05 * low.size
