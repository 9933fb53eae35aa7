import math

import numpy as np
import pytest

from vitrine.llm import embeddings as E
from vitrine.llm import topk as T

BAD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, float("nan"), 0.0], [float("inf"), 1.0, 0.0]]


def vectors(seed, n):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = r.standard_normal(3)
        out += [(base + r.standard_normal(3) * s).tolist() for s in r.choice([0, 0.05, 0.3], r.integers(1, 6))]
    return out[:n]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS v", "'clash' AS class", "1 AS n", "'clash' AS h")


def brute(rows, threshold):
    good = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    v = [np.array(r[1], np.float32).astype(float) if good(r[1]) and r[2] is not None else None for r in rows]
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    link = [[i != j and rows[i][2] == rows[j][2] and near(v[i], v[j]) for j in range(len(v))] for i in range(len(v))]
    ids = [r[0] for r in rows]
    label = list(ids)
    for _ in ids:
        label = [min([label[i], *(label[j] for j in range(len(ids)) if link[i][j])]) for i in range(len(ids))]
    return sorted((ids[i], sum(link[i]), label[i], label[i] == ids[i]) for i in range(len(ids)))


@pytest.mark.parametrize("block", [1024, 3])
def test_links_components_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(1, 120))] + [(200 + i, v, 1) for i, v in enumerate(BAD)]
    rows += [(300, [1.0, 2.0, 3.0], None), (301, [1.0, 2.0, 3.0, 4.0], 0), (302, [1.0, 2.0, 3.0, 4.0], 0), (303, [2.0, 4.0, 6.0, 8.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(frame(spark, rows), miss=1e-9).collect())
    assert got == brute(rows, 0.98)


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0)] * 3 + [(2, [1.0, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.0], 0)]
    got = sorted(map(tuple, E.near_duplicates(frame(spark, rows)).collect()))
    assert got == [(1, 3, 1, True)] * 3 + [(2, 3, 1, False), (3, 0, 3, True)]
    assert E.near_duplicates(frame(spark, rows).filter("1 = 0")).collect() == []


def test_hash_plan_misses_no_more_than_asked():
    for n in (2, 500, 10**6, 10**10):
        bits, tables = E.hash_plan(n, 0.98, 1e-5)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1e-5


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, np.round(r.standard_normal(4) * r.choice([0, 1], 4), 1).tolist(), 0) for i in range(90)] + [(500 + i, v, 0) for i, v in enumerate(BAD)]
    rows += [(7, [1.0, 1.0, 1.0, 1.0], 0), (600, [2.0, 1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 0)]
    q = T.quantized(frame(spark, rows), 256)
    got = T.top_k(q.filter("vec_id % 10 = 0"), q, 5, query_block=4, candidate_block=16).collect()
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    want = []
    for i, v in good:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert T.top_k(q.filter("1 = 0"), q, 5).collect() == [] and T.top_k(q, q.filter("1 = 0"), 5).collect() == []
    few = q.filter("vec_id IN (10, 20, 30)")
    assert len(T.top_k(few, few, 5).collect()) == 6


def test_top_k_ranks_repeated_queries_apart(spark):
    rows = [(50, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.0], 0), (3, [0.0, 1.0], 0)]
    q = T.quantized(frame(spark, rows), 256)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in T.top_k(q.filter("vec_id = 50"), q, 5).collect())
    assert got == sorted([(1, 1, 65536), (2, 2, 32768), (3, 3, 0), (1, 3, 65536), (2, 1, 0), (3, 2, 0)])
