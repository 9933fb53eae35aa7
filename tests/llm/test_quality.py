import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import quality as Q


def text(r, good):
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(r.randint(20, 300))]
    if good:
        return " ".join(words) + "."
    kind = r.randrange(3)
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " | ".join(words) if kind == 1 else " ".join(w for w in words[:9] for _ in range(20))


def test_held_out_accuracy():
    r = random.Random(5)
    y = np.array([r.random() < 0.8 for _ in range(500)], dtype=int)
    texts = [text(r, bool(k)).encode() for k in y]
    m = Q.train(texts[:350], y[:350], np.ones(350), steps=200)
    assert ((m.scores(texts[350:]) >= 0.3) == y[350:]).mean() > 0.95


def test_gradient_is_that_of_the_loss():
    r = random.Random(6)
    texts = [text(r, k % 2 == 0).encode() for k in range(6)]
    y, w = np.array([1, 0, 1, 0, 1, 0], np.float32), np.ones(6, np.float32)
    m = Q.Model()
    seen = {}
    t = Q.Trainer(m, 0.0)
    t.apply = seen.update
    t.step(texts, y, w)

    def loss():
        p = np.clip(m.scores(texts), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 0.5e-4 * (m.p["out"] ** 2).sum()

    for name in ("out", "out_b", "hidden", "hidden_b", "conv", "conv_b", "embed"):
        at = np.unravel_index(np.abs(seen[name]).argmax(), seen[name].shape)
        old, step = m.p[name][at], 2e-3
        m.p[name][at] = old + step
        up = loss()
        m.p[name][at] = old - step
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / (2 * step) - seen[name][at]) < 0.1 * abs(seen[name][at]) + 1e-4, name


def test_scores_do_not_depend_on_neighbours():
    r = random.Random(7)
    texts = [b"", b"a", *[text(r, k % 2 == 0).encode() * (k + 1) for k in range(5)]]
    m = Q.Model()
    assert np.allclose(m.scores(texts), [m.scores([t])[0] for t in texts], atol=1e-5)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.score(odd_docs, Q.fit(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert Q.score(no_docs, Q.fit(no_docs, labels.filter("1 = 0"))).collect() == []


def test_held_out_rows_are_never_learned_from(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(Q, "train", lambda texts, y, w: seen.extend(texts) or Q.Model())
    Q.fit(docs, labels)
    out = {f"text {r['doc_id']}".encode() for r in docs.filter(Q.held_out(F.col("doc_id"))).collect()}
    assert seen and not out & set(seen)


def naive_score(m, text):
    """The network's score of one text, filter position by filter position."""
    p = {k: v.astype(float) for k, v in m.p.items()}
    n = -(-(len(text) + Q.GUARD) // Q.BLOCK)
    x = text + bytes(n * Q.BLOCK + Q.KERNEL - len(text))
    best = np.zeros(Q.DETECTORS)
    for first in range(max(1, n - 1)):
        lo, hi = first * Q.BLOCK, min(first + 2, n) * Q.BLOCK
        total = np.zeros(Q.FILTERS)
        for at in range(lo, hi, Q.STRIDE):
            if at < len(text):
                seen = np.concatenate([p["embed"][c] for c in x[at : at + Q.KERNEL]])
                total += np.maximum(seen @ p["conv"] + p["conv_b"], 0)
        mean = total * Q.STRIDE / max(1, min(hi, len(text)) - lo)
        best = np.maximum(best, mean @ p["hidden"] + p["hidden_b"])
    return 1 / (1 + np.exp(-(best @ p["out"] + p["out_b"][0])))


def test_scores_are_those_of_a_naive_forward_pass():
    r = random.Random(9)
    texts = [b"", b"a", b"x" * 127, b"x" * 96, *[text(r, k % 2 == 0).encode() for k in range(4)]]
    m = Q.train(texts, np.array([0, 1] * 4), np.ones(8), steps=20)
    assert np.allclose(m.scores(texts), [naive_score(m, t) for t in texts], atol=1e-4)


def test_repeated_ids_have_a_defined_text(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{c}{k}") for k in range(60) for c in "zbca"], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2 + [(3, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda texts, y, w: seen.append((texts, y.tolist())) or Q.Model())
    for _ in range(2):
        Q.fit(docs, labels)
    assert seen[0] == seen[1] and all(t.startswith(b"a") for t in seen[0][0]) and b"a3" not in seen[0][0] and len(seen[0][0]) > 30


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_ranks_held_out_rows_of_the_local_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter(Q.held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    rows = Q.score(docs.join(known, "doc_id"), Q.fit(docs, labels), keep=("quality",)).collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    auc = np.mean([(np.array(good) > b).mean() for b in bad])
    assert len(bad) > 100 and auc > 0.98


def test_rows_without_an_id_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (0,), (1,), (5,)], "doc_id long").select("doc_id", Q.held_out(F.col("doc_id")).alias("h")).collect()
    import zlib

    assert [r["h"] for r in rows] == [False] + [zlib.crc32(str(i).encode()) % 5 == 0 for i in (0, 1, 5)]
