"""A byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes. Learned byte embeddings feed learned filters over KERNEL bytes with
a rectifier, which are averaged over overlapping chunks of CHUNK bytes that cover the whole
document; a learned layer turns each chunk into DETECTORS responses, these are max-pooled over
all chunks, and a logistic output combines them into one probability. Every weight is learned:
training is plain back-propagation with Adam on a bounded sample of labelled rows.

Defined cases: a null or empty text is scored as one empty chunk; texts of any length are
scored whole; rows whose label is null are not learned from, nor ids with labels of both kinds;
of an id with several texts the least is learned from; rows without an id are scored, never
learned from and not held out; with no labels, or labels of one kind
only, scores follow their base rate; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BLOCK = 64
CHUNK = 2 * BLOCK
KERNEL, STRIDE = 6, 2
EMBED, FILTERS, DETECTORS = 8, 24, 48
#: Zero bytes after each text, so that no filter sees two texts.
GUARD = 32
#: Bytes that are scored at once.
AT_ONCE = 1 << 21


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each padded to whole blocks; the bytes that count; each text's blocks."""
    blocks = np.array([-(-(len(t) + GUARD) // BLOCK) for t in texts])
    flat = b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks.tolist()))
    x = np.frombuffer(flat, dtype=np.uint8)
    starts = np.cumsum(blocks * BLOCK) - blocks * BLOCK
    valid = np.zeros(len(x) + 1, dtype=np.int8)
    lengths = np.array([len(t) for t in texts])
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + lengths, -1)
    return x, np.cumsum(valid[:-1], dtype=np.int8), blocks


def pairs(sums: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of overlapping chunks of two blocks within each text, and the number of chunks of each text."""
    ends = np.cumsum(blocks)
    both = sums.copy()
    both[:-1] += sums[1:]
    last = np.zeros(len(sums), dtype=bool)
    last[ends - 1] = True
    alone = last.copy()
    alone[ends - 1] = blocks == 1
    both[last] = sums[last]
    keep = ~last | alone
    return both[keep], np.maximum(blocks - 1, 1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """The network and its parameters."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "embed": r.standard_normal((256, EMBED)).astype(np.float32),
            "conv": scale(KERNEL * EMBED, FILTERS),
            "conv_b": np.zeros(FILTERS, np.float32),
            "hidden": scale(FILTERS, DETECTORS),
            "hidden_b": np.zeros(DETECTORS, np.float32),
            "out": np.full(DETECTORS, -0.5, np.float32) * r.random(DETECTORS).astype(np.float32),
            "out_b": np.zeros(1, np.float32),
        }

    def windows(self, x: np.ndarray) -> np.ndarray:
        """The embedded bytes under every filter position."""
        e = self.p["embed"][np.append(x, np.zeros(KERNEL, np.uint8))]
        n = len(x) // STRIDE
        step = e.strides[0]
        view = np.lib.stride_tricks.as_strided(e, (n, KERNEL * EMBED), (STRIDE * step, e.strides[1]))
        return np.ascontiguousarray(view)

    def conv_sums(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        out = np.empty((len(x) // BLOCK, FILTERS), np.float32)
        for lo in range(0, len(x), 1 << 18):
            hi = min(len(x), lo + (1 << 18))
            own = np.append(x[lo:hi], x[hi : hi + KERNEL])
            own = np.append(own, np.zeros((hi - lo) + KERNEL - len(own), np.uint8))
            a = self.windows(own)[: (hi - lo) // STRIDE] @ self.p["conv"] + self.p["conv_b"]
            np.maximum(a, 0, out=a)
            a *= valid[lo:hi:STRIDE, None]
            out[lo // BLOCK : hi // BLOCK] = a.reshape(-1, BLOCK // STRIDE, FILTERS).sum(axis=1)
        return out

    def features(self, x: np.ndarray, valid: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean responses of the filters in each chunk, the chunks of each text, and the bytes of each chunk."""
        counts = valid.reshape(-1, BLOCK).sum(axis=1, dtype=np.float32)[:, None]
        n, chunks = pairs(counts, blocks)
        conv, _ = pairs(self.conv_sums(x, valid), blocks)
        n = np.maximum(n, 1)
        return conv * (STRIDE / n), chunks, n

    def pooled(self, feats: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled responses of each text, and the chunk that each comes from."""
        h = np.maximum(feats @ self.p["hidden"] + self.p["hidden_b"], 0)
        starts = np.cumsum(chunks) - chunks
        top = np.maximum.reduceat(h, starts, axis=0)
        rows = np.repeat(np.arange(len(chunks)), chunks)
        at = np.where(h >= top[rows], np.arange(len(h))[:, None], len(h))
        return top, np.minimum.reduceat(at, starts, axis=0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= AT_ONCE):
                size += len(texts[hi]) + GUARD
                hi += 1
            x, valid, blocks = laid_out(texts[lo:hi])
            feats, chunks, _ = self.features(x, valid, blocks)
            top, _ = self.pooled(feats, chunks)
            out.append(logistic(top.astype(float) @ self.p["out"] + self.p["out_b"]))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0)


class Trainer:
    """Adam over the parameters of a model."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def apply(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            step = self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            self.model.p[k] = (self.model.p[k] - step).astype(np.float32)

    def step(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> None:
        m, p = self.model, self.model.p
        x, valid, blocks = laid_out(texts)
        feats, chunks, n = m.features(x, valid, blocks)
        top, at = m.pooled(feats, chunks)
        prob = logistic(top @ p["out"] + p["out_b"])
        d = ((prob - y) * weight / weight.sum()).astype(np.float32)
        grads = {"out": top.T @ d + 1e-4 * p["out"], "out_b": np.array([d.sum()], np.float32)}
        d_top = d[:, None] * p["out"][None, :] * (top > 0)
        rows, back = np.unique(at, return_inverse=True)
        d_h = np.zeros((len(rows), DETECTORS), np.float32)
        np.add.at(d_h, (back.reshape(at.shape), np.arange(DETECTORS)[None, :]), d_top)
        grads["hidden"], grads["hidden_b"] = feats[rows].T @ d_h, d_h.sum(axis=0)
        d_conv = (d_h @ p["hidden"].T) * (STRIDE / n[rows])
        # Only the chunks that won a pool have a gradient: their bytes go through the filters once more.
        text_of = np.searchsorted(np.cumsum(chunks), rows, side="right")
        first = (np.cumsum(blocks) - blocks)[text_of] + rows - (np.cumsum(chunks) - chunks)[text_of]
        x, valid = np.append(x, np.zeros(CHUNK + KERNEL, np.uint8)), np.append(valid, np.zeros(CHUNK, np.int8))
        spots = first[:, None] * BLOCK + np.arange(0, CHUNK, STRIDE)[None, :]
        bytes_at = x[spots[:, :, None] + np.arange(KERNEL)]
        seen = p["embed"][bytes_at].reshape(len(rows), -1, KERNEL * EMBED)
        a = seen @ p["conv"] + p["conv_b"]
        one = (blocks[text_of] == 1)[:, None] & (np.arange(0, CHUNK, STRIDE) >= BLOCK)[None, :]
        d_a = (a > 0) * (valid[spots] * ~one)[:, :, None] * d_conv[:, None, :]
        d_a = d_a.astype(np.float32).reshape(-1, FILTERS)
        grads["conv"], grads["conv_b"] = seen.reshape(-1, KERNEL * EMBED).T @ d_a, d_a.sum(axis=0)
        d_e = (d_a @ p["conv"].T).reshape(-1, EMBED)
        flat = bytes_at.reshape(-1)
        grads["embed"] = np.stack([np.bincount(flat, weights=d_e[:, k], minlength=256) for k in range(EMBED)], axis=1).astype(np.float32)
        self.apply(grads)


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray, steps: int = 360, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Model:
    """A model fitted to labels y (0 or 1) with the given row weights."""
    model = Model()
    base = float(np.clip((y * weight).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model.p["out_b"][:] = np.log(base / (1 - base))
    if len(np.unique(y)) < 2:
        model.p["out"][:] = 0
        return model
    r, trainer, order = np.random.default_rng(seed), Trainer(model, rate), np.zeros(0, int)
    for k in range(steps):
        if len(order) < batch:
            order = np.append(order, r.permutation(len(y)))
        own, order = order[:batch], order[batch:]
        trainer.rate = rate * (1 - k / steps) + rate / 50
        trainer.step([texts[i] for i in own], y[own].astype(np.float32), weight[own].astype(np.float32))
    return model


def held_out(col):
    """If a row is held out; without an id it is not, and no label names it either."""
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 700, most_bytes: int = 50_000) -> Model:
    """A model fitted to at most most_rows labelled texts of either kind, of at most most_bytes each.

    Rows are drawn by a hash of their id, so the sample spreads over the table and reruns
    agree. Held-out rows are never drawn. Row weights undo the unequal sampling of the kinds,
    so that scores are probabilities on the table's own mixture.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    usable = usable.filter(F.col("quality") == F.col("most")).select("doc_id", "quality")
    counts = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    chosen = None
    for kind in (0, 1):
        own = usable.filter(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
        chosen = own if chosen is None else chosen.union(own)
    slim = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes)
    rows = slim.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], dtype=int)
    kinds = np.bincount(y, minlength=2)
    weight = np.array([counts.get(k, 0) / max(kinds[k], 1) for k in y.tolist()])
    # Half of the way in logarithms for the sake of the rare kind, taken back in the scores by a shift.
    model = train([r["text"].encode() for r in rows], y, np.sqrt(weight)) if len(rows) else train([], y, weight)
    if len(rows) and len(np.unique(y)) == 2:
        w = [np.sqrt(counts[k] / kinds[k]) for k in (0, 1)]
        model.p["out_b"][:] += np.float32(np.log(w[1] / w[0]))
    return model


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The kept columns of every row, and its probability of good quality."""
    slim = df.select(*keep, F.col(text_col).alias("__text"))
    names = [c for c in slim.columns if c != "__text"]
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                texts = [(t or "").encode() for t in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(model.scores(texts))], names=[*names, out_col])

    return slim.mapInArrow(run, f"{fields}, `{out_col}` double")


def op10_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
