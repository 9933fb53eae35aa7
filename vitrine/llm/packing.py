"""Best-fit-decreasing packing of token sequences.

All pieces of one length are alike to best fit, and so are bins with the same room. So the
histogram of lengths (at most one row a length) is packed as a whole, exactly as best-fit
decreasing would pack every document: lengths go from long to short, a segment tree over
remaining capacities finds the tightest open bins in logarithmic time, and runs of equal
pieces go into runs of equal bins. The outcome is a short list of runs: ranks lo.. of a length
go to bins first_bin.. at one offset. Ranks within a length are computed by Spark (counts by
length and span, prefix sums, row numbers within a span), then each piece looks up its run.

Defined cases: a null or empty text is its closing id alone; a longer document is cut into
full pieces and a rest; repeated rows are packed each; null ids are kept; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import encoded


class OpenBins:
    """Open bins by remaining capacity, as intervals of bin numbers, under a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, filled: bool) -> None:
        i = room + self.leaves
        self.tree[i] = filled
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.bins[room].append((first, count))
            self._mark(room, True)

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least need that has an open bin."""
        i = need + self.leaves
        if not self.tree[i]:
            while i > 1 and (i % 2 or not self.tree[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves

    def pop(self, room: int) -> tuple[int, int]:
        got = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, False)
        return got


def best_fit_runs(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first bin, offset) of best-fit decreasing, and the number of bins."""
    runs, bins, opened = [], OpenBins(capacity), 0

    def place(length: int, rank: int, count: int, first: int, n: int, room: int) -> int:
        """Fills n equal bins one after the other with up to count pieces; returns how many went in."""
        each = room // length
        full, rest = divmod(min(count, n * each), each)
        for k in range(each):
            if full:
                runs.append((length, rank + k * full, full, first, capacity - room + k * length))
        bins.add(room - each * length, first, full)
        rank += each * full
        for k in range(rest):
            runs.append((length, rank + k, 1, first + full, capacity - room + k * length))
        used = full + bool(rest)
        if rest:
            bins.add(room - rest * length, first + full, 1)
        bins.add(room, first + used, n - used)
        return each * full + rest

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                got, opened = place(length, rank, left, opened, n, capacity), opened + n
            else:
                got = place(length, rank, left, *bins.pop(room), room)
            rank, left = rank + got, left - got
    return runs, opened


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian unsigned 32-bit bytes) of every piece."""
    end = np.array([end_id], dtype="<u4").tobytes()
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for b in batches:
            row, piece, length, crc, raw = [], [], [], [], []
            for i, ids in enumerate(encoded(b.column(1).to_pylist(), tokenizer)):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([k * capacity for k in piece], pa.int64())]
            columns += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(raw, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def place_pieces(cut: DataFrame, capacity: int, span_rows: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to a table with `length` (1 to capacity)."""
    rows = materialize(cut.withColumn("tie", F.rand(23)), "pieces")
    spans = max(1, -(-rows.count() // span_rows))
    rows = rows.withColumn("span", F.floor(F.col("tie") * spans).cast("int"))
    counts = materialize(rows.groupBy("length", "span").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_runs(histogram, capacity)
    runs.sort()
    plan = np.array(runs, dtype=np.int64).reshape(-1, 5)
    starts = plan[:, 0] * (1 << 44) + plan[:, 1]
    before = Window.partitionBy("length").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "span").orderBy("tie")
    ranked = rows.join(offsets, ["length", "span"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    ranked = ranked.drop("tie", "span", "before")
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names)

    def look_up(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1
            into = plan[at, 3] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(into), pa.array(plan[at, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack(
    df: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its place in the sequences; with_ids keeps the ids for training."""
    return place_pieces(pieces(df, tokenizer, capacity, end_id, id_col, text_col, with_ids), capacity)


def op4_best_fit_decreasing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
