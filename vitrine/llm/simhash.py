"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64-bit majority vote over the XXH64 hashes (seed 42) of all word shingles of a
whole text, repeats included.

Search: the 64 bits are grouped into eight blocks of correlated bits, learned from a bounded
sample, and the blocks are joined to m partitions. If thresholds T_1..T_m (each at least -1,
which means no probe) sum to radius - m + 1, then two fingerprints within the radius differ by
at most T_i in some partition i. Each fingerprint gets thresholds of its own: dynamic
programming takes those with the least expected cost, which is the probes to send plus the
candidates to check, estimated from exact counts of every block's values over all
fingerprints. m itself is taken by the same estimate, so few wide partitions replace many
narrow ones as the table grows and candidates stay in proportion to the rows.

Probes and partition values meet by an equi-join that checks the distance. A partition value
held by more than HOT fingerprints goes another way, in blocks of bounded size: inside a
block, a breadth-first walk over exact distances returns a spanning forest of its links, not
its pairs. Both ways together lose no link, so the components are exact.

Near copies that differ in more bits are searched for by a second fingerprint, over the set of
words of a text: a changed word touches several shingles but is one word of the set, so texts
that share 0.8 of their shingles lie within a few bits there, and others hardly ever do. A
similarity needs more than links, though: a forest's links may fail it where other pairs meet
it, and a large group of near copies has far too many pairs to compare. So the wider search
goes in steps. First every probe names its few nearest neighbours of other components; those
pairs are compared exactly, and what is similar is joined. A text with no more neighbours than
that in any partition is done. The others, which are the members of dense groups, are searched
again, among themselves, with bitmaps of their shingle sets, which bound the similarity from
above: once for the few best neighbours, and then for all pairs of components that are still
apart and that the bound doesn't rule out. So all pairs are either compared, ruled out or
already joined, and in a dense group nearly all are the last.

The wider radius takes hundreds of probes a text, and more as the table grows, so they don't move
one by one. Each partition's values are cut into cells by a few of their bits. A fingerprint goes
once to each cell that its probes reach, with the number of bits it may still differ in, and its
probes are made there. Texts move only where they must: a bitmap of key hashes, bounded and
broadcast, tells most of the rows that a join wouldn't keep, and those that need none.

Defined cases: a null or empty text has no shingles and the fingerprint zero, which links
like any other; fewer words than a shingle form one shorter shingle; repeated rows and copies
share a fingerprint; null ids never become a component's id unless no other is there; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, uniform
from .components import components

#: Fingerprints, about, that are sampled to learn which bits are correlated.
SAMPLE = 8192
#: Index entries of one partition value above which its candidates are walked, not joined.
HOT = 64
#: Most index entries and probes that meet in one block of a hot value.
BLOCK = 2048
#: Neighbours that a probe names at once in the wider search.
NAMED = 3
#: Entries of a task, and candidates that are looked at at once, in the wider search.
TASK_ENTRIES, AT_ONCE = 300_000, 1 << 21
BLOCKS = 8
#: Bits of the bitmap of a set of shingles.
BITMAP = 512
#: Cells of a partition in the wider search: at least as many bits, and about so many fingerprints a cell (as a power of two).
LEAST_CELL_BITS, CELL_ROWS = 4, 16
#: Index entries and probing fingerprints that meet in one block of a cell, times BLOCK.
CELL_X, CELL_Q = 32, 128
#: Bits of the hash places of a bitmap of keys.
PLACES = 24
#: Most bits in which a probe differs from a partition's value; with four partitions or fewer this allows any radius up to 8.
MOST_FLIPS = 3
#: Blocks in each partition, for each number of partitions.
LAYOUTS = {2: (4, 4), 3: (3, 3, 2), 4: (2, 2, 2, 2)}
#: What one probe costs against checking one candidate.
PROBE_COST = 1.0


def fingerprint(text: str | None, shingle: int = 3, distinct: bool = False) -> int:
    """The SimHash of a whole text, over all its word shingles or over the distinct ones."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(w) for w in zip(*(words[i:] for i in range(shingle)))] if len(words) >= shingle else [b" ".join(words)]
    parts = list(set(parts)) if distinct else parts
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def row_key(df: DataFrame) -> list[Column]:
    """k1, k2: two hashes of a row's values, nulls told apart; only rows that repeat in full share them."""
    values = [x for f in df.schema.fields if "map<" not in f.dataType.simpleString() for x in (F.col(f.name).isNull(), F.col(f.name))]
    return [F.xxhash64(F.lit(k), *values).alias(f"k{k}") for k in (1, 2)]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[Column, ...] = (), words: bool = False) -> DataFrame:
    """id, the fingerprint as a signed long and the columns to keep of every row; with words also wfp, the fingerprint of the set of words."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = [pa.array(np.array([fingerprint(t, *how) for t in texts], dtype="<u8").view("<i8")) for how in [(shingle,)] + [(1, True)] * words]
            yield pa.RecordBatch.from_arrays([b.column(0), *fps, *b.columns[2:]], names=["doc_id", "fp"] + ["wfp"] * words + b.schema.names[2:])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = ", wfp long" * words + "".join(f", {f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[2:])
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long{kept}")


def correlated_order(sample: np.ndarray) -> list[int]:
    """The 64 bits, blocks of correlated bits together: each block grows by the bit that is most correlated with it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(corr, 0)
    left, order = set(range(64)), []
    for _ in range(BLOCKS):
        rest = sorted(left)
        block = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(axis=1)))]]
        left.remove(block[0])
        while len(block) < 64 // BLOCKS:
            rest = sorted(left)
            best = rest[int(np.argmax(corr[np.ix_(rest, block)].sum(axis=1)))]
            block.append(best)
            left.remove(best)
        order += block
    return order


def permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Bit i of the result is bit order[i] of fp."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for i, bit in enumerate(order):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
    return out


def distance_shares(counts: np.ndarray) -> np.ndarray:
    """[block, value, d]: the share of all fingerprints whose block differs from the value in d bits."""
    values = np.arange(256)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    total = max(counts[0].sum(), 1)
    return np.stack([np.stack([(np.where(apart == d, counts[b][None, :], 0)).sum(axis=1) / total for d in range(9)], axis=1) for b in range(BLOCKS)])


def allocate(fp: np.ndarray, layout: tuple[int, ...], shares: np.ndarray, n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least expected cost for each (permuted) fingerprint, and that cost."""
    m, goal = len(layout), radius - len(layout) + 1
    options = list(range(-1, min(radius, MOST_FLIPS) + 1))
    sums = list(range(-m, m * MOST_FLIPS + 1))
    best = np.full((len(fp), len(sums)), np.inf)
    best[:, sums.index(0)] = 0
    taken, block = [], 0
    for width in layout:
        near = np.ones((len(fp), 1))
        for b in range(block, block + width):
            own = shares[b][((fp >> np.uint64(8 * b)) & np.uint64(255)).astype(int)][:, : radius + 1]
            new = np.zeros((len(fp), radius + 1))
            for d in range(near.shape[1]):
                for e in range(radius + 1 - d):
                    new[:, d + e] += near[:, d] * own[:, e]
            near = new
        block += width
        candidates = n * np.cumsum(near, axis=1)
        probes = np.cumsum([math.comb(8 * width, e) for e in range(radius + 1)])
        cost = np.concatenate([np.zeros((len(fp), 1)), candidates + PROBE_COST * probes], axis=1)
        new = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, dtype=np.int8)
        for k, t in enumerate(options):
            for s in range(len(sums)):
                if 0 <= s - t < len(sums):
                    c = best[:, s - t] + cost[:, k]
                    less = c < new[:, s]
                    new[less, s], pick[less, s] = c[less], t
        best = new
        taken.append(pick)
    at = np.full(len(fp), sums.index(goal))
    cost = best[np.arange(len(fp)), at]
    thresholds = np.zeros((len(fp), m), dtype=np.int8)
    for i in range(m - 1, -1, -1):
        thresholds[:, i] = taken[i][np.arange(len(fp)), at]
        at = at - thresholds[:, i]
    return thresholds, cost


@dataclass
class Plan:
    """How fingerprints are partitioned and probed: the order of bits, blocks of each partition, shares of all fingerprints by block, value and distance, their number, the radius, and the bits of a value that name its cell (all if none)."""

    order: list[int]
    layout: tuple[int, ...]
    shares: np.ndarray
    n: int
    radius: int
    cell_bits: int | None = None

    def bits(self, i: int) -> tuple[list[int], list[int]]:
        """The bits of partition i's values that name a cell, taken from its blocks by turns, and the others."""
        every = [8 * b + k for k in range(8) for b in range(self.layout[i])]
        return every[: self.cell_bits], [] if self.cell_bits is None else every[self.cell_bits :]


def masks(bits: list[int], e: int) -> np.ndarray:
    """All ways to flip e of the bits."""
    return np.array([sum(1 << k for k in c) for c in itertools.combinations(bits, e)], dtype=np.int64)


def postings(fps: DataFrame, plan: Plan) -> DataFrame:
    """key, fp, probe, left: one index entry a partition, and the cells that probes within the thresholds reach, with the bits left to flip there. The key is partition and cell. Other columns of fps go along."""
    more = [c for c in fps.columns if c != "fp"]
    names = ["key", "fp", "probe", "left", *more]

    def run(batches):
        for b in batches:
            raw = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            fp = permuted(raw.view("<u8"), plan.order)
            t, _ = allocate(fp, plan.layout, plan.shares, plan.n, plan.radius)
            start = 0
            for i, width in enumerate(plan.layout):
                named, _ = plan.bits(i)
                cell = ((fp >> np.uint64(8 * start)) & np.uint64(sum(1 << k for k in named))).astype(np.int64) | (np.int64(i) << np.int64(40))
                start += width
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(raw), pa.array(np.zeros(len(raw), bool)), pa.array(np.zeros(len(raw), np.int8)), *b.columns[1:]], names=names)
                for e in range(min(int(t[:, i].max(initial=-1)), len(named)) + 1):
                    who, flips = np.flatnonzero(t[:, i] >= e), masks(named, e)
                    for part in np.array_split(who, max(1, len(who) * len(flips) // 200_000)) if len(who) else []:
                        keys = (cell[part][:, None] ^ flips[None, :]).ravel()
                        own = np.repeat(part, len(flips))
                        left, rows = pa.array(t[own, i] - np.int8(e)), pa.array(own)
                        yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(rows), pa.array(np.ones(len(keys), bool)), left, *(c.take(rows) for c in b.columns[1:])], names=names)

    kinds = "".join(f", {c} {fps.schema[c].dataType.simpleString()}" for c in more)
    return fps.select("fp", *more).mapInArrow(run, f"key long, fp long, probe boolean, left tinyint{kinds}")


def spanning_links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of all pairs within the radius."""
    left = np.unique(fp)
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for lo in range(0, len(front), 256):
                near = np.bitwise_count(front[lo : lo + 256, None] ^ left[None, :]) <= radius
                hit = near.any(axis=0) & (parent < 0)
                parent[hit] = lo + near[:, hit].argmax(axis=0)
            found = parent >= 0
            links += zip(front[parent[found]].tolist(), left[found].tolist())
            front, left = left[found], left[~found]
    return links


def in_blocks(entries: DataFrame, sizes: DataFrame, times: tuple[int, int] = (1, 1)) -> DataFrame:
    """Adds x and q, by which index entries and probes of the keys of sizes (key, xs, qs) meet in blocks of bounded size, BLOCK times `times`; other keys are left out."""
    both = entries.join(sizes, "key")
    n_x, n_q = (F.greatest(F.ceil(F.col(c) / F.lit(BLOCK * k)).cast("int"), F.lit(1)) for c, k in zip(("xs", "qs"), times))
    mix = F.xxhash64("fp")
    x = F.when(F.col("probe"), F.sequence(F.lit(0), n_x - 1)).otherwise(F.array(F.pmod(mix, n_x).cast("int")))
    q = F.when(~F.col("probe"), F.sequence(F.lit(0), n_q - 1)).otherwise(F.array(F.pmod(mix, n_q).cast("int")))
    return both.withColumn("x", F.explode(x)).withColumn("q", F.explode(q)).select("x", "q", *entries.columns)


def links_in_blocks(entries: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """Spanning links of the hot partition values."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        links = spanning_links(group["fp"].to_numpy().astype("<i8").view("<u8"), radius)
        ends = np.array(links, dtype="<u8").reshape(-1, 2).view("<i8")
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return in_blocks(entries, sizes).groupBy("key", "x", "q").applyInPandas(walk, "a long, b long")


def planned(fps: DataFrame, radius: int) -> Plan:
    """The plan with the least expected cost for a table of fp."""
    n = fps.count()
    sample = [r[0] for r in fps.filter(uniform(F.col("fp"), seed=31) < SAMPLE / max(n, 1)).select("fp").limit(2 * SAMPLE).collect()]
    order = correlated_order(np.array(sample or [0], dtype="<i8").view("<u8"))

    def tally(batches):
        counts = np.zeros((BLOCKS, 256), dtype=np.int64)
        for b in batches:
            fp = permuted(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8"), order)
            for k in range(BLOCKS):
                counts[k] += np.bincount(((fp >> np.uint64(8 * k)) & np.uint64(255)).astype(int), minlength=256)
        k, v = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k * 256 + v), pa.array(counts[k, v])], names=["cell", "n"])

    counts = np.zeros(BLOCKS * 256)
    for cell, c in fps.select("fp").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = c
    shares = distance_shares(counts.reshape(BLOCKS, 256))
    some = permuted(np.array(sample or [0], dtype="<i8").view("<u8"), order)
    layout = min(LAYOUTS.values(), key=lambda x: allocate(some, x, shares, n, radius)[1].mean())
    return Plan(order, layout, shares, n, radius, max(LEAST_CELL_BITS, (n >> CELL_ROWS).bit_length()))


def value_sizes(entries: DataFrame) -> DataFrame:
    """key, xs, qs: the index entries and the probes of each partition value."""
    return entries.groupBy("key").agg(F.count(F.when(~F.col("probe"), 1)).alias("xs"), F.count(F.when(F.col("probe"), 1)).alias("qs"))


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links a, b between distinct fingerprints that join all that lie within the radius into the same components."""
    entries = materialize(postings(fps.select("fp"), replace(planned(fps, radius), cell_bits=None)).drop("left"), "postings")
    hot = materialize(value_sizes(entries).filter(F.col("xs") > HOT), "hot")
    index = entries.filter(~F.col("probe")).select("key", F.col("fp").alias("b"))
    probes = entries.filter("probe").select("key", F.col("fp").alias("a"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (F.col("a") < F.col("b"))
    cold = probes.join(index.join(hot.select("key"), "key", "left_anti"), "key").filter(near).select("a", "b")
    return cold.union(links_in_blocks(entries, hot, radius))


def meetings(held: np.ndarray, sought: np.ndarray):
    """Positions in sought and in held of all pairs of equal members, all of one of sought at once; held is sorted."""
    low = np.searchsorted(held, sought, side="left")
    found = np.flatnonzero(held[np.minimum(low, len(held) - 1)] == sought) if len(held) else np.zeros(0, np.int64)
    low = low[found]
    n = np.searchsorted(held, sought[found], side="right") - low
    part = np.cumsum(n) // AT_ONCE
    for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
        if len(cut):
            size = n[cut]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(found[cut], size), np.repeat(low[cut], size) + within


def met_before(a: np.ndarray, b: np.ndarray, part: np.ndarray, plan: Plan) -> np.ndarray:
    """Which pairs of a probing and an indexed fingerprint, given the partition in which they meet, also meet in an earlier one."""
    own, back = np.unique(a, return_inverse=True)
    own = permuted(own, plan.order)
    t, _ = allocate(own, plan.layout, plan.shares, plan.n, plan.radius)
    apart = own[back] ^ permuted(b, plan.order)
    before, start = np.zeros(len(a), dtype=bool), 0
    for i, width in enumerate(plan.layout):
        d = np.bitwise_count((apart >> np.uint64(8 * start)) & np.uint64((1 << 8 * width) - 1))
        before |= (i < part) & (d <= t[back, i])
        start += width
    return before


def neighbours(entries: DataFrame, plan: Plan, named: int | None, similarity: float = 0.0) -> DataFrame:
    """ra, a, ta, rb, b, tb, k: for each probe its nearest index entries within the radius and with another root, `named` of them or all; k is how many there are.

    A pair counts in the first partition in which the probe meets it.

    entries has key, fp, probe, root and, with a similarity, t, n, bits of a text: pairs of texts
    that cannot be so similar are left out, and the nearest are those that may be most similar.
    """
    # Cells are few (their number follows the rows only as rows >> CELL_ROWS); those with one root give no pair.
    sizes = entries.groupBy("key").agg(F.count(F.when(~F.col("probe"), 1)).alias("xs"), F.count(F.when(F.col("probe"), 1)).alias("qs"), F.min("root").alias("least"), F.max("root").alias("most"))
    sizes = materialize(sizes.filter((F.col("xs") > 0) & (F.col("qs") > 0) & (F.col("least") != F.col("most"))).select("key", "xs", "qs"), "sizes")
    names = [c for c in entries.columns if c not in ("key", "probe", "left")]
    dealt = in_blocks(entries, F.broadcast(sizes), (CELL_X, CELL_Q)).select("key", "x", "q", "probe", "left", *names)
    parts = max(1, -(-entries.count() // TASK_ENTRIES))
    dealt = dealt.repartition(parts, "key", "x", "q").sortWithinPartitions("key", "x", "q")
    with_texts = "bits" in names

    def run(batches):
        held = list(batches)
        if not held:
            return
        col = lambda name: np.concatenate([b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for b in held])
        key, x, q, probe, left, fp, root = (col(c) for c in ("key", "x", "q", "probe", "left", "fp", "root"))
        group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (q[1:] != q[:-1])))
        raw = fp.astype("<i8").view("<u8")
        own = permuted(raw, plan.order)
        # What the cell leaves of a value, within its group.
        code = np.zeros(len(key), dtype=np.int64)
        for i, width in enumerate(plan.layout):
            rest = np.uint64(sum(1 << k for k in plan.bits(i)[1]))
            code = np.where(key >> 40 == i, ((own >> np.uint64(8 * sum(plan.layout[:i]))) & rest).astype(np.int64), code)
        code |= group << 32
        index = np.flatnonzero(~probe.astype(bool))
        index = index[np.argsort(code[index], kind="stable")]
        held_codes = code[index]

        def probed():
            """Positions of probing rows and index entries of all pairs of a value, and a number for each probe; all of one probe at once."""
            for i in range(len(plan.layout)):
                others = plan.bits(i)[1]
                for e in range(min(MOST_FLIPS, len(others)) + 1):
                    who, flips = np.flatnonzero(probe.astype(bool) & (key >> 40 == i) & (left >= e)), masks(others, e)
                    for rows in np.array_split(who, -(-len(who) * len(flips) // AT_ONCE)) if len(who) else []:
                        for p, at in meetings(held_codes, (code[rows][:, None] ^ flips[None, :]).ravel()):
                            yield p, rows[p // len(flips)], index[at]

        if with_texts:
            t, n = col("t"), col("n").astype(np.int64)
            bits = np.concatenate([b.column(b.schema.get_field_index("bits")).flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(len(key), -1)
        for p, i, j in probed():
            d = np.bitwise_count(raw[i] ^ raw[j]).astype(np.int64)
            near = np.flatnonzero((d <= plan.radius) & (root[i] != root[j]))
            p, i, j, d = p[near], i[near], j[near], d[near]
            fresh = np.flatnonzero(~met_before(raw[i], raw[j], key[i] >> 40, plan)) if len(i) else np.zeros(0, np.int64)
            p, i, j, d = p[fresh], i[fresh], j[fresh], d[fresh]
            if with_texts:
                most = np.floor((n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6).astype(np.int64)
                apart = np.concatenate([np.bitwise_count(bits[i[lo : lo + 65536]] ^ bits[j[lo : lo + 65536]]).sum(axis=1, dtype=np.int64) for lo in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
                may = np.flatnonzero(apart <= most)
                p, i, j, d = p[may], i[may], j[may], (apart - most)[may]
            if not len(i):
                continue
            by = np.lexsort((raw[j], d, p))
            p, i, j = p[by], i[by], j[by]
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            sizes = np.diff(np.append(first, len(i)))
            k = np.repeat(sizes, sizes)
            if named is not None:
                keep = np.flatnonzero(np.arange(len(i)) - np.repeat(first, sizes) < named)
                i, j, k = i[keep], j[keep], k[keep]
            ends = [root[i], fp[i], t[i] if with_texts else np.zeros(len(i), np.int64), root[j], fp[j], t[j] if with_texts else np.zeros(len(i), np.int64), k]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in ends], names=["ra", "a", "ta", "rb", "b", "tb", "k"])

    return dealt.mapInArrow(run, "ra long, a long, ta long, rb long, b long, tb long, k long")


def may_be_among(df: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """df's rows with __among: false only where the key, a hash, is none of keys' (a table of that one column).

    A bitmap of 2**PLACES places, broadcast as at most 2**PLACES / 64 longs however many keys there are.
    """
    at, bit = "shiftright(pmod({0}, {1}L), 6)", "shiftleft(1L, cast(pmod({0}, 64L) as int))"
    hashed = keys.toDF("__hash")
    bitmap = hashed.groupBy(F.expr(at.format("__hash", 1 << PLACES)).alias("__at")).agg(F.bit_or(F.expr(bit.format("__hash"))).alias("__bits"))
    rows = df.withColumn("__hash", key).withColumn("__at", F.expr(at.format("__hash", 1 << PLACES)))
    met = rows.join(F.broadcast(materialize(bitmap, "bitmap")), "__at", "left")
    return met.withColumn("__among", F.coalesce(F.col("__bits").bitwiseAND(F.expr(bit.format("__hash"))) != 0, F.lit(False))).drop("__at", "__bits", "__hash")


def unordered(pairs: DataFrame, *cols: str) -> DataFrame:
    """Distinct pairs of structs of the columns that end in a and b, the lesser end first: columns ..a and ..b."""
    one, two = (F.struct(*(F.col(c + end if c else end).alias(c or "fp") for c in cols)) for end in "ab")
    both = pairs.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).distinct()
    return both.select(*(F.col(f"{side}.{c or 'fp'}").alias(c + end if c else end) for side, end in (("one", "a"), ("two", "b")) for c in cols))


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """fp, root, text_hash, the sorted distinct hashes of the word shingles, their number and a bitmap of a table of fp, root, text_hash, text.

    A bit of the bitmap is the parity of the hashes that fall on it, so two sets differ in at
    least as many members as their bitmaps in bits.
    """

    def run(batches):
        for b in batches:
            sets, maps = [], []
            for text in b.column(3).to_pylist():
                words = (text or "").encode().lower().split()
                n = max(1, len(words) - shingle + 1)
                own = np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)], dtype="<u8"))
                sets.append(own.view("<i8"))
                parity = np.bincount((own % BITMAP).astype(int), minlength=BITMAP) & 1
                maps.append(np.packbits(parity.astype(bool), bitorder="little").view("<i8"))
            columns = [pa.array(sets, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int32()), pa.array(maps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=["fp", "root", "text_hash", "set", "n", "bits"])

    return df.select("fp", "root", "text_hash", "text").mapInArrow(run, "fp long, root long, text_hash long, set array<long>, n int, bits array<long>")


def relabelled(df: DataFrame, links: DataFrame) -> DataFrame:
    """df with the roots that links between roots lead to."""
    found = materialize(components(links, "a", "b"), "relabelled")
    return df.withColumnRenamed("root", "old").join(found, F.col("old") == F.col("node"), "left").withColumn("root", F.coalesce("root", "old")).drop("old", "node")


def similar_links(df: DataFrame, docs: DataFrame, radius: int, shingle: int, similarity: float, text_col: str) -> DataFrame:
    """Links a, b between roots that join all roots of which two texts lie within a wider radius and share enough of their word shingles (exact Jaccard similarity).

    docs has fp (the fingerprint for this search), root, text_hash and the row key of every row
    of df; every distinct text of a fingerprint and root counts.
    """
    nodes = materialize(docs.select("fp", "root").distinct(), "nodes")
    plan = planned(nodes, radius)
    named = materialize(neighbours(materialize(postings(nodes, plan), "wide"), plan, NAMED), "named")
    pairs = materialize(unordered(named, "", "r"), "pairs")
    ends = pairs.select(F.col("a").alias("fp"), F.col("ra").alias("root")).union(pairs.select("b", "rb")).distinct()
    wanted = docs.join(ends, ["fp", "root"], "left_semi").groupBy("fp", "root", "text_hash").agg(F.min(F.struct("k1", "k2")).alias("k"))
    wanted = materialize(wanted.select("fp", "root", "text_hash", "k.k1", "k.k2"), "wanted")
    key = row_key(df)
    texts = may_be_among(df.select(F.col(text_col).alias("text"), *key), wanted.select("k1"), F.col("k1")).filter("__among").drop("__among")
    texts = texts.join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2", "fp", "root", "text_hash"])
    sets = materialize(shingle_sets(texts, shingle), "shingles")

    def side(end: str, *cols: str, of: DataFrame | None = None) -> DataFrame:
        """The sets as an end of pairs; of: those pairs, if they may be few."""
        own = sets if of is None else may_be_among(sets, of.select(F.xxhash64(end, f"r{end}", f"t{end}")), F.xxhash64("fp", "root", "text_hash")).filter("__among")
        return own.select(F.col("fp").alias(end), F.col("root").alias(f"r{end}"), F.col("text_hash").alias(f"t{end}"), *(F.col(c).alias(c + end) for c in cols))

    def alike(pairs: DataFrame, keys: list[str]) -> DataFrame:
        """Links between the roots of pairs of which some texts are similar enough: the bitmaps' bound comes first, the sets decide."""
        a, b = ([f"{k}{end}" for k in keys] for end in "ab")
        apart = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        most = (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-6
        close = pairs.join(side("a", "n", "bits"), a).join(side("b", "n", "bits"), b).filter(apart <= most).select("a", "ra", "ta", "b", "rb", "tb")
        close = materialize(close, "close")
        met = close.join(side("a", "set", of=close), ["a", "ra", "ta"]).join(side("b", "set", of=close), ["b", "rb", "tb"])
        shared = F.size(F.array_intersect("seta", "setb"))
        enough = met.filter(shared >= similarity * (F.size("seta") + F.size("setb") - shared))
        return materialize(enough.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "alike")

    links = alike(pairs, ["", "r"])
    crowded = materialize(named.filter(F.col("k") > NAMED).select(F.col("a").alias("fp"), F.col("ra").alias("root")).distinct(), "crowded")
    if crowded.isEmpty():
        return links
    dense = materialize(sets.join(crowded, ["fp", "root"], "left_semi").select("fp", "root", F.col("root").alias("was"), F.col("text_hash").alias("t"), "n", "bits"), "dense")
    for most in (NAMED, None):
        # Pairs are found by the roots of now, and compared and linked by those of before.
        now = materialize(relabelled(dense.drop("root").withColumnRenamed("was", "root").withColumn("was", F.col("root")), links), "now")
        was = now.select("fp", "t", "root", "was")
        entries = materialize(postings(now.select("fp", "root", "t", "n", "bits"), plan), "dense")
        found = unordered(neighbours(entries, plan, most, similarity), "", "r", "t")
        for end in "ab":
            own = was.select(F.col("fp").alias(end), F.col("t").alias(f"t{end}"), F.col("root").alias(f"r{end}"), F.col("was").alias(f"was{end}"))
            found = found.join(own, [end, f"t{end}", f"r{end}"]).drop(f"r{end}").withColumnRenamed(f"was{end}", f"r{end}")
        links = materialize(links.union(alike(found, ["", "r", "t"])), "links")
    return links


def classes(
    df: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, wide: int | None, wide_shingle: int, similarity: float, keep: tuple[Column, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp and the columns to keep of every row; fp, first (its smallest id) and root (its component) of every fingerprint."""
    if wide is not None:
        keep = (F.xxhash64(text_col).alias("text_hash"), *row_key(df))
    docs = materialize(fingerprints(df, id_col, text_col, shingle, keep, words=wide is not None), "fingerprints")
    firsts = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = materialize(components(fingerprint_links(firsts, radius), "a", "b"), "roots")
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    if wide is None:
        return docs, rooted
    rooted = materialize(rooted, "rooted")
    searched = docs.join(rooted, "fp").select(F.col("wfp").alias("fp"), "root", "text_hash", "k1", "k2")
    links = similar_links(df, searched, wide, wide_shingle, similarity, text_col).union(roots.select("node", "root"))
    roots = materialize(components(links, "a", "b"), "roots")
    return docs, rooted.drop("root").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, wide: int | None = None, wide_shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable by links) of every row.

    Fingerprints within the radius link. With `wide`, so do texts whose sets of words have
    fingerprints within that larger radius and which have the given similarity on shingles of
    wide_shingle words.
    """
    docs, rooted = classes(df, id_col, text_col, shingle, radius, wide, wide_shingle, similarity)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return docs.join(found, "fp").select("doc_id", "fp", "component_id")


def representatives(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, wide: int | None = None, wide_shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """One row of each component of near_duplicates: the one with the smallest id (null ids last), then the smallest row key.

    A row is known by the hashes of its values, not by its id, which may be null or repeated.
    """
    key = row_key(df)
    docs, rooted = classes(df, id_col, text_col, shingle, radius, wide, wide_shingle, similarity, tuple(key))
    best = docs.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best"))
    kept = materialize(best.select(F.col("best.k1").alias("__k1"), F.col("best.k2").alias("__k2")), "kept")
    # Only rows that may be lost or repeated are joined; the others stay as they are and don't move.
    counts = docs.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.count(F.lit(1)).alias("n"))
    doubtful = counts.join(kept.withColumn("kept", F.lit(True)), ["__k1", "__k2"], "left").filter(F.col("kept").isNull() | (F.col("n") > 1))
    keyed = may_be_among(df.select("*", key[0].alias("__k1"), key[1].alias("__k2")), doubtful.select("__k1"), F.col("__k1"))
    joined = keyed.filter("__among").join(kept, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return keyed.filter(~F.col("__among")).select(*df.columns).union(joined.select(*df.columns))


def op3_simhash_pigeonhole(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
