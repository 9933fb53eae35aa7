"""Spelling variant grouping by a positional q-gram inverted index with a count filter.

Two words are near if one inserted, deleted or replaced code point tells them apart. Such words
agree in the first or in the last half of the shorter one, so words are dealt by class (length
of the shorter word of a pair) and half; a group with more than `most_group` words is dealt
again by halves of what its words don't yet share, and so on. That ends: with all but one code
point fixed, a group has no more words than the square of the alphabet. A pair is looked for
only where it meets first (the front half if that agrees), so no pair is found twice.

Inside a group the words' unshared parts, padded, are indexed by q-gram (q = 2) and position. A
word's posting lists, restricted to the length and the positions that one edit allows, are
merged by a heap that skips ids which cannot reach the bound: one edit leaves all but q of the
longer word's q-grams where they are, shifted by at most one place. What reaches the bound
is compared code point by code point.

A word's form is its most frequent near word, ties by the smaller, if that is `ratio` times as
frequent; the root is where forms lead to. Forms grow by that factor each step, so there are no
loops, and a table of forms is followed by doubling.

Defined cases: null and empty texts have no words; a null id counts as the empty string; repeated
rows are counted again; an empty table gives no rows; extra columns are ignored; words may be of any
length.
"""

from __future__ import annotations

import heapq
import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

Q = 2
#: A letter of a word.
LETTER = "[A-Za-zÀ-ÿ]"
#: Ends of a word's unshared part; no letters.
HEAD, TAIL = "\x02", "\x03"


def corpus_words(docs: DataFrame, least_chars: int = 7, least_n: int = 2, drop_one_in: int = 31) -> DataFrame:
    """word, n: the distinct words of all texts, with their occurrences.

    Runs are at least least_chars long to begin with, as nothing is ever added to one. Where
    drop_one_in divides the hash of id and run, the run loses the code point that the hash names.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % drop_one_in == 0, less).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the front half of the unshared part as shared, and with the back half.

    Rows have word, n, m (length of the shorter word of a pair), path, front and back (code points
    shared so far).
    """
    h = F.floor((F.col("m") - F.col("front") - F.col("back")) / 2).cast("int")
    two = F.array(
        F.struct(F.concat("path", F.lit("f")).alias("path"), (F.col("front") + h).alias("front"), F.col("back")),
        F.struct(F.concat("path", F.lit("b")).alias("path"), F.col("front"), (F.col("back") + h).alias("back")),
    )
    rows = rows.select("word", "n", "m", F.explode(two).alias("x")).select("word", "n", "m", "x.*")
    shared = F.struct(F.substr("word", F.lit(1), F.col("front")).alias("f"), F.substr("word", F.length("word") - F.col("back") + 1).alias("b"))
    return rows.withColumn("key", F.xxhash64("m", "path", shared))


def groups(words: DataFrame, most_group: int) -> Iterator[DataFrame]:
    """Tables of rows with a key; rows of one key are a group of bounded size."""
    rows = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    rows = halves(rows.select("word", "n", "m", F.lit("").alias("path"), F.lit(0).alias("front"), F.lit(0).alias("back")))
    while True:
        # What is shared down to one code point is bounded by the alphabet.
        large = rows.filter(F.col("m") - F.col("front") - F.col("back") > 1).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most_group)
        large = materialize(large.select("key"), "large")
        if large.isEmpty():
            yield rows
            return
        yield rows.join(large, "key", "left_anti")
        rows = halves(materialize(rows.join(large, "key", "left_semi"), "halves"))


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Ids that occur in at least `least` of the ascending lists, by a heap over their heads.

    If the smallest id is in too few of them, the least - 1 smallest heads can be moved to the
    next head: nothing before it can be in enough lists.
    """
    width = len(lists)
    at = [0] * width
    heap = [x[0] * width + j for j, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0] // width
        moved = []
        while heap and heap[0] // width == top:
            moved.append(heapq.heappop(heap) % width)
        if len(moved) >= least:
            yield top
            target = top + 1
        else:
            while len(moved) < least - 1 and heap:
                moved.append(heapq.heappop(heap) % width)
            if not heap:
                return
            target = max(top + 1, heap[0] // width)
        for j in moved:
            ids = lists[j]
            k = at[j] + 1 if ids[at[j]] < target else at[j]
            if k < len(ids) and ids[k] < target:
                k = bisect_left(ids, target, k)
            at[j] = k
            if k < len(ids):
                heapq.heappush(heap, ids[k] * width + j)


def one_edit(a: str, b: str) -> bool:
    """If one edit makes a, which isn't the longer one, b."""
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def near_pairs(words: list[str], m: int, path: str) -> Iterator[tuple[int, int]]:
    """Places of the near words of a group; one of each pair has m code points, and they meet here first."""
    front = back = 0
    agree = []
    for side in path:
        h = (m - front - back) // 2
        if side == "f":
            front += h
        else:
            agree.append((front, front + h))
            back += h
    postings: dict[tuple[str, int], list[int]] = {}
    shorter: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        word = words[i]
        rest = HEAD + word[front : len(word) - back] + TAIL
        grams = [(rest[p : p + Q], p) for p in range(len(rest) - Q + 1)]
        longer = len(word) - m
        places = [(g, p - d) for g, p in grams for d in range(longer + 1)]
        lists = [postings[x] for x in places if x in postings]
        least = len(grams) - Q
        # With one code point left no q-gram need survive, and all words of the group are near.
        for j in merged(lists, least) if least > 0 else shorter:
            other = words[j]
            if one_edit(other, word) and not any(word[a:b] == other[a:b] for a, b in agree):
                yield j, i
        if not longer:
            shorter.append(i)
            for x in grams:
                postings.setdefault(x, []).append(i)


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, both ways, of batches ordered by key."""
    rest: pa.Table | None = None

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = t["key"].to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        some = ends - starts > 1
        words, n, m, path = (t[c].to_pylist() for c in ("word", "n", "m", "path"))
        out: tuple[list, list, list] = ([], [], [])
        for s, e in zip(starts[some].tolist(), ends[some].tolist()):
            for i, j in near_pairs(words[s:e], m[s], path[s]):
                i, j = s + i, s + j
                for c, two in zip(out, ((words[i], words[j]), (words[j], words[i]), (n[j], n[i]))):
                    c.extend(two)
            if len(out[0]) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = t["key"].to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if last:
            yield from pairs(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None:
        yield from pairs(rest)


def near_words(words: DataFrame, most_group: int = 2000) -> DataFrame:
    """word, near, near_n: every near word of each word. words: distinct word, n."""
    found = None
    for rows in groups(words, most_group):
        rows = rows.select("key", "word", "n", "m", "path").repartition("key").sortWithinPartitions("key")
        pairs = rows.mapInArrow(search, "word string, near string, near_n long")
        found = pairs if found is None else found.union(pairs)
    return found


def variants(words: DataFrame, ratio: int = 10, most_group: int = 2000) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct word, n."""
    near = near_words(words, most_group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    is_form = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
    )
    rows = materialize(rows, "forms")
    roots = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    steps = len(str(rows.agg(F.max("n")).first()[0] or 0))  # a chain is no longer than that
    for _ in range(steps.bit_length()):
        on = roots.select(F.col("word").alias("at"), F.col("root").alias("to"))
        roots = materialize(roots.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_positional_qgrams(spark, sf_dir: str) -> DataFrame:
    """Words of the documents with their near words, forms and roots."""
    words = corpus_words(table(spark, sf_dir, "documents"))
    return variants(materialize(words, "words"))
