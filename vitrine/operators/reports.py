"""Merging, selecting and planning of report rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Every key of either table; each field from the fresh record if it is known there."""
    a, b = fresh.alias("a"), stored.alias("b")
    rest = [c for c in fresh.columns if c != key]
    return a.join(b, key, "full").select(key, *(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in rest))


def linked(cited: DataFrame, claims: DataFrame) -> DataFrame:
    """ids of rows (id, claims array) that cite a claim of the table (claim)."""
    return cited.select("id", F.explode("claims").alias("claim")).join(claims, "claim", "left_semi").select("id").distinct()


def comparison_rows(rows: DataFrame, most: int = 80, least: int = 16) -> DataFrame:
    """id, matched of the best `most` matched rows, filled with unmatched ones up to `least`; rows has id, matched, score."""
    matched = rows.filter("matched").orderBy(F.col("score").desc(), "id").limit(most)
    pads = rows.filter(~F.col("matched")).orderBy("id").limit(least)
    # The pads are at most `least` rows; their number depends on the count of matched ones.
    ranked = pads.withColumn("n", F.row_number().over(Window.orderBy("id")))
    have = matched.agg(F.count(F.lit(1)).alias("have"))
    fill = ranked.join(F.broadcast(have)).filter(F.col("n") <= F.lit(least) - F.col("have"))
    return matched.select("id", "matched").unionByName(fill.select("id", "matched"))


def batches(groups: DataFrame, pairs: int, most_groups: int) -> DataFrame:
    """run, batch, groups, pairs: groups of a run (run, ord, pairs) in order, each batch filled up; what is left of a group opens the next one.

    One pass over rows that Spark has sorted by run; nothing is held but the open batch. Groups without pairs are left out.
    """

    def cut(frames):
        run, batch, n, total, out = None, 0, 0, 0, []
        for f in frames:
            for r, x in zip(f["run"], f["pairs"]):
                if run is None or r != run:
                    if n:
                        out.append((run, batch, n, total))
                    run, batch, n, total = r, 0, 0, 0
                x = int(x)
                while x > 0:
                    if total >= pairs or n >= most_groups:
                        out.append((run, batch, n, total))
                        batch, n, total = batch + 1, 0, 0
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=["run", "batch", "groups", "pairs"])
                            out = []
                    take = min(x, pairs - total)
                    n, total, x = n + 1, total + take, x - take
            if out:
                yield pd.DataFrame(out, columns=["run", "batch", "groups", "pairs"])
                out = []
        if n:
            yield pd.DataFrame([(run, batch, n, total)], columns=["run", "batch", "groups", "pairs"])

    rows = groups.filter("run IS NOT NULL AND pairs IS NOT NULL").select("run", "ord", "pairs").repartition("run").sortWithinPartitions("run", "ord")
    return rows.mapInPandas(cut, f"run {groups.schema['run'].dataType.simpleString()}, batch int, groups int, pairs long")


def pair_targets(pairs: DataFrame, budget: int) -> DataFrame:
    """run, page of the pages to fetch for the pairs (run, ord, a, b) of a run, taken in order while the pages not yet paid for fit the budget.

    State per run is the set of chosen pages, which the budget bounds.
    """

    def plan(frames):
        run, chosen = None, set()
        for f in frames:
            out = []
            for r, a, b in zip(f["run"], f["a"], f["b"]):
                if run is None or r != run:
                    run, chosen = r, set()
                new = {a, b} - chosen
                if len(chosen) + len(new) <= budget:
                    out += [(run, p) for p in sorted(new)]
                    chosen |= new
            yield pd.DataFrame(out, columns=["run", "page"])

    rows = pairs.filter("run IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").repartition("run").sortWithinPartitions("run", "ord").select("run", "a", "b")
    return rows.mapInPandas(plan, f"run {pairs.schema['run'].dataType.simpleString()}, page string")


def lowest_cap(rules: list[tuple[Column, int]]) -> Column:
    """The lowest cap of the rules that hold; null if none does."""
    return F.array_min(F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in rules))))


def is_strict_iso(c: Column | str) -> Column:
    """A time in UTC with milliseconds that names a day that exists."""
    x = F.col(c) if isinstance(c, str) else c
    parsed = F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.coalesce(x.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$") & (F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == x), F.lit(False))
