"""Bounded chunks and byte budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_chunks(facts: DataFrame, items: int, size: int) -> DataFrame:
    """run, chunk, items, bytes of the chunks that ordered facts of a run fall into.

    Facts have run, ord, bytes. A chunk ends before the fact that would make it too many or too
    large; a fact larger than the bound is a chunk of its own. Runs are reports and bounded by
    what one report holds; their facts are sorted by Spark and read one after the other.
    """

    def cut(batches):
        run, chunk, n, total = None, 0, 0, 0
        out: list[tuple] = []
        for b in batches:
            for r, x in zip(b["run"], b["bytes"]):
                x = 0 if pd.isna(x) else int(x)
                if run is None or r != run:
                    if run is not None:
                        out.append((run, chunk, n, total))
                    run, chunk, n, total = r, 0, 0, 0
                elif n >= items or total + x > size:
                    out.append((run, chunk, n, total))
                    chunk, n, total = chunk + 1, 0, 0
                n, total = n + 1, total + x
            if out:
                yield pd.DataFrame(out, columns=["run", "chunk", "items", "bytes"])
                out = []
        if run is not None:
            yield pd.DataFrame([(run, chunk, n, total)], columns=["run", "chunk", "items", "bytes"])

    rows = facts.filter("run IS NOT NULL").select("run", "ord", "bytes").repartition("run").sortWithinPartitions("run", "ord")
    return rows.mapInPandas(cut, f"run {facts.schema['run'].dataType.simpleString()}, chunk int, items int, bytes long")


def first_within(levels: list[Column], size: int) -> Column:
    """The first of several ever smaller forms of a document that fits a byte budget; the last if none does."""
    out = levels[-1]
    for level in reversed(levels[:-1]):
        out = F.when(F.octet_length(F.to_json(level)) <= size, F.to_json(level)).otherwise(out if out is not levels[-1] else F.to_json(out))
    return out if out is not levels[-1] else F.to_json(out)
