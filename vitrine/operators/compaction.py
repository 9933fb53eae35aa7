"""Fitting report documents into a byte budget by four levels of reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many blocks or items of each kind a level keeps, and how many characters of a block's text at any level.
LEVELS = [
    {"catalog": 12, "unmatched": 6, "evidence": 12, "gap": 30, "pages": 12, "rows": 100},
    {"catalog": 6, "unmatched": 3, "evidence": 6, "gap": 15, "pages": 6, "rows": 50},
    {"catalog": 3, "unmatched": 1, "evidence": 0, "gap": 8, "pages": 3, "rows": 25},
    {"catalog": 1, "unmatched": 0, "evidence": 0, "gap": 4, "pages": 1, "rows": 12},
]
CHARACTERS = {"evidence": 500, "gap": 1000, "summary": 4000, "company": 2000, "competitor": 2000, "candidate": 1000}
#: Kinds of blocks that are dropped past a number of them, and those whose items are.
COUNTED = {"evidence": "evidence", "gap": "gap"}
NESTED = {"product-catalog": "catalog", "product-unmatched": "unmatched", "company": "pages", "product-comparison": "rows"}


def _by_type(values: dict[str, int], otherwise: int | None = None) -> Column:
    out = F.lit(otherwise).cast("int")
    for kind, v in values.items():
        out = F.when(F.col("type") == kind, F.lit(v)).otherwise(out)
    return out


def compacted(blocks: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """doc, ord, type, text, items, total_items, level of the blocks of each document that the first level within the budget keeps.

    blocks has doc, ord, type, text, items (array of string). A document's size is the bytes of
    its texts and items and `overhead` for each block. Documents that no level makes small
    enough have no rows. Texts are cut at any level; nulls are empty.
    """
    own = F.coalesce("text", F.lit("")).alias("text")
    items = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    cut = _by_type(CHARACTERS)
    b = blocks.select("doc", "ord", "type", own, items).withColumn("text", F.when(cut.isNotNull(), F.substring("text", F.lit(1), cut)).otherwise(F.col("text")))
    b = b.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "type").orderBy("ord")))
    kept, sizes = [], []
    for level in LEVELS:
        most = _by_type({kind: level[c] for kind, c in COUNTED.items()})
        few = _by_type({kind: level[c] for kind, c in NESTED.items()})
        some = F.when(few.isNotNull(), F.slice("items", F.lit(1), few)).otherwise(F.col("items"))
        here = most.isNull() | (F.col("nth") <= most)
        size = F.octet_length("text") + F.aggregate(some, F.lit(0), lambda s, x: s + F.octet_length(F.coalesce(x, F.lit("")))) + F.lit(overhead)
        kept.append(F.struct(here.alias("here"), some.alias("items")))
        sizes.append(F.sum(F.when(here, size).otherwise(0)))
    fits = [F.when(s <= budget, F.lit(k)) for k, s in enumerate(sizes)]
    chosen = b.groupBy("doc").agg(F.coalesce(*fits).alias("level")).filter("level IS NOT NULL")
    at = b.join(chosen, "doc").withColumn("kept", F.element_at(F.array(*kept), F.col("level") + 1)).filter("kept.here")
    return at.select("doc", "ord", "type", "text", F.col("kept.items").alias("items"), F.size("items").alias("total_items"), "level")
