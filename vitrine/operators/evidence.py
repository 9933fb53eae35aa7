"""Published evidence in canonical JSON under a byte budget.

A run's evidence is one JSON row for each primary product, with its best priced matches. Texts
have caps, and a match keeps only what identity and price need. Bytes are those of the JSON
itself, counted natively. A run over its budget is refused as a whole, as a graph with edges
missing would pass for a complete one; an agent's envelope is cut instead, after the last row by
priority that fits, which a running sum over range partitions finds for a run of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import canonical_gtin
from ..functions.text import bounded_text
from ..sources.shared import stored
from .ordered import running_sum

# Matches of a primary that are kept, bytes of a run's evidence, numbers of a product that are kept.
MOST_MATCHES, MOST_BYTES, MOST_NUMBERS = 20, 3_500_000, 20
#: Code points that are kept of a text.
CAPS = {"id": 300, "name": 120, "raw": 120, "currency": 8, "period": 40, "sku": 100, "mpn": 100, "brand": 100, "plan": 40}


def compact_product(p: Column) -> Column:
    """What is kept of a product (id, domain, name, category, source_url, observed_at, gtins, sku, mpn, brand, prices); absent fields stay out of its JSON."""
    text = lambda c, cap: F.nullif(bounded_text(c, CAPS[cap]), F.lit(""))
    numbers = F.array_distinct(F.array_compact(F.transform(p["gtins"], canonical_gtin)))
    first = F.get(p["prices"], 0)
    price = F.struct(text(first["raw"], "raw").alias("raw"), text(first["currency"], "currency").alias("currency"), first["amount"].alias("amount"), text(first["period"], "period").alias("period"))
    return F.struct(
        bounded_text(p["id"], CAPS["id"]).alias("id"),
        p["domain"].alias("domain"),
        bounded_text(p["name"], CAPS["name"]).alias("name"),
        F.when(F.startswith(p["category"], F.lit("saas-plan")), bounded_text(p["category"], CAPS["plan"])).alias("plan"),
        F.when(first.isNotNull(), F.array(price)).alias("prices"),
        F.nullif(F.slice(F.coalesce(numbers, F.array().cast("array<string>")), 1, MOST_NUMBERS), F.array().cast("array<string>")).alias("gtins"),
        *(text(p[c], c).alias(c) for c in ("sku", "mpn", "brand")),
        p["source_url"].alias("source_url"),
        p["observed_at"].alias("observed_at"),
    )


def evidence_rows(primaries: DataFrame, matches: DataFrame, most_matches: int = MOST_MATCHES) -> DataFrame:
    """run, primary_id, json, bytes of every primary (run, primary_id, product).

    matches: run, primary_id, domain, rival_id, score, exact, eligible, product. Those that may
    show a price are kept, the most_matches best: exact ones first, then by score, domain and rival.
    Runs and primaries that are null are left out.
    """
    match = F.struct("domain", compact_product(F.col("product")).alias("product"), "score", F.when(~F.col("exact"), F.lit("close_substitute")).alias("verdict"))
    told = matches.filter("eligible").select("run", "primary_id", "exact", "score", "domain", "rival_id", F.to_json(match).alias("m")).withColumn("size", F.octet_length("m"))
    order = Window.partitionBy("run", "primary_id").orderBy(F.col("exact").desc(), F.col("score").desc_nulls_last(), "domain", "rival_id")
    best = told.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_matches)
    # A match's JSON is made before it moves, so that who asks for bytes alone moves lengths alone. Each match but the first adds a comma.
    listed = best.groupBy("run", "primary_id").agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("x"), (F.sum(F.col("size") + 1) - 1).alias("sizes"))
    rows = primaries.select("run", "primary_id", F.to_json(compact_product(F.col("product"))).alias("p")).withColumn("size", F.octet_length("p"))
    rows = rows.join(listed, ["run", "primary_id"], "left")
    head, between, end = '{"primary":', ',"matches":[', "]}"
    kept = F.coalesce(F.array_join(F.transform("x", lambda x: x["m"]), ","), F.lit(""))
    body = F.concat(F.lit(head), "p", F.lit(between), kept, F.lit(end))
    size = F.col("size") + F.coalesce("sizes", F.lit(0)) + len(head + between + end)
    return rows.select("run", "primary_id", body.alias("json"), size.cast("long").alias("bytes"))


def run_budgets(rows: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """run, rows, bytes (of all rows as one JSON list), kept: whether the run's evidence is within its budget."""
    whole = F.sum("bytes") + F.count(F.lit(1)) + 1
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), whole.alias("bytes")).withColumn("kept", F.col("bytes") <= most_bytes)


def published(rows: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of the runs within their budget, and the runs that are refused."""
    rows = stored(rows, "evidence")
    told = stored(run_budgets(rows, most_bytes), "budgets")
    return rows.join(told.filter("kept").select("run"), "run", "left_semi"), told.filter("NOT kept")


def envelope(rows: DataFrame, priority: list[str], most_bytes: int) -> DataFrame:
    """rows with `end` (bytes of a JSON list of all rows up to this one, in the order of priority) and `kept`, which ends before the first row that doesn't fit.

    The priority should tell the rows of a run apart. Rows are made once: the ranges are sampled from what was stored.
    """
    summed = running_sum(stored(rows, "rows"), ["run"], priority, F.col("bytes") + 1, "end").withColumn("end", F.col("end") + 1)
    return summed.withColumn("kept", F.col("end") <= most_bytes)
