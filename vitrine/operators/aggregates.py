"""Aggregates of pages, signals and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import REGION_WEIGHTS
from ..functions.numbers import clamp100, half_up, observed_score, percent_of


def benchmark_row(pages: DataFrame, key: str = "host") -> DataFrame:
    """One row of page metrics per domain, in one aggregation.

    Pages have key, ordinal (the smallest is the home page), product_links, product_path,
    language, viewport, images and images_alt. A component without observations has no weight.
    """
    g = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"),
        F.min_by("product_links", "ordinal").alias("home_links"),
        F.max("product_path").alias("product_path"),
        F.max("language").alias("language"),
        F.max("viewport").alias("viewport"),
        F.sum("images").alias("images"),
        F.sum("images_alt").alias("images_alt"),
    )
    hundred = lambda c: F.when(F.col(c), 100.0).otherwise(0.0)
    alt = percent_of("images_alt", "images")
    access = F.least(F.col("home_links"), F.lit(5)) / 5 * 60 + F.when(F.col("product_path"), 25).otherwise(0)
    mobile = observed_score([(hundred("viewport"), 45), (hundred("language"), 20), (alt, 35)])
    return g.withColumn("alt_coverage", alt).withColumn("access_score", clamp100(access)).withColumn("mobile_score", clamp100(mobile))


def trust_score(signals: Column) -> Column:
    """20 points for each distinct signal."""
    return clamp100(F.size(F.array_distinct(signals)) * 20)


def purchase_path(product: Column, cart_button: Column, cart_link: Column, checkout: Column) -> Column:
    """score and least public steps of what a page offers on the way to a purchase; null without any sign of it."""
    score = F.when(cart_button | cart_link | checkout, clamp100(product.cast("int") * 20 + cart_button.cast("int") * 35 + cart_link.cast("int") * 20 + checkout.cast("int") * 25))
    steps = F.when(checkout, 1).when(cart_button & cart_link, 2).when(cart_button, 3).when(cart_link, 2)
    return F.struct(score.alias("score"), steps.alias("steps"))


def information_score(*present: Column) -> Column:
    """Completed fields as a share of all fields of all products."""
    filled = sum((F.sum(p.cast("int")) for p in present), F.lit(0))
    return F.when(F.count(F.lit(1)) > 0, clamp100(filled * F.lit(100.0) / (F.count(F.lit(1)) * len(present))))


def region_votes(signals: DataFrame) -> DataFrame:
    """region and confidence of each domain from signals of domain, country, kind, value and optionally weight.

    Equal signals count once. A country wins with 4 points or more and a lead of 3; if none
    does, GLOBAL with 4 points or more.
    """
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in REGION_WEIGHTS.items() for x in kv)), F.col("kind")), F.lit(0))
    weight = F.col("weight") if "weight" in signals.columns else weight
    s = signals.select("domain", "country", "kind", F.lower(F.translate("value", "_", "-")).alias("value"), weight.alias("weight"))
    s = s.groupBy("domain", "country", "kind", "value").agg(F.max("weight").alias("weight"))
    sums = s.groupBy("domain", "country").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("domain").orderBy((F.col("country") == "GLOBAL"), F.col("w").desc(), "country")
    ranked = sums.withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead(F.when(F.col("country") != "GLOBAL", F.col("w"))).over(order))
    globally = F.max(F.when(F.col("country") == "GLOBAL", F.col("w"))).over(Window.partitionBy("domain"))
    top = ranked.withColumn("g", globally).filter("rn = 1")
    wins = (F.col("country") != "GLOBAL") & (F.col("w") >= 4) & (F.col("w") - F.coalesce("second", F.lit(0)) >= 3)
    region = F.when(wins, F.col("country")).when(F.col("g") >= 4, "GLOBAL").otherwise("Unknown")
    confidence = F.when(wins, F.when(F.col("w") >= 7, "High").otherwise("Medium")).when(F.col("g") >= 7, "High").when(F.col("g") >= 4, "Medium").otherwise("Low")
    return top.select("domain", region.alias("region"), confidence.alias("confidence"))


def rubric_points(parts: list[tuple[str, str | float, float]]) -> Column:
    """Whole percent of the points that ratios (part, whole, points) earn; ratios count up to one, and an empty whole earns all."""
    earned = F.lit(0.0)
    for part, whole, points in parts:
        w = F.col(whole) if isinstance(whole, str) else F.lit(float(whole))
        earned = earned + F.when(w > 0, F.least(F.lit(1.0), F.col(part) / w)).otherwise(1.0) * points
    return half_up(earned / sum(p for _, _, p in parts) * 100)
