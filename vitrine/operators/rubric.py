"""The deterministic rubric of a report: 19 ratios in four groups, caps, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, rounded

#: Group, component, points, numerator, denominator (a count or a number), points of an empty denominator.
COMPONENTS = [
    ("user_value", "verified_competitors", 15, "competitors", 3, 0),
    ("user_value", "source_linked_pairs", 15, "linked_matches", 10, 0),
    ("user_value", "pair_domain_breadth", 10, "match_domains", 3, 0),
    ("user_value", "pair_price_coverage", 10, "priced_matches", "linked_matches", 0),
    ("user_value", "recommendation_evidence", 10, "linked_actions", "actions", 0),
    ("integrity", "source_link_coverage", 25, "linked_claims", "claims", 0),
    ("integrity", "claim_type_coverage", 15, "typed_claims", "claims", 0),
    ("integrity", "relational_claims", 15, "backed_claims", "observed_claims", 0),
    ("integrity", "freshness", 10, "fresh_claims", "dated_claims", 0),
    ("integrity", "regional_competitors", 10, "region_competitors", "competitors", 0),
    ("integrity", "unavailable_explained", 5, "explained", "unavailable", 5),
    ("yield", "primary_products", 25, "primary_products", 50, 0),
    ("yield", "verified_competitors", 20, "competitors", 3, 0),
    ("yield", "rival_products", 20, "rival_products", 100, 0),
    ("yield", "rival_prices", 10, "priced_rivals", "rival_products", 0),
    ("yield", "rival_images", 10, "imaged_rivals", "rival_products", 0),
    ("yield", "source_linked_pairs", 15, "linked_matches", 10, 0),
    ("presentation", "linked_actions", 15, "all_actions_linked", 1, 0),
    ("presentation", "gap_coverage", 15, "explained", "unavailable", 15),
]
CAPS = {"unsupported-material-claims": 30, "no-primary-products-without-access-explanation": 35, "no-accepted-competitor": 45, "no-defensible-product-pair": 55}


def _score(points: int, numerator: str, denominator: str | int, empty: int) -> Column:
    """Points of a ratio of at most one, to four digits; an empty denominator earns its own points."""
    whole = F.lit(float(denominator)) if isinstance(denominator, int) else F.coalesce(F.col(denominator), F.lit(0)).cast("double")
    part = F.greatest(F.lit(0.0), F.coalesce(F.col(numerator), F.lit(0)).cast("double"))
    return F.when(whole <= 0, float(empty)).otherwise(rounded(F.least(part / whole, F.lit(1.0)) * points + F.lit(2.0**-52), 4))


def run_facts(companies: DataFrame, products: DataFrame, matches: DataFrame, claims: DataFrame, phases: DataFrame, actions: DataFrame) -> DataFrame:
    """The counts of every run that the rubric asks for, one row a run that has any fact.

    companies: run, is_primary, has_region. products: run, is_primary, has_price, has_image.
    matches: run, domain, linked, priced. claims: run, linked, typed, observed, backed, dated,
    fresh. phases: run, unavailable, explained, gap (a reason that is shown).
    actions: run, linked. Flags are boolean, null is false.
    """
    n = lambda c: F.count(F.when(c, 1))
    col = lambda c: F.coalesce(F.col(c), F.lit(False))
    rival = ~col("is_primary")
    parts = [
        companies.groupBy("run").agg(n(rival).alias("competitors"), n(rival & col("has_region")).alias("region_competitors")),
        products.groupBy("run").agg(n(col("is_primary")).alias("primary_products"), n(rival).alias("rival_products"), n(rival & col("has_price")).alias("priced_rivals"), n(rival & col("has_image")).alias("imaged_rivals")),
        matches.groupBy("run").agg(n(col("linked")).alias("linked_matches"), F.count_distinct(F.when(col("linked"), F.col("domain"))).alias("match_domains"), n(col("linked") & col("priced")).alias("priced_matches")),
        claims.groupBy("run").agg(
            F.count(F.lit(1)).alias("claims"), n(col("linked")).alias("linked_claims"), n(col("typed")).alias("typed_claims"), n(col("observed")).alias("observed_claims"),
            n(col("observed") & col("backed")).alias("backed_claims"), n(col("dated")).alias("dated_claims"), n(col("dated") & col("fresh")).alias("fresh_claims"),
        ),
        phases.groupBy("run").agg(n(col("unavailable")).alias("unavailable"), n(col("unavailable") & col("explained")).alias("explained"), n(col("gap")).alias("gaps")),
        actions.groupBy("run").agg(F.count(F.lit(1)).alias("actions"), n(col("linked")).alias("linked_actions")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "run", "full")
    out = out.na.fill(0)
    return out.withColumn("all_actions_linked", (F.col("actions").between(1, 3) & (F.col("actions") == F.col("linked_actions"))).cast("int"))


def evaluated(facts: DataFrame) -> DataFrame:
    """run, status, earned, applicable, score, cap (the lowest that holds) and capped score of each run.

    A run without any product is rated by the integrity of its evidence alone.
    """
    shop = (F.col("primary_products") > 0) | (F.col("rival_products") > 0)
    total = lambda groups: sum((_score(*c[2:]) for c in COMPONENTS if c[0] in groups), F.lit(0.0))
    points = lambda groups: sum(c[2] for c in COMPONENTS if c[0] in groups)
    every = {c[0] for c in COMPONENTS}
    earned = F.when(shop, rounded(total(every) + F.lit(2.0**-52), 4)).otherwise(rounded(total({"integrity"}) + F.lit(2.0**-52), 4))
    applicable = F.when(shop, points(every)).otherwise(points({"integrity"}))
    rules = {
        "unsupported-material-claims": F.col("claims") > F.col("linked_claims"),
        "no-primary-products-without-access-explanation": (F.col("primary_products") == 0) & (F.col("unavailable") == 0) & (F.col("gaps") == 0),
        "no-accepted-competitor": F.col("competitors") == 0,
        "no-defensible-product-pair": (F.col("competitors") > 0) & (F.col("linked_matches") == 0),
    }
    cap = F.when(shop, F.array_min(F.array_compact(F.array(*(F.when(rules[k], F.lit(v)) for k, v in CAPS.items())))))
    out = facts.select("run", F.when(shop, "deterministic").otherwise("rubric_unavailable").alias("status"), earned.alias("earned"), applicable.alias("applicable"), cap.alias("cap"))
    score = half_up(F.col("earned") / F.col("applicable") * 100)
    return out.withColumn("score", score).withColumn("capped", F.least("score", "cap"))


def manifest_gaps(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """run, kind, expected, found of every kind of fact whose number is not the one in its manifest (run, kind, expected); facts has run, kind."""
    found = facts.groupBy("run", "kind").agg(F.count(F.lit(1)).alias("found"))
    both = manifest.join(found, ["run", "kind"], "full").select("run", "kind", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.filter("expected <> found")
