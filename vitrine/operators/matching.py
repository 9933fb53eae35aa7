"""The hybrid matching of catalogs: candidates, groups for a judge, verdicts, published pairs.

Candidates come scored (by name, by embedding, by identifier); embeddings and verdicts are
tables, as no model is called here. Every limit is one of the matching plan and every order
ends in a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .assignment import greedy_assignment
from .ordered import running_sum
from .similarity import assessed_score, sanitized_verdict


def candidate_groups(candidates: DataFrame, per_domain: int = 5, per_primary: int = 5) -> DataFrame:
    """The candidates of each primary with their rank `n` in its group.

    candidates has run, primary_id, domain, rival_id, retrieval, lexical, pinned. Pinned pairs
    all stay and come first; of the others a domain gives its per_domain best, and a primary
    keeps the per_primary best of these.
    """
    own, others = candidates.filter("pinned"), candidates.filter("NOT pinned")
    by_domain = Window.partitionBy("run", "primary_id", "domain").orderBy(F.col("retrieval").desc(), F.col("lexical").desc(), "rival_id")
    by_primary = Window.partitionBy("run", "primary_id").orderBy(F.col("retrieval").desc(), "rival_id", "domain")
    others = others.withColumn("n", F.row_number().over(by_domain)).filter(F.col("n") <= per_domain)
    others = others.withColumn("n", F.row_number().over(by_primary)).filter(F.col("n") <= per_primary).drop("n")
    group = Window.partitionBy("run", "primary_id").orderBy(F.col("pinned").desc(), F.col("retrieval").desc(), "rival_id", "domain")
    return own.unionByName(others).withColumn("n", F.row_number().over(group))


def judge_groups(groups: DataFrame, primaries: DataFrame, most: int = 60) -> DataFrame:
    """run, primary_id, place of the groups that a judge sees, at most `most` a run.

    groups has run, primary_id, retrieval, priced, pinned; primaries has run, primary_id,
    has_price, has_image. Pinned groups come first, then those with a comparable price, the
    strongest candidate, a price, an image.
    """
    g = groups.groupBy("run", "primary_id").agg(F.max("pinned").alias("pinned"), F.max("priced").alias("priced"), F.max("retrieval").alias("strength"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).desc()
    order = Window.partitionBy("run").orderBy(F.col("pinned").desc(), F.col("priced").desc(), F.col("strength").desc(), flag("has_price"), flag("has_image"), "primary_id")
    placed = g.join(primaries, ["run", "primary_id"], "left").withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= most).select("run", "primary_id", "place")


def bounded_pairs(groups: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """The candidates that a judge sees, with their group's place: all pinned pairs, and others in order while a run's pairs are at most `most`."""
    rows = groups.join(places, ["run", "primary_id"])
    pinned = rows.groupBy("run").agg(F.count(F.when(F.col("pinned"), 1)).alias("pins"))
    ordinary = running_sum(rows.filter("NOT pinned"), ["run"], ["place", "n"], F.lit(1), "before").join(pinned, "run")
    kept = ordinary.filter(F.col("before") <= F.lit(most) - F.col("pins")).drop("before", "pins")
    return rows.filter("pinned").unionByName(kept)


def is_useful(deterministic: Column, confidence: Column, both_generic: Column, shared: Column) -> Column:
    """Whether a match tells something: an identifier or two own words in common, or enough confidence and not two generic names."""
    return deterministic | ((confidence >= 0.65) & ~(both_generic & (shared == 0)))


def judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs with the sanitized verdict and score of their assessment; pairs without one, and those that match nothing, are left out.

    pairs has vetoed, exact, deterministic, both_generic, shared; verdicts has run, primary_id,
    domain, rival_id, verdict, confidence, contradicted. An unknown verdict is no match.
    """
    known = F.when(F.col("verdict").isin("same_product", "close_substitute", "related", "no_match"), F.col("verdict")).otherwise("no_match")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    met = pairs.join(verdicts, ["run", "primary_id", "domain", "rival_id"]).withColumn("confidence", sure)
    met = met.withColumn("verdict", sanitized_verdict(known, F.col("vetoed"), F.coalesce("contradicted", F.lit(False)), F.col("exact")))
    met = met.withColumn("score", assessed_score(F.col("verdict"), F.col("confidence")))
    return met.filter(F.col("score").isNotNull() & is_useful(F.col("deterministic"), F.col("confidence"), F.col("both_generic"), F.col("shared")))


def hybrid_matches(candidates: DataFrame, primaries: DataFrame, verdicts: DataFrame, most_primaries: int = 60, most_pairs: int = 6000, per_domain: int = 5, per_primary: int = 5) -> DataFrame:
    """run, domain, primary_id, rival_id, verdict, score of the published matches: one rival of a domain for a primary, each once.

    candidates has what candidate_groups, judge_groups and judged ask for.
    """
    # Both are read several times, and cost windows and joins to make.
    groups = stored(candidate_groups(candidates, per_domain, per_primary), "groups")
    pairs = bounded_pairs(groups, judge_groups(groups, primaries, most_primaries), most_pairs)
    found = stored(judged(pairs, verdicts).select("run", "domain", "primary_id", "rival_id", "verdict", "score"), "found")
    keyed = found.withColumn("group", F.struct("run", "domain"))
    taken = greedy_assignment(keyed.select("group", "primary_id", "rival_id", "score"), "group").select("group.run", "group.domain", "primary_id", "rival_id")
    return found.join(taken, ["run", "domain", "primary_id", "rival_id"], "left_semi")
