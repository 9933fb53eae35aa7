"""States of evaluations, challenges and leases: which step each may take, and what a clock does to them.

A table of states and a table of requests give the next states: a request applies only if the
state it names is the current one, so replays and stale attempts change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most dispatch attempts, minutes before a dispatch and before a reservation is given up, minutes before a queued run is, minutes of a lease.
MOST_ATTEMPTS = 3
DISPATCH_MINUTES, RESERVED_MINUTES, QUEUED_MINUTES, LEASE_MINUTES = 5, 10, 60, 5
OPEN = ["deterministic", "dispatch_failed"]
CALLBACKS = ["complete", "agent_rejected", "needs_human_review", "call_outcome_unknown"]


def minutes_between(early: Column, late: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / 60e6


def next_state(status: Column, attempts: Column, owner: Column, request: Column, by: Column, attempt: Column, outcome: Column) -> Column:
    """status, attempts, owner, reply after a request: dispatch, fail, reserve or callback.

    A dispatch opens a new attempt while there are fewer than MOST_ATTEMPTS. All other requests
    name the attempt they belong to; one of another attempt is stale. Only the holder of a
    reservation may close it, and a closed evaluation absorbs every request.
    """

    def step(new: Column, tries: Column, holder: Column) -> Column:
        return F.struct(new.alias("status"), tries.alias("attempts"), holder.alias("owner"), F.lit("applied").alias("reply"))

    none = F.lit(None).cast("string")
    refused = lambda why: F.struct(status.alias("status"), attempts.alias("attempts"), owner.alias("owner"), F.lit(why).alias("reply"))
    failed = F.when(attempts >= MOST_ATTEMPTS, "failed").otherwise("dispatch_failed")
    return (
        F.when((request == "dispatch") & status.isin(OPEN) & (attempts < MOST_ATTEMPTS), step(F.lit("dispatching"), attempts + 1, none))
        .when(request == "dispatch", refused("ineligible"))
        .when(~attempt.eqNullSafe(attempts), refused("stale_attempt"))
        .when((request == "fail") & (status == "dispatching"), step(failed, attempts, none))
        .when((request == "reserve") & (status == "dispatching") & by.isNotNull(), step(F.lit("reserved"), attempts, by))
        .when((request == "callback") & (status == "reserved") & owner.eqNullSafe(by) & outcome.isin(CALLBACKS), step(outcome, attempts, owner))
        .when((request == "callback") & (status == "reserved"), refused("binding_conflict"))
        .otherwise(refused("ineligible"))
    )


def applied(states: DataFrame, requests: DataFrame) -> DataFrame:
    """id, status, attempts, owner, reply of every evaluation after its first request; one without a request stays as it is.

    states has id, status, attempts, owner; requests has id, ord, request, owner, attempt,
    outcome. Of several requests at once the first wins and the others must come again.
    """
    first = requests.groupBy("id").agg(F.min_by(F.struct("request", "owner", "attempt", "outcome"), "ord").alias("r"))
    met = states.join(first, "id", "left")
    new = next_state(F.col("status"), F.col("attempts"), F.col("owner"), F.col("r.request"), F.col("r.owner"), F.col("r.attempt"), F.col("r.outcome"))
    kept = F.struct("status", "attempts", "owner", F.lit(None).cast("string").alias("reply"))
    return met.select("id", F.when(F.col("r").isNull(), kept).otherwise(new).alias("s")).select("id", "s.*")


def expired(status: Column, attempts: Column, since: Column, now: Column) -> Column:
    """The state after a watchdog's pass: a dispatch or reservation that waits too long fails or may be dispatched again."""
    age = minutes_between(since, now)
    late = ((status == "dispatching") & (age > DISPATCH_MINUTES)) | ((status == "reserved") & (age > RESERVED_MINUTES))
    return F.when(late & (status == "reserved"), "call_outcome_unknown").when(late & (attempts >= MOST_ATTEMPTS), "failed").when(late, "dispatch_failed").otherwise(status)


def queued_timeout(status: Column, dispatched_at: Column, now: Column) -> Column:
    """A queued run that was dispatched too long ago has failed; one that never was still waits."""
    late = dispatched_at.isNotNull() & (minutes_between(dispatched_at, now) > QUEUED_MINUTES)
    return F.when((status == "queued") & late, "failed").otherwise(status)


def claimed(outbox: DataFrame, claims: DataFrame, receipts: DataFrame, worker: str, now: Column, most: int = 1) -> DataFrame:
    """id, worker, expires_at of the claims that a worker writes: the oldest messages without receipt and without a live claim.

    outbox has id, created_at; claims has id, expires_at; receipts has id. A message is handed
    out again once its claim expires, so it is delivered at least once.
    """
    live = claims.filter(F.col("expires_at") > now).select("id")
    free = outbox.join(receipts.select("id"), "id", "left_anti").join(live, "id", "left_anti").orderBy("created_at", "id").limit(most)
    return free.select("id", F.lit(worker).alias("worker"), (now + F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES")).alias("expires_at"))


def acknowledged(claims: DataFrame, acks: DataFrame) -> DataFrame:
    """id of the receipts to write: acknowledgements (id, worker, at) by the worker that holds a claim that is live then."""
    met = acks.alias("a").join(claims.alias("c"), "id").filter((F.col("a.worker") == F.col("c.worker")) & (F.col("a.at") <= F.col("c.expires_at")))
    return met.select("id").distinct()


def orphan_facts(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Facts (run, attempt, ...) of attempts that a recovery left behind: those of no run, or of an attempt before the run's current one that it did not adopt.

    runs has run, attempt, adopted (the attempts that it took over).
    """
    met = facts.join(runs.select("run", F.col("attempt").alias("__now"), F.col("adopted").alias("__adopted")), "run", "left")
    keep = (F.col("attempt") == F.col("__now")) | F.array_contains(F.coalesce("__adopted", F.array().cast("array<int>")), F.col("attempt"))
    return met.filter(~F.coalesce(keep, F.lit(False))).drop("__now", "__adopted")


def valid_checkpoints(checkpoints: DataFrame, plans: DataFrame) -> DataFrame:
    """Checkpoints (run, batch, plan_hash, pairs) that may be replayed: of the run's plan (run, plan_hash, batches, budget), within its batches, an earlier one of a batch first, and all together within the budget."""
    from .ordered import running_sum

    met = checkpoints.join(plans.select("run", F.col("plan_hash").alias("__plan"), "batches", "budget"), "run")
    met = met.filter((F.col("plan_hash") == F.col("__plan")) & (F.col("batch") >= 0) & (F.col("batch") < F.col("batches")) & F.col("pairs").isNotNull())
    one = met.groupBy("run", "batch").agg(F.min("ord").alias("ord"), F.min_by("pairs", "ord").alias("pairs"), F.first("budget").alias("budget"))
    return running_sum(one, ["run"], ["batch"], F.col("pairs"), "so_far").filter(F.col("so_far") <= F.col("budget")).select("run", "batch", "ord", "pairs")


def challenge_sample(known: DataFrame, most: int = 12) -> DataFrame:
    """run, urls, input_hash of a search challenge: a stable sample of a run's known URLs, by the hash of each, and the hash of the sample."""
    from pyspark.sql import Window

    order = Window.partitionBy("run").orderBy(F.sha2("url", 256), "url")
    few = known.select("run", "url").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    urls = F.array_sort(F.collect_list("url")).alias("urls")
    return few.groupBy("run").agg(urls).withColumn("input_hash", F.sha2(F.array_join("urls", "\n"), 256))
