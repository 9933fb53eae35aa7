"""Many requests for one evaluation or challenge at once: state machines folded in parallel.

A request is a function from state to state, and functions compose associatively. Requests are
dealt by key and order over Spark's range partitions, so a hot key spans many of them. Only
keys cut by a boundary need more than their own partition, at most one for each boundary: of
those, each partition composes its requests to one map from every open state to the state it
leads to, and the few maps of a key are folded in order, which gives each partition
the state its requests start from. Then all partitions answer their requests at once.

A reservation can be taken once, so it absorbs in these maps, with its place; when it is closed is
a matter of one join: its holder's first valid callback. So the maps stay of a fixed size, whatever
the owners are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .evaluations import CALLBACKS, MOST_ATTEMPTS, OPEN


@dataclass(frozen=True)
class Machine:
    """What tells an evaluation from a challenge."""

    #: States from which a dispatch may start.
    open: tuple[str, ...]
    #: Outcomes that a callback may have; all of them end it.
    outcomes: tuple[str, ...]
    most_attempts: int = MOST_ATTEMPTS
    #: Outcome of a callback that cost more than was reserved; null for no limit.
    over_cost: str | None = None
    most_cost: int = 0
    #: Replies to a reservation in a state that isn't dispatching: True tells a closed state and a reserved one apart.
    names_refusals: bool = False

    def step(self, state: tuple, request: tuple) -> tuple[tuple, str]:
        """(status, attempts, owner) and the reply after a request (request, by, attempt, outcome, cost)."""
        status, attempts, owner = state
        what, by, attempt, outcome, cost = request
        if what == "dispatch":
            return (("dispatching", attempts + 1, None), "applied") if status in self.open and attempts < self.most_attempts else (state, "ineligible")
        if self.names_refusals and what == "reserve" and status != "dispatching":
            return state, "already_reserved" if status == "reserved" else "terminal" if status == "failed" or status in self.outcomes or status == "insufficient_facts" else "ineligible"
        if attempt != attempts:
            return state, "stale_attempt"
        if what == "fail" and status == "dispatching":
            return ("failed" if attempts >= self.most_attempts else "dispatch_failed", attempts, None), "applied"
        if what == "reserve" and status == "dispatching" and by is not None:
            return ("reserved", attempts, by), "applied"
        if what == "callback" and status == "reserved":
            if owner == by and outcome in self.outcomes:
                return (self.outcome(outcome, cost), attempts, owner), "applied"
            return state, "binding_conflict"
        return state, "ineligible"

    def outcome(self, outcome: str, cost: int | None) -> str:
        return self.over_cost if self.over_cost and (cost or 0) > self.most_cost else outcome


EVALUATION = Machine(open=tuple(OPEN), outcomes=tuple(CALLBACKS))
#: A challenge knows no human review, closes on its cost, and tells why a reservation is refused.
CHALLENGE = Machine(open=("deterministic", "dispatch_failed"), outcomes=("complete", "agent_rejected", "call_outcome_unknown"), over_cost="agent_rejected", most_cost=250_000, names_refusals=True)

REQUEST = ["request", "owner", "attempt", "outcome", "cost"]


def plain(values) -> list:
    return [None if v is None or v != v else v for v in values]


def composed(machine: Machine, requests: list[tuple], starts: list[tuple]) -> list[tuple]:
    """For each start (status, attempts) where the requests (ord, ...) lead: status, attempts, and for a reservation its owner and ord."""
    now = [(s, a, None, None) for s, a in starts]
    live = {i for i, (s, *_) in enumerate(now) if s in machine.open or s == "dispatching"}
    for ord_, *request in requests:
        if not live:
            break
        for i in list(live):
            (s, a, o), reply = machine.step((now[i][0], now[i][1], None), tuple(request))
            if reply == "applied":
                now[i] = (s, a, o, ord_ if s == "reserved" else None)
                if s not in machine.open and s != "dispatching":
                    live.discard(i)
    return now


def answered(states: DataFrame, requests: DataFrame, machine: Machine = EVALUATION, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Final states and replies.

    states: id (long, once each), status, attempts (from 0 to a few), owner. requests: id, ord (long, tells a key's requests apart), request
    (dispatch, fail, reserve, callback), owner, attempt, outcome, cost. Returns id, status,
    attempts, owner of every state, and id, ord, reply of every request; requests for ids
    without a state get the reply 'unknown'. Requests count in the order of ord. Null ids have no state.
    """
    spark = requests.sparkSession
    n = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = requests.select("id", "ord", *REQUEST).repartitionByRange(n, "id", "ord").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "requests")
    spans = dealt.groupBy("id").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    spans = stored(spans.join(states, "id", "left_semi"), "spans")  # one id for each boundary at most
    cut = dealt.join(F.broadcast(spans.select("id")), "id")
    counts = states.agg(F.max("attempts")).first()[0] or 0
    starts = [(s, a) for s in dict.fromkeys((*machine.open, "dispatching")) for a in range(max(counts, machine.most_attempts) + 1)]

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for key, *request in zip(zip(b["id"].tolist(), b["part"].tolist()), b["ord"].tolist(), *(plain(b[c]) for c in REQUEST)):
                held.setdefault(key, []).append(request)
        rows = [(*key, *start, *end) for key, own in held.items() for start, end in zip(starts, composed(machine, sorted(own, key=lambda r: r[0]), starts))]
        yield pd.DataFrame(rows, columns=["id", "part", "s", "a", "status", "attempts", "owner", "ord"]).astype({"id": "int64", "part": "int64"}).astype({"ord": "Int64"})

    maps = cut.repartition(n, "part").mapInPandas(compose, "id long, part int, s string, a int, status string, attempts int, owner string, ord long")
    first = spans.join(states, "id").select("id", F.col("status").alias("status0"), F.col("attempts").alias("attempts0"), F.col("owner").alias("owner0"))

    def fold(key: tuple, m: pd.DataFrame) -> pd.DataFrame:
        status, attempts, owner = m["status0"].iloc[0], int(m["attempts0"].iloc[0]), plain(m["owner0"])[0]
        of = {(p, s, a): (t, b, o, r) for p, s, a, t, b, o, r in zip(m["part"], m["s"], m["a"], m["status"], m["attempts"], plain(m["owner"]), m["ord"])}
        rows, at = [], None
        for p in sorted(set(m["part"])):
            rows.append((key[0], p, status, attempts, owner, at))
            if (p, status, attempts) in of:
                new, more, holder, ord_ = of[p, status, attempts]
                if (new, more) != (status, attempts):
                    owner = holder
                status, attempts, at = new, int(more), int(ord_) if new == "reserved" else at
        return pd.DataFrame(rows, columns=["id", "part", "status", "attempts", "owner", "since"]).astype({"since": "Int64"})

    # A row for each boundary and open state, so the table is no larger than partitions times states.
    entry = maps.join(first, "id").groupBy("id").applyInPandas(fold, "id long, part int, status string, attempts int, owner string, since long")
    entry = stored(entry, "entries")
    # A reservation met before a partition may be closed before it, too.
    held = entry.filter("status = 'reserved'").groupBy("id").agg(F.max("attempts").alias("attempts"), F.max("owner").alias("owner"), F.max(F.coalesce("since", F.lit(-(2**63)))).alias("since"))
    h, c = held.alias("h"), cut.alias("c")
    closes = (
        h.join(c, (F.col("h.id") == F.col("c.id")) & (F.col("c.ord") > F.col("since")) & (F.col("request") == "callback") & (F.col("attempt") == F.col("attempts")) & F.col("c.owner").eqNullSafe(F.col("h.owner")) & F.col("outcome").isin(*machine.outcomes))
        .groupBy(F.col("h.id").alias("closed_id"))
        .agg(F.min(F.struct("c.ord", "c.part", "outcome", "cost")).alias("x"))
    )
    over = F.when(F.coalesce(F.col("x.cost"), F.lit(0)) > machine.most_cost, F.lit(machine.over_cost)) if machine.over_cost else F.lit(None).cast("string")
    later = (F.col("status") == "reserved") & (F.col("x.part") < F.col("part"))
    entry = entry.join(closes, F.col("id") == F.col("closed_id"), "left").select("id", "part", F.when(later, F.coalesce(over, F.col("x.outcome"))).otherwise(F.col("status")).alias("status"), "attempts", "owner")
    e = entry.select(F.col("id").alias("eid"), F.col("part").alias("epart"), F.struct("status", "attempts", "owner").alias("entry"))
    s = states.select(F.col("id").alias("sid"), F.struct("status", "attempts", "owner").alias("start"))
    met = dealt.join(s, F.col("id") == F.col("sid"), "left").join(F.broadcast(e), (F.col("id") == F.col("eid")) & (F.col("part") == F.col("epart")), "left")
    asked = met.withColumn("from", F.coalesce("entry", "start")).select("part", "id", "ord", *REQUEST, F.col("from.status").alias("status"), F.col("from.attempts").alias("attempts"), F.col("from.owner").alias("holder"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for part, id_, ord_, *request, status, attempts, holder in zip(b["part"].tolist(), plain(b["id"]), b["ord"].tolist(), *(plain(b[c]) for c in REQUEST), plain(b["status"]), plain(b["attempts"]), plain(b["holder"])):
                if (part, id_) != last:
                    last, state = (part, id_), None if status is None else (status, int(attempts), holder)
                if state is None:
                    out.append((id_, ord_, part, "unknown", None, None, None))
                    continue
                state, reply = machine.step(state, tuple(request))
                out.append((id_, ord_, part, reply, *state))
            yield pd.DataFrame(out, columns=["id", "ord", "part", "reply", "status", "attempts", "owner"]).astype({"id": "Int64", "attempts": "Int64"})

    told = asked.repartition(n, "part").sortWithinPartitions("part", "id", "ord")
    told = stored(told.mapInPandas(answer, "id long, ord long, part int, reply string, status string, attempts int, owner string"), "replies")
    final = told.filter("status IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("status", "attempts", "owner"), "ord").alias("f")).select(F.col("id").alias("fid"), "f")
    kept = F.struct("status", "attempts", "owner")
    after = states.join(final, F.col("id") == F.col("fid"), "left").select("id", F.coalesce("f", kept).alias("f")).select("id", "f.status", "f.attempts", "f.owner")
    return after, told.select("id", "ord", "reply")
