"""Requests folded in parallel against one sequential pass."""

import random

import pytest

from vitrine.operators import transitions as T

KIND = "id long, ord long, request string, owner string, attempt int, outcome string, cost long"


def sequential(machine, states, requests):
    now = {i: (s, a, o) for i, s, a, o in states}
    replies = []
    for i, ord_, *request in sorted(requests, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if i not in now:
            replies.append((i, ord_, "unknown"))
            continue
        now[i], reply = machine.step(now[i], tuple(request))
        replies.append((i, ord_, reply))
    return sorted((i, *s) for i, s in now.items()), replies


def some_requests(r, ids, n, start=0):
    out = []
    for k in range(n):
        what = r.choices(["dispatch", "fail", "reserve", "callback"], [1, 2, 1, 4])[0]
        out.append((r.choice(ids), start + k, what, r.choice([None, "w1", "w2", "w3"]), r.randrange(0, 4), r.choice(["complete", "agent_rejected", "needs_human_review", "nonsense", None]), r.choice([None, 1, 10**6])))
    return out


@pytest.mark.parametrize("machine", [T.EVALUATION, T.CHALLENGE])
def test_a_hot_key_is_folded_in_parallel(spark, machine):
    r = random.Random(4)
    states = [(i, r.choice(["deterministic", "dispatch_failed", "dispatching", "reserved", "failed", "insufficient_facts"]), r.randrange(0, 4), r.choice([None, "w1"])) for i in range(30)] + [(1000, "deterministic", 0, None), (1001, "reserved", 1, "w2"), (1002, "dispatching", 1, None)]
    requests = some_requests(r, list(range(35)) + [None], 2000)
    # Refused for long, then dispatched, reserved and closed far apart, over many partitions.
    quiet = lambda i, n, at: [(i, at + k, "fail", None, 9, None, None) for k in range(n)]
    for i in (1000, 1001, 1002):
        requests += quiet(i, 700, 0) + [(i, 700, "dispatch", None, None, None, None), (i, 701, "fail", None, 1, None, None), (i, 702, "dispatch", None, None, None, None)]
        requests += quiet(i, 700, 800) + [(i, 1500, "reserve", "w2", 2, None, None)] + quiet(i, 700, 1600) + [(i, 2400, "callback", "w1", 2, "complete", 1), (i, 2401, "callback", "w2", 1, "complete", 1), (i, 2402, "callback", "w2", 2, "complete", 10**6)]
        requests += quiet(i, 700, 2500) + [(i, 3300, "callback", "w2", 2, "agent_rejected", 1)]
    s = spark.createDataFrame(states, "id long, status string, attempts int, owner string")
    q = spark.createDataFrame(random.Random(1).sample(requests, len(requests)), KIND)
    want, replies = sequential(machine, states, requests)
    for parts in (1, 12):
        after, told = T.answered(s, q, machine, parts=parts)
        assert sorted(map(tuple, after.collect())) == want
        assert sorted(map(tuple, told.collect()), key=str) == sorted(replies, key=str)


def test_one_key_with_a_hundred_thousand_requests(spark):
    r = random.Random(8)
    states = [(1, "deterministic", 0, None), (2, "deterministic", 0, None)]
    requests = [(1, k, *x[2:]) for k, x in enumerate(some_requests(r, [1], 100_000))]
    late = [(2, k, "callback", "w", 1, "complete", 0) for k in range(50_000)] + [(2, 50_000, "dispatch", None, None, None, None), (2, 50_001, "reserve", "z", 1, None, None), (2, 90_000, "callback", "z", 1, "complete", 0)]
    q = spark.createDataFrame(requests + late, KIND)
    after, told = T.answered(spark.createDataFrame(states, "id long, status string, attempts int, owner string"), q, T.EVALUATION, parts=16)
    want, replies = sequential(T.EVALUATION, states, requests + late)
    assert sorted(map(tuple, after.collect())) == want
    assert sorted(map(tuple, told.collect())) == sorted(replies)


def test_composition_is_associative():
    r = random.Random(3)
    starts = [(s, a) for s in ("deterministic", "dispatch_failed", "dispatching") for a in range(4)]
    for _ in range(50):
        requests = [x[1:] for x in some_requests(r, [1], 30)]
        whole = T.composed(T.EVALUATION, requests, starts)
        cut = r.randrange(31)
        first = T.composed(T.EVALUATION, requests[:cut], starts)
        then = dict(zip(starts, T.composed(T.EVALUATION, requests[cut:], starts)))
        joined = []
        for s, a, o, at in first:
            t = then.get((s, a))
            joined.append((s, a, o, at) if t is None or (t[0], t[1]) == (s, a) else t)
        assert joined == whole


def test_no_rows(spark):
    s, q = spark.createDataFrame([(1, "deterministic", 0, None)], "id long, status string, attempts int, owner string"), spark.createDataFrame([], KIND)
    after, told = T.answered(s, q)
    assert [tuple(r) for r in after.collect()] == [(1, "deterministic", 0, None)] and told.collect() == []
    assert T.answered(s.filter("1 = 0"), spark.createDataFrame([(1, 1, "dispatch", None, None, None, None)], KIND))[1].first()["reply"] == "unknown"
