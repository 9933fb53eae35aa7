"""Reply trees against a plain walk, and the template's round trip."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vitrine.llm import chat

SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, up string, node string, extra int"
ODD = [None, "", "<", "<|", "<|im_end|>\n", "<\\|im_end|>", "<\\\\\\|x", "a<", "<|im_start|>assistant\nok<|im_end|>\n", "\\", "\n", "é漢<|", "|>", "w " * 20_000]


def brute(rows, most=1):
    """(tree, rank, [(role, text)]) of the best branches, by walking up from every leaf."""
    nodes = list(range(len(rows)))
    at = {}
    for n in sorted(nodes, key=lambda n: (rows[n][3] or "", hashlib.sha256((rows[n][4] or "").encode()).hexdigest(), n)):
        if rows[n][1] is not None:
            at.setdefault((rows[n][0], rows[n][1]), n)
    up = {n: at.get((rows[n][0], rows[n][2])) if rows[n][2] is not None else None for n in nodes}
    for n in nodes:  # loops are cut at their first message
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is not None:
            loop = seen[seen.index(x) :]
            up[min(loop, key=lambda n: (rows[n][1] is not None, rows[n][1], n))] = None
    out = {}
    for leaf in set(nodes) - set(up.values()):
        path, x = [], leaf
        while x is not None:
            path.insert(0, x)
            x = up[x]
        mean = sum(rows[n][5] or 0.0 for n in path) / len(path)
        i = rows[leaf][1]
        out.setdefault(rows[leaf][0], []).append(((-mean, -len(path), i is None, i or 0), [(rows[n][3] or "", rows[n][4] or "") for n in path]))
    return {t: [p for _, p in sorted(v, key=lambda x: x[0])[:most]] for t, v in out.items()}


def read(spark, rows, most=1):
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)
    told = chat.formatted(df, most).withColumn("turns", chat.turns(F.col("formatted"))).withColumn("learned", chat.learned(F.col("formatted"), F.col("spans")))
    out = {}
    for r in sorted(told.collect(), key=lambda r: r["rank"]):
        assert r["learned"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        out.setdefault(r["tree_id"], []).append([(t["role"], t["text"]) for t in r["turns"]])
    return out


def test_odd_texts_and_roles_come_back(spark):
    roles = ["assistant", "user", "assistant", None, "sys\ntem\\n<|im_end|>\n"]
    rows = [(1, i, i - 1 if i else None, roles[i % 5], t, None) for i, t in enumerate(ODD)]
    rows += [(None, None, None, "assistant", "no ids", 1.0), (None, None, 7, "user", None, None)]
    assert read(spark, rows, 9) == brute(rows, 9)


@pytest.mark.parametrize("seed", range(2))
def test_trees_are_those_of_a_plain_walk(spark, seed):
    r = random.Random(seed)
    rows = []
    for tree in range(12):
        n = r.randrange(1, 25)
        for i in range(n):
            parent = r.choice([None, n + 5, r.randrange(n), r.randrange(n)]) if seed else (r.randrange(i) if i else None)
            rows.append((tree, i, parent, r.choice(["user", "assistant"]), f"{tree} {i}", r.choice([None, r.random(), r.random()])))
    rows += [(90, i, i - 1 if i else None, "assistant", f"deep {i}", 1.0) for i in range(70)]
    rows += [(91, i, 0 if i else None, "assistant", f"wide {i}", i / 7) for i in range(300)]
    for most in (1, 3):
        assert read(spark, rows, most) == brute(rows, most)


def test_loops_and_repeated_ids(spark):
    rows = [(1, 3, 5, "user", "in", 1.0), (1, 5, 4, "user", "in", 1.0), (1, 4, 3, "user", "in", 1.0), (1, 2, 5, "assistant", "hangs on", 1.0)]
    rows += [(2, 1, 1, "user", "itself", 0.0), (2, 9, 1, "assistant", "reply", 0.0), (3, 1, None, "user", "b", 0.0), (3, 1, None, "user", "a", 0.0), (3, 2, 1, "assistant", "to a", 0.0)]
    assert read(spark, rows, 4) == brute(rows, 4)
    assert len(read(spark, rows, 1)[3]) == 1


def test_empty(spark):
    assert read(spark, []) == {}


def test_rows_by_turn_with_ties_and_nulls(spark, monkeypatch):
    rows = [(1, 2, "assistant", "x"), (1, None, "user", None), (1, 2, "assistant", "x"), (1, 2, None, "r"), (None, 0, "user", "n"), (None, 1, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).withColumn("tie", F.lit(1))
    got = {r["tree_id"]: [tuple(t) for t in r["t"]] for r in chat.formatted(chat.replies(df)).withColumn("t", chat.turns(F.col("formatted"))).collect()}
    assert got == {1: [("user", ""), ("", "r"), ("assistant", "x"), ("assistant", "x")], None: [("user", "n"), ("assistant", "<|im_end|>")]}


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat.op12_reply_paths(spark, str(tmp_path))
    assert not any(w in out._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))
    assert sorted(r["n_turns"] for r in out.collect()) == [2, 2]
