"""What a query does must not be one task's work, nor be done again for each round, rule or sample."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitrine import plans
from vitrine.operators import evidence as B
from vitrine.operators import page_identity as I
from vitrine.operators import similarity as S
from vitrine.plans import enrichment_queries as Q
from vitrine.plans import product_queries as P
from vitrine.sources import contracts as C
from vitrine.streaming import triggers as G

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def counted(monkeypatch, module):
    """What a module stores, by name."""
    seen, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, what: seen.append(what) or real(df, what))
    return seen


@needs_tables
def test_dear_rows_of_a_small_file_are_dealt_to_all_cores(spark):
    least = spark.sparkContext.defaultParallelism
    assert plans.QUERIES["ad_identities"](spark, SF).rdd.getNumPartitions() >= least


@needs_tables
def test_pages_of_a_small_file_are_dealt_to_all_cores(spark):
    least = spark.sparkContext.defaultParallelism
    made = [Q.product_pages(spark, SF), *Q.shop_pages(spark, SF)]
    assert all(df.rdd.getNumPartitions() >= least for df in made)


def test_redirects_that_go_round_do_not_add_rounds(spark, monkeypatch):
    edges = [("l1", "l2"), ("l2", "l1"), *((f"k{i}", f"e{i}") for i in range(5000))]
    rounds = counted(monkeypatch, I)
    got = {r["key"]: r["state"] for r in I.redirect_ends(spark.createDataFrame(edges, "key string, target string")).collect()}
    assert len(got) == 5002 and {k for k, s in got.items() if s == "loop"} == {"l1", "l2"}
    assert rounds.count("hops") <= 3


def test_triggers_use_their_state_once_for_all_changes_of_an_evaluation():
    class Handle:
        calls, timers, row = [], [], None

        def getValueState(self, *a):
            return self

        def get(self):
            self.calls.append("get")
            return self.row

        def update(self, row):
            self.calls.append("update")
            self.row = row

        def registerTimer(self, at):
            self.timers.append(at)

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, at):
            self.timers.remove(at)

    handle, t = Handle(), G.Triggers(60)
    t.init(handle)
    change = lambda seq, what, status=None, receipt=None: Row(seq=seq, change=what, status=status, receipt=receipt, ms=seq)
    told = lambda rows: [(r["seq"], r["effect"]) for r in t.handleInputRows((7,), iter(rows), None)]
    first = [change(1, "insert", "dispatching"), change(3, "receipt", receipt="a"), change(2, "update", "complete"), change(4, "receipt", receipt="a")]
    assert told(first) == [(1, "applied"), (2, "applied"), (2, "outbox"), (3, "acknowledged"), (4, "refused")]
    assert handle.calls == ["get", "update"] and handle.timers == []
    handle.row, handle.calls = None, handle.calls[:0]
    assert told(first[:1] + first[2:3]) == [(1, "applied"), (2, "applied"), (2, "outbox")] and handle.timers == [2 + 3_600_000]
    assert told([change(5, "receipt", receipt=None), change(6, "receipt", receipt=None)]) == [(5, "acknowledged"), (6, "refused")] and handle.timers == []


def test_contracts_tell_the_kind_of_scalars_alone(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "object"}}}}}}
    made = spark.range(1).select(C.violations(F.parse_json(F.lit("{}")), schema).alias("x"))
    assert "schema_of_variant" not in made._jdf.queryExecution().analyzed().toString().lower()
    assert [tuple(v) for v in made.first()["x"]] == [("/a", "required")]


def test_rows_of_an_envelope_are_made_once(spark, monkeypatch):
    stored = counted(monkeypatch, B)
    rows = spark.range(10).select(F.lit(1).alias("run"), F.col("id").alias("p"), F.lit(1).alias("bytes"))
    assert B.envelope(rows, ["p"], 9).filter("kept").count() == 4 and stored == ["rows"]


@needs_tables
def test_leads_of_a_small_file_are_dealt_to_all_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.I, "lead_verdicts", lambda leads, *a, **k: seen.append(leads) or leads.selectExpr("lead_id", "'' AS verdict", "'' AS rival_id"))
    plans.QUERIES["lead_verification"](spark, SF)
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pairs_of_large_classes_are_unfolded_by_all_cores(spark):
    """One pair of classes of 3,000 members a side has nine million pairs: no task makes more than a tenth of them."""
    n = 3_000
    pairs = spark.createDataFrame([("x", "y", 2)], "pk string, rk string, hits long")
    primary, rivals = spark.range(n).selectExpr("id AS primary_id", "'x' AS pk"), spark.range(n).selectExpr("id AS rival_id", "'y' AS rk")
    tasks = S.expanded(pairs, primary, rivals).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum("primary_id").alias("p"), F.sum("rival_id").alias("r")).collect()
    assert sum(t["n"] for t in tasks) == n * n and max(t["n"] for t in tasks) < n * n / 10
    assert sum(t["p"] for t in tasks) == sum(t["r"] for t in tasks) == n * sum(range(n))


def test_scored_pairs_of_large_classes_are_unfolded_by_all_cores(spark, tmp_path):
    """Products of one name and type are one class a side; pairs of 1,500 by 3,000 are dealt out with their score."""
    part = spark.range(4_500).selectExpr("id AS p_partkey", "'large ring' AS p_name", "if(id < 1500, 'Brand#1', 'Brand#2') AS p_brand", "'LARGE' AS p_type", "1.0D AS p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    df = plans.QUERIES["pair_score_eligible"](spark, str(tmp_path)).filter("score = 0.76 AND eligible")
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum("primary_id").alias("p")).collect()
    assert sum(t["n"] for t in tasks) == 4_500_000 and max(t["n"] for t in tasks) < 450_000
    assert sum(t["p"] for t in tasks) == 3_000 * sum(range(1_500))


def test_tokens_of_names_are_made_once_for_each_name_and_type(spark, tmp_path, monkeypatch):
    """510 products of five names and types: tokens are made of five rows, and nulls and accents find their class."""
    kinds = [("Brand#1", "large ring", "LARGE", 100), ("Brand#2", "large ring", "LARGE", 200), ("Brand#2", "Largé Ríng", "LARGE", 60), ("Brand#2", "large ring", None, 50), ("Brand#2", None, "LARGE", 50), ("Brand#2", "small cup", "SMALL", 50)]
    names = spark.createDataFrame(kinds, "p_brand string, p_name string, p_type string, n int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    names.select(F.xxhash64("p_brand", "p_name", "p_type", "i").alias("p_partkey"), "p_name", "p_brand", "p_type", F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    made, real = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, what: made.append((df.columns, t := real(df, what))) or t)
    df = plans.QUERIES["pair_score_eligible"](spark, str(tmp_path))
    assert {t.count() for columns, t in made if "name_tokens" in columns} == {4, 5}  # four classes of five names and types
    got = {(r["score"], r["eligible"]): (r["n"], r["p"], r["r"]) for r in df.groupBy("score", "eligible").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("primary_id").alias("p"), F.countDistinct("rival_id").alias("r")).collect()}
    assert got == {(0.76, True): (26_000, 100, 260), (0.58, True): (5_000, 100, 50)}


def test_names_in_ascii_start_no_python(spark):
    plan = lambda name: P.described(spark.createDataFrame([("x ring", "t"), (name, "t")], "p_name string, p_type string"), "p_name")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan("large ring") and "ArrowEvalPython" in plan("ríng")


def test_bytes_of_evidence_move_no_texts(spark):
    """Matches become JSON below the window, and who asks for bytes alone moves and lists lengths alone."""
    product = "named_struct('id', 'i', 'domain', 'd', 'name', string(id), 'category', 'c', 'source_url', 'u', 'observed_at', 't', 'gtins', array('x'), 'sku', 's', 'mpn', 'm', 'brand', 'b', 'prices', array(named_struct('raw', 'r', 'currency', 'EUR', 'amount', 1.0D, 'period', 'p')))"
    matches = spark.range(40).selectExpr("id % 2 AS run", "id % 8 AS primary_id", "'d' AS domain", "string(id) AS rival_id", "id AS score", "id % 3 = 0 AS exact", "id % 5 > 0 AS eligible", f"{product} AS product")
    rows = B.evidence_rows(spark.range(9).selectExpr("id % 2 AS run", "id AS primary_id", f"{product} AS product"), matches, 3)
    budgets = B.run_budgets(rows)
    plan = budgets._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "StructsToJson" in plan.split("Window [row_number")[1]
    sizes = [(r["run"], len(r["json"].encode()), r["bytes"]) for r in rows.collect()]
    assert len(sizes) == 9 and all(a == b for _, a, b in sizes)
    assert {r["run"]: r["bytes"] for r in budgets.collect()} == {k: sum(b + 1 for run, b, _ in sizes if run == k) + 1 for k in (0, 1)}
