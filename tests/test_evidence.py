"""Evidence budgets: bytes are those of the JSON, runs over budget are refused, envelopes are prefixes."""

import json

from pyspark.sql import functions as F

from vitrine.operators import evidence as B

PRODUCT = "struct<id:string,domain:string,name:string,category:string,source_url:string,observed_at:string,gtins:array<string>,sku:string,mpn:string,brand:string,prices:array<struct<raw:string,currency:string,amount:double,period:string>>>"


def product(i, **k):
    base = dict(id=i, domain="d", name="n", category="c", source_url="u", observed_at="t", gtins=None, sku=None, mpn=None, brand=None, prices=None) | k
    return tuple(base[f.split(":")[0]] for f in "id domain name category source_url observed_at gtins sku mpn brand prices".split())


def test_bytes_caps_and_refusals(spark):
    long = product("r2", name="  é   " * 90, category="saas-plan pro", gtins=["4006381333931", "bad", "4006381333931"], sku="s" * 200, brand="", prices=[("1 €", "EUR", 1.0, None), ("2 €", "EUR", 2.0, None)])
    primaries = spark.createDataFrame([(1, "a", product("a")), (1, "b", product(None)), (2, "c", product("c", name="x" * 100))], f"run int, primary_id string, product {PRODUCT}")
    matches = [(1, "a", "z", f"r{k}", float(k), False, True, product(f"r{k}")) for k in range(5)] + [(1, "a", "y", "r9", 0.0, True, True, long), (1, "a", "y", "r8", 9.0, True, False, long)]
    m = spark.createDataFrame(matches, f"run int, primary_id string, domain string, rival_id string, score double, exact boolean, eligible boolean, product {PRODUCT}")
    rows = {r["primary_id"]: r for r in B.evidence_rows(primaries, m, most_matches=3).collect()}
    assert all(r["bytes"] == len(r["json"].encode()) for r in rows.values()) and len(rows) == 3
    a = json.loads(rows["a"]["json"])
    assert [x["product"]["id"] for x in a["matches"]] == ["r2", "r4", "r3"] and [x.get("verdict") for x in a["matches"]] == [None, "close_substitute", "close_substitute"]
    first = a["matches"][0]["product"]
    assert len(first["name"]) == 120 and first["gtins"] == ["04006381333931"] and len(first["sku"]) == 100 and first["plan"] == "saas-plan pro" and len(first["prices"]) == 1 and "brand" not in first
    assert json.loads(rows["b"]["json"]) == {"primary": {"id": "", "domain": "d", "name": "n", "source_url": "u", "observed_at": "t"}, "matches": []}
    df = B.evidence_rows(primaries, m)
    budgets = {r["run"]: r for r in B.run_budgets(df).collect()}
    whole = {run: len(("[" + ",".join(r["json"] for r in df.collect() if r["run"] == run) + "]").encode()) for run in (1, 2)}
    assert {k: r["bytes"] for k, r in budgets.items()} == whole
    kept, refused = B.published(df, whole[2])
    assert {r["run"] for r in kept.collect()} == {2} and [(r["run"], r["bytes"]) for r in refused.collect()] == [(1, whole[1])]


def test_envelopes_of_a_hot_run_are_prefixes(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 5).alias("run"), F.col("id").alias("p"), (F.col("id") * 7 % 50 + 1).alias("bytes"))
    got = B.envelope(df, ["bytes", "p"], 400).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["run"], r["bytes"], r["p"])):
        total = by.get(r["run"], 1) + r["bytes"] + 1
        assert (r["end"], r["kept"]) == (total, total <= 400)
        by[r["run"]] = total
    assert len(got) == 3000
