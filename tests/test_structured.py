"""Depth-bounded walks, offers and price namespaces against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vitrine.sources import structured as S


def values(r, depth):
    if depth == 0 or r.random() < 0.2:
        return r.choice([1, "x", None, True, 2.5])
    if r.random() < 0.4:
        return [values(r, depth - 1) for _ in range(r.randrange(4))]
    return {k: values(r, depth - 1) for k in r.sample(["@graph", "mainEntity", "itemListElement", "other", "urls", "name"], r.randrange(1, 4))}


def records(v, path, depth, keys):
    """(path, name, deep) of the records down to depth containers."""
    inside = v if isinstance(v, list) else [v[k] for k in keys if k in v] if isinstance(v, dict) else []
    if depth == 0:
        return [(path, None, True)] if inside else [(path, v.get("name") if isinstance(v.get("name"), str) else None, False)] if isinstance(v, dict) else []
    own = [(path, v.get("name") if isinstance(v.get("name"), str) else None, False)] if isinstance(v, dict) else []
    return own + [x for i, c in enumerate(inside) for x in records(c, [*path, i], depth - 1, keys)]


def texts(v, path, depth, key):
    if depth > 8 or not isinstance(v, (list, dict)):
        return []
    if isinstance(v, dict) and isinstance(v.get(key), list):
        said = [json.dumps(x, separators=(",", ":"), sort_keys=True) if isinstance(x, (list, dict)) else str(x).lower() if isinstance(x, bool) else str(x) for x in v[key] if x is not None and x != ""]
        return [(path, list(dict.fromkeys(said)))] if said else []
    inside = v if isinstance(v, list) else [v[k] for k in sorted(v)]
    return [x for i, c in enumerate(inside) for x in texts(c, [*path, i], depth + 1, key)]


@pytest.mark.parametrize("depth", [1, 3, 8])
def test_walks_are_plain_recursion(spark, depth):
    r = random.Random(depth)
    docs = [values(r, 7) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string").select("id", F.try_parse_json("j").alias("v"), F.lit("clash").alias("n"))
    walked = S.walk(df, "v", S.RECORD_KEYS, depth)
    got = sorted((x["id"], x["path"], None if x["deep"] else x["name"], x["deep"]) for x in walked.select("id", "path", "deep", F.when(F.schema_of_variant(S.at(F.col("v"), "$.name")) == "STRING", S.at(F.col("v"), "$.name", "string")).alias("name")).collect())
    want = sorted((i, p, n, d) for i, doc in enumerate(docs) for p, n, d in records(doc, [], depth, S.RECORD_KEYS))
    assert got == want


def test_texts_under_a_key(spark):
    r = random.Random(5)
    docs = [values(r, 12) for _ in range(80)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string").select("id", F.try_parse_json("j").alias("v"))
    got = sorted((x["id"], x["path"], x["texts"]) for x in S.find_texts(df, "v", "urls").collect())
    assert got == sorted((i, p, t) for i, d in enumerate(docs) for p, t in texts(d, [], 0, "urls")) and got


def test_namespaces_do_not_depend_on_order_or_repetition(spark):
    r = random.Random(2)
    rows = [(page, f"{ns}:{what}", r.choice(["1", "2", "3", "x"] if what == "amount" else ["USD", "usd", "EUR", "XXQ"])) for page in range(40) for ns, _ in S.NAMESPACES for what in ("amount", "currency") for _ in range(r.randrange(3))]
    kind = "page_id int, key string, content string"
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        some = rows + rows[:50] * seed
        got = sorted(map(tuple, S.namespace_offers(spark.createDataFrame(some, kind).repartition(1 + 3 * seed)).collect()), key=str)
        want = want or got
        assert got == want and len({x[-1] for x in got}) == 4


def test_odd_pages(spark):
    ld = lambda o: '<script type="application/ld+json">' + (o if isinstance(o, str) else json.dumps(o)) + "</script>"
    pages = [(1, None, None), (2, "https://a.b/p", ""), (3, "https://a.b/p", ld("{bad") + ld("null") + ld("[]") + ld({"@type": "Product"})), (4, "https://a.b/p", "<!--" + ld({"@type": "Product", "name": "gone"}) + "-->")]
    pages += [(5, "https://a.b/p", ld({"@type": "Product", "name": "a"}) + ld({"@type": ["x", "Product"], "name": ["A", "B"], "brand": {"name": "z"}})), (None, "https://a.b/p", ld({"@type": "Service", "headline": "s"}))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((str(x["page_id"]), x["source"], x["kind"], x["name"]) for x in S.page_products(df, F.lit("2025-01-01").cast("timestamp")).collect())
    assert got == [("5", "json-ld", "Product", "A"), ("None", "json-ld", "Service", "s")]
    assert S.page_products(df.filter("1 = 0"), F.lit("2025-01-01").cast("timestamp")).collect() == []
