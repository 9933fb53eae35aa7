"""Page identities and live identities against plain walks."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import live_identity as L
from vitrine.operators import page_identity as I


def test_page_keys(spark):
    cases = {
        "HTTPS://Shop.Example:443/A/b//?b=2&utm_source=x&a=1&a=0#f": "https://shop.example/A/b?a=0&a=1&b=2",
        "http://shop.example:80": "http://shop.example/",
        "http://shop.example:8080/?q=a%20b&gclid=1": "http://shop.example:8080/?q=a+b",
        "https://shop.example/p?x=%zz&UTM_x=1": "https://shop.example/p?x=%25zz",
        "https://other.example/p": "",
        "ftp://shop.example/p": "",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(u, w) for u, w in cases.items()], "u string, w string").withColumn("k", I.page_key(F.col("u"), F.lit("www.shop.example")))
    assert [(r["u"], r["k"]) for r in df.collect()] == list(cases.items())


def test_redirected_products_keep_their_words(spark):
    at = lambda p: f"https://shop.example{p}"
    cases = [
        (at("/en-us/products/red-tea-pot"), at("/fr/produits/Réd-tea-pot"), True),
        (at("/products/red-tea-pot"), at("/products/red-tea"), True),
        (at("/products/red-tea-pot"), at("/products/blue-tea-cup"), False),
        (at("/products/tea"), at("/shop/tea"), True),
        (at("/products/"), at("/products/tea"), False),
        (at("/products/red-tea-pot"), "https://else.example/products/red-tea-pot", False),
        (None, at("/x"), False),
    ]
    df = spark.createDataFrame(cases, "a string, b string, w boolean")
    assert all(bool(r["x"]) == r["w"] for r in df.withColumn("x", I.same_redirected_product(F.col("a"), F.col("b"), F.lit("shop.example"))).collect())


def walk(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            to.setdefault(a, set()).add(b)
    out = {}
    for a in to:
        at, hops, seen = a, 0, set()
        while at in to and len(to[at]) == 1 and at not in seen:
            seen.add(at)
            at, hops = next(iter(to[at])), hops + 1
        out[a] = (at, hops, "conflict") if at in to and len(to[at]) > 1 else (None, None, "loop") if at in seen else (at, hops, "ok")
    return out


@pytest.mark.parametrize("seed", range(2))
def test_redirects_end_where_a_walk_ends(spark, seed):
    r = random.Random(seed)
    edges = [(f"k{i}", f"k{r.randrange(120)}") for i in range(100) if r.random() < 0.8] + [(f"c{i}", f"c{i + 1}") for i in range(70)]
    edges += r.sample(edges, 20) + [("k1", "k2"), ("s", "s"), (None, "k1"), ("k1", None), ("l1", "l2"), ("l2", "l1"), ("t", "l1")] + [(f"h{i}", "c0") for i in range(300)]
    got = {x["key"]: (x["end"], x["hops"], x["state"]) for x in I.redirect_ends(spark.createDataFrame(edges, "key string, target string")).collect()}
    assert got == walk(edges)
    assert I.redirect_ends(spark.createDataFrame([], "key string, target string")).collect() == []


def test_fingerprints_ignore_order_but_not_values(spark):
    kind = "normalized_name string, name string, quantity string, gtins array<string>, sku string, mpn string, brand string, prices array<struct<amount:double,currency:string,period:string>>, attributes array<string>"
    base = ("tea", "Tea", None, ["2", "1"], None, "", "b", [(1.0, "usd", None), (2.0, "EUR", "")], [" B", "a", ""])
    same = ("", "TEA", None, ["1", "2"], "", None, "b", [(2.0, "eur", None), (1.0, "USD", "")], ["A", "b"])
    other = [(*base[:k], v, *base[k + 1 :]) for k, v in ((0, "coffee"), (2, "g|1"), (3, ["1"]), (4, "s"), (7, [(1.0, "USD", None)]), (8, None))]
    df = spark.createDataFrame([base, same, *other], kind).select(I.fingerprint(F.struct("*")).alias("f"))
    f = [r["f"] for r in df.collect()]
    assert f[0] == f[1] and len(set(f)) == 1 + len(other)


def brute(products):
    """Kruskal over the same links, one after the other, with classes as plain lists."""
    clean = [(i, m, n or "", tuple(sorted({g for g in gs or [] if g is not None})), q) for i, m, n, gs, q in products]
    node = {}
    for i, m, n, gs, q in clean:
        node.setdefault((m, gs, q, "" if gs else n), []).append(i)
    of = {i: min(v) for v in node.values() for i in v}
    links, groups = {}, {}

    def link(kind, a, b):
        a, b = sorted((a, b))
        if a != b:
            links[a, b] = min(kind, links.get((a, b), 9))

    for i, m, n, gs, q in clean:
        for g in gs:
            groups.setdefault((m, g), {}).setdefault(q, set()).add(of[i])
    for by in groups.values():
        ranked = {q: sorted(v) for q, v in by.items()}
        for v in ranked.values():
            for k in range(2, len(v) + 1):
                link(0, v[k // 2 - 1], v[k - 1])
        for q, v in ranked.items():
            if q is not None and None in ranked:
                link(2, v[0], ranked[None][0])
    for x, y in itertools.product(clean, clean):
        if x[3] and not y[3] and (x[1], x[2], x[4]) == (y[1], y[2], y[4]):
            link(1, of[x[0]], of[y[0]])
    facts = {of[i]: (q, set(gs)) for i, _, _, gs, q in clean}
    cls = {n: [n] for n in facts}
    for (a, b), kind in sorted(links.items(), key=lambda x: (x[1], hashlib.md5(f"{x[0][0]}|{x[0][1]}".encode()).hexdigest())):
        if cls[a] is not cls[b] and not any(conflict(facts[x], facts[y]) for x in cls[a] for y in cls[b]):
            cls[a].extend(cls[b])
            for n in cls[b]:
                cls[n] = cls[a]
    return {i: min(cls[of[i]]) for i in of}


def conflict(a, b):
    return (a[0] is not None and b[0] is not None and a[0] != b[0]) or bool(a[1] and b[1] and not a[1] & b[1])


@pytest.mark.parametrize("most_part", [3, 50_000])
def test_live_classes_are_the_sequential_ones_without_conflicts(spark, most_part):
    r = random.Random(most_part)
    rows = [
        (i, r.choice(["m1", "m2", None]), r.choice(["tea", "pot", None, ""]), r.choice([None, [], [f"g{r.randrange(9)}"], [f"g{r.randrange(9)}", f"g{r.randrange(9)}", None]]), r.choice([None, None, "1 kg", "2 kg"]))
        for i in range(150)
    ]
    rows += [(1000 + i, "m3", f"n{i}", ["hot", f"x{i}"], None if i % 9 else "1 kg") for i in range(60)]
    kind = "id long, market string, name string, gtins array<string>, quantity string"
    got = {x["id"]: x["class_id"] for x in L.live_classes(spark.createDataFrame(rows, kind), most_part=most_part).collect()}
    assert got == brute(rows)
    facts = {i: (q, {g for g in gs or [] if g}) for i, _, _, gs, q in rows}
    by = {}
    for i, c in got.items():
        by.setdefault(c, []).append(i)
    assert not any(conflict(facts[a], facts[b]) for v in by.values() for a, b in itertools.combinations(v, 2)) and len(by) > 20


def test_no_rows(spark):
    assert L.live_classes(spark.createDataFrame([], "id long, market string, name string, gtins array<string>, quantity string")).collect() == []


def test_every_target_has_one_outcome(spark):
    from vitrine.operators import enrichment as E

    target = lambda i, path, score=1.0, **k: (i, "shop.example", f"https://shop.example{path}" if path.startswith("/") else path, f"n{i}", score, "SA", "", k.get("swap", False))
    page = lambda path, final="", name=None, amount=None, currency="USD", endpoint="", robots="allowed", status=200, market="", image=None: (
        f"https://shop.example{path}", f"https://shop.example{final}" if final else "", robots, status, market, name, amount, currency, image, f"https://shop.example{endpoint}" if endpoint else "",
    )
    targets = [target(1, "/p/1"), target(2, "/p/2"), target(3, "/p/3"), target(4, "/p/4"), target(5, "/p/5"), target(6, "/p/6", 0.5), target(7, "https://else.example/p"), target(8, "/p/1?utm_x=1"), target(9, "/p/9"), target(10, "/p/10", 0.1)]
    pages = [page("/p/1", name="n1", amount=2.0, image="https://i/1"), page("/p/2", "/p/2b"), page("/p/2b", "/p/2c"), page("/p/2c", "/p/2d"), page("/p/2d", "/p/2e"), page("/p/3", "/p/3b"), page("/p/3b", "/p/3")]
    pages += [page("/p/4", name="n4", amount=1.0, currency="USD", endpoint="/a/4"), page("/a/4", name="n4", amount=1.0, currency="EUR", image="https://i/4"), page("/p/5", name="n5", amount=-1.0, endpoint="/a/5"), page("/a/5", name="n5", amount=3.0)]
    pages += [page("/p/9", name="n9", amount=4.0, endpoint="/p/9", image="http://i"), page("/p/6", name="n6", amount=1.0), page("/p/1", name="zz", amount=9.0)]
    t = spark.createDataFrame(targets, "target_id long, domain string, url string, name string, score double, country string, market string, replaceable boolean")
    p = spark.createDataFrame(pages, "url string, final_url string, robots string, status int, market string, product_name string, amount double, currency string, image string, endpoint string")
    found, ledger = E.enriched(t, p, lambda a, b: a == b, most_pages=7, most_rounds=4)
    said = {r["target_id"]: (r["round"], r["reason"]) for r in ledger.collect()}
    assert ledger.count() == len(targets) == len(said)
    assert said == {1: (1, "enriched"), 2: (4, "out_of_rounds"), 3: (2, "redirect_loop"), 4: (2, "price_conflict"), 5: (2, "enriched"), 6: (1, "enriched"), 7: (0, "bad_url"), 8: (1, "identity_mismatch"), 9: (1, "enriched"), 10: (0, "over_budget")}
    products = {r["target_id"]: tuple(r)[1:] for r in found.collect()}
    assert products[4] == ("n4", 1.0, "USD", "https://i/4", E.CONFLICTS["currency"]) and products[5][:3] == ("n5", 3.0, "USD") and set(products) == {1, 4, 5, 6, 9}
    assert E.enriched(t.filter("1 = 0"), p, lambda a, b: a == b)[1].collect() == []
