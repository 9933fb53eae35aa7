import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from vitrine.operators import assignment as A
from vitrine.operators import catalog as C
from vitrine.operators import reports as R
from vitrine.operators import similarity as S
from vitrine.operators.aggregates import benchmark_row, region_votes
from vitrine.operators.chunks import bounded_chunks
from vitrine.sources import html as H
from vitrine.sources import sinks


def sequential(pairs):
    taken, used = [], set()
    for d, p, r, x in sorted(set(pairs), key=lambda x: (x[0], x[3] is None, -(x[3] or 0), x[1] or 0, x[2])):
        if p is not None and not {(d, "p", p), (d, "r", r)} & used:
            taken.append((d, p, r, x))
            used |= {(d, "p", p), (d, "r", r)}
    return sorted(taken, key=lambda x: x[:3])


def test_greedy_is_the_sequential_pass(spark):
    schema = "domain string, primary_id long, rival_id long, score double"
    for seed in (1, 2, 3):
        r = random.Random(seed)
        # Ties of all shapes: single pairs, blocks, blocks that share a side, and missing pairs in blocks.
        pairs = [(d, r.randrange(12), 100 + r.randrange(12), r.choice([0.5, 0.6, 0.7, None])) for d in ("a", "b") for _ in range(60)] + [("a", None, 3, 0.9)]
        pairs += [("c", p, q, 0.8 if (p < 5) == (q < 7) else 0.4) for p in range(12) for q in range(12)] + [("d", p, q, 0.5) for p in range(9) for q in range(6) if r.random() < 0.8]
        df = spark.createDataFrame(pairs, schema)
        want = sequential(pairs)
        for most in (0, 40, 2_000_000):
            assert sorted(map(tuple, A.greedy_assignment(df, most_pairs=most).collect()), key=lambda x: x[:3]) == want
    assert A.greedy_assignment(spark.createDataFrame([], schema)).collect() == []


def test_greedy_takes_blocks_of_ties_at_once(spark):
    n = 500
    ties = spark.range(n).select(F.col("id").alias("primary_id")).join(spark.range(n).select((F.col("id") * 3).alias("rival_id")), F.lit(True)).selectExpr("'a' AS domain", "primary_id", "rival_id", "0.7D AS score")
    for most in (2_000_000, 1000):
        got = A.greedy_assignment(ties, most_pairs=most).collect()
        assert sorted((r["primary_id"], r["rival_id"]) for r in got) == [(k, 3 * k) for k in range(n)]


def test_best_benefit_is_the_best():
    r = random.Random(2)
    for _ in range(150):
        edges = [(a, b, r.choice([0.2, 0.5, 1.0, 3.5])) for a in range(r.randint(1, 4)) for b in range(r.randint(1, 4)) if r.random() < 0.7]
        size = r.randint(1, 4)
        got = A.best_benefit(edges, size)
        assert len({edges[k][0] for k in got}) == len(got) == len({edges[k][1] for k in got})
        best = (0, 0.0)
        for n in range(1, size + 1):
            for c in itertools.combinations(edges, n):
                if len({e[0] for e in c}) == n == len({e[1] for e in c}):
                    best = max(best, (n, round(sum(e[2] for e in c), 9)))
        assert (len(got), round(sum(edges[k][2] for k in got), 9)) == best


def test_component_assignment_ignores_order(spark):
    rows = [(1, i, j, (i + j) % 2, (i * 7 + j * 3) % 10 / 10) for i in range(6) for j in range(5)]
    df = spark.createDataFrame(rows, "run long, row long, component long, exact int, score double")
    a, b = (A.component_assignment(d, target=4).collect() for d in (df, df.orderBy(F.rand())))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 4 and all(r["exact"] for r in a)


def test_component_assignment_cuts_lose_nothing(spark):
    """The benefit of a run is that of solving all its edges, though ranks cut most of them away."""
    r = random.Random(8)
    edges = {(row, c): (run, row, c, int(r.random() < 0.3), round(r.random(), 2)) for run in (1, 2) for row in range(run * 100, run * 100 + 30) for c in range(40) if r.random() < 0.6}
    df = spark.createDataFrame(list(edges.values()), "run long, row long, component long, exact int, score double")
    got = A.component_assignment(df, target=3, per_row=40).collect()
    for run in (1, 2):
        own = [(e[1], e[2], e[3] * 4 + e[4]) for e in edges.values() if e[0] == run]
        want = sum(own[k][2] for k in A.best_benefit(own, 3))
        assert abs(sum(x["exact"] * 4 + x["score"] for x in got if x["run"] == run) - want) < 1e-9


def test_identity_classes_follow_chains(spark):
    keys = [(i, f"k{i // 2}") for i in range(40)] + [(i, f"j{(i + 1) // 2}") for i in range(40)] + [(100, "z"), (None, "z")]
    got = {r["id"]: r["component"] for r in A.identity_classes(spark.createDataFrame(keys, "id long, key string")).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[100] == 100


def test_candidates_need_two_hits(spark):
    kind = "id long, name_tokens array<string>, gtins array<string>"
    p = spark.createDataFrame([(1, ["green", "kettle"], ["9"]), (2, ["mug"], [])], kind)
    r = spark.createDataFrame([(10, ["greens", "kettles"], []), (11, ["green", "greens"], []), (12, ["cup"], ["9"]), (13, ["kettle"], [])], kind)
    assert sorted(map(tuple, S.candidate_pairs(p, r).collect())) == [(1, 10, 2), (1, 12, 2)]


def product(name, **more):
    words = name.split()
    return {"name_tokens": words, "family_tokens": words, "category_tokens": ["tea"], "description_tokens": [], "image_tokens": None, "gtins": [], "quantity": None, "kind": "Product", "tier": None} | more


KIND = "struct<name_tokens:array<string>,family_tokens:array<string>,category_tokens:array<string>,description_tokens:array<string>,image_tokens:array<string>,gtins:array<string>,quantity:struct<kind:string,amount:double,unit:string>,kind:string,tier:string>"


def test_pair_scores(spark):
    cases = [
        (product("green tea"), product("green tea"), 0.76, True), (product("green tea"), product("green tea bags"), 0.76, True), (product("green tea"), product("black coffee"), 0.18, False),
        (product("green tea", gtins=["1"]), product("other name", gtins=["1"]), 0.18, True), (product("green tea", gtins=["1"]), product("green tea", gtins=["2"]), 0.76, False),
        (product("green tea", quantity=("mass", 1.0, "g")), product("green tea", quantity=("mass", 2.0, "g")), 0.76, False), (product("x", tier="free"), product("y", tier="free"), 0.72, True), (product("green tea"), product("green tea mug"), 0.76, False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], f"i int, p {KIND}, r {KIND}")
    got = [r["s"] for r in df.withColumn("s", S.pair_score(F.col("p"), F.col("r"))).orderBy("i").collect()]
    assert [(g["score"], g["eligible"]) for g in got] == [(s, e) for _, _, s, e in cases]


def test_region_votes(spark):
    rows = [("a", "US", "tld", "us"), ("a", "US", "language", "en_us"), ("a", "US", "language", "EN-US"), ("b", "US", "language", "en"), ("b", "DE", "language", "de"), ("c", "GLOBAL", "global-market", "x"), ("c", "FR", "phone", "+33"), ("d", "FR", "structured-address", "Paris")]
    got = {r["domain"]: (r["region"], r["confidence"]) for r in region_votes(spark.createDataFrame(rows, "domain string, country string, kind string, value string")).collect()}
    assert got == {"a": ("US", "High"), "b": ("Unknown", "Low"), "c": ("GLOBAL", "Medium"), "d": ("FR", "Medium")}


def test_benchmark_ignores_what_was_not_observed(spark):
    rows = [("a", 1, 7, True, True, True, 0, 0), ("a", 2, 0, False, False, False, 0, 0), ("b", 1, 1, False, True, False, 4, 1)]
    df = spark.createDataFrame(rows, "host string, ordinal int, product_links int, product_path boolean, language boolean, viewport boolean, images int, images_alt int")
    got = {r["host"]: (r["access_score"], r["alt_coverage"], r["mobile_score"]) for r in benchmark_row(df).collect()}
    assert got == {"a": (85, None, 100), "b": (12, 25, 29)}


def test_chunks(spark):
    facts = spark.createDataFrame([("a", i, b) for i, b in enumerate([4, 4, 4, 20, 1, 1])] + [("b", 0, None), (None, 1, 1)], "run string, ord int, bytes long")
    assert sorted(map(tuple, bounded_chunks(facts, 3, 10).collect())) == [("a", 0, 2, 8), ("a", 1, 1, 4), ("a", 2, 1, 20), ("a", 3, 2, 2), ("b", 0, 1, 0)]


def test_html_sources():
    page = '<!-- <meta name="a" content="no"> --><meta name="a" content="x > y"><script>"<meta name=b content=no>"</script><meta property=b content=yes>'
    assert H.metadata(page) == {"a": "x > y", "b": "yes"}
    found, broken = H.json_ld('<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"n","mainEntity":{"@type":"Service","name":"m"}}]}</script><script type="application/ld+json">{oops</script>')
    assert [n.get("name") for n in found] == [None, "n", "m"] and broken == 1


def test_robots(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /x\n\nUser-agent: vitrine\nDisallow: /y\nAllow: /y/*.html$\n"
    rules = H.robots_rules(spark.createDataFrame([("d", body)], "domain string, body string"), "vitrine")
    urls = spark.createDataFrame([("d", p) for p in ("/x", "/y", "/y/a.html", "/y/a.htmlx")] + [("e", "/")], "domain string, path string")
    assert {(r["domain"], r["path"]): r["allowed"] for r in H.robots_allowed(urls, rules).collect()} == {("d", "/x"): True, ("d", "/y"): False, ("d", "/y/a.html"): True, ("d", "/y/a.htmlx"): False, ("e", "/"): True}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    path = str(tmp_path / "facts")
    assert sinks.save_chunk(spark, df, path, "m", "products", 0) and not sinks.save_chunk(spark, df.orderBy(F.desc("id")), path, "m", "products", 0)
    assert sinks.save_chunk(spark, df.filter("id = 1"), path, "m", "products", 0) and spark.read.parquet(path).count() == 1
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, ord int")
    assert sorted(map(tuple, sinks.upserted(df, new, "id").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(r["v"] for r in sinks.new_rows(new, df, "id").collect()) == ["e"]
    good = '{"run_id":"%s","status":"done","created_at":"2024-01-01T00:00:00.000Z","document":"{}"}'
    (tmp_path / "s.json").write_text("\n".join([good % ("a" * 32), good % ("b" * 32), good % "short"]))
    fresh, bad = sinks.import_snapshot(spark, str(tmp_path / "s.json"), spark.createDataFrame([("b" * 32,)], "run_id string"))
    assert [r["run_id"][0] for r in fresh.collect()] == ["a"] and bad.count() == 1


def test_judge_batches_lose_no_pair(spark):
    import random

    r = random.Random(4)
    rows = [(run, k, r.choice([0, 1, 3, 8, 24, 25, 26, 60, 130])) for run in range(6) for k in range(40)]

    def packed(sizes, most_pairs, most_groups):
        units = [(k, 1) for k, n in enumerate(sizes) for _ in range(n)]
        done, batch = [], []
        for k, _ in units:
            if batch and (len(batch) == most_pairs or (batch[-1] != k and len(set(batch)) == most_groups)):
                done.append(batch)
                batch = []
            batch.append(k)
        return [(len(set(b)), len(b)) for b in done + [batch] * bool(batch)]

    want = [(run, k, *x) for run in range(6) for k, x in enumerate(packed([n for q, _, n in rows if q == run], 25, 6))]
    got = sorted(map(tuple, R.batches(spark.createDataFrame(rows, "run long, ord long, pairs long"), 25, 6).collect()))
    assert got == want and sum(x[3] for x in got) == sum(n for _, _, n in rows)


def test_running_sums_of_hot_keys(spark):
    from vitrine.operators.ordered import exact_percentiles, running_sum

    r = random.Random(4)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", i, r.randint(1, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "key string, id int, v int").repartition(5)
    got = {x["id"]: x["s"] for x in running_sum(df, ["key"], ["id"], F.col("v"), "s", parts=16).collect()}
    total = {}
    for key, i, v in rows:
        total[key] = total.get(key, 0) + v
        assert got[i] == total[key]
    p = {x["key"]: x for x in exact_percentiles(df, "key", "v", [0.5, 0.95]).collect()}
    for key in {x[0] for x in rows}:
        own = [v for k, _, v in rows if k == key]
        assert p[key]["n"] == len(own) and abs(p[key]["p0"] - np.quantile(own, 0.5)) < 1e-9 and abs(p[key]["p1"] - np.quantile(own, 0.95)) < 1e-9
    assert running_sum(df.filter("1 = 0"), ["key"], ["id"], F.col("v"), "s").collect() == []


def test_vectors_meet_in_blocks(spark):
    r = random.Random(6)
    vectors = [[r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(60)] + [None, [], [1.0], [0.0] * 4]
    rows = [(i, v, None if i % 5 == 0 else f"d{i % 3}") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, v array<double>, domain string")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        a, b = np.array(a), np.array(b)
        return np.floor(a / np.linalg.norm(a) @ (b / np.linalg.norm(b)) * 1e6 + 0.5) / 1e6

    want = set()
    for i, v, _ in rows[:20]:
        for d in {x[2] for x in rows}:
            own = sorted((-cosine(v, w), j) for j, w, e in rows if e == d and j != i)[:3]
            want |= {(i, d, j, n + 1) for n, (_, j) in enumerate(own)}
    for blocks in ((1024, 8192), (7, 11)):
        got = S.vector_top_k(df.filter("id < 20"), df, 3, "domain", *blocks).collect()
        assert {(x["primary_id"], x["domain"], x["rival_id"], x["rank"]) for x in got} == want


def test_a_frequent_token_sends_no_pairs_of_its_own(spark):
    r = random.Random(7)
    names = [["common", *{r.choice("abcdefghijklmnop") * 4 for _ in range(r.randint(0, 4))}] for _ in range(80)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name_tokens array<string>")
    p, q = df.filter("id < 30"), df.filter("id >= 30")
    got = {(x["primary_id"], x["rival_id"]): x["hits"] for x in S.candidate_pairs(p, q).collect()}
    hits = {(i, j): len(set(names[i]) & set(names[j])) for i in range(30) for j in range(30, 80)}
    assert got == {k: n for k, n in hits.items() if n >= 2}


def test_a_timer_tells_of_silent_runs(spark, tmp_path):
    """Files come one after the other: a run is told when the watermark passes its silence, once, and only if it isn't over."""
    from vitrine.streaming import events as V

    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    files = [[(1, 0, 1, "view"), (2, 0, 2, "view"), (3, 5, 3, "view")], [(4, 30, 1, "view"), (5, 31, 2, "purchase")], [(6, 200, 4, "view"), (7, 201, 1, "view")], [(8, 300, 5, "view")]]
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(i, minute(m), u, k) for i, m, u, k in rows], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [(r["user_id"], str(r["heartbeat"])) for r in V.finished(V.interrupted_runs(stream), "append").collect()]
    assert sorted(got) == [(1, minute(30)), (3, minute(5)), (4, minute(200))]


def test_bounded_documents_keep_head_tail_and_structured_data():
    block = '<script type="application/ld+json">{"name": "é"}</script>'
    html = "<p>" + "é" * 3000 + block + "ü" * 3000 + "</p>"
    short = H.bounded_document(html, 2000)
    assert len(short.encode()) <= 2000 and short.startswith("<p>é") and short.endswith("ü</p>") and block in short and "�" not in short
    assert H.bounded_document(html, 10**6) == html and len(H.bounded_document("x" * 5000, 5)) <= 1024


def test_greedy_by_class_is_the_pass_over_all_pairs(spark):
    r = random.Random(4)
    scores = [(f"p{a}", f"r{b}", r.choice([0.5, 0.6, 0.7, None])) for a in range(6) for b in range(6) if r.random() < 0.5]
    primary = [(i, f"p{r.randrange(6)}") for i in range(40)]
    # Ids beyond 2 ** 53 would be mixed up as doubles.
    rivals = [(2**60 + i, r.choice("ab"), f"r{r.randrange(7)}") for i in range(60)]
    pairs = [(d, p, q, s) for a, b, s in scores for p, pk in primary if pk == a for q, d, rk in rivals if rk == b]
    tables = spark.createDataFrame(scores, "pk string, rk string, score double"), spark.createDataFrame([*primary, (None, "p1")], "primary_id long, pk string"), spark.createDataFrame(rivals, "rival_id long, domain string, rk string")
    for most in (2_000_000, 3):
        assert sorted(map(tuple, A.greedy_by_class(*tables, most_pairs=most).collect()), key=lambda x: x[:3]) == sequential(pairs)


def test_greedy_by_class_lists_no_pairs(spark):
    """A class of 20,000 a side has 400 million pairs."""
    n = 20_000
    primary, rivals = spark.range(n).selectExpr("id AS primary_id", "'x' AS pk"), spark.range(n).selectExpr("id AS rival_id", "'d' AS domain", "'y' AS rk")
    got = A.greedy_by_class(spark.createDataFrame([("x", "y", 0.8)], "pk string, rk string, score double"), primary, rivals)
    assert got.filter("primary_id = rival_id AND score = 0.8").count() == got.count() == n


def test_classes_expand_to_every_pair_once(spark):
    pairs = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("b", "y", 4)], "pk string, rk string, hits long")
    primary, rivals = spark.range(50).selectExpr("id AS primary_id", "if(id < 30, 'a', 'b') AS pk"), spark.range(70).selectExpr("100 + id AS rival_id", "element_at(array('x', 'y', 'z'), int(id % 3) + 1) AS rk")
    got = sorted(map(tuple, S.expanded(pairs, primary, rivals, primary_block=7, rival_block=5).collect()))
    hits = {("a", 0): 2, ("a", 1): 3, ("b", 1): 4}
    assert got == sorted((p, 100 + r, hits[k, r % 3]) for p in range(50) for r in range(70) if (k := "a" if p < 30 else "b", r % 3) in hits)


def test_key_pairs_come_once_without_a_distinct(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (3, None), (None, "a")], "id long, key string")
    r = spark.createDataFrame([(10, "a"), (10, "b"), (10, "c"), (11, "b"), (11, "b"), (12, "z"), (13, None)], "id long, key string")
    got = C.key_pairs(p, r)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (2, 10), (2, 11)]
    # Aggregations are of products by their id alone, never of pairs.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [id#") == plan.count("Aggregate [") == 2


def test_component_edges_are_the_best_of_all_pairs(spark):
    """Each row's best edge of a component by (exact, score), and per_row of these, whether made by class or by pair."""
    r = random.Random(5)
    scores = [(f"p{a}", f"r{b}", r.randint(0, 1), r.choice([0.3, 0.5, 0.8])) for a in range(4) for b in range(8) if r.random() < 0.7]
    rows = [(i % 2, i, f"p{r.randrange(4)}") for i in range(20)]
    rivals = [(r.randrange(5), f"r{r.randrange(8)}") for _ in range(40)]
    got = A.component_edges(spark.createDataFrame(scores, "pk string, rk string, exact int, score double"), spark.createDataFrame(rows, "run long, row long, pk string"), spark.createDataFrame(rivals, "component long, rk string"), per_row=3)
    want = []
    for run, row, pk in rows:
        best = {}
        for a, rk, exact, score in scores:
            for c, k in rivals:
                if a == pk and k == rk:
                    best[c] = max(best.get(c, (-1, 0.0)), (exact, score))
        want += [(run, row, c, *e) for c, e in sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:3]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
