import random
from dataclasses import replace

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vitrine.llm import simhash as S
from vitrine.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, radius=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_spark_hash_is_the_same(spark):
    r = spark.sql("SELECT xxhash64('a b c') AS h").first()["h"]
    assert r & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_fingerprints(odd_docs):
    rows = S.near_duplicates(odd_docs).collect()
    source = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    want = {(r["doc_id"], plain(r["text"])) for r in source if (r["text"] or "") != "" and len(r["text"]) < 1000}
    got = {(r["doc_id"], r["fp"] & (2**64 - 1)) for r in rows}
    assert want <= got
    by = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == 5


def test_empty(no_docs):
    assert S.near_duplicates(no_docs).collect() == []


def test_thresholds_are_a_pigeonhole():
    r = np.random.default_rng(3)
    fp = r.integers(0, 2**63, 500).astype(np.uint64)
    counts = np.stack([np.bincount(((fp >> np.uint64(8 * b)) & np.uint64(255)).astype(int), minlength=256) for b in range(8)])
    for layout in S.LAYOUTS.values():
        t, cost = S.allocate(fp, layout, S.distance_shares(counts), 500, 3)
        assert (t.sum(axis=1) == 3 - len(layout) + 1).all() and t.min() >= -1 and np.isfinite(cost).all()


def clustered(seed, n):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        c = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 8])):
            out.append(c)
            for b in r.sample(range(64), r.randint(0, 4)):
                c ^= 1 << b
    return out[:n]


def links(spark, fps):
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in sorted(set(fps))], "fp long")
    return S.fingerprint_links(df)


def test_links_join_all_neighbours(spark, monkeypatch):
    for hot, layouts in ((64, S.LAYOUTS), (0, S.LAYOUTS), (2, {2: (4, 4)}), (1, {3: (3, 3, 2)})):
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "BLOCK", 4)
        monkeypatch.setattr(S, "LAYOUTS", layouts)
        fps = sorted(set(clustered(hot, 300)))
        roots = {r["node"] & (2**64 - 1): r["root"] for r in components(links(spark, fps), "a", "b").collect()}
        label = brute(fps)
        groups = {}
        for f, x in zip(fps, label):
            groups.setdefault(x, []).append(f)
        for g in groups.values():
            assert len({roots.get(f) for f in g}) == 1 or len(g) == 1
        for a, b in ((a, b) for a in groups for b in groups if a < b):
            ra, rb = roots.get(groups[a][0]), roots.get(groups[b][0])
            assert ra is None or ra != rb


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 40)) and got[500] == got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_same_result_on_other_partitions(spark):
    df = spark.createDataFrame([(i, f"some words for document {i // 2} and a few more of them") for i in range(60)], "doc_id long, text string")
    a = sorted(map(tuple, S.near_duplicates(df).collect()))
    assert a == sorted(map(tuple, S.near_duplicates(df.repartition(7, F.rand())).collect()))


def test_wider_radius_links_similar_texts_only(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(r.choice([60, 150, 300]))]
        texts.append(" ".join(words))
        for changes in r.sample([1, 2, 4, 12, 40], 2):
            copy = list(words)
            for k in r.sample(range(len(copy)), min(changes, len(copy))):
                copy[k] = word()
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [S.fingerprint(t) for t in texts]
    words = [S.fingerprint(t, 1, True) for t in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            d, w, shared = (fps[i] ^ fps[j]).bit_count(), (words[i] ^ words[j]).bit_count(), len(sets[i] & sets[j])
            if d <= 3 or (w <= 7 and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {x["doc_id"]: x["component_id"] for x in S.near_duplicates(df, wide=7).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) < len(texts)


def test_neighbours_are_all_pairs_of_different_roots(spark, monkeypatch):
    fps = sorted({f - 2**64 if f >> 63 else f for f in clustered(5, 250)} | {k * 5 for k in range(60)})
    root = {f: f if f % 3 else 7 for f in fps}
    rows = sorted(root.items()) + [(f, f + 1) for f in fps[:20]]
    near = {(a, ra, b, rb) for a, ra in rows for b, rb in rows if ra != rb and ((a ^ b) & (2**64 - 1)).bit_count() <= 7}
    want = {x for x in near if x[:2] < x[2:]}
    nodes = spark.createDataFrame(rows, "fp long, root long")
    plan = S.planned(nodes, 7)
    entries = S.postings(nodes, plan).persist()
    for block, at_once in ((2048, 1 << 21), (8, 50)):
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "AT_ONCE", at_once)
        every = S.neighbours(entries, plan, None)
        assert every.count() == every.select("a", "ra", "b", "rb").distinct().count() == len(near)
        got = S.unordered(every, "", "r").collect()
        assert {(r["a"], r["ra"], r["b"], r["rb"]) for r in got} == want and len(want) > 500
        few = S.neighbours(entries, plan, 2).collect()
        assert {(r["a"], r["ra"], r["b"], r["rb"]) for r in few} <= near
        # Who names fewer than it has says so; all pairs with an end that doesn't are there.
        done = {x[:2] for x in near} - {(r["a"], r["ra"]) for r in few if r["k"] > 2}
        named = {(r["a"], r["ra"], r["b"], r["rb"]) for r in few}
        assert {x for x in near if x[:2] in done} <= named and len(done) > 20


def test_a_text_is_sent_to_few_cells_at_the_size_of_millions(spark, monkeypatch):
    """The plan of 2,440,000 texts: a probe each would be some 700 rows a text; cells are few, and give all pairs."""
    fps = sorted({f - 2**64 if f >> 63 else f for f in clustered(21, 200)})
    nodes = spark.createDataFrame([(f, f) for f in fps], "fp long, root long")
    near = {(a, b) for a in fps for b in fps if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 7}
    plan = replace(S.planned(nodes, 7), n=2_440_000, layout=(3, 3, 2))
    assert S.postings(nodes, plan).count() < 70 * len(fps)
    monkeypatch.setattr(S, "BLOCK", 1)
    for bits in (0, 6, 20):
        entries = S.postings(nodes, replace(plan, cell_bits=bits)).persist()
        got = [(r["a"], r["b"]) for r in S.neighbours(entries, replace(plan, cell_bits=bits), None).collect()]
        assert len(got) == len(set(got)) and set(got) == near and len(near) > 100


def test_rows_that_are_surely_kept_do_not_move(spark, monkeypatch):
    rows = [(i, f"text {i // 2 if i < 60 else i} of words that repeat in pairs", "x") for i in range(400)] + [(5, "again", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    moved = S.may_be_among(df.select("*", *S.row_key(df)), df.filter("doc_id = 7").select(S.row_key(df)[0]), F.col("k1")).filter("__among").select(*df.columns).collect()
    assert tuple(rows[7]) in {tuple(r) for r in moved} and len(moved) < 5
    want = sorted(map(str, S.representatives(df, wide=7).collect()))
    for places in (6, 9):
        monkeypatch.setattr(S, "PLACES", places)
        assert sorted(map(str, S.representatives(df, wide=7).collect())) == want


def test_similar_pairs_of_a_dense_value_are_all_compared(spark, monkeypatch):
    """Fingerprints that lie within 7 bits of each other, of which only some texts are similar; all are hot, and two texts share a fingerprint."""
    word = lambda k, i: f"w{k}x{i}"
    base = {k: [word(k, i) for i in range(100)] for k in range(8)}
    texts = [" ".join(base[k]) for k in range(8)] + [" ".join([*base[k][:-3], "other", "end", "here"]) for k in range(8)]
    fake = {t: (0b111 << 4 * (i % 8)) ^ (0b1111 << 32 if i >= 8 else 0) for i, t in enumerate(texts)}
    fake[texts[1]], fake[texts[9]] = fake[texts[0]], fake[texts[0]] ^ (0b11111 << 40)
    rows = spark.createDataFrame([(None, t, fake[t], n) for n, t in enumerate(texts)], "doc_id long, text string, fp long, n int")
    docs = rows.select("fp", F.col("fp").alias("root"), F.xxhash64("text").alias("text_hash"), *S.row_key(rows))
    for named in (1, 3, 40):
        monkeypatch.setattr(S, "NAMED", named)
        got = {tuple(sorted((r["a"], r["b"]))) for r in S.similar_links(rows, docs, 7, 5, 0.8, "text").collect()}
        assert got == {tuple(sorted((fake[texts[k]], fake[texts[k + 8]]))) for k in range(8)}


def test_near_copies_are_found_by_their_words(spark):
    """Nearly all pairs that share 0.8 of their five-word shingles, brute force over all pairs."""
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(2000)]
    texts = []
    for _ in range(120):
        words = [vocabulary[int(2000 * r.random() ** 3)] for _ in range(r.choice([60, 120, 300]))]
        copy = list(words)
        for k in r.sample(range(len(copy)), len(copy) // 60):
            copy[k] = r.choice(vocabulary)
        texts += [" ".join(words), " ".join(copy)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    got = {x["doc_id"]: x["component_id"] for x in S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), wide=7).collect()}
    assert len(alike) > 80 and sum(got[i] == got[j] for i, j in alike) >= 0.95 * len(alike)
    assert all(got[i] == got[j] or i // 2 != j // 2 for i, j in alike if (S.fingerprint(texts[i], 1, True) ^ S.fingerprint(texts[j], 1, True)).bit_count() <= 7)


def test_a_dense_group_is_joined_by_few_comparisons(spark, monkeypatch):
    """Hundreds of texts within a few bits of each other, of which some pairs are similar: the classes of brute force, from few compared pairs."""
    r = random.Random(14)
    base = [f"w{r.randrange(10**6)}" for _ in range(70)]
    texts = []
    for _ in range(260):
        words = list(base)
        for k in r.sample(range(len(words)), r.choice([1, 2, 3, 5, 6])):
            words[k] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(words))
    fps, wide = [S.fingerprint(t) for t in texts], [S.fingerprint(t, 1, True) for t in texts]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(66)} for t in texts]
    compared = []
    listed = S.unordered
    monkeypatch.setattr(S, "unordered", lambda pairs, *cols: compared.append(S.materialize(listed(pairs, *cols), "t")) or compared[-1])
    got = {x["doc_id"]: x["component_id"] for x in S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), wide=7).collect()}
    near7 = [(i, j) for i in range(len(texts)) for j in range(i) if (wide[i] ^ wide[j]).bit_count() <= 7]
    want = list(range(len(texts)))
    for i, j in near7:
        shared = len(sets[i] & sets[j])
        if shared >= 0.8 * (132 - shared):
            a, b = want[i], want[j]
            want = [min(a, b) if x in (a, b) else x for x in want]
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert [got[i] for i in range(len(texts))] == want
    assert len(near7) > 10_000 and sum(c.count() for c in compared) < len(near7) / 3
