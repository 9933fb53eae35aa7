"""The registered queries themselves, over the local tables: against SQL, or against brute force."""

import os
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm import html, quality, queries, simhash
from vitrine.llm.mixing import targets

SMALL, SOME = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SOME), reason="needs the test tables")


def rows(sf, table):
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()


def named(number):
    return next(f for name, f in queries.QUERIES.items() if name.startswith(f"op{number}_"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SOME}/{table}.parquet'")
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SOME).toPandas()[list(want.columns)]
    plain = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v) if isinstance(v, float) else v) for v in r) for r in df.itertuples(index=False))
    assert len(want) and plain(got) == plain(want)


def test_op1_places_records_by_the_midpoints_of_their_keys(spark):
    got = {r["doc_id"]: r for r in named(1)(spark, SOME).collect()}
    docs = spark.read.parquet(f"{SOME}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 16).alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("k1"), F.xxhash64("doc_id", F.lit(1)).alias("k2")).collect()
    keyed.sort(key=lambda r: (r["k1"], r["k2"]))
    total, end, slots = sum(r["size"] for r in keyed), 0, Counter()
    for r in keyed:
        end += r["size"]
        shard = min(39, int((2 * end - r["size"]) * 40 / (2 * total)))
        x = got[r["doc_id"]]
        assert (x["size"], x["text_crc32"], x["shard"], x["slot"]) == (r["size"], r["crc"], shard, slots[shard]) and x["grown_shard"] is None
        slots[shard] += 1
    assert len(got) == len(keyed) and len(slots) == 40


def test_op2_is_the_extraction_in_memory(spark):
    pages = rows(SOME, "pages")
    want = html.main_texts([p["html"] for p in pages], [p["url"].split("/")[2].lower() for p in pages])
    got = {r["page_id"]: r for r in named(2)(spark, SOME).collect()}
    for p, text in zip(pages, want):
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (text, len(text), p["url"])
    assert len(got) == len(pages) and all(want)


def classes(nodes, linked):
    """The least node of each node's component."""
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            label[n] = label[label[n]]
            n = label[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(fps, radius):
    fps = np.array(fps, dtype="<u8")
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[: i + 1] ^ fps[i]) <= radius)[:-1].tolist():
            yield j, i


def test_op3_joins_all_pairs_within_three_bits(spark):
    docs = rows(SOME, "documents")
    ids, fps = [d["doc_id"] for d in docs], [simhash.fingerprint(d["text"]) for d in docs]
    want = classes(ids, ((ids[i], ids[j]) for i, j in near(fps, 3)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in named(3)(spark, SOME).collect()}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in zip(ids, fps)}


def pieces(docs, path, end, capacity=2048):
    """doc_id, piece, start, length, crc of every document, with the tokenizer itself."""
    tokenizer = Tokenizer.from_file(path)
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            yield doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())


def check_packing(packed, want):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == Counter(want)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    rooms = []
    for length in sorted((w[3] for w in want), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(2048 - length)
    assert len(bins) == len(rooms)


def test_op4_packs_like_plain_best_fit_decreasing(spark):
    docs = [(d["doc_id"], d["text"]) for d in rows(SMALL, "documents")]
    check_packing(named(4)(spark, SMALL).collect(), list(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 0)))


def test_op5_reads_back_the_tokenizers_ids(spark):
    docs = sorted((d["doc_id"], d["text"]) for d in rows(SMALL, "documents"))
    want, start = [], 0
    for doc_id, _, _, n, crc in pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, 1 << 40):
        want.append((doc_id, start, n, crc))
        start += n
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in named(5)(spark, SMALL).collect()) == want


def brute_mix(spark, docs, seed=11):
    """doc position -> words taken, by a pass over each source in the order of its keys."""
    size = [len((d["text"] or "").encode().split()) for d in docs]
    df = spark.createDataFrame([(k, d["doc_id"]) for k, d in enumerate(docs)], "n int, doc_id long").select("n", F.xxhash64("doc_id", F.lit(seed)).alias("key"))
    key = {r["n"]: r["key"] for r in df.collect()}
    by_source = {}
    for k, d in enumerate(docs):
        by_source.setdefault(d["source"], []).append(k)
    sums = spark.createDataFrame([(s, sum(size[k] for k in own)) for s, own in by_source.items()], "__mix_source string, __mix_source_size long")
    goal = {r["__mix_source"]: r["target"] for r in targets(sums, (1, 2, 3), 3).collect()}
    taken = {}
    for source, own in by_source.items():
        whole = sum(size[k] for k in own)
        budget = min(round(goal[source]), 3 * whole)
        full, rest = divmod(budget, whole) if whole else (0, 0)
        for k in sorted(own, key=lambda k: (key[k], size[k])):
            now = min(size[k], rest)
            taken[k] = full * size[k] + now
            rest -= now
    return size, goal, taken


def test_op8_takes_words_in_the_order_of_keys(spark):
    docs = rows(SOME, "documents")
    size, goal, taken = brute_mix(spark, docs)
    got = {r["doc_id"]: r for r in named(8)(spark, SOME).collect()}
    for k, d in enumerate(docs):
        x = got[d["doc_id"]]
        assert (x["size"], x["taken"]) == (size[k], taken[k]) and abs(x["target"] - goal[d["source"]]) < 1e-6


def test_op10_is_the_model_over_every_text(spark):
    docs = rows(SMALL, "documents")
    model = quality.fit(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")))
    got = {r["doc_id"]: r for r in named(10)(spark, SMALL).collect()}
    want = model.scores([(d["text"] or "").encode() for d in docs])
    assert len(got) == len(docs)
    for d, s in zip(docs, want.tolist()):
        x = got[d["doc_id"]]
        assert abs(x["score"] - s) < 1e-5 and x["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and x["predicted"] == int(x["score"] >= 0.3)


def test_pipeline_is_that_of_brute_force(spark):
    docs = rows(SMALL, "documents")
    model = quality.fit(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")))
    docs = [d for d, s in zip(docs, model.scores([(d["text"] or "").encode() for d in docs])) if s >= 0.3]
    assert 100 < len(docs) < len(rows(SMALL, "documents"))
    sets = []
    for d in docs:
        w = (d["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    alike = lambda i, j: (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)
    links = set(near([simhash.fingerprint(d["text"]) for d in docs], 3)) | {p for p in near([simhash.fingerprint(d["text"], 1, True) for d in docs], 7) if alike(*p)}
    label = classes(range(len(docs)), links)
    least = {}
    for k, d in enumerate(docs):
        least[label[k]] = min(least.get(label[k], d["doc_id"]), d["doc_id"])
    kept = [d for k, d in enumerate(docs) if least[label[k]] == d["doc_id"]]
    assert len(kept) < len(docs)
    size, _, taken = brute_mix(spark, kept)
    mixed = []
    for k, d in enumerate(kept):
        full, part = divmod(taken[k], size[k]) if size[k] else (0, 0)
        mixed += [(d["doc_id"], d["text"])] * full
        if part:
            words = [w.decode() for w in d["text"].encode().split()]
            mixed.append((d["doc_id"], " ".join(words[:part])))
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), list(pieces(mixed, public_tokenizers.path("word_bpe_49k.json"), 0)))
