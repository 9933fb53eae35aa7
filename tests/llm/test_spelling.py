"""Spelling variants against a plain search by deletions; the merge against counting."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from vitrine.llm import spelling
from vitrine.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute_words(docs, drop=31):
    n, upper = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def brute(n, ratio=10):
    near, left = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            x = w[:i] + w[i + 1 :]
            if x in n:
                near[w].add(x)
                near[x].add(w)
            left[i, x].add(w)
    for same in left.values():
        for a in same:
            near[a] |= same - {a}
    form = {}
    for w in n:
        if near[w]:
            f = min(near[w], key=lambda x: (-n[x], x))
            if n[f] >= ratio * n[w]:
                form[w] = f
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_skips_nothing():
    r = random.Random(1)
    for _ in range(500):
        lists = [sorted(r.sample(range(30), r.randrange(1, 20))) for _ in range(r.randrange(1, 9))]
        least = r.randrange(1, 6)
        counts = Counter(i for x in lists for i in x)
        assert list(spelling.merged([list(x) for x in lists], least)) == sorted(i for i, c in counts.items() if c >= least)


def random_words(seed, size):
    r = random.Random(seed)
    words = {"".join(r.choice("abÿ×") for _ in range(r.randrange(7, 11))) for _ in range(size)}
    words |= {"commonpart" + a + b for a in "abcdef" for b in "uvwxyz"} | {"x" * k for k in range(7, 13)} | {"z" * 500, "z" * 499 + "y", "z" * 499}
    return {w: r.choice([1, 1, 2, 10, 100, 1000]) for w in words}


@pytest.mark.parametrize("most_group", [2, 40, 2000])
def test_groups_of_any_size_give_all_pairs(spark, most_group):
    n = random_words(3, 900)
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows_of(spelling.variants(df, most_group=most_group)) == brute(n)


def test_forms_lead_to_roots(spark):
    n = {"aaaaaaaa": 10**6, "aaaaaaab": 10**4, "aaaaaabb": 10**3, "aaaaabbb": 10**2, "aaaabbbb": 10, "aaabbbbb": 1, "aaaaaaac": 10**4, "mmmmmmmm": 5}
    got = rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n) and {r[2] for r in got} == {"aaaaaaaa", "mmmmmmmm"}


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] * 2
    n = brute_words(docs)
    twice = odd_docs.union(odd_docs)
    assert dict(map(tuple, spelling.corpus_words(twice).collect())) == n
    assert rows_of(spelling.variants(spelling.corpus_words(no_docs))) == []


def test_letters_case_and_deletions(spark):
    text = "Façades FAÇADES façades ÀÉÎÕÜÝÞ àéîõüýþ sevenab×÷q under_score-hyphen123abcdefg " * 3
    docs = [(i, text) for i in range(200)] + [(None, text)]
    got = dict(map(tuple, spelling.corpus_words(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == brute_words(docs) and len(got) > 8


def test_op13_is_that_of_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    got = QUERIES["op13_positional_qgrams"](spark, SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == brute(brute_words(docs))
