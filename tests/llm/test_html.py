import os
import random
import re

import numpy as np
import pytest

from vitrine.llm import html as H
from vitrine.llm.html import MIN_RUN, blocks_of, covered, extract, main_texts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li>About</li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy &amp; win</div>
<article><header><h1>Head &lt;line&gt;</h1></header><p>First   part&nbsp;of
 text<br>goes <b>on</b>.<p>Second &eacute;&#33;</p><ul><li>one<li>two</ul><aside>Related</aside><form>Name <input></form>
<div class="share-buttons">Share</div><section id="comments"><article class="comment"><p>Nice!</p></article></section></article>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_without_furniture():
    want = "Head <line>\nFirst part of text goes on.\nSecond é!\none\ntwo"
    assert main_texts([PAGE]) == [want] and main_texts([PAGE, PAGE, PAGE]) == [want] * 3


def test_broken_markup():
    assert main_texts([None, "", "<", "<p", "plain text", "<p>a<!-- b", "<script>x", "<div>a</span></div></div>b"]) == ["", "", "", "", "plain text", "a", "", "a\nb"]
    assert blocks_of("<p>a < b &am c &amp d</p>")[0][0].startswith("a")


def naive(streams):
    out = []
    for i, s in enumerate(streams):
        marks = [False] * len(s)
        for k in range(len(s) - MIN_RUN + 1):
            run = s[k : k + MIN_RUN]
            if any(run == t[j : j + MIN_RUN] for m, t in enumerate(streams) if m != i for j in range(len(t) - MIN_RUN + 1)):
                marks[k : k + MIN_RUN] = [True] * MIN_RUN
        out.append(marks)
    return out


def test_covered_is_what_other_pages_have_too():
    r = random.Random(1)
    for _ in range(60):
        pool = [[r.choice("abc") for _ in range(r.randint(5, 20))] for _ in range(4)]
        streams = [[w for _ in range(r.randint(0, 4)) for w in r.choice(pool)] for _ in range(r.randint(1, 6))]
        assert [c.tolist() for c in covered([[s] for s in streams])] == naive(streams)


def test_repeated_runs_go_where_no_element_tells():
    menu = " ".join(f"menu{i}" for i in range(12))
    pages = [f"<div>{menu}</div><div>{' '.join(f'own{k}x{i}' for i in range(30))}</div><div>{menu} end</div>" for k in range(4)]
    assert main_texts(pages) == [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(4)]


def test_passages_of_an_article_stay_though_repeated():
    quote = " ".join(f"quote{i}" for i in range(60))
    pages = [f"<article><p>{quote}</p><p>{k} unique</p></article>" for k in range(3)]
    assert main_texts(pages) == [f"{quote}\n{k} unique" for k in range(3)]


def test_odd_rows(spark):
    rows = [(1, "http://a.example/x", PAGE), (1, "http://a.example/x", PAGE), (2, None, None), (None, "not a url", ""), (3, "http://a.example/long", "<article>" + "<p>word</p>" * 20000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "'clash' AS slab", "'clash' AS text", "1 AS slabs")
    got = extract(df).collect()
    assert len(got) == 5 and max(r["text"].count("\n") for r in got) == 19999
    assert sorted(r["text"][:4] for r in got) == ["", "", "Head", "Head", "word"]
    assert extract(df.filter("1 = 0")).collect() == []


def test_text_after_a_literal_less_than_stays():
    pages = ["<article><p>price < 5 and all the rest, never closed", "plain 1 < 2 <3 text", "<p>a < b <a href=\"x", "<p>a < b </", "<p>a < b <"]
    assert main_texts(pages) == ["price < 5 and all the rest, never closed", "plain 1 < 2 <3 text", "a < b", "a < b", "a < b"]


def test_a_body_beside_an_article_stays_if_unique():
    menu = " ".join(f"menu{i}" for i in range(12))
    body = [" ".join(f"body{k}x{i}" for i in range(40)) for k in range(3)]
    pages = [f"<div>{menu}</div><div>{body[k]}</div><article>teaser {k}</article>" for k in range(3)]
    assert main_texts(pages) == [f"{body[k]}\nteaser {k}" for k in range(3)]


def test_slabs_of_a_host_share_their_runs(spark):
    notice = " ".join(f"notice{i}" for i in range(20))
    own = [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(40)]
    rows = [(k, f"http://a.example/{k}", f"<div>{notice}</div><div>{own[k]}</div>" if k % 4 == 0 else f"<div>{own[k]}</div>") for k in range(40)]
    df = spark.createDataFrame(rows + rows[1:2], "page_id long, url string, html string")
    for slab_bytes in (200, 4 << 20):
        got = sorted((r["page_id"], r["text"]) for r in extract(df, slab_bytes).collect())
        assert got == sorted([*enumerate(own), (1, own[1])])


def test_suffixes_are_ordered_in_full():
    r = random.Random(2)
    for n in (1, 2, 7, 60, 200):
        ids = np.array([r.randrange(3) for _ in range(n)] * 2, dtype=np.int64)[: n + n // 2]
        order, common = H.suffix_array(ids)
        want = sorted(range(len(ids)), key=lambda k: ids[k:].tolist())
        assert order.tolist() == want
        for k in range(1, len(want)):
            a, b = ids[want[k - 1] :].tolist(), ids[want[k] :].tolist()
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def naive_extract(pages):
    """The texts of (host, html) pages by sets of runs, place by place."""
    found = [blocks_of(h) for _, h in pages]
    words = [[w for t, kind, _ in b for w in ([None] if kind == H.ARTICLE else t.split())] for b in found]
    whole = ["\n".join(t for t, _, _ in b) for b in found]
    runs = {}
    for (host, _), w, text in zip(pages, words, whole):
        for k in range(len(w) - MIN_RUN + 1):
            if None not in w[k : k + MIN_RUN]:
                runs.setdefault((host, tuple(w[k : k + MIN_RUN])), set()).add(text)
    marks, places = [], {}
    for (host, _), w, b in zip(pages, words, found):
        m = [False] * len(w)
        for k in range(len(w) - MIN_RUN + 1):
            if len(runs.get((host, tuple(w[k : k + MIN_RUN])), ())) > 1:
                m[k : k + MIN_RUN] = [True] * MIN_RUN
        m = [x for x, y in zip(m, w) if y is not None]
        marks.append(m)
        at = 0
        for t, kind, place in b:
            n = 0 if kind == H.ARTICLE else len(t.split())
            if n:
                for key in ((host, kind, place), (kind, place)):
                    seen = places.setdefault(key, [0, 0])
                    seen[0] += n
                    seen[1] += sum(m[at : at + n])
            at += n
    out = []
    for (host, _), m, b in zip(pages, marks, found):
        at, kept = 0, []
        for t, kind, place in b:
            if kind == H.ARTICLE:
                kept.append(t)
                continue
            w = t.split()
            own, at = m[at : at + len(w)], at + len(w)
            n, c = places[kind, place]
            prior = (c + 100 * (0.5 if kind == H.FURNITURE else 0)) / (n + 100)
            n, c = places[host, kind, place]
            if (c + 100 * prior) / (n + 100) >= (0.05 if kind == H.FURNITURE else 0.5):
                continue
            line, rest = "".join("1" if x else "0" for x in own), []
            for x in re.finditer("0+", line):
                if len(x[0]) >= MIN_RUN or not any(own):
                    rest += w[x.start() : x.end()]
            if rest:
                kept.append(" ".join(rest))
        out.append("\n".join(kept))
    return out


def random_pages(r, n):
    pool = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(40)) for _ in range(r.randint(9, 30))) for _ in range(6)]
    fresh = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    often = lambda p: r.choice(pool) if r.random() < p else fresh(r.randint(1, 30))
    pages = []
    for _ in range(n):
        parts = [f"<nav>{often(0.6)}</nav>", f"<div class='ad'>{often(0)}</div>", f"<div class='teaser box'>{often(0.9)}</div>", f"<div id=body>{fresh(20)} {often(0.4)} {fresh(3)} {often(0.4)}</div>"]
        parts += [f"<article>{often(0.5)}<form>{fresh(2)}</form></article>"] * r.randrange(2) + [f"<footer>{often(0.1)}</footer>"] + [f"<div class=comments>{fresh(9)}</div>"]
        r.shuffle(parts)
        pages.append((r.choice(["a.example"] * 5 + ["b.example", "c.example"]), "".join(parts)))
    return pages + r.sample(pages, 5)


def test_extraction_is_that_of_brute_force(spark):
    for seed, n in ((3, 25), (4, 120)):
        pages = random_pages(random.Random(seed), n)
        want = naive_extract(pages)
        assert main_texts([h for _, h in pages], [host for host, _ in pages]) == want
        df = spark.createDataFrame([(k, f"http://{host}/{k}", h) for k, (host, h) in enumerate(pages)], "page_id long, url string, html string")
        for slab_bytes in (900, 4 << 20):
            got = {r["page_id"]: r["text"] for r in extract(df, slab_bytes).collect()}
            assert [got[k] for k in range(len(pages))] == want
    assert any("w" in t for t in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_the_array_decides(monkeypatch):
    """Without the suffix array, most pages of the local tables would have another text; with it they are the article alone."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["url", "html"]).to_pylist()
    pages, hosts = [r["html"] for r in rows], [r["url"].split("/")[2] for r in rows]
    texts = main_texts(pages, hosts)
    article = lambda h: "\n".join(t for t, kind, _ in blocks_of(h or "") if kind == H.ARTICLE)
    assert texts == [article(h) for h in pages]
    monkeypatch.setattr(H, "covered", lambda pages: [np.zeros(sum(map(len, p)), bool) for p in pages])
    assert sum(a != b for a, b in zip(texts, main_texts(pages, hosts))) > 0.9 * len(pages)


def test_places_follow_what_is_repeated():
    notice = " ".join(f"notice{i}" for i in range(12))
    own = [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(40)]
    # Called a sidebar, but nothing of it is ever repeated: text. Called nothing, but mostly repeated: boilerplate, unique parts too.
    pages = [f"<div class='sidebar'>{own[k]}</div><div class='strip'>{notice if k else 'only here'}</div>" for k in range(40)]
    assert main_texts(pages) == own
    # Reader comments and forms are never text, though never repeated.
    pages = [f"<p>{own[k]}</p><section id='comments'><p>{own[k][::-1]}</p></section><form>{k}</form>" for k in range(40)]
    assert main_texts(pages) == own
