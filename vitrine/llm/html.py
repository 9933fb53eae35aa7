"""Main text of web pages: a suffix array over the pages of a host finds boilerplate.

A page becomes blocks of text with the place each was found in. Blocks of the article are kept
although other pages may quote them; the token streams of all else on a host's pages are
concatenated and their suffixes sorted in full. The longest common prefix of each suffix with
its nearest neighbours of other pages is the longest substring there that another page repeats.
Substrings of MIN_RUN tokens or more are covered.

What is covered decides in two ways. Inside a block, covered runs are removed and unique runs
of MIN_RUN tokens or more stay. And a place (a menu, an advert, a class of elements) of which
enough is covered, on the host and on all hosts together, is boilerplate: its unique blocks go
too. Names of elements, roles and classes are only a place's prior, worth PRIOR_TOKENS tokens:
a place called a footer of which nothing is ever repeated is text, and a place without a name
of which most is repeated is boilerplate. What no repetition can show is never text: scripts,
styles, forms, hidden elements and reader comments.

A host may hold a large part of all pages, so its pages are dealt into slabs of about
slab_bytes each by a hash; a slab has its own suffix array. Runs that a slab does not repeat are
looked for on all pages of such a host by their hashes, and those found on two distinct pages
count as covered as well. Copies of one page count as one page.

Defined cases: a null html is an empty text; a null url belongs to the host ''; text after an
unclosed comment, script or style is not text; repeated rows are each returned; an empty table
gives no rows; extra columns are ignored; pages of any length are read whole.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Tokens that a repeated run has at least.
MIN_RUN = 8
FURNITURE, ARTICLE, OTHER, NEVER = 0, 1, 2, 3
#: Tokens that a prior is worth, the covered share that a name stands for, and the share from which a place with a name, and one without, is boilerplate.
PRIOR_TOKENS, NAMED_SHARE = 100.0, 0.5
MOST_NAMED, MOST_OTHER = 0.05, 0.5

# Element and attribute names of HTML, and words that sites use in class names.
RAW = "script style textarea title noscript template iframe noembed noframes xmp svg math object canvas select".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NAMED = set("nav footer aside menu dialog".split())
NOT_TEXT = set("form head button label input fieldset".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CUES = set(
    "nav navbar navigation menu topbar masthead header footer sidebar aside ad ads advert adverts advertisement advertising adsense banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login register share sharing social related "
    "recommended breadcrumb breadcrumbs pagination pager search widget copyright disclaimer skip toolbar".split()
)
COMMENTS = set("comment comments commentlist disqus replies reply respond discussion".split())
IN_ARTICLE = set("header masthead".split())

_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_OPEN = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def kind_of(tag: str, attrs: str, inside_article: bool) -> int | None:
    """NEVER or FURNITURE if an element's name, role, visibility or class names say so."""
    if tag in NOT_TEXT:
        return NEVER
    named = tag in NAMED or (tag == "header" and not inside_article)
    if not attrs.strip() or tag in ("html", "body"):
        return FURNITURE if named else None
    values = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        return NEVER
    role = values.get("role", "").lower()
    if role == "form":
        return NEVER
    named = named or role in ROLES
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        parts = [p.lower() for p in _PART.split(name) if p]
        if parts and parts[0] not in ("has", "with", "no", "without", "is"):
            if COMMENTS.intersection(parts):
                return NEVER
            cues = CUES.intersection(parts)
            if cues and tag not in ("article", "main") and not (inside_article and IN_ARTICLE.issuperset(cues)):
                named = True
    return FURNITURE if named else None


def place_name(tag: str, attrs: str) -> str:
    """An element's tag, role, classes and id, by which places on different pages are the same."""
    values = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
    return " ".join(f"{tag} {values.get('role', '')} {values.get('class', '')} {values.get('id', '')}".lower().split())


def blocks_of(html: str) -> list[tuple[str, int, str]]:
    """Texts of all blocks in page order, with the kind and the name of the place where each stands."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, int, str]] = []
    held: list[str] = []
    kind, place = OTHER, ""

    def finish() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text and kind != NEVER:
                out.append((text, kind, place))
            held.clear()

    at = 0
    for m in _SCAN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK or tag in NAMED or tag in NOT_TEXT
        if m["end"]:
            if block:
                finish()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    finish()
                    del stack[k:]
                    kind, place = stack[-1][1:] if stack else (OTHER, "")
                    break
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCK:
            finish()
            if stack and stack[-1][0] == "p" or (tag in ("li", "dd", "dt", "td", "th", "tr", "option") and stack and stack[-1][0] == tag):
                stack.pop()
                kind, place = stack[-1][1:] if stack else (OTHER, "")
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if block or m["attrs"]:
            own = (kind, place)
            found = None if kind in (NEVER, FURNITURE) else kind_of(tag, m["attrs"], kind == ARTICLE)
            if kind == FURNITURE and kind_of(tag, m["attrs"], False) == NEVER:
                found = NEVER
            if found is not None:
                finish()
                own = (found, place_name(tag, m["attrs"]))
            elif kind == OTHER and tag in ("article", "main"):
                own = (ARTICLE, tag)
            elif kind == OTHER and m["attrs"].strip() and tag in BLOCK:
                own = (OTHER, place_name(tag, m["attrs"]))
            stack.append((tag, *own))
            kind, place = own
    if at < len(html):
        # An incomplete tag at the end is not text; any other '<' is.
        tail = _OPEN.search(html, at)
        held.append(html[at : tail.start() if tail else len(html)])
    finish()
    return out


def packed(blocks: list[tuple[str, int, str]]) -> bytes:
    """The blocks of a page in one value: a line with their number, their kinds and places, their texts."""
    lines = [str(len(blocks)), *(f"{kind}{place}" for _, kind, place in blocks), *(text for text, _, _ in blocks)]
    return "\n".join(lines).encode("utf-8", "replace")


def unpacked(data: bytes) -> list[tuple[str, int, str]]:
    lines = data.decode().split("\n")
    n = int(lines[0])
    return [(text, int(p[0]), p[1:]) for p, text in zip(lines[1 : n + 1], lines[n + 1 :])]


def streams_of(blocks: list[tuple[str, int, str]]) -> list[list[str]]:
    """The tokens outside the article, a stream for each stretch of blocks without an article between them."""
    out, inside = [], True
    for text, kind, _ in blocks:
        if kind != ARTICLE:
            if inside:
                out.append([])
            out[-1] += text.split(" ")
        inside = kind == ARTICLE
    return out


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, and the longest common prefix of each with the one before it in that order.

    Prefix doubling: a suffix's rank is how many have a smaller prefix; each round sorts only
    suffixes that still share their rank. The ranks of all rounds give the prefixes' lengths.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.append(True, ids[order[1:]] != ids[order[:-1]])[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, depth = [rank.astype(np.int32)], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sizes[rank] > 1)
        if not len(open_):
            break
        after = np.where(open_ + depth < n, rank[np.minimum(open_ + depth, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[open_]))
        own, first, second = open_[by], rank[open_][by], after[by]
        fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        starts = np.append(True, first[1:] != first[:-1])
        within = np.arange(len(own)) - np.maximum.accumulate(np.where(starts, np.arange(len(own)), 0))
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(fresh, first + within, 0))
        levels.append(rank.astype(np.int32))
        depth *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common[1:], b + common[1:]
        inside = np.flatnonzero(np.maximum(i, j) < n)
        same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
        common[1 + same] += 1 << k
    return order, common


def repeats(ids: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there on that another page has too."""
    order, common = suffix_array(ids)
    own = page[order]
    stretch = np.cumsum(np.append(True, own[1:] != own[:-1])[: len(own)])
    # Neighbours of the same page don't count: what lies between is the least common prefix on the way.
    before = pd.Series(common).groupby(stretch).cummin().to_numpy()
    after = pd.Series(np.append(common[1:], 0)[::-1]).groupby(stretch[::-1]).cummin().to_numpy()[::-1]
    out = np.zeros(len(ids), np.int64)
    out[order] = np.maximum(before, after)
    return out


def covered(pages: list[list[list[str]]]) -> list[np.ndarray]:
    """For each page, given by its streams, which of its tokens are in a substring of MIN_RUN tokens or more that another page has too."""
    lengths = np.array([len(s) for streams in pages for s in streams], dtype=np.int64)
    tokens = [t for streams in pages for s in streams for t in (*s, None)]
    ids = pd.factorize(np.array(tokens, dtype=object))[0].astype(np.int64)
    stops = np.cumsum(lengths + 1) - 1
    ids[stops] = ids.max(initial=0) + 1 + np.arange(len(stops))  # no substring crosses the end of a stream
    page = np.repeat(np.repeat(np.arange(len(pages)), [len(streams) for streams in pages]), lengths + 1)
    length = repeats(ids, page) if len(ids) else ids
    at = np.flatnonzero(length >= MIN_RUN)
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + length[at], -1)
    inside, token = np.cumsum(marks)[: len(ids)] > 0, np.ones(len(ids), bool)
    token[stops] = False
    ends = np.cumsum([sum(map(len, streams)) for streams in pages])[:-1]
    return np.split(inside[token], ends) if pages else []


def marked(found: list[list[tuple[str, int, str]]]) -> list[np.ndarray]:
    """Which tokens outside the article of each page are covered by what other distinct pages have."""
    whole = ["\n".join(t for t, _, _ in blocks) for blocks in found]
    first = {text: k for k, text in reversed(list(enumerate(whole)))}
    distinct = sorted(first.values())
    marks = dict(zip(distinct, covered([streams_of(found[k]) for k in distinct])))
    return [marks[first[text]] for text in whole]


def run_hashes(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all runs of MIN_RUN tokens of a page, and their 64-bit hashes as signed longs."""
    codes, words = pd.factorize(np.array([w for s in streams for w in s], dtype=object))
    own = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype="<u8")[codes]
    at, start = [np.zeros(0, np.int64)], 0
    for s in streams:
        at.append(start + np.arange(max(0, len(s) - MIN_RUN + 1)))
        start += len(s)
    places = np.concatenate(at)
    out = np.zeros(len(places), dtype="<u8")
    for k in range(MIN_RUN):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + own[places + k]
    return places, out.view("<i8")


def with_runs(marks: np.ndarray, at: list[int] | None) -> np.ndarray:
    """Marks with the runs from the given positions on."""
    if at is None or not len(at):
        return marks
    marks = marks.copy()
    for k in range(MIN_RUN):
        marks[np.asarray(at) + k] = True
    return marks


def place_counts(blocks: list[tuple[str, int, str]], marks: np.ndarray) -> dict[str, tuple[int, int]]:
    """Tokens and covered tokens of each place outside the article; a place is known by its kind and name."""
    sums, at, out = np.cumsum(np.append(0, marks)).tolist(), 0, {}
    for text, kind, place in blocks:
        if kind != ARTICLE:
            n = text.count(" ") + 1
            seen = out.get(f"{kind}{place}", (0, 0))
            out[f"{kind}{place}"] = (seen[0] + n, seen[1] + sums[at + n] - sums[at])
            at += n
    return out


def share(covered_, tokens, prior):
    """The covered share of a place, given what it was expected to be."""
    return (covered_ + PRIOR_TOKENS * prior) / (tokens + PRIOR_TOKENS)


def unique_runs(words: list[str], marks: np.ndarray) -> str:
    """A block without its covered runs: its unique runs of MIN_RUN tokens or more, or all of it if nothing is covered."""
    if not marks.any():
        return " ".join(words)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], marks, [True]]).astype(np.int8)))
    return " ".join(" ".join(words[i:j]) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()) if j - i >= MIN_RUN)


def kept_text(blocks: list[tuple[str, int, str]], marks: np.ndarray, flipped: set[str]) -> str:
    """The main text of a page: blocks of the article, and the unique runs of blocks whose place is not boilerplate.

    flipped has the places for which the array says otherwise than their names.
    """
    at, kept = 0, []
    for text, kind, place in blocks:
        if kind == ARTICLE:
            kept.append(text)
            continue
        words = text.split(" ")
        own = marks[at : at + len(words)]
        at += len(words)
        if (kind == FURNITURE) == (f"{kind}{place}" in flipped):
            kept.append(unique_runs(words, own))
    return "\n".join(t for t in kept if t)


def main_texts(pages: list[str | None], hosts: list[str] | None = None) -> list[str]:
    """The main text of each of the given pages, in memory; without hosts, all are of one."""
    hosts = hosts or [""] * len(pages)
    found = [blocks_of(p or "") for p in pages]
    marks: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    total: dict[tuple[str | None, str], np.ndarray] = {}
    for host in dict.fromkeys(hosts):
        own = [k for k, h in enumerate(hosts) if h == host]
        for k, m in zip(own, marked([found[k] for k in own])):
            marks[k] = m
            for place, n in place_counts(found[k], m).items():
                for key in ((host, place), (None, place)):
                    total[key] = total.get(key, 0) + np.array(n)
    flipped: dict[str, set[str]] = {host: set() for host in hosts}
    for (host, place), (n, c) in total.items():
        if host is not None:
            named = place.startswith(str(FURNITURE))
            every_n, every_c = total[None, place]
            rate = share(c, n, share(every_c, every_n, NAMED_SHARE if named else 0.0))
            if (rate >= (MOST_NAMED if named else MOST_OTHER)) != named:
                flipped[host].add(place)
    return [kept_text(blocks, m, flipped[host]) for blocks, m, host in zip(found, marks, hosts)]


def column(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def read_pages(b: pa.RecordBatch):
    """The blocks and marks of each row of a batch with the columns blob, marks and at."""
    for data, bits, at in zip(column(b, "blob"), column(b, "marks"), column(b, "at")):
        blocks = unpacked(data)
        n = sum(t.count(" ") + 1 for t, kind, _ in blocks if kind != ARTICLE)
        yield blocks, with_runs(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool), at)


def repeated_elsewhere(pages: DataFrame) -> DataFrame:
    """host, slab, nth, at: positions of runs of a page that its slab does not repeat, but another distinct page of its host does. Pages are not moved."""
    def asks(batches):
        for b in batches:
            for host, slab, nth, (blocks, marks) in zip(column(b, "host"), column(b, "slab"), column(b, "nth"), read_pages(b)):
                at, run = run_hashes(streams_of(blocks))
                bare = np.cumsum(np.append(0, ~marks))
                open_ = bare[at + MIN_RUN] > bare[at]
                at, run = at[open_], run[open_]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([host] * len(at)), pa.array([slab] * len(at), pa.int32()), pa.array([nth] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(run)],
                        names=["host", "slab", "nth", "at", "run"],
                    )

    def finds(batches):
        for b in batches:
            for host, (blocks, _) in zip(column(b, "host"), read_pages(b)):
                runs = np.unique(run_hashes(streams_of(blocks))[1])
                page = np.array(xxhash.xxh64_intdigest("\n".join(t for t, _, _ in blocks).encode()), dtype="<u8").view("<i8")
                if len(runs):
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(runs)), pa.array(runs), pa.array(np.repeat(page, len(runs)))], names=["host", "run", "page"])

    asked = materialize(pages.mapInArrow(asks, "host string, slab int, nth int, at int, run long"), "asked")
    runs = materialize(asked.select("host", "run").distinct(), "runs")
    found = pages.mapInArrow(finds, "host string, run long, page long").join(runs, ["host", "run"], "left_semi")
    shared = found.groupBy("host", "run").agg(F.min("page").alias("low"), F.max("page").alias("high")).filter("low <> high")
    positions = asked.join(shared, ["host", "run"], "left_semi").groupBy("host", "slab", "nth").agg(F.collect_list("at").alias("at"))
    return materialize(positions, "elsewhere")


def flipped_places(pages: DataFrame) -> DataFrame:
    """host, flipped: the places of each host for which the covered share says otherwise than their names.

    A place's share on all hosts, from its name as the prior, is the prior of its share on a host.
    """
    def count(batches):
        for b in batches:
            total: dict[tuple[str, str], tuple[int, int]] = {}
            for host, (blocks, marks) in zip(column(b, "host"), read_pages(b)):
                for place, (n, c) in place_counts(blocks, marks).items():
                    seen = total.get((host, place), (0, 0))
                    total[host, place] = (seen[0] + n, seen[1] + c)
            keys, sums = list(total), list(total.values())
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "place", "tokens", "covered"])

    counts = pages.mapInArrow(count, "host string, place string, tokens long, covered long")
    by_host = materialize(counts.groupBy("host", "place").agg(F.sum("tokens").alias("tokens"), F.sum("covered").alias("covered")), "places")
    named = F.col("place").startswith(str(FURNITURE))
    everywhere = by_host.groupBy("place").agg(share(F.sum("covered"), F.sum("tokens"), F.when(named, NAMED_SHARE).otherwise(0.0)).alias("prior"))
    rate = share(F.col("covered"), F.col("tokens"), F.col("prior"))
    other = (rate >= F.when(named, MOST_NAMED).otherwise(MOST_OTHER)) != named
    return materialize(by_host.join(everywhere, "place").filter(other).groupBy("host").agg(F.collect_set("place").alias("flipped")), "flipped")


def extract(df: DataFrame, slab_bytes: int = 4 << 20) -> DataFrame:
    """page_id, url and text of every row of page_id, url, html."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    rows = df.select("page_id", "url", "html", host.alias("host"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    slabs = rows.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / F.lit(float(slab_bytes)))).cast("int").alias("slabs"), F.sum(size).alias("bytes"))
    slabs = materialize(slabs, "hosts")
    total = slabs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    placed = rows.join(slabs.drop("bytes"), "host").withColumn("slab", F.pmod(F.xxhash64("page_id", "url"), F.col("slabs")).cast("int"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def parse(batches):
        for b in batches:
            blobs = [zstandard.compress(packed(blocks_of(h or ""))) for h in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *b.columns[1:]], names=["blob", *b.schema.names[1:]])

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        blobs = [zstandard.decompress(b) for b in group["blob"]]
        bits = [np.packbits(m).tobytes() for m in marked([unpacked(b) for b in blobs])]
        return group.assign(nth=np.arange(len(group), dtype=np.int32), blob=blobs, marks=bits)[["page_id", "url", "host", "slab", "slabs", "nth", "blob", "marks"]]

    parsed = placed.select("html", "page_id", "url", "host", "slab", "slabs").mapInArrow(parse, f"blob binary, page_id {kind}, url string, host string, slab int, slabs int")
    # As many partitions as slabs, so that a task has a few of them, however large the table.
    dealt = parsed.repartition(max(1, -(-total // slab_bytes)), "host", "slab")
    pages = dealt.groupBy("host", "slab").applyInPandas(mark, f"page_id {kind}, url string, host string, slab int, slabs int, nth int, blob binary, marks binary")
    pages = materialize(pages, "marked", compression="zstd")
    at = F.lit(None).cast("array<int>")
    if not slabs.filter("slabs > 1").isEmpty():
        elsewhere = repeated_elsewhere(pages.filter("slabs > 1").withColumn("at", at))
        if not elsewhere.isEmpty():
            pages = pages.join(elsewhere, ["host", "slab", "nth"], "left")
    if "at" not in pages.columns:
        pages = pages.withColumn("at", at)
    flipped = flipped_places(pages)
    # A row for each slab, so that no task joins a whole host where there are too many places to broadcast.
    by_slab = materialize(flipped.join(slabs, "host").select("host", "flipped", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab")), "by_slab")
    joined = pages.join(by_slab, ["host", "slab"], "left").select("page_id", "url", "blob", "marks", "at", "flipped")

    def keep(batches):
        for b in batches:
            texts = [kept_text(blocks, marks, set(f or ())) for (blocks, marks), f in zip(read_pages(b), column(b, "flipped"))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(keep, f"page_id {kind}, url string, text string")


def op2_host_suffix_array(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
