"""Queries of the matching driver, the rubric, and the upkeep of a report store.

lineitem stands in for candidates and matches, part for primary products, orders for runs and
messages; verdicts and flags are derived from keys by the same arithmetic here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import compaction as P
from ..operators import evaluations as E
from ..operators import matching as M
from ..operators import rubric as B
from ..operators import upkeep as K
from ..sources.shared import stored
from ..sources.tables import load
from .registry import query

_CANDIDATES = """c AS (SELECT l_returnflag AS run, l_partkey AS primary_id, 'd' || l_linenumber AS domain, l_suppkey AS rival_id, max(l_extendedprice) AS retrieval, max(l_discount) AS lexical,
bool_or(l_quantity = 50 AND l_tax = 0.08) AS pinned, bool_or(l_linestatus = 'O' AND l_tax < 0.02) AS priced FROM lineitem GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY run, primary_id, domain ORDER BY retrieval DESC, lexical DESC, rival_id) AS a FROM c WHERE NOT pinned),
e AS (SELECT *, row_number() OVER (PARTITION BY run, primary_id ORDER BY retrieval DESC, rival_id, domain) AS b FROM d WHERE a <= 2),
g0 AS (SELECT run, primary_id, domain, rival_id, retrieval, pinned, priced FROM e WHERE b <= 3 UNION ALL SELECT run, primary_id, domain, rival_id, retrieval, pinned, priced FROM c WHERE pinned),
g AS (SELECT *, row_number() OVER (PARTITION BY run, primary_id ORDER BY pinned DESC, retrieval DESC, rival_id, domain) AS n FROM g0),
j0 AS (SELECT run, primary_id, bool_or(pinned) AS pinned, bool_or(priced) AS priced, max(retrieval) AS strength FROM g GROUP BY ALL),
j AS (SELECT run, primary_id, place FROM (SELECT j0.*, row_number() OVER (PARTITION BY run ORDER BY pinned DESC, priced DESC, strength DESC, p_retailprice > 1200 DESC, p_size > 25 DESC, primary_id) AS place
FROM j0 JOIN part ON p_partkey = primary_id) WHERE place <= 60),
q0 AS (SELECT g.*, place, count(*) FILTER (pinned) OVER (PARTITION BY run) AS pins, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY place, n) AS so_far FROM g JOIN j USING (run, primary_id)),
q AS (SELECT * FROM q0 WHERE pinned OR so_far <= 150 - pins)"""


def kind() -> Column:
    """A rival's domain, or a kind of fact."""
    return F.concat(F.lit("d"), F.col("l_linenumber").cast("string"))


def candidates(spark, sf_dir) -> DataFrame:
    l = load(spark, sf_dir, "lineitem")
    c = l.groupBy(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("primary_id"), kind().alias("domain"), F.col("l_suppkey").alias("rival_id")).agg(
        F.max("l_extendedprice").alias("retrieval"), F.max("l_discount").alias("lexical"), F.max((F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08)).alias("pinned"), F.max((F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.02)).alias("priced")
    )
    p, r = F.col("primary_id"), F.col("rival_id")
    flags = {"vetoed": (p + r) % 11 == 0, "exact": (p + 2 * r) % 4 > 0, "deterministic": (p + r) % 3 == 0, "both_generic": (p % 2 == 0) & (r % 2 == 0), "shared": (r % 2).cast("int")}
    return c.withColumns(flags)


def primaries(spark, sf_dir) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("run"), F.col("p_partkey").alias("primary_id"), (F.col("p_retailprice") > 1200).alias("has_price"), (F.col("p_size") > 25).alias("has_image"))
    return p


@query(f"WITH {_CANDIDATES} SELECT run, primary_id, place FROM j")
def judge_groups(spark, sf_dir):
    """The groups of candidates that a judge sees, by six keys."""
    return M.judge_groups(M.candidate_groups(candidates(spark, sf_dir), 2, 3), primaries(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CANDIDATES}, v AS (SELECT *, (primary_id * 7 + rival_id * 3) % 5 AS k, ((primary_id + rival_id) % 11) / 10.0::DOUBLE AS confidence, rival_id % 6 = 0 AS contradicted FROM q),
w AS (SELECT *, CASE WHEN (primary_id + rival_id) % 11 = 0 THEN 'no_match' WHEN k = 0 AND (contradicted OR (primary_id + 2 * rival_id) % 4 = 0) THEN 'close_substitute' WHEN k = 0 THEN 'same_product' WHEN k = 1 THEN 'close_substitute' WHEN k = 2 THEN 'related' ELSE 'no_match' END AS verdict FROM v WHERE k < 4),
s AS (SELECT *, CASE verdict WHEN 'same_product' THEN 0.8::DOUBLE + 0.2::DOUBLE * confidence ELSE 0.55::DOUBLE + 0.25::DOUBLE * confidence END AS score FROM w WHERE verdict IN ('same_product', 'close_substitute')
AND ((primary_id + rival_id) % 3 = 0 OR (confidence >= 0.65 AND NOT (primary_id % 2 = 0 AND rival_id % 2 = 0)))),
o AS (SELECT run, domain, primary_id, rival_id, verdict, score, row_number() OVER (PARTITION BY run, domain ORDER BY score DESC, primary_id, rival_id) AS n FROM s),
walk AS (SELECT run, domain, 0::BIGINT AS n, []::BIGINT[] AS ps, []::BIGINT[] AS rs, false AS took, NULL::BIGINT AS primary_id, NULL::BIGINT AS rival_id, NULL::VARCHAR AS verdict, NULL::DOUBLE AS score FROM o GROUP BY run, domain
UNION ALL SELECT w.run, w.domain, o.n, CASE WHEN list_contains(w.ps, o.primary_id) OR list_contains(w.rs, o.rival_id) THEN w.ps ELSE list_append(w.ps, o.primary_id) END,
CASE WHEN list_contains(w.ps, o.primary_id) OR list_contains(w.rs, o.rival_id) THEN w.rs ELSE list_append(w.rs, o.rival_id) END, NOT (list_contains(w.ps, o.primary_id) OR list_contains(w.rs, o.rival_id)),
o.primary_id, o.rival_id, o.verdict, o.score FROM walk w JOIN o ON o.run = w.run AND o.domain = w.domain AND o.n = w.n + 1)
SELECT run, domain, primary_id, rival_id, verdict, score FROM walk WHERE took""")
def hybrid_matches(spark, sf_dir):
    """The whole matching: candidates, judge's groups, verdicts, one-to-one pairs per domain."""
    c = stored(candidates(spark, sf_dir), "candidates")
    p, r = F.col("primary_id"), F.col("rival_id")
    k = (p * 7 + r * 3) % 5
    verdict = F.when(k == 0, "same_product").when(k == 1, "close_substitute").when(k == 2, "related").otherwise("odd")
    verdicts = c.filter(k < 4).select("run", "primary_id", "domain", "rival_id", verdict.alias("verdict"), (((p + r) % 11) / 10).alias("confidence"), (r % 6 == 0).alias("contradicted"))
    return M.hybrid_matches(c, primaries(spark, sf_dir), verdicts, most_primaries=60, most_pairs=150, per_domain=2, per_primary=3)


_FACTS = """companies AS (SELECT c_custkey % 97 AS run, c_custkey % 7 = 0 AS is_primary, c_acctbal > 3000 AS has_region FROM customer WHERE c_custkey % 97 <> 5),
products AS (SELECT p_partkey % 97 AS run, p_size % 4 = 0 AS is_primary, p_size > 10 AS has_price, p_size > 30 AS has_image FROM part WHERE p_partkey % 97 > 9),
matches AS (SELECT l_partkey % 97 AS run, 'd' || l_linenumber AS domain, l_quantity > 40 AS linked, l_tax < 0.05 AS priced FROM lineitem WHERE l_partkey % 97 > 20),
claims AS (SELECT o_orderkey % 97 AS run, o_orderkey % 97 < 50 OR o_orderstatus <> 'P' AS linked, o_orderpriority <> '5-LOW' AS typed, o_orderstatus = 'F' AS observed, o_totalprice > 100000 AS backed, o_orderstatus <> 'O' AS dated, o_orderdate > DATE '1996-01-01' AS fresh FROM orders),
phases AS (SELECT s_suppkey % 97 AS run, s_suppkey % 3 = 0 AS unavailable, s_suppkey % 2 = 0 AS explained, s_suppkey % 5 = 0 AS gap FROM supplier),
actions AS (SELECT n_nationkey % 9 AS run, n_regionkey > 0 AS linked FROM nation),
runs AS (SELECT DISTINCT run FROM (SELECT run FROM companies UNION ALL SELECT run FROM products UNION ALL SELECT run FROM matches UNION ALL SELECT run FROM claims UNION ALL SELECT run FROM phases UNION ALL SELECT run FROM actions)),
f AS (SELECT run, (SELECT count(*) FILTER (NOT is_primary) FROM companies x WHERE x.run = r.run) AS competitors, (SELECT count(*) FILTER (NOT is_primary AND has_region) FROM companies x WHERE x.run = r.run) AS region_competitors,
(SELECT count(*) FILTER (is_primary) FROM products x WHERE x.run = r.run) AS primary_products, (SELECT count(*) FILTER (NOT is_primary) FROM products x WHERE x.run = r.run) AS rival_products,
(SELECT count(*) FILTER (NOT is_primary AND has_price) FROM products x WHERE x.run = r.run) AS priced_rivals, (SELECT count(*) FILTER (NOT is_primary AND has_image) FROM products x WHERE x.run = r.run) AS imaged_rivals,
(SELECT count(*) FILTER (linked) FROM matches x WHERE x.run = r.run) AS linked_matches, (SELECT count(DISTINCT domain) FILTER (linked) FROM matches x WHERE x.run = r.run) AS match_domains, (SELECT count(*) FILTER (linked AND priced) FROM matches x WHERE x.run = r.run) AS priced_matches,
(SELECT count(*) FROM claims x WHERE x.run = r.run) AS claims, (SELECT count(*) FILTER (linked) FROM claims x WHERE x.run = r.run) AS linked_claims, (SELECT count(*) FILTER (typed) FROM claims x WHERE x.run = r.run) AS typed_claims,
(SELECT count(*) FILTER (observed) FROM claims x WHERE x.run = r.run) AS observed_claims, (SELECT count(*) FILTER (observed AND backed) FROM claims x WHERE x.run = r.run) AS backed_claims,
(SELECT count(*) FILTER (dated) FROM claims x WHERE x.run = r.run) AS dated_claims, (SELECT count(*) FILTER (dated AND fresh) FROM claims x WHERE x.run = r.run) AS fresh_claims,
(SELECT count(*) FILTER (unavailable) FROM phases x WHERE x.run = r.run) AS unavailable, (SELECT count(*) FILTER (unavailable AND explained) FROM phases x WHERE x.run = r.run) AS explained, (SELECT count(*) FILTER (gap) FROM phases x WHERE x.run = r.run) AS gaps,
(SELECT count(*) FROM actions x WHERE x.run = r.run) AS actions, (SELECT count(*) FILTER (linked) FROM actions x WHERE x.run = r.run) AS linked_actions FROM runs r)"""


def _ratio(points: int, part: str, whole: str | int, empty: int) -> str:
    part, whole = {"all_actions_linked": "(CASE WHEN actions BETWEEN 1 AND 3 AND actions = linked_actions THEN 1 ELSE 0 END)"}.get(part, part), str(whole)
    return f"(CASE WHEN {whole} = 0 THEN {empty} ELSE floor(least(1::DOUBLE, {part}::DOUBLE / {whole}) * {points} * 10000 + 0.5) / 10000 END)"


_EARNED = {kind: " + ".join(_ratio(*c[2:]) for c in B.COMPONENTS if kind == "all" or c[0] == "integrity") for kind in ("all", "integrity")}


@query(f"""WITH {_FACTS}, e AS (SELECT *, primary_products + rival_products > 0 AS shop, {_EARNED["all"]} AS whole, {_EARNED["integrity"]} AS integrity FROM f),
s AS (SELECT run, CASE WHEN shop THEN 'deterministic' ELSE 'rubric_unavailable' END AS status, floor(CASE WHEN shop THEN whole ELSE integrity END * 10000 + 0.5) / 10000 AS earned, CASE WHEN shop THEN 270 ELSE 80 END AS applicable,
CASE WHEN NOT shop THEN NULL WHEN claims > linked_claims THEN 30 WHEN primary_products = 0 AND unavailable = 0 AND gaps = 0 THEN 35 WHEN competitors = 0 THEN 45 WHEN linked_matches = 0 THEN 55 END AS cap FROM e)
SELECT *, floor(earned / applicable * 100 + 0.5)::BIGINT AS score, least(floor(earned / applicable * 100 + 0.5), cap)::BIGINT AS capped FROM s""")
def deterministic_rubric(spark, sf_dir):
    """The nineteen ratios of each run, its score and the lowest cap that holds."""
    c, p, l, o, s, n = (load(spark, sf_dir, t) for t in ("customer", "part", "lineitem", "orders", "supplier", "nation"))
    run = lambda k: (F.col(k) % 97).alias("run")
    companies = c.filter("c_custkey % 97 <> 5").select(run("c_custkey"), (F.col("c_custkey") % 7 == 0).alias("is_primary"), (F.col("c_acctbal") > 3000).alias("has_region"))
    products = p.filter("p_partkey % 97 > 9").select(run("p_partkey"), (F.col("p_size") % 4 == 0).alias("is_primary"), (F.col("p_size") > 10).alias("has_price"), (F.col("p_size") > 30).alias("has_image"))
    matches = l.filter("l_partkey % 97 > 20").select(run("l_partkey"), kind().alias("domain"), (F.col("l_quantity") > 40).alias("linked"), (F.col("l_tax") < 0.05).alias("priced"))
    claims = o.select(
        run("o_orderkey"), ((F.col("o_orderkey") % 97 < 50) | (F.col("o_orderstatus") != "P")).alias("linked"), (F.col("o_orderpriority") != "5-LOW").alias("typed"), (F.col("o_orderstatus") == "F").alias("observed"),
        (F.col("o_totalprice") > 100000).alias("backed"), (F.col("o_orderstatus") != "O").alias("dated"), (F.col("o_orderdate") > F.lit("1996-01-01").cast("date")).alias("fresh"),
    )
    k = F.col("s_suppkey")
    phases = s.select(run("s_suppkey"), (k % 3 == 0).alias("unavailable"), (k % 2 == 0).alias("explained"), (k % 5 == 0).alias("gap"))
    actions = n.select((F.col("n_nationkey") % 9).alias("run"), (F.col("n_regionkey") > 0).alias("linked"))
    return B.evaluated(B.run_facts(companies, products, matches, claims, phases, actions))


@query("""WITH m AS (SELECT l_partkey % 50 AS run, 'd' || l_linenumber AS kind, count(*) + max(CASE WHEN l_partkey % 50 % 4 = 0 THEN 1 ELSE 0 END) AS expected FROM lineitem WHERE l_partkey % 50 <> 7 GROUP BY ALL),
f AS (SELECT l_partkey % 50 AS run, 'd' || l_linenumber AS kind, count(*) AS found FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL)
SELECT coalesce(m.run, f.run) AS run, coalesce(m.kind, f.kind) AS kind, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM m FULL JOIN f ON m.run = f.run AND m.kind = f.kind WHERE coalesce(expected, 0) <> coalesce(found, 0)""")
def manifest_gaps(spark, sf_dir):
    """Kinds of facts whose number is not the one in the manifest."""
    l = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("run"), kind().alias("kind"))
    m = l.filter("run <> 7").groupBy("run", "kind").agg(F.count(F.lit(1)).alias("n")).select("run", "kind", (F.col("n") + F.when(F.col("run") % 4 == 0, 1).otherwise(0)).alias("expected"))
    return B.manifest_gaps(m, l.filter("kind <> 'd1'"))


@query("""SELECT o_orderkey AS id, 'w' AS worker, TIMESTAMP '1998-01-01 00:05:00' AS expires_at FROM orders WHERE o_orderkey % 5 <> 0 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def claims_written(spark, sf_dir):
    """The claims that a worker writes: messages without receipt and live claim, the oldest first."""
    o = load(spark, sf_dir, "orders")
    now = F.to_timestamp(F.lit("1998-01-01 00:00:00"))
    outbox = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    claims = outbox.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, now + F.expr("INTERVAL 1 MINUTE")).otherwise(now).alias("expires_at"))
    return E.claimed(outbox, claims, outbox.filter("id % 5 = 0"), "w", now, 25).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 < 2""")
def acknowledged_claims(spark, sf_dir):
    """Receipts to write: acknowledgements by the holder of a live claim, twice or once."""
    k = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders")
    at = lambda m: F.to_timestamp(F.lit("1998-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), m)
    claims = o.filter("o_orderkey % 3 = 0").select(k.alias("id"), F.lit("w").alias("worker"), at(F.lit(5)).alias("expires_at"))
    acks = o.select(k.alias("id"), F.when(k % 4 == 2, "other").otherwise("w").alias("worker"), at(F.when(k % 4 == 3, 6).when(k % 4 == 0, 5).otherwise(1)).alias("at"))
    return E.acknowledged(claims, acks.unionByName(acks))


@query("""SELECT event_id, user_id % 40 AS run, (event_id % 4)::INT AS attempt FROM events WHERE user_id % 40 >= 30 OR NOT (event_id % 4 = user_id % 40 % 4 OR (user_id % 40 % 2 = 0 AND event_id % 4 = 1))""")
def orphan_facts(spark, sf_dir):
    """Facts of attempts that a recovery left behind."""
    facts = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("run"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    runs = spark.range(30).select(F.col("id").alias("run"), (F.col("id") % 4).cast("int").alias("attempt"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1))).alias("adopted"))
    return E.orphan_facts(facts, runs)


@query("""WITH c AS (SELECT user_id % 20 AS run, (event_id % 13 - 1)::INT AS batch, event_id AS ord, CASE WHEN event_id % 7 = 0 THEN 'old' ELSE 'p' || (user_id % 20) END AS plan_hash, (event_id % 10)::BIGINT AS pairs FROM events),
v AS (SELECT run, batch, min(ord) AS ord, arg_min(pairs, ord) AS pairs FROM c WHERE plan_hash = 'p' || run AND batch BETWEEN 0 AND 9 GROUP BY ALL), s AS (SELECT *, sum(pairs) OVER (PARTITION BY run ORDER BY batch) AS so_far FROM v)
SELECT run, batch, ord, pairs FROM s WHERE so_far <= 30""")
def valid_checkpoints(spark, sf_dir):
    """Checkpoints that may be replayed: of the current plan, one a batch, within the budget."""
    e, run = load(spark, sf_dir, "events"), F.col("user_id") % 20
    c = e.select(run.alias("run"), (F.col("event_id") % 13 - 1).cast("int").alias("batch"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 == 0, "old").otherwise(F.concat(F.lit("p"), run.cast("string"))).alias("plan_hash"), (F.col("event_id") % 10).cast("long").alias("pairs"))
    plans = spark.range(20).select(F.col("id").alias("run"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("plan_hash"), F.lit(10).alias("batches"), F.lit(30).alias("budget"))
    return E.valid_checkpoints(c, plans)


@query("""WITH k AS (SELECT DISTINCT page_id % 25 AS run, url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY sha256(url), url) AS n FROM k)
SELECT run, string_agg(url, ' ' ORDER BY url) AS urls, sha256(string_agg(url, chr(10) ORDER BY url)) AS input_hash FROM r WHERE n <= 12 GROUP BY run""")
def challenge_samples(spark, sf_dir):
    """The known URLs that a search challenge asks for, and the hash of its input."""
    k = load(spark, sf_dir, "pages").select((F.col("page_id") % 25).alias("run"), "url")
    return E.challenge_sample(k).select("run", F.array_join("urls", " ").alias("urls"), "input_hash")


@query("""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS parts FROM documents),
e AS (SELECT doc_id AS doc, unnest(parts) AS text, unnest(range(len(parts))) AS ord FROM s),
b AS (SELECT doc, ord, CASE ord % 4 WHEN 0 THEN 'evidence' WHEN 1 THEN 'gap' WHEN 2 THEN 'product-catalog' ELSE 'summary' END AS type, text AS whole, [CASE WHEN ord % 4 = 2 THEN text END, 'item', 'x'] AS items FROM e),
c AS (SELECT doc, ord, type, substring(whole, 1, CASE type WHEN 'evidence' THEN 500 WHEN 'gap' THEN 1000 WHEN 'summary' THEN 4000 ELSE 1000000000 END) AS text, items, row_number() OVER (PARTITION BY doc, type ORDER BY ord) AS nth FROM b),
l AS (SELECT * FROM (VALUES (0, 12, 12, 30), (1, 6, 6, 15), (2, 3, 0, 8), (3, 1, 0, 4)) AS v(level, catalog, evidence, gap)),
k AS (SELECT c.*, level, CASE WHEN type = 'product-catalog' THEN items[:catalog] ELSE items END AS kept FROM c CROSS JOIN l WHERE (type <> 'evidence' OR nth <= evidence) AND (type <> 'gap' OR nth <= gap)),
z AS (SELECT doc, min(level) AS level FROM (SELECT doc, level, sum(strlen(text) + list_sum([coalesce(strlen(x), 0) FOR x IN kept]) + 10) AS bytes FROM k GROUP BY ALL) WHERE bytes <= 1500 GROUP BY doc)
SELECT k.doc, k.ord, k.type, strlen(k.text)::INT AS bytes, len(kept)::INT AS items, len(k.items)::INT AS total_items, k.level FROM k JOIN z ON k.doc = z.doc AND k.level = z.level""")
def compacted_documents(spark, sf_dir):
    """Blocks of documents at the first of four reduction levels that fits a budget."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("ord", "text"))
    k = F.col("ord") % 4
    kinds = F.when(k == 0, "evidence").when(k == 1, "gap").when(k == 2, "product-catalog").otherwise("summary")
    items = F.array(F.when(k == 2, F.col("text")), F.lit("item"), F.lit("x"))
    found = P.compacted(d.select("doc", F.col("ord").cast("long").alias("ord"), kinds.alias("type"), "text", items.alias("items")), 1500, 10)
    return found.select("doc", "ord", "type", F.octet_length("text").alias("bytes"), F.size("items").alias("items"), "total_items", "level")


@query("""WITH p AS (SELECT l_orderkey % 200 AS request, l_partkey AS primary_id, 'd' || l_linenumber || '.com' AS domain, l_suppkey AS rival_id FROM lineitem WHERE l_orderkey % 10 < 2 AND l_linenumber < 3),
s AS (SELECT request, count(*) AS n, min(CASE WHEN primary_id % 97 <> 5 AND rival_id % 53 <> 7 THEN 1 ELSE 0 END) AS known FROM p GROUP BY request), o AS (SELECT DISTINCT * FROM p),
x AS (SELECT request FROM o GROUP BY request, primary_id, domain HAVING count(*) > 1 UNION SELECT request FROM o GROUP BY request, domain, rival_id HAVING count(*) > 1)
SELECT o.request, primary_id, domain, rival_id FROM o JOIN s ON s.request = o.request WHERE known = 1 AND n <= 6 AND o.request NOT IN (SELECT request FROM x)""")
def pinned_pairs(spark, sf_dir):
    """Pinned pairs of the requests that are valid as a whole."""
    l = load(spark, sf_dir, "lineitem").filter("l_orderkey % 10 < 2 AND l_linenumber < 3")
    pins = l.select((F.col("l_orderkey") % 200).alias("request"), F.col("l_partkey").alias("primary_id"), F.concat(F.lit("https://www."), kind(), F.lit(".com/")).alias("domain"), F.col("l_suppkey").alias("rival_id"))
    own = pins.filter("primary_id % 97 <> 5").select("request", F.lit("own.com").alias("domain"), F.col("primary_id").alias("id"), F.lit(True).alias("is_primary"))
    rivals = pins.filter("rival_id % 53 <> 7").select("request", "domain", F.col("rival_id").alias("id"), F.lit(False).alias("is_primary"))
    return K.pinned_pairs(pins, own.unionByName(rivals), 6)


@query("""SELECT o_orderkey AS run, greatest(least(o_orderdate::TIMESTAMP, TIMESTAMP '1997-01-01'), coalesce(s.seen, TIMESTAMP '1900-01-01')) AS reference FROM orders LEFT JOIN
(SELECT l_orderkey, max(l_shipdate)::TIMESTAMP AS seen FROM lineitem WHERE l_shipdate <= DATE '1997-01-01' GROUP BY 1) s ON l_orderkey = o_orderkey""")
def reference_times(spark, sf_dir):
    """The time by which a run's evidence is judged."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    runs = o.select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    times = K.reference_times(runs, l.select(F.col("l_orderkey").alias("run"), F.col("l_shipdate").cast("timestamp").alias("observed_at")), F.to_timestamp(F.lit("1997-01-01 00:00:00")))
    return times.withColumn("reference", F.col("reference").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT l_orderkey % 100 AS run, l_linenumber AS batch, l_partkey AS key, max(l_suppkey) AS product FROM lineitem GROUP BY ALL), t AS (SELECT DISTINCT o_orderkey % 100 AS run, o_custkey AS key FROM orders)
SELECT run, key, max(batch) AS batch, arg_max(product, batch) AS product FROM c SEMI JOIN t USING (run, key) GROUP BY ALL""")
def recovered_products(spark, sf_dir):
    """Products of earlier checkpoints that a run still asks for."""
    l, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    c = l.groupBy((F.col("l_orderkey") % 100).alias("run"), F.col("l_linenumber").alias("batch"), F.col("l_partkey").alias("key")).agg(F.max("l_suppkey").alias("product"))
    return K.recovered_products(c, o.select((F.col("o_orderkey") % 100).alias("run"), F.col("o_custkey").alias("key")))


@query("""WITH r AS (SELECT DISTINCT event_id AS id FROM events), e AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders)
SELECT r.id, CASE WHEN status IS NULL THEN 'unknown' WHEN status IN ('O', 'P') THEN 'recoverable' ELSE 'settled' END AS scope FROM r LEFT JOIN e ON e.id = r.id""")
def recovery_scope(spark, sf_dir):
    """Which of the requested evaluations can be recovered."""
    e = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return K.recovery_scope(load(spark, sf_dir, "events").select(F.col("event_id").alias("id")), e, ["O", "P"])


@query("""SELECT l_orderkey AS run, count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_returnflag = 'N' GROUP BY 1""")
def ungated_matches(spark, sf_dir):
    """Matches of old reports that no publication gate has decided on."""
    gate = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    return K.ungated_matches(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_quantity") > 5).alias("has_product"), gate.alias("price_eligible")))


@query("""SELECT doc_id, substring(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 240) AS explanation, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 0 AS kept,
sha256('Previous sitemap identity: ' || substring(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 180) || ' (u)') AS audit FROM documents""")
def feedback_projections(spark, sf_dir):
    """Items of feedback with bounded texts, and the mark of a replaced record."""
    text = F.coalesce("text", F.lit(""))
    item = F.struct(F.lit("code").alias("issue_code"), F.lit("report").alias("subject_kind"), F.lit("x").alias("subject_id"), F.col("text").alias("explanation"), F.array(F.lit(" a "), F.lit("")).alias("evidence_ids"))
    d = load(spark, sf_dir, "documents").select("doc_id", K.feedback_items(F.array(item)).alias("items"), K.replacement_attribute(text, F.lit("u")).alias("audit"))
    kept = F.size("items") > 0
    return d.select("doc_id", F.when(kept, F.col("items")[0]["explanation"]).otherwise("").alias("explanation"), kept.alias("kept"), F.sha2(F.when(K.is_replaced(F.array("audit")), F.col("audit")), 256).alias("audit"))
