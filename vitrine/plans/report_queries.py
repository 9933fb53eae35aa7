"""Queries of discovery, planning, evaluation and presentation of reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions.numbers import clamp100, half_up
from ..operators import reports as R
from ..operators.aggregates import information_score, purchase_path, trust_score
from ..sources.tables import load
from .registry import query

# Merges and links


@query("""SELECT coalesce(a.id, b.id) AS id, coalesce(a.price, b.price) AS price, coalesce(a.category, b.category) AS category FROM
(SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price, p_type AS category FROM part WHERE p_size > 10) a
FULL JOIN (SELECT p_partkey AS id, p_retailprice + 1 AS price, 'catalog' AS category FROM part WHERE p_size < 30) b USING (id)""")
def fresh_over_catalog(spark, sf_dir):
    """Fresh records over the stored catalog, field by field."""
    p = load(spark, sf_dir, "part")
    fresh = p.filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("price"), F.col("p_type").alias("category"))
    stored = p.filter("p_size < 30").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + 1).alias("price"), F.lit("catalog").alias("category"))
    return R.overlay(fresh, stored, "id")


@query("""WITH r AS (SELECT o_orderkey AS id, [o_custkey % 40, o_custkey % 41, o_custkey % 43] AS claims FROM orders), c AS (SELECT DISTINCT s_suppkey AS claim FROM supplier WHERE s_acctbal > 5000)
SELECT id FROM r WHERE len(list_intersect(claims, (SELECT list(claim) FROM c))) > 0""")
def linked_recommendations(spark, sf_dir):
    """Recommendations that cite at least one claim that is there."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    cited = o.select(F.col("o_orderkey").alias("id"), F.array(k % 40, k % 41, k % 43).alias("claims"))
    claims = load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("claim"))
    return R.linked(cited, claims)


@query("""SELECT brand, sum(n)::BIGINT AS mentions, max(n)::BIGINT AS most, string_agg(p_type, ',' ORDER BY n DESC, p_type) AS types FROM (SELECT p_brand AS brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY brand""")
def merged_candidates(spark, sf_dir):
    """Candidates by domain: mentions add up, evidence is ordered."""
    c = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), "p_type").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "p_type"))), lambda s: s["p_type"])
    return c.groupBy("brand").agg(F.sum("n").alias("mentions"), F.max("n").alias("most"), F.array_join(ordered, ",").alias("types"))


@query("""SELECT name, min(p_partkey) AS id, max(p_retailprice) AS price, max(p_size) AS size, arg_min(p_type, p_partkey) AS category FROM (SELECT *, p_name AS name FROM part) GROUP BY name""")
def preferred_products(spark, sf_dir):
    """One record a product: the first one's category, the best observed fields of all."""
    p = load(spark, sf_dir, "part")
    return p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.max("p_retailprice").alias("price"), F.max("p_size").alias("size"), F.min_by("p_type", "p_partkey").alias("category"))


# Selection and plans


@query("""WITH m AS (SELECT p_partkey AS id, p_size > 25 AS matched, p_retailprice AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY matched ORDER BY CASE WHEN matched THEN -score ELSE 0 END, id) AS rn, count(*) FILTER (matched) OVER () AS n FROM m)
SELECT id, matched FROM r WHERE (matched AND rn <= 80) OR (NOT matched AND rn <= 16 - least(80, n))""")
def comparison_rows(spark, sf_dir):
    """Matched rows first, up to 80; unmatched ones fill up to 16."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("matched"), F.col("p_retailprice").alias("score"))
    return R.comparison_rows(p)


@query("""SELECT p_partkey AS id, p_brand AS domain FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn <= 4""")
def stable_sample(spark, sf_dir):
    """The best of each domain by rank, ties by key."""
    order = Window.partitionBy("p_brand").orderBy(F.col("p_size").desc(), "p_partkey")
    return load(spark, sf_dir, "part").withColumn("rn", F.row_number().over(order)).filter("rn <= 4").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"))


@query("""WITH RECURSIVE g AS (SELECT l_partkey % 50 AS run, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_partkey) AS i, count(*) AS pairs FROM lineitem GROUP BY l_partkey),
walk AS (SELECT run, 0::BIGINT AS i, 0::BIGINT AS rest, 0::INT AS batch, 0::BIGINT AS n, 0::BIGINT AS total, 0::BIGINT AS take FROM g GROUP BY run
UNION ALL SELECT run, i, rest - take, batch, n + 1, total + take, take FROM (SELECT *, least(rest, 25 - total) AS take FROM (SELECT w.run, g.i, CASE WHEN w.rest = 0 THEN g.pairs ELSE w.rest END AS rest,
w.batch + (w.total >= 25 OR w.n >= 6)::INT AS batch, CASE WHEN w.total >= 25 OR w.n >= 6 THEN 0 ELSE w.n END AS n, CASE WHEN w.total >= 25 OR w.n >= 6 THEN 0 ELSE w.total END AS total
FROM walk w JOIN g ON g.run = w.run AND g.i = CASE WHEN w.rest = 0 THEN w.i + 1 ELSE w.i END)))
SELECT run, batch, count(*)::INT AS groups, sum(take)::BIGINT AS pairs FROM walk WHERE take > 0 GROUP BY run, batch""")
def judge_batches(spark, sf_dir):
    """Candidate groups of a run packed into batches of at most 25 pairs and 6 groups."""
    g = load(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("run"), F.col("l_partkey").alias("ord")).agg(F.count(F.lit(1)).alias("pairs"))
    return R.batches(g, 25, 6)


@query("""WITH RECURSIVE p AS (SELECT l_orderkey % 20 AS run, l_partkey::VARCHAR AS a, 's' || l_suppkey AS b, row_number() OVER (PARTITION BY l_orderkey % 20 ORDER BY -l_extendedprice, l_orderkey, l_linenumber) AS i
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48),
walk AS (SELECT run, 0::BIGINT AS i, []::VARCHAR[] AS chosen, []::VARCHAR[] AS added FROM p GROUP BY run
UNION ALL SELECT run, i, CASE WHEN len(chosen) + len(fresh) <= 30 THEN list_concat(chosen, fresh) ELSE chosen END, CASE WHEN len(chosen) + len(fresh) <= 30 THEN fresh ELSE [] END
FROM (SELECT w.run, p.i, w.chosen, [x FOR x IN [p.a, p.b] IF NOT list_contains(w.chosen, x)] AS fresh FROM walk w JOIN p ON p.run = w.run AND p.i = w.i + 1))
SELECT run, unnest(added) AS page FROM walk""")
def enrichment_targets(spark, sf_dir):
    """Pages to fetch within a budget: both sides of a pair or neither, a page is paid for once."""
    l = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 48")
    pairs = l.select((F.col("l_orderkey") % 20).alias("run"), F.struct((-F.col("l_extendedprice")).alias("s"), "l_orderkey", "l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return R.pair_targets(pairs, 30)


@query("""SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN 'primary' WHEN s_acctbal > 9000 THEN 'anchor' ELSE 'rest' END AS lane FROM supplier ORDER BY CASE WHEN s_nationkey = 3 THEN 0 WHEN s_acctbal > 9000 THEN 1 ELSE 2 END, s_suppkey LIMIT 30""")
def anchored_catalog(spark, sf_dir):
    """A bounded catalog, anchors first."""
    lane = F.when(F.col("s_nationkey") == 3, 0).when(F.col("s_acctbal") > 9000, 1).otherwise(2)
    s = load(spark, sf_dir, "supplier").withColumn("l", lane).orderBy("l", "s_suppkey").limit(30)
    return s.select(F.col("s_suppkey").alias("id"), F.when(F.col("l") == 0, "primary").when(F.col("l") == 1, "anchor").otherwise("rest").alias("lane"))


@query("""SELECT c_custkey AS domain_id, c_acctbal AS score FROM customer WHERE c_acctbal > 0 AND c_custkey % 30 < 20 ORDER BY c_acctbal DESC, c_custkey LIMIT 500""")
def remembered_competitors(spark, sf_dir):
    """Remembered companies that are still fresh, best first, at most 500."""
    c = load(spark, sf_dir, "customer").filter("c_acctbal > 0 AND c_custkey % 30 < 20").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(500)
    return c.select(F.col("c_custkey").alias("domain_id"), F.col("c_acctbal").alias("score"))


@query("""SELECT user_id, k, granted FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_id) <= 3 AS granted, event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) WHERE granted""")
def grants_per_plan(spark, sf_dir):
    """At most three grants a run, the strongest first."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    order = Window.partitionBy("user_id").orderBy(F.col("k").desc(), "event_id")
    return e.withColumn("rn", F.row_number().over(order)).filter("rn <= 3").select("user_id", "k", F.lit(True).alias("granted"))


# Texts, URLs and guards


@query("""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) AS depth,
lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) NOT LIKE '%.example' AS public FROM pages""")
def page_hosts(spark, sf_dir):
    """Hosts, path depth and whether a host is public."""
    p = load(spark, sf_dir, "pages")
    host = U.page_host("url")
    return p.select("page_id", host.alias("host"), F.size(U.path_segments("url")).cast("long").alias("depth"), U.is_public_host(host).alias("public"))


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/[a-z]{2}(/|$)', '\\1'), '/+$', ''), '^([^/]+)$', '\\1/') AS neutral FROM pages""")
def locale_neutral_pages(spark, sf_dir):
    """Pages without their language segment and query."""
    return load(spark, sf_dir, "pages").select("page_id", U.locale_neutral_url("url").alias("neutral"))


@query("""SELECT host, CASE WHEN n >= 3 THEN 'catalog' WHEN n = 2 THEN 'pair' ELSE 'single' END AS kind, n FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, count(DISTINCT regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS n FROM pages GROUP BY 1)""")
def seeded_paths(spark, sf_dir):
    """Distinct paths of a host that a crawl starts from."""
    g = load(spark, sf_dir, "pages").groupBy(U.page_host("url").alias("host")).agg(F.count_distinct(U.url_path("url")).alias("n"))
    return g.select("host", F.when(F.col("n") >= 3, "catalog").when(F.col("n") == 2, "pair").otherwise("single").alias("kind"), "n")


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(date_trunc('millisecond', ts), '%Y-02-31T%H:%M:%S.%gZ') ELSE strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso, event_id % 5 < 3 AS strict FROM events""")
def strict_timestamps(spark, sf_dir):
    """Times in the one strict form, and that they survive parsing."""
    k = F.col("event_id") % 5
    form = lambda f: F.date_format("ts", f)
    iso = F.when(k == 4, form("yyyy-MM-dd HH:mm:ss")).when(k == 3, form("yyyy-'02-31T'HH:mm:ss.SSS'Z'")).otherwise(form("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    e = load(spark, sf_dir, "events").withColumn("iso", iso)
    return e.select("event_id", "iso", R.is_strict_iso("iso").alias("strict"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) > 0 AS has_numbers, regexp_matches(lower(text), '([a-z0-9-]+\\.)+[a-z]{2,}') AS maybe_domain FROM documents""")
def grounding_tokens(spark, sf_dir):
    """Numbers and domains that a draft must be grounded in."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", (F.size(X.numbers_in("text")) > 0).alias("has_numbers"), F.lower("text").rlike(r"([a-z0-9-]+\.)+[a-z]{2,}").alias("maybe_domain"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'Rival lists a lower price: USD ' || printf('%.2f', -s_acctbal) WHEN s_acctbal > 9000 THEN 'Prices are equal' ELSE 'You list a lower price: USD ' || printf('%.2f', s_acctbal) END AS claim FROM supplier""")
def claim_copy(spark, sf_dir):
    """What a price claim says."""
    a = F.col("s_acctbal")
    claim = F.when(a < 0, F.concat(F.lit("Rival lists a lower price: USD "), F.format_string("%.2f", -a))).when(a > 9000, "Prices are equal").otherwise(F.concat(F.lit("You list a lower price: USD "), F.format_string("%.2f", a)))
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), claim.alias("claim"))


# Scores and verdicts


@query("""SELECT user_id, CASE WHEN c THEN 1 WHEN a AND l THEN 2 WHEN a THEN 3 WHEN l THEN 2 END AS steps, CASE WHEN a OR l OR c THEN (p::INT * 20 + a::INT * 35 + l::INT * 20 + c::INT * 25) END AS score FROM
(SELECT user_id, bool_or(event_type = 'view') AS p, bool_or(event_type = 'click') AS a, bool_or(event_type = 'signup') AS l, bool_or(event_type = 'purchase') AS c FROM events GROUP BY 1)""")
def purchase_paths(spark, sf_dir):
    """Score and least steps of the way to a purchase."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(*(F.max(F.col("event_type") == k).alias(k) for k in ("view", "click", "signup", "purchase")))
    return e.withColumn("s", purchase_path(F.col("view"), F.col("click"), F.col("signup"), F.col("purchase"))).select("user_id", "s.steps", F.col("s.score").cast("int").alias("score"))


@query("""SELECT user_id, 20 * count(DISTINCT event_type) AS score FROM events GROUP BY 1""")
def trust_scores(spark, sf_dir):
    """20 points for each distinct kind of trust signal."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(trust_score(F.collect_set("event_type")).alias("score"))


@query("""SELECT p_brand AS domain, floor((count(*) + sum((p_size > 20)::INT) + sum((p_retailprice > 950)::INT)) * 100.0 / (3 * count(*)) + 0.5)::BIGINT AS score FROM part GROUP BY 1""")
def information_scores(spark, sf_dir):
    """Completed public fields of a catalog."""
    g = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("domain"))
    return g.agg(information_score(F.col("p_name") != "", F.col("p_size") > 20, F.col("p_retailprice") > 950).alias("score"))


@query("""SELECT o_custkey AS run_id, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 30 WHEN count(*) < 5 THEN 45 WHEN max(o_totalprice) < 300000 THEN 55 END AS cap FROM orders GROUP BY 1""")
def hard_caps(spark, sf_dir):
    """The lowest hard cap that holds for a run."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    return o.select("run_id", R.lowest_cap([(F.col("f") == 0, 30), (F.col("n") < 5, 45), (F.col("m") < 300000, 55)]).alias("cap"))


@query("""SELECT o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM (SELECT DISTINCT ON (o_custkey, o_orderpriority) * FROM orders ORDER BY o_custkey, o_orderpriority, o_totalprice DESC, o_orderkey)) ORDER BY rn, o_totalprice DESC, o_orderkey LIMIT 48""")
def evidence_catalog(spark, sf_dir):
    """48 pieces of evidence: each once, spread over domains, best first."""
    best = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    o = load(spark, sf_dir, "orders").withColumn("n", F.row_number().over(best)).filter("n = 1")
    turn = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.withColumn("rn", F.row_number().over(turn)).orderBy("rn", F.col("o_totalprice").desc(), "o_orderkey").limit(48).select(F.col("o_orderkey").alias("id"))


@query("""WITH p AS (SELECT c_nationkey AS market, avg(c_acctbal) AS mean FROM customer GROUP BY 1) SELECT c_custkey AS id, CASE WHEN c_acctbal > mean * 1.2 THEN 'ahead' WHEN c_acctbal < mean * 0.8 THEN 'behind' ELSE 'level' END AS stand FROM customer JOIN p ON market = c_nationkey""")
def stand_against_market(spark, sf_dir):
    """Where a company stands against the mean of its market."""
    c = load(spark, sf_dir, "customer")
    mean = c.groupBy(F.col("c_nationkey").alias("market")).agg(F.avg("c_acctbal").alias("mean"))
    j = c.join(mean, c["c_nationkey"] == mean["market"])
    return j.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > F.col("mean") * 1.2, "ahead").when(F.col("c_acctbal") < F.col("mean") * 0.8, "behind").otherwise("level").alias("stand"))


@query("""SELECT sha256(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS anchor_hash, p_brand AS domain FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 1000 GROUP BY p_brand""")
def anchor_hashes(spark, sf_dir):
    """A hash of the sorted anchors of each domain; a catalog searches for at most 1000."""
    first = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = load(spark, sf_dir, "part").select("p_brand", "p_partkey").withColumn("n", F.row_number().over(first)).filter("n <= 1000")
    g = p.groupBy(F.col("p_brand").alias("domain")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("ids"))
    return g.select(F.sha2("ids", 256).alias("anchor_hash"), "domain")


@query("""SELECT p_type AS category, floor(avg(CASE WHEN p_size > 10 THEN p_size END) + 0.5)::BIGINT AS observed, greatest(0, least(100, floor(sum(p_size) / 10.0 + 0.5)))::BIGINT AS capped FROM part GROUP BY 1""")
def observed_means(spark, sf_dir):
    """Means over what was observed, and a capped sum."""
    g = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category"))
    return g.agg(half_up(F.avg(F.when(F.col("p_size") > 10, F.col("p_size")))).alias("observed"), clamp100(F.sum("p_size") / 10).alias("capped"))


@query("""SELECT r_name AS region, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name, o_orderstatus), (r_name), ())""")
def grouping_sets(spark, sf_dir):
    """Counts by region and status, by region, and in all."""
    o, c, n, r = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    by = o.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("k")).join(c, F.col("o_custkey") == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return by.rollup(F.col("r_name").alias("region"), F.col("o_orderstatus").alias("status")).agg(F.sum("k").alias("n"))
