"""Relational queries of the report store.

The local tables stand in for the store's: orders for runs, part for products (p_brand is the
rival domain), lineitem for matches, events for run events, customer for workspaces. Every
order ends in a key, time is an argument, and pages are read by key, never by offset.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ordered import exact_percentiles, running_sum
from ..sources.tables import load
from .registry import query

AS_OF = "2000-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-30 00:00:00"


def t(spark, sf_dir: str, *names: str):
    found = [load(spark, sf_dir, n) for n in names]
    return found[0] if len(found) == 1 else found


def at(ts: str):
    return F.to_timestamp(F.lit(ts))


# Filters, projection, pages


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, o_totalprice AS cost FROM orders WHERE o_orderkey = 42 LIMIT 1")
def point_lookup(spark, sf_dir):
    """A run by its id."""
    o = t(spark, sf_dir, "orders")
    return o.filter("o_orderkey = 42").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost")).limit(1)


@query("""SELECT o_orderkey AS run_id, o_orderpriority AS phase FROM orders
WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderkey BETWEEN 100 AND 2000 AND o_orderpriority LIKE '3-%'""")
def status_sets_and_ranges(spark, sf_dir):
    """Membership, exclusion, range and prefix predicates; all reach the scan."""
    o = t(spark, sf_dir, "orders")
    return o.filter(
        F.col("o_orderstatus").isin("O", "P") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderkey").between(100, 2000) & F.col("o_orderpriority").startswith("3-")
    ).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("phase"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE coalesce(json_extract_string(props, '$.k'), '') <> '' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50""")
def json_path_filter(spark, sf_dir):
    """Predicates on a path of JSON text; missing and empty are alike."""
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.filter((F.coalesce("k", F.lit("")) != "") & (F.col("k").cast("long") >= 50)).select("event_id", F.col("k").cast("long").alias("k"))


@query("""SELECT c_custkey AS workspace_id, CASE WHEN c_acctbal < 0 THEN 'debit' WHEN c_acctbal > 5000 THEN 'large' ELSE 'normal' END AS tier,
coalesce(nullif(c_mktsegment, 'MACHINERY'), 'other') AS segment FROM customer""")
def case_and_coalesce(spark, sf_dir):
    """Ordered CASE, and a default for an empty value."""
    tier = F.when(F.col("c_acctbal") < 0, "debit").when(F.col("c_acctbal") > 5000, "large").otherwise("normal")
    return t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("workspace_id"), tier.alias("tier"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("other")).alias("segment")
    )


@query("""SELECT m.l_orderkey AS match_row, m.l_linenumber AS line, p.p_name AS product, r.s_name AS rival FROM lineitem m
JOIN part p ON p.p_partkey = m.l_partkey JOIN supplier r ON r.s_suppkey = m.l_suppkey
WHERE m.l_returnflag = 'A' AND (m.l_orderkey > 500 OR (m.l_orderkey = 500 AND m.l_linenumber > 2))
ORDER BY m.l_orderkey, m.l_linenumber, m.l_partkey, m.l_suppkey, m.l_extendedprice LIMIT 101""")
def match_page_keyset(spark, sf_dir):
    """A page of matches after a key, one row more than the page holds to tell whether another follows."""
    m, p, r = t(spark, sf_dir, "lineitem", "part", "supplier")
    page = m.filter((F.col("l_returnflag") == "A") & ((F.col("l_orderkey") > 500) | ((F.col("l_orderkey") == 500) & (F.col("l_linenumber") > 2))))
    page = page.join(p, p["p_partkey"] == page["l_partkey"]).join(r, r["s_suppkey"] == page["l_suppkey"])
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return page.orderBy(*order).limit(101).select(
        F.col("l_orderkey").alias("match_row"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("product"), F.col("s_name").alias("rival")
    )


@query("""SELECT user_id, event_id, event_type FROM events WHERE (user_id < 50 OR (user_id = 50 AND event_id > 1000)) ORDER BY user_id DESC, event_id LIMIT 25""")
def mixed_direction_keyset(spark, sf_dir):
    """A page in descending attempts and ascending batches."""
    e = t(spark, sf_dir, "events").filter("user_id < 50 OR (user_id = 50 AND event_id > 1000)")
    return e.orderBy(F.col("user_id").desc(), "event_id").limit(25).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey AS workspace_id, o_orderkey AS run_id, o_orderdate AS created_at FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def workspace_history(spark, sf_dir):
    """The latest runs of a workspace."""
    o = t(spark, sf_dir, "orders").filter("o_custkey = 7").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50)
    return o.select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))


@query("SELECT event_id, user_id FROM events ORDER BY (event_id = 77) DESC, event_id LIMIT 1")
def preferred_row_first(spark, sf_dir):
    """One row, a wanted one before all others."""
    return t(spark, sf_dir, "events").orderBy((F.col("event_id") == 77).desc(), "event_id").limit(1).select("event_id", "user_id")


@query("SELECT * FROM (SELECT event_id, ts FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 20)")
def last_n_ascending(spark, sf_dir):
    """The last rows of a log, in ascending order."""
    return t(spark, sf_dir, "events").filter("user_id = 8").orderBy(F.col("event_id").desc()).limit(20).orderBy("event_id").select("event_id", "ts")


@query("SELECT p_brand AS key, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY p_brand HAVING count(*) > 1")
def partial_unique_violations(spark, sf_dir):
    """Values that break a uniqueness that holds for all but empty ones."""
    return t(spark, sf_dir, "part").filter("p_brand <> ''").groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT doc_id, md5(text) AS hash FROM documents WHERE length(md5(text)) = 32 AND regexp_matches(md5(text), '^[0-9a-f]{32}$')")
def hash_guards(spark, sf_dir):
    """Rows whose hash has the right length and digits."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    return d.filter((F.length("hash") == 32) & F.col("hash").rlike("^[0-9a-f]{32}$"))


# Joins


@query("""SELECT o.o_orderkey AS run_id, c.c_name AS workspace, n.n_name AS market FROM orders o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def run_with_optional_facts(spark, sf_dir):
    """Runs with what is known of their workspace."""
    o, c, n = t(spark, sf_dir, "orders", "customer", "nation")
    j = o.join(c.filter("c_acctbal > 0"), o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return j.select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("workspace"), F.col("n_name").alias("market"))


@query("""SELECT r.r_name AS region, count(*) AS matches, round(sum(l.l_extendedprice), 2) AS value FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name""")
def five_way_star(spark, sf_dir):
    """A star of five tables; matches are counted by order before they meet the dimensions."""
    l, o, c, n, r = t(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    by_run = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("m"), F.sum("l_extendedprice").alias("v"))
    j = by_run.join(o, by_run["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    j = j.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy(F.col("r_name").alias("region")).agg(F.sum("m").alias("matches"), F.round(F.sum("v"), 2).alias("value"))


@query("SELECT c_custkey AS workspace_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def unacknowledged_anti_join(spark, sf_dir):
    """Workspaces without a finished run."""
    c, o = t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'F'"), c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("c_custkey").alias("workspace_id"))


@query("""SELECT o_orderkey AS outbox_id FROM orders LEFT JOIN (SELECT user_id, max(ts) AS leased_until FROM events GROUP BY user_id) e ON e.user_id = o_custkey
WHERE o_orderstatus = 'O' AND (e.user_id IS NULL OR e.leased_until <= TIMESTAMP '2024-01-30 00:00:00')""")
def claimable_leases(spark, sf_dir):
    """Outbox rows without a lease or with one that ran out."""
    o, e = t(spark, sf_dir, "orders", "events")
    lease = e.groupBy("user_id").agg(F.max("ts").alias("leased_until"))
    j = o.filter("o_orderstatus = 'O'").join(lease, o["o_custkey"] == lease["user_id"], "left")
    return j.filter(F.col("user_id").isNull() | (F.col("leased_until") <= at(EVENTS_AS_OF))).select(F.col("o_orderkey").alias("outbox_id"))


@query("""SELECT s_suppkey AS rival_id FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09)
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_returnflag = 'R' AND l_linestatus = 'O')""")
def semi_and_double_anti(spark, sf_dir):
    """Rivals with one kind of match and without another."""
    s, l = t(spark, sf_dir, "supplier", "lineitem")
    some = l.filter("l_discount > 0.09").select("l_suppkey")
    none = l.filter("l_quantity > 49 AND l_returnflag = 'R' AND l_linestatus = 'O'").select("l_suppkey")
    keep = s.join(some, s["s_suppkey"] == some["l_suppkey"], "left_semi")
    return keep.join(none, keep["s_suppkey"] == none["l_suppkey"], "left_anti").select(F.col("s_suppkey").alias("rival_id"))


@query("""SELECT q.o_orderkey AS run_id, c.c_name AS workspace FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 30) q
JOIN customer c ON c.c_custkey = q.o_custkey""")
def join_on_queue_head(spark, sf_dir):
    """The head of a queue, joined only after it is cut."""
    o, c = t(spark, sf_dir, "orders", "customer")
    head = o.filter("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(30)
    return head.join(c, head["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("workspace"))


@query("SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def unknown_references(spark, sf_dir):
    """Referenced products that the run does not know."""
    l, p = t(spark, sf_dir, "lineitem", "part")
    known = p.filter("p_size <= 25")
    return l.select("l_partkey").distinct().join(known, F.col("l_partkey") == known["p_partkey"], "left_anti").select(F.col("l_partkey").alias("product_id"))


@query("""SELECT DISTINCT a.p_name AS product_name FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand""")
def id_collisions_across_runs(spark, sf_dir):
    """Names that two brands share: counted by name, not joined pairwise."""
    p = t(spark, sf_dir, "part")
    return p.groupBy("p_name").agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b")).filter("a <> b").select(F.col("p_name").alias("product_name"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages),
d(domain) AS (VALUES ('example.com'), ('example.org'), ('blog.theren.example.net'))
SELECT page_id, host, domain FROM h JOIN d ON host = domain OR ends_with(host, '.' || domain)""")
def domain_suffix_ownership(spark, sf_dir):
    """Pages of a domain or one of its subdomains: host suffixes are exploded, so the join is an equality."""
    from ..functions.urls import host_suffixes, page_host

    p = t(spark, sf_dir, "pages").select("page_id", page_host("url").alias("host"))
    d = spark.createDataFrame([("example.com",), ("example.org",), ("blog.theren.example.net",)], "domain string")
    return p.withColumn("domain", F.explode(host_suffixes("host"))).join(F.broadcast(d), "domain").select("page_id", "host", "domain")


@query("""SELECT o_orderkey AS run_id FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01 00:00:00' AND o_orderdate >= TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 30 DAY""")
def freshness_window(spark, sf_dir):
    """Evidence of the last 30 days as of a time."""
    o = t(spark, sf_dir, "orders")
    return o.filter((F.col("o_orderdate") <= at(AS_OF)) & (F.col("o_orderdate") >= at(AS_OF) - F.expr("INTERVAL 30 DAYS"))).select(F.col("o_orderkey").alias("run_id"))


# Subqueries


@query("""SELECT event_id, user_id, coalesce((SELECT max(e2.event_id) FROM events e2 WHERE e2.user_id < events.user_id AND e2.user_id >= events.user_id - 1), 0) + 1 AS next_seq
FROM events WHERE event_type = 'signup'""")
def next_sequence(spark, sf_dir):
    """The next number after the largest of a key, by one aggregation and a join."""
    e = t(spark, sf_dir, "events")
    most = e.groupBy((F.col("user_id") + 1).alias("user_id")).agg(F.max("event_id").alias("m"))
    rows = e.filter("event_type = 'signup'").join(most, "user_id", "left")
    return rows.select("event_id", "user_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_seq"))


@query("""SELECT user_id, event_id, event_type FROM events e WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)""")
def latest_event_per_user(spark, sf_dir):
    """The latest row of each key in one aggregation."""
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("last"))
    return e.select("user_id", "last.event_id", "last.event_type")


@query("""SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id) WHERE state = 'purchase'""")
def latest_state_guard(spark, sf_dir):
    """Keys whose latest event is the expected one."""
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"))
    return e.filter("state = 'purchase'").select("user_id")


@query("""SELECT (SELECT count(*) FROM orders) AS runs, (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM lineitem) AS matches, (SELECT count(*) FROM events) AS events""")
def audit_counts(spark, sf_dir):
    """Row counts of several tables in one row: labelled rows, one aggregation."""
    names = {"runs": "orders", "products": "part", "matches": "lineitem", "events": "events"}
    rows = None
    for label, name in names.items():
        one = t(spark, sf_dir, name).select(F.lit(label).alias("label"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*(F.count(F.when(F.col("label") == k, 1)).alias(k) for k in names))


@query("""WITH RECURSIVE link AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey - n_nationkey % 7 + (n_nationkey % 7 - 1) END AS parent FROM nation),
walk AS (SELECT id AS start, id, parent, 0 AS depth FROM link UNION ALL SELECT w.start, l.id, l.parent, w.depth + 1 FROM walk w JOIN link l ON l.id = w.parent WHERE w.depth < 20)
SELECT start, max(depth) AS depth, arg_max(id, depth) AS origin FROM walk GROUP BY start""")
def recovery_chain(spark, sf_dir):
    """Adopted attempts are followed to their origin; the depth is bounded, so a cycle ends."""
    t(spark, sf_dir, "nation").createOrReplaceTempView("chain_nation")
    return spark.sql("""
        WITH RECURSIVE walk(start, id, parent, depth) AS (
          SELECT id, id, parent, 0 FROM (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey - 1 END AS parent FROM chain_nation)
          UNION ALL
          SELECT w.start, l.id, l.parent, w.depth + 1 FROM walk w
          JOIN (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey - 1 END AS parent FROM chain_nation) l ON l.id = w.parent WHERE w.depth < 20)
        SELECT start, max(depth) AS depth, max_by(id, depth) AS origin FROM walk GROUP BY start""")


# Aggregation


@query("SELECT p.p_brand AS rival_domain, count(*) AS pairs FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_returnflag = 'A' GROUP BY p.p_brand")
def pair_counts_by_rival(spark, sf_dir):
    """Matches of each rival domain; matches are counted by product before the join."""
    l, p = t(spark, sf_dir, "lineitem", "part")
    by = l.filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return by.join(p, by["l_partkey"] == p["p_partkey"]).groupBy(F.col("p_brand").alias("rival_domain")).agg(F.sum("n").alias("pairs"))


@query("""SELECT date_trunc('day', o_orderdate) AS day, round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END), 2) AS known_cost,
count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS unknown FROM orders GROUP BY 1""")
def daily_budget_conditional_sum(spark, sf_dir):
    """Known cost and unknown runs of each day, in one pass."""
    o = t(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(
        F.round(F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(0.0)), 2).alias("known_cost"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("unknown")
    )


@query("""SELECT count(*) AS pending, min(o_orderdate) AS oldest, count(*) = 100 AS pending_is_lower_bound FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100)""")
def bounded_queue_summary(spark, sf_dir):
    """Size and age of the head of a queue, and whether the size is a lower bound."""
    q = t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderkey").limit(100)
    return q.agg(F.count(F.lit(1)).alias("pending"), F.min("o_orderdate").alias("oldest")).withColumn("pending_is_lower_bound", F.col("pending") == 100)


@query("""SELECT o_custkey AS workspace_id, count(*) AS used FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' GROUP BY o_custkey""")
def usage_per_period(spark, sf_dir):
    """Reports that count against a period, start included and end excluded."""
    o = t(spark, sf_dir, "orders")
    o = o.filter(F.col("o_orderstatus").isin("O", "F") & (F.col("o_orderdate") >= at("1999-01-01 00:00:00")) & (F.col("o_orderdate") < at("2000-01-01 00:00:00")))
    return o.groupBy(F.col("o_custkey").alias("workspace_id")).agg(F.count(F.lit(1)).alias("used"))


@query("SELECT l_orderkey AS run_id, count(DISTINCT l_suppkey) AS rivals FROM lineitem GROUP BY l_orderkey")
def distinct_rivals_per_run(spark, sf_dir):
    """Exact distinct counts."""
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count_distinct("l_suppkey").alias("rivals"))


@query("""SELECT l_suppkey AS rival_id, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS reasons FROM
(SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def frequency_map(spark, sf_dir):
    """Reasons and their counts of each rival, as one ordered text of a map."""
    l = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "l_returnflag", "n")))
    return l.groupBy(F.col("l_suppkey").alias("rival_id")).agg(F.array_join(pairs, ",").alias("reasons"))


@query("""SELECT l_suppkey AS rival_id, CASE WHEN count(*) % 2 = 1 THEN median(l_quantity) ELSE floor(median(l_quantity) + 0.5) END AS middle FROM lineitem GROUP BY l_suppkey""")
def median_by_group(spark, sf_dir):
    """Medians; an even number of values gives the rounded mean of the two in the middle."""
    from ..functions.numbers import rounded_median

    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rival_id")).agg(rounded_median("l_quantity").alias("middle"))


@query("""SELECT l_orderkey AS run_id, round(sum(CASE WHEN l_discount > 0.02 THEN l_quantity * l_discount END) / sum(CASE WHEN l_discount > 0.02 THEN l_quantity END), 10) AS score FROM lineitem GROUP BY l_orderkey""")
def weighted_mean_of_observed(spark, sf_dir):
    """A weighted mean over observed values only; none observed gives null."""
    from ..functions.numbers import observed_mean

    seen = F.when(F.col("l_discount") > 0.02, F.col("l_discount"))
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.round(observed_mean(seen, F.col("l_quantity")), 10).alias("score"))


@query("""SELECT brand, arg_max(p_type, (n, p_type)) AS category, max(n) AS n FROM (SELECT p_brand AS brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY brand""")
def most_frequent_category(spark, sf_dir):
    """The most frequent category of each brand; ties go to the larger name."""
    c = t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), "p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("brand").agg(F.max(F.struct("n", "p_type")).alias("m")).select("brand", F.col("m.p_type").alias("category"), F.col("m.n").alias("n"))


@query("""SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, count(*) AS n FROM lineitem GROUP BY 1""")
def panel_percentiles(spark, sf_dir):
    """Interpolated percentiles of a panel."""
    l = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return exact_percentiles(l, "flag", "l_extendedprice", [0.5, 0.95]).select("flag", F.round("p0", 4).alias("p50"), F.round("p1", 4).alias("p95"), "n")


@query("""SELECT o_custkey AS workspace_id, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS phases FROM orders GROUP BY o_custkey""")
def attempt_totals(spark, sf_dir):
    """Sums, maxima and unions over the attempts of a key."""
    o = t(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("workspace_id")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("most"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("phases")
    )


@query("""SELECT event_id, CAST(ceil((CAST(json_extract_string(props, '$.k') AS BIGINT) * 250 + 40 * 1000) / 100.0) AS BIGINT) AS micro_usd FROM events""")
def usage_cost(spark, sf_dir):
    """Token cost, rounded up to whole units."""
    e = t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.ceil((k * 250 + 40 * 1000) / F.lit(100.0)).alias("micro_usd"))


# Windows


@query("""SELECT l_partkey AS primary_id, l_suppkey AS rival_id, l_extendedprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def top_one_per_primary(spark, sf_dir):
    """The strongest match of each primary product."""
    order = Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_suppkey")
    l = t(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return l.select(F.col("l_partkey").alias("primary_id"), F.col("l_suppkey").alias("rival_id"), F.col("l_extendedprice").alias("score"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r1 FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS r2 FROM a WHERE r1 <= 2)
SELECT l_partkey AS primary_id, l_suppkey AS rival_id, l_orderkey AS ord, l_linenumber AS line, r2 AS rank FROM b WHERE r2 <= 5""")
def top_k_per_rival_then_primary(spark, sf_dir):
    """The best of each rival, then the best of each primary: two stacked group limits."""
    l = t(spark, sf_dir, "lineitem")
    score = F.col("l_extendedprice").desc()
    l = l.withColumn("r1", F.row_number().over(Window.partitionBy("l_partkey", "l_suppkey").orderBy(score, "l_orderkey", "l_linenumber"))).filter("r1 <= 2")
    l = l.withColumn("rank", F.row_number().over(Window.partitionBy("l_partkey").orderBy(score, "l_orderkey", "l_linenumber", "l_suppkey"))).filter("rank <= 5")
    return l.select(F.col("l_partkey").alias("primary_id"), F.col("l_suppkey").alias("rival_id"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey AS run_id, (SELECT count(*) FROM orders) > 500 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""")
def global_budget(spark, sf_dir):
    """The best rows within a budget, and whether any were left out."""
    o = t(spark, sf_dir, "orders")
    kept = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(500).select(F.col("o_orderkey").alias("run_id"))
    more = o.agg((F.count(F.lit(1)) > 500).alias("truncated"))
    return kept.join(F.broadcast(more))


@query("""SELECT p_partkey AS product_id, p_type AS category FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
ORDER BY rn > 1, p_retailprice DESC, p_partkey LIMIT 12""")
def diverse_then_fill(spark, sf_dir):
    """One product of each category first, then the best of the rest."""
    order = Window.partitionBy("p_type").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    # No more of one category can be among the first twelve: tasks keep twelve of each before the shuffle.
    p = t(spark, sf_dir, "part").withColumn("rn", F.row_number().over(order)).filter("rn <= 12")
    return p.orderBy(F.col("rn") > 1, F.col("p_retailprice").desc(), "p_partkey").limit(12).select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))


@query("""SELECT user_id, event_id, event_type, lead(event_type) OVER w AS next_type, row_number() OVER w AS seq,
epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def event_sequence_and_gap(spark, sf_dir):
    """The number, successor and distance of each event of a key."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", F.lead("event_type").over(w).alias("next_type"), F.row_number().over(w).cast("long").alias("seq"), (us - F.lag(us).over(w)).alias("gap_us")
    )


@query("""SELECT l_orderkey AS run_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CAST(floor((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) / 3) AS BIGINT) AS batch FROM lineitem""")
def pairs_per_batch(spark, sf_dir):
    """Batches of at most three pairs of a run."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.floor((F.row_number().over(w) - 1) / 3).alias("batch")
    )


# Sets and changes of state


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' UNION SELECT p_partkey FROM part WHERE p_size < 3")
def union_distinct_ids(spark, sf_dir):
    """The union of two lists of ids."""
    l, p = t(spark, sf_dir, "lineitem", "part")
    return l.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("id")).union(p.filter("p_size < 3").select("p_partkey")).distinct()


@query("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def missed_candidates(spark, sf_dir):
    """Known ids that were not verified."""
    p, l = t(spark, sf_dir, "part", "lineitem")
    return p.join(l.filter("l_quantity > 45"), p["p_partkey"] == l["l_partkey"], "left_anti").select(F.col("p_partkey").alias("id")).distinct()


@query("SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY ALL")
def first_and_last_wins(spark, sf_dir):
    """The survivors of both rules for repeated keys, with the order as a column."""
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""SELECT p_name AS name, arg_max(p_partkey, (p_size, p_retailprice, -p_partkey)) AS best FROM part GROUP BY p_name""")
def best_quality_wins(spark, sf_dir):
    """The richest fact of each key; ties go to the smaller id."""
    p = t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.max_by("p_partkey", F.struct("p_size", "p_retailprice", -F.col("p_partkey"))).alias("best"))
    return p


@query("""SELECT coalesce(n.user_id, o.c_custkey) AS id, coalesce(n.v, o.c_acctbal) AS value, CASE WHEN n.user_id IS NULL THEN 'kept' WHEN o.c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS what
FROM customer o FULL JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id) n ON n.user_id = o.c_custkey""")
def upsert(spark, sf_dir):
    """Insert or update by key as a rewrite: the latest change of a key wins over the stored row."""
    c, e = t(spark, sf_dir, "customer", "events")
    new = e.groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    j = c.join(new, c["c_custkey"] == new["user_id"], "full")
    what = F.when(F.col("user_id").isNull(), "kept").when(F.col("c_custkey").isNull(), "inserted").otherwise("updated")
    return j.select(F.coalesce("user_id", "c_custkey").alias("id"), F.coalesce("v", "c_acctbal").alias("value"), what.alias("what"))


@query("SELECT user_id, min(event_id) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal < 0) GROUP BY user_id")
def insert_if_absent(spark, sf_dir):
    """Rows whose key is not stored yet, the first of each key."""
    e, c = t(spark, sf_dir, "events", "customer")
    return e.join(c.filter("c_acctbal < 0"), e["user_id"] == c["c_custkey"], "left_anti").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("""SELECT user_id, event_id, ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stale FROM events WHERE event_type = 'purchase'""")
def stale_updates(spark, sf_dir):
    """Updates that are older than one that came before them."""
    e = t(spark, sf_dir, "events").filter("event_type = 'purchase'")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("user_id", "event_id", (F.col("ts") < F.max("ts").over(w)).alias("stale"))


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 60 DAY THEN 'X' ELSE o_orderstatus END AS status FROM orders""")
def guarded_transition(spark, sf_dir):
    """A change of state only from the expected state."""
    due = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < at(AS_OF) - F.expr("INTERVAL 60 DAYS"))
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(due, "X").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01 00:00:00' AND o_orderstatus = 'F')
SELECT l_orderkey AS run_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM e)""")
def cascade_delete(spark, sf_dir):
    """Child rows that outlive the deletion of expired parents."""
    o, l = t(spark, sf_dir, "orders", "lineitem")
    gone = o.filter((F.col("o_orderdate") <= at(AS_OF)) & (F.col("o_orderstatus") == "F"))
    left = l.join(gone, l["l_orderkey"] == gone["o_orderkey"], "left_anti")
    return left.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


@query("""WITH e AS (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01 00:00:00' AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 25)
SELECT (SELECT count(*) FROM e) AS runs, (SELECT count(*) FROM lineitem SEMI JOIN e ON l_orderkey = o_orderkey) AS matches,
(SELECT count(*) FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01 00:00:00' AND o_orderstatus = 'F') - (SELECT count(*) FROM e) AS remaining""")
def retention_pass(spark, sf_dir):
    """One pass of the retention: the oldest 25 eligible runs, what goes with them, and how many stay eligible."""
    o, l = t(spark, sf_dir, "orders", "lineitem")
    due = o.filter((F.col("o_orderdate") <= at(AS_OF)) & (F.col("o_orderstatus") == "F"))
    now = due.orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey")
    matches = l.join(F.broadcast(now), l["l_orderkey"] == now["o_orderkey"], "left_semi").agg(F.count(F.lit(1)).alias("matches"))
    runs = now.agg(F.count(F.lit(1)).alias("runs"))
    left = due.agg(F.count(F.lit(1)).alias("due"))
    return runs.join(F.broadcast(matches)).join(F.broadcast(left)).select("runs", "matches", (F.col("due") - F.col("runs")).alias("remaining"))


@query("""SELECT o_orderkey AS run_id FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_linenumber) AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE n >= 4 AND s > 12""")
def manifest_complete(spark, sf_dir):
    """Runs whose chunks are all there and agree with the manifest."""
    o, l = t(spark, sf_dir, "orders", "lineitem")
    chunks = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s")).filter("n >= 4 AND s > 12")
    return o.join(chunks, o["o_orderkey"] == chunks["l_orderkey"], "left_semi").select(F.col("o_orderkey").alias("run_id"))


# State of runs, batch form


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) - 1 AS repeats FROM events GROUP BY ALL")
def idempotent_events(spark, sf_dir):
    """The first event of each idempotency key, and how often it came again."""
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), (F.count(F.lit(1)) - 1).alias("repeats"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS done FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id, e.event_id FROM events e LEFT JOIN f USING (user_id) WHERE f.done IS NULL OR e.event_id <= f.done""")
def terminal_state_absorbs(spark, sf_dir):
    """Events up to the first terminal one; later ones have no effect."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t(spark, sf_dir, "events").withColumn("over", F.max(F.col("event_type") == "purchase").over(w))
    return e.filter(~F.coalesce("over", F.lit(False))).select("user_id", "event_id")


@query("""SELECT e.user_id, e.event_id FROM events e JOIN (SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS m FROM events GROUP BY user_id) x USING (user_id)
WHERE CAST(json_extract_string(e.props, '$.k') AS BIGINT) = x.m""")
def attempt_fencing(spark, sf_dir):
    """Events of the newest attempt only."""
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.withColumn("m", F.max("k").over(Window.partitionBy("user_id"))).filter("k = m").select("user_id", "event_id")


@query("""SELECT user_id, max(ts) AS heartbeat, TIMESTAMP '2024-01-30 00:00:00' - max(ts) > INTERVAL 42 MINUTE AS interrupted FROM events WHERE ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id""")
def stale_runs_as_of(spark, sf_dir):
    """Runs without a heartbeat for 42 minutes as of a time."""
    e = t(spark, sf_dir, "events").filter(F.col("ts") <= at(EVENTS_AS_OF)).groupBy("user_id").agg(F.max("ts").alias("heartbeat"))
    return e.withColumn("interrupted", (at(EVENTS_AS_OF) - F.col("heartbeat")) > F.expr("INTERVAL 42 MINUTES"))


@query("""WITH d AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS day, sum(o_totalprice) OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS used FROM orders)
SELECT o_orderkey AS run_id, used <= 5000000 AS granted FROM d""")
def budget_reservation(spark, sf_dir):
    """Reservations in order of arrival while the period's budget lasts."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_trunc("month", "o_orderdate").alias("month"), "o_totalprice")
    used = running_sum(o, ["month"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice"), "used")
    return used.select(F.col("o_orderkey").alias("run_id"), (F.col("used") <= 5000000).alias("granted"))


@query("""WITH r AS (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g, event_type FROM events)
SELECT event_type, min(event_id) AS range_start, max(event_id) + 1 AS range_end, count(*) AS n FROM r GROUP BY event_type, g HAVING count(*) > 1""")
def contiguous_ranges(spark, sf_dir):
    """Runs of batches in which each starts where the one before it ended."""
    e = running_sum(t(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], F.lit(1), "nth")
    e = e.withColumn("g", F.col("event_id") - F.col("nth"))
    return e.groupBy("event_type", "g").agg(F.min("event_id").alias("range_start"), (F.max("event_id") + 1).alias("range_end"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("g")


@query("""SELECT p.p_partkey AS id, coalesce(n.l_extendedprice, p.p_retailprice) AS price, n.l_partkey IS NOT NULL AS replaced FROM part p LEFT JOIN
(SELECT l_partkey, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS l_extendedprice FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) n ON n.l_partkey = p.p_partkey""")
def retry_merge(spark, sf_dir):
    """Retried keys replace what was stored; the others stay."""
    p, l = t(spark, sf_dir, "part", "lineitem")
    new = l.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("x"))
    j = p.join(new, p["p_partkey"] == new["l_partkey"], "left")
    return j.select(F.col("p_partkey").alias("id"), F.coalesce("x", "p_retailprice").alias("price"), F.col("l_partkey").isNotNull().alias("replaced"))


@query("""SELECT event_id, CASE WHEN event_type IN ('error') THEN 'retryable' WHEN event_type IN ('signup', 'view') THEN 'terminal' ELSE 'unresolved' END AS gap FROM events""")
def gap_classes(spark, sf_dir):
    """Gaps by what can be done about them."""
    kind = F.when(F.col("event_type").isin("error"), "retryable").when(F.col("event_type").isin("signup", "view"), "terminal").otherwise("unresolved")
    return t(spark, sf_dir, "events").select("event_id", kind.alias("gap"))


@query("""SELECT p.p_partkey AS id, sha256(p.p_name || '|' || p.p_brand) AS identity FROM part p WHERE sha256(p.p_name || '|' || p.p_brand) IN (SELECT sha256(p_name || '|' || p_brand) FROM part WHERE p_size > 40)""")
def identity_bound_rows(spark, sf_dir):
    """Rows whose identity hash is in the current catalog."""
    p = t(spark, sf_dir, "part").withColumn("identity", F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256))
    return p.join(p.filter("p_size > 40").select("identity").distinct(), "identity", "left_semi").select(F.col("p_partkey").alias("id"), "identity")


@query("""SELECT c_custkey AS workspace_id, coalesce(CASE c_mktsegment WHEN 'MACHINERY' THEN 'enterprise' WHEN 'FURNITURE' THEN 'team' END, 'free') AS plan FROM customer""")
def entitlement(spark, sf_dir):
    """The plan of each workspace by a small table of plans, with a default."""
    plans = spark.createDataFrame([("MACHINERY", "enterprise"), ("FURNITURE", "team")], "c_mktsegment string, plan string")
    return t(spark, sf_dir, "customer").join(F.broadcast(plans), "c_mktsegment", "left").select(F.col("c_custkey").alias("workspace_id"), F.coalesce("plan", F.lit("free")).alias("plan"))
