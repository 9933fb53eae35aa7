"""Queries of identity, decisions and profiles of catalog records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import text as X
from ..operators import catalog as C
from ..sources.tables import load
from .registry import query


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) || '|gtin|0000' || p_partkey WHEN p_partkey % 3 = 1 THEN lower(p_brand) || '|source|k' || p_partkey || '|' || lower(p_name) || '|' ELSE lower(p_brand) || '|name|' || lower(p_name) || '|' END AS key
FROM (SELECT p_partkey, replace(p_brand, '#', '-') AS p_brand, p_name FROM part)""")
def identity_keys(spark, sf_dir):
    """Identity keys: number, page or name."""
    k = F.col("p_partkey") % 3
    p = load(spark, sf_dir, "part")
    gtins = F.when(k == 0, F.array(F.concat(F.lit("0000"), "p_partkey"))).otherwise(F.array().cast("array<string>"))
    source = F.when(k == 1, F.concat(F.lit("k"), "p_partkey")).otherwise("")
    none = F.lit(None).cast("struct<kind:string,amount:double,unit:string>")
    key = C.identity_key(F.translate("p_brand", "#", "-"), gtins, source, F.col("p_name"), none, F.lit(""))
    return p.select(F.col("p_partkey").alias("id"), key.alias("key"))


@query("""SELECT DISTINCT a.p_partkey AS primary_id, b.p_partkey AS rival_id FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_partkey % 500 = b.p_partkey % 500 AND a.p_type = b.p_type WHERE a.p_brand = 'Brand#1' AND b.p_brand <> 'Brand#1'""")
def exact_key_blocking(spark, sf_dir):
    """Pairs that share a number, or a code within a brand."""
    p = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", F.array().cast("array<string>").alias("gtins"), F.col("p_type").alias("brand"), F.concat(F.lit("S"), F.col("p_partkey") % 500).alias("sku"), F.lit(None).cast("string").alias("mpn")
    )
    a, b = C.exact_keys(p.filter("p_brand = 'Brand#1'")), C.exact_keys(p.filter("p_brand <> 'Brand#1'"))
    return C.key_pairs(a, b).filter("primary_id < rival_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS aligned FROM part WHERE length(split_part(p_name, ' ', 1)) >= 4 AND length(split_part(p_name, ' ', 2)) >= 4 AND split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)""")
def page_alignment(spark, sf_dir):
    """How many name tokens of a fetched page align with the expected product."""
    p = load(spark, sf_dir, "part").withColumn("a", F.split("p_name", " "))
    p = p.filter((F.length(F.col("a")[0]) >= 4) & (F.length(F.col("a")[1]) >= 4) & (F.col("a")[0] != F.col("a")[1]))
    other = F.when(F.col("p_size") % 3 == 0, F.array(F.concat(F.col("a")[1], F.lit("s")), F.col("a")[0])).otherwise(F.array(F.lit("zzzzzzzzzzzz"), F.col("a")[0]))
    return p.select(F.col("p_partkey").alias("id"), C.token_alignment(F.col("a"), other)["aligned"].alias("aligned"))


@query("""SELECT l_orderkey AS run_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CASE WHEN l_tax > 0.06 THEN 'substitute' WHEN l_linestatus = 'O' THEN 'unaligned' WHEN l_quantity = 25 THEN 'equal' WHEN l_quantity < 25 THEN 'rival-cheaper' ELSE 'primary-cheaper' END AS verdict,
l_tax <= 0.06 AND l_linestatus <> 'O' AS comparable FROM lineitem""")
def pair_decisions(spark, sf_dir):
    """What two observed prices of a pair say."""
    price = lambda currency, amount: F.struct(currency.alias("currency"), amount.alias("amount"))
    currency = F.when(F.col("l_linestatus") == "O", "EUR").otherwise("USD")
    d = C.price_decision(price(F.lit("USD"), F.lit(25.0)), price(currency, F.col("l_quantity")), F.lit(True), F.lit(True), F.col("l_tax") <= 0.06)
    l = load(spark, sf_dir, "lineitem").withColumn("d", d)
    return l.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "d.verdict", "d.comparable")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://s' || s_suppkey || '.com/en-sa/p/x' ELSE '' END AS retry FROM supplier""")
def market_retries(spark, sf_dir):
    """URLs to try once more for the target market."""
    k = F.col("s_suppkey") % 3
    base = F.concat(F.lit("https://s"), "s_suppkey", F.lit(".com"))
    requested = F.when(k == 1, F.concat(base, F.lit("/p/x?country=AE"))).otherwise(F.concat(base, F.lit("/p/x")))
    fetched = F.when(k == 2, F.concat(base, F.lit("/en-sa/p/x"))).otherwise(F.concat(base, F.lit("/en-ae/p/x")))
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), C.redirect_retry(requested, fetched, F.lit("SA")).alias("retry"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'https://shop.com/' || s_suppkey WHEN 1 THEN 'https://shop.com/x?y=' || s_suppkey ELSE '' END AS destination FROM supplier""")
def ad_destinations(spark, sf_dir):
    """Destinations of adverts that are safe to show."""
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://shop.com/"), n)).when(k == 1, F.concat(F.lit("https://l.facebook.com/l.php?u=https%3A%2F%2Fshop.com%2Fx%3Fy%3D"), n)).when(k == 2, "http://10.0.0.1/").otherwise("https://user@shop.com/")
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), C.safe_destination(url).alias("destination"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'ecommerce' WHEN 1 THEN 'agency' WHEN 2 THEN 'saas' ELSE 'unknown' END AS kind FROM customer""")
def business_types(spark, sf_dir):
    """What kind of business a company is."""
    k = F.col("c_custkey") % 4
    core = F.when(k == 1, "A design studio for software").when(k == 2, "The workflow platform").otherwise("Company")
    text = F.when(k == 0, "Tea boxes, free delivery").otherwise(core)
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), C.business_type(F.lit(0), F.lit(0), core, text).alias("kind"))


@query("""SELECT user_id AS domain, CASE WHEN count(*) FILTER (event_type <> 'error') % 2 = 1 THEN median(floor(value)) FILTER (event_type <> 'error') ELSE floor(median(floor(value)) FILTER (event_type <> 'error') + 0.5) END AS median_ms, count(*) FILTER (event_type <> 'error') AS sample FROM events GROUP BY 1""")
def response_medians(spark, sf_dir):
    """Median response times of what was observed."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), F.when(F.col("event_type") == "error", -1.0).otherwise(F.floor("value").cast("double")).alias("response_time_ms"), F.lit(None).cast("double").alias("response_bytes"))
    return C.page_medians(e).select("domain", "median_ms", "sample")


@query("""SELECT p_brand AS domain, floor(floor(sum((p_size > 20)::INT) * 100.0 / count(*) + 0.5) + 0.5)::BIGINT AS score FROM part GROUP BY 1""")
def image_scores(spark, sf_dir):
    """Image readiness over what was observed: no page images here, so products alone."""
    g = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p_size") > 20, 1)).alias("i"))
    return g.select("domain", C.image_score(F.col("n"), F.col("i"), F.lit(0), F.lit(0), F.lit(0)).alias("score"))


@query("""SELECT p_type AS metric, CASE WHEN sum((p_size < 10)::INT) > 0 THEN 'Add images to ' || sum((p_size < 10)::INT) || ' products' ELSE 'Review the observed evidence' END AS action FROM part GROUP BY 1""")
def gap_actions(spark, sf_dir):
    """What would close the gap of images."""
    g = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("metric")).agg(F.count(F.when(F.col("p_size") < 10, 1)).alias("missing"))
    return g.select("metric", C.gap_action(F.lit("images"), F.col("missing")).alias("action"))


@query("""SELECT s_suppkey AS run_id, CASE WHEN s_acctbal < 0 THEN 'crawl,products' ELSE 'crawl' END AS explained FROM supplier""")
def explained_phases(spark, sf_dir):
    """Phases of a run that its gap reasons explain."""
    reasons = F.when(F.col("s_acctbal") < 0, F.array(F.lit("The website could not be fetched"), F.lit("No catalog was found"))).otherwise(F.array(F.lit("Blocked by ROBOTS rules")))
    phases = F.array(F.lit("crawl"), F.lit("products"), F.lit("ads"))
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.array_join(C.explained_phases(phases, reasons), ",").alias("explained"))


@query("""WITH c AS (SELECT c_nationkey AS run, c_custkey AS company, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) AS is_primary, c_acctbal > 3000 AS active FROM customer), p AS (SELECT run, active AS pa FROM c WHERE is_primary)
SELECT run, company, CASE WHEN active AND NOT pa THEN 'rival buys attention' WHEN active THEN 'both active' ELSE 'no gap shown' END AS headline FROM c JOIN p USING (run) WHERE NOT is_primary""")
def ad_strategies(spark, sf_dir):
    """Adverts of each company against those of the primary one."""
    from pyspark.sql import Window

    c = load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("company"), (F.col("c_custkey") == F.min("c_custkey").over(Window.partitionBy("c_nationkey"))).alias("is_primary"), (F.col("c_acctbal") > 3000).alias("active")
    )
    return C.ad_comparison(c)


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'seen' END AS verdict, p_size <= 25 AS pending FROM part""")
def cached_verdicts(spark, sf_dir):
    """Verdicts that equal plans already have."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_size").alias("b"))
    cache = p.filter("b > 25").select(F.sha2(F.to_json(F.struct("id", "a", "b")), 256).alias("plan_hash"), F.lit("seen").alias("verdict"))
    return C.replayed(p, cache, "id", "a", "b").select("id", "verdict", "pending")


@query("""SELECT (n_nationkey / 5)::BIGINT AS step, n_name AS name FROM (SELECT n_nationkey - n_nationkey % 5 AS n_nationkey, n_name FROM nation)""")
def cursor_pages(spark, sf_dir):
    """Rows of cursor pages in the order of the cursors; the last cursor leads back to the first."""
    page = F.floor(F.col("n_nationkey") / 5)
    g = load(spark, sf_dir, "nation").groupBy(page.alias("page")).agg(F.array_sort(F.collect_list("n_name")).alias("rows"))
    name = lambda c: F.when(c == 0, "").otherwise(F.concat(F.lit("c"), c.cast("string")))
    pages = g.select(name(F.col("page")).alias("cursor"), name((F.col("page") + 1) % 5).alias("next_cursor"), "rows")
    return C.followed(pages).select(F.col("step").cast("long").alias("step"), F.col("row").alias("name"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'conflict' ELSE 'equal' END AS quantities FROM part""")
def quantity_agreement(spark, sf_dir):
    """Whether two stated quantities agree."""
    a = I.parse_quantity(F.concat("p_size", F.lit(" kg")), ascii_only=True)
    b = I.parse_quantity(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_size", F.lit(" g"))).otherwise(F.concat(F.col("p_size") * 1000, F.lit(" grams"))), ascii_only=True)
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))
    return p.select("id", F.when(I.quantities_conflict("a", "b"), "conflict").when(I.quantities_equal("a", "b"), "equal").otherwise("unknown").alias("quantities"))


@query("""SELECT doc_id, array_to_string(list_sort([s FOR s IN [CASE doc_id % 4 WHEN 1 THEN 'Arabic' WHEN 2 THEN 'Cyrillic' END, CASE WHEN regexp_matches(text, '\\p{Latin}') THEN 'Latin' END] IF s IS NOT NULL]), ',') AS script FROM documents""")
def document_scripts(spark, sf_dir):
    """Writing systems of texts."""
    k = F.col("doc_id") % 4
    text = F.concat(F.coalesce("text", F.lit("")), F.when(k == 1, " شاي").when(k == 2, " чай").otherwise(""))
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(X.writing_systems(text)), ",").alias("script"))
