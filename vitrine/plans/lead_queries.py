"""Queries of leads, offerings, findings and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import page_host
from ..operators import leads as L
from ..sources.tables import load
from .registry import query


@query("""SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'no-public-domain' WHEN 1 THEN 'own-domain' WHEN 2 THEN 'listing-evidence' WHEN 3 THEN 'foreign-product-page' WHEN 4 THEN 'no-product-page' WHEN 5 THEN 'no-product-detail' END AS reason FROM customer""")
def lead_admission(spark, sf_dir):
    """Why candidates are not admitted."""
    k = F.col("c_custkey") % 7
    domain = F.when(k == 0, "localhost").when(k == 1, "eu.shop.com").otherwise("www.rival.com")
    evidence = F.when(k == 2, "https://rival.com/collections/tea").otherwise("https://rival.com/tea")
    product = F.when(k == 3, "https://other.com/p/tea").when(k == 4, "").when(k == 5, "https://rival.com/about").otherwise("https://rival.com/p/tea")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), L.admission(domain, F.lit("shop.com"), evidence, product, k >= 4).alias("reason"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS matched FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)""")
def lead_tokens(spark, sf_dir):
    """How many name tokens a source confirms, plurals aside."""
    p = load(spark, sf_dir, "part").withColumn("w", F.split("p_name", " ")).filter(F.col("w")[0] != F.col("w")[1])
    source = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", F.col("w")[1], F.lit("by"), F.concat(F.col("w")[0], F.lit("s")))).otherwise(F.concat(F.lit("the "), F.col("w")[0]))
    return p.select(F.col("p_partkey").alias("id"), F.size(L.matched_tokens(F.col("p_name"), source)).alias("matched"))


@query("""WITH h AS (SELECT p_brand AS domain, p_partkey AS ord, p_name AS name FROM part), f AS (SELECT domain, name, min(ord) AS ord FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS n FROM f)
SELECT domain, name FROM r WHERE n <= 12""")
def page_offerings(spark, sf_dir):
    """Offerings among headings: a name said twice is one, single words and slogans are none."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat_ws(" ", "p_name", "p_name")).otherwise(F.col("p_name"))
    noise = p.select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("ord"), F.when(k == 0, "Pricing").otherwise("Start now. Win more").alias("heading"))
    return L.offerings(p.select(F.col("p_brand").alias("domain"), F.col("p_partkey").alias("ord"), said.alias("heading")).unionByName(noise))


@query("""SELECT o_orderkey AS finding, CASE WHEN rn > 1 THEN 'duplicate-code,' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'unknown-evidence,' ELSE '' END || CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 THEN 'subject-mismatch,' ELSE '' END AS errors
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)""")
def finding_errors(spark, sf_dir):
    """Errors of findings against the evidence that they cite."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cited = F.when(k % 3 == 0, k + 10_000_000_000).otherwise(k)
    findings = o.select(F.col("o_custkey").alias("run"), k.alias("finding"), F.col("o_orderpriority").alias("code"), F.when(k % 2 == 1, "other").otherwise(F.col("o_orderstatus")).alias("subject"), F.array(cited).alias("ids"))
    evidence = o.select(F.col("o_custkey").alias("run"), k.alias("id"), F.lit("match").alias("type"), F.col("o_orderstatus").alias("subject"))
    return L.validated(findings, evidence).select("finding", F.concat(F.array_join("errors", ","), F.when(F.size("errors") > 0, ",").otherwise("")).alias("errors"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'compared' ELSE 'crawled' END AS source FROM part""")
def fact_rows(spark, sf_dir):
    """Facts of the crawl and of the comparison, the latter first."""
    p = load(spark, sf_dir, "part")
    row = lambda df, source: df.select(F.col("p_partkey").alias("id"), F.lit(source).alias("source"))
    return L.facts(row(p, "crawled"), row(p.filter("p_size > 25"), "compared"), "id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 < 2 THEN p_retailprice END AS price FROM part""")
def marked_prices(spark, sf_dir):
    """Current prices out of markup with struck, earlier and unit prices beside them."""
    k, n = F.col("p_size") % 3, F.col("p_retailprice").cast("string")
    now = F.concat(F.lit('<span class="price now">$'), n, F.lit("</span>"))
    html = F.when(k == 0, F.concat(F.lit('<del class="price">$9999</del>'), now)).when(k == 1, F.concat(F.lit('<div class="price-was"><b class="price">1</b></div><span class="unit-price price">2</span>'), now)).otherwise(F.concat(now, F.lit('<b class="price">3</b>')))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), L.marked_price(html).alias("price"))


@query("""SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, count(*) AS pages, count(*) FILTER (contains(html, 'facebook.com') OR contains(html, 'instagram.com')) AS social FROM pages GROUP BY 1""")
def social_links(spark, sf_dir):
    """Pages of a host that link to a social network."""
    social = F.col("html").contains("facebook.com") | F.col("html").contains("instagram.com")
    return load(spark, sf_dir, "pages").groupBy(page_host("url").alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(social, 1)).alias("social"))
