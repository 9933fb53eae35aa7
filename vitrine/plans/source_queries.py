"""Queries of sources, sinks and streams. Payloads are built from the tables, row by row, so that SQL can tell what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html as H
from ..sources import sinks
from ..sources.tables import load
from ..streaming import events as E
from .registry import query


@query("""SELECT p_partkey AS page_id, p_name AS name, p_type AS category, 'Product' AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, p_retailprice AS price, p_brand AS brand FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, p_name, NULL, 'PageSignal', 'GBP', p_retailprice, NULL FROM part WHERE p_partkey % 7 = 0""")
def product_extraction(spark, sf_dir):
    """Products of pages with JSON-LD in a graph, in a list, or with metadata alone; scripts and comments that hold markup do not matter."""
    p = load(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("string")
    offer = F.struct(F.when(F.col("p_partkey") % 3 == 0, "USD").otherwise("EUR").alias("priceCurrency"), price.alias("price"))
    node = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.array(offer).alias("offers"))
    body = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.array(node).alias("@graph")))).otherwise(F.to_json(F.array(node)))
    meta = F.concat(F.lit('<meta property="og:title" content="'), "p_name", F.lit('"><meta property="product:price:amount" content="'), price, F.lit('"><meta property="product:price:currency" content="GBP">'))
    page = F.when(F.col("p_partkey") % 7 == 0, meta).otherwise(F.concat(F.lit('<script>var x="<script>";</script><!-- <meta property="og:title" content="no"> --><script type="application/ld+json">'), body, F.lit("</script>")))
    found = H.extract_products(p.select(F.col("p_partkey").alias("page_id"), page.alias("html")))
    return found.select("page_id", "name", "category", "kind", "currency", F.col("price").cast("double").alias("price"), "brand")


@query("""SELECT s_suppkey AS supplier, 'https://d' || s_suppkey || '.example/p/' || i AS url, i AS position, s_suppkey % 2 = 1 AS truncated
FROM supplier, unnest(range(CASE WHEN s_suppkey % 2 = 1 THEN 5 ELSE 3 END)) AS r(i)""")
def sitemap_products(spark, sf_dir):
    """The first locations of sitemaps on their own domains, and whether any were left out."""
    s = load(spark, sf_dir, "supplier")
    n = F.when(F.col("s_suppkey") % 2 == 1, 7).otherwise(3)
    own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("<url><loc> https://d"), F.col("s_suppkey"), F.lit(".example/p/"), i, F.lit(" </loc></url>")))
    document = F.concat(F.lit("<urlset><url><loc>https://other.example/p/0</loc></url>"), F.array_join(own, ""), F.lit("</urlset>"))
    maps = s.select(F.concat(F.lit("d"), "s_suppkey", F.lit(".example")).alias("domain"), document.alias("document"))
    return H.sitemap_urls(maps, 5).select(F.regexp_extract("domain", r"^d(\d+)", 1).cast("long").alias("supplier"), "url", F.col("position").cast("long").alias("position"), "truncated")


@query("""SELECT s_suppkey AS supplier, path, CASE WHEN path = '/cart/x' THEN false WHEN path = '/cart/open' THEN true WHEN path = '/a.pdf' THEN s_suppkey % 2 = 0 ELSE true END AS allowed
FROM supplier, (VALUES ('/cart/x'), ('/cart/open'), ('/a.pdf'), ('/a.pdf.html'), ('/')) AS v(path)""")
def robots_paths(spark, sf_dir):
    """Which paths robots files allow: the best group, the longest pattern, allow wins ties."""
    s = load(spark, sf_dir, "supplier")
    named = F.when(F.col("s_suppkey") % 2 == 1, "User-agent: vitrine\nDisallow: /cart\nAllow: /cart/open\nDisallow: /*.pdf$\n").otherwise("User-agent: vitrine\nDisallow: /cart # no\nAllow: /cart/open\n")
    body = F.concat(F.lit("User-agent: *\nDisallow: /\n\n"), named, F.lit("\nUser-agent: other\nDisallow: /\n"))
    domain = F.concat(F.lit("d"), "s_suppkey").alias("domain")
    rules = H.robots_rules(s.select(domain, body.alias("body")), "vitrine-bot")
    urls = s.select(domain, F.explode(F.array(*map(F.lit, ["/cart/x", "/cart/open", "/a.pdf", "/a.pdf.html", "/"]))).alias("path"))
    return H.robots_allowed(urls, rules).select(F.substring("domain", 2, 20).cast("long").alias("supplier"), "path", "allowed")


@query("""SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS brand, p_type AS category, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price, CASE WHEN p_size % 5 > 0 THEN 'sku' || p_partkey END AS sku FROM part""")
def storefront_products(spark, sf_dir):
    """Products of storefront payloads; a price only if the available variants agree."""
    p = load(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast("string")
    sku = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("sku"), "p_partkey")).otherwise("")
    variant = lambda amount, ok: F.struct(amount.alias("price"), F.lit(ok).alias("available"), sku.alias("sku"))
    other = F.when(F.col("p_size") % 2 == 0, price).otherwise("1.5")
    product = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("product_type"), F.array(variant(price, True), variant(other, True), variant(F.lit("9"), False)).alias("variants"))
    bodies = p.select(F.col("p_brand").alias("domain"), F.to_json(F.struct(F.array(product).alias("products"))).alias("body"))
    return H.storefront_products(bodies).drop("domain")


@query("""SELECT 'https://s' || c_custkey % 100 || '.example' AS url, c_mktsegment AS title, 'q' || c_custkey % 100 AS query FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_mktsegment, c_custkey) AS rn FROM customer) WHERE rn = 1""")
def search_results(spark, sf_dir):
    """Results of nested search payloads, one row a url."""
    c = load(spark, sf_dir, "customer")
    k = (F.col("c_custkey") % 100).cast("string")
    result = F.struct(F.concat(F.lit("https://s"), k, F.lit(".example")).alias("url"), F.col("c_mktsegment").alias("title"))
    q = F.struct(F.concat(F.lit("q"), k).alias("query"), F.array(result).alias("results"))
    return H.search_results(c.select(F.to_json(F.struct(F.array(q).alias("queries"))).alias("body")))


@query("""SELECT l_returnflag || '|' || lower(l_linestatus) AS concept, count(*) AS placements, min(l_shipdate) AS start, max(l_shipdate) AS stop FROM lineitem GROUP BY ALL""")
def ad_concepts(spark, sf_dir):
    """Ad records grouped to concepts by what they say."""
    l = load(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    records = l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.col("l_returnflag").alias("page"), F.concat(F.lit("** "), "l_linestatus").alias("message"), none.alias("headline"), none.alias("cta"),
        none.alias("destination"), F.col("l_shipdate").alias("start"), F.col("l_shipdate").alias("stop"), none.alias("media"), F.array(F.lit("web")).alias("platforms"), F.col("l_orderkey").alias("ord"),
    )
    c = H.ad_concepts(records)
    part = lambda k: F.split_part("key", F.lit("|"), F.lit(k))
    return c.select(F.concat(F.upper(part(1)), F.lit("|"), part(2)).alias("concept"), "placements", "start", "stop")


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_mktsegment = 'MACHINERY') GROUP BY ALL""")
def append_new_rows(spark, sf_dir):
    """Rows to append to a sink that stores each key once."""
    e = load(spark, sf_dir, "events").withColumn("ord", F.col("event_id"))
    kinds = e.agg(F.collect_set("event_type").alias("kinds"))
    stored = load(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    stored = stored.join(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("event_type"))
    return sinks.new_rows(e, stored, "user_id", "event_type").select("user_id", "event_type", "event_id")


@query("""SELECT l_orderkey AS manifest, count(DISTINCT l_linenumber) AS chunks, sum(l_quantity)::BIGINT AS facts, count(DISTINCT l_linenumber) = 4 AND max(l_linenumber) - 1 = 3 AND count(DISTINCT (l_linenumber, l_returnflag)) = count(DISTINCT l_linenumber) AS complete FROM lineitem GROUP BY 1""")
def manifest_states(spark, sf_dir):
    """Whether all chunks of a manifest are there and agree."""
    l = load(spark, sf_dir, "lineitem")
    c = l.select(F.col("l_orderkey").alias("manifest"), (F.col("l_linenumber") - 1).alias("chunk"), F.col("l_quantity").cast("long").alias("facts"), F.col("l_returnflag").alias("hash"))
    return sinks.manifest_state(c, 4)


# Streams, run over all that is there


@query("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL""")
def stream_daily_windows(spark, sf_dir):
    """Tumbling windows over the stream of events."""
    return E.finished(E.windowed(E.source(spark, sf_dir)), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")


@query("""SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events, (VALUES (0), (1)) AS v(k) GROUP BY ALL""")
def stream_sliding_windows(spark, sf_dir):
    """Sliding windows of two days over the stream of events."""
    return E.finished(E.windowed(E.source(spark, sf_dir), "2 days", "1 day"), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Sessions over the stream of events."""
    return E.finished(E.sessions(E.source(spark, sf_dir)), "complete").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL")
def stream_deduplicated(spark, sf_dir):
    """Each idempotency key of the stream once."""
    return E.finished(E.deduplicated(E.source(spark, sf_dir)), "append").select("user_id", "event_type", F.lit(True).alias("seen"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS done FROM events WHERE event_type = 'purchase' GROUP BY user_id),
a AS (SELECT e.user_id, e.event_id, e.event_type, f.done IS NULL OR e.event_id <= f.done AS ok FROM events e LEFT JOIN f USING (user_id))
SELECT user_id, arg_max(event_type, event_id) FILTER (ok) AS state, count(*) FILTER (ok) AS applied, count(*) FILTER (NOT ok) AS rejected FROM a GROUP BY user_id""")
def stream_run_states(spark, sf_dir):
    """The state machine of runs over the stream of events."""
    out = E.finished(E.run_states(E.source(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("state", "applied", "rejected"), "batch").alias("s")).select("user_id", "s.*")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, min(ts) AS done FROM e WHERE event_type = 'purchase' GROUP BY user_id), m AS (SELECT max(ts) - INTERVAL 1 MINUTE AS now FROM events),
g AS (SELECT e.user_id, min(ts) AS heartbeat FROM e, m WHERE event_type <> 'purchase' AND ((next IS NOT NULL AND next - ts > INTERVAL 42 MINUTE) OR (next IS NULL AND now - ts > INTERVAL 42 MINUTE)) GROUP BY e.user_id)
SELECT user_id, heartbeat FROM g LEFT JOIN d USING (user_id) WHERE done IS NULL OR heartbeat < done""")
def stream_interrupted_runs(spark, sf_dir):
    """Runs that fell silent, by a timer of event time or by a gap."""
    return E.finished(E.interrupted_runs(E.source(spark, sf_dir)), "append").select("user_id", F.col("heartbeat").cast("timestamp_ntz").alias("heartbeat"))
