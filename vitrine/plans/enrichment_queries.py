"""Queries of page identities, live identities, enrichment, product extraction parallel state machines, triggers, contracts and evidence budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrichment as E
from ..operators import evidence as B
from ..operators import live_identity as L
from ..operators import page_identity as I
from ..operators import transitions as T
from ..sources import checkpoints as P
from ..sources import contracts as K
from ..sources import structured as S
from ..sources.shared import new_shared
from ..sources.tables import dealt, load
from ..streaming import events as V
from ..streaming import triggers as G
from .registry import query


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
list_sort([p FOR p IN string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&') IF p <> '' AND NOT regexp_matches(p, '^(utm_.+|fbclid|gclid|dclid|msclkid|srsltid)=')]) AS q FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM u""")
def page_keys(spark, sf_dir):
    """What tells the pages apart: no fragment, no tracking, no slash at the end, parameters in order."""
    return load(spark, sf_dir, "pages").select("page_id", I.page_key(F.col("url")).alias("key"))


_HOPS = """h AS (SELECT 'o' || o_orderkey AS key, 'o' || (o_orderkey // 2 + o_custkey % 3) AS target FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey > 8
UNION ALL SELECT 'o' || o_orderkey, 'o' || (o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) FROM orders WHERE o_orderkey BETWEEN 4 AND 5
UNION ALL SELECT 'o' || o_orderkey, 'o' || (o_orderkey // 3) FROM orders WHERE o_orderkey % 97 = 1),
r AS (SELECT DISTINCT key, target FROM h WHERE key <> target), k AS (SELECT key, min(target) AS target, count(*) > 1 AS split FROM r GROUP BY key)"""


@query(f"""WITH RECURSIVE {_HOPS}, walk AS (SELECT key, CASE WHEN split THEN key ELSE target END AS spot, CASE WHEN split THEN 0 ELSE 1 END::BIGINT AS hops, split AS done FROM k
UNION ALL SELECT w.key, k.target, w.hops + 1, false FROM walk w JOIN k ON k.key = w.spot WHERE NOT w.done AND NOT k.split AND w.hops < 60),
e AS (SELECT key, max_by(spot, hops) AS spot, max(hops) AS hops FROM walk GROUP BY key)
SELECT e.key, CASE WHEN e.hops < 60 THEN e.spot END AS "end", CASE WHEN e.hops < 60 THEN e.hops END AS hops, CASE WHEN e.hops = 60 THEN 'loop' WHEN k.split THEN 'conflict' ELSE 'ok' END AS state FROM e LEFT JOIN k ON k.key = e.spot""")
def redirect_ends(spark, sf_dir):
    """Where redirects between orders end: chains, loops and keys with two targets."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    key = lambda c: F.concat(F.lit("o"), c.cast("string"))
    one = o.filter((k % 10 != 3) & (k > 8)).select(key(k).alias("key"), key(F.floor(k / 2) + F.col("o_custkey") % 3).alias("target"))
    two = o.filter(k.between(4, 5)).select(key(k).alias("key"), key(k + F.when(k % 2 == 0, 1).otherwise(-1)).alias("target"))
    three = o.filter(k % 97 == 1).select(key(k).alias("key"), key(F.floor(k / 3)).alias("target"))
    return I.redirect_ends(one.union(two).union(three))


@query("""SELECT p_partkey AS lead_id, CASE WHEN p_partkey % 13 = 0 THEN 'no_primary' WHEN p_size % 8 = 3 THEN 'loop' WHEN p_size % 8 = 7 THEN 'conflict' WHEN p_partkey % 11 = 0 THEN 'no_page' WHEN p_size % 8 = 2 THEN 'renamed'
WHEN p_partkey % 9 = 4 THEN 'no_product' WHEN p_partkey % 9 = 5 THEN 'several_products' ELSE 'verified' END AS verdict,
CASE WHEN p_partkey % 13 = 0 OR p_size % 8 IN (2, 3, 7) OR p_partkey % 11 = 0 OR p_partkey % 9 IN (4, 5) THEN NULL ELSE 'r' || p_partkey END AS rival_id FROM part""")
def lead_verification(spark, sf_dir):
    """Which product leads a rival's page confirms, through redirects, and why the others fail."""
    p = dealt(spark, sf_dir, "part").withColumn("slug", F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey")))
    k, size = F.col("p_partkey"), F.col("p_size")
    shop = F.lower(F.regexp_replace("p_brand", "#", ""))
    own, rival = F.lit("own.example"), F.concat(shop, F.lit(".example"))
    page = lambda locale, slug: F.concat(F.lit("https://www."), rival, F.lit(locale), F.lit("/products/"), slug)
    asked, final = page("/en-us", F.col("slug")), page("/en-gb", F.col("slug"))
    other = page("/en-us", F.concat(F.lit("zz-y"), k))
    moved = (size % 8).isin(1, 2, 3, 7)
    end = F.when(size % 8 == 1, final).when(size % 8 == 2, other).otherwise(asked)
    leads = p.select(
        k.alias("lead_id"),
        k.alias("primary_id"),
        F.concat(F.lit("https://own.example/products/"), F.when(k % 13 == 0, "gone-").otherwise(""), "slug", F.lit("?utm_campaign=c&gclid=1")).alias("primary_url"),
        own.alias("primary_domain"),
        rival.alias("candidate_domain"),
        F.concat(asked, F.lit("/?srsltid=x#top")).alias("candidate_url"),
    )
    primaries = p.select(k.alias("primary_id"), F.concat(F.lit("https://OWN.example/products/"), "slug", F.lit("/")).alias("url"))
    pages = p.filter("p_partkey % 11 <> 0").select(end.alias("url"))
    redirects = p.filter(moved).select(F.concat(asked, F.lit("#a")).alias("url"), F.explode(F.when(size % 8 == 7, F.array(final, other)).when(size % 8 == 3, F.array(final)).otherwise(F.array(end))).alias("target"))
    redirects = redirects.union(p.filter("p_size % 8 = 3").select(final, asked))
    variant = F.explode(F.when(k % 9 == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2))))
    rows = p.withColumn("v", variant)
    said = F.struct(
        F.lower("p_name").alias("normalized_name"), F.col("p_name").alias("name"), F.lit(None).cast("struct<kind:string,amount:double,unit:string>").alias("quantity"), F.lit(None).cast("array<string>").alias("gtins"),
        F.lit("").alias("sku"), F.lit("").alias("mpn"), F.col("p_brand").alias("brand"),
        F.array(F.struct((F.col("p_retailprice") + F.when(F.col("v") == 1, 1).otherwise(0)).alias("amount"), F.when(F.col("v") == 2, "usd").otherwise("USD").alias("currency"), F.lit(None).cast("string").alias("period"))).alias("prices"),
        F.when(F.col("v") == 2, F.array(F.lit("B "), F.lit("a"), F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("attributes"),
    )
    products = rows.select(end.alias("url"), F.concat(F.lit("r"), k.cast("string")).alias("product_id"), (k % 9 != 4).alias("eligible"), I.fingerprint(said).alias("fingerprint"), F.col("v").alias("rank"))
    return I.lead_verdicts(leads, primaries, pages, products, redirects, ascii_only=True).select("lead_id", "verdict", "rival_id")


_NODES = """x AS (SELECT p_partkey AS id, p_brand AS market, p_name AS name, CASE WHEN p_size % 4 = 1 THEN [] WHEN p_size % 3 = 0 THEN list_sort(list_distinct(['g' || p_partkey % 7, 'g' || p_partkey % 11])) ELSE ['g' || p_partkey % 7] END AS g,
CASE WHEN p_size % 5 > 0 THEN 'q' || p_size % 2 END AS q FROM part),
v AS (SELECT *, min(id) OVER (PARTITION BY market, g, q, CASE WHEN len(g) = 0 THEN name END) AS node FROM x),
t0 AS (SELECT DISTINCT node, market, q, unnest(g) AS gtin FROM v), t AS (SELECT *, row_number() OVER (PARTITION BY market, gtin, q ORDER BY node) AS i FROM t0),
e0 AS (SELECT 0 AS kind, p.node AS a, c.node AS b, c.market FROM t c JOIN t p ON p.market = c.market AND p.gtin = c.gtin AND p.q IS NOT DISTINCT FROM c.q AND p.i = c.i // 2
UNION ALL SELECT 1, least(g.node, n.node), greatest(g.node, n.node), g.market FROM v g JOIN v n ON g.market = n.market AND g.name = n.name AND g.q IS NOT DISTINCT FROM n.q AND len(g.g) > 0 AND len(n.g) = 0
UNION ALL SELECT 2, least(k.node, u.node), greatest(k.node, u.node), k.market FROM t k JOIN t u ON k.market = u.market AND k.gtin = u.gtin AND k.q IS NOT NULL AND u.q IS NULL AND k.i = 1 AND u.i = 1),
e1 AS (SELECT a, b, market, min(kind) AS kind FROM e0 GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY kind, md5(a || '|' || b)) AS i FROM e1)"""


@query(f"""WITH RECURSIVE {_NODES}, w AS (SELECT market, 0::BIGINT AS i, list({{'n': node, 'c': node, 'q': q, 'g': g}}) AS s FROM (SELECT DISTINCT market, node, q, g FROM v) GROUP BY market
UNION ALL SELECT market, i, CASE WHEN ca = cb OR len(list_filter(list_filter(s, lambda x: x.c = ca), lambda x: len(list_filter(list_filter(s, lambda y: y.c = cb), lambda y: x.q <> y.q OR (len(x.g) > 0 AND len(y.g) > 0 AND NOT list_has_any(x.g, y.g)))) > 0)) > 0 THEN s
ELSE list_transform(s, lambda x: {{'n': x.n, 'c': CASE WHEN x.c = greatest(ca, cb) THEN least(ca, cb) ELSE x.c END, 'q': x.q, 'g': x.g}}) END
FROM (SELECT w.market, e.i, w.s, list_filter(w.s, lambda x: x.n = e.a)[1].c AS ca, list_filter(w.s, lambda x: x.n = e.b)[1].c AS cb FROM w JOIN e ON e.market = w.market AND e.i = w.i + 1)),
f AS (SELECT market, unnest(max_by(s, i)) AS x FROM w GROUP BY market)
SELECT v.id, f.x.c AS class_id FROM v JOIN f ON v.market = f.market AND v.node = f.x.n""")
def live_identities(spark, sf_dir):
    """Rows of a brand that are the same product: by numbers, names and quantities, no class with a conflict."""
    k, size = F.col("p_partkey"), F.col("p_size")
    one, two = F.concat(F.lit("g"), k % 7), F.concat(F.lit("g"), k % 11)
    gtins = F.when(size % 4 == 1, F.array().cast("array<string>")).when(size % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    p = load(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("market"), F.col("p_name").alias("name"), gtins.alias("gtins"), F.when(size % 5 > 0, F.concat(F.lit("q"), size % 2)).alias("quantity"))
    return L.live_classes(p)


def shop_pages(spark, sf_dir):
    """Targets and fetched pages of shops: the products of part, with redirects, market copies and endpoints by size and key."""
    p = dealt(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    shop = F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".example"))
    at = lambda tail: F.concat(F.lit("https://"), shop, tail)
    slug = F.concat(F.lit("/products/x"), k.cast("string"))
    targets = p.select(
        k.alias("target_id"),
        shop.alias("domain"),
        at(F.concat(slug, F.when(size == 50, "?country=sa").otherwise("/?utm_source=a"))).alias("url"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("score"),
        F.lit("SA").alias("country"),
        F.when(size == 50, "SA").otherwise("").alias("market"),
        (k % 2 == 0).alias("replaceable"),
    )
    no = F.lit("")
    name = F.when(size % 10 == 3, F.concat(F.lit("other "), F.col("p_name"))).when(size % 10 != 4, F.col("p_name"))
    price = F.when(size % 10 != 5, F.col("p_retailprice"))
    row = lambda url, final, robots, status, market, name, amount, currency, endpoint, secure=k % 3 == 0: p.select(
        url.alias("url"), final.alias("final_url"), robots.alias("robots"), status.alias("status"), market.alias("market"), name.alias("product_name"), amount.alias("amount"), currency.alias("currency"),
        F.when(secure, "https://img.example/x").otherwise("http://img.example/x").alias("image"), endpoint.alias("endpoint"), size.alias("size"), k.alias("k"),
    )
    ok, usd = F.lit("allowed"), F.lit("USD")
    robots = F.when(size == 41, "unreachable").when(size == 42, "disallowed").otherwise("allowed")
    final = F.when(size.isin(11, 21), at(F.concat(F.lit("/products/y"), k))).when(size == 31, F.concat(F.lit("https://else.example"), slug)).when(size == 12, at(F.concat(F.lit("/en-us"), slug))).otherwise("")
    end = F.when((size % 10 == 5) | (size == 7), at(F.concat(F.lit("/api/"), k))).otherwise("")
    first = row(at(F.concat(slug, F.when(size == 50, "?country=sa").otherwise(""))), final, robots, F.when(size == 43, 404).otherwise(200), F.when((size == 50) & (k % 4 == 0), "SA").otherwise(""), name, price, usd, end).filter("size <> 44")
    moved = row(at(F.concat(F.lit("/products/y"), k)), F.when(size == 21, at(slug)).otherwise(""), ok, F.lit(200), no, name, price, usd, no).filter("size IN (11, 21)")
    foreign = row(at(F.concat(F.lit("/en-us"), slug)), no, ok, F.lit(200), no, name, price, usd, no).filter("size = 12")
    local = row(at(F.concat(F.lit("/en-sa"), slug)), no, ok, F.lit(200), no, name, price + 1, usd, no).filter("size = 12 AND k % 2 = 0")
    api = row(at(F.concat(F.lit("/api/"), k)), no, ok, F.when(size == 25, 500).otherwise(200), no, F.when(size == 35, "no such thing").otherwise(F.col("p_name")), F.col("p_retailprice") + F.when(size == 7, k % 2).otherwise(0), F.when(size == 45, "XXZ").when((size == 7) & (k % 5 == 0), "EUR").otherwise("USD"), no, (k % 3 == 0) | (size == 7))
    api = api.filter("size = 7 OR size % 10 = 5 AND size <> 15")
    pages = first.union(moved).union(foreign).union(local).union(api).drop("size", "k")
    return targets, pages.union(pages.filter("status = 200"))


_SHOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
s0 AS (SELECT p_partkey AS id, p_size AS z, p_name, p_retailprice AS price, p_partkey % 2 = 0 AS swap, p_partkey % 4 = 0 AS kept, n FROM ranked),
step AS (SELECT id, z, p_name, price, swap, kept, 0 AS round, CASE WHEN n > 60 THEN 'over_budget' ELSE 'page' END AS spot FROM s0
UNION ALL SELECT id, z, p_name, price, swap, kept, round + 1, CASE
  WHEN spot = 'page' AND z = 44 THEN 'not_fetched' WHEN spot = 'page' AND z = 41 THEN 'robots_unreachable' WHEN spot = 'page' AND z = 42 THEN 'robots_disallowed' WHEN spot = 'page' AND z = 43 THEN 'fetch_failed'
  WHEN spot = 'page' AND z = 31 THEN 'other_host' WHEN spot = 'page' AND z IN (11, 21) THEN 'moved' WHEN spot = 'page' AND z = 12 THEN 'foreign'
  WHEN spot = 'moved' AND z = 21 THEN 'redirect_loop' WHEN spot = 'foreign' THEN 'local' WHEN spot = 'local' AND NOT swap THEN 'kept'
  WHEN spot = 'page' AND z = 50 AND NOT kept THEN 'market_mismatch'
  WHEN spot <> 'api' AND z % 10 = 4 THEN 'no_product' WHEN spot <> 'api' AND z % 10 = 3 AND swap THEN 'replaced' WHEN spot <> 'api' AND z % 10 = 3 THEN 'identity_mismatch'
  WHEN spot <> 'api' AND z % 10 = 5 THEN 'api' WHEN spot = 'api' AND z IN (15, 25) THEN 'endpoint_limited' WHEN spot = 'api' AND z = 35 THEN 'endpoint_mismatch' WHEN spot = 'api' AND z = 45 THEN 'no_price'
  WHEN spot <> 'api' AND z = 7 AND id % 3 > 0 THEN 'api' WHEN spot = 'api' AND z = 7 AND (id % 2 = 1 OR id % 5 = 0) THEN 'price_conflict'
  ELSE 'enriched' END FROM step WHERE spot IN ('page', 'moved', 'foreign', 'local', 'kept', 'api')),
fin AS (SELECT * FROM step WHERE spot NOT IN ('page', 'moved', 'foreign', 'local', 'kept', 'api'))"""


@query(f"""WITH RECURSIVE {_SHOP} SELECT id AS target_id, round, CASE WHEN spot IN ('enriched', 'replaced', 'price_conflict', 'endpoint_limited', 'endpoint_mismatch', 'no_price') THEN 'product' ELSE 'gap' END AS outcome, spot AS reason FROM fin""")
def enrichment_ledger(spark, sf_dir):
    """What became of every selected product page, in which round, and why."""
    targets, pages = shop_pages(spark, sf_dir)
    return E.enriched(targets, pages, lambda a, b: a == b, most_pages=60)[1]


@query(f"""WITH RECURSIVE {_SHOP} SELECT id AS target_id, CASE WHEN spot = 'replaced' THEN 'other ' || p_name ELSE p_name END AS name, CASE WHEN spot IN ('endpoint_limited', 'endpoint_mismatch', 'no_price') THEN NULL WHEN z = 12 AND swap THEN price + 1 ELSE price END AS amount,
CASE WHEN spot IN ('endpoint_limited', 'endpoint_mismatch', 'no_price') THEN NULL ELSE 'USD' END AS currency, CASE WHEN id % 3 = 0 OR z = 7 THEN 'https://img.example/x' END AS image,
CASE WHEN spot = 'replaced' THEN 'Catalog replacement: ' || p_name WHEN spot = 'price_conflict' THEN 'Price evidence conflict: page and endpoint ' || CASE WHEN id % 5 = 0 THEN 'currencies' ELSE 'amounts' END || ' disagree' END AS audit
FROM fin WHERE spot IN ('enriched', 'replaced', 'price_conflict', 'endpoint_limited', 'endpoint_mismatch', 'no_price')""")
def enriched_products(spark, sf_dir):
    """Products with the evidence of their pages and endpoints."""
    targets, pages = shop_pages(spark, sf_dir)
    return E.enriched(targets, pages, lambda a, b: a == b, most_pages=60)[0]


def _ld(node):
    return F.concat(F.lit('<script type="application/ld+json">'), F.to_json(node), F.lit("</script>"))


def _meta(ns, amount, currency):
    return F.concat(F.lit(f'<meta property="{ns}:amount" content="'), amount, F.lit(f'"><meta content={currency} name="{ns}:currency">'))


def product_pages(spark, sf_dir):
    """A page for each part, of eleven kinds by size."""
    p = dealt(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    price = F.col("p_retailprice").cast("string")
    offer = F.struct(price.alias("price"), F.lit("usd").alias("priceCurrency"))
    node = lambda offers: F.struct(F.lit("Product").alias("@type"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("name"), F.col("p_type").alias("category"), offers.alias("offers"))
    aggregate = lambda inner: F.struct(F.lit("AggregateOffer").alias("@type"), inner.alias("offers"))
    plain = _ld(node(offer))
    graph = _ld(F.struct(F.array(F.struct(F.lit("WebPage").alias("@type"), F.array(node(F.array(offer))).alias("mainEntity"))).alias("@graph")))
    nested = _ld(node(aggregate(F.array(offer, F.struct(F.lit("1").alias("price"), F.lit(None).cast("string").alias("priceCurrency"))))))
    dated = _ld(node(F.array(F.struct(price.alias("price"), F.lit("USD").alias("priceCurrency"), F.when(k % 2 == 0, "2020-01-01").otherwise("2030-01-01").alias("priceValidUntil")))))
    listed = _ld(node(F.array(F.struct(F.lit("9").alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("ListPrice").alias("priceType")), F.struct(price.alias("price"), F.lit("EUR").alias("priceCurrency"), F.lit(None).cast("string").alias("priceType")))))
    ranged = _ld(node(F.struct(F.lit(5).alias("lowPrice"), F.when(k % 2 == 0, 7).otherwise(3).alias("highPrice"), F.lit("USD").alias("priceCurrency"))))
    unpriced = _ld(node(F.lit(None).cast("string")))
    plans = F.concat(F.lit("<h2>Pro <i>popular</i></h2><p>$12 per user per month, billed annually</p><h2>Enterprise</h2>Contact sales<h3>"), "p_name", F.lit("</h3>$1 USD"))
    signal = F.concat(F.lit("<title>"), "p_name", F.lit(" | Shop</title><h1>"), "p_name", F.lit("</h1><!--<h1>no</h1>-->"), _meta("og:price", price, "usd"))
    kind = size % 11
    html = (
        F.when(kind == 0, F.concat(plain, F.lit('<script type="application/ld+json">{bad</script>')))
        .when(kind == 1, graph)
        .when(kind == 2, nested)
        .when(kind == 3, dated)
        .when(kind == 4, listed)
        .when(kind == 5, ranged)
        .when(kind == 6, F.concat(unpriced, _meta("og:price", F.lit("1"), "EUR"), _meta("product:price", price, "USD")))
        .when(kind == 7, F.concat(plain, _meta("product:price", F.when(k % 2 == 0, price).otherwise("1"), "USD")))
        .when(kind == 8, F.concat(plain, _meta("product:price", price, "EUR"), _meta("product:price", price, "USD")))
        .when(kind == 9, plans)
        .otherwise(signal)
    )
    path = F.when(kind == 9, "/pricing").when(k % 3 == 0, "/blog/").otherwise("/products/")
    return p.select(k.alias("page_id"), F.concat(F.lit("https://shop.example"), path, F.when(kind == 9, "").otherwise(k.cast("string"))).alias("url"), html.alias("html"))


@query("""WITH x AS (SELECT p_partkey AS id, p_name, p_type, p_retailprice AS price, p_size % 11 AS k, p_partkey % 2 = 0 AS even FROM part)
SELECT id AS page_id, 'json-ld' AS source, 'Product' AS kind, p_name AS name, p_type AS category, CASE WHEN k = 5 OR k = 8 OR k = 3 AND even OR k = 7 AND NOT even THEN NULL ELSE price END AS amount,
CASE WHEN k = 8 OR k = 3 AND even OR k = 7 AND NOT even OR k = 5 AND NOT even THEN NULL WHEN k = 4 THEN 'EUR' ELSE 'USD' END AS currency,
CASE WHEN k = 8 OR k = 3 AND even OR k = 7 AND NOT even OR k = 5 AND NOT even THEN NULL WHEN k = 5 THEN 5 ELSE price END AS low, CASE WHEN k = 8 OR k = 3 AND even OR k = 7 AND NOT even OR k = 5 AND NOT even THEN NULL WHEN k = 5 THEN 7 ELSE price END AS high,
CASE WHEN k = 8 THEN 'contradictory direct metadata namespace' WHEN k = 7 AND NOT even THEN 'direct metadata contradicts structured amount' END AS audit FROM x WHERE k < 9
UNION ALL SELECT id, 'plan', 'Service', v.n, 'saas-plan ' || v.t, v.a, v.c, v.a, v.a, NULL FROM x, (VALUES ('Pro', 'team', 12.0, 'USD'), ('Enterprise', 'enterprise', NULL, NULL)) AS v(n, t, a, c) WHERE k = 9
UNION ALL SELECT id, 'page-signal', 'PageSignal', p_name, 'products', price, 'USD', price, price, NULL FROM x WHERE k = 10 AND id % 3 > 0""")
def structured_products(spark, sf_dir):
    """All products of pages: nested records and offers, plan cards, page signals, metadata that fills in or contradicts."""
    return S.page_products(product_pages(spark, sf_dir), F.lit("2025-06-01").cast("timestamp"))


@query("""WITH x AS (SELECT p_partkey AS id, p_retailprice AS price, p_size % 9 AS k FROM part)
SELECT id AS page_id, CASE WHEN k = 2 THEN 'og' ELSE 'product' END AS scope, CASE WHEN k IN (0, 1, 2, 7) THEN CASE WHEN k = 0 THEN 1250.5 ELSE price END END AS amount, CASE WHEN k IN (0, 1, 7) THEN 'USD' WHEN k = 2 THEN 'EUR' END AS currency,
CASE WHEN k = 3 THEN 'several' WHEN k IN (4, 5, 6) THEN 'conflict' WHEN k = 8 THEN 'incomplete' ELSE 'offer' END AS state FROM x""")
def metadata_offers(spark, sf_dir):
    """The price that a page's metadata states, by the first namespace that states any."""
    p = dealt(spark, sf_dir, "part")
    k, price = F.col("p_size") % 9, F.col("p_retailprice").cast("string")
    both = lambda ns, a, c: F.array(F.struct(F.lit(f"{ns}:amount").alias("key"), F.lit(a).alias("content") if isinstance(a, str) else a.alias("content")), F.struct(F.lit(f"{ns}:currency").alias("key"), F.lit(c).alias("content")))
    rows = (
        F.when(k == 0, F.concat(both("product:sale_price", "1,250.50", "usd"), both("product:price", "9", "EUR")))
        .when(k == 1, F.concat(both("product:price", price, "USD"), both("product:price", price, "usd"), both("og:price", "x", "EUR")))
        .when(k == 2, both("og:price", price, "EUR"))
        .when(k == 3, F.concat(both("product:price", "1", "USD"), both("product:price", "2", "USD")))
        .when(k == 4, F.concat(both("product:price", "1", "USD"), both("product:price", "2", "USD"), both("product:price", "3", "USD")))
        .when(k == 5, F.concat(both("product:price", "1", "USD"), both("product:price", "1", "EUR")))
        .when(k == 6, F.concat(both("product:sale_price", "free", "USD"), both("product:price", "1", "USD")))
        .when(k == 7, F.concat(both("product:price", F.concat(F.lit("$ "), price), "USD"), both("og:price", "4", "XXQ")))
        .otherwise(F.concat(F.slice(both("product:sale_price", "1", "USD"), 1, 1), both("product:price", "1", "USD")))
    )
    rows = p.select(F.col("p_partkey").alias("page_id"), F.explode(rows).alias("m")).select("page_id", "m.*").repartition(7, "content")
    return S.namespace_offers(rows).select("page_id", "scope", "amount", "currency", "state")


@query("""SELECT l_orderkey AS orderkey, l_linenumber AS line, NOT (l_quantity % 7 = 0 OR l_tax > 0.07 OR l_discount > 0.09 OR (l_linestatus = 'O' AND l_returnflag = 'A') OR l_suppkey % 5 = 0) AS sound FROM lineitem""")
def price_integrity(spark, sf_dir):
    """Which stored prices still say what they were parsed from, in one currency that the URL agrees with."""
    l = load(spark, sf_dir, "lineitem")
    amount = F.col("l_extendedprice")
    raw = F.concat(F.when(F.col("l_quantity") % 7 == 0, F.lit("from 3 to ")).otherwise(""), amount.cast("decimal(18,2)").cast("string"), F.lit(" USD"))
    one = F.struct(raw.alias("raw"), (amount + F.when(F.col("l_tax") > 0.07, 0.01).otherwise(0.0)).alias("amount"), F.lit("USD").alias("currency"))
    two = F.struct(F.lit("€5").alias("raw"), F.lit(5.0).alias("amount"), F.lit("EUR").alias("currency"))
    signals = F.when(F.col("l_discount") > 0.09, F.array(one, two)).when(F.col("l_suppkey") % 5 == 0, F.array().cast("array<struct<raw:string,amount:double,currency:string>>")).otherwise(F.array(one, one))
    selector = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "SAR").when(F.col("l_linenumber") == 1, "usd").otherwise("")
    return l.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), S.integrity(signals, selector).alias("sound"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x|k' || json_extract_string(props, '$.k') ELSE 'y' END AS texts FROM events WHERE event_id % 4 < 3""")
def deep_texts(spark, sf_dir):
    """Lists under a key, wherever they are in a document down to eight containers; deeper ones are not read."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"urls":["x","k'), k, F.lit('","x",""],"more":{"urls":["no"]}}'))).otherwise('[[{"a":{"urls":["y"]}}]]')
    deep = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit('{"a":' * 9), body, F.lit("}" * 9))).otherwise(F.concat(F.lit('{"a":[{"b":{"urls":"text","c":['), body, F.lit("]}}]}")))
    return S.find_texts(e.select("event_id", F.parse_json(deep).alias("v")), "v", "urls").select("event_id", F.array_join("texts", "|").alias("texts"))


def _requests(spark, sf_dir, outcomes):
    """Requests of users for their evaluations, a third of all for one user, from the events in order."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    id_ = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id") % 50).cast("long")
    kind = F.when(F.col("event_type") == "signup", "dispatch").when(k < 30, "fail").when(k < 45, "reserve").otherwise("callback")
    outcome = F.element_at(F.array(*map(F.lit, outcomes)), (k % len(outcomes) + 1).cast("int"))
    requests = e.select(id_.alias("id"), F.col("event_id").alias("ord"), kind.alias("request"), F.concat(F.lit("w"), k % 3).alias("owner"), (k % 4).alias("attempt"), outcome.alias("outcome"), (F.col("value") * 10_000).cast("long").alias("cost"))
    states = requests.select("id").distinct().filter("id <> 7").select("id", F.when(F.col("id") % 5 == 4, "insufficient_facts").otherwise("deterministic").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("owner"))
    return states, requests


def _machine_sql(outcomes: tuple[str, ...], limit: int | None, named: bool, reply: bool) -> str:
    """Each id's requests one after the other, as recursive SQL."""
    listed = "[" + ", ".join(f"'{o}'" for o in outcomes) + "]"
    valid = "('complete', 'agent_rejected', 'needs_human_review', 'call_outcome_unknown')" if limit is None else "('complete', 'agent_rejected', 'call_outcome_unknown')"
    closed = "outcome" if limit is None else f"CASE WHEN cost > {limit} THEN 'agent_rejected' ELSE outcome END"
    refused = f"WHEN what = 'reserve' AND status <> 'dispatching' THEN CASE WHEN status = 'reserved' THEN 'already_reserved' WHEN status IN ('failed', 'insufficient_facts', 'complete', 'agent_rejected', 'call_outcome_unknown') THEN 'terminal' ELSE 'ineligible' END" if named else ""
    can = "status IN ('deterministic', 'dispatch_failed') AND tries < 3"
    last = "SELECT id, status, tries AS attempts, owner FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC) AS z FROM w) WHERE z = 1" if not reply else "SELECT w.id, r.ord, w.reply FROM w JOIN r ON r.id = w.id AND r.i = w.i UNION ALL SELECT id, ord, 'unknown' FROM r WHERE id = 7"
    return f"""WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id % 50 END AS id, event_id AS ord, CASE WHEN event_type = 'signup' THEN 'dispatch' WHEN k < 30 THEN 'fail' WHEN k < 45 THEN 'reserve' ELSE 'callback' END AS what, 'w' || k % 3 AS by_, k % 4 AS attempt,
{listed}[k % {len(outcomes)} + 1] AS outcome, trunc(value * 10000)::BIGINT AS cost, row_number() OVER (PARTITION BY CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id % 50 END ORDER BY event_id) AS i FROM e),
w AS (SELECT DISTINCT id, 0::BIGINT AS i, CASE WHEN id % 5 = 4 THEN 'insufficient_facts' ELSE 'deterministic' END AS status, 0 AS tries, NULL::VARCHAR AS owner, NULL::VARCHAR AS reply FROM r WHERE id <> 7
UNION ALL SELECT id, i, CASE reply WHEN 'dispatched' THEN 'dispatching' WHEN 'failed' THEN CASE WHEN tries >= 3 THEN 'failed' ELSE 'dispatch_failed' END WHEN 'taken' THEN 'reserved' WHEN 'closed' THEN {closed} ELSE status END,
CASE reply WHEN 'dispatched' THEN tries + 1 ELSE tries END, CASE WHEN reply IN ('dispatched', 'failed') THEN NULL WHEN reply = 'taken' THEN by_ ELSE owner END, reply
FROM (SELECT w.id, r.i, w.status, w.tries, w.owner, r.by_, r.outcome, r.cost, CASE WHEN what = 'dispatch' THEN CASE WHEN {can} THEN 'dispatched' ELSE 'ineligible' END {refused} WHEN attempt <> tries THEN 'stale_attempt' WHEN what = 'fail' AND status = 'dispatching' THEN 'failed'
WHEN what = 'reserve' AND status = 'dispatching' THEN 'taken' WHEN what = 'callback' AND status = 'reserved' THEN CASE WHEN w.owner = by_ AND outcome IN {valid} THEN 'closed' ELSE 'binding_conflict' END ELSE 'ineligible' END AS reply
FROM w JOIN r ON r.id = w.id AND r.i = w.i + 1))
{last.replace("w.reply", "CASE WHEN w.reply IN ('dispatched', 'failed', 'taken', 'closed') THEN 'applied' ELSE w.reply END AS reply")}"""


_OUTCOMES = ("complete", "nonsense", "needs_human_review", "agent_rejected", "call_outcome_unknown")


@query(_machine_sql(_OUTCOMES, None, False, False))
def evaluations_after_requests(spark, sf_dir):
    """Evaluations after all their requests, many of them for one."""
    return T.answered(*_requests(spark, sf_dir, _OUTCOMES), T.EVALUATION)[0]


@query(_machine_sql(_OUTCOMES, 250_000, True, True))
def challenge_replies(spark, sf_dir):
    """What every request for a search challenge is told."""
    return T.answered(*_requests(spark, sf_dir, _OUTCOMES), T.CHALLENGE)[1]


_CHANGES = """c AS (SELECT event_id // 10 AS id, event_id AS seq, event_id % 10 AS i, CASE WHEN event_id % 10 IN (0, 5) THEN 'insert' WHEN event_id % 10 IN (1, 2, 3, 6) THEN 'update' ELSE 'receipt' END AS change,
['deterministic', 'complete', 'dispatching', 'failed', 'reserved', 'dispatching'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 + 1] AS status, 'r' || user_id % 3 AS receipt, date_trunc('millisecond', ts::TIMESTAMP) AS ms FROM events)"""


@query(f"""WITH RECURSIVE {_CHANGES}, w AS (SELECT DISTINCT id, -1::BIGINT AS i, NULL::VARCHAR AS status, '' AS feedback, NULL::BIGINT AS since, []::VARCHAR[] AS seen, NULL::VARCHAR AS effect, NULL::VARCHAR AS detail, false AS opened FROM c
UNION ALL SELECT id, i, CASE WHEN effect = 'applied' THEN new ELSE status END, CASE WHEN effect = 'applied' AND closes AND feedback = '' THEN 'pending' WHEN effect = 'acknowledged' THEN 'done' ELSE feedback END,
CASE WHEN effect = 'applied' AND closes AND feedback = '' THEN seq ELSE since END, CASE WHEN effect = 'acknowledged' THEN list_append(seen, receipt) ELSE seen END, effect, detail, effect = 'applied' AND closes AND feedback = ''
FROM (SELECT *, new IN ('complete', 'failed') AS closes, CASE WHEN change = 'receipt' THEN CASE WHEN list_contains(seen, receipt) OR feedback <> 'pending' THEN 'refused' ELSE 'acknowledged' END
WHEN change = 'insert' AND status IS NOT NULL OR change = 'update' AND (status IS NULL OR status IN ('complete', 'failed')) THEN 'refused' ELSE 'applied' END AS effect,
CASE WHEN change = 'receipt' THEN CASE WHEN list_contains(seen, receipt) THEN 'repeated receipt' WHEN feedback <> 'pending' THEN 'nothing pending' ELSE receipt END WHEN change = 'insert' AND status IS NOT NULL THEN 'exists' WHEN change = 'update' AND status IS NULL THEN 'unknown'
WHEN change = 'update' AND status IN ('complete', 'failed') THEN 'immutable' ELSE new END AS detail FROM (SELECT w.id, c.i, c.seq, w.status, w.feedback, w.since, w.seen, c.change, c.status AS new, c.receipt FROM w JOIN c ON c.id = w.id AND c.i = w.i + 1))),
z AS (SELECT id, status, since, feedback FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC) AS n FROM w) WHERE n = 1)
SELECT w.id, c.seq, w.effect, w.detail, c.ms AS "at" FROM w JOIN c ON c.id = w.id AND c.i = w.i UNION ALL SELECT w.id, c.seq, 'outbox', w.detail, c.ms FROM w JOIN c ON c.id = w.id AND c.i = w.i WHERE w.opened
UNION ALL SELECT z.id, c.seq, 'overdue', z.status, c.ms + INTERVAL 60 MINUTES FROM z JOIN c ON c.id = z.id AND c.seq = z.since WHERE z.feedback = 'pending' AND c.ms + INTERVAL 60 MINUTES <= (SELECT date_trunc('millisecond', max(ts)::TIMESTAMP) - INTERVAL 1 MINUTE FROM events)""")
def trigger_effects(spark, sf_dir):
    """What a store's triggers do on a stream of changes: refused updates, outbox rows, receipts, overdue feedback."""
    e = V.source(spark, sf_dir)
    i, k = F.col("event_id") % 10, F.get_json_object("props", "$.k").cast("int")
    states = F.array(*map(F.lit, ["deterministic", "complete", "dispatching", "failed", "reserved", "dispatching"]))
    changes = e.select(
        F.floor(F.col("event_id") / 10).alias("id"), F.col("event_id").alias("seq"), F.when(i.isin(0, 5), "insert").when(i.isin(1, 2, 3, 6), "update").otherwise("receipt").alias("change"),
        F.element_at(states, k % 6 + 1).alias("status"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("receipt"), F.col("ts").alias("at"),
    )
    return G.run(changes, new_shared(spark, "triggers")).drop("batch")


@query("""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 12 AS k, o_custkey % 5 AS c FROM orders)
SELECT id, '' AS path, 'type' AS keyword FROM x WHERE k = 0 UNION ALL SELECT id, '/crawl', 'required' FROM x WHERE k = 1 UNION ALL SELECT id, '/results', 'minItems' FROM x WHERE k = 2 UNION ALL SELECT id, '/results/' || c || '/role', 'enum' FROM x WHERE k = 3
UNION ALL SELECT id, '/results/' || i || '/coverage/maxPages', 'minimum' FROM x, unnest(range(c + 1)) AS r(i) WHERE k = 4 UNION ALL SELECT id, '/document/blocks/0/claimType', 'required' FROM x WHERE k = 5 UNION ALL SELECT id, '/document/blocks/0/sourceUrl', 'format' FROM x WHERE k = 5
UNION ALL SELECT id, '/document/extra', 'additionalProperties' FROM x WHERE k = 6 UNION ALL SELECT id, '/ok', 'const' FROM x WHERE k = 7 UNION ALL SELECT id, '/crawl/generatedAt', 'format' FROM x WHERE k = 8 AND c = 2""")
def contract_violations(spark, sf_dir):
    """Where report documents break their contract, and by which rule."""
    o = dealt(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey") % 12, F.col("o_custkey") % 5
    one = lambda i: F.concat(
        F.lit('{"domain":"d","role":"'), F.when((k == 3) & (i == c), "boss").otherwise("primary"), F.lit('","pages":[],"products":[],"gaps":[],"coverage":{"pagesRequested":1,"pagesFetched":1,"maxPages":'),
        F.when(k == 4, "0").otherwise("4"), F.lit(',"robotsChecked":true},"fetchedAt":"2024-01-01T00:00:00Z"}'),
    )
    results = F.when(k == 2, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), c), one), ","))
    block = F.when(k == 5, '{"type":"evidence","id":"e","sourceUrl":"no uri","observedAt":"2024-01-01T00:00:00Z","confidence":"Low"}').otherwise('{"type":"gap","id":"g","domain":"d","reason":"r","observedAt":""}')
    day = F.when((k == 8) & (c == 2), "2024-13-01").otherwise("2024-12-01")
    crawl = F.when(k == 1, F.lit("")).otherwise(F.concat(F.lit(',"crawl":{"maxPagesPerDomain":3,"robotsAware":true,"generatedAt":"'), day, F.lit('T00:00:00Z"}')))
    whole = F.concat(F.lit('{"ok":'), F.when(k == 7, "1").otherwise("true"), F.lit(',"live":true,"primaryDomain":"p","results":['), results, F.lit('],"document":{"version":"1","generatedAt":"2024-01-01T00:00:00Z",'), F.when(k == 6, '"extra":1,').otherwise(""), F.lit('"blocks":['), block, F.lit("]}"), crawl, F.lit("}"))
    document = F.parse_json(F.when(k == 0, "[]").otherwise(whole))
    rows = o.select(F.col("o_orderkey").alias("id"), document.alias("document"))
    return rows.select("id", F.explode(K.violations(F.col("document"), K.REPORT)).alias("v")).select("id", "v.*")


def _evidence(spark, sf_dir):
    """Priced matches of runs of a hundred orders; a third of all lines is one run."""
    l = load(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    run = F.when(key % 3 == 0, F.lit(-1)).otherwise(F.floor(key / 100)).cast("long")
    text = lambda c: F.lit(None).cast("string").alias(c)
    product = lambda id_, domain, name, prices: F.struct(
        id_.alias("id"), domain.alias("domain"), name.alias("name"), F.lit("mug").alias("category"), F.lit("u").alias("source_url"), F.lit("t").alias("observed_at"), F.lit(None).cast("array<string>").alias("gtins"),
        text("sku"), text("mpn"), text("brand"), prices.alias("prices"),
    )
    price = F.array(F.struct(F.concat(F.lit(" €  "), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("raw"), F.lit("EUR").alias("currency"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"), F.lit("").alias("period")))
    rows = l.select(
        run.alias("run"), F.col("l_partkey").alias("primary_id"), F.concat(F.lit("d"), "l_linenumber").alias("domain"), F.concat(key, F.lit("-"), "l_suppkey", F.lit("-"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("rival_id"), F.round(F.col("l_discount") * 100).cast("long").alias("score"),
        (F.col("l_linestatus") == "F").alias("exact"), (F.col("l_tax") < 0.07).alias("eligible"),
        product(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("d"), "l_linenumber"), F.repeat(F.lit("ñ "), F.col("l_quantity").cast("int") * 2), price).alias("product"),
    )
    primaries = rows.select("run", "primary_id").distinct().withColumn("product", product(F.concat(F.lit("p"), "primary_id"), F.lit("own"), F.lit("n"), F.lit(None).cast("array<struct<raw:string,currency:string,amount:bigint,period:string>>")))
    return B.evidence_rows(primaries, rows, most_matches=3)


_EVIDENCE = """x AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_orderkey // 100 END AS run, l_partkey AS primary_id, 'd' || l_linenumber AS domain, l_orderkey || '-' || l_suppkey || '-' || round(l_extendedprice * 100)::BIGINT AS rival_id, round(l_discount * 100)::BIGINT AS score,
l_linestatus = 'F' AS exact, l_tax < 0.07 AS eligible, l_suppkey, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity::INTEGER AS n FROM lineitem),
m AS (SELECT *, '{"domain":"' || domain || '","product":{"id":"s' || l_suppkey || '","domain":"' || domain || '","name":"' || left(rtrim(repeat('ñ ', n * 2)), 120) || '","prices":[{"raw":"€ ' || cents || '","currency":"EUR","amount":' || cents || '}],"source_url":"u","observed_at":"t"},"score":' || score || CASE WHEN exact THEN '' ELSE ',"verdict":"close_substitute"' END || '}' AS j,
row_number() OVER (PARTITION BY run, primary_id ORDER BY exact DESC, score DESC, domain, rival_id) AS k FROM x WHERE eligible),
g AS (SELECT run, primary_id, string_agg(j, ',' ORDER BY k) AS j FROM m WHERE k <= 3 GROUP BY ALL),
r AS (SELECT run, primary_id, strlen('{"primary":{"id":"p' || primary_id || '","domain":"own","name":"n","source_url":"u","observed_at":"t"},"matches":[' || coalesce(j, '') || ']}') AS bytes FROM (SELECT DISTINCT run, primary_id FROM x) LEFT JOIN g USING (run, primary_id))"""


@query(f"WITH {_EVIDENCE} SELECT run, count(*) AS rows, (sum(bytes) + count(*) + 1)::BIGINT AS bytes, sum(bytes) + count(*) + 1 <= 60000 AS kept FROM r GROUP BY run")
def evidence_budgets(spark, sf_dir):
    """Bytes of each run's published evidence, and which runs keep to their budget."""
    return B.run_budgets(_evidence(spark, sf_dir), 60_000)


@query(f"""WITH {_EVIDENCE} SELECT run, primary_id, "end", "end" <= 50000 AS kept FROM (SELECT run, primary_id, (sum(bytes + 1) OVER (PARTITION BY run ORDER BY bytes, primary_id) + 1)::BIGINT AS "end" FROM r)""")
def evidence_envelopes(spark, sf_dir):
    """Which rows of a run's evidence fit into an envelope, the shortest first."""
    return B.envelope(_evidence(spark, sf_dir).select("run", "primary_id", "bytes"), ["bytes", "primary_id"], 50_000).select("run", "primary_id", "end", "kept")


@query("""WITH c AS (SELECT 'r' || l_orderkey % 97 AS run, l_linenumber AS attempt, l_orderkey * 100000 + l_partkey * 10 + l_quantity::BIGINT % 10 AS batch, l_returnflag || l_shipdate::DATE AS payload, l_orderkey % 97 AS k FROM lineitem),
n AS (SELECT run, attempt, batch, payload, row_number() OVER (PARTITION BY run ORDER BY attempt DESC, batch) AS n, count(*) OVER (PARTITION BY run) > 20 AS more FROM c WHERE k % 5 > 0 AND (k % 5 = 1 OR attempt < k % 7 + 1 OR attempt = k % 7 + 1 AND batch > 100000000))
SELECT run, attempt, batch, min(payload) AS payload, more FROM n WHERE n <= 20 GROUP BY run, attempt, batch, more HAVING count(*) = 1""")
def checkpoint_pages(spark, sf_dir):
    """A page of stored checkpoints for each run that asks, from its cursor on."""
    l = load(spark, sf_dir, "lineitem")
    run = F.concat(F.lit("r"), F.col("l_orderkey") % 97)
    batch = F.col("l_orderkey") * 100_000 + F.col("l_partkey") * 10 + F.col("l_quantity").cast("long") % 10
    rows = l.select(run.alias("run"), F.col("l_linenumber").alias("attempt"), batch.alias("batch"), F.concat("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("payload"))
    path = new_shared(spark, "checkpoints")
    P.write_checkpoints(rows, path)
    k = F.col("l_orderkey") % 97
    first = k % 5 == 1
    cursors = l.filter(k % 5 > 0).select(run.alias("run"), F.when(~first, (k % 7 + 1).cast("int")).alias("attempt"), F.when(~first, F.lit(100_000_000)).cast("long").alias("batch")).distinct()
    found = P.pages(P.read_checkpoints(spark, path), cursors, 20)
    return found.groupBy("run", "attempt", "batch", "more").agg(F.min("payload").alias("payload"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
