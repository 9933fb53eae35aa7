from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrine.functions.codes import countries, currencies
from vitrine.functions import identifiers as I
from vitrine.functions import numbers as N
from vitrine.functions import prices as P
from vitrine.functions import text as X
from vitrine.functions import urls as U
from vitrine.operators.aggregates import information_score


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def over(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_numbers(spark):
    assert over(spark, N.half_up, [2.5, -2.5, 2.4999, None], "double") == [3, -2, 2, None]
    assert over(spark, N.clamp100, [-4.0, 55.5, 101.0], "double") == [0, 56, 100]
    r = one(spark, N.percent_of(F.lit(1), F.lit(0)), N.percent_of(F.lit(1), F.lit(8)), N.observed_score([(F.lit(None).cast("double"), 60), (F.lit(50.0), 40)]), N.observed_score([(F.lit(None).cast("double"), 1)]))
    assert (r[0], r[1], r[2], r[3]) == (None, 13, 50.0, None)
    medians = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.5), ("b", 7.0), ("b", 9.5)], "k string, v double").groupBy("k").agg(N.rounded_median("v").alias("m"))
    assert {r["k"]: r["m"] for r in medians.collect()} == {"a": 2.0, "b": 7.0}
    r = one(spark, N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), N.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))), N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))
    assert list(r) == [1.0, 0.0, 0.0]


def test_percent_rounds_an_exact_half_up(spark):
    # 29 / 200 * 100 is 14.499999999999998 in doubles, 29 * 100 / 200 is 14.5; 57 of 200 likewise.
    r = one(spark, N.percent_of(F.lit(29), F.lit(200)), N.percent_of(F.lit(57), F.lit(200)), N.percent_of(F.lit(28), F.lit(200)))
    assert tuple(r) == (15, 29, 14)
    rows = spark.range(200).select((F.col("id") < 29).alias("has"))
    assert rows.agg(information_score(F.col("has")).alias("s")).collect()[0]["s"] == 15


def test_bilingual_normalize(spark):
    values = ["  Crème  BRÛLÉE!", "١٢٫٥ كجم", "1,5 L", "أحمد إيمان آلة", "مـــد َ", "v1.2.x a.b .5", "ﬁne Ａ", None, "1٬000"]
    want = ["crème brûlée", "12.5 كجم", "1.5 l", "احمد ايمان اله", "مد", "v1.2 x a b 5", "fine a", "", "1000"]
    got = over(spark, X.bilingual_normalize, values)
    assert got == want and over(spark, X.bilingual_normalize, got) == want
    assert over(spark, X.bilingual_tokens, ["Tea tea 1.5 kg"]) == [["tea", "1", "5", "kg"]]


def test_tokens_and_names(spark):
    assert over(spark, X.folded_normalize, ["<b>Crème</b> &amp; Brûlée", None]) == ["creme brulee", ""]
    assert over(spark, X.tokens, ["The Blue Widget Plus of a widget"]) == [["blue", "widget"]]
    assert one(spark, X.field_tokens(F.lit("Acme Blue Widget 250g 12"), F.lit("www.acme.com")))[0] == ["acme", "blue", "widget"]
    assert one(spark, X.field_tokens(F.lit("Acme Blue Widget 250g 12"), F.lit("acme.com")))[0] == ["blue", "widget"]
    assert over(spark, X.family_name, ["Blue Tea (20 bags) - large", "Tea | x", "Tea-bag"]) == ["Blue Tea", "Tea", "Tea-bag"]
    assert over(spark, X.slug, ["Crème Brûlée 2!", " ", None]) == ["creme-brulee-2", "unnamed", "unnamed"]
    assert over(spark, X.writing_systems, ["abc", "шай чай abc", "12"]) == [["Latin"], ["Latin", "Cyrillic"], []]
    assert one(spark, X.disjoint_scripts(F.lit("tea"), F.lit("شاي")))[0] is True
    assert one(spark, X.numbers_in(F.lit("1,200 of 3.5 and 3.5")))[0] == ["1200", "3.5"]


@pytest.mark.parametrize(
    "a,b,near", [("widget", "widgets", True), ("widget", "wodget", True), ("widget", "wdiget", False), ("cat", "cut", False), ("cat", "cat", True), ("abcde", "abcd", False), ("widget", "widgeted", False)]
)
def test_one_edit(spark, a, b, near):
    r = one(spark, X.within_one_edit(F.lit(a), F.lit(b)), F.arrays_overlap(X.edit_signatures(F.lit(a)), X.edit_signatures(F.lit(b))))
    assert r[0] is near and (r[1] or not near)


def test_short_ids():
    def plain(s):
        h = 2166136261
        for ch in s:
            h = (h ^ ord(ch)) * 16777619 % 2**32
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out[:6]

    assert all(X.fnv_hash(s) == plain(s) for s in ("", "a", "blue widget", "é")) and len(X.fnv_hash("x")) == 6


def test_identifiers(spark):
    assert over(spark, I.canonical_gtin, ["4006381333931", " 96385074", "036000291452", "4006381333932", "11111111", "123", None, "40063813339x1"]) == ["04006381333931", "00000096385074", "00036000291452", None, None, None, None, None]
    q = over(spark, I.parse_quantity, ["Tea 250 g", "Tea 1.5kg", "Tea 250 g 0.25 kg", "Tea 250 g 1 l", "Pack of 2", "12 pcs", "1.5 pcs", "شاي ٢٥٠ جم", "2 oz", None, "x250g"])
    assert [x and tuple(x) for x in q] == [
        ("mass", 250.0, "g"), ("mass", 1500.0, "g"), ("mass", 250.0, "g"), None, None, ("count", 12.0, "pcs"), None, ("mass", 250.0, "g"), ("mass", 56.699046, "g"), None, None,
    ]
    a, b, n = F.array(F.lit("1"), F.lit("2")), F.array(F.lit("2")), F.lit(None).cast("array<string>")
    assert list(one(spark, I.shared_gtin(a, b), I.conflicting_gtins(a, F.array(F.lit("3"))), I.conflicting_gtins(a, n), I.shared_gtin(a, n))) == ["2", True, False, ""]


@pytest.mark.parametrize(
    "text,currency,want",
    [
        ("$12.50", None, (None, 12.5, None)), ("US$ 12.50", None, ("USD", 12.5, None)), ("12.50", "usd", ("USD", 12.5, None)), ("€9 / month", None, ("EUR", 9.0, "month")), ("EUR 1,299.00", None, ("EUR", 1299.0, None)),
        ("£5 EUR", None, None), ("5 - 9 USD", None, None), ("-5 USD", None, None), ("(5.00)", None, None), ("USD 5", "EUR", None), ("$5", "EUR", None), ("&pound;7.20", None, ("GBP", 7.2, None)), ("free", None, None), ("", None, None),
        ("CA$ 5 per user per month", None, ("CAD", 5.0, "month")), ("5 USD", None, ("USD", 5.0, None)), ("−5", None, None), ("0 USD", None, ("USD", 0.0, None)),
    ],
)
def test_price_signal(spark, text, currency, want):
    got = P.price_signal(text, currency, currencies())
    assert (got and got[1:]) == want


def test_codes(spark):
    assert len(countries()) == 249 and {"HM", "MO", "GI", "PR", "KY", "SS"} <= countries() and not {"UK", "EU", "AN"} & countries()
    assert {"JPY", "SEK", "TRY", "KRW", "AED"} <= currencies() and "XXX" not in currencies()
    assert over(spark, P.is_supported_currency, ["jpy", " SEK ", "ABC", None]) == [True, True, False, False]


def test_listings_in_many_languages(spark):
    yes = ["https://s.com/collections/tea/products/x", "https://s.com/suche/tee", "https://s.com/tienda/busqueda-te", "https://s.com/a/b%C3%BAsqueda", "https://s.com/x/page/2", "https://s.com/products/all", "https://s.com/p?sort=up", "https://s.com/検索", "not a url", None]
    no = ["https://s.com/products/blue-tea", "https://s.com/produkte/tee?variant=3&sku=1", "https://s.com/tea/alle", "https://s.com/"]
    assert over(spark, U.is_listing_url, yes + no) == [True] * len(yes) + [False] * len(no)


def test_detail_pages(spark):
    yes = ["https://s.com/p/tea", "https://s.com/en-gb/products/tea/", "https://s.com/de/tee.html", "https://s.com/منتج/شاي", "https://s.com/store/%E8%8C%B6"]
    no = ["https://s.com/products", "https://s.com/products/tea/reviews", "https://s.com/shop-all/p/tea", "https://s.com/blog/p/tea", "https://s.com/about", "https://s.com/", "x", None]
    assert over(spark, U.is_detail_url, yes + no) == [True] * len(yes) + [False] * len(no)


def test_offers(spark):
    kind = "array<struct<label:string,valid_until:timestamp,currency:string,low:double,high:double,price:double>>"
    old, new = datetime(2020, 1, 1), datetime(2030, 1, 1)
    cases = [
        [("", None, "USD", None, None, 5.0)], [("List price", None, "USD", None, None, 9.0), ("", None, "USD", None, None, 5.0)], [("", None, "USD", None, None, 9.0), ("", None, "USD", None, None, 5.0)],
        [("", None, "USD", 5.0, 9.0, None)], [("", None, "USD", 9.0, 5.0, None)], [("", old, "USD", None, None, 5.0)], [("", new, "USD", None, None, 5.0)], [],
    ]
    got = over(spark, lambda c: P.resolve_offers(c, F.lit(datetime(2025, 1, 1))), cases, kind)
    assert [[tuple(x) for x in g] for g in got] == [[("USD", 5.0)], [("USD", 5.0)], [], [("USD", 5.0), ("USD", 9.0)], [], [], [("USD", 5.0)], []]


def test_price_claims(spark):
    g = lambda n: ("mass", float(n), "g") if n else None
    rows = [
        ("USD 10", "USD 8", None, None, "USD 10", "USD 8"), ("", "", None, None, "about ten", ""), ("", None, None, None, None, None), ("USD 10", " ", None, None, None, None), ("USD 10", "call us", None, None, None, None),
        ("USD 10", "EUR 8", None, None, None, None), ("USD 10", "USD 12", g(500), g(1000), None, None), ("USD 10", "USD 10.00", g(500), g(500), None, None), ("USD 10", "USD 8", g(500), None, None, None),
    ]
    q = "struct<kind:string,amount:double,unit:string>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, p string, r string, pq {q}, rq {q}, ap string, ar string")
    got = [tuple(x["claim"]) for x in P.price_claims(df, *(F.col(c) for c in ("p", "r", "pq", "rq", "ap", "ar"))).orderBy("i").collect()]
    assert [x[0] for x in got] == ["direct", "approved-unparsed", "none-observed", "one-observed", "both-observed", "both-observed", "unit-normalized", "listed-equal", "listed-gap"]
    assert got[0] == ("direct", "rival", "USD", 2.0, 20, None) and got[3][5] == "primary" and got[4][5] == "format" and got[5][5] == "currency"
    assert got[6][1:5] == ("rival", "USD", 0.8, 40) and got[8][1:4] == ("rival", "USD", 2.0)


def test_public_price_and_agreement(spark):
    s = lambda *x: F.array(*(F.struct(F.lit(c).alias("currency"), F.lit(a).alias("amount")) for c, a in x))
    now, seen = F.lit(datetime(2025, 1, 1)), F.lit(datetime(2024, 6, 1))
    ok = lambda signals, url="https://www.shop.com/p/x", at=seen: P.price_is_public(signals, F.lit(url), F.lit("shop.com"), at, now)
    r = one(spark, ok(s(("USD", 5.0))), ok(s(("USD", 5.0), ("EUR", 5.0))), ok(s(("USD", 0.0))), ok(s(("USD", 5.0)), "https://other.com/"), ok(s(("USD", 5.0)), at=F.lit(datetime(2023, 1, 1))), ok(s(("USD", 5.0)), "https://eu.shop.com/p/1"))
    assert list(r) == [True, False, False, False, False, True]
    assert one(spark, P.signals_agree(s(("USD", 5.0), ("EUR", 4.0)), s(("EUR", 4.0), ("USD", 5.0))))[0] is True
    assert one(spark, P.comparable_price(s(("USD", 5.0), ("USD", 5.0))))[0]["amount"] == 5.0 and one(spark, P.comparable_price(s(("USD", 5.0), ("USD", 6.0))))[0] is None


def test_urls(spark):
    assert over(spark, U.canonical_host, ["https://WWW.Shop.com:8080/x", "shop.com/y", " www.a.b ", None]) == ["shop.com", "shop.com", "a.b", ""]
    assert over(spark, U.host_suffixes, ["a.b.c"]) == [["a.b.c", "b.c", "c"]]
    assert over(spark, U.registrable_label, ["www.shop.co.uk", "eu.shop.com", "shop.com", "localhost"]) == ["shop", "shop", "shop", "localhost"]
    assert over(spark, U.is_public_host, ["shop.com", "localhost", "10.0.0.1", "8.8.8.8", "172.20.1.1", "999.1.1.1", "a.local", "x", None]) == [True, False, False, True, False, False, False, False, False]
    assert over(spark, U.product_path, ["https://s.com/en/products/Blue-Tea?x=1", "https://s.com/products/", "https://s.com/about"]) == ["blue-tea", None, None]
    assert over(spark, U.is_listing_route, ["https://s.com/collections/tea", "https://s.com/collections/tea/products/x", "https://s.com/"]) == [True, False, False]
    assert over(spark, U.locale_neutral_url, ["https://www.s.com/en-us/p/x/?q", "https://s.com/fr"]) == ["s.com/p/x", "s.com/"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://shop.com/products/x?country=US", ("US", "", True, False, "country:US")), ("https://shop.com/en-gb/products/x", ("GB", "", True, False, "country:GB")), ("https://shop.de/x", ("DE", "", False, False, "country:DE")),
        ("https://shop.de/products/x?country=US", ("", "", True, True, "conflict")), ("https://shop.com/en/products/x", ("", "", False, False, "")), ("https://shop.com/?currency=EUR", ("", "EUR", True, False, "currency:EUR")),
        ("https://shop.io/x", ("", "", False, False, "")), ("https://shop.com/?currency=XXX", ("", "", True, False, "currency:?")), (None, ("", "", False, False, "")), ("http://[bad", ("", "", False, False, "")), ("https://a.co.uk/", ("GB", "", False, False, "country:GB")),
        ("https://shop.com/products/x?country_code=hm&currencycode=SEK", ("HM", "SEK", True, False, "country:HM|currency:SEK")), ("https://shop.com/products/x?market=EU", ("", "", False, False, "")), ("https://shop.com/products/x?locale=en", ("", "", True, False, "country:?")),
        ("https://shop.com/de/shop/x", ("", "", False, False, "")), ("https://shop.com/no/shop/x", ("NO", "", True, False, "country:NO")), ("https://shop.com/en-uk/products/x", ("", "", True, False, "country:?")), ("https://shop.com/au/products/x?currency=AUD&currency=NZD", ("", "", True, True, "conflict")),
        ("https://shop.com/ja/products/x", ("", "", False, False, "")), ("https://shop.nu/x", ("", "", False, False, "")), ("https://shop.ky/x", ("KY", "", False, False, "country:KY")),
    ],
)
def test_markets(spark, url, want):
    assert U.market_of(url, countries(), currencies()) == want
