"""Compiled contracts against a plain recursive validator."""

import copy
import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from vitrine.sources import contracts as C

ABSENT = object()


def plain(v, s, path, root):
    if v is ABSENT:
        return []
    if isinstance(s, bool):
        return [] if s else [(path, "false")]
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and float(v).is_integer()}
    eq = lambda a, b: type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b
    out = []
    bad = lambda cond, word, p=path: out.extend([(p, word)] if cond else [])
    for word, x in s.items():
        if word == "type":
            bad(not any(kinds[k] for k in (x if isinstance(x, list) else [x])), word)
        elif word == "const":
            bad(not eq(v, x), word)
        elif word == "enum":
            bad(not any(eq(v, y) for y in x), word)
        elif word == "required" and isinstance(v, dict):
            for k in x:
                bad(k not in v, word, f"{path}/{k}")
        elif word == "properties" and isinstance(v, dict):
            for k, t in x.items():
                out += plain(v.get(k, ABSENT), t, f"{path}/{k}", root)
        elif word == "additionalProperties" and isinstance(v, dict) and x is not True:
            for k in set(v) - set(s.get("properties", {})):
                out += [(f"{path}/{k}", word)] if x is False else plain(v[k], x, f"{path}/{k}", root)
        elif word == "items" and isinstance(v, list):
            for i, y in enumerate(v):
                out += plain(y, x, f"{path}/{i}", root)
        elif word in ("minItems", "maxItems") and isinstance(v, list):
            bad(len(v) < x if word == "minItems" else len(v) > x, word)
        elif word in ("minLength", "maxLength") and isinstance(v, str):
            bad(len(v) < x if word == "minLength" else len(v) > x, word)
        elif word in ("minimum", "maximum") and number:
            bad(v < x if word == "minimum" else v > x, word)
        elif word == "pattern" and isinstance(v, str):
            bad(not re.search(x, v), word)
        elif word == "format" and isinstance(v, str):
            ok = bool(re.match(C.DATE_TIME if x == "date-time" else C.URI, v))
            if ok and x == "date-time":
                try:
                    date.fromisoformat(v[:10])
                except ValueError:
                    ok = False
            bad(not ok, word)
        elif word == "allOf":
            for t in x:
                out += plain(v, t, path, root)
        elif word in ("anyOf", "oneOf", "not"):
            n = sum(not plain(v, t, path, root) for t in (x if isinstance(x, list) else [x]))
            bad(n == 0 if word == "anyOf" else n != 1 if word == "oneOf" else n == 1, word)
        elif word == "if":
            k = "else" if plain(v, x, path, root) else "then"
            out += plain(v, s[k], path, root) if k in s else []
        elif word == "$ref":
            target = root
            for part in x[2:].split("/"):
                target = target[part]
            out += plain(v, target, path, root)
    return out


def check(spark, docs, schema):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string")
    got = {r["id"]: sorted(map(tuple, r["x"])) for r in df.select("id", C.violations(F.parse_json("j"), schema).alias("x")).collect()}
    want = {i: sorted(plain(d, schema, "", schema)) for i, d in enumerate(docs)}
    assert got == want
    return [w for v in want.values() for _, w in v]


GOOD = {
    "ok": True, "live": True, "primaryDomain": "a.example", "more": 1,
    "results": [{"domain": "a", "role": "primary", "pages": [], "products": [], "gaps": [], "coverage": {"pagesRequested": 1, "pagesFetched": 0, "maxPages": 2.0, "robotsChecked": False}, "fetchedAt": "2024-02-29T10:00:00.5Z"}],
    "document": {"version": "1", "generatedAt": "2024-01-01T00:00:00+02:00", "blocks": [{"type": "evidence", "id": "e", "claimType": "Observed", "sourceUrl": "https://a/b", "observedAt": "2024-01-01T00:00:00Z", "confidence": "Low"}, {"type": "gap", "id": "g", "domain": "d", "reason": "r", "observedAt": "x"}, {"type": "competitor", "id": "c", "domain": "d", "discoverySourceUrl": "u", "websiteSourceUrl": "w"}, {"type": "other", "id": "o"}]},
    "crawl": {"maxPagesPerDomain": 3, "robotsAware": True, "generatedAt": "2024-01-01T00:00:00Z"},
}


def places(v, at=()):
    return [at] + [p for k, x in (v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else []) for p in places(x, (*at, k))]


def test_reports_and_broken_ones(spark):
    r = random.Random(1)
    docs = [GOOD, [], None, "text", {}, GOOD | {"crawl": {"maxPagesPerDomain": 0, "robotsAware": True, "generatedAt": "2024-01-01T00:00:00Z"}}]
    for _ in range(150):
        d = copy.deepcopy(GOOD)
        for at in r.sample(places(GOOD)[1:], 3):
            node = d
            try:
                for k in at[:-1]:
                    node = node[k]
                if r.random() < 0.4:
                    del node[at[-1]]
                else:
                    node[at[-1]] = r.choice([None, 0, -1, 1.5, "", "x", True, False, [], {}, [1], {"type": "gap"}, "2023-02-30T10:00:00Z", "2024-01-01", "not a uri"])
            except (KeyError, IndexError, TypeError):
                pass
        if r.random() < 0.2 and isinstance(d.get("document"), dict):
            d["document"]["extra"] = 1
        docs.append(d)
    assert set(check(spark, docs, C.REPORT)) == {"type", "const", "enum", "required", "minItems", "minLength", "minimum", "format", "additionalProperties"}


def test_all_other_keywords(spark):
    schema = {
        "$defs": {"short": {"type": "string", "maxLength": 3, "pattern": "^[a-z]"}},
        "type": ["object", "array"],
        "properties": {"a": {"$ref": "#/$defs/short"}, "b": {"oneOf": [{"type": "integer"}, {"type": "number", "maximum": 5}]}, "c": {"anyOf": [{"type": "string"}, {"const": 2}]}, "d": {"not": {"enum": ["x", None, 1]}}, "e": {"type": "array", "maxItems": 1, "items": {"$ref": "#/$defs/short"}}, "f": False},
        "additionalProperties": {"type": "null"},
        "if": {"required": ["a"]},
        "then": {"required": ["b"]},
        "else": {"required": ["c"]},
    }
    r = random.Random(2)
    values = ["x", "abcd", "1", "", None, 1, 2, 2.0, 5.5, 4, [], ["a", "B"], ["abcd"], {}, True]
    docs = [{k: r.choice(values) for k in r.sample("abcdefgh", r.randrange(5))} for _ in range(150)] + [[], "x"]
    assert set(check(spark, docs, schema)) == {"type", "maxLength", "pattern", "oneOf", "anyOf", "not", "maxItems", "required", "false"}


def test_unknown_keywords_are_refused():
    for schema in ({"multipleOf": 2}, {"format": "email"}, {"$ref": "other.json"}, {"$ref": "#"}):
        with pytest.raises(NotImplementedError):
            C.violations(F.lit(None), schema)
