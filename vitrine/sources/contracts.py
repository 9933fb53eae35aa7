"""JSON Schema contracts compiled to column expressions.

A schema becomes one expression over a VARIANT, an array of (path, keyword) of everything that
violates it, so documents are checked where they are read, without Python. Compiled are type,
const, enum, required, properties, additionalProperties, items, minItems, maxItems, minLength,
maxLength, minimum, maximum, pattern, format (date-time and uri), allOf, anyOf, oneOf, not,
if/then/else and $ref within the document; another keyword that constrains is an error, as it would be
skipped silently otherwise. A recursive $ref is one, too.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .structured import at

#: Says nothing about values.
NOTES = {"$schema", "$id", "$defs", "title", "description", "then", "else", "default", "examples", "$comment"}
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]+$"
VIOLATIONS = "array<struct<path:string,keyword:string>>"

# The contract of a crawl report.
_TEXT, _TIME, _LIST, _COUNT = {"type": "string", "minLength": 1}, {"type": "string", "format": "date-time"}, {"type": "array"}, {"type": "integer", "minimum": 0}
_SOME = {"type": "integer", "minimum": 1}
REPORT = {
    "type": "object",
    "required": ["ok", "live", "primaryDomain", "results", "document", "crawl"],
    "properties": {
        "ok": {"const": True},
        "live": {"const": True},
        "primaryDomain": _TEXT,
        "results": {
            "type": "array",
            "minItems": 1,
            "items": {
                "type": "object",
                "required": ["domain", "role", "pages", "products", "gaps", "coverage", "fetchedAt"],
                "properties": {
                    "domain": _TEXT,
                    "role": {"enum": ["primary", "submitted-comparison", "discovered-competitor"]},
                    "pages": _LIST,
                    "products": _LIST,
                    "gaps": _LIST,
                    "coverage": {
                        "type": "object",
                        "required": ["pagesRequested", "pagesFetched", "maxPages", "robotsChecked"],
                        "properties": {"pagesRequested": _COUNT, "pagesFetched": _COUNT, "maxPages": _SOME, "robotsChecked": {"type": "boolean"}},
                    },
                    "fetchedAt": _TIME,
                },
            },
        },
        "document": {
            "type": "object",
            "required": ["version", "generatedAt", "blocks"],
            "properties": {
                "version": {"const": "1"},
                "generatedAt": _TIME,
                "blocks": {
                    "type": "array",
                    "items": {
                        "type": "object",
                        "required": ["type", "id"],
                        "properties": {"type": _TEXT, "id": _TEXT},
                        "allOf": [
                            {
                                "if": {"properties": {"type": {"const": "evidence"}}, "required": ["type"]},
                                "then": {
                                    "required": ["claimType", "sourceUrl", "observedAt", "confidence"],
                                    "properties": {
                                        "claimType": {"enum": ["Observed", "Inferred", "Estimated", "Recommended"]},
                                        "sourceUrl": {"type": "string", "format": "uri"},
                                        "observedAt": _TIME,
                                        "confidence": {"enum": ["High", "Medium", "Low"]},
                                    },
                                },
                            },
                            {"if": {"properties": {"type": {"const": "gap"}}, "required": ["type"]}, "then": {"required": ["domain", "reason", "observedAt"]}},
                            {"if": {"properties": {"type": {"const": "competitor"}}, "required": ["type"]}, "then": {"required": ["domain", "discoverySourceUrl", "websiteSourceUrl"]}},
                        ],
                    },
                },
            },
            "additionalProperties": False,
        },
        "crawl": {"type": "object", "required": ["maxPagesPerDomain", "robotsAware", "generatedAt"], "properties": {"maxPagesPerDomain": _SOME, "robotsAware": {"const": True}, "generatedAt": _TIME}},
    },
}


VARIANT = T.VariantType()
#: Keywords that need to know what a value is; those of objects and of lists; those whose schemas tell of the same value.
SCALAR_WORDS = {"const", "enum", "minLength", "maxLength", "minimum", "maximum", "pattern", "format"}
OBJECT_WORDS, LIST_WORDS = {"properties", "required", "additionalProperties"}, {"items", "minItems", "maxItems"}
SEVERAL, SINGLE = ("allOf", "anyOf", "oneOf"), ("not", "if", "then", "else")


class View(NamedTuple):
    """A value as its VARIANT, and what it was read as once: its kind, its fields, its elements (null if it has none; None if not read)."""

    v: Column
    k: Column | None = None
    o: Column | None = None
    a: Column | None = None
    fields: T.DataType | None = None


def is_number(k: Column) -> Column:
    return k.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(k, F.lit("DECIMAL"))


#: What a value must be for each type.
KINDS = {
    "object": lambda x: F.startswith(x.k, F.lit("OBJECT")) if x.o is None else x.o.isNotNull(),
    "array": lambda x: F.startswith(x.k, F.lit("ARRAY")) if x.a is None else x.a.isNotNull(),
    "string": lambda x: x.k == "STRING",
    "boolean": lambda x: x.k == "BOOLEAN",
    "null": lambda x: x.k == "VOID",
    "number": lambda x: is_number(x.k),
    "integer": lambda x: is_number(x.k) & F.coalesce(at(x.v, "$", "double") == F.floor(at(x.v, "$", "double")), F.lit(False)),
}


def same(v: Column, k: Column, value) -> Column:
    """If a value is a constant of the schema."""
    if isinstance(value, (dict, list)):
        raise NotImplementedError("constants that are objects or lists")
    if isinstance(value, bool):
        ok = (k == "BOOLEAN") & (at(v, "$", "boolean") == F.lit(value))
    elif isinstance(value, str):
        ok = (k == "STRING") & (at(v, "$", "string") == F.lit(value))
    else:
        ok = k == "VOID" if value is None else is_number(k) & (at(v, "$", "double") == float(value))
    return F.coalesce(ok, F.lit(False))


def _target(ref: str, root: dict, seen: tuple[str, ...]):
    if ref in seen or not ref.startswith("#"):
        raise NotImplementedError(f"$ref {ref}")
    target = root
    for part in [x for x in ref[1:].split("/") if x]:
        target = target[part.replace("~1", "/").replace("~0", "~")]
    return target


def _level(schema: dict | bool, root: dict, seen: tuple[str, ...]) -> list[tuple[dict, tuple[str, ...]]]:
    """All schemas that tell of the same value, with the references that led there."""
    if isinstance(schema, bool):
        return []
    below = [(s, seen) for w in SEVERAL for s in schema.get(w, [])] + [(schema[w], seen) for w in SINGLE if w in schema]
    if "$ref" in schema:
        below.append((_target(schema["$ref"], root, seen), (*seen, schema["$ref"])))
    return [(schema, seen)] + [x for s, z in below for x in _level(s, root, z)]


def _fields(level: list, root: dict) -> T.DataType:
    """What an object is read as: the fields that its schemas name, each as what it should be."""
    named: dict[str, list] = {}
    for s, seen in level:
        for name, sub in s.get("properties", {}).items():
            named.setdefault(name, []).append(_shape(sub, root, seen))
        for name in s.get("required", []):
            named.setdefault(name, [])
    one = lambda kinds: kinds[0] if kinds and all(k == kinds[0] for k in kinds) else VARIANT
    return T.StructType([T.StructField(n, one(kinds)) for n, kinds in named.items()]) if named else T.MapType(T.StringType(), T.BooleanType())


def _elements(words: set[str]) -> T.DataType:
    return T.ArrayType(VARIANT if "items" in words else T.BooleanType())


def _shape(schema: dict | bool, root: dict, seen: tuple[str, ...]) -> T.DataType:
    """What a value is read as by the object that holds it: fields or elements if it can only be one of them, else a VARIANT."""
    level = _level(schema, root, seen)
    words = set().union(*(s for s, _ in level))
    kinds = [s["type"] for s, _ in level if "type" in s]
    if words & SCALAR_WORDS or any(isinstance(k, list) for k in kinds):
        return VARIANT
    if words & OBJECT_WORDS | {k for k in kinds if k == "object"} and not words & LIST_WORDS and set(kinds) <= {"object"}:
        return _fields(level, root)
    return _elements(words) if kinds and set(kinds) == {"array"} and not words & OBJECT_WORDS else VARIANT


def _once(value: Column, f) -> Column:
    """f(value), violations, with value worked out once; unlike taking an element of a list, a fold doesn't derive the type of f again for every row."""
    return F.aggregate(F.array(value), F.lit(None).cast(VIOLATIONS), lambda _, x: f(x))


def violations(v: Column, schema: dict | bool, path: Column | None = None) -> Column:
    """Array of path, keyword of what a VARIANT violates; a value that is absent (null, not JSON null) violates nothing.

    An object is read once, as a struct of the fields that the schema names, down to lists, whose
    elements are read in their turn; so no part of a document is searched or copied for each rule.
    """
    told = _once(v, lambda x: _joined(*_of_value(x, schema, F.lit("") if path is None else path, schema, ())).cast(VIOLATIONS))
    return F.filter(F.coalesce(told, F.array().cast(VIOLATIONS)), lambda x: x.isNotNull())


def _joined(ones: list[Column], many: list[Column]) -> Column:
    """One array of single violations (or nulls) and arrays of them."""
    none = F.array().cast(VIOLATIONS)
    parts = [F.array(*ones).cast(VIOLATIONS)] * bool(ones) + [F.coalesce(m, none) for m in many]
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0] if parts else none


def _of_value(v: Column, schema: dict | bool, path: Column, root, seen: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """Violations of a VARIANT, single ones and arrays; what it is read as is worked out once."""
    if isinstance(schema, bool):
        return ([] if schema else [F.when(v.isNotNull(), _violation(path, "false"))]), []
    level = _level(schema, root, seen)
    words = set().union(*(s for s, _ in level))
    kinds = {k for s, _ in level if "type" in s for k in (s["type"] if isinstance(s["type"], list) else [s["type"]])}
    read = {}
    if words & OBJECT_WORDS or "object" in kinds:
        fields = _fields(level, root)
        read["o"] = v.try_cast(fields)
    if words & LIST_WORDS or "array" in kinds:
        read["a"] = v.try_cast(_elements(words))
    if words & SCALAR_WORDS or kinds - {"object", "array"}:
        read["k"] = F.schema_of_variant(v)
    view = lambda cols: View(v, cols.get("k"), cols.get("o"), cols.get("a"), fields if "o" in read else None)
    if len(words - NOTES) <= 1 and set(read) <= {"k"}:
        ones, many = _broken(view(read), schema, path, root, seen)
        return [F.when(v.isNotNull(), x) for x in ones], [F.when(v.isNotNull(), x) for x in many]
    inner = lambda x: _joined(*_broken(view({c: x[c] for c in read}), schema, path, root, seen)).cast(VIOLATIONS)
    told = _once(F.struct(*(c.alias(n) for n, c in read.items())), inner) if read else inner({})
    return [], [F.when(v.isNotNull(), told)]


def _violation(path: Column, word: str) -> Column:
    return F.struct(path.alias("path"), F.lit(word).alias("keyword"))


def _broken(x: View, schema: dict | bool, path: Column, root, seen: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """What a value that was read violates, single violations and arrays of them."""
    none = F.array().cast(VIOLATIONS)
    if isinstance(schema, bool):
        return ([] if schema else [F.when(x.v.isNotNull(), _violation(path, "false"))]), []
    v, k = x.v, x.k
    ones: list[Column] = []
    many: list[Column] = []
    refuse = lambda bad, word, p=path: ones.append(F.when(bad, _violation(p, word)))

    def add(found: tuple[list[Column], list[Column]]) -> None:
        ones.extend(found[0])
        many.extend(found[1])

    def good(s: dict | bool) -> Column:
        single, arrays = _broken(x, s, path, root, seen)
        ok = F.lit(True)
        for one in single:
            ok &= one.isNull()
        for each in arrays:
            ok &= ~F.exists(F.coalesce(each, none), lambda y: y.isNotNull())
        return ok

    for word, value in schema.items():
        if word == "type":
            ok = F.lit(False)
            for kind in value if isinstance(value, list) else [value]:
                ok |= F.coalesce(KINDS[kind](x), F.lit(False))
            refuse(~ok & v.isNotNull(), word)
        elif word == "const":
            refuse(~same(v, k, value), word)
        elif word == "enum":
            ok = F.lit(False)
            texts = [y for y in value if isinstance(y, str)]
            if texts:
                ok |= F.coalesce((k == "STRING") & at(v, "$", "string").isin(texts), F.lit(False))
            for y in value:
                ok = ok if isinstance(y, str) else ok | same(v, k, y)
            refuse(~ok, word)
        elif word == "required":
            for key in value:
                gone = x.o[key].isNull()
                # A field that is read as an object or list is null for anything else, too.
                gone = gone if x.fields[key].dataType == VARIANT else gone & at(v, f"$['{key}']").isNull()
                refuse(x.o.isNotNull() & gone, word, F.concat(path, F.lit(f"/{key}")))
        elif word == "properties":
            for key, s in value.items():
                kind, field, below = x.fields[key].dataType, x.o[key], F.concat(path, F.lit(f"/{key}"))
                if kind == VARIANT:
                    add(_of_value(field, s, below, root, seen))
                else:
                    inside = View(at(v, f"$['{key}']"), a=field) if isinstance(kind, T.ArrayType) else View(at(v, f"$['{key}']"), o=field, fields=kind)
                    add(_broken(inside, s, below, root, seen))
        elif word == "additionalProperties":
            known = [F.lit(y) for y in schema.get("properties", {})]
            if value is False:
                more = F.filter(F.map_keys(v.try_cast("map<string,boolean>")), lambda e: ~e.isin(*known) if known else F.lit(True))
                many.append(F.transform(more, lambda e: _violation(F.concat(path, F.lit("/"), e), word)).cast(VIOLATIONS))
            elif value is not True:
                rest = F.filter(F.map_entries(v.try_cast("map<string,variant>")), lambda e: ~e["key"].isin(*known) if known else F.lit(True))
                many.append(F.flatten(F.transform(rest, lambda e: _joined(*_of_value(e["value"], value, F.concat(path, F.lit("/"), e["key"]), root, seen)))))
        elif word == "items":
            many.append(F.flatten(F.transform(x.a, lambda y, i: _joined(*_of_value(y, value, F.concat(path, F.lit("/"), i.cast("string")), root, seen)))))
        elif word in ("minItems", "maxItems"):
            n = F.size(x.a)
            refuse(x.a.isNotNull() & (n < value if word == "minItems" else n > value), word)
        elif word in ("minLength", "maxLength"):
            n = F.length(at(v, "$", "string"))
            refuse((k == "STRING") & (n < value if word == "minLength" else n > value), word)
        elif word in ("minimum", "maximum"):
            y = at(v, "$", "double")
            refuse(is_number(k) & (y < value if word == "minimum" else y > value), word)
        elif word == "pattern":
            refuse((k == "STRING") & ~at(v, "$", "string").rlike(value), word)
        elif word == "format":
            text = at(v, "$", "string")
            if value not in ("date-time", "uri"):
                raise NotImplementedError(f"format {value}")
            ok = text.rlike(DATE_TIME) & F.substring(text, 1, 10).try_cast("date").isNotNull() if value == "date-time" else text.rlike(URI)
            refuse((k == "STRING") & ~F.coalesce(ok, F.lit(False)), word)
        elif word == "allOf":
            for s in value:
                add(_broken(x, s, path, root, seen))
        elif word == "anyOf":
            ok = F.lit(False)
            for s in value:
                ok |= good(s)
            refuse(~ok, word)
        elif word == "oneOf":
            refuse(sum((F.when(good(s), 1).otherwise(0) for s in value), F.lit(0)) != 1, word)
        elif word == "not":
            refuse(good(value), word)
        elif word == "if":
            yes, no = (_joined(*_broken(x, schema[y], path, root, seen)) if y in schema else none for y in ("then", "else"))
            many.append(F.when(good(value), yes).otherwise(no))
        elif word == "$ref":
            add(_broken(x, _target(value, root, seen), path, root, (*seen, value)))
        elif word not in NOTES:
            raise NotImplementedError(f"keyword {word}")
    return ones, many
