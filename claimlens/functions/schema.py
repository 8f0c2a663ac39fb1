"""JSON Schema documents compiled to column expressions over VARIANT values.

`errors(schema)` gives a function from a VARIANT column to array<string>, `path: what is wrong` by path, so the first is the first failure;
no Python worker takes part. Supported are the keywords of KEYWORDS; any other is an error when compiling, so nothing is left
unchecked in silence. A list's items are checked by one expression, however long the list is.

Paths sort by their parts, names by code point and items by number, a container before what it holds. Of one path, the type comes
first and hides the rest; then lacking names, unknown names, sizes, repeats.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that are checked, and those that say nothing about a value.
KEYWORDS = {"type", "enum", "minLength", "maxLength", "pattern", "minimum", "maximum", "items", "uniqueItems", "minItems", "maxItems", "properties", "required", "additionalProperties", "$ref", "anyOf", "not"}
REMARKS = {"$schema", "$id", "$defs", "title", "description", "default", "examples"}
SAYS = {"string": "a text", "boolean": "a boolean", "integer": "an integer", "number": "a number", "array": "a list", "object": "an object", "null": "null"}

PART = "struct<is_name:boolean,k:int,name:string>"
FOUND = f"array<struct<at:array<{PART}>,what:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _none() -> Column:
    return F.array().cast(FOUND)


def _one(at: Column, what: Column | str) -> Column:
    return F.array(F.struct(at.alias("at"), (F.lit(what) if isinstance(what, str) else what).alias("what"))).cast(FOUND)


def _name(name: str | Column) -> Column:
    return F.struct(F.lit(True).alias("is_name"), F.lit(0).alias("k"), (F.lit(name) if isinstance(name, str) else name).alias("name")).cast(PART)


def _item(k: Column) -> Column:
    return F.struct(F.lit(False).alias("is_name"), k.cast("int").alias("k"), F.lit("").alias("name")).cast(PART)


def _if(wrong: Column, then: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), then).otherwise(_none())


def _as(v: Column, kind: str) -> Column:
    """v as kind; null if it is something else."""
    return F.try_variant_get(v, "$", kind)


def _is(v: Column, kind: str) -> Column:
    if kind in ("array", "object"):
        return _as(v, "array<variant>" if kind == "array" else "map<string,variant>").isNotNull()
    told = F.schema_of_variant(v)
    if kind in ("integer", "number"):
        number = told.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(told, F.lit("DECIMAL"))
        return number & (_as(v, "double") % 1 == 0) if kind == "integer" else number
    return told == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[kind]


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _check(schema: dict[str, Any], whole: dict[str, Any], v: Column, at: Column) -> Column:
    """FOUND of a value that is there."""
    if unknown := set(schema) - KEYWORDS - REMARKS:
        raise ValueError(f"unknown keywords: {sorted(unknown)}")
    if "$ref" in schema:
        return _check(reduce(lambda s, k: s[k], schema["$ref"].removeprefix("#/").split("/"), whole), whole, v, at)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    parts: list[Column] = []
    fits = lambda part: F.size(_check(part, whole, v, at)) == 0
    if "anyOf" in schema:
        if not kinds and all(set(x) == {"type"} and isinstance(x["type"], str) for x in schema["anyOf"]):
            kinds = [x["type"] for x in schema["anyOf"]]
        else:
            parts.append(_if(~reduce(lambda a, b: a | b, map(fits, schema["anyOf"])), _one(at, f"none of {len(schema['anyOf'])} forms")))
    if "enum" in schema:
        words = [x for x in schema["enum"] if isinstance(x, str)]
        if len(words) < len(schema["enum"]):
            raise ValueError("an enum holds texts only")
        parts.append(_if(~(_is(v, "string") & _as(v, "string").isin(*words)), _one(at, "not one of " + ", ".join(words))))
    if {"minLength", "maxLength", "pattern"} & set(schema):
        own = _as(v, "string")
        wrong = [(F.length(own) < schema.get("minLength", 0), "empty" if schema.get("minLength") == 1 else f"shorter than {schema.get('minLength')}"), (F.length(own) > schema.get("maxLength", 1 << 31), f"longer than {schema.get('maxLength')}")]
        wrong += [(~own.rlike(schema["pattern"]), f"not like {schema['pattern']}")] if "pattern" in schema else []
        parts += [_if(_is(v, "string") & w, _one(at, what)) for w, what in wrong]
    if {"minimum", "maximum"} & set(schema):
        low, high = schema.get("minimum"), schema.get("maximum")
        own = _as(v, "double")
        outside = (own < low if low is not None else F.lit(False)) | (own > high if high is not None else F.lit(False))
        parts.append(_if(_is(v, "number") & outside, _one(at, f"not within {low} to {high}" if None not in (low, high) else f"below {low}" if high is None else f"above {high}")))
    if {"items", "uniqueItems", "minItems", "maxItems"} & set(schema):
        parts.append(_let(_as(v, "array<variant>"), lambda own: F.when(own.isNull(), _none()).otherwise(_items(schema, whole, own, at))))
    if {"properties", "required", "additionalProperties"} & set(schema):
        parts.append(_let(_as(v, "map<string,variant>"), lambda own: F.when(own.isNull(), _none()).otherwise(_properties(schema, whole, own, v, at))))
    if "not" in schema:
        parts.append(_if(fits(schema["not"]), _one(at, "of a form that is ruled out")))
    right = reduce(lambda a, b: a | b, (_is(v, k) for k in kinds)) if kinds else F.lit(True)
    said = [k for k in kinds if k != "null"] or kinds
    return F.when(F.coalesce(right, F.lit(False)), _joined(parts)).otherwise(_one(at, "not " + " or ".join(SAYS[k] for k in said)))


def _items(schema: dict[str, Any], whole: dict[str, Any], own: Column, at: Column) -> Column:
    low, high = schema.get("minItems", 0), schema.get("maxItems", (1 << 31) - 1)
    parts = [_if((F.size(own) < low) | (F.size(own) > high), _one(at, f"not {low} items" if low == high else f"fewer than {low} items" if "maxItems" not in schema else f"not {low} to {high} items"))]
    if schema.get("uniqueItems"):
        parts.append(_if(F.size(F.array_distinct(F.transform(own, lambda x: F.to_json(x)))) < F.size(own), _one(at, "repeated items")))
    if "items" in schema:
        parts.append(F.flatten(F.transform(own, lambda x, k: _check(schema["items"], whole, x, F.concat(at, F.array(_item(k)))))))
    return _joined(parts)


def _properties(schema: dict[str, Any], whole: dict[str, Any], own: Column, v: Column, at: Column) -> Column:
    known, required = schema.get("properties", {}), schema.get("required", [])
    more = schema.get("additionalProperties", True)
    if not isinstance(more, bool):
        raise ValueError("additionalProperties is true or false")
    listed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    said = lambda word, names: F.transform(names, lambda n: F.struct(at.alias("at"), F.concat(F.lit(f"{word} "), n).alias("what"))).cast(FOUND)
    parts = [_let(F.map_keys(own), lambda keys: said("lacks", F.filter(listed(required), lambda n: ~F.array_contains(keys, n))))]
    if not more:
        parts.append(said("has", F.array_sort(F.array_except(F.map_keys(own), listed(list(known))))))
    def property_of(name: str, part: dict[str, Any]) -> Column:
        there = F.variant_get(v, f"$['{name}']", "variant")
        return _let(there, lambda x: F.when(x.isNull(), _none()).otherwise(_check(part, whole, x, F.concat(at, F.array(_name(name))))))

    return _joined(parts + [property_of(name, part) for name, part in known.items()])


def errors(schema: dict[str, Any]) -> Callable[[Column], Column]:
    """A function of a VARIANT column: array<string> of what is wrong, by path; null for a null value (a text that is no JSON)."""
    def check(v: Column) -> Column:
        return _let(v, found_in)  # v may be a text's parsing: the checks name it for each property, and share one value

    def found_in(v: Column) -> Column:
        found = _check(schema, schema, v, F.array().cast(f"array<{PART}>"))
        placed = F.transform(found, lambda e, k: F.struct(e["at"].alias("at"), k.alias("k"), e["what"].alias("what")))
        path = lambda at: F.when(F.size(at) == 0, "<root>").otherwise(F.array_join(F.transform(at, lambda p: F.when(p["is_name"], p["name"]).otherwise(p["k"].cast("string"))), "."))
        return F.when(v.isNotNull(), F.transform(F.array_sort(placed), lambda e: F.concat(path(e["at"]), F.lit(": "), e["what"])))

    return check


def first_error(schema: dict[str, Any]) -> Callable[[Column], Column]:
    """The first of errors(), null if there is none."""
    every = errors(schema)
    return lambda v: F.get(every(v), F.lit(0))
