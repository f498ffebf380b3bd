"""The compiled expressions against a plain validator that walks the schema, keyword by keyword."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.json_schema import schema_violation


def is_type(v, name):
    return {
        "object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None,
        "number": isinstance(v, int | float) and not isinstance(v, bool), "integer": isinstance(v, int | float) and not isinstance(v, bool) and v == int(v),
    }[name]


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b and (is_type(a, "number") == is_type(b, "number"))


def holds(v, s, root):
    if isinstance(s, bool):
        return s
    number, ok = is_type(v, "number"), lambda x, t: holds(x, t, root)
    named, patterns = s.get("properties", {}), s.get("patternProperties", {})
    rules = {
        "$ref": lambda r: ok(v, root["$defs"][r.split("/")[-1]]),
        "type": lambda t: any(is_type(v, n) for n in ([t] if isinstance(t, str) else t)),
        "const": lambda c: same(v, c),
        "enum": lambda e: any(same(v, c) for c in e),
        "minimum": lambda m: not number or v >= m,
        "maximum": lambda m: not number or v <= m,
        "exclusiveMinimum": lambda m: not number or v > m,
        "exclusiveMaximum": lambda m: not number or v < m,
        "multipleOf": lambda m: not number or v / m == round(v / m),
        "minLength": lambda n: not isinstance(v, str) or len(v) >= n,
        "maxLength": lambda n: not isinstance(v, str) or len(v) <= n,
        "pattern": lambda p: not isinstance(v, str) or re.search(p, v) is not None,
        "required": lambda names: not isinstance(v, dict) or all(n in v for n in names),
        "minProperties": lambda n: not isinstance(v, dict) or len(v) >= n,
        "maxProperties": lambda n: not isinstance(v, dict) or len(v) <= n,
        "properties": lambda ps: not isinstance(v, dict) or all(ok(v[k], p) for k, p in ps.items() if k in v),
        "patternProperties": lambda ps: not isinstance(v, dict) or all(ok(x, p) for r, p in ps.items() for k, x in v.items() if re.search(r, k)),
        "additionalProperties": lambda a: not isinstance(v, dict) or all(ok(x, a) for k, x in v.items() if k not in named and not any(re.search(r, k) for r in patterns)),
        "propertyNames": lambda a: not isinstance(v, dict) or all(ok(k, a) for k in v),
        "minItems": lambda n: not isinstance(v, list) or len(v) >= n,
        "maxItems": lambda n: not isinstance(v, list) or len(v) <= n,
        "uniqueItems": lambda u: not u or not isinstance(v, list) or not any(same(a, b) for i, a in enumerate(v) for b in v[:i]),
        "prefixItems": lambda ts: not isinstance(v, list) or all(map(ok, v, ts)),
        "items": lambda t: not isinstance(v, list) or all(ok(x, t) for x in v[len(s.get("prefixItems", ())) :]),
        "contains": lambda t: not isinstance(v, list) or any(ok(x, t) for x in v),
        "allOf": lambda ts: all(ok(v, t) for t in ts),
        "anyOf": lambda ts: any(ok(v, t) for t in ts),
        "oneOf": lambda ts: sum(ok(v, t) for t in ts) == 1,
        "not": lambda t: not ok(v, t),
        "if": lambda t: ok(v, s.get("then" if ok(v, t) else "else", True)),
    }
    return all(rule(s[k]) for k, rule in rules.items() if k in s)


SCHEMAS = [
    {"type": "integer"}, {"type": ["null", "string"]}, {"const": 1}, {"const": {"a": [1, None], "b": True}}, {"enum": ["a", 2, None, [1]]}, {"minimum": 0, "exclusiveMaximum": 2}, {"maximum": 1, "exclusiveMinimum": -1},
    {"multipleOf": 0.5}, {"minLength": 1, "maxLength": 2}, {"pattern": "^a|b$"}, {"required": ["a", "b"]}, {"minProperties": 1, "maxProperties": 1}, {"properties": {"a": {"type": "number"}, "b": False}},
    {"patternProperties": {"^a": {"type": "string"}}, "properties": {"b": True}, "additionalProperties": {"type": "null"}}, {"additionalProperties": False, "properties": {"a": {}}}, {"propertyNames": {"maxLength": 1}},
    {"minItems": 1, "maxItems": 2}, {"uniqueItems": True}, {"prefixItems": [{"type": "string"}, {"const": 1}], "items": {"type": "boolean"}}, {"items": {"items": {"type": "string"}}}, {"contains": {"const": "a"}},
    {"allOf": [{"minimum": 0}, {"maximum": 1}]}, {"anyOf": [{"type": "string"}, {"minimum": 1}]}, {"oneOf": [{"minimum": 0}, {"maximum": 1}, {"type": "string"}]}, {"not": {"type": "object"}},
    {"if": {"properties": {"a": {"const": "x"}}, "required": ["a"]}, "then": {"required": ["b"]}, "else": {"type": ["object", "null"]}}, {"$ref": "#/$defs/t", "$defs": {"t": {"type": "array", "items": {"$ref": "#/$defs/u"}}, "u": {"type": "boolean"}}}, True, False,
]

LEAF = [None, True, False, 0, 1, 2, -1, 1.0, 0.5, 1.5, "", "a", "b", "ab", "x", "äöü", "xyz"]


def some_value(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.5:
        return rng.choice(LEAF)
    if kind < 0.75:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "ab", "c d"]): some_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_every_keyword_against_a_plain_validator(spark):
    rng = random.Random(3)
    values = [*LEAF, [], {}, *[some_value(rng) for _ in range(400)], {"a": [1, None], "b": True}, {"b": True, "a": [1.0, None]}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").withColumn("v", F.parse_json("t"))
    wrong = []
    for at in range(0, len(SCHEMAS), 10):
        some = SCHEMAS[at : at + 10]
        checked = rows.select("i", *[schema_violation(F.col("v"), s).isNull().alias(f"s{k}") for k, s in enumerate(some)])
        wrong += [(values[r.i], s) for r in checked.collect() for k, s in enumerate(some) if r[f"s{k}"] != holds(values[r.i], s, s)]
    assert not wrong


def test_paths_and_rules(spark):
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"required": ["x"], "properties": {"x": {"minimum": 1}}}}, "it's": {"const": 1}}, "additionalProperties": False}
    cases = {
        '{"a":[{"x":1},{"x":0}]}': ("$.a[1].x", "minimum"), '{"a":[{}]}': ("$.a[0].x", "required"), '{"a":3}': ("$.a", "type"), '{"z":1,"y":1}': ("$.y", "additionalProperties"), "[]": ("$", "type"), "null": ("$", "type"),
        '{"it\'s":2}': ("$.it's", "const"), '{"a":null}': ("$.a", "type"), "{}": None, '{"a":[]}': None,
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None, "{broken"]], "t string").select("t", schema_violation(F.try_parse_json("t"), json.dumps(schema)).alias("v")).collect()
    assert {r.t: r.v and tuple(r.v) for r in rows} == {**cases, None: ("$", "json"), "{broken": ("$", "json")}


@pytest.mark.parametrize("schema", [{"unheard": 1}, {"$ref": "#"}, {"properties": {"a": {"$ref": "#/properties/a"}}}])
def test_schemas_that_are_refused(spark, schema):
    with pytest.raises(ValueError):
        schema_violation(F.lit(None).cast("variant"), schema)


def test_documents_of_a_pair_are_checked_in_the_tasks_of_a_shuffle(spark):
    """No side of the join is sent, so the other one's few files do not limit how many tasks check."""
    from tessera.plans import catalog

    df = catalog.QUERIES["p3_schema_validation"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
