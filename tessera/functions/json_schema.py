"""JSON Schema as Column expressions: a schema becomes one expression over a VARIANT.

The expression gives the first violation (path and keyword) or null, so documents of no fixed type
are checked in the scan's own stage, without Python workers. Keywords are tried in the order of
`KEYWORDS`, properties in that of the schema, elements by place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATION = "struct<path:string,rule:string>"
NOTES = set("$schema $id $comment $defs definitions title description default examples deprecated readOnly writeOnly format".split())
#: In the order in which they are tried; `then`, `else` belong to `if`.
KEYWORDS = (
    "$ref type const enum minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern required minProperties maxProperties properties "
    "patternProperties additionalProperties propertyNames minItems maxItems uniqueItems prefixItems items contains allOf anyOf oneOf not if"
).split()
NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": NUMBERS}


def _let(value: Column, body: Callable[[Column], Column], kind: str = VIOLATION) -> Column:
    """`body(value)`, of type `kind`, with the value computed once for a row.

    A fold knows its type beforehand; an element taken out of a transformed array has its type derived from the whole body for each row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


def _fail(path: Column, rule: str) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"))


def _first(checks: list[Column]) -> Column:
    return F.coalesce(*checks) if checks else F.lit(None).cast(VIOLATION)


class _Node:
    """A value, what kind it is, and where it stands."""

    def __init__(self, value: Column, kind: Column, path: Column, members: dict[str, Column] | None = None):
        self.value, self.kind, self.path = value, kind, path
        self.members = members or {}  # structs (v, k) of members that the schema asks for, taken out once

    def of(self, *kinds: str) -> Column:
        return self.kind.isin(*kinds)

    def number(self, type_: str = "double") -> Column:
        return F.try_variant_get(self.value, "$", type_)

    def string(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    def array(self) -> Column:
        return F.try_variant_get(self.value, "$", "array<variant>")

    def map(self) -> Column:
        return self.value.try_cast("map<string,variant>")

    def member(self, name: str) -> Column:
        if re.search(r"['\"\\\[\]]", name) or not name:
            return F.try_element_at(self.map(), F.lit(name))
        return F.try_variant_get(self.value, f"$['{name}']", "variant")


def _kind(value: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def _below(value: Column, path: Column, body: Callable[[_Node], Column], names: list[str] = (), kind: str = VIOLATION) -> Column:
    """`body` of the node of `value`, which is computed once for a row, however often the node is asked."""
    pair = lambda v: F.struct(v.alias("v"), _kind(v).alias("k"))

    def within(v: Column) -> Column:
        whole = _Node(v, None, path)
        taken = [_let(whole.member(name), pair, "struct<v:variant,k:string>").alias(f"m{i}") for i, name in enumerate(names)]
        return _let(F.struct(v.alias("v"), _kind(v).alias("k"), *taken), lambda s: body(_Node(s["v"], s["k"], path, {name: s[f"m{i}"] for i, name in enumerate(names)})), kind)

    return _let(value, within, kind)


def _equals(node: _Node, want: object) -> Column:
    """Equality of JSON: 1 and 1.0 are equal, true and 1 are not, the order of keys does not matter."""
    if want is None:
        return node.of("VOID")
    if isinstance(want, bool):
        return node.of("BOOLEAN") & F.coalesce(F.try_variant_get(node.value, "$", "boolean") == want, F.lit(False))
    if isinstance(want, int | float):
        whole = F.lit(want).cast("decimal(38,10)") if isinstance(want, int) and abs(want) < 10**28 else F.lit(None).cast("decimal(38,10)")
        return node.of(*NUMBERS) & F.coalesce(node.number("decimal(38,10)") == whole, node.number() == float(want), F.lit(False))
    if isinstance(want, str):
        return node.of("STRING") & F.coalesce(node.string() == want, F.lit(False))
    if isinstance(want, list):
        same = node.of("ARRAY") & F.coalesce(F.size(node.array()) == len(want), F.lit(False))
        parts = [_below(F.get(node.array(), i), node.path, lambda n, w=w: _equals(n, w), kind="boolean") for i, w in enumerate(want)]
    else:
        keys = F.array_sort(F.map_keys(node.map()))
        same = node.of("OBJECT") & F.coalesce(keys == F.array(*[F.lit(k) for k in sorted(want)]).cast("array<string>"), F.lit(False))
        parts = [_below(node.member(k), node.path, lambda n, w=w: _equals(n, w), kind="boolean") for k, w in want.items()]
    for part in parts:
        same = same & F.coalesce(part, F.lit(False))
    return same


class _Compiler:
    def __init__(self, root: dict | bool):
        self.root, self.open = root, []

    def check(self, node: _Node, schema: dict | bool) -> Column:
        if schema is True:
            return _first([])
        if schema is False:
            return _fail(node.path, "false")
        unknown = set(schema) - NOTES - set(KEYWORDS) - {"then", "else"}
        if unknown:
            raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
        return _first([c for k in KEYWORDS if k in schema for c in getattr(self, "_" + k.lstrip("$"))(node, schema[k], schema)])

    def within(self, value: Column, path: Column, schema: dict | bool) -> Column:
        """The violation of a value that may be missing."""
        return _let(value, lambda v: F.when(v.isNotNull(), self.below(v, path, schema)))

    def below(self, value: Column, path: Column, schema: dict | bool) -> Column:
        return _below(value, path, lambda n: self.check(n, schema), self.names(schema, []))

    def names(self, schema: dict | bool, seen: list) -> list[str]:
        """The members that a schema asks for by name, in all its parts that look at the same value."""
        if isinstance(schema, bool) or any(schema is x for x in seen):
            return []
        seen.append(schema)
        parts = [*(schema.get(k, ()) for k in ("allOf", "anyOf", "oneOf"))]
        parts = [p for some in parts for p in some] + [schema[k] for k in ("not", "if", "then", "else") if k in schema]
        if "$ref" in schema:
            parts.append(self.target(schema["$ref"]))
        own = [*schema.get("properties", ()), *schema.get("required", ())]
        return list(dict.fromkeys([*own, *(n for p in parts for n in self.names(p, seen))]))

    def target(self, name: str) -> dict | bool:
        out = self.root
        for step in name.removeprefix("#").strip("/").split("/") if name != "#" else []:
            out = out[step.replace("~1", "/").replace("~0", "~")]
        return out

    def member(self, node: _Node, name: str, path: Column, schema: dict | bool) -> Column:
        """The violation of a member that may be missing."""
        if name not in node.members or (not isinstance(schema, bool) and self.names(schema, [])):
            return self.within(node.members[name]["v"] if name in node.members else node.member(name), path, schema)
        taken = node.members[name]
        return F.when(taken["v"].isNotNull(), self.check(_Node(taken["v"], taken["k"], path), schema))

    def _when(self, node: _Node, kinds: tuple[str, ...], broken: Column, rule: str) -> list[Column]:
        return [F.when(node.of(*kinds) & broken, _fail(node.path, rule))]

    def _ref(self, node, name, _):
        if name in self.open:
            raise ValueError(f"a schema that contains itself: {name}")
        self.open.append(name)
        try:
            return [self.check(node, self.target(name))]
        finally:
            self.open.pop()

    def _type(self, node, names, _):
        held = F.lit(False)
        for name in [names] if isinstance(names, str) else names:
            if name == "integer":
                held = held | node.of("BIGINT", "INT", "SMALLINT", "TINYINT") | (node.of("DECIMAL", "DOUBLE", "FLOAT") & (node.number() == F.rint(node.number())))
            else:
                held = held | node.of(*KINDS[name])
        return [F.when(~held, _fail(node.path, "type"))]

    def _const(self, node, want, _):
        return [F.when(~_equals(node, want), _fail(node.path, "const"))]

    def _enum(self, node, wanted, _):
        held = F.lit(False)
        strings = [w for w in wanted if isinstance(w, str)]
        if strings:
            held = node.of("STRING") & F.coalesce(node.string().isin(*strings), F.lit(False))
        for want in wanted:
            held = held if isinstance(want, str) else held | _equals(node, want)
        return [F.when(~held, _fail(node.path, "enum"))]

    def _minimum(self, node, least, _):
        return self._when(node, NUMBERS, node.number() < least, "minimum")

    def _maximum(self, node, most, _):
        return self._when(node, NUMBERS, node.number() > most, "maximum")

    def _exclusiveMinimum(self, node, least, _):
        return self._when(node, NUMBERS, node.number() <= least, "exclusiveMinimum")

    def _exclusiveMaximum(self, node, most, _):
        return self._when(node, NUMBERS, node.number() >= most, "exclusiveMaximum")

    def _multipleOf(self, node, step, _):
        ratio = node.number() / F.lit(float(step))
        return self._when(node, NUMBERS, ratio != F.rint(ratio), "multipleOf")

    def _minLength(self, node, least, _):
        return self._when(node, ("STRING",), F.length(node.string()) < least, "minLength")

    def _maxLength(self, node, most, _):
        return self._when(node, ("STRING",), F.length(node.string()) > most, "maxLength")

    def _pattern(self, node, pattern, _):
        return self._when(node, ("STRING",), ~node.string().rlike(pattern), "pattern")

    def _required(self, node, names, _):
        return [F.when(node.of("OBJECT") & (node.members[name]["v"] if name in node.members else node.member(name)).isNull(), _fail(F.concat(node.path, F.lit(f".{name}")), "required")) for name in names]

    def _minProperties(self, node, least, _):
        return self._when(node, ("OBJECT",), F.size(node.map()) < least, "minProperties")

    def _maxProperties(self, node, most, _):
        return self._when(node, ("OBJECT",), F.size(node.map()) > most, "maxProperties")

    def _properties(self, node, properties, _):
        return [F.when(node.of("OBJECT"), self.member(node, name, F.concat(node.path, F.lit(f".{name}")), schema)) for name, schema in properties.items()]

    def _entries(self, node, entries: Column, schema) -> Column:
        """The first violation among entries of a map, by key."""
        one = lambda found, k: F.coalesce(found, self.within(F.try_element_at(entries, k), F.concat(node.path, F.lit("."), k), schema))
        return F.when(node.of("OBJECT"), F.aggregate(F.array_sort(F.map_keys(entries)), F.lit(None).cast(VIOLATION), one))

    def _patternProperties(self, node, patterns, _):
        like = lambda pattern: F.map_filter(node.map(), lambda k, _: k.rlike(pattern))
        return [self._entries(node, like(pattern), schema) for pattern, schema in patterns.items()]

    def _additionalProperties(self, node, schema, around):
        named, patterns = list(around.get("properties", ())), list(around.get("patternProperties", ()))

        def other(key, _):
            held = ~key.isin(*named) if named else F.lit(True)
            for pattern in patterns:
                held = held & ~key.rlike(pattern)
            return held

        rest = F.map_filter(node.map(), other)
        if schema is False:
            first = F.array_min(F.map_keys(rest))
            return [F.when(node.of("OBJECT") & first.isNotNull(), _fail(F.concat(node.path, F.lit("."), first), "additionalProperties"))]
        return [self._entries(node, rest, schema)]

    def _propertyNames(self, node, schema, _):
        names = F.map_from_entries(F.transform(F.map_keys(node.map()), lambda k: F.struct(k, F.parse_json(F.to_json(F.struct(k.alias("k")))).alias("v"))))
        return [self._entries(node, F.transform_values(names, lambda k, v: F.try_variant_get(v, "$.k", "variant")), schema)]

    def _minItems(self, node, least, _):
        return self._when(node, ("ARRAY",), F.size(node.array()) < least, "minItems")

    def _maxItems(self, node, most, _):
        return self._when(node, ("ARRAY",), F.size(node.array()) > most, "maxItems")

    def _uniqueItems(self, node, wanted, _):
        if not wanted:
            return []
        shown = F.transform(node.array(), lambda x: F.struct(F.schema_of_variant(x) == "STRING", F.to_json(x)))
        return self._when(node, ("ARRAY",), F.size(F.array_distinct(shown)) < F.size(shown), "uniqueItems")

    def _place(self, node, i: Column) -> Column:
        return F.concat(node.path, F.lit("["), i.cast("string"), F.lit("]"))

    def _prefixItems(self, node, schemas, _):
        return [F.when(node.of("ARRAY"), self.within(F.get(node.array(), i), self._place(node, F.lit(i)), s)) for i, s in enumerate(schemas)]

    def _items(self, node, schema, around):
        past = len(around.get("prefixItems", ()))
        start = F.struct(F.lit(0).alias("i"), F.lit(None).cast(VIOLATION).alias("found"))

        def one(s, x):
            violation = F.when(s["i"] >= past, self.within(x, self._place(node, s["i"]), schema))
            return F.struct((s["i"] + 1).alias("i"), F.coalesce(s["found"], violation).alias("found"))

        return [F.when(node.of("ARRAY"), F.aggregate(node.array(), start, one, lambda s: s["found"]))]

    def _contains(self, node, schema, _):
        return self._when(node, ("ARRAY",), ~F.exists(node.array(), lambda x: self.within(x, node.path, schema).isNull()), "contains")

    def _allOf(self, node, schemas, _):
        return [self.check(node, s) for s in schemas]

    def _anyOf(self, node, schemas, _):
        held = F.lit(False)
        for s in schemas:
            held = held | self.check(node, s).isNull()
        return [F.when(~held, _fail(node.path, "anyOf"))]

    def _oneOf(self, node, schemas, _):
        held = sum((self.check(node, s).isNull().cast("int") for s in schemas), F.lit(0))
        return [F.when(held != 1, _fail(node.path, "oneOf"))]

    def _not(self, node, schema, _):
        return [F.when(self.check(node, schema).isNull(), _fail(node.path, "not"))]

    def _if(self, node, schema, around):
        held = self.check(node, schema).isNull()
        return [F.when(held, self.check(node, around.get("then", True))).otherwise(self.check(node, around.get("else", True)))]


def schema_violation(value: Column, schema: dict | bool | str) -> Column:
    """The first violation of a JSON Schema by a VARIANT as (path, rule), or null.

    `schema`: a mapping, or its text. A null value is no JSON: ($, json). Numbers are equal by value
    (1 and 1.0), strings match patterns anywhere, lengths are code points, keywords for other types do
    not apply. `uniqueItems` compares nested numbers as they are written. `format` and notes are ignored; an
    unknown keyword or a schema that contains itself is refused when compiled.
    """
    schema = json.loads(schema) if isinstance(schema, str) else schema
    compiler, path = _Compiler(schema), F.lit("$")
    return _let(value, lambda v: F.when(v.isNull(), _fail(path, "json")).otherwise(compiler.below(v, path, schema)))
