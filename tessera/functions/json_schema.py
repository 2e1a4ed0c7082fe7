"""JSON schemas compiled to one column of problems: no parser of rows in Python, one expression over a variant.

Understood are types, const, enum, bounds of numbers, lengths, patterns, formats, required, properties,
additionalProperties, propertyNames, items, sizes of arrays and objects, uniqueItems, allOf, anyOf, oneOf, not, if with
then and else, and references to ``$defs``. A schema with another keyword, another format or a reference to itself is
refused when it is compiled, so nothing is checked less than it says. Survey: JSN4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.binding import bind

#: Keywords that say nothing about a value.
ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "title", "description", "default", "examples", "deprecated"}
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$",
    "email": r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
}
_NONE = "array<string>"


class Node:
    """A value that is there, with its kind and the readings of it that rules need."""

    def __init__(self, bound: Column, path: Column):
        self.value, self.path = bound["value"], path
        self.kind = bound["kind"]
        self.number = F.when(self.kind == "number", F.try_variant_get(self.value, "$", "double"))
        self.text = F.when(self.kind == "string", F.try_variant_get(self.value, "$", "string"))
        self.items = F.try_variant_get(self.value, "$", "array<variant>")
        self.members = F.try_variant_get(self.value, "$", "map<string,variant>")

    def member(self, name: str) -> Column:
        """The variant under a name, null where there is none."""
        quote = '"' if "'" in name else "'"
        if quote in name:
            raise ValueError(f"a property with both quotes in its name: {name}")
        return F.try_variant_get(self.value, f"$[{quote}{name}{quote}]", "variant")

    def under(self, name: Column) -> Column:
        return F.concat(self.path, F.lit("."), name)


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    out = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null")
    return out.when(shape == "BOOLEAN", "boolean").when(shape == "STRING", "string").otherwise("number")


def _none() -> Column:
    return F.array().cast(_NONE)


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


class _Compiler:
    def __init__(self, schema: dict):
        self.defs = schema.get("$defs", {})

    def check(self, schema: dict | bool, value: Column, path: Column, inside: tuple[str, ...] = ()) -> Column:
        """Problems of a value that is there."""
        if isinstance(schema, bool):
            return _none() if schema else F.array(F.concat(path, F.lit(": false")))
        bound = F.struct(value.alias("value"), _kind(value).alias("kind"))
        return bind(bound, lambda b: _joined(list(self.rules(schema, Node(b, path), inside))))

    def rules(self, schema: dict, node: Node, inside: tuple[str, ...]):
        unknown = set(schema) - ANNOTATIONS - {m.removeprefix("on_") for m in dir(self) if m.startswith("on_")} - set(_TESTS) - {"$ref", "then", "else", "not", "if"}
        if unknown:
            raise ValueError(f"unknown keywords {sorted(unknown)}")
        for word, said in schema.items():
            if word in _TESTS:
                yield self.one(word, _TESTS[word](node, said), node)
            elif word == "$ref":
                name = said.removeprefix("#/$defs/")
                if name in inside or name not in self.defs:
                    raise ValueError(f"{said} refers to itself or to nothing")
                yield self.check(self.defs[name], node.value, node.path, (*inside, name))
            elif word == "not":
                yield self.one("not", F.size(self.check(said, node.value, node.path, inside)) == 0, node)
            elif word == "if":
                met = F.size(self.check(said, node.value, node.path, inside)) == 0
                branch = lambda b: self.check(schema.get(b, True), node.value, node.path, inside)
                yield F.when(met, branch("then")).otherwise(branch("else"))
            elif word not in ANNOTATIONS and word not in ("then", "else"):
                yield from getattr(self, f"on_{word}")(said, node, inside, schema)

    def one(self, word: str, bad: Column, node: Node) -> Column:
        """One problem of the node itself."""
        return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(node.path, F.lit(f": {word}")))).otherwise(_none())

    def on_required(self, names, node, inside, schema):
        for name in names:
            lacks = (node.kind == "object") & node.member(name).isNull()
            yield F.when(lacks, F.array(F.concat(node.under(F.lit(name)), F.lit(": required")))).otherwise(_none())

    def on_properties(self, members, node, inside, schema):
        for name, sub in members.items():
            child = node.member(name)
            there = (node.kind == "object") & child.isNotNull()
            yield F.when(there, self.check(sub, child, node.under(F.lit(name)), inside)).otherwise(_none())

    def on_additionalProperties(self, sub, node, inside, schema):
        if sub is True:
            return
        own = list(schema.get("properties", {}))
        keys = F.coalesce(F.map_keys(node.members), _none())
        other = F.filter(keys, lambda k: ~k.isin(own)) if own else keys
        if sub is False:
            yield F.transform(other, lambda k: F.concat(node.under(k), F.lit(": additionalProperties")))
        else:
            yield F.flatten(F.transform(other, lambda k: self.check(sub, F.element_at(node.members, k), node.under(k), inside)))

    def on_propertyNames(self, sub, node, inside, schema):
        keys = F.coalesce(F.map_keys(node.members), _none())
        bad = F.filter(keys, lambda k: F.size(self.check(sub, k.cast("variant"), F.lit("$"), inside)) > 0)
        yield F.transform(bad, lambda k: F.concat(node.under(k), F.lit(": propertyNames")))

    def on_items(self, sub, node, inside, schema):
        each = F.transform(node.items, lambda x, i: self.check(sub, x, F.concat(node.path, F.lit("["), i.cast("string"), F.lit("]")), inside))
        yield F.coalesce(F.flatten(each), _none())

    def on_allOf(self, subs, node, inside, schema):
        for sub in subs:
            yield self.check(sub, node.value, node.path, inside)

    def _fits(self, subs, node, inside) -> Column:
        return sum(((F.size(self.check(sub, node.value, node.path, inside)) == 0).cast("int") for sub in subs), F.lit(0))

    def on_anyOf(self, subs, node, inside, schema):
        yield self.one("anyOf", self._fits(subs, node, inside) == 0, node)

    def on_oneOf(self, subs, node, inside, schema):
        yield self.one("oneOf", self._fits(subs, node, inside) != 1, node)


def _is_type(node: Node, kind: str) -> Column:
    if kind == "integer":
        return (node.kind == "number") & (node.number == F.floor(node.number))
    return node.kind == kind


def _types(node: Node, said: str | list[str]) -> Column:
    out = F.lit(False)
    for kind in [said] if isinstance(said, str) else said:
        out |= F.coalesce(_is_type(node, kind), F.lit(False))
    return ~out


def _equals(node: Node, value) -> Column:
    if value is None:
        return node.kind == "null"
    if isinstance(value, bool):
        return (node.kind == "boolean") & (F.try_variant_get(node.value, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return F.coalesce(node.number == float(value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce(node.text == value, F.lit(False))
    raise ValueError("constants are strings, numbers, booleans or null")


def _among(node: Node, values: list) -> Column:
    texts = [v for v in values if isinstance(v, str)]
    out = F.coalesce(node.text.isin(texts), F.lit(False)) if texts else F.lit(False)
    for v in values:
        if not isinstance(v, str):
            out |= _equals(node, v)
    return ~out


def _format(node: Node, name: str) -> Column:
    bad = ~node.text.rlike(FORMATS[name])
    no_day = (node.kind == "string") & F.try_to_timestamp(F.substring(node.text, 1, 10)).isNull()
    return bad | no_day if name.startswith("date") else bad


#: When a value breaks a rule that looks at nothing but itself; null where the rule is not for its kind.
_TESTS: dict[str, Callable[[Node, object], Column]] = {
    "type": _types,
    "const": lambda n, v: ~_equals(n, v),
    "enum": _among,
    "minimum": lambda n, v: n.number < v,
    "maximum": lambda n, v: n.number > v,
    "exclusiveMinimum": lambda n, v: n.number <= v,
    "exclusiveMaximum": lambda n, v: n.number >= v,
    "multipleOf": lambda n, v: n.number / v != F.floor(n.number / v),
    "minLength": lambda n, v: F.length(n.text) < v,
    "maxLength": lambda n, v: F.length(n.text) > v,
    "pattern": lambda n, v: ~n.text.rlike(v),
    "format": _format,
    "minItems": lambda n, v: (n.kind == "array") & (F.size(n.items) < v),
    "maxItems": lambda n, v: (n.kind == "array") & (F.size(n.items) > v),
    "uniqueItems": lambda n, v: (n.kind == "array") & (F.size(F.array_distinct(F.transform(n.items, lambda x: F.to_json(x)))) < F.size(n.items)) if v else F.lit(False),
    "minProperties": lambda n, v: (n.kind == "object") & (F.size(n.members) < v),
    "maxProperties": lambda n, v: (n.kind == "object") & (F.size(n.members) > v),
}


def problems(document: Column, schema: dict) -> Column:
    """What is wrong with a JSON document, ``path: keyword`` sorted; empty if nothing is. No text: missing; no JSON: json."""
    whole = bind(F.try_parse_json(document), lambda v: F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(_Compiler(schema).check(schema, v, F.lit("$"))))
    return F.when(document.isNull(), F.array(F.lit("$: missing"))).otherwise(F.array_sort(F.array_distinct(whole)))


def valid(document: Column, schema: dict) -> Column:
    return F.size(problems(document, schema)) == 0
