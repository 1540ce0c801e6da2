"""JSON Schema (draft 7) documents as column expressions over variant values.

A schema becomes one expression that lists what a record violates, as ``path: keyword``
entries, so a scan of records checks them where it reads them: no shuffle, no Python.
Each value that has rules is bound once, with its kind, as the variable of a function
over arrays; so a record is parsed once however many rules look at it.
Keywords judge only values of their own type, as the standard has it; ``format`` and
other annotations judge nothing. A keyword that is not known raises an error, so that no
rule is passed over silently; so does a schema that refers to itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNOTATIONS = frozenset({"$schema", "$id", "$comment", "version", "title", "description", "default", "examples", "format", "definitions", "readOnly", "writeOnly"})


def _none() -> Column:
    return F.array().cast("array<string>")


class _Value:
    """A bound variant with its kind, and what rules ask of it."""

    def __init__(self, bound: Column):
        self.variant, self.kind = bound["variant"], bound["kind"]

    def taken(self, kind: str) -> Column:
        return F.try_variant_get(self.variant, "$", kind)

    def is_a(self, name: str) -> Column:
        if name in ("object", "array"):
            return self.kind.startswith(f"{name.upper()}<")
        if name in ("string", "boolean", "null"):
            return self.kind == {"null": "VOID"}.get(name, name.upper())
        if name in ("number", "integer"):
            numeric = self.kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            return numeric if name == "number" else numeric & (self.taken("double") == F.rint(self.taken("double")))
        raise ValueError(f"type not known: {name}")

    def equals(self, value: object) -> Column:
        """Whether the value is this scalar; a number equals another of the same size, whatever their types."""
        if value is None:
            return self.is_a("null")
        if isinstance(value, bool):
            return self.is_a("boolean") & (self.taken("boolean") == value)
        if isinstance(value, (int, float)):
            return self.is_a("number") & (self.taken("double") == float(value))
        if isinstance(value, str):
            return self.is_a("string") & (self.taken("string") == value)
        raise ValueError(f"only scalars can be listed, not {value!r}")

    def one_of(self, values: list) -> Column:
        texts = [x for x in values if isinstance(x, str)]
        listed = self.is_a("string") & self.taken("string").isin(*texts) if texts else F.lit(False)
        return reduce(Column.__or__, (self.equals(x) for x in values if not isinstance(x, str)), listed)


def _bound(values: Column, rules: Callable[[_Value], Column]) -> Column:
    """The violations of each variant of an array, joined; of none if the array is null."""
    with_kind = F.transform(values, lambda x: F.struct(x.alias("variant"), F.schema_of_variant(x).alias("kind")))
    return F.coalesce(F.flatten(F.transform(with_kind, lambda x: rules(_Value(x)))), _none())


def _member(v: _Value, key: str) -> Column:
    """The member of an object: null if it is absent or the value is no object, a variant null if it is null."""
    mark = "'" if "'" not in key else '"'
    if mark in key:
        raise ValueError(f"a name with both kinds of quotes: {key}")
    return F.try_variant_get(v.variant, f"$[{mark}{key}{mark}]", "variant")


def _number(broken: Callable[[Column, float], Column]) -> Callable[[_Value, float], Column]:
    return lambda v, n: v.is_a("number") & broken(v.taken("double"), n)


def _text(broken: Callable[[Column, object], Column]) -> Callable[[_Value, object], Column]:
    return lambda v, x: v.is_a("string") & broken(v.taken("string"), x)


def _array(broken: Callable[[Column, int], Column]) -> Callable[[_Value, int], Column]:
    return lambda v, n: v.is_a("array") & broken(F.size(v.taken("array<variant>")), n)


#: Per keyword that looks at one value alone: whether the value, of the keyword's type, breaks it.
SCALAR: dict[str, Callable[[_Value, object], Column]] = {
    "type": lambda v, names: ~reduce(Column.__or__, (v.is_a(x) for x in ([names] if isinstance(names, str) else names))),
    "enum": lambda v, values: ~v.one_of(values), "const": lambda v, value: ~v.equals(value),
    "minimum": _number(lambda x, n: x < n), "maximum": _number(lambda x, n: x > n), "exclusiveMinimum": _number(lambda x, n: x <= n), "exclusiveMaximum": _number(lambda x, n: x >= n),
    "multipleOf": _number(lambda x, n: x / n != F.rint(x / n)), "pattern": _text(lambda x, p: ~x.rlike(p)), "minLength": _text(lambda x, n: F.length(x) < n), "maxLength": _text(lambda x, n: F.length(x) > n),
    "minItems": _array(lambda x, n: x < n), "maxItems": _array(lambda x, n: x > n),
}


def _resolved(root: Mapping, ref: str) -> Mapping | bool:
    if not ref.startswith("#"):
        raise ValueError(f"only references inside the schema are followed, not {ref}")
    node = root
    for part in ref[1:].split("/")[1:]:
        node = node[part.replace("~1", "/").replace("~0", "~")]
    return node


def _checked(schema: Mapping | bool, v: _Value, path: Column, root: Mapping, inside: tuple[str, ...]) -> list[Column]:
    """Arrays of violations of a value, one for each keyword that can be broken."""
    if isinstance(schema, bool):
        return [] if schema else [F.array(F.concat(path, F.lit(": false")))]
    if "$ref" in schema:
        if schema["$ref"] in inside:
            raise ValueError(f"the schema refers to itself: {schema['$ref']}")
        return _checked(_resolved(root, schema["$ref"]), v, path, root, (*inside, schema["$ref"]))
    below = lambda sub, value, at: _joined(_checked(sub, value, at, root, inside))
    at_once = lambda broken, keyword, where=path: F.when(broken, F.array(F.concat(where, F.lit(f": {keyword}")))).otherwise(_none())
    child = lambda key: F.concat(path, F.lit("."), key if isinstance(key, Column) else F.lit(key))
    members = lambda kept: F.filter(F.map_entries(v.taken("map<string,variant>")), kept)
    each = lambda parts, sub, at: _each(parts, lambda e: _bound(F.array(e["value"]), lambda x: below(sub, x, at(e["key"]))))
    named, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
    found = []
    for keyword, given in schema.items():
        if keyword in SCALAR:
            found.append(at_once(SCALAR[keyword](v, given), keyword))
        elif keyword == "required":
            found += [at_once(v.is_a("object") & _member(v, key).isNull(), keyword, child(key)) for key in given]
        elif keyword == "properties":
            found += _of_named(given, members, lambda sub, x, key: below(sub, x, child(key)))
        elif keyword == "patternProperties":
            found += [each(members(lambda e: e["key"].rlike(pattern)), sub, child) for pattern, sub in given.items()]
        elif keyword == "additionalProperties" and given is not True:
            rest = members(lambda e: ~reduce(Column.__or__, (e["key"].rlike(p) for p in patterns), e["key"].isin(*named) if named else F.lit(False)))
            found.append(each(rest, given, child) if given is not False else _each(rest, lambda e: F.array(F.concat(child(e["key"]), F.lit(": additionalProperties")))))
        elif keyword == "items" and isinstance(given, (Mapping, bool)):
            listed = F.transform(v.taken("array<variant>"), lambda x, k: F.struct(x.alias("value"), k.alias("key")))
            found.append(each(listed, given, lambda k: F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        elif keyword == "allOf":
            found += [rule for sub in given for rule in _checked(sub, v, path, root, inside)]
        elif keyword in ("anyOf", "oneOf"):
            fits = reduce(Column.__add__, ((F.size(below(sub, v, path)) == 0).cast("int") for sub in given))
            found.append(at_once(fits == 0 if keyword == "anyOf" else fits != 1, keyword))
        elif keyword == "not":
            found.append(at_once(F.size(below(given, v, path)) == 0, keyword))
        elif keyword not in ANNOTATIONS | {"additionalProperties"}:
            raise ValueError(f"keyword not known: {keyword}")
    return found


def _of_named(given: Mapping, members: Callable, judged: Callable[[object, _Value, Column], Column]) -> list[Column]:
    """The violations of an object's members that ``given`` names, in its order; one rule for all names of equal schemas.

    Only members that a record has are looked at, so many names that it lacks cost nothing.
    """
    alike: dict[str, tuple[object, list[str]]] = {}
    for key, sub in given.items():
        if sub not in (True, {}):
            alike.setdefault(json.dumps(sub), (sub, []))[1].append(key)
    names = [key for _, keys in alike.values() for key in keys]
    if not names:
        return []
    place = F.create_map(*(F.lit(x) for k, key in enumerate(given) for x in (key, k)))

    def rules(key: Column, x: _Value) -> Column:
        return reduce(lambda rest, group: F.when(key.isin(*group[1]), judged(group[0], x, key)).otherwise(rest), alike.values(), _none())

    each = F.transform(members(lambda e: e["key"].isin(*names)), lambda e: F.struct(e["key"].alias("key"), _bound(F.array(e["value"]), lambda x: rules(e["key"], x)).alias("broken")))
    broken = F.transform(F.filter(each, lambda r: F.size(r["broken"]) > 0), lambda r: F.struct(F.try_element_at(place, r["key"]).alias("place"), r["broken"].alias("broken")))
    return [F.coalesce(F.flatten(F.transform(F.array_sort(broken), lambda r: r["broken"])), _none())]


def _joined(rules: list[Column]) -> Column:
    return F.concat(*rules) if rules else _none()


def _each(entries: Column, rule: Callable[[Column], Column]) -> Column:
    """The violations of all members or items; none if the value has no such parts."""
    return F.coalesce(F.flatten(F.transform(entries, rule)), _none())


def violations(schema: Mapping | bool, value: Column) -> Column:
    """What a variant value violates: an array of ``path: keyword``, in the schema's order; ``$: json`` if there is no value."""
    root = schema if isinstance(schema, Mapping) else {}
    return _bound(F.array(value), lambda v: F.when(v.variant.isNull(), F.array(F.lit("$: json"))).otherwise(_joined(_checked(schema, v, F.lit("$"), root, ()))))


def violations_of_text(schema: Mapping | bool, text: Column) -> Column:
    """``violations`` of a JSON text; a null text, or one that is no JSON, has the one violation ``$: json``."""
    return violations(schema, F.try_parse_json(text))
