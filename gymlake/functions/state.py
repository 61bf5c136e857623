"""Environment states: family schemas, validation, conforming, completion, differences.

Raw states are JSON texts, for their shape is what is in question. They are
validated as text and only then read with the family's type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B, _L = T.StringType(), T.LongType(), T.BooleanType(), T.ArrayType(T.StringType())


def _object(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# The declared state of each tool family.
FAMILIES: dict[str, T.StructType] = {
    "mcp_notes": _object(notes=T.ArrayType(_object(title=_S, content=_S, tags=_L))),
    "mcp_api": _object(records=T.ArrayType(_object(record_id=_S, collection=_S, fields=T.MapType(_S, _S)))),
    "terminal_ops": _object(cwd=_S, entries=T.ArrayType(_object(path=_S, kind=_S, text=_S))),
    "web_research": _object(last_results=T.ArrayType(_object(rank=_I, title=_S, url=_S, snippet=_S)), notebook=T.ArrayType(_object(headline=_S, body=_S))),
    "code_repo": _object(branch=_S, modules=T.ArrayType(_object(module=_S, source=_S, modified=_B)), last_test_run=_object(suite=_S, passed=_I, failed=_I, failing=_L)),
}
# What identifies an object within its list, first found first.
IDENTITY = ("id", "title", "name", "key", "path")
# The field each declared list of objects is keyed by.
DECLARED_IDENTITY = {"notes": "title", "records": "record_id", "entries": "path", "last_results": "rank", "notebook": "headline", "modules": "module"}


def kind_of(raw: Column) -> Column:
    """Kind of a JSON text: string, integer, number, boolean, list, object or null (also where it does not parse)."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return (
        F.when(kind.isNull() | (kind == "VOID"), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def expected_kind(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    return {"string": "string", "bigint": "integer", "double": "number", "boolean": "boolean"}[t.simpleString()]


def _entries(raw: Column) -> Column:
    """Top-level members of an object, each value as JSON text."""
    return F.from_json(F.to_json(F.try_parse_json(raw)), "map<string,variant>")


def _member(members: Column, key: str) -> Column:
    return F.to_json(F.try_element_at(members, F.lit(key)))


def _object_violations(name: str, item: T.StructType):
    """Of one listed object and its number."""
    names = F.array(*[F.lit(n) for n in item.names])
    none = F.array().cast("array<string>")

    def of(o: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]."))
        lost = F.transform(F.array_except(names, F.map_keys(o)), lambda k: F.concat(F.lit("missing:"), at, k))
        more = F.transform(F.array_sort(F.array_except(F.map_keys(o), names)), lambda k: F.concat(F.lit("extra:"), at, k))
        wrong = [F.when(F.map_contains_key(o, g.name) & (kind_of(_member(o, g.name)) != expected_kind(g.dataType)), F.array(F.concat(F.lit("kind:"), at, F.lit(g.name)))).otherwise(none) for g in item.fields]
        return F.concat(lost, more, *wrong)

    return of


def violations(raw: Column, schema: T.StructType) -> Column:
    """What a raw state has against its schema, as a list of texts: extra and missing keys, wrong kinds, and the same for listed objects."""
    members = _entries(raw)
    keys = F.map_keys(members)
    declared = F.array(*[F.lit(n) for n in schema.names])
    parts = [
        F.transform(F.array_sort(F.array_except(keys, declared)), lambda k: F.concat(F.lit("extra:"), k)),
        F.transform(F.array_except(declared, keys), lambda k: F.concat(F.lit("missing:"), k)),
    ]
    for f in schema.fields:
        own = _member(members, f.name)
        want = expected_kind(f.dataType)
        there = F.array_contains(keys, f.name)
        parts.append(F.when(there & (kind_of(own) != want), F.array(F.concat(F.lit(f"kind:{f.name}:"), kind_of(own)))).otherwise(F.array().cast("array<string>")))
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            item = f.dataType.elementType
            objects = F.from_json(own, "array<map<string,variant>>")
            listed = F.when(there & (kind_of(own) == "list"), F.flatten(F.transform(objects, _object_violations(f.name, item))))
            parts.append(F.coalesce(listed, F.array().cast("array<string>")))
    bad = F.array(F.lit("kind:state"))
    return F.when(kind_of(raw) == "object", F.concat(*parts)).otherwise(bad)


def neutral(t: T.DataType) -> Column:
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    if isinstance(t, T.StructType):
        return F.struct(*[neutral(f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.MapType):
        return F.create_map().cast(t)
    return F.lit({"string": "", "bigint": 0, "double": 0.0, "boolean": False}[t.simpleString()]).cast(t)


def conform(typed: Column, t: T.DataType) -> Column:
    """A typed state with every missing part at its neutral value; nothing present is changed."""
    if isinstance(t, T.StructType):
        return F.struct(*[conform(typed[f.name], f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        return F.coalesce(F.transform(typed, lambda x: conform(x, t.elementType)), neutral(t))
    return F.coalesce(typed, neutral(t))


def _same_object(name: str, item: T.StructType):
    """What identifies an object of a list: the declared field, else the first of the usual ones that it has; null where nothing does."""
    if DECLARED_IDENTITY.get(name) in item.names:
        return lambda x: x[DECLARED_IDENTITY[name]].cast("string")
    usual = [k for k in IDENTITY if k in item.names]
    if not usual:
        return lambda x: F.lit(None).cast("string")
    return lambda x: F.coalesce(*[F.concat(F.lit(f"{k}="), x[k].cast("string")) for k in usual])


def complete(prior: Column, predicted: Column, schema: T.StructType) -> Column:
    """A predicted state with what it left out, at every depth: from before, else neutral. Nothing that is there is changed.

    Objects are merged key by key, maps too; objects of a list keep the fields of their earlier selves, found by identity; one that
    is missing from a list stays deleted and an empty list stays empty. The last of equal earlier objects counts. What a list's
    object holds in a field is taken whole, with neutral values where parts of it are missing. Null counts as left out.
    """
    both = F.array(F.struct(prior.alias("prior"), predicted.alias("predicted")))  # computed once, read for every part
    return F.get(F.transform(both, lambda b: _merged(b["prior"], b["predicted"], schema)), F.lit(0))


def _merged(prior: Column, predicted: Column, schema: T.DataType, name: str = "") -> Column:
    if isinstance(schema, T.StructType):
        return F.struct(*[_merged(prior[f.name], predicted[f.name], f.dataType, f.name).alias(f.name) for f in schema.fields])
    if isinstance(schema, T.MapType):
        kept = F.map_filter(prior, lambda k, _: ~F.map_contains_key(predicted, k))
        return F.coalesce(F.map_concat(kept, predicted), predicted, prior, neutral(schema))
    if isinstance(schema, T.ArrayType) and isinstance(schema.elementType, T.StructType):
        item, same = schema.elementType, _same_object(name, schema.elementType)

        def fill(x: Column) -> Column:
            old = F.try_element_at(F.filter(prior, lambda p: same(p) == same(x)), F.lit(-1))
            return F.struct(*[conform(F.coalesce(x[g.name], old[g.name]), g.dataType).alias(g.name) for g in item.fields])

        return F.coalesce(F.transform(predicted, fill), conform(prior, schema))
    return F.coalesce(predicted, prior, neutral(schema))


def touched(prior: Column, after: Column) -> Column:
    """Sorted keys whose values differ between two maps of key to JSON text."""
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(prior), F.map_keys(after))))
    return F.filter(keys, lambda k: ~F.try_element_at(prior, k).eqNullSafe(F.try_element_at(after, k)))


def perturbed(raw: Column) -> Column:
    """Another value of the same JSON kind."""
    kind = kind_of(raw)
    inner = F.substr(raw, F.lit(1), F.length(raw) - 1)
    return (
        F.when(kind == "boolean", F.when(raw == "true", "false").otherwise("true")).when(kind.isin("integer", "number"), (raw.try_cast("double") + 1).cast("string"))
        .when(kind == "string", F.concat(inner, F.lit(' (counterfactual probe)"'))).when(kind == "list", F.when(raw == "[]", '["__counterfactual_probe__"]').otherwise(F.concat(inner, F.lit(',"__counterfactual_probe__"]'))))
        .when(kind == "object", F.when(raw == "{}", '{"__counterfactual_probe__":true}').otherwise(F.concat(inner, F.lit(',"__counterfactual_probe__":true}')))).otherwise('"__counterfactual_probe__"')
    )


def confidence(valid: Column, agreement: Column, counterfactual: Column, adjudicated: Column) -> Column:
    """Fused evidence: 0.6 agreement and 0.4 counterfactual where valid (a missing probe passes); an adjudication settles it."""
    fused = 0.6 * agreement + 0.4 * F.coalesce(counterfactual, F.lit(True)).cast("int")
    return F.when(adjudicated.isNotNull(), adjudicated.cast("int").cast("double")).when(valid, fused).otherwise(F.lit(0.0)).cast("double")


def unwrap_next(raw: Column, known: list[str]) -> tuple[Column, Column]:
    """(state, error): the object under next_state, else the whole where it shares a key with known, else an error."""
    inner = F.get_json_object(raw, "$.next_state")
    keys = F.json_object_keys(raw)
    wrapped = inner.isNotNull() & F.startswith(inner, F.lit("{"))
    bare = F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in known])), F.lit(False))
    return F.when(wrapped, inner).when(bare, raw), F.when(~wrapped & ~bare, "missing next_state")


def tool_arguments(raw: Column) -> Column:
    """Arguments as a map of JSON texts; anything but an object gives none."""
    members = F.from_json(raw, "map<string,string>")
    return F.when(kind_of(raw) == "object", members).otherwise(F.create_map().cast("map<string,string>"))


def _prefixed(prefix: str):
    return lambda k: F.concat(F.lit(prefix), k)


def key_paths(raw: Column, schema: T.StructType) -> Column:
    """Sorted dotted paths present in a raw state, lists marked by []."""
    members = _entries(raw)
    parts = [F.map_keys(members)]
    for f in schema.fields:
        own = _member(members, f.name)
        if isinstance(f.dataType, T.ArrayType):
            inner = F.flatten(F.transform(F.from_json(own, "array<map<string,variant>>"), F.map_keys))
            parts.append(F.coalesce(F.transform(inner, _prefixed(f"{f.name}[].")), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*parts)))
