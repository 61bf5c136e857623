"""JSON Schema as Columns: a schema compiles to a list of problems of a JSON text, through VARIANT, without Python on rows.

Validating keywords of the 2020-12 draft, but those that need dynamic scope or unevaluated parts, which are refused
when the schema is compiled, as are references that lead back to themselves. Unknown keywords and formats are
annotations. Numbers compare as doubles (so 1 equals 1.0 and is an integer); patterns search, in Java's dialect;
lengths are code points. A text that repeats a key in one object does not parse.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFUSED = ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef", "$recursiveRef", "dependentSchemas")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


MAP, LIST = "map<string,variant>", "array<variant>"
#: Keywords that look into objects and lists, and those that apply schemas to the value itself.
OF_OBJECTS = frozenset("required dependentRequired minProperties maxProperties properties patternProperties additionalProperties propertyNames".split())
OF_LISTS = frozenset("minItems maxItems uniqueItems prefixItems items contains".split())
IN_PLACE = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else")


def _kind(v: Column, members: Column | None, items: Column | None) -> Column:
    """OBJECT..., ARRAY... or a scalar's type; what has been read as one of the first two is not looked through again."""
    kind = F.schema_of_variant(v)
    if items is not None:
        kind = F.when(items.isNotNull(), "ARRAY").otherwise(kind)
    return kind if members is None else F.when(members.isNotNull(), "OBJECT").otherwise(kind)


class Value:
    """A VARIANT, what it is, and what it holds. JSON null is a value; an element of a list that is absent counts as null.

    name: of its columns, for a value at a fixed place of the text; such values are columns of a table, the others are bound by
    lambdas.
    """

    def __init__(self, seen: Callable[[str], Column], path: Column, name: str | None = None, once: Callable[[str, Column], Column] = lambda _, c: c):
        self.once = once
        self.v, kind, self.members, self.items, self.path, self.name = seen("v"), seen("kind"), seen("members"), seen("items"), path, name
        self.is_object, self.is_array, self.is_string = kind.startswith("OBJECT"), kind.startswith("ARRAY"), kind == "STRING"
        self.is_boolean, self.is_null = kind == "BOOLEAN", kind == "VOID"
        self.is_number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")

    @staticmethod
    def with_(v: Column, path: Column, needs: set[str], body: Callable[[Value], Column]) -> Column:
        """body(Value), with the parts that are needed read once. v is a variable or cheap."""
        members = F.try_variant_get(v, "$", MAP) if "members" in needs else None
        items = F.try_variant_get(v, "$", LIST) if "items" in needs else None
        parts = [v.alias("v"), (F.lit(None).cast(MAP) if members is None else members).alias("members"), (F.lit(None).cast(LIST) if items is None else items).alias("items")]
        if members is None and items is None:
            return _let(F.struct(*parts, _kind(v, None, None).alias("kind")), lambda seen: body(Value(lambda part: seen[part], path)))
        kinded = lambda x: F.struct(x["v"].alias("v"), x["members"].alias("members"), x["items"].alias("items"), _kind(x["v"], x["members"] if members is not None else None, x["items"] if items is not None else None).alias("kind"))
        return _let(F.struct(*parts), lambda x: _let(kinded(x), lambda seen: body(Value(lambda part: seen[part], path))))

    @property
    def number(self) -> Column:
        return self.once("number", F.try_variant_get(self.v, "$", "double"))

    @property
    def text(self) -> Column:
        return self.once("text", F.try_variant_get(self.v, "$", "string"))

    def is_type(self, name: str) -> Column:
        if name == "integer":
            return self.is_number & (self.number == F.rint(self.number))
        return {"object": self.is_object, "array": self.is_array, "string": self.is_string, "boolean": self.is_boolean, "null": self.is_null, "number": self.is_number}[name]

    def equals(self, literal) -> Column:
        """Equal as JSON values."""
        if literal is None:
            return self.is_null
        if isinstance(literal, bool):
            return self.is_boolean & (F.try_variant_get(self.v, "$", "boolean") == literal)
        if isinstance(literal, (int, float)):
            return self.is_number & (self.number == float(literal))
        if isinstance(literal, str):
            return self.is_string & (self.text == literal)
        return F.to_json(self.v).eqNullSafe(F.to_json(F.parse_json(F.lit(json.dumps(literal)))))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _only(where: Column, problems: Column) -> Column:
    return F.when(where, problems).otherwise(_empty())


class _Compiler:
    """levels: the columns that values at fixed places need, by depth; each reads those of the level before."""

    def __init__(self, root: dict | bool | None):
        self.root = root
        self.levels: list[dict[str, Column]] = []
        self.depth: dict[str, int] = {}
        self.keys: dict[tuple[str, str], str] = {}
        self.wanted: dict[str, set[str]] = {}

    def key(self, parent: str, name: str) -> str:
        """A column name for a property of a fixed value: the same for the same place."""
        return self.keys.setdefault((parent, name), f"json{len(self.keys) + 1}")

    def needs(self, schema: dict | bool | None, seen: tuple = ()) -> set[str]:
        """Which of members and items a schema looks at, at the value itself."""
        if not isinstance(schema, dict):
            return set()
        out = {"members"} if OF_OBJECTS & set(schema) else set()
        out |= {"items"} if OF_LISTS & set(schema) else set()
        for word in IN_PLACE:
            for s in schema.get(word, []) if word in ("allOf", "anyOf", "oneOf") else [schema[word]] if word in schema else []:
                out |= self.needs(s, seen)
        if schema.get("$ref") and schema["$ref"] not in seen:
            out |= self.needs(self.resolve(schema["$ref"]), (*seen, schema["$ref"]))
        return out

    def fixed(self, key: str, v: Column, path: Column, depth: int, needs: set[str]) -> Value:
        """The value at a fixed place, in two levels of columns: itself, then what it holds."""
        name = f"_{key}"
        self.depth.setdefault(name, depth)
        wanted = self.wanted.setdefault(name, set())
        wanted |= needs  # several schemas may look at one place
        while len(self.levels) < depth + 3:
            self.levels.append({})
        one = F.col(f"{name}_v")
        self.levels[depth][f"{name}_v"] = v
        for part, kind in (("members", MAP), ("items", LIST)):
            self.levels[depth + 1][f"{name}_{part}"] = F.try_variant_get(one, "$", kind) if part in wanted else F.lit(None).cast(kind)
        read = [F.col(f"{name}_{part}") if part in wanted else None for part in ("members", "items")]
        self.levels[depth + 2][f"{name}_kind"] = _kind(one, *read)

        def once(part: str, c: Column) -> Column:
            self.levels[self.depth[name] + 1][f"{name}_{part}"] = c
            return F.col(f"{name}_{part}")

        return Value(lambda part: F.col(f"{name}_{part}"), path, name, once)

    def resolve(self, ref: str) -> dict | bool:
        if not ref.startswith("#"):
            raise ValueError(f"only references within the schema are read, not {ref}")
        at = self.root
        for part in filter(None, ref[1:].split("/")):
            part = part.replace("~1", "/").replace("~0", "~")
            at = at[int(part)] if isinstance(at, list) else at[part]
        return at

    def inside(self, schema: dict | bool, v: Column, path: Column, seen: tuple) -> Column:
        """Problems of a part."""
        return Value.with_(v, path, self.needs(schema, seen), lambda x: self.problems(schema, x, seen))

    def holds(self, schema: dict | bool, x: Value, seen: tuple) -> Column:
        return F.size(self.problems(schema, x, seen)) == 0

    def problems(self, schema: dict | bool, x: Value, seen: tuple = ()) -> Column:
        say = lambda what: F.concat(x.path, F.lit(f": {what}"))
        if isinstance(schema, bool):
            return _empty() if schema else F.array(say("false"))
        if not isinstance(schema, dict):
            raise TypeError(f"a schema is an object or a boolean, not {schema!r}")
        for word in REFUSED:
            if word in schema:
                raise ValueError(f"{word} cannot be compiled")
        found: list[Column] = []
        sub = lambda s, y=x: self.problems(s, y, seen)

        def fails(where: Column, what: str) -> None:
            found.append(_only(F.coalesce(where, F.lit(False)), F.array(say(what))))

        if "$ref" in schema:
            if schema["$ref"] in seen:
                raise ValueError(f"{schema['$ref']} leads back to itself")
            found.append(self.problems(self.resolve(schema["$ref"]), x, (*seen, schema["$ref"])))
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            ok = F.lit(False)
            for k in kinds:
                ok = ok | x.is_type(k)
            fails(~F.coalesce(ok, F.lit(False)), "type")
        if "enum" in schema:
            ok = F.lit(False)
            for value in schema["enum"]:
                ok = ok | F.coalesce(x.equals(value), F.lit(False))
            fails(~ok, "enum")
        if "const" in schema:
            fails(~F.coalesce(x.equals(schema["const"]), F.lit(False)), "const")
        self._numbers(schema, x, fails)
        self._strings(schema, x, fails)
        self._objects(schema, x, seen, found, fails)
        self._arrays(schema, x, seen, found, fails)
        for s in schema.get("allOf", []):
            found.append(sub(s))
        if "anyOf" in schema:
            fails(~F.greatest(F.lit(False), F.lit(False), *[self.holds(s, x, seen) for s in schema["anyOf"]]), "anyOf")
        if "oneOf" in schema:
            fails(sum((self.holds(s, x, seen).cast("int") for s in schema["oneOf"]), F.lit(0)) != 1, "oneOf")
        if "not" in schema:
            fails(self.holds(schema["not"], x, seen), "not")
        if "if" in schema:
            met = self.holds(schema["if"], x, seen)
            found.append(F.when(met, sub(schema.get("then", True))).otherwise(sub(schema.get("else", True))))
        return F.concat(*found) if found else _empty()

    @staticmethod
    def _numbers(schema: dict, x: Value, fails: Callable) -> None:
        n = x.number
        for word, broken in (("minimum", lambda b: n < b), ("maximum", lambda b: n > b), ("exclusiveMinimum", lambda b: n <= b), ("exclusiveMaximum", lambda b: n >= b), ("multipleOf", lambda b: n / b != F.rint(n / b))):
            if word in schema:
                fails(x.is_number & broken(F.lit(float(schema[word]))), word)

    @staticmethod
    def _strings(schema: dict, x: Value, fails: Callable) -> None:
        if "minLength" in schema:
            fails(x.is_string & (F.length(x.text) < schema["minLength"]), "minLength")
        if "maxLength" in schema:
            fails(x.is_string & (F.length(x.text) > schema["maxLength"]), "maxLength")
        if "pattern" in schema:
            fails(x.is_string & ~x.text.rlike(schema["pattern"]), "pattern")

    def _objects(self, schema: dict, x: Value, seen: tuple, found: list, fails: Callable) -> None:
        has = lambda name: F.map_contains_key(x.members, name)
        keys = F.map_keys(x.members)
        for name in schema.get("required", []):
            fails(x.is_object & ~has(name), f"required:{name}")
        for name, needs in schema.get("dependentRequired", {}).items():
            for other in needs:
                fails(x.is_object & has(name) & ~has(other), f"dependentRequired:{other}")
        if "minProperties" in schema:
            fails(x.is_object & (F.size(keys) < schema["minProperties"]), "minProperties")
        if "maxProperties" in schema:
            fails(x.is_object & (F.size(keys) > schema["maxProperties"]), "maxProperties")
        for name, s in schema.get("properties", {}).items():
            if s is True:
                continue
            v, path = F.try_element_at(x.members, F.lit(name)), F.concat(x.path, F.lit(f".{name}"))
            if x.name is None:
                own = self.inside(s, v, path, seen)
            else:
                own = self.problems(s, self.fixed(self.key(x.name, name), v, path, self.depth[x.name] + 2, self.needs(s, seen)), seen)
            found.append(_only(F.coalesce(x.is_object & has(name), F.lit(False)), own))
        each = lambda s, chosen: F.flatten(F.transform(F.map_entries(chosen), lambda e: self.inside(s, e["value"], F.concat(x.path, F.lit("."), e["key"]), seen)))
        matches = lambda pattern: lambda k: k.rlike(pattern)
        like = lambda pattern: F.map_filter(x.members, lambda k, _: k.rlike(pattern))
        for pattern, s in schema.get("patternProperties", {}).items():
            found.append(_only(F.coalesce(x.is_object & F.exists(keys, matches(pattern)), F.lit(False)), each(s, like(pattern))))
        if "additionalProperties" in schema:

            def extra(k: Column) -> Column:
                out = ~k.isin(*schema["properties"]) if schema.get("properties") else F.lit(True)
                for pattern in schema.get("patternProperties", {}):
                    out = out & ~k.rlike(pattern)
                return out

            if schema["additionalProperties"] is False:
                fails(x.is_object & F.exists(keys, extra), "additionalProperties")
            elif schema["additionalProperties"] is not True:
                rest = F.map_filter(x.members, lambda k, _: extra(k))
                found.append(_only(F.coalesce(x.is_object, F.lit(False)), each(schema["additionalProperties"], rest)))
        if "propertyNames" in schema:
            text = lambda k: F.get(F.parse_json(F.to_json(F.array(k))).cast("array<variant>"), F.lit(0))
            named = F.transform(keys, lambda k: F.size(self.inside(schema["propertyNames"], text(k), x.path, seen)) > 0)
            fails(x.is_object & F.exists(named, lambda bad: bad), "propertyNames")

    def _arrays(self, schema: dict, x: Value, seen: tuple, found: list, fails: Callable) -> None:
        n = F.size(x.items)
        if "minItems" in schema:
            fails(x.is_array & (n < schema["minItems"]), "minItems")
        if "maxItems" in schema:
            fails(x.is_array & (n > schema["maxItems"]), "maxItems")
        if schema.get("uniqueItems"):
            fails(x.is_array & (F.size(F.array_distinct(F.transform(x.items, lambda i: F.coalesce(F.to_json(i), F.lit("null"))))) < n), "uniqueItems")
        first = schema.get("prefixItems", [])
        at = lambda i: F.concat(x.path, F.lit("["), i.cast("string"), F.lit("]"))
        for i, s in enumerate(first):
            found.append(_only(F.coalesce(x.is_array & (n > i), F.lit(False)), self.inside(s, F.get(x.items, F.lit(i)), at(F.lit(i)), seen)))
        if "items" in schema:
            rest = F.slice(x.items, len(first) + 1, F.greatest(n - len(first), F.lit(0)))
            inner = F.flatten(F.transform(rest, lambda v, i: self.inside(schema["items"], v, at(i + len(first)), seen)))
            found.append(_only(F.coalesce(x.is_array, F.lit(False)), inner))
        if "contains" in schema:
            hits = F.size(F.filter(x.items, lambda v: F.size(self.inside(schema["contains"], v, x.path, seen)) == 0))
            fails(x.is_array & (hits < schema.get("minContains", 1)), "contains")
            if "maxContains" in schema:
                fails(x.is_array & (hits > schema["maxContains"]), "maxContains")


def _judged(compiler: _Compiler, x: Value) -> Column:
    inside = _empty() if compiler.root is None else compiler.problems(compiler.root, x)
    return F.when(F.coalesce(~x.is_null, F.lit(False)), inside).otherwise(F.array(F.lit("$: not JSON")))


def schema_problems(raw: Column, schema: dict | bool | None) -> Column:
    """Problems of a JSON text against a schema, as `path: keyword` in the schema's order; none: valid.

    Without a schema the text need only parse. A null text, one that is no JSON, and the bare `null` have the one problem `$: not JSON`.
    """
    compiler = _Compiler(schema)
    return _let(F.try_parse_json(raw), lambda v: Value.with_(v, F.lit("$"), compiler.needs(schema), lambda x: _judged(compiler, x)))


def with_schema_problems(df: DataFrame, raw: str, schema: dict | bool | None, name: str = "problems") -> DataFrame:
    """df with the same as a column: parts at fixed places of the text are columns, level by level, so that they are read once, in
    generated code. Columns of df that begin with `_json` are not touched, but may not be named like those."""
    compiler = _Compiler(schema)
    root = compiler.fixed("json", F.try_parse_json(raw), F.lit("$"), 0, compiler.needs(schema))
    problems = _judged(compiler, root)
    out = df
    for level in compiler.levels:
        out = out.select("*", *[c.alias(n) for n, c in level.items()])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], problems.alias(name))
