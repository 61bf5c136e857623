"""Evidence on outputs and rollouts: JSON against a schema, states folded step by step, predictions completed at depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.functions import state as S
from gymlake.functions.json_schema import with_schema_problems
from gymlake.operators import folds
from gymlake.operators.verdicts import with_verdicts
from gymlake.sources.tables import table

QUERIES, ORACLES = {}, {}
NOTES = S.FAMILIES["mcp_notes"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


PROPS = {
    "type": "object",
    "required": ["k", "device"],
    "properties": {
        "k": {"type": "integer", "minimum": 3, "maximum": 95, "not": {"const": 50}},
        "device": {"type": "object", "properties": {"os": {"enum": ["android", "ios", "web"]}, "ver": {"type": "string", "pattern": "^[0-3][.]", "maxLength": 3}}},
        "items": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/item"}},
    },
    "patternProperties": {"^t": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"oneOf": [{"const": "a"}, {"const": "b"}]}}},
    "additionalProperties": False,
    "dependentRequired": {"tags": ["items"]},
    "$defs": {"item": {"type": "object", "required": ["sku", "qty"], "properties": {"sku": {"exclusiveMaximum": 150}, "qty": {"multipleOf": 2}}}},
}


# Fields are read by path, items one by one; a type is tested where the schema names one and another occurs.
@query("""
with p as (select click_id, props, case when json_valid(props) then props end j from clicks),
x as (
  select *, case when json_type(j, '$.k') = 'UBIGINT' then (j->>'$.k')::bigint end k, json_type(j, '$.k') k_type, json_type(j, '$.tags') tags_type, j->>'$.device.os' os, j->>'$.device.ver' ver,
    case when json_type(j, '$.tags') = 'ARRAY' then json_extract(j, '$.tags[*]')::varchar[] end tags, json_extract(j, '$.items[*]') items, json_exists(j, '$.device') has_device, json_exists(j, '$.items') has_items from p)
select click_id, case when j is null then ['$: not JSON'] else list_sort(list_concat(
  case when k_type is null then ['$: required:k'] when k_type <> 'UBIGINT' then ['$.k: type'] else [] end,
  case when has_device then [] else ['$: required:device'] end,
  case when tags_type is not null and not has_items then ['$: dependentRequired:items'] else [] end,
  case when k < 3 then ['$.k: minimum'] when k > 95 then ['$.k: maximum'] when k = 50 then ['$.k: not'] else [] end,
  case when os not in ('android', 'ios', 'web') then ['$.device.os: enum'] else [] end,
  case when not regexp_matches(ver, '^[0-3][.]') then ['$.device.ver: pattern'] else [] end,
  case when length(ver) > 3 then ['$.device.ver: maxLength'] else [] end,
  case when len(items) > 2 then ['$.items: maxItems'] else [] end,
  flatten(list_transform(items, lambda i, n: list_concat(
    case when (i->>'$.sku')::bigint >= 150 then ['$.items[' || (n - 1) || '].sku: exclusiveMaximum'] else [] end,
    case when (i->>'$.qty')::bigint % 2 <> 0 then ['$.items[' || (n - 1) || '].qty: multipleOf'] else [] end))),
  case when tags_type <> 'ARRAY' then ['$.tags: type'] when len(tags) = 0 then ['$.tags: minItems'] else [] end,
  case when list_unique(list_transform(tags, lambda t: coalesce(t, 'null'))) < len(tags) then ['$.tags: uniqueItems'] else [] end,
  flatten(list_transform(tags, lambda t, n: case when t in ('"a"', '"b"') then [] else ['$.tags[' || (n - 1) || ']: oneOf'] end)))) end problems
from x""")
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click's properties against a schema; broken texts are no JSON."""
    return with_schema_problems(table(spark, sf_dir, "clicks").select("click_id", "props"), "props", PROPS).select("click_id", F.array_sort("problems").alias("problems"))


# What a turn's prediction says of the one note: lost, left out, said by the user, said by the agent.
_TURNS = """t as (
  select conv_id, turn, role, case when length(text) % 7 = 0 then 'lost' when role = 'system' or length(text) % 5 = 0 then 'silent' when role = 'user' then 'user' else 'agent' end kind from conversations),
g as (select *, count(*) filter (where kind = 'lost') over w losses, row_number() over w place from t window w as (partition by conv_id order by turn)),
s as (
  select conv_id, place, coalesce(last_value(case when kind <> 'silent' then kind end ignore nulls) over w, '') = 'lost' gone,
    coalesce(last_value(case when kind = 'agent' then 'c' || turn end ignore nulls) over w, case when losses = 0 then 'start' else '' end) content,
    coalesce(last_value(case when kind = 'user' then ['user', 't' || turn] end ignore nulls) over w, case when losses = 0 then ['start'] else [] end) tags
  from g window w as (partition by conv_id, losses order by turn rows unbounded preceding)),
states as (
  select conv_id, place, case when gone then null else content end content, case when gone then null else tags end tags from s
  union all select distinct conv_id, 0, 'start', ['start'] from conversations)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction of the notes per turn, which forgets fields, keys and whole notes, as the turn's own text has it."""
    note = NOTES["notes"].dataType
    n = F.length("text")
    said = lambda content, tags: F.array(F.struct(F.lit("open").alias("title"), content.alias("content"), tags.alias("tags"))).cast(note)
    notes = (
        F.when(n % 7 == 0, F.array().cast(note)).when((F.col("role") == "system") | (n % 5 == 0), F.lit(None).cast(note))
        .when(F.col("role") == "user", said(F.lit(None), F.array(F.lit("user"), F.concat(F.lit("t"), F.col("turn").cast("string")))))
        .otherwise(said(F.concat(F.lit("c"), F.col("turn").cast("string")), F.lit(None)))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(notes.alias("notes")).cast(NOTES).alias("predicted"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial = F.from_json(F.lit('{"notes":[{"title":"open","content":"start","tags":["start"]}]}'), NOTES)
    return folds.fold_states(predictions(spark, sf_dir), ["conv_id"], "turn", "predicted", initial, NOTES)


@query(f"with {_TURNS} select conv_id, place, content, tags from states")
def folded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of each conversation's rollout, repaired from the one before."""
    note = F.try_element_at(F.col("state.notes"), F.lit(1))
    return folded(spark, sf_dir).select("conv_id", F.inline("states")).select("conv_id", "place", note["content"].alias("content"), note["tags"].alias("tags"))


STEPWISE = {"asked": "any('user' in n['tags'] for n in state['notes'])", "kept": "len(state['notes']) > 0", "filled": "state['notes'][0]['content'] != ''"}


@query(f"""with {_TURNS}, v as (select conv_id, place, coalesce(list_contains(tags, 'user'), false) asked, content is not null kept, coalesce(content <> '', false) filled, content is null err from states)
select conv_id, count(*) n_states,
  {", ".join(f"bool_or({p}) {p}_ever, bool_and({p}) {p}_always, max_by({p}, place) {p}_at_end, min(place) filter (where not {p}) {p}_first_failure" for p in STEPWISE)},
  null::varchar asked_error, null::varchar kept_error, case when bool_or(err) then 'checker_raised:IndexError' end filled_error
from v group by conv_id""")
def step_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on every state of a rollout: ever, always, at the end, and where they first fail."""
    return folds.step_verdicts(folded(spark, sf_dir), ["conv_id"], STEPWISE, NOTES)


@query(f"""with {_TURNS}, e as (select * from states qualify row_number() over (partition by conv_id order by place desc) = 1),
f as (select conv_id % 5 task, content is not null kept, coalesce(content <> '', false) filled, coalesce(list_contains(tags, 'user'), false) asked from e)
select task, count(*) n, avg((kept and filled and asked)::int) pass_rate, count(*) filter (where not kept) kept_failed, count(*) filter (where not filled) filled_failed, count(*) filter (where not asked) asked_failed,
  count(*) filter (where not kept and filled and asked) only_kept, count(*) filter (where kept and not filled and asked) only_filled, count(*) filter (where kept and filled and not asked) only_asked, count(*) filter (where not kept) unevaluable
from f group by task""")
def clause_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clauses of a checker fail on final states, which one alone, and how often one could not be evaluated, by task."""
    last = folded(spark, sf_dir).select("conv_id", F.element_at("states", -1)["state"].alias("state"))
    judged = with_verdicts(last, STEPWISE, NOTES)
    names = ("kept", "filled", "asked")
    alone = lambda n: F.count_if(~F.col(n) & F.forall(F.array(*[F.col(m) for m in names if m != n]), lambda v: v)).alias(f"only_{n}")
    return judged.groupBy((F.col("conv_id") % 5).alias("task")).agg(
        F.count("*").alias("n"), F.avg((F.col("kept") & F.col("filled") & F.col("asked")).cast("int")).alias("pass_rate"),
        *[F.count_if(~F.col(n)).alias(f"{n}_failed") for n in names], *[alone(n) for n in names], F.count_if(F.col("filled_error").isNotNull()).alias("unevaluable"),
    )


@query(f"""with {_TURNS}, n as (select conv_id, max(place) top from states group by conv_id),
b as (select conv_id, content b from states join n using (conv_id) where place = top // 2), f as (select conv_id, content f from states join n using (conv_id) where place = top),
v as (select conv_id, coalesce(b <> '', false) base, coalesce(f <> '', false) final, case when b is null then 'checker_raised:IndexError' end base_reason, case when f is null then 'checker_raised:IndexError' end final_reason from b join f using (conv_id))
select *, final and not base genuinely_improved, base and not final regressed from v""")
def paired_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checker that can raise, judged with its reason on the state halfway and on the last one; what improved and what regressed."""
    states = folded(spark, sf_dir).select("conv_id", F.element_at("states", (F.floor((F.size("states") - 1) / 2) + 1).cast("int"))["state"].alias("half"), F.element_at("states", -1)["state"].alias("last"))
    both = states.select("conv_id", F.explode(F.array(F.struct(F.lit("base").alias("when"), F.col("half").alias("state")), F.struct(F.lit("final").alias("when"), F.col("last").alias("state")))).alias("x")).select("conv_id", "x.*")
    judged = with_verdicts(both, {"filled": STEPWISE["filled"]}, NOTES)
    of = lambda when, c: F.max(F.when(F.col("when") == when, F.col(c)))
    out = judged.groupBy("conv_id").agg(of("base", "filled").alias("base"), of("final", "filled").alias("final"), of("base", "filled_error").alias("base_reason"), of("final", "filled_error").alias("final_reason"))
    return out.withColumn("genuinely_improved", F.col("final") & ~F.col("base")).withColumn("regressed", F.col("base") & ~F.col("final"))


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


_S, _I = T.StringType(), T.LongType()
#: A repository's state with a workspace around it: objects in objects, lists of objects in objects, a map.
WORKSPACE = _of(
    **{f.name: f.dataType for f in S.FAMILIES["code_repo"].fields},
    workspace=_of(root=_S, limits=_of(steps=_I, seconds=_I), labels=T.MapType(_S, _S), members=T.ArrayType(_of(name=_S, role=_S, quota=_of(files=_I, lines=_I)))),
)


@query("""
with d as (select doc_id, lang, source, n_chars n from documents),
p as (
  select *, n % 2 = 0 no_branch, n % 3 = 0 no_run, n % 3 = 1 part_run, n % 5 = 0 renamed, n % 7 = 0 no_space, n % 11 = 0 no_members, n % 4 = 1 no_quota, n % 4 = 2 half_quota from d)
select doc_id, case when no_branch then source else 'next' end branch,
  case when renamed then 'other' else lang end module, case when renamed then '' else 's' || n end source_text, n % 2 = 1 modified,
  case when no_run or part_run then n else n + 1 end passed, case when no_run or part_run then ['a', lang] else [] end failing,
  case when no_space then n else n + 1 end steps, 60 as seconds, list_sort(case when no_space then ['k=' || lang, 'old=1'] else ['k=new', 'old=1'] end) labels,
  case when no_space then [lang, 'b'] when no_members then [] else [lang, 'c'] end members,
  case when no_members and not no_space then null when no_space or no_quota then n when half_quota then 0 else n + 2 end files,
  case when no_members and not no_space then null when no_space or no_quota then 7 when half_quota then n + 3 else 0 end lines,
  case when no_members and not no_space then null::varchar[] when no_space then ['owner', ''] else ['owner', 'guest'] end roles
from p""")
def nested_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that forget parts of a state at two and three levels, completed from the state before."""
    n, lang, lit = F.col("n_chars"), F.col("lang"), F.lit
    null = lambda t: lit(None).cast(t)
    space = WORKSPACE["workspace"].dataType
    member = lambda name, role, files, lines: F.struct(name.alias("name"), role.alias("role"), F.struct(files.cast("long").alias("files"), lines.cast("long").alias("lines")).alias("quota"))
    module = lambda name, text, changed: F.struct(name.alias("module"), text.alias("source"), changed.alias("modified"))
    prior = F.struct(
        F.col("source").alias("branch"), F.array(module(lang, F.concat(lit("s"), n.cast("string")), lit(False)), module(lit("gone"), lit("x"), lit(True))).alias("modules"),
        F.struct(lit("unit").alias("suite"), n.alias("passed"), lit(2).alias("failed"), F.array(lit("a"), lang).alias("failing")).alias("last_test_run"),
        F.struct(
            lit("/").alias("root"), F.struct(n.alias("steps"), lit(60).alias("seconds")).alias("limits"), F.create_map(lit("k"), lang, lit("old"), lit("1")).alias("labels"),
            F.array(member(lang, lit("owner"), n, lit(7)), member(lit("b"), null("string"), lit(1), lit(1))).alias("members"),
        ).alias("workspace"),
    ).cast(WORKSPACE)
    run, item = WORKSPACE["last_test_run"].dataType, space["members"].dataType
    quota = item.elementType["quota"].dataType
    told = F.when(n % 4 == 1, null(quota)).when(n % 4 == 2, F.struct(null("long").alias("files"), (n + 3).alias("lines")).cast(quota)).otherwise(F.struct((n + 2).alias("files"), null("long").alias("lines")).cast(quota))
    known = F.struct(lang.alias("name"), null("string").alias("role"), told.alias("quota")).cast(item.elementType)
    new = member(lit("c"), lit("guest"), lit(5), lit(5)).cast(item.elementType)
    predicted = F.struct(
        F.when(n % 2 == 0, null("string")).otherwise("next").alias("branch"),
        F.array(module(F.when(n % 5 == 0, "other").otherwise(lang), null("string"), F.when(n % 2 == 1, True))).alias("modules"),
        F.when(n % 3 == 0, null(run)).when(n % 3 == 1, F.struct(lit("unit").alias("suite"), null("long").alias("passed"), lit(0).alias("failed"), null("array<string>").alias("failing")).cast(run))
        .otherwise(F.struct(null("string").alias("suite"), (n + 1).alias("passed"), null("long").alias("failed"), F.array().cast("array<string>").alias("failing")).cast(run)).alias("last_test_run"),
        F.when(n % 7 == 0, null(space)).otherwise(F.struct(
            null("string").alias("root"), F.struct((n + 1).alias("steps"), null("long").alias("seconds")).alias("limits"), F.create_map(lit("k"), lit("new")).alias("labels"),
            F.when(n % 11 == 0, F.array().cast(item)).otherwise(F.array(known, new)).alias("members"),
        ).cast(space)).alias("workspace"),
    ).cast(WORKSPACE)
    full = table(spark, sf_dir, "documents").select("doc_id", S.complete(prior, predicted, WORKSPACE).alias("s"))
    w, m, first = F.col("s.workspace"), F.try_element_at(F.col("s.modules"), lit(1)), F.try_element_at(F.col("s.workspace.members"), lit(1))
    return full.select(
        "doc_id", "s.branch", m["module"].alias("module"), m["source"].alias("source_text"), m["modified"].alias("modified"), "s.last_test_run.passed", "s.last_test_run.failing",
        w["limits"]["steps"].alias("steps"), w["limits"]["seconds"].alias("seconds"), F.array_sort(F.transform(F.map_entries(w["labels"]), lambda e: F.concat(e["key"], lit("="), e["value"]))).alias("labels"),
        F.transform(w["members"], lambda x: x["name"]).alias("members"), first["quota"]["files"].alias("files"), first["quota"]["lines"].alias("lines"),
        F.when(F.size(w["members"]) > 0, F.transform(w["members"], lambda x: x["role"])).alias("roles"),
    )
