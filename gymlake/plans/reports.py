"""Collectors and reports: seeds, coverage, grids, tool families, server subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gymlake.functions import text as X
from gymlake.sources import catalog as C
from gymlake.sources.files import measured
from gymlake.sources.tables import JUDGED_SQL, judged, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SEEDS = f"{JUDGED_SQL}, runs as (select domain model, cast(sample_id % 3 as int) seed, avg(quality) v from judged where not (domain_no = 2 and sample_id % 3 = 1) group by 1, 2)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    seed = (F.col("sample_id") % 3).cast("int")
    return j.where(~((F.col("domain_no") == 2) & (seed == 1))).groupBy(F.col("domain").alias("model"), seed.alias("seed")).agg(F.avg("quality").alias("v"))


@query(f"with {_SEEDS} select model, avg(v) mean, coalesce(stddev_samp(v), 0) std, count(*) n, case when count(*) < 3 then '(n=' || count(*) || ')' else '' end note from runs group by model")
def seed_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation over seeds; a single run deviates by 0, an incomplete set is marked."""
    n = F.count("*")
    return runs(spark, sf_dir).groupBy("model").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), n.alias("n"), F.when(n < 3, F.concat(F.lit("(n="), n.cast("string"), F.lit(")"))).otherwise("").alias("note"))


@query(f"with {_SEEDS} select model, case when count(v) = 3 then avg(v) end complete_mean, avg(v) available_mean from runs group by model")
def complete_only_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("model").agg(F.when(F.count("v") == 3, F.avg("v")).alias("complete_mean"), F.avg("v").alias("available_mean"))


@query(f"with {_SEEDS}, g as (select m.model, s.seed from (select distinct model from runs) m, (select unnest([0, 1, 2]) seed) s) select g.model, g.seed, runs.v, case when runs.v is null then '-' else 'ok' end status from g left join runs using (model, seed)")
def expected_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model and seed, measured or not."""
    found = runs(spark, sf_dir)
    seeds = spark.createDataFrame([(0,), (1,), (2,)], "seed int")
    grid = found.select("model").distinct().crossJoin(F.broadcast(seeds))  # three rows
    return measured(grid, found, "model", "seed").select("model", "seed", "v", F.when(F.col("v").isNull(), "-").otherwise("ok").alias("status"))


@query(f"with {_SEEDS} select model, max(v) filter (where seed = 0) s0, max(v) filter (where seed = 1) s1, max(v) filter (where seed = 2) s2, (max(v) filter (where seed = 0) + max(v) filter (where seed = 1)) / 2 single_turn from runs group by model")
def metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = runs(spark, sf_dir).groupBy("model").pivot("seed", [0, 1, 2]).agg(F.max("v"))
    return wide.select("model", F.col("0").alias("s0"), F.col("1").alias("s1"), F.col("2").alias("s2"), ((F.col("0") + F.col("1")) / 2).alias("single_turn"))


@query(f"with {JUDGED_SQL} select domain, avg(quality / 5.0::double) * 100 coverage, avg(cast(quality / 5.0::double >= 0.75 as int)) pass_share, count(*) n from judged group by domain")
def coverage_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("quality") / F.lit(5.0).cast("double")
    return judged(spark, sf_dir).groupBy("domain").agg((F.avg(c) * 100).alias("coverage"), F.avg((c >= 0.75).cast("int")).alias("pass_share"), F.count("*").alias("n"))


@query("select o_orderpriority, round(avg(try_cast(replace(trim(p), '%', '') as double)), 4) mean_percent, count(*) n, count(try_cast(replace(trim(p), '%', '') as double)) n_numbers from (select o_orderpriority, case when o_orderkey % 5 = 0 then 'n/a' else (o_orderkey % 100) || '.5%' end p from orders) group by 1")
def percent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.when(k % 5 == 0, "n/a").otherwise(F.concat((k % 100).cast("string"), F.lit(".5%")))
    n = X.percent(F.col("p"))
    return table(spark, sf_dir, "orders").select("o_orderpriority", p.alias("p")).groupBy("o_orderpriority").agg(F.round(F.avg(n), 4).alias("mean_percent"), F.count("*").alias("n"), F.count(n).alias("n_numbers"))


@query(f"with {_SEEDS}, m as (select model, avg(v) v from runs group by model) select string_agg(rpad(model, 10, ' ') || lpad(printf('%.4f', v), 9, ' '), chr(10) order by model) report from m")
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-width table as one text; a line per model."""
    line = F.concat(F.rpad("model", 10, " "), F.lpad(F.format_string("%.4f", F.col("v")), 9, " "))
    m = runs(spark, sf_dir).groupBy("model").agg(F.avg("v").alias("v")).select("model", line.alias("line"))
    return m.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model", "line"))), lambda x: x["line"]), "\n").alias("report"))


@query("select doc_id, list_distinct([source, 'src1_x']) tools, list_aggregate(list_transform(list_distinct([source, 'src1_x']), lambda t: t in ('src1', 'src2') or starts_with(t, 'src1_') or starts_with(t, 'src2_')), 'bool_and') all_default, not list_contains([lang, 'call'], 'de') none_excluded from documents".replace("list_distinct([source, 'src1_x']) tools", "len(list_distinct([source, 'src1_x'])) n_tools"))
def server_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose tools all belong to given servers, and whose trajectory calls none of the excluded ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.array("source", F.lit("src1_x"))).alias("enabled"), F.to_json(F.array(F.struct(F.array(F.struct(F.struct(F.col("lang").alias("name")).alias("function")), F.struct(F.struct(F.lit("call").alias("name")).alias("function"))).alias("tool_calls")))).alias("trajectory"))
    servers = F.array(F.lit("src1"), F.lit("src2"))
    own = lambda t: F.exists(servers, lambda s: (t == s) | F.startswith(t, F.concat(s, F.lit("_"))))
    tools = F.array_distinct(F.from_json("enabled", "array<string>"))
    calls = F.from_json("trajectory", "array<struct<tool_calls:array<struct<function:struct<name:string>>>>>")
    names = F.flatten(F.transform(calls, lambda m: F.transform(m["tool_calls"], lambda c: c["function"]["name"])))
    return d.select("doc_id", F.size(tools).alias("n_tools"), F.coalesce((F.size(tools) > 0) & F.forall(tools, own), F.lit(False)).alias("all_default"), (~F.arrays_overlap(names, F.array(F.lit("de")))).alias("none_excluded"))


_TOOLS_SQL = ", ".join(f"('{n}', '{f}', {i})" for i, (n, f, _) in enumerate(C.TOOLS))


@query(f"""with tools(name, family, i) as (values {_TOOLS_SQL}), c as (select event_id % {len(C.TOOLS)} i, count(*) n from events group by 1)
select family, count(*) n_tools, count(*) filter (where name not in ({", ".join(f"'{d}'" for d in C.DESTRUCTIVE)})) n_safe, family = '{C.HELD_OUT_FAMILY}' held_out, coalesce(sum(n), 0)::bigint n_calls from tools left join c using (i) group by family""")
def tool_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with their tools, which of them destroy nothing, and how often they are called."""
    named = F.element_at(F.array(*[F.lit(n) for n, _, _ in C.TOOLS]), (F.col("event_id") % len(C.TOOLS) + 1).cast("int"))
    calls = table(spark, sf_dir, "events").groupBy(named.alias("name")).agg(F.count("*").alias("n"))
    t = C.tools(spark).join(calls, "name", "left")
    out = t.groupBy("family").agg(F.count("*").alias("n_tools"), F.count_if(~F.col("name").isin(*C.DESTRUCTIVE)).alias("n_safe"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls"))
    return out.withColumn("held_out", F.col("family") == C.HELD_OUT_FAMILY)


def family_overlap(train: DataFrame, held: DataFrame) -> DataFrame:
    """One row: how many tool names and parameter keys two families share."""
    names = train.select("name").intersect(held.select("name")).agg(F.count("*").alias("name_overlap"))
    keys = train.select(F.explode("params")).intersect(held.select(F.explode("params"))).agg(F.count("*").alias("key_overlap"))
    return names.crossJoin(keys).withColumn("isolated", (F.col("name_overlap") == 0) & (F.col("key_overlap") == 0))  # one row each


def family_overlaps(tools: DataFrame) -> DataFrame:
    """The same for every family held out against all others (held, name_overlap, key_overlap, isolated); null names and keys count for nothing."""
    shared = lambda c, name: (
        tools.select("family", c.alias("x")).where("x is not null").distinct().withColumn("n", F.count("*").over(Window.partitionBy("x"))).where("n > 1").groupBy("family").agg(F.count("*").alias(name))
    )  # a value is one row per family that has it
    out = tools.select("family").distinct().join(shared(F.col("name"), "name_overlap"), "family", "left").join(shared(F.explode("params"), "key_overlap"), "family", "left")
    a, b = F.coalesce("name_overlap", F.lit(0)), F.coalesce("key_overlap", F.lit(0))
    return out.select(F.col("family").alias("held"), a.alias("name_overlap"), b.alias("key_overlap"), ((a == 0) & (b == 0)).alias("isolated"))


def assert_isolated(train: DataFrame, held: DataFrame) -> None:
    """Raise where training would show tools of the held-out family."""
    found = family_overlap(train, held).first()
    if not found["isolated"]:
        raise ValueError(f"families share {found['name_overlap']} tool names and {found['key_overlap']} parameter keys")


@query(f"""with k as (select distinct kind from items where kind is not null),
n as (select k.kind, count(distinct t.name) o from k join items h on h.kind = k.kind join items t on t.name = h.name and t.kind <> k.kind group by k.kind),
p as (select kind, unnest([brand, 'size' || size // 10]) p from items), q as (select h.kind, count(distinct h.p) o from p h join p t on t.p = h.p and t.kind <> h.kind group by h.kind)
select kind held, coalesce(n.o, 0) name_overlap, coalesce(q.o, 0) key_overlap, n.o is null and q.o is null isolated from k left join n using (kind) left join q using (kind)""")
def family_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each kind of items, held out as a family: the names and parameter keys that it shares with the others."""
    i = table(spark, sf_dir, "items").where(F.col("kind").isNotNull()).select(F.col("kind").alias("family"), "name", F.array("brand", F.concat(F.lit("size"), F.floor(F.col("size") / 10).cast("string"))).alias("params"))
    return family_overlaps(i)


@query("select doc_id, case when doc_id % 3 = 2 then 3 else 4 end lo, case when doc_id % 3 = 2 then 3 else 4 end hi from documents")
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(F.lit("/models/Agent-8B/"), F.lit("Simulator-35B"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    requests = table(spark, sf_dir, "documents").select("doc_id", model.alias("model"), F.col("lang").alias("family"))
    sizes = spark.createDataFrame(C.GRAPH_SIZES, "model string, family string, lo int, hi int")
    return C.graph_size(requests, sizes).select("doc_id", "lo", "hi")


@query("""with t as (select doc_id, unnest(['a', 'b', 'c', 'd', 'e', 'f']) tool from documents), r as (select doc_id, tool, row_number() over (partition by doc_id order by md5(doc_id || '|' || tool)) i from t)
select doc_id, 'n' || i node, tool, case when i > 1 then 'n' || (i - 1) end depends_on from r where i <= 3 + doc_id % 2""")
def sampled_tool_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of distinct tools per task, drawn by hash; each node depends on the one before."""
    names = F.array(*[F.lit(x) for x in "abcdef"])
    drawn = F.transform(F.array_sort(F.transform(names, lambda t: F.struct(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), t)).alias("h"), t.alias("t")))), lambda x: x["t"])
    chain = F.slice(drawn, 1, (3 + F.col("doc_id") % 2).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chain).alias("i", "tool"))
    return rows.select("doc_id", F.concat(F.lit("n"), (F.col("i") + 1).cast("string")).alias("node"), "tool", F.when(F.col("i") > 0, F.concat(F.lit("n"), F.col("i").cast("string"))).alias("depends_on"))


@query("select doc_id, coalesce(nullif(string_split(coalesce(t, 'mcp'), '/')[-1], ''), 'mcp') subtask from (select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'bench/' || lang else lang end t from documents)")
def subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    t = F.when(k == 1, F.concat(F.lit("bench/"), "lang")).when(k == 2, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.split(F.coalesce(t, F.lit("mcp")), "/"), -1).alias("subtask"))


@query("""with p as (select conv_id, list(text order by turn) filter (where role = 'user') prompts, list(text order by turn) filter (where role = 'assistant') responses from conversations group by conv_id)
select conv_id, coalesce(prompts[2], '') current_prompt, coalesce(responses[2], '') truth, case when len(prompts) > 0 and len(responses) > 0 then prompts[1] || chr(10) || responses[1] || chr(10) || chr(10) else '' end history from p""")
def turn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current prompt, ground truth and history of the second turn; an index out of range gives an empty text."""
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(of("user").alias("p"), of("assistant").alias("r"))
    at = lambda c, i: F.coalesce(F.try_element_at(c, F.lit(i)), F.lit(""))
    both = F.when((F.size("p") > 0) & (F.size("r") > 0), F.concat(at("p", 1), F.lit("\n"), at("r", 1), F.lit("\n\n"))).otherwise("")
    return p.select("conv_id", at("p", 2).alias("current_prompt"), at("r", 2).alias("truth"), both.alias("history"))
