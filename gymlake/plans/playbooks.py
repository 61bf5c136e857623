"""Playbook plans: frontier, history, credit, merging, duplicates, leaks, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gymlake.functions.text import word_count
from gymlake.operators import playbook as B
from gymlake.sources.tables import ENTRIES_SQL, entries, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_AXES = "select source playbook, avg(doc_id % 5) success, avg(doc_id % 7) robustness, avg(doc_id % 3) compact from documents group by source"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("playbook")).agg(F.avg(i % 5).alias("success"), F.avg(i % 7).alias("robustness"), F.avg(i % 3).alias("compact"))


_FRONT = f"""c as ({_AXES}), front as (select * from c where not exists (select 1 from c o where o.success >= c.success and o.robustness >= c.robustness and o.compact >= c.compact
  and (o.success > c.success or o.robustness > c.robustness or o.compact > c.compact)))"""


@query(f"with {_FRONT} select playbook, success, robustness, compact from front")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pareto_frontier(candidates(spark, sf_dir), "playbook", "success", "robustness", "compact")


@query(f"with {_FRONT} select playbook, success + robustness + compact total from front order by total desc, playbook limit 1")
def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = B.pareto_frontier(candidates(spark, sf_dir), "playbook", "success", "robustness", "compact")
    return front.select("playbook", (F.col("success") + F.col("robustness") + F.col("compact")).alias("total")).orderBy(F.col("total").desc(), "playbook").limit(1)


# The history of a playbook: one validation per version, some not evaluated.
_HIST = "hist as (select cast(doc_id % 10 as int) playbook_id, doc_id seq, case when doc_id % 4 <> 0 then (doc_id * 37 % 101) / 100.0::double end utility from documents)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select((i % 10).cast("int").alias("playbook_id"), i.alias("seq"), F.when(i % 4 != 0, (i * 37 % 101) / F.lit(100.0).cast("double")).alias("utility"))


@query(f"with {_HIST} select playbook_id, seq, utility from hist where utility is not null qualify row_number() over (partition by playbook_id order by utility desc, seq) = 1")
def best_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of highest utility."""
    best = history(spark, sf_dir).where("utility is not null").groupBy("playbook_id").agg(F.max_by(F.struct("seq", "utility"), F.struct("utility", -F.col("seq"))).alias("b"))
    return best.select("playbook_id", "b.seq", "b.utility")


@query(f"with {_HIST} select playbook_id, max(seq) seq, max_by(utility, seq) filter (where utility is not null) last_utility from hist group by playbook_id")
def current_playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("utility").isNotNull(), F.col("seq"))
    return history(spark, sf_dir).groupBy("playbook_id").agg(F.max("seq").alias("seq"), F.max_by("utility", known).alias("last_utility"))


@query(f"""with {_HIST}, r as (select *, row_number() over (partition by playbook_id order by seq desc) i from hist where utility is not null)
select playbook_id, count(*) filter (where i <= 4) n, count(*) filter (where i <= 4) = 4 and coalesce(max(utility) filter (where i <= 3) <= max(utility) filter (where i = 4), false) should_stop from r group by playbook_id""")
def stop_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop where none of the last three evaluated utilities beats the one just before them."""
    w = Window.partitionBy("playbook_id").orderBy(F.col("seq").desc())
    r = history(spark, sf_dir).where("utility is not null").withColumn("i", F.row_number().over(w)).where("i <= 4")
    of = lambda c: F.max(F.when(c, F.col("utility")))
    out = r.groupBy("playbook_id").agg(F.count("*").alias("n"), of(F.col("i") <= 3).alias("last"), of(F.col("i") == 4).alias("before"))
    return out.select("playbook_id", "n", ((F.col("n") == 4) & F.coalesce(F.col("last") <= F.col("before"), F.lit(False))).alias("should_stop"))


@query(f"""with {_HIST}, x as (select playbook_id, seq, utility, max(utility) over (partition by playbook_id order by seq) best from hist) select playbook_id, seq, utility + 0.05 >= best kept from x where utility is not null""")
def rollback_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep a version within the tolerance of the best so far; by sequence, since edits keep a playbook's id."""
    w = Window.partitionBy("playbook_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return history(spark, sf_dir).withColumn("best", F.max("utility").over(w)).where("utility is not null").select("playbook_id", "seq", (F.col("utility") + 0.05 >= F.col("best")).alias("kept"))


@query(f"with {_HIST}, x as (select playbook_id, seq, coalesce(utility, 0) u, lag(coalesce(utility, 0)) over (partition by playbook_id order by seq) p from hist) select playbook_id, count(*) filter (where u > p) edits from x group by playbook_id")
def edit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("playbook_id").orderBy("seq")
    u = F.coalesce("utility", F.lit(0.0))
    return history(spark, sf_dir).select("playbook_id", u.alias("u"), F.lag(u).over(w).alias("p")).groupBy("playbook_id").agg(F.count_if(F.col("u") > F.col("p")).alias("edits"))


@query("with i as (select distinct doc_id % 10 playbook, doc_id % 40 it from documents), n as (select playbook, it, row_number() over (partition by playbook order by it) - 1 i, count(*) over (partition by playbook) k from i) select playbook, max(it) filter (where i = k // 2 - 1) mid, max(it) filter (where i = k - 1) last from n group by playbook")
def checkpoint_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle and the last checkpoint, by number."""
    i = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("playbook"), (F.col("doc_id") % 40).alias("it")).distinct()
    n = i.select("playbook", "it", (F.row_number().over(Window.partitionBy("playbook").orderBy("it")) - 1).alias("i"), F.count("*").over(Window.partitionBy("playbook")).alias("k"))
    return n.groupBy("playbook").agg(F.max(F.when(F.col("i") == F.floor(F.col("k") / 2) - 1, F.col("it"))).alias("mid"), F.max(F.when(F.col("i") == F.col("k") - 1, F.col("it"))).alias("last"))


@query("with a as (select doc_id, source arm, md5(text) fp from documents) select fp, min(doc_id) pos, string_agg(arm, '+' order by doc_id) label, count(*) n from a group by fp")
def arm_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms with one fingerprint become one arm, labelled by all."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("arm"), F.md5("text").alias("fp"))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "arm"))), lambda x: x["arm"]), "+")
    return a.groupBy("fp").agg(F.min("doc_id").alias("pos"), label.alias("label"), F.count("*").alias("n"))


@query("with a as (select md5(text) fp, string_agg(source, '+' order by doc_id) label from documents group by 1) select count(*) n from a where list_contains(string_split(label, '+'), 'src3')")
def arm_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_dedupe(spark, sf_dir).where(F.array_contains(F.split("label", r"\+"), "src3")).agg(F.count("*").alias("n"))


@query(f"""with {ENTRIES_SQL}, c as (select distinct user_id % 1000 entry_id, event_id % 50 step, case when event_type in ('purchase', 'signup') then 'helpful' else 'harmful' end kind from events),
p as (select entry_id, count(*) filter (where kind = 'helpful') h, count(*) filter (where kind = 'harmful') b from c group by entry_id)
select entry_id, helpful + coalesce(h, 0) helpful, harmful + coalesce(b, 0) harmful, helpful + coalesce(h, 0) - harmful - coalesce(b, 0) utility from entries left join p using (entry_id)""")
def credit_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "helpful").otherwise("harmful")
    credits = table(spark, sf_dir, "events").select((F.col("user_id") % 1000).alias("entry_id"), (F.col("event_id") % 50).alias("step"), kind.alias("kind"))
    out = B.apply_credit(entries(spark, sf_dir).select("entry_id", F.col("helpful").cast("long").alias("helpful"), F.col("harmful").cast("long").alias("harmful")), credits)
    return out.withColumn("utility", F.col("helpful") - F.col("harmful"))


@query(f"""with {ENTRIES_SQL}, x as (select * from entries where playbook_id < 6), y as (select entry_id, cast(pos + 1 as bigint) pos, tag, content, cast(helpful + 1 as int) - (entry_id % 2) helpful, harmful, cast(entry_version + entry_id % 3 - 1 as int) entry_version from entries where playbook_id > 3)
select entry_id, case when t then y.pos else x.pos end pos, case when t then y.helpful else cast(x.helpful as bigint) end helpful, case when t then y.entry_version else x.entry_version end entry_version, x.entry_id is null is_new
from (select coalesce(x.entry_id, y.entry_id) entry_id, x.entry_id is null or (y.entry_id is not null and row(y.helpful - y.harmful, y.entry_version) > row(cast(x.helpful - x.harmful as bigint), x.entry_version)) t, x, y from x full join y on x.entry_id = y.entry_id)""")
def playbook_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumn("helpful", F.col("helpful").cast("long"))
    a = e.where("playbook_id < 6").select("entry_id", "pos", "helpful", "harmful", "entry_version")
    b = e.where("playbook_id > 3").select(
        "entry_id", (F.col("pos") + 1).alias("pos"), (F.col("helpful") + 1 - F.col("entry_id") % 2).alias("helpful"), "harmful", (F.col("entry_version") + F.col("entry_id") % 3 - 1).cast("int").alias("entry_version")
    )
    return B.merge_playbooks(a, b).select("entry_id", "pos", "helpful", "entry_version", "is_new")


@query(f"with {ENTRIES_SQL}, w as (select playbook_id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) n from entries) select playbook_id, coalesce(avg(greatest(0, 1 - n / 4000.0::double)), 1) compactness, sum(n) n_words from w group by playbook_id".replace("'\\s+'", r"'[ \t\n\r\f\x0b]+'"))
def compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = entries(spark, sf_dir).select("playbook_id", word_count(F.col("content")).alias("n"))
    return w.groupBy("playbook_id").agg(B.compactness(F.col("n"), 4000).alias("compactness"), F.sum("n").alias("n_words"))


@query(f"with {ENTRIES_SQL} select md5(tag || entry_id % 3) merge_id, sum(helpful) helpful, sum(harmful) harmful, max(entry_version) + 1 as \"version\", min(pos) created, list(entry_id order by entry_id) provenance from entries group by 1")
def credit_sum_on_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.concat("tag", (F.col("entry_id") % 3).cast("string")))
    return entries(spark, sf_dir).groupBy(key.alias("merge_id")).agg(
        F.sum("helpful").alias("helpful"), F.sum("harmful").alias("harmful"), (F.max("entry_version") + 1).alias("version"), F.min("pos").alias("created"), F.array_sort(F.collect_list("entry_id")).alias("provenance")
    )


@query(f"with {ENTRIES_SQL}, f as (select playbook_id, tag, min(pos) p from entries group by 1, 2) select playbook_id, list(tag order by p) tags from f group by playbook_id")
def ordered_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = entries(spark, sf_dir).groupBy("playbook_id", "tag").agg(F.min("pos").alias("p"))
    return first.groupBy("playbook_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "tag"))), lambda x: x["tag"]).alias("tags"))


@query(f"""with {ENTRIES_SQL}, l as (select playbook_id, tag, min(pos) p, string_agg('- [' || entry_id || '] +' || helpful || '/-' || harmful, chr(10) order by pos) b from entries group by 1, 2)
select playbook_id, string_agg('## ' || tag || chr(10) || b, chr(10) order by p) rendered from l group by playbook_id""")
def rendered_playbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by tag, tags in order of first appearance."""
    line = F.concat(F.lit("- ["), F.col("entry_id").cast("string"), F.lit("] +"), F.col("helpful").cast("string"), F.lit("/-"), F.col("harmful").cast("string"))
    ordered = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v.alias("v")))), lambda x: x["v"]), "\n")
    tags = entries(spark, sf_dir).groupBy("playbook_id", "tag").agg(F.min("pos").alias("p"), ordered("pos", line).alias("b"))
    return tags.groupBy("playbook_id").agg(ordered("p", F.concat(F.lit("## "), "tag", F.lit("\n"), "b")).alias("rendered"))


_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2))"


@query(rf"""with {ENTRIES_SQL}, s as (select entry_id, pos, {_TOK.format('content')} t from entries), p as (
  select n.entry_id new_id, o.entry_id, o.pos, len(list_intersect(n.t, o.t)) / cast(len(n.t) + len(o.t) - len(list_intersect(n.t, o.t)) as double) j from s n, s o where n.entry_id % 20 = 0 and o.entry_id <> n.entry_id and len(n.t) > 0 and len(o.t) > 0)
select new_id, max_by(entry_id, row(j, -pos)) entry_id, max(j) similarity from p where j >= 0.7 group by new_id""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose id is divisible by 20 proposed anew, against all others."""
    e = entries(spark, sf_dir)
    return B.near_duplicates(e, e.where("entry_id % 20 = 0"))


@query(f"with {ENTRIES_SQL}, terms as (select distinct lower(text) term from benchmark where length(text) > 3) select entry_id, count(*) n_terms from entries, terms where contains(lower(tag || ' ' || content), term) group by entry_id")
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose tag or content holds a forbidden term.

    Candidates share a term's first five words; containment is then checked. A
    term of fewer words is looked for everywhere, and such terms are a short list.
    """
    terms = table(spark, sf_dir, "benchmark").where(F.length("text") > 3).select(F.lower("text").alias("term")).distinct()
    e = entries(spark, sf_dir).select("entry_id", F.lower(F.concat("tag", F.lit(" "), "content")).alias("h"))
    words = lambda c: F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    # the first and last word of a term may be cut out of longer words, so the key takes words 2 to 6
    keyed = terms.withColumn("w", words(F.col("term"))).withColumn("key", F.when(F.size("w") >= 7, F.array_join(F.slice("w", 2, 5), " ")))
    grams = e.withColumn("w", words(F.col("h"))).select("entry_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 5), " "))).alias("key"))
    found = grams.join(keyed.where("key is not null").select("key", "term"), "key").select("entry_id", "term").distinct().join(e, "entry_id").where(F.col("h").contains(F.col("term")))
    short = e.join(keyed.where("key is null").select("term"), F.col("h").contains(F.col("term")))
    return found.select("entry_id", "term").union(short.select("entry_id", "term")).groupBy("entry_id").agg(F.count("*").alias("n_terms"))


@query(None)
def playbook_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of add, update, merge and remove, in order; each entry yields one of them."""
    e = entries(spark, sf_dir)
    ops = e.select(
        "playbook_id", F.col("pos").alias("batch_pos"),
        F.element_at(F.array(F.lit("add"), F.lit("update"), F.lit("merge"), F.lit("remove")), (F.floor(F.col("entry_id") / 10) % 4 + 1).cast("int")).alias("op"),
        F.when((F.floor(F.col("entry_id") / 10) % 4 == 2) | (F.col("entry_id") % 70 < 10), F.array(F.col("entry_id"), F.col("entry_id") + 20)).otherwise(F.array("entry_id")).alias("entry_ids"), "tag", F.concat(F.lit("new rule "), "content").alias("content"),
    )
    return B.apply_edits(e, ops)
