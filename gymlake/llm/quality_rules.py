"""Risk-controlled quality rules, in DataFrame operations only.

Each rule rejects a document whose feature lies above a cutoff. A cutoff is not
chosen by hand: on labelled documents, within each stratum, a fixed sequence of
settings is tested. It goes through the rules in the order given and through each
rule's cutoffs from the mildest on, keeping what earlier rules have reached. The
test of a setting is exact: with k of n good documents rejected by any rule of
it, P(X <= k) for X ~ Binomial(n, RISK) must be at most the level, which proves
the false-rejection rate to be under RISK (the Clopper-Pearson bound). A sequence
stops at the first setting that fails, so one level serves it whole, and the
levels of the strata add up to DELTA (Bonferroni). With probability 1 - DELTA no
stratum loses more than RISK of its good documents to these rules. A stratum
needs ln(level) / ln(1 - RISK), that is 122, good labels to get a cutoff; with
fewer it loses none.

Strata are bands of length, two at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gymlake.functions.stats import binomial_tail
from gymlake.llm.common import checkpointed

SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
RISK, DELTA = 0.03, 0.05
STRATA = (200,)  # a document's stratum: how many of these its word count reaches
#: rule: cutoffs from mild to strict, in the order of the tests. Features are shares or counts per word.
RULES = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_share": (0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.16, 0.14, 0.12, 0.1),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
}


def _distinct(x: Column) -> Column:
    return F.size(F.array_distinct(x))


def features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row.

    Null, empty and blank texts have no words and all counts 0. 8-word windows
    are compared by 64-bit digests within their document. Work goes with the
    length of the text (n log n where windows repeat).
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select(
        "doc_id",
        F.array_remove(F.split("t", SPACES), "").alias("words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    base = base.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - _distinct(F.col("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    empty = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(0), F.size("h") - WINDOW)
    base = base.withColumn("windows", F.when(F.size("h") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))).otherwise(empty)).drop("h")
    sorted_windows = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    base = base.withColumn("s", F.when(_distinct(F.col("windows")) < F.size("windows"), sorted_windows)).drop("windows")
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    twice = F.filter("s", lambda x, i: same(F.get("s", i - 1), x) | same(F.get("s", i + 1), x))
    base = base.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("s")
    steps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x) + WINDOW
    return base.withColumn("n_repeat_words", F.when(F.col("p").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("p")


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")


def _ready(docs: DataFrame, text: str, key: str) -> DataFrame:
    f = features(docs, text, key)
    return f.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        sum((F.col("n_words") >= n).cast("int") for n in STRATA).alias("stratum"),
        _per("n_symbols", "n_words").alias("symbols_per_word"), _per("n_dup_lines", "n_lines").alias("dup_line_share"), _per("n_repeat_words", "n_words").alias("repeat_share"),
    )


def settings() -> list[tuple[int, str, float, str]]:
    """(step, rule, cutoff, condition): the sequence of tests; condition: any rule of the setting rejects."""
    out, before = [], []
    for rule, cuts in RULES.items():
        out += [(rule, cut, " or ".join([*before, f"{rule} > {cut}"])) for cut in cuts]
        before.append(f"{rule} > {cuts[-1]}")
    return [(step, *x) for step, x in enumerate(out)]


def cutoffs(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the last cutoff of each rule that the sequence of tests reaches; good: features of good documents.

    One partial aggregate counts all cutoffs at once; what follows has a row per stratum, rule and cutoff.
    """
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.expr(rejects)).alias(f"k_{step}") for step, _, _, rejects in settings()])
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(cut).alias("cutoff"), F.col(f"k_{step}").alias("k")) for step, rule, cut, _ in settings()]))
    rows = counts.select("stratum", "n", each.alias("x")).select("stratum", "n", "x.*")
    passes = (F.col("k") < risk * F.col("n")) & (binomial_tail(F.col("k"), F.col("n"), risk) <= delta / (len(STRATA) + 1))
    w = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("passes", passes).withColumn("held", F.min("passes").over(w)).where("held")
    return held.groupBy("stratum", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: counts, base_failed, kept, and the first rule that rejects (null: none).

    labels (doc_id, quality) calibrates: a document counts as good where all its
    labels are 1. Unlabelled rows are judged alike. Without labels nothing but
    the base rules rejects. Null and empty texts fail the base rules. Repeated
    rows are judged each. Other columns are not read.
    """
    ready = checkpointed(_ready(docs, text, key))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("_q")).where("_q = 1").select("doc_id")
    chosen = cutoffs(ready.where(~F.col("base_failed")).join(marked, "doc_id", "left_semi"))
    # at most one row per stratum, of which there are len(STRATA) + 1
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"c_{rule}") for rule in RULES])
    joined = ready.join(F.broadcast(wide), "stratum", "left")
    broken = F.coalesce(*[F.when(F.col(rule) > F.col(f"c_{rule}"), F.lit(rule)) for rule in RULES])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & broken.isNull()).alias("kept"), broken.alias("rule"),
    )
