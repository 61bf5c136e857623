"""URL filters: rules given by hand, and association rules mined from labelled URLs, in DataFrame operations only.

A URL is a set of tokens: its host's labels, the words of its path, the words of
what follows, with runs of digits as one 0. FP-growth mines the sets of tokens
that are frequent among labelled URLs; those that go with bad ones often enough
(support) and nearly always (confidence) are the rules. No token and no set is
left out: MLlib's FP-growth takes the sets of URLs with few tokens, and what long
URLs have beyond that grows from conditional bases. A rule stands in an
inverted index under its rarest token; URLs meet the rules of their tokens there,
and those whose tokens they all have decide. URLs with the same tokens are judged
once, so a host with a third of all URLs is a few sets.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch

#: A rule needs so many bad URLs, and this share of the labelled ones; it must be right for this share of those that it fits.
MIN_BAD, MIN_SHARE, CONFIDENCE = 10, 0.002, 0.8
#: MLlib's FP-growth gets the commonest frequent tokens of a labelled URL, so many, for it makes all sets of them. Sets whose rarest token stands before these in any URL are grown.
TOKENS = 12
#: Rules up to this number are broadcast, more are joined by their token.
BROADCAST_RULES = 50_000
BAD = "=bad"
#: Digits of the number that an item begins with.
DIGITS = 19


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and the rest; all empty without `://`, and for null."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    behind = F.substr(after, F.length(host) + 1)
    path = F.regexp_extract(behind, r"^[^?#]*", 0)
    return lower_ascii(host), path, F.substr(behind, F.length(path) + 1)


def words(c: Column, kind: str) -> Column:
    """Words of ASCII letters, digits and whatever is not ASCII, each with its kind; runs of digits are one 0."""
    split = F.split(F.regexp_replace(lower_ascii(c), "[0-9]+", "0"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.transform(F.filter(split, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))


def tokens(host: Column, path: Column, rest: Column) -> Column:
    labels = F.transform(F.filter(F.split(F.regexp_replace(host, "[0-9]+", "0"), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    return F.array_sort(F.array_distinct(F.concat(labels, words(path, "p"), words(rest, "q"))))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, of those as long the one with the longer host, then the one that blocks; null if none. rules: (verdict, host/path)."""
    placed = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0] != "block", r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(placed):
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grow(baskets: DataFrame, first: DataFrame, least: int, scratch: Scratch) -> list[DataFrame]:
    """Sets (items, bad, good) of two and more tokens that hold one of first (item, good) as their first, from baskets (items in order, bad, good).

    Pattern growth: the base of a set is what follows it in the baskets that hold it, equal ones once with their numbers; a set grows by
    the tokens of its base, all sets of a length in one step. Only sets with `least` bad URLs of which every token excludes a good one:
    without a token that excludes none a set is as sure, so such a set is no rule, nor is any that holds it.
    """
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    base = baskets.select("items", "bad", "good", F.posexplode("items").alias("at", "item")).join(first.select("item"), "item")
    base = base.select(F.array("item").alias("items"), rest.alias("rest"), "bad", "good").where(F.size("rest") > 0)
    known, size, out = first.select(F.array("item").alias("items"), "good"), 1, []
    while True:
        base = scratch.table(base.groupBy("items", "rest").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
        size += 1
        longer = base.select("items", F.explode("rest").alias("item"), "bad", "good").groupBy("items", "item").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        longer = longer.where(F.col("bad") >= least).select(F.concat("items", F.array("item")).alias("items"), "bad", "good")
        fewer = longer.select("*", F.explode(F.slice("items", 2, size)).alias("one")).withColumn("fewer", F.array_remove("items", F.col("one")))
        fewer = fewer.join(known.select(F.col("items").alias("fewer"), F.col("good").alias("before")), "fewer").where(F.col("before") > F.col("good"))
        known = scratch.table(fewer.groupBy("items", "bad", "good").agg(F.count("*").alias("n")).where(F.col("n") == size - 1).drop("n"))
        if known.isEmpty():
            return out
        out.append(known)
        alive = known.where(F.col("good") > 0).select(F.slice("items", 1, size - 1).alias("items"), F.element_at("items", -1).alias("item")).groupBy("items").agg(F.collect_list("item").alias("alive"))
        base = base.join(alive, "items").select("items", F.array_intersect("rest", "alive").alias("rest"), "bad", "good")
        base = base.select("items", "rest", "bad", "good", F.posexplode("rest").alias("at", "item"))
        base = base.select(F.concat("items", F.array("item")).alias("items"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "bad", "good").where(F.size("rest") > 0)


def frequent_sets(baskets: DataFrame, least: int, scratch: Scratch) -> list[DataFrame]:
    """Sets (items, bad, good) of two and more of the last TOKENS items that `least` bad baskets (items in order, bad) hold, by FP-growth."""
    m = baskets.count()
    if m < least:
        return []
    last = F.slice(F.reverse("items"), 1, TOKENS)
    last = baskets.select(F.when(F.col("bad"), F.concat(last, F.array(F.lit(BAD)))).otherwise(last).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m).fit(last).freqItemsets
    frequent = scratch.table(frequent.select(F.array_sort("items").alias("items"), "freq"))
    hits = frequent.where(F.array_contains("items", BAD) & (F.size("items") > 2)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("bad"))
    return [hits.join(frequent.select("items", F.col("freq").alias("seen")), "items").select("items", "bad", (F.col("seen") - F.col("bad")).alias("good"))]


def mine(labelled: DataFrame, scratch: Scratch, min_bad: int = MIN_BAD, min_share: float = MIN_SHARE, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (items, bad, seen, confidence) from labelled (url, tokens, bad: boolean).

    A URL with the same label counts once however often it is logged; one with both labels counts for both. Rows without a label or
    tokens teach nothing. Without labels there are no rules. A rule goes if one with one token less is at least as sure. So tokens of
    no good URL and those of all good ones stand alone in rules; larger sets are made of the others, of all that a URL has.
    """
    once = scratch.table(labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).groupBy("url", "bad").agg(F.min("tokens").alias("tokens")))
    n, clean = once.agg(F.count("*"), F.count_if(~F.col("bad"))).first()
    least = max(min_bad, -(-int(n * min_share * 1_000_000) // 1_000_000))
    counts = once.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).where(F.col("bad") >= least)
    number = F.lpad((F.col("bad") + F.col("good")).cast("string"), DIGITS, "0")  # items sort from the rarest token to the commonest
    counts = scratch.table(counts.select("token", F.concat(number, "token").alias("item"), "bad", "good"))
    joint = counts.where((F.col("good") > 0) & (F.col("good") < clean)).select("token", "item", "good")
    baskets = once.select("url", "bad", F.explode("tokens").alias("token")).join(joint, "token").groupBy("url", "bad").agg(F.array_sort(F.collect_list("item")).alias("items"))
    baskets = scratch.table(baskets.select("items", "bad"))
    larger = frequent_sets(baskets, least, scratch)
    wide = baskets.where(F.size("items") > TOKENS).select(F.explode(F.slice("items", 1, F.size("items") - TOKENS)).alias("item")).distinct()
    wide = scratch.table(joint.join(wide, "item").select("item", "good"))
    if not wide.isEmpty():
        larger = [s.join(wide.select("item"), F.array_min("items") == F.col("item"), "left_anti") for s in larger]
        weighted = baskets.groupBy("items").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
        larger += grow(weighted, wide, least, scratch)
    sets = counts.select(F.array("item").alias("items"), "bad", "good")
    for more in larger:
        sets = sets.unionByName(more)
    seen = F.col("bad") + F.col("good")
    plain = F.array_sort(F.transform("items", lambda x: F.substr(x, F.lit(DIGITS + 1))))
    sure = sets.select(plain.alias("items"), "bad", seen.alias("seen"), (F.col("bad") / seen).alias("confidence")).where(F.col("confidence") >= confidence)
    sure = scratch.table(sure)
    smaller = sure.select(F.col("items").alias("_items"), F.col("confidence").alias("_confidence"))
    without = sure.select("items", "confidence", F.explode("items").alias("one")).select("items", "confidence", F.array_remove("items", F.col("one")).alias("fewer"))
    needless = without.join(smaller, (F.col("fewer") == F.col("_items")) & (F.col("_confidence") >= F.col("confidence"))).select("items").distinct()
    return scratch.table(sure.join(needless, "items", "left_anti"))


def index(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Rules by their rarest token among `known` sets of tokens."""
    each = rules.select("items", F.explode("items").alias("token"))
    counts = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "token", "left").groupBy("items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    return rules.join(rarest, "items")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, confidence) of the distinct sets of tokens that hold a rule, with the surest one's confidence."""
    posted = index(rules, sets)
    posted = F.broadcast(posted) if rules.count() <= BROADCAST_RULES else posted  # counted
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(posted, "token")
    return met.where(F.size(F.array_except("items", "tokens")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame, scratch: Scratch, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, confidence of each row of pages (key, url).

    Where a rule fits, its verdict holds. The rest is blocked if an association rule fits (confidence: of the surest) and allowed
    otherwise. These are mined from URLs that a rule decides, and from others with a row in labels (key, bad). A null url and one
    without `://` have no host, path or tokens and are allowed; rows without key or with the same key are judged each.
    """
    host, path, rest = parts(F.col("url"))
    split = pages.select(F.col(key), "url", host.alias("host"), path.alias("path"), rest.alias("rest"))
    split = split.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"))
    told = labels.where(F.col(key).isNotNull() & F.col("bad").isNotNull()).groupBy(key).agg(F.max("bad").alias("told"))
    labelled = split.join(told, key, "left").select("url", "tokens", F.coalesce(F.col("fit.verdict") == "block", F.col("told")).alias("bad"))
    mined = mine(labelled, scratch)
    sets = scratch.table(split.where(F.col("fit").isNull() & (F.size("tokens") > 0)).select("tokens").distinct())
    found = match(sets, mined).select(F.col("tokens").alias("_tokens"), "confidence")
    open_ = F.when(F.col("fit").isNull(), F.col("tokens"))
    judged = split.withColumn("_open", open_).join(found, F.col("_open") == F.col("_tokens"), "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.select(key, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "confidence")
