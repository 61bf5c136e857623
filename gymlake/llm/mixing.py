"""Mixing sources to target weights by Sainte-Lague apportionment.

Tokens are dealt in blocks of equal size. The mix has as many blocks as the
corpus; sources get integer quotas of blocks by highest quotient (votes: their
targets), each source's quota is split in the same way (votes: sizes) over
buckets of shards and each bucket's over its shards, and within a shard a seeded
run of blocks is taken from the documents laid out in seeded order. A quota above
the shard's size takes whole passes over the shard first. Two levels keep every
group that is apportioned at once small, also where one source holds most rows.
Seeds go through MD5 digests, so the mix can be checked in SQL.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gymlake.llm.common import WORD, Scratch, checkpointed

BLOCK = 16
DOCS_PER_SHARD, SHARDS_PER_BUCKET = 1000, 1000
CEILING = 3
#: Up to this many sources (one row each) are apportioned on the driver; beyond, by jobs over their table.
DRIVER_SOURCES = 100_000


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Integer quotas by the highest quotients votes / (2a + 1); ties to the earlier entry.

    Works on the divisor: round(votes / divisor) is the apportionment for any
    divisor that yields `seats`; seats tied at the last divisor go to earlier entries.
    """
    votes = np.asarray(votes, dtype=np.float64)
    out = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return out
    low, high = 0.0, 4.0 * votes.max()  # at high nobody has a seat
    high = max(high, np.nextafter(high, np.inf))
    low = votes.sum() / (seats + len(votes) + 1) / 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if np.floor(votes / middle + 0.5).sum() >= seats:
            low = middle
        else:
            high = middle
    out = np.floor(votes / high + 0.5).astype(np.int64)  # at most `seats`
    missing = seats - int(out.sum())
    while missing > 0:
        quotients = votes / (2 * out + 1)
        order = np.argsort(-quotients, kind="stable")[:missing]
        best = quotients[order[0]]
        take = order[quotients[order] >= best * (1 - 1e-12)] if best > 0 else order
        out[take] += 1
        missing -= len(take)
    return out


def targets(sizes: np.ndarray, weights: np.ndarray, ceiling: int = CEILING) -> np.ndarray:
    """Shares of sum(sizes) by weight, none above ceiling * its size; what is cut is shared again."""
    sizes, weights = np.asarray(sizes, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    out, capped = np.zeros(len(sizes)), sizes <= 0
    left = sizes.sum()
    while not capped.all():
        share = left * weights / weights[~capped].sum()
        over = ~capped & (share > ceiling * sizes)
        if not over.any():
            out[~capped] = share[~capped]
            break
        out[over] = ceiling * sizes[over]
        left -= out[over].sum()
        capped |= over
    return out


def _drawn(*parts) -> Column:
    """32 bits of the MD5 digest of the parts as texts, nulls as they are written here."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), F.lit(8)), 16, 10).cast("long")


def _plan_on_driver(totals: DataFrame, seats: int, block: int, ceiling: int) -> DataFrame:
    sources = totals.toPandas()
    sources["null"] = sources["_source"].isna()
    sources["at"] = [x.encode() if isinstance(x, str) else b"" for x in sources["_source"]]
    sources = sources.sort_values(["null", "at"]).reset_index(drop=True)
    sources["target"] = targets(sources["source_size"].to_numpy(), np.arange(len(sources)) % 3 + 1, ceiling)
    sources["quota"] = np.minimum(apportion(sources["target"].to_numpy(), seats), ceiling * sources["source_size"].to_numpy() // block)
    rows = [(None if r.null else r._1, int(r.source_size), float(r.target), int(r.quota)) for r in sources[["_source", "source_size", "target", "quota", "null"]].itertuples()]
    return totals.sparkSession.createDataFrame(rows, "_source string, source_size long, target double, quota long")


def _plan_by_jobs(totals: DataFrame, seats: int, block: int, ceiling: int) -> DataFrame:
    """The same plan without the sources on the driver: ranks by range partitions, then levels and divisors by bisection.

    Each step of a bisection is one aggregate over a row per source. Targets and
    quotas may differ from the driver's in the last bit and in ties.
    """
    scratch = Scratch(totals.sparkSession)
    order = [F.col("_source").isNull(), F.col("_source")]
    ranged = scratch.table(totals.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    places = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = places.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row per partition
    ranked = ranged.join(before, "_part").withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    ranked = scratch.table(ranked.select("_source", "source_size", "_place", (F.col("_place") % 3 + 1).alias("weight")))
    total, most = ranked.agg(F.sum("source_size"), F.max(F.lit(float(ceiling)).cast("double") * F.col("source_size") / F.col("weight"))).first()

    def bisect(high: float, too_low) -> float:
        low = 0.0
        for _ in range(200):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (middle, high) if too_low(middle) else (low, middle)
        return high

    capped = lambda level: F.least(F.lit(float(ceiling)) * F.col("source_size"), F.lit(level) * F.col("weight"))
    level = bisect(most or 0.0, lambda x: ranked.agg(F.sum(capped(x))).first()[0] < total)
    aimed = scratch.table(ranked.withColumn("target", capped(level)))
    rounded = lambda divisor: F.floor(F.col("target") / F.lit(divisor) + 0.5).cast("long")
    top = aimed.agg(F.max("target")).first()[0] or 0.0
    divisor = bisect(4 * top + 1, lambda x: aimed.agg(F.sum(rounded(x))).first()[0] >= seats)
    dealt = aimed.withColumn("quota", rounded(divisor))
    missing = seats - dealt.agg(F.sum("quota")).first()[0]
    if missing > 0:  # seats tied at the last divisor
        extra = dealt.orderBy((-F.col("target") / (2 * F.col("quota") + 1)), "_place").limit(int(missing)).select(F.col("_place").alias("_got"))
        dealt = dealt.join(extra, F.col("_place") == F.col("_got"), "left").withColumn("quota", F.col("quota") + F.col("_got").isNotNull().cast("long"))
    return scratch.table(dealt.select("_source", "source_size", "target", F.least("quota", F.floor(ceiling * F.col("source_size") / block).cast("long")).alias("quota")))


def _split(name: str, block: int, ceiling: int):
    """Apportion `quota` by `size` over the rows of a group; rows at their ceiling pass seats on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name).reset_index(drop=True)
        size, quota = pdf["size"].to_numpy(), int(pdf["quota"].iloc[0])
        most = ceiling * size // block
        got = np.minimum(apportion(size, quota), most)
        while (missing := quota - int(got.sum())) > 0 and (got < most).any():
            got = np.minimum(got + apportion(np.where(got < most, size, 0), missing), most)
        return pdf[["_source", name, "size", "source_size", "target"]].assign(got=got)

    return run


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK, text: str = "text", source: str = "source", key: str = "doc_id", driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken (words the mix takes), _skip, _shard.

    _skip: the words of the document before the first one taken by the run of its
    shard. Null text or no words: size 0, taken 0. A null source is a source of its
    own, last in order. Repeated rows count each. An empty table gives an empty
    result. Other columns are not read.
    """
    sized = checkpointed(docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))).alias("_order"),
    ))
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    n_sources, total, n = sized.agg(F.countDistinct(F.struct("_source")), F.sum("size"), F.count("*")).first()
    plan = (_plan_on_driver if n_sources <= driver_sources else _plan_by_jobs)(totals, int(round((total or 0) / block)), block, CEILING)
    n_shards = max(1, -(-n // DOCS_PER_SHARD))

    sharded = sized.withColumn("_shard", F.conv(F.left("_order", F.lit(8)), 16, 10).cast("long") % n_shards)
    shards = sharded.groupBy("_source", "_shard").agg(F.sum("size").alias("size")).withColumn("_bucket", F.floor(F.col("_shard") / SHARDS_PER_BUCKET))
    shards = checkpointed(shards)
    buckets = shards.groupBy("_source", "_bucket").agg(F.sum("size").alias("size"))
    same = lambda a, b, *names: functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in ("_source", *names)])
    voted = buckets.join(plan, same(buckets, plan), "inner").select(buckets["_source"], "_bucket", "size", "source_size", "target", "quota")
    dealt = voted.groupBy("_source").applyInPandas(_split("_bucket", block, CEILING), "_source string, _bucket long, size long, source_size long, target double, got long")
    dealt = dealt.select("_source", "_bucket", "source_size", "target", F.col("got").alias("quota"))
    inner = shards.join(dealt, same(shards, dealt, "_bucket"), "inner").select(shards["_source"], shards["_bucket"], "_shard", "size", "source_size", "target", "quota")
    quotas = inner.groupBy("_source", "_bucket").applyInPandas(_split("_shard", block, CEILING), "_source string, _shard long, size long, source_size long, target double, got long")
    quotas = quotas.select("_source", "_shard", F.col("size").alias("shard_size"), "source_size", "target", F.col("got").alias("shard_quota"))

    w = Window.partitionBy("_source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = sharded.withColumn("_end", F.sum("size").over(w))
    joined = laid.join(quotas, same(laid, quotas, "_shard"), "inner").select(
        laid["doc_id"], "size", laid["_source"], laid["_shard"], "shard_size", "source_size", "target", "shard_quota",
        (F.col("_end") - F.col("size")).alias("_begin"), "_end",
    )
    wanted = F.col("shard_quota") * block
    length = F.greatest(F.col("shard_size"), F.lit(1))
    joined = joined.withColumn("_passes", F.floor(wanted / length).cast("long")).withColumn("_rest", wanted - F.col("_passes") * length)
    n_blocks = F.ceil(length / F.lit(block)).cast("long")
    joined = joined.withColumn("_from", (_drawn(F.lit(seed + 2), F.col("_source"), F.col("_shard")) % n_blocks) * block)

    def overlap(lo, hi):
        return F.greatest(F.lit(0), F.least(F.col("_end"), hi) - F.greatest(F.col("_begin"), lo))

    stop = F.col("_from") + F.col("_rest")
    part = overlap(F.col("_from"), F.least(stop, length)) + overlap(F.lit(0), stop - length)
    skip = F.when(overlap(F.col("_from"), F.least(stop, length)) > 0, F.greatest(F.col("_from") - F.col("_begin"), F.lit(0))).otherwise(F.lit(0))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("_passes") * F.col("size") + part).cast("long").alias("taken"), skip.cast("long").alias("_skip"), "_shard")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a text repeated `taken // size` times and then `taken % size` of its words, those in the run of its shard.

    What is cut out keeps its white space. A row of which nothing is taken goes (so do null, empty and blank texts). One row per
    document remains, so doc_id stays a key; n_chars follows the text. Rows that repeat a doc_id and size take the larger share
    each. An empty table gives no rows. Other columns stay, whatever their names.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("key"), F.col("size").alias("size")).agg(F.max(F.struct("taken", "_skip")).alias("t"))
    taken = taken.where("t.taken > 0").select("key", "size", "t.taken", F.col("t._skip").alias("skip"))
    inner, text = docs.toDF(*names), F.col(at["text"])
    whole = F.array_join(F.array_repeat(text, F.floor(F.col("taken") / F.col("size")).cast("int")), "\n")
    rest, skip, size = ((F.col("taken") % F.col("size")).cast("int"), F.col("skip").cast("int"), F.col("size").cast("int"))
    words = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    piece = lambda first, n: F.regexp_replace(F.array_join(F.slice(words, first, n), ""), r"[\x20\x09-\x0D]+$", "")
    over = F.greatest(F.lit(0), skip + rest - size)  # a run that goes round the shard may end at the document it began in
    joint = F.when(over > 0, F.concat_ws("\n", piece(skip + 1, rest), piece(F.lit(1), over))).otherwise(piece(skip + 1, rest))
    new = F.when(rest == 0, whole).when(F.col("taken") < F.col("size"), joint).otherwise(F.concat_ws("\n", whole, joint))
    joined = inner.join(taken, inner[at["doc_id"]].eqNullSafe(taken["key"]) & (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) == taken["size"]), "inner")
    out = joined.withColumn(at["text"], new)
    if "n_chars" in docs.columns:
        out = out.withColumn(names[docs.columns.index("n_chars")], F.length(at["text"]).cast("long"))
    return out.select(*names).toDF(*docs.columns)
