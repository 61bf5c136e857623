"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct 5-word shingles (tokens). Two sets with
Jaccard similarity of 4/5 or more share all but t(n) = n - ceil(4n/5) tokens of
the smaller or larger one of size n. Tokens are ordered the same way everywhere:
rare ones first, frequent ones last, by digest within. A prefix is the shortest
run from the start whose *weight* exceeds t(n), where a rare token weighs 1 and
frequent tokens weigh one less than their number in each of several classes.
Similar sets then share, within their prefixes, a rare token or two frequent
tokens of one class: otherwise the set whose prefix ends first would lack more
than t(n) of its tokens in the other. So the index holds single rare tokens and
pairs of frequent ones, and nothing is lost. The number of classes goes with the
size band of the pair (a factor of 4); a set near the upper end of a band also
enters the next one. Sets under 64 tokens index single tokens only.

Which tokens are frequent is counted over all documents: a task counts its own
tokens first and ships sorted, delta-coded 40-bit digests, about 3 bytes a token,
so a token of every document is one entry a flush. Frequent tokens are ordered
by the logarithm of their count, so the commonest come last and seldom lie in a
prefix. Up to MAX_FREQUENT of them are broadcast; beyond, their occurrences are
found by a join, with the same index as result.

Candidates of an index entry with up to SMALL documents are all its pairs,
filtered by size and, where both prefixes are of rare tokens, by the number of
shared ones. Larger entries are of frequent tokens: a pair found there alone
shares no rare token, so the rare ones of each bound its similarity from above,
and documents that share a passage but little else drop out. The rest is handled
in rounds: first the entry's smallest document is compared with those not yet in
its component, then leaves the entry; what is left of entries that hold several
components then takes the pairs across components, at first for a slice of its
documents. So a group of g copies takes about g checks, not g * g, and no link
between components is missed. Every candidate is verified on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch, bounded_batches, release, tidy
from gymlake.llm.components import components
from gymlake.llm.kernel import LOWER, U, Words, chunks, mix, mix_int, powers, signed, windows

SHINGLE = 5
RARE_MOST = 24
SMALL = 32
#: Up to this many frequent tokens (9 bytes each) are broadcast.
MAX_FREQUENT = 1_000_000
FIRST_BAND = 64
COUNT_BITS = 40
FLUSH = 1_000_000
BUCKET_BYTES = 16 << 20
STARS, SLOTS = 1, 960
#: Tables of ids with no more rows than this are broadcast; longer ones are joined by shuffling.
BROADCAST_ROWS = 250_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each document's sorted distinct shingle digests; fewer words than k make one shingle, none make none."""
    words = Words(data, offsets)
    h, first = words.digests(LOWER), words.first
    all_windows, short = windows(h, k, salt=5), powers(k, U(mix_int(99) | 1))
    out = []
    for d in range(len(offsets) - 1):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= k:
            out.append(np.unique(all_windows[lo : hi - k + 1]))
        elif hi > lo:
            out.append(mix(np.array([(h[lo:hi] * short[: hi - lo]).sum(dtype=np.uint64) ^ U(mix_int(int(hi - lo)))], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def allowed(n: int) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - (4 * n + 4) // 5


def band_of(n: int) -> int:
    return 0 if n < FIRST_BAND else (int(n // FIRST_BAND).bit_length() + 1) // 2


def classes_of(band: int) -> int:
    return FIRST_BAND * 4 ** (band - 1) // 8


def signatures(tokens: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """(index entries, tokens in the prefix that no frequent entry stands for, whether all entries are single rare tokens) of a sorted set.

    grade: of each token, 0 if it is rare, else higher the commoner it is.
    """
    n = len(tokens)
    need = allowed(n) + 1
    rare = tokens[grade == 0]
    if len(rare) >= need:
        return rare[:need], need, True
    often, entries = tokens[np.argsort(grade, kind="stable")[len(rare) :]], [rare]
    for band in {band_of(n), band_of(n * 5 // 4)}:
        tag = U(mix_int(1000 + band))
        if band == 0:
            entries.append(mix(often[: need - len(rare)] ^ tag))
            continue
        kind = mix(often ^ tag) % U(classes_of(band))
        order = np.argsort(kind, kind="stable")
        begins = np.flatnonzero(np.diff(kind[order], prepend=kind[order][:1] + U(1)))
        place = np.empty(len(often), np.int64)
        place[order] = np.arange(len(often)) - np.repeat(begins, np.diff(np.append(begins, len(often))))
        weight = len(rare) + np.cumsum(place > 0)
        end = int(np.searchsorted(weight, need)) + 1
        chosen, group = often[:end], kind[:end]
        order = np.argsort(group, kind="stable")
        chosen, group = chosen[order], group[order]
        step = 1
        while step < len(chosen):  # members of a class lie side by side: pairs at distance 1, 2, ...
            same = group[step:] == group[:-step]
            if not same.any():
                break
            entries.append(mix((chosen[:-step][same] * U(0x9E3779B97F4A7C15)) ^ mix(chosen[step:][same] ^ tag)))
            step += 1
    return np.concatenate(entries), len(rare), False


def _count(buckets: int):
    shift, bits = U(64 - COUNT_BITS), int(buckets).bit_length() - 1
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def flush(held):
        x, n = np.unique(np.concatenate(held) >> shift, return_counts=True)
        owner = (x >> U(COUNT_BITS - bits)).astype(np.int32)
        cuts = np.searchsorted(owner, np.arange(buckets + 1))
        names, blobs = [], []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own, counts = x[cuts[b] : cuts[b + 1]], n[cuts[b] : cuts[b + 1]]
            gaps, many = np.diff(own, prepend=U(0)).astype("<u8"), np.flatnonzero(counts > 1)
            width = max(1, -(-int(gaps.max()).bit_length() // 8))
            planes = gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
            names.append(b)
            blobs.append(np.array([width, len(own)], "<u4").tobytes() + planes + np.concatenate([many, counts[many]]).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                sets = shingle_sets(data, offsets)
                held.extend(sets)
                n += sum(map(len, sets))
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return tidy(run)


def _read_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, n = np.frombuffer(blob, "<u4", 2).tolist()
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(blob, np.uint8, width * n, 8).reshape(width, n).T
    many, counts = np.frombuffer(blob, "<u4", offset=8 + width * n).reshape(2, -1)
    out = np.ones(n, np.int64)
    out[many] = counts
    return np.cumsum(gaps.view("<u8").ravel()), out


def _merge(least: int):
    """Of a bucket's blobs, the tokens that more than `least` documents hold. A token is there once a flush, however many documents hold it."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_read_counts(blob.as_py()) for blob in table.column("blob")]
        token, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(token, kind="stable")
        token, n = token[order], n[order]
        begin = np.flatnonzero(np.diff(token, prepend=token[:1] + U(1)))
        token, n = token[begin], np.add.reduceat(n, begin)
        often = n > least
        return pa.table({"token": pa.array(token[often].astype(np.int64)), "n": pa.array(n[often])})

    return run


def frequent_tokens(narrow: DataFrame, scratch: Scratch, least: int = RARE_MOST) -> DataFrame:
    """(token, n), written: the 40-bit digests of the tokens that more than `least` documents hold."""
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, 1 << int(size // BUCKET_BYTES).bit_length())
    return scratch.table(narrow.select("text").mapInArrow(_count(buckets), "bucket int, blob binary").groupBy("bucket").applyInArrow(_merge(least), "token long, n long"))


def _grade(n: np.ndarray) -> np.ndarray:
    return (np.log2(n) * 4).astype(np.uint8) + np.uint8(1)


def _occurrences(batches):
    """(doc_id, token) of all distinct tokens, as 40-bit digests."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1), 256 << 10):
            sets = [np.unique(s >> U(64 - COUNT_BITS)) for s in shingle_sets(data, offsets)]
            ids = np.repeat(np.asarray(batch.column(0).slice(lo, hi - lo)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).astype(np.int64))], ["doc_id", "token"])


def _index(shared=None):
    """Index entries of each document. shared: sorted frequent tokens and their grades; else they stand in columns 2 and 3."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(("doc_id", "n", "slack", "pure", "d1", "d2", "entries"), types, strict=True)))

    def grades(tokens: np.ndarray, often: np.ndarray, grade: np.ndarray) -> np.ndarray:
        if not len(often) or not len(tokens):
            return np.zeros(len(tokens), np.uint8)
        short = tokens >> U(64 - COUNT_BITS)
        at = np.minimum(np.searchsorted(often, short), len(often) - 1)
        return np.where(often[at] == short, grade[at], np.uint8(0))

    def own(batch, row):
        if not batch.column(2)[row].is_valid:
            return np.empty(0, np.uint64), np.empty(0, np.uint8)
        often, n = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (2, 3))
        order = np.argsort(often)
        return often[order].astype(np.uint64), _grade(n[order])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                grade = grades(flat, *shared.value) if shared else np.concatenate([grades(s, *own(batch, lo + d)) for d, s in enumerate(sets)])
                rows, begin, other = [], 0, mix(flat ^ U(0x243F6A8885A308D3))
                for tokens in sets:
                    n = len(tokens)
                    end = begin + n
                    entries, prefix, pure = signatures(tokens, grade[begin:end]) if n else (tokens, 0, True)
                    digests = mix(np.array([tokens.sum(dtype=np.uint64), other[begin:end].sum(dtype=np.uint64)], np.uint64) ^ U(n))
                    rows.append((int(n), int(n - prefix), pure, *signed(digests).tolist(), signed(entries)))
                    begin = end
                columns = list(zip(*rows, strict=True))
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[-1]])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(columns[-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(columns[:-1], types[1:-1], strict=True)), lists], schema=schema)

    return tidy(run)


INDEX = "doc_id long, n long, slack long, pure boolean, d1 long, d2 long, entries array<long>"


def indexed(narrow: DataFrame, frequent: DataFrame, most: int = MAX_FREQUENT) -> DataFrame:
    """Index entries of each row of narrow (doc_id, text), with the frequent tokens broadcast if there are at most `most`, else joined."""
    if frequent.count() <= most:
        got = frequent.toPandas().sort_values("token")
        shared = narrow.sparkSession.sparkContext.broadcast((got["token"].to_numpy().astype(np.uint64), _grade(got["n"].to_numpy())))
        return narrow.mapInArrow(_index(shared), INDEX)
    found = narrow.where("doc_id is not null").mapInArrow(_occurrences, "doc_id long, token long").join(frequent, "token")
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("token", "n"))).alias("found"))  # no more than a document has tokens
    joined = narrow.join(lists, "doc_id", "left").select("doc_id", "text", F.col("found.token").alias("often"), F.col("found.n").alias("n"))
    return joined.mapInArrow(_index(), INDEX)


def _sets(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            sets = shingle_sets(data, offsets)
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(cuts, pa.array(signed(np.concatenate(sets))))], ["doc_id", "tokens"])


def _similar_size(a: str, b: str):
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def light(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if a count shows it to be short."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", small: int = SMALL, rare_most: int = RARE_MOST, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Documents link when 100 * |intersection| >= 80 * |union| of their shingle
    sets. Null, empty and blank texts have no shingle and link with nothing.
    Equal sets link. Rows that repeat a doc_id hold the same text. A row without
    doc_id has no component (null). Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    index_path, index = scratch.write(indexed(narrow, frequent_tokens(narrow, scratch, min(rare_most, small)), max_frequent))
    release(spark)
    some = index.where("n > 0 and doc_id is not null")
    classes = scratch.table(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    kept = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    entries_path, entries = scratch.write(kept.select("doc_id", F.explode("entries").alias("entry")))
    meta = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "slack", "pure").dropDuplicates(["doc_id"])
    meta = scratch.table(meta)
    release(spark)

    shared_entries = entries.groupBy("entry").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("entry", "size")
    shared_entries = scratch.table(shared_entries)  # then both sides of the join are dealt anew, and a large entry can be split
    release(spark)
    hits_path, hits = scratch.write(entries.join(shared_entries, "entry"))
    scratch.drop(entries_path)
    release(spark)

    few, many = hits.where(F.col("size") <= small), hits.where(F.col("size") > small)
    # entries of rare tokens are small (rare_most <= small), so `shared` counts every rare token that two prefixes share
    sized = scratch.table(few.join(meta, "doc_id").select("entry", "doc_id", "n", "slack", "pure"))
    a, b = (sized.select("entry", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("slack").alias(f"s{x}"), F.col("pure").alias(f"p{x}")) for x in "ab")
    own = [F.first(f"{c}{x}").alias(f"{c}{x}") for c in "nsp" for x in "ab"]
    pairs = a.join(b, "entry").where((F.col("a") < F.col("b")) & _similar_size("na", "nb")).groupBy("a", "b").agg(F.count("*").alias("shared"), *own)
    # what a pair may share besides: tokens after the prefix that ends first, or frequent ones
    beyond = F.when(~F.col("pa") & ~F.col("pb"), F.least("sa", "sb")).when(F.col("pa") & F.col("pb"), F.greatest("sa", "sb")).when(F.col("pa"), F.col("sa")).otherwise(F.col("sb"))
    pairs = pairs.where(9 * (F.col("shared") + beyond) >= 4 * (F.col("na") + F.col("nb")))
    pairs = scratch.table(pairs.select("a", "b"))
    # Pairs of large entries that share a rare token are among the above; the others share frequent tokens alone, so both must be nearly made of
    # such, and the smaller one almost wholly ("core").
    large = many.join(meta.select("doc_id", "n", "slack"), "doc_id").select("entry", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("slack").alias("sb"))
    core = 9 * F.col("sb") >= 8 * F.col("nb")
    fits = _similar_size("na", "nb") & (9 * F.least("sa", "sb") >= 4 * (F.col("na") + F.col("nb")))
    first = large.where(core).groupBy("entry").agg(F.min(F.struct("b", "nb", "sb")).alias("p"))
    first = scratch.table(first.select("entry", F.col("p.b").alias("a"), F.col("p.nb").alias("na"), F.col("p.sb").alias("sa")))
    large = scratch.table(large.join(first, "entry"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(large.select(F.col("b").alias("doc_id"))).distinct()
    wanted = scratch.table(wanted)
    sets_path, sets = scratch.write(narrow.join(light(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(tidy(_sets), "doc_id long, tokens array<long>"))
    release(spark)

    def verified(candidates: DataFrame) -> DataFrame:
        held = scratch.table(candidates.select("a", "b"))
        firsts = scratch.table(held.select("a").distinct())
        sa = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")).join(light(firsts), "a", "left_semi")
        sb = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb")).cast("long")
        joined = sb.join(light(held), "b").join(sa, "a").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), both.alias("both"))
        return joined.where("100 * both >= 80 * (na + nb - both)").select("a", "b")

    def ordered(candidates: DataFrame) -> DataFrame:
        return candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def in_components(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
        return df.join(found.select(F.col("node").alias(column), F.col("component").alias(f"c{column}")), column, "left").withColumn(f"c{column}", F.coalesce(f"c{column}", column))

    # Round 1: one partner for each document joins most of what belongs together.
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    star = large.where(fits & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared"))
    star = star.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    links = scratch.table(verified(ordered(one.union(star))))
    found = components(links, scratch)
    release(spark)

    # Round 2: pairs of small entries that are still apart.
    apart = in_components(in_components(pairs, "a", found), "b", found).where("ca <> cb").select("a", "b")
    more = scratch.table(verified(apart))
    if not more.isEmpty():
        links = scratch.table(links.union(more))
        found = components(links, scratch)

    # Large entries: a star, then all pairs still apart with a core member, first for a slice of these.
    alive, turn, done = large.select("entry", "b", "nb", "sb"), 0, 0
    slot = F.pmod(F.xxhash64(F.lit(3), "b"), F.lit(SLOTS))
    while True:
        placed = in_components(alive, "b", found)
        pivot = F.min(F.when(core, F.struct("b", "nb", "sb", "cb")))
        state = placed.groupBy("entry").agg(F.count("*").alias("size"), pivot.alias("p"), F.min("cb").alias("least"), F.max("cb").alias("most")).where("least < most and p is not null")
        state = scratch.table(state.select("entry", "size", F.col("p.b").alias("a"), F.col("p.nb").alias("na"), F.col("p.sb").alias("sa"), F.col("p.cb").alias("ca")))
        mixed = scratch.table(placed.join(state, "entry"))
        if mixed.isEmpty():
            break
        if turn < STARS:
            candidates = mixed.where((F.col("cb") != F.col("ca")) & fits).select("a", "b")
        else:
            limit = SLOTS // 8 if turn == STARS else SLOTS
            is_pivot = core & ((slot < limit) | (F.col("size") <= small * 8))
            lists = mixed.groupBy("b").agg(F.sort_array(F.collect_list("entry")).alias("eb"))  # no more than a document has entries
            members = mixed.join(lists, "b").select("entry", "b", "cb", "nb", "sb", "eb", is_pivot.alias("pivot"))
            pivots = members.where("pivot").select("entry", F.col("b").alias("a"), F.col("cb").alias("ca"), F.col("nb").alias("na"), F.col("sb").alias("sa"), F.col("eb").alias("ea"))
            once = F.col("entry") == F.try_element_at(F.array_intersect("ea", "eb"), F.lit(1))  # a pair in many entries comes from the first
            candidates = pivots.join(members, "entry").where((F.col("ca") != F.col("cb")) & fits & ((F.col("a") < F.col("b")) | ~F.col("pivot")) & once).select("a", "b")
            mixed = mixed.where(~is_pivot)
            done = limit
        more = scratch.table(verified(ordered(candidates)))
        if not more.isEmpty():
            links = scratch.table(links.union(more))
            found = components(links, scratch)
        if done >= SLOTS:
            break
        alive = scratch.table(mixed.where((F.col("b") != F.col("a")) if turn < STARS else F.lit(True)).select("entry", "b", "nb", "sb"))
        turn += 1
        release(spark)

    narrow_index = scratch.table(index.select("doc_id", "n", "d1", "d2"))
    for path in (index_path, hits_path, sets_path):
        scratch.drop(path)
    release(spark)
    rows = narrow_index.join(classes, ["d1", "d2"], "left")
    rows = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that a document of a smaller doc_id stands for.

    Rows without doc_id stay, and so do null, empty and blank texts, which are linked with nothing. Rows that repeat a doc_id stay or
    go together. An empty table gives no rows. Other columns and their order stay.
    """
    gone = similar_groups(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
