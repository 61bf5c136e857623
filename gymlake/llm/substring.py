"""Substring dedup: repeated 50-word windows by prefix-partitioned suffix trees.

The suffixes of all documents, word by word and cut at depth 50, are split into
groups that fit a task's memory, and each group becomes a suffix tree.

Partition. A suffix carries the digests of its prefixes of 8, 20 and 50 words. A
group holds the suffixes of many prefixes of 8 words. Where a group has more than
GROUP suffixes its prefixes are extended: it is split by prefixes of 20 words, and
what is still too large by those of 50. So prefixes have the length that memory
asks for, and suffixes that share 50 words always share a group. A group that
stays too large then is a repeat in very many documents: all its suffixes are one
node, which is split by suffix and settled by partial aggregation.

Trees. A group's suffixes are sorted by path, and the internal nodes are the runs
that agree up to a depth (8, 20, 50) and part below it. A node at depth 50 with
suffixes of two documents is a repeat; there every suffix of a document above the
node's smallest goes. Suffixes of a document that follow each other so form its
maximal repeats.

Two things are settled before. Exact copies (equal word sequences) of a smaller
document are found by their digest and take no part: whatever they hold, the
smaller one holds too. And suffixes that cannot repeat are pruned by sampling: a
window's *minimizer* is the least digest among its 43 paths of 8 words, equal
windows have equal minimizers, so a window whose minimizer lies in no other
document has no other place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch, bounded_batches, release, tidy
from gymlake.llm.kernel import Words, chunks, column_bytes, mix, powers, signed, windows

DEPTH = 50
UPPER = 8
#: Prefix lengths between the first and the whole depth.
BETWEEN = (20,)
#: Suffixes of a group, at most, before its prefixes are extended (28 bytes each).
GROUP = 250_000
FLUSH = 300_000


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of every k consecutive values, by doubling."""
    if len(x) < k:
        return x[:0]
    out, have = x, 1
    while have * 2 <= k:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    more = k - have
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


def minimizers(h: np.ndarray, depth: int, upper: int) -> np.ndarray:
    return sliding_min(windows(h, upper, salt=1), depth - upper + 1)


def _survey(depth: int, upper: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("nodes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                h, first = words.digests(), words.first
                least = minimizers(h, depth, upper)
                n = np.diff(first)
                order = powers(int(n.max()) + 1 if len(n) else 1)
                sums, nodes = np.zeros((len(n), 2), np.uint64), []
                for d in range(len(n)):
                    own = h[first[d] : first[d + 1]]
                    sums[d, 0] = (own * order[: len(own)]).sum(dtype=np.uint64)
                    sums[d, 1] = (mix(own ^ np.uint64(0x5DEECE66D)) * order[: len(own)]).sum(dtype=np.uint64)
                    nodes.append(signed(np.unique(least[first[d] : first[d + 1] - depth + 1])) if n[d] >= depth else np.empty(0, np.int64))
                sizes = np.array([len(x) for x in nodes])
                flat = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                digests = mix(sums ^ n.astype(np.uint64)[:, None])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(signed(digests[:, 0].copy())), pa.array(signed(digests[:, 1].copy())), lists], schema=schema)

    return tidy(run)


def _packed(columns: tuple[np.ndarray, ...]) -> bytes:
    """Arrays of one length as byte planes: planes of equal bytes compress well."""
    return b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns)


def _unpacked(blob: bytes, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(blob) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return tuple(out)


def _by_owner(owner: np.ndarray, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """(bin, n, blob): the columns' rows of each owner."""
    order = np.argsort(owner, kind="stable")
    owner, columns = owner[order], tuple(x[order] for x in columns)
    cuts = np.append(np.flatnonzero(np.diff(owner, prepend=owner[:1] + 1)), len(owner))
    blobs = [_packed(tuple(x[lo:hi] for x in columns)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(owner[cuts[:-1]], pa.int64()), pa.array(np.diff(cuts)), pa.array(blobs, pa.binary())], ["bin", "n", "blob"])


BINS = "bin long, n long, blob binary"
SUFFIX = ("<i8", "<i4", "<u4", "<u4", "<u8")  # document, first word, digests of the prefixes, digest of the whole path


def _joined(table: pa.Table, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    parts = [_unpacked(blob.as_py(), kinds) for blob in table.column("blob")]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _suffixes(depth: int, upper: int, between: int, bins: int):
    """The suffixes below shared upper nodes, by bin of their shortest prefix."""

    def flush(held):
        columns = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        return _by_owner((mix(columns[2].astype(np.uint64)) % np.uint64(bins)).astype(np.int64), columns)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, shared = np.asarray(batch.column(0)), batch.column(2)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                h, first = words.digests(), words.first
                least, paths = minimizers(h, depth, upper), windows(h, depth, salt=2)
                prefixes = [windows(h, k, salt=3).astype(np.uint32) for k in (upper, between)]
                for d in range(hi - lo):
                    begin, end = first[d], first[d + 1] - depth + 1
                    if end <= begin:
                        continue
                    mine, own = np.sort(shared[lo + d].values.to_numpy(zero_copy_only=False)), signed(least[begin:end])
                    keep = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own)
                    if len(keep):
                        at = keep + begin
                        held.append((np.full(len(keep), ids[lo + d], "<i8"), keep.astype("<i4"), *(x[at] for x in prefixes), paths[at]))
                        n += len(keep)
                    if n >= FLUSH:
                        yield flush(held)
                        held, n = [], 0
        if n:
            yield flush(held)

    return tidy(run)


def _split(level: int):
    """Bins by a longer prefix: column 3 says into how many parts."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                columns, old = _unpacked(batch.column(2)[row].as_py(), SUFFIX), batch.column(0)[row].as_py()
                part = mix(columns[2 + level].astype(np.uint64)) % np.uint64(batch.column(3)[row].as_py())
                yield _by_owner(signed(mix(part ^ mix(np.array([old + level], np.int64).view(np.uint64)))), columns)

    return tidy(run)


def internal_nodes(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(begin, end) of the internal nodes at each level of sorted suffixes: runs of two or more that agree up to it and part below, or at the last level."""
    n, parted, out = len(levels[0]), np.zeros(len(levels[0]), bool), []
    parted[:1] = True
    starts = []
    for x in levels:
        parted = parted | np.concatenate([[True], x[1:] != x[:-1]])[:n]
        starts.append(np.flatnonzero(parted))
    for level, begin in enumerate(starts):
        end = np.append(begin[1:], n)
        branches = end - begin > 1
        if level + 1 < len(starts):  # a run that the next level does not split is no node: its path goes on
            below = starts[level + 1]
            branches &= np.searchsorted(below, end) - np.searchsorted(below, begin) > 1
        out.append((begin[branches], end[branches]))
    return out


def _tree(table: pa.Table) -> pa.Table:
    """The suffix tree of a group: (document, first word) of each suffix that a smaller document has."""
    doc, start, *prefixes, path = _joined(table, SUFFIX)
    order = np.lexsort((doc, path, *reversed(prefixes)))
    doc, start, levels = doc[order], start[order], [x[order] for x in (*prefixes, path)]
    begin, end = internal_nodes(levels)[-1]  # the deep ones; documents ascend within
    repeat = np.zeros(len(doc), bool)
    inside = np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange(int((end - begin).sum()))
    repeat[inside] = doc[inside] > np.repeat(doc[begin], end - begin)
    return pa.table({"doc_id": pa.array(doc[repeat]), "start": pa.array(start[repeat])})


REPEATS = "doc_id long, begins array<int>, ends array<int>"


def maximal_runs(doc: np.ndarray, start: np.ndarray, depth: int) -> pa.Table:
    """Of the repeated windows of documents, the stretches of words that they cover together."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + depth)])[: len(doc)]
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc))[: len(begin)] - 1
    owner = np.append(np.flatnonzero(np.diff(doc[begin], prepend=doc[:1] - 1)), len(begin)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(owner), pa.array(x.astype(np.int32))) for x in (start[begin], start[last] + depth)]
    return pa.table({"doc_id": pa.array(doc[begin][owner[:-1]]), "begins": lists[0], "ends": lists[1]})


def _runs(depth: int):
    def run(batches):
        for batch in batches:
            starts = batch.column(1)
            owner = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(starts.offsets)))
            yield from maximal_runs(owner, np.asarray(starts.flatten()), depth).to_batches()

    return tidy(run)


def _rows(batches):
    """(path, doc_id, start) of every suffix of the batches' blobs."""
    for batch in batches:
        for blob in batch.column(2):
            doc, start, *_, path = _unpacked(blob.as_py(), SUFFIX)
            yield pa.RecordBatch.from_arrays([pa.array(signed(path)), pa.array(doc), pa.array(start)], ["path", "doc_id", "start"])


def deep_repeats(suffixes: DataFrame, scratch: Scratch, depth: int, group: int) -> DataFrame:
    """(doc_id, begins, ends): the maximal stretches of each document that lie in deep nodes under a smaller document."""
    ready, spare = [], []
    for level in range(1, 4):
        sizes = suffixes.groupBy("bin").agg(F.sum("n").alias("total"))
        large = scratch.table(sizes.where(F.col("total") > group).select("bin", F.ceil(2 * F.col("total") / group).cast("long").alias("parts")))
        if large.isEmpty():
            ready.append(suffixes)
            suffixes = None
            break
        ready.append(suffixes.join(large, "bin", "left_anti"))
        over = suffixes.join(large, "bin").select("bin", "n", "blob", "parts")
        suffixes = over.select("bin", "n", "blob")
        if level < 3:
            path, suffixes = scratch.write(over.mapInArrow(_split(level), BINS))
            spare.append(path)
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    places = every.select("bin", "blob").groupBy("bin").applyInArrow(_tree, "doc_id long, start int")
    if suffixes is not None:  # groups of one path with more suffixes than a group may have: split by suffix, both sides dealt anew
        rows = suffixes.mapInArrow(tidy(_rows), "path long, doc_id long, start int")
        least = scratch.table(rows.groupBy("path").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"))
        places = places.union(rows.join(least, "path").where("doc_id > least").select("doc_id", "start"))
    found = places.groupBy("doc_id").agg(F.collect_set("start").alias("starts")).mapInArrow(_runs(depth), REPEATS)  # no more than a document has words
    found = scratch.table(found)
    for path in spare:
        scratch.drop(path)
    return found


def _cut(depth: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string())] * with_text)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            raw, copies, begins, ends = data.tobytes(), *batch.columns[2:5]
            n, gone, digests, texts = [], [], [], []
            for d in range(batch.num_rows):
                text = raw[offsets[d] : offsets[d + 1]]
                words = text.split()  # bytes split at exactly the six ASCII white-space bytes
                total, removed = len(words), 0
                if copies[d].as_py() and total >= depth:
                    words, removed = [], total
                elif begins[d].is_valid and len(begins[d].values):
                    edge = np.zeros(total + 1, np.int32)
                    np.add.at(edge, begins[d].values.to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, ends[d].values.to_numpy(zero_copy_only=False), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    removed = total - int(keep.sum())
                    words = [words[i] for i in np.flatnonzero(keep)]
                n.append(total)
                gone.append(removed)
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append((joined if removed else text).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())] + [pa.array(texts, pa.string())] * with_text, schema=schema)

    return tidy(run)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """A join whose right side grows with the input: sorted and merged at every size, never broadcast."""
    return left.join(right.hint("merge"), on, how)


def repeats(docs: DataFrame, depth: int = DEPTH, upper: int = UPPER, group: int = GROUP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, is_copy, begins, ends): the stretches of a document's words covered by windows that a smaller document has too; only documents that have any."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    narrow = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    survey = scratch.table(narrow.mapInArrow(_survey(depth, upper), "doc_id long, n_words long, d1 long, d2 long, nodes array<long>"))
    long = survey.where(F.col("n_words") >= depth)
    least = long.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least_path, least = scratch.write(least)
    copies = sorted_join(long, least.withColumnRenamed("d1", "e1").withColumnRenamed("d2", "e2"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("doc_id") > F.col("least")), "left_semi").select("doc_id").distinct()
    copies_path, copies = scratch.write(copies)

    nodes = sorted_join(long, copies, "doc_id", "left_anti").select("doc_id", F.explode("nodes").alias("node"))
    nodes_path, nodes = scratch.write(nodes)
    shared = nodes.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("node")
    shared_path, shared = scratch.write(shared)
    per_doc = sorted_join(nodes, shared, "node", "left_semi").groupBy("doc_id").agg(F.collect_set("node").alias("shared"))
    words = long.agg(F.sum("n_words")).first()[0] or 0
    bins = max(64, 1 << int(words // group).bit_length())
    between = min(BETWEEN[0], depth)
    suffixes = sorted_join(narrow, per_doc, "doc_id", "inner").select("doc_id", "text", "shared").mapInArrow(_suffixes(depth, upper, between, bins), BINS)
    suffixes_path, suffixes = scratch.write(suffixes)
    scratch.drop(nodes_path)
    release(spark)

    found = deep_repeats(suffixes, scratch, depth, group)
    empty = F.array().cast("array<int>")
    out = found.select("doc_id", F.lit(False).alias("is_copy"), "begins", "ends").unionByName(copies.select("doc_id", F.lit(True).alias("is_copy"), empty.alias("begins"), empty.alias("ends")))
    out = scratch.table(out)
    for path in (suffixes_path, copies_path, shared_path, least_path):
        scratch.drop(path)
    release(spark)
    return out


def remove_repeats(docs: DataFrame, depth: int = DEPTH, with_text: bool = False, group: int = GROUP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of docs.

    Null and empty texts: 0 words, nothing removed. A row without doc_id keeps
    all its words and removes none elsewhere. Rows that repeat a doc_id hold the
    same text and do not remove each other. Other columns are not read. kept_text
    is the text itself where nothing was removed.
    """
    found = repeats(docs, depth, group=group, text=text, key=key)
    joined = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = sorted_join(joined, found, "doc_id", "left").select("doc_id", "text", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "begins", "ends")
    return joined.mapInArrow(_cut(depth, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def apply_removal(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with the repeated words taken out of text (n_chars follows); rows and other columns stay.

    Null texts stay null, rows without doc_id stay whole. Rows that repeat a doc_id are each judged against documents of a smaller
    one, not against each other. An empty table gives no rows.
    """
    found = repeats(docs, depth)
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    keyed = docs.toDF(*names).withColumn("_key", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    inner = sorted_join(keyed, found.withColumnRenamed("doc_id", "_key"), "_key", "left")
    schema = inner.select(*names).schema

    def run(batches, cut=_cut(depth, True)):
        for batch in batches:
            rest = len(names)
            part = pa.RecordBatch.from_arrays([batch.column(rest), batch.column(at), *batch.columns[rest + 1 : rest + 4]], ["doc_id", "text", "is_copy", "begins", "ends"])
            kept = next(cut([part]))
            columns = [batch.column(i) for i in range(rest)]
            changed = pa.array(np.asarray(kept.column(2)) > 0)
            columns[at] = pa.compute.if_else(changed, kept.column(4).cast(columns[at].type), columns[at])
            yield pa.RecordBatch.from_arrays(columns, names)

    ready = inner.select(*names, "_key", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "begins", "ends")
    out = ready.mapInArrow(run, schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
