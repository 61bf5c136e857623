"""Packing documents into fixed-size sequences by best-fit decreasing.

Best-fit decreasing sees a piece only through its length, and lengths are whole
numbers up to the sequence size. So the histogram of lengths (at most one count
per length, whatever the corpus) determines the packing: the driver runs the
algorithm on counts, placing all pieces of one length at a time, with a segment
tree over remaining capacities to find the tightest open window. The outcome is
a plan of arithmetic runs, "the pieces of this length ranked from here go to the
sequences from there on", which executors apply to every piece. The plan is the
same as that of piece-by-piece best-fit decreasing, and its size depends on the
sequence size alone.

Tokenizing uses the given public tokenizer. White space separates its words, so
a worker need not encode a word it has met: a table of ids, keyed by the word's
64-bit digest, serves it by array lookups. The table is bounded in bytes; when it
is full, words that were not met again since they came in leave it.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch, bounded_batches, tidy
from gymlake.llm.kernel import Words, chunks

SEQUENCE = 4096
END_ID = 2
#: Bytes of a worker's table of word ids, at most. It changes how often a word is encoded, never its ids.
TABLE_BYTES = 16 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of words by digest: sorted keys into one flat array of ids, of at most `limit` bytes between two chunks."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.mark = limit, "\x01"
        ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.begin = np.empty(0, np.int32)
        self.size = np.empty(0, np.int32)
        self.again = np.empty(0, bool)  # met again since it came in, or since the table was last full
        self.ids = np.empty(0, np.uint32)

    def _keep(self, which: np.ndarray) -> None:
        sizes, begins = self.size[which], self.begin[which]
        ends = np.cumsum(sizes, dtype=np.int32)
        self.ids = self.ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        self.keys, self.size, self.begin, self.again = self.keys[which], sizes, ends - sizes, np.zeros(len(which), bool)

    def _bound(self) -> None:
        for which in (self.again, np.zeros(len(self.keys), bool)):
            if 17 * len(self.keys) + 4 * len(self.ids) > self.limit:
                self._keep(np.flatnonzero(which))

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: many words in one text, told apart by a mark that is one id of its own."""
        if self.mark_id is None or any(self.mark in w for w in words):
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out: list[np.ndarray] = []
        step = 2000
        texts = [f" {self.mark} ".join(words[i : i + step]) for i in range(0, len(words), step)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.mark_id))
            got = [parts[0], *(p[1:] for p in parts[1:])]
            expected = len(words[i * step : (i + 1) * step])
            if len(got) != expected:
                got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(words[i * step : (i + 1) * step], add_special_tokens=False)]
            out.extend(got)
        return out

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        if not len(words):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        self._bound()
        found, sample, at = np.unique(words.digests(), return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        known = (self.keys[slot] == found) if len(self.keys) else np.zeros(len(found), bool)
        self.again[slot[known]] = True
        if not known.all():
            raw, new = words.data.tobytes(), np.flatnonzero(~known)
            fresh = self.encode([raw[words.starts[i] : words.ends[i]].decode("utf-8", "replace") for i in sample[new]])
            sizes = np.array([len(x) for x in fresh], np.int32)
            begins = len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes
            self.ids = np.concatenate([self.ids, *fresh])
            keys = np.concatenate([self.keys, found[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.begin, self.size, self.again = keys[order], np.concatenate([self.begin, begins])[order], np.concatenate([self.size, sizes])[order], np.append(self.again, np.zeros(len(new), bool))[order]
            slot = np.searchsorted(self.keys, found)
        begin, size = self.begin[slot][at], self.size[slot][at]
        ends = np.cumsum(size, dtype=np.int64)
        index = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        return self.ids[index], size


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


def _pieces(path: str, sequence: int, end_id: int):
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"), types, strict=True)))

    def run(batches):
        from pyspark import TaskContext

        table, part, seen = word_ids(path), TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                ids, size = table.look_up(words)
                ends = np.concatenate([[0], np.cumsum(size)])[words.first]
                rows: list[tuple] = []
                for d in range(hi - lo):
                    own = np.append(ids[ends[d] : ends[d + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), sequence):
                        piece = own[start : start + sequence]
                        rows.append((keys[lo + d], start, len(piece), zlib.crc32(piece.tobytes()), len(own), part, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    return tidy(run)


class CapacityTree:
    """Segment tree over capacities 0..size: which have open windows, and the least of them at or above a need."""

    def __init__(self, size: int):
        self.width = 1
        while self.width <= size:
            self.width *= 2
        self.some = np.zeros(2 * self.width, bool)

    def put(self, capacity: int, some: bool) -> None:
        i = self.width + capacity
        self.some[i] = some
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = self.width + need
        if self.some[i]:
            return need
        while i > 1:  # up to the first subtree on the right that has any, then down its left side
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, first rank, first sequence, per, offset): the piece of that
    length and rank goes to sequence first + (rank - first rank) // per, at
    offset + (rank - first rank) % per * length.
    """
    tree, open_at, rows, next_sequence = CapacityTree(sequence), {}, [], 0

    def push(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_at.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            per = (capacity or sequence) // length
            if capacity is None:
                capacity, first, n = sequence, next_sequence, -(-left // per)
                next_sequence += n
            else:
                first, n = open_at[capacity].pop()
                if not open_at[capacity]:
                    tree.put(capacity, False)
            full = min(n, left // per)
            used = full
            push(capacity - per * length, first, full)
            placed = full * per
            if full < n and left > placed:  # one window takes what is left of this length
                last = left - placed
                push(capacity - last * length, first + full, 1)
                placed, used = placed + last, full + 1
            push(capacity, first + used, n - used)
            rows.append((length, rank, first, per, sequence - capacity))
            rank, left = rank + placed, left - placed
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold the end id alone. Repeated rows are packed each. An
    empty table gives no pieces. Other columns are not read. The order of pieces
    of one length is that of the scan, so a rerun on the same files agrees.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = Scratch(spark).table(narrow.mapInArrow(_pieces(tokenizer or default_tokenizer(), sequence, end_id), PIECES))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row per length
    rows = sorted(plan(counts, sequence))
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    first_of = np.searchsorted(table[:, 0], np.arange(sequence + 2))

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (2, 5))
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                lo, hi = first_of[n], first_of[n + 1]
                row[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], side="right") - 1
            step = rank - table[row, 1]
            where = table[row, 2] + step // table[row, 3]
            offset = table[row, 4] + step % table[row, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(where), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
