"""Similar sets of words: joins of a Jaccard similarity, a block of sought sets at a time.

The stored sets are written once, as digests of 64 bits of their words, and read
by every block. A block is broadcast and holds sets of BLOCK_TOKENS words at most,
so memory is bounded and nothing but what is found is shuffled. Tokens are ordered
by the number of the block's sets that hold them: those that none holds come first
and cost nothing. With l = SHARED, or the least overlap if that is less, similar
sets share l of the first n - ceil(t * n) + l tokens of each. Pairs that do and
whose sizes allow it are compared on their full sets. Equal sets count once: in a
block, and on the stored side in a batch.

Work goes with the product of both sides, for hits of common tokens and for groups
of sets that are all similar; it is spread over the tasks of the stored side.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.functions.text import content_tokens

BLOCK_TOKENS = 2_000_000
SHARED = 8
#: Hits, or tokens of compared sets, that are looked at in one go.
CHUNK = 500_000
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def token_digests(content: Column) -> Column:
    """The words of a text as a sorted array of digests."""
    return F.sort_array(F.transform(content_tokens(content), lambda w: F.xxhash64(w)))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches, so that long texts do not add up in a Python worker; no result depends on them."""
    for name, limit in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)
        if now <= 0 or now > limit:
            spark.conf.set(key, str(limit))


def remove(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Give freed memory back to the system, so that what the tasks of a process took does not add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted sets: the places of the first of equal ones, and the number of its set for each."""
    numbers: dict[bytes, int] = {}
    of = np.array([numbers.setdefault(values[lo:hi].tobytes(), len(numbers)) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
    return np.unique(of, return_index=True)[1], of


def taken(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `starts`, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Sought:
    """The sets of a block and what of the stored ones is similar to them."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, threshold: float):
        self.threshold = threshold
        self.sizes = np.diff(offsets)
        self.vocabulary, at, counts = np.unique(values, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(counts), np.int32)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
        key = (np.repeat(np.arange(len(self.sizes)), self.sizes) << 32) | self.rank[at]
        del at
        key.sort()
        self.starts = offsets[:-1]
        self.ids = (key & 0xFFFFFFFF).astype(np.int32)
        length, self.shared = self.prefix(self.sizes)
        in_prefix = taken(self.starts, length)
        tokens, sets = self.ids[in_prefix], (key[in_prefix] >> 32).astype(np.int32)
        self.postings = sets[np.argsort(tokens, kind="stable")]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(counts)))])

    def prefix(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of the prefix of a set of n, and how many of it a similar set shares at least (if its own number is not less)."""
        least = np.ceil(self.threshold * n - 1e-9).astype(np.int64)
        shared = np.minimum(SHARED, least)
        return n - least + shared, shared

    def similar(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stored set, sought set and similarity of each similar pair."""
        n = np.diff(offsets)
        at = np.minimum(np.searchsorted(self.vocabulary, values), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == values
        key = (np.repeat(np.arange(len(n)), n)[known] << 32) | self.rank[at[known]]
        key.sort()
        ids, counts = (key & 0xFFFFFFFF).astype(np.int32), np.bincount(key >> 32, minlength=len(n))
        starts = np.cumsum(counts) - counts
        length, shared = self.prefix(n)
        inside = np.clip(length - (n - counts), 0, counts)
        tokens, owner = ids[taken(starts, inside)], np.repeat(np.arange(len(n)), inside)
        hits = self.lists[tokens + 1] - self.lists[tokens]
        lo, hi = np.ceil(self.threshold * n - 1e-9), np.floor(n / self.threshold + 1e-9)
        # whole sets go together, since their hits are counted
        per_set = np.bincount(owner, weights=hits, minlength=len(n)).astype(np.int64)
        part = (np.cumsum(per_set) - per_set) // CHUNK
        cuts = np.searchsorted(owner, np.flatnonzero(np.diff(part, prepend=-1)))
        pairs = []
        for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True):
            found = self.postings[taken(self.lists[tokens[a:b]], hits[a:b])]
            by = np.repeat(owner[a:b], hits[a:b])
            size = self.sizes[found]
            fits = (size >= lo[by]) & (size <= hi[by])
            pair, times = np.unique((by[fits] << 32) | found[fits], return_counts=True)
            pairs.append(pair[times >= np.minimum(shared[pair >> 32], self.shared[pair & 0xFFFFFFFF])])
        pair = np.concatenate([*pairs, np.empty(0, np.int64)])
        stored, sought = pair >> 32, pair & 0xFFFFFFFF
        overlap = self._overlaps(stored, sought, ids, starts, counts)
        similarity = overlap / (n[stored] + self.sizes[sought] - overlap)
        good = similarity >= self.threshold
        return stored[good], sought[good], similarity[good]

    def _overlaps(self, stored: np.ndarray, sought: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out, held = np.zeros(len(stored), np.int64), np.zeros(len(self.vocabulary), bool)
        most = max(1, CHUNK // int(self.sizes.max(initial=1)))
        bounds = np.flatnonzero(np.diff(stored, prepend=-1, append=-1)).tolist()
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            s = stored[first]
            own = ids[starts[s] : starts[s] + counts[s]]
            held[own] = True
            for a in range(first, last, most):
                others = sought[a : min(a + most, last)]
                lengths = self.sizes[others]
                there = held[self.ids[taken(self.starts[others], lengths)]]
                out[a : a + len(others)] = np.add.reduceat(there, np.cumsum(lengths) - lengths, dtype=np.int64)
            held[own] = False
        return out


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sets with about CHUNK tokens."""
    cuts = np.flatnonzero(np.diff(offsets[:-1] // CHUNK, prepend=-1)).tolist()
    yield from zip(cuts, [*cuts[1:], len(offsets) - 1], strict=False)  # an empty batch has none


def run_block(stored: DataFrame, sets: DataFrame, ids: DataFrame | None, threshold: float, emit: Callable, schema: str, target: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Write, to `target`, what `emit` makes of the sets of `stored` that are similar to `sets` (key, tokens), which are distinct; `tokens` are sorted and not empty.

    emit gets the batch; the row of each distinct set of it and the number of its distinct set for each row; names of sought
    sets and the number of each one's set, where `ids` (entry_id, key) names them and keys do otherwise; and for each similar
    pair the stored and the sought set by number, and the similarity.
    """
    spark = stored.sparkSession
    table = sets.toArrow()
    if not table.num_rows:
        return
    keys = table.column("key").to_numpy()
    names, of = keys, np.arange(len(keys))
    if ids is not None:
        named, order = ids.toArrow(), np.argsort(keys)
        names, of = named.column("entry_id").to_numpy(), order[np.searchsorted(keys, named.column("key").to_numpy(), sorter=order)]
    index = Sought(*lists(table.column("tokens")), threshold)
    del table
    block = spark.sparkContext.broadcast((index, names, of))
    del index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names, of = block.value
        for whole in batches:
            for lo, hi in slices(lists(whole.column("tokens"))[1]):
                batch = whole.slice(lo, hi - lo)
                values, offsets = lists(batch.column("tokens"))
                first, rows = distinct(values, offsets)
                n = np.diff(offsets)[first]
                found = index.similar(values[taken(offsets[first], n)], np.concatenate([[0], np.cumsum(n)]))
                if len(found[0]):
                    yield from emit(batch, first, rows, names, of, *found)
        trim()

    then(stored.mapInArrow(run, schema)).write.parquet(target)
    block.destroy()
    trim()


def first_two(group: np.ndarray, ids: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group, and the first one of another id where there is one."""
    o = np.lexsort((*reversed(order), group))
    start = np.diff(group[o], prepend=-1) != 0
    first, which = np.flatnonzero(start), np.cumsum(start) - 1
    rest = np.flatnonzero(ids[o] != ids[o][first][which])
    return o[first], o[rest[np.unique(which[rest], return_index=True)[1]]]


def best_matches(batch: pa.RecordBatch, first: np.ndarray, rows: np.ndarray, names: np.ndarray, of: np.ndarray, stored: np.ndarray, sought: np.ndarray, similarity: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each sought id the most similar row of the batch that has another id; the first by pos of equals."""
    ids, pos = batch.column("entry_id").to_numpy(zero_copy_only=False), batch.column("pos").to_numpy(zero_copy_only=False)
    own = np.concatenate(first_two(rows, ids, pos))  # two rows of a set are enough, one of them may be the sought one
    own = own[np.argsort(rows[own], kind="stable")]
    per_set = np.bincount(rows[own], minlength=len(first))
    row = own[taken((np.cumsum(per_set) - per_set)[stored], per_set[stored])]
    sought, similarity = np.repeat(sought, per_set[stored]), np.repeat(similarity, per_set[stored])
    one, two = first_two(sought, ids[row], -similarity, pos[row])
    best, second = np.full(len(of), -1), np.full(len(of), -1)
    best[sought[one]], second[sought[two]] = one, two
    pick = best[of]
    itself = pick >= 0
    itself[itself] = ids[row[pick[itself]]] == names[itself]
    pick[itself] = second[of][itself]
    got = np.flatnonzero(pick >= 0)
    pick = pick[got]
    kind = batch.column("entry_id").type
    yield pa.RecordBatch.from_arrays(
        [pa.array(names[got], kind), pa.array(ids[row[pick]], kind), pa.array(pos[row[pick]], batch.column("pos").type), pa.array(similarity[pick])], ["new_id", "entry_id", "pos", "similarity"]
    )


def similar_keys(batch: pa.RecordBatch, first: np.ndarray, rows: np.ndarray, names: np.ndarray, of: np.ndarray, stored: np.ndarray, sought: np.ndarray, similarity: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each pair of similar, unequal sets by their keys, with the group of the stored one."""
    there = first[stored]
    left, right = names[sought], batch.column("key").to_numpy()[there]
    other = left != right
    yield pa.RecordBatch.from_arrays([batch.column("playbook_id").take(pa.array(there[other])), pa.array(left[other]), pa.array(right[other])], ["playbook_id", "key", "similar"])
