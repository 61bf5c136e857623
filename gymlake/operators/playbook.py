"""Playbooks: dominance, merging, credit, duplicates, ordered edits."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.operators import similar as S
from gymlake.sources.scratch import scratch_folder


def pareto_frontier(points: DataFrame, key: str, *axes: str) -> DataFrame:
    """Points that no other one dominates (at least as good on every axis, better on one); ties stay.

    Only the points of highest first axis within each combination of the others
    can survive, so duplicates collapse before the anti-join. The comparison is a
    nested loop over what is left, for candidates of one frontier, which are few;
    `streaming.frontier` keeps frontiers of many.
    """
    best = points.groupBy(*axes[1:]).agg(F.max(axes[0]).alias(axes[0])).select(*axes)
    other = best.select(*[F.col(a).alias(f"_{a}") for a in axes])
    no_worse, better = F.lit(True), F.lit(False)
    for a in axes:
        no_worse, better = no_worse & (F.col(f"_{a}") >= F.col(a)), better | (F.col(f"_{a}") > F.col(a))
    return points.join(other, no_worse & better, "left_anti")


def merge_playbooks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of both by id: b's replaces a's only where its (utility, version) is strictly greater; a's order, then new ones."""
    columns = [c for c in a.columns if c != "entry_id"]
    x, y = a.select("entry_id", F.struct(*columns).alias("x")), b.select("entry_id", F.struct(*columns).alias("y"))
    worth = lambda s: F.struct((s["helpful"] - s["harmful"]).alias("u"), s["entry_version"].alias("v"))
    take = F.col("x").isNull() | (worth(F.col("y")) > worth(F.col("x")))
    both = x.join(y, "entry_id", "full_outer")
    return both.select("entry_id", F.when(F.coalesce(take & F.col("y").isNotNull(), F.lit(False)), F.col("y")).otherwise(F.col("x")).alias("e"), F.col("x").isNull().alias("is_new")).select("entry_id", "e.*", "is_new")


def compactness(words: Column, budget: int = 40) -> Column:
    if budget <= 0:
        raise ValueError("budget must be positive")
    return F.coalesce(F.avg(F.greatest(F.lit(0.0).cast("double"), 1 - words / F.lit(float(budget)).cast("double"))), F.lit(1.0).cast("double"))


def apply_credit(entries: DataFrame, credits: DataFrame) -> DataFrame:
    """helpful and harmful raised by one for each judged step that names the entry; unknown ids do nothing."""
    per = credits.distinct().groupBy("entry_id").agg(F.count_if(F.col("kind") == "helpful").alias("_h"), F.count_if(F.col("kind") == "harmful").alias("_b"))
    out = entries.join(per, "entry_id", "left")
    return out.withColumn("helpful", F.col("helpful") + F.coalesce("_h", F.lit(0))).withColumn("harmful", F.col("harmful") + F.coalesce("_b", F.lit(0))).drop("_h", "_b")


def near_duplicates(entries: DataFrame, incoming: DataFrame, threshold: float = 0.7) -> DataFrame:
    """For each incoming entry its most similar stored one (not itself) of Jaccard similarity `threshold` or more, the earliest of equals.

    Words are known by digests of 64 bits. The sets are written once and compared
    with the incoming ones a block at a time (`similar`); a block's best are written.
    """
    spark = entries.sparkSession
    S.small_batches(spark)
    sets, found = scratch_folder(spark), scratch_folder(spark)
    for name, df in (("stored", entries), ("incoming", incoming)):
        rows = df.where("entry_id is not null").select("entry_id", "pos", S.token_digests(F.col("content")).alias("tokens"))
        (rows if name == "stored" else rows.withColumn("key", F.xxhash64("tokens"))).write.parquet(f"{sets}/{name}")
    # filtered when read again, since a filter of what a projection makes would make it twice
    stored, named = (spark.read.parquet(f"{sets}/{name}").where(F.size("tokens") > 0) for name in ("stored", "incoming"))
    named.select("key", "tokens").dropDuplicates(["key"]).write.parquet(f"{sets}/sought")
    sought = spark.read.parquet(f"{sets}/sought")
    n_blocks = -(-(sought.agg(F.sum(F.size("tokens"))).first()[0] or 0) // S.BLOCK_TOKENS)
    key, pos = (entries.schema[c].dataType.simpleString() for c in ("entry_id", "pos"))
    schema = f"new_id {key}, entry_id {key}, pos {pos}, similarity double"
    best = lambda df: df.groupBy("new_id").agg(F.max_by(F.struct("entry_id", "pos", "similarity"), F.struct("similarity", -F.col("pos"))).alias("m")).select("new_id", "m.*")
    for i in range(n_blocks):
        block = F.pmod("key", F.lit(n_blocks)) == i
        S.run_block(stored, sought.where(block), named.where(block).select("entry_id", "key"), threshold, S.best_matches, schema, f"{found}/block={i}", best)
    S.remove(spark, sets)
    out = spark.read.schema(schema).parquet(found) if n_blocks else spark.createDataFrame([], schema)
    return best(out).select("new_id", "entry_id", "similarity")  # an id that comes twice may be in two blocks


_TOKEN = re.compile(r"[^\W_]+")


def _tag(text: str) -> str:
    return "-".join(_TOKEN.findall(text.lower())) or "general"


class _Contents:
    """Token sets of the entries of a book, to find one that says the same (Jaccard similarity 0.7 or more).

    Prefix filter: with the tokens of all texts in one order, rarest first, similar sets
    share one of the first n - ceil(0.7 * n) + 1 of each. Only those are looked up.
    """

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {}
        sets = [array("i", {numbers.setdefault(w, len(numbers)) for w in _TOKEN.findall(t.lower()) if len(w) > 2}) for t in texts]
        counts = [0] * len(numbers)
        for s in sets:
            for w in s:
                counts[w] += 1
        rank = [0] * len(numbers)
        for r, w in enumerate(sorted(range(len(numbers)), key=counts.__getitem__)):
            rank[w] = r
        self.sets = [array("i", sorted(rank[w] for w in s)) for s in sets]
        self.held: dict[int, int] = {}
        self.by_token: dict[int, set[int]] = {}

    def _prefix(self, text: int) -> array:
        n = len(self.sets[text])
        return self.sets[text][: n - (7 * n + 9) // 10 + 1] if n else self.sets[text]

    def put(self, at: int, text: int) -> None:
        """The entry at a place has the text of this number from now on."""
        self.drop(at)
        self.held[at] = text
        for w in self._prefix(text):
            self.by_token.setdefault(w, set()).add(at)

    def drop(self, at: int) -> None:
        if at in self.held:
            for w in self._prefix(self.held.pop(at)):
                self.by_token[w].discard(at)

    def said(self, text: int) -> bool:
        own, seen = set(self.sets[text]), set()
        for w in self._prefix(text):
            for at in self.by_token.get(w, ()):
                if at in seen:
                    continue
                seen.add(at)
                other = self.sets[self.held[at]]
                if 10 * min(len(own), len(other)) >= 7 * max(len(own), len(other)):
                    both = len(own.intersection(other))
                    if both / (len(own) + len(other) - both) >= 0.7:
                        return True
        return False


class _Known:
    """As `_Contents`, with the similar texts found before: `keys` are the texts' sets (0: empty), and left[i] is similar to right[i]."""

    def __init__(self, keys: np.ndarray, left: np.ndarray, right: np.ndarray):
        names, self.sets = np.unique(np.concatenate([[0], keys]), return_inverse=True)
        self.empty, self.sets = self.sets[0], self.sets[1:].astype(np.int32)
        numbers = np.searchsorted(names, left)
        self.similar = np.searchsorted(names, right[np.argsort(numbers, kind="stable")]).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=len(names)))])
        self.held = np.full(len(keys), -1, np.int32)  # by place; there are no more places than texts
        self.live = np.zeros(len(names), np.int32)

    def put(self, at: int, text: int) -> None:
        self.drop(at)
        if (s := self.sets[text]) != self.empty:
            self.held[at] = s
            self.live[s] += 1

    def drop(self, at: int) -> None:
        if (s := self.held[at]) >= 0:
            self.live[s] -= 1
            self.held[at] = -1

    def said(self, text: int) -> bool:
        s = self.sets[text]
        return bool(self.live[s]) or bool(self.live[self.similar[self.starts[s] : self.starts[s + 1]]].any())


def edit_playbook(entries: list[dict], ops: list[dict]) -> tuple[list[dict], list[str]]:
    """Apply operations in order; what became of each.

    Rejected, while the rest go on: an operation without the content it needs, an
    update or removal that does not name one known entry, and a merge that does not
    name two. An addition that says what an entry already says is suppressed. An
    update keeps the entry's id and credit. A merge takes the known ones of its
    entries, stands where the first of them stood, has the credit of all and names
    them. Tags are normalised.

    Entries are kept by place and found by id, so an operation does not scan the book.
    """
    contents = None
    if any(op.get("op") == "add" for op in ops):
        contents = _Contents([e["content"] for e in entries] + [op.get("content") or "" for op in ops])
    book, outcomes = _edit(entries, [e["entry_id"] for e in entries], ops, contents)
    return [book[at] or dict(entries[at]) for at in sorted(book)], outcomes


def _edit(entries: Sequence[dict], ids: Iterable[str], ops: Iterable[dict], contents: _Contents | _Known | None) -> tuple[dict[int, dict | None], list[str]]:
    """`edit_playbook` by place, None for an entry as it was. contents: knows which texts say the same, by the places of entries and, after these, of operations."""
    book: dict[int, dict | None] = dict.fromkeys(range(len(entries)))
    outcomes, places_of = [], {}
    for at, i in enumerate(ids):
        places_of.setdefault(i, []).append(at)
    if contents:
        for at in book:
            contents.put(at, at)
    find = lambda i: min(places_of[i]) if places_of.get(i) else None

    def put(at: int, entry: dict, n: int) -> None:
        book[at] = entry
        if contents:
            contents.put(at, len(entries) + n)

    def remove(places: list[int]) -> None:
        for at in set(places):
            e = book.pop(at) or entries[at]
            places_of[e["entry_id"]].remove(at)
            if contents:
                contents.drop(at)

    for n, op in enumerate(ops):
        kind, ids, end, content = op.get("op"), op.get("entry_ids") or [], len(entries) + n, (op.get("content") or "").strip()
        places = [p for p in map(find, ids) if p is not None]
        tag = _tag(op["tag"]) if op.get("tag") else None
        if kind == "add" and content:
            if contents.said(end):
                outcomes.append("suppressed")
                continue
            put(end, {"entry_id": f"new-{n}", "tag": tag or "general", "content": content, "helpful": 0, "harmful": 0, "version": 1, "provenance": []}, n)
            places_of.setdefault(f"new-{n}", []).append(end)
            outcomes.append("added")
        elif kind == "update" and content and len(ids) == len(places) == 1:
            e = book[places[0]] or entries[places[0]]
            put(places[0], e | {"content": content, "tag": tag or e["tag"], "version": e["version"] + 1}, n)
            outcomes.append("updated")
        elif kind == "remove" and len(ids) == len(places) == 1:
            remove(places)
            outcomes.append("removed")
        elif kind == "merge" and content and len(places) > 1:
            olds = [book[p] or entries[p] for p in places]
            new = {
                "entry_id": f"new-{n}", "tag": tag or olds[0]["tag"], "content": content, "helpful": sum(e["helpful"] for e in olds),
                "harmful": sum(e["harmful"] for e in olds), "version": max(e["version"] for e in olds) + 1, "provenance": [e["entry_id"] for e in olds],
            }
            first = min(places)
            remove(places)
            put(first, new, n)
            places_of.setdefault(f"new-{n}", []).append(first)
            outcomes.append("merged")
        else:
            outcomes.append("rejected")
    return book, outcomes


def change_count(outcomes: Column, merged: Column) -> Column:
    """Changes of a batch: added, updated, merged and removed ones, where a merge also removes the entries it takes in (`merged`, their number)."""
    done = F.filter(outcomes, lambda o: o.isin("added", "updated", "merged", "removed"))
    return F.size(done) + F.coalesce(merged, F.lit(0))


#: Operations that give an entry a content.
_PLACING = ("add", "update", "merge")
#: Sets of words lie in so many folders, by playbook, so that a block reads those of its own.
_SLOTS = 32


class _Digests(dict):
    """Digests of words, the first ones remembered."""

    def __missing__(self, word: str) -> int:
        digest = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        if len(self) < 200_000:
            self[word] = digest
        return digest


def _sets_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with, for `content`, the set of its words (by playbook: the digests of two share none), the set's key, and how much of the text is no white space."""
    digests = _Digests()
    for batch in batches:
        sizes, words, keys, skips, lengths = [], [], [], [], []
        for text, op in zip(batch.column("content").to_pylist(), batch.column("op").to_pylist(), strict=True):
            own = {w for w in _TOKEN.findall(text.lower()) if len(w) > 2} if text else ()
            words.extend(map(digests.__getitem__, own))
            sizes.append(len(own))
            skips.append(None if op is None or text is None else len(text) - len(text.lstrip()))
            lengths.append(None if op is None or text is None else len(text.strip()))
        values = np.array(words, np.int64) ^ np.repeat(batch.column("book").to_numpy(), sizes)
        offsets = np.cumsum([0, *sizes], dtype=np.int32)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = values[lo:hi]
            own.sort()
            keys.append(int.from_bytes(blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if hi > lo else 0)
        new = {"key": pa.array(keys, pa.int64()), "skip": pa.array(skips, pa.int32()), "length": pa.array(lengths, pa.int32()), "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}
        kept = [c for c in batch.schema.names if c != "content"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.values()], [*kept, *new])
    S.trim()


def _similar_texts(sets: DataFrame, target: str) -> DataFrame:
    """Keys of similar, unequal sets of a playbook, those of additions as `key`."""
    spark = sets.sparkSession
    texts = sets.where("key <> 0")
    added = texts.where("op = 'add'")
    per_slot = added.select("slot", "key", F.size("tokens").alias("n")).dropDuplicates(["slot", "key"]).groupBy("slot").agg(F.sum("n")).collect()  # few slots
    blocks, group, held = [], [], 0
    for slot, n in sorted(map(tuple, per_slot)):
        parts = -(-n // S.BLOCK_TOKENS)
        if parts > 1:
            blocks += [([slot], i, parts) for i in range(parts)]
            continue
        if held + n > S.BLOCK_TOKENS:
            blocks.append((group, 0, 1))
            group, held = [], 0
        group, held = [*group, slot], held + n
    blocks += [(group, 0, 1)] if group else []
    schema = f"playbook_id {sets.schema['playbook_id'].dataType.simpleString()}, key long, similar long"
    for i, (slots, part, parts) in enumerate(blocks):
        here = F.col("slot").isin(slots)
        sought = added.where(here & (F.pmod("key", F.lit(parts)) == part)).select("key", "tokens").dropDuplicates(["key"])
        S.run_block(texts.where(here).select("playbook_id", "key", "tokens"), sought, None, 0.7, S.similar_keys, schema, f"{target}/block={i}", DataFrame.distinct)
    return spark.read.schema(schema).parquet(target).select("playbook_id", "key", "similar") if blocks else spark.createDataFrame([], schema)


class _Entries:
    """A table's rows as entries, each made when it is asked for; the content is the row's number."""

    def __init__(self, table: pa.Table):
        self.columns = {c: table.column(c).combine_chunks() for c in ("entry_id", "tag", "helpful", "harmful", "version")}
        self.n = table.num_rows

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: int) -> dict:
        return {"content": str(at)} | {c: x[at].as_py() for c, x in self.columns.items()}


def _edited(table: pa.Table) -> Iterator[pa.Table]:
    """The entries of a playbook after its operations, with references to their texts."""
    of = lambda kind, *names: table.filter(pc.equal(table.column("kind"), kind)).select(names)
    ordered = lambda t: t.take(np.lexsort((t.column("h").to_numpy(), t.column("pos").to_numpy())))
    place = ("kind", "pos", "h", "skip", "length", "key")
    before, batch = ordered(of(0, *place, "entry_id", "tag", "helpful", "harmful", "version")), ordered(of(1, *place, "op", "entry_ids", "tag"))
    pairs, playbook = of(2, "key", "similar"), table.column("playbook_id")[0]
    del table
    texts = pa.concat_tables([t.select(place) for t in (before, batch)])
    contents = _Known(texts.column("key").to_numpy(), pairs.column("key").to_numpy(), pairs.column("similar").to_numpy())
    texts, n, entries = texts.drop_columns("key"), before.num_rows, _Entries(before)
    parts = lambda t: (t.slice(i, 5000) for i in range(0, t.num_rows, 5000))
    rows = (r for p in parts(batch.select(["op", "entry_ids", "tag", "length"])) for r in p.to_pylist())
    ops = (r | {"content": str(n + at) if r["length"] else ""} for at, r in enumerate(rows))
    ids = (i for p in parts(before) for i in p.column("entry_id").to_pylist())
    book, outcomes = _edit(entries, ids, ops, contents)
    del contents, pairs, batch
    places = sorted(book)
    for i in range(0, max(1, len(places)), 5000):
        es = [book[at] or entries[at] for at in places[i : i + 5000]]
        refs = texts.take(pa.array([int(e["content"]) for e in es], pa.int64()))
        own = {c: pa.array([e[c] for e in es], k) for c, k in (("entry_id", pa.string()), ("tag", pa.string()), ("helpful", pa.int64()), ("harmful", pa.int64()), ("version", pa.int32()))}
        own["provenance"] = pa.array([e.get("provenance") or [] for e in es], pa.list_(pa.string()))
        own["outcome"] = pa.array([json.dumps(outcomes) if i + k == 0 else None for k in range(len(es))], pa.string())
        yield pa.table({"playbook_id": pa.array([playbook.as_py()] * len(es), playbook.type), "place": pa.array(range(i, i + len(es)), pa.int32()), **own, **{c: refs.column(c) for c in refs.schema.names}})


def _edited_whole(table: pa.Table) -> pa.Table:
    out = pa.concat_tables(_edited(table))
    S.trim()
    return out


def apply_edits(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """Edited playbooks, an entry a row, with the outcomes of the batch as JSON in the first one.

    The operations of a playbook are applied in order in one task, which gets no
    texts: which of them say the same is found before, by blocks of additions
    (`similar`), and what the entries then say is joined by text afterwards. Sets
    and edited playbooks are written on the way.
    """
    spark = entries.sparkSession
    S.small_batches(spark)
    sets, found, edited = scratch_folder(spark), scratch_folder(spark), scratch_folder(spark)
    null, book = lambda kind: F.lit(None).cast(kind), F.xxhash64("playbook_id").alias("book")
    h = F.xxhash64("content").alias("h")
    old = entries.select(
        "playbook_id", book, F.lit(0).alias("kind"), "pos", h, F.col("entry_id").cast("string").alias("entry_id"), "tag", F.col("helpful").cast("long").alias("helpful"),
        F.col("harmful").cast("long").alias("harmful"), F.col("entry_version").cast("int").alias("version"), null("string").alias("op"), null("array<string>").alias("entry_ids"), "content",
    )
    new = ops.select(
        "playbook_id", book, F.lit(1), F.col("batch_pos").alias("pos"), h, null("string"), "tag", null("long"), null("long"), null("int"), F.coalesce("op", F.lit("")), F.col("entry_ids").cast("array<string>"),
        F.when(F.col("op").isin(*_PLACING), F.col("content")),
    )
    rows = old.union(new)
    light = [f for f in rows.schema.fields if f.name != "content"]
    fields = T.StructType([*light, *(T.StructField(c, k) for c, k in (("key", T.LongType()), ("skip", T.IntegerType()), ("length", T.IntegerType()), ("tokens", T.ArrayType(T.LongType(), False))))])
    rows.mapInArrow(_sets_of_texts, fields).withColumn("slot", F.pmod("book", F.lit(_SLOTS))).write.partitionBy("slot").parquet(sets)
    texts = spark.read.schema(T.StructType([*fields, T.StructField("slot", T.LongType())])).parquet(sets)
    pairs = _similar_texts(texts, found).withColumn("kind", F.lit(2))
    table = texts.drop("slot", "tokens", "book").unionByName(pairs, allowMissingColumns=True)
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    by_name = ", ".join(f"{c} {kinds[c]}" for c in ("entry_id", "tag", "helpful", "harmful", "version"))
    shape = f"playbook_id {kinds['playbook_id']}, place int, {by_name}, provenance array<string>, outcome string, kind int, pos {kinds['pos']}, h long, skip int, length int"
    table.groupBy("playbook_id").applyInArrow(_edited_whole, shape).write.parquet(edited)
    place = ["kind", "playbook_id", "pos", "h"]
    twice = texts.groupBy(*place).count().where("count > 1").limit(1).count()  # one at most
    S.remove(spark, sets)
    S.remove(spark, found)
    contents = old.select(*place, "content").union(ops.where(F.col("op").isin(*_PLACING)).select(F.lit(1), "playbook_id", "batch_pos", h, "content"))
    contents = (contents.dropDuplicates(place) if twice else contents).select(*(F.col(c).alias(f"_{c}") for c in place), "content")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    text = F.when(F.col("kind") == 0, F.col("content")).otherwise(F.substr("content", F.col("skip") + 1, F.col("length")))
    out = spark.read.schema(shape).parquet(edited).join(contents, same, "left")
    return out.select(F.col("playbook_id").cast("int").alias("playbook_id"), F.col("place").alias("pos"), "entry_id", "tag", text.alias("content"), "helpful", "harmful", "version", "provenance", "outcome")
