"""A forest of Merkle trees in external memory, with proofs and their check.

Leaves are sorted into runs (range partitions of tree and order, so that a tree
with a third of all leaves is many runs) and numbered from 0 within their tree. A
node is known by its coordinate: tree, level, pos. Its children are the nodes 3 *
pos, 3 * pos + 1 and 3 * pos + 2 of the level below.

Nodes are stored as Parquet, a folder per level. A pass reads the last level that
is stored, in blocks of 3**STRIDE neighbours, each in order of pos, and streams
the next STRIDE levels out; a block is all that is ever in memory. Proofs are
read from the store by scans that merge, block by block, the path above a block,
its inner nodes and its nodes, all sorted by coordinate. So passes go with the
logarithm of the largest tree to the base 3**STRIDE, and no tree, level or proof
goes through the driver or one task. A path is a text: for each level the node's
place among its siblings, their number, their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch, bounded_batches, tidy

FAN, STRIDE = 3, 6
HEX = 64
NODE = "tree string, leaves long, pos long, digest binary, level int"


def counted(value: Column) -> Column:
    """A value with its UTF-8 byte count, so that no two rows have the same text; null is a minus sign."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[counted(v) for v in values]), 256))


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    return -(-leaves // FAN**level)


def steps_of(path: str) -> list[tuple[int, str]]:
    """(place, digests of the siblings) by level, lowest first."""
    out, at = [], 0
    while at < len(path):
        end = at + 2 + HEX * int(path[at + 1])
        out.append((int(path[at]), path[at + 2 : end]))
        at = end
    return out


def folded(digest: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for place, others in steps:
        digest = joined((others[: HEX * place], digest, others[HEX * place :]))
    return digest


def numbered(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Leaves with pos (place in their tree by `order`, nulls first, then digest) and the number of leaves of their tree."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "digest")]
    runs = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("at"))
    runs = scratch.table(runs)
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row per run that holds the tree
    parts = runs.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.select(F.col("tree").alias("_tree"), F.col("run").alias("_run"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("leaves"))
    both = runs.join(parts.hint("merge"), F.col("run").eqNullSafe(F.col("_run")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return both.select(*leaves.columns, "leaves", (F.col("at") + F.col("shift")).alias("pos"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield packed()
            held = []
    if held:
        yield packed()


class Forest:
    """Trees over `leaves` (tree, digest and any payload), each by `order`; stored below the scratch folder.

    Repeated leaves stay, each at a place of its own; a null tree is a tree; no leaves give no trees.
    """

    def __init__(self, leaves: DataFrame, order: list[str], scratch: Scratch, stride: int = STRIDE):
        self.spark, self.stride, self.payload = leaves.sparkSession, stride, [c for c in leaves.columns if c not in ("tree", "digest")]
        bounded_batches(self.spark)
        self.base = scratch.table(numbered(leaves, order, scratch))
        self.most = self.base.agg(F.max("leaves")).first()[0] or 0
        self.folder = scratch.folder()
        self.bases = [0]  # levels at which a pass has begun
        while width(self.most, self.bases[-1]) > 1:
            self._grow(self.bases[-1])
            self.bases.append(self.bases[-1] + stride)

    def nodes(self, low: int, high: int) -> DataFrame:
        """Nodes of the levels low..high; those of level 0 are the leaves."""
        stored = self.spark.read.schema(NODE).parquet(self.folder) if len(self.bases) > 1 else self.spark.createDataFrame([], NODE)
        stored = stored.where(F.col("level").between(low, high))
        return self.base.select("tree", "leaves", "pos", "digest", F.lit(0).alias("level")).union(stored) if low == 0 else stored

    def tops(self) -> DataFrame:
        """(tree, leaves, digest) of each tree's root."""
        return self.nodes(0, self.bases[-1]).where(F.col("leaves") <= F.pow(F.lit(FAN), F.col("level"))).select("tree", "leaves", "digest")

    def _grow(self, level: int) -> None:
        stride, block = self.stride, FAN**self.stride
        schema = pa.schema([("tree", pa.string()), ("leaves", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary()), ("level", pa.int32())])

        def levels(rows):
            for (tree, b, leaves), members in groupby(rows, key=lambda r: (r[0], r[2] // block, r[1])):
                now = [r[3].hex() for r in members]
                for up in range(level + 1, level + stride + 1):
                    if width(leaves, up - 1) == 1:
                        break
                    now = [joined(now[i : i + FAN]) for i in range(0, len(now), FAN)]
                    first = b * block // FAN ** (up - level)
                    for i, digest in enumerate(now):
                        yield tree, leaves, first + i, bytes.fromhex(digest), up

        below = self.nodes(level, level).where(F.col("leaves") > FAN**level).select("tree", "leaves", "pos", "digest")
        dealt = below.repartition("tree", F.floor(F.col("pos") / block)).sortWithinPartitions(F.col("tree").asc_nulls_first(), "pos")
        grown = dealt.mapInArrow(tidy(lambda batches: _in_batches(levels(_in_order(batches)), schema)), NODE)
        grown.sortWithinPartitions("level", "tree", "pos").write.mode("append").partitionBy("level").parquet(self.folder)

    def proven(self, above: DataFrame, finish: Callable, schema: str) -> DataFrame:
        """finish(payload, digest, steps, tops) of each leaf, as rows of `schema`.

        above: tree, leaves, tops (texts handed on) and path of each tree's root. steps are those of the leaf, then of what is above.
        """
        whole = above.select("tree", "leaves", F.lit(0).cast("long").alias("block"), "tops", "path")
        paths = None
        for level in reversed(self.bases):
            ends = F.col("leaves") <= FAN ** (level + self.stride)  # trees whose root this pass reaches
            begins = F.lit(True) if level == 0 else F.col("leaves") > FAN**level
            heads = whole.where(ends & begins)
            if paths is not None:
                heads = heads.union(paths)
            if level == 0:
                return self._scan(0, heads, self.payload, finish, schema)
            onward = lambda payload, digest, steps, tops: (payload[0], payload[1], payload[2], tops, "".join(f"{place}{len(others) // HEX}{others}" for place, others in steps))
            paths = self._scan(level, heads, ["tree", "leaves", "pos"], onward, "tree string, leaves long, block long, tops array<string>, path string")

    def _scan(self, level: int, heads: DataFrame, carried: list[str], finish: Callable, schema: str) -> DataFrame:
        """Merge, by coordinate, what is above each block with its nodes from the store."""
        stride, block = self.stride, FAN**self.stride
        own = self.base if level == 0 else self.nodes(level, level).where(F.col("leaves") > FAN**level)
        kinds = {f.name: f.dataType for f in own.schema}
        blank = lambda names, of=None: [F.lit(None).cast(kinds[c]).alias(f"p_{c}") if of is None else F.col(c).alias(f"p_{c}") for c in names]
        at = lambda up: F.floor(F.col("pos") / block) if up is None else F.floor(F.col("pos") * F.pow(F.lit(FAN), F.col("level") - level).cast("long") / block)
        no_head = [F.lit(None).cast("array<string>").alias("tops"), F.lit(None).cast("string").alias("path")]
        rows = own.select("tree", at(None).alias("block"), F.lit(level).alias("level"), "pos", "leaves", "digest", *no_head, *blank(carried, own))
        inner = self.nodes(max(1, level + 1), level + stride - 1)
        rows = rows.union(inner.select("tree", at(inner).alias("block"), "level", "pos", "leaves", "digest", *no_head, *blank(carried)))
        rows = rows.union(heads.select("tree", "block", F.lit(level + stride).alias("level"), F.lit(0).cast("long").alias("pos"), "leaves", F.lit(None).cast("binary").alias("digest"), "tops", "path", *blank(carried)))
        dealt = rows.repartition("tree", "block").sortWithinPartitions(F.col("tree").asc_nulls_first(), "block", F.col("level").desc(), "pos")
        target = self.spark.createDataFrame([], schema).schema
        arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in target.fields])

        def out(rows):
            for _, members in groupby(rows, key=lambda r: r[:2]):
                head = next(members)
                leaves, tops, last = head[4], head[6], steps_of(head[7])
                known: dict[int, dict[int, str]] = {}
                bottom = []
                for r in members:
                    known.setdefault(r[2], {})[r[3]] = r[5].hex()
                    if r[2] == level:
                        bottom.append(r)
                seen: dict[tuple[int, int], list] = {}

                def climb(up: int, pos: int, leaves=leaves, last=last, known=known, seen=seen) -> list:
                    if up == level + stride or width(leaves, up) == 1:
                        return last
                    if (up, pos) not in seen:
                        mates = range(pos - pos % FAN, min(pos - pos % FAN + FAN, width(leaves, up)))
                        seen[up, pos] = [(pos % FAN, "".join(known[up][x] for x in mates if x != pos)), *climb(up + 1, pos // FAN)]
                    return seen[up, pos]

                for r in bottom:
                    yield finish(r[8:], r[5].hex(), climb(level, r[3]), tops)

        return dealt.mapInArrow(tidy(lambda batches: _in_batches(out(_in_order(batches)), arrow)), target)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "int": pa.int32()}[kind]


def manifest(docs: DataFrame, tampered: Column, scratch: Scratch, stride: int = STRIDE) -> DataFrame:
    """A leaf per row, a tree per source, a tree of their roots; proofs, folded again with leaves of `tampered` texts.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. tampered: a text column; where it is null or equals
    the text, the leaf is the row's own. Null values of any column have a leaf of their own kind; leaves of a source ascend by doc_id
    (null first), then digest, so repeated rows stay and stand side by side. Other columns are not read. No rows give no rows.
    """
    c = F.col
    fields = lambda text: leaf_digest(c("doc_id"), c("source"), c("lang"), c("n_chars"), text)
    leaves = docs.select(c("source").cast("string").alias("tree"), fields(c("text")).alias("digest"), c("doc_id").cast("long").alias("doc_id"), F.when(tampered != c("text"), fields(tampered)).alias("changed"))
    by_source = Forest(scratch.table(leaves), ["doc_id"], scratch, stride)
    tops = by_source.tops().select(F.lit("").alias("tree"), "digest", F.col("tree").alias("source"), F.col("leaves").alias("n"))
    over_all = Forest(tops, ["source"], scratch, stride)
    found = over_all.tops().first()
    root = found["digest"].hex() if found else ""

    def to_source(payload, digest, steps, tops):
        return payload[0], payload[1], [digest], "".join(f"{place}{len(others) // HEX}{others}" for place, others in steps)

    start = over_all.tops().select("tree", "leaves", F.array().cast("array<string>").alias("tops"), F.lit("").alias("path"))
    above = over_all.proven(start, to_source, "tree string, leaves long, tops array<string>, path string")

    def prove(payload, digest, steps, tops):
        changed = payload[1].hex() if payload[1] is not None else digest
        return payload[0], digest, tops[0], joined(others for _, others in steps), folded(changed, steps)

    proofs = by_source.proven(scratch.table(above), prove, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (c("folded_root") == root).alias("verified"))
