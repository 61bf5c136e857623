"""An incremental frontier: candidates arrive, the points that no other one dominates stay, evictions are told.

A point dominates another if it is at least as good on every axis and better on
one; equal points stay together. What a batch's own rows dominate is dropped
before the shuffle, in each task, for it can never be on the frontier; so a group
that gets a third of all candidates sends each task's frontier of it alone. The
keyed state holds a group's frontier and a running number of its changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state of this kind needs, for queries that start and end inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def undominated(points: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Which rows no other row, and no row of `against`, dominates. Higher is better; rows with a missing value never stay.

    By falling sum of axes: then only an earlier row can dominate a later one.
    """
    keep = np.zeros(len(points), dtype=bool)
    front = against if against is not None else np.empty((0, points.shape[1]))
    front = front.copy()
    order = np.lexsort([*(-points.T[::-1]), -points.sum(axis=1)])
    for i in order:
        p = points[i]
        if np.isnan(p).any():
            continue
        if len(front) and ((front >= p).all(axis=1) & (front > p).any(axis=1)).any():
            continue
        keep[i] = True
        front = np.vstack([front, p])
    return keep


class Frontier(StatefulProcessor):
    """Rows (key, n, point, axes..., change): `enter` or `evict`, numbered within the key. Points that are there already change nothing."""

    def __init__(self, key: str, point: str, axes: tuple[str, ...]):
        self.key, self.point, self.axes = key, point, axes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.front = handle.getListState("front", f"{self.point} long, " + ", ".join(f"{a} double" for a in self.axes))
        self.changes = handle.getValueState("changes", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.front.get()] if self.front.exists() else []
        n = self.changes.get()[0] if self.changes.exists() else 0
        known = {(int(r[0]), *r[1:]) for r in held}
        before = np.array([r[1:] for r in held], dtype=float).reshape(-1, len(self.axes))
        came: list[tuple] = []
        for chunk in rows:  # each is cut to its own frontier before the next is read
            came += [(int(x[0]), *map(float, x[1:])) for x in chunk[[self.point, *self.axes]].itertuples(index=False) if not pd.isna(x[0])]
            came = [r for r in dict.fromkeys(came) if r not in known]
            points = np.array([r[1:] for r in came], dtype=float).reshape(-1, len(self.axes))
            came = [r for r, k in zip(came, undominated(points, before), strict=True) if k]
        now = np.array([r[1:] for r in came], dtype=float).reshape(-1, len(self.axes))
        gone = [bool(((now >= p).all(axis=1) & (now > p).any(axis=1)).any()) for p in before]
        told = [(r, "evict") for r, g in zip(held, gone, strict=True) if g] + [(r, "enter") for r in sorted(came)]
        if not told:
            return
        self.front.put([r for r, g in zip(held, gone, strict=True) if not g] + sorted(came))
        self.changes.update((n + len(told),))
        out = [(key[0], n + i + 1, int(r[0]), *r[1:], change) for i, (r, change) in enumerate(told)]
        yield pd.DataFrame(out, columns=[self.key, "n", self.point, *self.axes, "change"])

    def close(self) -> None:
        pass


def frontier_changes(candidates: DataFrame, key: str, point: str, axes: tuple[str, ...]) -> DataFrame:
    """The changes of each key's frontier as its candidates (key: string, point: long, axes) arrive.

    A candidate with a null axis was not measured and never enters. After each batch, the points whose last change is `enter` are the
    frontier of all candidates so far. Keys and points may repeat; null keys are a key.
    """
    kind = f"{key} string, {point} long, " + ", ".join(f"{a} double" for a in axes)
    changed = f"{key} string, n long, {point} long, " + ", ".join(f"{a} double" for a in axes) + ", change string"

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.groupby(key, dropna=False, group_keys=False)[df.columns.tolist()].apply(lambda g: g[undominated(g[list(axes)].to_numpy(dtype=float))])

    narrow = candidates.select(F.col(key).cast("string").alias(key), F.col(point).cast("long").alias(point), *[F.col(a).cast("double").alias(a) for a in axes])
    kept = narrow.mapInPandas(thin, kind)
    return kept.groupBy(key).transformWithStateInPandas(Frontier(key, point, axes), outputStructType=changed, outputMode="Append", timeMode="None")


def frontier_of(changes: DataFrame, key: str, point: str, axes: tuple[str, ...]) -> DataFrame:
    """The frontier that a log of changes describes."""
    last = changes.groupBy(key, point, *axes).agg(F.max_by("change", "n").alias("_change"))
    return last.where("_change = 'enter'").select(key, point, *axes)
