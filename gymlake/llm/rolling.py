"""Rolling window features: DuckDB frames inside Arrow partitions keyed by source and slot of time.

A window of width W before time t holds all rows of the source with t - W <= their
time < t. Rows that agree in source, time, language and length are counted before
any of them moves, so a row logged a million times is one fact. Time is cut into
slots as long as the widest window; a fact goes to its own slot and, as what came
before, to the next one. So a source, however hot, is dealt out by slots, and a
task holds at most two slots of one source. There DuckDB computes, for each time
at which the source has rows, frames by RANGE: sums, distinct languages, and the
ordered list of lengths from which order statistics are read by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, tidy

#: Facts of whole groups that one DuckDB query takes, and list elements that its frames hold, at most; larger groups are cut into runs of windows.
FACTS, ELEMENTS = 20_000, 1_000_000

FEATURES = "array<struct<window_s:long,n_events:long,sum_chars:long,n_langs:long,median_chars:long,high_chars:long>>"


def _frame(width: int) -> str:
    return f"(partition by g order by t range between {width} preceding and 1 preceding)"


def _sql(widths: tuple[int, ...], copies: bool) -> str:
    """Features of each own time. copies: some facts stand for several rows, so positions are those of running counts."""
    parts = []
    for w in widths:
        sums = f"select g, t, any_value(n) n, any_value(s) s, any_value(k) k from (select g, t, own, sum(c) over x n, sum(c * l) over x s, count(distinct lang) over x k from facts window x as {_frame(w)}) where own group by g, t"
        lists = f"select g, t, list_sort(flatten(o)) o from (select g, t, own, list(o) over x o from times window x as {_frame(w)}) where own"
        if copies:
            each = f"select g, t, p.l l, sum(p.c) c from (select g, t, unnest(o) p from ({lists})) group by g, t, p.l"
            running = f"select g, t, l, sum(c) over (partition by g, t order by l) upto, sum(c) over (partition by g, t) m from ({each})"
            picked = f"select g, t, min(l) filter (upto >= (m + 1) // 2) median, min(l) filter (upto >= (99 * m + 99) // 100) high from ({running}) group by g, t"
        else:
            picked = f"select g, t, o[(len(o) + 1) // 2] median, o[(99 * len(o) + 99) // 100] high from ({lists})"
        parts.append(f"select g, t, {w} w, coalesce(n, 0) n, coalesce(s, 0) s, k, median, high from ({sums}) left join ({picked}) using (g, t)")
    fact = "{l: l, c: c}" if copies else "l"
    return f"""
with times as (select g, t, bool_or(own) own, coalesce(list({fact}) filter (l is not null), []) o from facts group by g, t)
select g, t, list({{window_s: w::bigint, n_events: n::bigint, sum_chars: s::bigint, n_langs: k::bigint, median_chars: median::bigint, high_chars: high::bigint}} order by w) features
from ({" union all ".join(parts)}) group by g, t"""


def _pieces(g: np.ndarray, t: np.ndarray, own: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(facts to take, which of them have windows to compute), within the bound of list elements. Sorted by g, t."""
    edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
    held, cost = [], 0
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if not own[lo:hi].any():
            continue
        times = np.unique(t[lo:hi][own[lo:hi]])
        size = len(times) * (hi - lo)
        if size > ELEMENTS:
            step = max(1, ELEMENTS // (hi - lo))
            for i in range(0, len(times), step):
                first, last = times[i], times[min(i + step, len(times)) - 1]
                at = np.arange(lo, hi)
                at = at[(t[at] >= first - span) & (t[at] <= last)]
                yield at, own[at] & (t[at] >= first)
            continue
        if cost + size > ELEMENTS and held:
            at = np.concatenate(held)
            yield at, own[at]
            held, cost = [], 0
        held.append(np.arange(lo, hi))
        cost += size
    if held:
        at = np.concatenate(held)
        yield at, own[at]


def _compute(facts: pa.Table, widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows source, event_s, features of whole groups, sorted by source, slot and time."""
    source, slot, t = facts["source"].combine_chunks(), facts["slot"].to_numpy(), facts["event_s"].to_numpy()
    codes = source.dictionary_encode().indices.fill_null(-1).to_numpy()
    g = np.cumsum(np.r_[0, (codes[1:] != codes[:-1]) | (slot[1:] != slot[:-1])])
    own, copies = facts["own"].to_numpy(), facts["copies"].to_numpy()
    table = pa.table({"g": g, "t": t, "lang": facts["lang"], "l": facts["length"], "c": copies})
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    with duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""}) as con:
        for at, windows in _pieces(g, t, own, max(widths)):
            part = table.take(pa.array(at)).append_column("own", pa.array(windows))
            con.register("facts", part)
            out = con.sql(_sql(widths, bool((copies[at] > 1).any()))).to_arrow_table()
            con.unregister("facts")
            names = source.take(pa.array(first[out["g"].to_numpy()]))
            for batch in pa.table([names, out["t"], out["features"]], ["source", "event_s", "features"]).to_batches(2000):
                yield batch


def _by_groups(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < FACTS:
            continue
        table = pa.Table.from_batches(held)
        source, slot = table["source"].to_pylist(), table["slot"].to_pylist()
        cut = next((i for i in range(rows - 1, 0, -1) if (source[i], slot[i]) != (source[i - 1], slot[i - 1])), 0)
        if cut:  # the last group may go on
            yield from _compute(table.slice(0, cut), widths)
            held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield from _compute(pa.Table.from_batches(held), widths)


def window_features(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(source, event_s, features) for each source and time at which `rows` (source, event_s, lang, length) has rows.

    features holds one entry per width, by width. A null source is a source; a row without time is in no window; null languages and
    lengths count as events alone; repeated rows count each. Windows without rows have counts of 0 and null order statistics.
    """
    bounded_batches(rows.sparkSession)
    span = max(widths)
    facts = rows.where(F.col("event_s").isNotNull()).groupBy("source", "event_s", "lang", "length").agg(F.count("*").alias("copies"))
    slot = ((F.col("event_s") - F.pmod("event_s", F.lit(span))) / span).cast("long")
    both = F.inline(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))))
    dealt = facts.select("source", "event_s", "lang", "length", "copies", both).repartition("source", "slot").sortWithinPartitions(F.col("source").asc_nulls_first(), "slot", "event_s")
    return dealt.mapInArrow(tidy(lambda batches: _by_groups(batches, widths)), f"source string, event_s long, features {FEATURES}")


def with_windows(rows: DataFrame, keys: list[str], widths: tuple[int, ...]) -> DataFrame:
    """A row for each of `rows` (keys, source, event_s, lang, length) and width: keys, window_s, event_s and the features of the windows before it."""
    found = window_features(rows, widths).select(F.col("source").alias("_source"), F.col("event_s").alias("_at"), "features")
    none = F.array(*[F.struct(F.lit(w).cast("long").alias("window_s"), *[F.lit(v).cast("long").alias(n) for n, v in (("n_events", 0), ("sum_chars", 0), ("n_langs", 0), ("median_chars", None), ("high_chars", None))]) for w in sorted(widths)])
    own = rows.select(*keys, "source", "event_s")
    both = own.join(found.hint("merge"), own["source"].eqNullSafe(F.col("_source")) & (F.col("event_s") == F.col("_at")), "left")
    return both.select(*keys, "event_s", F.inline(F.coalesce("features", none.cast(FEATURES)))).select(*keys, "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars")


def event_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + crc32(doc_id) mod 1000) / 6), in whole numbers."""
    x = doc_id.cast("long") + F.crc32(doc_id.cast("string")) % 1000
    return (x - F.pmod(x, F.lit(6))) * 10
