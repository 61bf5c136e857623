"""Rolling windows against plain loops, with copies, nulls, ties, and groups cut into runs of windows."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gymlake.llm import rolling

SCHEMA = "id long, source string, event_s long, lang string, length long, features string"
WIDTHS = (1800, 86400)


def position(ordered, share):
    m = len(ordered)
    return ordered[-(-share * m // 100) - 1] if m else None


def expected(rows):
    out = []
    for r in rows:
        for w in WIDTHS:
            seen = [x for x in rows if x[1] == r[1] and None not in (x[2], r[2]) and r[2] - w <= x[2] < r[2]]
            lengths = sorted(x[4] for x in seen if x[4] is not None)
            out.append((r[0], w, r[2], len(seen), sum(lengths), len({x[3] for x in seen} - {None}), position(lengths, 50), position(lengths, 99)))
    return out


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clashes") for r in rows], SCHEMA).repartition(parts)
    return [tuple(r) for r in rolling.with_windows(df, ["id"], WIDTHS).collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def rows_of(n, seed, sources=("a", "b", None, ""), span=200_000):
    rnd = random.Random(seed)
    return [(i, rnd.choice(sources), 60 * rnd.randrange(-span // 120, span // 60), rnd.choice(("en", "de", None)), rnd.choice((0, 5, 5, 700, None, i))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_loops(spark, seed):
    rows = rows_of(400, seed)
    assert sorted(got(spark, rows), key=key) == sorted(expected(rows), key=key)


def test_copies_ties_and_rows_without_time(spark):
    rows = rows_of(80, 3, span=9000)
    rows += [rows[5]] * 300 + [(1000 + i, "a", 600, "en", 3) for i in range(50)] + [(7, "a", None, "en", 4), (None, None, 600, None, None), (8, None, 1200, None, None)]
    assert sorted(got(spark, rows), key=key) == sorted(expected(rows), key=key)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_both_ends_of_a_window(spark):
    rows = [(1, "a", 0, "en", 1), (2, "a", 1799, "en", 2), (3, "a", 1800, "en", 3), (4, "a", 86400, "en", 4), (5, "a", 86401, "en", 5)]
    assert sorted(got(spark, rows)) == sorted(expected(rows))


@pytest.mark.parametrize("copies", [1, 3])
@pytest.mark.parametrize("facts, elements", [(10, 50), (1000, 300), (10**6, 10**9)])
def test_cut_groups_change_nothing(monkeypatch, facts, elements, copies):
    monkeypatch.setattr(rolling, "FACTS", facts)
    monkeypatch.setattr(rolling, "ELEMENTS", elements)
    rows = sorted({r[1:] for r in rows_of(300, 5)}, key=key)
    dealt = sorted(((r[0], r[1] // 86400 + i, r[1], r[2], r[3], copies, i == 0) for r in rows for i in (0, 1)), key=key)
    names = ["source", "slot", "event_s", "lang", "length", "copies", "own"]
    columns = [pa.array(c, t) for c, t in zip(zip(*dealt, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
    batches = pa.table(columns, names).to_batches(max_chunksize=37)
    found = {(r["source"], r["event_s"]): [tuple(f.values()) for f in r["features"]] for b in rolling._by_groups(iter(batches), WIDTHS) for r in b.to_pylist()}
    want: dict = {}
    for x in expected([(i, *r) for i, r in enumerate(r for r in rows for _ in range(copies))]):
        want.setdefault(x[0], []).append(tuple(x[i] for i in (1, 3, 4, 5, 6, 7)))
    assert found == {(r[0], r[1]): want[i * copies] for i, r in enumerate(rows)}


def test_event_times_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(5, "é" * 300_000), (-9, ""), (None, "x")], "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in docs.select("doc_id", rolling.event_time(F.col("doc_id")), F.length("text")).collect()}
    at = lambda i: 60 * ((i + zlib.crc32(str(i).encode()) % 1000) // 6)
    assert got == {5: (at(5), 300_000), -9: (at(-9), 0), None: (None, 1)}
