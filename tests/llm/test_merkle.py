"""The Merkle forest against trees built in memory, for several strides (so that trees span many passes) and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gymlake.llm.common import Scratch
from gymlake.llm.merkle import folded, manifest, steps_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))


def tree(digests):
    """(root, path of each leaf as (place, siblings) by level)."""
    rows, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(rows) > 1:
        for i, p in enumerate(paths):
            lo = at[i] - at[i] % 3
            run = rows[lo : lo + 3]
            p.append((at[i] % 3, [x for k, x in enumerate(run) if k != at[i] % 3]))
            at[i] //= 3
        rows = [sha("".join(rows[i : i + 3])) for i in range(0, len(rows), 3)]
    return (rows[0] if rows else None), paths


def even(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0


def expected(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        made[s] = (own, *tree([leaf_of(r, r[1]) for r in own]))
    root, over = tree([made[s][1] for s in sources])
    out = []
    for s, top in zip(sources, over, strict=True):
        own, sub, paths = made[s]
        for r, p in zip(own, paths, strict=True):
            h = leaf_of(r, r[1].replace("\n", "") if even(r) and r[1] is not None else r[1])
            for place, others in p + top:
                h = sha("".join([*others[:place], h, *others[place:]]))
            out.append((r[0], leaf_of(r, r[1]), sub, root, sha("".join(x for _, o in p + top for x in o)), h, h == root))
    return out


def got(spark, rows, stride, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return [tuple(r) for r in manifest(df, tampered, Scratch(spark), stride).collect()]


def rows_of(n, sources, start=0):
    return [(i, f"line {i}\nend{'é' * (i % 3)}", ("en", None, "de")[i % 3], sources[i % len(sources)], i if i % 4 else None, "x") for i in range(start, start + n)]


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_trees_of_all_sizes(spark, stride):
    rows = [(i, f"t{i}\n", "en", s, 1, "x") for n, s in enumerate([1, 2, 3, 4, 9, 10, 28, 82]) for i in range(1000 * n, 1000 * n + s) for s in [f"s{s}"]]
    assert sorted(got(spark, rows, stride)) == sorted(expected(rows))


@pytest.mark.parametrize("stride", [1, 6])
def test_nulls_repeated_rows_and_long_texts(spark, stride):
    rows = rows_of(40, ["b", None, "", "é", "a"])
    rows += [rows[7]] * 5 + [(None, "null id\n", "en", "a", 3, "x"), (None, None, None, None, None, None), (None, "null id\n", "en", "a", 3, "x")]
    rows += [(3, "another text of the same id", "en", "b", 2, "x"), (900, "w\n" * 200_000, "fr", "a", 1, "x"), (901, "", "fr", "a", 0, "x"), (-7, "\n", "fr", "a", 0, "x")]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got(spark, rows, stride), key=key) == sorted(expected(rows), key=key)


def test_a_tree_with_most_leaves_spans_runs_and_blocks(spark):
    rows = rows_of(3000, ["hot", "hot", "hot", "cold"])
    assert sorted(got(spark, rows, 3, parts=8)) == sorted(expected(rows))


def test_one_row_and_none(spark):
    rows = rows_of(1, ["s"])
    assert got(spark, rows, 6) == expected(rows)
    assert got(spark, rows, 6)[0][4] == sha("")
    assert got(spark, [], 6) == []


def test_every_changed_text_is_found(spark):
    rows = rows_of(60, ["a", "b"])
    assert {r[0]: r[6] for r in got(spark, rows, 6)} == {r[0]: not even(r) for r in rows}


def test_paths_read_back():
    assert steps_of("10" + "01" + "a" * 64 + "22" + "b" * 128) == [(1, ""), (0, "a" * 64), (2, "b" * 128)]
    assert folded("c" * 64, [(1, "a" * 64)]) == sha("a" * 64 + "c" * 64)
