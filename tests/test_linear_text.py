"""Parsers of odd replies: linear versions against plain ones that rescan, on random texts, and their time on bad ones."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gymlake.functions import text as X
from gymlake.plans.catalogue import QUERIES
from gymlake.sources import files as S
from tests.oracle import SF


def end_of(text, at):
    """Where the object that opens at `at` ends, by reading on from there."""
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        ch = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if depth == 0:
                return i + 1
    return None


@pytest.mark.parametrize("seed", range(6))
def test_mates_of_braces(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        text = "".join(rnd.choice('{{}}""\\\\ab') for _ in range(rnd.randrange(40)))
        assert X.brace_mates(text) == [(i, end_of(text, i)) for i, ch in enumerate(text) if ch == "{"]


def test_objects_first_last_and_preferred():
    text = '} { {"a": 1} x {"scores": "}"} { y {"b": {}} {"c'
    assert [x for _, x in X.balanced_objects(text)] == ['{"a": 1}', '{"scores": "}"}', '{"b": {}}']
    assert X.outer_braces(text) == '{"a": 1}' and X.outer_braces(text, True) == '{"scores": "}"}' and X.outer_braces(text, True, '"a"') == '{"a": 1}'
    assert X.outer_braces("{{{") is X.outer_braces("", True) is None


def rescanned(text, stop_tag):
    tags = [(m.start(), m.end(), bool(m.group(1))) for m in re.finditer(r"<(/?)think>", text, re.I)]
    if not tags:
        return text
    closes, gone = [t for t in tags if t[2]], []
    for start, end, closing in tags:
        if closing:
            continue
        mate = next((c for c in closes if c[0] > start), None)
        if mate:
            closes.remove(mate)
            gone.append((start, mate[1]))
        else:
            stop = re.search(f"<{stop_tag}>", text[end:], re.I)
            gone.append((start, end + stop.start() if stop else len(text)))
    gone += [(0, c[1]) for c in closes]
    return "".join(ch for i, ch in enumerate(text) if not any(a <= i < b for a, b in gone)).strip()


@pytest.mark.parametrize("seed", range(4))
def test_thinking_removed_equals_rescanning(seed):
    rnd = random.Random(seed)
    for _ in range(500):
        text = "".join(rnd.choice(["<think>", "</think>", "</THINK>", "<obs>", "a", " b "]) for _ in range(rnd.randrange(14)))
        assert X.thinking_removed(text, "obs") == rescanned(text, "obs"), text


def test_bad_texts_take_linear_time():
    for make in (lambda n: "{" * n, lambda n: '{"' * n, lambda n: "<think>" * n + "</think>" * n, lambda n: "</think><think>" * n):
        start = time.time()
        text = make(100_000)
        X.outer_braces(text, True, "x")
        X.thinking_removed(text, "obs")
        assert time.time() - start < 5


def test_whole_tables_of_replies(spark):
    """strip_thinking and judge_parse over every turn, against what their inputs were made of."""
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    shapes = {0: "<think>a</think>{}", 1: "<THINK>a<think>b</think>c</think>{}", 2: "lost</think>{}", 3: "{}<think>never closed <obs>kept", 4: "{}"}
    for r in QUERIES["strip_thinking"](spark, SF).collect():
        assert r["clean"] == rescanned(shapes[r["conv_id"] % 5].replace("{}", turns[r["conv_id"], r["turn"]]), "obs")
    rows = QUERIES["judge_parse"](spark, SF).collect()
    assert len(rows) == len(turns)
    for r in rows:
        kind, n = r["conv_id"] % 6, r["turn"] % 7
        scored = kind < 4
        want = (min(n, 5) if n > 0 else 0, 4, 2, 1, 5) if scored else (0, 0, 0, 0, 0)
        assert (r["format"], r["factuality"], r["consistency"], r["realism"], r["quality"]) == want and r["success"] == scored
        valid = [x for x in want if x > 0]
        assert r["total_score"] == pytest.approx(sum(valid) / len(valid) if valid else 0)
        assert r["strengths"] == (["a", "b"] if kind < 3 else []) and r["weaknesses"] == (["one"] if kind < 3 else [])
        assert r["error_message"] == (None if scored else "Empty output" if kind == 4 else "No JSON object found")


def test_texts_without_a_tag_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("plain",), (None,), ("<think>x</think> y",)], "t string").select(X.strip_thinking(F.col("t")).alias("c"))
    assert [r[0] for r in df.collect()] == ["plain", None, "y"]


def test_lines_are_numbered_over_the_splits_of_a_file(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    want = {}
    for name, n in (("a", 5000), ("b", 3), ("c", 0)):
        rows = [json.dumps({"i": i, "pad": "é" * (i % 50)}) for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(x + "\n" * (i % 7 == 0) for i, x in enumerate(rows)), encoding="utf-8")
        want[name] = rows
    try:
        spark.conf.set(key, "8k")
        lines = S.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = lines.collect()
        strict = S.strict_lines(spark, str(tmp_path), "i long, pad string").select("row.i").collect()
        bad = tmp_path / "b.jsonl"
        bad.write_text(bad.read_text() + "\nnot json\n")
        with pytest.raises(Exception, match=r"b\.jsonl:4: not a JSON object"):
            S.strict_lines(spark, str(tmp_path), "i long, pad string").collect()
    finally:
        spark.conf.set(key, before)
    for name, rows in want.items():
        own = {r["line"]: r["value"] for r in got if r["file"].endswith(f"{name}.jsonl")}
        assert own == dict(enumerate(rows))
    assert sorted(r["i"] for r in strict) == sorted([*range(5000), 0, 1, 2])
