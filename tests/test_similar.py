"""Joins of similar sets against brute force, and what they shuffle."""

import json
import random

import numpy as np
import pytest

from gymlake.operators import playbook as B
from gymlake.operators import similar as S


def shuffled(spark) -> int:
    """Bytes of shuffles written so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, *none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def corpus(r, n, vocabulary, longest):
    texts = []
    for i in range(n):
        if i > 5 and r.random() < 0.5:  # copies with a few words changed, or none
            words = r.choice(texts).split()
            for _ in range(r.choice((0, 0, 1, 3, len(words) // 5))):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        else:
            words = [f"word{int(vocabulary * r.random() ** 3)}" for _ in range(r.randint(1, longest))]
        texts.append(" ".join(words))
    return texts


def best_by_brute_force(rows, incoming):
    sets = [(i, p, {w for w in (t or "").lower().split() if len(w) > 2}) for i, p, t in rows]
    want = {}
    for i, _, a in sets:
        if a and incoming(i):
            found = [(jaccard(a, b), -p, j) for j, p, b in sets if j != i and b and jaccard(a, b) >= 0.7]
            if found:
                want[i] = max(max(found), want.get(i, (0,)))
    return {i: (j, s) for i, (s, _, j) in want.items()}


@pytest.mark.parametrize("block", [6_000_000, 900])
def test_near_duplicates_shuffle_less_than_the_texts(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_TOKENS", block)
    r = random.Random(5)
    texts = corpus(r, 600, 3000, 120)
    texts[40:60] = ["the same rule for every case that comes up"] * 20  # with its incoming ones a group of exact copies
    texts[80], texts[81], texts[100], texts[101] = None, None, "", "a b"
    texts[120], texts[121] = "aaa bbb ccc ddd eee fff ggg", "aaa bbb ccc ddd eee fff ggg hhh iii jjj"  # exactly 0.7
    texts[140], texts[141] = "alone", "alone"
    texts.append(texts[300])
    rows = [(i, 1000 - i if i < 100 else i, t) for i, t in enumerate(texts)] + [(20, 700, texts[90]), (20, 701, texts[91])]  # and an id that comes three times
    spark.createDataFrame(rows, "entry_id long, pos long, content string").repartition(4).write.parquet(f"{tmp_path}/entries")
    entries = spark.read.parquet(f"{tmp_path}/entries")
    before = shuffled(spark)
    got = {x["new_id"]: (x["entry_id"], x["similarity"]) for x in B.near_duplicates(entries, entries.where("entry_id % 20 = 0")).collect()}
    after = shuffled(spark)
    assert got == best_by_brute_force(rows, lambda i: i % 20 == 0)
    assert got[40] == (59, 1.0) and got[120] == (121, 0.7) and got[140] == (141, 1.0) and 80 not in got and 100 not in got
    assert after - before < sum(len(t or "") for t in texts)


def test_near_duplicates_of_nothing(spark):
    entries = spark.createDataFrame([(1, 1, "some words here")], "entry_id long, pos long, content string")
    assert B.near_duplicates(entries, entries.where("false")).collect() == [] == B.near_duplicates(entries, entries).collect()


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9, 1.0])
def test_similar_finds_all_pairs(monkeypatch, threshold):
    monkeypatch.setattr(S, "CHUNK", 50)
    r = random.Random(int(threshold * 10))
    for _ in range(20):
        words = r.choice((6, 30, 400))
        sets = [sorted(r.sample(range(words), r.randint(1, min(words, 40)))) for _ in range(60)]
        sets += [sorted({*s[: len(s) * 9 // 10], r.randrange(words)}) for s in sets[:20]]
        left, right = sets[::2], sets[1::2] + sets[:6]
        pack = lambda xs: (np.array([w * 7919 - 999 for s in xs for w in s], np.int64), np.cumsum([0, *map(len, xs)]))
        stored, sought, similarity = S.Sought(*pack(left), threshold).similar(*pack(right))
        want = {(j, i): s for j, b in enumerate(right) for i, a in enumerate(left) if (s := jaccard(set(a), set(b))) >= threshold}
        assert dict(zip(zip(stored.tolist(), sought.tolist(), strict=True), similarity.tolist(), strict=True)) == want


def largest_read(spark, since: int) -> int:
    """Most bytes of shuffles that a task read, in stages from this number on."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsc.sc().statusStore(), 0
    none = spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
    stages = store.stageList(None, False, False, *none)
    for s in map(stages.apply, range(stages.size())):
        if s.stageId() >= since:
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            reads = [t.taskMetrics().get().shuffleReadMetrics() for t in map(tasks.apply, range(tasks.size())) if t.taskMetrics().isDefined()]
            most = max([most, *(r.localBytesRead() + r.remoteBytesRead() for r in reads)])
    return most


def stage_now(spark) -> int:
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, *none)
    return max((stages.apply(i).stageId() for i in range(stages.size())), default=-1) + 1


ENTRY = "playbook_id int, pos long, entry_id string, tag string, content string, helpful int, harmful int, entry_version int"
OP = "playbook_id int, batch_pos long, op string, entry_ids array<string>, tag string, content string"


def edited(spark, entries, ops):
    out = {}
    for x in B.apply_edits(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(ops, OP)).orderBy("playbook_id", "pos").collect():
        out.setdefault(x["playbook_id"], []).append(x.asDict())
    return out


def edited_at_once(entries, ops):
    """All in one list, with contents."""
    out = {}
    for p in {x[0] for x in entries + ops}:
        old = [dict(zip(("entry_id", "tag", "content", "helpful", "harmful", "version"), x[2:], strict=True)) for x in sorted(e for e in entries if e[0] == p)]
        new = [dict(zip(("op", "entry_ids", "tag", "content"), x[2:], strict=True)) for x in sorted((o for o in ops if o[0] == p), key=lambda o: o[1])]
        book, outcomes = B.edit_playbook(old, new)
        out[p] = [{"playbook_id": p, "pos": i, **e, "provenance": e.get("provenance") or [], "outcome": None if i else json.dumps(outcomes)} for i, e in enumerate(book)]
    return {p: book for p, book in out.items() if book}


@pytest.mark.parametrize("block", [6_000_000, 300])
def test_edits_of_texts_that_are_joined_afterwards(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_TOKENS", block)
    r = random.Random(8)
    texts = corpus(r, 300, 400, 25) + ["", "  ", "Ünïcode Wörter ÉTÉ straße 数字 四五六七 x_y", " \x1cspaced  out words here\t\n", "a b"]
    entries = [(i % 3, i, f"e{i % 140}" if i > 145 else f"e{i}", f"t{i % 4}", r.choice(texts), i % 5, i % 3, i % 4) for i in range(150)]
    entries += [(9, 1, "gone", "t", "all of this playbook goes", 1, 1, 1)]
    entries += [(7, 1, "lone", "t", "no operation comes here", 1, 1, 1)]
    ids = [e[2] for e in entries] + ["new-3", "new-10", "nobody"]
    ops = []
    for i in range(240):
        named = r.choice((None, [], r.sample(ids, 1), r.sample(ids, 1), r.sample(ids, 2), r.sample(ids, 3)))
        ops.append((i % 4, i, r.choice(("add", "add", "add", "update", "update", "merge", "remove", "dance", None)), named, r.choice((None, "", "A b", "t1")), r.choice([*texts, None])))
    ops.append((9, 1, "remove", ["gone"], None, None))
    got, want = edited(spark, entries, ops), edited_at_once(entries, ops)
    assert got == want
    assert {o for book in want.values() for o in json.loads(book[0]["outcome"])} == {"added", "suppressed", "updated", "merged", "removed", "rejected"}


def test_edits_at_one_place_keep_each_text(spark):
    entries = [(1, 5, i, "t", c, 0, 0, 1) for i, c in (("a", "first text of all"), ("b", "another one here"), ("c", "another one here"), ("d", None))]
    ops = [(1, 0, "update", ["a"], "t", " sharper "), (1, 0, "update", ["a"], "t", " sharper ")]
    book = edited(spark, entries, ops)[1]
    assert sorted((x["entry_id"], x["content"], x["version"]) for x in book) == [("a", "sharper", 3), ("b", "another one here", 1), ("c", "another one here", 1), ("d", None, 1)]


def test_edits_do_not_bring_the_texts_of_a_playbook_to_one_task(spark):
    r = random.Random(2)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=4000)) for _ in range(300)]
    entries = [(1, i, str(i), "t", t, 0, 0, 1) for i, t in enumerate(texts)]
    ops = [(1, i, "add" if i % 2 else "update", [str(i)], "t", f"new rule {t}") for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        since = stage_now(spark)
        book = edited(spark, entries, ops)[1]
        most = largest_read(spark, since)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [x["content"] for x in book] == [t if i % 2 else f"new rule {t}".strip() for i, t in enumerate(texts)]
    assert 0 < most < 4000 * 300 / 2
