"""Queries without SQL against brute force on small tables."""

import difflib
import json
import random
import re
from itertools import combinations

from gymlake.plans import catalogue


def test_self_consistency_compares_whole_texts(spark, tmp_path):
    head = "the same opening sentence of every sample, " * 6
    convs = {1: [head + "then apples", head + "but never any pears at all" * 9, head + "then apples!"], 2: [head], 3: [], 4: ["kurz", "kürzer"]}
    rows = [(c, 2 * i + 1, "assistant", t) for c, texts in convs.items() for i, t in enumerate(texts)] + [(c, 0, "user", "go") for c in convs]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n"], r["agreement"]) for r in catalogue.QUERIES["self_consistency"](spark, str(tmp_path)).collect()}
    for c, texts in convs.items():
        ratios = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in combinations(texts, 2)]
        want = sum(ratios) / len(ratios) if ratios else float(len(texts))
        assert got[c][0] == len(texts) and abs(got[c][1] - want) < 1e-12
    assert got[1][1] < 0.95


def scanned(book, ops):
    """Edits by scanning the book for every operation."""
    outcomes = []
    tokens = lambda t: {w for w in re.findall(r"[^\W_]+", t.lower()) if len(w) > 2}
    same = lambda a, b: bool(a | b) and len(a & b) / len(a | b) >= 0.7
    for n, (op, ids, tag, content) in enumerate((*o[:3], o[3].strip()) for o in ops):
        at = [next((k for k, e in enumerate(book) if e[0] == i), None) for i in ids]
        if op == "add":
            known = any(same(tokens(content), tokens(e[2])) for e in book)
            book = book if known else [*book, (f"new-{n}", tag, content, 0, 0, 1)]
            outcomes.append("suppressed" if known else "added")
            continue
        at = [k for k in at if k is not None]
        if len(at) < 2 if op == "merge" else (len(ids), len(at)) != (1, 1):
            outcomes.append("rejected")
        elif op == "update":
            i, _, _, h, b, v = book[at[0]]
            book = [*book[: at[0]], (i, tag, content, h, b, v + 1), *book[at[0] + 1 :]]
            outcomes.append("updated")
        else:
            olds, rest = [book[k] for k in at], [e for k, e in enumerate(book) if k not in at]
            new = (f"new-{n}", tag, content, sum(e[3] for e in olds), sum(e[4] for e in olds), max(e[5] for e in olds) + 1)
            book = rest if op == "remove" else [*rest[: min(at)], new, *rest[min(at) :]]
            outcomes.append("removed" if op == "remove" else "merged")
    return book, outcomes


def test_playbook_edits_take_all_entries_and_whole_contents(spark, tmp_path):
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(460)]
    for i in range(50, 460, 3):  # near copies of earlier entries of the playbook
        texts[i] = texts[i - 10 * r.randint(1, 5)] + " extra"
    rows = [(i, t, f"src{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got, told = {}, {}
    for x in catalogue.QUERIES["playbook_edits"](spark, str(tmp_path)).orderBy("playbook_id", "pos").collect():
        got.setdefault(x["playbook_id"], []).append(tuple(x[c] for c in ("entry_id", "tag", "content", "helpful", "harmful", "version")))
        if x["outcome"]:
            told[x["playbook_id"]] = json.loads(x["outcome"])
    seen = set()
    for p in range(10):
        own = range(p, 460, 10)
        book = [(str(i), f"src{i % 3}", texts[i], i % 5, i % 3, i % 4) for i in own]
        ops = [(("add", "update", "merge", "remove")[i // 10 % 4], [str(i), str(i + 20)] if i // 10 % 4 == 2 or i % 70 < 10 else [str(i)], f"src{i % 3}", f"new rule {texts[i]}") for i in own]
        assert (got[p], told[p]) == scanned(book, ops)
        seen.update(told[p])
    assert seen == {"added", "suppressed", "updated", "merged", "removed", "rejected"}
