"""Kernel, substring dedup, n-gram join and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gymlake.llm import ngram_join, packing, substring
from gymlake.llm.kernel import LOWER, Words, chunks, column_bytes, windows

TEXT = "doc_id long, text string, extra string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], TEXT)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0abAB.é漢😀", max_size=30)), max_size=6))
def test_words_equal_byte_split(texts):
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    words = Words(data, offsets)
    got = [[data[words.starts[i] : words.ends[i]].tobytes() for i in range(words.first[d], words.first[d + 1])] for d in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]
    digests = words.digests()
    flat = [w for ws in got for w in ws]
    assert all((a == b) == (x == y) for a, x in zip(flat, digests, strict=True) for b, y in zip(flat, digests, strict=True))


def test_chunks_cover_all_rows():
    texts = ["a" * 10, "", "b" * 50, "c", ""]
    parts = list(chunks(pa.array(texts), limit=12))
    assert [(lo, hi) for lo, hi, *_ in parts][0][0] == 0 and parts[-1][1] == 5
    assert b"".join(p[2].tobytes() for p in parts) == "".join(texts).encode()


def test_long_windows_equal_iff_words_equal():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4] * 4, np.uint64)
    w = windows(h, 13)
    same = [tuple(h[i : i + 13]) for i in range(len(w))]
    assert all((same[i] == same[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(len(w)))


# --- substring dedup


def brute_removal(rows, depth):
    words = {i: (t or "").encode().split() for i, t in rows if i is not None}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - depth + 1):
            first.setdefault(tuple(words[i][p : p + depth]), i)
    out = []
    for i, t in rows:
        ws = (t or "").encode().split()
        gone = set()
        for p in range(len(ws) - depth + 1) if i is not None else ():
            if first[tuple(ws[p : p + depth])] < i:
                gone.update(range(p, p + depth))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made_texts(n, seed, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 30))] for _ in range(4)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 15))]
        rows.append((i * 3 % 101, rng.choice([" ", "\n"]).join(ws)))
    return rows


@pytest.mark.parametrize("seed,group", [(1, 250_000), (2, 40), (3, 3)])
def test_substring_removal_equals_brute_force(spark, seed, group):
    """Also where groups exceed their budget, so that prefixes are extended and single paths split."""
    rows = made_texts(60, seed) + [(500, None), (501, ""), (502, " \n "), (None, "w1 w2 " * 20)]
    rows += [(600 + k, rows[0][1] + " w1" * 12) for k in range(5)] + [(700, "w1 " * 40)]
    got = substring.remove_repeats(table(spark, rows), depth=10, group=group).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_removal(rows, 10)


def test_substring_removal_keeps_columns_and_clean_texts(spark):
    long = " ".join(f"q{k}" for k in range(60))
    df = spark.createDataFrame([(2, long, "b", 5), (1, long, "a", 5), (3, "short\ntext", None, 10)], "doc_id long, text string, starts string, n_chars long")
    got = {r["doc_id"]: r for r in substring.apply_removal(df).collect()}
    assert got[1]["text"] == long and got[2]["text"] == "" and got[2]["starts"] == "b" and got[3]["text"] == "short\ntext"
    assert got[2]["n_chars"] == 0 and got[3]["n_chars"] == 10


def test_internal_nodes_are_runs_that_part_below():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        rows = sorted(tuple(x) for x in rng.integers(0, 3, (n, 3)).tolist())
        got = substring.internal_nodes([np.array([r[k] for r in rows]) for k in range(3)])
        for depth in range(1, 4):
            want = []
            for prefix in sorted({r[:depth] for r in rows}):
                own = [i for i, r in enumerate(rows) if r[:depth] == prefix]
                if len(own) > 1 and (depth == 3 or len({rows[i][: depth + 1] for i in own}) > 1):
                    want.append((own[0], own[-1] + 1))
            assert list(zip(*(x.tolist() for x in got[depth - 1]), strict=True)) == want


def test_maximal_runs_join_windows_that_touch():
    got = substring.maximal_runs(np.array([5, 5, 5, 7, 5]), np.array([3, 1, 40, 0, 2], np.int32), 10).to_pylist()
    assert got == [{"doc_id": 5, "begins": [1, 40], "ends": [13, 50]}, {"doc_id": 7, "begins": [0], "ends": [10]}]
    assert substring.maximal_runs(np.empty(0, np.int64), np.empty(0, np.int32), 10).num_rows == 0


def test_substring_of_empty_table(spark):
    assert substring.remove_repeats(table(spark, [])).count() == 0


# --- n-gram join


def brute_groups(rows, k=5):
    sets = {}
    for i, t in rows:
        ws = bytes(LOWER.astype(np.uint8)[list((t or "").encode())]).split() if t else []
        sets[i] = {tuple(ws[p : p + k]) for p in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def near_copies(seed, groups=8, size=14, length=120):
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(3000)]
    shared = [rng.choice(words) for _ in range(150)]
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, length, length * 3]))]
        if g % 3 == 0:
            base = shared + base[:20]
        for _ in range(size):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 60))):
                ws[rng.randrange(len(ws))] = rng.choice(words)
            text = " ".join(ws)
            rows.append((i * 7 % 1009, text.upper() if rng.random() < 0.2 else text))
            i += 1
    return rows


@pytest.mark.parametrize("small,rare_most", [(32, 24), (3, 2), (2, 1)])
def test_join_equals_brute_force(spark, small, rare_most):
    rows = near_copies(small) + [(2000, None), (2001, ""), (2002, "One"), (2003, "one"), (2004, "one two three four five"), (2005, "ONE two three four\tfive")]
    got = ngram_join.similar_groups(table(spark, rows), small=small, rare_most=rare_most).collect()
    assert sorted(tuple(r) for r in got) == brute_groups(rows)


def test_join_with_more_frequent_tokens_than_are_broadcast(spark):
    rows = [(i, f"in every document of all {t}") for i, t in near_copies(5, groups=4, size=10, length=40)]
    got = ngram_join.similar_groups(table(spark, rows), small=4, rare_most=3, max_frequent=10).collect()
    assert sorted(tuple(r) for r in got) == brute_groups(rows)


def test_frequent_tokens_are_counted_over_all_tasks(spark):
    rows = [(i, "a b c d e " + (f"x{i} y z w v" if i % 2 else "")) for i in range(300)]
    narrow = table(spark, rows).select("doc_id", "text").repartition(7)
    counts = sorted(r["n"] for r in ngram_join.frequent_tokens(narrow, ngram_join.Scratch(spark)).collect())
    assert counts == [300]


def test_word_table_keeps_its_ids_when_it_is_full():
    whole, tight = packing.WordIds(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer(), limit=2000)
    rng = random.Random(6)
    for _ in range(30):
        texts = [" ".join(f"{rng.choice(['common', 'Wörter', 'mixed'])}{rng.randint(0, 40) ** 2}" for _ in range(50)) for _ in range(3)]
        words = Words(*column_bytes(pa.array(texts)))
        (a, n), (b, m) = whole.look_up(words), tight.look_up(words)
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def test_join_edge_cases(spark):
    assert ngram_join.similar_groups(table(spark, [])).count() == 0
    got = ngram_join.similar_groups(table(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, "A b")])).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (2, 1, 1)], key=repr)
    kept = ngram_join.keep_one(table(spark, [(1, "a b"), (2, "A b"), (3, None), (4, None)])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4] and kept[0]["extra"] == "x"


def test_prefixes_of_similar_sets_share_an_entry():
    rng = np.random.default_rng(3)
    for n in (40, 63, 64, 70, 200, 260, 1000):
        for _ in range(20):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            lost = ngram_join.allowed(n) // 2
            other = np.unique(np.concatenate([base[lost:], rng.integers(0, 2**63, lost, dtype=np.uint64)]))
            base = np.unique(base)
            if len(np.intersect1d(base, other)) * 5 < 4 * len(np.union1d(base, other)):
                continue
            often = rng.random() < 0.5
            flag = (lambda x: (x % np.uint64(5)).astype(np.uint8) + 1) if often else (lambda x: (x % np.uint64(7)).astype(np.uint8))  # noqa: B023
            a, b = ngram_join.signatures(base, flag(base))[0], ngram_join.signatures(other, flag(other))[0]
            assert len(np.intersect1d(a, b)), n


# --- packing


def test_word_ids_equal_whole_text_encoding():
    table = packing.WordIds(packing.default_tokenizer())
    texts = ["It's a TEST, isn't it?  x y", "", "café \x01 a\x01b  wide　space", "<|endoftext|> a<|startoftext|>b", "naïve 漢字😀 12345 ...", "ΑΣ ΟΔΟΣ"] * 2
    data, offsets = column_bytes(pa.array(texts))
    words = Words(data, offsets)
    ids, size = table.look_up(words)
    ends = np.concatenate([[0], np.cumsum(size)])[words.first]
    for d, text in enumerate(texts):
        assert ids[ends[d] : ends[d + 1]].tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, sequence):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(sequence - n)
    return sorted(left)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_equals_piece_by_piece_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for length, first_rank, first, per, offset in (rows := packing.plan(counts, 32)):
        ranks = [r for r in rows if r[0] == length and r[1] > first_rank]
        end = min((r[1] for r in ranks), default=counts[length])
        for rank in range(first_rank, end):
            step = rank - first_rank
            bins.setdefault(first + step // per, []).append((offset + step % per * length, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(32 - sum(n for _, n in p) for p in bins.values()) == plain_best_fit(lengths, 32)
    assert sum(len(p) for p in bins.values()) == len(lengths)


def test_pack_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "été"]) for _ in range(rng.choice([0, 3, 30, 400])))) for i in range(60)]
    rows += [(100, None), (101, "a"), (101, "a")]
    got = packing.pack(table(spark, rows), sequence=64).collect()
    table_ = packing.WordIds(packing.default_tokenizer())
    whole = {i: np.array(table_.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    sequences = {}
    for r in got:
        piece = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(whole[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in got) == sum(len(whole[i]) for i, _ in rows)
    assert sorted(plain_best_fit([r["length"] for r in got], 64)) == sorted(64 - sum(n for _, n in p) for p in sequences.values())
    assert packing.pack(table(spark, [])).count() == 0


def test_pack_query_is_gapless(spark):
    from gymlake.llm.packing_queries import op6_pack_sequences

    df = op6_pack_sequences(spark, "/root/testdata/sf0.001").cache()
    per = df.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n <> end or n > 4096").count() == 0
    fill = per.agg(F.avg("n")).first()[0]
    assert fill > 0.97 * 4096
