"""URL rules by hand and by association, against plain loops and by SQL where rules are mined."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gymlake.llm import url_rules as U
from gymlake.llm.common import Scratch
from gymlake.llm.url_rules_queries import OP11_SQL, RULES, op11_url_filter
from tests.oracle import compare, connect

MID = "/root/testdata/sf0.1"


def pages(spark, urls, keys=None):
    return spark.createDataFrame([(k, u, "clash", "clash") for k, u in zip(keys or range(len(urls)), urls, strict=True)], "page_id long, url string, host string, tokens string")


def labels(spark, bad):
    return spark.createDataFrame(list(bad), "page_id long, bad boolean")


def judged(spark, urls, bad=(), keys=None, rules=RULES):
    return [tuple(r) for r in U.judge(pages(spark, urls, keys), rules, labels(spark, bad), Scratch(spark)).collect()]


def test_mined_rules_take_part_and_equal_sql(spark):
    compare(spark, connect(MID), op11_url_filter, OP11_SQL, MID)
    verdicts = op11_url_filter(spark, MID).where("rule is null").groupBy("verdict").count().collect()
    assert {r[0]: r[1] > 0 for r in verdicts} == {"allow": True, "block": True}


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://WWW.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/17?x=/es/", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://a.com/fr/x#y", "a.com", "/fr/x", "com/fr/", "allow"),
        ("http://a.com/FR/x", "a.com", "/FR/x", None, "allow"),
        ("//b.org/", "", "", None, "allow"),
        ("http://org", "org", "", None, "allow"),
        ("http://ä.ORG/Ä://c", "ä.org", "/Ä://c", "org/", "allow"),
        ("x://?://org/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    assert judged(spark, [url]) == [(0, host, path, rule, verdict, None)]


def test_ties_between_rules(spark):
    rules = [("allow", "a.net/bc"), ("block", "x.a.net/b"), ("allow", "net/"), ("block", "net/")]
    got = judged(spark, ["http://x.a.net/bcd", "http://y.net/"], rules=rules)
    assert sorted((r[3], r[4]) for r in got) == [("net/", "block"), ("x.a.net/b", "block")]


def brute(baskets, least, confidence):
    """Rules by counting every set of tokens."""
    seen, bad = {}, {}
    for items, b in baskets:
        for k in range(1, len(items) + 1):
            for s in combinations(sorted(items), k):
                seen[s] = seen.get(s, 0) + 1
                bad[s] = bad.get(s, 0) + b
    sure = {s: bad[s] / seen[s] for s in seen if bad[s] >= least and bad[s] / seen[s] >= confidence}
    return {s: c for s, c in sure.items() if not any(sure.get(tuple(x for x in s if x != y), -1) >= c for y in s)}


def test_mining_equals_counting_every_set(spark):
    rows = [(f"u{i}", sorted({f"h:{i % 7}", f"p:{i % 4}", f"q:{i % 3}", *([f"z:{i % 2}"] * (i % 5 > 1))}), i % 7 < 2 and i % 4 != 1 or i % 11 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "url string, tokens array<string>, bad boolean")
    df = df.union(df.limit(37)).union(spark.createDataFrame([("n", ["h:1"], None), ("e", [], True)], df.schema))
    got = {tuple(r["items"]): r["confidence"] for r in U.mine(df, Scratch(spark), min_bad=8, confidence=0.7).collect()}
    want = brute([(t, b) for _, t, b in rows], 8, 0.7)
    assert got == pytest.approx(want) and len(want) > 3 and max(map(len, want)) > 1


def test_mining_of_long_urls_equals_counting_every_set(spark):
    rows = []
    for i in range(72):
        rare = [f"p:{j}" for j in range(13) if (i * 5 + j * 3) % 13 > 1]
        rows.append((f"u{i}", sorted(rare + ["h:x"] * (i % 7 > 0) + ["h:y"] * (i % 8 > 0) + ["q:all"]), i % 7 > 0 and i % 8 > 0 and i % 5 > 0 or i % 7 == 3))
    got = {tuple(r["items"]): r["confidence"] for r in U.mine(spark.createDataFrame(rows, "url string, tokens array<string>, bad boolean"), Scratch(spark), min_bad=8).collect()}
    want = brute([(t, b) for _, t, b in rows], 8, 0.8)
    assert max(len(t) for _, t, _ in rows) > 12 and got == pytest.approx(want)
    assert any({"h:x", "h:y"} <= set(s) for s in want)


def test_the_commonest_tokens_of_long_urls_make_rules(spark):
    deep = [f"d{chr(97 + j)}" for j in range(15)]
    urls = []
    for i in range(160):
        some = [w for j, w in enumerate(deep) if (i + j) % 15 > 1]
        urls.append("http://h.net/" + "/".join(some + ["casino"] * (i % 10 > 0) + ["bonus"] * (i % 10 < 9) + [chr(97 + i % 26) + chr(97 + i // 26)]))
    bad = [(i, 0 < i % 10 < 9) for i in range(160)]
    new = ["http://k.net/casino/bonus", "http://k.net/casino", "http://k.net/bonus"]
    got = sorted(judged(spark, urls + new, bad))[160:]
    assert [(r[4], r[5]) for r in got] == [("block", 1.0), ("block", pytest.approx(128 / 144)), ("block", pytest.approx(128 / 144))]


def test_a_token_of_nearly_all_urls_makes_rules(spark):
    urls = ["http://h.net/bonus/casino"] * 30 + ["http://h.net/casino"] * 10 + ["http://h.net/bonus"] * 160
    urls = [f"{u}/{chr(97 + i % 26)}{chr(97 + i // 26)}" for i, u in enumerate(urls)]
    got = sorted(judged(spark, [*urls, "http://k.net/casino", "http://k.net/bonus/casino"], [(i, i < 30) for i in range(200)]))[200:]
    assert [(r[4], r[5]) for r in got] == [("allow", None), ("block", 1.0)]


def test_a_mined_rule_blocks_others_and_leaves_clean_ones(spark):
    urls = [f"http://s{i}.net/{w}/{'casino' if i % 3 == 0 else 'news'}/{i}" for i in range(120) for w in ("a", "b")]
    bad = [(k, "casino" in u) for k, u in enumerate(urls) if k % 2]
    got = judged(spark, urls, bad)
    assert len(got) == len(urls) and all((r[4] == "block") == ("casino" in r[2]) for r in got)


def test_repeated_rows_and_keys(spark):
    urls = ["http://a.net/x"] * 500 + ["http://b.net/y"] * 3 + [None, None]
    got = judged(spark, urls, [(1, True), (1, False), (None, True)], keys=[1] * 500 + [None] * 3 + [2, 2])
    assert len(got) == 505 and {r[4] for r in got} == {"allow"}  # 500 rows of one URL are one bad URL, too few for a rule


def test_long_urls_that_share_most_tokens(spark):
    deep = "/".join(f"d{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    urls = [f"http://h.net/{deep}/{'x' * (i + 1)}" for i in range(40)] + ["http://k.net/" + "w/" * 50_000] + [f"http://ok.net/{'y' * (i + 1)}" for i in range(60)]
    got = judged(spark, urls, [(i, i < 40) for i in range(101)])
    assert [r[4] for r in sorted(got)[:40]] == ["block"] * 40 and {r[4] for r in sorted(got)[40:]} == {"allow"}


def test_empty_tables(spark):
    assert judged(spark, []) == []
    assert judged(spark, ["http://a.com/de/1"]) == [(0, "a.com", "/de/1", "com/de/", "block", None)]


def test_no_python_on_the_executors(spark):
    plan = op11_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas")) and F is not None
