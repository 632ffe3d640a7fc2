import random
import time
from itertools import combinations, product

from pyspark.sql import functions as F

from lineagelake.llm import url_rules as ur


def plain_base(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in ur.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def plain_mine(rows, m):
    n = len(rows)
    count = {}
    for tokens, blocked in rows:
        for k in range(1, m.max_tokens + 1):
            for c in combinations(sorted(tokens), k):
                a, b = count.get(c, (0, 0))
                count[c] = (a + 1, b + blocked)
    good = {c: b / a for c, (a, b) in count.items() if b >= max(m.min_count, m.min_support * n) and b / a >= m.min_confidence}
    parts = lambda c: (p for k in range(1, len(c)) for p in combinations(c, k))
    return {c: x for c, x in good.items() if not any(good.get(p, -1) >= x for p in parts(c))}


def test_pages_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    labels = pages.select("url", (F.col("page_id") % 5 == 0).alias("blocked"))
    mining = ur.Mining(min_support=0.02, min_count=4, min_confidence=0.3)
    got = ur.judge(pages, labels, mining=mining).collect()
    assert len(got) == pages.count()
    rows = {}
    for r in pages.select("page_id", "url", ur.tokens_of(F.col("url"), ur.host_of(F.col("url")), ur.path_of(F.col("url"))).alias("t")).collect():
        rows[r.page_id] = r
    known = {}
    for i, r in rows.items():
        known[r.url] = (r.t, known.get(r.url, (0, False))[1] or i % 5 == 0)
    rules = plain_mine([x for x in known.values() if x[0]], mining)
    for r in got:
        host, path, rule, verdict = plain_base(rows[r.page_id].url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        met = [c for c in rules if set(c) <= set(rows[r.page_id].t)]
        assert r.verdict == (verdict or ("block" if met else "allow"))
        assert (r.mined is None) == bool(rule or not met)
    assert rules


def test_edge_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.COM", "x://EXAMPLE.com/en/é?x#y", "x://www.example.com/en/", "x://a.www.example.com/en/z", "x://net/es/", "x://notcom/", "x://com", "x://com/", "x://com?/en/", "a://b://c/d", "x://net/fr", "x://example.com/en/\n/a", "y://h/" + "s/" * 20000, "x://..//%?=&="]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls)] + [(None, "x://com/")], "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as key", "4 as tokens")
    labels = spark.createDataFrame([("x://com/", None), (None, True)], "url string, blocked boolean")
    got = ur.judge(df, labels).collect()
    assert len(got) == 2 * len(urls) + 1
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = plain_base((urls + urls)[r.page_id])
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert ur.judge(df.limit(0), labels.limit(0)).count() == 0


def mined(spark, rows, mining):
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    rules, classes = ur.mine(df, mining)
    members = {}
    for r in classes.collect():
        members.setdefault(r["class"], []).append(r.token)
    out = {}
    for r in rules.collect():
        assert r.anchor in r.tokens
        for c in product(*[members[t] for t in r.tokens]):
            out[tuple(sorted(c))] = r.confidence
    return out


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        tokens = [f"t{i}" for i in range(9) if rng.random() < 0.5] + [f"deep{i}" for i in range(rng.choice([0, 2, 5]))]
        bad = ("t1" in tokens and "t2" in tokens and "t3" in tokens) or ("t4" in tokens and "t5" in tokens) or rng.random() < 0.1
        rows.append((tokens, bad))
    for most in (1, 2, 3):
        m = ur.Mining(min_support=0.01, min_count=5, min_confidence=0.7, max_tokens=most)
        want = plain_mine(rows, m)
        got = mined(spark, rows, m)
        assert set(got) == set(want) and all(abs(got[c] - x) < 1e-9 for c, x in want.items())
    assert any(len(c) == 3 for c in want) and any(len(c) == 2 for c in want)


def test_deep_shared_paths(spark):
    """Thirty tokens that always stand together, and thirty of which each implies the last."""
    same = [f"s{i}" for i in range(30)]
    rows = [(same, True)] * 60 + [([f"n{i}" for i in range(k)], k > 15) for k in range(1, 31) for _ in range(2)] + [(["other"], False)] * 40
    m = ur.Mining(min_support=0.01, min_count=2, max_tokens=3)
    began = time.time()
    got = mined(spark, rows, m)
    assert time.time() - began < 60
    assert got == plain_mine(rows, m)


def test_rules_of_four_and_five_tokens(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(500):
        tokens = [f"t{i}" for i in range(8) if rng.random() < 0.65]
        four, five = {"t0", "t1", "t2", "t3"} <= set(tokens), {"t3", "t4", "t5", "t6", "t7"} <= set(tokens)
        rows.append((tokens, four or five or rng.random() < 0.05))
    m = ur.Mining(min_support=0.005, min_count=4, min_confidence=0.9, max_tokens=5)
    want, got = plain_mine(rows, m), mined(spark, rows, m)
    assert set(got) == set(want) and all(abs(got[c] - x) < 1e-9 for c, x in want.items())
    assert {4, 5} <= {len(c) for c in want}


def test_many_independent_tokens(spark):
    """Forty frequent tokens that tell nothing of each other."""
    rng = random.Random(6)
    rows = [([f"t{i}" for i in range(40) if rng.random() < 0.5], rng.random() < 0.5) for _ in range(300)]
    m = ur.Mining(min_support=0.05, min_count=10, min_confidence=0.75, max_tokens=3)
    began = time.time()
    got = mined(spark, rows, m)
    assert time.time() - began < 120
    assert set(got) == set(plain_mine(rows, m))
