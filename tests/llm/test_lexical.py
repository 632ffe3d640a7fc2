import math
import random
import re
from collections import Counter

import numpy as np

from lineagelake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans(lexical.UPPER, lexical.LOWER)
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(t):
    return TERM.findall((t or "").translate(SMALL))


def plain(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for h in held if h[2]), sum(h[2] for h in held)
    df = Counter(t for h in held for t in h[1])
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        found = []
        for d, tf, n in held:
            m = 10 + 90 * n * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in ts if t in tf)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, k=10):
    rows = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k).collect()
    return sorted((tuple(r) for r in rows), key=str)


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "Ünï", "中文", "A1"]
    text = lambda least, most: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(least, most)))
    docs = [(i, text(0, rng.choice([3, 30, 300]))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]
    return docs, [(i, text(1, 12)) for i in range(15)]


def test_matches_brute_force(spark, monkeypatch):
    docs, items = made(1)
    want = plain(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(lexical, "TASK_POSTINGS", 300)  # strata split over tasks
    assert got(spark, docs, items) == want and got(spark, docs, items, 3) == plain(docs, items, 3)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)  # items in blocks
    assert got(spark, docs, items) == want


def test_tables(spark):
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").select(*c).collect()]
    docs, items = read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")
    assert got(spark, docs, items) == plain(docs, items)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "..., !"), (4, "x_y-z 9"), (5, "X y"), (5, "X y"), (None, "x y"), (6, "É é"), (7, "x " * 50_000), (8, "x"), (9, "only\x00nul\x7fhere")]
    items = [(1, "x Y"), (1, "z"), (None, "é É"), (3, None), (4, "nothing of it"), (5, "NUL here"), (5, "NUL here")]
    assert got(spark, docs, items) == plain(docs, items)
    one = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as n", "2 as m", "'a' as terms", "3 as score")
    two = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as rank", "2 as doc_id")
    assert sorted((tuple(r) for r in lexical.search(one, two).collect()), key=str) == plain(docs, items)
    assert lexical.search(one.limit(0), two).count() == 0 and lexical.search(one, two.limit(0)).count() == 0


def test_bounds_end_the_visit():
    """Strata whose bound is below the k-th score are not visited, ties are."""
    docs = 2000
    m = np.repeat(np.arange(10, 210), 10)
    index = lexical.Strata(np.arange(docs), m, np.zeros(docs, np.int64), np.ones(docs, np.int64), np.array([1000]))
    seen = []
    runs = index.runs
    index.runs = lambda t, s: seen.extend(s.tolist()) or runs(t, s)
    found, scores = index.search(np.array([0]), np.arange(docs)[::-1].copy(), 10)
    assert found.tolist() == list(range(9, -1, -1)) and len(set(scores.tolist())) == 1 and len(seen) == 1
