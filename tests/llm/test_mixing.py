import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lineagelake.llm import mixing


def plain_rake(rows, targets, sweeps=400):
    w = np.array([r["tokens"] for r in rows], float)
    w /= w.sum()
    for _ in range(sweeps):
        for m, t in targets.items():
            for v, share in t.items():
                at = np.array([r[m] == v for r in rows])
                if w[at].sum() > 0:
                    w[at] *= share / w[at].sum()
    return w


def test_documents_match_plain_raking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mix = mixing.Mix()
    told = docs.withColumn("n_tokens", mixing.tokens_of(F.col("text"))).withColumn("topic", mixing.topic_of(F.col("text"), F.col("n_tokens")))
    raked = mixing.probabilities(mixing.rake(mixing.cells(told), mix), mix)
    rows = [r.asDict() for r in raked.collect()]
    total = sum(r["tokens"] for r in rows)
    targets = {}
    for m, power in mix.temper:
        share = {}
        for r in rows:
            share[r[m]] = share.get(r[m], 0) + r["tokens"] / total
        t = {v: s**power for v, s in share.items()}
        targets[m] = {v: x / sum(t.values()) for v, x in t.items()}
    want = plain_rake(rows, targets)
    got = np.array([r["weight"] for r in rows])
    assert np.abs(want - got).max() < 1e-5
    for m, t in targets.items():
        for v, x in t.items():
            assert abs(sum(r["weight"] for r in rows if r[m] == v) - x) < 1e-5
    p = np.array([r["probability"] for r in rows])
    tokens = np.array([r["tokens"] for r in rows])
    assert abs((p * tokens).sum() - mix.budget * total) < 1e-6 * total and p.max() <= 1
    free = p < 1  # these share one factor
    assert np.ptp((p * tokens / got)[free]) < 1e-6 * (p * tokens / got)[free].max()
    kept = mixing.assign(docs).where("kept").agg(F.sum("n_tokens")).first()[0]
    assert abs(kept / total - mix.budget) < 0.05
    assert mixing.sample(docs).count() == mixing.assign(docs).where("kept").count()


def test_many_sources_match_plain_raking(spark):
    """Every value has its own target, however many there are, and given ones are met."""
    rows = [(f"s{i}" if i else "(other)", l, t, 1 + (7 * i + 3 * j + k) % 23) for i in range(300) for j, l in enumerate(("en", "de", "fr")) for k, t in enumerate(("x", "y"))]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    mix = mixing.Mix(targets=(("lang", (("en", 0.5), ("de", 0.3), ("fr", 0.2))), ("source", (("s7", 0.1), ("s250", 0.2), *[(f"s{i}", 0.7 / 100) for i in range(100, 200)]))), temper=(("topic", 0.5),), tolerance=1e-9)
    raked = mixing.rake(mixing.cells(df), mix)
    got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
    cells = {}
    for s, l, t, n in rows:
        cells[s, l, t] = cells.get((s, l, t), 0) + n
    plain = [{"source": s, "lang": l, "topic": t, "tokens": n} for (s, l, t), n in cells.items()]
    total = sum(cells.values())
    topic = {t: (sum(n for k, n in cells.items() if k[2] == t) / total) ** 0.5 for t in "xy"}
    targets = {"source": {s: 0.0 for s in {r[0] for r in rows}} | dict(mix.targets[1][1]), "lang": dict(mix.targets[0][1]), "topic": {t: x / sum(topic.values()) for t, x in topic.items()}}
    want = plain_rake(plain, targets, 60)
    assert len(got) == 1800 and max(abs(got[r["source"], r["lang"], r["topic"]] - w) for r, w in zip(plain, want)) < 1e-7
    assert sum(w > 0 for w in got.values()) == 102 * 6
    p = [r for r in mixing.probabilities(raked, mix).collect()]
    assert all(0 <= r.probability <= 1 for r in p) and sum(r.probability == 1 for r in p) == 102 * 6


def plain_scale(rows, budget):
    """Water filling by bisection."""
    total = sum(t for t, _ in rows)
    lo, hi = 0.0, 1e18
    for _ in range(300):
        s = (lo + hi) / 2
        lo, hi = (s, hi) if sum(min(t, s * w) for t, w in rows) < budget * total else (lo, s)
    return [min(1.0, hi * w / t) for t, w in rows]


def test_probabilities_match_bisection(spark):
    rows = [(10 * (i + 1), (i * i % 17 + 1) / 500) for i in range(60)]
    df = spark.createDataFrame([(str(i), "l", "t", a, b) for i, (a, b) in enumerate(rows)], "source string, lang string, topic string, tokens long, weight double")
    for budget in (0.1, 0.5, 0.9, 0.99):
        got = {int(r.source): r.probability for r in mixing.probabilities(df, mixing.Mix(budget=budget)).collect()}
        assert all(abs(got[i] - x) < 1e-9 for i, x in enumerate(plain_scale(rows, budget)))


def test_edge_rows(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "word", None, "en"), (None, "word word", "s", None), (4, "w " * 9000, "s", "en"), (4, "w " * 9000, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as topic", "2 as weight", "3 as _key", "4 as n_tokens", "5 as _n", "6 as _cell", "7 as _mix", "8 as row", "9 as draw", "10 as rate")
    got = mixing.assign(df).collect()
    twins = mixing.assign(spark.createDataFrame([(None, f"word number {i}", "s", "en") for i in range(200)], "doc_id long, text string, source string, lang string"), mixing.Mix(budget=0.5)).collect()
    assert 50 < sum(r.kept for r in twins) < 150
    assert mixing.sample(df, mixing.Mix(budget=1.0)).where("_key = 3 and row = 8 and rate = 10").count() == 4
    assert len(got) == 6 and all(r.kept is not None and 0 <= r.probability <= 1 for r in got)
    assert not any(r.kept for r in got if r.doc_id in (1, 2)) and len({r.kept for r in got if r.doc_id == 4}) == 1
    assert mixing.sample(df).columns == df.columns
    assert mixing.assign(df.limit(0)).count() == 0


def plain_tokens(text):
    n, inside = 0, False
    for c in text or "":
        word = unicodedata.category(c)[0] in "LN"
        n += not inside if word else c not in " \t\n\x0b\f\r"
        inside = word
    return n


def plain_topic(text):
    words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    if not words:
        return "none"
    if re.search(r"\b(licen[cs]e|all rights reserved|copyright)\b", text, re.I):
        return "legal"
    if text.count(" | ") * 4 > words:
        return "tabular"
    return "brief" if words < 60 else "article" if words < 600 else "long"


def test_tokens_and_topics_of_any_script(spark):
    texts = ["今天天气很好。" * 800, "「你好」，世界。", "«Où est-il ?» “Là—bas”…", "a\u00a0b\u3000c", "naïve café №5 ٣٤ Ⅷ", "Привет, мир! " * 50, "the licensee has a copyrighted work", "the LICENSE of it", "Copyright 2020"]
    texts += ["a | b | c | d", "a|b|c|d|e|f|g|h", "x, " * 40, "w " * 59, "w " * 60, "w. " * 599, "w " * 600, " \n", "", None]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(t,) for t in texts] + [(r.text,) for r in docs.select("text").collect()]
    df = spark.createDataFrame(rows, "text string").withColumn("n", mixing.tokens_of(F.col("text")))
    for r in df.withColumn("topic", mixing.topic_of(F.col("text"), F.col("n"))).collect():
        assert (r.n, r.topic) == (plain_tokens(r.text), plain_topic(r.text)), (r.text or "")[:60]
    assert plain_tokens(texts[0]) == 1600
