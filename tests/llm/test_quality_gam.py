import math
import re
import zlib
from collections import Counter

import numpy as np

from lineagelake.llm import quality_gam as qg


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = qg.score(docs, qg.train(docs, labels))
    rows = found.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in test]) > 0.97
    good = [r.score for r in test if r.quality]
    bad = [r.score for r in test if not r.quality]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    print("held-out accuracy", np.mean([r.predicted == r.quality for r in test]), "AUC", auc)
    assert auc > 0.97


def test_interaction_is_learnt():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = qg.fit(x, y, n_pairs=1)
    assert m.pairs == [(0, 1)] and np.mean((m.score(x) > 0.5) == y) > 0.95


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a " * 50000), (4, "é 漢\n\n"), (None, "x"), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as x", "3 as y")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = qg.score(df, qg.train(df, none)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    some = spark.createDataFrame([(1, 0), (3, 1), (4, None), (5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    got = qg.score(df, qg.train(df, some)).collect()
    assert len(got) == 7 and len({r.score for r in got if r.doc_id == 5}) == 1
    assert qg.score(df.limit(0), qg.train(df.limit(0), none)).count() == 0


def plain_features(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(qg.FEATURES)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    n, size, count = max(1, len(words)), len(raw), Counter(words)
    up, low = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122)))
    of = lambda chars: sum(b in chars for b in raw) / size
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, len(count) / n, max(count.values(), default=0) / n, sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n, up / max(1, up + low),
        of(b"0123456789"), of(b"#*$%&|<>"), of(b"!?"), of(b".,;:"), sum(b >= 128 for b in raw) / size, of(b"\n"), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(max(map(len, words), default=0)),
        sum(len(w) <= 3 for w in words) / n, (up + low) / size,
    ]


def plain_score(m, x):
    """Sum of the looked-up values, one feature and one pair at a time."""
    at = [sum(v >= e for e in edges) for v, edges in zip(x, m.edges)]
    total = m.bias + sum(t[i] for t, i in zip(m.tables, at))
    for (i, j), t in zip(m.pairs, m.pair_tables):
        total += t[m.coarse[i][at[i]]][m.coarse[j][at[j]]]
    return 1 / (1 + math.exp(-max(-40, min(40, total))))


def test_scores_are_sums_of_lookups(spark):
    """Features and scores of every document against a plain version."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = qg.train(docs, labels)
    assert model.pairs
    got = {r.doc_id: r for r in qg.score(docs, model).collect()}
    for r in docs.collect():
        x = plain_features(r.text)
        assert np.allclose(x, qg.features((r.text or "").encode()), rtol=1e-12, atol=1e-12)
        assert abs(got[r.doc_id].score - plain_score(model, qg.features((r.text or "").encode()))) < 1e-9
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
