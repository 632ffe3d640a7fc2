import random
import re

from pyspark.sql import functions as F

from lineagelake.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, rule=ls.Voting()):
    w = words(text)
    at, labels = [], set()
    for phrase, label in ls.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    more, best = set(labels), 1.0 if at else 0.0
    grams = {}
    for d in range(len(w) - rule.k + 1):
        grams.setdefault(tuple(w[d : d + rule.k]), []).append(d)
    for label, notice in rule.notices:
        t = words(notice)
        hits = sorted((d - p, d, p) for p in range(len(t) - rule.k + 1) for d in grams.get(tuple(t[p : p + rule.k]), ()))
        islands = []
        for x in hits:
            if not islands or x[0] - islands[-1][-1][0] > rule.slack:
                islands.append([])
            islands[-1].append(x)
        for island in islands:
            spans = []
            for diagonal, d, p in sorted(island, key=lambda x: (x[1], x[0])):
                if not spans or d - spans[-1][-1][0] > rule.k + rule.slack or abs(diagonal - spans[-1][-1][2]) > rule.slack:
                    spans.append([])
                spans[-1].append((d, p, diagonal))
            for span in spans:
                seen, last = set(), -1
                for _, p, _ in sorted(x[:2] + x[2:] for x in span):
                    if p > last:
                        seen |= set(range(p, p + rule.k))
                        last = p
                share = len(seen) / len(t)
                if share >= rule.share and span[-1][0] - span[0][0] + rule.k <= len(t) * (2 - rule.share) + rule.slack:
                    more.add(label)
                    best = max(best, share)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), round(best, 9))


def check(df):
    want = sorted(((r.doc_id, *plain(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in ls.scan(df).collect()), key=str)
    assert got == want
    return got


def test_documents_match_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_edge_rows(spark):
    mit = ls.NOTICES[3][1]
    broken = mit.replace("free of charge", "free of any charge at all").replace("software", "")
    rows = [
        (1, None), (2, ""), (3, "CC BY"), (4, "cc-by cc by-cc BY cc"), (5, "..."), (6, "a b"), (7, mit * 3), (7, mit * 3), (None, mit), (8, broken), (9, "GNU General\nPublic\x00License all_rights reserved ALL RIGHTS é RESERVED"),
        (10, "x " * 60000 + mit + " y" * 10), (11, "İ K cc by"), (12, "all rights"), (12, "all rights reserved"), (13, " ".join(reversed(mit.split()))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as labels", "2 as words", "3 as text_hash")
    got = check(df)
    assert sum(r[0] == 7 for r in got) == 2
    assert ls.scan(df.limit(0)).count() == 0


def test_scattered_and_shuffled_notices(spark):
    """A notice's pieces far apart, or in another order, are no notice; whole ones with small changes are."""
    notice = words(ls.NOTICES[13][1])
    pieces = [notice[i : i + 6] for i in range(0, len(notice), 6)]
    fill = lambda n: [f"w{n}x{i}" for i in range(2)]
    rng = random.Random(1)
    mixed = pieces[:]
    rng.shuffle(mixed)
    rows = [
        (1, " ".join(notice)), (2, " ".join(w for i, p in enumerate(pieces) for w in p + [f"z{i}y{j}" for j in range(12)])), (3, " ".join(w for p in mixed for w in p)),
        (4, " ".join(w for i, p in enumerate(pieces) for w in p + (fill(i) if i % 5 == 0 else []))), (5, " ".join(notice[:20])), (6, "before " * 40 + " ".join(notice) + " and " + " ".join(notice)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    labels = {r.doc_id: r.labels for r in ls.scan(df).collect()}
    # The opening sentence is a notice of its own.
    assert labels[1] == labels[4] == labels[6] == "mit" and labels[2] == labels[3] == "" and labels[5] == "mit"


def test_rows_that_repeat_bring_no_more_hits(spark):
    """Thousands of rows without an id and one text are one to the votes."""
    notice = ls.NOTICES[0][1]
    df = spark.createDataFrame([(None, f"before {notice} after")] * 3000 + [(1, notice)], "doc_id long, text string")
    keyed = df.select("doc_id", F.xxhash64("text").alias("text_hash"), ls.words_of(F.col("text")).alias("words"))
    assert ls.votes(spark, keyed, ls.Voting()).count() == 2
    rows = ls.scan(df).collect()
    assert len(rows) == 3001 and len({(r.doc_id, r.labels, r.score) for r in rows}) == 2
