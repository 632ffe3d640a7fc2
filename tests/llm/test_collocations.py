import random
import re
from collections import Counter

import numpy as np
import pytest

from lineagelake.llm import collocations as co

SCHEMA = "doc_id long, lang string, text string"
SMALL = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=100, longest=5, top=2000, share=100):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(SMALL)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, ws), a in cands.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                part = (lang, ws[i : i + k])
                if 100 * a >= share * cands.get(part, 10**18):
                    gone.add(part)
    by = {}
    for (lang, ws), a in cands.items():
        if (lang, ws) in gone:
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = f[lang, ws[:k]], f[lang, ws[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        by.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in by.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def got(df, **given):
    return sorted(tuple(r) for r in co.collocations(df, **given).collect())


def made(seed, docs=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)] + ["Éa", "中", "x\x01", "B'c"]
    rows = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 5))), "new york city", "a b c d e f", "One Two"]) + rng.choice([" ", " ", "\t", ", ", ".", "\n", "\r\n", "  "])
        rows.append((i, rng.choice(["en", "de", None]), text))
    return rows


@pytest.mark.parametrize("given", [{}, {"least": 20}, {"least": 5, "longest": 4, "top": 30}, {"least": 3, "share": 60, "top": 50}])
def test_matches_brute_force(spark, given):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows, **given)
    assert got(df, **given) == want and want


def test_shards_and_ranges(spark, monkeypatch):
    rows = made(3, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(co, "RANGE_ENTRIES", 50)
    assert got(df.coalesce(1), least=4) == got(df.repartition(7), least=4) == plain(rows, least=4)


def test_one_document_repeated(spark):
    rows = [(7, "en", "the quick brown fox, the quick dog")] * 150 + [(8, "fr", "a b " * 20_000), (9, "fr", None), (None, None, ""), (10, "xx", " .,;"), (11, None, "x " * 99)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as shard", "'z' as word", "3 as ids")
    assert got(df) == plain(rows)
    assert got(df.limit(0)) == []


def test_permutation_is_invertible_and_filters_lossless():
    rng = np.random.default_rng(1)
    for bits in (1, 2, 7, 18, 21, 31):
        for n in (2, 3, 4, 5):
            p = co.Packing(n, bits)
            ids = rng.integers(0, 1 << bits, (300, n))
            lanes = p.pack(ids.ravel(), np.arange(0, 300 * n, n))
            mixed = p.permute(lanes)
            assert (p.unpack(p.restore(mixed)) == ids).all()
            kept, _, counts = co.sorted_counts(mixed)
            counts = counts * rng.integers(1, 400, len(counts))
            for r in {0, min(3, p.width[0] - 1)}:
                top = (kept[0] >> np.uint64(p.width[0] - r)).astype(int) if r else np.zeros(len(counts), int)
                for at in np.unique(top).tolist():
                    m = top == at
                    raw = co.QuotientFilter.write([x[m] for x in kept], counts[m], p, r, at)
                    back, c = co.QuotientFilter.read(raw, p, r, at)
                    assert (c == counts[m]).all() and all((x == y[m]).all() for x, y in zip(back, kept))


def test_small_keys_are_permuted_one_to_one():
    p = co.Packing(2, 5)
    x = p.permute([np.arange(1 << 10, dtype=np.uint64)])[0]
    assert sorted(x.tolist()) == list(range(1 << 10)) and x.tolist() != list(range(1 << 10))


def test_arithmetic_past_64_bits(spark):
    """A million by a million occurrences times thousand is exact in the decimals used."""
    big = spark.sql("select (cast(1000 as decimal(5,0)) * cast(900000000000001L as decimal(15,0)) * cast(123456789012345678L as decimal(18,0))) div (cast(3000000000000000001L as decimal(19,0)) * cast(1234567890123456789L as decimal(19,0))) as s").first().s
    assert big == 1000 * 900000000000001 * 123456789012345678 // (3000000000000000001 * 1234567890123456789)
