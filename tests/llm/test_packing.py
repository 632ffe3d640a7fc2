import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lineagelake.llm import packing
from lineagelake.llm.packing import Capacity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


def one_by_one(items, capacity):
    """Sequences that plain best fit over single pieces opens."""
    room = np.array(capacity.room())
    weights = np.array(capacity.weights) / room
    bins = []
    for n in sorted(items, reverse=True):
        v, best = np.array([n, 1, n * n]), None
        for b in bins:
            if (b >= v).all():
                score = (((b - v) * weights) ** 2).sum() if capacity.rule == "norm" else -((b * weights) @ (v * weights))
                if best is None or score < best[0] - 1e-12:
                    best = score, b
        if best is None:
            bins.append(room - v)
        else:
            best[1][:] -= v
    return len(bins)


def placed(steps):
    out = {}
    for n, count, sequence, each, offset in zip(*(steps[k].tolist() for k in ("length", "count", "sequence", "each", "offset"))):
        for i in range(count):
            out.setdefault(sequence + i // each, []).append((offset + i % each * n, n))
    return out


def whole(load, capacity):
    tokens, documents, cost = capacity.room()
    for v in load.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= tokens and len(v) <= documents and sum(n * n for _, n in v) <= cost


CAPACITIES = [Capacity(), Capacity(documents=3), Capacity(cost=2_900_000), Capacity(documents=9, rule="dot"), Capacity(weights=(1.0, 3.0, 0.5), documents=5, cost=3_000_000), Capacity(rule="dot", cost=2_900_000)]


@pytest.mark.parametrize("capacity", CAPACITIES)
def test_plan_is_best_fit_under_every_capacity(capacity):
    rng = np.random.default_rng(3)
    items = np.clip(rng.lognormal(5.4, 1.3, 1500), 1, 1700).astype(int).tolist() + [700] * 200
    counts = dict(zip(*(x.tolist() for x in np.unique(items, return_counts=True))))
    steps = packing.plan(counts, capacity)
    load = placed(steps)
    whole(load, capacity)
    assert sorted(n for v in load.values() for _, n in v) == sorted(items)
    assert len(load) == one_by_one(items, capacity)


def test_plan_refuses_what_never_fits():
    assert len(packing.plan({}, Capacity())["first"]) == 0
    with pytest.raises(ValueError):
        packing.plan({2049: 1}, Capacity())
    with pytest.raises(ValueError):
        packing.plan({1000: 1}, Capacity(cost=999_999))


def expected(texts, tokens=2048):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out = []
    for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        ids, pieces = [*e.ids, 0], []
        over = len(ids) % tokens
        cuts = [0, *range(over or tokens, len(ids) + 1, tokens)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces.append((p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        out.append(pieces)
    return out


def check(rows, docs, tokens=2048):
    want = sorted((d, *p) for (d, _), ps in zip(docs, expected([t for _, t in docs], tokens)) for p in ps)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    load = {}
    for r in rows:
        load.setdefault(r.sequence_id, []).append((r.offset, r.length))
    whole(load, Capacity(tokens))
    return len(load), sum(r.length for r in rows)


def test_documents_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    n, total = check(packing.pack(df, PATH).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert n <= -(-total // 2048) + 1  # as good as no room left


def test_edge_rows(spark):
    texts = [None, "", " ", "a", "<|endoftext|> x", "日本語 テキスト ١٢٣ 🙂", "word " * 5000, "x" * 30_000, "tab\t\n\r\n  end  ", "it's we've I'LL", "word " * 2047, "a", "é " * 300]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, SCHEMA)
    check(packing.pack(df.selectExpr("*", "1 as length", "2 as part", "3 as nth", "4 as offset"), PATH).collect(), docs)
    check(packing.pack(df, PATH, Capacity(64)).collect(), docs, 64)
    assert packing.pack(df.limit(0), PATH).count() == 0
    same = packing.pack(spark.createDataFrame([(None, "a b c")] * 5, SCHEMA), PATH).collect()
    assert [r.doc_id for r in same] == [None] * 5 and len({(r.sequence_id, r.offset) for r in same}) == 5


def test_ids_are_those_of_tokenizers():
    ids, rng = packing._Ids(PATH), random.Random(1)
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    alphabet = ["a", "B", "7", " ", "  ", "\n", "\t", " \n", "'s", "'", "ll", ".", ",", "!", "é", "中", "\u00a0", "\x1c", "ß", "½", "\r\n", "<|endoftext|>", "#", "_", "🙂", "e\u0301", "\u2003", "?", "x y", "١", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(5000)] + [" " * 50_000 + "x", "\n" * 3000, "ab" * 40_000]
    assert [ids(x).tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
