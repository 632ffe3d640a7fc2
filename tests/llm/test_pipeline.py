"""Each stage is held against a brute-force version on the documents that reach it."""

import hashlib

import public_tokenizers
import test_bpe
import test_fertility
import test_secret_scan
import test_simhash

import corpus_pipeline
from lineagelake.llm import mixing

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def plain_classes(ids, texts):
    """Smallest id reachable over all pairs of 5-word shingle sets of Jaccard 0.8 or more."""
    sets = []
    for t in texts:
        w = test_simhash.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(ids)
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert frames[-1].columns == docs.columns
    kept, single, clean, mixed, coded = frames[1:]

    before = {r.doc_id: r for r in docs.collect()}
    for r in kept.collect():
        assert tuple(r) == tuple(before[r.doc_id])
        m = test_fertility.plain(r.text)
        assert m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]

    ids = [r.doc_id for r in kept.orderBy("doc_id").collect()]
    least = sorted(set(plain_classes(ids, [before[i].text for i in ids])))
    assert [r.doc_id for r in single.orderBy("doc_id").collect()] == least
    assert rows(single) == sorted((tuple(before[i]) for i in least), key=str)

    for r in clean.collect():
        text, at, out = before[r.doc_id].text, 0, ""
        base = test_secret_scan.plain_base(text)
        spans = [tuple(map(int, x.split(":")[1:])) for x in test_secret_scan.plain_spans(text, base).split(",") if x]
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + text[at:] and (not spans or r.n_chars == len(r.text))
    assert clean.count() == single.count()

    drawn = {r.doc_id for r in mixing.assign(clean).where("kept").collect()}
    assert {r.doc_id for r in mixed.collect()} == drawn and rows(mixed) == [x for x in rows(clean) if x[0] in drawn]

    text = {r.doc_id: r.text for r in mixed.collect()}
    got = coded.collect()
    assert {r.doc_id for r in got} == set(text)
    for r in got:
        assert r.n_tokens == len(test_bpe.REF.encode_ordinary(text[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_documents(spark, tmp_path):
    """Nulls in any column, repeated ids with different texts, ties, a very long text: no crash
    and no group of near duplicates lost by the second stage."""
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 600 and lang = 'en'").orderBy("doc_id").limit(6).collect()]
    rows = [(1, prose[0], "en", "a", 5), (1, prose[1], "en", "a", 5), (2, prose[1], "en", "b", 5), (None, prose[2], None, None, None), (None, prose[2], None, None, None), (3, None, "en", "a", None), (4, "", None, "a", 0), (5, " ".join(prose * 300), "en", "a", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as row", "2 as _key").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    single = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, None).collect()), key=str)
    assert single == sorted([(1, prose[0]), (1, prose[1]), (None, prose[2]), (3, None), (5, rows[-1][1])], key=str)
    assert all(r.doc_id in (1, 2, 5, None) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
