import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece

from lineagelake.llm import fertility

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tokens = [t for x in w for t in sp.encode(x)]
    n = Counter(tokens)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "n_tokens": len(tokens), "n_byte_tokens": sum(map(sp.is_byte, tokens)), "token_entropy": round(-sum(c / len(tokens) * math.log2(c / len(tokens)) for c in n.values()), 6) if n else 0.0,
    }


def plain_kept(lang, text, m):
    """The verdict past the base rules, by tokeniser measures alone."""
    n = m["n_tokens"]
    letters = sum(c.isascii() and c.isalpha() for c in text)
    band = fertility.BANDS.get(lang) or fertility.SCRIPT_BANDS["latin" if letters >= 0.5 * max(1, m["word_chars"]) else "other"]
    x = min(math.log2(n), 12)
    a, b, c = band.entropy
    off = m["token_entropy"] - (a + b * x + c * x * x)
    low = band.chars_per_token - max(band.least_slack, band.chars_slack / math.sqrt(n))
    return low <= m["word_chars"] / n <= 8 and m["n_byte_tokens"] <= band.max_byte_share * n and -band.entropy_slack[0] <= off <= band.entropy_slack[1]


def check(spark, df):
    rows = df.select("doc_id", "text", "lang").collect()
    found = {}
    for r in fertility.score(df, MODEL).collect():
        found.setdefault(r.doc_id, []).append(r)
    for r in rows:
        want = plain(r.text)
        for g in found[r.doc_id]:
            got = {k: round(g[k], 6) if isinstance(g[k], float) else g[k] for k in want}
            got["token_entropy"], want["token_entropy"] = round(got["token_entropy"] + 0.0, 5), round(want["token_entropy"] + 0.0, 5)
            assert got == want
            assert g.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
            assert g.kept == (not g.base_failed and plain_kept(r.lang, r.text, want))
    return found


def test_documents_match_brute_force(spark):
    found = check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert any(r.kept for x in found.values() for r in x)


def test_edge_rows(spark):
    rows = [
        (1, None, "en"), (2, "", None), (3, " \n\n\t", "xx"), (4, "a b c d e f g h " * 12, "en"), (5, "a\n" * 50, "en"), (6, "\x0bone\x0c two\r\n three\xa0four", "fr"),
        (7, "漢字 かな 한국 " * 10, "ja"), (8, "x" * 60000 + " y", "en"), (8, "x" * 60000 + " y", "en"), (None, "\U0001f600 " * 40, None), (9, "q w e r t y u i", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as n_words", "3 as _text")
    assert len(check(spark, df)[8]) == 2
    assert fertility.score(df.limit(0), MODEL).count() == 0
    assert fertility.keep(df, MODEL).columns == df.columns


def test_labels_agree(spark):
    """Of labelled prose all is kept, and of labelled junk that passes the base rules most goes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = fertility.score(docs, MODEL).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_planted_text(spark):
    """Each measure rejects by itself: bytes, crumbs, and text of few tokens."""
    prose = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en' and n_chars > 900").orderBy("doc_id").first().text
    words = prose.split()
    rng = random.Random(8)
    rare = [chr(c) for c in range(0x13000, 0x13400)]
    crumbs = " ".join("".join(rng.choices("qxzjvkw", k=7)) for _ in range(300))
    rows = [
        (1, prose, "en"), (2, " ".join(w if i % 3 else "".join(rng.choices(rare, k=3)) for i, w in enumerate(words)), "en"), (3, crumbs, "en"),
        (4, " ".join(rng.choice(["the", "of"]) if i % 2 else w for i, w in enumerate(words)), "en"), (5, " ".join(x for w in words for x in (w, "|")), "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    check(spark, df)
    measured = fertility.measure(df, MODEL, ["doc_id"])
    says = {r.doc_id: r for r in measured.select("doc_id", *[c.alias(k) for k, c in fertility.within(fertility.BANDS["en"]).items()]).collect()}
    assert all(says[1][1:]) and not says[2].bytes and not says[3].characters and not says[4].entropy and not says[5].entropy
    assert says[4].characters and says[4].bytes and says[5].bytes
