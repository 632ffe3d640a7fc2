import base64
import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lineagelake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
HARD = "".join(["' ' a b 1 2 . ! \n \t \r \xa0 　 é 漢 ² ́ \U0001f600 s t d m l v e r re ll"])


def ours(texts):
    ids, upto, _, _ = bpe.encode_texts(texts, bpe._Pieces(RANKS))
    cut = [0, *upto.tolist()]
    return [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="'sdmtlverLL 1.!\n\t\xa0　é漢²́😀", max_size=40), st.text(max_size=30)), max_size=6))
def test_any_text_as_tiktoken(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert ours(texts) == [REF.encode_ordinary(t) for t in texts]


def test_scan_over_many_blocks():
    text = ("don't  stop \n\n we'll've 12 a1b2 ''s 's\t\tx" * 4000)
    assert ours([text, "", "x", text[:-3]]) == [REF.encode_ordinary(t) for t in (text, "", "x", text[:-3])]
    long = "ab" * 30000
    assert ours([long]) == [REF.encode_ordinary(long)]


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    enc = bpe.encode(docs, PATH)
    for r in enc.collect():
        want = REF.encode_ordinary(text[r.doc_id])
        raw = struct.pack(f"<{len(want)}I", *want)
        assert r.n_tokens == len(want) and bytes(r.token_ids) == raw and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        ends = struct.unpack(f"<{len(r.piece_ends) // 4}I", r.piece_ends)
        assert list(ends) == sorted(ends) and ends[-1] == len(want)
    assert {r.doc_id: r.text for r in bpe.decode(enc, PATH).collect()} == text


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (None, "x"), (4, "x"), (4, "x"), (5, " " * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as token_ids")
    got = sorted(((r.doc_id, r.n_tokens) for r in bpe.encode(df, PATH, tokens=False).collect()), key=str)
    assert got == sorted(((i, len(REF.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert bpe.encode(df.limit(0), PATH).count() == 0
