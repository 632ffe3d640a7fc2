"""Ranked lexical search by a length-stratified index.

Documents whose length gives the same normaliser m make a stratum. In a stratum the weight
of a term depends on its frequency tf alone, so postings are kept by term, stratum and tf,
and an impact is computed once for each such list, not for each document. The largest tf of
each term in a stratum bounds what a document there can score for an item; strata are
visited by falling bound, and what is left once the bound falls below an item's k-th score
can hold no result.

One narrow pass counts the asked terms in each document. Documents, sorted by m, are then
dealt over tasks by range, so a stratum of many documents is split and small neighbours
stay together; each task builds its strata, searches them for all items, and gives at most
k rows an item. Items are taken in blocks of a bounded vocabulary, which is what the tasks
get; each block reads the documents once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAKS = bytes(c for c in range(0x80) if not chr(c).isalnum())
# Bytes of a text that end a term become blanks, A-Z become small.
_TABLE = bytes.maketrans(_BREAKS + UPPER.encode(), b" " * len(_BREAKS) + LOWER.encode())
# Distinct terms of the items of a block, together; postings of a task.
BLOCK_TERMS = 200_000
TASK_POSTINGS = 1_000_000
CHUNK = 1 << 22


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def asked(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): each item's distinct terms; rows that share an id are one item."""
    rows = items.select(F.col(item).alias("item_id"), F.explode(terms_of(F.col(text))).alias("t")).distinct()
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_list("t")).alias("terms"))


def counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and which of the vocabulary
    it holds how often (places in the vocabulary, rising)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t.encode(): i for i, t in enumerate(vocabulary)}.get
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                stop, size, found, n = at, 0, [], []
                while stop < len(texts) and (stop == at or size < CHUNK):
                    words = (texts[stop] or b"").translate(_TABLE).split()
                    size += len(texts[stop] or b"")
                    n.append(len(words))
                    found.append(np.fromiter((x for x in map(place, words) if x is not None), np.int64))
                    stop += 1
                held = np.fromiter(map(len, found), np.int64, len(found))
                key = np.repeat(np.arange(len(found)), held) * max(len(vocabulary), 1) + np.concatenate(found)
                key, tf = np.unique(key, return_counts=True)
                doc, term = np.divmod(key, max(len(vocabulary), 1))
                ends = np.searchsorted(doc, np.arange(len(found) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                at = stop

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


class Strata:
    """A task's index: postings by term, stratum and tf."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        """Rows are postings; doc is a number from 0 of the task's documents."""
        self.m, stratum = np.unique(m, return_inverse=True)
        order = np.lexsort((-tf, stratum, term))
        self.doc, term, stratum, tf = doc[order], term[order], stratum[order], tf[order]
        changed = (np.diff(term) != 0) | (np.diff(stratum) != 0)
        start = np.flatnonzero(np.concatenate([[True], changed])) if len(term) else np.empty(0, np.int64)
        lists = np.flatnonzero(np.concatenate([[True], changed | (np.diff(tf) != 0)])) if len(term) else start
        once = tf[lists]
        once = weights[term[lists]] * (1_000_000_000 * once // (1000 * once + 8 * self.m[stratum[lists]]))
        self.impact = np.repeat(once, np.diff(np.append(lists, len(term))))
        # One run for each term and stratum, best tf first.
        self.key = term[start] * len(self.m) + stratum[start]
        self.start, self.size, self.best = start, np.diff(np.append(start, len(term))), self.impact[start]

    def runs(self, terms: np.ndarray, strata: np.ndarray) -> np.ndarray:
        """Places of the runs of these terms in these strata."""
        want = (terms[:, None] * len(self.m) + strata[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        return at[self.key[at] == want] if len(self.key) else at[:0]

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """What a document can score at most, for each stratum."""
        out = np.zeros(len(self.m), np.int64)
        lo, hi = np.searchsorted(self.key, terms * len(self.m)), np.searchsorted(self.key, (terms + 1) * len(self.m))
        at = np.arange(int((hi - lo).sum())) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        np.add.at(out, self.key[at] % len(self.m), self.best[at])
        return out

    def search(self, terms: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, ties by smaller ids."""
        bound = self.bounds(terms)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        docs, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 1
        while at < len(order) and (len(docs) < k or bound[order[at]] >= scores[k - 1]):
            run = self.runs(terms, order[at : at + step])
            size = self.size[run]
            i = np.arange(int(size.sum())) + np.repeat(self.start[run] - (np.cumsum(size) - size), size)
            met, back = np.unique(self.doc[i], return_inverse=True)
            sums = np.zeros(len(met), np.int64)
            np.add.at(sums, back, self.impact[i])
            docs, scores = np.concatenate([docs, met]), np.concatenate([scores, sums])
            top = np.lexsort((ids[docs], -scores))[:k]
            docs, scores = docs[top], scores[top]
            at, step = at + step, step * 2
        return docs[scores > 0], scores[scores > 0]


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """items: (item_id, terms) rows of a block."""
    vocabulary = sorted({t for r in items for t in r.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    wanted = [np.array([place[t] for t in r.terms], np.int64) for r in items]
    forward = stored(counted(docs, vocabulary))
    total = forward.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("postings")).first()
    n_docs, length = total.N, total.L or 0
    df = np.zeros(len(vocabulary), np.int64)
    for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
        df[r.t] = r["count"]
    weights = weight(n_docs, df)
    m = 10 + F.expr(f"(90 * n * {n_docs}L) div {max(length, 1)}L")
    parts = max(1, -(-(total.postings or 0) // TASK_POSTINGS))
    dealt = forward.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs", F.monotonically_increasing_id().alias("_at")).repartitionByRange(parts, "m", "doc_id", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        ids = np.array([-(1 << 63) if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        lists = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        size = np.diff(lists[0].offsets.to_numpy())
        doc = np.repeat(np.arange(len(ids)), size)
        term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        index = Strata(doc, np.repeat(table.column("m").to_numpy(), size), term, tf, weights)
        for i, terms in enumerate(wanted):
            found, scores = index.search(terms, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), table.column("doc_id").take(pa.array(found)).combine_chunks(), pa.array(scores)], ["_i", "doc_id", "score"])

    found = dealt.drop("_at").mapInArrow(run, "_i int, doc_id long, score long")
    first = Window.partitionBy("_i").orderBy(F.desc("score"), "doc_id")
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "_i int, item_id long")
    return best.join(names, "_i").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """docs (doc_id, text, ...), items (item_id, text, ...): item_id, rank, doc_id, score of
    each item's k best documents with a score above 0, ties by rising doc_id.

    Null texts have no term. Repeated rows of documents rank row by row, a null doc_id comes
    first among ties; rows of one item_id, null included, are one item. An item without a
    hit has no row; empty tables give none. Other columns are not read."""
    wanted = stored(asked(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))))
    size = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = 1 + size // BLOCK_TERMS
    rows = wanted.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    return reduce(DataFrame.unionByName, [_block(docs, rows.where(F.col("_b") == b).orderBy("item_id").collect(), k) for b in range(blocks)])
