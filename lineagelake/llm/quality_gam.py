"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Boosting goes round the features in turn; each
step fits a shallow tree to one feature's bins and adds it to that feature's lookup table.
Then the pairs whose bins still explain the residuals best get tables of their own, grown by
trees of one cut a side. A score is a sum of looked-up values, done for whole batches.

The model is fitted on the driver from at most MAX_LABELLED labelled documents (features
only, some 20 numbers each); scoring is one narrow pass over all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bound of the training sample: documents are taken in the order of a hash of their ids.
MAX_LABELLED = 20_000

FEATURES = (
    "log_words", "word_bytes", "unique_words", "top_word", "repeated_next", "upper", "digits", "symbols", "calls", "stops", "high_bytes", "line_breaks",
    "repeated_lines", "longest_word", "short_words", "letters",
)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, np.float64)
    m[list(chars)] = 1
    return m


_UP, _LOW = bytes(range(65, 91)), bytes(range(97, 123))
_KINDS = np.stack([_mask(_UP), _mask(_LOW), _mask(b"0123456789"), _mask(b"#*$%&|<>"), _mask(b"!?"), _mask(b".,;:"), _mask(bytes(range(128, 256))), _mask(b"\n")], axis=1)


def features(raw: bytes) -> list[float]:
    """FEATURES of one text; of an empty one all zero."""
    if not raw:
        return [0.0] * len(FEATURES)
    up, low, digit, symbol, call, stop, high, line = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS).tolist()
    words, size = raw.split(), len(raw)
    n = max(1, len(words))
    count = Counter(words)
    lengths = list(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(words))), sum(lengths) / n, len(count) / n, max(count.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        up / max(1.0, up + low), digit / size, symbol / size, call / size, stop / size, high / size, line / size,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(max(lengths, default=0))), sum(x <= 3 for x in lengths) / n, (up + low) / size,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float = 0.0
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # fine bin -> coarse bin, by feature
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.bias)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -40, 40)))


def _cut(g: np.ndarray, h: np.ndarray, lam: float, least: float) -> tuple[float, int]:
    """(gain, k): best cut of bins into those below k and the rest."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - g.sum() ** 2 / (h.sum() + lam)
    gain[(hl < least) | (hr < least)] = -1
    k = int(gain.argmax()) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, lam: float, least: float, depth: int) -> np.ndarray:
    """Leaf value of each bin, by a tree of at most `depth` levels."""
    gain, k = _cut(g, h, lam, least) if depth and len(g) > 1 else (-1.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + lam))
    return np.concatenate([_tree(g[:k], h[:k], lam, least, depth - 1), _tree(g[k:], h[k:], lam, least, depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int, int]:
    """(gain, i, j): best cut of a table of bins into four."""
    cg, ch = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1), np.pad(h, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    a, b = slice(1, -1), slice(1, -1)

    def four(c):
        tl = c[a, b]
        return tl, c[a, -1:] - tl, c[-1:, b] - tl, c[-1, -1] - c[a, -1:] - c[-1:, b] + tl

    gain = sum(x**2 / (y + lam) for x, y in zip(four(cg), four(ch)))
    if not gain.size:
        return -1.0, 0, 0
    k = int(gain.argmax())
    i, j = divmod(k, gain.shape[1])
    return float(gain.flat[k] - cg[-1, -1] ** 2 / (ch[-1, -1] + lam)), i + 1, j + 1


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 48, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, lam: float = 2.0, least: float = 2.0) -> Model:
    """x (rows, features), y 0 or 1. Without rows, or with one class only, a constant."""
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(d)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges])
    p0 = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(p0 / (1 - p0)))
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    f = np.full(len(y), model.bias)
    for _ in range(rounds):
        for j in range(d):
            p = 1 / (1 + np.exp(-f))
            n = len(model.tables[j])
            leaf = rate * _tree(np.bincount(b[:, j], y - p, n), np.bincount(b[:, j], p * (1 - p), n), lam, least, 2)
            model.tables[j] += leaf
            f += leaf[b[:, j]]
    model.coarse = [np.minimum(np.arange(len(t)) * 12 // len(t), 11) for t in model.tables]
    c = np.stack([model.coarse[j][b[:, j]] for j in range(d)], axis=1)

    def table(i, j, p):
        k = c[:, i] * 12 + c[:, j]
        return np.bincount(k, y - p, 144).reshape(12, 12), np.bincount(k, p * (1 - p), 144).reshape(12, 12)

    p = 1 / (1 + np.exp(-f))
    ranked = sorted(combinations(range(d), 2), key=lambda ij: -_quadrants(*table(*ij, p), lam)[0])
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((12, 12)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-f))
            g, h = table(i, j, p)
            gain, u, v = _quadrants(g, h, lam)
            if gain <= 1e-9:
                continue
            step = np.zeros((12, 12))
            for rows in (slice(0, u), slice(u, 12)):
                for cols in (slice(0, v), slice(v, 12)):
                    step[rows, cols] = rate * g[rows, cols].sum() / (h[rows, cols].sum() + lam)
            t += step
            f += step[c[:, i], c[:, j]]
    return model


def _features_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled documents that are not held out. Labels of one id are averaged; of
    several rows of one id the least features count once."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    found = _features_of(texts).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(known), "doc_id")
    rows = sorted(((r.doc_id, r.x, r.y) for r in found.collect()), key=lambda r: r[0])
    x = np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[2] for r in rows], float))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, held_out, score (0 to 1, higher: better) and
    predicted (1 if score >= threshold) for each row.

    Null and empty texts are scored too. Repeated rows stay repeated; other columns are not
    read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            s = model.score(np.array(rows, float).reshape(len(rows), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
