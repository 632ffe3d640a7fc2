"""Quality rules on tokeniser fertility.

A public byte-fallback vocabulary measures each text: characters per token, share of
tokens that are byte fallbacks, and entropy of the tokens. Text that a vocabulary of many
languages cuts into crumbs, spells in bytes, or repeats without end lies outside bands
that are set for each language, or for the script where the language is not listed.
Two plain rules stand before the bands: too few words, and too many repeated windows.

Each text is measured whole and by itself in one narrow pass, so nothing is shuffled and
a lost task is simply run again. Words are the unit of caching: in this vocabulary no
token spans white space, so the tokens of a text are those of its words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_TAIL = bytes(range(0x80, 0xC0))
CACHE = 500_000


@dataclass(frozen=True)
class Band:
    """What is kept, ends included, by three measures of the vocabulary.

    Characters a token: at most `most_chars`, and less than the usual value by no more than
    chars_slack / sqrt(tokens) or `least_slack`, whichever is more, since short texts vary
    more. Bits of entropy a token: within `entropy_slack` (below, above) of what is usual
    for a text of so many tokens, a + b x + c x^2 with x = log2(tokens), at most TOP. Byte
    fallbacks: at most a share of the tokens."""

    chars_per_token: float
    entropy: tuple[float, float, float]
    entropy_slack: tuple[float, float] = (0.30, 1.5)
    max_byte_share: float = 0.10
    chars_slack: float = 6.0
    least_slack: float = 0.15
    most_chars: float = 8.0


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))
    by_script: dict[str, Band] = field(default_factory=lambda: dict(SCRIPT_BANDS))


TOP = 12.0  # log2 of the tokens beyond which the usual entropy stays
# Usual characters a token and curves of entropy, fitted to labelled prose of
# each language by least squares. The slack below the curve is beyond all labelled prose.
BANDS = {
    "en": Band(2.218, (0.863, 1.012, -0.042)),
    "de": Band(2.241, (1.416, 0.892, -0.038)),
    "fr": Band(1.980, (1.983, 0.773, -0.032), (0.37, 1.5)),
    "es": Band(1.941, (1.337, 0.907, -0.038), (0.33, 1.5)),
}
# By script, for other languages: wider, since it holds for many.
SCRIPT_BANDS = {
    "latin": Band(2.0, (1.3, 0.9, -0.038), (1.0, 3.0), max_byte_share=0.2, least_slack=0.8),
    "other": Band(0.9, (1.3, 0.9, -0.038), (2.5, 5.0), max_byte_share=0.9, least_slack=0.7),
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, token_entropy double, latin_share double"


class _Words(dict):
    """word -> index into arrays of tokens; filled as words are met."""

    def __init__(self, encode, is_byte):
        super().__init__()
        self.encode, self.is_byte = encode, is_byte
        self.new: list[bytes] = []
        self.size = self.off = self.fell = self.flat = np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.size) + len(self.new)
        self.new.append(word)
        return k

    def settle(self) -> None:
        """Encode the new words together and move them into the arrays."""
        ids = self.encode([w.decode("utf-8", "replace") for w in self.new], num_threads=1)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(size.sum()))
        fell = np.bincount(np.repeat(np.arange(len(size)), size), self.is_byte[flat], len(size)).astype(np.int64)
        self.off = np.concatenate([self.off, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat, self.fell = (np.concatenate(x) for x in ((self.size, size), (self.flat, flat), (self.fell, fell)))
        self.new = []


def repeated_window_words(ids: np.ndarray, window: int = 8) -> int:
    """Words inside windows of `window` words that stand twice or more, the first included.

    Exact: windows are ranked by doubling, each rank naming one sequence of words."""
    n = len(ids)
    if n <= window:
        return 0
    rank, size = ids, 1
    while True:
        step = min(size, window - size)
        m = n - (size + step) + 1
        key = rank[:m] * (int(rank.max()) + 1) + rank[step : step + m]
        _, rank = np.unique(key, return_inverse=True)
        size += step
        if size == window:
            break
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _runs(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions off[i], off[i] + 1, ... of every i, one after another."""
    return np.arange(int(size.sum())) + np.repeat(off - (np.cumsum(size) - size), size)


def _entropy(k: np.ndarray, words: _Words) -> float:
    """Bits a token."""
    u, c = np.unique(k, return_counts=True)
    if not len(u):
        return 0.0
    size = words.size[u]
    tok, inv = np.unique(words.flat[_runs(words.off[u], size)], return_inverse=True)
    n = np.bincount(inv, np.repeat(c, size), len(tok))
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


_LOADED: dict[str, tuple] = {}


def _vocabulary(path: str) -> tuple:
    if path not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _LOADED[path] = (sp.encode, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())]))
    return _LOADED[path]


_FIELDS = [x.split(" ")[0] for x in MEASURES.split(", ")]
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLUMN = "_fertility"


def _measured(texts: list[bytes | None], words: _Words, window: int) -> pa.StructArray:
    rows, ks = [], []
    get = words.__getitem__
    for raw in texts:
        raw = raw or b""
        parts = raw.split()
        k = np.fromiter(map(get, parts), np.int64, len(parts))
        ks.append(k)
        chars = len(raw.translate(None, _TAIL + _SPACE))
        latin = len(raw) - len(raw.translate(None, _LETTERS))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        rows.append((len(parts), chars, symbols, duplicate_lines(raw), repeated_window_words(k, window), latin / max(1, chars)))
    words.settle()
    *plain, latin = zip(*rows)
    tokens = [int(words.size[k].sum()) for k in ks]
    fell = [int(words.fell[k].sum()) for k in ks]
    arrays = [pa.array(x, pa.int64()) for x in (*plain, tokens, fell)]
    arrays += [pa.array([_entropy(k, words) for k in ks], pa.float64()), pa.array(latin, pa.float64())]
    return pa.StructArray.from_arrays(arrays, _FIELDS)


def measure(docs: DataFrame, model: str, carry: list[str], window: int = 8) -> DataFrame:
    """The columns `carry` of docs, and a struct COLUMN of the MEASURES of its text."""
    where = [i for i, c in enumerate(docs.columns) if c in carry and c != COLUMN]
    fields = [docs.schema.fields[i] for i in where]
    out = T.StructType([*fields, T.StructField(COLUMN, T.StructType.fromDDL(MEASURES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(*_vocabulary(model))
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                if len(words) > CACHE:
                    words = _Words(*_vocabulary(model))
                found = _measured(b.column(0).cast(pa.binary()).to_pylist(), words, window)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], found], names=[*b.schema.names[1:], COLUMN])

    text = F.col("text").cast("string").alias("_".join(["_text", *docs.columns]))  # no column has this name
    return docs.select(text, *[docs[f.name] for f in fields]).mapInArrow(run, out)


def within(band: Band) -> dict[str, F.Column]:
    """What each measure says of a text: by characters a token, byte fallbacks, entropy."""
    m = lambda x: F.col(f"{COLUMN}.{x}")
    n = m("n_tokens").cast("double")
    x = F.least(F.log2(n), F.lit(TOP))
    a, b, c = band.entropy
    usual = a + b * x + c * x * x
    low = band.chars_per_token - F.greatest(F.lit(band.least_slack), band.chars_slack / F.sqrt(n))
    return {
        "characters": (m("word_chars") / n).between(low, F.lit(band.most_chars)),
        "bytes": m("n_byte_tokens") <= band.max_byte_share * n,
        "entropy": (m("token_entropy") - usual).between(-band.entropy_slack[0], band.entropy_slack[1]),
    }


def _in_band(band: Band) -> F.Column:
    x = within(band)
    return x["characters"] & x["bytes"] & x["entropy"]


def judge(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """measured (lang, COLUMN, ...): adds base_failed and kept; neither is ever null."""
    m = lambda x: F.col(f"{COLUMN}.{x}")
    failed = (m("n_words") < rules.min_words) | (100 * m("n_repeat_words") > rules.max_repeat_percent * m("n_words"))
    script = F.when(m("latin_share") >= 0.5, _in_band(rules.by_script["latin"])).otherwise(_in_band(rules.by_script["other"]))
    inside = script
    for lang, band in rules.bands.items():
        inside = F.when(F.col("lang") == lang, _in_band(band)).otherwise(inside)
    return measured.withColumn("base_failed", failed).withColumn("kept", F.when(failed, False).otherwise(F.coalesce(inside, F.lit(False))))


def score(docs: DataFrame, model: str, rules: Rules = Rules()) -> DataFrame:
    """docs (doc_id, text, lang, ...): a row for each row, with measures and verdict.

    Null and empty texts have no words and fail. A null or unlisted language is judged by
    script. Repeated rows are judged alike, each by itself; other columns are not read. An
    empty table gives no rows.
    """
    found = judge(measure(docs, model, ["doc_id", "lang"], rules.window), rules)
    return found.select("doc_id", f"{COLUMN}.*", "base_failed", "kept")


def keep(docs: DataFrame, model: str, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs whose verdict is kept, with all their columns."""
    return judge(measure(docs, model, docs.columns, rules.window), rules).where("kept").select(*docs.columns)
