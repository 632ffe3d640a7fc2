"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regex. Each code point has a class; a class with one or two
characters of look-ahead is a symbol; a symbol is a function on the few states of an
automaton that tells where pieces begin. These functions compose associatively, so the
state before every character comes from a blocked prefix scan over small integers that
name functions, for whole batches of texts at once. The slices between boundaries are
looked up in a cache of merged pieces; a new piece is merged by rank. Ids are gathered
from the cache by offsets, and the same kind of offsets, one a token, decode them.

Each text is encoded whole in one narrow pass: no shuffle, and a lost task is run again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 500_000
CHARS = 1 << 20

# Classes of code points.
LETTER, NUMBER, OTHER, WHITE, SPACE, QUOTE = range(6)
# Symbols: what a character does to the automaton. A white character is the last of its
# run (a plain space or another one) or not; a quote may begin a contraction that takes
# one or two characters more.
S_LETTER, S_NUMBER, S_OTHER, S_LAST_SPACE, S_LAST_WHITE, S_WHITE, S_QUOTE1, S_QUOTE2 = range(8)
# States: what was read last. FRESH: the next character begins a piece. PENDING: a plain
# space that the next character joins. TAKE1, TAKE2: so many characters of a contraction
# are still to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PENDING, IN_WHITE, TAKE1, TAKE2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins before this character)."""
    if state == TAKE2:
        return TAKE1, False
    if state == TAKE1:
        return FRESH, False
    joins = state == PENDING
    if symbol == S_LETTER:
        return IN_LETTERS, not (joins or state == IN_LETTERS)
    if symbol == S_NUMBER:
        return IN_NUMBERS, not (joins or state == IN_NUMBERS)
    if symbol in (S_QUOTE1, S_QUOTE2) and not joins and state != IN_OTHERS:
        return (TAKE1 if symbol == S_QUOTE1 else TAKE2), True
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        return IN_OTHERS, not (joins or state == IN_OTHERS)
    if symbol == S_LAST_SPACE:
        return PENDING, True
    if symbol == S_LAST_WHITE:
        return FRESH, True
    return IN_WHITE, state != IN_WHITE


class _Automaton:
    """The functions that sequences of symbols can be, numbered, and their compositions."""

    def __init__(self):
        n = range(8)
        plain = [tuple(_step(q, s)[0] for q in n) for s in n]
        first = [tuple(f[FRESH] for _ in n) for f in plain]  # at the start of a text
        funcs = list(dict.fromkeys([tuple(n), *plain, *first]))
        number = {f: i for i, f in enumerate(funcs)}
        done = 0
        while done < len(funcs):  # close under composition with the generators
            for g in [*plain, *first]:
                h = tuple(g[q] for q in funcs[done])
                if h not in number:
                    number[h] = len(funcs)
                    funcs.append(h)
            done += 1
        self.apply = np.array(funcs, np.uint8)
        self.then = np.array([[number[tuple(b[q] for q in a)] for b in funcs] for a in funcs], np.int16)
        self.of = np.array([[number[f] for f in plain], [number[f] for f in first]], np.int16)
        self.begins = np.array([[_step(q, s)[1] for s in n] for q in n])

    def states(self, f: np.ndarray, width: int = 128) -> np.ndarray:
        """State before each of the characters whose functions are f."""
        n = len(f)
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.int16)  # 0: the identity
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        flat, m = self.then.ravel(), len(self.then)
        for i in range(1, width):
            grid[i] = flat[grid[i - 1].astype(np.int32) * m + grid[i]]
        last = self.scan_rows(grid[-1])
        before = np.empty((width, rows), np.uint8)
        before[0] = last
        for i in range(1, width):
            before[i] = self.apply[grid[i - 1], last]
        return before.T.reshape(-1)[:n]

    def scan_rows(self, total: np.ndarray) -> np.ndarray:
        """State before each block, from the blocks' composed functions."""
        if len(total) <= 256:
            out, q = np.empty(len(total), np.uint8), FRESH
            for i, f in enumerate(total.tolist()):
                out[i] = q
                q = self.apply[f, q]
            return out
        return self.states(total)


_STATIC: dict[str, object] = {}


def _automaton() -> _Automaton:
    if "automaton" not in _STATIC:
        _STATIC["automaton"] = _Automaton()
    return _STATIC["automaton"]


# Code points with the White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    if "classes" not in _STATIC:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[_WHITE] = WHITE
        table[0x20], table[0x27] = SPACE, QUOTE
        _STATIC["classes"] = table
    return _STATIC["classes"]


def boundaries(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the concatenated code points of texts that begin at starts
    (each of one character at least)."""
    auto, n = _automaton(), len(cps)
    cls = _classes()[cps]
    at_start = np.zeros(n + 2, bool)
    at_start[starts] = True
    at_start[n:] = True
    nxt = np.zeros(n + 2, np.uint32)
    nxt[:n] = cps
    one, two = np.where(at_start[1 : n + 1], 0, nxt[1 : n + 1]), nxt[2:]
    two = np.where(at_start[2:] | at_start[1 : n + 1], 0, two)
    symbol = np.choose(cls, [S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_WHITE, S_OTHER]).astype(np.uint8)
    quote = np.flatnonzero(cls == QUOTE)
    a, b = one[quote], two[quote]
    short = np.isin(a, [ord(c) for c in "sdmt"])
    pair = a * np.uint32(256) + np.where(b < 256, b, 0)
    long = (a < 256) & np.isin(pair, [ord(x) * 256 + ord(y) for x, y in ("ll", "ve", "re")])
    symbol[quote[long]] = S_QUOTE2
    symbol[quote[short]] = S_QUOTE1
    white = (cls == WHITE) | (cls == SPACE)
    followed = np.zeros(n, bool)
    followed[:-1] = ~white[1:]
    followed &= ~at_start[1 : n + 1]
    symbol[white & followed] = S_LAST_WHITE
    symbol[(cls == SPACE) & followed] = S_LAST_SPACE
    head = at_start[:n]
    state = auto.states(auto.of[head.astype(np.int8), symbol])
    return np.flatnonzero(head | auto.begins[state, symbol])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank is merged, leftmost first, until none is
    left. A heap keeps very long pieces at n log n."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01" * n)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        j = end[i]
        alive[j] = 0
        end[i] = e
        if e < n:
            prev[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        p = prev[i]
        if p >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks read from a file of base64 tokens, and the tokens' bytes by id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = sorted(self.ranks, key=self.ranks.get)
        ids = np.fromiter((self.ranks[t] for t in tokens), np.int64, len(tokens))
        self.size = np.zeros(int(ids.max()) + 1, np.int64)
        self.size[ids] = [len(t) for t in tokens]
        self.off = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in _STATIC:
            _STATIC[path] = cls(path)
        return _STATIC[path]


def _runs(off: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(off - (np.cumsum(size) - size), size)


class _Pieces(dict):
    """piece -> index into the arrays of merged ids."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.new = ranks, []
        self.size = self.off = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def __missing__(self, piece: bytes) -> int:
        self[piece] = k = len(self.size) + len(self.new)
        self.new.append(merge(piece, self.ranks))
        return k

    def settle(self) -> None:
        size = np.fromiter(map(len, self.new), np.int64, len(self.new))
        flat = np.fromiter((t for x in self.new for t in x), np.uint32, int(size.sum()))
        self.off = np.concatenate([self.off, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.new = []


def encode_texts(texts: list[str], pieces: _Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids up to each text's end, ids up to each piece's end, pieces up to each text's end)."""
    joined = "".join(texts)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    if not joined:
        none = np.zeros(len(texts), np.int64)
        return np.empty(0, np.uint32), none, np.empty(0, np.int64), none
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    buf = joined.encode("utf-8")
    start = np.cumsum(length) - length
    begin = boundaries(cps, start[length > 0])
    wide = 1 + (cps >= 0x80).astype(np.uint8) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
    cut = at[begin].tolist()
    cut.append(len(buf))
    k = np.fromiter(map(pieces.__getitem__, map(buf.__getitem__, map(slice, cut[:-1], cut[1:]))), np.int64, len(cut) - 1)
    pieces.settle()
    size = pieces.size[k]
    ids = pieces.flat[_runs(pieces.off[k], size)]
    ends = np.cumsum(size)
    n_pieces = np.searchsorted(begin, start + length)  # pieces that begin before the text's end
    upto = np.concatenate([[0], ends])[n_pieces]
    return ids, upto, ends, n_pieces


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens, end of each token in them)."""
    size = vocabulary.size[ids]
    return vocabulary.data[_runs(vocabulary.off[ids], size)], np.cumsum(size)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about CHARS characters; a longer text stands alone."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if i > a and n + len(t) > CHARS:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_TOKENS = "token_ids binary, piece_ends binary"


def encode(docs: DataFrame, path: str, tokens: bool = True) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_tokens, digests of the ids and of the bytes they
    decode to, and with `tokens` the ids and, for each piece, the number of ids up to its
    end (both little-endian unsigned 32-bit integers).

    Null and empty texts have no tokens. Strings that look like special tokens are plain
    text. Repeated rows stay repeated; other columns are not read. An empty table gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        pieces = _Pieces(vocabulary.ranks)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                if len(pieces) > CACHE:
                    pieces = _Pieces(vocabulary.ranks)
                ids, upto, ends, n_pieces = encode_texts(texts[a:b], pieces)
                data, stop = decode_ids(ids, vocabulary)
                cut = [0, *upto.tolist()]
                edge = np.concatenate([[0], stop])[cut].tolist()
                raw, out = ids.astype("<u4").tobytes(), data.tobytes()
                columns = [
                    pa.array(np.diff(cut)), pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(cut, cut[1:])], pa.string()),
                    pa.array([hashlib.sha256(out[x:y]).hexdigest() for x, y in zip(edge, edge[1:])], pa.string()),
                ]
                if tokens:
                    own = (ends - np.repeat(cut[:-1], np.diff(n_pieces, prepend=0))).astype("<u4").tobytes()
                    piece = [0, *n_pieces.tolist()]
                    columns += [pa.array([r[4 * x : 4 * y] for x, y in zip(c, c[1:])], pa.binary()) for r, c in ((raw, cut), (own, piece))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=out_type.names)

    out_type = T.StructType.fromDDL(f"doc_id long, {_DIGESTS}" + f", {_TOKENS}" * tokens)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, out_type)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, token_ids, ...): doc_id and the text again, with the byte offset of
    each token's end (token_ends, little-endian unsigned 32-bit integers). Null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            texts, ends = [], []
            for raw in batch.column(1).to_pylist():
                data, stop = decode_ids(np.frombuffer(raw or b"", "<u4"), vocabulary)
                texts.append(None if raw is None else data.tobytes().decode("utf-8", "replace"))
                ends.append(None if raw is None else stop.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(ends, pa.binary())], ["doc_id", "text", "token_ends"])

    return encoded.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string, token_ends binary")
