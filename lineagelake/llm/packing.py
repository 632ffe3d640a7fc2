"""Best-fit packing of token sequences under several capacities at once.

A document is a vector (tokens, documents, attention cost = tokens squared), a sequence has
a capacity for each. Best fit goes from the longest pieces to the shortest; a piece goes to
the sequence, among those with room in every component, whose weighted residual norm is
least afterwards (`norm`), or whose residual has the largest weighted dot product with the
piece (`dot`); where none has room, to a new one.

Pieces of one length are one vector, and sequences with one residual are alike. So the
whole packing is planned over lengths and residuals with their multiplicities: at most
`tokens` lengths, whatever the number of documents. The plan says which numbers of a
length go to which sequences at which offset. It is the only thing that passes the driver;
documents are tokenised, numbered by length and placed where they are.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.session import stored

_STATIC: dict = {}


class _Ids:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file.

    Its merges are done by tiktoken, in a third of the time, with ranks read from the same
    file: possible where merges stand in the order of the ids they make, which is checked.
    Texts with very long runs of white space, which its pattern can't take, go to tokenizers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.wide = re.compile(r"\s{1000}").search
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary, special = told["model"]["vocab"], {x["content"] for x in told["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids are not in the order of merges")
        byte_of = _bytes_of_letters()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.wide(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level files write a byte that is a visible Latin-1 character as itself, the others,
    in order, as the characters from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(other)}


def tokenised(docs: DataFrame, path: str, tokens: int, end: int = 0) -> DataFrame:
    """docs (doc_id, text): doc_id, piece, start, length and ids_crc32 of each document's ids
    with the id `end` behind them. Those longer than `tokens` are cut; the first piece takes
    what is over. part and nth number the pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _STATIC.get(path) or _STATIC.setdefault(path, _Ids(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        tail = np.array([end], np.uint32)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([ids_of(text or ""), tail]).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % tokens + 1, len(ids) + 1, tokens)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, v in zip(rows, (i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()), int(seen[b - a]))):
                        column.append(v)
                    seen[b - a] += 1
            doc = batch.column(0).take(pa.array(rows[0], pa.int64()))
            piece, rest = pa.array(rows[1], pa.int32()), [pa.array(c, pa.int64()) for c in rows[2:]]
            yield pa.RecordBatch.from_arrays([doc, piece, *rest, pa.array(np.full(len(doc), part, np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, part long")


@dataclass(frozen=True)
class Capacity:
    """Room of a sequence. documents and cost: no bound of their own if null. weights: of
    the three components, each measured in parts of its capacity."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def room(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.cost or self.tokens**2


def plan(counts: dict[int, int], capacity: Capacity) -> dict[str, np.ndarray]:
    """counts: pieces of each length. Arrays, a step an entry, ordered by length and first:
    pieces `first` to `first + count - 1` of a length go to sequences from `sequence` on,
    `each` to one, the first of these at `offset`."""
    room = np.array(capacity.room(), np.int64)
    if counts and (max(counts) > room[0] or max(counts) ** 2 > room[2]):
        raise ValueError("a piece is larger than a sequence's capacity")
    weights = np.array(capacity.weights) / room
    groups: dict[tuple[int, int, int], deque] = {}  # residual -> ranges [first sequence, how many]
    left = np.empty((0, 3), np.int64)
    steps, opened = [], 0

    def take(ranges: deque, n: int) -> Iterator[tuple[int, int]]:
        while n:
            a, m = ranges[0]
            k = min(m, n)
            n -= k
            if k == m:
                ranges.popleft()
            else:
                ranges[0] = (a + k, m - k)
            yield a, k

    def put(residual: np.ndarray, a: int, m: int) -> None:
        nonlocal left
        key = tuple(residual.tolist())
        if key not in groups:
            groups[key] = deque()
            left = np.concatenate([left, residual[None]])
        groups[key].append((a, m))

    for length in sorted(counts, reverse=True):
        item, todo, first = np.array([length, 1, length * length], np.int64), counts[length], 0
        while todo:
            fits = np.flatnonzero((left >= item).all(1))
            if len(fits):
                if capacity.rule == "norm":
                    best = fits[np.argmin((((left[fits] - item) * weights) ** 2).sum(1))]
                else:
                    best = fits[np.argmax((left[fits] * weights) @ (item * weights))]
                residual = left[best]
                # The least norm stays least in a sequence that takes one more; the largest
                # dot product moves on to the next sequence.
                each = int((residual // item).min()) if capacity.rule == "norm" else 1
                ranges = groups[tuple(residual.tolist())]
                there = sum(m for _, m in ranges)
            else:
                residual, best = room, None
                each = int((residual // item).min()) if capacity.rule == "norm" else 1
                there = -(-todo // each) if capacity.rule == "norm" else 1
                ranges = deque([(opened, there)])
                opened += there
            full, rest = min(there, todo // each), 0
            if full < there:
                rest = todo - full * each  # fewer than fill one more
            for n, k in ((full, each), (1 if rest else 0, rest)):
                for a, m in take(ranges, n):
                    steps.append((length, first, m * k, a, k, int(room[0] - residual[0])))
                    put(residual - k * item, a, m)
                    first, todo = first + m * k, todo - m * k
            if best is not None and not ranges:
                del groups[tuple(residual.tolist())]
                left = np.delete(left, best, 0)
    steps.sort()
    columns = np.array(steps, np.int64).reshape(-1, 6).T
    return dict(zip(("length", "first", "count", "sequence", "each", "offset"), columns))


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), end: int = 0) -> DataFrame:  # noqa: B008
    """docs (doc_id, text, ...): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty: one piece of the id `end`. Repeated rows and null ids are packed
    row by row, other columns are not read, an empty table gives no rows. Longer documents
    than a sequence takes are cut into whole pieces, the first of which may be shorter."""
    pieces = stored(tokenised(docs, path, capacity.tokens, end))
    by = pieces.groupBy("part", "length").agg(F.count("*").alias("_n"))
    counts = {r.length: r.n for r in by.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `tokens` rows
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by.select("part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("nth")).alias("nth"))
    steps = plan(counts, capacity)
    # One sorted key for (length, number): both parts in one integer.
    wide = max(counts.values(), default=1).bit_length()
    keys = (steps["length"] << wide) + steps["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("nth").to_numpy()
            at = np.searchsorted(keys, (length << wide) + nth, side="right") - 1
            over = nth - steps["first"][at]
            sequence = steps["sequence"][at] + over // steps["each"][at]
            offset = steps["offset"][at] + over % steps["each"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    if math.log2(capacity.tokens + 1) + wide > 62:
        raise ValueError("too many pieces of one length")
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
