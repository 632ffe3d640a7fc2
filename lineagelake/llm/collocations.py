"""Collocations: phrases that are more frequent than their parts let expect.

Counts are exact and per language. Words that occur often enough are numbered; an n-gram is
its word numbers packed into one or two 64-bit lanes. The packed number goes through an
invertible permutation, whose high bits are the quotient and whose other bits, all of them,
the remainder. A counting quotient filter holds a shard's n-grams in order: how many stand
at each quotient, their remainders in whole bytes, and their counts. Nothing is hashed away:
quotient and remainder give the packed number back, and that the words. The permutation
spreads n-grams evenly over ranges of quotients, so filters are cut by range, the shards'
slices of one range are merged as the sorted runs they are, and no n-gram is hot, since
each shard has it once.

Levels follow each other from pairs of words on. What a merged range finds too rare is told
to the shards as one bit a slot, and a shard keeps only the stretches of text in which every
n-gram is frequent: only there can a longer phrase be. That drops nothing that could count,
as a phrase is never more frequent than its parts. No table of frequent words or phrases is
sent to all tasks; what a shard needs is joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.session import stored

UNKNOWN = "und"
SHARD_BYTES = 32 << 20
# Entries of a range, on average at most.
RANGE_ENTRIES = 1 << 21
_UPPER = bytes(range(0x41, 0x5B))
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + _UPPER, b"\n" * 10 + b" " + _UPPER.lower())
BREAK = -1
_FULL = (1 << 64) - 1


class _Dictionary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _squeeze(ids: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(ids, "<i4").tobytes(), codec="zstd", asbytes=True)


def _expand(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), "<i4")


def shards(docs: DataFrame) -> DataFrame:
    """docs (lang, text): shard, lang, its different words (m of them) with their counts, and
    n and ids, the words of its texts in order by place among these, BREAK between pieces.
    Words stand in the order of a hash, so that any ranges of hashes are slices of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            for lang, (words, runs) in held.items():
                ids, names = np.concatenate(runs), list(words)[2:]
                ids = ids[ids > 0]
                order = np.argsort(_hashes(names), kind="stable")
                place = np.empty(len(names) + 2, np.int32)
                place[1], place[order + 2] = BREAK, np.arange(len(names))
                ids = place[ids]
                counts = np.bincount(ids[ids >= 0], minlength=len(names))
                row = (part << 32) + number, lang, len(names), int(counts.sum()), b"\n".join([names[i] for i in order.tolist()]), counts.tobytes(), len(ids), _squeeze(ids)
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["shard", "lang", "m", "total", "words", "counts", "n", "ids"])
                number += 1
            held, size = {}, 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                if size and size + len(text) > SHARD_BYTES:
                    yield from flush()
                if lang not in held:
                    held[lang] = _Dictionary({b"": 0, b"\n": 1}), []
                words, runs = held[lang]
                tokens = text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
                tokens.append(b"\n")
                runs.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                size += len(text)
        yield from flush()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "shard long, lang string, m long, total long, words binary, counts binary, n long, ids binary")


def _word_slices(held: DataFrame, range_bits: int) -> DataFrame:
    """(at, shard, lang, words, counts): each shard's words cut by ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, m, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if not m:
                    continue
                names, counts = words.split(b"\n"), np.frombuffer(counts, np.int64)
                top = (_hashes(names) >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(m, np.int64)
                ranges, first = np.unique(top, return_index=True)
                cuts = [*first.tolist(), m]
                columns = [ranges, [shard] * len(ranges), [lang] * len(ranges), [b"\n".join(names[a:b]) for a, b in zip(cuts, cuts[1:])], [counts[a:b] for a, b in zip(cuts, cuts[1:])]]
                kinds = pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], ["at", "shard", "lang", "words", "counts"])

    return held.select("shard", "lang", "m", "words", "counts").mapInArrow(run, "at long, shard long, lang string, words binary, counts array<long>")


def _merged_words(cut: DataFrame, range_bits: int, least: int) -> DataFrame:
    """Adds up each range's words: at, shard, size and wids: the numbers of the slice's words,
    BREAK for a rare one; and rows without a shard for the frequent ones: lang, words, counts,
    numbers. A number is the word's place among the range's frequent ones, times the number
    of ranges, and the range."""

    def run(table: pa.Table) -> pa.Table:
        at = table.column("at")[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("shard", "lang", "words", "counts"))))
        known: dict[str, _Dictionary] = {}
        slots = []
        for _, lang, words, _ in rows:
            d = known.setdefault(lang, _Dictionary())
            names = words.split(b"\n")
            slots.append(np.fromiter(map(d.__getitem__, names), np.int64, len(names)))
        out: list[tuple] = []
        number, used = {}, 0
        for lang, d in sorted(known.items()):
            total = np.zeros(len(d), np.int64)
            for slot, r in zip(slots, rows):
                if r[1] == lang:
                    total[slot] += r[3]
            good = np.flatnonzero(total >= least)
            number[lang] = np.full(len(d), BREAK, np.int64)
            number[lang][good] = ((used + np.arange(len(good))) << range_bits) + at
            used += len(good)
            names = list(d)
            if len(good):
                out.append((at, None, None, None, lang, [names[i] for i in good.tolist()], total[good], number[lang][good]))
        out += [(at, r[0], len(slot), _squeeze(number[r[1]][slot]), None, None, None, None) for slot, r in zip(slots, rows)]
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["at", "shard", "size", "wids", "lang", "words", "counts", "numbers"])

    return cut.groupBy("at").applyInArrow(run, "at long, shard long, size long, wids binary, lang string, words array<binary>, counts array<long>, numbers array<long>")


def _stretches(ids: np.ndarray, good: np.ndarray, width: int) -> np.ndarray:
    """The words of each run of good starts, `width` words from each, BREAK in front."""
    start = np.flatnonzero(good & ~np.concatenate([[False], good[:-1]]))
    end = np.flatnonzero(good & ~np.concatenate([good[1:], [False]])) + width
    size = end - start + 1
    at = np.arange(int(size.sum())) + np.repeat(start - 1 - (np.cumsum(size) - size), size)
    out = ids[np.maximum(at, 0)]
    out[np.cumsum(size) - size] = BREAK
    return out


class Packing:
    """n word numbers of `bits` bits in lanes of at most 64 bits, permuted."""

    def __init__(self, n: int, bits: int):
        lane = 64 // bits
        self.n, self.bits = n, bits
        self.words = [min(lane, n - i) for i in range(0, n, lane)]
        self.width = [w * bits for w in self.words]

    @staticmethod
    def _mask(width: int) -> np.uint64:
        return np.uint64(_FULL >> (64 - width))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    # Odd factors, and what undoes each modulo 2^64.
    FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
    UNDO = tuple(pow(f, -1, 1 << 64) for f in FACTORS)

    def permute(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        first, rest = lanes[0], lanes[1:]
        for x in rest:
            first = first ^ (self._mix(x) & self._mask(self.width[0]))
        half = np.uint64(self.width[0] - self.width[0] // 2)
        for f in self.FACTORS:
            first = first ^ (first >> half)
            first = (first * np.uint64(f)) & self._mask(self.width[0])
        first = first ^ (first >> half)
        return [first, *[x ^ (self._mix(first) & self._mask(w)) for x, w in zip(rest, self.width[1:])]]

    def restore(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        first = lanes[0]
        rest = [x ^ (self._mix(first) & self._mask(w)) for x, w in zip(lanes[1:], self.width[1:])]
        half = np.uint64(self.width[0] - self.width[0] // 2)
        first = first ^ (first >> half)
        for f in reversed(self.UNDO):
            first = (first * np.uint64(f)) & self._mask(self.width[0])
            first = first ^ (first >> half)
        for x in rest:
            first = first ^ (self._mix(x) & self._mask(self.width[0]))
        return [first, *rest]

    def pack(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Lanes of the n-grams that begin at these places."""
        lanes, i = [], 0
        for w in self.words:
            x = np.zeros(len(at), np.uint64)
            for _ in range(w):
                x = (x << np.uint64(self.bits)) | ids[at + i].astype(np.uint64)
                i += 1
            lanes.append(x)
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> np.ndarray:
        """(n-grams, n) word numbers."""
        out = []
        for x, w in zip(lanes, self.words):
            out += [(x >> np.uint64(self.bits * (w - 1 - j))) & self._mask(self.bits) for j in range(w)]
        return np.stack(out, 1).astype(np.int64)


def sorted_counts(lanes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct rows in order, place of each row among them, how often each is there)."""
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    held = [x[order] for x in lanes]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in held])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return [x[first] for x in held], back, np.diff(np.append(first, len(order)))


class QuotientFilter:
    """Bytes of a sorted slice of n-grams, and back."""

    @staticmethod
    def _bytes(x: np.ndarray, size: int) -> bytes:
        return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()

    @staticmethod
    def _numbers(raw: bytes, size: int) -> np.ndarray:
        wide = np.zeros((len(raw) // size, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
        return wide.view("<u8").ravel()

    @classmethod
    def write(cls, lanes: list[np.ndarray], counts: np.ndarray, packing: Packing, range_bits: int, at: int) -> bytes:
        """at: number of the slice's range, which the high range_bits of the quotient are."""
        n, width = len(counts), packing.width[0]
        # Whole bytes of remainder, about one quotient for each entry.
        keep = max(0, min((width - range_bits) // 8, -(-(width - range_bits - n.bit_length()) // 8)))
        rest = np.uint64(8 * keep)
        high = (lanes[0] >> rest) if keep < 8 else np.zeros(n, np.uint64)
        first = at << (width - range_bits - 8 * keep)
        runs = np.bincount((high - np.uint64(first)).astype(np.int64), minlength=1 << (width - range_bits - 8 * keep))
        small = np.minimum(counts, 255).astype(np.uint8)
        parts = [runs.astype("<u4").tobytes(), cls._bytes(lanes[0], keep) if keep else b""]
        parts += [cls._bytes(x, -(-w // 8)) for x, w in zip(lanes[1:], packing.width[1:])]
        parts += [small.tobytes(), counts[small == 255].astype("<i8").tobytes()]
        head = np.array([n, keep, *map(len, parts)], "<i8")
        return head.tobytes() + b"".join(parts)

    @classmethod
    def read(cls, raw: bytes, packing: Packing, range_bits: int, at: int) -> tuple[list[np.ndarray], np.ndarray]:
        n_parts = len(packing.width) + 3
        head = np.frombuffer(raw, "<i8", 2 + n_parts)
        n, keep = int(head[0]), int(head[1])
        ends = 8 * (2 + n_parts) + np.cumsum(head[2:])
        part = [raw[b - s : b] for b, s in zip(ends.tolist(), head[2:].tolist())]
        runs = np.frombuffer(part[0], "<u4")
        first = at << (packing.width[0] - range_bits - 8 * keep)
        high = np.repeat(np.arange(len(runs), dtype=np.uint64) + np.uint64(first), runs)
        low = cls._numbers(part[1], keep) if keep else np.zeros(n, np.uint64)
        lanes = [(high << np.uint64(8 * keep)) | low if keep < 8 else low]
        lanes += [cls._numbers(p, -(-w // 8)) for p, w in zip(part[2:-2], packing.width[1:])]
        counts = np.frombuffer(part[-2], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(part[-1], "<i8")
        return lanes, counts


def _grams(ids: np.ndarray, packing: Packing) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(places, distinct permuted lanes, place of each among them, counts) of a shard's n-grams."""
    n = packing.n
    if len(ids) < n:
        at = np.empty(0, np.int64)
    else:
        broken = np.concatenate([[0], np.cumsum(ids < 0)])
        at = np.flatnonzero(broken[n:] == broken[:-n])
    return at, *sorted_counts(packing.permute(packing.pack(ids, at)))


def filters(state: DataFrame, packing: Packing, range_bits: int) -> DataFrame:
    """state (shard, n, ids): at, shard, filter: each shard's filter cut by ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                _, lanes, _, counts = _grams(_expand(blob, n), packing)
                top = (lanes[0] >> np.uint64(packing.width[0] - range_bits)).astype(np.int64) if range_bits else np.zeros(len(counts), np.int64)
                ranges, first = np.unique(top, return_index=True)
                cuts = [*first.tolist(), len(top)]
                raw = [QuotientFilter.write([x[a:b] for x in lanes], counts[a:b], packing, range_bits, r) for r, a, b in zip(ranges.tolist(), cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(np.full(len(raw), shard, np.int64)), pa.array(raw, pa.binary())], ["at", "shard", "filter"])

    return state.select("shard", "n", "ids").mapInArrow(run, "at long, shard long, filter binary")


def merged(cut: DataFrame, packing: Packing, range_bits: int, least: int) -> DataFrame:
    """Merges each range's filters: at, shard, good: a bit for each slot of the shard's slice,
    whether its n-gram is frequent; and a row without a shard that has the frequent n-grams:
    grams (word numbers, n each) and counts."""

    def run(table: pa.Table) -> pa.Table:
        at, rows = table.column("at")[0].as_py(), sorted(zip(table.column("shard").to_pylist(), table.column("filter").to_pylist()))
        read = [QuotientFilter.read(raw, packing, range_bits, at) for _, raw in rows]
        lanes = [np.concatenate(x) for x in zip(*(lanes for lanes, _ in read))]
        counts = np.concatenate([c for _, c in read])
        whole, back, _ = sorted_counts(lanes)
        total = np.zeros(len(whole[0]), np.int64)
        np.add.at(total, back, counts)
        good = total >= least
        ends = np.cumsum([len(c) for _, c in read])
        bits = [np.packbits(x).tobytes() for x in np.split(good[back], ends[:-1])]
        words = packing.unpack(packing.restore([x[good] for x in whole])) if good.any() else np.empty((0, packing.n), np.int64)
        n = len(rows)
        columns = [[at] * (n + 1), [s for s, _ in rows] + [None], bits + [None], [None] * n + [words.ravel()], [None] * n + [total[good]]]
        kinds = pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds)], names=["at", "shard", "good", "grams", "counts"])

    return cut.groupBy("at").applyInArrow(run, "at long, shard long, good binary, grams array<long>, counts array<long>")


def narrowed(state: DataFrame, told: DataFrame, packing: Packing, range_bits: int) -> DataFrame:
    """The stretches of each shard whose n-grams are all frequent."""
    by = told.where("shard is not null").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("at", "good"))).alias("told"))
    both = state.join(by, "shard").select("shard", "n", "ids", F.col("told.at").alias("at"), F.col("told.good").alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, blob, _, bits in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _expand(blob, n)
                at, lanes, back, counts = _grams(ids, packing)
                top = (lanes[0] >> np.uint64(packing.width[0] - range_bits)).astype(np.int64) if range_bits else np.zeros(len(counts), np.int64)
                size = np.unique(top, return_counts=True)[1]
                slots = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=s) for b, s in zip(bits, size.tolist())]).astype(bool)
                good = np.zeros(len(ids), bool)
                good[at] = slots[back]
                kept = _stretches(ids, good, packing.n)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(kept)]), pa.array([_squeeze(kept)], pa.binary())], ["shard", "n", "ids"])

    return both.mapInArrow(run, "shard long, n long, ids binary")


def _known(held: DataFrame, told: DataFrame) -> DataFrame:
    """Shards with the numbers of frequent words for their own, cut to stretches of these."""
    by = told.where("shard is not null").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("at", "size", "wids"))).alias("told"))
    both = held.select("shard", "n", "ids").join(by, "shard").select("shard", "n", "ids", F.col("told.size").alias("size"), F.col("told.wids").alias("wids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, blob, size, wids in zip(*(c.to_pylist() for c in batch.columns)):
                # One number more, for BREAK itself.
                number = np.concatenate([*(_expand(w, s) for w, s in zip(wids, size)), np.array([BREAK], "<i4")])
                ids = number[_expand(blob, n)]
                good = np.zeros(len(ids), bool)
                good[:-1] = (ids[:-1] >= 0) & (ids[1:] >= 0)
                kept = _stretches(ids, good, 2)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(kept)]), pa.array([_squeeze(kept)], pa.binary())], ["shard", "n", "ids"])

    return both.mapInArrow(run, "shard long, n long, ids binary")


def counted(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals (lang, n), words (wid, lang, word, f), grams (ids, f)): all words of each
    language, and the words and phrases of up to `longest` words that occur `least` times."""
    held = stored(shards(docs))
    totals = stored(held.groupBy("lang").agg(F.sum("total").alias("n")))
    cut_at = max(0, ((held.agg(F.sum("m")).first()[0] or 0) // RANGE_ENTRIES).bit_length())
    told = stored(_merged_words(_word_slices(held, cut_at), cut_at, least))
    frequent = told.where("shard is null").select("lang", F.explode(F.arrays_zip("words", "counts", "numbers")).alias("x"))
    words = stored(frequent.select(F.col("x.numbers").alias("wid"), "lang", F.col("x.words").alias("word"), F.col("x.counts").alias("f")))
    bits = max(1, (words.agg(F.max("wid")).first()[0] or 0).bit_length())
    if bits > 31:
        raise ValueError("over 2^31 frequent words")
    grams = [words.select(F.array("wid").alias("ids"), "f")]
    state = stored(_known(held, told))
    for n in range(2, longest + 1):
        size = state.agg(F.sum("n")).first()[0]
        if not size:
            break
        packing = Packing(n, bits)
        range_bits = min(packing.width[0] - 1, max(0, (size // RANGE_ENTRIES).bit_length()))
        told = stored(merged(filters(state, packing, range_bits), packing, range_bits, least))
        found = told.where("shard is null").select("counts", F.expr(f"transform(sequence(0, size(counts) - 1), i -> slice(grams, i * {n} + 1, {n}))").alias("g")).where("size(counts) > 0")
        grams.append(found.select(F.explode(F.arrays_zip("g", "counts")).alias("x")).select(F.col("x.g").alias("ids"), F.col("x.counts").alias("f")))
        if n < longest:
            state = stored(narrowed(state, told, packing, range_bits))
    whole = grams[0]
    for g in grams[1:]:
        whole = whole.unionByName(g)
    return totals, words, whole


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, spread: int = 64) -> DataFrame:
    """docs (lang, text, ...): lang, rank, phrase, a, l, r, n, score of each language's `top`
    phrases of two words on that occur `least` times.

    Cut after k words, a phrase of frequency a has parts of frequencies l and r, and scores
    floor(1000 a n / (l r)), n being all words of the language; the cut that scores least
    counts, the first among equals. Arithmetic is in decimals of 38 digits. A phrase within
    a longer one that has `share` percent of its frequency goes.

    Null texts are empty, a null lang is `und`, repeated rows count each time, other columns
    are not read; an empty table gives no rows. Order of phrases: bytes of UTF-8."""
    totals, words, whole = counted(docs, least, longest)
    grams = stored(whole.withColumn("k", F.size("ids")))
    within = F.array(F.expr("slice(ids, 1, k - 1)"), F.expr("slice(ids, 2, k - 1)"))
    longer = grams.where("k > 2").select(F.explode(within).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("_more"))
    kept = grams.where("k > 1").join(longer, "ids", "left").where(F.coalesce(100 * F.col("_more") < share * F.col("f"), F.lit(True))).select("ids", "k", "f")
    cuts = kept.select("ids", "k", "f", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select("*", F.expr("slice(ids, 1, cut)").alias("_l"), F.expr("slice(ids, cut + 1, k)").alias("_r"))
    part = lambda key, name: grams.select(F.col("ids").alias(key), F.col("f").alias(name))
    cuts = cuts.join(part("_l", "l"), "_l").join(part("_r", "r"), "_r")
    tongue = words.select(F.col("wid").alias("_w"), "lang")
    cuts = cuts.withColumn("_w", F.col("ids")[0]).join(tongue, "_w").join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
    cuts = cuts.select("*", F.expr("(cast(1000 as decimal(5,0)) * cast(f as decimal(15,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score"))
    best = cuts.groupBy("ids").agg(F.min(F.struct("score", "cut", "lang", F.col("f").alias("a"), "l", "r", "n")).alias("b"))
    named = best.select("ids", F.posexplode("ids").alias("i", "_w")).join(words.select(F.col("wid").alias("_w"), "word"), "_w")
    spelt = named.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"].cast("string")), " ").alias("phrase"))
    scored = best.join(spelt, "ids").select("b.lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each part of a language first, so that no task sorts all of it.
    some = Window.partitionBy("lang", "_s").orderBy(*order)
    few = scored.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(spread))).withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
