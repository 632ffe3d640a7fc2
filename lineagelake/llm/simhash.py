"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. By the pigeonhole principle two fingerprints that
differ in at most `radius` bits have a segment in which they differ in few bits, so each
segment value enumerates the small Hamming ball around it, fetches the table entries
there, and complete distances are verified on what is fetched.

Scale: equal fingerprints are merged first. Balls are enumerated once for each distinct
segment value, not for each document. A table entry holds a block of at most BLOCK
fingerprints, so a hot value is many rows that are dealt over many tasks, and a match of
two blocks is verified in one vectorised step which returns a spanning forest of its
links, never all pairs. Connectivity, and so every class, is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.graph import components
from lineagelake.session import checkpoint, own_exchange

BLOCK = 2048
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def simhash(raw: bytes, shingle: int = 4) -> int:
    """Fingerprint as an unsigned integer; texts without words have 0."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        parts = [joined]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        begin = (end - size)[: n - shingle + 1].tolist()
        parts = [joined[a:b] for a, b in zip(begin, end[shingle - 1 :].tolist())]
    digest, seeds = xxhash.xxh64_intdigest, (42,) * len(parts)
    h = np.fromiter(map(digest, parts, seeds), np.uint64, len(parts)).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view(np.uint64)[0])


def wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64-bit hashes in `words` words of 64 bits, each with hashes of its own that
    are mixed from the given ones; of none all bits are 0."""
    ones = np.zeros(64 * words, np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * _ODD[0]
    for i in range(0, len(hashes), 255):  # as many as a byte counts
        h = hashes[i : i + 255, None] ^ salt
        for odd in _ODD:
            h ^= h >> np.uint64(32)
            h *= odd
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, text_hash): one row for each row of docs, fp the fingerprint as a signed
    long, text_hash what tells rows of one id with different texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((simhash(t or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["doc_id", "fp", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), text_hash(text).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (row, doc_id, text): all columns in one struct, so that no name can clash, and
    an id for each row; a row without one takes it from its text, above 2^62."""
    text = F.col("text").cast("string")
    anonymous = F.lit(1 << 62) + text_hash(text).bitwiseAND(F.lit((1 << 62) - 1))
    return docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), anonymous).alias("doc_id"), text.alias("text"))


def first_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (row, doc_id, text) and found (doc_id, text_hash, root) of them: the row of each
    component with the least id, of several the least text hash, then the least row.

    One (id, text hash) is chosen a component, by pre-aggregated minima, so rows of one id
    with different texts are chosen each for its own component and no component is lost."""
    chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("c")).select("c.*").distinct()
    placed = rows.select("row", "doc_id", text_hash(F.col("text")).alias("text_hash"))
    kept = placed.join(own_exchange(chosen, "doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    return kept.groupBy("doc_id", "text_hash").agg(F.min("row").alias("row")).select("row.*")


def segments(bits: int, pieces: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment; the radii make every link within `radius` meet."""
    least, rest = divmod(radius, pieces)
    out, shift = [], 0
    for i in range(pieces):
        width = bits // pieces + (i < bits % pieces)
        out.append((shift, width, least if i <= rest else least - 1))
        shift += width
    return [s for s in out if s[2] >= 0]


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most `radius` of `width` bits, zero first."""
    masks = [0]
    for _ in range(radius):
        masks += [m | 1 << i for m in masks for i in range(width) if 1 << i > m]
    return sorted(set(masks), key=lambda m: (m.bit_count(), m))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def spanning(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links between a and b (of a, if same): breadth-first, so
    what is reached once is never compared again."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    left = [a.copy(), a if same else b.copy()]
    if same:
        left[1] = left[0]
    while len(left[0]):
        front, side = left[0][:1], 0
        left[0] = left[0][1:]
        if same:
            left[1] = left[0]
        waves = [(front, side)]
        while waves:
            front, side = waves.pop()
            other = 0 if same else 1 - side
            for i in range(0, len(front), 512):
                rest = left[other]
                if not len(rest):
                    break
                hit = _near(front[i : i + 512], rest, radius)
                any_hit = hit.any(axis=0)
                if any_hit.any():
                    found = rest[any_hit]
                    out.append((front[i : i + 512][hit.argmax(axis=0)[any_hit]], found))
                    left[other] = rest[~any_hit]
                    if same:
                        left[0] = left[1] = left[other]
                    waves.append((found, other))
    return out


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = b.column(0).to_numpy(zero_copy_only=False)
            lists = [b.column(i) for i in (1, 2)]
            off = [x.offsets.to_numpy() for x in lists]
            val = [x.values.to_numpy().view(np.uint64) for x in lists]
            size = [np.diff(o).astype(np.int64) for o in off]
            work = size[0] * size[1]
            u, v = [], []
            small = np.flatnonzero(work <= 256)
            for i in range(0, len(small), 4096):  # many small matches in one step
                rows = small[i : i + 4096]
                n = work[rows]
                row = np.repeat(rows, n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                x = val[0][off[0][row] + k // size[1][row]]
                y = val[1][off[1][row] + k % size[1][row]]
                ok = (np.bitwise_count(x ^ y) <= radius) & (x != y)
                u.append(x[ok])
                v.append(y[ok])
            for r in np.flatnonzero(work > 256):
                x, y = (val[i][off[i][r] : off[i][r + 1]] for i in (0, 1))
                for p, q in spanning(x, y, radius, bool(same[r])):
                    u.append(p)
                    v.append(q)
            u, v = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (u, v))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = 4, pieces: int = 3) -> DataFrame:
    """distinct (fp long), each once: (u, v) whose transitive closure is that of all links
    of at most `radius` bits. Each returned link is verified."""
    segs = segments(64, pieces, radius)
    shape = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(s).alias("shift"), F.lit((1 << w) - 1).cast("long").alias("mask")) for i, (s, w, _) in enumerate(segs)])
    entries = distinct.select("fp", F.explode(shape).alias("s")).select(
        "fp", F.col("s.seg").cast("long").alias("seg"), F.expr("shiftrightunsigned(fp, s.shift) & s.mask").alias("key")
    )
    # At most the sum of 2^width keys, whatever the input's size.
    sizes = checkpoint(entries.groupBy("seg", "key").agg(F.count("*").alias("n")))
    hot = sizes.where(F.col("n") > BLOCK)
    blocks = (
        entries.join(own_exchange(hot, "seg", "key"), ["seg", "key"], "left")
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("long")))
        .groupBy("seg", "key", "block")
        .agg(F.collect_list("fp").alias("fps"))
    )
    blocks = checkpoint(blocks)
    masks = F.array(*[F.struct(F.lit(i).cast("long").alias("seg"), F.lit(m).cast("long").alias("x"), F.lit(m & -m).cast("long").alias("low")) for i, (_, w, r) in enumerate(segs) for m in ball(w, r)])
    # Of two keys that differ, the one that has the mask's lowest bit asks for the other.
    asked = (
        sizes.select("seg", "key", "n", F.explode(masks).alias("m"))
        .where("m.seg = seg and (m.x = 0 or key & m.low <> 0)")
        .select("seg", F.col("key").alias("key_a"), F.expr("key ^ m.x").alias("key_b"), (F.col("m.x") == 0).alias("own"), F.col("n").alias("n_a"))
    )
    found = asked.where("not own or n_a > 1").join(sizes.select("seg", F.col("key").alias("key_b")), ["seg", "key_b"]).select("seg", "key_a", "key_b", "own")
    a = blocks.select("seg", F.col("key").alias("key_a"), F.col("block").alias("block_a"), F.col("fps").alias("fps_a"))
    b = blocks.select("seg", F.col("key").alias("key_b"), F.col("block").alias("block_b"), F.col("fps").alias("fps_b"))
    met = found.join(a, ["seg", "key_a"]).join(b, ["seg", "key_b"]).where("not own or block_a <= block_b")
    pairs = met.select((F.col("own") & (F.col("block_a") == F.col("block_b"))).alias("same"), "fps_a", "fps_b")
    return pairs.mapInArrow(_verify(radius), "u long, v long")


def classes(docs: DataFrame, shingle: int = 4, radius: int = 4, pieces: int = 3) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, fp, text_hash, root, component_id), see near_duplicates.
    Where rows of one id have different texts, two components can have one component_id;
    root tells them apart."""
    fps = checkpoint(fingerprints(docs, shingle))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(first.select("fp"), radius, pieces))
    with_root = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = with_root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = with_root.select("fp", "root").join(own_exchange(least, "root"), "root").select("fp", "root", "component_id")
    return fps.join(own_exchange(of_fp, "fp"), "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, pieces: int = 3) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, fp, component_id), one row for each row of docs.

    component_id is the smallest doc_id reachable over links of at most `radius` differing
    bits. Null and empty texts, and texts of white space only, have fingerprint 0, which is
    linked like any other. Repeated rows stay repeated. Rows with a null doc_id keep null as
    id and take the component of their fingerprint (null if no row of it has an id). Other
    columns are not read, so clashing names can't matter. An empty table gives no rows.
    """
    return classes(docs, shingle, radius, pieces).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, pieces: int = 3) -> DataFrame:
    """One row of each group of near duplicates, with the columns of docs: the one with the
    smallest doc_id; of several rows with that id, the least text hash, then the least row
    by its columns in order.

    Rows of one id with different texts belong each to its own group. A row without an id
    takes one from its text, above all ids up to 2^62, so it stays only where no row of its
    group has an id. Columns may have any names, but must be orderable (no maps)."""
    rows = keyed(docs)
    found = classes(rows.select("doc_id", "text"), shingle, radius, pieces)
    return first_rows(rows, found)
