"""Media columns: motion-JPEG in AVI.

Reading: the RIFF index gives the frames, each frame is a baseline JPEG that is decoded by
itself, and shots are found where the histogram of a frame differs from the one before by
more than its surroundings do. A clip row tells when a shot begins and ends.

Writing: bytes are stored losslessly in the unit that JPEG keeps exactly, the quantised
coefficient. A byte b is the coefficient b - 255 below 128 and b from there on: these are
the 256 values of magnitude category 8, whose extra bits are b itself. One Huffman code of
8 bits then keeps every coefficient on byte boundaries, so coding and decoding such frames
are array operations; frames with other codes are decoded bit by bit.

Files of other makers may lack Huffman tables (the usual ones then hold), go on in further
RIFF segments, bring OpenDML indexes, or be broken: what can't be read is counted and told,
never raised.

Each row is one medium and is handled by itself: no shuffle, and memory is bounded by the
largest medium.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FPS = 25
SIDE = 8  # blocks a frame's side, at most
BATCH_BYTES = 8 << 20

# The zigzag order of a block's coefficients, row * 8 + column.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_C = np.sqrt(2 / 8) * np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) / np.where(np.arange(8) == 0, np.sqrt(2), 1)[:, None]
# Rows: coefficients in natural order; columns: samples in natural order.
_IDCT = np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    one_code = bytes([0] * 7 + [1] + [0] * 8 + [8])  # one code, of 8 bits, for category 8
    return (
        b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + one_code) + _segment(0xC4, b"\x10" + one_code) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _scans(blocks: np.ndarray) -> bytes:
    """Entropy-coded data of one frame's blocks (n, 64 bytes), a restart after each block."""
    n = len(blocks)
    data = np.zeros((n, 130), np.uint8)
    data[:, 1:128:2] = blocks
    data[:, 128], data[:, 129] = 0xFF, 0xD0 + np.arange(n) % 8
    if (blocks == 0xFF).any():  # a byte 0xFF of the data is followed by a zero
        flat = data.reshape(-1)
        mark = np.zeros(data.shape, bool)
        mark[:, 1:128:2] = blocks == 0xFF
        return np.insert(flat, np.flatnonzero(mark.reshape(-1)) + 1, 0).tobytes()[:-2]
    return data.tobytes()[:-2]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write(payload: bytes) -> bytes:
    """AVI file that holds the payload, whose length is a positive multiple of 64."""
    n = len(payload) // 64
    if not n or len(payload) % 64:
        raise ValueError("the payload must be whole blocks of 64 bytes")
    w = min(n, SIDE)
    h = min(-(-n // w), SIDE)
    per = w * h
    frames = -(-n // per)
    blocks = np.zeros((frames * per, 64), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    head = _frame_head(8 * w, 8 * h)
    chunks, index, at = [], [], 4
    for i in range(frames):
        jpeg = head + _scans(blocks[i * per : (i + 1) * per]) + b"\xff\xd9"
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(jpeg)))
        chunks.append(_chunk(b"00dc", jpeg))
        at += len(chunks[-1])
    most = max(map(len, chunks))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, frames, 0, 1, most, 8 * w, 8 * h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, frames, most, 10_000, 0, 0, 0, 8 * w, 8 * h)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * w, 8 * h, 1, 24, b"MJPG", 192 * w * h, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d" % len(payload))
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of each chunk; a chunk cut short by the file's end is cut too."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def _indexed(data: bytes, at: int, size: int) -> list[tuple[int, int]]:
    """(start, size) of the frames that an OpenDML index chunk (ix..) names."""
    per, kind, n, base = struct.unpack_from("<HxBI4xQ", data, at) if size >= 24 else (0, 0, 0, 0)
    if per != 2 or kind != 1:
        return []
    n = min(n, (size - 24) // 8)
    pairs = np.frombuffer(data, "<u4", 2 * n, at + 24).reshape(n, 2).astype(np.int64)
    return [(base + int(o), int(k & 0x7FFFFFFF)) for o, k in pairs]


def parse(data: bytes) -> dict:
    """{frames: [(start, size)], fps, payload (or None)} of all RIFF segments: by OpenDML
    indexes, or by each segment's own index, or by the chunks themselves."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI " or len(data) < 20:
        raise ValueError("no AVI file")
    out: dict = {"frames": [], "fps": float(FPS), "payload": None}
    movis, index, long_index = [], [], []
    todo = [(start + 4, start + size) for name, start, size in _walk(data, 0, len(data)) if name == b"RIFF" and data[start : start + 4] in (b"AVI ", b"AVIX")]
    while todo:
        for name, start, size in _walk(data, *todo.pop()):
            kind = data[start : start + 4]
            if name == b"LIST" and kind == b"movi":
                movis.append((start, size))
                long_index += [(s, n) for x, s, n in _walk(data, start + 4, start + size) if x[:2] == b"ix"]
            elif name == b"LIST":
                todo.append((start + 4, start + size))
            elif name == b"avih" and size >= 4 and struct.unpack_from("<I", data, start)[0]:
                out["fps"] = 1_000_000 / struct.unpack_from("<I", data, start)[0]
            elif name == b"ICMT" and data[start : start + 8] == b"payload=" and data[start + 8 : start + size].rstrip(b"\0").isdigit():
                out["payload"] = int(data[start + 8 : start + size].rstrip(b"\0"))
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, start + i) for i in range(0, size - 15, 16)]
            elif name[:2] == b"ix":
                long_index.append((start, size))
    movis.sort()
    if not movis:
        raise ValueError("no frames")
    inside = lambda x: 0 <= x[0] and x[0] + x[1] <= len(data)
    out["frames"] = [f for at, n in sorted(long_index) for f in _indexed(data, at, n) if inside(f)]
    walked = lambda movi: [(s, n) for name, s, n in _walk(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db")]
    if not out["frames"]:
        for name, _, at, size in index:
            for base in (movis[0][0], 0):  # offsets from the list's name, or from the file's start
                if name[2:] in (b"dc", b"db") and data[base + at : base + at + 4] == name:
                    out["frames"].append((base + at + 8, size))
                    break
        # The index of old files covers the first segment alone.
        for movi in movis[1:] if out["frames"] else movis:
            out["frames"] += walked(movi)
    return out


def _usual(lengths: tuple[int, ...], head: bytes) -> tuple[bytes, bytes]:
    """A usual table: the symbols of `head`, then the rest of all (zeros, size) by number."""
    every = [0x00, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 11))]
    return bytes(lengths), head + bytes(sorted(set(every) - set(head)))


# The usual Huffman tables of the JPEG standard (class and place: code lengths, symbols).
_USUAL = {
    0x00: (bytes((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)), bytes(range(12))),
    0x01: (bytes((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)), bytes(range(12))),
    0x10: _usual((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    0x11: _usual((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), bytes.fromhex("0001020311040521310612415107617113223281081442" "91a1b1c109233352f0156272d10a162434e125f1")),
}


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(bits, code) -> symbol."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_ALIGNED = {(8, 0): 8}


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.n, self.acc = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at > len(self.data) + 64:
                raise ValueError("the frame is cut short")
            self.acc = self.acc << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        out = self.acc >> self.n
        self.acc &= (1 << self.n) - 1
        return out

    def symbol(self, codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> size - 1 else v - (1 << size) + 1


def decode_frame(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Baseline JPEG: (quantised coefficients of the first component's blocks in zigzag
    order and in scan order, its quantisation table in zigzag order, (width, height))."""
    quant, comps, restart, size, at = {}, [], 0, (0, 0), 2
    huff = {k: _codes(*v) for k, v in _USUAL.items()}
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    while True:
        while jpeg[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if jpeg[at : at + 1] != b"\xff":
            raise ValueError("no marker")
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            size = struct.unpack_from(">HH", body, 1)[::-1]
            comps = [[*body[i : i + 3], 0] for i in range(6, 6 + 3 * body[5], 3)]
            all_hv = [(c[1] >> 4, c[1] & 15) for c in comps]
            if not all(1 <= x <= 4 for hv in all_hv for x in hv):
                raise ValueError("no such sampling")
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            named = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if comps and comps[0][0] in named:  # the scan that holds the first component
                single = len(named) == 1
                hv0 = comps[0][1]
                comps = [[c[0], c[1], c[2], named[c[0]]] for c in comps if c[0] in named]
                break
            at = _scan_end(jpeg, at)
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a baseline frame")
    scan = jpeg[at : _scan_end(jpeg, at)]
    if len(comps) == 1 and restart == 1 and huff[comps[0][3] >> 4] == _ALIGNED == huff[16 + (comps[0][3] & 15)]:
        raw = np.frombuffer(scan, np.uint8)
        if len(raw) % 130 != 128 or (raw[1::130] == 0xFF).any() or scan.find(b"\xff\x00") >= 0:
            ff = np.flatnonzero(raw[:-1] == 0xFF)
            raw = np.delete(raw, ff[raw[ff + 1] == 0] + 1)
        b = np.concatenate([raw, np.zeros(2, np.uint8)]).reshape(-1, 130)[:, 1:128:2].astype(np.int32)
        return np.where(b < 128, b - 255, b), quant[comps[0][2]], size
    hv = [(c[1] >> 4, c[1] & 15) for c in comps]
    most = (max(h for h, _ in all_hv), max(v for _, v in all_hv))
    if single:  # blocks stand in the component's own rows
        hv = [(1, 1)]
        mcus = -(-size[0] * (hv0 >> 4) // (8 * most[0])) * -(-size[1] * (hv0 & 15) // (8 * most[1]))
    else:
        mcus = -(-size[0] // (8 * most[0])) * -(-size[1] // (8 * most[1]))
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in _split_restarts(scan)]
    out, done = [], 0
    for piece in pieces:
        bits, pred = _Bits(piece), [0] * len(comps)
        for _ in range(min(restart or mcus, mcus - done)):
            for k, c in enumerate(comps):
                for _ in range(hv[k][0] * hv[k][1]):
                    block = [0] * 64
                    pred[k] += bits.value(bits.symbol(huff[c[3] >> 4]))
                    block[0], i = pred[k], 1
                    while i < 64:
                        s = bits.symbol(huff[16 + (c[3] & 15)])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            block[i] = bits.value(s & 15)
                        i += 1
                    if k == 0:
                        out.append(block)
            done += 1
    return np.array(out, np.int32).reshape(-1, 64), quant[comps[0][2]], size


def _scan_end(jpeg: bytes, at: int) -> int:
    """Where the entropy-coded data that begin at `at` end: at the next marker that is no restart."""
    i = jpeg.find(b"\xff", at)
    while 0 <= i < len(jpeg) - 1:
        if jpeg[i + 1] != 0 and not 0xD0 <= jpeg[i + 1] <= 0xD7:
            return i
        i = jpeg.find(b"\xff", i + 2)
    return len(jpeg)


def _split_restarts(scan: bytes) -> list[bytes]:
    out, a, i = [], 0, scan.find(b"\xff")
    while 0 <= i < len(scan) - 1:
        if 0xD0 <= scan[i + 1] <= 0xD7:
            out.append(scan[a:i])
            a = i + 2
        i = scan.find(b"\xff", i + 2)
    return [*out, scan[a:]]


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples of blocks, in natural order."""
    natural = np.empty(coefficients.shape, np.float32)
    natural[:, _ZIGZAG] = coefficients * quant
    return np.clip(np.rint(natural @ _IDCT) + 128, 0, 255).astype(np.uint8)


def stored_bytes(coefficients: np.ndarray) -> bytes:
    """The bytes that `write` put into coefficients."""
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes()


def shots(hist: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.15) -> list[int]:
    """First frame of each shot. hist: (frames, bins), each row summing to one.

    A cut is where the histograms' difference exceeds `least` and the mean of the differences
    within `window` frames before by `factor` of their deviations (at least 0.02)."""
    if not len(hist):
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    out = [0]
    for i, d in enumerate(diff.tolist()):
        near = diff[max(0, i - window, out[-1]) : i]
        if d > least and (not len(near) or d > near.mean() + factor * max(0.02, float(near.std()))):
            out.append(i + 1)
    return out


def read(data: bytes) -> dict:
    """{payload (None if not written here), fps, size, hist (frames, 16), starts of shots,
    broken}. A frame that can't be decoded counts as the one before it, and as `broken`."""
    found = parse(data)
    parts, hists, size, broken = [], [], (0, 0), 0
    for start, n in found["frames"]:
        try:
            coefficients, quant, size = decode_frame(data[start : start + n])
            px = samples(coefficients, quant) >> 4
        except (ArithmeticError, LookupError, TypeError, UnboundLocalError, ValueError, struct.error):
            broken += 1
            hists.append(hists[-1] if hists else np.eye(16)[0])
            continue
        hists.append(np.bincount(px.reshape(-1), minlength=16) / max(1, px.size))
        if found["payload"] is not None:
            parts.append(stored_bytes(coefficients))
    hist = np.array(hists).reshape(-1, 16)
    whole = found["payload"] is not None and not broken
    return {"payload": b"".join(parts)[: found["payload"]] if whole else None, "fps": found["fps"], "size": size, "hist": hist, "shots": shots(hist), "broken": broken}


def to_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_bytes and media (an AVI file) for each row.

    The text's UTF-8, filled with zeros to a positive multiple of 64, is stored; null counts
    as empty. Repeated rows stay repeated; other columns are not read. An empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            first, sizes, media, held = 0, [], [], 0
            for i in range(len(ids)):
                raw = texts[i].as_py() or b""
                media.append(write(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))))
                sizes.append(len(raw))
                held += len(media[-1])
                if held > BATCH_BYTES or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, i + 1 - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    first, sizes, media, held = i + 1, [], [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


CLIP = "struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,luma:double>"
_CLIP_TYPE = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64())]))
_READ = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]


def _row(data: bytes) -> tuple[list, list]:
    digest = [len(data), hashlib.sha256(data).hexdigest()]
    try:
        found = read(data)
    except (ValueError, struct.error) as e:
        return [None, None, None, *digest, None, str(e)], []
    p, hist = found["payload"], found["hist"]
    starts = [*found["shots"], len(hist)]
    mean = (hist @ (np.arange(16) * 16 + 8)).tolist()
    clips = [
        {"clip": i, "first_frame": a, "n_frames": b - a, "start_s": round(a / found["fps"], 6), "end_s": round(b / found["fps"], 6), "luma": round(sum(mean[a:b]) / (b - a), 3)}
        for i, (a, b) in enumerate(zip(starts, starts[1:]))
    ]
    levels = ".".join(f"{round(1000 * x)}" for x in (hist.mean(axis=0) if len(hist) else []))
    feature = f"{found['size'][0]}x{found['size'][1]} frames={len(hist)} shots={len(clips)} luma={levels}"
    known = [None] * 3 if p is None else [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])]
    return [*known, *digest, feature, f"{found['broken']} frames" if found["broken"] else None], clips


def read_media(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media): doc_id, n_bytes, the stored payload's length and
    digests as read back (null for files not written here), the file's, a feature string,
    error and clips. error says how many frames could not be decoded (each counts as the one
    before), or why the file could not be read, which then has no feature and no clips. A
    null medium gives nulls and no clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, clips = [], []
            for x in b.column(2):
                data = x.as_py()
                row, found = _row(data) if data is not None else ([None] * len(_READ), [])
                rows.append(row)
                clips.append(found)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array(clips, _CLIP_TYPE)], ["doc_id", "n_bytes", *_READ, "clips"])

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string, clips array<{CLIP}>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def clip_rows(read_back: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, first_frame, n_frames, start_s, end_s, luma."""
    return read_back.select("doc_id", F.inline("clips"))
