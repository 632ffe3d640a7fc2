import hashlib
import struct
import zlib

import numpy as np

from lineagelake.llm import media_avi as av


def padded(raw):
    n = max(64, -(-len(raw) // 64) * 64)
    return raw + b"\0" * (n - len(raw))


def test_round_trip_of_any_bytes():
    rng = np.random.default_rng(1)
    for n in (64, 128, 64 * 9, 64 * 64, 64 * 65, 64 * 200):
        for data in (bytes(n), b"\xff" * n, rng.integers(0, 256, n, np.uint8).tobytes(), bytes(range(256)) * (n // 256) + bytes(n % 256)):
            assert av.read(av.write(data))["payload"] == data


def test_zigzag_and_samples():
    assert av._ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and av._ZIGZAG[-4:].tolist() == [47, 55, 62, 63]
    flat = np.zeros((1, 64), np.int32)
    flat[0, 0] = 80
    assert (av.samples(flat, np.ones(64, int)) == 138).all()
    wave = np.zeros((1, 64), np.int32)
    wave[0, 1] = 100  # the first wave across a row
    px = av.samples(wave, np.ones(64, int)).reshape(8, 8)
    assert (px == px[0]).all() and px[0, 0] > px[0, 7]


def bits_frame(blocks):
    """One grey frame with codes of many lengths and no restarts, written bit by bit."""
    ac = [0x00, 0xF0] + [r << 4 | s for r in range(3) for s in range(1, 11)]
    dc = list(range(12))
    lengths = {0: [0, 0, 1, 5, 6] + [0] * 11, 1: [0, 0, 2, 4, 8, 8, 10] + [0] * 9}

    def table(symbols, counts):
        out, code, at = {}, 0, 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                out[symbols[at]] = format(code, f"0{n}b")
                code, at = code + 1, at + 1
            code <<= 1
        return out

    d, a = table(dc, lengths[0]), table(ac, lengths[1])

    def number(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    out, pred = "", 0
    for b in blocks:
        s, x = number(b[0] - pred)
        out, pred, run = out + d[s] + x, b[0], 0
        last = max([i for i in range(64) if b[i]], default=0)
        for i in range(1, last + 1):
            if not b[i]:
                run += 1
                continue
            while run > 15:
                out, run = out + a[0xF0], run - 16
            assert run < 3
            s, x = number(b[i])
            out, run = out + a[run << 4 | s] + x, 0
        if last < 63:
            out += a[0]
    out += "1" * (-len(out) % 8)
    data = int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = av._segment
    return (
        b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x02" * 64) + seg(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * len(blocks), 1, 1, 0x11, 0)) + seg(0xC4, b"\x00" + bytes(lengths[0]) + bytes(dc))
        + seg(0xC4, b"\x10" + bytes(lengths[1]) + bytes(ac)) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + data + b"\xff\xd9"
    )


def test_frames_with_other_codes():
    rng = np.random.default_rng(2)
    blocks = [[int(rng.integers(-500, 500)) if i % 3 == 0 else 0 for i in range(64)] for _ in range(5)] + [[0] * 64, [7] + [0] * 20 + [0] * 43]
    got, quant, size = av.decode_frame(bits_frame(blocks))
    assert got.tolist() == blocks and size == (56, 8) and (quant == 2).all()


def movie(levels, fps_us=40_000, with_index=True):
    def jpeg(level):
        b = [[(level - 128) * 4] + [0] * 63] * 2
        return bits_frame(b)

    chunks, index, at = [], b"", 4
    for x in levels:
        j = jpeg(x)
        index += b"00dc" + struct.pack("<III", 16, at, len(j))
        chunks.append(av._chunk(b"00dc", j))
        at += len(chunks[-1])
    hdrl = b"hdrl" + av._chunk(b"avih", struct.pack("<14I", fps_us, *[0] * 13))
    body = b"AVI " + av._chunk(b"LIST", hdrl) + av._chunk(b"LIST", b"movi" + b"".join(chunks)) + (av._chunk(b"idx1", index) if with_index else b"")
    return av._chunk(b"RIFF", body)


def test_shots_of_a_movie(spark):
    levels = [60] * 30 + [180] * 20 + [100] * 10
    for with_index in (True, False):
        found = av.read(movie(levels, with_index=with_index))
        assert found["shots"] == [0, 30, 50] and found["payload"] is None and found["fps"] == 25
    df = spark.createDataFrame([(1, 0, movie(levels)), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    rows = av.clip_rows(av.read_media(df)).orderBy("clip").collect()
    assert [(r.doc_id, r.start_s, r.end_s) for r in rows] == [(1, 0.0, 1.2), (1, 1.2, 2.0), (1, 2.0, 2.4)]


def check(df):
    rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    got = sorted(av.read_media(av.to_media(df)).collect(), key=lambda r: str((r.doc_id,)))
    assert len(got) == len(rows)
    want = sorted(((i, len((t or "").encode()), len(padded((t or "").encode())), hashlib.sha256(padded((t or "").encode())).hexdigest(), zlib.crc32(padded((t or "").encode())[-64:])) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == want
    return got


def test_documents_round_trip(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    same = {}
    for r in got:
        same.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "\0"), (4, "x" * 64), (5, "é" * 40000), (None, "z"), (6, "t"), (6, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes", "3 as clips")
    check(df)
    assert av.read_media(av.to_media(df.limit(0))).count() == 0


def usual_frame(blocks, scans=1):
    """A frame coded with the usual tables, which it does not carry; with scans=2 a second
    component's scan stands before the first one's."""
    codes = {k: {v: format(c, f"0{n}b") for (n, c), v in av._codes(*av._USUAL[k]).items()} for k in (0, 16)}

    def coded(blocks):
        out, pred = "", 0
        for b in blocks:
            d = b[0] - pred
            pred, n = b[0], abs(d).bit_length()
            out += codes[0][n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
            run = 0
            for v in b[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    out, run = out + codes[16][0xF0], run - 16
                n = abs(v).bit_length()
                out, run = out + codes[16][run << 4 | n] + format(v if v > 0 else v + (1 << n) - 1, f"0{n}b"), 0
            out += codes[16][0] if run else ""
        out += "1" * (-len(out) % 8)
        return int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\x00")

    seg = av._segment
    head = b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x02" * 64) + seg(0xC0, struct.pack(">BHHB", 8, 8, 8 * len(blocks), scans) + b"".join(bytes((i + 1, 0x11, 0)) for i in range(scans)))
    scan = lambda i, x: seg(0xDA, bytes((1, i, 0, 0, 63, 0))) + coded(x)
    return head + (scan(2, [[5] + [0] * 63] * len(blocks)) if scans == 2 else b"") + scan(1, blocks) + b"\xff\xd9"


def test_usual_tables_and_scans():
    assert [sum(x[0]) == len(x[1]) for x in av._USUAL.values()] == [True] * 4
    rng = np.random.default_rng(6)
    blocks = [[int(rng.integers(-900, 900)) if i % k == 0 else 0 for i in range(64)] for k in (1, 2, 17, 40, 64)]
    for scans in (1, 2):
        got, _, size = av.decode_frame(usual_frame(blocks, scans))
        assert got.tolist() == blocks and size == (40, 8)


def long_movie(levels, with_ix):
    """Frames in two RIFF segments, the second AVIX, with or without OpenDML indexes."""
    hdrl = b"hdrl" + av._chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13))
    out = b""
    for part, name in ((levels[:20], b"AVI "), (levels[20:], b"AVIX")):
        frames = [av._chunk(b"00dc", usual_frame([[(x - 128) * 4] + [0] * 63] * 2)) for x in part]
        before = name + (av._chunk(b"LIST", hdrl) if name == b"AVI " else b"")
        base = len(out) + 8 + len(before) + 8
        at, entries = 4, b""
        for f in frames:
            entries += struct.pack("<II", at + 8, len(f) - 8)
            at += len(f)
        ix = av._chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(part), b"00dc", base, 0) + entries) if with_ix else b""
        out += av._chunk(b"RIFF", before + av._chunk(b"LIST", b"movi" + b"".join(frames) + ix))
    return out


def test_further_segments():
    levels = [60] * 30 + [180] * 20
    for with_ix in (True, False):
        found = av.read(long_movie(levels, with_ix))
        assert len(found["hist"]) == 50 and found["shots"] == [0, 30] and found["broken"] == 0


def test_broken_files(spark):
    """Cut, scrambled and foreign bytes: a defined row for each, nothing raised."""
    good = movie([60] * 5 + [180] * 5)
    rng = np.random.default_rng(7)
    files = [b"", b"RIFF", b"no media at all", good[:12], good[: len(good) // 2], good.replace(b"\xff\xda", b"\xff\xc2", 1), av.write(b"x" * 640)[:-300]]
    for _ in range(60):
        x = bytearray(good)
        for i in rng.integers(0, len(x), 40):
            x[i] = int(rng.integers(0, 256))
        files.append(bytes(x))
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(files)], "doc_id long, n_bytes long, media binary")
    rows = {r.doc_id: r for r in av.read_media(df).collect()}
    assert len(rows) == len(files) and all(r.media_bytes == len(files[i]) for i, r in rows.items())
    assert all(rows[i].error == "no AVI file" and not rows[i].clips for i in range(4)) and rows[5].error == "1 frames" and rows[4].clips
