"""Data sources for reads and alignments: spark.read.format("reads") and format("sam").

Files are planned as ranges of bytes, gzip files whole. A task begins with the first record
that starts in its range and reads the last one past its end, so ranges need no knowledge
of each other. `part` and `nth`, a range's number in the order of files and offsets and a
record's place in it, put records in order; `numbered` makes running numbers of them from
the ranges' sizes, without a pass of all records through one task. As streams, both take
the files that come to a folder. Paths are what pyarrow opens: local, hdfs, s3, gs.

Options: path (file or folder), splitBytes (bytes of a range), dialect (of sam).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT = 64 << 20
BLOCK = 4 << 20
ROWS = 8192
READS = "file string, part int, nth long, read_name string, seq string, qual string"
SAM = "file string, part int, nth long, read_id string, flag int, ref string, pos long, cigar string, seq string, score double, line string"


@dataclass
class Range(InputPartition):
    path: str
    part: int
    start: int
    end: int


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[pafs.FileInfo]:
    system, inner = _system(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.is_file]
    return sorted((f for f in found if f.base_name[:1] not in "._"), key=lambda f: f.path)


def _ranges(files: list[pafs.FileInfo], split: int) -> list[Range]:
    out: list[Range] = []
    for f in files:
        whole = f.base_name.endswith((".gz", ".bgz"))
        for a in range(0, max(f.size, 1), max(f.size, 1) if whole else split):
            out.append(Range(f.path, len(out), a, -1 if whole else min(a + split, f.size)))
    return out


def _lines(stream, offset: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) from a line's start on."""
    rest = b""
    while block := stream.read(BLOCK):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for x in parts:
            yield offset, x.rstrip(b"\r")
            offset += len(x) + 1
    if rest:
        yield offset, rest.rstrip(b"\r")


def _open(system: pafs.FileSystem, r: Range) -> Iterator[tuple[int, bytes]]:
    """Lines that start in a range, and after it."""
    if r.end < 0:
        yield from _lines(system.open_input_stream(r.path, compression="gzip"), 0)
        return
    with system.open_input_file(r.path) as f:
        # From one byte before, so that a line that starts just there isn't taken for a rest.
        f.seek(max(r.start - 1, 0))
        lines = _lines(f, max(r.start - 1, 0))
        if r.start:
            next(lines, None)
        yield from lines


def _reads(lines: Iterator[tuple[int, bytes]], r: Range) -> Iterator[tuple[str, str, str]]:
    """(name, sequence, quality) of the records that start in a range. The first line tells
    FASTQ from FASTA; FASTA has quality H throughout."""
    over = lambda at: 0 <= r.end <= at
    head: list[tuple[int, bytes]] = []
    for at, x in lines:
        head.append((at, x))
        if x[:1] == b">":
            yield from _fasta([(at, x)], lines, over)
            return
        if r.start <= 0 and x[:1] == b"@":
            head = [(at, x)]
            break
        # In the middle of a FASTQ file: a record's third line tells its first.
        if len(head) >= 3 and head[-3][1][:1] == b"@" and x[:1] == b"+":
            head = head[-3:]
            break
        if len(head) > 8:
            head.pop(0)
    else:
        return
    record = head
    while True:
        while len(record) < 4:
            line = next(lines, None)
            if line is None:
                if any(x for _, x in record):
                    raise ValueError(f"{r.path}: the last record is cut off")
                return
            if record or line[1]:
                record.append(line)
        if over(record[0][0]):
            return
        yield _name(record[0][1]), record[1][1].decode(), record[3][1].decode()
        record = []


def _fasta(head: list, lines: Iterator[tuple[int, bytes]], over) -> Iterator[tuple[str, str, str]]:
    (at, name), seq = head[0], []
    if over(at):
        return
    for at, x in lines:
        if x[:1] == b">":
            s = b"".join(seq).decode()
            yield _name(name), s, "H" * len(s)
            if over(at):
                return
            name, seq = x, []
        else:
            seq.append(x.replace(b" ", b""))
    s = b"".join(seq).decode()
    yield _name(name), s, "H" * len(s)


def _name(head: bytes) -> str:
    return (head[1:].split(None, 1) or [b""])[0].decode()


def _alignments(lines: Iterator[tuple[int, bytes]], r: Range, dialect: str) -> Iterator[tuple]:
    """(read_id, flag, ref, pos, cigar, seq, score, line); of header lines only the line."""
    for at, x in lines:
        if 0 <= r.end <= at:
            return
        if not x:
            continue
        text = x.decode()
        if text[0] == "@":
            yield None, None, None, None, None, None, None, text
            continue
        p = text.split("\t")
        tag = p[14 if dialect == "long" else 13].rsplit(":", 1)[-1] if len(p) > (14 if dialect == "long" else 13) else None
        try:
            score = float(tag) if tag is not None else None
        except ValueError:
            score = None
        ref = p[2].split("|tax")[0] if dialect == "long" else p[2]
        yield p[0], int(p[1]), ref, int(p[3]), p[5], p[9], score, None


class _Source(DataSource):
    kind = ""

    def schema(self) -> str:
        return SAM if self.kind == "sam" else READS

    def _config(self) -> dict:
        if "path" not in self.options:
            raise ValueError(f"{self.name()} needs a path")
        return {"kind": self.kind, "path": self.options["path"], "split": int(self.options.get("splitBytes", SPLIT)), "dialect": self.options.get("dialect", "short")}

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._config())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self._config())


class ReadsSource(_Source):
    kind = "reads"

    @classmethod
    def name(cls) -> str:
        return "reads"


class SamSource(_Source):
    kind = "sam"

    @classmethod
    def name(cls) -> str:
        return "sam"


class _Reader(DataSourceReader):
    def __init__(self, config: dict):
        self.config = config

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.config["path"]), self.config["split"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        # Planning gave a folder without files one partition without a range.
        if partition is None:
            return
        system, _ = _system(self.config["path"])
        lines = _open(system, partition)
        sam = self.config["kind"] == "sam"
        rows = _alignments(lines, partition, self.config["dialect"]) if sam else _reads(lines, partition)
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()] if sam else [pa.string()] * 3
        names = [c.split()[0] for c in (SAM if sam else READS).split(", ")]
        held: list[tuple] = []
        nth = 0

        def batch() -> pa.RecordBatch:
            nonlocal nth, held
            n = len(held)
            columns = [pa.array([partition.path] * n), pa.array([partition.part] * n, pa.int32()), pa.array(range(nth, nth + n), pa.int64())]
            columns += [pa.array(c, t) for c, t in zip(zip(*held), types)]
            nth, held = nth + n, []
            return pa.RecordBatch.from_arrays(columns, names)

        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield batch()
        if held:
            yield batch()


class _StreamReader(DataSourceStreamReader):
    """Files by time and name; an offset is the last one taken."""

    def __init__(self, config: dict):
        self.config, self.reader = config, _Reader(config)

    def _known(self) -> list[tuple[str, pafs.FileInfo]]:
        return sorted(((f"{f.mtime_ns:020d} {f.path}", f) for f in _files(self.config["path"])), key=lambda x: x[0])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"last": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        known = self._known()
        return {"last": known[-1][0] if known else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges([f for k, f in self._known() if start["last"] < k <= end["last"]], self.config["split"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing is kept besides the offset


def register(spark: SparkSession) -> None:
    for source in (ReadsSource, SamSource):
        spark.dataSource.register(source)


def numbered(rows: DataFrame, name: str = "read_id") -> DataFrame:
    """Rows of a source with running numbers from 0, in the order of files and offsets."""
    sizes = rows.groupBy("part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("part", before.alias("_before")), "part").withColumn(name, F.col("_before") + F.col("nth")).drop("_before")
