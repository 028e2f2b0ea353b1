"""Reduced-alignment (RAD) files: a binary layout of header, tag sections and chunks, as a batch data source and a writer.

Layout, all little-endian. Header: paired (u8), number of references (u64), their names (u16 length and bytes), number of chunks (u64).
Three tag sections (file, read, alignment): number of tags (u16), then name and type (u8) of each; an array type is followed by the
types of its length and elements. Then the values of the file tags. A chunk is its size in bytes (u32, these eight included), its
number of records (u32) and the records: number of alignments (u32), the read tags, then the alignment tags of each alignment.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Type numbers: fixed values of the format.
BOOL, U8, U16, U32, U64, F32, F64, ARRAY, STRING = range(9)
_CODES = {BOOL: "<B", U8: "<B", U16: "<H", U32: "<I", U64: "<Q", F32: "<f", F64: "<d"}
FORWARD = 1 << 31

SCHEMA = "bc long, umi long, sample long, refs array<long>, dirs array<boolean>, pos array<long>, scores array<long>, starts array<long>, ends array<long>, types array<long>, start_pos array<long>, frag_lens array<long>"
#: The column of each alignment tag; of read tags, by their place among the barcodes.
ALIGNMENT_COLUMNS = {"pos": "pos", "as": "scores", "start": "starts", "end": "ends", "type": "types", "start_pos": "start_pos", "frag_len": "frag_lens"}


@dataclass
class Prelude:
    """What stands before the first chunk."""

    paired: bool
    references: list[str]
    chunks: int
    file_tags: list[tuple[str, tuple[int, ...]]]
    read_tags: list[tuple[str, tuple[int, ...]]]
    alignment_tags: list[tuple[str, tuple[int, ...]]]
    values: dict[str, object] = field(default_factory=dict)

    def kind(self) -> str:
        """The kind of records, told by the tags: several barcodes, long reads, positions, fragments, or plain ones."""
        names = {n for n, _ in self.alignment_tags}
        if int(self.values.get("num_barcodes", 1)) > 1:
            return "multi-barcode"
        if {"as", "start", "end"} <= names:
            return "long-read"
        if "pos" in names:
            return "positions"
        return "fragments" if {"type", "start_pos", "frag_len"} <= names else "plain"


def _take(f: BinaryIO, code: str) -> int | float:
    size = struct.calcsize(code)
    raw = f.read(size)
    if len(raw) < size:
        raise ValueError("the file is cut off")
    return struct.unpack(code, raw)[0]


def _value(f: BinaryIO, kind: tuple[int, ...]) -> object:
    if kind[0] == STRING:
        return f.read(_take(f, "<H")).decode()
    if kind[0] == ARRAY:
        return [_value(f, (kind[2],)) for _ in range(_take(f, _CODES[kind[1]]))]
    if kind[0] not in _CODES:
        raise ValueError(f"no type {kind[0]}")
    return _take(f, _CODES[kind[0]])


def _section(f: BinaryIO) -> list[tuple[str, tuple[int, ...]]]:
    out = []
    for _ in range(_take(f, "<H")):
        name = f.read(_take(f, "<H")).decode()
        kind = _take(f, "<B")
        out.append((name, (kind, _take(f, "<B"), _take(f, "<B")) if kind == ARRAY else (kind,)))
    return out


def read_prelude(f: BinaryIO) -> Prelude:
    """Reads up to the first chunk; barcode and UMI tags must be integers."""
    paired = bool(_take(f, "<B"))
    names = [f.read(_take(f, "<H")).decode() for _ in range(_take(f, "<Q"))]
    p = Prelude(paired, names, _take(f, "<Q"), _section(f), _section(f), _section(f))
    p.values = {n: _value(f, k) for n, k in p.file_tags}
    if any(k[0] not in (U8, U16, U32, U64) for n, k in p.read_tags if n[:1] in "bu"):
        raise ValueError("barcodes and identifiers are integers")
    return p


def _records(raw: bytes, count: int, p: Prelude) -> Iterator[tuple]:
    read = struct.Struct("<I" + "".join(_CODES[k[0]][1] for _, k in p.read_tags))
    each = struct.Struct("<" + "".join(_CODES[k[0]][1] for _, k in p.alignment_tags))
    names = [n for n, _ in p.read_tags]
    barcodes = [i for i, n in enumerate(names) if n[:1] == "b"]
    umi = next((i for i, n in enumerate(names) if n[:1] == "u"), None)
    columns = list(ALIGNMENT_COLUMNS.values())
    at = 0
    for _ in range(count):
        n, *tags = read.unpack_from(raw, at)
        at += read.size
        rows = [each.unpack_from(raw, at + i * each.size) for i in range(n)]
        at += n * each.size
        cols: dict[str, list[int]] = {}
        refs, dirs = [], None
        for j, (name, _) in enumerate(p.alignment_tags):
            values = [r[j] for r in rows]
            if name == "compressed_ori_refid":
                refs, dirs = [v & ~FORWARD for v in values], [bool(v & FORWARD) for v in values]
            elif name in ("ref", "refid"):
                refs = values
            elif name in ALIGNMENT_COLUMNS:
                cols[ALIGNMENT_COLUMNS[name]] = values
        yield (tags[barcodes[-1]], tags[umi] if umi is not None else None, tags[barcodes[0]] if len(barcodes) > 1 else None, refs, dirs, *(cols.get(c) for c in columns))


class _Span(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("chunksPerTask", 64))

    def _open(self, path: str):
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        return fs.open_input_file(at)

    def partitions(self) -> list[_Span]:
        """Runs of chunks. Only the eight bytes before each chunk are read to find the next."""
        out = []
        with self._open(self.path) as f:
            read_prelude(f)
            at, size, first, n = f.tell(), f.size(), f.tell(), 0
            while at + 8 <= size:
                f.seek(at)
                at += max(8, _take(f, "<I"))
                n += 1
                if n == self.per_task:
                    out.append(_Span(self.path, first, n))
                    first, n = at, 0
            if n:
                out.append(_Span(self.path, first, n))
        return out or [_Span(self.path, 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        with self._open(partition.path) as f:
            p = read_prelude(f)
            if partition.count:
                f.seek(partition.first)
            for _ in range(partition.count):
                size, count = _take(f, "<I"), _take(f, "<I")
                yield from _records(f.read(size - 8), count, p)


class RadSource(DataSource):
    """spark.read.format("rad").load(path); option chunksPerTask."""

    @classmethod
    def name(cls) -> str:
        return "rad"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def read(spark: SparkSession, path: str, chunks_per_task: int = 64) -> DataFrame:
    """The records of a file, chunks read in parallel; columns that its kind of record lacks are null."""
    spark.dataSource.register(RadSource)
    return spark.read.format("rad").option("chunksPerTask", chunks_per_task).load(path)


def write_plain(f: BinaryIO, references: list[str], chunks: list[list[tuple[int, int, list[int], list[bool]]]], bc_length: int, umi_length: int) -> None:
    """Writes plain records (bc, umi, refs, dirs) by chunk; integers as wide as the lengths need."""
    wide = lambda n: next(k for k, most in ((U8, 4), (U16, 8), (U32, 16), (U64, 32)) if n <= most)
    text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
    section = lambda tags: struct.pack("<H", len(tags)) + b"".join(text(n) + bytes([k]) for n, k in tags)
    f.write(struct.pack("<BQ", 0, len(references)) + b"".join(map(text, references)) + struct.pack("<Q", len(chunks)))
    f.write(section([("cblen", U16), ("ulen", U16)]) + section([("b", wide(bc_length)), ("u", wide(umi_length))]) + section([("compressed_ori_refid", U32)]))
    f.write(struct.pack("<HH", bc_length, umi_length))
    head = "<I" + _CODES[wide(bc_length)][1] + _CODES[wide(umi_length)][1]
    for rows in chunks:
        body = b"".join(struct.pack(head, len(refs), bc, umi) + b"".join(struct.pack("<I", r | (FORWARD if d else 0)) for r, d in zip(refs, dirs, strict=True)) for bc, umi, refs, dirs in rows)
        f.write(struct.pack("<II", len(body) + 8, len(rows)) + body)
