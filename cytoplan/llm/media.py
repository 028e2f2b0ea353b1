"""Media columns: lossless 8-bit images as PNG in binary columns, read back through checked chunks, and their cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_chunks

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type, for 8-bit samples.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Side of the picture that is transformed, and of the low-frequency corner that makes the hash.
SIDE, CORNER = 32, 8
LEVEL = 1


class BadImage(ValueError):
    """The bytes are not an image that this reader takes, or they are damaged."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _near_zero(x: np.ndarray) -> np.ndarray:
    """The usual measure of a filtered line: its bytes as signed numbers, summed without their signs."""
    return np.minimum(x, (256 - x.astype(np.int16)).astype(np.int16)).sum(1, dtype=np.int64)


def encode(samples: np.ndarray) -> bytes:
    """A PNG of a (height, width) or (height, width, 2 to 4) array of bytes; each line takes the filter none, left or up that suits it best."""
    h, w = samples.shape[:2]
    step = samples.shape[2] if samples.ndim == 3 else 1
    raw = np.ascontiguousarray(samples, np.uint8).reshape(h, w * step)
    left, up = raw.copy(), raw.copy()
    left[:, step:] -= raw[:, :-step]
    up[1:] -= raw[:-1]
    kind = np.argmin(np.stack([_near_zero(x) for x in (raw, left, up)]), axis=0)
    lines = np.empty((h, w * step + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.choose(kind[:, None], (raw, left, up))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 2: 4, 4: 6}[step], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def chunks(raw: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """The chunks up to the end chunk; a wrong signature, length or checksum raises BadImage."""
    if raw[:8] != SIGNATURE:
        raise BadImage("no signature")
    view, at = memoryview(raw), 8
    while at + 12 <= len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        if at + 12 + n > len(raw):
            raise BadImage("a chunk is cut off")
        if zlib.crc32(view[at + 4 : at + 8 + n]) != struct.unpack_from(">I", raw, at + 8 + n)[0]:
            raise BadImage("a checksum is wrong")
        kind = bytes(view[at + 4 : at + 8])
        yield kind, view[at + 8 : at + 8 + n]
        if kind == b"IEND":
            return
        at += 12 + n
    raise BadImage("no end chunk")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the line filters of (height, 1 + bytes) lines; `step` bytes a pixel.

    None, left and up are whole-array sums; consecutive lines of one of those kinds are done together. Average and Paeth depend on
    the pixel before, so they go pixel by pixel along a line.
    """
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("an unknown filter")
    width = out.shape[1] // step
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi or kinds[lo] == 0:
            continue
        block = out[lo:hi]
        if kinds[lo] == 1:
            block[:] = np.cumsum(block.reshape(hi - lo, width, step), axis=1, dtype=np.uint8).reshape(hi - lo, -1)
        elif kinds[lo] == 2:
            if lo:
                block[0] += out[lo - 1]
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        else:
            for row in range(lo, hi):
                over = (out[row - 1] if row else np.zeros(out.shape[1], np.uint8)).reshape(width, step).astype(np.int16)
                line = out[row].reshape(width, step)
                before, corner = np.zeros(step, np.int16), np.zeros(step, np.int16)
                for x in range(width):
                    if kinds[row] == 3:
                        guess = (before + over[x]) >> 1
                    else:
                        p = before + over[x] - corner
                        a, b, c = abs(p - before), abs(p - over[x]), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), before, np.where(b <= c, over[x], corner))
                    corner = over[x]
                    before = (line[x] + guess) & 255
                    line[x] = before
    return out


def decode(raw: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without palette and interlacing, (height, width) or (height, width, samples)."""
    head, body = None, []
    for kind, part in chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind[0] & 32 == 0 and kind not in (b"IEND", b"PLTE"):
            raise BadImage("an unknown critical chunk")
    if head is None or not body or head[2] != 8 or head[3] not in SAMPLES or head[4:] != (0, 0, 0):
        raise BadImage("not an 8-bit image without palette and interlacing")
    w, h, step = head[0], head[1], SAMPLES[head[3]]
    try:
        flat = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise BadImage(str(e)) from None
    if len(flat) != h * (w * step + 1):
        raise BadImage("the number of samples is wrong")
    out = unfilter(np.frombuffer(flat, np.uint8).reshape(h, w * step + 1), step)
    return out.reshape(h, w) if step == 1 else out.reshape(h, w, step)


_COS = np.cos(np.pi * (np.arange(SIDE)[None, :] + 0.5) * np.arange(CORNER)[:, None] / SIDE)


def cosine_hash(gray: np.ndarray) -> str:
    """64 bits as hex: which of the low-frequency cosine coefficients of the picture, shrunk to SIDE x SIDE means, exceed their median."""
    for axis in (0, 1):
        n = gray.shape[axis]
        edges = np.minimum(np.arange(SIDE) * n // SIDE, n - 1)
        size = np.maximum(np.diff(np.append(edges, n)), 1)
        if n >= SIDE:
            gray = np.add.reduceat(gray.astype(np.float64), edges, axis=axis) / size.reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            gray = np.take(gray.astype(np.float64), edges, axis=axis)
    low = (_COS @ gray @ _COS.T).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes) -> np.ndarray:
    """The text's bytes, filled with bytes 255 to a positive multiple of WIDTH, as lines of WIDTH gray samples."""
    size = max(1, -(-len(text) // WIDTH)) * WIDTH
    return np.frombuffer(text.ljust(size, b"\xff"), np.uint8).reshape(-1, WIDTH)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch):
            raw, at = data.tobytes(), offs.tolist()
            media = [encode(payload(raw[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, hashes = [], []
        for raw in batch.column(2).to_pylist():
            picture = decode(raw)
            payloads.append(picture.tobytes())
            hashes.append(cosine_hash(picture if picture.ndim == 2 else picture.mean(2)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(hashes, pa.string())], [*batch.schema.names, "payload", "feature"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a PNG of the text's bytes, for each row of docs (doc_id, text).

    A null text is empty; an empty text is one line of filling. Equal texts give equal images, in every row; other columns are
    ignored; an empty table gives an empty result.
    """
    bounded_batches(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_store, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """media (doc_id, n_bytes, media) with payload, the samples read back, and feature. A damaged image raises BadImage in its task."""
    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, f"doc_id {kind}, n_bytes long, media binary, payload binary, feature string")
