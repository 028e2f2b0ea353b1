"""Shared parts of the training-data operators: shared storage, and vectorised text primitives on Arrow buffers.

Texts are handled as one byte buffer with offsets for a chunk of rows, so work per word costs numpy passes and no Python objects.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Most bytes of text that are handled at once (a longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(0x5EED)
_LETTERS = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own is set only in a local session that has none. A cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='cytoplan-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, rows: int = 1000) -> None:
    """Lowers the session's rows per Arrow batch: a batch of whole texts is held by the JVM and by Python at once."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its other columns renamed out of the way of an operator's own, and what gives names and order back."""
    names = {c: f"__aside{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(names), lambda out: out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mod3(df: DataFrame) -> DataFrame:
    """Adds held_out: the remainder of crc32(doc_id as text) by 3 is 1 (false for a null doc_id)."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): row i's text is bytes[offsets[i]:offsets[i + 1]]; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return
    _, offs, buf = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def power_table(kind: str, n: int) -> np.ndarray:
    """Powers of the rolling base ('up') or of its inverse modulo 2**64 ('down'), at least n of them."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, _BASE if kind == "up" else _INVERSE, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > 8 * CHUNK_BYTES:
            return have
        _powers[kind] = have
    return have[:n]


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (with one end more)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(WHITE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offs[:-1]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    cut = offs[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum; fold: A-Z as a-z."""
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if fold else _LETTERS)[data] * power_table("up", len(data)), out=total[1:])
    return mix((total[end] - total[start]) * power_table("down", len(data))[start] + (end - start).astype(U64))


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words has its whole sequence as one, a row without words none."""
    run = np.zeros(0, U64)
    if len(words) >= width:
        run = np.zeros(len(words) - width + 1, U64)
        for j in range(width):
            run += words[j : len(run) + j] * U64((0xD6E8FEB86659FD93 * (2 * j + 3)) % 2**64 | 1)
        run = mix(run)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            one = np.sort(run[lo : hi - width + 1])
            out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        elif hi > lo:
            h = U64(hi - lo)
            for w in words[lo:hi]:
                h = mix(np.array([h], U64) * U64(0xA0761D6478BD642F) + w)[0]
            out.append(np.array([h], U64))
        else:
            out.append(np.zeros(0, U64))
    return out
