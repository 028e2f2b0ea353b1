"""Token counts from flat, unindexed token files: a vectorised search for separators, and a prefix scan over blocks.

A token file is nothing but little-endian 16-bit (or 32-bit) identifiers; each document ends with the separator. Files are cut into
blocks of bytes that tasks read on their own. A block reports its separators' places; the scan over the blocks of a file passes on
the last separator before each block and the number of separators so far, which stitches documents over any number of blocks.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shared_dir

SEPARATOR = 50256
BLOCK_BYTES = 8 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def _encoding(name: str) -> tiktoken.Encoding:
    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _write(name: str, folder: str, separator: int, wide: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name)
        fs, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        # A retried or doubled task writes a file of its own and then gives it the part's name; its bytes are the same.
        scratch, final, n = f"{root}/.{part:06d}-{uuid.uuid4().hex}", f"{root}/{part:06d}.bin", 0
        end = np.array([separator], wide).tobytes()
        with fs.open_output_stream(scratch) as out:
            for batch in batches:
                ids = batch.column(0)
                texts = batch.column(1).to_pylist()
                for text in texts:
                    if text:
                        out.write(np.asarray(encoding.encode_ordinary(text), wide).tobytes())
                    out.write(end)
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(n, n + batch.num_rows), pa.int64()), ids], ["file", "document", "doc_id"])
                n += batch.num_rows
        fs.move(scratch, final) if n else fs.delete_file(scratch)

    return run


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, separator: int = SEPARATOR) -> tuple[str, DataFrame]:
    """Encodes texts into flat files, one for each task, in a folder that all executors share; the folder, and (file, document, doc_id).

    A null or empty text is a document without tokens. The vocabulary is a file of the driver with a rank on each line. Files are the
    only output with tokens: nothing in them tells where documents begin.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    write = _write(vocabulary.replace("\\", "/").rsplit("/", 1)[-1], folder, separator, "<u2" if separator < 65536 else "<u4")
    return folder, materialize(rows.mapInArrow(write, f"file int, document long, doc_id {dict(rows.dtypes)['doc_id']}"), "manifest")


def _find(folder: str, separator: int, wide: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        size = np.dtype(wide).itemsize
        for batch in batches:
            for path, file, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(path) as f:
                    tokens = np.frombuffer(f.read_at(block, at), wide)
                places = np.flatnonzero(tokens == separator) + at // size
                gaps = np.diff(places) - 1  # tokens of the documents that lie within the block
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([at // size]), pa.array([len(places)]), pa.array([int(places[0]) if len(places) else None], pa.int64()), pa.array([int(places[-1]) if len(places) else None], pa.int64()), pa.array([places[:-1] + 1], pa.list_(pa.int64())), pa.array([gaps], pa.list_(pa.int64()))], ["file", "at", "n", "first", "last", "starts", "inner"])

    return run


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, document, first_token, n_tokens) for each document of the folder's files NNNNNN.bin; documents are numbered by place.

    A separator at once after another ends a document without tokens; tokens after the last separator of a file are a document if
    there are any. Empty files and folders have no documents. Only the files' names and sizes pass through the driver.
    """
    wide = "<u2" if separator < 65536 else "<u4"
    fs, root = pafs.FileSystem.from_uri(folder)
    found = sorted((x for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(".bin") and not x.base_name.startswith(".") and x.size), key=lambda x: x.path)
    block -= block % np.dtype(wide).itemsize
    files = spark.createDataFrame([(x.path, int(x.base_name[:-4]), x.size) for x in found], "path string, file int, size long")
    cut = files.select("path", "file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("at"))
    # One block for each place: dealt evenly, since block sizes are even.
    blocks = cut.select("path", "file", "at").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "at")
    scanned = materialize(blocks.mapInArrow(_find(folder, separator, wide, block), "file int, at long, n long, first long, last long, starts array<long>, inner array<long>"), "blocks")
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    # The scan carries two numbers for each block, not its documents.
    carried = scanned.select("file", "at", "n", "first", "last", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("number"))
    heads = carried.filter("first is not null").select("file", F.col("number").alias("document"), (F.col("previous") + 1).alias("first_token"), (F.col("first") - F.col("previous") - 1).alias("n_tokens"))
    within = scanned.filter(F.size("inner") > 0).select("file", "at", "starts", "inner").join(carried.select("file", "at", "number"), ["file", "at"])
    within = within.select("file", "number", F.posexplode(F.arrays_zip("starts", "inner")).alias("i", "x"))
    inner = within.select("file", (F.col("number") + 1 + F.col("i")).alias("document"), F.col("x.starts").alias("first_token"), F.col("x.inner").alias("n_tokens"))
    tails = scanned.groupBy("file").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum("n").alias("document")).join(files.select("file", (F.col("size") / np.dtype(wide).itemsize).cast("long").alias("tokens")), "file")
    tails = tails.filter("tokens > last + 1").select("file", "document", (F.col("last") + 1).alias("first_token"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"))
    return heads.unionByName(inner).unionByName(tails)
