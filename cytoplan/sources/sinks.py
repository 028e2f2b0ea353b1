"""Text outputs: count matrices, row and column names, fragments, metrics, classes and metadata. Paths are folders of part files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_lines(counts: DataFrame, rows: int, cols: int, kind: str = "real") -> DataFrame:
    """value: the lines of a coordinate matrix of counts (row, col, n), header first, entries by row and column, counted from 1."""
    spark = counts.sparkSession
    body = counts.select("row", "col", F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("n").cast("double" if kind == "real" else "long").cast("string")).alias("value"))
    size = counts.agg(F.count("*").alias("k")).select(F.lit(-1).cast("long").alias("row"), F.lit(1).cast("long").alias("col"), F.concat(F.lit(f"{rows} {cols} "), F.col("k").cast("string")).alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(f"%%MatrixMarket matrix coordinate {kind} general").alias("value"))
    return body.unionByName(size).unionByName(head).orderBy("row", "col").select("value")


def write_matrix(counts: DataFrame, path: str, rows: int, cols: int, kind: str = "real") -> None:
    matrix_lines(counts, rows, cols, kind).write.mode("overwrite").text(path)


def bed_lines(frags: DataFrame, names: DataFrame, length: int, reverse: bool = False) -> DataFrame:
    """value: chr, start, end, barcode and count, separated by tabs, in coordinate order. names: (chr, name)."""
    from ..functions.dna import reverse_complement, unpack

    dna = unpack(F.col("bc"), length)
    line = F.concat_ws("\t", "name", F.col("start").cast("string"), (F.col("start") + F.col("frag_len")).cast("string"), reverse_complement(dna) if reverse else dna, F.col("n").cast("string"))
    return frags.join(names, "chr").orderBy("chr", "start", "frag_len", "bc").select(line.alias("value"))


def write_bed(frags: DataFrame, names: DataFrame, length: int, path: str, compress: bool = False, reverse: bool = False) -> None:
    """Part files in coordinate order; their concatenation is the sorted file, also of gzip members."""
    bed_lines(frags, names, length, reverse).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_names(names: DataFrame, path: str) -> None:
    """One name per line, by index: names (i, name)."""
    names.orderBy("i").select(F.col("name").cast("string").alias("value")).write.mode("overwrite").text(path)


def column_names(genes: list[str], spliced: bool = False) -> list[str]:
    """The matrix's columns; in spliced mode spliced, unspliced and ambiguous ones."""
    return genes + [f"{g}-{s}" for s in "UA" for g in genes] if spliced else list(genes)


def write_features(features: DataFrame, length: int, path: str) -> None:
    """The metrics as tab-separated text with a header."""
    from ..functions.dna import unpack

    out = features.select(unpack(F.col("cell"), length).alias("CB"), *(F.col(a).alias(b) for a, b in FEATURES))
    out.write.mode("overwrite").csv(path, sep="\t", header=True)


#: Column names of the metrics file.
FEATURES = (
    ("corrected_reads", "CorrectedReads"),
    ("mapped_reads", "MappedReads"),
    ("deduplicated_reads", "DeduplicatedReads"),
    ("mapping_rate", "MappingRate"),
    ("dedup_rate", "DedupRate"),
    ("mean_by_max", "MeanByMax"),
    ("num_genes_expressed", "NumGenesExpressed"),
    ("num_genes_over_mean", "NumGenesOverMean"),
)


def class_lines(labels: DataFrame, genes: int) -> DataFrame:
    """value: the lines of a label file of (eqid, label)."""
    body = labels.select("eqid", F.concat(F.array_join(F.transform("label", lambda g: g.cast("string")), "\t"), F.lit("\t"), F.col("eqid").cast("string")).alias("value"))
    spark = labels.sparkSession
    head = spark.range(1).select(F.lit(-2).cast("long").alias("eqid"), F.lit(str(genes)).alias("value"))
    size = labels.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).cast("long").alias("eqid"), "value")
    return body.unionByName(head).unionByName(size).orderBy("eqid").select("value")


def write_metadata(spark, values: dict, path: str) -> None:  # noqa: ANN001
    """A one-row JSON file."""
    spark.range(1).select(F.lit(json.dumps(values, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
