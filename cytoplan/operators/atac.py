"""Chromatin accessibility fragments: genome bins, coordinate order, duplicates with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN, LONGEST = 100_000, 2000
PROPER_PAIR = 4


def bins(reads: DataFrame) -> DataFrame:
    """chr, bin, n: reads with one alignment (refs, starts) by the bin of their start."""
    one = reads.filter(F.size("refs") == 1).select(F.col("refs")[0].alias("chr"), F.floor(F.col("starts")[0] / BIN).cast("long").alias("bin"))
    return one.groupBy("chr", "bin").agg(F.count("*").alias("n"))


def bin_offsets(refs: DataFrame) -> DataFrame:
    """chr, n_bins, first_bin of references (chr, len): their bins one after another."""
    n = refs.select("chr", F.ceil(F.col("len") / BIN).cast("long").alias("n_bins"))
    before = F.sum("n_bins").over(W.orderBy("chr").rowsBetween(W.unboundedPreceding, -1))  # a row for each reference
    return n.withColumn("first_bin", F.coalesce(before, F.lit(0)))


def fragments(reads: DataFrame, proper_pairs: bool = False) -> DataFrame:
    """chr, start, frag_len, bc, n: fragments of reads with one alignment, duplicates counted; too long ones go after counting.

    proper_pairs keeps only reads whose alignment has the type of a proper pair.
    """
    one = reads.filter(F.size("refs") == 1)
    if proper_pairs:
        one = one.filter(F.col("types")[0] == PROPER_PAIR)
    f = one.select(F.col("refs")[0].alias("chr"), F.col("starts")[0].alias("start"), F.col("frag_lens")[0].alias("frag_len"), "bc")
    return f.groupBy("chr", "start", "frag_len", "bc").agg(F.count("*").alias("n")).filter(F.col("frag_len") < LONGEST)


def dropped(reads: DataFrame) -> DataFrame:
    """One row: unmapped reads, reads of several alignments, and single ones that are no proper pair."""
    return reads.agg(F.count(F.when(F.size("refs") == 0, 1)).alias("n_unmapped"), F.count(F.when(F.size("refs") > 1, 1)).alias("n_multi"), F.count(F.when((F.size("refs") == 1) & (F.get("types", 0) != PROPER_PAIR), 1)).alias("n_not_paired"))


def ordered(frags: DataFrame) -> DataFrame:
    """By chromosome, start, length and barcode: a range sort."""
    return frags.orderBy("chr", "start", "frag_len", "bc")
