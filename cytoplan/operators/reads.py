"""Filters and projections of read records (bc, umi, refs, dirs; more columns pass through)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIENTATIONS = ("fw", "rc", "both", "either")
#: Alignment flags of the SAM format: unmapped, reverse strand, supplementary.
UNMAPPED, REVERSE, SUPPLEMENTARY = 4, 16, 2048


def on_strand(dirs: Column, orientation: str) -> Column:
    """Whether a read has an alignment on the expected strand."""
    if orientation not in ORIENTATIONS:
        raise ValueError(f"no orientation {orientation!r}")
    if orientation in ("both", "either"):
        return F.lit(True)
    return F.exists(dirs, lambda d: d) if orientation == "fw" else F.exists(dirs, lambda d: ~d)


def oriented(reads: DataFrame, orientation: str) -> DataFrame:
    """Reads with an alignment on the expected strand."""
    return reads.filter(on_strand(F.col("dirs"), orientation))


def prune_alignments(reads: DataFrame, orientation: str) -> DataFrame:
    """Reads with only their alignments on the expected strand; reads without one go."""
    if orientation in ("both", "either"):
        return reads.filter(F.size("refs") > 0)
    want = orientation == "fw"
    kept = F.filter(F.arrays_zip("refs", "dirs"), lambda x: x["dirs"] == F.lit(want))
    return reads.withColumn("__kept", kept).withColumn("refs", F.col("__kept.refs")).withColumn("dirs", F.col("__kept.dirs")).drop("__kept").filter(F.size("refs") > 0)


def uniquely_mapped(reads: DataFrame) -> DataFrame:
    """Reads with exactly one alignment."""
    return reads.filter(F.size("refs") == 1)


def genes_of(reads: DataFrame, t2g: DataFrame, key: list[str]) -> DataFrame:
    """key, label: each read's sorted distinct genes. t2g (tid, gid) joins by transcript; `key` identifies a read."""
    one = reads.select(*key, F.explode("refs").alias("tid"))
    return one.join(t2g, "tid").groupBy(*key).agg(F.array_sort(F.collect_set("gid")).alias("label"))


def view(reads: DataFrame, names: DataFrame, bc_length: int, umi_length: int) -> DataFrame:
    """One row per alignment: id, hi (from 1), nh, cb, umi, dir, name."""
    from ..functions.dna import unpack

    one = reads.select("id", F.size("refs").alias("nh"), unpack(F.col("bc"), bc_length).alias("cb"), unpack(F.col("umi"), umi_length).alias("umi"), F.posexplode(F.arrays_zip("refs", "dirs")).alias("i", "x"))
    one = one.select("id", (F.col("i") + 1).alias("hi"), "nh", "cb", "umi", F.when(F.col("x.dirs"), "fw").otherwise("rc").alias("dir"), F.col("x.refs").alias("tid"))
    return one.join(names, "tid").drop("tid")


def convert(alignments: DataFrame, filter_best: bool = False) -> DataFrame:
    """Alignments (qname, flag, tid, score, cb, ub) grouped into reads (qname, bc, umi, refs, dirs).

    Unmapped and supplementary alignments go, secondary ones stay; with filter_best only those of a read's best score stay. The
    first N of a barcode or UMI counts as A; a read with another N goes.
    """
    from ..functions.dna import pack

    fixed = lambda c: F.when(F.instr(c, "N") > 0, F.concat(F.substring_index(c, "N", 1), F.lit("A"), F.expr(f"substring({c}, instr({c}, 'N') + 1)"))).otherwise(F.col(c))
    a = alignments.filter((F.col("flag").bitwiseAND(UNMAPPED) == 0) & (F.col("flag").bitwiseAND(SUPPLEMENTARY) == 0))
    a = a.withColumn("cb", fixed("cb")).withColumn("ub", fixed("ub")).filter(~F.col("cb").contains("N") & ~F.col("ub").contains("N"))
    x = F.struct("tid", (F.col("flag").bitwiseAND(REVERSE) == 0).alias("fw"), "score")
    reads = a.groupBy("qname").agg(F.min("cb").alias("cb"), F.min("ub").alias("ub"), F.sort_array(F.collect_list(x)).alias("x"), F.max("score").alias("best"))
    if filter_best:
        reads = reads.withColumn("x", F.filter("x", lambda y: y["score"] >= F.col("best")))
    return reads.select("qname", pack(F.col("cb")).alias("bc"), pack(F.col("ub")).alias("umi"), F.col("x.tid").alias("refs"), F.col("x.fw").alias("dirs"))
