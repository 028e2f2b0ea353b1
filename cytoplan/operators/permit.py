"""Barcode histograms and the choice of retained barcodes (real cells)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(reads: DataFrame, by: tuple[str, ...] = ("bc",)) -> DataFrame:
    """by, n: reads for each barcode (or sample and barcode)."""
    return reads.groupBy(*by).agg(F.count("*").alias("n"))


def summary(reads: DataFrame) -> DataFrame:
    """One row: reads and the most alignments of a read."""
    return reads.agg(F.count("*").alias("n_reads"), F.max(F.size("refs")).alias("max_ambiguity"))


def min_reads(hist: DataFrame, least: int = 10, whitelist: DataFrame | None = None) -> DataFrame:
    """Barcodes of at least `least` reads, of a whitelist (bc) if there is one."""
    if least < 1:
        raise ValueError("min-reads is at least 1")
    kept = hist.filter(F.col("n") >= least)
    return kept if whitelist is None else kept.join(whitelist.select("bc").distinct(), "bc", "left_semi")


def explicit(hist: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed barcodes, unread ones with n = 0."""
    return listed.select("bc").distinct().join(hist, "bc", "left").select("bc", F.coalesce("n", F.lit(0)).alias("n"))


def _at_rank(hist: DataFrame, rank: int, by: tuple[str, ...]) -> DataFrame:
    """by, threshold: the count at a rank (from 1) of the descending counts, or the last one.

    Counts are summed by value first, so that the running sum orders distinct counts (a few thousand) and not barcodes.
    """
    values = hist.groupBy(*by, "n").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy(*(by or (F.lit(0),))).orderBy(F.col("n").desc()))
    ranked = values.withColumn("upto", upto)
    reach = F.max(F.when(F.col("upto") >= rank, F.col("n")))
    found = ranked.groupBy(*by).agg(F.coalesce(reach, F.min("n")).alias("threshold"))
    return found


def _at_least(hist: DataFrame, thresholds: DataFrame, by: tuple[str, ...]) -> DataFrame:
    if not by:
        return hist.filter(F.col("n") >= thresholds.select("threshold").scalar())
    return hist.join(thresholds, list(by)).filter(F.col("n") >= F.col("threshold")).drop("threshold")


def force_cells(hist: DataFrame, cells: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The `cells` most frequent barcodes (of each group `by`) and all that tie with the last of them; none for 0."""
    return hist.limit(0) if cells <= 0 else _at_least(hist, _at_rank(hist, cells, by), by)


def expect_cells(hist: DataFrame, cells: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Barcodes with at least a tenth (rounded, at least 1) of the count at the 99th percentile of the expected cells."""
    at = _at_rank(hist, int(np.floor(0.99 * cells + 0.5)) + 1, by)
    tenth = F.floor(F.col("threshold") / 10 + 0.5).cast("long")
    return _at_least(hist, at.withColumn("threshold", F.greatest(tenth, F.lit(1))), by)


def knee_index(counts: np.ndarray, most_rounds: int = 100, slack: int = 5) -> int:
    """The index of the knee of descending counts: the point of the running sum furthest from the line between its ends.

    The search repeats on `slack` times the last index until the index stays. Of equal distances the last counts.
    """
    total = np.cumsum(np.asarray(counts, np.int64)).astype(float)

    def furthest(c: np.ndarray) -> int:
        if len(c) < 2:
            raise ValueError("too few barcodes to find a knee")
        x, y = np.arange(len(c)) / len(c), c / c[-1]
        slope = y[-1] - y[0]
        d = np.abs(slope * x - y + y[0]) / np.sqrt(slope * slope + 1)
        at = len(d) - 1 - int(np.argmax(d[::-1]))
        if at == 0:
            raise ValueError("the knee is at the first barcode")
        return at

    at, before = furthest(total), 0
    for _ in range(most_rounds):
        if at == before:
            break
        before, at = at, furthest(total[: min(len(total) - 1, at * slack)])
    return at


def knee(hist: DataFrame) -> DataFrame:
    """Barcodes with at least the count at the knee.

    Only the distinct counts and how often each occurs come to the driver: as many as there are different counts, not barcodes.
    """
    values = hist.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).toPandas()
    if values.empty:
        return hist
    counts = np.repeat(values["n"].to_numpy(), values["k"].to_numpy())
    return hist.filter(F.col("n") >= int(counts[min(knee_index(counts), len(counts) - 1)]))


def unmatched_fraction(hist: DataFrame, whitelist: DataFrame, warn: float = 0.3) -> DataFrame:
    """One row: reads, reads of barcodes off the whitelist, their share and whether it is a warning."""
    flag = hist.join(whitelist.select("bc", F.lit(1).alias("__on")).distinct(), "bc", "left")
    out = flag.agg(F.sum("n").alias("n_reads"), F.coalesce(F.sum(F.when(F.col("__on").isNull(), F.col("n"))), F.lit(0)).alias("n_unmatched"))
    out = out.withColumn("fraction", F.col("n_unmatched") / F.col("n_reads"))
    return out.withColumn("warns", F.col("fraction") >= warn)
