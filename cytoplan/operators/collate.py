"""Reads grouped by corrected cell. Collation is a join with the plan; the grouping itself is left to the aggregation that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collate(reads: DataFrame, accepted: DataFrame) -> DataFrame:
    """Reads with cell, their corrected barcode (a column of that name is replaced); reads without one go. accepted: (observed, corrected)."""
    return reads.drop("cell").join(accepted.select(F.col("observed").alias("bc"), F.col("corrected").alias("cell")), "bc")


def collate_samples(reads: DataFrame, samples: DataFrame, accepted: DataFrame) -> DataFrame:
    """Reads with canonical sample and cell: samples (sample, canonical), accepted (canonical, observed, corrected)."""
    routed = reads.drop("cell").join(samples, "sample")
    return routed.join(accepted.select("canonical", F.col("observed").alias("bc"), F.col("corrected").alias("cell")), ["canonical", "bc"])


def unmapped(counts: DataFrame, accepted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, cell, n: unmapped reads (bc, n) added up by corrected cell, within `by`."""
    plan = accepted.select(*by, F.col("observed").alias("bc"), F.col("corrected").alias("cell"))
    return counts.join(plan, [*by, "bc"]).groupBy(*by, "cell").agg(F.sum("n").alias("n"))


def manifest(collated: DataFrame) -> DataFrame:
    """canonical, n_cells, n_records, first_cell: each sample's cells and records, and the cells of the samples before it."""
    per = collated.groupBy("canonical", "cell").agg(F.count("*").alias("n")).groupBy("canonical").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_records"))
    before = F.sum("n_cells").over(W.orderBy("canonical").rowsBetween(W.unboundedPreceding, -1))  # a row for each sample
    return per.withColumn("first_cell", F.coalesce(before, F.lit(0)))


def only_cells(rows: DataFrame, cells: DataFrame, column: str = "cell") -> DataFrame:
    """The rows of listed cells; cells that are listed and absent have none."""
    return rows.join(cells.select(F.col(cells.columns[0]).alias(column)).distinct(), column, "left_semi")
