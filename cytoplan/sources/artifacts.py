"""Tables that one stage leaves for the next: histograms, correction plans, unmapped counts, manifests, with a version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layout's version, and the columns and unique key of each kind of table.
VERSION = 1
KINDS = {
    "histogram": ("bc long, n long", ("bc",)),
    "sample_histogram": ("sample long, bc long, n long", ("sample", "bc")),
    "plan": ("observed long, corrected long", ("observed",)),
    "sample_plan": ("canonical long, observed long, corrected long", ("canonical", "observed")),
    "unmapped": ("cell long, n long", ("cell",)),
    "manifest": ("canonical long, n_cells long, n_records long, first_cell long", ("canonical",)),
}


def _columns(kind: str) -> list[str]:
    return [c.split()[0] for c in KINDS[kind][0].split(", ")]


def write(rows: DataFrame, kind: str, folder: str, **metadata: object) -> None:
    """Writes a table sorted within its files by its key, and a row of metadata beside it. A write that fails leaves no table."""
    rows.select(*_columns(kind)).sortWithinPartitions(*KINDS[kind][1]).write.mode("overwrite").parquet(f"{folder}/{kind}")
    text = json.dumps({"version": VERSION, "kind": kind} | metadata, sort_keys=True)
    rows.sparkSession.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{kind}.json")


def metadata(spark: SparkSession, kind: str, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{kind}.json").first()[0])


def read(spark: SparkSession, kind: str, folder: str, check: bool = True) -> DataFrame:
    """Reads a table. A later version, a null or a key that occurs twice raises ValueError; check=False skips the look at the rows."""
    if int(metadata(spark, kind, folder)["version"]) > VERSION:
        raise ValueError("the table is of a later version")
    rows = spark.read.schema(KINDS[kind][0]).parquet(f"{folder}/{kind}")
    if check:
        key = list(KINDS[kind][1])
        if not rows.groupBy(*key).count().filter("count > 1").isEmpty() or not rows.filter(" or ".join(f"{c} is null" for c in _columns(kind))).isEmpty():
            raise ValueError(f"the {kind} has nulls or a key twice")
    return rows
