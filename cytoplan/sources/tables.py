"""Read tables projected from the order tables: the same expressions as columns and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


#: SQL of reads(): sample (2 bases), bc (6), cell (4), umi, fw, refs (transcripts, sorted, distinct).
READS_SQL = """reads AS (SELECT l_suppkey % 16 AS sample, l_orderkey % 4096 AS bc, l_orderkey % 256 AS cell, l_quantity::BIGINT + 64 * (l_orderkey % 4) AS umi,
  l_returnflag <> 'R' AS fw, list_sort(list_distinct(CASE WHEN l_linestatus = 'F' THEN [l_partkey % 200, (l_partkey + l_linenumber) % 200] ELSE [l_partkey % 200] END)) AS refs FROM lineitem)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.when(F.col("l_linestatus") == "F", F.array(F.col("l_partkey") % 200, (F.col("l_partkey") + F.col("l_linenumber")) % 200)).otherwise(F.array(F.col("l_partkey") % 200))
    out = _lineitem(spark, sf_dir).select(
        (F.col("l_suppkey") % 16).alias("sample"),
        (F.col("l_orderkey") % 4096).alias("bc"),
        (F.col("l_orderkey") % 256).alias("cell"),
        (F.col("l_quantity").cast("bigint") + 64 * (F.col("l_orderkey") % 4)).alias("umi"),
        (F.col("l_returnflag") != "R").alias("fw"),
        F.array_sort(F.array_distinct(refs)).alias("refs"),
    )
    return out.withColumn("dirs", F.transform("refs", lambda r: F.col("fw")))


#: SQL of graph_reads(): cell (5 bases), umi (4), label of 16 references.
GRAPH_SQL = """greads AS (SELECT l_orderkey % 1024 AS cell, (l_partkey % 128) + 128 * (l_linenumber % 2) AS umi,
  list_sort(list_distinct(CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN [l_partkey % 16, (l_partkey + l_linenumber) % 16] ELSE [l_partkey % 16] END)) AS label FROM lineitem)"""


def graph_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0)
    label = F.when(two, F.array(F.col("l_partkey") % 16, (F.col("l_partkey") + F.col("l_linenumber")) % 16)).otherwise(F.array(F.col("l_partkey") % 16))
    return _lineitem(spark, sf_dir).select((F.col("l_orderkey") % 1024).alias("cell"), ((F.col("l_partkey") % 128) + 128 * (F.col("l_linenumber") % 2)).cast("long").alias("umi"), F.array_sort(F.array_distinct(label)).alias("label"))


#: SQL of atac_reads(): chr, start, frag_len, bc, and refs of none, one or two alignments.
ATAC_SQL = """areads AS (SELECT l_orderkey % 16 AS bc, l_suppkey % 25 AS chr, (l_quantity * 1000)::BIGINT AS start, (l_quantity * 41)::BIGINT AS frag_len,
  CASE WHEN l_linenumber = 7 THEN 0 WHEN l_linenumber = 6 THEN 2 ELSE 1 END AS na, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 4 END AS type FROM lineitem)"""


def atac_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    na = F.when(F.col("l_linenumber") == 7, 0).when(F.col("l_linenumber") == 6, 2).otherwise(1)
    times = lambda c: F.array_repeat(c, na)
    return li.select(
        (F.col("l_orderkey") % 16).alias("bc"),
        times(F.col("l_suppkey") % 25).alias("refs"),
        times((F.col("l_quantity") * 1000).cast("long")).alias("starts"),
        times((F.col("l_quantity") * 41).cast("long")).alias("frag_lens"),
        times(F.when(F.col("l_returnflag") == "R", 2).otherwise(4)).alias("types"),
    )
