"""Shared parts of the registered queries: the inputs that several of them start from, on both sides."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correct, permit
from ..operators import reads as R
from ..sources import tables

CELLS = 100
BASES = 6
GENES_OF = 4  # transcripts of a gene
SQL_HIST = f"{tables.READS_SQL}, hist AS (SELECT bc, count(*) AS n FROM reads WHERE fw GROUP BY bc)"
SQL_KEPT = f"{SQL_HIST}, kept AS (SELECT bc, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM hist) WHERE r <= {CELLS})"
#: Hamming distance one as a plain predicate, and the theta join of observed and retained barcodes.
SQL_ONE = "bit_count((xor(a.bc, k.bc) | (xor(a.bc, k.bc) >> 1)) & 1365) = 1"
SQL_PAIRS = f"""{SQL_KEPT}, pairs AS (SELECT a.bc AS observed, a.n AS n, k.bc AS target, k.n + 1 AS w FROM hist a JOIN kept k ON {SQL_ONE}
  WHERE a.bc NOT IN (SELECT bc FROM kept))"""
SQL_PLAN = f"""{SQL_PAIRS}, uniq AS (SELECT observed, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS corrected,
  CASE WHEN count(DISTINCT target) = 1 THEN 'corrected' ELSE 'ambiguous' END AS kind FROM pairs GROUP BY observed),
plan AS (SELECT h.bc AS observed, h.n, CASE WHEN k.bc IS NOT NULL THEN k.bc ELSE u.corrected END AS corrected,
  CASE WHEN k.bc IS NOT NULL THEN 'exact' ELSE coalesce(u.kind, 'not_found') END AS kind
  FROM hist h LEFT JOIN kept k ON h.bc = k.bc LEFT JOIN uniq u ON h.bc = u.observed)"""


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permit.histogram(R.oriented(tables.reads(spark, sf_dir), "fw"))


def plan(spark: SparkSession, sf_dir: str, kind: str = "hamming-1", policy: str = "unique", least: Fraction = Fraction(39, 40)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The histogram, the retained barcodes and the plan."""
    h = hist(spark, sf_dir)
    kept = permit.force_cells(h, CELLS)
    return h, kept, correct.plan(h, kept, correct.Spec(BASES, kind, policy, least))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, umi, label: reads of 256 cells with the genes of their transcripts."""
    r = tables.reads(spark, sf_dir)
    return r.select("cell", "umi", F.array_sort(F.array_distinct(F.transform("refs", lambda t: F.floor(t / GENES_OF).cast("long")))).alias("label"))


#: SQL of labelled(), and of spliced_labels() with a transcript as the form of gene tid / 2.
SQL_LABELLED = f"{tables.READS_SQL}, lab AS (SELECT cell, umi, list_sort(list_distinct(list_transform(refs, lambda t: t // {GENES_OF}))) AS label FROM reads)"
SQL_VOTES = """votes AS (SELECT cell, umi, g, count(*) AS v FROM (SELECT cell, umi, unnest(label) AS g FROM lab) GROUP BY ALL),
won AS (SELECT cell, umi, list(g ORDER BY g) AS label FROM (SELECT *, max(v) OVER (PARTITION BY cell, umi) AS top FROM votes) WHERE v = top GROUP BY cell, umi)"""


def spliced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, umi, label: transcripts of 40 as splicing forms of 20 genes."""
    r = tables.reads(spark, sf_dir)
    return r.select("cell", "umi", F.array_sort(F.array_distinct(F.transform("refs", lambda t: t % 40))).alias("label"))


SPLICED_GENES = 20
SQL_SPLICED = f"{tables.READS_SQL}, lab AS (SELECT cell, umi, list_sort(list_distinct(list_transform(refs, lambda t: t % 40))) AS label FROM reads)"


def text(label: str) -> Column:
    """An array as text, for comparison."""
    return F.array_join(F.transform(label, lambda x: x.cast("string")), "|")
