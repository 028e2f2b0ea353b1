"""Barcode correction as a similarity join: neighbours of the retained barcodes are generated, then matched by equality."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import check_length, neighbours

POLICIES = ("unique", "frequency")


def confidence(value: str | float | Fraction) -> Fraction:
    """A confidence from 'a/b', a decimal of at most 18 digits after the point, or a number; from 0 to 1, reduced."""
    if isinstance(value, str):
        text = value.strip()
        if "/" not in text and len(text.partition(".")[2]) > 18:
            raise ValueError("at most 18 decimal digits")
        out = Fraction(text)
    else:
        if value != value:
            raise ValueError("not a number")
        out = Fraction(str(value)) if isinstance(value, float) else Fraction(value)
    if not 0 <= out <= 1:
        raise ValueError("a confidence is from 0 to 1")
    return out


@dataclass(frozen=True)
class Spec:
    """length of barcodes, neighbourhood, policy, and confidence and pseudocount of the frequency policy."""

    length: int
    neighbourhood: str = "hamming-1"
    policy: str = "unique"
    least: Fraction = Fraction(39, 40)
    pseudocount: int = 1

    def __post_init__(self) -> None:
        check_length(self.length)
        if self.policy not in POLICIES:
            raise ValueError(f"no policy {self.policy!r}")
        if self.policy == "frequency" and self.pseudocount < 1:
            raise ValueError("the frequency policy needs a pseudocount")


#: Neighbourhoods by workflow.
DEFAULTS = {"filtered": "substitution-or-shift-1", "unfiltered": "hamming-1", "multi": "hamming-1", "atac": "hamming-1"}
SAMPLE_MODES = {"exact": None, "unique": ("hamming-1", "unique"), "frequency": ("hamming-1", "frequency"), "1-edit": ("substitution-or-shift-1", "unique")}


def check_sources(sources: DataFrame) -> DataFrame:
    """sources (source, target, count), repeated rows once; raises when it runs if a source has two targets or counts."""
    one = sources.groupBy("source").agg(F.min("target").alias("target"), F.max("target").alias("__t"), F.min("count").alias("count"), F.max("count").alias("__c"))
    bad = (F.col("target") != F.col("__t")) | (F.col("count") != F.col("__c"))
    return one.withColumn("target", F.when(bad, F.raise_error(F.lit("a source with different targets or counts"))).otherwise(F.col("target"))).drop("__t", "__c")


def candidates(sources: DataFrame, spec: Spec) -> DataFrame:
    """observed, source, target, count: for each barcode in a neighbourhood, the sources that may have become it."""
    out = sources.select("source", "target", "count", F.explode(neighbours(F.col("source"), spec.length, spec.neighbourhood)).alias("observed"))
    return out.join(sources.select(F.col("source").alias("observed")), "observed", "left_anti")  # an exact source always wins


def decide(found: DataFrame, spec: Spec, by: tuple[str, ...] = ("observed",)) -> DataFrame:
    """by, corrected, kind ('corrected' or 'ambiguous') from candidates.

    unique: all sources have one target. frequency: a target weighs the sum of its sources' counts + pseudocount; the heaviest (of
    equal ones the greatest) needs the confidence's share of all, compared exactly. Sources are unique, so each counts once.
    """
    per = found.groupBy(*by, "target").agg(F.sum(F.col("count") + F.lit(spec.pseudocount)).cast("decimal(20,0)").alias("w"))
    best = per.groupBy(*by).agg(F.count("*").alias("k"), F.max(F.struct("w", "target")).alias("best"), F.sum("w").cast("decimal(20,0)").alias("total"))
    if spec.policy == "unique":
        good: Column = F.col("k") == 1
    else:
        good = (F.col("k") == 1) | (F.col("best.w") * F.lit(spec.least.denominator).cast("decimal(18,0)") >= F.col("total") * F.lit(spec.least.numerator).cast("decimal(18,0)"))
    return best.select(*by, F.when(good, F.col("best.target")).alias("corrected"), F.when(good, F.lit("corrected")).otherwise(F.lit("ambiguous")).alias("kind"))


def neighbourhood_table(sources: DataFrame, spec: Spec) -> DataFrame:
    """observed, corrected, kind for every retained barcode ('exact') and every neighbour of one."""
    exact = sources.select(F.col("source").alias("observed"), F.col("target").alias("corrected"), F.lit("exact").alias("kind"))
    return exact.unionByName(decide(candidates(sources, spec), spec))


def structural_table(sources: DataFrame, spec: Spec) -> DataFrame:
    """The neighbourhood without the policy: unique targets, and the barcodes that several targets reach."""
    return neighbourhood_table(sources, Spec(spec.length, spec.neighbourhood, "unique"))


def resolve(observed: DataFrame, sources: DataFrame, spec: Spec) -> DataFrame:
    """observed (observed, n) with corrected and kind: exact, corrected, ambiguous or not_found."""
    table = neighbourhood_table(sources, spec)
    return observed.join(table, "observed", "left").select("observed", "n", "corrected", F.coalesce("kind", F.lit("not_found")).alias("kind"))


def sources_of(retained: DataFrame) -> DataFrame:
    """Retained barcodes (bc, n) as their own sources and targets."""
    return retained.select(F.col("bc").alias("source"), F.col("bc").alias("target"), F.col("n").alias("count"))


def plan(hist: DataFrame, retained: DataFrame, spec: Spec) -> DataFrame:
    """observed, corrected, kind, n for all barcodes of the histogram (bc, n)."""
    return resolve(hist.select(F.col("bc").alias("observed"), "n"), sources_of(retained), spec)


def accepted(plan_rows: DataFrame) -> DataFrame:
    """The pairs observed, corrected of a plan; targets without an accepted read do not occur."""
    return plan_rows.filter(F.col("corrected").isNotNull()).select("observed", "corrected")


def target_counts(plan_rows: DataFrame) -> DataFrame:
    """corrected, n: accepted reads by target."""
    return plan_rows.filter(F.col("corrected").isNotNull()).groupBy("corrected").agg(F.sum("n").alias("n"))


def statistics(plan_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """kind, n_distinct, n_reads for the four outcomes; retained barcodes that no read has add to the exact distinct ones."""
    seen = plan_rows.groupBy("kind").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_reads"))
    unread = sources.select(F.col("source").alias("observed")).join(plan_rows, "observed", "left_anti").agg(F.count("*").alias("n_distinct"))
    unread = unread.select(F.lit("exact").alias("kind"), "n_distinct", F.lit(0).cast("long").alias("n_reads"))
    kinds = plan_rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("exact", "corrected", "ambiguous", "not_found")))).alias("kind"), F.lit(0).cast("long").alias("n_distinct"), F.lit(0).cast("long").alias("n_reads"))
    return seen.unionByName(unread).unionByName(kinds).groupBy("kind").agg(F.sum("n_distinct").alias("n_distinct"), F.sum("n_reads").alias("n_reads"))


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """outcome, n_distinct, n_reads of two plans of the same barcodes: identical, rescue, rejection or retarget."""
    a = one.select("observed", F.col("corrected").alias("a"), F.col("n").alias("na"))
    b = two.select("observed", F.col("corrected").alias("b"), F.col("n").alias("nb"))
    both = a.join(b, "observed", "full_outer")
    outcome = F.when(F.col("a").eqNullSafe(F.col("b")), "identical").when(F.col("a").isNull(), "rescue").when(F.col("b").isNull(), "rejection").otherwise("retarget")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_distinct"), F.sum(F.coalesce("na", "nb")).alias("n_reads"))


def route_samples(pairs: DataFrame, known: DataFrame, length: int, mode: str = "exact", least: Fraction = Fraction(39, 40)) -> DataFrame:
    """pairs (sample, bc, n) with canonical and route: exact, unique, accepted, rejected or none.

    known (observed, canonical) lists sample barcodes. Frequency weighs the ambiguous ones by the exact reads of the canonical
    samples; those priors are one aggregation of the whole input, so nothing is put off and replayed.
    """
    if mode not in SAMPLE_MODES:
        raise ValueError(f"no sample mode {mode!r}")
    exact = pairs.join(known.select(F.col("observed").alias("sample"), "canonical"), "sample").groupBy("canonical").agg(F.sum("n").alias("count"))
    sources = known.join(exact, "canonical", "left").select(F.col("observed").alias("source"), F.col("canonical").alias("target"), F.coalesce("count", F.lit(0)).alias("count"))
    table = known.select(F.col("observed").alias("sample"), "canonical", F.lit("exact").alias("route"))
    if SAMPLE_MODES[mode]:
        kind, policy = SAMPLE_MODES[mode]
        spec = Spec(length, kind, policy, least)
        found = candidates(sources, spec)
        plain = decide(found, Spec(length, kind, "unique")).select("observed", F.col("corrected").alias("u"))
        rows = decide(found, spec).join(plain, "observed")
        unsure = "accepted" if policy == "frequency" else "unique"
        route = F.when(F.col("u").isNotNull(), "unique").when(F.col("corrected").isNotNull(), unsure).otherwise("rejected")
        table = table.unionByName(rows.select(F.col("observed").alias("sample"), F.col("corrected").alias("canonical"), route.alias("route")))
    return pairs.join(table, "sample", "left").withColumn("route", F.coalesce("route", F.lit("none")))
