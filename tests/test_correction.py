from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplan.functions import dna
from cytoplan.operators import correct, permit


def neighbours(spark, f, code, length):
    return sorted(spark.range(1).select(f(F.lit(code).cast("long"), length)).first()[0])


def test_substitutions_and_shifts(spark):
    assert neighbours(spark, dna.substitutions, 7, 3) == [3, 4, 5, 6, 11, 15, 23, 39, 55]
    assert neighbours(spark, dna.shifts, 7, 3) == [1, 4, 5, 6, 9, 12, 13, 14, 15, 28, 29, 30, 31]
    both = spark.range(1).select(dna.neighbours(F.lit(7).cast("long"), 3, "edit-1")).first()[0]
    assert len(both) == len(set(both)) == 18
    assert neighbours(spark, dna.shifts, 2, 1) == []


def test_dna_round_trip(spark):
    df = spark.createDataFrame([("ACGTTGCA",), ("TTTTTTTT",), ("ANGT",)], "s string")
    rows = df.select("s", dna.pack(F.col("s")).alias("c")).collect()
    assert [r.c for r in rows] == [int("".join("0123"["ACGT".index(x)] if x in "ACGT" else "0" for x in r.s), 4) for r in rows]
    back = df.filter("s not like '%N%'").select("s", dna.unpack(dna.pack(F.col("s")), 8).alias("t"), dna.unpack(dna.reverse_complement_packed(dna.pack(F.col("s")), 8), 8).alias("r"), dna.reverse_complement(F.col("s")).alias("q"))
    assert all(r.s == r.t and r.r == r.q for r in back.collect())
    with pytest.raises(ValueError):
        dna.check_length(32)


def resolve(spark, sources, observed, spec):
    s = spark.createDataFrame(sources, "source long, target long, count long")
    o = spark.createDataFrame([(x, 1) for x in observed], "observed long, n long")
    return {r.observed: (r.kind, r.corrected) for r in correct.resolve(o, s, spec).collect()}


def test_policies(spark):
    h1 = correct.Spec(1)
    assert resolve(spark, [(0, 10, 1), (1, 11, 1)], [0], h1) == {0: ("exact", 10)}
    assert resolve(spark, [(1, 7, 1), (2, 7, 1)], [0], h1) == {0: ("corrected", 7)}
    assert resolve(spark, [(1, 10, 1), (2, 20, 1)], [0], h1) == {0: ("ambiguous", None)}
    split = [(0, 10, 100), (2, 20, 1)]
    assert resolve(spark, split, [1, 3], h1) == {1: ("ambiguous", None), 3: ("ambiguous", None)}
    assert resolve(spark, split, [1], correct.Spec(1, policy="frequency")) == {1: ("corrected", 10)}
    assert resolve(spark, [(1, 10, 4), (2, 20, 4)], [0], correct.Spec(1, policy="frequency", least=Fraction(1, 2))) == {0: ("corrected", 20)}


def test_frequency_threshold_is_inclusive(spark):
    spec = correct.Spec(1, policy="frequency")
    assert resolve(spark, [(1, 10, 37), (2, 20, 0)], [0], spec)[0] == ("ambiguous", None)
    assert resolve(spark, [(1, 10, 19), (2, 10, 18), (3, 20, 0)], [0], spec)[0] == ("corrected", 10)  # 39 of 40
    assert resolve(spark, [(1, 10, 18), (2, 10, 18), (3, 20, 1)], [0], spec)[0] == ("ambiguous", None)  # 38 of 40


def test_shift_is_directed(spark):
    spec = correct.Spec(3, "substitution-or-shift-1")
    assert resolve(spark, [(1, 1, 1)], [8], spec) == {8: ("corrected", 1)} or resolve(spark, [(1, 1, 1)], [8], spec)[8][0] == "corrected"
    assert resolve(spark, [(8, 8, 1)], [1], spec) == {1: ("not_found", None)}


def test_confidence():
    assert correct.confidence("0.975") == Fraction(39, 40)
    assert correct.confidence("90/100") == Fraction(9, 10)
    for bad in ("1.01", float("nan"), "-0.1"):
        with pytest.raises(ValueError):
            correct.confidence(bad)


def test_conflicting_sources(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        correct.check_sources(spark.createDataFrame([(1, 7, 1), (1, 8, 1)], "source long, target long, count long")).collect()


def test_knee_and_thresholds(spark):
    counts = np.array([100, 90, 80, 70, 60, 3, 2, 2, 1, 1, 1, 1])
    assert permit.knee_index(counts) in range(3, 6)
    with pytest.raises(ValueError):
        permit.knee_index(np.array([5]))
    h = spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts)], "bc long, n long")
    assert permit.force_cells(h, 7).count() == 8  # a tie
    assert permit.force_cells(h, 0).count() == 0
    assert permit.force_cells(h, 99).count() == 12
    assert permit.expect_cells(h, 4).count() == 5  # a tenth of 60 is 6
    empty = h.limit(0)
    assert permit.knee(empty).count() == permit.force_cells(empty, 3).count() == permit.expect_cells(empty, 3).count() == 0


def test_differing_bases_sees_all_places(spark):
    """Pairs that differ in the last two bases are compared as well."""
    from cytoplan.plans.queries import QUERIES

    rows = QUERIES["sf7_all_pairs"](spark, "/root/testdata/sf0.001").collect()
    kept = {r.a for r in rows}
    assert len(rows) == len(kept) ** 2 and any(r.a % 16 != r.b % 16 for r in rows)
    assert all(r.bases == sum((r.a >> 2 * i) & 3 != (r.b >> 2 * i) & 3 for i in range(6)) for r in rows)
