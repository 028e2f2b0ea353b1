"""One query for each read operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import atac, collate, correct, permit, quant, resolve
from ..operators import reads as R
from ..sources import sinks, tables
from . import base
from .base import BASES, CELLS, GENES_OF, SPLICED_GENES, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- histograms and retained barcodes ----


@query(f"WITH {base.SQL_HIST} SELECT bc, n FROM hist")
def a1_histogram(spark, d):
    return base.hist(spark, d)


@query(f"WITH {tables.READS_SQL} SELECT sample, bc, count(*) AS n FROM reads WHERE fw GROUP BY sample, bc")
def a2_sample_histogram(spark, d):
    return permit.histogram(R.oriented(tables.reads(spark, d), "fw"), ("sample", "bc"))


@query(f"WITH {tables.READS_SQL} SELECT count(*) AS n_reads, max(len(refs))::INTEGER AS max_ambiguity FROM reads")
def a11_read_summary(spark, d):
    return permit.summary(tables.reads(spark, d))


@query(f"WITH {tables.READS_SQL} SELECT fw AS forward, count(*) AS n, count(*) FILTER (WHERE fw) AS fw_kept, count(*) FILTER (WHERE NOT fw) AS rc_kept FROM reads GROUP BY fw")
def p1_orientation(spark, d):
    r = tables.reads(spark, d)
    on = lambda o: F.count(F.when(R.on_strand(F.col("dirs"), o), 1))
    return r.groupBy(F.col("fw").alias("forward")).agg(F.count("*").alias("n"), on("fw").alias("fw_kept"), on("rc").alias("rc_kept"))


@query(f"""WITH {tables.READS_SQL}, a AS (SELECT cell, umi, len(refs) AS k, refs[1] AS lo, fw FROM reads)
SELECT cell, count(*) AS n_reads, sum(CASE WHEN k = 2 THEN 1 ELSE k END)::BIGINT AS n_alignments FROM a WHERE k = 2 OR fw GROUP BY cell""")
def p2_prune_alignments(spark, d):
    r = tables.reads(spark, d).withColumn("dirs", F.when(F.size("refs") == 2, F.array(F.lit(True), F.lit(False))).otherwise(F.array("fw")))
    return R.prune_alignments(r, "fw").groupBy("cell").agg(F.count("*").alias("n_reads"), F.sum(F.size("refs")).alias("n_alignments"))


@query(f"WITH {base.SQL_HIST} SELECT bc, n FROM hist WHERE n >= 3 AND bc % 3 = 0")
def r1_min_reads(spark, d):
    return permit.min_reads(base.hist(spark, d), 3, spark.range(0, 4096, 3).withColumnRenamed("id", "bc"))


@query(f"WITH {base.SQL_KEPT} SELECT bc, n FROM kept")
def r2_force_cells(spark, d):
    return permit.force_cells(base.hist(spark, d), CELLS)


@query(f"""WITH {base.SQL_HIST}, o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM hist), c AS (SELECT count(*) AS k FROM hist),
t AS (SELECT greatest(1, floor(n / 10 + 0.5)) AS t FROM o, c WHERE r = least(100, k)) SELECT bc, n FROM hist, t WHERE n >= t""")
def r3_expect_cells(spark, d):
    return permit.expect_cells(base.hist(spark, d), 100)


@query(f"""WITH RECURSIVE {base.SQL_HIST}, o AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS i FROM hist),
c AS (SELECT i, sum(n) OVER (ORDER BY i)::DOUBLE AS y FROM o), size AS (SELECT count(*) AS k FROM o), lead AS (SELECT y AS f FROM c WHERE i = 0),
it(k, was, knee, len) AS (SELECT 0, -1::BIGINT, 0::BIGINT, (SELECT k FROM size)
 UNION ALL SELECT k + 1, knee, m, least((SELECT k FROM size) - 1, 5 * m) FROM (
   SELECT it.k, it.knee, (SELECT max_by(c.i, (abs((1 - f / top) * (c.i / it.len) - c.y / top + f / top) / sqrt((1 - f / top) * (1 - f / top) + 1), c.i))
     FROM c, lead, (SELECT max(y) AS top FROM c WHERE c.i < it.len) t WHERE c.i < it.len) AS m FROM it WHERE it.k <= 100 AND it.was <> it.knee)),
done AS (SELECT max_by(knee, k) AS knee FROM it) SELECT bc, n FROM hist WHERE n >= (SELECT o.n FROM o, done WHERE o.i = done.knee)""")
def r4_knee(spark, d):
    return permit.knee(base.hist(spark, d))


@query(f"WITH {base.SQL_HIST} SELECT r.range * 5 AS bc, coalesce(n, 0) AS n FROM range(1000) r LEFT JOIN hist ON bc = r.range * 5")
def r5_explicit_list(spark, d):
    return permit.explicit(base.hist(spark, d), spark.range(0, 5000, 5).withColumnRenamed("id", "bc"))


@query(f"""WITH {tables.READS_SQL}, h AS (SELECT sample, bc, count(*) AS n FROM reads WHERE fw GROUP BY sample, bc)
SELECT sample, bc, n FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY n DESC) AS r FROM h) WHERE r <= 20""")
def r6_force_cells_by_sample(spark, d):
    return permit.force_cells(permit.histogram(R.oriented(tables.reads(spark, d), "fw"), ("sample", "bc")), 20, ("sample",))


@query(f"""WITH {base.SQL_HIST}, t AS (SELECT sum(n)::BIGINT AS n_reads, coalesce(sum(n) FILTER (WHERE bc % 3 <> 0), 0)::BIGINT AS n_unmatched FROM hist)
SELECT *, n_unmatched / n_reads AS fraction, n_unmatched / n_reads >= 0.3 AS warns FROM t""")
def a15_unmatched_fraction(spark, d):
    return permit.unmatched_fraction(base.hist(spark, d), spark.range(0, 4096, 3).withColumnRenamed("id", "bc"))


# ---- packed DNA ----


@query(f"""WITH {base.SQL_HIST}, s AS (SELECT bc, list_aggregate(list_transform(range({BASES}), lambda i: substr('ACGT', 1 + ((bc >> (2 * ({BASES - 1} - i))) & 3)::INTEGER, 1)), 'string_agg', '') AS dna FROM hist)
SELECT bc, dna, reverse(translate(dna, 'ACGT', 'TGCA')) AS rc, bc AS packed,
 list_sum(list_transform(range({BASES}), lambda i: (3 - ((bc >> (2 * i)) & 3)) << (2 * ({BASES - 1} - i))))::BIGINT AS rc_packed FROM s""")
def sf1_dna(spark, d):
    s = base.hist(spark, d).select("bc", dna.unpack(F.col("bc"), BASES).alias("dna"))
    return s.select("bc", "dna", dna.reverse_complement(F.col("dna")).alias("rc"), dna.pack(F.col("dna")).alias("packed"), dna.reverse_complement_packed(F.col("bc"), BASES).alias("rc_packed"))


@query(f"WITH {base.SQL_KEPT} SELECT k.bc AS bc, a.bc AS neighbour FROM kept k JOIN (SELECT range AS bc FROM range(4096)) a ON {base.SQL_ONE}")
def sf3_substitutions(spark, d):
    return permit.force_cells(base.hist(spark, d), CELLS).select("bc", F.explode(dna.substitutions(F.col("bc"), BASES)).alias("neighbour"))


_SHIFTS = f"""shifted AS (SELECT DISTINCT bc, CASE WHEN up THEN ((bc >> (2 * b)) << (2 * b)) | base | ((bc & ((1 << (2 * b)) - 1)) << 2)
  ELSE ((bc >> (2 * b)) << (2 * b)) | (base << (2 * (b - 1))) | ((bc & ((1 << (2 * b)) - 1)) >> 2) END AS neighbour
  FROM kept, range(1, {BASES}) x(b), range(4) y(base), (VALUES (true), (false)) z(up))"""


@query(f"WITH {base.SQL_KEPT}, {_SHIFTS} SELECT bc, neighbour FROM shifted WHERE neighbour <> bc")
def sf4_shifts(spark, d):
    return permit.force_cells(base.hist(spark, d), CELLS).select("bc", F.explode(dna.shifts(F.col("bc"), BASES)).alias("neighbour"))


@query(f"""WITH {base.SQL_KEPT} SELECT k.bc AS a, h.bc AS b, list_sum(list_transform(range({BASES}), lambda i: (((k.bc >> (2 * i)) & 3) <> ((h.bc >> (2 * i)) & 3))::INTEGER))::INTEGER AS bases FROM kept k, hist h""")
def sf7_differing_bases(spark, d):
    """Of every retained barcode (CELLS of them, so that side is bounded and broadcast) and every barcode read."""
    h = base.hist(spark, d)
    k = permit.force_cells(h, CELLS).select(F.col("bc").alias("a"))
    return h.select(F.col("bc").alias("b")).join(F.broadcast(k)).select("a", "b", dna.differing_bases(F.col("a"), F.col("b")).alias("bases"))


# ---- correction ----


@query(f"WITH {base.SQL_PLAN} SELECT observed, corrected, kind, n FROM plan")
def b4_unique_plan(spark, d):
    return base.plan(spark, d)[2].select("observed", "corrected", "kind", "n")


def _frequency_sql(num: int, den: int) -> str:
    return f"""WITH {base.SQL_PAIRS}, t AS (SELECT observed, target, sum(w) AS w FROM pairs GROUP BY ALL),
    b AS (SELECT observed, max(w) AS w, sum(w) AS total FROM t GROUP BY observed),
    f AS (SELECT b.observed, max(t.target) AS best, any_value(b.w * {den} >= b.total * {num}) AS good FROM b JOIN t ON t.observed = b.observed AND t.w = b.w GROUP BY b.observed)
    SELECT h.bc AS observed, CASE WHEN k.bc IS NOT NULL THEN k.bc WHEN good THEN best END AS corrected,
    CASE WHEN k.bc IS NOT NULL THEN 'exact' WHEN good THEN 'corrected' WHEN best IS NOT NULL THEN 'ambiguous' ELSE 'not_found' END AS kind, h.n
    FROM hist h LEFT JOIN kept k ON h.bc = k.bc LEFT JOIN f ON f.observed = h.bc"""


@query(_frequency_sql(1, 2))
def b5_frequency_half(spark, d):
    return base.plan(spark, d, policy="frequency", least=Fraction(1, 2))[2].select("observed", "corrected", "kind", "n")


@query(_frequency_sql(39, 40))
def b5_frequency_default(spark, d):
    return base.plan(spark, d, policy="frequency")[2].select("observed", "corrected", "kind", "n")


@query(f"""WITH {base.SQL_KEPT}, {_SHIFTS}, near AS (SELECT bc, neighbour FROM shifted WHERE neighbour <> bc
  UNION SELECT k.bc, a.bc FROM kept k JOIN (SELECT range AS bc FROM range(4096)) a ON {base.SQL_ONE}),
u AS (SELECT neighbour AS observed, CASE WHEN count(DISTINCT bc) = 1 THEN min(bc) END AS corrected, CASE WHEN count(DISTINCT bc) = 1 THEN 'corrected' ELSE 'ambiguous' END AS kind FROM near GROUP BY neighbour)
SELECT h.bc AS observed, CASE WHEN k.bc IS NOT NULL THEN k.bc ELSE u.corrected END AS corrected, CASE WHEN k.bc IS NOT NULL THEN 'exact' ELSE coalesce(u.kind, 'not_found') END AS kind, h.n
FROM hist h LEFT JOIN kept k ON h.bc = k.bc LEFT JOIN u ON u.observed = h.bc""")
def b6_shift_plan(spark, d):
    return base.plan(spark, d, "substitution-or-shift-1")[2].select("observed", "corrected", "kind", "n")


_TABLE = f"""WITH {base.SQL_KEPT}, u AS (SELECT a.bc AS observed, CASE WHEN count(*) = 1 THEN min(k.bc) END AS corrected, CASE WHEN count(*) = 1 THEN 'corrected' ELSE 'ambiguous' END AS kind
  FROM (SELECT range AS bc FROM range(4096)) a JOIN kept k ON {base.SQL_ONE} WHERE a.bc NOT IN (SELECT bc FROM kept) GROUP BY a.bc)
SELECT observed, corrected, kind FROM u UNION ALL SELECT bc, bc, 'exact' FROM kept"""


@query(_TABLE)
def b7_neighbourhood_table(spark, d):
    return correct.neighbourhood_table(correct.sources_of(permit.force_cells(base.hist(spark, d), CELLS)), correct.Spec(BASES))


@query(f"SELECT kind, count(*) AS n, coalesce(sum(corrected), 0)::BIGINT AS checksum FROM ({_TABLE}) GROUP BY kind")
def b8_structural_table(spark, d):
    t = correct.structural_table(correct.sources_of(permit.force_cells(base.hist(spark, d), CELLS)), correct.Spec(BASES, policy="frequency"))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("corrected"), F.lit(0)).alias("checksum"))


@query(f"WITH {base.SQL_PLAN} SELECT corrected, sum(n)::BIGINT AS n FROM plan WHERE corrected IS NOT NULL GROUP BY corrected")
def a3_target_counts(spark, d):
    return correct.target_counts(base.plan(spark, d)[2])


@query(f"""WITH {base.SQL_PLAN} SELECT k.kind, count(p.kind) + CASE WHEN k.kind = 'exact' THEN 10 ELSE 0 END AS n_distinct, coalesce(sum(p.n), 0)::BIGINT AS n_reads
FROM (VALUES ('exact'), ('corrected'), ('ambiguous'), ('not_found')) k(kind) LEFT JOIN plan p ON p.kind = k.kind GROUP BY k.kind""")
def a4_correction_statistics(spark, d):
    _, kept, p = base.plan(spark, d)
    unread = spark.range(5000, 5010).select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0).cast("long").alias("count"))
    return correct.statistics(p, correct.sources_of(kept).unionByName(unread))


@query(f"""WITH {base.SQL_PLAN} SELECT 'rescue' AS outcome, count(*) AS n_distinct, sum(n)::BIGINT AS n_reads FROM plan WHERE kind = 'corrected' HAVING count(*) > 0
UNION ALL SELECT 'identical', count(*), sum(n)::BIGINT FROM plan WHERE kind <> 'corrected' HAVING count(*) > 0""")
def j10_plan_difference(spark, d):
    p = base.plan(spark, d)[2]
    exact_only = p.withColumn("corrected", F.when(F.col("kind") == "exact", F.col("corrected")))
    return correct.difference(exact_only, p)


_KNOWN = {0: 0, 5: 5, 10: 10}
_SAMPLE_SQL = f"""{tables.READS_SQL}, prs AS (SELECT sample, bc, count(*) AS n FROM reads GROUP BY sample, bc), known AS (SELECT unnest([0, 5, 10]) AS k),
cand AS (SELECT s.s AS sample, k FROM (SELECT range AS s FROM range(16)) s JOIN known ON bit_count((xor(s.s, k) | (xor(s.s, k) >> 1)) & 5) = 1 WHERE s.s NOT IN (SELECT k FROM known)),
prior AS (SELECT k, coalesce((SELECT sum(n) FROM prs WHERE sample = k), 0) + 1 AS w FROM known)"""


def _known(spark):
    return spark.createDataFrame([(a, b) for a, b in _KNOWN.items()], "observed long, canonical long")


def _pairs(spark, d):
    return permit.histogram(tables.reads(spark, d), ("sample", "bc"))


@query(f"""WITH {_SAMPLE_SQL}, u AS (SELECT sample, count(*) AS c, min(k) AS k FROM cand GROUP BY sample),
r AS (SELECT p.*, CASE WHEN p.sample IN (SELECT k FROM known) THEN 'exact' WHEN u.c = 1 THEN 'unique' WHEN u.c > 1 THEN 'rejected' ELSE 'none' END AS route FROM prs p LEFT JOIN u ON u.sample = p.sample)
SELECT route, count(*) AS n_pairs, sum(n)::BIGINT AS n_reads FROM r GROUP BY route""")
def a18_sample_routes(spark, d):
    return correct.route_samples(_pairs(spark, d), _known(spark), 2, "unique").groupBy("route").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_reads"))


@query(f"""WITH {_SAMPLE_SQL}, t AS (SELECT c.sample, c.k, p.w FROM cand c JOIN prior p ON p.k = c.k),
b AS (SELECT sample, count(*) AS c, max(w) AS w, sum(w) AS total FROM t GROUP BY sample), f AS (SELECT b.sample, b.c, max(t.k) AS k, any_value(b.w * 2 >= b.total) AS good FROM b JOIN t ON t.sample = b.sample AND t.w = b.w GROUP BY b.sample, b.c),
r AS (SELECT p.*, CASE WHEN p.sample IN (SELECT k FROM known) THEN p.sample WHEN f.c = 1 OR good THEN f.k END AS canonical,
  CASE WHEN p.sample IN (SELECT k FROM known) THEN 'exact' WHEN f.c = 1 THEN 'unique' WHEN good THEN 'accepted' WHEN f.c > 1 THEN 'rejected' ELSE 'none' END AS route FROM prs p LEFT JOIN f ON f.sample = p.sample)
SELECT sample, bc, n, canonical, route FROM r""")
def b12_sample_frequency(spark, d):
    return correct.route_samples(_pairs(spark, d), _known(spark), 2, "frequency", Fraction(1, 2)).select("sample", "bc", "n", "canonical", "route")


# ---- collation ----


@query(f"WITH {base.SQL_PLAN} SELECT p.corrected AS cell, count(*) AS n, count(DISTINCT r.umi) AS n_umi FROM reads r JOIN plan p ON r.bc = p.observed WHERE r.fw AND p.corrected IS NOT NULL GROUP BY p.corrected")
def j1_collate(spark, d):
    reads = R.oriented(tables.reads(spark, d), "fw")
    return collate.collate(reads, correct.accepted(base.plan(spark, d)[2])).groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("umi").alias("n_umi"))


_TWO = f"""{tables.READS_SQL}, h AS (SELECT sample, bc, count(*) AS n FROM reads WHERE fw AND sample IN (0, 5, 10) GROUP BY sample, bc),
k AS (SELECT sample, bc FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY n DESC) AS r FROM h) WHERE r <= 20),
c AS (SELECT h.sample, h.bc, min(k.bc) AS t FROM h JOIN k ON h.sample = k.sample AND bit_count((xor(h.bc, k.bc) | (xor(h.bc, k.bc) >> 1)) & 1365) = 1
  WHERE (h.sample, h.bc) NOT IN (SELECT (sample, bc) FROM k) GROUP BY ALL HAVING count(*) = 1),
acc AS (SELECT sample, bc, bc AS cell FROM k UNION ALL SELECT sample, bc, t FROM c),
two AS (SELECT r.sample AS canonical, a.cell, r.umi FROM reads r JOIN acc a ON a.sample = r.sample AND a.bc = r.bc WHERE r.fw)"""


def _two_level(spark, d):
    reads = R.oriented(tables.reads(spark, d), "fw")
    known = _known(spark).select(F.col("observed").alias("sample"), "canonical")
    h = permit.histogram(reads.join(known, "sample"), ("canonical", "bc"))
    kept = permit.force_cells(h, 20, ("canonical",))
    spec = correct.Spec(BASES)
    near = kept.select("canonical", F.col("bc").alias("target"), F.col("n").alias("count"), F.explode(dna.neighbours(F.col("bc"), BASES, "hamming-1")).alias("observed"))
    near = near.join(kept.select("canonical", F.col("bc").alias("observed")), ["canonical", "observed"], "left_anti")
    fixed = correct.decide(near, spec, ("canonical", "observed")).filter("corrected is not null").select("canonical", "observed", "corrected")
    accepted = fixed.unionByName(kept.select("canonical", F.col("bc").alias("observed"), F.col("bc").alias("corrected")))
    return collate.collate_samples(reads, known, accepted)


@query(f"WITH {_TWO} SELECT canonical, cell, count(*) AS n FROM two GROUP BY ALL")
def j2_collate_samples(spark, d):
    return _two_level(spark, d).groupBy("canonical", "cell").agg(F.count("*").alias("n"))


@query(f"""WITH {_TWO}, m AS (SELECT canonical, count(DISTINCT cell) AS n_cells, count(*) AS n_records FROM two GROUP BY canonical)
SELECT *, coalesce(sum(n_cells) OVER (ORDER BY canonical ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_cell FROM m""")
def a17_manifest(spark, d):
    return collate.manifest(_two_level(spark, d))


@query(f"""WITH {base.SQL_PLAN}, un AS (SELECT bc, count(*) AS n FROM reads WHERE NOT fw GROUP BY bc)
SELECT p.corrected AS cell, sum(un.n)::BIGINT AS n FROM un JOIN plan p ON un.bc = p.observed WHERE p.corrected IS NOT NULL GROUP BY p.corrected""")
def j9_unmapped_counts(spark, d):
    un = permit.histogram(R.oriented(tables.reads(spark, d), "rc"))
    return collate.unmapped(un, correct.accepted(base.plan(spark, d)[2]))


@query(f"WITH {tables.READS_SQL} SELECT cell, count(*) AS n FROM reads WHERE cell IN (1, 2, 3) GROUP BY cell")
def p12_cell_subset(spark, d):
    return collate.only_cells(tables.reads(spark, d), spark.createDataFrame([(1,), (2,), (3,), (999,)], "cell long")).groupBy("cell").agg(F.count("*").alias("n"))


# ---- classes, votes, spliced counts ----


@query(f"WITH {tables.READS_SQL} SELECT cell, array_to_string(refs, '|') AS label, umi, count(*) AS n FROM reads GROUP BY ALL")
def a5_transcript_classes(spark, d):
    return resolve.classes(tables.reads(spark, d), "refs").select("cell", text("label").alias("label"), "umi", "n")


@query(f"WITH {base.SQL_LABELLED} SELECT cell, array_to_string(label, '|') AS label, umi, count(*) AS n FROM lab GROUP BY ALL")
def a6_gene_classes(spark, d):
    return resolve.classes(base.labelled(spark, d)).select("cell", text("label").alias("label"), "umi", "n")


@query(f"WITH {base.SQL_LABELLED}, {base.SQL_VOTES} SELECT cell, array_to_string(label, '|') AS label, count(*) AS n FROM won GROUP BY ALL")
def a7_class_counts(spark, d):
    return resolve.class_counts(resolve.votes_winner_take_all(base.labelled(spark, d))).select("cell", text("label").alias("label"), "n")


@query(f"""WITH {base.SQL_LABELLED}, {base.SQL_VOTES}, c AS (SELECT cell, label, count(*) AS n FROM won GROUP BY ALL)
SELECT cell, dense_rank() OVER (ORDER BY label) - 1 AS eqid, array_to_string(label, '|') AS label, n FROM c""")
def a8_class_dictionary(spark, d):
    ids, matrix = resolve.dictionary(resolve.class_counts(resolve.votes_winner_take_all(base.labelled(spark, d))))
    return matrix.join(ids, "eqid").select("cell", "eqid", text("label").alias("label"), "n")


@query(f"WITH {base.SQL_LABELLED} SELECT cell, label[1] AS gid, count(DISTINCT umi) AS n FROM lab WHERE len(label) = 1 GROUP BY ALL")
def u1_trivial(spark, d):
    return resolve.trivial(base.labelled(spark, d))


@query(f"WITH {base.SQL_LABELLED}, {base.SQL_VOTES} SELECT cell, umi, array_to_string(label, '|') AS label FROM won")
def u2_winner_take_all(spark, d):
    return resolve.votes_winner_take_all(base.labelled(spark, d)).select("cell", "umi", text("label").alias("label"))


@query(f"WITH {base.SQL_LABELLED}, {base.SQL_VOTES} SELECT cell, label[1] AS gid, count(*)::DOUBLE AS n FROM won WHERE len(label) = 1 GROUP BY ALL")
def u17_cr_like(spark, d):
    return quant.quantify(tables.reads(spark, d).select("cell", "umi", F.col("refs").alias("label")), "cr-like", 0, transcripts_per_gene=GENES_OF)


@query(f"""WITH {base.SQL_SPLICED}, v AS (SELECT cell, umi, g >> 1 AS gene, count(*) AS v, list_distinct(list(g)) AS forms FROM (SELECT cell, umi, unnest(label) AS g FROM lab) GROUP BY ALL)
SELECT cell, umi, array_to_string(list_sort(flatten(list(forms))), '|') AS label FROM (SELECT *, max(v) OVER (PARTITION BY cell, umi) AS top FROM v) WHERE v = top GROUP BY cell, umi""")
def u3_prefer_ambiguous(spark, d):
    return resolve.votes_prefer_ambiguous(base.spliced_labels(spark, d)).select("cell", "umi", text("label").alias("label"))


_SMALL = """sz AS (SELECT cell, count(*) AS k FROM lab GROUP BY cell), thr AS (SELECT avg(k)::BIGINT AS t FROM sz)"""


def _mean_reads(reads):
    """The threshold of _SMALL: a half goes to the even number, as in the SQL's cast; 0 where there are no reads."""
    return reads.groupBy("cell").count().agg(F.rint(F.avg("count")).cast("long")).first()[0] or 0


@query(f"""WITH {base.SQL_LABELLED}, {base.SQL_VOTES}, {_SMALL},
small AS (SELECT w.cell, label[1] AS gid, count(*)::DOUBLE AS n FROM won w JOIN sz USING (cell), thr WHERE k < t AND len(label) = 1 GROUP BY w.cell, label[1]),
big AS (SELECT l.cell, label[1] AS gid, count(DISTINCT umi)::DOUBLE AS n FROM lab l JOIN sz USING (cell), thr WHERE k >= t AND len(label) = 1 GROUP BY l.cell, label[1])
SELECT * FROM small UNION ALL SELECT * FROM big""")
def u5_small_cells(spark, d):
    reads = base.labelled(spark, d)
    return quant.quantify(reads, "trivial", _mean_reads(reads))


_SLOT = f"""CASE WHEN x % 2 = 0 AND list_contains(label, x + 1) THEN {2 * SPLICED_GENES} + (x >> 1)
 WHEN x % 2 = 0 THEN x >> 1 WHEN NOT list_contains(label, x - 1) THEN {SPLICED_GENES} + (x >> 1) END"""
_VOTED = f"""{base.SQL_SPLICED}, {base.SQL_VOTES}, c AS (SELECT cell, label, count(*) AS n, list_filter(label, lambda x: x % 2 = 0) AS s FROM won GROUP BY ALL)"""


@query(f"""WITH {_VOTED}, t AS (SELECT cell, n, CASE WHEN len(label) = 1 THEN (label[1] >> 1) + {SPLICED_GENES} * (label[1] % 2)
 WHEN len(label) = 2 AND label[1] >> 1 = label[2] >> 1 THEN {2 * SPLICED_GENES} + (label[1] >> 1) WHEN len(label) = 2 AND len(s) = 1 THEN s[1] >> 1
 WHEN len(label) BETWEEN 3 AND 10 AND len(s) = 1 THEN (s[1] >> 1) + CASE WHEN list_contains(label, s[1] + 1) THEN {2 * SPLICED_GENES} ELSE 0 END END AS slot FROM c)
SELECT cell, slot, sum(n)::BIGINT AS n FROM t WHERE slot IS NOT NULL GROUP BY ALL""")
def u6_spliced_counts(spark, d):
    c = resolve.class_counts(resolve.votes_winner_take_all(base.spliced_labels(spark, d)))
    return resolve.spliced_counts(c, SPLICED_GENES)


@query(f"""WITH {_VOTED}, f AS (SELECT cell, n, label, unnest(label) AS x FROM c), s AS (SELECT cell, n, label, {_SLOT} AS slot FROM f),
k AS (SELECT *, count(slot) OVER (PARTITION BY cell, label) AS parts FROM s WHERE slot IS NOT NULL)
SELECT cell, slot, round(sum(n / parts), 6) AS n FROM k GROUP BY ALL""")
def u7_spliced_uniform(spark, d):
    c = resolve.class_counts(resolve.votes_winner_take_all(base.spliced_labels(spark, d)))
    return resolve.spliced_uniform(c, SPLICED_GENES).withColumn("n", F.round("n", 6))


@query(f"""WITH {_VOTED}, f AS (SELECT cell, n, label, unnest(label) AS x FROM c), s AS (SELECT cell, n, label, {_SLOT} AS slot FROM f)
SELECT cell, array_to_string(label, '|') AS label, array_to_string(list(slot ORDER BY slot) FILTER (WHERE slot IS NOT NULL), '|') AS slots, any_value(n) AS n FROM s GROUP BY cell, label""")
def u8_spliced_relabel(spark, d):
    c = resolve.class_counts(resolve.votes_winner_take_all(base.spliced_labels(spark, d)))
    return c.withColumn("slots", resolve.slots(F.col("label"), SPLICED_GENES)).select("cell", text("label").alias("label"), text("slots").alias("slots"), "n")


# ---- molecule graph, abundances ----

_MOL = f"{tables.GRAPH_SQL}, mol AS (SELECT cell, label, umi, count(*) AS n FROM greads GROUP BY ALL)"
_EDGE = f"""{_MOL}, near AS (SELECT cell, label, umi, n, ref, i, umi & ~(3::BIGINT << (2 * i)) AS masked FROM (SELECT *, unnest(label) AS ref FROM mol), range(4) x(i)),
 edge AS (SELECT DISTINCT a.cell, a.label AS la, a.umi AS ua, b.label AS lb, b.umi AS ub FROM near a JOIN near b ON a.cell = b.cell AND a.ref = b.ref AND a.i = b.i AND a.masked = b.masked
 WHERE (a.umi <> b.umi OR a.label <> b.label) AND (a.umi = b.umi OR a.n > 2 * b.n - 1 OR NOT (b.n > 2 * a.n - 1)))"""


def _molecules(spark, d):
    return tables.graph_reads(spark, d).groupBy("cell", "label", "umi").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGE} SELECT cell, array_to_string(la, '|') AS la, ua, array_to_string(lb, '|') AS lb, ub FROM edge")
def u9_graph_edges(spark, d):
    e = resolve.graph_edges(_molecules(spark, d), 4)
    return e.select("cell", text("src.label").alias("la"), F.col("src.umi").alias("ua"), text("dst.label").alias("lb"), F.col("dst.umi").alias("ub"))


@query(f"""WITH {_MOL}, e AS (SELECT a.cell, a.umi AS ua, b.umi AS ub FROM mol a JOIN mol b ON a.cell = b.cell AND a.umi = b.umi AND a.label <> b.label AND list_has_any(a.label, b.label))
SELECT cell, count(*) AS n FROM e GROUP BY cell""")
def u9_exact_edges(spark, d):
    return resolve.graph_edges(_molecules(spark, d), 4, exact=True).groupBy("cell").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_EDGE}, node AS (SELECT row_number() OVER (ORDER BY cell, label, umi) AS id, cell, label, umi FROM mol),
link AS (SELECT x.id AS a, y.id AS b FROM edge e JOIN node x ON x.cell = e.cell AND x.label = e.la AND x.umi = e.ua JOIN node y ON y.cell = e.cell AND y.label = e.lb AND y.umi = e.ub),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
root AS (SELECT a, min(b) AS r FROM reach GROUP BY a) SELECT n.cell, count(DISTINCT r.r) AS n_components, count(*) AS n_molecules FROM root r JOIN node n ON n.id = r.a GROUP BY n.cell""")
def u10_components(spark, d):
    from ..operators import kernels

    def kernel(cell, rows):
        rows = sorted(rows, key=lambda r: (r["label"], r["umi"]))
        out = kernels.molecule_graph([tuple(r["label"]) for r in rows], [r["umi"] for r in rows], [r["n"] for r in rows])
        yield len(kernels.weak_components(out)), len(rows)

    return kernels.by_cell(_molecules(spark, d), kernel, "n_components long, n_molecules long")


@query()
def u12_parsimony(spark, d):
    return quant.cover_classes(_molecules(spark, d)).select("cell", text("label").alias("label"), "n")


@query()
def u14_large_components(spark, d):
    return quant.cover_classes(_molecules(spark, d), large=8).select("cell", text("label").alias("label"), "n", "voted")


@query()
def u17_parsimony_em(spark, d):
    return quant.quantify(tables.graph_reads(spark, d), "parsimony-em", 0).withColumn("n", F.round("n", 4))


@query(f"""WITH {base.SQL_LABELLED}, {base.SQL_VOTES}, r AS (SELECT (cell * 7 + g) % 97 AS s, cell, g FROM (SELECT cell, unnest(label) AS g FROM won)),
p AS (SELECT cell, umi, array_to_string(label, '|') AS label, len(label) AS k FROM won) SELECT cell, count(*) FILTER (WHERE k = 1) AS unique_n, count(*) FILTER (WHERE k > 1) AS shared_n FROM p GROUP BY cell""")
def e4_unique_and_shared(spark, d):
    w = resolve.votes_winner_take_all(base.labelled(spark, d))
    return w.groupBy("cell").agg(F.count(F.when(F.size("label") == 1, 1)).alias("unique_n"), F.count(F.when(F.size("label") > 1, 1)).alias("shared_n"))


_KIN = "kin AS (SELECT cell, g, g AS h FROM targets)"
#: In spliced mode the ambiguous slot weighs in with the others of its gene, and they with it.
_KIN_SPLICED = f"""kin AS (SELECT a.cell, a.g, b.g AS h FROM targets a JOIN targets b ON a.cell = b.cell AND a.g % {SPLICED_GENES} = b.g % {SPLICED_GENES}
 AND (a.g = b.g OR a.g // {SPLICED_GENES} = 2 OR b.g // {SPLICED_GENES} = 2))"""


def _em_sql(kin: str = _KIN, last: bool = False) -> str:
    """em: rounds over classes cls (cell, label, n); fin: what they give, with last after one round more of the cells that settled."""
    split = """SELECT m.cell, m.g, sum(m.n * a.w / d.s) AS add FROM mm m JOIN {w} a ON a.cell = m.cell AND a.g = m.g
    JOIN (SELECT m2.cell, m2.c, sum(a2.w) AS s FROM mm m2 JOIN {w} a2 ON a2.cell = m2.cell AND a2.g = m2.g GROUP BY ALL) d ON d.cell = m.cell AND d.c = m.c WHERE d.s > 0 GROUP BY ALL"""
    weigh = "(SELECT k.cell, k.g, sum(e0.alpha) AS w FROM {t} e0 JOIN kin k ON k.cell = e0.cell AND k.h = e0.g GROUP BY ALL)"
    out = f"""targets AS (SELECT cell, g, coalesce(sum(n) FILTER (WHERE k = 1), 0)::DOUBLE AS u FROM (SELECT cell, n, len(label) AS k, unnest(label) AS g FROM cls) GROUP BY ALL),
{kin}, memb AS (SELECT cell, row_number() OVER () AS c, n, label FROM cls WHERE len(label) > 1), mm AS (SELECT cell, c, n, unnest(label) AS g FROM memb),
em(cell, g, alpha, k, done) AS (SELECT cell, g, (u + 0.5) * 1e-3, 0, false FROM targets
 UNION ALL SELECT cell, g, new, k + 1, k + 1 >= 2 AND bool_and(NOT (new > 0.01 AND abs(new - alpha) > 0.01)) OVER (PARTITION BY cell) FROM (
  SELECT e.cell, e.g, e.alpha, e.k, t.u + coalesce(x.add, 0) AS new FROM em e JOIN targets t ON t.cell = e.cell AND t.g = e.g
  LEFT JOIN ({split.format(w=weigh.format(t="em"))}) x ON x.cell = e.cell AND x.g = e.g
  WHERE NOT e.done AND e.k < 100)),
cut AS (SELECT cell, g, CASE WHEN alpha < 0.01 THEN 0 ELSE alpha END AS alpha, done FROM (SELECT cell, g, max_by(alpha, k) AS alpha, max_by(done, k) AS done FROM em GROUP BY cell, g))"""
    if not last:
        return out + ", fin AS (SELECT cell, g, alpha AS n FROM cut)"
    return out + f""", fin AS (SELECT c.cell, c.g, CASE WHEN c.done THEN t.u + coalesce(x.add, 0) ELSE c.alpha END AS n FROM cut c JOIN targets t ON t.cell = c.cell AND t.g = c.g
 LEFT JOIN ({split.format(w=weigh.format(t="cut"))}) x ON x.cell = c.cell AND x.g = c.g)"""


_EM_OUT = "SELECT cell, g AS gid, round(n, 4) AS n FROM fin WHERE n >= 0.01"
_CLASSES = "cls AS (SELECT cell, label, count(*) AS n FROM won GROUP BY ALL)"


@query(f"WITH RECURSIVE {base.SQL_LABELLED}, {base.SQL_VOTES}, {_CLASSES}, {_em_sql()} {_EM_OUT}")
def e1_expectation_maximisation(spark, d):
    return quant.abundances(resolve.class_counts(resolve.votes_winner_take_all(base.labelled(spark, d)))).withColumn("n", F.round("n", 4))


@query(f"WITH RECURSIVE {_VOTED}, f AS (SELECT cell, n, label, unnest(label) AS x FROM c), s AS (SELECT cell, n, label, {_SLOT} AS slot FROM f), cls AS (SELECT cell, list(slot ORDER BY slot) AS label, any_value(n) AS n FROM s WHERE slot IS NOT NULL GROUP BY cell, s.label), {_em_sql(_KIN_SPLICED, True)} {_EM_OUT}")
def e3_spliced_em(spark, d):
    return quant.quantify(base.spliced_labels(spark, d), "cr-like-em", 0, genes=SPLICED_GENES).withColumn("n", F.round("n", 4))


@query()
def e6_bootstrap(spark, d):
    c = resolve.class_counts(resolve.votes_winner_take_all(base.labelled(spark, d)))
    return quant.replicate_summary(quant.replicates(c, 5), 5)


@query(f"WITH RECURSIVE {base.SQL_LABELLED}, {base.SQL_VOTES}, {_CLASSES}, {_em_sql(last=True)} {_EM_OUT}")
def e7_infer(spark, d):
    ids, matrix = resolve.dictionary(resolve.class_counts(resolve.votes_winner_take_all(base.labelled(spark, d))))
    return quant.infer(matrix, ids).withColumn("n", F.round("n", 4))


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, [l_quantity::INTEGER, (l_quantity::INTEGER * 7 + 3) % 50] AS s, [900, 1500] AS e, [1000, 1800] AS t FROM lineitem),
p AS (SELECT id, line, list_transform(range(1, 3), lambda i: exp((s[i] - list_max(s)) / 5.0) * exp(greatest(-(greatest(t[i] - e[i] - 100, 0) ** 2) / 20000.0, -6.907755278982137))) AS w FROM r)
SELECT id, line, round(w[1] / (w[1] + w[2]), 6) AS p1, round(w[2] / (w[1] + w[2]), 6) AS p2 FROM p""")
def u16_alignment_probabilities(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    q = F.col("l_quantity").cast("int")
    p = quant.alignment_probabilities(F.array(q, (q * 7 + 3) % 50), F.array(F.lit(900), F.lit(1500)), F.array(F.lit(1000), F.lit(1800)))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), p.alias("p")).select("id", "line", F.round(F.col("p")[0], 6).alias("p1"), F.round(F.col("p")[1], 6).alias("p2"))


@query()
def u15_long_reads(spark, d):
    r = tables.graph_reads(spark, d).withColumn("s", F.transform("label", lambda t: ((t * 7 + F.col("umi")) % 50).cast("int")))
    p = quant.alignment_probabilities(F.col("s"), F.transform("label", lambda t: (t * 13 + 800).cast("int")), F.transform("label", lambda t: F.lit(1200)))
    return quant.long_read_counts(r.withColumn("probs", p)).withColumn("n", F.round("n", 4))


# ---- a named transcript-to-gene map, and several samples ----

_MAP = "first AS (SELECT p_partkey % 200 AS tid, arg_min(p_brand, p_partkey) AS gene FROM part GROUP BY 1), t2g AS (SELECT tid, dense_rank() OVER (ORDER BY gene) - 1 AS gid FROM first)"
_NAMED = f"{tables.READS_SQL}, {_MAP}, lab AS (SELECT cell, umi, (SELECT list_sort(list(DISTINCT gid)) FROM t2g WHERE list_contains(r.refs, tid)) AS label FROM reads r)"


def _brand_genes(spark, d, transcripts: int = 200):
    """tid, gid: a transcript's gene is the brand of its first part, numbered by name."""
    first = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % transcripts).alias("tid")).agg(F.min_by("p_brand", "p_partkey").alias("gene"))
    names = first.select("gene").distinct().select("gene", (F.row_number().over(W.orderBy("gene")) - 1).alias("gid"))  # a row for each brand
    return first.join(names, "gene").select("tid", "gid")


def _named(spark, d, resolution: str):
    return quant.quantify(tables.graph_reads(spark, d), resolution, 0, t2g=_brand_genes(spark, d, 16)).withColumn("n", F.round("n", 4))


@query(f"WITH {_NAMED}, {base.SQL_VOTES} SELECT cell, label[1] AS gid, count(*)::DOUBLE AS n FROM won WHERE len(label) = 1 GROUP BY ALL")
def u17_cr_like_named_genes(spark, d):
    return quant.quantify(tables.reads(spark, d).select("cell", "umi", F.col("refs").alias("label")), "cr-like", 0, t2g=_brand_genes(spark, d))


@query(f"WITH RECURSIVE {_NAMED}, {base.SQL_VOTES}, {_CLASSES}, {_em_sql()} {_EM_OUT}")
def u17_cr_like_em(spark, d):
    return quant.quantify(tables.reads(spark, d).select("cell", "umi", F.col("refs").alias("label")), "cr-like-em", 0, t2g=_brand_genes(spark, d)).withColumn("n", F.round("n", 4))


@query()
def u17_parsimony(spark, d):
    return _named(spark, d, "parsimony")


@query()
def u17_parsimony_gene(spark, d):
    return _named(spark, d, "parsimony-gene")


@query()
def u17_parsimony_gene_em(spark, d):
    return _named(spark, d, "parsimony-gene-em")


_SAMPLED = f"""{tables.READS_SQL}, lab AS (SELECT sample, cell, umi, list_sort(list_distinct(list_transform(refs, lambda t: t // {GENES_OF}))) AS label FROM reads),
votes AS (SELECT sample, cell, umi, g, count(*) AS v FROM (SELECT sample, cell, umi, unnest(label) AS g FROM lab) GROUP BY ALL),
won AS (SELECT sample, cell, umi, list(g ORDER BY g) AS label FROM (SELECT *, max(v) OVER (PARTITION BY sample, cell, umi) AS top FROM votes) WHERE v = top GROUP BY sample, cell, umi),
c AS (SELECT sample, cell, label[1] AS gid, count(*)::DOUBLE AS n FROM won WHERE len(label) = 1 GROUP BY ALL)"""
_BY_SAMPLE = ("sample", "cell")


def _sample_counts(spark, d):
    return quant.quantify(tables.reads(spark, d).select("sample", "cell", "umi", F.col("refs").alias("label")), "cr-like", 0, transcripts_per_gene=GENES_OF, keys=_BY_SAMPLE)


@query(f"WITH {_SAMPLED} SELECT sample, cell, gid, n FROM c")
def q_samples(spark, d):
    """Equal cell barcodes of different samples stay apart."""
    return _sample_counts(spark, d)


@query(f"""WITH {_SAMPLED}, m AS (SELECT sample, cell, count(*) AS mapped_reads FROM lab GROUP BY ALL), u AS (SELECT sample, cell, count(*) AS k FROM reads WHERE NOT fw GROUP BY ALL),
p AS (SELECT sample, cell, sum(n) AS dedup, count(*) AS genes FROM c GROUP BY ALL)
SELECT sample, cell, mapped_reads + coalesce(k, 0) AS corrected_reads, mapped_reads, coalesce(dedup, 0) AS deduplicated_reads, coalesce(dedup, 0) / mapped_reads AS dedup_rate, coalesce(genes, 0) AS num_genes_expressed
FROM m LEFT JOIN u USING (sample, cell) LEFT JOIN p USING (sample, cell)""")
def q_sample_features(spark, d):
    reads = tables.reads(spark, d)
    out = quant.features(_sample_counts(spark, d), permit.histogram(reads, _BY_SAMPLE), permit.histogram(reads.filter("not fw"), _BY_SAMPLE), _BY_SAMPLE)
    return out.select("sample", "cell", "corrected_reads", "mapped_reads", "deduplicated_reads", "dedup_rate", "num_genes_expressed")


@query(f"""WITH {base.SQL_LABELLED}, {base.SQL_VOTES}, {_SMALL}, c AS (SELECT cell, count(*) FILTER (WHERE len(label) = 1) AS k1 FROM won GROUP BY cell)
SELECT s.cell, s.k AS n_reads, s.k < t AS tiny, false AS voted, coalesce(k1, 0) = 0 AS empty FROM sz s LEFT JOIN c USING (cell), thr""")
def k8_resolved_lists(spark, d):
    """Which cells were resolved in another way, and which have no counts."""
    reads = base.labelled(spark, d)
    found = quant.molecules(reads, "cr-like", _mean_reads(reads))
    return quant.resolved_lists(found, quant.counts_of(found, "cr-like"))


@query(f"""WITH {base.SQL_LABELLED}, {base.SQL_VOTES}, c AS (SELECT cell, label[1] AS gid, count(*)::DOUBLE AS n FROM won WHERE len(label) = 1 GROUP BY ALL),
m AS (SELECT cell, count(*) AS mapped_reads FROM lab GROUP BY cell), u AS (SELECT cell, count(*) AS k FROM reads WHERE NOT fw GROUP BY cell),
p AS (SELECT cell, sum(n) AS deduplicated_reads, max(n) AS top, count(*) AS num_genes_expressed, avg(n) AS mean FROM c GROUP BY cell),
o AS (SELECT c.cell, count(*) AS num_genes_over_mean FROM c JOIN p USING (cell) WHERE n > mean GROUP BY c.cell)
SELECT cell, mapped_reads + coalesce(k, 0) AS corrected_reads, mapped_reads, deduplicated_reads, mapped_reads::DOUBLE / (mapped_reads + coalesce(k, 0)) AS mapping_rate,
deduplicated_reads / mapped_reads AS dedup_rate, deduplicated_reads / num_genes_expressed / top AS mean_by_max, num_genes_expressed, coalesce(num_genes_over_mean, 0) AS num_genes_over_mean
FROM m JOIN p USING (cell) LEFT JOIN u USING (cell) LEFT JOIN o USING (cell)""")
def a10_cell_features(spark, d):
    reads = tables.reads(spark, d)
    counts = quant.quantify(reads.select("cell", "umi", F.col("refs").alias("label")), "cr-like", 0, transcripts_per_gene=GENES_OF)
    return quant.features(counts, permit.histogram(reads, ("cell",)), permit.histogram(reads.filter("not fw"), ("cell",)))


@query(f"""WITH {base.SQL_LABELLED}, {base.SQL_VOTES}, a AS (SELECT cell, label[1] AS gid, count(*)::DOUBLE AS n FROM won WHERE len(label) = 1 GROUP BY ALL),
b AS (SELECT cell, label[1] AS gid, count(DISTINCT umi)::DOUBLE AS n FROM lab WHERE len(label) = 1 GROUP BY ALL)
SELECT sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS total, count(*) FILTER (WHERE b.n IS NULL) AS only_one, count(*) FILTER (WHERE a.n IS NULL) AS only_two FROM a FULL JOIN b ON a.cell = b.cell AND a.gid = b.gid""")
def j11_count_difference(spark, d):
    reads = base.labelled(spark, d)
    return quant.difference(quant.quantify(reads, "cr-like", 0), quant.quantify(reads, "trivial", 0))


@query(f"""WITH {base.SQL_LABELLED}, {base.SQL_VOTES}, c AS (SELECT cell, label[1] AS gid, count(*) AS n FROM won WHERE len(label) = 1 GROUP BY ALL)
SELECT '%%MatrixMarket matrix coordinate integer general' AS value UNION ALL SELECT '256 50 ' || count(*) FROM c UNION ALL SELECT (cell + 1) || ' ' || (gid + 1) || ' ' || n FROM c""")
def k3_matrix_lines(spark, d):
    c = quant.quantify(base.labelled(spark, d), "cr-like", 0).select(F.col("cell").alias("row"), F.col("gid").alias("col"), "n")
    return sinks.matrix_lines(c, 256, 50, "integer")


# ---- alignments ----


@query(f"""WITH {tables.READS_SQL}, v AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag <> 'R' AS fw, l_orderkey % 256 AS bc,
 list_sort(list_distinct(CASE WHEN l_linestatus = 'F' THEN [l_partkey % 200, (l_partkey + l_linenumber) % 200] ELSE [l_partkey % 200] END)) AS refs FROM lineitem),
x AS (SELECT id, bc, fw, len(refs) AS nh, unnest(refs) AS tid, generate_subscripts(refs, 1) AS hi FROM v)
SELECT id, hi::INTEGER AS hi, nh::INTEGER AS nh, list_aggregate(list_transform(range(4), lambda i: substr('ACGT', 1 + ((bc >> (2 * (3 - i))) & 3)::INTEGER, 1)), 'string_agg', '') AS cb,
 list_aggregate(list_transform(range(4), lambda i: substr('ACGT', 1 + ((bc >> (2 * (3 - i))) & 3)::INTEGER, 1)), 'string_agg', '') AS umi, CASE WHEN fw THEN 'fw' ELSE 'rc' END AS dir, 'tx' || tid AS name FROM x""")
def k17_view(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    refs = F.when(F.col("l_linestatus") == "F", F.array(F.col("l_partkey") % 200, (F.col("l_partkey") + F.col("l_linenumber")) % 200)).otherwise(F.array(F.col("l_partkey") % 200))
    r = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") != "R").alias("fw"), (F.col("l_orderkey") % 256).alias("bc"), F.array_sort(F.array_distinct(refs)).alias("refs"))
    r = r.withColumn("umi", F.col("bc")).withColumn("dirs", F.transform("refs", lambda x: F.col("fw")))
    names = spark.range(200).select(F.col("id").alias("tid"), F.concat(F.lit("tx"), F.col("id")).alias("name"))
    return R.view(r, names, 4, 4)


def _alignments(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    bc = dna.unpack(F.col("l_orderkey") % 4096, BASES)
    flag = F.when(F.col("l_linenumber") == 7, 4).when(F.col("l_linenumber") == 6, 2048).when(F.col("l_returnflag") == "R", 16).otherwise(0)
    cb = F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("N"), F.substring(bc, 2, 5))).when(F.col("l_orderkey") % 11 == 0, F.lit("NNACGT")).otherwise(bc)
    return li.select(F.col("l_orderkey").alias("qname"), flag.alias("flag"), (F.col("l_partkey") % 200).alias("tid"), F.col("l_quantity").cast("int").alias("score"), cb.alias("cb"), F.substring(bc, 3, 4).alias("ub"))


def _convert_sql(best: bool) -> str:
    return f"""WITH a AS (SELECT l_orderkey AS q, l_linenumber AS ln, l_partkey % 200 AS tid, l_quantity::INTEGER AS score, l_returnflag <> 'R' AS fw FROM lineitem WHERE l_linenumber < 6 AND (l_orderkey % 5 = 0 OR l_orderkey % 11 <> 0)),
    b AS (SELECT *, max(score) OVER (PARTITION BY q) AS top FROM a)
    SELECT q AS qname, CASE WHEN q % 5 = 0 THEN q % 1024 ELSE q % 4096 END AS bc, q % 256 AS umi, count(*) AS n, sum(tid)::BIGINT AS tids, count(*) FILTER (WHERE fw) AS n_fw FROM b {'WHERE score = top' if best else ''} GROUP BY q"""


def _converted(spark, d, best):
    r = R.convert(_alignments(spark, d), best)
    return r.select("qname", "bc", "umi", F.size("refs").cast("long").alias("n"), F.aggregate("refs", F.lit(0).cast("long"), lambda a, x: a + x).alias("tids"), F.size(F.filter("dirs", lambda x: x)).cast("long").alias("n_fw"))


@query(_convert_sql(False))
def p3_convert(spark, d):
    return _converted(spark, d, False)


@query(_convert_sql(True))
def p4_convert_best(spark, d):
    return _converted(spark, d, True)


# ---- fragments ----


@query(f"WITH {tables.ATAC_SQL} SELECT chr, start // 100000 AS bin, count(*) AS n FROM areads WHERE na = 1 GROUP BY ALL")
def a12_genome_bins(spark, d):
    return atac.bins(tables.atac_reads(spark, d))


@query("""WITH l AS (SELECT l_suppkey % 25 AS chr, max((l_quantity * 1000)::BIGINT * (1 + l_suppkey % 25)) AS len FROM lineitem GROUP BY 1)
SELECT chr, (len + 99999) // 100000 AS n_bins, coalesce(sum((len + 99999) // 100000) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_bin FROM l""")
def s19_bin_offsets(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    length = (F.col("l_quantity") * 1000).cast("long") * (1 + F.col("l_suppkey") % 25)
    return atac.bin_offsets(li.groupBy((F.col("l_suppkey") % 25).alias("chr")).agg(F.max(length).alias("len")))


_FRAGS = f"{tables.ATAC_SQL}, f AS (SELECT chr, start, frag_len, bc, count(*) AS n FROM areads WHERE na = 1 GROUP BY ALL HAVING frag_len < 2000)"


@query(f"WITH {_FRAGS} SELECT * FROM f")
def a13_fragments(spark, d):
    return atac.ordered(atac.fragments(tables.atac_reads(spark, d)))


@query(f"WITH {tables.ATAC_SQL} SELECT chr, start, frag_len, bc, count(*) AS n FROM areads WHERE na = 1 AND type = 4 GROUP BY ALL HAVING frag_len < 2000")
def p8_paired_fragments(spark, d):
    return atac.fragments(tables.atac_reads(spark, d), proper_pairs=True)


@query(f"WITH {tables.ATAC_SQL} SELECT count(*) FILTER (WHERE na = 0) AS n_unmapped, count(*) FILTER (WHERE na > 1) AS n_multi, count(*) FILTER (WHERE na = 1 AND type <> 4) AS n_not_paired FROM areads")
def p7_dropped_reads(spark, d):
    return atac.dropped(tables.atac_reads(spark, d))


@query(f"""WITH {_FRAGS} SELECT 'chr' || chr || chr(9) || start || chr(9) || (start + frag_len) || chr(9) || substr('ACGT', 1 + ((bc >> 2) & 3)::INTEGER, 1) || substr('ACGT', 1 + (bc & 3)::INTEGER, 1) || chr(9) || n AS value FROM f""")
def k15_bed_lines(spark, d):
    names = spark.range(25).select(F.col("id").alias("chr"), F.concat(F.lit("chr"), F.col("id")).alias("name"))
    return sinks.bed_lines(atac.fragments(tables.atac_reads(spark, d)), names, 2)


# ---- all together ----


@query(f"""WITH {base.SQL_PLAN}, lab AS (SELECT p.corrected AS cell, umi, list_sort(list_distinct(list_transform(refs, lambda t: t // {GENES_OF}))) AS label FROM reads r JOIN plan p ON r.bc = p.observed WHERE r.fw AND p.corrected IS NOT NULL),
{base.SQL_VOTES} SELECT cell, label[1] AS gid, count(*)::DOUBLE AS n FROM won WHERE len(label) = 1 GROUP BY ALL""")
def flagship(spark, d):
    """Reads to counts: histogram, retained cells, correction, collation, votes."""
    reads = R.oriented(tables.reads(spark, d), "fw")
    cells = collate.collate(reads.drop("cell"), correct.accepted(base.plan(spark, d)[2]))
    return quant.quantify(cells.select("cell", "umi", F.col("refs").alias("label")), "cr-like", 0, transcripts_per_gene=GENES_OF)
