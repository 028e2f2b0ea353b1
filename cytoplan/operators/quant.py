"""Quantification: a resolution strategy composed of the relational rules and the per-cell kernels, and per-cell metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resolve
from .kernels import Rows, bootstrap, by_cell, expectation_maximisation, genes_by_rows, parsimony, weighted_parsimony

RESOLUTIONS = ("trivial", "cr-like", "cr-like-em", "parsimony", "parsimony-em", "parsimony-gene", "parsimony-gene-em")


def check_options(resolution: str, umi_edit_distance: int | None = None, bootstraps: int = 0, dump_classes: bool = False, spliced: bool = False) -> None:
    """Options that do not go together raise ValueError."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"no resolution {resolution!r}")
    if umi_edit_distance not in (None, 0, 1) or (umi_edit_distance == 1 and not resolution.startswith("parsimony")):
        raise ValueError("an edit distance of 1 needs a parsimony resolution")
    if bootstraps and not resolution.endswith("-em"):
        raise ValueError("bootstraps need an -em resolution")
    if dump_classes and resolution == "trivial":
        raise ValueError("trivial has no classes")
    if spliced and (bootstraps or resolution == "trivial"):
        raise ValueError("spliced mode has neither bootstraps nor trivial")


def seed_of(cell: tuple) -> int:
    """A seed that depends on the cell alone."""
    return int.from_bytes(hashlib.md5(repr(tuple(cell)).encode()).digest()[:8], "little")


CELL = resolve.CELL


def _spread(keys: tuple[str, ...], rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*keys, *(c for c in columns if c in rows.columns))


def cover_classes(molecules: DataFrame, exact: bool = False, large: int = 1000, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, label, n, voted: gene classes of molecules (cell, label, umi, n) by parsimonious cover of their graph.

    A column genes holds the gene of each reference of the label; without it a reference is a gene. voted: the cell has a component of
    more than `large` molecules that went by votes.
    """

    def kernel(cell: object, rows: Rows) -> Iterator[tuple]:
        found, voted = parsimony(rows, genes_by_rows(rows), exact, large)
        for label, n in sorted(found.items()):
            yield list(label), n, voted

    return by_cell(_spread(keys, molecules, "label", "umi", "n", "genes"), kernel, "label array<long>, n long, voted boolean", keys)


def abundances(classes: DataFrame, init: str = "informative", axis: int | None = None, last_round: bool = False, usa: int = 0, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, gid, n: expectation maximisation over each cell's classes (cell, label, n)."""

    def kernel(cell: object, rows: Rows) -> Iterator[tuple]:
        found = expectation_maximisation([(tuple(r["label"]), r["n"]) for r in rows], init, axis, last_round, usa)
        yield from sorted(found.items())

    return by_cell(_spread(keys, classes, "label", "n"), kernel, "gid long, n double", keys)


def long_read_counts(reads: DataFrame, exact: bool = False, large: int = 1000, keys: tuple[str, ...] = CELL, by_place: bool = False) -> DataFrame:
    """cell, gid, n of long reads (cell, umi, label, probs[, genes]): weighted cover, then expectation maximisation with mean probabilities.

    A molecule's probabilities are the means over its reads, by place in the label. by_place: see weighted_parsimony.
    """
    held = [c for c in ("genes",) if c in reads.columns]
    one = reads.select(*keys, "label", "umi", *held, F.posexplode("probs").alias("i", "p"))
    mean = one.groupBy(*keys, "label", "umi", *held, "i").agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    molecules = mean.groupBy(*keys, "label", "umi", *held).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("probs"))

    def kernel(cell: object, rows: Rows) -> Iterator[tuple]:
        found = sorted(weighted_parsimony(rows, genes_by_rows(rows), exact, large, by_place).items())
        n = expectation_maximisation([(label, k) for label, (k, _) in found], probs=[p for _, (_, p) in found])
        yield from sorted(n.items())

    return by_cell(molecules, kernel, "gid long, n double", keys)


def replicates(classes: DataFrame, count: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, replicate, gid, n: bootstrap abundances, seeded by the cell."""

    def kernel(cell: object, rows: Rows) -> Iterator[tuple]:
        for i, found in enumerate(bootstrap([(tuple(r["label"]), r["n"]) for r in rows], count, seed_of(cell))):
            for gid, n in sorted(found.items()):
                yield i, gid, n

    return by_cell(_spread(keys, classes, "label", "n"), kernel, "replicate int, gid long, n double", keys)


def replicate_summary(rows: DataFrame, count: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, gid, mean, var_pop, var_samp over all replicates; a replicate without the gene counts as 0."""
    s = rows.groupBy(*keys, "gid").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    mean = F.col("s") / count
    pop = F.greatest(F.col("q") / count - mean * mean, F.lit(0.0))
    return s.select(*keys, "gid", mean.alias("mean"), pop.alias("var_pop"), (pop * count / max(count - 1, 1)).alias("var_samp"))


@dataclass(frozen=True)
class Molecules:
    """What quantification leaves before counts: classes (cell, label, n), and for each cell how it was resolved (cell, n_reads, tiny, voted)."""

    classes: DataFrame
    tiny: DataFrame
    cells: DataFrame


def gene_labels(reads: DataFrame, t2g: DataFrame | None = None, transcripts_per_gene: int = 1) -> DataFrame:
    """Reads (label of transcripts) with genes, the gene of each transcript of the label.

    t2g (tid, gid) is joined with the distinct labels, which are far fewer than reads; a label with a transcript that the map lacks raises.
    Without a map a gene is its transcripts' number divided by transcripts_per_gene.
    """
    if t2g is None:
        return reads.withColumn("genes", F.transform("label", lambda t: F.floor(t / transcripts_per_gene).cast("long")))
    labels = reads.select("label").distinct()
    one = labels.select("label", F.posexplode("label").alias("i", "tid")).join(t2g.select("tid", F.col("gid").cast("long").alias("gid")), "tid", "left")
    gid = F.coalesce("gid", F.raise_error(F.concat(F.lit("no gene for transcript "), F.col("tid").cast("string"))).cast("long"))
    genes = one.select("label", "i", gid.alias("gid")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "gid"))), lambda x: x["gid"]).alias("genes"))
    return reads.join(genes, "label")


def molecules(
    reads: DataFrame, resolution: str = "cr-like", small_threshold: int = 100, umi_edit_distance: int | None = None, large: int = 1000, prefer_ambiguous: bool = False, t2g: DataFrame | None = None, transcripts_per_gene: int = 1,
    keys: tuple[str, ...] = CELL,
) -> Molecules:
    """Gene classes of reads (cell, umi, label of transcripts) by a resolution, and the cells with how each was resolved."""
    check_options(resolution, umi_edit_distance)
    mapped = t2g is not None or transcripts_per_gene > 1
    both = gene_labels(reads.select(*keys, "umi", "label"), t2g, transcripts_per_gene) if mapped else reads.select(*keys, "umi", "label", F.col("label").alias("genes"))
    both = resolve.small_cells(both, 0 if prefer_ambiguous else small_threshold, keys)
    by_gene = lambda rows: rows.select(*keys, "umi", F.array_sort(F.array_distinct("genes")).alias("label"))
    vote = resolve.votes_prefer_ambiguous if prefer_ambiguous else resolve.votes_winner_take_all
    rest = both.filter("not small")
    voted = None
    if resolution == "trivial":
        main = resolve.trivial(by_gene(rest), keys).select(*keys, F.array("gid").alias("label"), "n")
    elif resolution.startswith("cr-like"):
        main = resolve.class_counts(vote(by_gene(rest), keys), keys)
    else:
        source = by_gene(rest) if "gene" in resolution else rest.select(*keys, "umi", "label", "genes")
        held = [c for c in ("genes",) if c in source.columns]
        found = cover_classes(source.groupBy(*keys, "label", "umi", *held).agg(F.count("*").alias("n")), umi_edit_distance == 0, large, keys)
        main, voted = found.drop("voted"), found.groupBy(*keys).agg(F.max("voted").alias("voted"))
    cells = both.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.max("small").alias("tiny"))
    cells = cells.join(voted, list(keys), "left").withColumn("voted", F.coalesce("voted", F.lit(False))) if voted is not None else cells.withColumn("voted", F.lit(False))
    tiny = resolve.class_counts(resolve.votes_winner_take_all(by_gene(both.filter("small")), keys), keys)
    return Molecules(main, tiny, cells)


def counts_of(found: Molecules, resolution: str, genes: int = 0, init: str = "informative", axis: int | None = None, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, gid, n of resolved molecules; tiny cells count unique classes only."""
    return _counts(found.classes, resolution.endswith("-em"), genes, init, axis, keys).unionByName(_counts(found.tiny, False, genes, init, axis, keys))


def quantify(
    reads: DataFrame, resolution: str = "cr-like", small_threshold: int = 100, genes: int = 0, transcripts_per_gene: int = 1, umi_edit_distance: int | None = None, large: int = 1000, prefer_ambiguous: bool = False,
    t2g: DataFrame | None = None, keys: tuple[str, ...] = CELL, init: str = "informative", axis: int | None = None,
) -> DataFrame:
    """cell, gid, n from reads (cell, umi, label of transcripts).

    keys names the columns that tell cells apart; with several samples, equal barcodes of different samples are different cells.
    t2g (tid, gid) maps transcripts to genes; without it gid is tid divided by transcripts_per_gene. Cells of fewer than small_threshold
    reads go by votes whatever the resolution (0: none do). genes > 0 is spliced mode: genes of the map are splicing forms (2 g,
    2 g + 1) and gid is a slot of 3 * genes.
    """
    check_options(resolution, umi_edit_distance, spliced=genes > 0)
    small = 0 if prefer_ambiguous else small_threshold
    found = molecules(reads, resolution, small, umi_edit_distance, large, prefer_ambiguous, t2g, transcripts_per_gene, keys)
    main = _counts(found.classes, resolution.endswith("-em"), genes, init, axis, keys)
    return main if small <= 0 else main.unionByName(_counts(found.tiny, False, genes, init, axis, keys))


def _counts(classes: DataFrame, em: bool, genes: int, init: str, axis: int | None, keys: tuple[str, ...]) -> DataFrame:
    if em:
        if not genes:
            return abundances(classes, init, axis, keys=keys)
        return abundances(classes.select(*keys, resolve.slots(F.col("label"), genes).alias("label"), "n"), init, axis, last_round=True, usa=genes, keys=keys)
    if genes:
        return resolve.spliced_counts(classes, genes, keys).select(*keys, F.col("slot").alias("gid"), F.col("n").cast("double").alias("n"))
    return resolve.unique_only(classes, keys).withColumn("n", F.col("n").cast("double"))


def features(counts: DataFrame, mapped: DataFrame, unmapped: DataFrame | None = None, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Per-cell metrics of counts (cell, gid, n) and mapped reads (cell, n).

    corrected_reads adds unmapped reads (cell, n); mapping_rate is mapped / corrected, dedup_rate is molecules / mapped (0 for a cell
    without counts). mean_by_max is the mean of the expressed genes by the greatest, NaN for a cell without counts.
    """
    by = list(keys)
    c = counts.filter("n > 0")
    per = c.groupBy(*keys).agg(F.sum("n").alias("dedup"), F.max("n").alias("top"), F.count("*").alias("num_genes"))
    over = c.join(per.select(*keys, (F.col("dedup") / F.col("num_genes")).alias("mean")), by).filter("n > mean").groupBy(*keys).agg(F.count("*").alias("num_over_mean"))
    m = mapped.select(*keys, F.col("n").alias("mapped_reads"))
    if unmapped is not None:
        m = m.join(unmapped.select(*keys, F.col("n").alias("u")), by, "left").select(*keys, "mapped_reads", (F.col("mapped_reads") + F.coalesce("u", F.lit(0))).alias("corrected_reads"))
    else:
        m = m.withColumn("corrected_reads", F.col("mapped_reads"))
    out = m.join(per, by, "left").join(over, by, "left")
    dedup, genes, nan = F.coalesce("dedup", F.lit(0.0)), F.coalesce("num_genes", F.lit(0)), F.lit(float("nan"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(nan)
    return out.select(
        *keys,
        "corrected_reads",
        "mapped_reads",
        dedup.alias("deduplicated_reads"),
        ratio(F.col("mapped_reads").cast("double"), F.col("corrected_reads")).alias("mapping_rate"),
        ratio(dedup, F.col("mapped_reads")).alias("dedup_rate"),
        ratio(dedup / F.greatest(genes, F.lit(1)), F.coalesce("top", F.lit(0.0))).alias("mean_by_max"),
        genes.alias("num_genes_expressed"),
        F.coalesce("num_over_mean", F.lit(0)).alias("num_genes_over_mean"),
    )


def resolved_lists(found: Molecules, counts: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """keys, n_reads, tiny, voted, empty for each cell: resolved by votes for its few reads, in a large component, or left without counts."""
    some = counts.filter("n > 0").select(*keys).distinct().withColumn("__some", F.lit(True))
    return found.cells.join(some, list(keys), "left").select(*keys, "n_reads", "tiny", "voted", F.col("__some").isNull().alias("empty"))


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: the sum of absolute differences of two count tables (cell, gid, n), and entries that only one of them has."""
    a, b = one.select("cell", "gid", F.col("n").alias("a")), two.select("cell", "gid", F.col("n").alias("b"))
    both = a.join(b, ["cell", "gid"], "full_outer")
    gap = F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return both.agg(F.sum(gap).alias("total"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_one"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_two"))


def alignment_probabilities(scores: Column, ends: Column, lengths: Column) -> Column:
    """Each alignment's probability within its read: by its score's distance from the best, and by how far from the end it stops.

    exp((score - best) / 5) times exp(-x^2 / (2 * 100^2)), but not below 1e-3, for x the bases beyond 100 before the end; they add up to 1.
    """
    best = F.array_max(scores)
    by_score = F.transform(scores, lambda s: F.exp((s - best) / 5.0))
    far = F.zip_with(lengths, ends, lambda n, e: F.greatest(n - e - 100, F.lit(0)).cast("double"))
    by_end = F.transform(far, lambda x: F.exp(F.greatest(-x * x / 20000.0, F.lit(-6.907755278982137))))
    raw = F.zip_with(by_score, by_end, lambda a, b: a * b)
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raw, lambda x: x / total)


def infer(matrix: DataFrame, labels: DataFrame, usa: int = 0, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, gid, n by expectation maximisation on a stored matrix (cell, eqid, n) and its labels (eqid, label)."""
    return abundances(matrix.join(labels, "eqid").select(*keys, "label", "n"), last_round=True, usa=usa, keys=keys)
