"""Molecules from reads by exact and vote-based rules, and spliced / unspliced / ambiguous counts. All relational.

Reads are rows (cell, umi, label) with label the sorted distinct genes of a read; classes are rows (cell, label, n). `keys` names the
columns that tell cells apart, such as sample and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


CELL = ("cell",)


def classes(reads: DataFrame, label: str = "label", keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, label, umi, n: reads with the same label and molecular identifier."""
    return reads.groupBy(*keys, F.col(label).alias("label"), "umi").agg(F.count("*").alias("n"))


def class_counts(molecules: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, label, n: molecules by label."""
    return molecules.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def dictionary(counts: DataFrame, keys: tuple[str, ...] = CELL) -> tuple[DataFrame, DataFrame]:
    """(label, eqid) over all cells and (cell, eqid, n). Ids count the labels in order, from 0.

    A label's id is its rank among the labels that begin with the same two genes, plus the labels that begin with lesser ones. So ids
    depend on the labels alone, no task orders more than the labels of one such beginning, and the running sums see one row each.
    """
    labels = counts.select("label").distinct().withColumn("one", F.get("label", F.lit(0))).withColumn("two", F.coalesce(F.get("label", F.lit(1)), F.lit(-1)))
    before = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_two = labels.groupBy("one", "two").agg(F.count("*").alias("k"))
    by_one = by_two.groupBy("one").agg(F.sum("k").alias("k"))
    low = by_one.select("one", before(W.orderBy("one")).alias("low"))  # a row for each gene
    base = by_two.withColumn("mid", before(W.partitionBy("one").orderBy("two"))).join(low, "one").select("one", "two", (F.col("low") + F.col("mid")).alias("base"))
    rank = F.row_number().over(W.partitionBy("one", "two").orderBy("label")) - 1
    ids = labels.withColumn("rank", rank).join(base, ["one", "two"]).select("label", (F.col("base") + F.col("rank")).cast("long").alias("eqid"))
    return ids, counts.join(ids, "label").select(*keys, "eqid", "n")


def trivial(reads: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, gid, n: distinct identifiers of each gene over reads of one gene; reads of several genes go."""
    return reads.filter(F.size("label") == 1).select(*keys, "umi", F.col("label")[0].alias("gid")).groupBy(*keys, "gid").agg(F.countDistinct("umi").alias("n"))


def _winners(votes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """cell, umi, label: the genes of the most votes, from (cell, umi, gid, v). One aggregation: the best set per identifier is small."""
    ranked = votes.groupBy(*keys, "umi").agg(F.max("v").alias("top"), F.collect_list(F.struct("gid", "v")).alias("all"))
    best = F.transform(F.filter("all", lambda x: x["v"] == F.col("top")), lambda x: x["gid"])
    return ranked.select(*keys, "umi", F.array_sort(best).alias("label"))


def votes_winner_take_all(reads: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, umi, label: each identifier goes to the gene that most of its reads contain; ties keep all the tied genes."""
    v = reads.select(*keys, "umi", F.explode("label").alias("gid")).groupBy(*keys, "umi", "gid").agg(F.count("*").alias("v"))
    return _winners(v, keys)


def votes_prefer_ambiguous(reads: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """As votes_winner_take_all, but the votes of a gene's spliced and unspliced forms add up, and a winner keeps the forms seen."""
    one = reads.select(*keys, "umi", F.explode("label").alias("gid"))
    g = one.groupBy(*keys, "umi", F.shiftright("gid", 1).alias("gene")).agg(F.count("*").alias("v"), F.collect_set("gid").alias("forms"))
    ranked = g.groupBy(*keys, "umi").agg(F.max("v").alias("top"), F.collect_list(F.struct("v", "forms")).alias("all"))
    best = F.flatten(F.transform(F.filter("all", lambda x: x["v"] == F.col("top")), lambda x: x["forms"]))
    return ranked.select(*keys, "umi", F.array_sort(best).alias("label"))


def unique_only(counts: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, gid, n: classes of one gene."""
    return counts.filter(F.size("label") == 1).select(*keys, F.col("label")[0].alias("gid"), "n")


def spliced_slot(label: Column, genes: int) -> Column:
    """The slot that a class counts for, or null: spliced g, unspliced genes + g, ambiguous 2 * genes + g.

    One form: its own. Both forms of one gene: ambiguous. Two genes: the spliced one if exactly one is. Three to ten: the spliced
    one if exactly one is, but ambiguous if its unspliced form is there too. Otherwise none.
    """
    a, b = label[0], label[1]
    spliced = F.filter(label, lambda x: x % 2 == 0)
    only = spliced[0]
    gene = lambda x: F.shiftright(x, 1)
    one = F.when(a % 2 == 0, gene(a)).otherwise(genes + gene(a))
    two = F.when(gene(a) == gene(b), 2 * genes + gene(a)).when(F.size(spliced) == 1, gene(only))
    more = F.when(F.size(spliced) == 1, F.when(F.array_contains(label, only + 1), 2 * genes + gene(only)).otherwise(gene(only)))
    return F.when(F.size(label) == 1, one).when(F.size(label) == 2, two).when(F.size(label).between(3, 10), more)


def spliced_counts(counts: DataFrame, genes: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """cell, slot, n from classes (cell, label, n)."""
    return counts.withColumn("slot", spliced_slot(F.col("label"), genes)).filter(F.col("slot").isNotNull()).groupBy(*keys, "slot").agg(F.sum("n").alias("n"))


def slots(label: Column, genes: int) -> Column:
    """The label in slots: both forms of a gene become its ambiguous slot, single forms their own."""
    def slot(x: Column) -> Column:
        gene = F.shiftright(x, 1)
        return F.when(x % 2 == 0, F.when(F.array_contains(label, x + 1), 2 * genes + gene).otherwise(gene)).when(~F.array_contains(label, x - 1), genes + gene)

    return F.array_sort(F.filter(F.transform(label, slot), lambda s: s.isNotNull()))


def spliced_uniform(counts: DataFrame, genes: int) -> DataFrame:
    """cell, slot, n: a class counts for each of its slots in equal parts."""
    out = counts.select("cell", "n", slots(F.col("label"), genes).alias("s"))
    return out.select("cell", F.explode("s").alias("slot"), (F.col("n") / F.size("s")).alias("part")).groupBy("cell", "slot").agg(F.sum("part").alias("n"))


def small_cells(reads: DataFrame, threshold: int, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Adds small: the cell has fewer than `threshold` reads, so it is resolved by votes whatever is asked for; 0 turns that off."""
    if threshold <= 0:
        return reads.withColumn("small", F.lit(False))
    n = reads.groupBy(*keys).agg((F.count("*") < threshold).alias("small"))
    return reads.join(n, list(keys))


def graph_edges(molecules: DataFrame, umi_length: int, exact: bool = False) -> DataFrame:
    """cell, src, dst (structs of label and umi): directed edges between the molecules (cell, label, umi, n) of a cell.

    Two molecules are near if their labels share a reference and their identifiers differ in one base at most (exact: in none).
    Equal identifiers point both ways; else x points to y unless y has at least twice its reads, that is n_y > 2 n_x - 1.
    Candidates come from equality of cell, reference and identifier with one base masked, never from a theta join: a row for each
    reference and base on either side. Equal identifiers meet with every base masked and are taken once.
    """
    node = F.struct("label", "umi")
    masks = [0] if exact else [3 << (2 * i) for i in range(umi_length)]
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("umi").bitwiseAND(F.lit(~m).cast("long")).alias("k")) for i, m in enumerate(masks))))
    one = molecules.select("cell", F.explode("label").alias("ref"), node.alias("node"), "n", key.alias("key"))
    src, dst = (one.select("cell", "ref", "key", F.col("node").alias(a), F.col("n").alias(b)) for a, b in (("src", "ns"), ("dst", "nd")))
    near = src.join(dst, ["cell", "ref", "key"]).filter(F.col("src") != F.col("dst"))
    same = F.col("src.umi") == F.col("dst.umi")
    points = same | ~(F.col("nd") > 2 * F.col("ns") - 1) | (F.col("ns") > 2 * F.col("nd") - 1)
    # A pair that shares several references is taken at the least of them, which spares a shuffle for distinct pairs.
    once = (F.array_min(F.array_intersect("src.label", "dst.label")) == F.col("ref")) & (~same | (F.col("key.i") == 0))
    return near.filter(points & once).select("cell", "src", "dst")
