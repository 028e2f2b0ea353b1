"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates for each language and source.

Everything is DataFrame expressions. A text's statistics come from its words and lines with array functions (no quadratic step).

The statistic vector is transformed and cut to whole steps, a small part of what counts as a difference at all. So the estimates work
on a table of distinct vectors with their numbers of documents, and all their sums are sums of integers: they do not depend on how
rows are dealt to tasks. From several starts (all documents; medians and absolute deviations; few documents drawn by hash) they
concentrate: distances from the mean and covariance, the share H that is nearest, its mean and covariance, until the determinant
stops falling. Of a group's starts the one of least determinant counts. Each step is one aggregation by whole classes of distance,
fine on a logarithmic scale, from which the nearest share is exact up to its last class; no task orders a group's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Share of a group that the estimates rest on, and the factor that makes the share's covariance consistent for normal data in five
#: dimensions: H / P(chi2 with 7 degrees < its H-quantile with 5).
H, CONSISTENT = 0.75, 1.41
#: Statistic vector, with the least standard deviation of each: differences below it are not evidence, however uniform a group is.
VECTOR = {"x0": 0.5, "x1": 0.12, "x2": 0.42, "x3": 0.6, "x4": 0.06}
P = len(VECTOR)
#: Steps of the cut vector in one least standard deviation, and classes of distance in a doubling of its square.
STEPS, CLASSES = 64, 32
#: Starts from few documents, documents of each, steps after which only the BEST starts of a group go on, and a bound that no run comes near.
DRAWN, DRAWN_SIZE, TRIAL, BEST, MOST_STEPS = 6, 6, 2, 3, 200
#: Squared distance from which a document is rejected; for five normal statistics the chance is about 1e-5.
CUTOFF = 30.0
WIDTH = 5
#: Parts of a group's rows in joins with the group's few estimates: a group may hold a third of all rows.
SALTS = 32
#: Most bytes of all groups' estimates, by count and length of their names, that are broadcast; beyond it the joins are salted.
BROADCAST_BYTES, ESTIMATE_BYTES = 32 << 20, 256
#: Pairs of a group and a start that one task settles.
PAIRS = 64
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")


def covered(starts: Column) -> Column:
    """How many places the windows at these starts (ascending, distinct) cover."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-WIDTH).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, s: F.struct(s.cast("long").alias("last"), (acc["sum"] + F.least(F.lit(WIDTH).cast("long"), s - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def repeated_words(w: Column) -> Column:
    """Number of words in windows of WIDTH words that occur twice or more, first occurrences included."""
    join = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    part = lambda a, start, n: F.slice(a, F.lit(start), n)

    def windows(h: Column) -> Column:
        """Hashes of pairs, of two pairs, and of those with the fifth word."""
        n = F.size(h)
        pairs = join(part(h, 1, n - 1), part(h, 2, n - 1))
        fours = let(pairs, lambda p: join(part(p, 1, n - 3), part(p, 3, n - 3)))
        return join(part(fours, 1, n - 4), part(h, 5, n - 4))

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, places))

    return F.when(F.size(w) < WIDTH + 1, F.lit(0).cast("long")).otherwise(let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), count))


def repeated_lines(text: Column) -> Column:
    """Number of lines with a word that equal an earlier line."""
    full = lambda lines: F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    extra = lambda lines: F.size(lines) - F.size(F.array_distinct(lines))
    return let(F.split(text, "\n"), lambda lines: F.when(extra(lines) == 0, F.lit(0)).otherwise(let(full(lines), extra))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.length(text)
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        of_words.alias("w"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
    )
    return out.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))


def vector(s: DataFrame) -> DataFrame:
    """Adds k0.., the transformed statistics in whole steps."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    x = [F.log1p(F.col("n_words").cast("double")), F.log(chars / n), F.log1p(100.0 * F.col("n_symbols") / chars), F.log1p(F.col("n_dup_lines").cast("double")), F.col("n_repeat_words") / n]
    return s.withColumns({f"k{i}": F.round(v * (STEPS / low)).cast("long") for i, (v, low) in enumerate(zip(x, VECTOR.values(), strict=True))})


K = [f"k{i}" for i in range(P)]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in LOWER)]
ESTIMATE = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in LOWER), "logdet"]


def _with(s: DataFrame, per_group: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """s joined with its groups' values: broadcast if they are known to be small, so that s stays in place.

    Else the rows of a group are dealt out by a salt, and its few rows of values are repeated for each.
    """
    if small:
        return s.join(F.broadcast(per_group), keys)
    salted = s.withColumn("__salt", F.pmod(F.xxhash64(*s.columns), F.lit(SALTS).cast("long")))
    values = per_group.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(values, [*keys, "__salt"]).drop("__salt")


def fits(of: DataFrame) -> bool:
    """Whether the estimates of all groups and starts are small enough for a broadcast."""
    groups, names = of.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("g") + F.octet_length("l")), F.lit(0))).first()
    return (2 + DRAWN) * (groups * ESTIMATE_BYTES + names) <= BROADCAST_BYTES


def sums(weight: Column) -> list[Column]:
    """What a covariance is made from, as integer sums."""
    linear = [F.sum(weight * F.col(f"k{i}")).alias(f"s{i}") for i in range(P)]
    square = [F.sum(weight * F.expr(f"k{i} * k{j}")).alias(f"q{i}{j}") for i, j in LOWER]
    return [F.sum(weight).alias("n"), *linear, *square]


def estimate(of: DataFrame) -> DataFrame:
    """Adds means, the lower triangle of the covariance's Cholesky factor (in least standard deviations) and the log determinant to rows with SUMS.

    The formulas are SQL text: one call of the session for each column, not one for each operation.
    """
    steps = [f"s{i} / double(n) / {STEPS} AS m{i}" for i in range(P)]
    for i, j in LOWER:
        rest = f"(q{i}{j} / double(n) / {STEPS**2} - m{i} * m{j}) * {CONSISTENT}D + {1 if i == j else 0}D"
        for k in range(j):
            rest += f" - l{i}{k} * l{j}{k}"
        steps.append(f"sqrt(greatest({rest}, 1e-12D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    logs = " + ".join(f"ln(l{i}{i})" for i in range(P))
    return of.selectExpr("*", *steps, f"2 * ({logs}) AS logdet").drop(*SUMS)  # each column may use the ones before it


def distances(of: DataFrame) -> DataFrame:
    """Adds d, the squared distance, to rows with a cut vector and an estimate."""
    names = [f"__y{i}" for i in range(P)]
    steps = []
    for i, name in enumerate(names):
        rest = f"k{i} / {STEPS}D - m{i}" + "".join(f" - l{i}{j} * {names[j]}" for j in range(i))
        steps.append(f"({rest}) / l{i}{i} AS {name}")
    return of.selectExpr("*", *steps, f"{' + '.join(f'{c} * {c}' for c in names)} AS d").drop(*names)


def concentrate(points: DataFrame, estimates: DataFrame, small: bool = False) -> DataFrame:
    """pool, start and the estimate of the documents nearest to each estimate: whole classes of distance until the share H is reached."""
    near = distances(_with(points, estimates, ["pool"], small))
    level = F.floor(F.log2(F.col("d") + 2.0**-10) * CLASSES).cast("int")
    by_class = near.groupBy("pool", "start", level.alias("level")).agg(*sums(F.col("w")))
    group = W.partitionBy("pool", "start")
    before = F.sum("n").over(group.orderBy("level")) - F.col("n")
    used = by_class.withColumn("__before", before).withColumn("__all", F.sum("n").over(group)).filter(F.col("__before") < H * F.col("__all"))
    return estimate(used.groupBy("pool", "start").agg(*(F.expr(f"sum({c}) AS {c}") for c in SUMS))).select("pool", "start", *ESTIMATE)


def _medians(values: DataFrame) -> DataFrame:
    """pool, i, med: the least value k of each pool and place i that at least half of the documents (w) do not exceed."""
    by = values.groupBy("pool", "i", "k").agg(F.sum("w").alias("w"))
    group = W.partitionBy("pool", "i")  # values in steps: a few thousand of them, however many documents
    upto = by.withColumn("__upto", F.sum("w").over(group.orderBy("k"))).withColumn("__all", F.sum("w").over(group))
    return upto.filter(2 * F.col("__upto") >= F.col("__all")).groupBy("pool", "i").agg(F.min("k").alias("med"))


def starts(points: DataFrame, small: bool = False) -> DataFrame:
    """pool, start and estimates: 0 of all documents, 1 of medians and absolute deviations, the others of DRAWN_SIZE different vectors by hash."""
    whole = estimate(points.groupBy("pool").agg(*sums(F.col("w")))).withColumn("start", F.lit(0))
    each = points.select("pool", "w", F.posexplode(F.array(*K)).alias("i", "k"))
    med = _medians(each)
    off = _with(each, med, ["pool", "i"], small).select("pool", "i", "w", F.abs(F.col("k") - F.col("med")).alias("k"))
    both = med.withColumnRenamed("med", "mid").join(_medians(off), ["pool", "i"])
    wide = both.groupBy("pool").agg(*(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for c in ("mid", "med") for i in range(P)))
    scale = {f"l{i}{i}": F.sqrt((1.4826 * F.col(f"med{i}") / STEPS) ** 2 + 1.0) for i in range(P)}
    robust = wide.withColumns({f"m{i}": F.col(f"mid{i}") / F.lit(float(STEPS)) for i in range(P)} | {f"l{i}{j}": scale.get(f"l{i}{j}", F.lit(0.0)) for i, j in LOWER})
    robust = robust.withColumn("logdet", F.lit(0.0)).withColumn("start", F.lit(1))
    draws = F.explode(F.array(*(F.struct(F.lit(2 + j).alias("start"), F.xxhash64(F.lit(j), *K).alias("h")) for j in range(DRAWN))))
    drawn = points.select("pool", *K, draws.alias("x")).groupBy("pool", "x.start", F.pmod("x.h", F.lit(DRAWN_SIZE).cast("long")).alias("slot"))
    drawn = drawn.agg(F.min(F.struct("x.h", *K)).alias("least")).select("pool", "start", *(F.col(f"least.{c}").alias(c) for c in K))
    few = estimate(drawn.groupBy("pool", "start").agg(*sums(F.lit(1).cast("long"))))
    columns = ["pool", "start", *ESTIMATE]
    return whole.select(*columns).unionByName(robust.select(*columns)).unionByName(few.select(*columns))


def determinants(points: DataFrame, small: bool = False) -> DataFrame:
    """pool and the estimate of least determinant, of points (pool, k0.., w). Only counts of open starts reach the driver."""
    now = materialize(starts(points, small).withColumn("logdet", F.lit(float("inf"))), "mcd")
    left = now.count()
    done = None
    for step in range(MOST_STEPS):
        new = concentrate(points, now, small).coalesce(max(1, left // PAIRS))
        old = now.selectExpr("pool", "start", *(f"{c} AS __{c}" for c in ESTIMATE))
        both = new.join(old, ["pool", "start"]).withColumn("settled", F.expr("logdet >= __logdet - 1e-9D"))
        both = both.selectExpr("pool", "start", *(f"if(settled, __{c}, {c}) AS {c}" for c in ESTIMATE), "settled")
        if step + 1 == TRIAL:
            rank = F.row_number().over(W.partitionBy("pool").orderBy("logdet", "start"))
            both = both.withColumn("__rank", rank).filter(F.col("__rank") <= BEST).drop("__rank")
        both = materialize(both, "mcd")
        ended = both.filter("settled").drop("settled")
        done = ended if done is None else done.unionByName(ended)
        now = both.filter("not settled").drop("settled")
        left = now.count()
        if not left:
            break
    else:
        raise RuntimeError("the estimates did not settle")
    best = done.groupBy("pool").agg(F.min(F.struct("logdet", "start", *ESTIMATE[:-1])).alias("b"))
    return best.select("pool", *(F.col(f"b.{c}").alias(c) for c in ESTIMATE))


def pools(cells: DataFrame, least_group: int, least_pool: int) -> DataFrame:
    """l, g (language; language and source), pool and members: the pool that judges a group, and the pools in use that its documents belong to.

    A group of least_group documents is its own pool; a smaller one is judged by all documents of its language, if they are as many,
    else by all documents; and by none if there are fewer than least_pool.
    """
    by_group = cells.groupBy("l", "g").agg(F.sum("w").alias("n"))
    by_lang = by_group.groupBy("l").agg(F.sum("n").alias("m"), F.min("n").alias("least"))
    total = by_group.agg(F.sum("n").alias("all"))
    of = by_group.join(by_lang, "l").join(F.broadcast(total))  # one row
    whole = F.when(F.col("all") >= least_pool, F.lit("*"))
    pool = F.when(F.col("n") >= least_group, F.col("g")).when(F.col("m") >= least_group, F.col("l")).otherwise(whole)
    members = F.array_compact(F.array(F.when(F.col("n") >= least_group, F.col("g")), F.when((F.col("least") < least_group) & (F.col("m") >= least_group), F.col("l")), whole))
    return of.select("l", "g", pool.alias("pool"), members.alias("members"))


def judge(docs: DataFrame, least_group: int = 50, least_pool: int = 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept, pool for each row of docs.

    docs has doc_id, text, lang, source; other columns are ignored. A null text has no words; a very long text is taken whole.
    base_failed: fewer than 10 words, or more than a fifth of the words repeat. Those rows take no part in the estimates and are not
    kept; of the others, rows at a squared distance of CUTOFF or more (one equal to it included) go. A null lang or source is a value
    of its own. pool names the estimate: language and source where they have least_group documents, else the language, else "*", all
    documents; null (and then no verdict against a row) where there are fewer than least_pool. Equal rows get equal verdicts, whatever
    the order and the partitions; empty tables give an empty result.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    s = vector(statistics(docs)).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    s = materialize(s.withColumn("l", name("lang")).withColumn("g", F.concat(name("lang"), F.lit("\x1f"), name("source"))), "stats")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = s.filter("not base_failed")
    cells = materialize(good.groupBy("l", "g", *K).agg(F.count("*").alias("w")), "cells")
    of = materialize(pools(cells, least_group, least_pool), "pools")
    small = fits(of)
    in_use = of.select("pool").distinct()
    members = of.select("g", F.explode("members").alias("pool")).join(in_use, "pool", "left_semi")
    points = materialize(_with(cells, members, ["g"], small).groupBy("pool", *K).agg(F.sum("w").alias("w")), "points")
    estimates = of.select("g", "pool").join(determinants(points, small), "pool", "left")
    judged = distances(_with(good, estimates, ["g"], small))
    passed = judged.select(*columns, F.col("d").alias("distance"), (F.coalesce(F.col("d"), F.lit(0.0)) < CUTOFF).alias("kept"), "pool")
    failed = s.filter("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"), F.lit(None).cast("string").alias("pool"))
    return passed.unionByName(failed)
