"""Mixing sources to target weights: repetition rates from words per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, materialize

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A document's draw is this many bits of a digest of its id and the seed, so reruns and other engines draw alike.
DRAW_DIGITS = 12


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null: characters that start a word, after white space became one character."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number from 0 below 1 that depends on the id and the seed only (a null id draws as an empty one)."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**DRAW_DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): the water level at which targets add up to share times all sizes.

    Sources by code point, null last, weigh `weights`, repeating. A target is level * weight, at most `most` times its source's size.
    Sorted by size / weight, the sources that are full form a prefix; the level is what they leave over, divided by the weights
    of the others, for the shortest prefix whose level fills no further source. One row per source, so the windows are small.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    # Sums of sizes stay integers: the share is a fraction of 100.
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    s = s.withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
    s = s.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(round(share * 100)))
    s = s.withColumn("level", (F.col("wanted") - 100 * F.col("full")).cast("double") / (100 * F.col("open")).cast("double"))
    stays = F.col("level") * F.col("weight") <= most * F.col("source_size")
    level = F.min(F.when(stays, F.struct(F.col("full").alias("full"), F.col("level").alias("level")))).over(everything)["level"]
    s = s.withColumn("at", level)
    target = F.when(F.col("at").isNull(), (F.col("source_size") * most).cast("double")).otherwise(F.least(F.col("at") * F.col("weight"), (F.col("source_size") * most).cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """All rows and columns of docs, with size, source_size, target, rate and copies.

    copies is floor(rate), and one more where the document's draw is below the rate's fraction; a rate is target / source_size, so
    0 to 2. A null text has size 0, a null source is a source of its own (the last). Sources without words have rate 0. Repeated
    rows draw alike; empty tables give an empty result. Columns of those names are replaced.
    """
    sized = docs.drop("size", "source_size", "target", "rate", "copies").withColumn("size", word_count(F.col("text")))
    # The sum per source needs the sizes alone; the partial sums leave one row for each source and task.
    by_source = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    # Written first, so its size is known: a small table is broadcast and the texts stay where they are, a large one is joined by key.
    t = materialize(targets(by_source), "targets").select(F.col("source").alias("__source"), "source_size", "target")
    out = sized.join(t, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    extra = F.when(draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return out.withColumn("rate", rate).withColumn("copies", (whole + extra).cast("int"))


def emit(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as it has copies, with the columns of docs."""
    rows, back = aside(docs, ("doc_id", "text", "source"))
    return back(mix(rows, seed).filter("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))


def oracle_sql(table: str = "documents", seed: str = "mix") -> str:
    """The digest of mix() in DuckDB's SQL."""
    words = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w != ''))"
    return f"""
WITH sized AS (SELECT doc_id, source, {words}::BIGINT AS size FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s),
f AS (SELECT *, 2 * coalesce(sum(source_size) OVER b, 0)::BIGINT AS filled, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS open,
      150 * (sum(source_size) OVER ())::BIGINT AS wanted
      FROM w WINDOW b AS (ORDER BY source_size / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (wanted - 100 * filled)::DOUBLE / (100 * open)::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, least(coalesce((SELECT arg_min(level, filled) FROM l WHERE level * weight <= 2 * source_size), 1e300) * weight,
      (2 * source_size)::DOUBLE) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '/{seed}'), 1, {DRAW_DIGITS}))::BIGINT::DOUBLE / {float(16**DRAW_DIGITS)!r} AS draw
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
