"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of distinct five-word shingles. Each set gets T minwise tokens. A tree's node selects token positions (as a
hash of the node says: WIDTHS of them by level); a document goes down to one child for each, named by the position and its token
there. Sets of similarity s share a child with chance s, so less similar sets part level by level, while over as many independent
trees as the threshold takes (three at 0.85, four at 0.8) a pair at the threshold misses all common leaves with a chance of at most
6 in a million.

A leaf is never expanded into all its pairs. First each member is compared with the leaf's least document; when components of
these links are known, only members of different components are still compared, exhaustively, most similar partners first. Pairs
whose tokens agree too little are left out, all others are confirmed on the two full sets. So a group of N near copies costs about
N comparisons and keeps every component. A large leaf is dealt out as cells: blocks of the members outside its largest component,
each against every block of the leaf. So a task holds a bounded number of sets, and no pair is lost to a leaf's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, bounded_batches, materialize, mix, shingles, span_hashes, text_chunks, word_bounds
from .components import connected_components

T, TREES, WIDTHS = 256, 3, (3, 3, 1, 1, 1)
#: A leaf of up to so many sets is one cell; the members of a larger one are dealt out to blocks of about so many.
SMALL, BLOCK = 1024, 512
#: Greatest chance that a pair at the threshold shares no leaf.
LEAF_LOSS = 6e-6
#: A pair is worth confirming from so many deviations of its share of equal tokens below the threshold.
DEVIATIONS = 4.5


@dataclass(frozen=True)
class Threshold:
    """What a similarity threshold takes: trees, and the least number of equal tokens."""

    least: Fraction
    trees: int = TREES
    agree: int = 0

    @staticmethod
    def of(similarity: float | Fraction) -> Threshold:
        least = Fraction(similarity).limit_denominator(10_000)
        if not 0 < least < 1:
            raise ValueError("the threshold lies between 0 and 1")
        s = float(least)
        miss = 0.0
        for width in reversed(WIDTHS):
            miss = (1 - s * (1 - miss)) ** width
        agree = math.ceil(T * (s - DEVIATIONS * math.sqrt(s * (1 - s) / T)))
        return Threshold(least, math.ceil(math.log(LEAF_LOSS) / math.log(miss)), max(agree, 1))

    def close(self, shared: int, union: int) -> bool:
        """Whether shared / union is the threshold or more."""
        return self.least.denominator * shared >= self.least.numerator * union > 0


#: The contract of op1.
OP1 = Threshold.of(0.85)

_RNG = np.random.default_rng(17)
_XOR, _MUL = (_RNG.integers(1, 2**63, T, dtype=U64) for _ in range(2))
_MUL = _MUL * U64(2) + U64(1)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The T minwise tokens of each non-empty set, 16 bits each; the low 8 bits are kept for comparing two sets."""
    flat, begin = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), T), np.uint16)
    for t in range(T):
        out[:, t] = (mix(np.minimum.reduceat((flat ^ _XOR[t]) * _MUL[t], begin)) >> U64(48)).astype(np.uint16)
    return out


def paths(sig: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The names of the leaves that each row of tokens reaches."""
    rows, wide, out = np.arange(len(sig)), sig.astype(U64), []

    def down(node: np.ndarray, level: int) -> None:
        if level == len(WIDTHS):
            out.append(node)
            return
        for j in range(WIDTHS[level]):
            # A level has T // depth positions of its own, so a path uses none twice.
            at = level + len(WIDTHS) * (((mix(node ^ U64(level + 1)) >> U64(20)).astype(np.int64) + j * 7) % (T // len(WIDTHS)))
            down(mix(node ^ ((at.astype(U64) << U64(16)) | wide[rows, at])), level + 1)

    for tree in range(trees):
        down(np.full(len(sig), (tree + 1) * 0x1000003, U64), 0)
    return np.stack(out, 1).view(np.int64)


_SET_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, sig binary, marks binary, paths array<long>"


def _describe(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in text_chunks(batch):
                start, end, first = word_bounds(data, offs)
                sets = shingles(span_hashes(data, start, end, fold=True), first)
                sizes = np.array(list(map(len, sets)), np.int64)
                full = np.flatnonzero(sizes)
                h = np.zeros((2, hi - lo), U64)
                sig, marks, leaf = [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo)
                if len(full):
                    held = [sets[i] for i in full]
                    flat, begin = np.concatenate(held), np.cumsum([0, *sizes[full][:-1]])
                    h[0, full], h[1, full] = (np.add.reduceat(mix(flat ^ U64(k)), begin) for k in (0x1234567, 0x89ABCDEF0))
                    tokens = minwise(held)
                    for i, s, p in zip(full.tolist(), tokens, paths(tokens, trees), strict=True):
                        sig[i], marks[i], leaf[i] = s.astype(np.uint8).tobytes(), p.astype(np.uint32).tobytes(), p
                cols = [ids.slice(lo, hi - lo), sizes, h[0].view(np.int64), h[1].view(np.int64), pa.array(sig, pa.binary()), pa.array(marks, pa.binary()), pa.array(leaf, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["doc_id", "n_shingles", "h1", "h2", "sig", "marks", "paths"])

    return run


def _confirm(at: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps the pairs (a, b, text_a, text_b) whose full sets are similar enough."""
        last: tuple[object, np.ndarray] = (None, np.zeros(0, U64))

        def sets_of(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
            for _, _, data, offs in text_chunks(batch, name):
                start, end, first = word_bounds(data, offs)
                yield from shingles(span_hashes(data, start, end, fold=True), first)

        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                heads: dict[int, int] = {}
                for i, x in enumerate(a):
                    heads.setdefault(x, i)
                fresh = [i for x, i in heads.items() if x != last[0]]
                known = {last[0]: last[1]}
                if fresh:
                    known |= dict(zip((a[i] for i in fresh), sets_of(pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(fresh))], ["text"]), "text"), strict=True))
                keep = []
                for i, other in enumerate(sets_of(batch, "text_b")):
                    one = known[a[i]]
                    if at.close(min(len(one), len(other)), max(len(one), len(other))):
                        where = np.searchsorted(one, other)
                        where[where == len(one)] = 0
                        both = int(np.count_nonzero(one[where] == other))
                        if at.close(both, len(one) + len(other) - both):
                            keep.append(i)
                last = (a[-1], known[a[-1]])
                if keep:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, at: Threshold) -> DataFrame:
    """The confirmed ones of pairs (a, b). The two joins share one exchange of the texts; a side with a hot key is split by AQE."""
    t = texts.select(F.col("doc_id"), F.col("text"))
    one = pairs.join(t.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    two = one.join(t.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(at), "a long, b long")


def _node_pairs(comps: np.ndarray, sigs: np.ndarray, left: np.ndarray, most: int, at: Threshold = OP1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a cell's sets that lie in different components and may be similar; for each set the `most` likeliest (0: all).

    left tells the two sides, which are compared with each other; of a cell with one side, all sets are compared.
    """
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    within = not (len(one) and len(two))
    kinds, back, count = np.unique(comps, return_inverse=True, return_counts=True)
    if len(kinds) < 2:
        return
    rank = np.lexsort((comps, count[back]))  # small components first; members of the largest, the last ones, need no partners among themselves
    largest = comps == comps[rank[-1]]
    if within:
        rounds = [(rank[: len(rank) - int(count.max())], rank)]
    else:
        rounds = [(one[~largest[one]], two), (one[largest[one]], two[~largest[two]])]
    for first, second in rounds:
        block = max(1, (4 << 20) // (max(1, len(second)) * T))
        for lo in range(0, len(first), block):
            some = first[lo : lo + block]
            rest = second[lo:] if within else second
            agree = np.count_nonzero(sigs[some, None, :] == sigs[None, rest, :], axis=2)
            agree[comps[some, None] == comps[None, rest]] = 0
            if within:
                agree[np.arange(len(rest))[None, :] <= np.arange(len(some))[:, None]] = 0
            if most:
                for r in np.flatnonzero((agree >= at.agree).sum(1) > most).tolist():
                    agree[r, np.argsort(-agree[r], kind="stable")[most:]] = 0
            i, j = np.nonzero(agree >= at.agree)
            if len(i):
                yield some[i], rest[j]


def _compare_nodes(most: int, at: Threshold):
    def pairs_of(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
        """A pair that shares several leaves is taken in the first of them, as the marks of both its sets' leaves tell."""
        table = pa.Table.from_batches(batches)
        leaf = table["path"][0].as_py() & 0xFFFFFFFF
        ids, comps = (table[k].to_numpy() for k in ("rep", "comp"))
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, T)
        marks = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint32).reshape(len(ids), -1)
        out = []
        for i, j in _node_pairs(comps, sigs, table["left"].to_numpy(), most, at):
            here = marks[i, (marks[i] == marks[j]).argmax(1)] == leaf
            out.append(np.sort(np.stack([ids[i[here]], ids[j[here]]], 1), axis=1))
        return out

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        x = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, key = [], [], None
        for batch in batches:
            p = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero(np.diff(p, axis=0).any(1)) + 1).tolist(), len(p)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if held and (p[lo] != key).any():
                        found += pairs_of(held)
                        held = []
                    key = p[lo]
                    held.append(batch.slice(lo, hi - lo))
            if sum(map(len, found)) > 50_000:
                yield packed(found)
                found = []
        found += pairs_of(held) if held else []
        if found:
            yield packed(found)

    return run


def _cells(known: DataFrame, opened: DataFrame) -> DataFrame:
    """path, i, j, left, rep, comp: each member of the open leaves (path, n), in every cell that it is compared in.

    A leaf of up to SMALL members is one cell. Else its members outside the largest component are blocks 0 to outer - 1 and those of
    that component the blocks from there on; cells are pairs i <= j of blocks with i < outer. So a component of any size costs one
    copy of its members for each block of the others.
    """
    members = known.join(opened, "path")
    whole = lambda m: m.select("path", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left"), "rep", "comp")
    large = opened.filter(F.col("n") > SMALL)
    if large.isEmpty():
        return whole(members)
    by_comp = known.join(large, "path").groupBy("path", "n", "comp").agg(F.count("*").alias("m"))
    main = by_comp.groupBy("path", "n").agg(F.max(F.struct("m", "comp")).alias("x"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    main = main.select("path", F.col("x.comp").alias("__main"), blocks(F.col("n") - F.col("x.m")).alias("outer"), blocks(F.col("x.m")).alias("inner"))
    dealt = known.join(main, "path").withColumn("__in", F.col("comp") == F.col("__main"))
    one_of = lambda n: F.pmod(F.xxhash64("rep", "path"), n).cast("int")
    dealt = dealt.withColumn("b", F.when(F.col("__in"), F.col("outer") + one_of(F.col("inner"))).otherwise(one_of(F.col("outer"))))
    others = F.sequence(F.lit(0), F.when(F.col("__in"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    dealt = dealt.select("path", "rep", "comp", "b", F.explode(others).alias("o")).select("path", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") <= F.col("o")).alias("left"), "rep", "comp")
    return whole(members.filter(F.col("n") <= SMALL)).unionByName(dealt)


def near_duplicates(docs: DataFrame, rounds: tuple[int, ...] = (8, 0), threshold: float = 0.85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Null, empty and white-space texts have an empty set: linked with nothing, each its own component. Equal sets are always one
    component, so repeated rows are linked. Links have similarity >= threshold on whole sets; component_id is the least doc_id that
    links reach and kept says that it is the row's own. A null doc_id is compared under no other document; its component is its
    set's least doc_id, or null. Empty tables give an empty result.
    """
    at = Threshold.of(threshold)
    bounded_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(texts.mapInArrow(_describe(at.trees), _SET_SCHEMA), "sets")
    first = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = materialize(sets.join(first, ["h1", "h2"]).filter("doc_id = rep").dropDuplicates(["h1", "h2"]).select("rep", "sig", "marks", "paths"), "reps")
    nodes = reps.select("rep", F.explode("paths").alias("path"))
    pivots = nodes.groupBy("path").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("path", "a")
    star = nodes.join(pivots, "path").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    links = materialize(_links(star, texts, at), "links")
    comps = connected_components(links)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes: not to be coalesced by size
    for most in rounds:
        known = nodes.join(comps, F.col("rep") == F.col("node"), "left").select("path", "rep", F.coalesce("component", "rep").alias("comp"))
        opened = known.groupBy("path").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).filter("x < y").select("path", "n")
        rows = _cells(known, materialize(opened, "open")).join(reps.select("rep", "sig", "marks"), "rep").select("path", "i", "j", "left", "rep", "comp", "sig", "marks")
        found = rows.repartition(tasks, "path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_compare_nodes(most, at), "a long, b long")
        more = materialize(_links(found.distinct(), texts, at), "links")
        if more.isEmpty():
            if most == 0:
                break
            continue
        links = links.unionByName(more)
        comps = connected_components(links)
    of_set = first.join(comps, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, whose document stands for its group.

    Of several rows with such a doc_id, the one of least text stays (a null is least). Rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, threshold=threshold).filter("kept").select("doc_id").distinct()
    lone = docs.filter("doc_id is null")
    first = docs.join(kept, "doc_id", "left_semi").withColumn("__row", F.row_number().over(W.partitionBy("doc_id").orderBy("text")))
    return first.filter("__row = 1").drop("__row").unionByName(lone)


#: The same rows in DuckDB's SQL: a join of all shingles, and a walk along the links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * k >= 85 * (len(sa.s) + len(sb.s) - k)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""