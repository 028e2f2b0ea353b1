"""Toxicity by a factorization machine over hashed terms.

A text's terms are its runs of letters (A-Z folded) and their first four and five bytes, hashed into BUCKETS. The machine adds a
bias, a weight for each term present and the products of the terms' factor vectors for all pairs present, so that an insult with a
group mention can count for more than both alone, or for less. It is fitted on a bounded sample of labelled rows. Every frequent term
takes part, whether or not it tells the labels apart by itself, since it may do so with another; rarer terms, of which no pair could
be estimated, take part if their own frequency differs clearly between the labels. What chance terms of long texts would add is held
back in the fit: a parameter is pulled to zero by as many deviations of its own gradient as PULL says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, aside, bounded_batches, mix, mod3, span_hashes, text_chunks

BUCKETS, FACTORS = 1 << 18, 4
#: The sample's bound: labelled rows of each label, taken by a hash of their ids.
MOST_TOXIC, MOST_CLEAN = 3000, 6000
#: A row of more distinct terms is not in the sample, so the sample is bounded in bytes as well.
MOST_ROW_TERMS = 8000
#: Terms by frequency that take part, at most so many others by the two-proportion z value, its least value, and the least documents with a term.
FREQUENT, MOST_OTHERS, LEAST_Z, LEAST_DOCS = 2048, 8192, 5.0, 3
#: Deviations by which weights and factors are pulled to zero, rounds, and the step.
PULL, ROUNDS, STEP = (3.0, 1.0), 60, 0.05
THRESHOLD = 0.7

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each term occurrence of a chunk of texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    row = np.searchsorted(offs, start, "right") - 1
    rows, keys = [row], [span_hashes(data, start, end, fold=True)]
    for n in (4, 5):
        long = end - start >= n
        rows.append(row[long])
        keys.append(mix(span_hashes(data, start[long], start[long] + n, fold=True) ^ U64(0xABCDEF * n)))
    return np.concatenate(rows), (np.concatenate(keys) >> U64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Machine:
    """bias, the model's index of each bucket (-1: none), weights and factors by index."""

    bias: float
    index: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Probability of the toxic label for each of `rows` rows with the distinct pairs (row, index of term)."""
        total = self.bias + np.bincount(row, self.weight[term], rows)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            total += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def pairs(self, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of row and known term."""
        at = self.index[bucket]
        both = np.unique(row[at >= 0] << 16 | at[at >= 0].astype(np.int64))
        return both >> 16, both & 0xFFFF


def vocabulary(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The buckets that take part, ascending, from distinct pairs (row, bucket) and the rows' labels."""
    n, pos = len(toxic), int(toxic.sum())
    in_pos = np.bincount(buckets[toxic[rows] == 1], minlength=BUCKETS)
    in_all = np.bincount(buckets, minlength=BUCKETS)
    share = in_all / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / pos + 1 / (n - pos)))
    z = np.abs(np.where(in_all >= LEAST_DOCS, (in_pos / pos - (in_all - in_pos) / (n - pos)) / spread, 0))
    known = in_all >= LEAST_DOCS
    frequent = np.argsort(-np.where(known, in_all, 0), kind="stable")[:FREQUENT]
    telling = np.argsort(-z, kind="stable")[:MOST_OTHERS]
    return np.union1d(frequent[known[frequent]], telling[z[telling] >= LEAST_Z])


def fit(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Machine:
    """Fits a machine to distinct pairs (row, bucket) and the rows' labels: full-batch Adam on logistic loss, from small random factors.

    The pull to zero is measured in deviations of a parameter's gradient over the rows. At zero, a parameter moves only by what its
    gradient has beyond the pull. The same pairs, in any order, give the same machine.
    """
    n, pos = len(toxic), int(toxic.sum())
    index = np.full(BUCKETS, -1, np.int16)
    prior = (pos + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not pos or pos == n:
        return Machine(-4.0 if not pos else 4.0, index, np.zeros(1), np.zeros((1, FACTORS)))
    chosen = vocabulary(rows, buckets, toxic)
    if not len(chosen):
        return Machine(bias, index, np.zeros(1), np.zeros((1, FACTORS)))
    index[chosen] = np.arange(len(chosen))
    at = index[buckets]
    r, t = rows[at >= 0], at[at >= 0].astype(np.int64)
    order = np.lexsort((t, r))
    r, t = r[order], t[order]
    of_term = np.argsort(t, kind="stable")
    by_term, terms_at = r[of_term], np.searchsorted(t[of_term], np.arange(len(chosen)))  # every chosen term has a row
    some, rows_at = np.unique(r, return_index=True)  # rows with a term
    y = toxic.astype(np.float32)
    size = np.sqrt(np.bincount(t, minlength=len(chosen)) / n)[:, None]
    p = np.concatenate([np.zeros((len(chosen), 1)), np.random.default_rng(seed).normal(0, 0.05, (len(chosen), FACTORS))], 1).astype(np.float32)
    pull = np.array([PULL[0]] + [PULL[1]] * FACTORS)
    m, s, mb, sb = np.zeros(p.shape), np.zeros(p.shape), 0.0, 0.0
    for step in range(1, rounds + 1):
        present = p[t]
        sums, squares = np.zeros((n, FACTORS + 1), np.float32), np.zeros(n, np.float32)
        sums[some] = np.add.reduceat(present, rows_at, 0)
        squares[some] = np.add.reduceat((present[:, 1:] ** 2).sum(1), rows_at)
        total = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
        miss = ((1 / (1 + np.exp(-np.clip(total, -30, 30))) - y) / n).astype(np.float32)
        each = np.concatenate([miss[:, None], miss[:, None] * sums[:, 1:]], 1)[by_term]
        grad = np.add.reduceat(each, terms_at, 0).astype(float)
        grad[:, 1:] -= grad[:, :1] * p[:, 1:]
        off = np.sqrt(np.add.reduceat(each * each, terms_at, 0).astype(float)) * pull
        grad = np.where(np.abs(p) > 1e-3, grad + off * np.clip(p / 0.05, -1, 1), np.sign(grad) * np.maximum(np.abs(grad) - off, 0))
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        p = (p - STEP * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-3 * size / np.sqrt(n))).astype(np.float32)
        g = float(miss.sum())
        mb, sb = 0.9 * mb + 0.1 * g, 0.999 * sb + 0.001 * g * g
        bias -= STEP * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias), index, p[:, 0].astype(float), p[:, 1:].astype(float))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch):
            row, bucket = terms(data, offs)
            both = np.unique(row * BUCKETS + bucket)
            at = np.searchsorted(both, np.arange(hi - lo + 1) * BUCKETS)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((both % BUCKETS).astype(np.int32)))
            some = pa.array(np.diff(at) <= MOST_ROW_TERMS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], ["doc_id", "toxic", "terms"]).filter(some)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from rows of docs that have a label and are not held out: at most MOST_TOXIC and MOST_CLEAN of them, by a hash of their ids.

    Labels other than 0 and 1 and rows without one are ignored; a doc_id labelled twice counts with its larger label, one with several
    texts counts with the least of them. Rows of more than MOST_ROW_TERMS distinct terms (very long texts) take no part in the fit.
    """
    bounded_batches(docs)
    known = mod3(labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))).filter("not held_out and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    sample = picked[0].unionByName(picked[1])  # at most MOST_TOXIC + MOST_CLEAN rows of two numbers, so it can be broadcast
    got = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    kind = dict(got.dtypes)["doc_id"]
    table = got.mapInArrow(_terms_of, f"doc_id {kind}, toxic int, terms array<int>").toArrow()
    if not table.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    table = table.sort_by("doc_id")
    flat = table["terms"].combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    return fit(np.repeat(np.arange(table.num_rows), sizes), flat.flatten().to_numpy().astype(np.int64), table["toxic"].to_numpy().astype(np.int64))


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "__text"):
                row, term = machine.pairs(*terms(data, offs))
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(machine.scores(row, term, hi - lo))], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, and score from 0 to 1.

    Null and empty texts have no terms and get the bias's score; a very long text is taken whole. Equal texts get equal scores, in every row. The machine has a fixed
    size (an index of BUCKETS entries, FREQUENT + MOST_OTHERS weights) and goes out with the tasks. An empty table gives an empty result.
    """
    bounded_batches(docs)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_score(machine), f"{schema}, score double")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD, a score equal to it included) for each row of docs."""
    out = mod3(score(docs, train(docs, labels)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    rows, back = aside(docs, ("doc_id", "text"))
    return back(score(rows, train(docs, labels), tuple(rows.columns)).filter(F.col("score") < THRESHOLD))
