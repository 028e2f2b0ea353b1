"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text's words are its runs of letters, folded to lower case, between word marks; a character's context is the up to ORDER - 1
characters before it in its word. Grams are counted over all training documents (words are counted within a task, then grams are
summed over the table). Counts, discounts and probabilities of all grams are DataFrame aggregations, and no gram is left out. The
models are a table of 64-bit hashes in shared storage, in shards by hash: grams with their interpolated log probability, contexts
with their back-off weight. A worker looks up what a batch's new words need, shard by shard, and keeps shards of a bounded size.
A word's cost does not depend on its neighbours, so each worker scores a word once while its bounded cache lasts; a text goes to the
language of least cost per character.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, materialize, mix, mod3, power_table, shared_dir, text_chunks

ORDER = 5
#: Least number of shards of the stored models, most entries of one, and entries that a worker keeps of them.
SHARDS, SHARD_ENTRIES, KEPT_ENTRIES = 16, 500_000, 8_000_000
#: Grams that a task holds before it sends partial counts, and words in a worker's cache.
TASK_GRAMS, CACHE_WORDS = 400_000, 300_000
#: A mean cost this many nats per character above the language's usual one halves the score.
SLACK = 1.0
MARK = 0x02


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case where that is one character (else itself)."""
    size = 0x110000
    letter, lower = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for c in (*range(0xD800), *range(0xE000, 0x32000)):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                lower[c] = ord(y)
    return letter, lower


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code points (folded), starts and ends of words, their 64-bit hashes, and the row of each word."""
    letter, lower = letter_tables()
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]  # offsets in code points
    except UnicodeDecodeError:  # damaged bytes become replacement marks, row by row
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.cumsum([0, *map(len, texts)])
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = letter[points]
    points = lower[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    total = np.zeros(len(points) + 1, U64)
    np.cumsum(mix(points.astype(U64) + U64(0x51ED27)) * power_table("up", len(points)), out=total[1:])
    key = mix((total[end] - total[start]) * power_table("down", len(points) + 1)[start] + (end - start).astype(U64))
    return points, start, end, key, np.searchsorted(at, start, "right") - 1


def marked(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each between two marks, and where each begins (with one end more)."""
    size = end - start + 2
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(at[-1], MARK, np.uint32)
    n = end - start
    inner = np.repeat(at[:-1] + 1 - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    out[inner] = points[np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    return out, at


def gram_hash(x: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` symbols of x, by its first symbol's place."""
    n = max(len(x) - length + 1, 0)
    h = np.full(n, length, U64)
    for j in range(length if n else 0):
        h = mix(h * U64(0x9E3779B97F4A7C15) + x[j : j + n].astype(U64))
    return h


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of the longest grams, and of those that begin at a word's start mark."""
    held: dict[str, list[pd.DataFrame]] = {}

    def drain(lang: str) -> Iterator[pa.RecordBatch]:
        both = pd.concat(held.pop(lang)).groupby("gram", sort=False)["n"].sum()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(both), pa.string()), pa.array(both.index, pa.string()), pa.array(both.to_numpy())], ["lang", "gram", "n"])

    for batch in batches:
        names = batch.column(1).dictionary_encode()
        code = names.indices.to_numpy()
        for lo, _, data, offs in text_chunks(batch):
            points, start, end, key, row = words(data, offs)
            lang_of = code[lo + row]
            for c in np.unique(lang_of).tolist():
                own = np.flatnonzero(lang_of == c)
                _, first, count = np.unique(key[own], return_index=True, return_counts=True)
                x, at = marked(points, start[own[first]], end[own[first]])
                size = np.diff(at)
                left = np.arange(len(x)) - np.repeat(at[:-1], size)
                word = np.repeat(np.arange(len(size)), size)
                text = x.astype("<u4").tobytes().decode("utf-32-le")
                parts = []
                for n in range(2, ORDER + 1):
                    where = np.flatnonzero((left + n <= size[word]) & ((left == 0) | (n == ORDER)))
                    if not len(where):
                        continue
                    h = gram_hash(x, n)[where]
                    _, one, back = np.unique(h, return_index=True, return_inverse=True)
                    sums = np.bincount(back, count[word[where]]).astype(np.int64)
                    parts.append(pd.DataFrame({"gram": [text[i : i + n] for i in where[one].tolist()], "n": sums}))
                lang = names.dictionary[c].as_py()
                if parts:
                    held.setdefault(lang, []).extend(parts)
                    if sum(map(len, held[lang])) > TASK_GRAMS:
                        yield from drain(lang)
    for lang in [*held]:
        yield from drain(lang)


@dataclass
class Model:
    """Sorted hashes and values of one language."""

    lang: str
    gram: np.ndarray
    logp: np.ndarray
    context: np.ndarray
    backoff: np.ndarray
    floor: float
    usual: float = 2.5

    def costs(self, x: np.ndarray, at: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        """Nats that each marked word of x takes."""
        size = np.diff(at)
        left = np.arange(len(x)) - np.repeat(at[:-1], size)
        todo = np.flatnonzero(left > 0)
        total = np.zeros(len(x))
        for n in range(ORDER, 0, -1):  # n symbols, the predicted one is the last
            use = left[todo] + 1 >= n
            now = todo[use]
            if not len(now):
                continue
            begin = now - n + 1
            found, value = _look(self.gram, self.logp, hashes[n][begin])
            total[now[found]] += value[found]
            rest = now[~found]
            if n > 1 and len(rest):
                seen, weight = _look(self.context, self.backoff, hashes[n - 1][rest - n + 1])
                total[rest[seen]] += weight[seen]
            elif len(rest):
                total[rest] += self.floor
            todo = np.concatenate([todo[~use], rest]) if n > 1 else rest
        return -np.add.reduceat(total, at[:-1]) if len(size) else np.zeros(0)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted, values[at]


def _hash_text(grams: pd.Series) -> np.ndarray:
    """gram_hash of each string of a column."""
    out = np.zeros(len(grams), U64)
    size = grams.str.len().to_numpy()
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        x = np.frombuffer("".join(grams.iloc[own]).encode("utf-32-le"), np.uint32).reshape(-1, n)
        h = np.full(len(own), n, U64)
        for j in range(n):
            h = mix(h * U64(0x9E3779B97F4A7C15) + x[:, j].astype(U64))
        out[own] = h
    return out


def estimate(lang: str, grams: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney from counts (gram, n) of the longest grams and of those at word starts, of one language in memory.

    train() gives the same values for whole tables. Shorter grams inside words count the different symbols before them. Each order's discount is n1 / (n1 + 2 n2).
    """
    levels: dict[int, pd.DataFrame] = {}
    size = grams["gram"].str.len()
    start = grams["gram"].str[0] == chr(MARK)
    inner = grams[(size == ORDER)]
    levels[ORDER] = inner.assign(c=inner["n"])[["gram", "c"]]
    for n in range(ORDER - 1, 0, -1):
        above = levels[n + 1]["gram"]
        cont = above.str[1:].value_counts()
        own = grams[(size == n) & start]
        levels[n] = pd.concat([pd.DataFrame({"gram": cont.index, "c": cont.to_numpy()}), pd.DataFrame({"gram": own["gram"], "c": own["n"]})])
    one = levels[1]
    symbols = max(len(one) + 1, 2)
    prob = pd.Series((one["c"].to_numpy() + 0.1) / (one["c"].sum() + 0.1 * symbols), index=one["gram"])
    floor = float(np.log(0.1 / (one["c"].sum() + 0.1 * symbols)))
    out_gram, out_logp = [pd.Series(prob.index)], [np.log(prob.to_numpy())]
    out_ctx, out_bow = [], []
    for n in range(2, ORDER + 1):
        now = levels[n]
        now = now[now["c"] > 0]
        if not len(now):
            continue
        n1, n2 = int((now["c"] == 1).sum()), int((now["c"] == 2).sum())
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        ctx = now["gram"].str[:-1]
        stat = now.groupby(ctx.to_numpy())["c"].agg(["sum", "count"])
        weight = d * stat["count"] / stat["sum"]
        lower = now["gram"].str[1:].map(prob).fillna(np.exp(floor)).to_numpy()
        p = (now["c"].to_numpy() - d) / stat["sum"].loc[ctx].to_numpy() + weight.loc[ctx].to_numpy() * lower
        prob = pd.Series(p, index=now["gram"])
        out_gram.append(pd.Series(prob.index))
        out_logp.append(np.log(p))
        out_ctx.append(pd.Series(weight.index))
        out_bow.append(np.log(weight.to_numpy()))
    h, v = _hash_text(pd.concat(out_gram, ignore_index=True)), np.concatenate(out_logp)
    order = np.argsort(h)
    ch, cv = (_hash_text(pd.concat(out_ctx, ignore_index=True)), np.concatenate(out_bow)) if out_ctx else (np.zeros(0, U64), np.zeros(0))
    c_order = np.argsort(ch)
    model = Model(lang, h[order], v[order].astype(np.float32), ch[c_order], cv[c_order].astype(np.float32), floor)
    # The usual cost: of the model's own grams at their frequency, which stands for its training text.
    top = levels[ORDER]
    if len(top):
        found, value = _look(model.gram, model.logp, _hash_text(top["gram"].reset_index(drop=True)))
        model.usual = float(-np.average(value[found], weights=top["c"].to_numpy()[found]))
    return model


@dataclass(frozen=True)
class Stored:
    """Models in shared storage: a folder of shards, and for each language its floor and usual cost."""

    path: str
    shards: int
    langs: tuple[str, ...]
    floors: tuple[float, ...]
    usual: tuple[float, ...]


def _levels(counts: DataFrame) -> list[DataFrame]:
    """(lang, gram, c) for each length from 1 to ORDER, as in estimate(), of counts (lang, gram, n)."""
    size, start = F.length("gram"), F.substring("gram", 1, 1) == chr(MARK)
    out = [counts.filter(size == ORDER).select("lang", "gram", F.col("n").alias("c"))]
    for n in range(ORDER - 1, 0, -1):
        inner = out[0].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c"))
        out.insert(0, materialize(inner.unionByName(counts.filter((size == n) & start).select("lang", "gram", F.col("n").alias("c"))), f"level{n}"))
    return out


def _hashed(shards: int, code: dict[str, int]):
    """(lang, is_context, gram, v) to (shard, lang, is_context, h, v), with the language's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = _hash_text(batch.column(2).to_pandas().astype(object))
                lang = np.array([code[x] for x in batch.column(0).to_pylist()], np.int32)
                cols = [pa.array((h % U64(shards)).astype(np.int32)), pa.array(lang), batch.column(1), pa.array(h.view(np.int64)), batch.column(3)]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "lang", "is_context", "h", "v"])

    return run


def train(docs: DataFrame) -> Stored:
    """A model for each non-null lang of the documents that are not held out, from the text of all of them and with all their grams."""
    bounded_batches(docs)
    spark = docs.sparkSession
    rows = mod3(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))).filter("not held_out and lang is not null and text is not null")
    counts = rows.select("text", "lang").mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = _levels(materialize(counts, "grams"))
    # A few values for each language: the driver holds no grams.
    one = {r.lang: (r.total, max(r.symbols + 1, 2)) for r in levels[0].groupBy("lang").agg(F.sum("c").alias("total"), F.count("*").alias("symbols")).collect()}
    langs = tuple(sorted(one))
    if not langs:
        return Stored("", SHARDS, (), (), ())
    per_lang = lambda of: F.element_at(F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(of[k])))), F.col("lang"))
    mass = {k: total + 0.1 * symbols for k, (total, symbols) in one.items()}
    prob = levels[0].select("lang", "gram", "c", ((F.col("c") + 0.1) / per_lang(mass)).alias("p"))
    entry = lambda df, context, gram, v: df.select("lang", F.lit(context).alias("is_context"), F.col(gram).alias("gram"), F.log(v).alias("v"))
    entries = entry(prob, False, "gram", "p")
    for n in range(2, ORDER + 1):
        now = levels[n - 1]
        seen = {r.lang: (r.n1, r.n2) for r in now.groupBy("lang").agg(F.count(F.when(F.col("c") == 1, 1)).alias("n1"), F.count(F.when(F.col("c") == 2, 1)).alias("n2")).collect()}
        d = per_lang({k: min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5)) for k, (n1, n2) in ((k, seen.get(k, (0, 0))) for k in langs)})
        now = now.withColumn("ctx", F.substring("gram", 1, n - 1))
        stat = now.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).withColumn("weight", d * F.col("kinds") / F.col("total"))
        lower = prob.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower"))
        p = (F.col("c") - d) / F.col("total") + F.col("weight") * F.col("lower")
        prob = materialize(now.withColumn("rest", F.substring("gram", 2, n - 1)).join(stat, ["lang", "ctx"]).join(lower, ["lang", "rest"]).select("lang", "gram", "ctx", "c", "weight", p.alias("p")), f"prob{n}")
        entries = entries.unionByName(entry(prob, False, "gram", "p")).unionByName(entry(prob.dropDuplicates(["lang", "ctx"]), True, "ctx", "weight"))
    # The usual cost: of the model's own longest grams at their frequency, which stands for its training text.
    usual = {r.lang: r.cost for r in prob.groupBy("lang").agg((-F.sum(F.log("p") * F.col("c")) / F.sum("c")).alias("cost")).collect()}
    entries = materialize(entries, "entries")
    shards = max(SHARDS, -(-entries.count() // SHARD_ENTRIES))
    path = f"{shared_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    hashed = entries.mapInArrow(_hashed(shards, {k: i for i, k in enumerate(langs)}), "shard int, lang int, is_context boolean, h long, v double")
    hashed.withColumn("v", F.col("v").cast("float")).repartition(shards, "shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
    return Stored(path, shards, langs, tuple(float(np.log(0.1 / mass[k])) for k in langs), tuple(float(usual.get(k, Model.usual)) for k in langs))


class _Shards:
    """The stored models of a worker: shards are read as they are needed, and the least recent ones go."""

    def __init__(self, stored: Stored):
        self.stored = stored
        self.fs, self.root = pafs.FileSystem.from_uri(stored.path) if stored.path else (None, "")
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def _read(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted hashes and values of a shard, for each language those of grams and of contexts."""
        if k in self.held:
            self.held[k] = self.held.pop(k)
            return self.held[k]
        where = f"{self.root}/shard={k}"
        n = 2 * len(self.stored.langs)
        if self.fs.get_file_info(where).type == pafs.FileType.NotFound:
            part, h, v = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.float32)
        else:
            table = pq.read_table(where, filesystem=self.fs, columns=["lang", "is_context", "h", "v"], partitioning=None)
            part = table["lang"].to_numpy().astype(np.int64) * 2 + table["is_context"].to_numpy()
            h, v = table["h"].to_numpy().view(U64), table["v"].to_numpy()
        order = np.lexsort((h, part))
        ends = np.searchsorted(part[order], np.arange(n + 1))
        h, v = h[order], v[order]
        while self.held and sum(len(x) for one in self.held.values() for x, _ in one) + len(h) > KEPT_ENTRIES:
            del self.held[next(iter(self.held))]
        self.held[k] = [(h[a:b], v[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return self.held[k]

    def models(self, wanted: np.ndarray) -> list[Model]:
        """The models cut to the wanted hashes, which are all that the words at hand look up."""
        wanted = np.unique(wanted)
        shard = (wanted % U64(self.stored.shards)).astype(np.int64)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(2 * len(self.stored.langs))]
        # Shards at hand come first, so that those that must go are not read twice.
        for k in sorted(np.unique(shard).tolist(), key=lambda k: k not in self.held):
            asked = wanted[shard == k]
            for i, (keys, values) in enumerate(self._read(k)):
                hit, value = _look(keys, values, asked)
                found[i].append((asked[hit], value[hit]))
        joined = []
        for parts in found:
            h = np.concatenate([np.zeros(0, U64), *(x for x, _ in parts)])
            order = np.argsort(h)
            joined.append((h[order], np.concatenate([np.zeros(0, np.float32), *(x for _, x in parts)])[order]))
        s = self.stored
        return [Model(s.langs[i], *joined[2 * i], *joined[2 * i + 1], s.floors[i], s.usual[i]) for i in range(len(s.langs))]


class _Scorer:
    def __init__(self, stored: Stored):
        self.shards = _Shards(stored)
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.cost = np.zeros((1024, len(self.shards.stored.langs)), np.float32)

    def word_costs(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.index) > CACHE_WORDS:
            self.clear()
        known, index = [], self.index
        for k in unique.tolist():
            known.append(index.get(k, -1))
        slot = np.array(known, np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            x, at = marked(points, start[first[new]], end[first[new]])
            hashes = [np.zeros(0, U64), *(gram_hash(x, n) for n in range(1, ORDER + 1))]
            fresh = np.stack([m.costs(x, at, hashes) for m in self.shards.models(np.concatenate(hashes))], 1)
            base = len(index)
            while len(self.cost) < base + len(new):
                self.cost = np.concatenate([self.cost, np.zeros_like(self.cost)])
            self.cost[base : base + len(new)] = fresh
            slot[new] = np.arange(base, base + len(new))
            index.update(zip(unique[new].tolist(), slot[new].tolist(), strict=True))
        return self.cost[slot[back]]


_scorers: dict[str, _Scorer] = {}


def _predict(models: Stored):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if models.path not in _scorers:
            _scorers.clear()
            _scorers[models.path] = _Scorer(models)
        scorer = _scorers[models.path]
        usual = np.array(models.usual)
        names = np.array(models.langs, object)
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch):
                rows = hi - lo
                points, start, end, key, row = words(data, offs)
                pred, score = np.full(rows, "und", object), np.zeros(rows)
                if len(start) and models.langs:
                    cost = scorer.word_costs(points, start, end, key)
                    n = np.bincount(row, end - start + 1, rows)
                    mean = np.stack([np.bincount(row, cost[:, j], rows) for j in range(len(names))], 1) / np.maximum(n, 1)[:, None]
                    best = mean.argmin(1)
                    gap = np.exp(-np.minimum((mean - mean.min(1)[:, None]) * np.minimum(n, 60)[:, None], 50)).sum(1)
                    sure = 1 / (1 + np.exp(np.minimum(4 * (mean.min(1) - usual[best] - SLACK), 50)))
                    some = n > 0
                    pred[some], score[some] = names[best[some]], (sure / gap)[some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, models: Stored, accept: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score and accepted for each row of docs (doc_id, text).

    lang_pred is the language of least cost per character; a tie goes to the first by name. score is its share among the languages
    at that cost, lowered where the cost is above what the language's own text takes; accepted is score >= accept (the rejection).
    A null text, and one without a letter, is `und` with score 0; so is every text if there is no model. Equal texts get equal
    results. An empty table gives an empty result. The models stay in shared storage; workers read what they look up.
    """
    bounded_batches(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_predict(models), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
    return out.withColumn("accepted", F.col("score") >= accept)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: models from the documents that are not held out, applied to all."""
    return mod3(identify(docs, train(docs))).select("doc_id", "held_out", "lang_pred", "score", "accepted")
