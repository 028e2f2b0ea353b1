"""Per-cell kernels: graph cover, expectation maximisation and bootstrap, run over whole partitions of cells and never one cell a call."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Rows = list[dict]
# Expectation maximisation: fixed values that results depend on.
LEAST_ROUNDS, MOST_ROUNDS, WATCHED, TOLERANCE, LEAST_OUTPUT = 2, 100, 0.01, 0.01, 0.01
BOTH_WAYS = 10**9


def by_cell(rows: DataFrame, kernel: Callable[[object, Rows], Iterator[tuple]], schema: str, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """keys and schema: kernel(cell, rows of the cell) over all cells, a cell being a value of the key columns.

    A cell's rows come sorted to one task; a batch's last cell is carried over. The kernel gets the tuple of the keys' values and yields
    tuples of the other columns.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    whole = ", ".join([*(f"{k} {'long' if kinds[k] == 'bigint' else kinds[k]}" for k in keys), schema])
    names = [f.strip().split(" ")[0] for f in whole.split(",")]
    others = [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows = []
        held_key: tuple | None = None
        out: list[tuple] = []
        kind = _arrow(whole)

        def packed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                out.clear()

        def close() -> None:
            out.extend((*held_key, *r) for r in kernel(held_key, held))

        for batch in batches:
            lists = {c: batch.column(names_at).to_pylist() for names_at, c in enumerate(batch.schema.names)}
            for key, *values in zip(zip(*(lists[k] for k in keys), strict=True), *(lists[c] for c in others), strict=True):
                if key != held_key:
                    if held_key is not None:
                        close()
                    held, held_key = [], key
                held.append(dict(zip(others, values, strict=True)))
            if len(out) > 20_000:
                yield from packed()
        if held_key is not None:
            close()
        yield from packed()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, whole)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"array<double>": pa.list_(pa.float64()), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.strip().split(" ")[0], kinds[f.strip().split(" ")[1]]) for f in schema.split(",")])


# ---- graph cover ----


def molecule_graph(labels: list[tuple[int, ...]], umis: list[int], counts: list[int], exact: bool = False) -> list[list[int]]:
    """Out-neighbours of each molecule; the rule of resolve.graph_edges. Buckets of equal masked identifiers replace the pair loop."""
    n = len(umis)
    out: list[set[int]] = [set() for _ in range(n)]
    buckets: dict[tuple, list[int]] = defaultdict(list)
    bases = max(1, (max(umis, default=0).bit_length() + 1) // 2)
    for i in range(n):
        for r in labels[i]:
            if exact:
                buckets[r, umis[i]].append(i)
            else:
                for b in range(bases):
                    buckets[r, b, umis[i] & ~(3 << (2 * b))].append(i)
    for group in buckets.values():
        for k, i in enumerate(group):
            for j in group[k + 1 :]:
                same = umis[i] == umis[j]
                big_i, big_j = counts[i] > 2 * counts[j] - 1, counts[j] > 2 * counts[i] - 1
                if same or big_i or not big_j:
                    out[i].add(j)
                if same or (big_j and not big_i) or not (big_i or big_j):
                    out[j].add(i)
    return [sorted(x) for x in out]


def weak_components(out: list[list[int]]) -> list[list[int]]:
    """Vertices of each weakly connected component, ascending."""
    root = list(range(len(out)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, near in enumerate(out):
        for j in near:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    parts: dict[int, list[int]] = defaultdict(list)
    for i in range(len(out)):
        parts[find(i)].append(i)
    return list(parts.values())


def arborescence(v: int, free: set[int], out: list[list[int]], labels: list[tuple[int, ...]]) -> tuple[list[int], int]:
    """The largest set of free vertices that v reaches through vertices of one of its references, and that reference (the first of equals)."""
    best: list[int] = []
    chosen = -1
    for ref in labels[v]:
        seen, order = {v}, [v]
        for x in order:
            for y in out[x]:
                if y in free and y not in seen:
                    seen.add(y)  # as the traversal marks a vertex when it is met, whatever its label
                    if ref in labels[y]:
                        order.append(y)
        if len(order) > len(best):
            best, chosen = order, ref
    return best, chosen


def cover(members: list[int], out: list[list[int]], labels: list[tuple[int, ...]]) -> Iterator[list[int]]:
    """Parsimonious cover of a component: again and again the largest arborescence. Ties: the least vertex, then the least reference."""
    free = set(members)
    while free:
        best: list[int] = []
        for v in sorted(free):
            found, _ = arborescence(v, free, out, labels)
            if len(found) > len(best):
                best = found
            if len(found) == len(free):
                break
        yield best
        free -= set(best)


def vote_winners(reads: list[tuple[int, tuple[int, ...], int]]) -> Iterator[tuple[int, ...]]:
    """For each identifier of (umi, genes, reads), the genes of the most reads."""
    votes: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for umi, genes, n in reads:
        for g in genes:
            votes[umi][g] += n
    for v in votes.values():
        top = max(v.values())
        yield tuple(sorted(g for g, n in v.items() if n == top))


def genes_by_rows(rows: Rows) -> Callable[[int], int]:
    """The gene of each reference, from rows that name it beside each reference of their label; without such a column, a reference is a gene."""
    if not rows or rows[0].get("genes") is None:
        return lambda t: t
    known: dict[int, int] = {}
    for r in rows:
        known.update(zip(r["label"], r["genes"], strict=True))
    return known.__getitem__


def parsimony(rows: Rows, gene_of: Callable[[int], int], exact: bool = False, large: int = 1000) -> tuple[dict[tuple[int, ...], int], bool]:
    """Molecules by gene label of one cell's rows (label, umi, n), and whether a component was too large and went by votes."""
    rows = sorted(rows, key=lambda r: (r["label"], r["umi"]))
    labels, umis, counts = [tuple(r["label"]) for r in rows], [r["umi"] for r in rows], [r["n"] for r in rows]
    out = molecule_graph(labels, umis, counts, exact)
    found: dict[tuple[int, ...], int] = defaultdict(int)
    voted = False
    genes = lambda refs: tuple(sorted({gene_of(t) for t in refs}))
    for part in weak_components(out):
        if len(part) == 1:
            found[genes(labels[part[0]])] += 1
        elif large and len(part) > large:
            voted = True
            for label in vote_winners([(umis[v], genes(labels[v]), counts[v]) for v in part]):
                found[label] += 1
        else:
            for arb in cover(part, out, labels):
                shared = set(labels[arb[0]]).intersection(*(labels[v] for v in arb[1:]))
                found[genes(shared)] += 1
    return dict(found), voted


def likeliest_arborescence(v: int, free: set[int], out: list[list[int]], probs: list[dict[int, float]], by_place: bool = False) -> tuple[list[int], float, dict[int, float]]:
    """Of the sets that v reaches by one of its references, the one of the highest mean probability, that mean, and every reference's mean.

    A vertex counts with its own probability of the reference; by_place: with its probability at the place that the reference has in
    v's label, as the established implementation counts (a label too short for the place then counts 0).
    """
    best: list[int] = []
    top, means = 0.0, {}
    rows = [list(p.values()) for p in probs] if by_place else []
    for place, ref in enumerate(sorted(probs[v])):
        seen, order = {v}, [v]
        for x in order:
            for y in out[x]:
                if y in free and y not in seen:
                    seen.add(y)
                    if ref in probs[y]:
                        order.append(y)
        own = [rows[x][place] if place < len(rows[x]) else 0.0 for x in order] if by_place else [probs[x][ref] for x in order]
        means[ref] = sum(own) / len(order)
        if means[ref] > top:
            best, top = order, means[ref]
    return best or [v], top, means


def weighted_parsimony(rows: Rows, gene_of: Callable[[int], int], exact: bool = False, large: int = 1000, by_place: bool = False) -> dict[tuple[int, ...], tuple[int, list[float]]]:
    """Molecules by gene label with the mean probability of each of its genes, of one cell's rows (label, umi, n, probs).

    As parsimony(), but a molecule is the arborescence of the highest mean probability. probs are the mean probabilities of the label's
    references over the molecule's reads; a gene's probability is the sum of its references'.
    """
    rows = sorted(rows, key=lambda r: (r["label"], r["umi"]))
    labels, umis, counts = [tuple(r["label"]) for r in rows], [r["umi"] for r in rows], [r["n"] for r in rows]
    probs = [dict(zip(r["label"], r["probs"], strict=True)) for r in rows]
    out = molecule_graph(labels, umis, counts, exact)
    found: dict[tuple[int, ...], list[dict[int, float]]] = defaultdict(list)

    def add(means: dict[int, float]) -> None:
        genes: dict[int, float] = defaultdict(float)
        for ref, p in means.items():
            genes[gene_of(ref)] += p
        found[tuple(sorted(genes))].append({g: 1.0 for g in genes} if len(genes) == 1 else genes)

    for part in weak_components(out):
        if len(part) == 1:
            add(probs[part[0]])
        elif large and len(part) > large:
            for label in vote_winners([(umis[v], tuple(sorted({gene_of(t) for t in labels[v]})), counts[v]) for v in part]):
                found[label].append({g: 1.0 / len(label) for g in label})
        else:
            free = set(part)
            while free:
                picks = [likeliest_arborescence(v, free, out, probs, by_place) for v in sorted(free)]
                arb, _, means = max(picks, key=lambda x: x[1])
                shared = set(labels[arb[0]]).intersection(*(labels[v] for v in arb[1:]))
                add({t: p for t, p in means.items() if t in shared})
                free -= set(arb)
    return {label: (len(x), [sum(y[g] for y in x) / len(x) for g in label]) for label, x in found.items()}


# ---- expectation maximisation ----


def _classes(classes: list[tuple[tuple[int, ...], float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets present, unique counts by target, and (class, target, count of class) of the other classes."""
    targets = np.array(sorted({t for label, n in classes if n > 0 for t in label}), np.int64)
    at = {t: i for i, t in enumerate(targets.tolist())}
    unique = np.zeros(len(targets))
    cls, tgt, cnt = [], [], []
    for label, n in classes:
        if n <= 0:
            continue
        if len(label) == 1:
            unique[at[label[0]]] += n
        else:
            cls += [len(cnt)] * len(label)
            tgt += [at[t] for t in label]
            cnt.append(n)
    return targets, unique, np.array(cls, np.int64), np.array(tgt, np.int64), np.array(cnt, float)


def _weights(targets: np.ndarray, usa: int) -> list[np.ndarray]:
    """For each target, the indices whose abundances weigh it: in spliced mode S with A, U with A, A with S and U."""
    at = {t: i for i, t in enumerate(targets.tolist())}
    out = []
    for t in targets.tolist():
        layer, gene = divmod(t, usa)
        kin = {0: (0, 2), 1: (1, 2), 2: (2, 0, 1)}[layer]
        out.append(np.array([at[k * usa + gene] for k in kin if k * usa + gene in at], np.int64))
    return out


def expectation_maximisation(
    classes: list[tuple[tuple[int, ...], float]], init: str = "informative", axis: int | None = None, last_round: bool = False, usa: int = 0, rng: np.random.Generator | None = None, probs: list[list[float]] | None = None
) -> dict[int, float]:
    """Abundance of each target from classes (label, count).

    Classes of one target add their count; others are split in proportion to abundance. It starts from 1e-3 of the unique counts +
    0.5 (informative), 1 / axis (uniform) or at random, and stops when no abundance over WATCHED moved by more than TOLERANCE.
    Abundances below LEAST_OUTPUT become 0; with last_round, if it did settle, a further round follows, after which small ones become
    0 again, and classes that are all of one target return at once. usa, the number of genes, weighs splicing layers together. probs: for each class the mean probabilities of
    its targets, multiplied with their abundances.
    """
    if probs is not None:
        kept = [(c, p) for c, p in zip(classes, probs, strict=True) if c[1] > 0]
        classes, probs = [c for c, _ in kept], [p for _, p in kept]
    targets, unique, cls, tgt, cnt = _classes(classes)
    if not len(targets):
        return {}
    if last_round and not len(cnt):
        return {t: float(x) for t, x in zip(targets.tolist(), unique, strict=True) if x > 0}
    scale = np.array([x for (label, _), p in zip(classes, probs, strict=True) if len(label) > 1 for x in p]) if probs is not None else np.ones(len(tgt))
    if init == "informative":
        alpha = (unique + 0.5) * 1e-3
    elif init == "uniform":
        alpha = np.full(len(targets), 1.0 / (axis or len(targets)))
    else:
        alpha = (rng or np.random.default_rng(0)).random(len(targets)) + 1e-5
    kin = _weights(targets, usa) if usa else None

    def one(a: np.ndarray) -> np.ndarray:
        w = (np.array([a[k].sum() for k in kin]) if kin is not None else a)[tgt] * scale
        total = np.bincount(cls, w, len(cnt))
        share = np.divide(cnt, total, out=np.zeros_like(cnt), where=total > 0)
        return unique + np.bincount(tgt, w * share[cls], len(targets))

    settled = False
    for r in range(MOST_ROUNDS):
        new = one(alpha)
        settled = r + 1 >= LEAST_ROUNDS and not (np.abs(new - alpha)[new > WATCHED] > TOLERANCE).any()
        alpha = new
        if settled:
            break
    alpha[alpha < LEAST_OUTPUT] = 0
    if last_round and settled:
        alpha = one(alpha)
        alpha[alpha < LEAST_OUTPUT] = 0
    return {t: float(x) for t, x in zip(targets.tolist(), alpha, strict=True) if x > 0}


def bootstrap(classes: list[tuple[tuple[int, ...], float]], replicates: int, seed: int) -> list[dict[int, float]]:
    """Abundances of `replicates` multinomial resamplings of the class counts, each from a random start."""
    rng = np.random.default_rng(seed)
    classes = sorted(c for c in classes if c[1] > 0)
    if not classes:
        return [{} for _ in range(replicates)]
    n = np.array([c[1] for c in classes], float)
    return [expectation_maximisation([(label, k) for (label, _), k in zip(classes, rng.multinomial(int(n.sum()), n / n.sum()), strict=True)], "random", last_round=True, rng=rng) for _ in range(replicates)]
