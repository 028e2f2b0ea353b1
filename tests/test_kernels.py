import itertools
import random

import numpy as np
import pytest

from cytoplan.operators import kernels, quant


def brute_graph(labels, umis, counts):
    edges = set()
    for i, j in itertools.permutations(range(len(umis)), 2):
        x = umis[i] ^ umis[j]
        far = sum((x >> (2 * b)) & 3 != 0 for b in range(16))
        if set(labels[i]) & set(labels[j]) and far <= 1 and (far == 0 or counts[i] > 2 * counts[j] - 1 or not counts[j] > 2 * counts[i] - 1):
            edges.add((i, j))
    return edges


def test_graph_matches_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 14)
        keys = list({(tuple(sorted(rng.sample(range(4), rng.randint(1, 2)))), rng.randrange(32)) for _ in range(n)})
        labels, umis, counts = [k[0] for k in keys], [k[1] for k in keys], [rng.randint(1, 5) for _ in keys]
        out = kernels.molecule_graph(labels, umis, counts)
        assert {(i, j) for i, x in enumerate(out) for j in x} == brute_graph(labels, umis, counts)


def test_cover_partitions_components():
    rng = random.Random(5)
    for _ in range(40):
        keys = list({(tuple(sorted(rng.sample(range(3), rng.randint(1, 2)))), rng.randrange(64)) for _ in range(20)})
        labels, umis = [k[0] for k in keys], [k[1] for k in keys]
        out = kernels.molecule_graph(labels, umis, [rng.randint(1, 4) for _ in keys])
        for part in kernels.weak_components(out):
            arbs = list(kernels.cover(part, out, labels))
            assert sorted(v for a in arbs for v in a) == part
            assert all(set.intersection(*(set(labels[v]) for v in a)) for a in arbs)
            # The first arborescence is the largest that any vertex and reference give.
            assert len(arbs[0]) == max(len(kernels.arborescence(v, set(part), out, labels)[0]) for v in part)


def test_parsimony_small_cases():
    rows = [{"label": [0], "umi": 0, "n": 5}, {"label": [0], "umi": 1, "n": 1}, {"label": [1, 2], "umi": 63, "n": 1}]
    assert kernels.parsimony(rows, lambda t: t) == ({(0,): 1, (1, 2): 1}, False)
    assert kernels.parsimony(rows, lambda t: t // 4) == ({(0,): 2}, False)
    assert kernels.parsimony(rows, lambda t: t, exact=True)[0] == {(0,): 2, (1, 2): 1}
    assert kernels.parsimony(rows, lambda t: t, large=1) == ({(0,): 2, (1, 2): 1}, True)


def test_expectation_maximisation():
    em = kernels.expectation_maximisation
    found = em([((1, 2), 10), ((2, 3), 10), ((9,), 0)])
    assert set(found) <= {1, 2, 3} and sum(found.values()) == pytest.approx(20, abs=0.03)
    assert em([]) == {} and em([((4,), 3)], last_round=True) == {4: 3.0}
    assert em([((0,), 9), ((0, 1), 10)])[0] > 18
    assert sum(em([((0, 1, 2), 7), ((1,), 2)], "uniform", axis=10).values()) == pytest.approx(9)
    spliced = em([((0,), 5), ((0, 2), 4), ((2,), 1)], last_round=True, usa=1)
    assert sum(spliced.values()) == pytest.approx(10)
    sided = em([((0, 1), 10)], probs=[[0.9, 0.1]])
    assert sided[0] > sided.get(1, 0)


def brute_em(reads):
    """Abundances of one cell's reads (umi, label), with plain dictionaries."""
    votes = {}
    for umi, label in reads:
        for g in label:
            votes.setdefault(umi, {}).setdefault(g, 0)
            votes[umi][g] += 1
    classes = {}
    for v in votes.values():
        label = tuple(sorted(g for g in v if v[g] == max(v.values())))
        classes[label] = classes.get(label, 0) + 1
    unique = {g: classes.get((g,), 0) for label in classes for g in label}
    alpha = {g: (u + 0.5) * 1e-3 for g, u in unique.items()}
    for r in range(100):
        new = {g: float(u) for g, u in unique.items()}
        for label, n in classes.items():
            if len(label) > 1:
                for g in label:
                    new[g] += n * alpha[g] / sum(alpha[h] for h in label)
        moved = any(new[g] > 0.01 and abs(new[g] - alpha[g]) > 0.01 for g in new)
        alpha = new
        if r and not moved:
            break
    return {g: x for g, x in alpha.items() if x >= 0.01}


def test_em_query_covers_all_cells(spark):
    from cytoplan.plans import base
    from cytoplan.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    cells = {}
    for r in base.labelled(spark, sf).collect():
        cells.setdefault(r.cell, []).append((r.umi, r.label))
    want = {(c, g): x for c, reads in cells.items() for g, x in brute_em(reads).items()}
    got = {(r.cell, r.gid): r.n for r in QUERIES["e1_expectation_maximisation"](spark, sf).collect()}
    assert max(cells) >= 64 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_bootstrap_is_seeded():
    classes = [((0,), 5), ((0, 1), 4), ((1,), 1)]
    one, two = kernels.bootstrap(classes, 3, 11), kernels.bootstrap(classes[::-1], 3, 11)
    assert one == two and all(sum(x.values()) == pytest.approx(10, abs=0.03) for x in one)
    assert kernels.bootstrap([], 2, 1) == [{}, {}]


def test_votes_match_sql_form(spark):
    from cytoplan.operators import resolve

    rng = np.random.default_rng(1)
    rows = [(0, int(rng.integers(6)), sorted({int(x) for x in rng.integers(0, 4, 2)})) for _ in range(200)]
    df = spark.createDataFrame(rows, "cell long, umi long, label array<long>")
    got = {r.umi: tuple(r.label) for r in resolve.votes_winner_take_all(df).collect()}
    for umi in got:
        want = list(kernels.vote_winners([(u, tuple(x), 1) for _, u, x in rows if u == umi]))
        assert [got[umi]] == want


def test_options():
    for bad in (("nothing",), ("cr-like", 1), ("trivial", None, 0, True), ("cr-like", None, 3)):
        with pytest.raises(ValueError):
            quant.check_options(*bad)
    quant.check_options("parsimony-em", 1, 10)


def test_small_cells_take_the_vote_path(spark):
    from pyspark.sql import functions as F

    reads = spark.createDataFrame([(c, u, [u % 10, (u + 1) % 10]) for c in range(4) for u in range(8)], "cell long, umi long, label array<long>")
    mass = lambda t: quant.quantify(reads, "parsimony-em", t).agg(F.sum("n")).first()[0] or 0
    assert mass(100) == 0 and mass(0) > 0


def test_weighted_parsimony():
    rows = [{"label": [0, 1], "umi": 0, "n": 4, "probs": [0.9, 0.1]}, {"label": [0], "umi": 1, "n": 1, "probs": [1.0]}, {"label": [1, 2], "umi": 2, "n": 1, "probs": [0.2, 0.8]}]
    found = kernels.weighted_parsimony(rows, lambda t: t)
    # The single read of certain origin is the likeliest set, so it does not join the larger one that points to it.
    assert sum(n for n, _ in found.values()) == 3 and found[(0,)] == (1, [1.0]) and found[(0, 1)][1] == pytest.approx([0.9, 0.15])
    assert found[(1, 2)][0] == 1 and found[(1, 2)][1] == pytest.approx([0.2, 0.8])
    assert kernels.weighted_parsimony(rows[2:], lambda t: 0) == {(0,): (1, [1.0])}
    assert sum(n for n, _ in kernels.weighted_parsimony(rows, lambda t: t, large=1).values()) == 3


def test_long_read_counts(spark):
    rows = [(0, 5, [3, 4], [0.9, 0.1]), (0, 5, [3, 4], [0.7, 0.3]), (0, 60, [3], [1.0]), (1, 9, [8, 9], [0.5, 0.5])]
    out = {(r.cell, r.gid): r.n for r in quant.long_read_counts(spark.createDataFrame(rows, "cell long, umi long, label array<long>, probs array<double>")).collect()}
    assert out[0, 3] > 1.7 and out[1, 8] == pytest.approx(0.5, abs=0.02)
