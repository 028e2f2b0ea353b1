import math
import re
from itertools import combinations

import numpy as np
import pytest

from cytoplan.llm import common, components, near_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_matches_brute_force(table, prose):
    assert got(near_dedup.near_duplicates(table(prose))) == brute(prose)


def test_group_of_near_copies_whose_least_document_is_an_outlier(table):
    """Links that do not pass through a leaf's least document are found as well."""
    base = [f"w{i}" for i in range(120)]
    edit = lambda at: " ".join(f"e{at}" if i in at else w for i, w in enumerate(base))
    rows = [(0, edit((1, 30, 60, 90)))] + [(i, edit((2 * i,))) for i in range(1, 25)] + [(50, edit((2, 4, 110)))]
    assert got(near_dedup.near_duplicates(table(rows))) == brute(rows)


def test_threshold_is_exact(table):
    """Sets of 20 and 17 shared shingles link at 85 %, of 16 shared do not."""
    a = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:21])), (3, " ".join(a[:20]))]
    assert got(near_dedup.near_duplicates(table(rows))) == brute(rows)


def test_edge_cases(spark, table):
    assert near_dedup.near_duplicates(table([])).collect() == []
    rows = got(near_dedup.near_duplicates(table([(1, None), (2, ""), (3, " "), (4, "a"), (5, "A"), (4, "a")])))
    assert rows == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False)}
    odd = table([(2, "p q r s t u"), (1, "p q r s t u")]).selectExpr("*", "1 as rep", "2 as path", "3 as h1", "4 as component")
    assert got(near_dedup.near_duplicates(odd)) == {1: (2, 1, True), 2: (2, 1, False)}
    null_id = near_dedup.near_duplicates(table([(None, "k l m"), (7, "k l m"), (None, None)])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in null_id} == {(7, 7, True), (None, 7, False), (None, None, False)}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [1]


def test_paths_meet_at_the_planned_rate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (20_000, near_dedup.T)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.85, a, rng.integers(0, 65536, a.shape)).astype(np.uint16)
    assert (near_dedup.paths(a) == near_dedup.paths(b)).any(1).mean() > 0.9995


def groups_at(rows, percent):
    """The least document of each group, by comparing all pairs at a threshold in per cent."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    return set(root.values())


def test_pipeline_stage_links_from_80_percent(spark, table, prose):
    """Sets of 20 and 16 shared shingles link at 80 %, of 15 do not; near copies between 80 and 85 % go as brute force says."""
    import corpus_pipeline

    a = [f"w{i}" for i in range(24)]
    rows = prose + [(500, " ".join(a)), (501, " ".join(a[:20])), (502, " ".join(a[:19]).replace("w0 ", ""))]
    rng = np.random.default_rng(5)
    for i in range(40):
        words = [f"t{i}x{j}" for j in range(104)]
        rows.append((1000 + 2 * i, " ".join(words)))
        words[: int(rng.integers(8, 22))] = ["new"]
        rows.append((1001 + 2 * i, " ".join(words)))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table(rows), "").select("doc_id").collect()}
    assert kept == groups_at(rows, 80) and kept < groups_at(rows, 85)


def test_paths_meet_at_the_planned_rate_at_80_percent():
    at = near_dedup.Threshold.of(0.8)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (20_000, near_dedup.T)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 65536, a.shape)).astype(np.uint16)
    assert (near_dedup.paths(a, at.trees) == near_dedup.paths(b, at.trees)).any(1).mean() > 0.9995
    assert ((a == b).sum(1) >= at.agree).mean() > 0.999


@pytest.mark.parametrize("similarity", [0.85, 0.8])
def test_few_links_are_lost_to_the_agreement_bound(similarity):
    """The binomial chance that a pair at the threshold has fewer equal tokens than are asked for."""
    n = near_dedup.T
    below = sum(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(near_dedup.Threshold.of(similarity).agree))
    assert below < 2e-5


def pairs_in(comps, sigs, left, most=0):
    return {tuple(sorted(p)) for i, j in near_dedup._node_pairs(comps, sigs, left, most) for p in zip(i.tolist(), j.tolist(), strict=True)}


def test_cells_compare_all_members_of_different_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 255, (1, near_dedup.T)).astype(np.uint8)
    sigs = np.where(rng.random((40, near_dedup.T)) < 0.97, base, rng.integers(0, 255, (40, near_dedup.T))).astype(np.uint8)
    every, ids = {(i, j) for i, j in combinations(range(40), 2)}, np.arange(40)
    whole = np.ones(40, bool)
    assert pairs_in(ids, sigs, whole) == every
    assert len(pairs_in(ids, sigs, whole, 2)) < len(every)
    for comps in (ids, np.where(ids % 3 == 0, 99, ids % 5), np.full(40, 7)):
        apart = {(i, j) for i, j in every if comps[i] != comps[j]}
        assert pairs_in(comps, sigs, whole) == apart
        assert pairs_in(comps, sigs, ids < 15) == {(i, j) for i, j in apart if i < 15 <= j}


@pytest.mark.parametrize(("small", "block"), [(2, 1), (16, 4)])
def test_large_leaves_lose_no_link(monkeypatch, table, prose, small, block):
    """Components equal brute force where nearly every leaf is dealt out as cells: a leaf of many unlike copies, and one large component with outsiders."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = list(prose)
    for i in range(60):
        words = list(base)
        for at in rng.choice(200, int(rng.integers(1, 6)), replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((5000 + i, " ".join(words)))
    assert got(near_dedup.near_duplicates(table(rows))) == brute(rows)


def test_repeated_ids_with_different_texts_keep_the_least(table):
    kept = near_dedup.keep_one(table([(3, "b b b"), (3, "a a a"), (3, None), (4, "c"), (4, "c")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, None), (4, "c")]


def test_a_cluster_must_name_its_shared_folder(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    assert common.shared_dir(spark) == common.shared_dir(spark)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 5), (2, 1), (20, 21)] + [(30 + i, 31 + i) for i in range(40)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {i: 30 for i in range(30, 71)}
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
