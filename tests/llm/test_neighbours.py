import numpy as np
import pytest

from energraph.llm import neighbours as nb
from energraph.llm.neighbours import build_graph, fit_centroids, graph_search, nearest, neighbour_pairs, unit

SCHEMA = "id string, embedding array<float>, vector string, list int, h1 long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, k, floor):
    rows = {i: np.asarray(np.float32(v), float) for i, v in rows if v is not None and None not in list(v) and np.linalg.norm(v) > 0}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    out = set()
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a and sims[a, b] > floor), key=lambda b: (-sims[a, b], ids[b]))
        out |= {(i, ids[b]) for b in order[:k]}
    return out


def found(spark, rows, k, floor):
    return {(r.id, r.other) for r in nearest(table(spark, rows), k=k, min_similarity=floor).collect()}


def test_cases(spark):
    rows = [("a", [1, 0]), ("b", [1, 0.1]), ("b", [1, 0.1]), ("c", [0, 1]), ("n", None), ("z", [0, 0]), ("bad", [float("nan"), 1]), ("gap", [None, 1]), ("odd", [1, 2, 3]), (None, [1, 0])]
    assert found(spark, rows, 2, 0.5) == {("a", "b"), ("b", "a")}
    assert found(spark, [], 2, 0.5) == set() and found(spark, [("a", None)], 2, 0.5) == set()
    pairs = neighbour_pairs(nearest(table(spark, rows), k=2, min_similarity=0.5)).collect()
    assert [(p.u, p.v) for p in pairs] == [("a", "b")]


def test_copies_and_ties(spark):
    rows = [(f"c{i:02d}", [3, 4]) for i in range(12)] + [("d", [3, 4.1]), ("e", [6, 8]), ("f", [-3, -4])]
    assert found(spark, rows, 3, 0.5) == brute(rows, 3, 0.5)


def uneven():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    x = np.concatenate([c + rng.normal(size=(n, 24)) * s for c, n, s in zip(centers, rng.integers(10, 160, 40), rng.uniform(0.05, 0.6, 40))]).astype(np.float32)
    return [(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)]


def test_recall_with_uneven_density(spark):
    rows = uneven()
    true, got = brute(rows, 5, 0.75), found(spark, rows, 5, 0.75)
    assert len(got & true) >= 0.97 * len(true)
    assert len(got & true) >= 0.97 * len(got)


@pytest.mark.parametrize("block", [4096, 60])
def test_recall_at_two_levels(spark, monkeypatch, block):
    """Four lists at the first level for what would take dozens; the parts hold as few rows as lists do."""
    for name, n in (("MAX_LISTS", 4), ("SPLIT_ROWS", 300), ("SLOT_ROWS", 700), ("BLOCK_ROWS", block)):
        monkeypatch.setattr(nb, name, n)
    rows = [*uneven(), *[(f"w{i:03d}", [0.5] * 24) for i in range(40)]]
    true, got = brute(rows, 5, 0.75), found(spark, rows, 5, 0.75)
    assert len(got & true) >= 0.97 * len(true)
    assert len(got & true) >= 0.97 * len(got)


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(6000, 32)))
    c = fit_centroids(x, 16)
    ids, sims = graph_search(x[:500], c, *build_graph(c))
    exact = (x[:500] @ c.T).max(axis=1)
    assert (sims[:, 0] >= exact - 1e-6).mean() > 0.97 and len(c) >= 6000 / 16
