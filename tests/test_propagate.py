import pytest

from energraph.config import ConflictConfig, DedupConfig, MassConfig, NegativeSeedConfig, PolarityConfig, PropagationConfig
from energraph.operators.graph import from_edges
from energraph.operators.outputs import activation_paths, energy_ledger, gap_warnings, theme_clusters
from energraph.operators.propagate import confidence, fold_conflicts, negative_field, propagate
from energraph.operators.similarity import PairSimilarity, VectorSimilarity

CANON = [("A", "A_dup", 0.0), ("A", "B", 0.8), ("A", "D", 0.4), ("C", "D", 0.6), ("C", "E", 0.3), ("D", "F", 0.5)]


def graph(spark, edges):
    return from_edges(spark.createDataFrame([(u, v, float(w), i) for i, (u, v, w) in enumerate(edges)], "u string, v string, w double, ord long"))


def seed(spark, weights, qid="q", color=None):
    rows = [(qid, color or "all", n, float(w)) for n, w in weights.items()]
    return spark.createDataFrame(rows, "qid string, color string, node string, weight double")


def energies(run):
    return {r.node: round(r.energy, 9) for r in run.activations.collect()}


def one(df):
    return df.collect()[0]


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, layer string, source_id string, length int, polarity int")


def test_canonical_trace(spark):
    adj = graph(spark, CANON)
    run = propagate(adj, seed(spark, {"A": 0.9, "C": 0.7}))
    assert energies(run) == {"A": 5.625, "C": 4.375, "D": 2.875, "B": 2.25, "F": 1.725}
    end = one(run.runs)
    assert (end.hops_used, end.stop_reason, end.threshold) == (2, "threshold", 1.5)
    by = {r.node: r for r in run.activations.collect()}
    assert by["D"].contributors == ["A", "C"] and by["D"].hop == 1 and by["F"].hop == 2 and by["A"].contributors == []
    assert [r.node for r in run.ranked().orderBy("rank").collect()] == ["A", "C", "D", "B", "F"]
    book = one(energy_ledger(run, adj, PropagationConfig()))
    assert book.balanced and abs(book.residual) < 1e-6 and book.mismatch < 1e-6
    c = one(confidence(run))
    assert (c.node_count, c.hop_depth) == (5, 2)
    paths = {r.node: r.steps for r in activation_paths(run).collect()}
    assert paths["F"] == ["A", "D", "F"] and paths["A"] == ["A"]


def test_guards_and_bad_seeds(spark):
    chain = graph(spark, [(f"n{i}", f"n{i + 1}", 1.0) for i in range(10)])
    run = propagate(chain, seed(spark, {"n0": 1}), PropagationConfig(damping=0.99, threshold_ratio=0.0, max_hop=3))
    assert set(energies(run)) == {"n0", "n1", "n2", "n3"} and (one(run.runs).stop_reason, one(run.runs).hops_used) == ("max_hop", 3)
    hub = graph(spark, [("hub", f"l{i:02d}", 1.0) for i in range(20)])
    run = propagate(hub, seed(spark, {"hub": 1}), PropagationConfig(threshold_ratio=0.0, max_nodes=5))
    assert len(energies(run)) == 5 and one(run.runs).stop_reason == "max_nodes"
    run = propagate(graph(spark, [("A", "B", 1.0)]), seed(spark, {"lonely": 1}))
    assert set(energies(run)) == {"lonely"} and one(run.runs).hops_used == 0 and one(run.runs).stop_reason == "threshold"
    with pytest.raises(ValueError):
        propagate(hub, seed(spark, {"hub": 0}))
    with pytest.raises(ValueError):
        propagate(hub, seed(spark, {}))


def test_alpha_and_batch(spark):
    adj = graph(spark, [("Q", "strong", 0.8), ("Q", "weak", 0.4)])
    both = seed(spark, {"Q": 1}, "a").unionByName(seed(spark, {"strong": 1}, "b"))
    run = propagate(adj, both, PropagationConfig(split_alpha=2.0, threshold_ratio=0.0))
    e = {(r.qid, r.node): r.energy for r in run.activations.collect()}
    assert e["a", "strong"] / e["a", "weak"] == pytest.approx(4) and e["a", "strong"] + e["a", "weak"] == pytest.approx(6)
    assert e["b", "Q"] == pytest.approx(6)


def test_failed_feeder_stays_a_contributor(spark):
    # N fails its gate from X at hop 1 and passes from Y at hop 3
    adj = graph(spark, [("X", "N", 0.1), ("X", "a", 0.9), ("a", "Y", 1.0), ("Y", "N", 1.0)])
    run = propagate(adj, seed(spark, {"X": 1}), PropagationConfig(damping=0.9))
    n = next(r for r in run.activations.collect() if r.node == "N")
    assert n.hop == 3 and n.contributors == ["X", "Y"]


def test_dedup_votes(spark):
    edges = [e if e[1] != "A_dup" else ("A", "A_dup", 0.95) for e in CANON]
    adj = graph(spark, edges)
    sims = spark.createDataFrame([("A", "A_dup", 0.95)], "u string, v string, sim double")
    cfg = DedupConfig(floor=0.9, min_pairs=100)
    run = propagate(adj, seed(spark, {"A": 0.9, "C": 0.7}), similarity=PairSimilarity(sims), dedup=cfg)
    assert energies(run) == {"A": 5.625, "C": 4.375, "D": 2.875, "B": 2.25, "F": 1.725}
    assert [(r.node, r.survivor) for r in run.suppressed.collect()] == [("A_dup", "A")]
    assert [(r.source, r.votes) for r in run.votes.collect()] == [("A", 2)]
    assert [r.tau for r in run.taus.collect()] == [0.9] * 4
    off = propagate(adj, seed(spark, {"A": 0.9, "C": 0.7}), similarity=PairSimilarity(sims), dedup=DedupConfig(enabled=False))
    assert "B" not in energies(off) and energies(off)["D"] == pytest.approx(3.375 * 0.4 / 2.15 + 2.625 * 0.6 / 0.9)


def test_seed_dedup_by_pairs_and_vectors(spark):
    adj = graph(spark, [("A", "X", 0.1)])
    s = seed(spark, {"A": 0.9, "A2": 0.88, "B": 0.45})
    cfg = DedupConfig(floor=0.9, min_pairs=100)
    pairs = PairSimilarity(spark.createDataFrame([("A", "A2", 0.96)], "u string, v string, sim double"))
    vec = VectorSimilarity(spark.createDataFrame([("A", [1.0, 0.0]), ("A2", [0.96, 0.28]), ("B", [0.0, 1.0])], "id string, embedding array<double>"))
    for similarity in (pairs, vec):
        run = propagate(adj, s, similarity=similarity, dedup=cfg)
        e = energies(run)
        assert "A2" not in e and e["A"] == pytest.approx(10 * 0.9 / 1.35) and e["B"] == pytest.approx(10 * 0.45 / 1.35)


def test_threshold_is_population_deviation(spark):
    names = "abcd"
    pairs = [(names[i], names[j]) for i in range(4) for j in range(i + 1, 4)]
    sims = spark.createDataFrame([(u, v, s) for (u, v), s in zip(pairs, [0.4, 0.4, 0.4, 0.6, 0.6, 0.6])], "u string, v string, sim double")
    active = spark.createDataFrame([("q", "all", n) for n in names], "qid string, color string, node string")
    assert one(PairSimilarity(sims).threshold(active, DedupConfig(floor=0.2, min_pairs=6))).tau == pytest.approx(0.7)


def test_conflicts(spark):
    assert fold_conflicts([("a", "b", 0.9)], {"a": 5.0, "b": 2.0}, 1.0)[0][3:] == pytest.approx((1.8, 5.0, 3.2, 2.0, 0.2))
    neg = spark.createDataFrame([("N", "P", 1.0)], "a string, b string, strength double")
    run = propagate(graph(spark, [("P", "X", 0.8)]), seed(spark, {"P": 0.9, "N": 0.7}), negative=neg, conflict=ConflictConfig())
    assert energies(run) == {"P": 1.25, "N": 0.0}
    r = one(run.conflicts)
    assert (r.node_a, r.node_b, r.hop, r.absorbed_each) == ("N", "P", 0, 4.375)
    neg = spark.createDataFrame([("A", "B", 0.5)], "a string, b string, strength double")
    run = propagate(graph(spark, [("A", "X", 1.0)]), seed(spark, {"A": 0.5, "B": 0.5}), negative=neg, conflict=ConflictConfig())
    assert energies(run)["X"] == 1.5
    neg = spark.createDataFrame([("H", "S", 1.0)], "a string, b string, strength double")
    run = propagate(graph(spark, [("T", "H", 1.0), ("H", "H2", 1.0)]), seed(spark, {"S": 0.5, "T": 0.5}), negative=neg, conflict=ConflictConfig())
    assert energies(run) == {"S": 2.0, "T": 5.0, "H": 0.0} and one(run.conflicts).hop == 1


def test_absorption_and_polarity(spark):
    adj = graph(spark, [("P", "M", 1.0), ("M", "T", 1.0)])
    for field, expect in ((8.0, {"P": 10.0, "M": 0.0}), (2.0, {"P": 10.0, "M": 4.0, "T": 2.4})):
        absorb = spark.createDataFrame([("q", "M", field)], "qid string, node string, field double")
        run = propagate(adj, seed(spark, {"P": 1}), absorb=absorb, negative_seed=NegativeSeedConfig())
        assert energies(run) == expect
    f = negative_field(graph(spark, [("X", "Y", 1.0)]), seed(spark, {"X": 1}), PropagationConfig(), 0.5)
    assert {r.node: r.field for r in f.collect()} == {"X": 5.0, "Y": 3.0}
    abc = graph(spark, [("A", "B", 0.5), ("B", "C", 0.5)])
    table = nodes(spark, [(n, "chunk", "d", 1, -1 if n == "B" else 1) for n in "ABC"])
    run = propagate(abc, seed(spark, {"A": 1}), nodes=table, polarity=PolarityConfig())
    assert energies(run) == {"A": 10.0, "B": 0.0} and one(run.disputes).absorbed == 6.0
    run = propagate(abc, seed(spark, {"A": 1}), nodes=table, polarity=PolarityConfig(coefficient=0.5))
    assert energies(run) == {"A": 10.0, "B": 3.0, "C": 1.8}


def test_mass(spark):
    table = nodes(spark, [("A", "chunk", "d", 100, 1), ("B", "chunk", "d", 600, 1), ("f1", "chunk", "d", 100, 1), ("f2", "chunk", "d", 100, 1), ("C", "chunk", "d", 100, 1)])
    cfg = PropagationConfig(threshold_ratio=0.1, mass=MassConfig(enabled=True, floor=1.0))
    run = propagate(graph(spark, [("A", "B", 1.0), ("B", "C", 1.0)]), seed(spark, {"A": 1}), cfg, nodes=table)
    assert energies(run)["C"] == pytest.approx(6 * 0.6**0.5)
    heavy = PropagationConfig(threshold_ratio=0.45, mass=MassConfig(enabled=True))
    assert "B" not in energies(propagate(graph(spark, [("A", "B", 1.0)]), seed(spark, {"A": 1}), heavy, nodes=table))


def test_colors_residue_clusters(spark):
    adj = graph(spark, [("A", "X", 0.9), ("X", "B", 0.9)])
    both = seed(spark, {"A": 1}, color="c1").unionByName(seed(spark, {"B": 1}, color="c2"))
    run = propagate(adj, both, PropagationConfig(damping=0.3))
    assert [(r.node, r.colors) for r in run.bridges().collect()] == [("X", ["c1", "c2"])]
    assert [(r.node, r.energy) for r in run.ranked().orderBy("rank").collect()] == [("A", 5.0), ("B", 5.0), ("X", 3.0)]
    warm = spark.createDataFrame([("q", "X", 2.0)], "qid string, node string, energy double")
    run = propagate(graph(spark, [("A", "B", 0.5)]), seed(spark, {"A": 1}), residue=warm)
    assert one(run.runs).injected == 12 and one(run.runs).threshold == pytest.approx(1.8) and energies(run)["X"] == 2 and energies(run)["A"] == 10
    islands = graph(spark, [("A", "B", 1.0), ("B", "C", 1.0), ("X", "Y", 1.0), ("Y", "Z", 1.0)])
    run = propagate(islands, seed(spark, {"A": 1, "X": 1}), PropagationConfig(threshold_ratio=0.05))
    parts = theme_clusters(run, islands).orderBy("rank").collect()
    assert [p.nodes for p in parts] == [["X", "Y", "Z"], ["A", "B", "C"]] or [p.nodes for p in parts] == [["A", "B", "C"], ["X", "Y", "Z"]]
    assert {p.top_node for p in parts} == {"A", "X"} and gap_warnings(theme_clusters(run, islands)).count() == 1
