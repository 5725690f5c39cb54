"""Cases in which an easier reading of an operator would give another result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from energraph.config import ColoredRetrievalConfig, IterativeBaselineConfig, LearnedLayerConfig, StructuralEdgeConfig
from energraph.operators import edges as eb
from energraph.operators import evaluation as ev
from energraph.operators import search as se
from energraph.operators.corpus import chunk_documents
from energraph.operators.feedback import reinforce, reinforce_runs
from energraph.operators.graph import from_edges, from_layers
from energraph.operators.retrieve import retrieve


def vec(spark, rows, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], f"{key} string, embedding array<double>")


def test_inner_product_and_cosine(spark):
    v = vec(spark, [("a", [1, 0]), ("b", [5, 5]), ("z", [0, 0]), ("n", None)])
    q = vec(spark, [("q", [1, 0])], "qid")
    inner = [(r.node, r.score) for r in se.top_k(q, v, 3).orderBy("rank").collect()]
    assert inner == [("b", 5.0), ("a", 1.0), ("z", 0.0)]
    assert [(r.node, round(r.score, 6)) for r in se.top_k(q, v, 3, metric="cosine").orderBy("rank").collect()] == [("a", 1.0), ("b", round(math.sqrt(0.5), 6))]
    assert se.top_k(q.limit(0), v, 3).count() == 0 and se.top_k(q, v.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        se.top_k(q, v, 0)


def test_both_ways_of_search_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"v{i:03d}", rng.integers(-3, 4, 4).tolist()) for i in range(300)]  # many ties
    v, q = vec(spark, rows).repartition(3), vec(spark, rows[:40], "qid")
    few = {(r.qid, r.node, round(r.score, 9), r.rank) for r in se.top_k(q, v, 7, skip_self=True).collect()}
    monkeypatch.setattr(se, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(se, "BLOCK_ROWS", 50)
    assert {(r.qid, r.node, round(r.score, 9), r.rank) for r in se.top_k(q, v, 7, skip_self=True).collect()} == few and len(few) == 280


def test_many_queries_move_no_vector(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-30, 1e30):  # the outer ones are beyond single precision
        x, y = rng.normal(size=(700, 5)) * scale, rng.normal(size=(60, 5))
        x[350:] = x[:350]  # every score twice
        v, q = vec(spark, [(f"v{i:03d}", r) for i, r in enumerate(x)]), vec(spark, [(f"q{i}", r) for i, r in enumerate(y)], "qid")
        monkeypatch.setattr(se, "BROADCAST_NUMBERS", 0)
        found = se.top_k(q, v, 3)
        assert "CoGroups" not in found._jdf.queryExecution().toString() and se.top_k(q, v, 1).count() == 60
        assert len(se._stored[v]) == 1  # two searches, one set of files
        order = [sorted(range(700), key=lambda j, s=np.einsum("bd,bd->b", np.tile(r, (700, 1)), x): (-s[j], j))[:3] for r in y]
        assert {(r.qid, r.rank): r.node for r in found.collect()} == {(f"q{i}", n + 1): f"v{j:03d}" for i, o in enumerate(order) for n, j in enumerate(o)}


def test_semantic_edges_refuse_zero_and_take_other_neighbours(spark):
    with pytest.raises(Exception, match="no direction"):
        eb.semantic_edges(vec(spark, [("a", [1, 0]), ("z", [0, 0])])).collect()
    given = spark.createDataFrame([("b", "a", 0.5), ("a", "b", 0.5), ("a", "c", 0.0)], "qid string, node string, score double")
    assert [tuple(r) for r in eb.semantic_edges(vec(spark, [("a", [1, 0])]), neighbours=lambda v, k: given).collect()] == [("a", "b", 0.5)]


def test_weights_are_checked_and_the_last_wins(spark):
    rows = spark.createDataFrame([("semantic", "a", "b", 1.0, 2), ("semantic", "b", "a", 0.2, 5), ("entity", "a", "b", 0.5, 1)], "layer string, u string, v string, w double, ord long")
    assert {(r.src, r.dst): r.w for r in from_layers(rows).collect()} == {("a", "b"): 0.6, ("b", "a"): 0.6}
    assert {(r.src, r.dst): r.w for r in from_edges(rows.where("layer = 'semantic'"), directed=True).collect()} == {("a", "b"): 1.0, ("b", "a"): 0.2}
    for bad in (-1.0, None):
        broken = spark.createDataFrame([("semantic", "a", "b", bad, 1)], rows.schema)
        for build in (from_edges, from_layers):
            with pytest.raises(Exception, match="negative or null"):
                build(broken).collect()


def refs(spark, rows):
    return spark.createDataFrame(rows, "id string, source_id string, position int, section_id string").repartition(5)


def test_one_source_with_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(eb, "ENTITY_BLOCK", 16)
    rows = [(f"h{i:04d}", "hot", 3 * i, "s" if i < 60 else None) for i in range(900)] + [(f"c{i:03d}", f"d{i // 2}", i, f"t{i}") for i in range(100)]
    got = {(r.u, r.v): r.w for r in eb.structural_edges(refs(spark, rows)).collect()}
    want = {}
    for a, b in ((x, y) for i, x in enumerate(rows) for y in rows[i + 1 :]):
        if a[1] == b[1]:
            step = int(b[0][1:]) - int(a[0][1:]) == 1
            if step or (a[3] and a[3] == b[3]):
                want[a[0], b[0]] = 1.0 if step else 0.6
    assert got == want
    steps = {(r.a, r.b) for r in eb.adjacent_pairs(refs(spark, rows)).collect()}
    assert len(steps) == 899 + 50
    assert eb.structural_edges(refs(spark, [])).count() == 0 and eb.structural_edges(refs(spark, rows), StructuralEdgeConfig(0, 0, 0)).count() == 0
    with pytest.raises(Exception, match="share a position"):
        eb.structural_edges(refs(spark, [("a", "x", 1, None), ("b", "x", 1, None)])).collect()


def test_chunks_refuse_blank_units_and_repeated_sources(spark):
    def docs(*rows):
        return spark.createDataFrame([(s, [(t, None) for t in units]) for s, units in rows], "source_id string, units array<struct<text:string,section_id:string>>")

    assert [(r.id, r.length) for r in chunk_documents(docs(("a", ["x", "yÿ"]), ("b", []))).orderBy("id").collect()] == [("a:0", 1), ("a:1", 2)]
    with pytest.raises(Exception, match="blank unit"):
        chunk_documents(docs(("a", ["　\t"]))).collect()
    for bad in (docs(("a", ["x"]), ("a", ["y"])), docs(("", ["x"]))):
        with pytest.raises(ValueError):
            chunk_documents(bad)


def test_names_match_in_any_case(spark):
    cand = spark.createDataFrame([(0, "a", "b"), (1, "a", "c")], "ord int, a string, b string")
    texts = spark.createDataFrame([("a", "Die STRASSE war"), ("b", "straße lang"), ("c", "nothing")], "id string, text string")
    names = spark.createDataFrame([("a", ["Straße"]), ("b", ["STRASSE"]), ("c", ["Straße"]), *[(f"x{i}", []) for i in range(700)]], "node_id string, entities array<string>")
    assert [r.ord for r in eb.shared_subject_pairs(cand, texts, names).collect()] == [0]
    rows = spark.createDataFrame([("1", "Alte STRAẞE", "t", 0)], "id string, title string, text string, ord int")
    assert se.atom_search(rows, "strasse").count() == 1


def test_p_counts_the_other_side_of_the_mean():
    a = np.array([0.0] * 9 + [10.0])
    b = np.full(10, 0.9)
    mean, low, high, p = ev.bootstrap(a, b, 2000)
    rng = np.random.default_rng(20260816)
    means = np.concatenate([(a - b)[rng.integers(0, 10, (1000, 10))].mean(axis=1) for _ in range(2)])
    assert mean == pytest.approx(0.1) and p == min(1.0, 2 * (means <= 0).mean())
    assert ev.bootstrap(b, a, 2000)[3] == min(1.0, 2 * (-means >= 0).mean())


def test_the_first_colour_is_the_one_given_first(spark):
    v = vec(spark, [("a", [1, 0]), ("b", [0, 1])])
    adj = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    rows = [("q", "zuerst", 0, [1.0, 0.0]), ("q", "danach", 1, [-1.0, -1.0])]
    q = spark.createDataFrame(rows, "qid string, color string, place int, embedding array<double>")
    run = retrieve(q, v, adj, ColoredRetrievalConfig()).bundle
    assert {r.color for r in run.runs.collect()} == {"zuerst"}
    with pytest.raises(ValueError):
        retrieve(q.withColumn("place", -F.col("place")), v, adj, ColoredRetrievalConfig())


def test_runs_folded_in_blocks(spark, monkeypatch):
    from energraph.operators import feedback

    cfg = LearnedLayerConfig(learning_rate=0.5, forgetting=0.9, max_strength=0.8)
    rows = [(run, "a", "b", g) for run, g in ((0, 0.9), (1, 0.9), (1, 0.4), (5, 0.1), (6, 0.9), (7, 0.9), (13, 0.2))] + [(9, "a", "c", 0.3)]
    pairs = spark.createDataFrame(rows, "run int, u string, v string, gain double")
    want = None
    for run in range(14):
        want = reinforce(want, pairs.where(F.col("run") == run).select("u", "v", "gain"), cfg)
        want = spark.createDataFrame(want.collect(), "u string, v string, strength double")
    expect = {(r.u, r.v): pytest.approx(r.strength) for r in want.collect()}
    for block in (4096, 3):
        monkeypatch.setattr(feedback, "RUN_BLOCK", block)
        assert {(r.u, r.v): r.strength for r in reinforce_runs(pairs, cfg).collect()} == expect


def test_gold_counted_from_lists_equals_gold_given_as_arrays(spark):
    rows = [("q1", 2, ["a", "b", "c"], ["b"], "threshold", ["a", "x#1", "x#2", "b"], ["x", "b#3", "c"], ["c"]), ("q2", 3, ["z"], None, "max_hop", ["y"], ["z#0", "z#1"], ["y", "z"])]
    per_query = spark.createDataFrame(rows, "id string, hops int, gold array<string>, bridge_gold array<string>, stop_reason string, topk array<string>, web array<string>, iterative array<string>")
    want = {tuple(r) for r in ev.measures(per_query).collect()}
    lists = [(r[0], s, n, i + 1) for r in rows for s, col in (("topk", 5), ("web", 6), ("iterative", 7)) for i, n in enumerate(r[col])]
    hits = [(i, n, n.split("#")[0] in (r[3] or [])) for r in rows for i, _, n, _ in lists if i == r[0] and n.split("#")[0] in r[2]]
    sizes = [(r[0], r[1], r[4], len(r[2]), len(r[3] or [])) for r in rows]
    got = ev.measures_of_lists(
        spark.createDataFrame(lists, "id string, system string, node string, rank int"),
        spark.createDataFrame(hits, "id string, node string, bridge boolean"),
        spark.createDataFrame(sizes, "id string, hops int, stop_reason string, n_gold long, n_bridge long"),
    )
    assert {tuple(r) for r in got.collect()} == want and len(want) == 18


def test_full_lists_refuse_new_ids_but_improve_known_ones(spark):
    v = vec(spark, [("a", [1, 0]), ("b", [0.9, 0]), ("c", [0, 1]), ("d", [0, 0.9])])
    q = vec(spark, [("q", [1, 0.1])], "qid")
    steps = iter([[0.5, 2.0], [3.0, 0.0]])

    def follow(open_, held, step):
        return vec(spark, [("q", next(steps))], "qid")

    got = {r.node: (r.score, r.step) for r in ev.iterative_retrieve(q, v, follow, IterativeBaselineConfig(per_step_k=2, max_steps=2, max_collected=3)).collect()}
    assert got == {"a": (3.0, 0), "b": (pytest.approx(2.7), 0), "c": (2.0, 1)}
