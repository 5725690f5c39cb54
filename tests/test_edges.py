import pytest
from pyspark.sql import functions as F

from energraph.config import PROFILES, ColoredRetrievalConfig, ConsolidationConfig, EntityEdgeConfig, EvaluationConfig, LayerWeights, MassConfig, NLICandidateConfig, PropagationConfig, SemanticEdgeConfig, StructuralEdgeConfig
from energraph.operators import edges as eb
from energraph.operators import graph as gr
from energraph.operators.models import contradiction_scores, embed, recognise


def triples(df, digits=9):
    return {(r[0], r[1]): round(r[2], digits) for r in df.collect()}


def entities(spark, rows):
    return spark.createDataFrame(rows, "node_id string, entities array<string>")


def test_entity_edges(spark):
    e = entities(spark, [("c1", ["A", "B"]), ("c2", ["A"]), ("c3", ["A", "C"]), ("c4", ["B", "C"])])
    third = round(1 / 3, 9)
    assert triples(eb.entity_edges(e, EntityEdgeConfig(1.0))) == {("c1", "c2"): third, ("c1", "c3"): third, ("c1", "c4"): 0.5, ("c2", "c3"): third, ("c3", "c4"): 0.5}
    assert triples(eb.entity_edges(e, EntityEdgeConfig(0.5))) == {("c1", "c4"): 0.5, ("c3", "c4"): 0.5}
    sparse = entities(spark, [("c1", ["A"]), ("c2", ["A"]), ("c3", []), ("c4", None)])
    assert triples(eb.entity_edges(sparse, EntityEdgeConfig(0.5))) == {("c1", "c2"): 0.5}


def test_frequent_entity_in_blocks(spark, monkeypatch):
    e = entities(spark, [(f"n{i:03d}", ["X"]) for i in range(60)])
    monkeypatch.setattr(eb, "ENTITY_BLOCK", 7)
    assert len(triples(eb.entity_edges(e, EntityEdgeConfig(1.0)))) == 60 * 59 // 2


def test_structural_edges(spark):
    schema = "id string, source_id string, position int, section_id string"
    rows = spark.createDataFrame([("a", "d", 0, "s1"), ("b", "d", 7, "s2"), ("c", "d", 9, "s1"), ("x", "e", 0, None)], schema)
    assert triples(eb.structural_edges(rows)) == {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): 0.6}
    same = spark.createDataFrame([("a", "d", 0, "s"), ("b", "d", 1, "s")], schema)
    assert triples(eb.structural_edges(same)) == {("a", "b"): 1.0}
    assert triples(eb.structural_edges(same, StructuralEdgeConfig(adjacent=0.0))) == {("a", "b"): 0.6}
    assert triples(eb.structural_edges(same, StructuralEdgeConfig(0, 0, 0))) == {}


def test_semantic_edges(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "id string, embedding array<double>")
    assert triples(eb.semantic_edges(v)) == {("a", "b"): round(2**-0.5, 9)}
    hub = spark.createDataFrame([("hub", [1.0, 0.0]), ("twin", [1.0, -0.05]), ("far", [0.6, 0.8])], "id string, embedding array<double>")
    got = triples(eb.semantic_edges(hub, SemanticEdgeConfig(k=1)))
    assert ("far", "hub") in got and ("far", "twin") not in got
    line = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [3.0, 0.0])], "id string, embedding array<double>")
    assert set(triples(eb.semantic_edges(line, SemanticEdgeConfig(k=1)))) == {("a", "b"), ("a", "c")}


def test_layers(spark):
    schema = "layer string, u string, v string, w double, ord long"
    edges = spark.createDataFrame([("semantic", "A", "B", 0.8, 0), ("entity", "B", "A", 0.5, 0), ("learned", "X", "Y", 1.0, 0), ("entity", "A", "C", 0.9, 0), ("entity", "C", "A", 0.0, 1)], schema)
    adj = {(r.src, r.dst): round(r.w, 9) for r in gr.from_layers(edges).collect()}
    assert adj == {("A", "B"): 0.9, ("B", "A"): 0.9, ("A", "C"): 0.0, ("C", "A"): 0.0}
    assert {(r.u, r.v): r.layer for r in gr.dominant_layer(edges).collect()} == {("A", "B"): "entity", ("A", "C"): "entity"}
    assert {r.layer: r.n_edges for r in gr.layer_counts(edges).collect()} == {"semantic": 1, "entity": 3, "structural": 0, "derivation": 0, "learned": 1}
    assert gr.from_layers(edges, LayerWeights(0, 0, 0, 0, 0)).count() == 0
    with pytest.raises(ValueError):
        gr.check_edges(spark.createDataFrame([("A", "B", -1.0)], "u string, v string, w double"))
    with pytest.raises(ValueError):
        gr.check_unique(spark.createDataFrame([("A",), ("A",)], "id string"), "id")


def test_masses(spark):
    n = spark.createDataFrame([("a", "chunk", 300), ("b", "chunk", 100), ("c", "proposition", 60), ("d", "proposition", 20)], "id string, layer string, length int")
    assert {r.node: r.mass for r in gr.node_masses(n, MassConfig(enabled=True)).collect()} == {"a": 1.5, "b": 0.5, "c": 1.5, "d": 0.5}
    assert gr.node_masses(n, MassConfig()).count() == 0


def test_subjects_negative_and_pruning(spark):
    texts = spark.createDataFrame([("a", "Radio Alpha is old"), ("b", "Some radio alpha plays"), ("c", "x" * 50 + " radio alpha")], "id string, text string")
    e = entities(spark, [("a", ["radio alpha"]), ("b", ["radio alpha"]), ("c", ["radio alpha"])])
    cands = spark.createDataFrame([(0, "a", "b"), (1, "a", "c")], "ord long, a string, b string")
    kept = eb.shared_subject_pairs(cands, texts, e, NLICandidateConfig(max_subject_df_ratio=1.0)).collect()
    assert [(r.a, r.b) for r in kept] == [("a", "b")]
    said = spark.createDataFrame([("p", "the bridge is open"), ("q", "the bridge is not open")], "id string, text string")
    scored = eb.nli_edges(spark.createDataFrame([("q", "p")], "a string, b string"), said, contradiction_scores, 0.5)
    assert [(r.a, r.b) for r in scored.collect()] == [("p", "q")]
    neg = spark.createDataFrame([("x", "y", 0.4), ("y", "x", 0.9), ("x", "x", 1.0), (None, "y", 1.0), ("x", "", 1.0), ("x", "z", None)], "source string, target string, strength double")
    assert triples(eb.negative_adjacency(neg)) == {("x", "y"): 0.9}
    layers = spark.createDataFrame([("semantic", "A", "B", 1.0), ("semantic", "C", "D", 1.0), ("entity", "B", "A", 1.0)], "layer string, u string, v string, w double")
    usage = spark.createDataFrame([("A", "B", 1)], "u string, v string, n long")
    keep, gone = eb.prune_layers(layers, usage, 1, ConsolidationConfig(min_runs=1))
    assert keep.count() == 2 and [(r.u, r.v) for r in gone.collect()] == [("C", "D")]
    assert eb.prune_layers(layers, usage, 0)[1].count() == 0


def test_models(spark):
    t = spark.createDataFrame([("a", "Big Bridge"), ("b", "Big Bridge"), ("c", None)], "id string, text string")
    got = {r.id: r.embedding for r in embed(t, "passage").collect()}
    assert got["a"] == got["b"] and len(got["a"]) == 64
    assert [e.name for e in recognise(t.where("id = 'a'")).collect()[0].found] == ["Bridge"]


@pytest.mark.parametrize("make", [
    lambda: PropagationConfig(damping=1.0), lambda: PropagationConfig(seed_energy=0), lambda: PropagationConfig(max_nodes=0), lambda: MassConfig(cap=0.5), lambda: SemanticEdgeConfig(k=0),
    lambda: EntityEdgeConfig(0.0), lambda: EvaluationConfig(recall_weight=0.9), lambda: ColoredRetrievalConfig(chain_mode="x"), lambda: LayerWeights(semantic=-1),
])
def test_bounds(make):
    with pytest.raises(ValueError):
        make()
    assert PROFILES["precise"].retrieval().seed_width == 3


def test_layers_merged_where_pairs_are_made(spark, monkeypatch):
    from energraph.operators import shared

    e = entities(spark, [(f"n{i:02d}", [f"e{i % 3}", f"f{i % 5}", "x"][: 1 + i % 3]) for i in range(40)] + [("lone", [])])
    rows = [("structural", f"n{i:02d}", f"n{i + 1:02d}", 1.0, 0) for i in range(39)] + [("derivation", "n05", "n02", 0.01, 0), ("derivation", "n02", "n05", 0.3, 1), ("derivation", "lone", "n01", 1.0, 0), ("derivation", "p", "q", 0.0, 0), ("structural", "p", "q", 0.0, 0), ("structural", "n03", "n03", 1.0, 0)]
    others = spark.createDataFrame(rows, "layer string, u string, v string, w double, ord long")
    cfg = EntityEdgeConfig(0.5)
    every = others.unionByName(eb.entity_edges(e, cfg).select(F.lit("entity").alias("layer"), "u", "v", "w", F.lit(0).cast("long").alias("ord")))
    for name, n in (("UNIT_PAIRS", 20), ("BLOCK_MEMBERS", 11), ("SLICE", 13), ("BATCH", 5)):
        monkeypatch.setattr(shared, name, n)
    for weights in (LayerWeights(), LayerWeights(structural=0.0, derivation=0.0), LayerWeights(entity=0.0), LayerWeights(entity=0.01)):
        merged = gr.from_layers_and_members(others, eb.entity_members(e, cfg), weights, 6)
        assert sorted(map(tuple, merged.collect())) == sorted((r.src, r.dst, round(r.w, 6)) for r in gr.from_layers(every, weights).collect())
        layers = gr.dominant_layer_with_members(others, eb.entity_members(e, cfg), weights)
        assert sorted(map(tuple, layers.collect())) == sorted(map(tuple, gr.dominant_layer(every, weights).collect()))


def test_rarest_names_come_as_places():
    import numpy as np

    from energraph.operators.shared import _slices

    code, node = np.array([7, 9, 7, 9, 9]), np.array([0, 0, 1, 1, 2])
    by = np.argsort(code, kind="stable")
    block = {"ids": ["a", "b", "c"], "node": node, "code": code, "df": np.where(code == 7, 2, 3), "name_code": code[by], "name_node": node[by], "code_at": np.array([5, 7, 9])}
    ((u, v, _, place),) = _slices(block, block, True)
    assert list(zip(u.tolist(), v.tolist(), place.tolist())) == [(0, 1, 1), (0, 2, 2), (1, 2, 2)]
