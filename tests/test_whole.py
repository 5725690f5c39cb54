"""Queries over small tables of their own, held against results worked out here."""

import datetime
import math
import os
from itertools import combinations

import pytest

from energraph.config import PropagationConfig
from energraph.plans import layers, waves

N = 100
#: One entity in two of 100 nodes (just within the guard of 0.02), one in three (beyond it).
NAMES = {0: ["Lake  Baikal"], 7: ["lake baikal", "Often"], 20: ["Often"], 31: ["often"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")

    at = datetime.datetime(2026, 1, 1)
    put("entities", [(f"n{i:02d}", NAMES.get(i, []), at) for i in range(N)], "node_id string, entities array<string>, loaded_at timestamp")
    put("passages", [("n00", "s", 0, "a"), ("n01", "s", 1, "b")], "chunk_id string, source_id string, pos int, section_id string")
    put("propositions", [("n20#0", "n20", "x")], "id string, chunk_id string, text string")
    return d


def entity_pairs():
    own = {i: {" ".join(x.lower().split()) for x in names} for i, names in NAMES.items()}
    df = {e: sum(e in x for x in own.values()) for x in own.values() for e in x}
    said = {}
    for a, b in combinations(sorted(own), 2):
        if both := [e for e in own[a] & own[b] if 2 <= df[e] <= 0.02 * N]:
            said[f"n{a:02d}", f"n{b:02d}"] = (sum(1 / df[e] for e in both), min(both))
    return said


def test_entity_layer_keeps_what_the_guard_allows(spark, folder):
    want = entity_pairs()
    assert want == {("n00", "n07"): (0.5, "lake baikal")}
    assert {(r.u, r.v): r.w for r in layers.entity_edges(spark, folder).collect()} == {k: w for k, (w, _) in want.items()}
    assert [tuple(r) for r in layers.edge_labels(spark, folder).select("u", "v", "label").collect()] == [("n00", "n07", "lake baikal")]
    merged = {(r.src, r.dst): r.w for r in layers.merge_layers(spark, folder).collect()}
    assert merged == {("n00", "n07"): 0.5, ("n07", "n00"): 0.5, ("n00", "n01"): 0.3, ("n01", "n00"): 0.3, ("n20", "n20#0"): 1.0, ("n20#0", "n20"): 1.0}
    assert {(r.u, r.v): r.layer for r in layers.layer_of_edge(spark, folder).collect()}["n00", "n07"] == "entity"
    assert {r.layer: r.n_edges for r in layers.layer_counts(spark, folder).collect()}["entity"] == 1


def test_listing_items_in_any_script(spark, tmp_path):
    lines = ["- 山風海の橋", "１. Башню восстановил", "　* Lebe vivió", "\t2. plain", "　　", "+ وصل تولينو"]
    rows = [(1, "listing", "\n".join(lines)), (2, "listing", "Straße нет"), (3, "note", "- no"), (4, "listing", None)]
    spark.createDataFrame(rows, "doc_id long, kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in layers.parse_listings(spark, str(tmp_path)).collect())
    assert got == [(1, 0, "山風海の橋"), (1, 1, "Башню восстановил"), (1, 2, "Lebe vivió"), (1, 3, "plain"), (1, 4, "وصل تولينو"), (2, 0, "Straße"), (2, 1, "нет")]


def test_snippets_of_whole_texts(spark, tmp_path):
    long = "Größe " + "湖" * 200
    rows = [("Lake#1", None, "L'été à　Þingvellir — озеро"), ("b", "Salt LAKE", long), ("c", "lake", None), ("d", "river", "lake")]
    spark.createDataFrame(rows, "chunk_id string, title string, text string").write.parquet(f"{tmp_path}/passages.parquet")
    got = {r.id: r.snippet for r in layers.atom_search(spark, str(tmp_path)).collect()}
    assert got == {"Lake#1": "L'été à Þingvellir — озеро", "b": long[:159] + "…", "c": ""}


def test_subjects_up_to_the_default_ratio(spark, tmp_path):
    """600 nodes: "mill" in 3 (0.005) counts, "town" in 4 does not; 0.0005 would allow none."""
    at = datetime.datetime(2026, 1, 1)
    names = {"p0": ["Mill"], "p1": ["mill", "town"], "p2": ["town"], "p3": ["town"], "p4": ["town", "mill"]}
    texts = {"p0": "Mill of old", "p1": "The mill in town", "p2": "town one", "p3": "town two", "p4": "town " * 9 + "mill"}
    vecs = {"p0": [1.0, 0.0], "p1": [0.9, 0.1], "p2": [0.0, 1.0], "p3": [0.0, 1.0], "p4": [1.0, 0.1], "p5": [1.0, 0.0]}

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("entities", [(i, e, at) for i, e in names.items()] + [(f"x{i}", [], at) for i in range(595)], "node_id string, entities array<string>, loaded_at timestamp")
    put("propositions", [(i, "c", t) for i, t in texts.items()], "id string, chunk_id string, text string")
    put("vectors", list(vecs.items()), "id string, embedding array<float>")
    assert [(r.a, r.b) for r in layers.nli_subject_pairs(spark, str(tmp_path)).collect()] == [("p0", "p1")]
    near = layers.nli_candidates(spark, str(tmp_path)).collect()
    assert [(r.a, r.b, round(r.similarity, 4)) for r in near] == [("p0", "p1", round(0.9 / 0.82**0.5, 4))]


def iterated(vecs, ask):
    """The steps of one query, one at a time: it goes on with the best id that its last step brought."""
    own, held = ask, {}
    for step in range(5):  # the question's own search and four that follow
        score = {i: sum(x * y for x, y in zip(vecs[ask], v)) for i, v in enumerate(vecs)}
        for i in sorted(score, key=lambda i: (-score[i], i))[:5]:
            if i in held or len(held) < 20:
                best, at = held.get(i, (-2, step))
                held[i] = (max(best, score[i]), at)
        if not (new := [(s, i) for i, (s, at) in held.items() if at == step and i != own]):
            break
        ask = max(new)[1]
    return held


def test_iterative_takes_all_steps(spark, tmp_path):
    vecs = [[math.sin(1 + 7.3 * i * d + d * d) for d in range(1, 7)] for i in range(80)]
    vecs = [[x / math.hypot(*v) for x in v] for v in vecs]
    spark.createDataFrame([(i, e, i % 3) for i, e in enumerate(vecs)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(q, i): (round(s, 6), at) for q in range(0, 80, 20) for i, (s, at) in iterated(vecs, q).items()}
    assert max(at for _, at in want.values()) >= 3
    got = {(int(r.qid[1:]), int(r.node[1:])): (round(r.score, 6), r.step) for r in waves.iterative_retrieval(spark, str(tmp_path)).collect()}
    assert got == want
    assert {r.system for r in waves.evaluation_report(spark, str(tmp_path)).collect()} == {"topk", "web", "iterative"}


def test_hops_beyond_the_unrolled_ones(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    assert waves.thermal_sessions(spark, d).agg({"hop": "max"}).first()[0] > 2
    assert waves.THEMES.max_hop == waves.WAVE.max_hop == PropagationConfig().max_hop


def test_conflicts_of_nodes_in_several_pairs(spark):
    """Whatever the hop, each run's records follow from one another in the order of the pairs."""
    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    rows = waves.conflict_web(spark, d).collect()
    runs = {}
    for r in rows:
        runs.setdefault((r.qid, r.hop), []).append(r)
    shared = 0
    for found in runs.values():
        level = {}
        for r in sorted(found, key=lambda r: (r.node_a, r.node_b)):
            for node, after in ((r.node_a, r.a_after), (r.node_b, r.b_after)):
                if node in level:
                    shared += 1
                    assert after + r.absorbed_each == pytest.approx(level[node], abs=5e-6)
                level[node] = after
    assert rows and shared
