"""Pairs that share names: whole, each once, in no more memory than two blocks."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from energraph.config import EntityEdgeConfig, NLICandidateConfig
from energraph.operators import edges as eb
from energraph.operators import shared as sh
from energraph.plans import builds, layers


def drawn(n=60, names=25):
    rng = np.random.default_rng(7)
    return {f"n{i:02d}é" if i % 7 else f"ñ{i}": sorted({f"e{x}" for x in rng.integers(0, names, rng.integers(0, 5))}) for i in range(n)}


def expected(own):
    df, w, label = defaultdict(int), {}, {}
    for x in own.values():
        for e in x:
            df[e] += 1
    for a, b in combinations(sorted(own), 2):
        if both := set(own[a]) & set(own[b]):
            w[a, b], label[a, b] = sum(1 / df[e] for e in both), min(both, key=lambda e: (df[e], e))
    return w, label


@pytest.mark.parametrize("members, slice_", [(7, 5), (1000, 1000)])
def test_blocks_give_every_pair_once(spark, monkeypatch, members, slice_):
    monkeypatch.setattr(sh, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(sh, "SLICE", slice_)
    own = drawn()
    w, label = expected(own)
    e = spark.createDataFrame(list(own.items()), "node_id string, entities array<string>")
    got = eb.entity_edges(e, EntityEdgeConfig(1.0)).collect()
    assert len(got) == len(w) and {(r.u, r.v): r.w for r in got} == pytest.approx(w)
    assert {(r.u, r.v): r.label for r in eb.entity_labels(e, EntityEdgeConfig(1.0)).collect()} == label
    assert eb.count_entity_edges(e, EntityEdgeConfig(1.0)).first().n == len(w)
    assert eb.count_entity_edges(e.where("node_id = ''"), EntityEdgeConfig(1.0)).first().n == 0


def test_no_pair_is_shuffled(spark):
    """The plan of the pairs ends in the tasks that make them."""
    e = spark.createDataFrame([("a", ["x"]), ("b", ["x"])], "node_id string, entities array<string>")
    for df in (eb.entity_edges(e, EntityEdgeConfig(1.0)), eb.entity_labels(e, EntityEdgeConfig(1.0))):
        above = df._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert not any(x in above for x in ("Aggregate", "Join", "Sort"))


def shuffled(spark) -> int:
    """Bytes that the session's stages have shuffled so far."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_names_are_not_shuffled_with_ids(spark):
    """Before pairs are made, a mention moves once, as 8 bytes beside its node's others."""
    names = ", ".join(f"md5(CAST((id * {k} + {k}) % 4001 AS STRING))" for k in (3, 5, 7, 11))
    e = spark.range(0, 20_000, 1, 2).selectExpr("format_string('n%06d', id) AS node_id", f"array({names}) AS entities")
    before = shuffled(spark)
    eb.entity_labels(e, EntityEdgeConfig(1.0))
    assert shuffled(spark) - before < 20_000 * 4 * 70


def test_two_names_with_one_key(spark, monkeypatch):
    """Another seed is taken if keys of names meet."""
    own = drawn()
    e = spark.createDataFrame(list(own.items()), "node_id string, entities array<string>")
    hash_, seeds = sh.F.xxhash64, []

    def meeting(*cols):
        seeds.append(len(seeds))
        return F.lit(1).cast("bigint") if len(seeds) == 1 else hash_(*cols)

    monkeypatch.setattr(sh.F, "xxhash64", meeting)
    got = {(r.u, r.v): r.label for r in eb.entity_labels(e, EntityEdgeConfig(1.0)).collect()}
    assert got == expected(own)[1] and len(seeds) >= 3


@pytest.mark.parametrize("query", [layers.merge_layers, layers.layer_of_edge])
def test_layers_meet_names_that_move_once(spark, tmp_path, query):
    """Nor do the queries that merge layers shuffle a name for each mention."""
    spark.createDataFrame([("n000001", "s", 0, None), ("n000002", "s", 1, None)], "chunk_id string, source_id string, pos int, section_id string").write.parquet(f"{tmp_path}/passages.parquet")
    spark.createDataFrame([("n000003", "n000001")], "id string, chunk_id string").write.parquet(f"{tmp_path}/propositions.parquet")
    names = ", ".join(f"md5(CAST((id * {k} + {k}) % 4001 AS STRING))" for k in (3, 5, 7, 11))
    spark.range(0, 20_000, 1, 2).selectExpr("format_string('n%06d', id) AS node_id", f"array({names}) AS entities", "TIMESTAMP '2026-01-01' AS loaded_at").write.parquet(f"{tmp_path}/entities.parquet")
    before = shuffled(spark)
    query(spark, str(tmp_path))
    assert shuffled(spark) - before < 20_000 * 4 * 100


def test_rounding_is_that_of_the_engine(spark):
    x = [1 / 128, 3 / 128, 1 / 3, 2 / 3, 0.5, 1e-9, 0.0000005, 0.1234565, 1.0000005, 5 / 640] + [1 / n + 1 / m for n in range(2, 400, 7) for m in range(2, 400, 11)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert sh.rounded(np.array(x), 6).tolist() == want


def test_a_layer_that_is_off_is_not_computed(spark, monkeypatch, tmp_path):
    spark.createDataFrame([("a", "s", 0, None), ("b", "s", 1, None)], "chunk_id string, source_id string, pos int, section_id string").write.parquet(f"{tmp_path}/passages.parquet")
    spark.createDataFrame([("a#0", "a")], "id string, chunk_id string").write.parquet(f"{tmp_path}/propositions.parquet")
    monkeypatch.setattr(eb, "entity_edges", lambda *_: pytest.fail("the entity layer is off"))
    got = {(r.src, r.dst): r.w for r in layers.merge_layers_disabled(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): 0.3, ("b", "a"): 0.3, ("a", "a#0"): 1.0, ("a#0", "a"): 1.0}


def test_subject_pairs_make_no_other_pairs(spark, monkeypatch):
    texts = spark.createDataFrame([("a", "Radio Alpha is old"), ("b", "Some radio alpha plays"), ("c", "x" * 50 + " radio alpha"), ("d", None)], "id string, text string")
    e = spark.createDataFrame([(x, ["radio alpha"]) for x in "abcd"], "node_id string, entities array<string>")
    monkeypatch.setattr(eb, "entity_edges", lambda *_: pytest.fail("pairs that share anything are not asked for"))
    assert [tuple(r) for r in eb.subject_pairs(texts, e, NLICandidateConfig(max_subject_df_ratio=1.0)).collect()] == [("a", "b")]


def test_the_nodes_of_an_index_need_no_later_stage(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(builds, "_capital_words", lambda _: pytest.fail("the names are not read"))
    text = "Baikal is a deep lake. It never freezes over here.\nIt lies in Siberia"
    spark.createDataFrame([(1, "passage", text), (2, "listing", text)], "doc_id long, kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.layer: (r.n, r.length) for r in builds.index_nodes(spark, str(tmp_path)).collect()}
    lines = text.split("\n")
    facts = ["Baikal is a deep lake.", "It never freezes over here.", lines[1]]
    assert got == {"chunk": (2, sum(map(len, lines))), "proposition": (3, sum(map(len, facts)))}
