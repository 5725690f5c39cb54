import numpy as np
import pytest

from energraph.config import DedupConfig, EvaluationConfig, LearnedLayerConfig, PropagationConfig, RetrievalConfig, ThermalConfig
from energraph.functions import text as tx
from energraph.operators import evaluation as ev
from energraph.operators.corpus import parse_propositions, sample_ids
from energraph.operators.feedback import reinforce, reinforce_runs, residue
from energraph.operators.graph import from_edges
from energraph.operators.outputs import spring_positions
from energraph.operators.retrieve import retrieve, select_contacts
from energraph.sources.datasets import read_arrays, read_lines
from energraph.sources.index import Index, cached_completions, pairs_from_snapshot, pairs_to_snapshot
from pyspark.sql import functions as F


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def test_measures(spark):
    r, gold = arr("g1#p2", "g1#p5", "x#p0", "g2"), arr("g1", "g2", "g3")
    assert value(spark, ev.passages_at_k(r, 3)) == ["g1", "x", "g2"]
    assert value(spark, ev.support_recall(r, gold, 3)) == pytest.approx(2 / 3)
    assert value(spark, ev.novelty(arr("g1#p0", "g2"), arr("g1", "z"), gold, 2)) == pytest.approx(1 / 3)
    assert value(spark, ev.nodes_for_k_passages(r, 2)) == ["g1#p2", "g1#p5", "x#p0"] and len(value(spark, ev.nodes_for_k_passages(r, 9))) == 4
    with pytest.raises(Exception):
        value(spark, ev.support_recall(r, F.array().cast("array<string>"), 3))
    rows = [("a", 2, ["g"], ["g"], "threshold", ["g", "x"], ["y", "g"]), ("b", 3, ["h"], [], "max_hop", ["x"], ["h"])]
    per = spark.createDataFrame(rows, "id string, hops int, gold array<string>, bridge_gold array<string>, stop_reason string, topk array<string>, web array<string>")
    scores = ev.measures(per, EvaluationConfig(k_values=(1, 2)))
    got = {(r.system, r.k): (r.recall, r.novelty) for r in ev.report(scores).collect()}
    assert got == {("topk", 1): (0.5, 0.0), ("topk", 2): (0.5, 0.0), ("web", 1): (0.5, 0.5), ("web", 2): (1.0, 0.5)}
    assert "| web | 2 | 1.000 |" in ev.render_report(ev.report(scores), "Report")
    assert ev.bootstrap(np.array([]), np.array([])) == (0.0, 0.0, 0.0, 1.0) and ev.bootstrap(np.ones(5), np.zeros(5), 200)[:3] == (1.0, 1.0, 1.0)
    assert ev.poisson_bootstrap(scores, EvaluationConfig(k_values=(1, 2)), 50).count() == 1


def test_text(spark):
    s = F.lit
    assert value(spark, tx.parse_listing(s("- one\n* two\n3. three\n\n- 4. four"))) == ["one", "two", "three", "4. four"]
    assert value(spark, tx.parse_subqueries(s("Here are:\n1. Who?\n- What?"), s("q"))) == ["Who?", "What?"]
    assert value(spark, tx.parse_subqueries(s("queries:"), s("q"))) == ["q"]
    assert value(spark, tx.parse_answer(s("none known"))) == "" and value(spark, tx.parse_answer(s("a b c d"), 2)) == "a b"
    assert value(spark, tx.first_sentence(s("\nIt is. Or not."))) == "It is."
    assert value(spark, tx.snippet(s("a  b\nc"), 9)) == "a b c" and value(spark, tx.snippet(s("abcdef"), 4)) == "abc…"
    assert value(spark, tx.normal_entities(arr("  Straße X ", "STRASSE x", ""))) == ["strasse x"]
    replies = spark.createDataFrame([("c", "s", "- The bridge opened in 1900.\n- the  bridge OPENED in 1900.\nshort\nNEG: The lake has no bridge.\n- A third full sentence.")], "chunk_id string, source_id string, reply string")
    from energraph.config import PropositionConfig

    got = parse_propositions(replies, PropositionConfig(max_per_chunk=2, tag_polarity=True)).orderBy("id").collect()
    assert [(r.id, r.polarity) for r in got] == [("c#p0", 1), ("c#p1", -1)] and got[1].text == "The lake has no bridge."
    assert sample_ids(["b", "a", "c"], EvaluationConfig(sample_size=0)) == ["a", "b", "c"] and len(sample_ids(list("abcdef"), EvaluationConfig(sample_size=3))) == 3


def test_contacts(spark):
    c = spark.createDataFrame([("q", "all", n, s) for n, s in (("a", 0.9), ("a_dup", 0.89), ("c", 0.7), ("d", 0.5), ("dead", 0.0), ("anti", -0.3))], "qid string, color string, node string, score double")
    pairs = spark.createDataFrame([("a", "a_dup", 0.97)], "u string, v string, sim double")
    got = select_contacts(c, 2, DedupConfig(floor=0.9, min_pairs=100), pairs).collect()
    assert {r.node: r.survivor for r in got} == {"a": None, "a_dup": "a", "c": None} and {r.tau for r in got} == {0.9}
    assert {r.node for r in select_contacts(c, 2).collect()} == {"a", "a_dup"}
    props = spark.createDataFrame([("q", "all", n, s) for n, s in (("p1#p0", 0.9), ("p1#p3", 0.88), ("p2", 0.7), ("p3", 0.5))], "qid string, color string, node string, score double")
    src = spark.createDataFrame([("p1#p0", "d1"), ("p1#p3", "d1"), ("p2", "d2"), ("p3", "d3")], "node string, source string")
    assert {r.node: r.survivor for r in select_contacts(props, 2, DedupConfig(), None, src).collect()} == {"p1#p0": None, "p1#p3": "p1#p0", "p2": None}


def test_retrieve(spark):
    adj = from_edges(spark.createDataFrame([("P", "M", 1.0, 0), ("M", "T", 1.0, 1)], "u string, v string, w double, ord long"))
    v = spark.createDataFrame([("P", [1.0, 0.0, 0.0]), ("M", [0.0, 1.0, 0.0]), ("T", [0.0, 0.0, 1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "qid string, embedding array<double>")
    n = spark.createDataFrame([("q", "n", [0.0, 1.0, 0.0])], "qid string, part string, embedding array<double>")
    run = retrieve(q, v, adj, RetrievalConfig(seed_width=2), negatives=n).bundle
    e = {r.node: round(r.energy, 9) for r in run.activations.collect()}
    assert e["P"] == 7.0 and e["M"] == 0.0 and "T" not in e
    assert sorted((r.node, round(r.absorbed, 9)) for r in run.absorptions.collect()) == [("M", 4.2), ("P", 3.0)]
    with pytest.raises(ValueError):
        retrieve(spark.createDataFrame([("q", [-1.0, 0.0, 0.0])], "qid string, embedding array<double>"), v, adj)


def test_feedback(spark):
    pairs = spark.createDataFrame([("A", "B", 0.6)], "u string, v string, gain double")
    once = reinforce(None, pairs)
    assert once.first().strength == pytest.approx(0.06) and reinforce(once, pairs).first().strength == pytest.approx(0.06 * 0.99 + 0.06)
    runs = spark.createDataFrame([(0, "A", "B", 0.6), (1, "A", "B", 0.6), (1, "C", "D", 50.0)], "run long, u string, v string, gain double")
    assert {r.u: round(r.strength, 9) for r in reinforce_runs(runs, LearnedLayerConfig()).collect()} == {"A": round(0.06 * 0.99 + 0.06, 9), "C": 1.0}
    act = spark.createDataFrame([("q", "A", 10.0), ("q", "B", 0.0)], "qid string, node string, energy double")
    assert [(r.node, r.energy) for r in residue(act).collect()] == [("A", 2.5)] and residue(act, ThermalConfig(enabled=False)).count() == 0


def test_learned_stream_equals_batch(spark, tmp_path):
    from energraph.streaming.sessions import learned_stream

    rows = [(0, "A", "B", 0.6), (1, "A", "B", 0.6), (3, "A", "B", 0.2)]
    schema = "run long, u string, v string, gain double"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = learned_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("learned").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = reinforce_runs(spark.createDataFrame(rows, schema)).first().strength
    assert max(((r.run, r.strength) for r in spark.table("learned").collect()))[1] == pytest.approx(want)


def test_sources(spark, tmp_path):
    lines = tmp_path / "set.jsonl"
    para = '{"idx": %d, "title": "%s", "paragraph_text": "%s", "is_supporting": %s}'
    first = '{"id": "2hop__1", "question": "old", "answer": "a", "paragraphs": [], "question_decomposition": []}'
    ps = ", ".join(para % x for x in ((0, "Beta", "b", "true"), (1, "Alpha", "a", "true"), (2, "Gamma", "c", "false")))
    steps = '{"id": 1, "question": "x", "answer": "y", "paragraph_support_idx": 1}, {"id": 2, "question": "x", "answer": "y", "paragraph_support_idx": 0}'
    lines.write_text(first + "\n\n" + '{"id": "2hop__1", "question": "new", "answer": "a", "paragraphs": [%s], "question_decomposition": [%s]}' % (ps, steps) + "\n")
    got = read_lines(spark, str(lines))
    q = got["questions"].first()
    assert (q.question, q.hops, q.gold, q.bridge_gold) == ("new", 2, ["d00001:0", "d00000:0"], ["d00000:0"]) and got["pool"].count() == 3
    array = tmp_path / "set.json"
    array.write_text('[{"_id": "1", "type": "compositional", "question": "q", "answer": "Paris", "context": [["A", ["In Paris.", " Yes."]], ["B", ["By B."]], ["C", ["No."]]], "supporting_facts": [["A", 0], ["B", 0]]}]')
    q = read_arrays(spark, str(array))["questions"].first()
    assert q.id == "compositional__1" and q.gold == ["d00000:0", "d00001:0"] and q.bridge_gold == ["d00001:0"]
    index = Index(spark, str(tmp_path / "index"))
    vec = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    index.append_vectors(vec)
    with pytest.raises(ValueError):
        index.append_vectors(vec)
    assert index.plan()["vectors"] and not index.plan()["edges"] and index.negative_edges().count() == 0
    e = spark.createDataFrame([("entity", "a", "b", 1.0, 0)], "layer string, u string, v string, w double, ord long")
    assert index.write_edges(e) and not index.write_edges(e) and index.graph().count() == 2
    snap = pairs_to_snapshot(e, "w")
    assert pairs_from_snapshot(snap, "w").first().v == "b"
    cache = spark.createDataFrame([], "key string, response string")
    answers, fresh = cached_completions(spark.createDataFrame([("p",), ("p",)], "prompt string"), cache, lambda m: m.withColumn("response", F.lit("r")))
    assert answers.count() == 2 and fresh.count() == 1


def test_layout():
    p = spring_positions(["a", "b", "c"], [("a", "b", 1.0)], 50)
    assert p.shape == (3, 2) and (p == spring_positions(["a", "b", "c"], [("a", "b", 1.0)], 50)).all() and p.min() >= 0 and p.max() <= 1
    assert PropagationConfig().max_hop == 8
