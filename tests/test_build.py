"""The whole way: reading, building, retrieving, showing; streams; the command line."""

import json

import pytest
from pyspark.sql import functions as F

from energraph.__main__ import main
from energraph.config import EntityEdgeConfig, EvaluationConfig, IterativeBaselineConfig, LayerWeights, NLICandidateConfig, PropagationConfig
from energraph.operators import evaluation as ev
from energraph.operators import models as md
from energraph.operators.chain import passages_prompt, sentence_rewriter
from energraph.operators.graph import from_layers
from energraph.operators.inspect import inspect, render_spec
from energraph.operators.propagate import propagate
from energraph.operators.retrieve import Retrieval
from energraph.sources.build import IndexConfig, Models, build_index
from energraph.sources.datasets import read_lines
from energraph.sources.index import Index
from energraph.streaming.sessions import learned_stream, warmth_stream


def record(i, question, supporting=True):
    para = [{"idx": k, "title": f"t{k}", "paragraph_text": f"p{k}", "is_supporting": supporting} for k in range(2)]
    return json.dumps({"id": i, "question": question, "answer": "a", "paragraphs": para, "question_decomposition": [{"id": k, "paragraph_support_idx": k} for k in range(2)]})


def test_lines_of_many_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([record("2hop__1", "old")] + [record(f"2hop__{i}", "x" * 300) for i in range(2, 9)]))
    (tmp_path / "b.jsonl").write_text(record("2hop__1", "new") + "\n \t\n")
    got = {r.id: r.question for r in read_lines(spark, str(tmp_path))["questions"].collect()}
    assert got["2hop__1"] == "new" and len(got) == 8
    few = [r.id for r in read_lines(spark, str(tmp_path), EvaluationConfig(sample_size=3, sample_seed=1))["questions"].collect()]
    assert len(few) == 3
    (tmp_path / "c.jsonl").write_text(record("2hop__9", "no gold", supporting=False))
    with pytest.raises(Exception, match="no gold for 2hop__9"):
        read_lines(spark, str(tmp_path))["questions"].collect()


def capital(texts):
    return texts.withColumn("found", F.transform(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0), lambda w: F.struct(w.alias("name"), F.lit("MISC").alias("label"))))


def test_index_from_documents_to_graph(spark, tmp_path):
    rows = [("d1", [("Baikal is a deep lake. Baikal never freezes over", "s"), ("It lies in Siberia", "s")]), ("d2", [("Baikal does freeze over in winter", None)])]
    docs = spark.createDataFrame(rows, "source_id string, units array<struct<text:string,section_id:string>>")
    calls = []

    def extract(chunks):
        calls.append(1)
        return chunks.withColumn("reply", F.regexp_replace("text", r"\. ", "\n"))

    def contradict(pairs):
        return pairs.withColumn("score", F.when(F.col("premise").contains("never") != F.col("hypothesis").contains("never"), 0.95).otherwise(0.0))

    made = Models(lambda t: md.embed(t, "passage"), capital, extract, contradict)
    cfg = IndexConfig(nli=NLICandidateConfig(min_similarity=0.0, max_subject_df_ratio=1.0))
    index = Index(spark, str(tmp_path))
    assert all(build_index(index, docs, made, cfg).values()) and not any(build_index(index, docs, made, cfg).values()) and len(calls) == 1
    assert index.nodes().count() == 3 + 4 and index.available() == [s for s in ("nodes", "vectors", "entities", "propositions", "edges", "negative_edges", "meta")]
    assert {tuple(sorted((r.a, r.b))) for r in index.negative_edges().collect()} >= {("d1:0#p1", "d2:0#p0")}
    assert {r.layer for r in index.read("edges").select("layer").distinct().collect()} >= {"structural", "derivation"}
    assert index.graph().count() > 0


def test_index_stores_no_pair_of_entities(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", [("Baikal and Olkhon lie in Siberia", None)] * 2) for i in range(4)] + [(f"x{i}", [("nothing", None)] * 3) for i in range(4)], "source_id string, units array<struct<text:string,section_id:string>>")
    index = Index(spark, str(tmp_path))
    build_index(index, docs, Models(lambda t: md.embed(t, "passage"), capital), IndexConfig(entity=EntityEdgeConfig(1.0)))
    assert index.read("edges").where("layer = 'entity'").count() == 0
    assert index.edges().where("layer = 'entity'").count() == 8 * 7 // 2
    for weights in (LayerWeights(), LayerWeights(semantic=0.0), LayerWeights(entity=0.0)):
        got, want = ({(r.src, r.dst): round(r.w, 9) for r in g.collect()} for g in (index.graph(weights), from_layers(index.edges(), weights)))
        assert got == want and got


def test_one_call_shows_a_run(spark):
    layers = spark.createDataFrame([("structural", "a", "b", 1.0, 0), ("entity", "b", "c", 0.5, 0), ("structural", "x", "y", 1.0, 0)], "layer string, u string, v string, w double, ord long")
    adj = from_layers(layers)
    cfg = PropagationConfig(threshold_ratio=0.01)
    run = propagate(adj, spark.createDataFrame([("q", "a", 1.0), ("q", "x", 0.5)], "qid string, node string, weight double"), cfg)
    contacts = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "z", 0.5, 2)], "qid string, node string, score double, rank int")
    nodes = spark.createDataFrame([(n, "chunk", "d", 10) for n in "abcxy"], "id string, layer string, source_id string, length int")
    shown = inspect(run, adj, contacts, nodes, layers, cfg)
    got = {name: df.collect() for name, df in shown.items()}
    assert {r.node for r in got["ranking"]} == set("abcxy") and [tuple(r.nodes) for r in sorted(got["clusters"], key=lambda r: r.rank)] == [("a", "b", "c"), ("x", "y")]
    assert {r.node: r.badge for r in got["comparison"]}["z"] == "topk" and got["ledger"][0].balanced and got["refusal"][0].n_clusters == 2
    assert {(r.u, r.v): r.layer for r in got["scene_edges"]} == {("a", "b"): "structural", ("b", "c"): "entity", ("x", "y"): "structural"}
    drawn = render_spec(shown["scene_nodes"], shown["scene_edges"], "q")
    assert [len(x["data"]["values"]) for x in drawn["layer"]] == [3, 5] and json.dumps(drawn)
    skipped = spark.createDataFrame([("q", "all", "z", "a", 0.9)], "qid string, color string, node string, survivor string, tau double")
    assert [tuple(r) for r in Retrieval(None, skipped, run).votes().collect()] == [("q", "a", 2)]


def test_rewriting_by_sentence_stops_at_the_phrase(spark):
    def vec(rows, key):
        return spark.createDataFrame(rows, f"{key} string, embedding array<double>")

    questions = spark.createDataFrame([("q1", "one?"), ("q2", "two?")], "qid string, question string")
    passages = spark.createDataFrame([("a", "A", "text a"), ("b", None, "text b")], "id string, title string, text string")
    held = spark.createDataFrame([("q1", "b#p1", 0.9, 0), ("q1", "a", 0.5, 0), ("q1", "b", 0.4, 1)], "qid string, node string, score double, step int")
    told = {r.qid: r.prompt for r in passages_prompt(held, passages, questions).collect()}
    assert "b: text b\n\nA: text a" in told["q1"] and told["q1"].count("text b") == 1 and "two?" in told["q2"]
    replies = {"one?": "So the ANSWER is b. Done", "two?": "\n b now. More"}

    def ask(rows):
        return rows.withColumn("reply", F.when(F.col("prompt").contains("one?"), replies["one?"]).otherwise(replies["two?"]))

    def embed(texts):
        return texts.withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0)))

    rewrite = sentence_rewriter(questions, passages, ask, embed)
    got = ev.iterative_retrieve(vec([("q1", [1.0, 0.0]), ("q2", [1.0, 0.0])], "qid"), vec([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id"), rewrite, IterativeBaselineConfig(per_step_k=1, max_steps=2)).collect()
    assert {(r.qid, r.node, r.step) for r in got} == {("q1", "a", 0), ("q2", "a", 0), ("q2", "b", 1)}


def run_stream(spark, tmp_path, name, make, schema, batches):
    """What each batch adds to the result."""
    source, seen, out = str(tmp_path / "in"), set(), []
    spark.createDataFrame([], schema).write.parquet(source)
    q = make(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
        now = [r for r in spark.table(name).collect() if str(r) not in seen]
        seen |= {str(r) for r in now}
        out.append(now)
    q.stop()
    return out


def test_a_late_run_is_aged_and_the_clock_stays(spark, tmp_path):
    rows = [[(4, "A", "B", 0.5)], [(1, "A", "B", 0.4)], [(5, "A", "B", 0.0)]]
    got = [b[0] for b in run_stream(spark, tmp_path, "late", learned_stream, "run long, u string, v string, gain double", rows)]
    late = 0.05 + 0.04 * 0.99**3
    assert [r.run for r in got] == [4, 4, 5] and [r.strength for r in got] == pytest.approx([0.05, late, late * 0.99])


def test_a_turn_in_two_batches_is_whole(spark, tmp_path):
    rows = [[("q", 0, "a", 4.0)], [("q", 0, "b", 2.0), ("q", 0, "z", 0.0)], [("q", 1, "c", 1.0), ("q", 0, "d", 9.0)]]
    got = [b[0] for b in run_stream(spark, tmp_path, "warm", warmth_stream, "qid string, turn long, node string, energy double", rows)]
    assert [(r.turn, r.nodes, r.energies) for r in got] == [(0, ["a"], [1.0]), (0, ["a", "b"], [1.0, 0.5]), (1, ["c"], [0.25])]


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "merge_layers" in capsys.readouterr().out.split()
    assert main(["run", "no_such", "--data", str(tmp_path)], spark) == 2
    spark.createDataFrame([("2hop__1",), ("3hop2__7",)], "id string").write.parquet(f"{tmp_path}/questions.parquet")
    assert main(["run", "question_hops", "--data", str(tmp_path), "--out", f"{tmp_path}/out"], spark) == 0
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/question_hops").collect()} == {("2hop__1", 2), ("3hop2__7", 3)}
