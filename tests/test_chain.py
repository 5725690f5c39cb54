import pandas as pd
from pyspark.sql import functions as F

from energraph.config import ColoredRetrievalConfig, EvaluationConfig, PropagationConfig
from energraph.operators import models as md
from energraph.operators import evaluation as ev
from energraph.operators.chain import chained_queries, colored_web, evaluate_questions
from energraph.operators.graph import from_edges

WORDS = {"Who built Alpha?": [1.0, 0.0, 0.0], "Where was the builder born? Bravo": [0.0, 1.0, 0.0], "Where was the builder born?": [0.1, 0.0, 1.0], "Where was the builder of Alpha born?": [0.9, 0.0, 0.4]}


def embed(texts):
    table = texts.sparkSession.createDataFrame(list(WORDS.items()), "text string, embedding array<double>")
    return texts.join(table, "text")


def setup(spark):
    q = spark.createDataFrame([("q", "Where was the builder of Alpha born?", 2, ["alpha", "bravo"], ["alpha"])], "qid string, question string, hops int, gold array<string>, bridge_gold array<string>")
    v = spark.createDataFrame([("alpha", [1.0, 0.0, 0.0]), ("bravo", [0.0, 1.0, 0.0]), ("noise", [0.2, 0.0, 1.0])], "id string, embedding array<double>")
    p = spark.createDataFrame([("alpha", "Alpha was built by Bravo."), ("bravo", "Bravo was born here."), ("noise", "Nothing.")], "id string, text string")
    adj = from_edges(spark.createDataFrame([("alpha", "bravo", 1.0, 0)], "u string, v string, w double, ord long"))
    ask = lambda d: d.withColumn("reply", F.lit("1. Who built Alpha?\n2. Where was the builder born?"))
    answer = lambda d: d.withColumn("reply", F.when(F.col("passage").contains("built by"), "Bravo").otherwise("NONE"))
    return q, v, p, adj, ask, answer


def test_chain_modes(spark):
    q, v, p, _, ask, answer = setup(spark)
    for mode, text in (("sequential", "Where was the builder born? Bravo"), ("none", "Where was the builder born?")):
        queries, answers = chained_queries(q, v, p, ask, answer, embed, ColoredRetrievalConfig(chain_mode=mode))
        assert {r.color: r.text for r in queries.collect()} == {"c00": "Who built Alpha?", "c01": text}
        assert [r.answer for r in answers.orderBy("level").collect()] == (["Bravo", ""] if mode == "sequential" else [])


def test_the_web_beats_dense_search(spark):
    q, v, p, adj, ask, answer = setup(spark)
    cfg = ColoredRetrievalConfig(propagation=PropagationConfig(threshold_ratio=0.01), seed_width=1)
    web, extras = colored_web(q, v, adj, p, ask, answer, embed, cfg)
    assert extras.first().n_colors == 2 and {r.node for r in web.seeds.collect()} == {"alpha", "bravo"}
    per = evaluate_questions(q, v, web, embed, cfg=EvaluationConfig(k_values=(2,)))
    got = {r.system: r.recall for r in ev.report(ev.measures(per, EvaluationConfig(k_values=(2,)))).collect()}
    assert got == {"topk": 0.5, "web": 1.0}


def test_hashed_words_are_looked_up_once(monkeypatch):
    calls, real = [], md.hashlib.blake2b
    monkeypatch.setattr(md.hashlib, "blake2b", lambda *a, **k: calls.append(a) or real(*a, **k))
    got = md.hashing_embedder(8)()(pd.DataFrame({"text": ["lake a lake", "A lake", None]}))
    assert len(calls) == 2 and [x.shape for x in got] == [(8,)] * 3 and got[2][0] == 1
