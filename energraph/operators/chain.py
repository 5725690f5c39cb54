"""Coloured retrieval with sub-questions, and the evaluation of all systems side by side.

Everything is phased over the whole batch: all questions are decomposed, then level after level
every distinct query text is embedded once, searched once and answered once, and each answer is
appended to the next sub-question of its question. Only the number of levels is a loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from energraph.config import ColoredRetrievalConfig, EvaluationConfig, IterativeBaselineConfig, need
from energraph.functions.text import first_sentence, parse_answer, parse_subqueries, passage_of
from energraph.operators.evaluation import iterative_retrieve, rankings, topk_retrieve
from energraph.operators.models import TEMPLATES, prompts
from energraph.operators.retrieve import Retrieval, retrieve
from energraph.operators.search import top_k
from energraph.runtime import settle

Embed = Callable[[DataFrame], DataFrame]  # adds embedding to (text)
Ask = Callable[[DataFrame], DataFrame]  # adds reply to its rows


def decompose(questions: DataFrame, ask: Ask, cfg: ColoredRetrievalConfig = ColoredRetrievalConfig()) -> DataFrame:
    """(qid, level, text): the sub-questions of each (qid, question), at most max_colors."""
    told = ask(questions.select("qid", "question"))
    parts = parse_subqueries(F.col("reply"), F.col("question"), cfg.max_colors)
    return told.select("qid", F.posexplode(parts).alias("level", "text"))


def embedded(texts: DataFrame, embed: Embed) -> DataFrame:
    """Adds ``embedding`` to rows with ``text``; every distinct text is embedded once."""
    return texts.join(embed(texts.select("text").distinct()).select("text", "embedding"), "text")


def chained_queries(questions: DataFrame, vectors: DataFrame, passages: DataFrame, ask: Ask, answer: Ask, embed: Embed, cfg: ColoredRetrievalConfig = ColoredRetrievalConfig()) -> tuple[DataFrame, DataFrame]:
    """(queries (qid, color, text, embedding), answers (qid, level, answer)).

    passages: (id, text). With ``none`` nothing is appended, with ``single`` only the answer of the
    first level, with ``sequential`` the answer of each level to the next.
    """
    parts = settle(decompose(questions, ask, cfg))
    depth = parts.agg(F.max("level")).first()[0]
    need(depth is not None, "there are no questions")
    out, answers = None, None
    known = None  # the answer that the next level starts from
    for level in range(depth + 1):
        now = parts.where(F.col("level") == level).select("qid", "level", "text")
        if known is not None:
            now = now.join(known, "qid", "left").select("qid", "level", F.when(F.coalesce("answer", F.lit("")) != "", F.concat_ws(" ", "text", "answer")).otherwise(F.col("text")).alias("text"))
        now = settle(embedded(now, embed))
        rows = now.select("qid", F.format_string("c%02d", "level").alias("color"), "text", "embedding")
        out = rows if out is None else out.unionByName(rows)
        if cfg.chain_mode == "none" or (cfg.chain_mode == "single" and level):
            continue
        best = top_k(now.select("qid", "embedding"), vectors, 1).where("score > 0").select("qid", passage_of(F.col("node")).alias("id"))
        said = answer(best.join(passages.select("id", F.col("text").alias("passage")), "id").join(now.select("qid", F.col("text").alias("question")), "qid"))
        got = settle(said.select("qid", F.lit(level).alias("level"), parse_answer(F.col("reply"), cfg.max_answer_words).alias("answer")))
        answers = got if answers is None else answers.unionByName(got)
        known = got.select("qid", "answer")
    empty = parts.select("qid", "level", F.lit("").alias("answer")).limit(0)
    return out, answers if answers is not None else empty


def colored_web(questions: DataFrame, vectors: DataFrame, adj: DataFrame, passages: DataFrame, ask: Ask, answer: Ask, embed: Embed, cfg: ColoredRetrievalConfig = ColoredRetrievalConfig(), **more) -> tuple[Retrieval, DataFrame]:
    """(retrieval, extras): coloured retrieval of all questions and (qid, subqueries, intermediate_answers, n_colors)."""
    queries, answers = chained_queries(questions, vectors, passages, ask, answer, embed, cfg)
    run = retrieve(queries.select("qid", "color", "embedding"), vectors, adj, cfg, **more)
    texts = queries.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("color", "text"))), lambda x: x["text"]).alias("subqueries"), F.count("*").alias("n_colors"))
    said = answers.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "answer"))), lambda x: x["answer"]).alias("intermediate_answers"))
    return run, texts.join(said, "qid", "left")


def passages_prompt(held: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, prompt): the question and its passages found so far, best first; propositions stand for theirs, each passage comes once.

    held: (qid, node, score, step); passages: (id, title, text); questions: (qid, question).
    """
    best = held.withColumn("id", passage_of(F.col("node"))).groupBy("qid", "id").agg(F.min(F.struct((-F.col("score")).alias("s"), "step", "node")).alias("place"))
    told = best.join(passages.select("id", F.concat_ws(": ", F.coalesce("title", "id"), "text").alias("told")), "id").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "told"))), lambda x: x["told"]), "\n\n").alias("passages"))
    return questions.join(told, "qid", "left").select("qid", prompts(TEMPLATES["next"], passages=F.coalesce("passages", F.lit("")), question=F.col("question")).alias("prompt"))


def sentence_rewriter(questions: DataFrame, passages: DataFrame, ask: Ask, embed: Embed, cfg: IterativeBaselineConfig = IterativeBaselineConfig()):
    """A ``rewrite`` for ``iterative_retrieve``: the first sentence of the reply is the next query.

    A query ends with an empty sentence or one that holds the stop phrase in any case.
    """

    def rewrite(open_: DataFrame, held: DataFrame, step: int) -> DataFrame:
        going = questions.join(open_.select("qid"), "qid", "left_semi")
        said = ask(passages_prompt(held, passages, going)).select("qid", first_sentence(F.col("reply")).alias("text"))
        more = settle(said.where((F.col("text") != "") & ~F.lower("text").contains(cfg.stop_phrase.lower())))
        return embedded(more, embed).select("qid", "embedding")

    return rewrite


def evaluate_questions(questions: DataFrame, vectors: DataFrame, web: Retrieval, embed: Embed, rewrite=None, cfg: EvaluationConfig = EvaluationConfig(), iterative: IterativeBaselineConfig = IterativeBaselineConfig()) -> DataFrame:
    """The per-query table of ``measures``: (id, hops, gold, bridge_gold, stop_reason, hops_used, n_activated, topk, web[, iterative]).

    questions: (qid, question, hops, gold, bridge_gold).
    """
    asked = settle(embedded(questions.select("qid", F.col("question").alias("text")), embed).select("qid", "embedding"))  # searched twice
    top = topk_retrieve(asked, vectors, max(cfg.k_values)).withColumnRenamed("ranking", "topk")
    lit = rankings(web.bundle.ranked()).withColumnRenamed("ranking", "web")
    ends = web.bundle.runs.groupBy("qid").agg(F.max("hops_used").alias("hops_used"), F.max_by("stop_reason", "hops_used").alias("stop_reason"))
    count = web.bundle.activations.groupBy("qid").agg(F.countDistinct("node").alias("n_activated"))
    out = questions.select("qid", "hops", "gold", "bridge_gold")
    for t in (top, lit, ends, count):
        out = out.join(t, "qid", "left")
    if rewrite is not None:
        out = out.join(rankings(iterative_retrieve(asked, vectors, rewrite, iterative)).withColumnRenamed("ranking", "iterative"), "qid", "left")
    return out.withColumnRenamed("qid", "id")
