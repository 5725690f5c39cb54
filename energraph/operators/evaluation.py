"""Retrieval measures, their aggregation and the paired bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from energraph.config import EvaluationConfig, IterativeBaselineConfig
from energraph.functions.text import passage_of
from energraph.operators.search import top_k
from energraph.runtime import settle


def passages_at_k(ranking: Column, k: Column | int) -> Column:
    """The first k distinct passages of a ranking of nodes."""
    return F.slice(F.array_distinct(F.transform(ranking, passage_of)), 1, k)


def nodes_for_k_passages(ranking: Column, k: int) -> Column:
    """The shortest head of the ranking that holds k passages, or all of it."""
    parents = F.transform(ranking, passage_of)
    last = F.get(F.array_distinct(parents), F.lit(k - 1))
    return F.when(last.isNull(), ranking).otherwise(F.slice(ranking, 1, F.array_position(parents, last).cast("int")))


def _checked(gold: Column) -> Column:
    return F.when(gold.isNull() | (F.size(gold) == 0), F.raise_error(F.lit("gold must not be empty")).cast("array<string>")).otherwise(F.array_distinct(gold))


def support_recall(ranking: Column, gold: Column, k: Column | int) -> Column:
    return F.size(F.array_intersect(passages_at_k(ranking, k), gold)) / F.size(_checked(gold))


def novelty(ranking: Column, reference: Column, gold: Column, k: Column | int) -> Column:
    """Share of the gold found here but not by the reference ranking."""
    found = F.array_intersect(passages_at_k(ranking, k), gold)
    return F.size(F.array_except(found, passages_at_k(reference, k))) / F.size(_checked(gold))


def objective(recall: Column, new: Column, cfg: EvaluationConfig = EvaluationConfig()) -> Column:
    return cfg.recall_weight * recall + cfg.novelty_weight * new


def measures(per_query: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """(id, hops, stop_reason, system, k, recall, novelty, objective, bridge) of per-query rankings.

    per_query: (id, hops, gold, bridge_gold, stop_reason, topk, web, iterative), the rankings as
    arrays; ``iterative`` is left out as a system if it is null anywhere.
    """
    systems = ["topk", "web"]
    if "iterative" in per_query.columns and per_query.where("iterative IS NULL").isEmpty():
        systems.append("iterative")
    each = per_query.withColumn("s", F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("ranking")) for s in systems]))).withColumn("k", F.explode(F.array(*map(F.lit, cfg.k_values))))
    each = each.withColumn("recall", support_recall(F.col("s.ranking"), F.col("gold"), F.col("k"))).withColumn("novelty", novelty(F.col("s.ranking"), F.col("topk"), F.col("gold"), F.col("k")))
    has = F.size(F.coalesce("bridge_gold", F.array().cast("array<string>"))) > 0
    bridge = F.when(has, F.size(F.array_intersect(passages_at_k(F.col("s.ranking"), F.col("k")), "bridge_gold")) / F.size(F.array_distinct("bridge_gold")))
    return each.select("id", "hops", "stop_reason", "s.system", "k", "recall", "novelty", objective(F.col("recall"), F.col("novelty"), cfg).alias("objective"), bridge.alias("bridge"))


def measures_of_lists(lists: DataFrame, hits: DataFrame, sizes: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """The rows of ``measures`` for gold sets of any size: nothing but the ranked lists is joined.

    lists: (id, system, node, rank), one system ``topk``; hits: the (id, node, bridge) of the lists'
    nodes that are gold, ``bridge`` telling if they are bridge gold too; sizes: (id, hops,
    stop_reason, n_gold, n_bridge). Nodes stand for their passages.
    """
    folded = lists.withColumn("node", passage_of(F.col("node"))).groupBy("id", "system", "node").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("id", "system").orderBy("rank"))
    heads = folded.withColumn("place", place).where(F.col("place") <= max(cfg.k_values))
    gold = hits.select("id", passage_of(F.col("node")).alias("node"), "bridge").groupBy("id", "node").agg(F.max("bridge").alias("bridge"))
    found = heads.join(gold, ["id", "node"])
    known = found.where("system = 'topk'").select("id", "node", F.col("place").alias("known"))
    each = found.join(known, ["id", "node"], "left").withColumn("k", F.explode(F.array(*map(F.lit, cfg.k_values)))).where("place <= k")
    counts = each.groupBy("id", "system", "k").agg(F.count("*").alias("hit"), F.count_if(F.col("known").isNull() | (F.col("known") > F.col("k"))).alias("fresh"), F.count_if("bridge").alias("bridged"))
    systems = sorted(r[0] for r in lists.select("system").distinct().collect())  # a handful
    checked = F.when(F.col("n_gold") > 0, F.col("n_gold")).otherwise(F.raise_error(F.lit("gold must not be empty")).cast("bigint"))
    grid = sizes.withColumn("system", F.explode(F.array(*map(F.lit, systems)).cast("array<string>"))).withColumn("k", F.explode(F.array(*map(F.lit, cfg.k_values))))
    full = grid.join(counts, ["id", "system", "k"], "left").fillna(0, ["hit", "fresh", "bridged"]).withColumns({"recall": F.col("hit") / checked, "novelty": F.col("fresh") / checked})
    bridge = F.when(F.col("n_bridge") > 0, F.col("bridged") / F.col("n_bridge"))
    return full.select("id", "hops", "stop_reason", "system", "k", "recall", "novelty", objective(F.col("recall"), F.col("novelty"), cfg).alias("objective"), bridge.alias("bridge"))


def report(scores: DataFrame) -> DataFrame:
    """(system, k, recall, novelty, objective, bridge): means over the questions."""
    return scores.groupBy("system", "k").agg(*[F.avg(c).alias(c) for c in ("recall", "novelty", "objective", "bridge")])


def objective_by_hop(scores: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    return scores.where(F.col("k") == cfg.primary_k).groupBy("system", "hops").agg(F.avg("objective").alias("objective"), F.count("*").alias("n"))


def stop_reasons(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("stop_reason").agg(F.count("*").alias("n"))


def headroom(per_query: DataFrame, columns: list[str]) -> DataFrame:
    """The largest value of each guard ever seen, null if none was recorded."""
    return per_query.agg(*[F.max(c).alias(c) for c in columns])


def bootstrap(a: np.ndarray, b: np.ndarray, iterations: int = 10_000, seed: int = 20260816) -> tuple[float, float, float, float]:
    """Mean paired difference with its 95 % interval and two-sided p; (0, 0, 0, 1) without data."""
    if not len(a):
        return 0.0, 0.0, 0.0, 1.0
    diff, rng = np.asarray(a, float) - np.asarray(b, float), np.random.default_rng(seed)
    means = np.concatenate([diff[rng.integers(0, len(diff), (min(1000, iterations - lo), len(diff)))].mean(axis=1) for lo in range(0, iterations, 1000)])
    low, high = np.percentile(means, [2.5, 97.5])
    crossed = (means <= 0).mean() if diff.mean() > 0 else (means >= 0).mean()
    return float(diff.mean()), float(low), float(high), float(min(1.0, 2 * crossed))


def bootstrap_report(scores: DataFrame, cfg: EvaluationConfig = EvaluationConfig(), iterations: int = 10_000) -> DataFrame:
    """(rival, mean, low, high, p) of web against the other systems: the questions of one evaluation are one group."""
    at = scores.where(F.col("k") == cfg.primary_k)
    web = at.where("system = 'web'").select("id", F.col("objective").alias("web"))
    rivals = at.where("system <> 'web'").select("id", F.col("system").alias("rival"), F.col("objective").alias("other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame([(pdf.rival.iloc[0], *bootstrap(pdf.web.to_numpy(), pdf.other.to_numpy(), iterations))], columns=["rival", "mean", "low", "high", "p"])

    return rivals.join(web, "id").groupBy("rival").applyInPandas(run, "rival string, mean double, low double, high double, p double")


def paired_means(scores: DataFrame, cfg: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """(rival, mean, n): how much better web is than each other system, and over how many questions."""
    at = scores.where(F.col("k") == cfg.primary_k)
    web = at.where("system = 'web'").select("id", F.col("objective").alias("web"))
    return at.where("system <> 'web'").join(web, "id").groupBy(F.col("system").alias("rival")).agg(F.avg(F.col("web") - F.col("objective")).alias("mean"), F.count("*").alias("n"))


def poisson_bootstrap(scores: DataFrame, cfg: EvaluationConfig = EvaluationConfig(), iterations: int = 200) -> DataFrame:
    """The same interval for any number of questions: seeded Poisson(1) weights, one aggregate."""
    at = scores.where(F.col("k") == cfg.primary_k)
    web = at.where("system = 'web'").select("id", F.col("objective").alias("web"))
    diff = at.where("system <> 'web'").join(web, "id").select("id", F.col("system").alias("rival"), (F.col("web") - F.col("objective")).alias("d"))
    u = (F.pmod(F.xxhash64("id", "i"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    below = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(13)])  # no u lies beyond the last
    weight = sum((u > float(s)).cast("int") for s in below)
    draws = diff.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("w", weight)
    means = draws.groupBy("rival", "i").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy("rival").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def topk_retrieve(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, ranking): the dense top k."""
    return rankings(top_k(queries, vectors, k))


def rankings(ranked: DataFrame) -> DataFrame:
    """(qid, ranking) from (qid, node, rank)."""
    return ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("ranking"))


def iterative_retrieve(queries: DataFrame, vectors: DataFrame, rewrite, cfg: IterativeBaselineConfig = IterativeBaselineConfig()) -> DataFrame:
    """(qid, node, score, step, rank): search, and up to max_steps times rewrite the query and search again.

    ``rewrite(open queries (qid, embedding), collected, step)`` returns (qid, embedding) of the
    queries that go on; all of them step together. Once max_collected ids are held, new ones are
    refused in order of arrival while known ones still improve.
    """
    asked, held = queries.select("qid", "embedding"), None
    for step in range(cfg.max_steps + 1):
        if asked.isEmpty():
            break
        hits = top_k(asked, vectors, cfg.per_step_k).select("qid", "node", "score", F.lit(step).alias("step"), F.col("rank").alias("place"))
        every = hits if held is None else held.unionByName(hits)
        first = Window.partitionBy("qid", "node").orderBy("step", "place")
        known = every.withColumn("nth", F.row_number().over(first)).withColumn("best", F.max("score").over(Window.partitionBy("qid", "node"))).where("nth = 1")
        order = F.row_number().over(Window.partitionBy("qid").orderBy("step", "place"))
        held = settle(known.withColumn("arrival", order).where(F.col("arrival") <= cfg.max_collected).select("qid", "node", F.col("best").alias("score"), "step", "place"))
        if step < cfg.max_steps:
            asked = settle(rewrite(asked, held, step))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "step", "node"))).drop("place")


def color_receipt(per_query: DataFrame) -> DataFrame:
    """Counts over coloured runs: questions with a bridge, bridges that hold gold, answers given."""
    given = F.size(F.filter("intermediate_answers", lambda a: a != ""))
    return per_query.agg(F.count_if(F.col("n_bridges") > 0).alias("questions_with_bridge"), F.count_if(F.col("bridge_hit")).alias("bridge_contains_gold"), F.sum(given).alias("non_none_answers"), F.avg("n_colors").alias("mean_colors"))


def render_report(rows: DataFrame, title: str) -> str:
    """Markdown of the small report table."""
    lines = [f"# {title}", "", "| system | k | recall | novelty | objective | bridge |", "|---|---|---|---|---|---|"]
    for r in sorted(rows.collect(), key=lambda r: (r.system, r.k)):  # a row per system and k
        lines.append(f"| {r.system} | {r.k} | {r.recall:.3f} | {r.novelty:.3f} | {r.objective:.3f} | " + (f"{r.bridge:.3f} |" if r.bridge is not None else "- |"))
    return "\n".join(lines)
