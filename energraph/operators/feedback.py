"""What earlier runs leave behind: warmth, learned edges, usage counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from energraph.config import LearnedLayerConfig, ThermalConfig
from energraph.operators.propagate import Bundle
from energraph.runtime import settle


def residue(activations: DataFrame, cfg: ThermalConfig = ThermalConfig()) -> DataFrame:
    """(qid, node, energy) that the previous turn leaves to the next."""
    if not cfg.enabled:
        return activations.select("qid", "node", "energy").limit(0)
    warm = activations.groupBy("qid", "node").agg((F.sum("energy") * cfg.residue_ratio).alias("energy"))
    return warm.where("energy > 0")


def topic_changed(contacts: DataFrame, warm: DataFrame, cfg: ThermalConfig = ThermalConfig()) -> DataFrame:
    """(qid, changed): too few of the turn's raw contacts are warm; no contact counts as a change."""
    hit = contacts.join(warm.select("qid", "node").distinct().withColumn("warm", F.lit(1)), ["qid", "node"], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("warm", F.lit(0))) / F.count("*") < cfg.min_overlap).alias("changed"))


def thermal_turns(turns: DataFrame, run: Callable[[DataFrame, DataFrame | None], Bundle], contacts: Callable[[DataFrame], DataFrame] | None = None, cfg: ThermalConfig = ThermalConfig()) -> DataFrame:
    """Activations of every turn; conversations run side by side, turns one after the other.

    turns: (qid, turn, ...), one row per conversation and turn; ``run(rows, residue)`` runs them.
    The number of turns, not of conversations, is the number of steps.
    """
    last, out = None, None
    for turn in [r[0] for r in turns.select("turn").distinct().orderBy("turn").collect()]:
        rows = turns.where(F.col("turn") == turn)
        warm = residue(last, cfg) if last is not None and cfg.enabled else None
        if warm is not None:
            warm = warm.join(rows.select("qid").distinct(), "qid", "left_semi")
            if cfg.auto_reset and contacts is not None:
                found = contacts(rows)
                changed = rows.select("qid").distinct().join(topic_changed(found, warm, cfg), "qid", "left").where("changed IS NULL OR changed").select("qid")
                warm = warm.join(changed, "qid", "left_anti")
            warm = settle(warm)
        bundle = run(rows, warm)
        now = settle(bundle.activations.withColumn("turn", F.lit(turn)).join(bundle.runs.select("qid", "color", "injected"), ["qid", "color"]))
        out = now if out is None else out.unionByName(now)
        here = now.select("qid", "node", "energy")
        last = here if last is None else settle(here.unionByName(last.join(rows.select("qid").distinct(), "qid", "left_anti")))
    return out


def evidence(run: Bundle, accepted: DataFrame | None = None) -> DataFrame:
    """(u, v, gain): the share of the injected energy that each feeder brought to each node, per run."""
    act = run.activations.join(run.runs.select("qid", "color", "injected"), ["qid", "color"]).where(F.size("contributors") > 0)
    if accepted is not None:
        act = act.join(accepted.select("qid", "node").distinct(), ["qid", "node"], "left_semi")
    gain = F.least(F.lit(1.0), F.col("energy") / F.size("contributors") / F.col("injected"))
    each = act.select("qid", "color", "node", gain.alias("gain"), F.explode("contributors").alias("feeder"))
    return each.select("qid", F.least("feeder", "node").alias("u"), F.greatest("feeder", "node").alias("v"), "gain")


def reinforce(learned: DataFrame | None, pairs: DataFrame, cfg: LearnedLayerConfig = LearnedLayerConfig()) -> DataFrame:
    """(u, v, strength) after one run: every edge ages, used ones gain, none exceeds the maximum.

    pairs: (u, v, gain). Disabled, the layer stays as it is.
    """
    if not cfg.enabled:
        return learned
    gained = pairs.groupBy("u", "v").agg(F.sum("gain").alias("gain"))
    old = learned if learned is not None else gained.limit(0).select("u", "v", F.lit(0.0).alias("strength"))
    both = old.join(gained, ["u", "v"], "full_outer")
    aged = F.coalesce("strength", F.lit(0.0)) * cfg.forgetting + cfg.learning_rate * F.coalesce("gain", F.lit(0.0))
    return both.select("u", "v", F.least(F.lit(float(cfg.max_strength)), aged).alias("strength"))


#: Runs of an edge that are folded at once.
RUN_BLOCK = 4096


def reinforce_runs(pairs: DataFrame, cfg: LearnedLayerConfig = LearnedLayerConfig()) -> DataFrame:
    """(u, v, strength) after many runs (run, u, v, gain), numbered 0, 1, ...: one pass for any number.

    Edges are independent, so each edge folds its own runs in order and ages by the number of runs
    in between; the result equals ``reinforce`` run by run. A run turns a strength x into
    min(c, a * x + b), and so does any sequence of runs, so an edge used in very many runs is first
    folded block by block and no list holds more than ``RUN_BLOCK`` of them.
    """
    total = pairs.agg(F.max("run")).first()[0]
    keep, most = F.lit(float(cfg.forgetting)), F.lit(float(cfg.max_strength))
    per_run = pairs.groupBy("u", "v", F.col("run").cast("bigint").alias("run")).agg((F.sum("gain") * cfg.learning_rate).alias("gain"))
    blocks = per_run.groupBy("u", "v", F.floor(F.col("run") / RUN_BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("run", "gain"))).alias("runs"))
    line = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("inf")).alias("c"), (F.col("block") * RUN_BLOCK).alias("at"))

    def step(acc, r):
        age = F.pow(keep, r["run"] - acc["at"])
        return F.struct((acc["a"] * age).alias("a"), (acc["b"] * age + r["gain"]).alias("b"), F.least(most, acc["c"] * age + r["gain"]).alias("c"), r["run"].alias("at"))

    folded = blocks.select("u", "v", "block", F.aggregate("runs", line, step).alias("f"))
    edges = folded.groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("blocks"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("at"))

    def add(acc, x):
        aged = acc["s"] * F.pow(keep, x["block"] * RUN_BLOCK - acc["at"])
        return F.struct(F.least(x["f"]["c"], x["f"]["a"] * aged + x["f"]["b"]).alias("s"), x["f"]["at"].alias("at"))

    last = F.aggregate("blocks", start, add, lambda acc: acc["s"] * F.pow(keep, F.lit(total or 0) - acc["at"]))
    return edges.select("u", "v", last.alias("strength"))


def learned_edges(learned: DataFrame) -> DataFrame:
    return learned.where("strength > 0").select("u", "v", F.col("strength").alias("w"))


def forget_weak(learned: DataFrame, min_strength: float) -> tuple[DataFrame, int]:
    """The edges of at least this strength, and how many are gone."""
    return learned.where(F.col("strength") >= min_strength), learned.where(F.col("strength") < min_strength).count()


def edge_usage(run: Bundle) -> DataFrame:
    """(u, v, n): how many runs used each pair."""
    return evidence(run).groupBy("u", "v").agg(F.countDistinct("qid").alias("n"))


