"""Redundancy tests on a batch of runs: thresholds, survivors and greedy selection.

``Similarity`` is the protocol; ``PairSimilarity`` holds listed pairs (all others are 0) and stays
relational, ``VectorSimilarity`` holds vectors and works on one matrix per run, so that no pair
is ever shuffled. A run has at most max_nodes active nodes, which bounds both.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from energraph.config import DedupConfig

KEY = ["qid", "color"]


class Similarity(Protocol):
    def threshold(self, active: DataFrame, cfg: DedupConfig) -> DataFrame: ...

    def survivors(self, candidates: DataFrame, active: DataFrame, taus: DataFrame) -> DataFrame: ...

    def greedy(self, seeds: DataFrame, cfg: DedupConfig) -> DataFrame: ...


def greedy_pick(order: list[str], sims: dict[tuple[str, str], float], tau: float) -> dict[str, str]:
    """Duplicate to the kept node it repeats: the most similar one at or above tau, ties by id."""
    kept: list[str] = []
    dropped: dict[str, str] = {}
    for node in order:
        best = max(((sims.get((node, k), 0.0), k) for k in sorted(kept, reverse=True)), key=lambda x: x[0], default=(0.0, ""))
        ties = [k for k in kept if sims.get((node, k), 0.0) == best[0]]
        if ties and best[0] >= tau:
            dropped[node] = min(ties)
        else:
            kept.append(node)
    return dropped


def cut(n_pairs: int, total: float, squares: float, cfg: DedupConfig) -> float:
    """max(floor, mean + sigma * population deviation); the floor when pairs are few."""
    if n_pairs < cfg.min_pairs or not n_pairs:
        return cfg.floor
    mean = total / n_pairs
    return max(cfg.floor, mean + cfg.sigma * max(0.0, squares / n_pairs - mean * mean) ** 0.5)


class PairSimilarity:
    """Similarities of listed pairs (u, v, sim)."""

    def __init__(self, pairs: DataFrame) -> None:
        one = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim").where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"))
        self.pairs = one
        self.both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))

    def _stats(self, active: DataFrame) -> DataFrame:
        a, b = (active.select(*KEY, F.col("node").alias(x)) for x in ("u", "v"))
        listed = a.join(self.pairs, "u").join(b, [*KEY, "v"]).groupBy(*KEY).agg(F.sum("sim").alias("total"), F.sum(F.col("sim") * F.col("sim")).alias("squares"))
        return active.groupBy(*KEY).agg(F.count("*").alias("n")).join(listed, KEY, "left").select(*KEY, (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("squares", F.lit(0.0)).alias("squares"))

    def threshold(self, active: DataFrame, cfg: DedupConfig) -> DataFrame:
        """(qid, color, tau) over all pairs of active nodes; a pair that is not listed counts as 0."""
        mean = F.col("total") / F.col("pairs")
        tau = mean + cfg.sigma * F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("pairs") - mean * mean))
        few = (F.col("pairs") < cfg.min_pairs) | (F.col("pairs") == 0)
        return self._stats(active).select(*KEY, F.when(few, F.lit(float(cfg.floor))).otherwise(F.greatest(F.lit(float(cfg.floor)), tau)).alias("tau"))

    def survivors(self, candidates: DataFrame, active: DataFrame, taus: DataFrame) -> DataFrame:
        """(qid, color, node, survivor) of candidates that repeat an active node."""
        hits = candidates.join(self.both, F.col("node") == F.col("u")).join(active.select(*KEY, F.col("node").alias("v")), [*KEY, "v"]).join(taus, KEY).where("sim >= tau")
        best = hits.groupBy(*KEY, "node").agg(F.min(F.struct((-F.col("sim")).alias("order"), "v")).alias("s"))
        return best.select(*KEY, "node", F.col("s.v").alias("survivor"))

    def greedy(self, seeds: DataFrame, cfg: DedupConfig) -> DataFrame:
        """(qid, color, node, weight, survivor, tau): strongest first; tau is null for a single seed."""
        taus = self.threshold(seeds.select(*KEY, "node"), cfg)
        a, b = (seeds.select(*KEY, F.col("node").alias(x)) for x in ("u", "v"))
        listed = a.join(self.both, "u").join(b, [*KEY, "v"]).groupBy(*KEY).agg(F.collect_list(F.struct("u", "v", "sim")).alias("sims"))
        seen = seeds.groupBy(*KEY).agg(F.collect_list(F.struct("node", "weight")).alias("all")).join(taus, KEY).join(listed, KEY, "left")

        def pick(it):
            for pdf in it:
                out = []
                for r in pdf.itertuples():
                    order = sorted(((x["node"], x["weight"]) for x in r.all), key=lambda x: (-x[1], x[0]))
                    sims = {(x["u"], x["v"]): x["sim"] for x in r.sims} if r.sims is not None else {}
                    gone = greedy_pick([n for n, _ in order], sims, r.tau) if len(order) > 1 else {}
                    out += [(r.qid, r.color, n, w, gone.get(n), r.tau if len(order) > 1 else None) for n, w in order]
                yield pd.DataFrame(out, columns=["qid", "color", "node", "weight", "survivor", "tau"])

        return seen.mapInPandas(pick, "qid string, color string, node string, weight double, survivor string, tau double")


class VectorSimilarity:
    """Cosines of vectors (id, embedding); an id without a vector is similar to nothing."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors.select(F.col("id").alias("node"), "embedding")

    @staticmethod
    def _matrix(pdf: pd.DataFrame) -> np.ndarray:
        """Unit rows; rows without a vector are zero."""
        dim = next((len(e) for e in pdf.embedding if e is not None), 1)
        x = np.array([np.asarray(e, float) if e is not None else np.zeros(dim) for e in pdf.embedding]).reshape(-1, dim)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def threshold(self, active: DataFrame, cfg: DedupConfig) -> DataFrame:
        matrix = self._matrix

        def tau(pdf: pd.DataFrame) -> pd.DataFrame:
            x = matrix(pdf)
            gram = x @ x.T
            upper = gram[np.triu_indices(len(x), 1)]
            return pd.DataFrame({"qid": [pdf.qid.iloc[0]], "color": [pdf.color.iloc[0]], "tau": [cut(len(upper), upper.sum(), (upper**2).sum(), cfg)]})

        return active.select(*KEY, "node").join(self.vectors, "node", "left").groupBy(*KEY).applyInPandas(tau, "qid string, color string, tau double")

    def survivors(self, candidates: DataFrame, active: DataFrame, taus: DataFrame) -> DataFrame:
        matrix = self._matrix

        def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            names = ["qid", "color", "node", "survivor"]
            if not len(left) or not len(right):
                return pd.DataFrame([], columns=names)
            right = right.sort_values("node", kind="stable")
            sims = matrix(left) @ matrix(right).T
            best = sims.argmax(axis=1)  # the first of equal ones has the smallest id
            hit = np.flatnonzero(sims[np.arange(len(left)), best] >= right.tau.iloc[0])
            return pd.DataFrame({"qid": left.qid.to_numpy()[hit], "color": left.color.to_numpy()[hit], "node": left.node.to_numpy()[hit], "survivor": right.node.to_numpy()[best[hit]]}, columns=names)

        again = self.vectors.select(F.col("node").alias("node"), F.col("embedding").alias("embedding"))
        own = candidates.join(again, "node")
        kept = active.select(*KEY, "node").join(self.vectors, "node").join(taus, KEY).select(*KEY, "node", "embedding", "tau")
        return own.groupBy(*KEY).cogroup(kept.groupBy(*KEY)).applyInPandas(match, "qid string, color string, node string, survivor string")

    def greedy(self, seeds: DataFrame, cfg: DedupConfig) -> DataFrame:
        matrix = self._matrix

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["weight", "node"], ascending=[False, True], kind="stable")
            out = pdf[["qid", "color", "node", "weight"]].assign(survivor=None, tau=None)
            if len(pdf) > 1:
                x, names = matrix(pdf), pdf.node.tolist()
                gram = x @ x.T
                upper = gram[np.triu_indices(len(x), 1)]
                tau = cut(len(upper), upper.sum(), (upper**2).sum(), cfg)
                sims = {(names[i], names[j]): float(gram[i, j]) for i in range(len(x)) for j in range(len(x)) if i != j}
                gone = greedy_pick(names, sims, tau)
                out = out.assign(survivor=[gone.get(n) for n in names], tau=tau)
            return out

        return seeds.join(self.vectors, "node", "left").groupBy(*KEY).applyInPandas(pick, "qid string, color string, node string, weight double, survivor string, tau double")
