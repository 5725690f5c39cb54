"""Feedback as streams: usage counts and learned edges that age with the runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from energraph.config import LearnedLayerConfig


def usage_stream(pairs: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, u, v, n): used pairs (ts, run, u, v) counted per event-time window, late rows dropped."""
    return pairs.withWatermark("ts", watermark).groupBy(F.window("ts", window), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"))


def learned_stream(pairs: DataFrame, cfg: LearnedLayerConfig = LearnedLayerConfig()) -> DataFrame:
    """(u, v, run, strength) after each batch of used pairs (run, u, v, gain).

    The state of an edge is its strength and the run it was last touched in; ageing is applied for
    all runs in between when the edge is touched again, so no run has to touch every edge. The gain
    of a run that arrives late is aged to the edge's clock, which never runs back.
    """
    rate, keep, most = cfg.learning_rate, cfg.forgetting, cfg.max_strength

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strength, at = state.get if state.exists else (0.0, 0)
        for run, gain in pd.concat(list(batches)).groupby("run").gain.sum().sort_index().items():
            now = max(int(run), at)
            strength, at = min(most, strength * keep ** (now - at) + rate * float(gain) * keep ** (now - int(run))), now
        state.update((strength, at))
        yield pd.DataFrame({"u": [key[0]], "v": [key[1]], "run": [at], "strength": [strength]})

    return pairs.groupBy("u", "v").applyInPandasWithState(update, "u string, v string, run long, strength double", "strength double, at long", "update", GroupStateTimeout.NoTimeout)


def warmth_stream(activations: DataFrame, ratio: float = 0.25) -> DataFrame:
    """(qid, turn, nodes, energies) left warm by the latest turn of each conversation (qid, turn, node, energy).

    A turn may arrive in several batches, each of which yields all of the turn so far; rows of an
    earlier turn than the latest change nothing. A turn has at most max_nodes nodes, so the state
    is bounded.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, nodes, energies = state.get if state.exists else (-1, [], [])
        pdf = pd.concat(list(batches))
        turn = int(pdf.turn.max())
        if turn >= seen:
            warm = dict(zip(nodes, energies)) if turn == seen else {}
            for r in pdf[(pdf.turn == turn) & (pdf.energy > 0)].itertuples():
                warm[r.node] = warm.get(r.node, 0.0) + r.energy * ratio
            names = sorted(warm)
            state.update((turn, names, [float(warm[n]) for n in names]))
            yield pd.DataFrame({"qid": [key[0]], "turn": [turn], "nodes": [names], "energies": [[float(warm[n]) for n in names]]})

    kind = "turn long, nodes array<string>, energies array<double>"
    return activations.groupBy("qid").applyInPandasWithState(update, f"qid string, {kind}", kind, "update", GroupStateTimeout.NoTimeout)
