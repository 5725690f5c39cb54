"""Everything that one run shows for itself, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from energraph.config import LayerWeights, OutputConfig, PropagationConfig
from energraph.operators import outputs as out
from energraph.operators.graph import dominant_layer, ranked
from energraph.operators.propagate import Bundle, confidence, disputed
from energraph.runtime import settle

#: How many of each a query shows; the tables behind are whole.
PATHS, CLUSTERS, DEEPEST = 40, 12, 8


def inspect(run: Bundle, adj: DataFrame, contacts: DataFrame, nodes: DataFrame, edges: DataFrame, cfg: PropagationConfig, output: OutputConfig = OutputConfig(), *, k: int = 5, weights: LayerWeights = LayerWeights()) -> dict[str, DataFrame]:
    """Named tables, each with qid: ranking, confidence, paths, clusters, gaps, refusal, ledger, conflicts, absorptions, disputes, disputed, comparison, scene_nodes, scene_edges.

    contacts: (qid, node, score, rank) of the vector search; nodes: (id, layer, source_id, length);
    edges: the layers (layer, u, v, w) from which ``adj`` was merged.
    """
    parts = settle(out.theme_clusters(run, adj))
    gaps = out.gap_warnings(parts, output)
    order = run.ranked().select("qid", "node", "energy", "rank")
    paths = out.activation_paths(run).join(order.select("qid", "node", "energy", "rank"), ["qid", "node"])
    scene_nodes, scene_edges = out.scene(run, adj, dominant_layer(edges, weights), nodes)
    report = out.refusal_report(run, parts, gaps)
    return {
        "ranking": order.join(out.votes_of(run, nodes), ["qid", "node"]),
        "confidence": confidence(run),
        "paths": ranked(paths.drop("rank"), ["qid"], "energy", "node").where(F.col("rank") <= PATHS),
        "clusters": parts.where(F.col("rank") <= CLUSTERS),
        "gaps": gaps,
        "refusal": report.withColumn("deepest", F.slice("deepest", 1, DEEPEST)),
        "ledger": out.energy_ledger(run, adj, cfg, nodes),
        "conflicts": run.conflicts,
        "absorptions": run.absorptions,
        "disputes": out.dispute_warnings(run),
        "disputed": disputed(run),
        "comparison": out.web_vs_topk(order, contacts, k),
        "scene_nodes": scene_nodes,
        "scene_edges": scene_edges,
    }


def render_spec(nodes: DataFrame, edges: DataFrame, qid: str) -> dict:
    """One query's scene as a declarative drawing: the driver takes its few hundred rows."""
    own = lambda df: [r.asDict() for r in df.where(F.col("qid") == qid).drop("qid").collect()]
    points = sorted(own(nodes), key=lambda r: (r["ghost"], -r["energy"], r["node"]))
    at = {r["node"]: r for r in points}
    lines = [e | {"x": at[e["u"]]["x"], "y": at[e["u"]]["y"], "x2": at[e["v"]]["x"], "y2": at[e["v"]]["y"]} for e in own(edges) if e["u"] in at and e["v"] in at]
    place = {"x": {"field": "x", "type": "quantitative", "axis": None}, "y": {"field": "y", "type": "quantitative", "axis": None}}
    return {
        "layer": [
            {"data": {"values": sorted(lines, key=lambda e: (e["u"], e["v"]))}, "mark": "rule", "encoding": place | {"x2": {"field": "x2"}, "y2": {"field": "y2"}, "color": {"field": "layer", "type": "nominal"}, "opacity": {"field": "w", "type": "quantitative"}}},
            {"data": {"values": points}, "mark": "circle", "encoding": place | {"size": {"field": "energy", "type": "quantitative"}, "shape": {"field": "ghost", "type": "nominal"}, "tooltip": [{"field": f} for f in ("node", "energy", "votes")]}},
        ]
    }
