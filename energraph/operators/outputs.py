"""What a run shows for itself: paths, clusters, warnings, ledger, comparison and scene."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from energraph.config import OutputConfig, PropagationConfig
from energraph.operators.edges import mentions
from energraph.operators.graph import node_masses
from energraph.operators.propagate import Bundle
from energraph.runtime import settle

KEY = ["qid", "color"]


def activation_paths(run: Bundle) -> DataFrame:
    """(qid, color, node, steps, converging): from the node back to a seed by the strongest feeder.

    Ties go to the larger id. The hop falls with every step, so the walk ends after at most
    hops_used joins.
    """
    act = settle(run.activations)
    fed = act.select(*KEY, "node", F.explode("contributors").alias("feeder"))
    alive = act.select(*KEY, F.col("node").alias("feeder"), F.col("energy").alias("e"))
    parent = settle(fed.join(alive, [*KEY, "feeder"]).groupBy(*KEY, "node").agg(F.max_by("feeder", F.struct("e", "feeder")).alias("parent")))
    paths = act.select(*KEY, "node", F.col("node").alias("head"), F.array("node").alias("steps"), F.size("contributors").alias("converging"))
    depth = act.agg(F.max("hop")).first()[0] or 0
    up = parent.select(*KEY, F.col("node").alias("head"), "parent")
    for _ in range(depth):
        paths = paths.join(up, [*KEY, "head"], "left").select(*KEY, "node", F.coalesce("parent", F.lit("")).alias("head"), F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "steps")).otherwise(F.col("steps")).alias("steps"), "converging")
    return paths.drop("head")


def rendered_paths(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``text``: the steps with the label of each edge between them, whatever its direction.

    labels: (u, v, label), u < v.
    """
    steps = paths.select(*KEY, "node", "steps", F.posexplode("steps").alias("i", "step")).withColumn("next", F.get("steps", F.col("i") + 1))
    named = steps.withColumns({"u": F.least("step", "next"), "v": F.greatest("step", "next")}).join(labels.select("u", "v", "label"), ["u", "v"], "left")
    part = F.when(F.col("next").isNull(), F.col("step")).when(F.col("label").isNull(), F.concat("step", F.lit(" -> "))).otherwise(F.concat("step", F.lit(" -> "), "label", F.lit(" -> ")))
    text = named.groupBy(*KEY, "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))), lambda x: x["p"]), "").alias("text"))
    return paths.join(text, [*KEY, "node"])


def edge_labels(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(u, v, label): the rarest entity that both ends share, ties by name."""
    own = mentions(entities)
    counted = own.join(own.groupBy("entity").agg(F.count("*").alias("df")), "entity")
    a = counted.select(F.col("node_id").alias("u"), "entity", "df")
    b = own.select(F.col("node_id").alias("v"), "entity")
    wanted = pairs.where("u <> v").select("u", "v").distinct()
    return wanted.join(a, "u").join(b, ["v", "entity"]).groupBy("u", "v").agg(F.min_by("entity", F.struct("df", "entity")).alias("label"))


def theme_clusters(run: Bundle, adj: DataFrame) -> DataFrame:
    """(qid, cluster, nodes, size, energy, share, top_node, colors, rank): connected parts of what lit up.

    Components of the activated subgraph over positive edges, by min-label steps with pointer
    jumping; a query has at most max_nodes nodes, and all queries step together. The strongest
    node's ties go to the larger id; clusters are ranked by energy, ties by top node.
    """
    act = settle(run.activations.groupBy("qid", "node").agg(F.sum("energy").alias("energy"), F.array_sort(F.collect_set("color")).alias("colors")))
    nodes = act.select("qid", "node")
    edges = settle(nodes.join(adj.where("w > 0"), F.col("node") == F.col("src")).select("qid", "src", "dst").join(nodes.withColumnRenamed("node", "dst"), ["qid", "dst"]))
    label = nodes.withColumn("label", F.col("node"))
    while True:
        around = edges.join(label.select("qid", F.col("node").alias("dst"), "label"), ["qid", "dst"]).groupBy("qid", F.col("src").alias("node")).agg(F.min("label").alias("near"))
        hooked = settle(label.join(around, ["qid", "node"], "left").select("qid", "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")))
        jump = hooked.select("qid", F.col("node").alias("label"), F.col("label").alias("up"))
        new = settle(hooked.join(jump, ["qid", "label"], "left").select("qid", "node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        label = new.select("qid", "node", "label")
        if new.where("label <> old").isEmpty():
            break
    parts = act.join(label, ["qid", "node"]).groupBy("qid", F.col("label").alias("cluster")).agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.count("*").alias("size"), F.sum("energy").alias("energy"), F.max_by("node", F.struct("energy", "node")).alias("top_node"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("colors")))).alias("colors"))
    all_energy = F.sum("energy").over(Window.partitionBy("qid"))
    shared = parts.withColumn("share", F.when(all_energy > 0, F.col("energy") / all_energy).otherwise(0.0))
    return shared.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("energy"), "top_node")))


def color_composition(run: Bundle) -> DataFrame:
    return run.activations.groupBy("qid", "node").agg(F.array_sort(F.collect_set("color")).alias("colors"))


def gap_warnings(clusters: DataFrame, cfg: OutputConfig = OutputConfig()) -> DataFrame:
    """(qid, left_node, right_node, text) for each two dense clusters of a query, in their order."""
    dense = clusters.where((F.col("size") >= cfg.min_cluster_nodes) & (F.col("share") >= cfg.min_cluster_energy_share))
    a, b = (dense.select("qid", F.col("rank").alias(f"r{x}"), F.col("top_node").alias(f"{x}_node")) for x in ("left", "right"))
    text = F.format_string("No path joins the evidence around %s with that around %s.", "left_node", "right_node")
    return a.join(b, "qid").where("rleft < rright").select("qid", "left_node", "right_node", text.alias("text"))


def dispute_warnings(run: Bundle) -> DataFrame:
    text = F.format_string("%s speaks against the query and took %.2f of its energy.", "node", "absorbed")
    return run.disputes.select(*KEY, "hop", "node", text.alias("text"))


def refusal_report(run: Bundle, clusters: DataFrame, gaps: DataFrame) -> DataFrame:
    """(qid, n_clusters, n_gaps, deepest, text): what was reached, and where it ended."""
    hops = run.runs.groupBy("qid").agg(F.max("hops_used").alias("hops"))
    ends = run.activations.join(hops, "qid").where("hop = hops").groupBy("qid").agg(F.array_sort(F.collect_set("node")).alias("deepest"))
    n = clusters.groupBy("qid").agg(F.count("*").alias("n_clusters"))
    g = gaps.groupBy("qid").agg(F.count("*").alias("n_gaps"))
    text = F.format_string("The evidence forms %d cluster(s) with %d gap(s); it ends at %s.", "n_clusters", "n_gaps", F.array_join(F.slice("deepest", 1, 3), ", "))
    return ends.join(n, "qid").join(g, "qid", "left").withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0).cast("bigint"))).select("qid", "n_clusters", "n_gaps", "deepest", text.alias("text"))


def conflict_questions(run: Bundle, labels: DataFrame) -> DataFrame:
    """(qid, node_a, node_b, question, options): asks which of two conflicting nodes holds."""
    name = labels.select("id", "label")
    said = run.conflicts.select("qid", "node_a", "node_b").distinct().join(name.withColumnsRenamed({"id": "node_a", "label": "la"}), "node_a", "left").join(name.withColumnsRenamed({"id": "node_b", "label": "lb"}), "node_b", "left")
    a, b = F.coalesce("la", "node_a"), F.coalesce("lb", "node_b")
    return said.select("qid", "node_a", "node_b", F.format_string('"%s" and "%s" contradict each other. Which one holds?', a, b).alias("question"), F.array(a, b, F.lit("Both, in different contexts")).alias("options"))


def destroyed_per_node(run: Bundle) -> DataFrame:
    """(qid, color, node, lost) over conflicts, absorptions and disputes."""
    ends = run.conflicts.select(*KEY, F.explode(F.array("node_a", "node_b")).alias("node"), F.col("absorbed_each").alias("lost"))
    parts = [t.select(*KEY, "node", F.col("absorbed").alias("lost")) for t in (run.absorptions, run.disputes)]
    return ends.unionByName(parts[0]).unionByName(parts[1]).groupBy(*KEY, "node").agg(F.sum("lost").alias("lost"))


def energy_ledger(run: Bundle, adj: DataFrame, cfg: PropagationConfig, nodes: DataFrame | None = None) -> DataFrame:
    """One row per run: injected, held, dissipated, destroyed by cause, residual, mismatch, balanced.

    A reconstruction from final energies: each node is taken to have forwarded its share over the
    neighbours that were not yet active and never suppressed, unless its run was cut there.
    """
    act = settle(run.activations.select(*KEY, "node", "energy", "hop"))
    ends = run.runs.select(*KEY, "injected", "hops_used", "stop_reason")
    mass = node_masses(nodes, cfg.mass) if nodes is not None and cfg.mass.enabled else None
    carry = F.lit(float(cfg.damping))
    src = act.join(ends, KEY).withColumn("cut", (F.col("stop_reason") == "max_nodes") & (F.col("hop") == F.col("hops_used")))
    if mass is not None:
        src = src.join(mass, "node", "left")
        carry = F.pow(carry, 1 / F.coalesce("mass", F.lit(1.0)))
    src = src.withColumn("carry", carry)
    reach = src.where("NOT cut").join(adj.where("w > 0 AND src <> dst"), F.col("node") == F.col("src")).select(*KEY, "node", "hop", "energy", "carry", "dst", F.pow("w", F.lit(float(cfg.split_alpha))).alias("part"))
    there = act.select(*KEY, F.col("node").alias("dst"), F.col("hop").alias("dst_hop"), F.col("energy").alias("dst_energy"))
    gone = run.suppressed.select(*KEY, F.col("node").alias("dst"))
    live = reach.join(gone, [*KEY, "dst"], "left_anti").join(there, [*KEY, "dst"], "left").where("dst_hop IS NULL OR dst_hop > hop")
    sent = live.withColumn("amount", F.col("energy") * F.col("carry") * F.col("part") / F.sum("part").over(Window.partitionBy(*KEY, "node")))
    sent = settle(sent.select(*KEY, "node", "hop", "dst", "dst_hop", "dst_energy", "amount"))
    out = sent.groupBy(*KEY, "node").agg(F.sum("amount").alias("out"))
    held = act.join(out, [*KEY, "node"], "left").groupBy(*KEY).agg(F.sum(F.col("energy") - F.coalesce("out", F.lit(0.0))).alias("held"))
    lost = destroyed_per_node(run).withColumnRenamed("node", "dst")
    landed = sent.groupBy(*KEY, "hop", "dst").agg(F.first("dst_hop").alias("dst_hop"), F.first("dst_energy").alias("dst_energy"), F.sum("amount").alias("amount")).join(lost, [*KEY, "dst"], "left")
    hit = F.coalesce(F.col("dst_hop") == F.col("hop") + 1, F.lit(False))
    flow = landed.groupBy(*KEY).agg(F.sum(F.when(~hit, F.col("amount")).otherwise(0.0)).alias("dissipated"), F.sum(F.when(hit, F.abs(F.col("amount") - F.col("dst_energy") - F.coalesce("lost", F.lit(0.0)))).otherwise(0.0)).alias("mismatch"))
    causes = run.conflicts.groupBy(*KEY).agg(F.sum(F.col("absorbed_each") * 2).alias("conflict"))
    field = run.absorptions.groupBy(*KEY).agg(F.sum("absorbed").alias("negative_seed"))
    pole = run.disputes.groupBy(*KEY).agg(F.sum("absorbed").alias("polarity"))
    book = ends.select(*KEY, "injected").join(held, KEY, "left")
    for t in (flow, causes, field, pole):
        book = book.join(t, KEY, "left")
    book = book.fillna(0.0, ["held", "dissipated", "mismatch", "conflict", "negative_seed", "polarity"])
    residual = F.col("injected") - F.col("held") - F.col("dissipated") - F.col("conflict") - F.col("negative_seed") - F.col("polarity")
    tolerance = 1e-6 * F.greatest(F.lit(1.0), F.col("injected"))
    return book.withColumn("residual", residual).withColumn("tolerance", tolerance).withColumn("balanced", (F.abs("residual") <= F.col("tolerance")) & (F.col("mismatch") <= F.col("tolerance")))


def offers_ledger(run: Bundle) -> DataFrame:
    """(qid, color, injected, landed, lost_at_gates, overdraft) from the offers that were really made.

    ``overdraft`` is energy that conflicts destroyed after it had been forwarded.
    """
    first = run.activations.select(*KEY, "node", "hop")
    made = run.offers.join(first.withColumnRenamed("node", "dst").withColumnRenamed("hop", "landed_hop"), [*KEY, "dst"], "left")
    hit = F.coalesce(F.col("landed_hop") == F.col("hop") + 1, F.lit(False))
    flow = made.groupBy(*KEY).agg(F.sum(F.when(hit, F.col("share")).otherwise(0.0)).alias("landed"), F.sum(F.when(~hit, F.col("share")).otherwise(0.0)).alias("lost_at_gates"))
    given = run.offers.groupBy(*KEY, F.col("src").alias("node")).agg(F.sum("share").alias("given"))
    over = run.activations.join(given, [*KEY, "node"]).groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0.0), F.col("given") - F.col("energy"))).alias("overdraft"))
    return run.runs.select(*KEY, "injected").join(flow, KEY, "left").join(over, KEY, "left").fillna(0.0, ["landed", "lost_at_gates", "overdraft"])


def web_vs_topk(ranking: DataFrame, contacts: DataFrame, k: int) -> DataFrame:
    """(qid, node, web_rank, topk_rank, badge): the first k of both, and which of them has what."""
    web = ranking.where(F.col("rank") <= k).select("qid", "node", F.col("rank").alias("web_rank"))
    top = contacts.where(F.col("rank") <= k).select("qid", "node", F.col("rank").alias("topk_rank"))
    badge = F.when(F.col("topk_rank").isNull(), "web").when(F.col("web_rank").isNull(), "topk").otherwise("both")
    return web.join(top, ["qid", "node"], "full_outer").withColumn("badge", badge)


def votes_of(run: Bundle, nodes: DataFrame) -> DataFrame:
    """(qid, node, votes): by node, else by its source, else 1."""
    v = run.merged_votes()
    act = run.activations.select("qid", "node").distinct().join(nodes.select(F.col("id").alias("node"), "source_id"), "node", "left")
    own = v.withColumnsRenamed({"source": "node", "votes": "by_node"})
    theirs = v.withColumnsRenamed({"source": "source_id", "votes": "by_source"})
    return act.join(own, ["qid", "node"], "left").join(theirs, ["qid", "source_id"], "left").select("qid", "node", F.coalesce("by_node", "by_source", F.lit(1)).alias("votes"))


def select_subgraph(run: Bundle, n: int) -> DataFrame:
    """The ranked nodes with ``shown``: the strongest n of each query."""
    return run.ranked().withColumn("shown", F.col("rank") <= n)


def contributor_edges(run: Bundle, shown: DataFrame) -> DataFrame:
    """(qid, u, v): who fed whom among the shown (qid, node) rows."""
    fed = run.activations.select("qid", F.col("node").alias("v"), F.explode("contributors").alias("u")).distinct()
    a, b = (shown.select("qid", F.col("node").alias(x)) for x in ("u", "v"))
    return fed.join(a, ["qid", "u"], "left_semi").join(b, ["qid", "v"], "left_semi").select("qid", "u", "v")


def induced_edges(adj: DataFrame, shown: DataFrame, limit: int) -> DataFrame:
    """(qid, u, v, w, shown): positive edges among the shown nodes, strongest first."""
    a, b = (shown.select("qid", F.col("node").alias(x)) for x in ("src", "dst"))
    inner = a.join(adj.where("w > 0"), "src").join(b, ["qid", "dst"]).groupBy("qid", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("w").alias("w"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("w"), "u", "v"))
    return inner.withColumn("shown", place <= limit)


def hop_ring_layout(run: Bundle) -> DataFrame:
    """(qid, node, x, y): rings by hop, by energy around a ring, turned by a hash of the query."""
    act = run.activations.groupBy("qid", "node").agg(F.sum("energy").alias("energy"), F.min("hop").alias("hop"))
    ring = Window.partitionBy("qid", "hop")
    deepest = F.greatest(F.lit(1), F.max("hop").over(Window.partitionBy("qid")))
    radius = F.when((F.col("hop") == 0) & (F.count("*").over(ring) == 1), 0.0).otherwise(0.06 + 0.44 * F.col("hop") / deepest)
    turn = F.pmod(F.xxhash64("qid", "hop"), F.lit(3600)) / 3600.0
    angle = 2 * np.pi * ((F.row_number().over(ring.orderBy(F.desc("energy"), "node")) - 1) / F.count("*").over(ring) + turn)
    return act.select("qid", "node", (0.5 + radius * F.cos(angle)).alias("x"), (0.5 + radius * F.sin(angle)).alias("y"))


def spring_positions(names: list[str], edges: list[tuple[str, str, float]], iterations: int = 200, gravity: float = 0.05) -> np.ndarray:
    """Force-directed positions in the unit square, the same for the same names."""
    n = len(names)
    seed = int.from_bytes(hashlib.blake2b("\n".join(names).encode(), digest_size=8).digest(), "big")
    p = np.random.default_rng(seed).random((n, 2))
    at = {x: i for i, x in enumerate(names)}
    i, j = (np.array([at[e[s]] for e in edges], int) for s in (0, 1))
    w = np.array([e[2] for e in edges])
    ideal = 1 / np.sqrt(max(1, n))
    for step in range(iterations):
        gap = p[:, None] - p[None]
        far = np.maximum(np.linalg.norm(gap, axis=2), 1e-6)
        push = (gap / far[..., None] * (ideal**2 / far)[..., None]).sum(axis=1)
        if len(i):
            d = p[i] - p[j]
            pull = d * (np.linalg.norm(d, axis=1) / ideal * w)[:, None]
            np.add.at(push, i, -pull)
            np.add.at(push, j, pull)
        push += gravity * (0.5 - p)
        size = np.maximum(np.linalg.norm(push, axis=1, keepdims=True), 1e-9)
        p = p + push / size * np.minimum(size, 0.1 * (1 - step / iterations))
    low, high = p.min(axis=0), p.max(axis=0)
    return (p - low) / np.maximum(high - low, 1e-9)


def spring_layout(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, node, x, y) of the shown nodes, at most max_nodes a query, laid out query by query."""

    def place(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted(nodes.node)
        p = spring_positions(names, list(zip(links.u, links.v, links.w))) if names else np.zeros((0, 2))
        return pd.DataFrame({"qid": [nodes.qid.iloc[0]] * len(names) if names else [], "node": names, "x": p[:, 0], "y": p[:, 1]})

    return shown.select("qid", "node").groupBy("qid").cogroup(edges.select("qid", "u", "v", "w").groupBy("qid")).applyInPandas(place, "qid string, node string, x double, y double")


def scene(run: Bundle, adj: DataFrame, layers: DataFrame, nodes: DataFrame, max_nodes: int = 300, max_edges: int = 1500) -> tuple[DataFrame, DataFrame]:
    """(scene nodes, scene edges) as data: positions, energy, votes, ghosts; layer and weight."""
    shown = settle(select_subgraph(run, max_nodes).where("shown"))
    edges = settle(induced_edges(adj, shown, max_edges).where("shown"))
    lit = shown.join(hop_ring_layout(run), ["qid", "node"]).join(votes_of(run, nodes), ["qid", "node"]).withColumn("ghost", F.lit(False))
    ghosts = run.suppressed.select("qid", "node", "survivor").distinct().join(lit.select("qid", F.col("node").alias("survivor"), "x", "y"), ["qid", "survivor"])
    ghost_rows = ghosts.select("qid", "node", F.lit(0.0).alias("energy"), F.lit(None).cast("int").alias("rank"), "x", "y", F.lit(1).cast("bigint").alias("votes"), F.lit(True).alias("ghost"))
    columns = ["qid", "node", "energy", "rank", "x", "y", "votes", "ghost"]
    return lit.select(columns).unionByName(ghost_rows.select(columns)), edges.join(layers, ["u", "v"], "left").select("qid", "u", "v", "w", "layer")
