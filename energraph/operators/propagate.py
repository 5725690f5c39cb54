"""Spreading activation for a whole batch of queries: an iterated join and aggregate.

All queries and colours run at once; every table is keyed by (qid, color). One hop is one
DataFrame plan over (frontier, adjacency, active), written to the shared folder to cut lineage,
and the driver only learns how many rows the next frontier has. The adjacency is written once in
buckets of (src, piece), so no hop shuffles it; a small frontier is broadcast by the adaptive
planner on its measured size. A hub is cut into as many pieces as its degree and the number of
runs that may meet it ask for, and what a node shares out is summed with partial sums.

Order within a hop: activate, polarity, absorption, conflict, (stop at max_nodes), redundancy
threshold, distribute, gate. Seeds are never gated. Energy that does not pass a gate is gone, but
whoever offered it stays a contributor of a later activation.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from energraph.config import ConflictConfig, DedupConfig, NegativeSeedConfig, PolarityConfig, PropagationConfig, need
from energraph.operators.graph import node_masses
from energraph.operators.similarity import Similarity
from energraph.runtime import session_of, settle, settle_bucketed

KEY = ["qid", "color"]
#: Up to so many runs, their rows of four numbers are broadcast to the gate.
MAX_BROADCAST_RUNS = 500_000
#: Offers that one piece of a node may yield in a hop, and from how many neighbours on a node is cut.
PIECE_OFFERS, HUB_DEGREE = 1 << 20, 256


@dataclass(frozen=True)
class Bundle:
    """The tables of a batch of runs.

    runs (injected, threshold, hops_used, stop_reason), activations (node, energy, hop,
    contributors), offers (hop, src, dst, share), votes (source, votes), suppressed (node,
    survivor), taus (step, tau), conflicts, absorptions, disputes; each with qid and color.
    """

    runs: DataFrame
    activations: DataFrame
    offers: DataFrame
    votes: DataFrame
    suppressed: DataFrame
    taus: DataFrame
    conflicts: DataFrame
    absorptions: DataFrame
    disputes: DataFrame

    def ranked(self) -> DataFrame:
        """(qid, node, energy, rank) summed over colours; ties by id, dead nodes included."""
        total = self.activations.groupBy("qid", "node").agg(F.sum("energy").alias("energy"))
        return total.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("energy"), "node")))

    def energy_of(self, wanted: DataFrame) -> DataFrame:
        """(qid, node, energy) of the wanted (qid, node) rows, 0 where not activated."""
        return wanted.join(self.ranked().drop("rank"), ["qid", "node"], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))

    def bridges(self) -> DataFrame:
        """(qid, node, colors) of nodes that several colours reached."""
        return self.activations.groupBy("qid", "node").agg(F.array_sort(F.collect_set("color")).alias("colors")).where(F.size("colors") >= 2)

    def merged_votes(self) -> DataFrame:
        """(qid, source, votes): one plus what each colour adds."""
        return self.votes.groupBy("qid", "source").agg((F.sum(F.col("votes") - 1) + 1).alias("votes"))


def _keyed(df: DataFrame | None, runs: DataFrame) -> DataFrame | None:
    """A table without colour applies to every colour of its query."""
    if df is None or "color" in df.columns:
        return df
    return df.join(runs.select(*KEY), "qid")


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for p in parts:
        out = out.unionByName(p)
    return out


def fold_conflicts(pairs: list[tuple[str, str, float]], energy: dict[str, float], coefficient: float) -> list[tuple]:
    """Fires pairs in sorted order on the running energies, which it changes; the records."""
    out = []
    for a, b, strength in sorted(pairs):
        lost = coefficient * strength * min(energy[a], energy[b])
        if lost > 0:
            before = energy[a], energy[b]
            energy[a], energy[b] = before[0] - lost, before[1] - lost
            out.append((a, b, strength, lost, before[0], energy[a], before[1], energy[b]))
    return out


_CONFLICT = "node_a string, node_b string, strength double, absorbed_each double, a_before double, a_after double, b_before double, b_after double"


@dataclass
class _Run:
    """What changes from hop to hop."""

    active: list[DataFrame] = field(default_factory=list)
    offers: list[DataFrame] = field(default_factory=list)
    suppressed: list[DataFrame] = field(default_factory=list)
    taus: list[DataFrame] = field(default_factory=list)
    conflicts: list[DataFrame] = field(default_factory=list)
    absorptions: list[DataFrame] = field(default_factory=list)
    disputes: list[DataFrame] = field(default_factory=list)
    trimmed: list[DataFrame] = field(default_factory=list)
    too_deep: list[DataFrame] = field(default_factory=list)


def live_edges(adj: DataFrame, alpha: float, n_runs: int, mass: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(edges (src, piece, dst, part[, src_mass, dst_mass]), hubs (src, pieces) or None if there are none).

    Were all runs to meet a node in the same hop, each of its pieces would yield at most about
    ``PIECE_OFFERS`` offers.
    """
    live = adj.where("w > 0 AND src <> dst").select("src", "dst", F.pow("w", F.lit(float(alpha))).alias("part"))
    if mass is not None:
        for end in ("src", "dst"):
            live = live.join(mass.select(F.col("node").alias(end), F.col("mass").alias(f"{end}_mass")), end, "left")
    degree = live.groupBy("src").agg(F.count("*").alias("degree"))
    offers = F.col("degree") * F.lit(n_runs)
    pieces = F.least(F.col("degree"), F.ceil(offers / PIECE_OFFERS)).cast("int").alias("pieces")
    hubs = settle(degree.where((F.col("degree") >= HUB_DEGREE) & (offers > PIECE_OFFERS)).select("src", pieces))
    if hubs.isEmpty():
        return live.withColumn("piece", F.lit(0)), None
    return live.join(hubs, "src", "left").withColumn("piece", F.coalesce(F.pmod(F.hash("dst"), "pieces"), F.lit(0))).drop("pieces"), hubs


def propagate(
    adj: DataFrame,
    seeds: DataFrame,
    cfg: PropagationConfig = PropagationConfig(),
    *,
    nodes: DataFrame | None = None,
    similarity: Similarity | None = None,
    dedup: DedupConfig | None = None,
    source_of: DataFrame | None = None,
    negative: DataFrame | None = None,
    conflict: ConflictConfig | None = None,
    absorb: DataFrame | None = None,
    negative_seed: NegativeSeedConfig | None = None,
    residue: DataFrame | None = None,
    polarity: PolarityConfig | None = None,
    split_energy: bool = True,
) -> Bundle:
    """Run every (qid, color) of seeds (qid, color, node, weight).

    adj (src, dst, w); nodes (id, layer, length, polarity, source_id) for mass, polarity and
    sources; negative (a, b, strength); absorb (qid, node, field); residue (qid, node, energy);
    source_of (node, source). With several colours a query's energy is divided among them unless
    ``split_energy`` is off. Raises ValueError where a run has no seed of positive weight.
    """
    spark = session_of(seeds)
    seeds = seeds if "color" in seeds.columns else seeds.withColumn("color", F.lit("all"))
    total = Window.partitionBy(*KEY)
    seeds = settle(seeds.select(*KEY, "node", "weight"))
    sums = seeds.groupBy(*KEY).agg(F.sum("weight").alias("total"))
    need(not seeds.isEmpty(), "there are no seeds")
    need(sums.where("total <= 0 OR total IS NULL").isEmpty(), "seed weights must sum to more than zero")

    share = F.lit(float(cfg.seed_energy)) / (F.count("*").over(Window.partitionBy("qid")) if split_energy else F.lit(1.0))
    base = sums.select(*KEY, share.alias("budget"))
    warm = _keyed(residue, base)
    if warm is not None:
        warm = warm.where("energy > 0").select(*KEY, "node", "energy")
        base = base.join(warm.groupBy(*KEY).agg(F.sum("energy").alias("extra")), KEY, "left")
    extra = F.coalesce("extra", F.lit(0.0)) if warm is not None else F.lit(0.0)
    runs = settle(base.select(*KEY, "budget", (F.col("budget") + extra).alias("injected"), ((F.col("budget") + extra) * cfg.threshold_ratio).alias("threshold")))

    mass = node_masses(nodes, cfg.mass) if nodes is not None and cfg.mass.enabled else None
    opposing = nodes.where("polarity = -1").select(F.col("id").alias("node")) if nodes is not None and polarity and polarity.enabled else None
    field_ = _keyed(absorb, runs) if negative_seed and negative_seed.enabled else None
    clash = negative if negative is not None and conflict and conflict.enabled else None
    cuts = similarity is not None and dedup is not None and dedup.enabled
    n_runs = runs.count()
    edges, hubs = live_edges(adj, cfg.split_alpha, n_runs, mass)
    edges, drop_edges = settle_bucketed(edges, ["src", "piece"])

    runs_side = F.broadcast(runs) if n_runs <= MAX_BROADCAST_RUNS else runs
    state = _Run()
    none = spark.createDataFrame
    empty = {
        "active": none([], "qid string, color string, node string, energy double, hop int"),
        "offers": none([], "qid string, color string, hop int, src string, dst string, share double"),
        "suppressed": none([], "qid string, color string, node string, survivor string"),
        "taus": none([], "qid string, color string, step int, tau double"),
        "conflicts": none([], f"qid string, color string, hop int, {_CONFLICT}"),
        "absorptions": none([], "qid string, color string, hop int, node string, absorbed double, field double, energy_before double, energy_after double"),
        "disputes": none([], "qid string, color string, hop int, node string, absorbed double, energy_before double, energy_after double"),
        "trimmed": none([], "qid string, color string"),
        "too_deep": none([], "qid string, color string"),
    }

    kept = seeds
    if cuts and dedup.include_seeds:
        many = settle(similarity.greedy(seeds, dedup))  # (keys, node, survivor or null, tau)
        state.suppressed.append(many.where("survivor IS NOT NULL").select(*KEY, "node", "survivor"))
        state.taus.append(many.where("tau IS NOT NULL").select(*KEY, F.lit(-1).alias("step"), "tau").distinct())
        kept = many.where("survivor IS NULL").select(*KEY, "node", "weight")
    first = kept.join(runs, KEY).select(*KEY, "node", (F.col("budget") * F.col("weight") / F.sum("weight").over(total)).alias("energy"))
    if warm is not None:
        first = first.unionByName(warm).groupBy(*KEY, "node").agg(F.sum("energy").alias("energy"))

    def placed(df: DataFrame) -> DataFrame:
        """With their places; one more than fits is kept, which tells that a run is full."""
        return settle(df.withColumn("place", F.row_number().over(total.orderBy(F.desc("energy"), "node"))).where(F.col("place") <= cfg.max_nodes + 1))

    frontier, hop, most = placed(first), 0, 0
    while True:
        n, widest = frontier.agg(F.count("*"), F.max("place")).first()
        if not n:
            break
        if hop > cfg.max_hop:
            state.too_deep.append(frontier.select(*KEY).distinct())
            break
        active = _union(state.active, empty["active"])
        # activate, with room for the strongest only; no run can be full before ``most`` says so
        most += widest
        now, over = frontier, None
        if most > cfg.max_nodes:
            held = active.groupBy(*KEY).agg(F.count("*").alias("held"))
            sized = settle(frontier.join(held, KEY, "left").withColumn("fits", F.col("place") + F.coalesce("held", F.lit(0)) <= cfg.max_nodes))
            over = settle(sized.where("NOT fits").select(*KEY).distinct())
            state.trimmed.append(over.withColumn("hop", F.lit(hop)))
            now = sized.where("fits")
        now = now.select(*KEY, "node", F.col("energy").alias("arrived"), "energy").withColumn("damped", F.lit(False))

        if opposing is not None:
            now = now.join(opposing.withColumn("opposes", F.lit(True)), "node", "left").withColumn("lost", F.when(F.col("opposes"), F.col("energy") * polarity.coefficient).otherwise(0.0))
            now = settle(now)
            state.disputes.append(now.where("lost > 0").select(*KEY, F.lit(hop).alias("hop"), "node", F.col("lost").alias("absorbed"), F.col("energy").alias("energy_before"), (F.col("energy") - F.col("lost")).alias("energy_after")))
            now = _damp(now, runs)
        if field_ is not None:
            now = now.join(field_.select(*KEY, "node", "field"), [*KEY, "node"], "left").withColumn("lost", F.greatest(F.lit(0.0), F.least("energy", F.coalesce(F.col("field") * negative_seed.coefficient, F.lit(0.0)))))
            now = settle(now)
            state.absorptions.append(now.where("lost > 0").select(*KEY, F.lit(hop).alias("hop"), "node", F.col("lost").alias("absorbed"), "field", F.col("energy").alias("energy_before"), (F.col("energy") - F.col("lost")).alias("energy_after")))
            now = _damp(now, runs).drop("field")
        if opposing is not None or field_ is not None:
            now = settle(now)
        fresh = now.select(*KEY, "node", "energy", F.lit(hop).alias("hop"))
        state.active.append(fresh)
        spreading = now.where("NOT damped OR energy >= gate" if "gate" in now.columns else "true").select(*KEY, "node", "energy")
        active = active.unionByName(fresh)
        if clash is not None:
            fought = settle(_conflicts(active, clash, conflict, hop, state.conflicts))
            state.conflicts.append(fought)
            loss = _losses([fought])
            weak = spreading.join(loss, [*KEY, "node"]).join(runs, KEY).where("energy - lost < threshold").select(*KEY, "node")
            spreading = spreading.join(loss, [*KEY, "node"], "left").withColumn("energy", F.col("energy") - F.coalesce("lost", F.lit(0.0))).drop("lost").join(weak, [*KEY, "node"], "left_anti")
        if over is not None:
            spreading = spreading.join(over, KEY, "left_anti")

        # distribute over live neighbours only
        if hubs is None:
            aimed = spreading.withColumn("piece", F.lit(0))
        else:
            aimed = spreading.join(hubs.withColumnRenamed("src", "node"), "node", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
        ahead = aimed.withColumnRenamed("node", "src").join(edges, ["src", "piece"]).drop("piece")
        ahead = ahead.join(active.select(*KEY, F.col("node").alias("dst")), [*KEY, "dst"], "left_anti")
        if cuts:
            going = frontier.select(*KEY).distinct() if over is None else frontier.select(*KEY).distinct().join(over, KEY, "left_anti")
            state.taus.append(taus := settle(similarity.threshold(active.join(going, KEY, "left_semi"), dedup).select(*KEY, F.lit(hop).alias("step"), "tau")))
            ahead = settle(ahead.join(_union(state.suppressed, empty["suppressed"]).select(*KEY, F.col("node").alias("dst")), [*KEY, "dst"], "left_anti"))
            copies = settle(similarity.survivors(ahead.select(*KEY, F.col("dst").alias("node")).distinct(), active.select(*KEY, "node"), taus))
            state.suppressed.append(copies)
            ahead = ahead.join(copies.select(*KEY, F.col("node").alias("dst")), [*KEY, "dst"], "left_anti")
        ahead = ahead.join(ahead.groupBy(*KEY, "src").agg(F.sum("part").alias("all_parts")), [*KEY, "src"])
        carry, gate, heavy = F.lit(float(cfg.damping)), F.col("threshold"), []
        if mass is not None:
            carry = F.pow(carry, 1 / F.coalesce("src_mass", F.lit(1.0)))
            gate, heavy = gate * F.coalesce("mass", F.lit(1.0)), ["dst_mass"]
        offers = settle(ahead.select(*KEY, F.lit(hop).alias("hop"), "src", "dst", (F.col("energy") * carry * F.col("part") / F.col("all_parts")).alias("share"), *heavy))
        state.offers.append(offers)
        arrivals = offers.groupBy(*KEY, F.col("dst").alias("node")).agg(F.sum("share").alias("energy"), *[F.max(c).alias("mass") for c in heavy]).join(runs_side, KEY)
        frontier = placed(arrivals.where(F.col("energy") >= gate).select(*KEY, "node", "energy"))
        hop += 1

    drop_edges()
    return _bundle(runs, state, empty, source_of)


def _damp(now: DataFrame, runs: DataFrame) -> DataFrame:
    """Takes ``lost`` off and marks the damped nodes with the gate they must still pass."""
    gated = now if "gate" in now.columns else now.join(runs.select(*KEY, F.col("threshold").alias("gate")), KEY)
    return gated.select(*KEY, "node", "arrived", (F.col("energy") - F.col("lost")).alias("energy"), (F.col("damped") | (F.col("lost") > 0)).alias("damped"), "gate", *[c for c in ("field",) if c in now.columns])


def _losses(conflicts: list[DataFrame]) -> DataFrame:
    every = conflicts[0]
    for c in conflicts[1:]:
        every = every.unionByName(c)
    ends = every.select(*KEY, F.explode(F.array("node_a", "node_b")).alias("node"), F.col("absorbed_each"))
    return ends.groupBy(*KEY, "node").agg(F.sum("absorbed_each").alias("lost"))


def _conflicts(active: DataFrame, clash: DataFrame, cfg: ConflictConfig, hop: int, earlier: list[DataFrame]) -> DataFrame:
    """Records of the pairs whose second end became active in this hop.

    A pair whose ends have no energy left never fires, as energies do not grow. Pairs of one run
    are folded in order, for a node may stand in several; runs have at most max_nodes nodes.
    """
    energy = active
    if earlier:
        energy = active.join(_losses(earlier), [*KEY, "node"], "left").withColumn("energy", F.col("energy") - F.coalesce("lost", F.lit(0.0))).drop("lost")
    a = energy.select(*KEY, F.col("node").alias("a"), F.col("energy").alias("ea"), F.col("hop").alias("ha"))
    b = energy.select(*KEY, F.col("node").alias("b"), F.col("energy").alias("eb"), F.col("hop").alias("hb"))
    pending = a.join(clash, "a").join(b, [*KEY, "b"]).where(F.greatest("ha", "hb") == hop).select(*KEY, "a", "b", "strength", "ea", "eb")
    coefficient = cfg.coefficient

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        level = dict(zip(pdf.a, pdf.ea)) | dict(zip(pdf.b, pdf.eb))
        rows = fold_conflicts(list(zip(pdf.a, pdf.b, pdf.strength)), level, coefficient)
        names = [x.split()[0] for x in _CONFLICT.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, "hop", hop)
        out.insert(0, "color", pdf.color.iloc[0])
        out.insert(0, "qid", pdf.qid.iloc[0])
        return out

    return pending.groupBy(*KEY).applyInPandas(fold, f"qid string, color string, hop int, {_CONFLICT}")


def _bundle(runs: DataFrame, state: _Run, empty: dict[str, DataFrame], source_of: DataFrame | None) -> Bundle:
    def table(name: str) -> DataFrame:
        parts = getattr(state, name)
        return _union([p.select(empty[name].columns) for p in parts], empty[name])

    active, offers = table("active"), table("offers")
    if state.conflicts:
        active = active.join(_losses(state.conflicts), [*KEY, "node"], "left").select(*KEY, "node", (F.col("energy") - F.coalesce("lost", F.lit(0.0))).alias("energy"), "hop")
    fed = offers.select(*KEY, F.col("hop").alias("sent"), "src", F.col("dst").alias("node"))
    feeders = active.select(*KEY, "node", "hop").join(fed, [*KEY, "node"]).where("sent < hop").groupBy(*KEY, "node").agg(F.array_sort(F.collect_set("src")).alias("contributors"))
    activations = active.join(feeders, [*KEY, "node"], "left").withColumn("contributors", F.coalesce("contributors", F.array().cast("array<string>")))
    reached = active.groupBy(*KEY).agg(F.max("hop").alias("deepest"))
    cut = _union(state.trimmed, empty["trimmed"].withColumn("hop", F.lit(0)).limit(0)).groupBy(*KEY).agg(F.max("hop").alias("cut_hop"))
    deep = table("too_deep").withColumn("deep", F.lit(True))
    ends = runs.join(reached, KEY, "left").join(cut, KEY, "left").join(deep, KEY, "left")
    reason = F.when(F.col("cut_hop").isNotNull(), "max_nodes").when(F.col("deep"), "max_hop").otherwise("threshold")
    done = ends.select(*KEY, "injected", "threshold", F.greatest(F.coalesce("deepest", F.lit(0)), F.coalesce("cut_hop", F.lit(0))).cast("int").alias("hops_used"), reason.alias("stop_reason"))
    suppressed = table("suppressed")
    named = suppressed.select(*KEY, F.col("survivor").alias("node"))
    if source_of is not None:
        named = named.join(source_of.select("node", "source"), "node", "left").withColumn("source", F.coalesce("source", "node"))
    else:
        named = named.withColumn("source", F.col("node"))
    votes = named.groupBy(*KEY, "source").agg((F.count("*") + 1).alias("votes"))
    return Bundle(done, activations, offers, votes, suppressed, table("taus"), table("conflicts"), table("absorptions"), table("disputes"))


def negative_field(adj: DataFrame, seeds: DataFrame, cfg: PropagationConfig, ratio: float = 1.0, nodes: DataFrame | None = None) -> DataFrame:
    """(qid, node, field): the energies of a plain run with the budget times ``ratio``; no seeds, no field."""
    if seeds.isEmpty():
        return seeds.sparkSession.createDataFrame([], "qid string, node string, field double")
    run = propagate(adj, seeds, replace(cfg, seed_energy=cfg.seed_energy * ratio), nodes=nodes)
    return run.activations.select("qid", "node", F.col("energy").alias("field"))


def confidence(run: Bundle) -> DataFrame:
    """(qid, total_energy, node_count, hop_depth)."""
    return run.activations.groupBy("qid").agg(F.sum("energy").alias("total_energy"), F.countDistinct("node").alias("node_count"), F.max("hop").alias("hop_depth"))


def disputed(run: Bundle) -> DataFrame:
    """(qid, node): ends of conflicts that still have energy."""
    ends = run.conflicts.select("qid", F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    return ends.join(run.ranked().where("energy > 0").select("qid", "node"), ["qid", "node"], "left_semi")


