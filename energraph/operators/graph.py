"""Merging edge layers into one weighted adjacency, and looking into it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from energraph.config import LAYERS, LayerWeights, MassConfig, need
from energraph.operators.shared import Members, Membership, merged_pairs, rounded


def canonical(u: str = "u", v: str = "v") -> tuple[Column, Column]:
    return F.least(u, v).alias("u"), F.greatest(u, v).alias("v")


def check_edges(edges: DataFrame) -> None:
    """Raises on a negative or missing weight."""
    bad = edges.where(F.col("w").isNull() | (F.col("w") < 0)).limit(1).count()
    need(not bad, "edge weights must not be negative or null")


def check_unique(df: DataFrame, key: str) -> None:
    """Raises on a key that occurs twice."""
    need(df.groupBy(key).count().where("count > 1").isEmpty(), f"{key} is not unique")


def weight() -> Column:
    """The weight of an edge row; a negative or missing one fails the job that reads it."""
    return F.when(F.col("w") >= 0, F.col("w")).otherwise(F.raise_error(F.lit("edge weights must not be negative or null")).cast("double"))


def last_written(edges: DataFrame, *keys: str) -> DataFrame:
    """One weight per key: that of the highest ``ord``."""
    return edges.groupBy(*keys).agg(F.max_by(weight(), "ord").alias("w"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions; a loop stays single."""
    there = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    return there.unionByName(pairs.where("u <> v").select(F.col("v").alias("src"), F.col("u").alias("dst"), "w"))


def from_edges(edges: DataFrame, directed: bool = False) -> DataFrame:
    """edges (u, v, w, ord) to adjacency (src, dst, w): the last duplicate wins, weight 0 is kept."""
    if directed:
        return last_written(edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w", "ord"), "src", "dst")
    return mirrored(last_written(edges.select(*canonical(), "w", "ord"), "u", "v"))


def from_layers(edges: DataFrame, weights: LayerWeights = LayerWeights()) -> DataFrame:
    """edges (layer, u, v, w, ord) to adjacency (src, dst, w), the weighted sum over the layers.

    A layer of weight 0 takes its edges out before anything is shuffled. One aggregate finds the
    last weight of every layer, and the layers are added in their fixed order, so the sum is the
    same in every run.
    """
    on = weights.enabled()
    wide = _last_of_layers(edges, list(on))
    total = F.lit(0.0)
    for name in LAYERS:
        if name in on:
            total = total + F.coalesce(F.col(name) * on[name], F.lit(0.0))
    return mirrored(wide.select("u", "v", total.alias("w")))


def _last_of_layers(edges: DataFrame, on: list[str]) -> DataFrame:
    """(u, v, one column a layer): the last weight of every layer, null where a pair has none."""
    rows = edges.where(F.col("layer").isin(*on)).select("layer", *canonical(), weight().alias("w"), "ord")

    def last(name: str) -> Column:
        here = F.col("layer") == name
        return F.max_by(F.when(here, F.col("w")), F.when(here, F.col("ord"))).alias(name)

    return rows.groupBy("u", "v").agg(*([last(name) for name in on] or [F.lit(0.0).alias("none")]))


def _by_id(members: Members) -> Members:
    return members if isinstance(members, Membership) else members.select(F.col("node_id").alias("id"), "entity", "df")


def from_layers_and_members(edges: DataFrame, members: Members, weights: LayerWeights = LayerWeights(), digits: int | None = None) -> DataFrame:
    """``from_layers`` with the entity layer given as its membership, (entity, node_id, df) or ``Membership``.

    edges: all other layers. Pairs of the entity layer are merged with them where they are made, so
    none is shuffled or stored. ``digits`` rounds w.
    """
    on = weights.enabled()
    others = [x for x in LAYERS if x in on and x != "entity"]
    if "entity" not in on:
        plain = from_layers(edges, weights)
        return plain if digits is None else plain.select("src", "dst", F.round("w", digits).alias("w"))

    def value(s, w):
        total = np.zeros(len(s))
        for name in LAYERS:  # in the order of from_layers
            if name == "entity":
                total = total + np.nan_to_num(s * on[name])
            elif name in others and w is not None:
                total = total + np.nan_to_num(w[:, others.index(name)] * on[name])
        return total if digits is None else rounded(total, digits)

    wide = _last_of_layers(edges, others).select("u", "v", F.array(*[F.col(x) for x in others] or [F.lit(0.0)]).alias("w"))
    made, rest = merged_pairs(_by_id(members), wide, value, "src string, dst string, w double", True)
    total = F.lit(0.0)
    for i, name in enumerate(others):
        total = total + F.coalesce(F.get("w", F.lit(i)) * on[name], F.lit(0.0))
    return made.unionByName(mirrored(rest.select("u", "v", (total if digits is None else F.round(total, digits)).alias("w"))))


def graph_nodes(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("src").alias("id")).unionByName(adj.select(F.col("dst").alias("id"))).distinct()


def neighbours(adj: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, dst, w) of the given ids."""
    return ids.select("id").join(adj, F.col("id") == F.col("src")).select("id", "dst", "w")


def node_masses(nodes: DataFrame, cfg: MassConfig) -> DataFrame:
    """(node, mass): length over the mean length of the layer, to a power, clamped; empty when off."""
    means = nodes.groupBy("layer").agg(F.avg("length").alias("mean"))  # few layers: a broadcast join
    mass = F.least(F.lit(float(cfg.cap)), F.greatest(F.lit(float(cfg.floor)), F.pow(F.col("length") / F.col("mean"), F.lit(float(cfg.exponent)))))
    out = nodes.join(F.broadcast(means), "layer").select(F.col("id").alias("node"), mass.alias("mass"))
    return out if cfg.enabled else out.limit(0)


def layer_contributions(edges: DataFrame, weights: LayerWeights = LayerWeights()) -> DataFrame:
    """(u, v, layer, contribution) per enabled layer; duplicates collapse to the largest weight."""
    on = weights.enabled()
    factor = F.element_at(F.create_map(*[F.lit(x) for k, w in on.items() for x in (k, float(w))]), F.col("layer"))
    return edges.where(F.col("layer").isin(*on)).select("layer", *canonical(), "w").groupBy("u", "v", "layer").agg(F.max("w").alias("w")).select("u", "v", "layer", (F.col("w") * factor).alias("contribution"))


def dominant_layer(edges: DataFrame, weights: LayerWeights = LayerWeights()) -> DataFrame:
    """(u, v, layer): the largest contribution, ties by the order of the layers."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(LAYERS) for x in (k, i)]), F.col("layer"))
    return layer_contributions(edges, weights).groupBy("u", "v").agg(F.max_by("layer", F.struct("contribution", -order)).alias("layer"))


def dominant_layer_with_members(edges: DataFrame, members: Members, weights: LayerWeights = LayerWeights()) -> DataFrame:
    """``dominant_layer`` with the entity layer given as its membership, edges as all others."""
    on = weights.enabled()
    if "entity" not in on:
        return dominant_layer(edges, weights)
    names = [x for x in LAYERS if x in on]
    others = [x for x in names if x != "entity"]

    def value(s, w):
        if w is None:
            return np.full(len(s), names.index("entity"))
        every = np.stack([s * on[x] if x == "entity" else w[:, others.index(x)] for x in names], axis=1)
        return np.where(np.isnan(every), -np.inf, every).argmax(axis=1)  # the first of equal ones

    best = layer_contributions(edges, weights)
    wide = best.groupBy("u", "v").agg(F.array(*[F.max(F.when(F.col("layer") == x, F.col("contribution"))) for x in others] or [F.lit(None).cast("double")]).alias("w"))
    made, rest = merged_pairs(_by_id(members), wide, value, "u string, v string, layer string", False, names)
    first = F.lit(None).cast("string")
    top = F.array_max("w")
    for i, name in reversed(list(enumerate(others))):
        first = F.when(F.get("w", F.lit(i)) == top, F.lit(name)).otherwise(first)
    return made.unionByName(rest.select("u", "v", first.alias("layer")))


def layer_counts(edges: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(layer, n_edges) of all layers, 0 where there is none. counted: (layer, n) of edges counted elsewhere."""
    names = edges.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    found = edges.groupBy("layer").agg(F.count("*").alias("n"))
    if counted is not None:
        found = found.unionByName(counted.select("layer", "n")).groupBy("layer").agg(F.sum("n").alias("n"))
    return F.broadcast(names).join(found, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n_edges"))


def ranked(df: DataFrame, group: list[str], by: str, tie: str, name: str = "rank") -> DataFrame:
    """Adds a rank from 1: largest first, ties by the smaller id."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), tie)))
