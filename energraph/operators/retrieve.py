"""From query vectors to activations: contact search, seed selection, exclusion, propagation."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from energraph.config import ColoredRetrievalConfig, ConflictConfig, DedupConfig, NegativeSeedConfig, PolarityConfig, PropagationConfig, RetrievalConfig, need
from energraph.operators.propagate import Bundle, negative_field, propagate
from energraph.operators.search import top_k
from energraph.operators.similarity import Similarity, cut, greedy_pick
from energraph.runtime import settle

KEY = ["qid", "color"]


@dataclass(frozen=True)
class Retrieval:
    """seeds and skipped contacts of every run, and the runs themselves."""

    seeds: DataFrame
    skipped: DataFrame
    bundle: Bundle

    def votes(self, sources: DataFrame | None = None) -> DataFrame:
        """(qid, source, votes): one, plus what contact selection and propagation each add."""
        contact = contact_votes(self.skipped, sources)
        both = contact.select("qid", "source", "votes").unionByName(self.bundle.votes.select("qid", "source", "votes"))
        return both.groupBy("qid", "source").agg((F.sum(F.col("votes") - 1) + 1).alias("votes"))


def contact_depth(width: int, overfetch: int, refill: bool) -> int:
    """More contacts are fetched only when a refill rule may skip some."""
    return width * overfetch if refill else width


def source_keys(ids: DataFrame, nodes: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """(node, source): the given source, else the node's, else the node itself."""
    out = ids.select("node").distinct().withColumn("source", F.lit(None).cast("string"))
    for table in ([given.select("node", F.col("source").alias("s"))] if given is not None else []) + ([nodes.select(F.col("id").alias("node"), F.col("source_id").alias("s"))] if nodes is not None else []):
        out = out.join(table, "node", "left").select("node", F.coalesce("source", "s").alias("source"))
    return out.select("node", F.coalesce("source", "node").alias("source"))


def _walk(order: list[tuple[str, float, str]], width: int, sims: dict[tuple[str, str], float] | None, tau: float | None, by_source: bool) -> list[tuple[str, float, str | None]]:
    """(node, score, survivor) of the contacts looked at until the slots are full."""
    kept: list[str] = []
    holder: dict[str, str] = {}
    out: list[tuple[str, float, str | None]] = []
    for node, score, source in order:
        if len(kept) == width:
            break
        survivor = None
        if sims is not None and tau is not None and kept:
            survivor = greedy_pick([*kept, node], {p: s for p, s in sims.items() if p[0] == node}, tau).get(node)
        if survivor is None and by_source:
            survivor = holder.get(source)
        if survivor is None:
            kept.append(node)
            holder[source] = node
        out.append((node, score, survivor))
    return out


def contact_pairs(contacts: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of contacts (qid, color, node) of the same run: as many as the square of a run's few contacts."""
    a, b = (contacts.select(*KEY, F.col("node").alias(x)) for x in ("a", "b"))
    return a.join(b, KEY).where("a < b").select("a", "b").distinct()


def select_contacts(contacts: DataFrame, width: int, dedup: DedupConfig | None = None, pairs: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(qid, color, node, weight, survivor, tau): the first distinct positive contacts.

    contacts (qid, color, node, score); pairs (u, v, sim) switch the cosine rule on, sources
    (node, source) the source rule. A skipped contact names its survivor. With the source rule
    alone the selection is a window; the cosine rule walks the few contacts of each run in order.
    """
    good = contacts.where("score > 0").select(*KEY, "node", "score")
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "node")
    blank = {"survivor": F.lit(None).cast("string"), "tau": F.lit(None).cast("double")}
    on = dedup is not None and dedup.enabled
    by_source = on and dedup.distinct_sources and sources is not None
    if not on or (pairs is None and not by_source):
        return good.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width).select(*KEY, "node", F.col("score").alias("weight")).withColumns(blank)
    named = good.join(sources.select("node", "source"), "node", "left").withColumn("source", F.coalesce("source", "node")) if by_source else good.withColumn("source", F.col("node"))
    if pairs is None:
        firsts = named.withColumn("place", F.row_number().over(order)).withColumn("holder", F.first("node").over(Window.partitionBy(*KEY, "source").orderBy("place")))
        numbered = firsts.withColumn("slots", F.sum((F.col("holder") == F.col("node")).cast("int")).over(Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
        seen = numbered.where(F.coalesce("slots", F.lit(0)) < width)
        return seen.select(*KEY, "node", F.col("score").alias("weight"), F.when(F.col("holder") != F.col("node"), F.col("holder")).alias("survivor"), blank["tau"].alias("tau"))
    both = pairs.select("u", "v", "sim").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    a, b = (good.select(*KEY, F.col("node").alias(x)) for x in ("u", "v"))
    listed = a.join(both, "u").join(b, [*KEY, "v"]).groupBy(*KEY).agg(F.collect_list(F.struct("u", "v", "sim")).alias("sims"))
    runs = named.groupBy(*KEY).agg(F.collect_list(F.struct("node", "score", "source")).alias("all")).join(listed, KEY, "left")

    def pick(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                rows = sorted(((x["node"], x["score"], x["source"]) for x in r.all), key=lambda x: (-x[1], x[0]))
                sims = {(x["u"], x["v"]): x["sim"] for x in r.sims} if r.sims is not None else {}
                upper = [s for (u, v), s in sims.items() if u < v]
                tau = cut(len(rows) * (len(rows) - 1) // 2, sum(upper), sum(s * s for s in upper), dedup)
                out += [(r.qid, r.color, n, s, v, tau) for n, s, v in _walk(rows, width, sims, tau, by_source)]
            yield pd.DataFrame(out, columns=["qid", "color", "node", "weight", "survivor", "tau"])

    return runs.mapInPandas(pick, "qid string, color string, node string, weight double, survivor string, tau double")


def contact_votes(skipped: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(qid, color, source, votes): one plus the skipped contacts of each survivor's source."""
    named = skipped.select(*KEY, F.col("survivor").alias("node"))
    named = named.join(sources.select("node", "source"), "node", "left").withColumn("source", F.coalesce("source", "node")) if sources is not None else named.withColumn("source", F.col("node"))
    return named.groupBy(*KEY, "source").agg((F.count("*") + 1).alias("votes"))


def absorbing_field(adj: DataFrame, vectors: DataFrame, negatives: DataFrame, propagation: PropagationConfig, cfg: NegativeSeedConfig, nodes: DataFrame | None = None) -> DataFrame:
    """(qid, node, field) of the negative queries (qid, part, embedding): the best score per node spreads."""
    tagged = negatives.select(F.struct("qid", "part").alias("key"), "embedding").select(F.concat_ws("\t", "key.qid", "key.part").alias("qid"), "embedding")
    hits = top_k(tagged, vectors, cfg.seed_width).where("score > 0")
    seeds = hits.select(F.substring_index("qid", "\t", 1).alias("qid"), "node", "score").groupBy("qid", "node").agg(F.max("score").alias("weight"))
    return negative_field(adj, settle(seeds), propagation, cfg.energy_ratio, nodes)


def retrieve(
    queries: DataFrame,
    vectors: DataFrame,
    adj: DataFrame,
    cfg: RetrievalConfig | ColoredRetrievalConfig = RetrievalConfig(),
    *,
    nodes: DataFrame | None = None,
    dedup: DedupConfig | None = None,
    pairs: DataFrame | None = None,
    similarity: Similarity | None = None,
    sources: DataFrame | None = None,
    negatives: DataFrame | None = None,
    negative_seed: NegativeSeedConfig | None = None,
    negative: DataFrame | None = None,
    conflict: ConflictConfig | None = None,
    polarity: PolarityConfig | None = None,
    residue: DataFrame | None = None,
) -> Retrieval:
    """Search, select and spread all queries (qid, embedding), with a ``color`` column if coloured.

    A query without any positive contact raises; so does a coloured one whose first colour has
    none, while later colours without a contact are left out. The order of the colours is that of
    a column ``place``, or else that of their names.
    """
    colored = "color" in queries.columns
    asked = queries if colored else queries.withColumn("color", F.lit("all"))
    refill = dedup is not None and dedup.enabled and (pairs is not None or (dedup.distinct_sources and sources is not None))
    depth = contact_depth(cfg.seed_width, cfg.contact_overfetch, refill)
    keyed = asked.select(F.concat_ws("\t", "qid", "color").alias("qid"), "embedding")
    found = top_k(keyed, vectors, depth).select(F.substring_index("qid", "\t", 1).alias("qid"), F.substring_index("qid", "\t", -1).alias("color"), "node", "score")
    picked = settle(select_contacts(found, cfg.seed_width, dedup, pairs, sources))
    seeds = picked.where("survivor IS NULL").select(*KEY, "node", "weight")
    primary = asked.groupBy("qid").agg((F.min_by("color", "place") if "place" in asked.columns else F.min("color")).alias("color"))
    need(primary.join(seeds, KEY, "left_anti").isEmpty(), "a query has no positive contact")
    field = None
    if negatives is not None:
        negative_seed = negative_seed or NegativeSeedConfig()
        field = absorbing_field(adj, vectors, negatives, cfg.propagation, negative_seed, nodes) if negative_seed.enabled else None
    run = propagate(adj, seeds, cfg.propagation, nodes=nodes, similarity=similarity, dedup=dedup, source_of=sources, negative=negative, conflict=conflict, absorb=field, negative_seed=negative_seed, residue=residue, polarity=polarity)
    return Retrieval(seeds, picked.where("survivor IS NOT NULL").select(*KEY, "node", "survivor", "tau"), run)
