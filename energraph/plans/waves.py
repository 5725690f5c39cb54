"""Queries over the vector graph: search, propagation and what is derived from it.

The graph joins every vector of ``embeddings`` with its 5 nearest (either way). The queries are
the vectors whose number is divisible by 20, against all vectors. The SQL states the hops as
unrolled common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from energraph.config import ConflictConfig, DedupConfig, EvaluationConfig, IterativeBaselineConfig, MassConfig, NegativeSeedConfig, OutputConfig, PolarityConfig, PropagationConfig, RetrievalConfig, SemanticEdgeConfig, ThermalConfig
from energraph.operators import evaluation as ev
from energraph.operators import outputs as out
from energraph.operators.edges import semantic_edges
from energraph.operators.feedback import edge_usage as used_pairs
from energraph.operators.feedback import evidence, thermal_turns
from energraph.operators.graph import from_edges
from energraph.operators.propagate import Bundle, confidence, disputed, propagate
from energraph.operators.retrieve import contact_pairs, contact_votes, retrieve, select_contacts
from energraph.operators.search import pair_similarity, top_k
from energraph.operators.similarity import VectorSimilarity
from energraph.runtime import kept, settle
from energraph.sources.tables import table

WAVE = PropagationConfig(threshold_ratio=0.01, split_alpha=3.0)
FLAT = PropagationConfig(threshold_ratio=0.02)
NARROW = PropagationConfig(threshold_ratio=0.01, split_alpha=3.0, max_nodes=10)
HEAVY = PropagationConfig(threshold_ratio=0.01, split_alpha=3.0, mass=MassConfig(enabled=True))
#: Two colours a query.
THEMES = PropagationConfig(threshold_ratio=0.05)
#: The vectors are hardly alike, so the floor is low enough for some to count as repeats.
TWINS = DedupConfig(floor=0.2, sigma=1.0)
HOPS = WAVE.max_hop + 1


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.format_string("v%06d", "vec_id").alias("id"), "embedding", "label", "vec_id")


def wave_graph(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        edges = semantic_edges(vectors(spark, folder).select("id", "embedding"), SemanticEdgeConfig(k=5))
        return settle(from_edges(edges.withColumn("ord", F.lit(0).cast("long"))))

    return kept(spark, folder, ["embeddings"], ("graph",), build)


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).where("vec_id % 20 = 0").select(F.col("id").alias("qid"), "embedding")


def contacts(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    return top_k(asked(spark, folder), vectors(spark, folder).select("id", "embedding"), k)


def wave_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return contacts(spark, folder).where("score > 0").select("qid", F.lit("all").alias("color"), "node", F.col("score").alias("weight"))


def wave_nodes(spark: SparkSession, folder: str) -> DataFrame:
    v = vectors(spark, folder)
    return v.select("id", F.lit("chunk").alias("layer"), F.concat(F.lit("L"), "label").alias("source_id"), (F.lit(50) + F.col("label") * 10).alias("length"), F.when(F.col("label") == 0, -1).otherwise(1).alias("polarity"))


def wave(spark: SparkSession, folder: str, cfg: PropagationConfig = WAVE, **more) -> tuple[Bundle, DataFrame]:
    """The runs and their graph; runs without further tables are kept, as their results are stored anyway."""
    adj = wave_graph(spark, folder)
    if more:
        return propagate(adj, wave_seeds(spark, folder), cfg, **more), adj
    return kept(spark, folder, ["embeddings"], (cfg,), lambda: propagate(adj, wave_seeds(spark, folder), cfg)), adj


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def vector_topk(spark, folder):
    return contacts(spark, folder, 10).select("qid", "node", _r("score"), F.col("rank").cast("bigint").alias("rank"))


def semantic_knn_edges(spark, folder):
    return semantic_edges(vectors(spark, folder).select("id", "embedding"), SemanticEdgeConfig(k=5)).select("u", "v", _r("w"))


def propagate_activations(spark, folder):
    return wave(spark, folder)[0].activations.select("qid", "node", _r("energy"), "hop")


def propagate_contributors(spark, folder):
    return wave(spark, folder)[0].activations.select("qid", "node", F.explode("contributors").alias("feeder"))


def propagate_runs(spark, folder):
    return wave(spark, folder)[0].runs.select("qid", _r("injected"), _r("threshold"), "hops_used", "stop_reason")


def propagate_alpha1(spark, folder):
    return wave(spark, folder, FLAT)[0].activations.select("qid", "node", _r("energy"), "hop")


def propagate_max_nodes(spark, folder):
    run = wave(spark, folder, NARROW)[0]
    return run.activations.join(run.runs, ["qid", "color"]).select("qid", "node", _r("energy"), "hop", "stop_reason")


def propagate_residue(spark, folder):
    warm = asked(spark, folder).select("qid", F.lit("v000001").alias("node"), F.lit(2.0).alias("energy"))
    return wave(spark, folder, residue=warm)[0].activations.select("qid", "node", _r("energy"), "hop")


def polarity_disputes(spark, folder):
    run = wave(spark, folder, nodes=wave_nodes(spark, folder), polarity=PolarityConfig(coefficient=0.5))[0]
    return run.disputes.select("qid", "node", "hop", _r("absorbed"), _r("energy_after"))


def absorption_ledger(spark, folder):
    v = vectors(spark, folder)
    negatives = asked(spark, folder).select("qid", F.lit("v000001").alias("id")).join(v, "id").select("qid", F.lit("n").alias("part"), "embedding")
    run = retrieve(asked(spark, folder), v.select("id", "embedding"), wave_graph(spark, folder), RetrievalConfig(WAVE), negatives=negatives, negative_seed=NegativeSeedConfig()).bundle
    return run.absorptions.select("qid", "node", "hop", _r("absorbed"), _r("energy_after"))


def negative_pairs(spark, folder):
    """A matching: every even vector against the next one."""
    v = vectors(spark, folder)
    return v.where("vec_id % 2 = 0").select(F.col("id").alias("a"), F.format_string("v%06d", F.col("vec_id") + 1).alias("b"), ((F.col("label") + 1) / 20).alias("strength"))


def _fight(spark, folder):
    return wave(spark, folder, negative=negative_pairs(spark, folder), conflict=ConflictConfig())[0]


def conflict_ledger(spark, folder):
    return _fight(spark, folder).conflicts.select("qid", "node_a", "node_b", "hop", _r("absorbed_each"))


def conflict_web(spark, folder):
    """Nodes that stand in several pairs each, so that the order of the pairs counts: 1, 2 and 3 numbers apart."""
    v = vectors(spark, folder)
    n = v.count()
    pairs = v.select("id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("d"), "vec_id", "label").select("id", F.format_string("v%06d", F.pmod(F.col("vec_id") + F.col("d"), F.lit(n))).alias("to"), ((F.col("label") + F.col("d")) / 20).alias("strength"))
    clash = pairs.groupBy(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).agg(F.max("strength").alias("strength"))
    run = wave(spark, folder, negative=clash, conflict=ConflictConfig())[0]
    return run.conflicts.select("qid", "node_a", "node_b", "hop", _r("absorbed_each"), _r("a_after"), _r("b_after"))


def disputed_nodes(spark, folder):
    return disputed(_fight(spark, folder))


def dedup_threshold(spark, folder):
    active = wave_seeds(spark, folder).select("qid", "color", "node")
    return VectorSimilarity(vectors(spark, folder).select("id", "embedding")).threshold(active, DedupConfig(floor=0.05, sigma=1.0)).select("qid", _r("tau"))


def _alike(spark, folder) -> VectorSimilarity:
    return VectorSimilarity(vectors(spark, folder).select("id", "embedding"))


def _deduped(spark, folder) -> Bundle:
    def build() -> Bundle:
        sources = wave_nodes(spark, folder).select(F.col("id").alias("node"), F.col("source_id").alias("source"))
        return wave(spark, folder, similarity=_alike(spark, folder), dedup=TWINS, source_of=sources)[0]

    return kept(spark, folder, ["embeddings"], ("deduped",), build)


def propagate_dedup(spark, folder):
    return _deduped(spark, folder).activations.select("qid", "node", _r("energy"), "hop")


def dedup_suppressed(spark, folder):
    return _deduped(spark, folder).suppressed.select("qid", "node", "survivor")


def dedup_votes(spark, folder):
    return _deduped(spark, folder).merged_votes().select("qid", "source", "votes")


def dedup_taus(spark, folder):
    return _deduped(spark, folder).taus.select("qid", "step", _r("tau"))


def node_votes(spark, folder):
    return out.votes_of(_deduped(spark, folder), wave_nodes(spark, folder)).select("qid", "node", "votes")


def _contacts_by_cosine(spark, folder):
    c = contacts(spark, folder, 15).where("score > 0").select("qid", F.lit("all").alias("color"), "node", "score")
    c = settle(c)
    pairs = pair_similarity(vectors(spark, folder).select("id", "embedding"), contact_pairs(c)).select(F.col("a").alias("u"), F.col("b").alias("v"), "sim")
    return select_contacts(c, 5, TWINS, pairs)


def seed_select_cosine(spark, folder):
    return _contacts_by_cosine(spark, folder).select("qid", "node", _r("weight"), "survivor", _r("tau"))


def seed_votes(spark, folder):
    return contact_votes(_contacts_by_cosine(spark, folder).where("survivor IS NOT NULL")).select("qid", "source", "votes")


def propagate_mass(spark, folder):
    return wave(spark, folder, HEAVY, nodes=wave_nodes(spark, folder))[0].activations.select("qid", "node", _r("energy"), "hop")


def edge_usage(spark, folder):
    return used_pairs(wave(spark, folder)[0])


def edge_evidence(spark, folder):
    return evidence(wave(spark, folder)[0]).groupBy("u", "v").agg(F.round(F.sum("gain"), 6).alias("gain"))


def seed_select_distinct_source(spark, folder):
    c = contacts(spark, folder, 10).select("qid", F.lit("all").alias("color"), "node", "score")
    sources = wave_nodes(spark, folder).select(F.col("id").alias("node"), F.col("source_id").alias("source"))
    return select_contacts(c, 3, DedupConfig(), None, sources).select("qid", "node", _r("weight"), "survivor")


def _colored(spark, folder, cfg=WAVE):
    v = vectors(spark, folder)
    n = v.count()
    first = v.where("vec_id % 20 = 0").select(F.col("id").alias("qid"), "vec_id")
    each = first.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("other", F.pmod(F.col("vec_id") + 7 * F.col("c"), F.lit(n)))
    q = each.join(v.select(F.col("vec_id").alias("other"), "embedding"), "other").select("qid", F.concat(F.lit("c"), "c").alias("color"), "embedding")
    keyed = q.select(F.concat_ws("\t", "qid", "color").alias("qid"), "embedding")
    found = top_k(keyed, v.select("id", "embedding"), 2).where("score > 0")
    seeds = found.select(F.substring_index("qid", "\t", 1).alias("qid"), F.substring_index("qid", "\t", -1).alias("color"), "node", F.col("score").alias("weight"))
    return kept(spark, folder, ["embeddings"], ("colored", cfg), lambda: propagate(wave_graph(spark, folder), seeds, cfg))


def colored_bridges(spark, folder):
    return _colored(spark, folder).bridges().select("qid", "node", F.array_join("colors", ",").alias("colors"))


def colored_ranked(spark, folder):
    return _colored(spark, folder).ranked().select("qid", "node", _r("energy"))


def wave_confidence(spark, folder):
    return confidence(wave(spark, folder)[0]).select("qid", _r("total_energy"), "node_count", "hop_depth")


def activation_paths(spark, folder):
    return out.activation_paths(wave(spark, folder)[0]).select("qid", "node", F.array_join("steps", ">").alias("steps"), "converging")


def _themes(spark, folder) -> tuple[Bundle, DataFrame]:
    run = _colored(spark, folder, THEMES)
    return run, kept(spark, folder, ["embeddings"], ("themes",), lambda: settle(out.theme_clusters(run, wave_graph(spark, folder))))


def theme_clusters(spark, folder):
    return _themes(spark, folder)[1].select("qid", "cluster", "size", _r("energy"), _r("share"), "top_node", F.array_join("colors", ",").alias("colors"))


def gap_warnings(spark, folder):
    return out.gap_warnings(_themes(spark, folder)[1], OutputConfig(2, 0.1)).select("qid", "left_node", "right_node")


def refusal_report(spark, folder):
    run, parts = _themes(spark, folder)
    return out.refusal_report(run, parts, out.gap_warnings(parts, OutputConfig(2, 0.1))).select("qid", "n_clusters", "n_gaps", F.array_join("deepest", ",").alias("deepest"))


def energy_ledger(spark, folder):
    run, adj = wave(spark, folder)
    return out.energy_ledger(run, adj, WAVE).select("qid", _r("injected"), _r("held"), _r("dissipated"), "balanced")


def web_vs_topk(spark, folder):
    return out.web_vs_topk(wave(spark, folder)[0].ranked(), contacts(spark, folder), 5).select("qid", "node", "badge")


def contributor_edges(spark, folder):
    run = wave(spark, folder)[0]
    return out.contributor_edges(run, out.select_subgraph(run, 10).where("shown"))


def induced_edges(spark, folder):
    run, adj = wave(spark, folder)
    return out.induced_edges(adj, out.select_subgraph(run, 10).where("shown"), 1000).select("qid", "u", "v", _r("w"))


def _scores(spark, folder) -> DataFrame:
    """Gold are the vectors of the query's label, those with an even number are bridge gold.

    A label is a tenth of all vectors, so gold sets are counted and never listed.
    """

    def build() -> DataFrame:
        v = vectors(spark, folder)
        run = wave(spark, folder)[0]
        web = run.ranked().where(F.col("rank") <= 10).select("qid", F.lit("web").alias("system"), "node", "rank")
        top = contacts(spark, folder, 10).select("qid", F.lit("topk").alias("system"), "node", "rank")
        more = _iterative(spark, folder).where(F.col("rank") <= 10).select("qid", F.lit("iterative").alias("system"), "node", "rank")
        lists = settle(web.unionByName(top).unionByName(more).withColumnRenamed("qid", "id"))
        of = v.select(F.col("id").alias("node"), F.col("label").alias("theirs"), (F.col("vec_id") % 2 == 0).alias("bridge"))
        own = v.where("vec_id % 20 = 0").select("id", "label")
        hits = lists.select("id", "node").distinct().join(own, "id").join(of, "node").where("label = theirs").select("id", "node", "bridge")
        counts = v.groupBy("label").agg(F.count("*").alias("n_gold"), F.count_if(F.col("vec_id") % 2 == 0).alias("n_bridge"))
        sizes = own.join(counts, "label").join(run.runs.select(F.col("qid").alias("id"), "stop_reason"), "id").select("id", (F.col("label") % 3 + 2).alias("hops"), "stop_reason", "n_gold", "n_bridge")
        return settle(ev.measures_of_lists(lists, hits, sizes))

    return kept(spark, folder, ["embeddings"], ("scores",), build)


def evaluation_report(spark, folder):
    return ev.report(_scores(spark, folder)).select("system", "k", *[_r(c) for c in ("recall", "novelty", "objective", "bridge")])


def objective_by_hop(spark, folder):
    return ev.objective_by_hop(_scores(spark, folder)).select("system", F.col("hops").cast("int").alias("hops"), _r("objective"), "n")


def stop_reasons(spark, folder):
    return ev.stop_reasons(_scores(spark, folder).select("id", "stop_reason").distinct())


def bootstrap_ci(spark, folder):
    return ev.bootstrap_report(_scores(spark, folder), EvaluationConfig())


def bootstrap_poisson(spark, folder):
    return ev.poisson_bootstrap(_scores(spark, folder), EvaluationConfig())


def paired_means(spark, folder):
    return ev.paired_means(_scores(spark, folder), EvaluationConfig()).select("rival", _r("mean"), "n")


def thermal_sessions(spark, folder):
    """Two turns per conversation; the second asks the next vector and starts warm."""
    v = vectors(spark, folder)
    n = v.count()
    adj, vecs = wave_graph(spark, folder), v.select("id", "embedding")
    turns = v.where("vec_id % 20 = 0").select(F.col("id").alias("qid"), "vec_id").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("other", F.pmod(F.col("vec_id") + F.col("turn"), F.lit(n))).join(v.select(F.col("vec_id").alias("other"), "embedding"), "other").select("qid", "turn", "embedding")
    cfg = RetrievalConfig(WAVE)

    def run(rows, warm):
        return retrieve(rows.select("qid", "embedding"), vecs, adj, cfg, residue=warm).bundle

    return thermal_turns(turns, run, cfg=ThermalConfig()).select("qid", "turn", "node", _r("energy"), "hop", _r("injected"))


def _iterative(spark, folder):
    """The next query is the vector of the best hit that is not the query itself."""
    vecs = vectors(spark, folder).select("id", "embedding")

    def follow(open_, held, step):
        best = held.where(F.col("node") != F.col("qid")).where(F.col("step") == step).groupBy("qid").agg(F.max_by("node", F.struct("score", "node")).alias("id"))
        return best.join(vecs, "id").select("qid", "embedding")

    return kept(spark, folder, ["embeddings"], ("iterative",), lambda: settle(ev.iterative_retrieve(asked(spark, folder), vecs, follow, IterativeBaselineConfig())))


def iterative_retrieval(spark, folder):
    return _iterative(spark, folder).select("qid", "node", _r("score"), "step", F.col("rank").cast("bigint").alias("rank"))


# The same in SQL

GRAPH = """
WITH v AS (SELECT printf('v%06d', vec_id) AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT a.id AS u, b.id AS v, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE a.id <> b.id),
near AS (SELECT u, v, s FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY s DESC, v) AS n FROM sims) WHERE n <= 5 AND s > 0),
edges AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(s) AS w FROM near GROUP BY 1, 2),
adj AS (SELECT u AS src, v AS dst, w FROM edges UNION ALL SELECT v, u, w FROM edges),
hits AS (SELECT a.id AS qid, b.id AS node, list_inner_product(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS rank FROM hits),
seeds AS (SELECT qid, 'all' AS color, node, score AS weight FROM ranked WHERE rank <= 5 AND score > 0)
"""


def sql_waves(cfg: PropagationConfig, seeds: str = "seeds", name: str = "", budget: str | None = None, residue: str | None = None, polarity: float | None = None, absorb: str | None = None, conflict: str | None = None, dedup: DedupConfig | None = None, mass: str | None = None) -> str:
    """Unrolled hops as CTEs: run, f0.., (energies that spread), a0.. (activations) and o1.. (offers), with a suffix."""
    p = name
    e = f"{float(budget or cfg.seed_energy)}e0"
    warm = f"(SELECT qid, sum(energy) AS extra FROM {residue} GROUP BY qid)" if residue else "(SELECT NULL AS qid, 0.0 AS extra)"
    c = [f"run{p} AS (SELECT s.qid, s.color, s.total, {e} AS budget, {e} + coalesce(w.extra, 0e0) AS injected, ({e} + coalesce(w.extra, 0)) * {cfg.threshold_ratio}e0 AS threshold FROM (SELECT qid, color, sum(weight) AS total FROM {seeds} GROUP BY qid, color) s LEFT JOIN {warm} w ON w.qid = s.qid)"]
    start = f"SELECT s.qid, s.color, s.node, r.budget * s.weight / r.total AS e FROM {seeds} s JOIN run{p} r USING (qid, color)"
    if residue:
        start = f"SELECT qid, color, node, sum(e) AS e FROM ({start} UNION ALL SELECT w.qid, r.color, w.node, w.energy FROM {residue} w JOIN run{p} r USING (qid)) GROUP BY qid, color, node"
    c.append(f"g0{p} AS ({start})")
    for h in range(cfg.max_hop + 1):
        before = " UNION ALL ".join(f"SELECT qid, color, node FROM a{i}{p}" for i in range(h)) or "SELECT NULL AS qid, NULL AS color, NULL AS node"
        room = f"QUALIFY row_number() OVER (PARTITION BY g.qid, g.color ORDER BY g.e DESC, g.node) <= {cfg.max_nodes} - (SELECT count(*) FROM ({before}) x WHERE x.qid = g.qid AND x.color = g.color)" if cfg.max_nodes < 512 else ""
        c.append(f"t{h}{p} AS (SELECT g.*, CAST({h} AS INTEGER) AS hop FROM g{h}{p} g {room})")
        lost = "0.0"
        join = ""
        if polarity is not None:
            lost, join = f"CASE WHEN n.label = 0 THEN {polarity}e0 * t.e ELSE 0e0 END", "LEFT JOIN v n ON n.id = t.node"
        if absorb:
            lost, join = "greatest(0.0, least(t.e, coalesce(n.field, 0.0)))", f"LEFT JOIN {absorb} n ON n.qid = t.qid AND n.node = t.node"
        c.append(f"a{h}{p} AS (SELECT t.qid, t.color, t.node, t.hop, t.e AS arrived, {lost} AS lost, t.e - {lost} AS e FROM t{h}{p} t {join})")
        alive = f"SELECT a.* FROM a{h}{p} a JOIN run{p} r USING (qid, color) WHERE a.lost <= 0 OR a.e >= r.threshold"
        act = " UNION ALL ".join(f"SELECT qid, color, node, hop, e FROM a{i}{p}" for i in range(h + 1))
        if conflict:
            damage = " UNION ALL ".join([f"SELECT qid, color, a AS node, each FROM c{i}{p} UNION ALL SELECT qid, color, b, each FROM c{i}{p}" for i in range(h)]) or "SELECT NULL AS qid, NULL AS color, NULL AS node, 0.0 AS each"
            c.append(f"n{h}{p} AS (SELECT x.qid, x.color, x.node, x.hop, x.e - coalesce((SELECT sum(each) FROM ({damage}) d WHERE d.qid = x.qid AND d.color = x.color AND d.node = x.node), 0) AS e FROM ({act}) x)")
            c.append(f"c{h}{p} AS (SELECT l.qid, l.color, k.a, k.b, CAST({h} AS INTEGER) AS hop, k.strength * least(l.e, r.e) AS each FROM {conflict} k JOIN n{h}{p} l ON l.node = k.a JOIN n{h}{p} r ON r.node = k.b AND r.qid = l.qid AND r.color = l.color WHERE greatest(l.hop, r.hop) = {h} AND k.strength * least(l.e, r.e) > 0)")
            hurt = f"SELECT qid, color, a AS node, each FROM c{h}{p} UNION ALL SELECT qid, color, b, each FROM c{h}{p}"
            alive = f"SELECT a.qid, a.color, a.node, a.hop, a.arrived, a.lost, a.e - coalesce(d.each, 0) AS e FROM a{h}{p} a JOIN run{p} r USING (qid, color) LEFT JOIN ({hurt}) d USING (qid, color, node) WHERE d.each IS NULL OR a.e - d.each >= r.threshold"
        if cfg.max_nodes < 512:
            alive = f"SELECT * FROM ({alive}) z WHERE NOT EXISTS (SELECT 1 FROM g{h}{p} g WHERE g.qid = z.qid AND g.color = z.color AND NOT EXISTS (SELECT 1 FROM t{h}{p} t WHERE t.qid = g.qid AND t.color = g.color AND t.node = g.node))"
        c.append(f"f{h}{p} AS ({alive})")
        c.append(f"l{h}{p} AS (SELECT f.qid, f.color, f.node AS src, f.e, d.dst, pow(d.w, {cfg.split_alpha}) AS part FROM f{h}{p} f JOIN adj d ON d.src = f.node WHERE d.w > 0 AND NOT EXISTS (SELECT 1 FROM ({act}) x WHERE x.qid = f.qid AND x.color = f.color AND x.node = d.dst))")
        live = f"SELECT * FROM l{h}{p}"
        if dedup:
            c.append(f"u{h}{p} AS ({sql_tau(f'SELECT x.qid, x.color, x.node FROM ({act}) x WHERE EXISTS (SELECT 1 FROM t{h}{p} t WHERE t.qid = x.qid AND t.color = x.color)', dedup)})")
            gone = " UNION ALL ".join(["SELECT qid, color, node FROM seedless", *[f"SELECT qid, color, node FROM s{i}{p}" for i in range(h)]])
            c.append(f"m{h}{p} AS (SELECT * FROM l{h}{p} l WHERE NOT EXISTS (SELECT 1 FROM ({gone}) x WHERE x.qid = l.qid AND x.color = l.color AND x.node = l.dst))")
            c.append(f"s{h}{p} AS (SELECT c.qid, c.color, c.dst AS node, x.node AS survivor FROM (SELECT DISTINCT qid, color, dst FROM m{h}{p}) c JOIN ({act}) x USING (qid, color) JOIN sims z ON z.u = c.dst AND z.v = x.node JOIN u{h}{p} t ON t.qid = c.qid AND t.color = c.color WHERE z.s >= t.tau QUALIFY row_number() OVER (PARTITION BY c.qid, c.color, c.dst ORDER BY z.s DESC, x.node) = 1)")
            live = f"SELECT * FROM m{h}{p} l WHERE NOT EXISTS (SELECT 1 FROM s{h}{p} x WHERE x.qid = l.qid AND x.color = l.color AND x.node = l.dst)"
        damping = f"pow({cfg.damping}e0, 1 / coalesce((SELECT mass FROM {mass} m WHERE m.id = src), 1e0))" if mass else f"{cfg.damping}e0"
        gate = f" * coalesce((SELECT mass FROM {mass} m WHERE m.id = o.dst), 1e0)" if mass else ""
        c.append(f"o{h + 1}{p} AS (SELECT qid, color, CAST({h} AS INTEGER) AS hop, src, dst, e * {damping} * part / sum(part) OVER (PARTITION BY qid, color, src) AS share FROM ({live}))")
        c.append(f"g{h + 1}{p} AS (SELECT o.qid, o.color, o.dst AS node, sum(o.share) AS e FROM o{h + 1}{p} o GROUP BY 1, 2, 3 HAVING sum(o.share) >= (SELECT threshold FROM run{p} r WHERE r.qid = o.qid AND r.color = o.color){gate})")
    c.append(f"act{p} AS ({' UNION ALL '.join(f'SELECT qid, color, node, hop, arrived, lost, e FROM a{h}{p}' for h in range(cfg.max_hop + 1))})")
    c.append(f"offers{p} AS ({' UNION ALL '.join(f'SELECT * FROM o{h + 1}{p}' for h in range(cfg.max_hop + 1))})")
    return ",\n".join(c)


def sql_tau(active: str, cfg: DedupConfig) -> str:
    """(qid, color, tau) of the similarities within each run's nodes."""
    spread = f"CASE WHEN count(z.s) < {cfg.min_pairs} THEN {cfg.floor}e0 ELSE greatest({cfg.floor}e0, avg(z.s) + {cfg.sigma}e0 * stddev_pop(z.s)) END"
    return f"SELECT k.qid, k.color, {spread} AS tau FROM (SELECT DISTINCT qid, color FROM ({active})) k LEFT JOIN (SELECT a.qid, a.color, y.s FROM ({active}) a JOIN ({active}) b ON b.qid = a.qid AND b.color = a.color AND a.node < b.node JOIN sims y ON y.u = a.node AND y.v = b.node) z ON z.qid = k.qid AND z.color = k.color GROUP BY 1, 2"


def sql_walk(rows: str, tau: str, name: str, width: int) -> str:
    """Rows (qid, color, node, weight, rank) taken in order while fewer than ``width`` are kept: with the survivor of each repeat."""
    hit = "list_sort(list_filter(list_transform(w.kept, lambda k: struct_pack(s := -list_cosine_similarity(k.e, v.e), node := k.node)), lambda k: k.s <= -t.tau))[1].node"
    return f"""{name}tau AS ({tau}),
{name} AS (SELECT c.qid, c.color, c.node, c.weight, c.rank, CAST(NULL AS VARCHAR) AS survivor, [struct_pack(node := c.node, e := v.e)] AS kept FROM {rows} c JOIN v ON v.id = c.node WHERE c.rank = 1
  UNION ALL SELECT c.qid, c.color, c.node, c.weight, c.rank, {hit}, CASE WHEN {hit} IS NULL THEN list_append(w.kept, struct_pack(node := c.node, e := v.e)) ELSE w.kept END
  FROM {name} w JOIN {rows} c ON c.qid = w.qid AND c.color = w.color AND c.rank = w.rank + 1 JOIN v ON v.id = c.node JOIN {name}tau t ON t.qid = w.qid AND t.color = w.color WHERE len(w.kept) < {width})"""


_ONE = GRAPH + ", " + sql_waves(WAVE)
_FEED = ", feed AS (SELECT DISTINCT a.qid, a.color, a.node, o.src FROM act a JOIN offers o ON o.qid = a.qid AND o.color = a.color AND o.dst = a.node AND o.hop < a.hop)"
_TOTAL = ", total AS (SELECT qid, node, sum(e) AS energy FROM act GROUP BY 1, 2), web AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY energy DESC, node) AS rank FROM total)"
_ASKS = GRAPH + """, asks AS (SELECT a.id AS qid, c, b.e FROM v a, (SELECT unnest([0, 1]) AS c), v b WHERE a.vec_id % 20 = 0 AND b.vec_id = (a.vec_id + 7 * c) % (SELECT count(*) FROM v)),
chits AS (SELECT q.qid, 'c' || q.c AS color, b.id AS node, list_inner_product(q.e, b.e) AS weight FROM asks q, v b QUALIFY row_number() OVER (PARTITION BY q.qid, q.c ORDER BY list_inner_product(q.e, b.e) DESC, b.id) <= 2),
cseeds AS (SELECT * FROM chits WHERE weight > 0), """
_COLORED = _ASKS + sql_waves(WAVE, "cseeds", budget="5.0")
_PARTS = _ASKS.replace("WITH v", "WITH RECURSIVE v", 1) + sql_waves(THEMES, "cseeds", budget="5.0", name="z") + """,
act AS (SELECT qid, node, sum(e) AS e FROM actz GROUP BY 1, 2),
links AS (SELECT a.qid, a.node AS x, b.node AS y FROM act a JOIN adj d ON d.src = a.node AND d.w > 0 JOIN act b ON b.qid = a.qid AND b.node = d.dst),
reach AS (SELECT qid, node AS x, node AS y FROM act UNION SELECT r.qid, r.x, l.y FROM reach r JOIN links l ON l.qid = r.qid AND l.x = r.y),
part AS (SELECT qid, x AS node, min(y) AS cluster FROM reach GROUP BY 1, 2),
parts AS (SELECT p.qid, p.cluster, count(*) AS size, sum(a.e) AS energy, sum(a.e) / sum(sum(a.e)) OVER (PARTITION BY p.qid) AS share, arg_max(p.node, (a.e, p.node)) AS top_node, (SELECT string_agg(DISTINCT z.color, ',' ORDER BY z.color) FROM actz z JOIN part pp ON pp.qid = z.qid AND pp.node = z.node WHERE z.qid = p.qid AND pp.cluster = p.cluster) AS colors FROM part p JOIN act a USING (qid, node) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY energy DESC, top_node) AS rank FROM parts),
gaps AS (SELECT a.qid, a.top_node AS left_node, b.top_node AS right_node FROM placed a JOIN placed b ON b.qid = a.qid AND a.rank < b.rank WHERE a.share >= 0.1 AND b.share >= 0.1 AND a.size >= 2 AND b.size >= 2)"""
def _iterated() -> str:
    """Searches 0 to max_steps; with max_collected ids held, new ones are refused in order of arrival."""
    cfg, c = IterativeBaselineConfig(), []
    c.append(f"i0 AS (SELECT qid, node, score, 0 AS step, rank FROM ranked WHERE rank <= {cfg.per_step_k}), w0 AS (SELECT * FROM i0)")
    for n in range(1, cfg.max_steps + 1):
        b = n - 1
        c.append(f"b{n} AS (SELECT qid, arg_max(node, (score, node)) AS id FROM w{b} WHERE step = {b} AND node <> qid GROUP BY 1)")
        c.append(f"i{n} AS (SELECT b.qid, y.id AS node, list_inner_product(x.e, y.e) AS score, {n} AS step, row_number() OVER (PARTITION BY b.qid ORDER BY list_inner_product(x.e, y.e) DESC, y.id) AS rank FROM b{n} b JOIN v x ON x.id = b.id, v y QUALIFY rank <= {cfg.per_step_k})")
        fresh = f"SELECT i.* FROM i{n} i ANTI JOIN w{b} w ON w.qid = i.qid AND w.node = i.node QUALIFY row_number() OVER (PARTITION BY i.qid ORDER BY i.rank) + (SELECT count(*) FROM w{b} z WHERE z.qid = i.qid) <= {cfg.max_collected}"
        c.append(f"w{n} AS (SELECT w.qid, w.node, greatest(w.score, coalesce(i.score, w.score)) AS score, w.step, w.rank FROM w{b} w LEFT JOIN i{n} i ON i.qid = w.qid AND i.node = w.node UNION ALL {fresh})")
    c.append(f"held AS (SELECT qid, node, score, step, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, step, node) AS rank FROM w{cfg.max_steps})")
    return ", ".join(c)


_EVAL = _ONE + _TOTAL + ", " + _iterated() + """,
lists AS (SELECT qid, 'web' AS system, node, rank FROM web UNION ALL SELECT qid, 'topk', node, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT qid, 'iterative', node, rank FROM held),
ks AS (SELECT unnest([2, 5, 10]) AS k),
gold AS (SELECT q.id AS qid, q.label, g.id AS node, g.vec_id % 2 = 0 AS bridge FROM v q JOIN v g USING (label) WHERE q.vec_id % 20 = 0),
sizes AS (SELECT qid, any_value(label) AS label, count(*) AS n, count(*) FILTER (bridge) AS nb FROM gold GROUP BY 1),
found AS (SELECT s.system, k.k, z.qid, z.label, z.n, z.nb, count(l.node) AS hit, count(l.node) FILTER (t.node IS NULL) AS fresh, count(l.node) FILTER (l.bridge) AS bridged
  FROM (SELECT DISTINCT system FROM lists) s CROSS JOIN ks k CROSS JOIN sizes z
  LEFT JOIN (SELECT l.*, g.bridge FROM lists l JOIN gold g USING (qid, node)) l ON l.system = s.system AND l.qid = z.qid AND l.rank <= k.k
  LEFT JOIN lists t ON t.system = 'topk' AND t.qid = z.qid AND t.node = l.node AND t.rank <= k.k
  GROUP BY ALL),
scores AS (SELECT *, hit / n AS recall, fresh / n AS novelty, 0.65 * hit / n + 0.35 * fresh / n AS objective, CASE WHEN nb > 0 THEN bridged / nb END AS bridge FROM found)"""


def _thermal() -> str:
    cfg = WAVE
    return GRAPH + """, hits2 AS (SELECT a.id AS qid, c.id AS node, list_inner_product(b.e, c.e) AS score FROM v a JOIN v b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM v), v c WHERE a.vec_id % 20 = 0),
seeds2 AS (SELECT qid, 'all' AS color, node, score AS weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS n FROM hits2) WHERE n <= 5 AND score > 0), """ + sql_waves(cfg, name="x") + ", warm AS (SELECT qid, node, 0.25 * sum(e) AS energy FROM actx GROUP BY 1, 2), " + sql_waves(cfg, "seeds2", name="y", residue="warm") + """
SELECT qid, CAST(0 AS INTEGER) AS turn, node, round(e, 6) AS energy, hop, round(injected, 6) AS injected FROM actx JOIN runx USING (qid, color)
UNION ALL SELECT qid, 1, node, round(e, 6), hop, round(injected, 6) FROM acty JOIN runy USING (qid, color)"""


_ITERATE = GRAPH + ", " + _iterated() + " SELECT qid, node, round(score, 6) AS score, CAST(step AS INTEGER) AS step, rank FROM held"

_ACT = "SELECT qid, node, round(e, 6) AS energy, hop FROM act"
_PATHS = _ONE + _FEED + """,
up AS (SELECT f.qid, f.node, arg_max(f.src, (a.e, f.src)) AS parent FROM feed f JOIN act a ON a.qid = f.qid AND a.node = f.src GROUP BY 1, 2),
p0 AS (SELECT a.qid, a.node, a.node AS head, a.node AS steps, (SELECT count(*) FROM feed f WHERE f.qid = a.qid AND f.node = a.node) AS converging FROM act a),
""" + ",\n".join(f"p{i + 1} AS (SELECT p.qid, p.node, coalesce(u.parent, '') AS head, CASE WHEN u.parent IS NULL THEN p.steps ELSE u.parent || '>' || p.steps END AS steps, p.converging FROM p{i} p LEFT JOIN up u ON u.qid = p.qid AND u.node = p.head)" for i in range(WAVE.max_hop)) + f"\nSELECT qid, node, steps, CAST(converging AS INTEGER) AS converging FROM p{WAVE.max_hop}"
_LEDGER = _ONE + """, sent AS (SELECT a.qid, a.node, a.hop, a.e, d.dst, b.hop AS dst_hop, pow(d.w, 3) AS part FROM act a JOIN adj d ON d.src = a.node AND d.w > 0 LEFT JOIN act b ON b.qid = a.qid AND b.node = d.dst WHERE b.hop IS NULL OR b.hop > a.hop),
flow AS (SELECT *, e * 0.6 * part / sum(part) OVER (PARTITION BY qid, node) AS amount FROM sent),
kept AS (SELECT a.qid, sum(a.e - coalesce(f.gone, 0)) AS held FROM act a LEFT JOIN (SELECT qid, node, sum(amount) AS gone FROM flow GROUP BY 1, 2) f USING (qid, node) GROUP BY 1),
waste AS (SELECT qid, sum(amount) FILTER (dst_hop IS NULL OR dst_hop <> hop + 1) AS dissipated FROM flow GROUP BY 1)
SELECT r.qid, round(r.injected, 6) AS injected, round(k.held, 6) AS held, round(coalesce(w.dissipated, 0), 6) AS dissipated, abs(r.injected - k.held - coalesce(w.dissipated, 0)) <= 1e-6 * r.injected AS balanced
FROM run r JOIN kept k USING (qid) LEFT JOIN waste w USING (qid)"""

_DEDUP = GRAPH.replace("WITH v", "WITH RECURSIVE v", 1) + ", hold AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, node) AS rank FROM seeds), " + sql_walk("hold", sql_tau("SELECT qid, color, node FROM seeds", TWINS), "walk", 512) + """,
seedless AS (SELECT qid, color, node, survivor FROM walk WHERE survivor IS NOT NULL), alone AS (SELECT qid, color, node, weight FROM walk WHERE survivor IS NULL), """ + sql_waves(WAVE, "alone", dedup=TWINS) + ", gone AS (SELECT qid, node, survivor FROM seedless UNION ALL " + " UNION ALL ".join(f"SELECT qid, node, survivor FROM s{h}" for h in range(HOPS)) + "), taus AS (SELECT qid, -1 AS step, tau FROM walktau UNION ALL " + " UNION ALL ".join(f"SELECT qid, {h}, tau FROM u{h}" for h in range(HOPS)) + ") "
_VOTES = ", votes AS (SELECT g.qid, 'L' || v.label AS source, count(*) + 1 AS votes FROM gone g JOIN v ON v.id = g.survivor GROUP BY 1, 2) "
_PICKED = GRAPH.replace("WITH v", "WITH RECURSIVE v", 1) + ", hold AS (SELECT qid, 'all' AS color, node, score AS weight, rank FROM ranked WHERE rank <= 15 AND score > 0), " + sql_walk("hold", sql_tau("SELECT qid, color, node FROM hold", TWINS), "walk", 5)

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, semantic_knn_edges, propagate_activations, propagate_contributors, propagate_runs, propagate_alpha1, propagate_max_nodes, propagate_residue, polarity_disputes, absorption_ledger,
        conflict_ledger, disputed_nodes, dedup_threshold, seed_select_distinct_source, colored_bridges, colored_ranked, activation_paths, theme_clusters, gap_warnings, refusal_report, energy_ledger,
        web_vs_topk, contributor_edges, induced_edges, evaluation_report, objective_by_hop, stop_reasons, bootstrap_ci, bootstrap_poisson, paired_means, thermal_sessions, iterative_retrieval,
        propagate_dedup, dedup_suppressed, dedup_votes, dedup_taus, node_votes, seed_select_cosine, seed_votes, propagate_mass, conflict_web, edge_usage, edge_evidence,
    )
} | {"confidence": wave_confidence}

SQL = {
    "vector_topk": GRAPH + "SELECT qid, node, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10",
    "semantic_knn_edges": GRAPH + "SELECT u, v, round(w, 6) AS w FROM edges",
    "propagate_activations": _ONE + _ACT,
    "propagate_contributors": _ONE + _FEED + "SELECT qid, node, src AS feeder FROM feed",
    "propagate_runs": _ONE + f"SELECT r.qid, round(r.injected, 6) AS injected, round(r.threshold, 6) AS threshold, (SELECT max(hop) FROM act a WHERE a.qid = r.qid) AS hops_used, CASE WHEN EXISTS (SELECT 1 FROM g{HOPS} g WHERE g.qid = r.qid) THEN 'max_hop' ELSE 'threshold' END AS stop_reason FROM run r",
    "propagate_alpha1": GRAPH + ", " + sql_waves(FLAT) + _ACT,
    "propagate_max_nodes": GRAPH + ", " + sql_waves(NARROW) + ", cut AS (" + " UNION ".join(f"SELECT qid FROM g{h} g WHERE NOT EXISTS (SELECT 1 FROM t{h} t WHERE t.qid = g.qid AND t.node = g.node)" for h in range(HOPS)) + f") SELECT a.qid, a.node, round(a.e, 6) AS energy, a.hop, CASE WHEN a.qid IN (SELECT qid FROM cut) THEN 'max_nodes' WHEN a.qid IN (SELECT qid FROM g{HOPS}) THEN 'max_hop' ELSE 'threshold' END AS stop_reason FROM act a",
    "propagate_residue": GRAPH + ", warm AS (SELECT id AS qid, 'v000001' AS node, 2.0 AS energy FROM v WHERE vec_id % 20 = 0), " + sql_waves(WAVE, residue="warm") + _ACT,
    "polarity_disputes": GRAPH + ", " + sql_waves(WAVE, polarity=0.5) + "SELECT qid, node, hop, round(lost, 6) AS absorbed, round(e, 6) AS energy_after FROM act WHERE lost > 0",
    "absorption_ledger": GRAPH + ", nhits AS (SELECT q.id AS qid, b.id AS node, list_inner_product(n.e, b.e) AS score FROM v q, v n, v b WHERE q.vec_id % 20 = 0 AND n.id = 'v000001'), nseeds AS (SELECT qid, 'all' AS color, node, score AS weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) AS n FROM nhits) WHERE n <= 5 AND score > 0), " + sql_waves(WAVE, "nseeds", name="n") + ", field AS (SELECT qid, node, e AS field FROM actn), " + sql_waves(WAVE, absorb="field") + "SELECT qid, node, hop, round(lost, 6) AS absorbed, round(e, 6) AS energy_after FROM act WHERE lost > 0",
    "dedup_threshold": GRAPH + ", pairs AS (SELECT a.qid, coalesce(s.s, 0) AS s FROM seeds a JOIN seeds b ON b.qid = a.qid AND a.node < b.node LEFT JOIN sims s ON s.u = a.node AND s.v = b.node) SELECT q.qid, round(CASE WHEN count(p.s) < 8 THEN 0.05 ELSE greatest(0.05, avg(p.s) + stddev_pop(p.s)) END, 6) AS tau FROM (SELECT DISTINCT qid FROM seeds) q LEFT JOIN pairs p USING (qid) GROUP BY q.qid",
    "seed_select_distinct_source": GRAPH + ", c AS (SELECT r.qid, r.node, r.score, r.rank, v.label, first_value(r.node) OVER (PARTITION BY r.qid, v.label ORDER BY r.rank) AS holder FROM ranked r JOIN v ON v.id = r.node WHERE r.rank <= 10 AND r.score > 0), d AS (SELECT *, coalesce(sum(CASE WHEN holder = node THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slots FROM c) SELECT qid, node, round(score, 6) AS weight, CASE WHEN holder <> node THEN holder END AS survivor FROM d WHERE slots < 3",
    "colored_bridges": _COLORED + "SELECT qid, node, string_agg(color, ',' ORDER BY color) AS colors FROM act GROUP BY 1, 2 HAVING count(*) >= 2",
    "colored_ranked": _COLORED + "SELECT qid, node, round(sum(e), 6) AS energy FROM act GROUP BY 1, 2",
    "confidence": _ONE + "SELECT qid, round(sum(e), 6) AS total_energy, count(*) AS node_count, max(hop) AS hop_depth FROM act GROUP BY 1",
    "activation_paths": _PATHS,
    "theme_clusters": _PARTS + "SELECT qid, cluster, size, round(energy, 6) AS energy, round(share, 6) AS share, top_node, colors FROM placed",
    "gap_warnings": _PARTS + "SELECT * FROM gaps",
    "refusal_report": _PARTS + "SELECT q.qid, (SELECT count(*) FROM parts p WHERE p.qid = q.qid) AS n_clusters, (SELECT count(*) FROM gaps g WHERE g.qid = q.qid) AS n_gaps, (SELECT string_agg(DISTINCT node, ',' ORDER BY node) FROM actz a WHERE a.qid = q.qid AND a.hop = q.deepest) AS deepest FROM (SELECT qid, max(hop) AS deepest FROM actz GROUP BY 1) q",
    "energy_ledger": _LEDGER,
    "web_vs_topk": _ONE + _TOTAL + "SELECT coalesce(w.qid, t.qid) AS qid, coalesce(w.node, t.node) AS node, CASE WHEN t.node IS NULL THEN 'web' WHEN w.node IS NULL THEN 'topk' ELSE 'both' END AS badge FROM (SELECT * FROM web WHERE rank <= 5) w FULL JOIN (SELECT * FROM ranked WHERE rank <= 5) t ON t.qid = w.qid AND t.node = w.node",
    "contributor_edges": _ONE + _FEED + _TOTAL + "SELECT f.qid, f.src AS u, f.node AS v FROM feed f JOIN web a ON a.qid = f.qid AND a.node = f.src AND a.rank <= 10 JOIN web b ON b.qid = f.qid AND b.node = f.node AND b.rank <= 10",
    "induced_edges": _ONE + _TOTAL + "SELECT a.qid, d.u, d.v, round(d.w, 6) AS w FROM edges d JOIN web a ON a.node = d.u AND a.rank <= 10 JOIN web b ON b.qid = a.qid AND b.node = d.v AND b.rank <= 10",
    "evaluation_report": _EVAL + "SELECT system, CAST(k AS INTEGER) AS k, round(avg(recall), 6) AS recall, round(avg(novelty), 6) AS novelty, round(avg(objective), 6) AS objective, round(avg(bridge), 6) AS bridge FROM scores GROUP BY 1, 2",
    "objective_by_hop": _EVAL + "SELECT system, CAST(label % 3 + 2 AS INTEGER) AS hops, round(avg(objective), 6) AS objective, count(*) AS n FROM scores WHERE k = 5 GROUP BY 1, 2",
    "stop_reasons": _ONE + f"SELECT CASE WHEN r.qid IN (SELECT qid FROM g{HOPS}) THEN 'max_hop' ELSE 'threshold' END AS stop_reason, count(*) AS n FROM run r GROUP BY 1",
    "paired_means": _EVAL + "SELECT o.system AS rival, round(avg(w.objective - o.objective), 6) AS mean, count(*) AS n FROM scores o JOIN scores w ON w.system = 'web' AND w.qid = o.qid AND w.k = o.k WHERE o.k = 5 AND o.system <> 'web' GROUP BY 1",
    "propagate_dedup": _DEDUP + _ACT,
    "dedup_suppressed": _DEDUP + "SELECT qid, node, survivor FROM gone",
    "dedup_votes": _DEDUP + _VOTES + "SELECT qid, source, votes FROM votes",
    "dedup_taus": _DEDUP + "SELECT qid, CAST(step AS INTEGER) AS step, round(tau, 6) AS tau FROM taus",
    "node_votes": _DEDUP + _VOTES + "SELECT a.qid, a.node, coalesce(n.votes, s.votes, 1) AS votes FROM act a JOIN v ON v.id = a.node LEFT JOIN votes n ON n.qid = a.qid AND n.source = a.node LEFT JOIN votes s ON s.qid = a.qid AND s.source = 'L' || v.label",
    "seed_select_cosine": _PICKED + "SELECT qid, node, round(weight, 6) AS weight, survivor, round(tau, 6) AS tau FROM walk JOIN walktau USING (qid, color)",
    "seed_votes": _PICKED + "SELECT qid, survivor AS source, count(*) + 1 AS votes FROM walk WHERE survivor IS NOT NULL GROUP BY 1, 2",
    "propagate_mass": GRAPH + ", heavy AS (SELECT id, least(2e0, greatest(0.5e0, (50 + label * 10) / avg(50 + label * 10) OVER ())) AS mass FROM v), " + sql_waves(HEAVY, mass="heavy") + _ACT,
    "edge_usage": _ONE + _FEED + "SELECT least(src, node) AS u, greatest(src, node) AS v, count(DISTINCT qid) AS n FROM feed GROUP BY 1, 2",
    "edge_evidence": _ONE + _FEED + ", n AS (SELECT qid, node, count(*) AS n FROM feed GROUP BY 1, 2) SELECT least(f.src, f.node) AS u, greatest(f.src, f.node) AS v, round(sum(least(1e0, a.e / n.n / r.injected)), 6) AS gain FROM feed f JOIN n USING (qid, node) JOIN act a ON a.qid = f.qid AND a.node = f.node JOIN run r ON r.qid = f.qid GROUP BY 1, 2",
    "thermal_sessions": _thermal(),
    "iterative_retrieval": _ITERATE,
}
_CONFLICTS = GRAPH + ", clash AS (SELECT id AS a, printf('v%06d', vec_id + 1) AS b, (label + 1) / 20 AS strength FROM v WHERE vec_id % 2 = 0), " + sql_waves(WAVE, conflict="clash") + ", fought AS (" + " UNION ALL ".join(f"SELECT * FROM c{h}" for h in range(HOPS)) + ")"
SQL["conflict_ledger"] = _CONFLICTS + "SELECT qid, a AS node_a, b AS node_b, hop, round(each, 6) AS absorbed_each FROM fought"
SQL["disputed_nodes"] = _CONFLICTS + ", ends AS (SELECT qid, a AS node, each FROM fought UNION ALL SELECT qid, b, each FROM fought) SELECT qid, node FROM (SELECT e.qid, e.node, sum(e.each) AS gone FROM ends e GROUP BY 1, 2) x JOIN act USING (qid, node) WHERE e - gone > 0"
