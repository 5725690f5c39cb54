"""Builders of edge layers. All return canonical pairs u < v unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from energraph.config import ConsolidationConfig, EntityEdgeConfig, NLICandidateConfig, SemanticEdgeConfig, StructuralEdgeConfig, need
from energraph.functions.text import casefold
from energraph.operators.graph import canonical
from energraph.operators.search import top_k
from energraph.operators.shared import Membership, count_shared, shared_labels, shared_pairs
from energraph.runtime import session_of, settle, sweep

#: Members of a group are paired in blocks of this size, so a large group is many tasks.
ENTITY_BLOCK = 2048
#: (vectors (id, embedding), k) to (qid, node, score): the k nearest others of each vector by cosine.
Neighbours = Callable[[DataFrame, int], DataFrame]


def exact_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """Compares all with all, in blocks: exact, and quadratic in the number of vectors."""
    return top_k(vectors.select(F.col("id").alias("qid"), "embedding"), vectors, k, skip_self=True, metric="cosine")


def semantic_edges(vectors: DataFrame, cfg: SemanticEdgeConfig = SemanticEdgeConfig(), neighbours: Neighbours = exact_neighbours) -> DataFrame:
    """(u, v, w): cosine of pairs of which one end has the other among its k nearest, above the bound.

    vectors: (id, embedding), ids unique. The search can be replaced by an index whose cost does
    not grow with the square of the vectors. A vector that is null or all zero fails the job.
    """
    zero = ~F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    checked = vectors.select("id", F.when(zero, F.raise_error(F.concat(F.lit("no direction in the vector of "), F.col("id").cast("string"))).cast(vectors.schema["embedding"].dataType)).otherwise(F.col("embedding")).alias("embedding"))
    near = neighbours(checked, cfg.k)
    pairs = near.where(F.col("score") > cfg.min_similarity).select(F.least("qid", "node").alias("u"), F.greatest("qid", "node").alias("v"), F.col("score").alias("w"))
    return pairs.groupBy("u", "v").agg(F.max("w").alias("w"))


def mentions(entities: DataFrame) -> DataFrame:
    """(node_id, entity) distinct, without null and empty names."""
    return entities.select("node_id", F.explode("entities").alias("entity")).where("entity IS NOT NULL AND entity <> ''").distinct()


def entity_frequency(entities: DataFrame, max_ratio: float) -> DataFrame:
    """(entity, df) of entities in at least two nodes and at most ``max_ratio`` of all nodes."""
    n = entities.select("node_id").distinct().count()
    return mentions(entities).groupBy("entity").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= F.lit(max_ratio) * n))


def pairs_within(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, u, v), u < v: every two ids of the same group (keys, id), whose size the rows carry.

    A group is split into blocks by a hash of the id and joined block by block, so that no task
    takes more than two blocks of it.
    """
    blocks = F.ceil(size / ENTITY_BLOCK).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash("id"), "blocks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = placed.select(*keys, F.col("id").alias("u"), F.col("own").alias("a"), F.explode(every).alias("b"))
    right = placed.select(*keys, F.col("id").alias("v"), F.explode(every).alias("a"), F.col("own").alias("b"))
    return left.join(right, [*keys, "a", "b"]).where("u < v").select(*keys, "u", "v")


def membership(entities: DataFrame, cfg: EntityEdgeConfig = EntityEdgeConfig()) -> Membership:
    """The names of each node and the frequency of those that the guard lets through, stored once; no mention is shuffled."""
    names = F.array_distinct(F.filter(F.flatten(F.collect_list("entities")), lambda x: x.isNotNull() & (x != "")))
    own = settle(entities.groupBy("node_id").agg(names.alias("names")).withColumnRenamed("node_id", "id"))
    sweep(session_of(own), collect=True)  # the entities as they were shuffled
    n = own.count()
    df = own.select(F.explode("names").alias("entity")).groupBy("entity").agg(F.count("*").alias("df"))
    return Membership(own, df.where((F.col("df") >= 2) & (F.col("df") <= F.lit(cfg.max_df_ratio) * n)))


def entity_members(entities: DataFrame, cfg: EntityEdgeConfig = EntityEdgeConfig()) -> DataFrame:
    """(entity, node_id, df): the layer as membership, linear in the mentions where the pairs are not.

    Two nodes are linked by the entities they share, each with 1 / df.
    """
    own = settle(entities.select("node_id", "entities"))  # read three times
    return mentions(own).join(entity_frequency(own, cfg.max_df_ratio), "entity").select("entity", "node_id", "df")


def entity_edges(entities: DataFrame, cfg: EntityEdgeConfig = EntityEdgeConfig(), digits: int | None = None) -> DataFrame:
    """(u, v, w): 1/df summed over shared entities, the same in every run and layout.

    entities: (node_id, entities array), one row per node, empty arrays included. The frequency
    guard runs before anything is paired. Every pair of an entity comes out, so the result grows
    with the square of the most frequent entities' df; ``entity_members`` is the linear form. Each
    node's names are all that is shuffled or stored. ``digits`` rounds w.
    """
    return shared_pairs(membership(entities, cfg), digits)


def count_entity_edges(entities: DataFrame, cfg: EntityEdgeConfig = EntityEdgeConfig()) -> DataFrame:
    """(n): how many rows ``entity_edges`` has, counted where they are made."""
    return count_shared(membership(entities, cfg)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def entity_labels(entities: DataFrame, cfg: EntityEdgeConfig = EntityEdgeConfig()) -> DataFrame:
    """(u, v, label): the rarest entity of each pair of ``entity_edges``, ties by name."""
    return shared_labels(membership(entities, cfg))


_STEPS = pa.schema([("part", pa.int32()), ("place", pa.string()), ("source_id", pa.string()), ("position", pa.int64()), ("a", pa.string()), ("b", pa.string())])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within a sorted partition, and its first and last row, at which others continue."""
    part, before = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        out = []
        for row in rows:
            if before is None:
                out.append((part, "first", *row, None))
            elif before[0] == row[0]:
                if before[1] == row[1]:
                    raise ValueError(f"{before[2]} and {row[2]} share a position of {row[0]}")
                out.append((part, "step", None, None, before[2], row[2]))
            before = row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _STEPS)], schema=_STEPS)
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, "last", *before, None), _STEPS)], schema=_STEPS)


def adjacent_pairs(refs: DataFrame) -> DataFrame:
    """(a, b): consecutive ids of a source by position, gaps allowed.

    A source may be most of the table: the rows are range-partitioned by (source, position), each
    partition links its own rows, and the driver links the ends of neighbouring partitions, of
    which it holds two rows a partition.
    """
    rows = refs.where("source_id IS NOT NULL AND position IS NOT NULL").select(F.col("source_id").cast("string"), F.col("position").cast("bigint"), F.col("id").cast("string"))
    ordered = rows.repartitionByRange("source_id", "position", "id").sortWithinPartitions("source_id", "position", "id")
    found = settle(ordered.mapInArrow(_steps, "part int, place string, source_id string, position bigint, a string, b string"))
    ends = sorted(found.where("place <> 'step'").select("part", "place", "source_id", "position", "a").collect())
    across = []
    for last, first in zip(ends[1::2], ends[2::2]):
        if last.source_id == first.source_id:
            need(last.position != first.position, f"{last.a} and {first.a} share a position of {last.source_id}")
            across.append((last.a, first.a))
    return found.where("place = 'step'").select("a", "b").unionByName(refs.sparkSession.createDataFrame(across, "a string, b string"))


def structural_edges(refs: DataFrame, cfg: StructuralEdgeConfig = StructuralEdgeConfig()) -> DataFrame:
    """(u, v, w): the strongest of adjacent, same section and same document.

    refs: (id, source_id, position, section_id), ids unique; a position that a source has twice is
    refused. A relation of weight 0 is not planned at all. Same section and same document give
    every pair of the group, as many as its size squared.
    """
    parts = []
    if cfg.adjacent > 0:
        parts.append(adjacent_pairs(refs).select("a", "b", F.lit(float(cfg.adjacent)).alias("w")))
    for strength, keys in ((cfg.same_section, ["source_id", "section_id"]), (cfg.same_document, ["source_id"])):
        if strength > 0:
            own = refs.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(*keys, "id")
            sized = own.join(own.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"), keys)
            parts.append(pairs_within(sized, keys, F.col("size")).select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(float(strength)).alias("w")))
    if not parts:
        return refs.sparkSession.createDataFrame([], "u string, v string, w double")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*canonical("a", "b")).agg(F.max("w").alias("w"))


def derivation_edges(propositions: DataFrame) -> DataFrame:
    """(u, v, w): (chunk, proposition, 1), in this direction."""
    return propositions.where("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))


def negative_adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, strength), a < b: the strongest of each pair of (source, target, strength)."""
    usable = edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> '' AND target <> '' AND source <> target AND strength > 0")
    return usable.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("strength").alias("strength"))


def early_subjects(texts: DataFrame, entities: DataFrame, cfg: NLICandidateConfig = NLICandidateConfig()) -> DataFrame:
    """(node_id, entity): the rare entities that a text (id, text) names early, in any case."""
    n = entities.select("node_id").distinct().count()
    own = mentions(entities).select("node_id", casefold(F.col("entity")).alias("entity")).distinct()
    rare = own.groupBy("entity").agg(F.count("*").alias("df")).where(F.col("df") <= F.lit(cfg.max_subject_df_ratio) * n)
    early = casefold(F.substring("text", 1, cfg.subject_prefix_chars))
    return own.join(rare, "entity").join(texts, F.col("node_id") == F.col("id")).where(F.instr(early, F.col("entity")) > 0).select("node_id", "entity")


def subject_pairs(texts: DataFrame, entities: DataFrame, cfg: NLICandidateConfig = NLICandidateConfig()) -> DataFrame:
    """(a, b), a < b: all pairs of texts that share an early rare entity, each once; ids of texts are unique.

    Made from the early mentions alone: no pair that would be dropped is ever made, and none is shuffled.
    """
    own = early_subjects(texts, entities, cfg)
    sized = own.join(own.groupBy("entity").agg(F.count("*").alias("df")).where("df > 1"), "entity")
    return shared_pairs(sized.withColumnRenamed("node_id", "id")).select(F.col("u").alias("a"), F.col("v").alias("b"))


def shared_subject_pairs(candidates: DataFrame, texts: DataFrame, entities: DataFrame, cfg: NLICandidateConfig = NLICandidateConfig()) -> DataFrame:
    """Candidates (ord, a, b) that share a rare entity named early in both texts, in any case; order kept.

    texts: (id, text). A pair without text or entities is dropped.
    """
    subjects = early_subjects(texts, entities, cfg)
    a, b = (subjects.select(F.col("node_id").alias(x), F.col("entity").alias(f"name_{x}")) for x in ("a", "b"))
    hits = candidates.join(a, "a").join(b, "b").where("name_a = name_b").select("ord").distinct()
    return candidates.join(hits, "ord", "left_semi")


def nli_candidates(vectors: DataFrame, texts: DataFrame, entities: DataFrame, cfg: NLICandidateConfig = NLICandidateConfig(), neighbours: Neighbours = exact_neighbours) -> DataFrame:
    """(ord, a, b, similarity): near pairs, most similar first, filtered by subject before the cap."""
    edges = semantic_edges(vectors, SemanticEdgeConfig(cfg.top_k, cfg.min_similarity), neighbours)
    pairs = edges.select(F.concat_ws("\t", "u", "v").alias("ord"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("similarity"))
    kept = shared_subject_pairs(pairs, texts, entities, cfg) if cfg.require_shared_subject else pairs
    return kept.orderBy(F.desc("similarity"), "a", "b").limit(cfg.max_pairs)


def nli_edges(candidates: DataFrame, texts: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = 0.90) -> DataFrame:
    """(a, b, strength): the larger score of both directions where it reaches the threshold.

    ``score`` adds a column ``score`` to (a, b, premise, hypothesis) rows, batch by batch.
    """
    need(0 < threshold <= 1, "threshold must be in (0, 1]")
    t = texts.select("id", "text")
    pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    said = pairs.join(t.withColumnsRenamed({"id": "a", "text": "ta"}), "a", "left").join(t.withColumnsRenamed({"id": "b", "text": "tb"}), "b", "left")
    checked = said.withColumn("a", F.when((F.col("a") == F.col("b")) | F.col("ta").isNull() | F.col("tb").isNull(), F.raise_error(F.lit("a pair needs two nodes with text"))).otherwise(F.col("a")))
    both = checked.select("a", "b", F.col("ta").alias("premise"), F.col("tb").alias("hypothesis")).unionByName(checked.select("a", "b", F.col("tb").alias("premise"), F.col("ta").alias("hypothesis")))
    return score(both).groupBy("a", "b").agg(F.max("score").alias("strength")).where(F.col("strength") >= threshold)


def prune_layers(edges: DataFrame, usage: DataFrame, runs: int, cfg: ConsolidationConfig = ConsolidationConfig()) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): edges (layer, u, v, ...) never used are removed once enough runs were seen."""
    if runs < cfg.min_runs:
        return edges, edges.limit(0)
    used = usage.where("n > 0").select(F.least("u", "v").alias("_u"), F.greatest("u", "v").alias("_v")).distinct()
    same = (F.least("u", "v") == F.col("_u")) & (F.greatest("u", "v") == F.col("_v"))
    return edges.join(used, same, "left_semi"), edges.join(used, same, "left_anti")
