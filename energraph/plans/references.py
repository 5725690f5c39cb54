"""Queries of the reference check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from energraph.operators.references import orphan_report, orphans
from energraph.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """References of propositions, questions and negative edges without a node living at their time."""
    p, q, e, n = (table(spark, folder, t) for t in ("propositions", "questions", "negative_edges", "nodes"))

    def refs(df: DataFrame, name: str, field: str, key: str, target: object, at: str, scoped: bool) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(key).cast("string").alias("ref_id"), target.alias("target_id"), F.col(at).alias("at"), F.lit(scoped).alias("scoped"))

    every = (
        refs(p, "propositions", "chunk_id", "id", F.col("chunk_id"), "extracted_at", True)
        .unionByName(refs(q, "questions", "gold_ids", "id", F.explode(F.array_distinct("gold_ids")), "asked_at", True))
        .unionByName(refs(e, "negative_edges", "source", "edge_id", F.col("source"), "found_at", False))
        .unionByName(refs(e, "negative_edges", "target", "edge_id", F.col("target"), "found_at", False))
    )
    parents = n.select(F.col("id").alias("key"), F.col("created_at").alias("begins"), F.col("deleted_at").alias("ends"), (F.col("layer") == "chunk").alias("scoped"))
    return orphans(every, parents)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """The same references counted per table, field, month and kind."""
    return orphan_report(p2_found(spark, folder))


_FOUND = """
WITH refs AS (
  SELECT 'propositions' AS ref_table, 'chunk_id' AS ref_field, id AS ref_id, chunk_id AS target_id, extracted_at AS t, true AS chunks FROM propositions
  UNION ALL SELECT 'questions', 'gold_ids', id, unnest(list_distinct(gold_ids)), asked_at, true FROM questions
  UNION ALL SELECT 'negative_edges', 'source', CAST(edge_id AS VARCHAR), source, found_at, false FROM negative_edges
  UNION ALL SELECT 'negative_edges', 'target', CAST(edge_id AS VARCHAR), target, found_at, false FROM negative_edges
), wanted AS (
  SELECT DISTINCT * FROM refs WHERE target_id IS NOT NULL AND target_id <> ''
), held AS (
  SELECT w.ref_table, w.ref_field, w.ref_id, w.target_id, w.t, count(n.id) AS there, min(n.created_at) AS began,
         coalesce(bool_or(n.created_at <= w.t AND (n.deleted_at IS NULL OR n.deleted_at > w.t)), false) AS lives
  FROM wanted w LEFT JOIN nodes n ON n.id = w.target_id AND (NOT w.chunks OR n.layer = 'chunk')
  GROUP BY ALL
), found AS (
  SELECT DISTINCT ref_table, ref_field, ref_id, target_id, strftime(t, '%Y-%m') AS ref_month,
         CASE WHEN there = 0 THEN 'missing' WHEN began > t THEN 'late' ELSE 'deleted' END AS kind
  FROM held WHERE NOT lives
)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _FOUND + "SELECT * FROM found",
    "p2_report": _FOUND + "SELECT ref_table, ref_field, ref_month, kind, count(*) AS n_refs, count(DISTINCT target_id) AS n_targets FROM found GROUP BY ALL",
}
