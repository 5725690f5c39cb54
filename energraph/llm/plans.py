"""Queries of this subpackage and the SQL that states them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from energraph.llm.copies import copies
from energraph.llm.leaks import leaks
from energraph.llm.neighbours import nearest, neighbour_pairs
from energraph.llm.packing import pack
from energraph.llm.sampling import stable_sample
from energraph.llm.sentences import sentences
from energraph.llm.terms import WHITESPACE, term_frequencies
from energraph.runtime import settle
from energraph.sources.tables import table


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity with its mentions, its nodes and its mark."""
    return term_frequencies(table(spark, folder, "entities"), "node_id", "entities", min_df=2, max_df_ratio=0.02)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of too few or too many nodes."""
    return p1_terms(spark, folder).where("mark IS NOT NULL").selectExpr("term AS entity", "mark")


_TERMS = r"""
WITH rows AS (
  SELECT node_id, any_value(entities) AS entities FROM entities WHERE node_id IS NOT NULL GROUP BY node_id
), said AS (
  SELECT node_id, trim(lower(regexp_replace(e, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))) AS term FROM (SELECT node_id, unnest(entities) AS e FROM rows)
), counts AS (
  SELECT term, count(*) AS mentions, count(DISTINCT node_id) AS df, (SELECT count(*) FROM rows) AS records FROM said WHERE term <> '' GROUP BY term
), marked AS (
  SELECT *, CASE WHEN df < 2 THEN 'rare' WHEN df > 0.02 * records THEN 'common' END AS mark FROM counts
)
"""


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of which one is among the 5 most similar of the other, above 0.75."""
    return neighbour_pairs(nearest(table(spark, folder, "vectors"), "id", "embedding", k=5, min_similarity=0.75)).select("u", "v")


_NEAREST = """
WITH v AS (
  SELECT id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM vectors WHERE id IS NOT NULL AND embedding IS NOT NULL GROUP BY id
), usable AS (
  SELECT * FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0
), sims AS (
  SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM usable a, usable b WHERE a.id <> b.id
), near AS (
  SELECT id, other FROM sims WHERE s > 0.75 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 5
)
SELECT DISTINCT least(id, other) AS u, greatest(id, other) AS v FROM near
"""


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the questions, stable under reruns, layouts and later batches."""
    return stable_sample(table(spark, folder, "questions"), "id", "batch", seed=42, block_size=20, per_block=2).withColumnRenamed("key", "id")


_SAMPLE = """
WITH ids AS (
  SELECT id, min(batch) AS batch FROM questions WHERE id IS NOT NULL GROUP BY id
), numbered AS (
  SELECT id, CAST(batch AS BIGINT) AS batch, row_number() OVER (ORDER BY batch NULLS LAST, id) - 1 AS seq FROM ids
), placed AS (
  SELECT *, seq // 20 AS block, CAST(seq % 20 AS INTEGER) AS pos FROM numbered
)
SELECT * FROM placed p
WHERE len(list_filter(range(20), lambda x: md5('42:' || block || ':' || x) < md5('42:' || block || ':' || pos))) < 2
"""


def p5_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct passage with its number of copies."""
    return copies(table(spark, folder, "passages"), "chunk_id", "title", "text", "facts").where("key = keep").select("keep", "copies").withColumnRenamed("keep", "keep_id").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The copies of every passage that is kept."""
    return copies(table(spark, folder, "passages"), "chunk_id", "title", "text", "facts").where("key <> keep").selectExpr("keep AS keep_id", "key AS chunk_id")


_PLAIN = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_COPIES = f"""
WITH rows AS (
  SELECT DISTINCT chunk_id, coalesce({_PLAIN.format("title")}, '') AS title, {_PLAIN.format("text")} AS words, facts FROM passages WHERE chunk_id IS NOT NULL
), keyed AS (
  SELECT chunk_id, title, words,
         CASE WHEN facts IS NULL THEN '-' ELSE
           array_to_string(list_sort(list_distinct([{_PLAIN.format("k")} || '=' || {_PLAIN.format("json_extract_string(facts, '$.\"' || k || '\"')")} for k in json_keys(facts)])), ',') END AS facts
  FROM rows
), sets AS (
  SELECT *, min(chunk_id) OVER same AS keep_id, count(*) OVER same AS copies FROM keyed WHERE words <> '' WINDOW same AS (PARTITION BY title, words, facts)
)
"""


def p6_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of 2,048 tokens."""
    return pack(table(spark, folder, "documents"), "doc_id", "text", capacity=2048).withColumnRenamed("key", "doc_id")


def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers whatever the tokenizer: every document is in them once, none is overfull or overlaps, and only long documents are cut."""
    rows = settle(p6_packs(spark, folder))
    after = Window.partitionBy("container").orderBy("container_offset", "doc_id", "piece")  # at most 2,048 pieces
    placed = rows.where("container IS NOT NULL").withColumn("next", F.lead("container_offset", 1, 2048).over(after))
    none = F.lit(0).cast("bigint")
    bad = placed.agg(F.count_if(F.col("container_offset") + F.col("n_tokens") > F.col("next")).alias("overlaps")).select(none.alias("documents"), none.alias("wrongly_cut"), none.alias("gaps"), "overlaps")
    whole = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("token_start").alias("last"))
    wrong = whole.agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("n") / 2048), F.lit(1))).alias("wrongly_cut"), F.count_if((F.col("pieces") - 1) * 2048 != F.col("last")).alias("gaps"))
    return wrong.withColumn("overlaps", none).unionByName(bad).agg(*[F.sum(c).alias(c) for c in ("documents", "wrongly_cut", "gaps", "overlaps")])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that share a run of 60 letters and digits with an evaluation item."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), run=60, q=24)


_LEAKS = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("text")} AS w FROM documents), i AS (SELECT item_id, {_PLAIN.format("text")} AS w FROM eval_items),
di AS (SELECT item_id, substr(w, k, 60) AS run FROM i, unnest(range(1, length(w) - 58)) AS t(k)),
dd AS (SELECT doc_id, substr(w, k, 60) AS run FROM d, unnest(range(1, length(w) - 58)) AS t(k))
SELECT DISTINCT doc_id, item_id FROM dd JOIN di USING (run)
"""

def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document, by their offsets."""
    return sentences(table(spark, folder, "documents"), "doc_id", "text", with_text=False).select(F.col("key").alias("doc_id"), "start_at", "end_at").distinct()


def p8_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The same sentences with their number and their restored text."""
    return sentences(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The characters of each document's sentences without white space: none may be lost or come twice."""
    said = F.regexp_replace("sentence", WHITESPACE, "")
    return p8_sentences(spark, folder).groupBy("doc_id").agg(F.sum(F.char_length(said)).alias("chars"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_at", said.alias("t")))), lambda x: x["t"]), "")).alias("digest"))


_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_COVERED = f"SELECT doc_id, CAST(sum(length(w)) AS BIGINT) AS chars, md5(any_value(w)) AS digest FROM (SELECT doc_id, regexp_replace(text, '{_WHITE}', '', 'g') AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '' GROUP BY doc_id"

QUERIES = {
    "p1_found": p1_found, "p1_terms": p1_terms, "p3_found": p3_found, "p4_sample": p4_sample, "p5_found": p5_found,
    "p5_copies": p5_copies, "p6_packs": p6_packs, "p6_audit": p6_audit, "p7_found": p7_found, "p8_found": p8_found, "p8_sentences": p8_sentences, "p8_coverage": p8_coverage,
}
SQL = {
    "p1_found": _TERMS + "SELECT term AS entity, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT term, CAST(mentions AS BIGINT) AS mentions, CAST(df AS BIGINT) AS df, CAST(records AS BIGINT) AS records, mark FROM marked",
    "p3_found": _NEAREST,
    "p4_sample": _SAMPLE,
    "p5_found": _COPIES + "SELECT keep_id, chunk_id FROM sets WHERE chunk_id <> keep_id",
    "p5_copies": _COPIES + "SELECT keep_id, copies FROM sets WHERE chunk_id = keep_id UNION ALL SELECT chunk_id, 1 FROM keyed WHERE words = '' OR words IS NULL",
    "p6_audit": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS wrongly_cut, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS overlaps FROM documents",
    "p7_found": _LEAKS,
    "p8_coverage": _COVERED,
}
