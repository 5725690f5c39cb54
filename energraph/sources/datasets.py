"""Question sets in JSON lines and JSON arrays."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from energraph.config import EvaluationConfig, need
from energraph.functions.text import strip
from energraph.operators.corpus import bridge_approximation, bridge_chunks, gold_chunks, last_record, parse_hops, pool_paragraphs, sample_ids
from energraph.runtime import settle

_LINES = "id string, question string, answer string, answerable boolean, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<id:int,question:string,answer:string,paragraph_support_idx:int>>"
_ARRAYS = "_id string, type string, question string, answer string, context string, supporting_facts string"


def fetch(target: str, url: str, get: Callable[[str], bytes]) -> str:
    """Writes what ``get`` returns unless the file is there; only https is accepted."""
    need(url.startswith("https://"), "only https is fetched")
    if not os.path.exists(target):
        data = get(url)
        with open(f"{target}.part", "wb") as f:
            f.write(data)
        os.replace(f"{target}.part", target)
    return target


def read_lines(spark: SparkSession, path: str, sample: EvaluationConfig | None = None) -> dict[str, DataFrame]:
    """questions and pool of a JSON-lines set; the last record of an id wins, in the order of files and lines.

    ``sample`` keeps the seeded sample of the question ids, which the driver draws. A question
    without a supporting paragraph fails the job.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    raw = spark.read.text(path).select(strip(F.col("value")).alias("value"), place.alias("line")).where("value <> ''")
    rows = last_record(raw.select(F.from_json("value", _LINES).alias("r"), "line").select("r.*", "line"), "id", "line")
    if sample is not None:
        ids = sample_ids([r[0] for r in rows.select("id").collect()], sample)
        rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "id string")), "id", "left_semi")
    rows = settle(rows)
    paragraphs = rows.select("id", F.explode("paragraphs").alias("p")).select("id", "p.idx", "p.title", F.col("p.paragraph_text").alias("text"), "p.is_supporting")
    pool = pool_paragraphs(paragraphs)
    steps = rows.select("id", F.posexplode("question_decomposition").alias("step", "s")).select("id", "step", F.col("s.paragraph_support_idx").alias("support_idx"))
    questions = rows.select("id", "question", "answer", parse_hops(F.col("id")).alias("hops")).join(gold_chunks(paragraphs, pool), "id", "left").join(bridge_chunks(steps, paragraphs, pool), "id", "left")
    return {"questions": questions.withColumn("gold", _some(F.col("gold"), F.col("id"))), "pool": pool}


def _some(gold: Column, who: Column) -> Column:
    return F.when(F.size(gold) > 0, gold).otherwise(F.raise_error(F.concat(F.lit("no gold for "), who)).cast("array<string>"))


def read_arrays(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """questions and pool of a JSON array with (title, sentences) contexts; ids become type__id."""
    raw = spark.read.schema(_ARRAYS).json(path, multiLine=True)
    rows = raw.select(F.concat_ws("__", "type", "_id").alias("id"), "type", "question", "answer", F.from_json("context", "array<array<string>>").alias("context"), F.from_json("supporting_facts", "array<array<string>>").alias("facts"))
    each = rows.select("id", F.posexplode("context").alias("idx", "c"), "facts")
    text = F.array_join(F.transform(F.from_json(F.get("c", F.lit(1)), "array<string>"), lambda x: F.trim(x)), " ")
    para = each.select("id", "idx", F.get("c", F.lit(0)).alias("title"), text.alias("text"), "facts")
    first = para.groupBy("id", "title").agg(F.min_by(F.struct("idx", "text", "facts"), "idx").alias("p")).select("id", "title", "p.*")
    marked = first.withColumn("is_supporting", F.exists("facts", lambda f: F.get(f, F.lit(0)) == F.col("title")))
    pool = pool_paragraphs(marked)
    gold = marked.where("is_supporting").join(pool, ["title", "text"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "chunk_id", "text"))).alias("g"))
    both = rows.select("id", "type", "question", "answer").join(gold, "id")
    ids, texts = F.transform("g", lambda x: x["chunk_id"]), F.transform("g", lambda x: x["text"])
    questions = both.withColumns({"gold": ids, "texts": texts}).select("id", "question", "answer", F.size("gold").alias("hops"), "gold", bridge_approximation(F.col("type"), F.col("answer"), F.col("gold"), F.col("texts")).alias("bridge_gold"))
    return {"questions": questions, "pool": pool}
