"""The tables of an index: one Parquet table per stage, the merged graph never among them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from energraph.config import LayerWeights, need
from energraph.operators.graph import check_edges, check_unique, from_layers, from_layers_and_members
from energraph.operators.shared import shared_pairs
from energraph.runtime import remove

STAGES = ("nodes", "vectors", "entities", "propositions", "edges", "negative_edges", "meta", "llm_cache", "per_query", "results", "learned", "usage")


class Index:
    """Reads and writes the stages below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, stage: str) -> str:
        need(stage in STAGES, f"unknown stage {stage}")
        return f"{self.root}/{stage}"

    @property
    def members_path(self) -> str:
        """A part of the stage edges, written before it."""
        return f"{self.root}/edges_members"

    def has(self, stage: str) -> bool:
        return self._there(self.path(stage))

    def _there(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def available(self) -> list[str]:
        return [s for s in STAGES if self.has(s)]

    def plan(self) -> dict[str, bool]:
        """Which stages a build would skip."""
        return {s: self.has(s) for s in STAGES}

    def write(self, stage: str, df: DataFrame, *, force: bool = False, partition_by: str | None = None) -> bool:
        """Writes a stage unless it is there; true if it was written."""
        if self.has(stage) and not force:
            return False
        out = df.write.mode("overwrite")
        (out.partitionBy(partition_by) if partition_by else out).parquet(self.path(stage))
        return True

    def build(self, stage: str, make: Callable[[], DataFrame], *, force: bool = False) -> DataFrame:
        """A stage as it is stored; ``make`` is only called if it has to be written."""
        if force or not self.has(stage):
            self.write(stage, make(), force=True, partition_by="layer" if stage == "edges" else None)
        return self.read(stage)

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def read_or_empty(self, stage: str, schema: str) -> DataFrame:
        return self.read(stage) if self.has(stage) else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        df = self.read("nodes")
        have = set(df.columns)
        return df.withColumn("polarity", F.coalesce("polarity", F.lit(1)) if "polarity" in have else F.lit(1))

    def graph(self, weights: LayerWeights = LayerWeights(), digits: int | None = None) -> DataFrame:
        """The layers merged under the given weights; layers of weight 0 are not read. ``digits`` rounds w."""
        members = self.members()
        if members is not None:
            return from_layers_and_members(self.read("edges"), members, weights, digits)
        plain = from_layers(self.read("edges"), weights)  # an index whose edges hold the pairs of the entity layer
        return plain if digits is None else plain.select("src", "dst", F.round("w", digits).alias("w"))

    def members(self) -> DataFrame | None:
        """(entity, node_id, df): the entity layer as it is stored, linear where its pairs are not."""
        return self.spark.read.parquet(self.members_path) if self._there(self.members_path) else None

    def edges(self) -> DataFrame:
        """(layer, u, v, w, ord): the edges of every layer, those of the entity layer made from its members."""
        members, stored = self.members(), self.read("edges")
        if members is None:
            return stored
        pairs = shared_pairs(members.withColumnRenamed("node_id", "id"))
        return stored.select("layer", "u", "v", "w", "ord").unionByName(pairs.select(F.lit("entity").alias("layer"), "u", "v", "w", F.lit(0).cast("long").alias("ord")))

    def negative_edges(self) -> DataFrame:
        return self.read_or_empty("negative_edges", "a string, b string, strength double")

    def append_vectors(self, vectors: DataFrame) -> None:
        """Adds vectors (id, embedding): ids new and unique, one dimension."""
        need(vectors.where("id IS NULL OR id = '' OR embedding IS NULL").isEmpty(), "vectors need an id and numbers")
        check_unique(vectors, "id")
        dims = vectors.select(F.size("embedding").alias("d")).distinct()
        if self.has("vectors"):
            old = self.read("vectors")
            need(vectors.join(old, "id", "left_semi").isEmpty(), "an id is stored already")
            dims = dims.union(old.select(F.size("embedding")).limit(1)).distinct()
        need(dims.limit(2).count() <= 1, "vectors must have one dimension")
        vectors.select("id", "embedding").write.mode("append").parquet(self.path("vectors"))

    def write_edges(self, edges: DataFrame, *, force: bool = False) -> bool:
        check_edges(edges)
        if force or not self.has("edges"):  # else the members of another build would stand for the given entity layer
            remove(self.spark, self.members_path)
        return self.write("edges", edges, force=force, partition_by="layer")


def prompt_key(prompt) -> object:
    return F.sha2(prompt, 256)


def cache_tag(model: str) -> str:
    """A model name as a partition value."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", model)


def cached_completions(prompts: DataFrame, cache: DataFrame, complete: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows): prompts (prompt) are answered from the cache (key, response) or once by the model.

    ``complete`` adds ``response`` to distinct (key, prompt) rows; its output should be written
    before it is used twice.
    """
    keyed = prompts.withColumn("key", prompt_key(F.col("prompt")))
    missing = keyed.select("key", "prompt").distinct().join(cache.select("key"), "key", "left_anti")
    fresh = complete(missing).select("key", "response")
    return keyed.join(cache.select("key", "response").unionByName(fresh), "key", "left"), fresh


def pairs_to_snapshot(pairs: DataFrame, value: str) -> DataFrame:
    """(key, value) with both ends in one key."""
    return pairs.select(F.concat_ws("\t", "u", "v").alias("key"), F.col(value).alias("value"))


def pairs_from_snapshot(snapshot: DataFrame, value: str) -> DataFrame:
    parts = F.split("key", "\t")
    good = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("malformed key "), F.col("key"))).cast("array<string>"))
    return snapshot.select(good.alias("p"), "value").select(F.col("p")[0].alias("u"), F.col("p")[1].alias("v"), F.col("value").alias(value))
