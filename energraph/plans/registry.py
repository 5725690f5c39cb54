"""The query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from energraph.plans import builds, layers, references, waves

PARTS = [references, layers, waves, builds]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Activations of the vector graph, strongest first within each query."""
    return waves.wave(spark, folder)[0].ranked().select("qid", "node", F.round("energy", 6).alias("energy"), "rank").orderBy("qid", "rank")
