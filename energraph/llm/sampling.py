"""A sample that is the same in every rerun and layout and keeps its members as data grows.

Distinct keys get sequence numbers in order of arrival (first batch, then key), dense over all
partitions. The numbers fall into fixed blocks, and a hash of the block number decides which
positions of a block are in the sample, whether rows already fill them or not: position p of
block b is chosen if md5(seed:b:p) is among the ``per_block`` smallest of its block. Keys of later
batches only get later numbers, so nothing that was chosen is ever dropped.

The numbers persist if they are stored: ``sequence_numbers`` takes the table it returned before
and numbers only the keys that it does not hold, after all others, whatever batch they name. So
even a row that turns up late in an old batch moves nobody.

Defined results: a key counts once, with its earliest batch; without stored numbers, keys whose
batches are all null come after all others; rows without a key are not numbered; an empty table
gives an empty sample. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from energraph.runtime import session_of, settle

_NO_BATCH = (1 << 63) - 1


def sequence_numbers(df: DataFrame, key: str, batch: str, stored: DataFrame | None = None) -> DataFrame:
    """(key, batch, seq): dense numbers from 0 in order of (earliest batch, key).

    stored: (key, batch, seq) of an earlier call, which keep their rows as they are. Write the
    result where it can be read again.
    """
    ids = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.coalesce(F.min(F.col(batch).cast("bigint")), F.lit(_NO_BATCH)).alias("batch"))
    first = 0
    if stored is not None:
        ids = ids.join(stored.select("key"), "key", "left_anti")
        first = stored.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(np.arange(n, n + b.num_rows))], names=["key", "batch", "part", "local"])
            n += b.num_rows

    kind = ids.schema["key"].dataType.simpleString()
    ordered = ids.repartitionByRange("batch", "key").sortWithinPartitions("batch", "key")
    local = settle(ordered.mapInArrow(number, f"key {kind}, batch bigint, part int, local bigint"))
    sizes = sorted(tuple(r) for r in local.groupBy("part").count().collect())  # a row per partition
    starts = np.append(0, np.cumsum([n for _, n in sizes])) + first
    offsets = session_of(df).createDataFrame([(p, int(starts[i])) for i, (p, _) in enumerate(sizes)], "part int, offset bigint")
    fresh = local.join(F.broadcast(offsets), "part").select("key", F.when(F.col("batch") != _NO_BATCH, F.col("batch")).alias("batch"), (F.col("offset") + F.col("local")).alias("seq"))
    return fresh if stored is None else stored.select("key", "batch", "seq").unionByName(fresh)


def chosen_positions(block: int, seed: int, block_size: int, per_block: int) -> list[int]:
    """The positions of a block whose tickets are the smallest."""
    return sorted(range(block_size), key=lambda p: md5(f"{seed}:{block}:{p}".encode()).hexdigest())[:per_block]


def sampled(numbers: DataFrame, *, seed: int = 42, block_size: int = 20, per_block: int = 2) -> DataFrame:
    """(key, batch, seq, block, pos) of the numbered keys (key, batch, seq) that are chosen.

    The tickets are drawn once for each block that a batch of rows holds, not for every row.
    """
    if not 0 < per_block <= block_size:
        raise ValueError("per_block must be in (0, block_size]")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, pos = np.divmod(b.column(2).to_numpy(), block_size)
            wanted = [u * block_size + p for u in np.unique(block).tolist() for p in chosen_positions(u, seed, block_size, per_block)]
            hit = np.isin(b.column(2).to_numpy(), np.array(wanted, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), pa.array(pos.astype(np.int32))], names=["key", "batch", "seq", "block", "pos"]).filter(pa.array(hit))

    kind = numbers.schema["key"].dataType.simpleString()
    return numbers.select("key", "batch", "seq").mapInArrow(choose, f"key {kind}, batch bigint, seq bigint, block bigint, pos int")


def stable_sample(df: DataFrame, key: str, batch: str, *, seed: int = 42, block_size: int = 20, per_block: int = 2, stored: DataFrame | None = None) -> DataFrame:
    """(key, batch, seq, block, pos) of the chosen keys, a share of per_block / block_size."""
    return sampled(sequence_numbers(df, key, batch, stored), seed=seed, block_size=block_size, per_block=per_block)
