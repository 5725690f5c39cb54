"""References to rows that do not exist: range-partitioned binary search.

The parents (key, lifetime) are range-partitioned by key and stored as one row of sorted arrays
per range. References are tagged with the range their key falls into, spread over as many slots
as the range's references need (a hot key gets many slots, each with a copy of that one range),
and every slot probes its references in one vectorised binary search. Only misses leave the probe.

The lower keys of the ranges are the only thing the driver holds; their number is bounded by
``MAX_RANGES``, since ranges get longer as parents get more.

Defined results: a null or empty reference is none; the same reference of the same row counts
once; a parent without a key is no parent, without a begin it has always lived, without an end it
still lives, and with an end before its begin it never lived. A reference without a time has a
null month and resolves if the key exists at all. Empty tables give empty results (no parents:
every reference is missing). Further columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from energraph.runtime import session_of, settle

#: Parents of a range and references of a slot, which bound what a task holds at once.
RANGE_ROWS, SLOT_ROWS, MAX_RANGES = 1 << 15, 1 << 17, 1 << 17

_RANGES = pa.schema([("first_key", pa.string()), ("keys", pa.list_(pa.string())), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("scoped", pa.list_(pa.bool_()))])
_FIRST, _NEVER = -(1 << 62), 1 << 62


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def parent_ranges(parents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Sorted arrays per key range of distinct (key, begins, ends, scoped) rows.

    A key's rows never straddle two ranges.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row(t: pa.Table) -> pa.RecordBatch:
            lists = [pa.array([c.combine_chunks().to_pylist()], f.type) for c, f in zip(t.columns, list(_RANGES)[1:])]
            return pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()]), *lists], schema=_RANGES)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) > range_rows:
                t = pa.Table.from_batches(held)
                keys = t.column(0).combine_chunks().slice(0, range_rows + 1).to_pylist()
                cut = range_rows
                while cut and keys[cut] == keys[cut - 1]:
                    cut -= 1
                if not cut:  # one key fills the range: it ends with that key
                    alls = t.column(0).to_pylist()
                    cut = next((i for i in range(range_rows, len(alls)) if alls[i] != alls[0]), 0)
                    if not cut:
                        break
                yield row(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield row(t)

    ordered = parents.repartitionByRange("key").sortWithinPartitions("key", "begins")
    return ordered.mapInArrow(store, "first_key string, keys array<string>, begins array<bigint>, ends array<bigint>, scoped array<boolean>")


def _last_begun(keys: np.ndarray, begins: np.ndarray, ends: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each wanted key and time: is the key there, had a row of it begun, does one live.

    ``keys`` ascend, and ``begins`` ascend within a key.
    """
    if not len(keys):
        no = np.zeros(len(wanted), bool)
        return no, no, no
    low = np.searchsorted(keys, wanted, "left")
    high = np.searchsorted(keys, wanted, "right")
    there = high > low
    starts = np.append(True, keys[1:] != keys[:-1])
    # the latest end among the rows of a key up to each row, by doubling steps
    group = np.cumsum(starts)
    until, step = ends.copy(), 1
    while step < len(keys) and np.any(same := group[step:] == group[:-step]):
        until[step:] = np.where(same, np.maximum(until[step:], until[:-step]), until[step:])
        step *= 2
    lo, hi = low.copy(), high.copy()
    while np.any(open_ := lo < hi):
        mid = np.minimum((lo + hi) // 2, len(keys) - 1)
        up = open_ & (begins[mid] <= at)
        lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    begun = lo > low
    return there, begun, begun & (until[np.maximum(lo - 1, 0)] > at)


def _probe(parents: pa.Table, refs: pa.Table) -> pa.Table:
    n = refs.num_rows
    wanted = np.array(refs.column("target_id").to_pylist(), object)
    when = refs.column("at").combine_chunks()
    timeless = when.is_null().to_numpy(zero_copy_only=False)
    at = when.fill_null(_NEVER - 1).to_numpy()
    narrow = refs.column("scoped").to_numpy()
    if parents.num_rows:
        held = [parents.column(c)[0].values for c in ("keys", "begins", "ends", "scoped")]
        keys = np.array(held[0].to_pylist(), object)
        begins, ends = held[1].to_numpy(), held[2].to_numpy()
        mine = held[3].to_numpy(zero_copy_only=False)
    else:
        keys, begins, ends, mine = np.array([], object), np.array([], np.int64), np.array([], np.int64), np.array([], bool)
    there, begun, lives = (np.zeros(n, bool) for _ in range(3))
    for scope, part in ((False, np.ones(len(keys), bool)), (True, mine)):
        rows = np.flatnonzero(narrow == scope)
        if len(rows):
            there[rows], begun[rows], lives[rows] = _last_begun(keys[part], begins[part], ends[part], wanted[rows], at[rows])
    kind = np.where(~there, "missing", np.where(begun, "deleted", "late"))
    lives |= timeless & there
    out = refs.select(["ref_table", "ref_field", "ref_id", "target_id", "at"]).append_column("kind", pa.array(kind, pa.string()))
    return out.filter(pa.array(~lives))


def orphans(refs: DataFrame, parents: DataFrame, *, range_rows: int = RANGE_ROWS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Distinct (ref_table, ref_field, ref_id, target_id, ref_month, kind) of references without a living parent.

    refs: (ref_table, ref_field, ref_id, target_id, at timestamp, scoped boolean); parents: (key,
    begins timestamp, ends timestamp, scoped boolean). A scoped reference sees scoped parents
    only. ``kind`` is ``missing`` without a parent of that key, ``late`` if the first one began
    after the reference, else ``deleted``.
    """
    spark = session_of(refs)
    own = parents.where(F.col("key").isNotNull()).select("key", F.coalesce(_micros(F.col("begins")), F.lit(_FIRST)).alias("begins"), F.coalesce(_micros(F.col("ends")), F.lit(_NEVER)).alias("ends"), F.coalesce("scoped", F.lit(False)).alias("scoped")).distinct()
    ranges = settle(parent_ranges(own, range_rows))
    first = sorted(r[0] for r in ranges.select("first_key").toLocalIterator())
    if len(first) > MAX_RANGES:
        return orphans(refs, parents, range_rows=range_rows * 4, slot_rows=slot_rows)
    lows = spark.sparkContext.broadcast(np.array(first or [""], object))
    ref = refs.where(F.col("target_id").isNotNull() & (F.col("target_id") != "")).select("ref_table", "ref_field", F.col("ref_id").cast("string").alias("ref_id"), "target_id", _micros(F.col("at")).alias("at"), F.coalesce("scoped", F.lit(False)).alias("scoped"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = np.array(b.column("target_id").to_pylist(), object)
            at = np.maximum(np.searchsorted(lows.value, wanted, "right") - 1, 0) if len(wanted) else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "range_no"])

    # A range's references are counted first, so that hot ranges get more slots.
    tagged = ref.mapInArrow(locate, "ref_table string, ref_field string, ref_id string, target_id string, at bigint, scoped boolean, range_no int")
    counts = ref.select("target_id").mapInArrow(locate, "target_id string, range_no int").groupBy("range_no").count()
    width = {r[0]: -(-r[1] // slot_rows) for r in counts.toLocalIterator()}
    n_ranges = max(1, len(first))
    widths = np.array([width.get(i, 1) for i in range(n_ranges)])
    base = np.append(0, np.cumsum(widths))
    layout = F.broadcast(spark.createDataFrame([(i, int(base[i]), int(widths[i])) for i in range(n_ranges)], "range_no int, base long, width long"))
    numbered = spark.createDataFrame([(k, i) for i, k in enumerate(first)], "first_key string, range_no int")
    slots = tagged.join(layout, "range_no").withColumn("slot", F.col("base") + F.pmod(F.xxhash64("ref_id", "target_id"), F.col("width"))).drop("base", "width", "range_no")
    copies = ranges.join(F.broadcast(numbered), "first_key").join(layout, "range_no").withColumn("slot", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("width") - 1))).select("slot", "keys", "begins", "ends", "scoped")
    misses = copies.groupBy("slot").cogroup(slots.groupBy("slot")).applyInArrow(lambda l, r: _probe(l, r), "ref_table string, ref_field string, ref_id string, target_id string, at bigint, kind string")
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return misses.select("ref_table", "ref_field", "ref_id", "target_id", month.alias("ref_month"), "kind").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """References without a parent by table, field, month and kind."""
    return found.groupBy("ref_table", "ref_field", "ref_month", "kind").agg(F.count("*").alias("n_refs"), F.countDistinct("target_id").alias("n_targets"))
