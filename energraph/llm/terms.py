"""Frequency of every distinct term: range-partitioned external sort and run-length scan.

``term_frequencies`` explodes each record into (term, record, delivery) rows, sorts them by range
partitions of (term, record) and scans the runs. The record is part of the range key, so a term
that holds a third of all rows is spread over as many ranges as it needs; each range reports one
partial count per term, and the partial counts add up because no (term, record) pair straddles
two ranges. The number of records is counted in the same sort, as the runs of the empty term.

Defined results: a null or empty array contributes a record but no term; null and blank elements
are no terms; a record delivered repeatedly counts once, with the most mentions of one delivery;
rows without a record id are no records; an empty table gives an empty result. Further columns
of the table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from energraph.runtime import settle

#: Fixed value: every character that counts as whitespace, the four ASCII separators included.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"

_RUNS = pa.schema([("term", pa.string()), ("mentions", pa.int64()), ("df", pa.int64())])


def normal_term(c: Column) -> Column:
    """Each run of whitespace one space, ends trimmed, lower case."""
    return F.trim(F.lower(F.regexp_replace(c, WHITESPACE, " ")))


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one above it."""
    first = np.array([before is None or column[0].as_py() != before.as_py()])
    if len(column) == 1:
        return first
    return np.concatenate([first, pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of sorted (term, record, delivery) rows.

    A batch yields the sums over the pairs that end in it; only the open pair is carried on.
    """
    last: list[pa.Scalar] | None = None
    run = best = 0  # rows of the open delivery, most rows of one delivery of the open pair
    for batch in batches:
        if not batch.num_rows:
            continue
        term, record, delivery = batch.columns
        new_term = _changes(term, last and last[0])
        new_pair = new_term | _changes(record, last and last[1])
        starts = np.flatnonzero(new_pair | _changes(delivery, last and last[2]))
        run += int(starts[0]) if len(starts) else batch.num_rows
        if len(starts):
            lengths = np.diff(np.append(starts, batch.num_rows))
            opens = np.append(True, new_pair[starts])  # the carried pair comes first
            lengths = np.append(max(best, run), lengths)
            if last is None:
                opens, lengths = opens[1:], lengths[1:]
            pairs = np.flatnonzero(opens)
            most = np.maximum.reduceat(lengths, pairs)
            rows = starts[new_pair[starts]]
            names = term.take(pa.array(rows))
            heads = new_term[rows]
            if last is not None:
                names = pa.concat_arrays([pa.array([last[0].as_py()], term.type), names])
                heads = np.append(True, heads)
            heads = np.flatnonzero(heads[:-1])
            if len(heads):
                counts = np.diff(np.append(heads, len(most) - 1))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(heads)), pa.array(np.add.reduceat(most[:-1], heads)), pa.array(counts)], schema=_RUNS)
            run, best = int(lengths[-1]), int(most[-1])
        last = [term[-1], record[-1], delivery[-1]]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0].as_py()]), pa.array([max(best, run)]), pa.array([1])], schema=_RUNS)


def term_counts(df: DataFrame, record: str, terms: str) -> DataFrame:
    """(term, mentions, df) of every term; the empty term's df is the number of records."""
    clean = F.filter(F.transform(F.coalesce(F.col(terms), F.array().cast("array<string>")), normal_term), lambda x: x.isNotNull() & (x != ""))
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.monotonically_increasing_id().alias("delivery"), F.concat(clean, F.array(F.lit(""))).alias("all_terms"))
    pairs = rows.select(F.explode("all_terms").alias("term"), "record", "delivery")
    ordered = pairs.repartitionByRange("term", "record").sortWithinPartitions("term", "record", "delivery")
    parts = ordered.mapInArrow(_scan, "term string, mentions bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("mentions").alias("mentions"), F.sum("df").alias("df"))


def term_frequencies(df: DataFrame, record: str, terms: str, *, min_df: int = 2, max_df_ratio: float = 0.02) -> DataFrame:
    """(term, mentions, df, records, mark): ``mark`` is ``rare`` if df < min_df, else ``common`` if
    df > max_df_ratio * records, else null."""
    if min_df < 0 or not 0 < max_df_ratio <= 1:
        raise ValueError("min_df must not be negative, max_df_ratio must be in (0, 1]")
    counts = settle(term_counts(df, record, terms))
    total = counts.where(F.col("term") == "").select("df").first()
    n = total[0] if total else 0
    mark = F.when(F.col("df") < min_df, "rare").when(F.col("df") > F.lit(max_df_ratio) * n, "common")
    return counts.where(F.col("term") != "").select("term", "mentions", "df", F.lit(n).cast("bigint").alias("records"), mark.alias("mark"))
