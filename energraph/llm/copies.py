"""Records that are the same once formatting is ignored, found with merged Bloom filters.

Each record becomes a narrow row (key, digest of its canonical form, 64-bit hash). Every input
partition builds two Bloom filters over its hashes, of those seen once and of those seen again;
merging two partitions adds to "again" what both have in "once", so no repeat is ever missed. Only
rows that hit the merged "again" filter, the possible repeats, are shuffled and grouped exactly by
the 256-bit digest; all others are single records and never move. Texts are not shuffled at all.

Filters are made of 1 MiB segments, each for a part of the hash space, ``BITS_PER_ROW`` bits a
row. The narrow rows are written by share, and ``SHARE_SEGMENTS`` segments belong to a share. The
merged filters are files in the shared folder, of which a task reads those of the share whose
rows it has at hand, 64 MiB at most; so neither the number of jobs nor what a task or the driver
holds depends on the number of rows.

Groups that hold over a thousandth of the rows, of which there are at most a thousand, get their
record by a broadcast join, so that no task receives the whole of such a group.

Defined results: a null title is an empty one; null facts agree only with null facts; facts that
are no JSON object are compared as plain text; facts given twice under one reduced name keep both;
null or symbol-only texts are never copies; a record delivered repeatedly counts once; rows
without a key are no records; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from energraph.functions.text import plain
from energraph.runtime import new_path, read_files, remove, session_of, settle, shuffle_partitions

SEGMENT_BITS, BITS_PER_ROW, HASHES, SHARE_SEGMENTS = 23, 16, 4, 64


def _numbers_as_strings(facts: Column) -> Column:
    """The JSON text with each number outside a string put in quotes, so that parsing keeps it as written."""

    def swap(c: Column, a: str, b: str) -> Column:
        return F.replace(c, F.lit(a), F.lit(b))

    clean = F.regexp_replace(facts, r"[\uE000-\uE003]", "")
    escapes = swap(swap(clean, "\\\\", "\uE002\uE002"), '\\"', "\uE002\uE003")
    tokens = F.regexp_replace(escapes, r'("[^"]*+")|(-?\d[0-9.eE+\-]*+)', "$1\uE000$2\uE001")
    quoted = F.regexp_replace(swap(tokens, "\uE000\uE001", ""), r"[\uE000\uE001]", '"')
    return swap(swap(quoted, "\uE002\uE003", '\\"'), "\uE002\uE002", "\\\\")


def facts_key(c: Column) -> Column:
    """The same for facts with the same values under the same names, in any order and look."""
    pairs = F.transform(F.map_entries(F.from_json(_numbers_as_strings(c), "map<string,string>")), lambda e: F.concat(plain(e["key"]), F.lit("="), F.coalesce(plain(e["value"]), F.lit("\u0000"))))
    listed = F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(pairs)), ","))
    return F.when(c.isNull(), "-").otherwise(F.coalesce(listed, F.concat(F.lit("?"), plain(c))))


def narrow_rows(df: DataFrame, key: str, title: str, text: str, facts: str) -> DataFrame:
    """(key, digest, h) by canonical form; a record without letters or digits is alone under its key."""
    words = plain(F.col(text))
    full = F.concat_ws("|", F.coalesce(plain(F.col(title)), F.lit("")), words, facts_key(F.col(facts)))
    alone = words.isNull() | (words == "")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.unhex(F.sha2(F.when(alone, F.concat(F.lit("#"), F.col(key).cast("string"))).otherwise(full), 256)).alias("digest"))
    return rows.withColumn("h", F.xxhash64("digest"))


class Filter:
    """Bits of some segments; ``first`` is the number of the first one."""

    def __init__(self, bits: dict[int, np.ndarray] | None = None) -> None:
        self.bits = bits or {}

    @staticmethod
    def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit within the segment, HASHES columns."""
        h = h.astype(np.uint64)
        mask = np.uint64((1 << SEGMENT_BITS) - 1)
        a, b = h & mask, (h >> np.uint64(SEGMENT_BITS)) | np.uint64(1)
        at = np.stack([(a + np.uint64(i) * b) & mask for i in range(HASHES)], axis=1)
        return (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)

    def segment(self, s: int) -> np.ndarray:
        if s not in self.bits:
            self.bits[s] = np.zeros(1 << (SEGMENT_BITS - 3), np.uint8)
        return self.bits[s]

    def has(self, s: int, h: np.ndarray) -> np.ndarray:
        if s not in self.bits:
            return np.zeros(len(h), bool)
        byte, bit = self.places(h)
        return ((self.bits[s][byte] & bit) != 0).all(axis=1)

    def add(self, s: int, h: np.ndarray) -> None:
        byte, bit = self.places(h)
        np.bitwise_or.at(self.segment(s), byte.ravel(), bit.ravel())


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h.astype(np.uint64) >> np.uint64(46)) % np.uint64(segments)).astype(np.int64)


def observe(once: Filter, again: Filter, s: int, h: np.ndarray) -> None:
    """Add the hashes of one segment: repeats within ``h`` and those in ``once`` go to ``again``."""
    h, n = np.unique(h, return_counts=True)
    seen = once.has(s, h)
    again.add(s, h[seen | (n > 1)])
    once.add(s, h[~seen])


def merge(once: np.ndarray, again: np.ndarray, other_once: np.ndarray, other_again: np.ndarray) -> None:
    """Add another partition's pair of filters to the first pair."""
    again |= other_again | (once & other_once)
    once |= other_once


_PAIRS = pa.schema([("share", pa.int32()), ("segment", pa.int64()), ("once", pa.binary()), ("again", pa.binary())])


def _packed(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def repeats_filter(rows: DataFrame, segments: int) -> DataFrame:
    """(share, segment, again): the merged "again" segments of rows (share, h)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = None, Filter(), Filter()

        def done() -> Iterator[pa.RecordBatch]:
            for s, bits in once.bits.items():
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((at, s, _packed(bits), _packed(again.segment(s))), _PAIRS)], schema=_PAIRS)

        for b in batches:
            shares, hashes = (c.to_numpy() for c in b.columns)
            for share in np.unique(shares).tolist():
                if share != at:  # rows of a share come together, file by file
                    yield from done()
                    at, once, again = share, Filter(), Filter()
                h = hashes[shares == share]
                seg = segment_of(h, segments)
                for s in np.unique(seg):
                    observe(once, again, int(s), h[seg == s])
        yield from done()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([_packed(again)], pa.binary())], names=["share", "segment", "again"])

        for b in batches:
            for row in b.to_pylist():
                pair = [_unpacked(row[k]) for k in ("once", "again")]
                if (row["share"], row["segment"]) != at:
                    yield from done()
                    at, once, again = (row["share"], row["segment"]), pair[0].copy(), pair[1].copy()
                else:
                    merge(once, again, *pair)
        yield from done()

    built = rows.select("share", "h").mapInArrow(build, "share int, segment bigint, once binary, again binary")
    return built.repartition(shuffle_partitions(session_of(rows)), "segment").sortWithinPartitions("share", "segment").mapInArrow(fold, "share int, segment bigint, again binary")


def split_repeats(rows: DataFrame, segments: int) -> DataFrame:
    """(key, digest, maybe) of rows (share, key, digest, h): ``maybe`` is true where the hash may occur more than once."""
    path = new_path(session_of(rows))
    repeats_filter(rows, segments).write.partitionBy("share").parquet(path)

    def load(share: int) -> Filter:
        table = read_files(f"{path}/share={share}", ["segment", "again"])
        return Filter(dict(zip(table.column("segment").to_pylist(), map(_unpacked, table.column("again").to_pylist()))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Filter()
        for b in batches:
            shares, h = (b.column(c).to_numpy() for c in ("share", "h"))
            hit = np.zeros(len(h), bool)
            for share in np.unique(shares).tolist():
                if share != at:
                    at, held = share, load(share)
                mine = shares == share
                seg = segment_of(h, segments)
                for s in np.unique(seg[mine]):
                    own = mine & (seg == s)
                    hit[own] = held.has(int(s), h[own])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("digest"), pa.array(hit)], names=["key", "digest", "maybe"])

    key = rows.schema["key"].dataType.simpleString()
    split = settle(rows.select("share", "key", "digest", "h").mapInArrow(probe, f"key {key}, digest binary, maybe boolean"))
    remove(session_of(rows), path)
    return split


def segments_for(n: int) -> int:
    """A power of two that gives each of n rows its bits."""
    segments = 1
    while segments << SEGMENT_BITS < n * BITS_PER_ROW:
        segments *= 2
    return segments


def copies(df: DataFrame, key: str, title: str, text: str, facts: str) -> DataFrame:
    """(keep, key, copies): one row per record with the smallest key of its set of copies and the set's size."""
    segments = segments_for(df.count())
    shares = max(1, segments // SHARE_SEGMENTS)
    share = F.pmod(F.shiftrightunsigned("h", 46), F.lit(shares)).cast("int")
    rows = settle(narrow_rows(df, key, title, text, facts).withColumn("share", share), partition_by="share")
    split = split_repeats(rows, segments)
    members = settle(split.where("maybe").select("digest", "key").distinct())
    groups = members.groupBy("digest").agg(F.min("key").alias("keep"), F.count("*").alias("copies"))
    hot = settle(groups.where(F.col("copies") > F.lit(members.count() // 1000 + 1)))
    many = members.join(F.broadcast(hot), "digest")
    few = members.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest")
    single = split.where(~F.col("maybe")).select(F.col("key").alias("keep"), "key", F.lit(1).cast("bigint").alias("copies"))
    return single.unionByName(many.select("keep", "key", "copies")).unionByName(few.select("keep", "key", "copies"))
