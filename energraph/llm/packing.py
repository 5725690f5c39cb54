"""Fixed-capacity containers filled with token-counted texts, shortest pack first.

A text's length is its number of tokens. A text longer than the capacity is cut into full pieces
and a remainder; nothing else is cut. The histogram of piece lengths, at most ``capacity`` rows
however large the corpus, goes to the driver, where lengths are placed longest first, each into
the emptiest packs that still take it, by changing the counts of packing patterns and never
single packs. Pieces are then ranked within their length (range-partitioned sort, a local rank
and one offset per partition and length), and a rank names its pattern, container and place.

Defined results: null and tokenless texts get a row without container; equal rows are packed as
separate items; ties go by key and piece; the result is the same in every rerun; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from energraph.runtime import session_of, settle, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts with the vocabulary file at ``path``, chosen by its ending."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"unknown kind of tokenizer: {path}")


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, n_tokens), 0 for null texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            texts = b.column(1).to_pylist()
            full = [i for i, t in enumerate(texts) if t]
            for lo in range(0, len(full), 256):
                part = full[lo : lo + 256]
                n[part] = counter([texts[i] for i in part])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(count, f"key {kind}, n_tokens bigint")


Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(count, pattern) of packs that hold every length as often as the histogram says."""
    room: dict[int, dict[Pattern, int]] = defaultdict(dict)  # by space left
    full: dict[Pattern, int] = defaultdict(int)

    def store(left: int, pattern: Pattern, n: int) -> None:
        at = room[left] if left else full
        at[pattern] = at.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n and room and (left := max(room)) >= length:
            pattern, packs = room[left].popitem()
            used = min(n, packs)
            if packs > used:
                room[left][pattern] = packs - used
            if not room[left]:
                del room[left]
            last = pattern[-1]
            grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            store(left - length, grown, used)
            n -= used
        each = capacity // length
        packs, rest = divmod(n, each)
        for count, times in ((packs, each), (1, rest)):
            if count and times:
                store(capacity - length * times, ((length, times),), count)
    return sorted(((n, p) for at in (full, *room.values()) for p, n in at.items()), key=lambda x: x[1], reverse=True)


def slots(patterns: list[tuple[int, Pattern]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, first container, times, first offset), sorted by length and rank."""
    rows, container = [], 0
    used: dict[int, int] = defaultdict(int)
    for n, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, used[length], container, times, offset))
            used[length] += n * times
            offset += length * times
        container += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "container", "times", "offset"), table.T))


def ranked_pieces(pieces: DataFrame) -> DataFrame:
    """Adds part, n_before: the range partition and the earlier rows of the same length in it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column("length").to_numpy()
            starts = np.append(0, np.flatnonzero(np.diff(length)) + 1)
            before = np.arange(len(length)) - np.repeat(starts, np.diff(np.append(starts, len(length))))
            if length[0] == at:
                first = starts[1] if len(starts) > 1 else len(length)
                before[:first] += seen
            at, seen = length[-1], int(before[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(before)], names=[*b.schema.names, "part", "n_before"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartitionByRange("length", "key", "piece").sortWithinPartitions("length", "key", "piece").mapInArrow(number, f"{fields}, part int, n_before bigint")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, piece, token_start, n_tokens, container, container_offset)."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counted = token_counts(df, key, text, tokenizer)
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("bigint")
    cut = counted.select("key", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = cut.select("key", "piece", (F.col("piece") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("length"))
    ranked = settle(ranked_pieces(settle(pieces)))
    sizes = sorted((r[1], r[0], r[2]) for r in ranked.groupBy("part", "length").count().toLocalIterator())  # a row per part, and per length
    histogram: dict[int, int] = defaultdict(int)
    offsets = []
    for length, part, n in sizes:
        offsets.append((part, length, histogram[length]))
        histogram[length] += n
    spark = session_of(df)
    table = spark.sparkContext.broadcast(slots(pack_histogram({k: n for k, n in histogram.items() if k}, capacity)))
    earlier = spark.createDataFrame(offsets, "part int, length bigint, earlier bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            none = length == 0
            lo, hi = np.searchsorted(t["length"], length, "left"), np.searchsorted(t["length"], length, "right")
            while np.any(hi - lo > 1):  # the last slot of the length that starts at or before the rank
                mid = (lo + hi) // 2
                up = t["rank"][np.minimum(mid, len(t["rank"]) - 1)] <= rank
                lo, hi = np.where(up & (hi - lo > 1), mid, lo), np.where(~up & (hi - lo > 1), mid, hi)
            if len(t["rank"]):
                at = np.minimum(lo, len(t["rank"]) - 1)
                step = rank - t["rank"][at]
                container, offset = t["container"][at] + step // t["times"][at], t["offset"][at] + step % t["times"][at] * length
            else:
                container = offset = np.zeros(len(length), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("piece"), b.column("token_start"), b.column("length"), pa.array(container, mask=none), pa.array(offset, mask=none)], names=["key", "piece", "token_start", "n_tokens", "container", "container_offset"])

    kind = df.schema[key].dataType.simpleString()
    placed = ranked.join(F.broadcast(earlier), ["part", "length"]).select("key", "piece", "token_start", "length", (F.col("earlier") + F.col("n_before")).alias("rank"))
    return placed.mapInArrow(place, f"key {kind}, piece bigint, token_start bigint, n_tokens bigint, container bigint, container_offset bigint")
