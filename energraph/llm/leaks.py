"""Held-out texts inside a corpus: prefix-filtered join on character shingles.

Both sides are reduced to letters and digits in lower case. An item leaks into a document if they
share a run of ``run`` such characters, and then the document holds every ``q``-character shingle
of some ``run``-wide window of the item. So it is enough to look for one shingle of each window:

1. A quarter of the item shingles, chosen by their hash, are the candidates; a window without any
   gives its smallest hash. A first pass over all documents counts in how many pieces of text each
   candidate occurs, and each window takes its rarest candidate as prefix token.
2. A second pass finds the prefix tokens in the documents. Each hit leaves with the characters
   around it, as many as any run through it can need, and is joined with the places where items
   hold the token. A pair goes on only if the text on both sides is long enough for a run, and is
   then verified character by character.

Only hashes are sent to the tasks: of the candidates in the first pass and of the prefix tokens,
about a twentieth of the item characters, in the second; the join takes the items' texts, by
broadcast while they are few. So a set of items of up to ``BLOCK_CHARS`` characters costs the same
two passes and the same number of jobs, at 3 bytes a character and task (400 MB at most); only a
larger set is handled in blocks of that size. Documents of any length are cut into overlapping
pieces of ``PIECE`` characters, of which a task holds ``STEP`` characters at once.

Defined results: null and blank texts share nothing; items with less than ``run`` characters
cannot leak; equal rows give one result row; empty tables give an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from energraph.functions.text import plain
from energraph.runtime import session_of, settle, spread

BLOCK_CHARS, PIECE, STEP = 1 << 27, 1 << 20, 1 << 21
#: Bits of the filter per candidate, the candidates' share as a mask on the hash, places that are broadcast at most (380 bytes each).
FILTER_BITS, CANDIDATE_MASK, BROADCAST_PLACES, COUNTED = 16, 3, 100_000, 1 << 22
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingle_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of the q characters from each position, by doubling."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width = chars.astype(np.uint64) * _BASE, 1
    factor, done, out, out_width = _BASE, 0, None, 0
    rest = q
    while rest:
        if rest & 1:
            if out is None:
                out, out_width = power, width
            else:
                m = min(len(out), len(power) - out_width)
                out, out_width = out[:m] * factor + power[out_width : out_width + m], out_width + width
        rest >>= 1
        if rest:
            power = power[:-width] * factor + power[width:]
            factor, width = factor * factor, width * 2
    out = out[:n]
    return out ^ (out >> np.uint64(29))


class Tokens:
    """Sorted distinct hashes with a bitmap in front that turns away most others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.bits = max(20, int(np.ceil(np.log2(max(1, len(hashes)) * FILTER_BITS))))
        self.bitmap = np.zeros(1 << (self.bits - 3), np.uint8)
        byte, bit = self._place(hashes)
        np.bitwise_or.at(self.bitmap, byte, bit)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = h & np.uint64((1 << self.bits) - 1)
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a token, and the number of that token."""
        byte, bit = self._place(h)
        at = np.flatnonzero(self.bitmap[byte] & bit)
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at]
        return at[same], k[same]


def candidates(hashes: np.ndarray, span: int) -> np.ndarray:
    """Which shingles of an item are candidates: at least one in each ``span`` in a row."""
    chosen = (hashes >> np.uint64(11)) & np.uint64(CANDIDATE_MASK) == 0
    if len(hashes) < span:
        return chosen
    some = np.cumsum(np.append(0, chosen))
    for w in np.flatnonzero(some[span:] == some[:-span]):  # few: a window without any
        chosen[w + hashes[w : w + span].argmin()] = True
    return chosen


def prefixes(hashes: np.ndarray, rarity: np.ndarray, span: int) -> np.ndarray:
    """Places of the rarest candidate of each window, ties to the first."""
    windows = np.lib.stride_tricks.sliding_window_view(np.where(candidates(hashes, span), rarity, np.iinfo(np.int64).max), span)
    return np.unique(np.arange(len(windows)) + windows.argmin(axis=1))


def surroundings(chars: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, run: int, q: int) -> np.ndarray:
    """The run - q characters before each place and the run from it on; 0 beyond its text."""
    place = at[:, None] + np.arange(q - run, run)
    inside = (place >= low[:, None]) & (place < high[:, None])
    return np.where(inside, chars[np.clip(place, 0, len(chars) - 1)], 0).astype(np.uint32)


def common_run(a: np.ndarray, b: np.ndarray, run: int, q: int) -> np.ndarray:
    """Length of the common run through the place, 0 where not even the shingle agrees."""
    same = (a == b) & (a != 0)
    left, right = same[:, : run - q][:, ::-1], same[:, run - q :]
    before = np.where(left.all(axis=1), run - q, left.argmin(axis=1)) if run > q else np.zeros(len(a), np.int64)
    after = np.where(right.all(axis=1), run, right.argmin(axis=1))
    return np.where(after >= q, before + after, 0)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    ends = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(np.ascontiguousarray(rows))])


def _pieces(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(documents' ids, ends, characters) of pieces side by side; a run lies within one of them."""
    ids: list = []
    parts: list[np.ndarray] = []
    size = 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            chars = code_points(text)
            for at in range(0, max(1, len(chars) - run + 1), PIECE - run + 1):
                ids.append(i)
                parts.append(chars[at : at + PIECE])
                size += len(parts[-1])
                if size >= STEP:
                    yield ids, np.cumsum([len(p) for p in parts]), np.concatenate(parts)
                    ids, parts, size = [], [], 0
    if ids:
        yield ids, np.cumsum([len(p) for p in parts]), np.concatenate(parts)


def _found(tokens: Tokens, ends: np.ndarray, chars: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, token, piece) of the tokens that lie within one piece."""
    at, k = tokens.find(shingle_hashes(chars, q))
    piece = np.searchsorted(ends, at, "right")
    keep = at + q <= ends[np.minimum(piece, len(ends) - 1)]
    return at[keep], k[keep], piece[keep]


def _block_leaks(docs: DataFrame, items: DataFrame, run: int, q: int) -> DataFrame:
    sc, span = session_of(docs).sparkContext, run - q + 1

    def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [h[candidates(h, span)] for h in (shingle_hashes(code_points(t), q) for t in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], names=["token"])

    hashes = items.mapInArrow(offered, "token bigint").distinct().toArrow().column(0).to_numpy()  # at most a quarter of BLOCK_CHARS
    hashes = np.sort(hashes.view(np.uint64))
    offers = sc.broadcast(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(offers.value), [], 0

        def summed() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "df"])

        for _, ends, chars in _pieces(batches, run):
            _, k, piece = _found(tokens, ends, chars, q)
            n = max(1, len(tokens.hashes))
            held.append(np.unique(piece * np.int64(n) + k) % n)
            size += len(held[-1])
            if size >= COUNTED:
                yield summed()
                held, size = [], 0
        yield summed()

    df = np.zeros(len(hashes), np.int64)
    seen = docs.mapInArrow(count, "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df")).toArrow()  # a row per candidate
    df[seen.column("token").to_numpy()] = seen.column("df").to_numpy()
    counted = sc.broadcast(np.minimum(df, (1 << 32) - 1).astype(np.uint32))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rare = offers.value, counted.value
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                chars = code_points(text)
                h = shingle_hashes(chars, q)
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                at = prefixes(h, rare[k].astype(np.int64), span)
                around = surroundings(chars, at, np.zeros(len(at), np.int64), np.full(len(at), len(chars)), run, q)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.full(len(at), item)), _binary(around)], names=["token", "item_id", "said"])

    places = settle(items.mapInArrow(choose, "token bigint, item_id bigint, said binary"))
    prefix = sc.broadcast(np.sort(places.select("token").distinct().toArrow().column(0).to_numpy().view(np.uint64)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(prefix.value)
        for ids, ends, chars in _pieces(batches, run):
            at, k, piece = _found(tokens, ends, chars, q)
            begins, names = np.append(0, ends[:-1]), np.array(ids, np.int64)
            for lo in range(0, len(at), 1 << 13):
                cut = slice(lo, lo + (1 << 13))
                p = piece[cut]
                around = surroundings(chars, at[cut], begins[p], ends[p], run, q)
                room = (around != 0).sum(axis=1) >= run
                yield pa.RecordBatch.from_arrays([pa.array(tokens.hashes[k[cut]][room].view(np.int64)), pa.array(names[p][room]), _binary(around[room])], names=["token", "doc_id", "seen"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * run - q
        for b in batches:
            if b.num_rows:
                said, seen = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, width) for c in ("said", "seen"))
                good = pa.array(common_run(said, seen, run, q) >= run)
                yield pa.RecordBatch.from_arrays([b.column(c).filter(good) for c in ("doc_id", "item_id")], names=["doc_id", "item_id"])

    few = places.count() <= BROADCAST_PLACES
    hits = docs.mapInArrow(match, "token bigint, doc_id bigint, seen binary")
    pairs = hits.join(F.broadcast(places) if few else places, "token").select("doc_id", "item_id", "said", "seen")
    return pairs.mapInArrow(verify, "doc_id bigint, item_id bigint")


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 60, q: int = 24) -> DataFrame:
    """Distinct (doc_id, item_id) that share a run of at least ``run`` letters and digits."""
    if not 0 < q <= run:
        raise ValueError("q must be in (0, run]")
    long_enough = F.char_length("words") >= run
    corpus = spread(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))).select("id", plain(F.col("text")).alias("words")).where(F.col("id").isNotNull() & long_enough)
    wanted = settle(items.select(F.col(item_id).cast("bigint").alias("id"), plain(F.col(text)).alias("words")).where(F.col("id").isNotNull() & long_enough).distinct())
    chars = wanted.agg(F.sum(F.char_length("words"))).first()[0] or 0
    if not chars:
        return session_of(docs).createDataFrame([], "doc_id bigint, item_id bigint")
    blocks = -(-chars // BLOCK_CHARS)
    out = None
    for block in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == block)
        found = _block_leaks(corpus, part, run, q)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
