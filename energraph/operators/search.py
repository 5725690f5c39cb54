"""Exact vector search, and search by text.

Few queries are broadcast and every vector stays where it is; many are cut into blocks, each of
which reads the vectors' files. The size of the queries decides, measured before anything is planned.
"""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from energraph.config import need
from energraph.functions.text import casefold, snippet
from energraph.runtime import new_path, read_batches, read_settled, session_of, spread

#: Rows of a block of queries, of a batch of vectors that is read, of queries and vectors compared at once, and of the first vectors.
BLOCK_ROWS, FILE_ROWS, QUERY_ROWS, VECTOR_ROWS, FIRST_ROWS = 8192, 8192, 512, 4096, 512
#: Queries of at most so many numbers (16 MB) are broadcast.
BROADCAST_NUMBERS = 1 << 21
METRICS = ("inner", "cosine")


def dot(a: str, b: str):
    """Inner product in double precision, in the JVM."""
    both = F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: str):
    return F.sqrt(dot(a, a))


def _matrix(column, unit: bool) -> np.ndarray:
    """Vectors as rows of one matrix; they must have one length."""
    parts = [c for c in column.chunks if len(c)] if isinstance(column, pa.ChunkedArray) else [column]
    if any(c.null_count or c.flatten().null_count for c in parts):
        raise ValueError("a vector has a missing number")
    sizes = {int(n) for c in parts for n in np.unique(np.diff(c.offsets.to_numpy()))}
    if len(sizes) > 1:
        raise ValueError("vectors must have one dimension")
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in parts]).astype(np.float64).reshape(-1, sizes.pop())
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if unit else x


class _Best:
    """The k best vectors of each query among the blocks of vectors met so far.

    A block is compared in single precision first. What may reach the k-th best so far, given the
    largest error that this can have, is computed again in double precision, and only that is sorted.
    """

    def __init__(self, a: np.ndarray, qids: np.ndarray, k: int, skip_self: bool) -> None:
        self.a, self.qids, self.k, self.skip_self = a, qids, k, skip_self
        self.norms = np.linalg.norm(a, axis=1)
        self.short = a.astype(np.float32) if self._tame(self.norms) else None
        self.floor = np.full(len(a), -np.inf)
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self.waiting, self.n_waiting = [], 0

    @staticmethod
    def _tame(norms: np.ndarray) -> bool:
        """Whether single precision neither overflows nor loses small numbers."""
        some = norms[norms > 0]
        return bool(np.isfinite(norms).all() and (not len(some) or (some.min() > 1e-9 and some.max() < 1e9)))

    def add(self, b: np.ndarray, ids: pa.Array) -> None:
        for lo, hi in ((0, FIRST_ROWS), *((x, x + VECTOR_ROWS) for x in range(FIRST_ROWS, len(b), VECTOR_ROWS))) if np.isneginf(self.floor).any() else ((x, x + VECTOR_ROWS) for x in range(0, len(b), VECTOR_ROWS)):
            self._add(b[lo:hi], ids[lo:hi])

    def _add(self, b: np.ndarray, ids: pa.Array) -> None:
        norms = np.linalg.norm(b, axis=1)
        fast = self.short is not None and self._tame(norms)
        n, left = len(b), self.short if fast else self.a
        slack = (4 + b.shape[1]) * (1.2e-7 if fast else 4.5e-16) * self.norms * norms.max(initial=0.0)
        wide = -(-n // 8) * 8  # a row of marks is read by words
        right = np.zeros((wide, b.shape[1]), left.dtype)
        right[:n] = b
        take, found = min(self.k + self.skip_self, n), []
        for lo in range(0, len(left), QUERY_ROWS):
            sims = left[lo : lo + QUERY_ROWS] @ right.T
            floor = self.floor[lo : lo + QUERY_ROWS] - slack[lo : lo + QUERY_ROWS]
            if open_ := np.flatnonzero(np.isneginf(floor)).tolist():
                least = -np.partition(-sims[open_, :n], take - 1, axis=1)[:, take - 1]
                floor[open_] = least - 2 * slack[lo : lo + QUERY_ROWS][open_]
            # rounded down, so that nothing at the floor is lost
            marks = sims >= np.nextafter(floor.astype(sims.dtype), np.array(-np.inf, sims.dtype))[:, None]
            words = np.flatnonzero(marks.reshape(-1).view(np.uint64))
            at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
            at = at[marks.reshape(-1)[at]]
            r, c = np.divmod(at, wide)
            found.append((lo + r[c < n], c[c < n]))
        r, c = (np.concatenate(x) for x in zip(*found))
        if not len(r):
            return
        names = np.array(ids.take(pa.array(c)).to_pylist(), object)
        if self.skip_self:
            other = self.qids[r] != names
            r, c, names = r[other], c[other], names[other]
        s = np.concatenate([np.zeros(0), *(np.einsum("bd,bd->b", self.a[r[x : x + 65536]], b[c[x : x + 65536]]) for x in range(0, len(r), 65536))])  # the same sum whatever the block
        near = s >= self.floor[r]
        r, names, s = r[near], names[near], s[near]
        self.waiting.append((r, names, s))
        self.n_waiting += len(r)
        if self.n_waiting * 2 >= self.k * len(self.a) or np.isneginf(self.floor).any():
            self.merge()

    def merge(self) -> None:
        """Put what waits to the best so far. Equal scores are rare, so names are compared for them alone."""
        r, names, s = (np.concatenate(x) for x in zip((self.rows, self.ids, self.scores), *self.waiting))
        self.waiting, self.n_waiting = [], 0
        by = np.lexsort((-s, r))
        r, names, s = r[by], names[by], s[by]
        tie = (r[1:] == r[:-1]) & (s[1:] == s[:-1])
        if tie.any():
            some = np.flatnonzero(np.r_[tie, False] | np.r_[False, tie])
            group = np.cumsum(np.r_[True, ~tie])[some]
            names[some] = names[some][np.lexsort((names[some].astype(str), group))]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        full = place == self.k - 1
        self.floor[r[full]] = s[full]
        keep = place < self.k
        self.rows, self.ids, self.scores = r[keep], names[keep], s[keep]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array(self.qids[self.rows].tolist(), kind), pa.array(self.ids.tolist(), pa.string()), pa.array(self.scores)], names=["qid", "node", "score"])


def _by_broadcast(queries: DataFrame, vectors: DataFrame, k: int, skip_self: bool, unit: bool, kind: str) -> DataFrame:
    """Each task holds all queries and the k best that its vectors had so far for each of them."""
    asked = queries.toArrow()  # bounded by BROADCAST_NUMBERS
    names, qtype = asked.column("qid").to_pylist(), asked.schema.field("qid").type
    shared = session_of(vectors).sparkContext.broadcast((np.array(names, object), _matrix(asked.column("embedding"), unit) if names else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, a = shared.value
        if a is None:
            return
        best = _Best(a, qids, k, skip_self)
        for b in batches:
            if b.num_rows:
                best.add(_matrix(b.column(1), unit), b.column(0))
        yield best.batch(qtype)

    return spread(vectors).mapInArrow(run, f"qid {kind}, node string, score double")


#: The files of vectors that were searched by many queries, as long as those vectors are in use.
_stored: WeakKeyDictionary = WeakKeyDictionary()


def _files(vectors: DataFrame, usable: DataFrame, unit: bool) -> tuple[str, DataFrame]:
    """The folder of the vectors' files and the table that keeps it; written once for the same vectors."""
    known = _stored.setdefault(vectors, {})
    if unit not in known:
        path = new_path(session_of(vectors))
        usable.write.parquet(path)
        known[unit] = path, read_settled(session_of(vectors), path, usable.schema)
    return known[unit]


def _by_files(queries: DataFrame, rows: int, vectors: DataFrame, usable: DataFrame, k: int, skip_self: bool, unit: bool, kind: str) -> DataFrame:
    """Each task holds a block of queries and reads the vectors' files: neither a vector nor a partial list is shuffled."""
    path, stored = _files(vectors, usable, unit)
    size, cores = BLOCK_ROWS, session_of(vectors).sparkContext.defaultParallelism
    blocks = max(-(-rows // size), min(2 * cores, -(-rows // QUERY_ROWS)))
    none = stored.where(F.lit(False)).select(F.lit(None).cast(kind).alias("qid"), F.col("embedding").cast(queries.schema["embedding"].dataType).alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            asked = pa.Table.from_batches(part)
            best = _Best(_matrix(asked.column("embedding"), unit), np.array(asked.column("qid").to_pylist(), object), k, skip_self)
            for b in read_batches(path, ["id", "embedding"], FILE_ROWS):
                best.add(_matrix(b.column(1), unit), b.column(0))
            return best.batch(asked.schema.field("qid").type)

        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, size):
                held.append(b.slice(lo, size))
                n += held[-1].num_rows
                if n >= size:
                    yield answers(held)
                    held, n = [], 0
        if n:
            yield answers(held)

    # the empty part keeps the files as long as this plan is in use
    return queries.unionByName(none).repartition(blocks, "qid").mapInArrow(run, f"qid {kind}, node string, score double")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, skip_self: bool = False, metric: str = "inner") -> DataFrame:
    """(qid, node, score, rank): the k best vectors of each query, ties by id.

    queries: (qid, embedding); vectors: (id, embedding). ``metric`` is ``inner``, the inner product
    of what is stored, or ``cosine``, for which null and all-zero vectors are left out; null
    vectors always are. Many queries: the vectors are written to files once, and a task takes a
    block of queries through all of them, so that k rows a query are all that it yields. The
    lists are merged by a window whose limit is applied before its shuffle.
    """
    need(k >= 1, "k must be at least 1")
    need(metric in METRICS, f"metric must be one of {METRICS}")
    unit = metric == "cosine"
    kind = queries.schema["qid"].dataType.simpleString()
    some = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    some = some & F.exists("embedding", lambda x: x != 0) if unit else some
    q = queries.where(some).select(F.col("qid").alias("qid"), F.col("embedding").alias("embedding"))
    v = vectors.where(some).select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("embedding"))
    numbers, rows = q.agg(F.sum(F.size("embedding")), F.count("*")).first()
    if (numbers or 0) <= BROADCAST_NUMBERS:
        parts = _by_broadcast(q, v, k, skip_self, unit, kind)
    else:
        parts = _by_files(q, rows, vectors, v, k, skip_self, unit, kind)
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "node")
    return parts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def atom_queries(vectors: DataFrame, ids: list[str]) -> DataFrame:
    """(qid, embedding): stored vectors used as queries."""
    return vectors.where(F.col("id").isin(*ids)).select(F.col("id").alias("qid"), "embedding")


def atom_search(texts: DataFrame, needle: str, limit: int = 20, snippet_chars: int = 160) -> DataFrame:
    """(id, title, snippet) of the first ``limit`` rows, by ord, whose id or title holds the needle in any case."""
    wanted = F.lit(needle.casefold())
    hit = casefold(F.col("id")).contains(wanted) | casefold(F.coalesce("title", F.lit(""))).contains(wanted)
    return texts.where(hit).orderBy("ord").limit(limit).select("id", "title", snippet(F.col("text"), snippet_chars).alias("snippet"))


def pair_similarity(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with ``sim``, their cosine; 0 where an id is unknown."""
    v = vectors.select("id", "embedding")
    both = pairs.join(v.withColumnsRenamed({"id": "a", "embedding": "_x"}), "a", "left").join(v.withColumnsRenamed({"id": "b", "embedding": "_y"}), "b", "left")
    cosine = dot("_x", "_y") / F.greatest(norm("_x") * norm("_y"), F.lit(1e-12))
    return both.withColumn("sim", F.coalesce(cosine, F.lit(0.0))).drop("_x", "_y")
