"""The most similar vectors of every vector, by balanced posting lists.

1. Vectors that are exactly equal become one group that carries its k + 1 smallest ids, which is
   all that any neighbour list can need of it.
2. A sample of at most ``FIT_SAMPLE`` distinct vectors, those of the smallest hashes, is split by
   hierarchical k-means until no cell holds more than its share of ``LIST_ROWS`` rows, so dense
   regions get more lists; the cells' centroids, at most ``MAX_LISTS``, are broadcast (about 8 MB
   at 96 numbers) with a graph of their nearest centroids.
3. Every vector finds its nearest centroids by best-first search in that graph. It is stored in
   the list of the nearest one, and a boundary vector also in those nearly as near (unless a
   list already taken is nearer to the new list than the vector is). As a query it reads the
   lists whose distance is within a ratio of the nearest one's.
4. So many vectors that the lists would hold more than ``SPLIT_ROWS`` rows get a second level:
   every such list is split by centroids fitted to a sample of its own rows, of at most
   ``FIT_SAMPLE``, in a task of its own, and its readers choose among the parts as before. The
   distance to beat is that of the nearest centroid of either level. So the rows that a vector is
   compared with do not grow with the collection, and no centroid of the second level is ever
   broadcast or sent to the driver.
5. A list with more rows than ``BLOCK_ROWS`` is handled in blocks, each block of queries against
   each block of stored rows, so no task holds more than two blocks and no row is left out.
6. Candidates are chosen by single-precision products, with a margin, and ranked by exact cosines
   rounded to 9 decimals; equal ones go by smaller id.

The index is approximate: a true neighbour is missed when none of its lists is read. A search
keeps the ``BEAM`` best centroids, and a vector reads at most ``READ_MOST`` lists of each level.
The tests measure the recall against brute force, at one and at two levels.

Defined results: null and all-zero vectors, those with null, NaN or infinite numbers and those of
another length than most are in no pair; a row without an id is none; an id that comes repeatedly
counts once, with its smallest vector hash; empty tables give an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from energraph.runtime import session_of, settle

FIT_SAMPLE, LIST_ROWS, MAX_LISTS, BLOCK_ROWS, SPLIT_ROWS, SLOT_ROWS = 1 << 16, 256, 1 << 14, 4096, 1024, 1 << 15
LINKS, BEAM, READ_MOST, STORE_MOST, READ_RATIO, STORE_RATIO = 24, 48, 24, 4, 1.22, 1.06


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def _split(x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The cell of each row after spherical k-means."""
    centers = x[rng.choice(len(x), parts, replace=False)]
    cell = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        cell = np.concatenate([(x[i : i + 8192] @ centers.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, x)
        empty = np.bincount(cell, minlength=parts) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centers = unit(sums)
    return cell


def fit_centroids(sample: np.ndarray, cell_rows: int, branches: int = 16) -> np.ndarray:
    """Centroids of cells of at most ``cell_rows`` rows; rows too alike to be told apart stay together."""
    rng, done, work = np.random.default_rng(7), [], [sample]
    while work:
        x = work.pop()
        parts = min(branches, -(-len(x) // cell_rows))
        cell = _split(x, parts, rng) if parts > 1 else np.zeros(len(x), np.int64)
        sizes = np.bincount(cell)
        if sizes.max() == len(x):
            done.append(x.mean(axis=0))
        else:
            work += [x[cell == c] for c in np.flatnonzero(sizes)]
    return unit(np.array(done))


def build_graph(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids of each, and the places where a search may start."""
    n = len(centroids)
    links = min(LINKS, n)
    graph = np.empty((n, links), np.int32)
    for i in range(0, n, 1024):
        near = centroids[i : i + 1024] @ centroids.T
        graph[i : i + 1024] = np.argpartition(-near, links - 1, axis=1)[:, :links]
    starts = np.random.default_rng(11).permutation(n)[: max(1, int(4 * np.sqrt(n)))]
    return graph, np.sort(starts).astype(np.int32)


def graph_search(queries: np.ndarray, centroids: np.ndarray, graph: np.ndarray, starts: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for many queries at once: (numbers, cosines), nearest first, -1 where none."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(centroids) + 1), bool)
    near = queries @ centroids[starts].T
    first = min(8, len(starts))
    top = np.argpartition(-near, first - 1, axis=1)[:, :first]
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, np.float32)
    ids[:, :first], sims[:, :first] = starts[top], near[rows, top]
    seen[rows, ids[:, :first]] = True
    spent = np.zeros((n, beam), bool)
    live = np.arange(n)
    while len(live):
        open_ = np.where(spent[live] | (ids[live] < 0), -np.inf, sims[live])
        at = open_.argmax(axis=1)
        more = open_[np.arange(len(live)), at] > -np.inf
        live, at = live[more], at[more]
        if not len(live):
            break
        spent[live, at] = True
        step = graph[ids[live, at]]
        fresh = ~seen[live[:, None], step]
        seen[live[:, None], step] = True
        values = np.where(fresh, np.einsum("bd,brd->br", queries[live], centroids[step]), -np.inf)
        all_sims = np.concatenate([sims[live], values], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        r = np.arange(len(live))[:, None]
        ids[live] = np.where(all_sims[r, keep] > -np.inf, np.concatenate([ids[live], step], axis=1)[r, keep], -1)
        spent[live] = np.concatenate([spent[live], np.zeros_like(fresh)], axis=1)[r, keep]
        sims[live] = all_sims[r, keep]
    order = np.argsort(-sims, axis=1, kind="stable")
    return ids[rows, order], sims[rows, order]


def choose_lists(ids: np.ndarray, sims: np.ndarray, centroids: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the found centroids: lists to read, and lists to be stored in.

    ``bound`` is a distance known from elsewhere, beyond whose ratio nothing is read.
    """
    far = np.sqrt(np.maximum(0, 2 - 2 * sims.astype(np.float64)))
    place = np.arange(ids.shape[1])
    best = far[:, :1] if bound is None else np.minimum(far[:, :1], bound[:, None])
    read = (ids >= 0) & (far <= READ_RATIO * best + 1e-6) & (place < READ_MOST)
    stored = np.zeros_like(read)
    stored[:, 0] = True
    for j in range(1, min(ids.shape[1], 2 * STORE_MOST)):
        want = (ids[:, j] >= 0) & (far[:, j] <= STORE_RATIO * far[:, 0] + 1e-6) & (stored.sum(axis=1) < STORE_MOST)
        for i in range(j):  # a list nearer to one that is taken than to the vector adds little
            rows = np.flatnonzero(want & stored[:, i])
            if len(rows):
                between = np.einsum("bd,bd->b", centroids[ids[rows, j]], centroids[ids[rows, i]])
                want[rows[between > sims[rows, j]]] = False
        stored[:, j] = want
    return read, stored


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _usable(vector: Column) -> Column:
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & number & F.exists(vector, lambda x: x != 0)


def copy_groups(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, first_id, ids, copies, vector): equal vectors with their k + 1 smallest ids."""
    by = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.array_sort(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"))


def _compare(dim: int, k: int, floor: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        stored, asks = (t.column(c).to_numpy(zero_copy_only=False) for c in ("stored", "asks"))
        x = _matrix(t.column("vector").chunk(0), dim).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        base, q = np.flatnonzero(stored), np.flatnonzero(asks)
        lists = t.column("ids").chunk(0)
        names, starts = np.array(lists.flatten().to_pylist(), np.str_), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        low = x.astype(np.float32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(q) if len(base) else 0, 512):
            part = q[lo : lo + 512]
            near = low[part] @ low[base].T
            m = min(k + 2, len(base))
            cut = np.maximum(-np.partition(-near, m - 1, axis=1)[:, m - 1] - 4e-6, floor - 4e-6)
            r, c = np.nonzero(near >= cut[:, None])
            exact = np.concatenate([np.round(np.einsum("bd,bd->b", x[part[r[i : i + (1 << 16)]]], x[base[c[i : i + (1 << 16)]]]), 9) for i in range(0, max(1, len(r)), 1 << 16)])
            keep = exact > floor
            r, c, exact = r[keep], base[c[keep]], exact[keep]
            width = starts[c + 1] - starts[c]  # a group of copies stands for all its ids
            rows = np.repeat(np.arange(len(r)), width)
            other = np.repeat(starts[c], width) + np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width)
            r, s, named = r[rows], exact[rows], names[other]
            by = np.lexsort((named, -s, r))
            r = r[by]
            best = np.arange(len(r)) - np.searchsorted(r, r, "left") <= k
            out.append((part[r[best]], other[by][best], s[by][best]))
        a, o, s = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        first, every = t.column("first_id").chunk(0) if t.num_rows else pa.array([], pa.string()), lists.flatten()
        return pa.Table.from_arrays([first.take(pa.array(a)), every.take(pa.array(o)), pa.array(s)], names=["first_id", "other", "similarity"])

    return run


def _explode_lists(ids: np.ndarray, read: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, stored) of every list that a row reads or is stored in."""
    row, column = np.nonzero(read | stored)
    return row, column, stored[row, column]


def _refine(visits: DataFrame, sizes: DataFrame, dim: int) -> DataFrame:
    """The visits of lists with too many rows as visits of those lists' parts.

    visits (list, first_id, ids, vector, stored, asks, bound); sizes (list, rows, slots).
    """

    def fit(t: pa.Table) -> pa.Table:
        x = unit(_matrix(t.column("vector").combine_chunks().cast(pa.list_(pa.float32())), dim))
        rows = t.column("rows")[0].as_py()
        parts = fit_centroids(x, max(2, LIST_ROWS // 2 * len(x) // rows))
        return pa.Table.from_arrays([t.column("list").slice(0, 1), pa.array([parts.ravel()], pa.list_(pa.float32()))], names=["list", "centers"])

    def choose(t: pa.Table, fitted: pa.Table) -> pa.Table:
        centers = _matrix(fitted.column("centers").combine_chunks(), dim)
        t = t.combine_chunks()
        graph, places, kept = build_graph(centers), [], []
        x, bound = unit(_matrix(t.column("vector").chunk(0), dim)), t.column("bound").to_numpy()
        stored, asks = (t.column(c).to_numpy(zero_copy_only=False) for c in ("stored", "asks"))
        for lo in range(0, len(x), 1024):
            part = slice(lo, lo + 1024)
            ids, sims = graph_search(x[part], centers, *graph, beam=min(BEAM, max(8, len(centers))))
            read, held = choose_lists(ids, sims, centers, bound[part])
            row, column, holds = _explode_lists(ids, read & asks[part, None], held & stored[part, None])
            places.append(row + lo)
            kept.append(np.stack([ids[row, column], holds, read[row, column] & asks[part][row]], axis=1))
        at, found = np.concatenate(places), np.concatenate(kept).astype(np.int64)
        out = t.select(["list", "first_id", "ids", "vector"]).take(pa.array(at))
        key = (out.column("list").to_numpy() + 1) * (1 << 32) + found[:, 0]
        columns = [pa.array(key), *out.columns[1:], pa.array(found[:, 1] > 0), pa.array(found[:, 2] > 0)]
        return pa.Table.from_arrays(columns, names=["list", "first_id", "ids", "vector", "stored", "asks"])

    big = visits.join(F.broadcast(sizes), "list")
    drawn = F.pmod(F.xxhash64("first_id"), F.lit(1 << 20)) < F.lit(FIT_SAMPLE * float(1 << 20)) / F.col("rows")
    centers = settle(big.where("stored").where(drawn).select("list", "rows", "vector").groupBy("list").applyInArrow(fit, "list bigint, centers array<float>"))
    slotted = big.withColumn("slot", F.pmod(F.xxhash64("first_id"), F.col("slots")).cast("int")).drop("rows", "slots")
    copies = centers.join(F.broadcast(sizes), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slots").cast("int") - 1)).alias("slot"), "centers")
    return slotted.groupBy("list", "slot").cogroup(copies.groupBy("list", "slot")).applyInArrow(choose, "list bigint, first_id string, ids array<string>, vector array<float>, stored boolean, asks boolean")


def nearest(df: DataFrame, id: str = "id", vector: str = "embedding", *, k: int = 5, min_similarity: float = 0.0) -> DataFrame:
    """(id, other, similarity): the k most similar others of each id with more than ``min_similarity``."""
    spark = session_of(df)
    given = df.where(F.col(id).isNotNull() & _usable(F.col(vector))).select(F.col(id).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    hashed = given.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(7), "vector"))
    sizes = hashed.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes[0] if sizes else 1
    one = hashed.where(F.size("vector") == dim).groupBy("id").agg(F.min(F.struct("h1", "h2", "vector")).alias("v")).select("id", "v.h1", "v.h2", "v.vector")
    rows = settle(one)
    groups = settle(copy_groups(rows, k))
    n = groups.count()

    # the index
    share = min(1.0, FIT_SAMPLE / max(1, n))
    bound = int(share * (1 << 31))
    sample = groups.where(F.pmod(F.xxhash64("h2"), F.lit(1 << 31)) <= bound).select("h1", "vector").orderBy("h1").limit(FIT_SAMPLE).toArrow()
    fit = unit(_matrix(sample.column("vector").combine_chunks(), dim)) if sample.num_rows else np.zeros((1, dim), np.float32)
    list_rows = max(LIST_ROWS, -(-2 * n // MAX_LISTS))
    centroids = fit_centroids(fit, max(2, int(list_rows * share)))
    index = spark.sparkContext.broadcast((centroids, *build_graph(centroids)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, graph, starts = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                ids, sims = graph_search(unit(_matrix(b.column("vector"), dim)), centers, graph, starts)
                read, stored = choose_lists(ids, sims, centers)
                lists = [i[m].tolist() for i, m in zip(ids, read | stored)]
                holds = [s[m].tolist() for s, m in zip(stored, read | stored)]
                bound = np.sqrt(np.maximum(0, 2 - 2 * sims[:, 0].astype(np.float64)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int64())), pa.array(holds, pa.list_(pa.bool_())), pa.array(bound)], names=[*b.schema.names, "lists", "holds", "bound"])

    assigned = settle(groups.select("first_id", "ids", "vector").mapInArrow(assign, "first_id string, ids array<string>, vector array<float>, lists array<bigint>, holds array<boolean>, bound double"))
    counts = assigned.select(F.explode(F.arrays_zip("lists", "holds")).alias("l")).groupBy("l.lists").agg(F.count("*"), F.count_if("l.holds")).collect()  # a row per list of the first level
    visit = assigned.select("first_id", "ids", "vector", "bound", F.explode(F.arrays_zip("lists", "holds")).alias("l")).select(F.col("l.lists").alias("list"), "first_id", "ids", "vector", F.col("l.holds").alias("stored"), F.lit(True).alias("asks"), "bound")
    large = [(r[0], r[2], -(-r[1] // SLOT_ROWS)) for r in counts if r[2] > SPLIT_ROWS]
    columns = ["list", "first_id", "ids", "vector", "stored", "asks"]
    if large:
        sizes = spark.createDataFrame(large, "list bigint, rows bigint, slots bigint")
        small = visit.join(F.broadcast(sizes), "list", "left_anti").select(columns)
        visit = settle(small.unionByName(_refine(visit, sizes, dim).select(columns)))
        crowded = visit.groupBy("list").agg(F.count_if("asks").alias("n"), F.count_if("stored").alias("m")).where((F.col("n") > BLOCK_ROWS) | (F.col("m") > BLOCK_ROWS))
        blocks = settle(crowded.select("list", F.ceil(F.greatest("n", F.lit(1)) / BLOCK_ROWS).cast("int").alias("ask_blocks"), F.ceil(F.greatest("m", F.lit(1)) / BLOCK_ROWS).cast("int").alias("store_blocks")))
        whole, cut = visit.join(blocks, "list", "left_anti"), visit.join(blocks, "list")
    else:
        held = spark.createDataFrame([(r[0], -(-r[1] // BLOCK_ROWS), max(1, -(-r[2] // BLOCK_ROWS))) for r in counts if r[2]], "list bigint, ask_blocks int, store_blocks int")
        sized = visit.select(columns).join(F.broadcast(held), "list")
        whole, cut = sized.where("ask_blocks = 1"), sized.where("ask_blocks > 1")

    def every(n_blocks: Column) -> Column:
        return F.sequence(F.lit(0), n_blocks - 1)

    def own(n_blocks: Column) -> Column:
        return F.array(F.pmod(F.xxhash64("first_id"), n_blocks).cast("int"))

    whole = whole.withColumns({"a": F.lit(0), "s": F.lit(0)})
    asking = cut.where("asks").withColumn("s", F.explode(every(F.col("store_blocks")))).withColumn("a", F.explode(own(F.col("ask_blocks")))).withColumn("stored", F.lit(False))
    storing = cut.where("stored").withColumn("a", F.explode(every(F.col("ask_blocks")))).withColumn("s", F.explode(own(F.col("store_blocks")))).withColumn("asks", F.lit(False))
    columns = [*columns, "a", "s"]
    units = whole.select(columns).unionByName(asking.select(columns)).unionByName(storing.select(columns))
    found = units.groupBy("list", "a", "s").applyInArrow(_compare(dim, k, min_similarity), "first_id string, other string, similarity double").distinct()
    best = Window.partitionBy("first_id").orderBy(F.desc("similarity"), "other")
    ranked = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    tops = settle(ranked.groupBy("first_id").agg(F.sort_array(F.collect_list(F.struct("n", "other", "similarity"))).alias("top")))

    # every member of a group of copies has the group's neighbours, without itself
    single = tops.select(F.col("first_id").alias("id"), "first_id", "top")
    more = groups.where(F.size("ids") > 1).select("h1", "h2", "first_id").join(tops, "first_id").select("h1", "h2", "first_id", "top")
    many = rows.groupBy("h1", "h2").count().where(F.col("count") > F.lit(n // 1000 + k + 1)).select("h1", "h2")
    hot = settle(more.join(many, ["h1", "h2"]))  # at most a thousand groups and their short lists
    members = rows.select("id", "h1", "h2")
    by_hot = members.join(F.broadcast(hot), ["h1", "h2"])
    by_key = members.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(more, ["h1", "h2"])
    copies = by_hot.select("id", "first_id", "top").unionByName(by_key.select("id", "first_id", "top")).where("id <> first_id")
    others = F.slice(F.filter("top", lambda t: t["other"] != F.col("id")), 1, k)
    each = single.unionByName(copies).select("id", F.explode(others).alias("t"))
    return each.select("id", F.col("t.other").alias("other"), F.col("t.similarity").alias("similarity"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(u, v, similarity), u < v: pairs of which at least one end has the other among its nearest."""
    return near.groupBy(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).agg(F.max("similarity").alias("similarity"))
