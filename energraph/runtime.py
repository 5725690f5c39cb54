"""What every operator needs from the session: shared storage and sizes.

Lineage is cut by writing a Parquet table below the folder that the session names in
``spark.checkpoint.dir``. All executors share that folder, so a lost executor costs a retry of
its tasks and nothing else. Only a local session without the setting gets a folder of its own.

A table lives as long as any plan reads it: the driver holds a weak reference to the file index
that all plans over the table share, and deletes the table once that is gone. Whatever is left is
deleted when the interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

_RUN = f"energraph-{uuid.uuid4().hex}"
T = TypeVar("T")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for this run's tables; deleted when the driver's interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="energraph-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{_RUN}"
    if path not in _dirs:
        _dirs.add(path)
        atexit.register(remove, spark, path)
    return path


_dirs: set[str] = set()
_kept: dict[tuple, object] = {}
#: Tables that plans may still read: path and weak reference.
_tables: list[tuple[str, object]] = []
MAX_KEPT, TABLES_BEFORE_GC = 64, 400
_since_gc = 0


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_of(spark: SparkSession, folder: str, names: list[str]) -> tuple:
    """Changes whenever one of the folder's tables is written again: sizes, numbers of files and times."""
    out = []
    for name in names:
        where, fs = _at(spark, f"{folder}/{name}.parquet")
        content = fs.getContentSummary(where)
        out.append((name, content.getLength(), content.getFileCount(), fs.getFileStatus(where).getModificationTime()))
    return tuple(out)


def kept(spark: SparkSession, folder: str, names: list[str], key: tuple, make: Callable[[], T]) -> T:
    """A stored result over tables of a folder, made once for each state of them; the oldest of too many go."""
    full = (spark.sparkContext.applicationId, folder, state_of(spark, folder, names), *key)
    if full not in _kept:
        while len(_kept) >= MAX_KEPT:
            _kept.pop(next(iter(_kept)))
        _kept[full] = make()
    return _kept[full]


def forget() -> None:
    """Drop all kept results; their tables go once nothing else reads them."""
    _kept.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    try:
        where, fs = _at(spark, path)
        fs.delete(where, True)
    except Exception:  # the session may be gone already
        pass


def sweep(spark: SparkSession, collect: bool = False) -> int:
    """Delete the tables that no plan reads any more; how many are left. ``collect`` has the JVM look first."""
    if collect:
        spark.sparkContext._jvm.System.gc()
    alive = []
    for path, ref in _tables:
        try:
            gone = ref.refersTo(None)
        except Exception:  # of a session that has ended
            continue
        if gone:
            remove(spark, path)
        else:
            alive.append((path, ref))
    _tables[:] = alive
    return len(alive)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def read_settled(spark: SparkSession, path: str, schema) -> DataFrame:
    """Read a table below the shared folder and free it with its last reader."""
    global _since_gc
    out = spark.read.schema(schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _tables.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    del index
    _since_gc += 1
    if _since_gc >= TABLES_BEFORE_GC:
        _since_gc = 0
        sweep(spark, collect=True)
    return out


def _opened(path: str):
    import re

    from pyarrow import fs

    uri = re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", path))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_files(path: str, columns: list[str]):
    """The Parquet files below a path of the shared folder as an Arrow table, read by the task itself."""
    import pyarrow.parquet as pq

    system, where = _opened(path)
    return pq.read_table(where, columns=columns, filesystem=system, partitioning=None)


def read_batches(path: str, columns: list[str], rows: int) -> Iterator:
    """The same files batch by batch, of which no more than one is held."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, where = _opened(path)
    for f in sorted(x.path for x in system.get_file_info(fs.FileSelector(where, recursive=True)) if x.path.endswith(".parquet")):
        with system.open_input_file(f) as opened:
            yield from pq.ParquetFile(opened).iter_batches(rows, columns=columns)


def settle(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the reader of it."""
    spark = session_of(df)
    path = new_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return read_settled(spark, path, df.schema)


def settle_bucketed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Callable[[], None]]:
    """Write ``df`` in as many buckets as a shuffle has partitions, so that joins on the columns never shuffle it.

    The second value drops the table, which whoever asked for it must do.
    """
    spark = session_of(df)
    n, path, name = shuffle_partitions(spark), new_path(spark), f"energraph_{uuid.uuid4().hex}"
    df.repartition(n, *columns).write.option("path", path).bucketBy(n, *columns).sortBy(*columns).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)

    return spark.table(name), drop


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in a quarter as many partitions or fewer, else as it is."""
    cores = session_of(df).sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 4 <= cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
