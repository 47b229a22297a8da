"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    temporary folder; on a cluster, whose executors would not see it, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def own_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends or by clean()."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _fs(spark, path)[0].deleteOnExit(_fs(spark, path)[1])
    _made.append(path)
    return path


_made: list[str] = []


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables and checkpoints of this session; results that still read them must be written before."""
    paths, own = list(_made), spark.sparkContext.getCheckpointDir()
    _made.clear()
    if own:
        at = _fs(spark, own)
        paths += [str(x.getPath()) for x in at[0].listStatus(at[1])] if at[0].exists(at[1]) else []
    for path in paths:
        fs, at = _fs(spark, path)
        fs.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    path, sc = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again; for wide rows this is far smaller than a checkpoint."""
    spark = df.sparkSession
    path = own_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gather(rows: DataFrame, col: str, most_bytes: int, tag: str) -> pa.Table:
    """The rows (id, ...) of a bounded sample with distinct ids at the driver, by id: by hash of id as many as hold
    most_bytes in the binary column, the first one in any case. The rest never leaves the executors."""
    kept = table(rows, tag)
    sizes = kept.select("id", F.xxhash64("id").alias("h"), F.coalesce(F.octet_length(col), F.lit(0)).cast("long").alias("n")).toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    total = np.cumsum(sizes.column("n").to_numpy())
    if len(total) and total[-1] > most_bytes:
        most = max(1, int(np.searchsorted(total, most_bytes, side="right")))
        last = (sizes.column("h")[most - 1].as_py(), sizes.column("id")[most - 1].as_py())
        h = F.xxhash64("id")
        kept = kept.where((h < last[0]) | ((h == last[0]) & (F.col("id") <= last[1])))
    return kept.toArrow().sort_by("id")


def release(spark: SparkSession) -> None:
    """Let the JVM collect the plans that were cut, so that Spark's cleaner deletes their shuffle files now and not at some
    later collection: a long job then holds the files of its current step only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of ids, up to some 10 MB, that a join broadcasts; more are shuffled.
BROADCAST_ROWS = 200_000


def few(ids: DataFrame) -> DataFrame:
    """A narrow frame of ids, cut before, marked for a broadcast where a count finds at most BROADCAST_ROWS of them; then the
    other side, with its texts, need not be shuffled."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def spans(batch: pa.RecordBatch, col: int, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of a batch that hold about most_bytes of text."""
    column = batch.column(col)
    n, at = len(column), 0
    step = max(1, int(n * most_bytes / max(1, column.nbytes)))
    while at < n:
        yield at, min(step, n - at)
        at += step


def slices(batch: pa.RecordBatch, col: int, most_bytes: int = 8 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of a batch that hold about most_bytes of text; null texts come as empty ones."""
    for at, n in spans(batch, col, most_bytes):
        yield at, [t or "" for t in batch.column(col).slice(at, n).to_pylist()]


#: Caches of modules, emptied by lean() in a worker that goes on with another stage.
caches: list = []


def lean(*keep: Callable) -> None:
    """Give back what earlier stages of a job left in this worker: models in the caches but those to keep, and freed memory."""
    for cache in caches:
        if cache not in keep:
            cache.cache_clear()
    trim()


def trim() -> None:
    """Give back the freed memory that Arrow and the C library hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def change_rows(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], most_bytes: int = 4 << 20) -> DataFrame:
    """df with fn applied to slices of its batches; fn gets a slice with all columns and its texts, and gives rows of the
    same columns. Rows never leave their partition."""
    at_col = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for at, texts in slices(batch, at_col, most_bytes):
                yield fn(batch.slice(at, len(texts)), texts)

    return df.mapInArrow(run, df.schema)


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the column as text, modulo mod."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def hash_sample(df: DataFrame, most: int, *cols: str) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of the columns.

    A count comes first and a share of the hash range that holds about half as many rows again, so that what tasks sort
    and send stays near the sample's own size, however many tasks there are. Where equal rows share hashes and too few
    stand in that share, all rows are sorted instead: the sample is the same by either way.
    """
    order = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    n = df.count()
    if n > 2 * most:
        some = df.where(order < int(2**53 * 1.5 * most / n))
        if some.count() >= most:
            df = some
    return df.orderBy(order, *cols).limit(most)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
