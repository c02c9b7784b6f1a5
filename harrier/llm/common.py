"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, small_batches


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and all runs on one machine (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = tempfile.mkdtemp(prefix="harrier-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, and a lost executor costs nothing that was finished."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/harrier-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For functions of mapInArrow: the worker gives freed memory back when a task is done, since it idles beside the JVM until the next one."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drops columns that a result's own columns would clash with."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def exchange(packed: DataFrame, partitions: int) -> DataFrame:
    """Rows with an int column ``bucket``, moved so that those of a bucket follow one another in one partition."""
    return packed.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The tables of successive buckets; holds one bucket at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets = batch.column("bucket").to_numpy()
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(buckets)]):
            if now is not None and buckets[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(buckets[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def numbers(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers packed in a binary column, one after the other, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(x) for x in parts], np.int64)


def batch_of(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def binary(parts: Iterable[bytes]) -> pa.Array:
    return pa.array(list(parts), pa.binary())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps: rows (node, component), the component being its least node.

    Nodes without an edge to another do not occur. Every step is written to the shared folder.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())

    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        e = saved(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
