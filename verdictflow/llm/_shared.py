"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a group row that a salted join deals out, so one hot key spreads over this many tasks.
SALTS = 16
#: Bytes of an Arrow batch of texts. A limit of rows alone lets long texts fill a worker and the JVM's own buffers.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Without that setting a local session gets a temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="verdictflow-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def uncut(*frames: DataFrame) -> None:
    """Delete the files of cut() frames that nothing reads any more: neither a later frame, nor one not yet cut."""
    for df in frames:
        leaves = df._jdf.queryExecution().logical().collectLeaves()
        for i in range(leaves.size()):
            if leaves.apply(i).getClass().getSimpleName() == "LogicalRDD":
                file = leaves.apply(i).rdd().getCheckpointFile()
                if file.isDefined():
                    delete_path(df.sparkSession, file.get())


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver: Spark deletes the shuffle files that nothing reads again, and the heap shrinks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES for what is computed inside; the caller's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frugal(run: Callable) -> Callable:
    """An iterator function of a Python worker that gives freed memory back to the system when its task ends.

    Workers are reused and wait beside the JVM in the executor's memory, which the next stage may need.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def bucket(n: int, *cols: str | Column) -> Column:
    """A bucket from 0 to n-1 by hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def attach(rows: DataFrame, groups: DataFrame, key: list[str], spread: list[str] | None = None, how: str = "left") -> DataFrame:
    """Join rows to one-row-per-key `groups`; each key's rows are dealt over SALTS tasks.

    They are dealt by the columns `spread`, or without it by their place in their partition: for rows read from files
    or from cut(), which have the same place when a task is run again. The hint keeps Spark from broadcasting `groups`
    on the strength of an estimate.
    """
    g = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    r = rows.withColumn("_salt", bucket(SALTS, *spread) if spread else place)
    return r.join(g.hint("merge"), [*key, "_salt"], how).drop("_salt")


def attach_bounded(rows: DataFrame, groups: DataFrame, key: list[str], spread: list[str] | None = None, how: str = "left", limit: int = 50_000) -> DataFrame:
    """As attach(); `groups` is broadcast only when a count shows that it has at most `limit` rows."""
    if groups.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(groups), key, how)
    return attach(rows, groups, key, spread, how)


def held_out(id_col: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))
