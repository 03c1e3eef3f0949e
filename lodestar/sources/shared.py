"""Tables in the folder that driver and executors share: they end a plan's lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: set[tuple[int, str]] = set()
_owners = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a temporary folder stands in for it on a
    local master and the warehouse on any other, unless that is a folder of
    each machine's own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            path = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lodestar"
            if path.startswith("file:") and not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    _made.add((id(spark.sparkContext), path))
    if stack := getattr(_owners, "stack", None):
        stack[-1].append(path)
    return path


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside are deleted at the end: a stream's batch leaves none behind."""
    stack = _owners.stack = getattr(_owners, "stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.discard((id(spark.sparkContext), path))


@atexit.register
def _clean() -> None:
    context = SparkContext._active_spark_context
    spark = SparkSession.getActiveSession()
    if context is None or spark is None:
        return
    for owner, path in list(_made):
        if owner == id(context):
            try:
                drop_path(spark, path)
            except Exception:  # the JVM may have gone before Python
                return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there.

    The table survives lost executors, unlike cached blocks or local checkpoints.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """Like :func:`stored`, in ``buckets`` by ``column`` and sorted by it inside: joins and groups on it need no exchange.

    Spark keeps the buckets of catalog tables only, so the files in the shared
    folder have an entry in the session's catalog as long as they live.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"lodestar_{path.rsplit('-', 1)[1]}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._lodestar_path, out._lodestar_table = path, table
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` or :func:`bucketed` that no later step reads."""
    if table := getattr(df, "_lodestar_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    drop_path(df.sparkSession, df._lodestar_path)


#: Tables up to this size may be dealt out again if they come in too few files.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out to all of them; any other table as it is.

    One file with one row group is one task, however many cores wait. Large
    tables are never moved for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES and 0 < len(df.inputFiles()) < cores else df


#: Rows of a catalog for one task: their texts, vectors and postings cost far more than moving them.
TASK_ROWS = 4096


def dealt(df: DataFrame, rows: int, name: str) -> DataFrame:
    """A table made by :func:`stored` whose ``rows`` rows cost much to work on, stored anew for all cores if it would be read by too few tasks."""
    wanted = min(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() >= wanted:
        return df
    out = stored(df.repartition(wanted), name)
    forget(df)
    return out
