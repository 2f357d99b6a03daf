"""Session helpers: table readers and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that ``written`` made and that still stand.
_standing: list[str] = []
#: Seconds between clean-ups of the driver, and when the last one was.
TIDY_SECONDS = 3.0
_tidied = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, from ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary folder is taken.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-talus-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


def tidy(spark: SparkSession) -> None:
    """Let go of finished plans in the driver, so that Spark removes their shuffle files and broadcasts.

    Jobs of many small plans would otherwise fill the driver's heap before its collector runs by itself.
    """
    if time.monotonic() - _tidied[0] > TIDY_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _tidied[0] = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    The write's shuffle files go as soon as it ends, the table when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/talus-{label}-{uuid.uuid4().hex}"
    own = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if own is None else spark.conf.set(CLEANUP_KEY, own)
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    _standing.append(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that the JVM hands a Python worker. Both hold a batch whole, the JVM outside its heap.
BATCH_BYTES = 4 << 20


def in_python(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of about ``BATCH_BYTES``, one row at least; a session that sets a bound of its own keeps it.

    The bound stays set, as Spark reads it when the plan runs. After a task the worker gives back what
    its allocator kept of the batches; it lives on to serve later tasks.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, f"{BATCH_BYTES}b")

    def lean(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


#: Rows that one task of a dealt table gets, about.
TASK_ROWS = 1 << 20


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about so many rows, dealt by ``keys`` to as many tasks as these ask for, where the session's shuffles have fewer.

    A task's sorts and hash tables then stay of one size however large the table is.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/talus-{label}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def tables_written() -> int:
    """How many tables of ``written`` stand: a mark for ``drop_written``."""
    return len(_standing)


def drop_written(spark: SparkSession, since: int) -> None:
    """Remove the tables that ``written`` made after the mark ``since``, but for the newest."""
    for path in _standing[since:-1]:
        files, where = _file_system(spark, path)
        files.delete(where, True)
    del _standing[since:-1]


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    held = {path.rsplit("/", 2)[-2] for df in tables for path in df.inputFiles()}
    for path in [p for p in _standing if p.rsplit("/", 1)[-1] in held]:
        files, where = _file_system(spark, path)
        files.delete(where, True)
        _standing.remove(path)
