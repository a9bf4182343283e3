"""Written intermediate tables.

A table that later steps read more than once is written once and read back. That cuts
the lineage (a lost executor costs a re-read, not a recomputation of the facts), gives
every later pass a columnar, pruned scan, and makes its row count a footer lookup.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_used: set[str] = set()
_scopes: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder the cluster names for checkpoints, else the session's warehouse; both are shared.

    A warehouse on a machine's own disk is refused unless Spark runs on that machine alone.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if shared:
        return shared.rstrip("/")
    return _shared_warehouse(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)


def _shared_warehouse(warehouse: str, master: str) -> str:
    if warehouse.startswith(("file:", "/")) and not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors reach: the warehouse {warehouse} is local to the driver")
    return f"{warehouse.rstrip('/')}/scratch"


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; what is still to be read must be stored before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, path)


def reserve(spark: SparkSession, name: str) -> str:
    """Path of a new scratch table or folder, for callers that write it themselves.

    The tables of a session share one folder, which is removed when the driver ends or
    ``release`` is called; those of a ``scope`` go with it.
    """
    folder = f"{scratch_root(spark)}/basketlens-{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(release, spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new scratch table and return a scan of it."""
    spark = df.sparkSession
    path = reserve(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with_facts(df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates over the rows that were taken while writing, without a second pass.

    Use it for maxima, and for counts that only guide the next step.
    """
    seen = Observation(name)
    table = written(df.observe(seen, *facts), name)
    return table, seen.get


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch table, or a part of it, that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def drop_table(table: DataFrame) -> None:
    """Remove the files of a table from ``written`` that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        drop(table.sparkSession, path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of tables written inside leave the disks once the table is there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    spark._jvm.System.gc()  # what the setting does not reach goes with its plan


def release(spark: SparkSession) -> None:
    """Remove the scratch tables of this session; results still to be read must be stored first."""
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        while _used:
            drop(spark, _used.pop())
