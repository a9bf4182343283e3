"""Parquet folders dealt into buckets by a key.

Spark knows buckets of catalogue tables only, so a folder is made known under a name of its own for the
session. Grouping by the key, or joining with a folder that has as many buckets of the same key,
then reads each bucket in one task and shuffles nothing. So what is stored this way should have no hot
key: reduce it first, as ``operators.rfm.visits`` does.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_names: list[str] = []


def _new_name(spark: SparkSession) -> str:
    if not _names:
        atexit.register(_forget, spark)
    _names.append(f"basketlens_{uuid.uuid4().hex}")
    return _names[-1]


def _forget(spark: SparkSession) -> None:
    """Take the names out of the catalogue; the files stay."""
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        while _names:
            spark.sql(f"drop table if exists {_names.pop()}")


def default_buckets(spark: SparkSession) -> int:
    """As many as a shuffle would have partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, placed: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to a new folder, one file per bucket, and return a scan that knows them.

    ``placed``: the rows lie where ``repartition(buckets, key)`` puts them, so they do not move.
    """
    name = _new_name(df.sparkSession)
    dealt = (df if placed else df.repartition(buckets, key)).write.mode("errorifexists").format("parquet").options(**options)
    dealt.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A scan of a folder that ``write_bucketed`` wrote, also in an earlier session."""
    name, where = _new_name(spark), path.replace("'", "\\'")
    columns = spark.read.parquet(path)._jdf.schema().toDDL()
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) into {buckets} buckets location '{where}'")
    return spark.table(name)
