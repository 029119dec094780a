"""Shared scratch storage and size-checked broadcasts.

The caller owns the session.  Intermediate tables that several jobs read go
to the folder named by ``spark.checkpoint.dir`` as Parquet: they survive the
loss of executors, and later passes read only the columns they need.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may have.  The sides we broadcast are parameter tables
# of at most about 1 kB a row, so this keeps a broadcast under 50 MB.
BROADCAST_ROWS = 50_000

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="barwatch-package-"), "barwatch")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="barwatch-")
    return _local_scratch[sc.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_parameters(
    rows: DataFrame, params: DataFrame, on: list[str], how: str = "inner", written: bool = False
) -> DataFrame:
    """Join a table of per-group parameters to many rows.

    ``params`` is written out (unless it was already) and counted first.  Up to ``BROADCAST_ROWS`` it
    is broadcast, so the rows do not move; a larger one is left to a shuffle
    join, where adaptive execution splits hot keys.
    """
    if not written:
        params = materialize(params, "params")
    if params.count() <= BROADCAST_ROWS:
        params = F.broadcast(params)
    return rows.join(params, on, how)


def one_file_each(rows: DataFrame, key: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Deal ``rows`` for a write partitioned by ``key``: one task a key, or as many as a large one's rows ask for."""
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_parts"))
    parts = parts.withColumnRenamed(key, "_key")
    dealt = rows.join(parts, rows[key].eqNullSafe(parts["_key"]))
    salt = F.pmod(F.xxhash64(*rows.columns), F.col("_parts"))
    return dealt.withColumn("_salt", salt).repartition(key, "_salt").drop("_key", "_parts", "_salt")
