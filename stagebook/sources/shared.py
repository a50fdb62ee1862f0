"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="stagebook-")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. A session in one process may leave that unset (tests); on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or _own_dir()}/stagebook/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on an executor."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of at most so many rows may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


#: Rows that a task sorts or groups, about; the number of parts grows with the table, and not what a task holds.
PART_ROWS = 500_000


def parts(spark: SparkSession, *tables: DataFrame) -> int:
    """How many parts the greatest of some tables needs; tables that are dealt into as many meet part by part."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, *[-(-t.count() // PART_ROWS) for t in tables])


def few(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` is counted to have so few rows that a task can hold them all."""
    limit = BROADCAST_ROWS if limit is None else limit
    return df.limit(limit + 1).count() <= limit


def narrow(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast of ``df`` (few narrow columns) if it is counted to be small; else leave the join to a shuffle."""
    return F.broadcast(df) if few(df, limit) else df


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the ledger: the join shuffles. Spark takes a table to be as small as its compressed files,
    and would send many times the limit of a broadcast through the driver."""
    return df.hint("merge")
