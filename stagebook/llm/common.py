"""Shared pieces of the training-data operators: bounded broadcasts, marks, and column helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.shared import materialize, shared_dir

__all__ = ["BROADCAST_ROWS", "bounded", "fresh", "held_out", "id_of", "in_arrow", "lean", "marked", "materialize", "shared_dir", "text_of"]

#: A side of at most so many narrow rows (keys and numbers, under 100 bytes each) may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
#: Words of 64 bits in the largest table of marks: some 40 MB when broadcast, whatever the number of keys.
MARK_WORDS = 1 << 19
#: A session setting, Spark's own value of it, and ours: a task holds a batch of texts several times over, in the JVM and in Python.
ARROW_LIMIT, ARROW_DEFAULT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def bounded(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast of a materialised ``df`` if it is counted to be small; else leave the join to a shuffle."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def marked(rows: DataFrame, key: Column, keys: DataFrame, mark: str) -> DataFrame:
    """Add ``mark``: whether the 64-bit ``key`` may be among ``keys`` (a materialised column of longs). It is never false for one that is.

    Rows stay where they are. Up to BROADCAST_ROWS keys are broadcast themselves; more of them set bits in a table of bounded
    size, 16 a key up to MARK_WORDS words, so that some other rows are marked too: an exact join of the marked rows follows.
    """
    at, bits = fresh(rows, "_marked_key", "_marked_bits")
    (name,) = keys.columns
    n = keys.count()
    if n <= BROADCAST_ROWS:
        known = F.broadcast(keys.select(F.col(name).alias(at), F.lit(True).alias(mark)).distinct())
        return rows.withColumn(at, key).join(known, at, "left").withColumn(mark, F.coalesce(mark, F.lit(False))).drop(at)
    words = min(MARK_WORDS, 1 << (n // 4).bit_length())
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(64 * words))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (place(k) % 64).cast("int"))
    word = lambda k: F.floor(place(k) / 64)
    table = keys.groupBy(word(F.col(name)).alias(at)).agg(F.bit_or(bit(F.col(name))).alias(bits))
    out = rows.withColumn(at, word(key)).join(F.broadcast(table), at, "left")
    return out.withColumn(mark, F.coalesce(F.col(bits).bitwiseAND(bit(key)) != 0, F.lit(False))).drop(at, bits)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives freed memory back at its end, Arrow's and the C library's, as Python workers live on after a task."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    return wrapped


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: StructType | str) -> DataFrame:
    """``run`` over Arrow batches of about ARROW_BYTES (one row at least), each seen once and in order.

    Spark reads the limit when a job starts, so it is set in the session and stays; a session with a limit of its own keeps it.
    Columns with dots or backticks in their names, which mapInArrow does not resolve, have other names on the way.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_LIMIT) == f"{ARROW_DEFAULT}b":
        conf.set(ARROW_LIMIT, f"{ARROW_BYTES}b")
    odd = [c for c in df.columns if "." in c or "`" in c]
    if not odd:
        return df.mapInArrow(lean(run), schema)
    plain = dict(zip(odd, fresh(df, *(f"_odd_{k}" for k in range(len(odd)))), strict=True))
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    renamed = StructType([StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in out.fields])
    return df.toDF(*(plain.get(c, c) for c in df.columns)).mapInArrow(lean(run), renamed).toDF(*out.names)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names, made from ``names``, which ``df`` does not have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    """Ids of any whole type as long."""
    return F.col(column).cast("long").alias(column)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id as text is divisible by five (null ids are held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
