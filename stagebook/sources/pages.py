"""Tables in key order with the bounds of their files, so that a keyset page opens the files behind its cursor and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Ordered:
    """``path`` has the rows, sorted by ``keys`` over files and within them; ``path-bounds`` a row for every file: name, low, high, n."""

    spark: SparkSession
    path: str
    keys: list[str]
    schema: StructType

    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}-bounds")

    def files(self, scope: list, cursor: list | None, limit: int) -> list[str]:
        """Files that hold the first ``limit`` rows of a scope (values of the first keys) behind the cursor (values of the others).

        At most ``limit`` files besides two, which hold other rows as well, and as few as their rows allow.
        """
        k = len(scope)
        start = [*scope, *(cursor or [])]
        least = F.struct(*[F.lit(v).alias(c) for c, v in zip(self.keys, start, strict=False)])
        head = lambda side, n: F.struct(*[F.col(side)[c].alias(c) for c in self.keys[:n]])
        behind = head("high", len(start)) > least if cursor else head("high", len(start)) >= least
        inside = head("low", k) <= F.struct(*[F.lit(v).alias(c) for c, v in zip(self.keys, scope, strict=False)]) if k else F.lit(True)
        whole = (head("low", len(start)) > least if cursor else head("low", k) >= least if k else F.lit(True)) & (head("high", k) == head("low", k) if k else F.lit(True))
        found = self.bounds().where(behind & inside).select("file", F.when(whole, F.col("n")).otherwise(0).alias("sure")).orderBy("low").limit(limit + 2).collect()
        chosen, rows = [], 0
        for r in found:
            chosen.append(r["file"])
            rows += r["sure"]
            if rows >= limit:
                break
        return chosen

    def page(self, scope: list, cursor: list | None, limit: int, condition: Column | None = None) -> DataFrame:
        """Rows of the scope after the cursor in key order, at most ``limit`` (the page's size is the feature); all of an order if ``scope`` is empty.

        Conditions on keys reach the scan, where row groups and pages of a file outside them are skipped. A ``condition`` on other
        columns needs files until enough rows fit; it is then applied to the whole scope, still without the files before the cursor.
        """
        files = self.files(scope, cursor, limit) if condition is None else self.files(scope, cursor, 1 << 30)
        rows = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        for c, v in zip(self.keys, scope, strict=False):
            rows = rows.where(F.col(c) == F.lit(v))
        rest = self.keys[len(scope) :]
        if cursor is not None:
            rows = rows.where(F.col(rest[0]) >= F.lit(cursor[0]))  # of a comparison of structs nothing would be pushed
            rows = rows.where(F.struct(*rest[: len(cursor)]) > F.struct(*[F.lit(v).alias(c) for c, v in zip(rest, cursor, strict=False)]))
        rows = rows if condition is None else rows.where(condition)
        return rows.orderBy(*rest).limit(limit)

    def of_keys(self, values: list) -> DataFrame:
        """Rows whose first key is among some values (a page's): only files whose bounds have room for one of them are opened."""
        key = self.keys[0]
        if not values:
            return self.spark.createDataFrame([], self.schema)
        fits = F.exists(F.array(*map(F.lit, values)), lambda v: (v >= F.col("low")[key]) & (v <= F.col("high")[key]))
        files = [r["file"] for r in self.bounds().where(fits).select("file").collect()]
        rows = self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)
        return rows.where(F.col(key).isin(*values))


def write_ordered(rows: DataFrame, keys: list[str], path: str, rows_per_file: int = 1_000_000) -> Ordered:
    """Write rows in key order, with page indexes, and the bounds of every file. Keys are not null; rows that are equal in all keys may fill several files."""
    spark = rows.sparkSession
    files = max(1, -(-rows.count() // rows_per_file))
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(files, *keys, "_row").sortWithinPartitions(*keys).drop("_row")
    ranged.write.option("parquet.page.row.count.limit", "2000").parquet(path)
    key = F.struct(*keys)
    seen = spark.read.schema(rows.schema).parquet(path).select(F.input_file_name().alias("file"), key.alias("key"))
    seen.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).repartitionByRange(F.col("low")).write.parquet(f"{path}-bounds")
    return Ordered(spark, path, keys, rows.schema)
