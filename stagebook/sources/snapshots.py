"""Versioned snapshots of tables: key buckets, copy-on-write, appended logs with compaction, and a commit that only one writer wins.

A store is a folder. ``data/<folder>/bucket=<b>`` holds rows as Parquet and is never changed; ``versions/<n>.json`` names, for every
table and bucket, the folders that make it up. A commit writes the next version by a rename that fails if the name is taken, so
of two writers that began at one version one is rejected, and readers see all of a commit or none of it. A version may carry the
number of the batch or tick that made it: what is repeated after a failure finds its number there and changes nothing.

Each bucket of a keyed table has a digest of its rows. The digests of a version form a hash tree, from which two versions tell
which buckets differ without a look at the others. What the driver holds grows with the number of buckets, never with the rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StructField, StructType

from .shared import BROADCAST_ROWS, materialize

#: Subtrees of a node of the hash tree, and folders of one level in a bucket before they are merged into one of the next.
FANOUT, MERGE = 16, 4

#: Rows of a bucket, about.
BUCKET_ROWS = 500_000


def buckets_for(rows: DataFrame, least: int) -> int:
    """How many buckets a table needs that begins with these rows, as a bucket is one task and file."""
    return max(least, -(-rows.count() // BUCKET_ROWS))


class Conflict(Exception):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Table:
    """``entries``: bucket to [folder, level] pairs; ``digests``: bucket to the digest of its rows (empty for logs)."""

    keys: list[str]
    buckets: int
    schema: str
    entries: dict[str, list[list]] = field(default_factory=dict)
    digests: dict[str, str] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def tree(self) -> list[list[str]]:
        """Levels of the hash tree, from the buckets' digests to the root."""
        levels = [[self.digests.get(str(b), "") for b in range(self.buckets)]]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([hashlib.sha256("|".join(below[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(below), FANOUT)])
        return levels


@dataclass(frozen=True)
class Version:
    """A committed state of all tables; number 0 has none."""

    store: Snapshots
    number: int = 0
    batch: int = -1
    tables: dict[str, Table] = field(default_factory=dict)

    def paths(self, name: str, buckets: list[int] | None = None) -> list[str]:
        table = self.tables[name]
        chosen = table.entries if buckets is None else [str(b) for b in buckets if str(b) in table.entries]
        return [f"{self.store.base}/data/{folder}/bucket={b}" for b in chosen for folder, _ in table.entries[b]]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or those of its rows that lie in some buckets: no file of another one is opened. One scan, however many folders."""
        schema, paths = StructType.fromJson(json.loads(self.tables[name].schema)), self.paths(name, buckets)
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def buckets_of(self, name: str, *rows: DataFrame) -> list[int]:
        """Buckets in which the keys of some rows lie, at most as many as the table has."""
        found: set[int] = set()
        for df in rows:
            found |= {r["b"] for r in df.select(self.tables[name].bucket().alias("b")).distinct().collect()}
        return sorted(found)


def changed_buckets(old: Version, new: Version, name: str) -> list[int]:
    """Buckets whose rows differ between two versions, found from the root of the hash tree down; of equal subtrees nothing is looked at."""
    a, b = (v.tables[name] for v in (old, new))
    if a.buckets != b.buckets:
        raise ValueError("the versions have another number of buckets")
    left, right = a.tree(), b.tree()
    if left[-1] == right[-1]:
        return []
    at = [0]
    for level in range(len(left) - 2, -1, -1):
        at = [k for p in at for k in range(p * FANOUT, min((p + 1) * FANOUT, len(left[level]))) if left[level][k] != right[level][k]]
    return at


def row_text(df: DataFrame) -> Column:
    """A row as text that tells nulls from empty values and does not depend on the order of a map's entries."""
    columns = [F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


class Snapshots:
    """A store below ``base``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/versions/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        path, fs = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def at(self, number: int) -> Version:
        if number == 0:
            return Version(self)
        path, fs = self._path(f"{number}.json")
        stream = fs.open(path)
        try:
            said = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return Version(self, number, said["batch"], {name: Table(**t) for name, t in said["tables"].items()})

    def head(self) -> Version:
        return self.at(max(self.numbers(), default=0))

    def begin(self, at: Version | None = None) -> Change:
        return Change(self.head() if at is None else at)

    def _put(self, version: Version) -> None:
        """Write a version unless it is there: a file of its own first, then a rename that does not replace."""
        said = {"batch": version.batch, "tables": {n: t.__dict__ for n, t in version.tables.items()}}
        own, fs = self._path(f"_{uuid.uuid4().hex}")
        target, _ = self._path(f"{version.number}.json")
        stream = fs.create(own, False)
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()
        jvm = self.spark._jvm
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(option, 1)
        how[0] = option.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, target, how)
        except Py4JJavaError as error:
            fs.delete(own, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise Conflict(f"version {version.number} of {self.base} was committed by another writer") from error
            raise


class Change:
    """What a writer does to the version it began at; nothing of it is seen before ``commit``."""

    def __init__(self, start: Version) -> None:
        self.start, self.store, self.tables = start, start.store, dict(start.tables)

    def now(self) -> Version:
        """The state after what was done so far."""
        return replace(self.start, tables=self.tables)

    def _write(self, table: Table, rows: DataFrame, placed: bool = False, ordered: bool = False) -> str:
        """A new folder of rows, a file a bucket; rows that are ``placed`` are written from where they are, as tasks read whole files of buckets.
        Of ``ordered`` rows a file has those of near keys on the same pages."""
        folder, rows = uuid.uuid4().hex, rows.withColumn("bucket", table.bucket())
        rows = rows if placed else rows.repartitionById(table.buckets, "bucket")
        rows = rows.sortWithinPartitions("bucket", *table.keys) if ordered else rows
        rows.write.partitionBy("bucket").parquet(f"{self.store.base}/data/{folder}", compression="zstd")
        return folder

    def _seen(self, folder: str, schema: StructType) -> DataFrame:
        """Rows of a folder with their bucket."""
        return self.store.spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.store.base}/data/{folder}")

    def _digests(self, folder: str, schema: StructType) -> dict[str, str]:
        """Bucket to digest, over rows in any order: their number and two sums of 64-bit hashes."""
        rows = self._seen(folder, schema)
        text = row_text(rows.drop("bucket"))
        big = lambda c: F.sum(F.xxhash64(c).cast("decimal(38,0)"))
        sums = rows.withColumn("_text", text).groupBy("bucket").agg(F.count("*").alias("n"), big(F.col("_text")).alias("a"), big(F.concat("_text", F.lit("#"))).alias("b"))
        return {str(r["bucket"]): hashlib.sha256(f"{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest() for r in sums.collect()}

    def create(self, name: str, rows: DataFrame, keys: list[str], buckets: int = 64, ordered: bool = False) -> None:
        """A keyed table with all its rows, or with others than before; ``ordered`` by key within buckets until it is updated."""
        empty = Table(keys, buckets, rows.schema.json())
        folder = self._write(empty, rows, ordered=True) if ordered else self._write(empty, rows)
        digests = self._digests(folder, rows.schema)
        self.tables[name] = replace(empty, entries={b: [[folder, 0]] for b in digests}, digests=digests)

    def update(self, name: str, updates: DataFrame, inserts: DataFrame | None = None, guard: str | list[str] | None = None, key: str | None = None) -> list[int]:
        """``apply_changes`` on the buckets that hold a changed key; the others stay the files they are. Returns the buckets.

        ``key`` identifies a row where the table is bucketed by something else, which updates and inserts then carry too (stages
        that lie with their item). A key that updates name several times is an error of the caller, as it is for ``apply_changes``.
        """
        from ..operators.changes import apply_changes

        table = self.tables[name]
        key = key or table.keys[0]
        updates = materialize(updates, "updates")
        inserts = None if inserts is None else materialize(inserts, "inserts")
        touched = self.now().buckets_of(name, updates, *([] if inserts is None else [inserts]))
        if touched:
            # few changes go to the rows, which stay in the tasks that read their buckets; each time inserts add a file to a bucket, until it is dealt out again
            worn = max([level for b in touched for _, level in table.entries.get(str(b), [])], default=0) + (inserts is not None)
            placed = worn < MERGE and updates.count() <= BROADCAST_ROWS
            rows, schema = self.now().read(name, touched), StructType.fromJson(json.loads(table.schema))
            dealt = not placed and inserts is None
            if dealt:  # many changes and the rows are dealt by bucket once: they meet and are written there
                deal = lambda df: df.withColumn("bucket", table.bucket()).repartition(len(touched), "bucket")
                new = apply_changes(deal(rows), ["bucket", key], deal(updates), None, guard).select(*[f.name for f in schema.fields])
            else:
                new = apply_changes(rows, key, F.broadcast(updates) if placed else updates, inserts, guard)
            folder = self._write(table, new, placed or dealt)
            fresh = self._digests(folder, schema)
            kept = lambda d: {b: x for b, x in d.items() if int(b) not in set(touched)}
            self.tables[name] = replace(table, entries=kept(table.entries) | {b: [[folder, worn if placed else 0]] for b in fresh}, digests=kept(table.digests) | fresh)
        return touched

    def append(self, name: str, rows: DataFrame, keys: list[str], buckets: int = 64, merge: Callable[[DataFrame], DataFrame] | None = None, level: int = 0) -> None:
        """Add rows to a log at a level (0: a batch; what a log begins with is put higher). MERGE folders of one level in a bucket become one of the next level, so that a bucket has few
        folders whatever the number of batches, and a row is written again a logarithmic number of times. ``merge`` sums rows up."""
        table = self.tables.get(name) or Table(keys, buckets, rows.schema.json())
        schema = StructType.fromJson(json.loads(table.schema))
        folder = self._write(table, rows.select(*[f.name for f in schema.fields]))
        entries = {b: list(e) for b, e in table.entries.items()}
        for r in self._seen(folder, schema).select("bucket").distinct().collect():
            entries.setdefault(str(r["bucket"]), []).append([folder, level])
        self.tables[name] = replace(table, entries=entries)
        while full := [b for b, e in entries.items() if sum(x[1] == level for x in e) >= MERGE]:
            # folders of a bucket that are merged; those of higher levels stay
            part = replace(table, entries={b: [x for x in entries[b] if x[1] == level] for b in full})
            rows = replace(self.start, tables={name: part}).read(name)
            folder = self._write(table, merge(rows) if merge else rows)
            there = {str(r["bucket"]) for r in self._seen(folder, schema).select("bucket").distinct().collect()}
            for b in full:
                entries[b] = [x for x in entries[b] if x[1] != level] + ([[folder, level + 1]] if b in there else [])
            self.tables[name] = replace(table, entries={b: e for b, e in entries.items() if e})
            level += 1

    def commit(self, batch: int | None = None) -> Version:
        """The next version. Raises Conflict if another writer has committed since this one began."""
        version = Version(self.store, self.start.number + 1, self.start.batch if batch is None else batch, self.tables)
        self.store._put(version)
        return version
