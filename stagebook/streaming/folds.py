"""Streams of the ledger: moves of stages folded to states, live counts, registration, runs that settle, and periodic passes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.expressions import MOVES, stable_rank
from ..operators.registration import register_members
from ..sources.shared import materialize, narrow, shared_dir
from ..sources.snapshots import Change, Snapshots, buckets_for
from .state import STATES, for_streams, packed, unpacked

_LEGAL = frozenset(MOVES)
#: Level of what a log begins with: appended batches are not merged into it until there are a great many of them.
BASE = 12
#: Hashes of keys, 8 bytes each, that may be broadcast.
HASHES = 1_000_000


def event_moves(raw: DataFrame) -> DataFrame:
    """``work_item_id, seq, new_state, ts`` of the event table."""
    asks = (("signup", "ready"), ("view", "admitted"), ("click", "succeeded"), ("error", "failed"))
    state = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in asks], F.lit("cancelled"))
    return raw.select((F.col("user_id") + 1).alias("work_item_id"), F.col("event_id").alias("seq"), state.alias("new_state"), F.col("ts").cast("timestamp").alias("ts"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of (work_item_id, seq, new_state)."""
    raw = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return event_moves(raw).drop("ts")


def folded_moves(events: DataFrame, buckets: int = 256) -> DataFrame:
    """Every move with the state it met: ``work_item_id, seq, old_state, new_state, accepted``; moves that are not legal are rejected.

    An item starts as ready, and its state outlives the batches. Within a batch an item's events are taken in the order of
    ``seq``; they meet in one task, bounded by what a trigger takes up (``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of the source).
    Items lie in ``buckets``, as each call into Python takes milliseconds. A bucket's states are read and written by every batch that has a
    move of it, so that their number has to grow with the items, and to stay as it is while a stream's state is kept.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = unpacked(bytes(held.get[0])) if held.exists else {"work_item_id": [], "state": []}
        states = dict(zip(known["work_item_id"], known["state"], strict=True))
        moves = pd.concat(list(frames)).sort_values(["unnumbered", "seq"], kind="stable")
        old, accepted = [], []
        for item, lost, new in zip(moves["work_item_id"].tolist(), moves["lost"].tolist(), moves["new_state"], strict=True):
            item = None if lost else item
            state = states.get(item, "ready")
            old.append(state)
            accepted.append((state, new) in _LEGAL)
            states[item] = new if accepted[-1] else state
        held.update((packed({"work_item_id": list(states), "state": list(states.values())}, STATES),))
        yield pd.DataFrame({**{c: moves[c] for c in ("work_item_id", "lost", "seq", "unnumbered")}, "old_state": old, "new_state": moves["new_state"], "accepted": accepted})

    # a null among numbers would make pandas take them all for floats
    whole = lambda c, flag: (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c), F.col(c).isNull().alias(flag))
    rows = events.select(F.pmod(F.xxhash64("work_item_id"), F.lit(buckets)).alias("bucket"), *whole("work_item_id", "lost"), *whole("seq", "unnumbered"), "new_state")
    schema = "work_item_id long, lost boolean, seq long, unnumbered boolean, old_state string, new_state string, accepted boolean"
    moves = rows.groupBy("bucket").applyInPandasWithState(fold, schema, "items binary", "append", GroupStateTimeout.NoTimeout)
    return moves.select(F.when(~F.col("lost"), F.col("work_item_id")).alias("work_item_id"), F.when(~F.col("unnumbered"), F.col("seq")).alias("seq"), "old_state", "new_state", "accepted")


def current_states(moves: DataFrame) -> DataFrame:
    """Of moves that were written: each item's state now, and how many moves were accepted and rejected."""
    state = F.coalesce(F.max_by(F.when(F.col("accepted"), F.col("new_state")), F.when(F.col("accepted"), F.col("seq"))), F.lit("ready"))
    return moves.groupBy("work_item_id").agg(state.alias("state"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def event_counts(events: DataFrame) -> DataFrame:
    """Events by the state they ask for, whether or not it is taken."""
    return events.groupBy(F.col("new_state").alias("state")).agg(F.count("*").alias("n"))


def state_deltas(moves: DataFrame, items: DataFrame) -> DataFrame:
    """``campaign_key, state, delta``: each accepted move leaves a state and enters another. All items count as ready before their first move."""
    known = items.select("work_item_id", "campaign_key")
    changes = F.array(F.struct(F.col("old_state").alias("state"), F.lit(-1).alias("delta")), F.struct(F.col("new_state").alias("state"), F.lit(1).alias("delta")))
    moved = moves.where("accepted").join(known, "work_item_id").select("campaign_key", F.explode(changes).alias("c")).select("campaign_key", "c.*")
    return moved.groupBy("campaign_key", "state").agg(F.sum("delta").alias("delta"))


class LiveCounts:
    """Live items by campaign and state, for ``foreachBatch``: a log of changes by campaign, summed up as it is compacted.

    The number of the last batch lies in the log's own versions, so another process goes on from there, and a batch that comes
    again counts nothing twice. A batch reads the items of its own moves alone: a bucket's items lie in the order of their ids, and of
    its file the pages between the least and the greatest id of the batch are read. There are ``buckets`` of items or more, as many as they
    need. With ``base``, a folder of an earlier process, ``items`` is not needed.
    """

    def __init__(self, spark: SparkSession, items: DataFrame | None = None, base: str | None = None, buckets: int = 16) -> None:
        self.store, self.buckets = Snapshots(spark, base or shared_dir(spark, "live-counts")), buckets
        if not self.store.numbers():
            change = self.store.begin()
            change.create("items", items.select("work_item_id", "campaign_key"), ["work_item_id"], buckets_for(items, buckets), ordered=True)
            start = items.groupBy("campaign_key").agg(F.count("*").alias("n")).select("campaign_key", F.lit("ready").alias("state"), "n")
            change.append("counts", start, ["campaign_key"], buckets, _summed_counts, level=BASE)
            change.commit()

    def __call__(self, moves: DataFrame, k: int) -> None:
        at = self.store.head()
        if k <= at.batch:
            return
        moves = materialize(moves.where("accepted"), "moves")
        # the items of a batch go to the table, which is not shuffled
        moved = narrow(moves.select("work_item_id").distinct())
        low, high = moves.agg(F.min("work_item_id"), F.max("work_item_id")).first()
        items = at.read("items", at.buckets_of("items", moves)).where(F.col("work_item_id").between(low, high)).join(moved, "work_item_id", "left_semi")
        change = self.store.begin(at)
        change.append("counts", state_deltas(moves, items).withColumnRenamed("delta", "n"), ["campaign_key"], self.buckets, _summed_counts)
        change.commit(k)

    def now(self) -> DataFrame:
        return _summed_counts(self.store.head().read("counts")).where("n <> 0")


def _summed_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("campaign_key", "state").agg(F.sum("n").alias("n"))


class Registration:
    """Registration of a stream of members, for ``foreachBatch``: items that are new in a batch are known to later ones.

    Known items are a log in levels, bucketed by campaign and work key and compacted as it grows; a batch looks its members up in
    their buckets alone, in one scan, however many batches there were, and of these items only those that it names are shuffled. A run's
    members come in one batch. A batch that comes again changes nothing, and another process goes on from ``base``. There are ``buckets``
    or more, as many as the items need that are known at the start.
    """

    ITEM = ("campaign_key", "work_key", "work_item_id", "origin_run_key", "input_reference", "labels", "rank", "priority")

    def __init__(self, spark: SparkSession, items: DataFrame, runs: DataFrame, base: str | None = None, buckets: int = 16) -> None:
        self.store, self.runs = Snapshots(spark, base or shared_dir(spark, "registration")), runs
        if not self.store.numbers():
            change = self.store.begin()
            change.append("items", items.select(*self.ITEM), ["campaign_key", "work_key"], buckets_for(items, buckets), level=BASE)
            change.commit()

    def known(self, members: DataFrame) -> DataFrame:
        """Items that may be among the members: hashes of the members' keys go to the items, unless they are too many."""
        at, key = self.store.head(), F.xxhash64("campaign_key", "work_key").alias("h")
        items = at.read("items", at.buckets_of("items", members))
        if members.limit(HASHES + 1).count() > HASHES:
            return items
        return items.withColumn("h", key).join(F.broadcast(members.select(key).distinct()), "h", "left_semi").drop("h")

    def __call__(self, members: DataFrame, k: int) -> None:
        at = self.store.head()
        if k <= at.batch:
            return
        members = materialize(members, "members")
        good, rejects = register_members(members, self.known(members), self.runs)
        good = good.select("run_key", "campaign_key", "member_ordinal", "work_key", "input_reference", "labels", "priority", "kind")
        new = good.where("kind = 'new'").dropDuplicates(["campaign_key", "work_key"])
        made = new.select(
            "campaign_key", "work_key", F.xxhash64("campaign_key", "work_key").alias("work_item_id"), F.col("run_key").alias("origin_run_key"), "input_reference", "labels",
            stable_rank("campaign_key", "work_key").alias("rank"), "priority",
        )
        change, buckets = self.store.begin(at), at.tables["items"].buckets
        change.append("items", made, ["campaign_key", "work_key"], buckets)
        change.append("members", good, ["run_key", "member_ordinal"], buckets)
        change.append("rejects", rejects, ["run_key", "member_ordinal"], buckets)
        change.commit(k)

    def read(self, what: str) -> DataFrame:
        return self.store.head().read(what)


def in_files(rows: DataFrame, file: Column, n: int, tag: str, path: str | None = None, first: int = 0) -> str:
    """Write rows as ``n`` files from number ``first`` on, one after the other, for a stream that takes one file a trigger; returns the folder.

    The rows are dealt out by their number in one job; each file is then written from its own rows alone, by one task: ``n`` has
    to grow with the rows. With ``path`` the files follow those that are there.
    """
    spark, dealt, path = rows.sparkSession, shared_dir(rows.sparkSession, tag), path or shared_dir(rows.sparkSession, f"{tag}-files")
    rows.withColumn("_file", file.cast("int")).repartition(n, "_file").write.partitionBy("_file").parquet(dealt)
    numbered = spark.read.schema(StructType([*rows.schema.fields, StructField("_file", IntegerType())])).parquet(dealt)
    for k in range(first, first + n):
        numbered.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return path


def read_files(spark: SparkSession, path: str, schema: StructType, files: int | None = 1) -> DataFrame:
    """A stream over a folder's files in the order in which they were written, ``files`` a trigger (None: all)."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run_once(spark: SparkSession, stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, state: str | None = None, numbered: bool = False) -> DataFrame | None:
    """Run a stream over all that is there now. Without ``each`` (a step for foreachBatch), its rows are written and returned, ``numbered`` with their ``batch``.

    State and output lie in the shared folder; a stream that is run again with the ``state`` folder of an earlier one goes on from there.
    """
    base = shared_dir(spark, "stream")

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    with for_streams(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(each or write).option("checkpointLocation", f"{state or base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if each:
        return None
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    if mode == "complete":  # the last batch has all
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out if numbered else out.drop("batch")


def committed(store: Snapshots, *passes: Callable[[Change], None]) -> Callable[[int], bool]:
    """A tick of passes for ``periodically``: all of them change one version, which is committed under the tick's number.

    A tick that was committed is not done again; one that fails on its way leaves nothing behind, so it can be repeated.
    Says whether the tick was done now.
    """

    def tick(k: int) -> bool:
        at = store.head()
        if k <= at.batch:
            return False
        change = store.begin(at)
        for pass_ in passes:
            pass_(change)
        change.commit(k)
        return True

    return tick


def periodically(spark: SparkSession, pass_: Callable[[int], None], seconds: float, times: int | None = None) -> int:
    """Run a pass over the ledger on every tick of a processing-time trigger, ``times`` at most; returns how often it ran.

    A tick that is late runs once, and a pass that fails ends the stream with its error.
    """
    base, done = shared_dir(spark, "ticks"), []

    def tick(_: DataFrame, k: int) -> None:
        if times is None or len(done) < times:
            pass_(k)
            done.append(k)

    query = spark.readStream.format("rate").load().writeStream.foreachBatch(tick).option("checkpointLocation", f"{base}/state").trigger(processingTime=f"{seconds} seconds").start()
    try:
        while query.isActive and (times is None or len(done) < times):
            time.sleep(min(seconds, 0.2))
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return len(done)
