"""Readers for many requests at once: pages behind as many cursors, records of many items, and what is turned away.

A request has a ``request_id``; the answer repeats it in every row. ``rejects`` has ``request_id, reason``, the first rule that a request
breaks: repeated_request (its id is there more than once), bad_page_size, bad_state, unknown_campaign or unknown_run, bad_cursor
(out of range), unknown_cursor (no such row in what is asked for). A null cursor is the start, a null page size the default.
Keys of the tables are not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.expressions import PRECEDENCE
from ..sources.schemas import READERS, conform
from ..sources.shared import BROADCAST_ROWS, materialize, narrow, parts
from .status import campaign_summaries, with_current_attempt, work_item_status

#: The size of a page that names none, and the states of stages.
PAGE_SIZE = 10_000
STATES = ("ready", "admitted", "succeeded", "failed", "cancelled")

#: Rows of a list and pages meet in blocks of so many places; a task sorts and counts about so many rows.
BLOCK = 32
ROWS_PER_PART = 500_000


@dataclass
class Read:
    """``rows``: request_id, ``nth`` (place on the page, from 1) and the record. ``rejects``: request_id and reason."""

    rows: DataFrame
    rejects: DataFrame


def _among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with wanted keys if these are few, else all: a join that follows leaves out the others, and asking here would shuffle all of them once more."""
    wanted = wanted.select(*keys)
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted), keys, "left_semi") if few else rows


def _running(lists: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many rows of each list are up to every row of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = dict.fromkeys(lists, 0)
        for batch in batches:
            for name in lists:
                own = np.cumsum(batch.column(f"on_{name}").to_numpy(zero_copy_only=False), dtype=np.int64) + sums[name]
                sums[name] = int(own[-1]) if len(own) else sums[name]
                batch = batch.append_column(f"own_{name}", pa.array(own))
            yield batch

    return run


def places(rows: DataFrame, order: list[str], lists: dict[str, Column]) -> DataFrame:
    """``rows`` with ``on_`` and ``at_`` of each list (a condition by name): whether a row is on it, and how many are up to this row in the (unique) order of all rows.

    Rows are sorted by range, so a scope of any size is spread over tasks. Each part counts its own rows while it is sorted; the sums of
    earlier parts, a row for each part, are added.
    """
    listed = materialize(rows.select(*rows.columns, *[F.coalesce(c, F.lit(False)).alias(f"on_{n}") for n, c in lists.items()]), "listed")
    parts = max(1, -(-listed.count() // ROWS_PER_PART))
    dealt = listed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields, *[StructField(f"own_{n}", LongType()) for n in lists]])
    laid = materialize(dealt.mapInArrow(_running(list(lists)), schema), "laid-out")
    own = laid.groupBy("part").agg(*[F.max(f"own_{n}").alias(n) for n in lists])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = materialize(own.select("part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in lists]), "offsets")
    placed = laid.join(F.broadcast(offsets), "part")
    return placed.select(*rows.columns, *[f"on_{n}" for n in lists], *[(F.col(f"own_{n}") + F.col(f"before_{n}")).alias(f"at_{n}") for n in lists])


def _judged(requests: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Requests with ``size`` and the ``reason`` of the first rule that holds, null if none does."""
    twice = materialize(requests.groupBy(F.col("request_id").alias("twice")).count().where("count > 1").select("twice", F.lit(True).alias("repeated")), "repeated-requests")
    rows = requests.join(narrow(twice), F.col("request_id").eqNullSafe(F.col("twice")), "left").withColumn("size", F.coalesce("page_size", F.lit(PAGE_SIZE)).cast("long"))
    reason = F.when(F.col("repeated"), "repeated_request").when(F.col("size") <= 0, "bad_page_size")
    for name, broken in rules:
        reason = reason.when(F.coalesce(broken, F.lit(False)), name)
    return materialize(rows.withColumn("reason", reason).drop("twice", "repeated", "page_size"), "judged-requests")


@dataclass
class _Laid:
    """Rows of the scopes that are asked for with their places, and a row for each scope with the places where it begins and ends in each list."""

    rows: DataFrame
    bounds: DataFrame
    scope: list[str]
    key: str
    lists: list[str]


def _laid_out(requests: DataFrame, rows: DataFrame, scope: list[str], key: str, order: list[str], lists: dict[str, Column], carry: tuple[str, ...] = ()) -> _Laid:
    """Places of rows in the order of scopes and of ``order``; ``carry`` names narrow columns that go with them."""
    asked = _among(rows, requests.select(*scope).distinct(), scope)
    narrow_rows = asked.select(*dict.fromkeys([*scope, key, *order, *carry]), *[c.alias(f"is_{n}") for n, c in lists.items()])
    placed = places(narrow_rows, [*scope, *order], {n: F.col(f"is_{n}") for n in lists}).drop(*[f"is_{n}" for n in lists])
    ends = [x for n in lists for x in (F.min(F.col(f"at_{n}") - F.col(f"on_{n}").cast("long")).alias(f"from_{n}"), F.max(f"at_{n}").alias(f"to_{n}"))]
    return _Laid(placed, placed.groupBy(*scope).agg(*ends), scope, key, list(lists))


def _known(requests: DataFrame, laid: _Laid, table: DataFrame | None = None) -> DataFrame:
    """Requests with the places ``first`` and ``end`` of their scope in their list, and ``known``: whether the table has their scope."""
    scopes = laid.bounds
    if table is not None:
        asked = _among(table, requests.select(*laid.scope).distinct(), laid.scope)
        scopes = asked.select(*laid.scope).distinct().withColumn("known", F.lit(True)).join(scopes, laid.scope, "left")
    of_list = lambda end: F.coalesce(*[F.when(F.col("list") == n, F.col(f"{end}_{n}")) for n in laid.lists], F.lit(0).cast("long"))
    return requests.join(scopes, laid.scope, "left").withColumns({"first": of_list("from"), "end": of_list("to")}).drop(*[f"{e}_{n}" for n in laid.lists for e in ("from", "to")])


def _pages(judged: DataFrame, laid: _Laid, facts: DataFrame | None = None, on: str | None = None) -> Read:
    """Answer requests (``request_id``, scope, ``list``, ``cursor``, ``size``, ``first``, ``end``) with the rows on their pages and their ``nth``.

    A cursor is the key of a row of the scope, on the list or not; that row knows how many of each list are up to it, so a page is a
    range of places. Rows meet the pages that reach into their block of the list: the work grows with the rows and with what is
    returned, not with requests times rows. ``facts`` are joined to rows of lists by the column ``on``, before these are repeated page by page.
    """
    by = [*laid.scope, laid.key]
    good = judged.where("reason IS NULL").select("request_id", *laid.scope, "list", F.col("cursor").alias(laid.key), "size", "first", "end")
    few = good.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cursors = laid.rows.select(*by, F.lit(True).alias("found"), *[f"at_{n}" for n in laid.lists])
    cursors = cursors.join(F.broadcast(good.select(*by)), by, "left_semi") if few else cursors
    at = F.coalesce(*[F.when(F.col("list") == n, F.col(f"at_{n}")) for n in laid.lists], F.when(F.col("found"), F.lit(0).cast("long")))
    after = F.when(F.col(laid.key).isNull(), F.col("first")).otherwise(at)
    started = good.join(cursors, by, "left").select("request_id", "list", after.alias("after"), F.least(after + F.col("size"), F.col("end")).alias("last"))
    started = materialize(started, "page-ranges") if few else started
    reach = F.sequence(F.floor((F.col("after") + 1) / BLOCK), F.floor(F.col("last") / BLOCK))
    ranges = started.where("last > after").withColumn("block", F.explode(reach))
    on_lists = F.array(*[F.when(F.col(f"on_{n}"), F.struct(F.lit(n).alias("list"), F.col(f"at_{n}").alias("at"))) for n in laid.lists])
    shown = [c for c in laid.rows.columns if not c.startswith(("on_", "at_"))]
    entries = laid.rows.where(reduce(Column.__or__, [F.col(f"on_{n}") for n in laid.lists])).select(*shown, F.explode(F.filter(on_lists, lambda e: e.isNotNull())).alias("e"))
    entries = entries.select(*shown, "e.list", "e.at", F.floor(F.col("e.at") / BLOCK).alias("block"))
    entries = _among(entries, ranges.select("list", "block").distinct(), ["list", "block"]) if few else entries
    entries = entries if facts is None else entries.join(facts, on)
    found = ranges.join(entries, ["list", "block"]).where("at > after AND at <= last").withColumn("nth", F.col("at") - F.col("after"))
    lost = started.where("after IS NULL").select("request_id", F.lit("unknown_cursor").alias("reason"))
    refused = judged.where("reason IS NOT NULL").select("request_id", "reason").distinct()
    return Read(found.drop("list", "block", "at", "after", "last"), refused.unionByName(lost))


def _record(rows: DataFrame, reader: str) -> DataFrame:
    return conform(rows, f"request_id bigint, nth bigint, {READERS[reader]}")


def campaign_pages(requests: DataFrame, runs: DataFrame, items: DataFrame) -> Read:
    """Summaries of campaigns by key for requests (request_id, cursor, page_size)."""
    summaries = materialize(campaign_summaries(runs, items), "campaign-summaries").withColumn("everything", F.lit(0))
    requests = requests.withColumn("everything", F.lit(0)).withColumn("list", F.lit("any"))
    laid = _laid_out(requests, summaries, ["everything"], "campaign_key", ["campaign_key"], {"any": F.lit(True)})
    pages = _pages(_judged(_known(requests, laid), []), laid)
    return Read(_record(pages.rows.join(summaries, "campaign_key"), "campaign_summary"), pages.rejects)


def run_pages(requests: DataFrame, runs: DataFrame, memberships: DataFrame) -> Read:
    """Runs of a campaign by time of creation and key for requests (request_id, campaign_key, cursor, page_size); a cursor is a run of the campaign.

    A closed run has its stored number of members; those of open runs on the pages are counted.
    """
    requests = requests.withColumn("list", F.lit("any"))
    laid = _laid_out(requests, runs, ["campaign_key"], "run_key", ["created_at", "run_key"], {"any": F.lit(True)})
    judged = _judged(_known(requests, laid, runs), [("unknown_campaign", F.col("known").isNull())])
    pages = _pages(judged, laid)
    rows = materialize(pages.rows.drop("created_at").join(runs, ["campaign_key", "run_key"]), "runs-on-pages")
    open_runs = rows.where("registration_closed_at IS NULL").select("run_key").distinct()
    live = memberships.join(open_runs, "run_key", "left_semi").groupBy("run_key").agg(F.count("*").alias("live"))
    count = F.when(F.col("registration_closed_at").isNotNull(), F.col("registered_member_count")).otherwise(F.coalesce("live", F.lit(0)))
    return Read(_record(rows.join(live, "run_key", "left").withColumn("registered_member_count", count), "run"), pages.rejects)


def work_item_pages(requests: DataFrame, runs: DataFrame, items: DataFrame, executions: DataFrame) -> Read:
    """Items of a campaign by id with their status, for requests (request_id, campaign_key, state, cursor, page_size).

    A null state asks for every item that has a stage. A cursor is the id of an item of the campaign, in whatever state.
    """
    state = F.col("state")
    requests = requests.withColumn("list", F.coalesce("state", F.lit("any")))
    scoped = _among(items, requests.select("campaign_key").distinct(), ["campaign_key"])
    status = work_item_status(_among(executions, scoped, ["work_item_id"]))
    known = materialize(scoped.select("work_item_id", "campaign_key").join(status, "work_item_id", "left"), "items-with-status")
    laid = _laid_out(requests, known, ["campaign_key"], "work_item_id", ["work_item_id"], {"any": state.isNotNull()} | {s: state == s for s in STATES})
    rules = [("bad_state", state.isNotNull() & ~state.isin(*STATES)), ("unknown_campaign", F.col("known").isNull()), ("bad_cursor", F.col("cursor") <= 0)]
    pages = _pages(_judged(_known(requests, laid, runs), rules), laid)
    facts = items.select("work_item_id", "work_key", "origin_run_key", "labels")
    rows = pages.rows.join(known.drop("campaign_key"), "work_item_id").join(facts, "work_item_id")
    named = {"stage_execution_id": "current_stage_execution_id", "stage_key": "current_stage_key", "stage_index": "current_stage_index"}
    return Read(_record(rows.withColumnsRenamed(named), "work_item"), pages.rejects)


def run_member_pages(
    requests: DataFrame, runs: DataFrame, memberships: DataFrame, items: DataFrame, executions: DataFrame, attempts: DataFrame | Callable[[DataFrame], DataFrame],
    condition: Column | None = None, states: tuple[str, ...] | None = None,
) -> Read:
    """Members of a run by ordinal with their status, for requests (request_id, run_key, cursor, page_size); a cursor is an ordinal of the run.

    With a ``condition`` on the state and the current attempt only members that meet it are listed, with their stage, summary and
    evidence; ``states`` names the states that it can hold for, any if null. ``attempts`` may be a function that gives those of some
    stages. Without a condition, these are null, and status is derived for members on the pages alone.
    """
    requests, scope = requests.withColumn("list", F.lit("any")), ["run_key"]
    rules = [("unknown_run", F.col("known").isNull()), ("bad_cursor", F.col("cursor") < 0)]
    members = _among(memberships.select("run_key", "member_ordinal", "work_item_id"), requests.select("run_key").distinct(), scope)
    facts = items.select("work_item_id", "work_key", "input_reference")
    order, carry = ["member_ordinal"], ("work_item_id",)
    if condition is None:
        laid = _laid_out(requests, members, scope, "member_ordinal", order, {"any": F.lit(True)}, carry)
        pages = _pages(_judged(_known(requests, laid, runs), rules), laid)
        rows = materialize(pages.rows, "members-on-pages")
        scoped = executions.join(rows.select("work_item_id").distinct(), "work_item_id", "left_semi")
        rows = rows.join(work_item_status(scoped).drop("stage_execution_id"), "work_item_id", "left").join(facts, "work_item_id")
    else:
        scoped = _among(executions, members, ["work_item_id"])
        if states is not None:  # a stage of a later precedence than theirs stands for no item that is in one of them
            last = max(PRECEDENCE.index(s) if s in PRECEDENCE else len(PRECEDENCE) for s in states)
            scoped = scoped.where(F.col("state").isin(*PRECEDENCE[: last + 1])) if last < len(PRECEDENCE) else scoped
        status = work_item_status(scoped, ("current_attempt",))
        status = materialize(status if states is None else status.where(F.col("state").isin(*states)), "status")
        met = with_current_attempt(status, scoped, attempts(status) if callable(attempts) else attempts).where(condition)
        met = materialize(met.join(facts, "work_item_id"), "items-that-meet-it")
        flagged = members.join(met.select("work_item_id", F.lit(True).alias("met")), "work_item_id", "left")
        laid = _laid_out(requests, flagged, scope, "member_ordinal", order, {"any": F.col("met")}, carry)
        pages = _pages(_judged(_known(requests, laid, runs), rules), laid, met, "work_item_id")
        rows = pages.rows
    return Read(_record(rows.withColumnsRenamed({"stage_key": "current_stage_key", "stage_index": "current_stage_index"}), "run_member"), pages.rejects)


def stage_records(wanted: DataFrame, executions: DataFrame, attempts: DataFrame) -> Read:
    """Full records of the stages of requested items (``work_item_id``, which is the request), by index and id, each with its attempts in order.

    Rejects: bad_item (no positive id), unknown_item (it has no stage).
    """
    asked = wanted.select("work_item_id").distinct()
    attempt = [f.name for f in conform(attempts, READERS["stage_attempt"]).schema.fields]
    records, tries, key = conform(executions, READERS["stage_execution"]), conform(attempts, READERS["stage_attempt"]), "stage_execution_id"
    n = parts(executions.sparkSession, executions, attempts)
    # places are worked out on keys alone, so that a record is shuffled once, by its own key, as its attempts are
    placed = records.select("work_item_id", "stage_index", key).repartition(n, "work_item_id").join(asked.where("work_item_id > 0").repartition(n, "work_item_id"), "work_item_id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("work_item_id").orderBy("stage_index", key)).cast("long")
    placed = placed.select(key, nth.alias("nth")).repartition(n, key)
    tries = tries.repartition(n, key).join(placed.select(key), key, "left_semi")
    history = tries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("attempt_number", *[c for c in attempt if c != "attempt_number"]))).alias("attempts"))
    rows = placed.join(records.repartition(n, key), key).join(history, key, "left").withColumn("request_id", F.col("work_item_id"))
    bad = asked.where("work_item_id IS NULL OR work_item_id <= 0").withColumn("reason", F.lit("bad_item"))
    lost = asked.where("work_item_id > 0").join(executions.select("work_item_id"), "work_item_id", "left_anti").withColumn("reason", F.lit("unknown_item"))
    columns = [c for c in records.columns if c != "work_item_id"]
    shown = rows.select("request_id", "nth", "work_item_id", *columns, F.coalesce("attempts", F.array().cast(history.schema["attempts"].dataType)).alias("attempts"))
    return Read(shown, bad.unionByName(lost).withColumnRenamed("work_item_id", "request_id"))


def predecessor_records(requests: DataFrame, executions: DataFrame) -> Read:
    """Succeeded stages with an output below a stage, for requests (request_id, work_item_id, below, stage_key, above, up_to), by index.

    ``above`` and ``up_to`` are exclusive; a null ``up_to`` is ``below``, a null ``stage_key`` any. Rejects: repeated_request, bad_item, bad_bound
    (negative, or no ``below``), bound_over_stage (``up_to`` over ``below``), empty_range. An item without such stages has no rows.
    """
    top = F.coalesce("up_to", "below")
    bad = F.lit(False)
    for bound in ("up_to", "above"):
        bad = bad | F.coalesce(F.col(bound) < 0, F.lit(False))
    times = F.count("*").over(Window.partitionBy("request_id"))
    reason = (
        F.when(F.col("times") > 1, "repeated_request").when(F.coalesce(F.col("work_item_id") <= 0, F.lit(True)), "bad_item").when(F.coalesce(F.col("below") < 0, F.lit(True)), "bad_bound")
        .when(F.col("up_to") > F.col("below"), "bound_over_stage").when(bad, "bad_bound").when(F.col("above") >= top, "empty_range")
    )
    judged = materialize(requests.withColumn("times", times).withColumn("reason", reason).withColumn("top", top).drop("times"), "judged-requests")
    good = judged.where("reason IS NULL").select("request_id", "work_item_id", F.col("stage_key").alias("asked_key"), "above", "top")
    done = executions.where("state = 'succeeded' AND output_reference IS NOT NULL").select("work_item_id", "stage_execution_id", "stage_index", "stage_key", "input_reference", "output_reference")
    inside = (F.col("asked_key").isNull() | (F.col("asked_key") == F.col("stage_key"))) & (F.col("above").isNull() | (F.col("stage_index") > F.col("above"))) & (F.col("stage_index") < F.col("top"))
    rows = good.join(done, "work_item_id").where(inside)
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("stage_index", "stage_execution_id")).cast("long")
    return Read(_record(rows.withColumn("nth", nth), "predecessor_output"), judged.where("reason IS NOT NULL").select("request_id", "reason").distinct())
