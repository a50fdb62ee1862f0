"""Passes over a ledger in a versioned store, to be committed together under the number of a tick (see ``folds.committed``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import admission, changes, completion, recovery
from ..sources.shared import materialize
from ..sources.snapshots import Change, buckets_for

#: Tables and how they lie: stages and attempts by their stage, runs by key, the outbox as a log.
STAGES, ATTEMPTS, RUNS, ITEMS, MEMBERS, CONTROLS, OUTBOX = "stage_executions", "stage_attempts", "pipeline_runs", "work_items", "run_memberships", "stage_controls", "outbox"


def put(change: Change, tables: dict[str, DataFrame], buckets: int = 64) -> None:
    """Begin a store with the ledger's tables, in ``buckets`` or more, as their rows ask for."""
    keys = {STAGES: ["stage_execution_id"], ATTEMPTS: ["stage_execution_id"], RUNS: ["run_key"], ITEMS: ["work_item_id"], MEMBERS: ["run_key", "member_ordinal"], CONTROLS: ["stage_control_id"]}
    for name, rows in tables.items():
        change.create(name, rows, keys[name], buckets_for(rows, buckets))


def _send(change: Change, tick: str, rows: DataFrame) -> None:
    change.append(OUTBOX, rows.select("workflow_id", F.lit(tick).alias("pass"), "payload"), ["workflow_id"])


def admission_tick(declared: DataFrame, at: Column, batch: int = 10_000) -> Callable[[Change], None]:
    """Admits what fits: stages and attempts change, and workflows are sent."""

    def run(change: Change) -> None:
        now = change.now()
        stages, attempts = now.read(STAGES), now.read(ATTEMPTS)
        facts = partial(changes.admission_rows, stages, now.read(ITEMS), now.read(RUNS))
        rows = facts()
        occupancy = materialize(changes.control_occupancy(rows, now.read(CONTROLS)), "occupancy")
        done = admission.admission_pass(stages, rows, occupancy, attempts, declared, at, batch, facts=facts)
        change.update(STAGES, done.executions.select("stage_execution_id", "state", "current_attempt", "expected"), guard="state")
        written = materialize(done.attempts, "admitted-attempts")
        prepared = written.where("NOT appended").select(F.concat_ws("#", "stage_execution_id", "attempt_number").alias("attempt"), "stage_execution_id", "admitted_at")
        added = written.where("appended").select(F.concat_ws("#", "stage_execution_id", "attempt_number").alias("attempt"), "stage_execution_id", "attempt_number", "workflow_id", "admitted_at", F.lit(None).cast("timestamp").alias("terminal_at"))
        change.update(ATTEMPTS, prepared, added, key="attempt")
        _send(change, "admission", done.outbox)

    return run


def sweep_tick(feed: DataFrame, live: recovery.Live, at: Column) -> Callable[[Change], None]:
    """Ends admitted stages that the external feed shows to be abandoned; a stage that has moved on meanwhile is left alone."""

    def run(change: Change) -> None:
        now = change.now()
        current = now.read(ATTEMPTS).where("terminal_at IS NULL").select("stage_execution_id", F.col("attempt_number").alias("current_attempt"), "attempt", "workflow_id")
        admitted = now.read(STAGES).where("state = 'admitted'").select("stage_execution_id", "current_attempt").join(current, ["stage_execution_id", "current_attempt"])
        swept = materialize(recovery.sweep_live(admitted, feed, live).where("reason IS NOT NULL"), "swept")
        change.update(STAGES, swept.select("stage_execution_id", F.col("new_state").alias("state"), F.lit("admitted").alias("expected_state"), F.col("current_attempt").alias("expected_current_attempt")), guard=["state", "current_attempt"])
        change.update(ATTEMPTS, swept.select("attempt", "stage_execution_id", at.alias("terminal_at")), key="attempt")

    return run


def barrier_tick(declared: DataFrame, at: Column, batch: int = 10_000, budget: int = 100_000) -> Callable[[Change], None]:
    """Releases runs that have settled; each is sent once, as a released run is no candidate any more."""

    def run(change: Change) -> None:
        now = change.now()
        done = completion.barrier_pass(now.read(RUNS), now.read(MEMBERS), now.read(STAGES), declared, None, at, batch, budget)
        change.update(RUNS, done.runs.select("run_key", "released_at"))
        _send(change, "barrier", done.outbox)

    return run
