"""Recovery: who is alive, what an external feed says of open work, retries, and priorities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import blank_as_absent, not_before, valid_priority
from ..sources.shared import materialize, parts
from .changes import sweep

# Fixed value: the name of a process that runs alone.
LOCAL = "local"


@dataclass
class Live:
    """``executors``: ids of live processes. A suppressed kind of evidence is not used."""

    version: str | None
    executors: DataFrame
    suppress_version: bool
    suppress_executor: bool

    @property
    def unavailable(self) -> bool:
        return self.suppress_version or self.suppress_executor


def live_identity(version: str | None, resolved: DataFrame | None, static: DataFrame, own: DataFrame, failed: bool = False) -> Live:
    """The union of resolved, static and own executor ids (``executor_id``), trimmed, without blanks and repeats.

    Without a version, versions are no evidence. If a resolver failed or found none, its ids are left out and executors are no
    evidence; nor are they where nothing is known but a single process's own name.
    """
    found = lambda df: df.select(blank_as_absent("executor_id").alias("executor_id")).where("executor_id IS NOT NULL")
    known = found(static).unionByName(found(own))
    silent = resolved is not None and (failed or found(resolved).isEmpty())
    if resolved is not None and not silent:
        known = known.unionByName(found(resolved))
    known = known.distinct()
    alone = known.where(F.col("executor_id") != LOCAL).isEmpty()
    version = (version or "").strip() or None
    return Live(version, known, version is None, silent or alone)


def sweep_live(admitted: DataFrame, feed: DataFrame, live: Live, cancellable: bool = True) -> DataFrame:
    """``sweep`` with the evidence that the live identity allows."""
    return sweep(admitted, feed, live.version or "", live.executors, cancellable, live.suppress_version, live.suppress_executor)


def sweep_summary(swept: DataFrame, live: Live) -> DataFrame:
    """One row: how many were inspected and projected, by reason, and whether a part of the identity was unavailable."""
    return swept.agg(
        F.count("*").alias("inspected"), F.count("reason").alias("projected"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("workflow_cancelled", "workflow_error", "stale_app_version", "dead_executor")]
    ).withColumn("identity_unavailable", F.lit(live.unavailable))


def retry_stages(wanted: DataFrame, executions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Requested executions: ``disposition`` retry (with the next attempt), unknown, not_failed, or open_attempt (its current attempt has not ended)."""
    key, current = "stage_execution_id", ["stage_execution_id", "current_attempt"]
    n = parts(wanted.sparkSession, wanted, executions, attempts)
    ends = attempts.where("terminal_at IS NOT NULL").select(key, F.col("attempt_number").alias("current_attempt"), F.lit(True).alias("ended"))
    # only what has failed is asked for its attempt
    failed = executions.where("state = 'failed'").select(*current)
    ended = failed.repartition(n, *current).join(ends.repartition(n, *current), current).select(key, "ended")
    rows = wanted.select(key).repartition(n, key).dropDuplicates().join(executions.select(key, "state", "current_attempt").repartition(n, key), key, "left")
    rows = rows.join(ended.repartition(n, key), key, "left")
    disposition = F.when(F.col("state").isNull(), "unknown").when(F.col("state") != "failed", "not_failed").when(F.col("ended").isNull(), "open_attempt").otherwise("retry")
    return rows.select("stage_execution_id", disposition.alias("disposition"), F.when(disposition == "retry", F.col("current_attempt") + 1).alias("attempt_number"))


@dataclass
class Priorities:
    """Updates of ``items``, ``executions`` and ``workflows`` (admitted ones), and ``rejects`` with a reason."""

    items: DataFrame
    executions: DataFrame
    workflows: DataFrame
    rejects: DataFrame


def set_priorities(wanted: DataFrame, items: DataFrame, executions: DataFrame, attempts: DataFrame, at: Column) -> Priorities:
    """New priorities (``campaign_key, work_key, priority``) of items and their ready, admitted and failed executions.

    A time of change is never before the execution's creation. Unknown items, priorities out of range, and items that are asked for
    several times with other priorities are rejected.
    """
    key = ["campaign_key", "work_key"]
    # one deal by key serves repeats, counts and the join
    n = parts(wanted.sparkSession, wanted, items)
    asked = wanted.select(*key, "priority").repartition(n, *key).distinct().withColumn("times", F.count("*").over(Window.partitionBy(*key)))
    rows = asked.join(items.select(*key, "work_item_id").repartition(n, *key), key, "left")
    reason = F.when(F.col("work_item_id").isNull(), "unknown").when(F.col("times") > 1, "repeated").when(~valid_priority("priority"), "out_of_range")
    judged = rows.withColumn("reason", reason)
    good = materialize(judged.where("reason IS NULL").select("work_item_id", "priority"), "good-priorities")
    n = parts(wanted.sparkSession, good, executions, attempts)
    rows = executions.where("state IN ('ready', 'admitted', 'failed')").drop("priority").repartition(n, "work_item_id")
    open_ = rows.join(good.repartition(n, "work_item_id"), "work_item_id")
    running = ["stage_execution_id", "current_attempt"]
    current = attempts.select("stage_execution_id", F.col("attempt_number").alias("current_attempt"), "workflow_id").repartition(n, *running)
    admitted = open_.where("state = 'admitted'").repartition(n, *running).join(current, running)
    changes = open_.select("stage_execution_id", "priority", not_before(at, "created_at").alias("updated_at"), F.col("state").alias("expected"))
    return Priorities(good, changes, admitted.select("stage_execution_id", "workflow_id", "priority"), judged.where("reason IS NOT NULL").select(*key, "priority", "reason"))
