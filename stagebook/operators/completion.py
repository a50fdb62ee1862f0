"""The barrier pass: runs that have settled are released, with what changes and what is sent; attempts of run completions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import completion_workflow_id
from ..sources.shared import materialize, narrow
from .changes import eligible_runs, terminal_counts
from .status import work_item_status

# Final states in their order.
FINAL = ("succeeded", "failed", "cancelled")


@dataclass
class Barrier:
    """``runs``: releases as updates. ``executions``, ``attempts``: rows to add. ``outbox``: what to send. ``failures``: runs with a reason. ``summary``: one row."""

    runs: DataFrame
    executions: DataFrame
    attempts: DataFrame
    outbox: DataFrame
    failures: DataFrame
    summary: DataFrame


def frozen_counts() -> Column:
    """Counts of members by final state, in the fixed order of states."""
    return F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).cast("int").alias("count")) for s in FINAL])


def barrier_pass(runs: DataFrame, memberships: DataFrame, executions: DataFrame, declared: DataFrame, cursor: str | None, at: Column, batch: int = 10_000, budget: int = 100_000) -> Barrier:
    """One pass over the settled runs after the cursor, around the end, until ``batch`` are released or ``budget`` were looked at.

    A run whose counts do not add up to its members, or whose completion is not the declared one, is a failure: it uses the
    budget and not the batch. The last run looked at is the new cursor. At most ``budget`` rows, the feature's own limit, are
    numbered in one task.
    """
    eligible = eligible_runs(runs, memberships, executions)
    turn = F.lit(False) if cursor is None else F.col("run_key") <= F.lit(cursor)
    page = materialize(eligible.withColumn("turn", turn).orderBy("turn", "run_key").limit(budget), "barrier-page")
    keys = narrow(page.select("run_key"))
    own = memberships.join(keys, "run_key", "left_semi")
    status = work_item_status(executions.join(own.select("work_item_id"), "work_item_id", "left_semi"))
    counted = terminal_counts(page, own, status)
    completions = narrow(declared.groupBy("pipeline_key", "pipeline_version").agg(F.first("run_completion_key").alias("declared_key")))
    judged = counted.join(completions, ["pipeline_key", "pipeline_version"], "left")
    covered = F.col("succeeded") + F.col("failed") + F.col("cancelled") == F.col("expected_member_count")
    judged = judged.withColumn("reason", F.when(~covered, "not_covered").when(~F.col("declared_key").eqNullSafe(F.col("run_completion_key")), "completion_differs"))
    before = Window.orderBy("turn", "run_key").rowsBetween(Window.unboundedPreceding, -1)
    seen = judged.withColumn("released_before", F.coalesce(F.count_if(F.col("reason").isNull()).over(before), F.lit(0))).where(F.col("released_before") < batch)
    seen = materialize(seen, "barrier-seen")
    good = seen.where("reason IS NULL").withColumn("counts", frozen_counts()).withColumn("workflow_id", completion_workflow_id("run_key", "pipeline_key", "pipeline_version", "run_completion_key", F.lit(1)))
    payload = F.to_json(F.struct(
        "campaign_key", "run_key", "pipeline_key", "pipeline_version", "execution_config_reference", "manifest_reference", "membership_digest",
        F.col("expected_member_count").alias("member_count"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("released_at"), F.col("counts").alias("release_terminal_state_counts"),
    ))
    released = good.select("run_key", at.alias("released_at"), F.col("counts").alias("release_terminal_state_counts"))
    new = good.select("run_key", F.lit(1).alias("current_attempt"), F.lit("enqueued").alias("state"), at.alias("enqueued_at"))
    attempts = good.select("run_key", F.lit(1).alias("attempt_number"), "workflow_id", at.alias("created_at"), at.alias("enqueued_at"))
    outbox = good.select("run_key", "workflow_id", payload.alias("payload"))
    last = F.max_by("run_key", F.struct("turn", "run_key")).alias("last_run_key")
    summary = seen.agg(F.count("*").alias("examined"), F.count_if(F.col("reason").isNull()).alias("released"), F.count_if(F.col("reason").isNotNull()).alias("failed"), last)
    summary = summary.withColumn("last_run_key", F.coalesce("last_run_key", F.lit(cursor).cast("string")))
    return Barrier(released, new, attempts, outbox, seen.where("reason IS NOT NULL").select("run_key", "reason"), summary)


def payload_problems(payloads: DataFrame) -> DataFrame:
    """Completion payloads that may not be sent: ``run_key`` and the first rule that fails (states in their order, counts not negative and adding up, references given)."""
    counts = F.col("release_terminal_state_counts")
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["count"])
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    reason = (
        F.when(F.transform(counts, lambda x: x["state"]) != F.array(*map(F.lit, FINAL)), "order_of_states").when(F.exists(counts, lambda x: x["count"] < 0), "negative_count")
        .when(total != F.col("member_count"), "sum_of_counts").when(~(given("execution_config_reference") & given("manifest_reference") & given("membership_digest")), "missing_reference")
        .when(F.col("pipeline_version") <= 0, "version")
    )
    return payloads.withColumn("reason", reason).where("reason IS NOT NULL").select("run_key", "reason")


def retry_completions(wanted: DataFrame, runs: DataFrame, executions: DataFrame, attempts: DataFrame, at: Column) -> DataFrame:
    """Requested runs: ``disposition`` (retry, unknown, not_failed, open_attempt, time_goes_back), and where to retry the next attempt and its workflow.

    Only a failed completion whose current attempt has ended, no later than ``at``, is enqueued again.
    """
    facts = runs.select("run_key", "pipeline_key", "pipeline_version", "run_completion_key")
    ends = attempts.select("run_completion_execution_id", F.col("attempt_number").alias("current_attempt"), F.col("terminal_at").alias("ended_at"))
    rows = wanted.select("run_key").dropDuplicates().join(executions.select("run_completion_execution_id", "run_key", "state", "current_attempt"), "run_key", "left")
    rows = rows.join(ends, ["run_completion_execution_id", "current_attempt"], "left").join(facts, "run_key", "left").withColumn("at", at)
    disposition = (
        F.when(F.col("state").isNull(), "unknown").when(F.col("state") != "failed", "not_failed").when(F.col("ended_at").isNull(), "open_attempt").when(F.col("at") < F.col("ended_at"), "time_goes_back").otherwise("retry")
    )
    rows = rows.withColumn("disposition", disposition)
    number = F.when(F.col("disposition") == "retry", F.col("current_attempt") + 1)
    rows = rows.withColumn("attempt_number", number)
    return rows.select("run_key", "disposition", "attempt_number", F.when(number.isNotNull(), completion_workflow_id("run_key", "pipeline_key", "pipeline_version", "run_completion_key", "attempt_number")).alias("workflow_id"))
