"""Outcomes of stages applied as a batch: what they change, which stages follow, and which are turned away."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import apart, few, materialize, narrow
from .changes import STAGE


@dataclass
class Applied:
    """``kinds``: a row per outcome with ``kind`` and ``reason``. ``executions``, ``attempts``: updates. ``successors``: rows to add. ``priorities``: updates of replayed successors."""

    kinds: DataFrame
    executions: DataFrame
    attempts: DataFrame
    successors: DataFrame
    priorities: DataFrame


def terminal_summary(outcome: Column, producer: Column | None = None, **more: Column) -> Column:
    """The summary of an ended attempt as JSON: outcome, producer, then error_type, message, dbos_status, reason, traceback; nulls are left out."""
    names = ("error_type", "message", "dbos_status", "reason", "traceback")
    fields = [outcome.alias("outcome"), *([] if producer is None else [producer.alias("producer")]), *[more[k].alias(k) for k in names if k in more]]
    return F.to_json(F.struct(*fields))


def linear_successors(outcomes: DataFrame, located: DataFrame, declared: DataFrame) -> DataFrame:
    """For successes whose result is a plain reference (``linear``): the next declared stage, at the next index, with the output as its input."""
    order = Window.partitionBy("pipeline_key", "pipeline_version").orderBy("position")
    following = narrow(declared.select(*STAGE, F.lead("stage_key").over(order).alias("next_key")))
    rows = outcomes.where("linear AND succeeded").select("workflow_id", "output_reference").join(apart(located.select("workflow_id", *STAGE, "stage_index")), "workflow_id")
    rows = rows.join(following, STAGE).where("next_key IS NOT NULL")
    return rows.select("workflow_id", F.col("next_key").alias("stage_key"), (F.col("stage_index") + 1).alias("stage_index"), F.col("output_reference").alias("input_reference"), F.lit(False).alias("barrier"))


def apply_outcomes(outcomes: DataFrame, attempts: DataFrame, executions: DataFrame, items: DataFrame, runs: DataFrame, declared: DataFrame) -> Applied:
    """Judge each outcome, the first rule that holds giving its kind and reason; only those to apply change anything.

    unknown: no such workflow. mismatch: another pipeline, version, stage key or index than expected, or not the current
    admitted attempt. ignored: cancelled meanwhile. rejected: a success without output or with evidence, a failure with an output or
    successors, an attempt that has ended, a time before the last change, a successor at no higher index, at an index twice or
    of a stage that is not declared. conflict: a successor's place is held by a stage with other facts (key, rank, barrier, or
    a given input). A place held by an equal one is a replay, whose priority follows the item's.
    Of several outcomes for one workflow the earliest is judged and the others are rejected as repeated.
    Few outcomes are looked up in the ledger's tables; of many, no side of a join goes through the driver.
    """
    origin = runs.select(F.col("run_key").alias("origin_run_key"), "pipeline_key", "pipeline_version")
    owner = items.select("work_item_id", "origin_run_key", F.col("rank").alias("item_rank"), F.col("priority").alias("item_priority"))
    stage = executions.select("stage_execution_id", "work_item_id", "stage_key", "stage_index", "state", "current_attempt", "updated_at")
    at = attempts.select("workflow_id", "stage_execution_id", "attempt_number", F.col("terminal_at").alias("ended_at"))
    # only attempts that an outcome names take part in the joins that follow
    ids = outcomes.select("workflow_id")
    named = at.join(F.broadcast(ids) if few(ids) else apart(ids), "workflow_id", "left_semi")
    found = named.join(apart(stage), "stage_execution_id").join(apart(owner), "work_item_id").join(F.broadcast(origin) if few(origin) else apart(origin), "origin_run_key").drop("origin_run_key")
    nth = F.row_number().over(Window.partitionBy("workflow_id").orderBy("completed_at", F.to_json(F.struct(*[F.col(c) for c in outcomes.columns if c != "successors"]))))
    located = materialize(outcomes.withColumn("nth", nth).join(apart(found), "workflow_id", "left"), "located-outcomes")
    explicit = outcomes.select("workflow_id", F.explode("successors").alias("s")).select("workflow_id", "s.*")
    following = explicit.unionByName(linear_successors(outcomes, located.where("nth = 1"), declared))
    facts = located.where("nth = 1").select("workflow_id", "work_item_id", F.col("stage_index").alias("own_index"), "pipeline_key", "pipeline_version", "item_rank", "item_priority", "completed_at")
    known = narrow(declared.select(*STAGE, F.lit(True).alias("declared")))
    place = executions.select("work_item_id", "stage_index", F.col("stage_execution_id").alias("old_id"), F.struct("stage_key", "rank", "barrier").alias("old"), F.col("input_reference").alias("old_input"), F.col("priority").alias("old_priority"))
    wanted = following.join(apart(facts), "workflow_id").join(known, STAGE, "left").join(apart(place), ["work_item_id", "stage_index"], "left")
    wanted = wanted.withColumn("times", F.count("*").over(Window.partitionBy("workflow_id", "stage_index")))
    same = F.col("old").eqNullSafe(F.struct(F.col("stage_key"), F.col("item_rank").alias("rank"), F.col("barrier"))) & (F.col("input_reference").isNull() | F.col("old_input").eqNullSafe(F.col("input_reference")))
    wrong = F.when(F.col("stage_index") <= F.col("own_index"), 1).when(F.col("times") > 1, 2).when(F.col("declared").isNull(), 3).when(F.col("old_id").isNotNull() & ~same, 4)
    judged = materialize(wanted.withColumn("wrong", wrong), "judged-successors")
    by_outcome = judged.groupBy("workflow_id").agg(F.min("wrong").alias("wrong"), F.count("*").alias("n_successors"))
    rows = located.join(apart(by_outcome), "workflow_id", "left")
    identity = [("expected_pipeline_key", "pipeline_key"), ("expected_pipeline_version", "pipeline_version"), ("expected_stage_key", "stage_key"), ("expected_stage_index", "stage_index")]
    differs = F.lit(False)
    for said, is_ in identity:
        if said in outcomes.columns:
            differs = differs | ~F.col(said).eqNullSafe(F.col(is_))
    current = F.col("attempt_number") == F.col("current_attempt")
    names = F.array(F.lit("successor_index"), F.lit("successor_twice"), F.lit("successor_not_declared"))
    why = (
        F.when(F.col("stage_execution_id").isNull(), "unknown").when(F.col("nth") > 1, "repeated").when(differs, "identity").when(current & (F.col("state") == "cancelled"), "cancelled")
        .when(~current | (F.col("state") != "admitted"), "not_current").when(F.col("succeeded") & (F.coalesce("output_reference", F.lit("")) == ""), "no_output")
        .when(F.col("succeeded") & F.col("evidence_reference").isNotNull(), "evidence_of_success").when(~F.col("succeeded") & F.col("output_reference").isNotNull(), "output_of_failure")
        .when(~F.col("succeeded") & (F.coalesce("n_successors", F.lit(0)) > 0), "successors_of_failure").when(F.col("ended_at").isNotNull(), "ended_before")
        .when(F.col("completed_at") < F.col("updated_at"), "time_goes_back").when(F.col("wrong") == 4, "successor_conflict").when(F.col("wrong").isNotNull(), F.get(names, F.col("wrong") - 1))
    )
    kind = (
        F.when(why == "unknown", "unknown").when(why.isin("identity", "not_current"), "mismatch").when(why == "cancelled", "ignored").when(why == "successor_conflict", "conflict")
        .when(why.isNotNull(), "rejected").otherwise("apply")
    )
    kinds = materialize(rows.withColumn("reason", why).withColumn("kind", kind), "outcome-kinds")
    done = kinds.where("kind = 'apply'")
    state = F.when(F.col("succeeded"), "succeeded").otherwise("failed")
    changes = done.select("stage_execution_id", state.alias("state"), F.when(F.col("succeeded"), F.col("output_reference")).alias("output_reference"), F.col("completed_at").alias("updated_at"), F.lit("admitted").alias("expected"))
    summary = F.when(F.col("succeeded"), terminal_summary(F.lit("succeeded"))).otherwise(terminal_summary(F.lit("failed"), F.lit("application_failure"), error_type=F.col("error_type"), message=F.col("message")))
    ends = done.select("stage_execution_id", "attempt_number", F.col("completed_at").alias("terminal_at"), summary.alias("terminal_summary"), F.col("evidence_reference"))
    good = judged.join(apart(done.select("workflow_id")), "workflow_id", "left_semi")
    new = good.where("old_id IS NULL").select(
        "work_item_id", "stage_key", "stage_index", F.lit("ready").alias("state"), F.lit(0).alias("current_attempt"), F.col("item_rank").alias("rank"), F.col("item_priority").alias("priority"),
        "input_reference", "barrier", F.col("completed_at").alias("created_at"),
    )
    moved = good.where("old_id IS NOT NULL AND old_priority <> item_priority").select(F.col("old_id").alias("stage_execution_id"), F.col("item_priority").alias("priority"), F.col("completed_at").alias("updated_at"))
    return Applied(kinds.select("workflow_id", "stage_execution_id", "kind", "reason"), changes, ends, new, moved)
