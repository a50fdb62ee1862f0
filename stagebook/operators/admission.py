"""The admission pass: which ready rows are admitted, what changes, what is sent, and what was left for which reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import canonical, contains, stage_workflow_id
from ..sources.shared import materialize, narrow
from .changes import STAGE, attempts_to_admit, plan_admission
from .status import barrier_gate


@dataclass
class Pass:
    """``executions``: updates, guarded by ``expected`` state. ``attempts``: attempts to admit. ``outbox``: what to send. ``summary``: a row per stage and reason."""

    executions: DataFrame
    attempts: DataFrame
    outbox: DataFrame
    summary: DataFrame


def queue_of(labels: Column, routes: Column, default: Column) -> Column:
    """The queue of the first route (array of ``ordinal, selector, queue_name``) whose selector the labels hold, else the default."""
    first = F.array_min(F.transform(F.filter(routes, lambda r: contains(labels, r["selector"])), lambda r: F.struct(r["ordinal"], r["queue_name"])))
    return F.coalesce(first["queue_name"], default)


def candidates_by_fate(executions: DataFrame, rows: DataFrame, controls: DataFrame, declared: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Ready rows with the first thing that holds them back, in this order: ``unconfigured`` (the stage has no control for all),
    ``mismatched`` (the stage is not declared), ``paused``, ``barrier`` (a lower stage has not succeeded), else ``candidate``.

    ``excluded`` names stages, or single executions by ``stage_execution_id``, that are left out beforehand.
    """
    ready = rows.where("state = 'ready'")
    if excluded is not None:
        ready = ready.join(narrow(excluded), [c for c in ("stage_execution_id", *STAGE) if c in excluded.columns], "left_anti")
    flag = lambda df, name: narrow(df.select(*STAGE).distinct()).withColumn(name, F.lit(True))
    paused = narrow(controls.where("paused").groupBy(*STAGE).agg(F.collect_list("selector").alias("pauses")))
    gate = barrier_gate(executions).where("state = 'ready' AND barrier AND blocked").select("stage_execution_id", F.lit(True).alias("waits"))
    out = ready.join(flag(controls.where(F.size("selector") == 0), "configured"), STAGE, "left").join(flag(declared, "declared"), STAGE, "left")
    out = out.join(paused, STAGE, "left").join(gate, "stage_execution_id", "left")
    held = F.coalesce(F.exists("pauses", lambda s: contains(F.col("labels"), s)), F.lit(False))
    fate = F.when(F.col("configured").isNull(), "unconfigured").when(F.col("declared").isNull(), "mismatched").when(held, "paused").when(F.col("waits"), "barrier").otherwise("candidate")
    return out.withColumn("fate", fate).drop("configured", "declared", "pauses", "waits")


def admission_pass(executions: DataFrame, rows: DataFrame, occupancy: DataFrame, attempts: DataFrame | Callable[[DataFrame], DataFrame], declared: DataFrame, at: Column, batch: int = 10_000, excluded: DataFrame | None = None, facts: Callable[[DataFrame], DataFrame] | None = None) -> Pass:
    """One pass over all ready rows. ``rows``: executions with labels, rank and stage identity; ``occupancy``: controls with ``occupied``.
    ``facts``: gives the rows of few ``stage_execution_id, work_item_id``, so that those that are not admitted are not shuffled with all that is sent.
    ``attempts`` may likewise give those of few ``stage_execution_id``.

    ``declared`` has the stages with ``queue_name`` and maybe ``routes``. A prepared attempt is admitted itself, else the next
    one. Rows skipped for pause, barrier or capacity are counted up to the last admitted row if the batch is full, else all.
    """
    # what several results follow from is worked out once
    judged = candidates_by_fate(executions, rows, occupancy, declared, excluded)
    if facts is not None:
        judged = judged.select("stage_execution_id", "work_item_id", *STAGE, "labels", "priority", "rank", "fate")
    fates = materialize(judged, "fates")
    able = fates.where("fate = 'candidate'").drop("fate")
    planned = materialize(plan_admission(able, occupancy, batch), "planned")
    if facts is not None:
        few = materialize(able.select("stage_execution_id", "work_item_id").join(F.broadcast(planned.select("stage_execution_id")), "stage_execution_id"), "planned-items")
        able = facts(few)
    order = F.struct("priority", "rank", "stage_execution_id")
    # of the attempts only those of planned rows are looked at
    ids = planned.select("stage_execution_id")
    attempts = attempts(ids) if callable(attempts) else attempts.join(F.broadcast(ids), "stage_execution_id", "left_semi")
    numbered = attempts_to_admit(planned, executions, attempts)
    kept = attempts.select("stage_execution_id", "attempt_number", F.col("workflow_id").alias("old_id"))
    chosen = able.join(planned.select("stage_execution_id"), "stage_execution_id").join(numbered, "stage_execution_id").join(kept, ["stage_execution_id", "attempt_number"], "left")
    new_id = stage_workflow_id("campaign_key", "work_key", "pipeline_key", "pipeline_version", "stage_key", "stage_index", "attempt_number")
    routed = declared.select(*STAGE, "queue_name", *(["routes"] if "routes" in declared.columns else []))
    chosen = chosen.withColumn("workflow_id", F.coalesce("old_id", new_id)).join(narrow(routed), STAGE)
    queue = queue_of(F.col("labels"), F.col("routes"), F.col("queue_name")) if "routes" in declared.columns else F.col("queue_name")
    changes = chosen.select("stage_execution_id", F.lit("admitted").alias("state"), F.col("attempt_number").alias("current_attempt"), at.alias("updated_at"), F.lit("ready").alias("expected"))
    written = chosen.select("stage_execution_id", "attempt_number", "workflow_id", at.alias("admitted_at"), F.col("old_id").isNull().alias("appended"))
    outbox = chosen.select("stage_execution_id", queue.alias("queue_name"), "workflow_id", F.nullif(F.col("priority"), F.lit(0)).alias("priority"), admission_payload().alias("payload"))
    # how far the pass looked: to its last row if the batch is full
    end = planned.agg(F.when(F.count("*") >= batch, F.max(order)).alias("end"))
    seen = fates.join(F.broadcast(end)).where(F.col("end").isNull() | (order <= F.col("end")))
    taken = planned.select("stage_execution_id", F.lit(True).alias("taken"))
    reason = F.when(F.col("taken"), "admitted").when(F.col("fate") == "candidate", "capacity").otherwise(F.col("fate"))
    summary = seen.join(taken, "stage_execution_id", "left").groupBy(*STAGE, reason.alias("reason")).agg(F.count("*").alias("n"))
    return Pass(changes, written, outbox, summary)


#: Candidates that a paged pass may look at beyond those it admits.
WATCHDOG = 1_000_000


class _Walk:
    """The rule of the paged pass over candidates in their order: a page holds as many as may still be admitted; controls that are
    full and stages that are not configured drop out of the pages after the one in which they were met."""

    def __init__(self, batch: int, skips: int) -> None:
        self.batch, self.most = batch, batch + skips
        self.admitted = self.considered = self.left = 0
        self.room: dict[int, int] = {}
        self.full: set[int] = set()
        self.unconfigured: set[tuple] = set()
        self.dropped: tuple[frozenset, frozenset] = (frozenset(), frozenset())

    def over(self) -> bool:
        return self.left == 0 and (self.admitted >= self.batch or self.considered >= self.most)

    def see(self, stage: tuple, configured: bool, declared: bool, blocked: bool, ids: list[int], free: list[int]) -> str | None:
        """What becomes of the next candidate; None: no page holds it."""
        if self.left == 0:  # a new page
            self.left = min(self.batch - self.admitted, self.most - self.considered)
            self.dropped = (frozenset(self.full), frozenset(self.unconfigured))
        full, gone = self.dropped
        if stage in gone or not full.isdisjoint(ids):
            return None
        self.left -= 1
        self.considered += 1
        if not configured:
            self.unconfigured.add(stage)
            return "unconfigured"
        if blocked:
            return "barrier"
        for k, n in zip(ids, free, strict=True):
            self.room.setdefault(k, n)
        if short := [k for k in ids if self.room[k] <= 0]:
            self.full.update(short)
            return "capacity"
        if not declared:
            return "mismatched"
        self.admitted += 1
        for k in ids:
            self.room[k] -= 1
            if self.room[k] <= 0:
                self.full.add(k)
        if self.admitted >= self.batch:
            self.left = 0
        return "admitted"


def paged_pass(executions: DataFrame, rows: DataFrame, occupancy: DataFrame, declared: DataFrame, batch: int = 10_000, skips: int = WATCHDOG, salts: int = 64) -> DataFrame:
    """Every candidate that a pass in pages looks at, with its fate: ``stage_execution_id``, stage identity, ``reason`` (admitted,
    capacity, barrier, mismatched or unconfigured).

    Candidates are ready rows that no pause holds, by priority, rank and id. A page holds as many as may still be admitted;
    within it a row is looked at in this order: its stage has a control for all, no lower stage holds it back, every matching
    control has room, its stage is declared. Rows of full controls and unconfigured stages are left out of later pages and not
    counted. The pass ends when ``batch`` are admitted or ``batch`` + ``skips`` were looked at. As no more than that can be looked
    at of any stage and set of controls, a window keeps so many of each, of ``salts`` parts first; the rule, which is one
    sequence over all stages, then passes over what is left in order, one row at a time and in one task, as the limit bounds it.
    """
    flag = lambda df, name: narrow(df.select(*STAGE).distinct()).withColumn(name, F.lit(True))
    wide = F.struct("stage_control_id", F.greatest(F.col("capacity") - F.col("occupied"), F.lit(0)).cast("long").alias("free"), "paused", F.to_json("selector").alias("text"))
    controls = narrow(occupancy.groupBy(*STAGE).agg(F.sort_array(F.collect_list(wide)).alias("all")))
    gate = barrier_gate(executions).where("state = 'ready' AND barrier AND blocked").select("stage_execution_id", F.lit(True).alias("blocked"))
    out = rows.where("state = 'ready'").join(controls, STAGE, "left").join(gate, "stage_execution_id", "left")
    held = F.filter("all", lambda x: contains(F.col("labels"), F.from_json(x["text"], "map<string,string>")))
    out = out.withColumn("held", F.coalesce(held, F.array().cast("array<struct<stage_control_id:bigint,free:bigint,paused:boolean,text:string>>")))
    out = out.where(~F.exists("held", lambda x: x["paused"]))
    out = out.join(flag(occupancy.where(F.size("selector") == 0), "configured"), STAGE, "left").join(flag(declared, "declared"), STAGE, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    ids = F.transform("held", lambda x: x["stage_control_id"].cast("long")).alias("ids")
    free = F.transform("held", lambda x: x["free"].cast("long")).alias("free")
    flat = out.select("stage_execution_id", *STAGE, "priority", "rank", yes("configured"), yes("declared"), yes("blocked"), ids, free)
    order, most = ["priority", "rank", "stage_execution_id"], batch + skips
    for part in ([F.pmod(F.xxhash64("stage_execution_id"), F.lit(salts))], []):
        w = Window.partitionBy(*STAGE, "ids", "blocked", *part).orderBy(*order)
        flat = flat.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")

    def walk(batches):
        pass_ = _Walk(batch, skips)
        for table in batches:
            if pass_.over():
                return
            keep, reasons = [], []
            columns = [table.column(table.schema.get_field_index(c)).to_pylist() for c in (*STAGE, "configured", "declared", "blocked", "ids", "free")]
            for k, (a, b, c, *facts) in enumerate(zip(*columns, strict=True)):
                if pass_.over():
                    break
                reason = pass_.see((a, b, c), *facts)
                if reason:
                    keep.append(k)
                    reasons.append(reason)
            seen = table.select(["stage_execution_id", *STAGE]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*seen.columns, pa.array(reasons, pa.string())], names=["stage_execution_id", *STAGE, "reason"])

    ordered = flat.repartition(1).sortWithinPartitions(*order)
    return ordered.mapInArrow(walk, "stage_execution_id long, pipeline_key string, pipeline_version int, stage_key string, reason string")


def admission_payload() -> Column:
    """The eleven facts that a stage's workflow is started with, as JSON."""
    return F.to_json(F.struct(
        "campaign_key", "work_key", "work_item_id", "origin_run_key", F.coalesce("input_reference", "item_input").alias("input_reference"), "labels",
        "pipeline_key", "pipeline_version", "stage_key", "stage_index", "attempt_number",
    ))


# ---------------------------------------------------------------- controls


def list_controls(controls: DataFrame, stages: DataFrame, labels: bool = False) -> DataFrame:
    """Controls of the wanted stages; with ``labels`` (a column of ``stages``, which may be every item) those whose selector the labels hold.

    Controls are few, as people set them, so they go to the stages; callers that show them sort by id.
    """
    wanted = stages if labels else stages.distinct()
    found = wanted.join(narrow(controls), STAGE)
    return found.where(contains("labels", "selector")) if labels else found


def control_changes(controls: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next controls, and the changes that were rejected with a ``reason``.

    ``wanted``: stage identity, ``selector``, ``action`` (capacity, pause, resume), ``capacity``, ``updated_at``; one change for a
    control at a time. A capacity is set or added and keeps the pause (a new control is not paused); pause and resume need the
    exact selector and keep the capacity. Capacities are not negative.
    """
    key = [*STAGE, "selector_key"]
    old = controls.withColumn("selector_key", canonical("selector"))
    new = wanted.withColumn("selector_key", canonical("selector"))
    repeated = narrow(new.groupBy(*key).agg(F.count("*").alias("times")))
    known = old.select(*key, F.lit(True).alias("known"))
    new = new.join(repeated, key).join(narrow(known), key, "left")
    capacity = F.col("action") == "capacity"
    reason = (
        F.when(~F.col("action").isin("capacity", "pause", "resume"), "unknown_action").when(F.col("times") > 1, "repeated")
        .when(capacity & (F.col("capacity").isNull() | (F.col("capacity") < 0)), "bad_capacity").when(~capacity & F.col("known").isNull(), "absent")
    )
    judged = new.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(*key, "action", F.col("capacity").alias("new_capacity"), F.col("updated_at").alias("new_at"))
    paused = F.when(F.col("action") == "pause", True).when(F.col("action") == "resume", False).otherwise(F.col("paused"))
    held = old.join(narrow(good), key, "left")
    kept = held.select(
        "stage_control_id", *STAGE, "selector", F.when(F.col("action") == "capacity", F.col("new_capacity")).otherwise(F.col("capacity")).cast("int").alias("capacity"), paused.alias("paused"),
        F.coalesce("new_at", "updated_at").alias("updated_at"),
    )
    added = judged.where("reason IS NULL AND known IS NULL")
    # new ids follow the greatest in the order of the controls' keys; controls are few, as people set them
    top = controls.agg(F.coalesce(F.max("stage_control_id"), F.lit(0)).alias("top"))
    nth = F.row_number().over(Window.orderBy(*key))
    added = added.withColumn("nth", nth).join(F.broadcast(top)).select((F.col("top") + F.col("nth")).cast("long").alias("stage_control_id"), *STAGE, "selector", F.col("capacity").cast("int").alias("capacity"), F.lit(False).alias("paused"), "updated_at")
    return kept.withColumn("stage_control_id", F.col("stage_control_id").cast("long")).unionByName(added), judged.where("reason IS NOT NULL").select(*STAGE, "selector_key", "action", "reason")
