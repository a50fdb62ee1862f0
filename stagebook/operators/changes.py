"""Decisions over whole tables: admission, registration, outcomes, completion, recovery, integrity. Each returns rows to apply."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import blank_as_absent, contains, may_move, stable_rank
from ..sources.shared import narrow
from .status import barrier_gate

STAGE = ["pipeline_key", "pipeline_version", "stage_key"]


# ---------------------------------------------------------------- admission


def admission_rows(executions: DataFrame, items: DataFrame, runs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Executions with labels, priority, rank and stage identity (of the item's origin run); ``only``: those of few ``stage_execution_id, work_item_id``."""
    if only is not None:
        executions = executions.join(F.broadcast(only.select("stage_execution_id")), "stage_execution_id", "left_semi")
        items = items.join(F.broadcast(only.select("work_item_id")), "work_item_id", "left_semi")
    origin = runs.select(F.col("run_key").alias("origin_run_key"), "pipeline_key", "pipeline_version")
    facts = ["work_item_id", "origin_run_key", "campaign_key", "work_key", "labels", "priority", *(["rank"] if "rank" in items.columns else [])]
    rows = executions.drop("rank", "priority").join(items.select(*facts, F.col("input_reference").alias("item_input")), "work_item_id")
    return rows.join(origin, "origin_run_key")


def control_occupancy(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Admitted rows per control, zero included."""
    wide = narrow(controls.select("stage_control_id", *STAGE, "selector"))
    counts = rows.where("state = 'admitted'").join(wide, STAGE).where(contains("labels", "selector")).groupBy("stage_control_id").agg(F.count("*").alias("occupied"))
    return controls.join(counts, "stage_control_id", "left").withColumn("occupied", F.coalesce("occupied", F.lit(0)))


def ready_candidates(executions: DataFrame, rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Ready rows of configured stages that no lower stage and no pause holds back."""
    gate = barrier_gate(executions).where("state = 'ready' AND NOT (barrier AND blocked)").select("stage_execution_id")
    configured = narrow(controls.where(F.size("selector") == 0).select(*STAGE).distinct())
    paused = narrow(controls.where("paused").select(*STAGE, "selector"))
    ready = rows.where("state = 'ready'").join(configured, STAGE, "left_semi").join(gate, "stage_execution_id", "left_semi")
    same = [F.col(f"r.{k}") == F.col(f"p.{k}") for k in STAGE]
    return ready.alias("r").join(paused.alias("p"), [*same, contains("r.labels", "p.selector")], "left_anti")


def plan_admission(candidates: DataFrame, occupancy: DataFrame, batch: int = 10_000, salts: int = 64) -> DataFrame:
    """The candidates to admit, in order of priority, rank and id, under all matching controls.

    Rows with the same set of matching controls are admitted as a prefix of their order, so at most the smallest free
    capacity of each set (and ``batch``) can matter. A window keeps so many first of each of ``salts`` parts of a set, so that
    no task sorts a whole backlog, a second one of each set; the sequential rule runs on what is left for each stage, whose
    size depends on capacities and ``batch`` alone.
    """
    some = F.struct("stage_control_id", F.greatest(F.col("capacity") - F.col("occupied"), F.lit(0)).cast("long").alias("free"), "selector")
    controls = narrow(occupancy.groupBy(*STAGE).agg(F.sort_array(F.transform(F.collect_list(some), lambda x: F.struct(x["stage_control_id"], x["free"], F.to_json(x["selector"]).alias("text")))).alias("all")))
    held = F.filter("all", lambda x: contains(F.col("labels"), F.from_json(x["text"], "map<string,string>")))
    matched = candidates.join(controls, STAGE).withColumn("controls", F.transform(held, lambda x: F.struct(x["stage_control_id"], x["free"])))
    # a row that no control matches has no room
    room = F.least(F.array_min(F.transform("controls", lambda x: x["free"])), F.lit(batch).cast("long"))
    matched = matched.select("stage_execution_id", *STAGE, "priority", "rank", "controls", room.alias("room"), F.to_json("controls").alias("signature"))
    order = ["priority", "rank", "stage_execution_id"]
    parts = Window.partitionBy(*STAGE, "signature", "salt").orderBy(*order)
    salted = matched.withColumn("salt", F.pmod(F.xxhash64("stage_execution_id"), F.lit(salts)))
    first = salted.withColumn("nth", F.row_number().over(parts)).where(F.col("nth") <= F.col("room")).drop("salt", "nth")
    kept = first.withColumn("nth", F.row_number().over(Window.partitionBy(*STAGE, "signature").orderBy(*order))).where(F.col("nth") <= F.col("room"))
    flat = kept.select("stage_execution_id", *STAGE, "priority", "rank", F.transform("controls", lambda x: x["stage_control_id"]).alias("ids"), F.transform("controls", lambda x: x["free"]).alias("free"))

    def admit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["priority", "rank", "stage_execution_id"])
        left: dict[int, int] = {}
        taken = []
        for i, (ids, free) in enumerate(zip(rows["ids"], rows["free"], strict=True)):
            for k, n in zip(ids, free, strict=True):
                left.setdefault(k, n)
            if all(left[k] > 0 for k in ids):
                for k in ids:
                    left[k] -= 1
                taken.append(i)
        return rows.iloc[taken][["stage_execution_id", *STAGE, "priority", "rank"]]

    schema = "stage_execution_id long, pipeline_key string, pipeline_version int, stage_key string, priority int, rank long"
    return flat.groupBy(*STAGE).applyInPandas(admit, schema).orderBy("priority", "rank", "stage_execution_id").limit(batch)


def attempts_to_admit(planned: DataFrame, executions: DataFrame, attempts: DataFrame) -> DataFrame:
    """The attempt number of each planned row: its current attempt if that is prepared (neither admitted nor terminal), else the next one."""
    held = attempts.select("stage_execution_id", F.col("attempt_number").alias("current_attempt"), (F.col("admitted_at").isNull() & F.col("terminal_at").isNull()).alias("prepared"))
    rows = planned.select("stage_execution_id").join(executions.select("stage_execution_id", "current_attempt"), "stage_execution_id").join(held, ["stage_execution_id", "current_attempt"], "left")
    return rows.select("stage_execution_id", F.when(F.col("prepared"), F.col("current_attempt")).otherwise(F.col("current_attempt") + 1).alias("attempt_number"))


# ---------------------------------------------------------------- registration


def classify_members(members: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """Each member as new, conflict, priority_change or same.

    A known item is a conflict if its input, labels or rank differ from the member's, or if its origin run has another pipeline,
    version or execution config than the submitting run; nulls are compared as values. Members may bring their run's ``provenance``.
    """
    entries = lambda labels: F.array_sort(F.map_entries(labels))
    provenance = F.struct("pipeline_key", "pipeline_version", "execution_config_reference")
    origin = runs.select(F.col("run_key").alias("origin_run_key"), provenance.alias("old_provenance"))
    held = items.select("campaign_key", "work_key", "work_item_id", "origin_run_key", F.col("input_reference").alias("old_input"), F.col("labels").alias("old_labels"), F.col("rank").alias("old_rank"), F.col("priority").alias("old_priority"))
    known = held.join(origin, "origin_run_key", "left").withColumnRenamed("origin_run_key", "old_origin")
    rows = members.join(known, ["campaign_key", "work_key"], "left")
    if "provenance" not in members.columns:
        rows = rows.join(runs.select("run_key", provenance.alias("provenance")), "run_key", "left")
    facts = F.col("old_input").eqNullSafe(F.col("input_reference")) & entries("old_labels").eqNullSafe(entries("labels")) & F.col("old_rank").eqNullSafe(stable_rank("campaign_key", "work_key"))
    equal = facts & F.col("old_provenance").eqNullSafe(F.col("provenance"))
    kind = F.when(F.col("work_item_id").isNull(), "new").when(~equal, "conflict").when(~F.col("old_priority").eqNullSafe(F.col("priority")), "priority_change").otherwise("same")
    return rows.withColumn("kind", kind).drop("provenance", "old_provenance")


def closure_check(runs: DataFrame, memberships: DataFrame, items: DataFrame) -> DataFrame:
    """Per run: members, whether ordinals run from 0 without gaps, whether the count is as expected, created and reused items.

    Memberships may bring the ``origin_run_key`` of their items, which are there then.
    """
    if "origin_run_key" not in memberships.columns:
        memberships = memberships.join(items.select("work_item_id", "origin_run_key"), "work_item_id")
    n = memberships.groupBy("run_key").agg(F.count("*").alias("members"), F.min("member_ordinal").alias("low"), F.max("member_ordinal").alias("high"), F.countDistinct("member_ordinal").alias("ordinals"), F.count_if(F.col("origin_run_key") == F.col("run_key")).alias("created"))
    rows = runs.select("run_key", "expected_member_count").join(n, "run_key", "left")
    members = F.coalesce("members", F.lit(0))
    gapless = (members == 0) | ((F.col("low") == 0) & (F.col("high") == members - 1) & (F.col("ordinals") == members))
    return rows.select("run_key", members.alias("members"), gapless.alias("contiguous"), (members == F.col("expected_member_count")).alias("complete"), F.coalesce("created", F.lit(0)).alias("created"), (members - F.coalesce("created", F.lit(0))).alias("reused"))


# ---------------------------------------------------------------- outcomes


def fanout_problems(successors: DataFrame, eval_key: str, fanin_key: str) -> DataFrame:
    """Per origin (``origin_id, origin_index``) the first thing wrong with its successors as rows to evaluate plus one fan-in; null if all is well."""
    if eval_key == fanin_key:
        raise ValueError("rows to evaluate and the fan-in need different stage keys")
    row, fanin = F.col("stage_key") == eval_key, F.col("stage_key") == fanin_key
    n = successors.groupBy("origin_id", "origin_index").agg(
        F.count_if(~row & ~fanin).alias("foreign"), F.count_if(row).alias("rows"), F.count_if(fanin).alias("fanins"),
        F.max(F.when(fanin, F.col("barrier"))).alias("fanin_waits"), F.max(F.when(row, F.col("barrier"))).alias("row_waits"), F.max(F.when(fanin, F.col("stage_index"))).alias("fanin_index"),
        F.min(F.when(row, F.col("stage_index"))).alias("low"), F.max(F.when(row, F.col("stage_index"))).alias("high"), F.countDistinct(F.when(row, F.col("stage_index"))).alias("places"),
    )
    gapless = (F.col("low") == F.col("origin_index") + 1) & (F.col("high") == F.col("origin_index") + F.col("rows")) & (F.col("places") == F.col("rows"))
    problem = (
        F.when(F.col("foreign") > 0, "foreign_stage").when(F.col("rows") == 0, "no_rows").when(F.col("fanins") != 1, "not_one_fanin").when(~F.col("fanin_waits"), "fanin_without_barrier")
        .when(F.col("row_waits"), "row_with_barrier").when(~gapless, "gap").when(F.col("fanin_index") != F.col("high") + 1, "fanin_misplaced")
    )
    return n.select("origin_id", "rows", problem.alias("problem"))


def route_problems(routes: DataFrame) -> DataFrame:
    """What is wrong with routes by label (stage identity, ``ordinal, selector, queue_name``): ``ordinal, other, problem``.

    A selector must not be empty, queues of a stage differ, and two selectors must not agree on all the labels that both name
    (selectors without a common label may stand side by side). Pairs are found by a label and value that both have.
    """
    empty = routes.where(F.size("selector") == 0).select(*STAGE, "ordinal", F.lit(None).cast("int").alias("other"), F.lit("empty_selector").alias("problem"))
    later = lambda rows: rows.select(*STAGE, F.col("ordinal").alias("other"), *[F.col(c).alias(f"other_{c}") for c in rows.columns if c not in (*STAGE, "ordinal")])
    queues = routes.select(*STAGE, "ordinal", "queue_name")
    same = queues.join(later(queues), STAGE).where("ordinal < other AND queue_name = other_queue_name").select(*STAGE, "ordinal", "other", F.lit("repeated_queue").alias("problem"))
    entries = routes.select(*STAGE, "ordinal", "selector", F.explode(F.map_entries("selector")).alias("entry"))
    both = entries.alias("a").join(later(entries).alias("b"), STAGE).where("ordinal < other AND entry = other_entry")
    agree = F.forall(F.map_entries("selector"), lambda e: F.coalesce(F.col("other_selector")[e["key"]] == e["value"], F.lit(True)))
    overlap = both.where(agree).select(*STAGE, "ordinal", "other", F.lit("overlap").alias("problem")).distinct()
    return empty.unionByName(same).unionByName(overlap)


def illegal_moves(changes: DataFrame) -> DataFrame:
    """Rows (old state, new state) that the table of moves does not have."""
    return changes.where(~may_move("old_state", "new_state"))


# ---------------------------------------------------------------- completion


def terminal_counts(runs: DataFrame, memberships: DataFrame, status: DataFrame) -> DataFrame:
    """Per run: members by final state, zeros included."""
    n = memberships.join(status, "work_item_id").groupBy("run_key").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("succeeded", "failed", "cancelled")])
    return runs.join(n, "run_key", "left").select(*runs.columns, *[F.coalesce(s, F.lit(0)).alias(s) for s in ("succeeded", "failed", "cancelled")])


def eligible_runs(runs: DataFrame, memberships: DataFrame, executions: DataFrame) -> DataFrame:
    """Closed runs with a completion that are not released and have no ready or admitted member stage."""
    waiting = runs.where("registration_closed_at IS NOT NULL AND run_completion_key IS NOT NULL AND released_at IS NULL")
    open_items = executions.where("state IN ('ready', 'admitted')").select("work_item_id").distinct()
    blocked = memberships.join(open_items, "work_item_id", "left_semi").select("run_key").distinct()
    return waiting.join(blocked, "run_key", "left_anti")


def releases(eligible: DataFrame, memberships: DataFrame, status: DataFrame) -> DataFrame:
    """Eligible runs with their counts; ``covered`` says whether these add up to the expected members (else a failure)."""
    return terminal_counts(eligible, memberships, status).withColumn("covered", F.col("succeeded") + F.col("failed") + F.col("cancelled") == F.col("expected_member_count"))


def classify_completion_outcomes(outcomes: DataFrame, attempts: DataFrame, executions: DataFrame) -> DataFrame:
    """Each completion outcome as unknown, stale (not the current attempt), replay or conflict (an outcome is there already), rejected or apply.

    A success needs an output reference, a failure an error (canonical JSON) and no reference. ``new_state`` is set where to apply.
    """
    at = attempts.select("workflow_id", "run_completion_execution_id", "attempt_number")
    held = executions.select("run_completion_execution_id", "run_key", "current_attempt", "state", F.col("output_reference").alias("old_reference"), F.col("error_summary").alias("old_error"))
    rows = outcomes.join(at, "workflow_id", "left").join(held, "run_completion_execution_id", "left")
    said = F.when(F.col("succeeded"), "succeeded").otherwise("failed")
    equal = (F.col("state") == said) & F.col("old_reference").eqNullSafe(F.col("output_reference")) & (F.coalesce("old_error", F.lit("{}")) == F.coalesce("error_summary", F.lit("{}")))
    valid = F.when(F.col("succeeded"), blank_as_absent("output_reference").isNotNull()).otherwise(F.col("output_reference").isNull() & F.col("error_summary").isNotNull())
    kind = (
        F.when(F.col("attempt_number").isNull() | F.col("current_attempt").isNull(), "unknown")
        .when(F.col("attempt_number") != F.col("current_attempt"), "stale")
        .when(F.col("state") != "enqueued", F.when(equal, "replay").otherwise("conflict"))
        .when(~valid, "rejected")
        .otherwise("apply")
    )
    return rows.withColumn("kind", kind).withColumn("new_state", F.when(F.col("kind") == "apply", said))


def rotate(runs: DataFrame, cursor: str, budget: int) -> DataFrame:
    """The next ``budget`` candidates after the cursor, around the end."""
    return runs.withColumn("wrapped", F.col("run_key") <= cursor).orderBy("wrapped", "run_key").limit(budget)


# ---------------------------------------------------------------- recovery


def sweep(admitted: DataFrame, workflow_status: DataFrame, live_version: str, live_executors: DataFrame, cancellable: bool = True, suppress_version: bool = False, suppress_executor: bool = False) -> DataFrame:
    """What an external status feed says of current attempts: ``new_state`` and ``reason``, null where nothing is to be done.

    A pending workflow counts as abandoned only with evidence: both identity fields are there, and the version is not the live
    one or the executor does not live; a suppressed kind of evidence is not used. ``live_executors`` is a list of processes.
    """
    live = narrow(live_executors.select(blank_as_absent("executor_id").alias("executor_id"), F.lit(True).alias("alive")).where("executor_id IS NOT NULL").distinct())
    feed = workflow_status.select("workflow_id", "status", blank_as_absent("app_version").alias("version"), blank_as_absent("executor_id").alias("executor_id"))
    rows = admitted.join(feed, "workflow_id", "left").join(live, "executor_id", "left")
    known = F.col("version").isNotNull() & F.col("executor_id").isNotNull()
    stale = F.lit(not suppress_version) & (F.col("version") != live_version)
    evidence = F.when(known & stale, "stale_app_version").when(known & F.lit(not suppress_executor) & F.col("alive").isNull(), "dead_executor")
    broken = F.col("status").isin("ERROR", "MAX_RECOVERY_ATTEMPTS_EXCEEDED")
    reason = F.when(F.lit(cancellable) & (F.col("status") == "CANCELLED"), "workflow_cancelled").when(broken, "workflow_error").when(F.col("status") == "PENDING", evidence)
    state = F.when(reason == "workflow_cancelled", "cancelled").when(reason.isNotNull(), "failed")
    return rows.withColumn("new_state", state).withColumn("reason", reason).drop("alive", "version")


def cancellations(executions: DataFrame, wanted: DataFrame, attempts: DataFrame) -> DataFrame:
    """Open executions of requested items: all become cancelled; admitted ones also name the workflow to cancel."""
    rows = executions.where("state IN ('ready', 'admitted', 'failed')").join(wanted.select("work_item_id").dropDuplicates(), "work_item_id", "left_semi")
    current = attempts.select("stage_execution_id", F.col("attempt_number").alias("current_attempt"), "workflow_id")
    rows = rows.join(current, ["stage_execution_id", "current_attempt"], "left")
    admitted = F.col("state") == "admitted"
    return rows.select("work_item_id", "stage_execution_id", F.when(admitted, "delegated").otherwise("cancelled").alias("disposition"), F.when(admitted, F.col("workflow_id")).alias("delegated_workflow_id"))


def redelegations(executions: DataFrame, wanted: DataFrame, attempts: DataFrame) -> DataFrame:
    """Of requested items with nothing open: the workflow ids of cancelled executions that had been admitted."""
    keys = wanted.select("work_item_id").dropDuplicates()
    scoped = executions.join(keys, "work_item_id", "left_semi")
    open_items = scoped.where("state IN ('ready', 'admitted', 'failed')").select("work_item_id").distinct()
    done = scoped.where("state = 'cancelled'").join(open_items, "work_item_id", "left_anti")
    return done.join(attempts.select("stage_execution_id", F.col("attempt_number").alias("current_attempt"), "workflow_id"), ["stage_execution_id", "current_attempt"]).select("work_item_id", "workflow_id").distinct()


# ---------------------------------------------------------------- integrity and merge


def violations(table: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """A row per broken rule: ``rule, key``; a rule is a SQL condition that must not be false."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(cond), F.lit(True)), F.lit(name)) for name, cond in rules.items()])
    return table.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule")).select("rule", "key")


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def apply_changes(table: DataFrame, key: str | list[str], updates: DataFrame, inserts: DataFrame | None = None, guard: str | list[str] | None = None) -> DataFrame:
    """The next snapshot: updates replace named columns of rows by key, unless a guard column has moved on; inserts of known keys are ignored.

    ``updates`` has the key, new values under the table's names, and for a guard its expected value as ``expected``; for several
    guards as ``expected_`` with the column's name.
    """
    guards = {guard: "expected"} if isinstance(guard, str) else {g: f"expected_{g}" for g in guard or []}
    key = [key] if isinstance(key, str) else key
    changed = [c for c in updates.columns if c not in (*key, "expected", *guards.values())]
    new = updates.select(*key, *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("hit"), *guards.values())
    rows = table.join(new, key, "left")
    ok = F.col("hit")
    for column, expected in guards.items():
        ok = ok & F.col(column).eqNullSafe(F.col(expected))
    out = rows.select(*[F.when(F.coalesce(ok, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns])
    if inserts is not None:
        known = table.select(*key).join(inserts.select(*key), key, "left_semi")
        out = out.unionByName(inserts.dropDuplicates(key).join(known, key, "left_anti").select(*table.columns))
    return out
