"""Admission, sweep and barrier committed as one tick over a store; submission as one job; priorities of replayed successors."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from stagebook.operators import integrity, outcomes, recovery, registration, status
from stagebook.sources import schemas, seeders
from stagebook.sources.snapshots import Snapshots
from stagebook.streaming import folds, ticks

DECLARED = "pipeline_key string, pipeline_version int, position int, stage_key string, queue_name string, run_completion_key string"


def at():
    return F.to_timestamp(F.lit("2026-07-17 12:00:00"))


@pytest.fixture()
def ledger(spark, tmp_path):
    day = datetime.datetime(2026, 1, 1)
    runs = spark.createDataFrame([(r, "c", "p", 1, "cfg", n, "m", "d", "fin", day, day, None) for r, n in (("a", 1), ("b", 2))], "run_key string, campaign_key string, pipeline_key string, pipeline_version int, execution_config_reference string, expected_member_count int, manifest_reference string, membership_digest string, run_completion_key string, created_at timestamp, registration_closed_at timestamp, released_at timestamp")
    items = spark.createDataFrame([(i, "c", f"w{i}", "a", f"in:{i}", {"k": "v"}, i, 0) for i in range(1, 5)], "work_item_id long, campaign_key string, work_key string, origin_run_key string, input_reference string, labels map<string,string>, rank long, priority int")
    stages = spark.createDataFrame([(1, 1, "x", 0, "admitted", 1, False), (2, 2, "x", 0, "ready", 0, False), (3, 3, "x", 0, "admitted", 1, False), (4, 4, "x", 0, "ready", 1, False)], "stage_execution_id long, work_item_id long, stage_key string, stage_index int, state string, current_attempt int, barrier boolean").withColumn("input_reference", F.lit(None).cast("string"))
    attempts = spark.createDataFrame([("1#1", 1, 1, "wf1", day, None), ("3#1", 3, 1, "wf3", day, None), ("4#1", 4, 1, "wf4", None, None)], "attempt string, stage_execution_id long, attempt_number int, workflow_id string, admitted_at timestamp, terminal_at timestamp")
    controls = spark.createDataFrame([(1, "p", 1, "x", {}, 4, False)], "stage_control_id long, pipeline_key string, pipeline_version int, stage_key string, selector map<string,string>, capacity int, paused boolean")
    members = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("b", 1, 3)], "run_key string, member_ordinal int, work_item_id long")
    store = Snapshots(spark, str(tmp_path))
    change = store.begin()
    ticks.put(change, {ticks.STAGES: stages, ticks.ATTEMPTS: attempts, ticks.RUNS: runs, ticks.ITEMS: items, ticks.MEMBERS: members, ticks.CONTROLS: controls}, 4)
    change.commit()
    return store


def test_a_tick_admits_sweeps_and_releases_in_one_version(spark, ledger):
    declared = spark.createDataFrame([("p", 1, 0, "x", "queue", "fin")], DECLARED)
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "executor_id string")
    live = recovery.live_identity("v2", ids("e1"), ids(), ids())
    feed = spark.createDataFrame([("wf1", "CANCELLED", "v2", "e1"), ("wf3", "PENDING", "v2", "gone"), ("wf4", "PENDING", "v2", "e1")], "workflow_id string, status string, app_version string, executor_id string")
    passes = ticks.admission_tick(declared, at()), ticks.sweep_tick(feed, live, at()), ticks.barrier_tick(declared, at())
    with pytest.raises(ValueError):
        folds.committed(ledger, *passes, lambda change: (_ for _ in ()).throw(ValueError()))(0)
    assert ledger.numbers() == [1]
    assert [folds.committed(ledger, *passes)(0), folds.committed(ledger, *passes)(0)] == [True, False]
    now = ledger.head()
    assert {r["stage_execution_id"]: (r["state"], r["current_attempt"]) for r in now.read(ticks.STAGES).collect()} == {1: ("cancelled", 1), 2: ("admitted", 1), 3: ("failed", 1), 4: ("admitted", 1)}
    attempts = {r["attempt"]: r for r in now.read(ticks.ATTEMPTS).collect()}
    assert set(attempts) == {"1#1", "2#1", "3#1", "4#1"} and all(attempts[a]["admitted_at"] for a in attempts)
    assert {a for a, r in attempts.items() if r["terminal_at"]} == {"1#1", "3#1"} and attempts["4#1"]["workflow_id"] == "wf4"
    assert {r["run_key"] for r in now.read(ticks.RUNS).where("released_at IS NOT NULL").collect()} == {"a", "b"}
    assert sorted(r["pass"] for r in now.read(ticks.OUTBOX).collect()) == ["admission", "admission", "barrier", "barrier"]
    folds.committed(ledger, *passes)(1)  # nothing is left to do
    assert ledger.head().read(ticks.OUTBOX).count() == 4 and ledger.head().batch == 1


def test_submission_as_one_job(spark):
    entries = ",".join(f'{{"input_reference":"input:{k}","ordinal":{k},"work_key":"work-{k}"}}' for k in range(2))
    digest = hashlib.sha256(f'{{"entries":[{entries}],"expected_member_count":2,"schema":"run-membership/v1"}}'.encode()).hexdigest()
    facts = ", ".join(f"{c} {'int' if c in ('pipeline_version', 'expected_member_count') else 'string'}" for c in registration.PROVENANCE)
    run = lambda key, n, d=None, v=1: (key, "c", "p", v, "cfg", n, "m" if d else None, d, None)
    stored = spark.createDataFrame([(*run("closed", 1), 1, 1, 0), (*run("open", 1), None, None, None), (*run("taken", 1), None, None, None)], f"run_key string, {facts}, registered_member_count int, created_work_count int, reused_work_count int").withColumn("registration_closed_at", F.when(F.col("run_key") == "closed", at()))
    items = spark.createDataFrame([(7, "c", "old", "closed", "in:old", {"a": "b"}, 0)], "work_item_id long, campaign_key string, work_key string, origin_run_key string, input_reference string, labels map<string,string>, priority int")
    from stagebook.functions.expressions import stable_rank

    items = items.withColumn("rank", stable_rank("campaign_key", "work_key"))
    memberships = spark.createDataFrame([("open", 0, 7), ("taken", 0, 99)], "run_key string, member_ordinal int, work_item_id long")
    declarations = spark.createDataFrame([run("pinned", 2, digest), run("other", 2), run("short", 3), run("bad", 1, "x" * 64), run("closed", 5), run("open", 1), run("taken", 1), run("one", 1), run("two", 1), run("wrong", 1, v=0)], f"run_key string, {facts}")
    declarations = declarations.withColumn("expected_member_count", F.when(F.col("run_key") == "closed", 1).otherwise(F.col("expected_member_count")))
    m = lambda r, k, w, i, p=0: (r, "c", k, w, i, {"a": "b"}, p)
    members = spark.createDataFrame([
        m("pinned", 0, "work-0", "input:0"), m("pinned", 1, "work-1", "input:1"), m("other", 0, "work-0", "input:0"), m("other", 1, "old", "in:old"), m("short", 0, "s0", "i"), m("short", 1, "s1", "i"),
        m("bad", 0, "b", "i"), m("closed", 0, "never", "i"), m("open", 0, "old", "in:old"), m("taken", 0, "old", "in:old"), m("one", 0, "same", "i"), m("two", 0, "same", "j"), m("wrong", 0, "w", "i"),
    ], "run_key string, campaign_key string, member_ordinal int, work_key string, input_reference string, labels map<string,string>, priority int")
    declared = spark.createDataFrame([("p", 1, 1, "later", "q", None), ("p", 1, 0, "first", "q", None)], DECLARED)
    done = registration.submit(declarations, members, stored, items, memberships, declared, "run-membership/v1", at())
    assert {r["run_key"]: (r["registered_count"], r["created_count"], r["reused_count"]) for r in done.receipts.collect()} == {"pinned": (2, 1, 1), "other": (2, 1, 1), "open": (1, 0, 1), "closed": (1, 1, 0)}
    assert {(r["run_key"], r["reason"]) for r in done.rejects.collect()} == {("short", "complete"), ("bad", "digest_equal"), ("taken", "other_members"), ("one", "disputed"), ("two", "disputed"), ("wrong", "version_positive")}
    made = {r["work_key"]: r for r in done.items.collect()}
    assert set(made) == {"work-0", "work-1", "s0", "s1", "b"} and made["work-0"]["origin_run_key"] == "other" and min(r["work_item_id"] for r in made.values()) > 7
    assert {(r["work_item_id"], r["stage_key"], r["state"]) for r in done.executions.collect()} == {(r["work_item_id"], "first", "ready") for r in made.values()}
    assert {r["run_key"] for r in done.runs.collect()} == {"pinned", "other", "short", "bad", "one", "two"}
    assert sorted((r["run_key"], r["member_ordinal"]) for r in done.memberships.collect()) == [("bad", 0), ("other", 0), ("other", 1), ("pinned", 0), ("pinned", 1), ("short", 0), ("short", 1)]


def test_a_replayed_successor_takes_the_priority_of_its_item(spark):
    stages = spark.createDataFrame([(1, 5, "x", 0, "admitted", 1, 9, 0, False), (2, 5, "y", 1, "ready", 0, 9, 3, False)], "stage_execution_id long, work_item_id long, stage_key string, stage_index int, state string, current_attempt int, rank long, priority int, barrier boolean").withColumn("input_reference", F.lit("next")).withColumn("updated_at", at())
    attempts = spark.createDataFrame([("wf", 1, 1)], "workflow_id string, stage_execution_id long, attempt_number int").withColumn("terminal_at", F.lit(None).cast("timestamp"))
    items = spark.createDataFrame([(5, "r", 9, 7)], "work_item_id long, origin_run_key string, rank long, priority int")
    runs = spark.createDataFrame([("r", "p", 1)], "run_key string, pipeline_key string, pipeline_version int")
    declared = spark.createDataFrame([("p", 1, 0, "x", "q", None), ("p", 1, 1, "y", "q", None)], DECLARED)
    batch = spark.createDataFrame([("wf", True, "out", None, None, None, False, [("y", 1, "next", False)])], "workflow_id string, succeeded boolean, output_reference string, evidence_reference string, error_type string, message string, linear boolean, successors array<struct<stage_key:string,stage_index:int,input_reference:string,barrier:boolean>>").withColumn("completed_at", at())
    done = outcomes.apply_outcomes(batch, attempts, stages, items, runs, declared)
    assert [r["kind"] for r in done.kinds.collect()] == ["apply"] and done.successors.count() == 0
    assert [(r["stage_execution_id"], r["priority"]) for r in done.priorities.collect()] == [(2, 7)]
    held = spark.createDataFrame([(2, 5, "y", 1, "ready", 0, 8, 3, False)], stages.drop("input_reference", "updated_at").schema).withColumn("input_reference", F.lit("next")).withColumn("updated_at", at())
    other = outcomes.apply_outcomes(batch, attempts, stages.where("stage_execution_id = 1").unionByName(held), items, runs, declared)
    assert [r["reason"] for r in other.kinds.collect()] == ["successor_conflict"]


def test_the_cursor_is_one_row(spark):
    rows = spark.createDataFrame([(True, "r1"), (True, "r2"), (False, None)], schemas.TABLES["run_barrier_cursor"])
    assert [(r["table"], r["rule"]) for r in integrity.check_all({"run_barrier_cursor": rows}).collect()] == [("run_barrier_cursor", "singleton")]
    with_cursor = {name: spark.createDataFrame([], schemas.TABLES[name]) for name in schemas.TABLES}
    with_cursor["stage_controls"] = with_cursor["stage_controls"].withColumn("selector_key", F.lit(""))
    found = integrity.unique_all(with_cursor | {"run_barrier_cursor": rows}).collect()
    assert [(r["table"], r["key"], r["n"]) for r in found] == [("run_barrier_cursor", "true", 2)]


def test_seeders_of_items_and_ended_stages(spark):
    work = spark.createDataFrame([("c", "w1"), ("c", "w2")], "campaign_key string, work_key string")
    items, stages = seeders.work_items(work, "first", 3)
    assert {r["state"] for r in status.work_item_status(stages).collect()} == {"ready"} and stages.count() == items.count() == 2
    ended = seeders.succeeded(stages, F.concat(F.lit("out:"), F.col("work_item_id").cast("string")), at())
    assert {(r["state"], r["output_reference"][:4], r["current_attempt"]) for r in ended.collect()} == {("succeeded", "out:", 1)}
