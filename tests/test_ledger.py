import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stagebook.functions import expressions as X
from stagebook.operators import admission as A
from stagebook.operators import changes as C
from stagebook.operators import completion as B
from stagebook.operators import outcomes as O
from stagebook.operators import recovery as V
from stagebook.operators import registration as R
from stagebook.operators import status as S
from stagebook.plans import passes  # noqa: F401
from stagebook.plans import queries as plans
from stagebook.sources import fixtures, schemas, seeders
from stagebook.streaming import folds

SF = "/root/testdata/sf0.001"
EXECUTIONS = "work_item_id long, stage_execution_id long, stage_key string, stage_index int, state string"


def test_status_precedence_and_order(spark):
    rows = [(1, 1, "a", 1, "failed"), (1, 2, "b", 3, "ready"), (2, 3, "a", 0, "succeeded"), (2, 4, "b", 2, "succeeded"), (2, 5, "c", 1, "succeeded"), (3, 6, "a", 0, "ready"), (3, 7, "b", 1, "admitted")]
    got = {r["work_item_id"]: (r["state"], r["stage_index"]) for r in S.work_item_status(spark.createDataFrame(rows, EXECUTIONS)).collect()}
    assert got == {1: ("failed", 1), 2: ("succeeded", 2), 3: ("admitted", 1)}


def test_pinned_identities(spark):
    row = spark.range(1).select(
        X.stable_rank(F.lit("campaign-7"), F.lit("item/alpha")).alias("rank"),
        X.stage_workflow_id(F.lit("campaign-7"), F.lit("item/alpha"), F.lit("evaluation"), F.lit(1), F.lit("execute"), F.lit(0), F.lit(1)).alias("id"),
    ).first()
    assert row["rank"] == 3670084909033913430
    assert row["id"] == "drp-ec522298fe642c4803ad044e2d76547d924a518ecf7a3cdb95d18e5b5602d1f5-a1"


def test_selector_containment(spark):
    got = spark.sql("SELECT map('a','1','b','2') AS l, map('a','1') AS s, map('c','1') AS t, map_from_arrays(array(), array()) AS e").select(X.contains("l", "s"), X.contains("l", "t"), X.contains("l", F.col("e").cast("map<string,string>"))).first()
    assert list(got) == [True, False, True]


def test_admission_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    for _ in range(3):
        colours, sizes = ("blue", "red"), ("s", "l")
        rows = [(i, "p", 1, rng.choice(("x", "y")), {"c": rng.choice(colours), "z": rng.choice(sizes)}, rng.randrange(3), rng.randrange(50)) for i in range(120)]
        controls = [(k, "p", 1, s, sel, rng.randrange(25), rng.randrange(5)) for k, (s, sel) in enumerate([("x", {}), ("x", {"c": "blue"}), ("x", {"z": "s"}), ("x", {"c": "red", "z": "l"}), ("y", {}), ("y", {"z": "l"})])]
        free, want = {c[0]: max(0, c[5] - c[6]) for c in controls}, []
        for r in sorted(rows, key=lambda r: (r[5], r[6], r[0])):
            match = [c[0] for c in controls if c[3] == r[3] and all(r[4].get(a) == b for a, b in c[4].items())]
            if match and all(free[k] > 0 for k in match):
                want.append(r[0])
                for k in match:
                    free[k] -= 1
        candidates = spark.createDataFrame(rows, "stage_execution_id long, pipeline_key string, pipeline_version int, stage_key string, labels map<string,string>, priority int, rank long")
        occupancy = spark.createDataFrame(controls, "stage_control_id int, pipeline_key string, pipeline_version int, stage_key string, selector map<string,string>, capacity int, occupied long")
        assert [r["stage_execution_id"] for r in C.plan_admission(candidates, occupancy).collect()] == want


def test_terminal_filter_needs_a_condition():
    with pytest.raises(ValueError):
        X.terminal_filter()


def test_fold_keeps_legal_moves(spark):
    got = plans.queries()["stream_current_state"](spark, SF).collect()
    total = duckdb.sql(f"SELECT count(*) FROM '{SF}/events.parquet'").fetchall()[0][0]
    assert sum(r["accepted"] + r["rejected"] for r in got) == total


def test_status_is_aggregated_before_its_one_shuffle(spark):
    table = spark.createDataFrame([(1, 1, "a", 1, "failed")], EXECUTIONS)
    plan = S.work_item_status(table)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_clusters_take_one_shuffle(spark):
    table = seeders.episodes(spark.createDataFrame([(1, 5), (2, 6)], "work_item_id long, rank long"), F.lit(2), F.col("work_item_id"))
    plan = S.barrier_clusters(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = sorted((r["work_item_id"], r["optim_index"], r["eval_count"], r["fanin_index"], r["problem"]) for r in S.barrier_clusters(table).collect())
    assert got == [(1, 0, 2, 3, None), (2, 0, 2, 3, None), (2, 4, 2, 7, None)]
    wanted = spark.createDataFrame([(1, 3), (1, 2), (1, 9), (2, 7), (7, 1)], "work_item_id long, fanin_index int")
    found = {(r["work_item_id"], r["fanin_index"]): (r["optim_index"], None if r["eval_rows"] is None else len(r["eval_rows"]), r["problem"]) for r in S.resolve_clusters(wanted, table).collect()}
    assert found[1, 3] == (0, 2, None) and found[2, 7] == (4, 2, None) and found[1, 2][2] == "not_barrier" and found[1, 9][2] == found[7, 1][2] == "no_row"
    with pytest.raises(ValueError):
        S.resolve_clusters(wanted, table, "a", "a")


def test_fanout_needs_rows_in_place_and_one_waiting_fanin(spark):
    good = [("row", 3, False), ("row", 4, False), ("join", 5, True)]
    cases = {
        1: (good, None), 2: ([*good, ("x", 6, False)], "foreign_stage"), 3: (good[2:], "no_rows"), 4: (good[:2], "not_one_fanin"), 5: ([*good[:2], ("join", 5, False)], "fanin_without_barrier"),
        6: ([("row", 3, True), *good[1:]], "row_with_barrier"), 7: (good[1:], "gap"), 8: ([good[0], *good], "gap"), 9: ([*good[:2], ("join", 6, True)], "fanin_misplaced"),
    }
    rows = [(k, 2, *x) for k, (of, _) in cases.items() for x in of]
    got = C.fanout_problems(spark.createDataFrame(rows, "origin_id long, origin_index int, stage_key string, stage_index int, barrier boolean"), "row", "join").collect()
    assert {r["origin_id"]: r["problem"] for r in got} == {k: want for k, (_, want) in cases.items()}
    with pytest.raises(ValueError):
        C.fanout_problems(spark.range(1), "row", "row")


def test_routes_overlap_only_where_all_common_labels_agree(spark):
    rows = [("p", 1, "a", k, sel, q) for k, (sel, q) in enumerate([({"c": "x"}, "q0"), ({"c": "y"}, "q1"), ({"z": "s"}, "q2"), ({"c": "x", "z": "l"}, "q3"), ({}, "q4"), ({"z": "m"}, "q1")])]
    got = C.route_problems(spark.createDataFrame(rows, "pipeline_key string, pipeline_version int, stage_key string, ordinal int, selector map<string,string>, queue_name string")).collect()
    assert {(r["ordinal"], r["other"], r["problem"]) for r in got} == {(0, 3, "overlap"), (1, 5, "repeated_queue"), (4, None, "empty_selector")}


def test_completion_outcomes(spark):
    attempts = spark.createDataFrame([("w1", 1, 1), ("w2", 2, 1), ("w2b", 2, 2), ("w3", 3, 1), ("w4", 4, 1)], "workflow_id string, run_completion_execution_id int, attempt_number int")
    held = spark.createDataFrame([(1, "r1", 1, "enqueued", None, None), (2, "r2", 2, "enqueued", None, None), (3, "r3", 1, "succeeded", "out", None), (4, "r4", 1, "failed", None, "{}")], "run_completion_execution_id int, run_key string, current_attempt int, state string, output_reference string, error_summary string")
    said = [("w1", True, "out", None, "apply"), ("w1", True, " ", None, "rejected"), ("w1", False, None, None, "rejected"), ("w1", False, "out", "{}", "rejected"), ("w2", True, "out", None, "stale"), ("w2b", False, None, "{}", "apply"), ("w3", True, "out", None, "replay"), ("w3", True, "other", None, "conflict"), ("w4", False, None, "{}", "replay"), ("w0", True, "out", None, "unknown")]
    got = C.classify_completion_outcomes(spark.createDataFrame(said, "workflow_id string, succeeded boolean, output_reference string, error_summary string, want string"), attempts, held).collect()
    assert len(got) == len(said) and all(r["kind"] == r["want"] for r in got)


def test_members_conflict_by_labels_rank_and_provenance(spark):
    runs = spark.createDataFrame([("a", "p", 1, "x"), ("b", "p", 1, "x"), ("q", "q", 1, "x"), ("v", "p", 2, "x"), ("c", "p", 1, "y"), ("n", "p", 1, None)], "run_key string, pipeline_key string, pipeline_version int, execution_config_reference string")
    items = spark.createDataFrame([("w", "a"), ("ranked", "a"), ("null", "n")], "work_key string, origin_run_key string").select(
        F.lit("k").alias("campaign_key"), "work_key", F.xxhash64("work_key").alias("work_item_id"), "origin_run_key", F.lit("in").alias("input_reference"), F.expr("map('s', '1', 't', '2')").alias("labels"),
        (X.stable_rank(F.lit("k"), "work_key") + F.when(F.col("work_key") == "ranked", 1).otherwise(0)).alias("rank"), F.lit(0).alias("priority"),
    )
    labels, turned = {"s": "1", "t": "2"}, {"t": "2", "s": "1"}
    said = [
        ("b", "w", "in", labels, 0, "same"), ("b", "w", "in", turned, 0, "same"), ("b", "w", "in", labels, 3, "priority_change"), ("b", "other", "in", labels, 0, "new"), ("b", "w", "else", labels, 0, "conflict"), ("b", "w", "in", {"s": "1"}, 3, "conflict"),
        ("b", "ranked", "in", labels, 0, "conflict"), ("q", "w", "in", labels, 0, "conflict"), ("v", "w", "in", labels, 0, "conflict"), ("c", "w", "in", labels, 0, "conflict"), ("n", "w", "in", labels, 0, "conflict"), ("n", "null", "in", labels, 0, "same"),
    ]
    members = spark.createDataFrame(said, "run_key string, work_key string, input_reference string, labels map<string,string>, priority int, want string").withColumn("campaign_key", F.lit("k"))
    got = C.classify_members(members, items, runs).collect()
    assert len(got) == len(said) and all(r["kind"] == r["want"] for r in got)


def test_a_prepared_attempt_is_admitted_itself(spark):
    cases = [(1, 0, None, None, 1), (2, 2, None, None, 2), (3, 1, "2026-07-17", None, 2), (4, 1, None, "2026-07-17", 2), (5, 3, "2026-07-17", "2026-07-17", 4)]
    rows = spark.createDataFrame(cases, "stage_execution_id long, current_attempt int, admitted_at string, terminal_at string, want int")
    attempts = rows.where("current_attempt > 0").selectExpr("stage_execution_id", "explode(sequence(1, current_attempt)) AS attempt_number", "cast(admitted_at AS timestamp) AS admitted_at", "cast(terminal_at AS timestamp) AS terminal_at")
    got = {r["stage_execution_id"]: r["attempt_number"] for r in C.attempts_to_admit(rows, rows, attempts).collect()}
    assert got == {c[0]: c[4] for c in cases}


def test_whole_request_sets_leave_nothing_out(spark):
    known = plans.queries()
    items = duckdb.sql(f"SELECT count(*) FROM '{SF}/orders.parquet' JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey").fetchall()[0][0]
    stages = duckdb.sql(f"SELECT count(*) FROM '{SF}/lineitem.parquet' JOIN '{SF}/orders.parquet' ON l_orderkey = o_orderkey").fetchall()[0][0]
    assert known["bulk_work_statuses_all"](spark, SF).count() == 2 * items
    assert known["retry_stages_all"](spark, SF).count() == 2 * stages
    order = [tuple(r) for r in known["ready_order_all"](spark, SF).select("priority", "rank", "stage_execution_id").collect()]
    assert len(order) == known["attempts_to_admit"](spark, SF).count() and order == sorted(order)


# ---------------------------------------------------------------- seeded cases



def now():
    return F.to_timestamp(F.lit("2026-07-17 12:00:00"))


CONTROLS = "stage_control_id long, pipeline_key string, pipeline_version int, stage_key string, selector map<string,string>, capacity int, paused boolean, occupied long"


def admit(spark, rows, controls, batch=10_000, held=(), declared=("x",)):
    """rows: (id, pipeline, labels, priority); all stages are x of version 1."""
    table = spark.createDataFrame([(i, i, p, 1, "x", 0, "ready", 1 if i in held else 0, False, sel, pr, i, "c", f"w{i}", "r", None, "in") for i, p, sel, pr in rows],
        "stage_execution_id long, work_item_id long, pipeline_key string, pipeline_version int, stage_key string, stage_index int, state string, current_attempt int, barrier boolean, labels map<string,string>, priority int, rank long, campaign_key string, work_key string, origin_run_key string, input_reference string, item_input string")
    attempts = spark.createDataFrame([(i, 1, f"old-{i}", None, None) for i in held], "stage_execution_id long, attempt_number int, workflow_id string, admitted_at timestamp, terminal_at timestamp")
    stages = spark.createDataFrame([(p, 1, s, "queue", [(0, {"c": "red"}, "red-queue")]) for p in {r[1] for r in rows} for s in declared], "pipeline_key string, pipeline_version int, stage_key string, queue_name string, routes array<struct<ordinal:int,selector:map<string,string>,queue_name:string>>")
    done = A.admission_pass(table, table, spark.createDataFrame(controls, CONTROLS), attempts, stages, now(), batch)
    return done, {(r["pipeline_key"], r["reason"]): r["n"] for r in done.summary.collect()}


def test_stage_capacity_and_prepared_attempts(spark):
    done, summary = admit(spark, [(i, "p", {}, 0) for i in range(1, 5)], [(1, "p", 1, "x", {}, 2, False, 0)], held=(2,))
    assert summary == {("p", "admitted"): 2, ("p", "capacity"): 2}
    sent = {r["stage_execution_id"]: r for r in done.outbox.collect()}
    assert set(sent) == {1, 2} and sent[2]["workflow_id"] == "old-2" and sent[1]["workflow_id"].startswith("drp-") and sent[1]["priority"] is None
    assert {r["stage_execution_id"]: r["appended"] for r in done.attempts.collect()} == {1: True, 2: False}
    assert len(json.loads(sent[1]["payload"])) == 11


def test_selector_capacity_and_queues(spark):
    colours = ["blue", "blue", "red", "red"]
    done, summary = admit(spark, [(i, "p", {"c": c}, i) for i, c in enumerate(colours)], [(1, "p", 1, "x", {}, 4, False, 0), (2, "p", 1, "x", {"c": "blue"}, 1, False, 0)])
    assert summary == {("p", "admitted"): 3, ("p", "capacity"): 1}
    assert {r["stage_execution_id"]: r["queue_name"] for r in done.outbox.collect()} == {0: "queue", 2: "red-queue", 3: "red-queue"}


def test_a_paused_stage_does_not_starve_others(spark):
    rows = [(i, "a", {}, 0) for i in range(5)] + [(9, "b", {}, 5)]
    _, summary = admit(spark, rows, [(1, "a", 1, "x", {}, 9, True, 0), (2, "b", 1, "x", {}, 1, False, 0)], batch=1)
    assert summary == {("a", "paused"): 5, ("b", "admitted"): 1}
    _, summary = admit(spark, rows, [(2, "b", 1, "x", {}, 9, False, 0)], declared=("y",))
    assert summary == {("a", "unconfigured"): 5, ("b", "mismatched"): 1}


def test_overlapping_runs_and_absent_or_empty_runs(spark):
    members = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 1), ("b", 1, 2)], "run_key string, member_ordinal int, work_item_id long")
    executions = spark.createDataFrame([(0, 10, "s", 0, "ready"), (1, 11, "s", 0, "succeeded"), (2, 12, "s", 0, "ready")], EXECUTIONS)
    assert {(r["run_key"], r["state"]): r["n"] for r in S.run_state_counts(members, executions).collect()} == {("a", "ready"): 1, ("a", "succeeded"): 1, ("b", "ready"): 1, ("b", "succeeded"): 1}
    runs = spark.createDataFrame([("a",), ("b",), ("empty",)], "run_key string")
    keys = spark.createDataFrame([("a",), ("empty",), ("missing",), ("a",)], "run_key string")
    got = sorted((r["run_key"], r["present"], r["state"], r["n"]) for r in S.bulk_run_state_counts(keys, runs, members, executions).collect() if r["run_key"] != "a")
    assert got == [("empty", True, None, 0), ("missing", False, None, 0)]


def test_digests_pinned(spark):
    pinned = [("work-0", "input:0"), ("work-1", "input:1")]
    items = spark.createDataFrame([(i, w, r) for i, (w, r) in enumerate(pinned)] + [(9, "z", "y")], "work_item_id long, work_key string, input_reference string")
    members = spark.createDataFrame([("r", 1, 1), ("r", 0, 0), ("s", 0, 9)], "run_key string, member_ordinal int, work_item_id long")
    got = {r["run_key"]: r["membership_digest"] for r in R.ordered_digests(members, items, "run-membership/v1").collect()}
    text = lambda *rows: json.dumps({"entries": [{"input_reference": r, "ordinal": k, "work_key": w} for k, (w, r) in enumerate(rows)], "expected_member_count": len(rows), "schema": "run-membership/v1"}, separators=(",", ":"))
    assert got == {"r": hashlib.sha256(text(*pinned).encode()).hexdigest(), "s": hashlib.sha256(text(("z", "y")).encode()).hexdigest()}
    assert R.ordered_digests(members.limit(0), items, "v").count() == 0


def test_barrier_pass_stops_at_the_batch_and_goes_round(spark):
    keys = [f"r{k}" for k in range(6)]
    runs = spark.createDataFrame([(k, "c", "p", 1, "cfg", 2 if k == "r4" else 1, "m", "d", "fin", "2026-01-01", None) for k in keys], "run_key string, campaign_key string, pipeline_key string, pipeline_version int, execution_config_reference string, expected_member_count int, manifest_reference string, membership_digest string, run_completion_key string, closed string, released string")
    runs = runs.withColumn("registration_closed_at", F.to_timestamp("closed")).withColumn("released_at", F.to_timestamp("released")).drop("closed", "released")
    members = spark.createDataFrame([(k, 0, i) for i, k in enumerate(keys)], "run_key string, member_ordinal int, work_item_id long")
    executions = spark.createDataFrame([(i, i, "s", 0, "ready" if i == 5 else "failed") for i in range(6)], EXECUTIONS)
    declared = spark.createDataFrame([("p", 1, "fin")], "pipeline_key string, pipeline_version int, run_completion_key string")
    done = B.barrier_pass(runs, members, executions, declared, "r2", now(), batch=2, budget=10)
    assert [r["run_key"] for r in done.runs.orderBy("run_key").collect()] == ["r0", "r3"]
    assert [tuple(r) for r in done.failures.collect()] == [("r4", "not_covered")]
    assert done.summary.first().asDict() == {"examined": 3, "released": 2, "failed": 1, "last_run_key": "r0"}
    assert B.barrier_pass(runs, members, executions, declared, None, now(), batch=10, budget=2).summary.first()["examined"] == 2
    good = [("a", 1, "c", "m", "d", 3, [("succeeded", 1), ("failed", 2), ("cancelled", 0)])]
    odd = [("b", 1, "c", "m", "d", 3, [("failed", 1), ("succeeded", 2), ("cancelled", 0)]), ("c", 1, "c", "m", "d", 4, good[0][6]), ("d", 1, "c", "", "d", 3, good[0][6]), ("e", 0, "c", "m", "d", 3, good[0][6])]
    table = spark.createDataFrame(good + odd, "run_key string, pipeline_version int, execution_config_reference string, manifest_reference string, membership_digest string, member_count int, release_terminal_state_counts array<struct<state:string,count:int>>")
    assert {r["run_key"]: r["reason"] for r in B.payload_problems(table).collect()} == {"b": "order_of_states", "c": "sum_of_counts", "d": "missing_reference", "e": "version"}


def test_live_identity(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "executor_id string")
    live = V.live_identity("v2", ids(" a ", ""), ids("b"), ids("local"))
    assert {r[0] for r in live.executors.collect()} == {"a", "b", "local"} and not live.unavailable
    silent = V.live_identity("v2", ids(" "), ids(), ids("local"))
    assert silent.suppress_executor and not silent.suppress_version
    assert V.live_identity(" ", None, ids("b"), ids()).suppress_version
    assert V.live_identity("v2", None, ids(), ids()).suppress_executor
    admitted = spark.createDataFrame([("w1",), ("w2",), ("w3",)], "workflow_id string")
    feed = spark.createDataFrame([("w1", "CANCELLED", "v2", "a"), ("w2", "MAX_RECOVERY_ATTEMPTS_EXCEEDED", None, None), ("w3", "PENDING", "v2", "a")], "workflow_id string, status string, app_version string, executor_id string")
    summary = V.sweep_summary(V.sweep_live(admitted, feed, live), live).first()
    assert (summary["inspected"], summary["projected"]) == (3, 2)


def test_terminal_summaries_leave_nulls_out(spark):
    row = spark.range(1).select(O.terminal_summary(F.lit("failed"), F.lit("abandonment"), reason=F.lit("dead_executor"), message=F.lit(None).cast("string")).alias("a"), O.terminal_summary(F.lit("succeeded")).alias("b")).first()
    assert row["a"] == '{"outcome":"failed","producer":"abandonment","reason":"dead_executor"}' and row["b"] == '{"outcome":"succeeded"}'


def test_tables_are_read_under_their_schemas(spark, tmp_path):
    ledger = fixtures.Ledger(spark, SF)
    for full, name in (("full_items", "work_items"), ("full_executions", "stage_executions"), ("full_attempts", "stage_attempts"), ("run_memberships", "run_memberships")):
        path = str(tmp_path / name)
        schemas.conform(getattr(ledger, full), schemas.TABLES[name]).write.parquet(path)
        table = schemas.read_table(spark, name, path)
        assert table.schema == schemas.schema_of(schemas.TABLES[name]) and table.count() == getattr(ledger, full).count()


def test_a_pass_runs_on_every_tick(spark):
    seen = []
    assert folds.periodically(spark, seen.append, 0.2, times=2) == 2 and len(seen) == 2


def test_changes_keep_guards_and_ignore_known_rows(spark):
    table = spark.createDataFrame([(1, "ready", 0), (2, "ready", 1), (3, "failed", 1)], "id long, state string, attempt int")
    updates = spark.createDataFrame([(1, "admitted", "ready", 0), (2, "admitted", "ready", 0), (3, "ready", "admitted", 1)], "id long, state string, expected_state string, expected_attempt int")
    inserts = spark.createDataFrame([(3, "new", 9), (4, "new", 0), (4, "new", 0)], "id long, state string, attempt int")
    assert sorted(tuple(r) for r in C.apply_changes(table, "id", updates, inserts, guard=["state", "attempt"]).collect()) == [(1, "admitted", 0), (2, "ready", 1), (3, "failed", 1), (4, "new", 0)]
