"""Readers for many requests at once, against the rule for one request after the other."""

import random

import pytest
from pyspark.sql import functions as F

from stagebook.functions import expressions as X
from stagebook.operators import readers
from stagebook.sources import schemas

REQUESTS = "request_id long, campaign_key string, state string, cursor long, page_size int"


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks and parts of a few rows, so that pages and scopes go over many of them."""
    monkeypatch.setattr(readers, "BLOCK", 3)
    monkeypatch.setattr(readers, "ROWS_PER_PART", 7)


def table(spark, name, rows):
    schema = schemas.schema_of(schemas.TABLES[name])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def ledger(spark, seed=3, n=90):
    """Items of three campaigns, one with most of them; every seventh item has no stage."""
    rng = random.Random(seed)
    runs = [{"run_key": f"r{k}", "campaign_key": c, "pipeline_key": "p", "pipeline_version": 1} for k, c in enumerate("aaaaabbc")]
    items = [{"work_item_id": i, "campaign_key": rng.choice("aaaab"), "work_key": f"w{i}", "origin_run_key": "r0", "input_reference": f"in{i}", "labels": {"k": "v"}} for i in rng.sample(range(1, 10 * n), n)]
    stages = [
        {"stage_execution_id": i["work_item_id"] * 10 + k, "work_item_id": i["work_item_id"], "stage_key": f"s{k}", "stage_index": k, "state": rng.choice(readers.STATES), "current_attempt": 1, "output_reference": rng.choice([None, "out"])}
        for i in items if i["work_item_id"] % 7 for k in range(rng.randint(1, 3))
    ]
    return runs, items, stages


def status_of(stages):
    order = {"failed": 0, "cancelled": 1, "admitted": 2, "ready": 3}
    best = {}
    for s in stages:
        key = (order.get(s["state"], 4), -s["stage_index"] if s["state"] == "succeeded" else s["stage_index"], s["stage_execution_id"])
        if s["work_item_id"] not in best or key < best[s["work_item_id"]][0]:
            best[s["work_item_id"]] = (key, s)
    return {k: s for k, (_, s) in best.items()}


def test_pages_of_items_behind_many_cursors(spark, small_blocks):
    runs, items, stages = ledger(spark)
    status, rng = status_of(stages), random.Random(4)
    ids = [i["work_item_id"] for i in items]
    requests = [(k, rng.choice("aabc"), rng.choice([None, None, *readers.STATES]), rng.choice([None, *rng.sample(ids, 5)]), rng.choice([None, 1, 2, 5, 50])) for k in range(120)]
    requests += [(200, "a", None, None, 0), (201, "none", None, None, 5), (202, "a", "odd", None, 5), (203, "a", None, -1, 5), (204, "c", None, None, 5), (205, "a", None, None, 1), (205, "a", None, None, 2), (206, None, None, None, 1)]
    read = readers.work_item_pages(spark.createDataFrame(requests, REQUESTS), table(spark, "pipeline_runs", runs), table(spark, "work_items", items), table(spark, "stage_executions", stages))
    rows, rejects = {}, {200: "bad_page_size", 201: "unknown_campaign", 202: "bad_state", 203: "bad_cursor", 205: "repeated_request", 206: "unknown_campaign"}
    for k, campaign, state, cursor, size in requests:
        own = sorted(i["work_item_id"] for i in items if i["campaign_key"] == campaign)
        if k in rejects:
            continue
        if cursor is not None and cursor not in own:
            rejects[k] = "unknown_cursor"
            continue
        found = [i for i in own if i in status and (state is None or status[i]["state"] == state) and (cursor is None or i > cursor)]
        rows |= {(k, n): i for n, i in enumerate(found[: size or 10_000], 1)}
    got = read.rows.collect()
    assert {(r["request_id"], r["nth"]): r["work_item_id"] for r in got} == rows and len(got) == len(rows) > 300
    assert {r["request_id"]: r["reason"] for r in read.rejects.collect()} == rejects and "unknown_cursor" in rejects.values()
    by_id = {i["work_item_id"]: i for i in items}
    assert read.rows.columns == ["request_id", "nth", *schemas.schema_of(schemas.READERS["work_item"]).names]
    for r in got:
        s, i = status[r["work_item_id"]], by_id[r["work_item_id"]]
        assert (r["work_key"], r["origin_run_key"], r["labels"], r["state"]) == (i["work_key"], "r0", {"k": "v"}, s["state"])
        assert (r["current_stage_execution_id"], r["current_stage_key"], r["current_stage_index"]) == (s["stage_execution_id"], s["stage_key"], s["stage_index"])


def test_pages_of_runs_and_campaigns(spark, small_blocks):
    rng = random.Random(5)
    runs = [
        {"run_key": f"r{k:03}", "campaign_key": rng.choice(["a", "a", "a", "b", "c"]), "pipeline_key": "p", "pipeline_version": 1, "created_at": None, "day": rng.randint(1, 9), "closed": k % 3 == 0, "registered_member_count": 40 + k}
        for k in range(60)
    ]
    table_of_runs = spark.createDataFrame([(r["run_key"], r["campaign_key"], r["day"], r["closed"], r["registered_member_count"]) for r in runs], "run_key string, campaign_key string, day int, closed boolean, registered_member_count int")
    day = F.timestamp_seconds(F.col("day") * 86400)
    table_of_runs = table_of_runs.withColumn("created_at", day).withColumn("registration_closed_at", F.when(F.col("closed"), day))
    members = spark.createDataFrame([(r["run_key"], o, o) for k, r in enumerate(runs) for o in range(k % 4)], "run_key string, member_ordinal int, work_item_id long")
    requests = [(k, rng.choice("abc"), rng.choice([None, *[r["run_key"] for r in runs]]), rng.choice([1, 4, 100])) for k in range(50)] + [(90, "x", None, 3)]
    read = readers.run_pages(spark.createDataFrame(requests, "request_id long, campaign_key string, cursor string, page_size int"), table_of_runs, members)
    want, rejects = {}, {90: "unknown_campaign"}
    for k, campaign, cursor, size in requests[:-1]:
        own = sorted(((r["day"], r["run_key"]) for r in runs if r["campaign_key"] == campaign))
        start = [r for r in own if r[1] == cursor]
        if cursor and not start:
            rejects[k] = "unknown_cursor"
        else:
            want |= {(k, n): r[1] for n, r in enumerate([r for r in own if not start or r > start[0]][:size], 1)}
    got = read.rows.collect()
    assert {(r["request_id"], r["nth"]): r["run_key"] for r in got} == want and len(got) == len(want)
    assert {r["request_id"]: r["reason"] for r in read.rejects.collect()} == rejects
    for r in got:
        k = int(r["run_key"][1:])
        assert r["registered_member_count"] == (40 + k if k % 3 == 0 else k % 4)
    items = spark.createDataFrame([(k, "a") for k in range(9)], "work_item_id long, campaign_key string")
    asked = spark.createDataFrame([(1, None, 2), (2, "a", 9), (3, "c", 9), (4, "zz", 9), (5, None, -1)], "request_id long, cursor string, page_size int")
    read = readers.campaign_pages(asked, table_of_runs, items)
    count = lambda c: sum(r["campaign_key"] == c for r in runs)
    assert sorted((r["request_id"], r["nth"], r["campaign_key"], r["run_count"], r["work_item_count"]) for r in read.rows.collect()) == [(1, 1, "a", count("a"), 9), (1, 2, "b", count("b"), 0), (2, 1, "b", count("b"), 0), (2, 2, "c", count("c"), 0)]
    assert {r["request_id"]: r["reason"] for r in read.rejects.collect()} == {4: "unknown_cursor", 5: "bad_page_size"}


def test_pages_of_members_with_and_without_a_condition(spark, small_blocks):
    runs, items, stages = ledger(spark, 6, 40)
    rng = random.Random(7)
    members = [{"run_key": run, "member_ordinal": o, "work_item_id": i["work_item_id"]} for run in ("r0", "r1") for o, i in enumerate(items)]
    attempts = [
        {"stage_attempt_id": s["stage_execution_id"], "stage_execution_id": s["stage_execution_id"], "attempt_number": a, "workflow_id": f"w{s['stage_execution_id']}-{a}", "terminal_summary": rng.choice([None, '{"producer":"cancellation"}', '{"producer":"abandonment"}'])}
        for s in stages for a in (1, 2)
    ]
    tables = [table(spark, n, r) for n, r in (("pipeline_runs", runs), ("run_memberships", members), ("work_items", items), ("stage_executions", stages), ("stage_attempts", attempts))]
    requests = [(k, rng.choice(["r0", "r1"]), rng.choice([None, 0, 5, 17, 39, 40]), rng.choice([1, 6, None])) for k in range(40)] + [(90, "r9", None, 3), (91, "r0", -1, 3), (92, "r7", None, 3)]
    asked = spark.createDataFrame(requests, "request_id long, run_key string, cursor int, page_size int")
    status = status_of(stages)
    summary = {(a["stage_execution_id"], a["attempt_number"]): a["terminal_summary"] for a in attempts}
    for condition, keep in ((None, lambda i: True), (X.terminal_filter(producer="cancellation"), lambda i: i in status and "cancellation" in (summary[status[i]["stage_execution_id"], 1] or ""))):
        read = readers.run_member_pages(asked, *tables, condition=condition)
        want, rejects = {}, {90: "unknown_run", 91: "bad_cursor"}
        for k, _, cursor, size in requests[:40]:
            if cursor == 40:
                rejects[k] = "unknown_cursor"
                continue
            found = [o for o, i in enumerate(items) if keep(i["work_item_id"]) and (cursor is None or o > cursor)]
            want |= {(k, n): o for n, o in enumerate(found[: size or 10_000], 1)}
        got = read.rows.collect()
        assert {(r["request_id"], r["nth"]): r["member_ordinal"] for r in got} == want and len(got) == len(want) > 20
        assert {r["request_id"]: r["reason"] for r in read.rejects.collect()} == rejects
        for r in got:
            s = status.get(r["work_item_id"])
            assert (r["current_stage_key"], r["state"]) == ((s["stage_key"], s["state"]) if s else (None, None))
            assert r["stage_execution_id"] == (s["stage_execution_id"] if condition is not None else None)
            assert condition is None or "cancellation" in r["terminal_summary"]


def test_records_of_stages_and_outputs(spark):
    _, items, stages = ledger(spark, 8, 40)
    attempts = [{"stage_attempt_id": s["stage_execution_id"] * 3 + a, "stage_execution_id": s["stage_execution_id"], "attempt_number": a, "workflow_id": f"w{a}"} for s in stages for a in (2, 1) if s["stage_index"]]
    executions = table(spark, "stage_executions", stages)
    ids = [i["work_item_id"] for i in items]
    asked = spark.createDataFrame([(i,) for i in [*ids, ids[0], -5, 10**9, None]], "work_item_id long")
    read = readers.stage_records(asked, executions, table(spark, "stage_attempts", attempts))
    got = read.rows.collect()
    assert len(got) == len(stages) and {(r["request_id"], r["nth"], r["stage_execution_id"]) for r in got} == {(s["work_item_id"], s["stage_index"] + 1, s["stage_execution_id"]) for s in stages}
    assert all([a["attempt_number"] for a in r["attempts"]] == ([1, 2] if r["stage_index"] else []) for r in got)
    rejects = {(r["request_id"], r["reason"]) for r in read.rejects.collect()}
    assert rejects == {(-5, "bad_item"), (None, "bad_item"), (10**9, "unknown_item"), *((i, "unknown_item") for i in ids if i % 7 == 0)}

    rng = random.Random(9)
    outputs = [(i, rng.choice([0, 1, 2, 3]), rng.choice([None, "s0", "s1"]), rng.choice([None, 0, 1]), rng.choice([None, 1, 2])) for i in ids * 4]
    requests = [(k, *r) for k, r in enumerate(outputs)] + [(900, 0, 1, None, None, None), (901, 1, -1, None, None, None), (902, 1, 1, None, -1, None), (903, 1, 1, None, None, -1), (904, 1, None, None, None, None)]
    read = readers.predecessor_records(spark.createDataFrame(requests, "request_id long, work_item_id long, below int, stage_key string, above int, up_to int"), executions)
    want, rejects = [], {900: "bad_item", 901: "bad_bound", 902: "bad_bound", 903: "bad_bound", 904: "bad_bound"}
    for k, (item, below, key, above, up_to) in enumerate(outputs):
        top = below if up_to is None else up_to
        if top > below:
            rejects[k] = "bound_over_stage"
        elif above is not None and above >= top:
            rejects[k] = "empty_range"
        else:
            found = sorted(s["stage_index"] for s in stages if s["work_item_id"] == item and s["state"] == "succeeded" and s["output_reference"] and key in (None, s["stage_key"]) and (above is None or s["stage_index"] > above) and s["stage_index"] < top)
            want += [(k, n, i) for n, i in enumerate(found, 1)]
    assert sorted((r["request_id"], r["nth"], r["stage_index"]) for r in read.rows.collect()) == want and len(want) > 3
    assert {r["request_id"]: r["reason"] for r in read.rejects.collect()} == rejects


def test_empty_tables_and_no_requests(spark):
    runs, items, stages = ([], [], [])
    tables = [table(spark, n, r) for n, r in (("pipeline_runs", runs), ("work_items", items), ("stage_executions", stages))]
    none = readers.work_item_pages(spark.createDataFrame([], REQUESTS), *tables)
    assert none.rows.count() == 0 and none.rejects.count() == 0
    one = readers.work_item_pages(spark.createDataFrame([(1, "a", None, None, 5)], REQUESTS), *tables)
    assert one.rows.count() == 0 and [tuple(r) for r in one.rejects.collect()] == [(1, "unknown_campaign")]
