"""Joins whose sides grow with the ledger shuffle: compressed files look small to Spark, and their rows went through the driver."""

import pytest

import __spark_entry__ as entry
from stagebook.sources import shared

SMALL = "/root/testdata/sf0.001"


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_ranges_do_not_send_items_through_the_driver(spark):
    """the ranges of all items were broadcast."""
    df = entry.queries()["stages_in_ranges"](spark, SMALL)
    assert broadcasts(df) == 0 and df.count() > 0


@pytest.mark.parametrize("name", ["bulk_terminal_statuses_all", "bulk_terminal_statuses_filtered_all", "bulk_work_statuses_all"])
def test_many_requested_items_do_not_go_through_the_driver(spark, monkeypatch, name):
    """the ids of all requested items were broadcast to the executions."""
    few = sorted(str(r) for r in entry.queries()[name](spark, SMALL).collect())
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 100)
    df = entry.queries()[name](spark, SMALL)
    assert broadcasts(df) == 0 and sorted(str(r) for r in df.collect()) == few != []


def test_requested_items_that_repeat_or_are_null(spark, monkeypatch):
    from stagebook.operators.status import bulk_terminal_statuses

    keys = spark.createDataFrame([("c", "w1"), ("c", "w1"), ("c", "w3"), ("c", "none"), (None, "w2")], "campaign_key string, work_key string")
    items = spark.createDataFrame([("c", "w1", 1), ("c", "w1", 1), ("c", "w2", 2), ("c", "w3", 3), (None, "w2", 4), ("c", "none", None)], "campaign_key string, work_key string, work_item_id long")
    stages = spark.createDataFrame([(i * 10, i, "s", 0, "failed", 1) for i in (1, 2, 4, 5)] + [(90, None, "s", 0, "failed", 1)], "stage_execution_id long, work_item_id long, stage_key string, stage_index int, state string, current_attempt int")
    attempts = spark.createDataFrame([(10, 1, "ended", None), (10, 2, "later", None)], "stage_execution_id long, attempt_number int, terminal_summary string, evidence_reference string")
    asked = lambda: sorted(str((r["campaign_key"], r["work_key"], r["present"], r["work_item_id"], r["terminal_summary"])) for r in bulk_terminal_statuses(keys, items, stages, attempts).collect())
    want = sorted(map(str, [("c", "w1", True, 1, "ended"), ("c", "w1", True, 1, "ended"), ("c", "w3", False, None, None), ("c", "none", False, None, None), (None, "w2", False, None, None)]))
    assert asked() == want
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert asked() == want


@pytest.mark.parametrize("name", ["outcome_kinds", "outcome_changes", "outcome_attempts", "outcome_successors"])
def test_many_outcomes_do_not_go_through_the_driver(spark, monkeypatch, name):
    """Runs, and what follows from each outcome, were broadcast; so were items, as the batch was derived."""
    from stagebook.operators import outcomes
    from stagebook.sources.fixtures import Ledger

    few = sorted(str(r) for r in entry.queries()[name](spark, SMALL).collect())
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 100)
    assert broadcasts(Ledger(spark, SMALL)._derive("outcome_batch")) == 0
    sent, write = {}, outcomes.materialize
    monkeypatch.setattr(outcomes, "materialize", lambda df, tag: (sent.setdefault(tag, df._jdf.queryExecution().executedPlan().toString()), write(df, tag))[1])
    df = entry.queries()[name](spark, SMALL)
    assert "BroadcastExchange" not in sent["located-outcomes"] + sent["outcome-kinds"] and broadcasts(df) == 0
    assert sent["judged-successors"].count("BroadcastHashJoin") == 2  # stages that are declared, twice
    assert sorted(str(r) for r in df.collect()) == few != []


def test_parents_of_foreign_keys_do_not_go_through_the_driver(spark):
    """the keys of all runs were broadcast, once for each table that refers to them."""
    df = entry.queries()["fk_violations_all"](spark, SMALL)
    assert broadcasts(df) == 0 and df.count() > 0


def test_moves_are_folded_by_bucket(spark, tmp_path):
    """Each item was a call into Python in every batch; beside a null, a number beyond 2^53 was rounded."""
    from stagebook.streaming import folds

    big, schema = 2**53 + 1, "work_item_id long, seq long, new_state string"
    path = str(tmp_path / "events")
    for batch in ([(1, 2, "succeeded"), (1, 1, "admitted"), (big, None, "failed"), (big, big, "admitted"), (None, 1, "admitted"), (3, 1, "succeeded")], [(1, 3, "ready"), (None, 2, "failed"), (big, 5, "ready"), (4, 1, "cancelled")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    stream = folds.folded_moves(folds.read_files(spark, path, spark.createDataFrame([], schema).schema), 2)
    assert "bucket" in stream._jdf.queryExecution().analyzed().toString()
    got = {(r["work_item_id"], r["seq"]): (r["old_state"], r["new_state"], r["accepted"]) for r in folds.run_once(spark, stream).collect()}
    assert got == {
        (1, 1): ("ready", "admitted", True), (1, 2): ("admitted", "succeeded", True), (1, 3): ("succeeded", "ready", False), (big, big): ("ready", "admitted", True), (big, None): ("admitted", "failed", True),
        (big, 5): ("failed", "ready", True), (None, 1): ("ready", "admitted", True), (None, 2): ("admitted", "failed", True), (3, 1): ("ready", "succeeded", False), (4, 1): ("ready", "cancelled", True),
    }


def test_live_counts_look_items_up_by_their_order(spark, tmp_path, monkeypatch):
    """F8: every batch read all items of its buckets, whose number did not grow with them."""
    from stagebook.sources import snapshots
    from stagebook.streaming import folds

    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 100)
    items = spark.range(1_000).selectExpr("(id * 7919) % 1000 AS work_item_id", "'c' AS campaign_key")
    counts = folds.LiveCounts(spark, items, str(tmp_path), 4)
    head = counts.store.head()
    assert head.tables["items"].buckets == 10
    for b in range(10):
        ids = [r["work_item_id"] for r in head.read("items", [b]).collect()]
        assert ids == sorted(ids)
    moves = spark.createDataFrame([(5, "ready", "admitted", True), (900, "ready", "cancelled", True), (7, "ready", "failed", False), (None, "ready", "admitted", True)], "work_item_id long, old_state string, new_state string, accepted boolean")
    counts(moves, 0)
    counts(moves.where("false"), 1)
    assert {r["state"]: r["n"] for r in counts.now().collect()} == {"ready": 998, "admitted": 1, "cancelled": 1} and counts.store.head().batch == 1


def test_runs_settle_by_what_their_moved_items_began_with(spark, monkeypatch):
    """every batch looked for its items among those of all memberships, whether or not they ever move."""
    from stagebook.plans import passes

    seen, settled = [], passes.state.settled_runs
    monkeypatch.setattr(passes.state, "settled_runs", lambda stream, members, runs: (seen.append(members), settled(stream, members, runs))[1])
    assert entry.queries()["stream_run_settled"](spark, SMALL).count() > 0
    began = {r["work_item_id"] for r in seen[0].select("work_item_id").distinct().collect()}
    moving = {r["user_id"] + 1 for r in spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().collect()}
    assert began and began <= moving
