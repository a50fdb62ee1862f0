"""Queries against their SQL on tables that the given ones do not show: long orders, a full batch."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with ``orders`` orders of ``lines`` lines each, of customers of pipeline version 1."""

    def make(orders, lines, status, flag):
        folder = str(tmp_path_factory.mktemp("tables"))
        order = spark.range(orders)
        put = lambda df, name: df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        put(spark.sql("SELECT 0 AS n_nationkey"), "nation")
        put(spark.sql("SELECT CAST(0 AS BIGINT) AS c_custkey, 0 AS c_nationkey, 'FURNITURE' AS c_mktsegment"), "customer")
        put(order.select(F.col("id").alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.lit(status).alias("o_orderstatus"), F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority")), "orders")
        line = order.join(spark.range(lines).select(F.col("id").cast("int").alias("l_linenumber")))
        more = [F.lit(0).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.to_timestamp(F.lit("2026-01-01")).alias("l_shipdate"), F.lit(9.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice")]
        put(line.select(F.col("id").alias("l_orderkey"), "l_linenumber", *more, F.lit(flag).alias("l_returnflag"), F.lit("O").alias("l_linestatus")), "lineitem")
        put(spark.sql("SELECT CAST(0 AS BIGINT) AS event_id, TIMESTAMP '2026-01-01' AS ts, CAST(0 AS BIGINT) AS user_id, 'view' AS event_type"), "events")
        return folder

    return make


def both(spark, folder, name):
    """Rows of a query and of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("nation", "customer", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    said = con.execute(entry.oracle_sql()[name]).fetchall()
    return sorted(map(str, (tuple(r) for r in entry.queries()[name](spark, folder).collect()))), sorted(map(str, said))


@pytest.mark.parametrize("name", ["outcome_classify", "successor_rows"])
def test_outcomes_of_stages_of_long_orders(spark, tables, name):
    """Stages from the seventeenth on were changed after the day on which outcomes used to come in."""
    got, said = both(spark, tables(6, 24, "P", "N"), name)
    assert got == said and len(got) > 0


def test_a_full_pass_counts_up_to_its_last_admitted_row(spark, tables):
    got, said = both(spark, tables(10_200, 3, "O", "N"), "admission_pass_summary")
    assert got == said and any("'admitted', 9960" in r for r in got) and any("'admitted', 40" in r for r in got)


def test_only_the_spoiled_table_that_is_asked_for_is_derived(spark):
    from stagebook.plans import passes

    class Asked:
        def __init__(self):
            self.spark, self.names = spark, []

        def __getattr__(self, name):
            self.names.append(name)
            return spark.createDataFrame([], "run_key string, campaign_key string, pipeline_key string, pipeline_version int, execution_config_reference string, expected_member_count int, manifest_reference string, membership_digest string, run_completion_key string, created_at timestamp, registration_closed_at timestamp, registered_member_count int, created_work_count int, reused_work_count int, released_at timestamp, release_facts string")

    asked = Asked()
    assert list(passes._spoiled(asked, "pipeline_runs")) == ["pipeline_runs"] and asked.names == ["full_runs"]


def test_buckets_grow_with_the_table_and_few_changes_are_not_shuffled(spark, tmp_path, monkeypatch):
    """a bucket that holds ever more rows is one ever larger task; an update of few rows leaves the others in the tasks that read them."""
    from stagebook.sources import snapshots

    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 100)
    rows = spark.range(1_000).select("id", F.lit("ready").alias("state"))
    assert snapshots.buckets_for(rows, 4) == 10 and snapshots.buckets_for(rows, 16) == 16
    store = snapshots.Snapshots(spark, str(tmp_path))
    change = store.begin()
    change.create("t", rows, ["id"], 1)
    change.commit()
    dealt, write = [], snapshots.Change._write
    monkeypatch.setattr(snapshots.Change, "_write", lambda self, table, rows, placed=False: (dealt.append(not placed), write(self, table, rows, placed))[1])
    for k in range(6):
        change = store.begin()
        change.update("t", rows.where(f"id = {k}").withColumn("state", F.lit("done")), rows.where(f"id = {k}").withColumn("id", F.col("id") - 100))
        change.commit()
    assert dealt == [False, False, False, True, False, False]  # dealt out again before inserts have worn a bucket into many files
    found = {r["id"]: r["state"] for r in store.head().read("t").collect()}
    assert len(found) == store.head().read("t").count() == 1_006 and {i for i, s in found.items() if s == "done"} == set(range(6))


@pytest.mark.parametrize("name", ["priority_changes", "set_priority_all", "fanout_problems", "retry_ended_stages", "retry_stages_all", "fk_violations_all", "records_of_stages"])
def test_parts_grow_with_the_tables(spark, monkeypatch, name):
    """What a task sorts or groups is bounded by rows, whatever the session's number of partitions."""
    import re

    from stagebook.sources import shared

    monkeypatch.setattr(shared, "PART_ROWS", 500)
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]
    assert dealt and max(dealt) >= 12 and df.count() > 0


def test_an_ended_attempt_counts_for_the_current_attempt_alone(spark):
    from stagebook.operators.recovery import retry_stages

    stages = spark.createDataFrame([(1, "failed", 2), (2, "failed", 1), (3, "ready", 0)], "stage_execution_id long, state string, current_attempt int")
    attempts = spark.sql("SELECT * FROM VALUES (1L, 1, TIMESTAMP '2026-01-01'), (1L, 2, NULL), (2L, 1, TIMESTAMP '2026-01-01') AS t(stage_execution_id, attempt_number, terminal_at)")
    wanted = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "stage_execution_id long")
    got = sorted(tuple(r) for r in retry_stages(wanted, stages, attempts).collect())
    assert got == [(1, "open_attempt", None), (2, "retry", 2), (3, "not_failed", None), (4, "unknown", None)]


MEMBERS = "run_key string, campaign_key string, member_ordinal int, work_key string, input_reference string, labels map<string,string>, priority int"


def test_registration_looks_at_the_items_that_a_batch_names(spark, tmp_path, monkeypatch):
    """F16: each batch shuffled all items that were known, several times, and their buckets did not grow with them."""
    from stagebook.sources import snapshots
    from stagebook.streaming import folds

    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 100)
    items = spark.range(1_000).select(F.lit("c").alias("campaign_key"), F.concat(F.lit("w"), "id").alias("work_key"), F.col("id").alias("work_item_id"), F.lit("r").alias("origin_run_key"), F.lit("in").alias("input_reference"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"), F.lit(1).cast("long").alias("rank"), F.lit(0).alias("priority"))
    registration = folds.Registration(spark, items, spark.sql("SELECT 'r' AS run_key"), str(tmp_path), 4)
    assert registration.store.head().tables["items"].buckets == 10
    members = spark.createDataFrame([("r", "c", k, w, "in", {"a": "b"}, 0) for k, w in enumerate(("w7", "w70", "w700", "none", None))], MEMBERS)
    assert {r["work_key"] for r in registration.known(members).collect()} == {"w7", "w70", "w700"}
    monkeypatch.setattr(folds, "HASHES", 2)
    assert {"w7", "w70", "w700"} <= {r["work_key"] for r in registration.known(members).collect()}


def test_repeated_members_are_told_by_their_keys(spark):
    from stagebook.operators.registration import member_problems

    m = lambda run, k, w, p=0: (run, "c", k, w, "in", {"a": "b"}, p)
    rows = [m("r", 0, "a"), m("r", 1, "a"), m("r", 2, "b"), m("r", 2, "c"), m("r", 3, "d"), m("q", 0, "a"), m("q", 1, "b", -1), m(None, 0, "a"), m(None, 0, "b"), m("q", None, "e")]
    got = {(r["run_key"], r["work_key"]): r["reason"] for r in member_problems(spark.createDataFrame(rows, MEMBERS)).collect()}
    assert got == {("r", "a"): "one_row_of_a_work_key", ("r", "b"): "one_row_of_an_ordinal", ("r", "c"): "one_row_of_an_ordinal", ("q", "b"): "priority_in_range", ("q", "e"): "ordinal_not_negative"}


@pytest.mark.parametrize("left", [0, 1_000_000])
def test_submissions_give_items_of_rejected_runs_to_the_next_run(spark, monkeypatch, left):
    """what was asked of every member several times is asked once; the rules stay, whether few or many runs are turned away."""
    from stagebook.functions.expressions import stable_rank
    from stagebook.operators import registration
    from stagebook.sources import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", left)
    facts = ", ".join(f"{c} {'int' if c in ('pipeline_version', 'expected_member_count') else 'string'}" for c in registration.PROVENANCE)
    declarations = spark.createDataFrame([(r, "c", "p", 1, "cfg", n, None, None, None) for r, n in (("a", 2), ("b", 2), ("d", 1), ("e", 1), ("f", 1))], f"run_key string, {facts}")
    stored_runs = declarations.where("run_key = 'a'").withColumn("registration_closed_at", F.lit(None).cast("timestamp")).withColumns({c: F.lit(None).cast("int") for c in ("registered_member_count", "created_work_count", "reused_work_count")})
    items = spark.createDataFrame([("c", "old", 7, "a", "in", {"a": "b"}, 0)], "campaign_key string, work_key string, work_item_id long, origin_run_key string, input_reference string, labels map<string,string>, priority int").withColumn("rank", stable_rank("campaign_key", "work_key"))
    memberships = spark.createDataFrame([("a", 5, 99)], "run_key string, member_ordinal int, work_item_id long")
    m = lambda run, k, w, i="in": (run, "c", k, w, i, {"a": "b"}, 0)
    # a differs from what is stored, b shares an item that a made and keeps it from being closed; d and e disagree, f brings what d brought too
    members = spark.createDataFrame([m("a", 0, "old"), m("a", 1, "x"), m("b", 0, "x"), m("b", 1, "y"), m("d", 0, "z"), m("e", 0, "z", "other"), m("f", 0, "old")], MEMBERS)
    digested, digests = [], registration.ordered_digests
    monkeypatch.setattr(registration, "ordered_digests", lambda rows, *more: (digested.append(rows.count()), digests(rows, *more))[1])
    declared = spark.sql("SELECT 'p' AS pipeline_key, 1 AS pipeline_version, 0 AS position, 's' AS stage_key")
    done = registration.submit(declarations, members, stored_runs, items, memberships, declared, "run-membership/v1", F.to_timestamp(F.lit("2026-01-01")))
    assert {(r["run_key"], r["registered_count"], r["created_count"]) for r in done.receipts.collect()} == {("f", 1, 0)}
    assert {(r["run_key"], r["reason"]) for r in done.rejects.collect()} == {("a", "other_members"), ("b", "gapless"), ("d", "disputed"), ("e", "disputed")}
    assert {(r["work_key"], r["origin_run_key"]) for r in done.items.collect()} == {("y", "b")}
    assert digested == [0]  # none of the runs declared a digest


def test_the_view_keeps_what_is_asked_for_and_deals_many_changes_once(spark, tmp_path, monkeypatch):
    """a view for counts by campaign had the memberships too, and an update of many rows shuffled the table for the join and again for its buckets."""
    from stagebook.operators import views
    from stagebook.sources import snapshots

    monkeypatch.setattr(snapshots, "BROADCAST_ROWS", 5)
    stages = spark.range(300).select(F.col("id").alias("stage_execution_id"), (F.col("id") % 100).alias("work_item_id"), F.lit("s").alias("stage_key"), F.lit(0).alias("stage_index"), F.lit("ready").alias("state"))
    store = snapshots.Snapshots(spark, str(tmp_path))
    change = store.begin()
    views.build(change, stages, memberships=spark.range(100).select(F.col("id").alias("work_item_id"), F.lit("r").alias("run_key")), buckets=8)
    assert set(change.tables) == {"stages", "members", "status", "run_counts"}
    change.commit()
    plans, write = [], snapshots.Change._write

    def seen(self, table, rows, placed=False):
        if table.keys == ["work_item_id"] and "stage_index" in rows.columns and placed:
            plan = rows._jdf.queryExecution().executedPlan().toString()
            plans.append((plan.count("Exchange hashpartitioning"), plan.count("REPARTITION_BY_NUM")))
        return write(self, table, rows, placed)

    monkeypatch.setattr(snapshots.Change, "_write", seen)
    change = store.begin()
    views.update_stages(change, stages.where("work_item_id < 50").select("stage_execution_id", "work_item_id", F.lit("failed").alias("state"), F.lit("ready").alias("expected")), guard="state")
    new = change.commit()
    assert plans == [(2, 2)]  # the rows and the changes, once each
    assert {tuple(r) for r in views.run_counts(new).collect()} == {("r", "failed", 50), ("r", "ready", 50)}
    assert {(r["state"], r["count"]) for r in new.read("stages").groupBy("state").count().collect()} == {("failed", 150), ("ready", 150)}
    assert all(len(new.read("stages", [int(b)]).inputFiles()) == 1 for b in new.tables["stages"].entries)


def test_the_outbox_does_not_derive_the_full_attempts(spark):
    """the full attempts and executions were derived and written for the few attempts of planned stages."""
    from stagebook.plans import passes
    from stagebook.sources.fixtures import Ledger

    t = Ledger(spark, "/root/testdata/sf0.001")
    outbox = passes._pass(t).outbox
    assert "full_attempts" not in t.built and "full_executions" not in t.built and outbox.count() > 0


def test_pages_of_failed_members_look_up_failed_stages_alone(spark):
    """all stages were shuffled for their items' status and all attempts for the current ones; the runs' counts were derived to tell known runs."""
    from stagebook.plans import reading
    from stagebook.sources.fixtures import Ledger

    t = Ledger(spark, "/root/testdata/sf0.001")
    got = sorted(str(tuple(r)) for r in reading.pages_of_failed_members(t).collect())
    assert "stage_attempts" not in t.built and "full_runs" not in t.built and len(got) > 0
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    assert got == sorted(map(str, con.execute(entry.oracle_sql()["pages_of_failed_members"]).fetchall()))


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
@pytest.mark.parametrize("states", [("failed",), ("cancelled", "failed"), ("succeeded",), ("ready", "succeeded")])
def test_states_of_a_condition_leave_the_pages_as_they_are(spark, monkeypatch, states, broadcast):
    """only stages that can stand for an item in the states asked for are looked at, whether few or many rows are asked for."""
    from stagebook.operators import readers
    from stagebook.sources import shared

    monkeypatch.setattr(readers, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(readers, "BLOCK", 3)
    monkeypatch.setattr(readers, "ROWS_PER_PART", 20)
    of = {i: [readers.STATES[(i * 7 + k * (i % 3 + 1)) % 5] for k in range(i % 4)] for i in range(1, 61)}
    order = {"failed": 0, "cancelled": 1, "admitted": 2, "ready": 3, "succeeded": 4}
    stands = {i: min((order[s], -k if s == "succeeded" else k, s) for k, s in enumerate(own))[2] for i, own in of.items() if own}
    stages = spark.createDataFrame([(i * 10 + k, i, f"s{k}", k, s, 1) for i, own in of.items() for k, s in enumerate(own)], "stage_execution_id long, work_item_id long, stage_key string, stage_index int, state string, current_attempt int")
    asked = []

    def attempts(wanted):
        asked.extend(r["state"] for r in wanted.collect())
        return wanted.select("stage_execution_id", F.lit(1).alias("attempt_number"), F.lit("{}").alias("terminal_summary"), F.lit(None).cast("string").alias("evidence_reference"))

    members = spark.createDataFrame([(f"r{i % 2}", i, i) for i in of], "run_key string, member_ordinal int, work_item_id long")
    items = spark.createDataFrame([(i, f"w{i}", f"in{i}") for i in of], "work_item_id long, work_key string, input_reference string")
    requests = [(i, f"r{i % 2}", None if i % 5 == 0 else i, i % 7 + 1) for i in of] + [(90, "r0", 1, 2), (91, "none", None, 2), (92, "r1", None, 4), (92, "r1", None, 4)]
    read = readers.run_member_pages(spark.createDataFrame(requests, "request_id long, run_key string, cursor int, page_size int"), spark.createDataFrame([("r0",), ("r1",), ("r2",)], "run_key string"), members, items, stages, attempts, F.col("state").isin(*states), states)
    want = {}
    for k, run, cursor, size in requests[:60]:
        found = [i for i in of if f"r{i % 2}" == run and stands.get(i) in states and (cursor is None or i > cursor)]
        want |= {(k, n): i for n, i in enumerate(found[:size], 1)}
    got = read.rows.collect()
    assert {(r["request_id"], r["nth"]): r["work_item_id"] for r in got} == want and len(got) == len(want) > 20
    assert set(asked) == set(states) and all(r["state"] == stands[r["work_item_id"]] and r["work_key"] == f"w{r['work_item_id']}" for r in got)
    assert {tuple(r) for r in read.rejects.collect()} == {(90, "unknown_cursor"), (91, "unknown_run"), (92, "repeated_request")}
