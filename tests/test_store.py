"""Versioned snapshots and logs, streams over several batches with restarts, and passes that are committed once."""

import pytest
from pyspark.sql import functions as F

from stagebook.operators import integrity
from stagebook.sources.snapshots import Conflict, Snapshots, changed_buckets
from stagebook.streaming import folds, state


def parts(version, name):
    """Folder of every bucket."""
    return {b: [f for f, _ in e] for b, e in version.tables[name].entries.items()}


@pytest.fixture()
def store(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    change = store.begin()
    rows = spark.range(1000).select("id", F.lit("ready").alias("state"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("labels"))
    change.create("items", rows, ["id"], 32)
    assert store.numbers() == []  # nothing is seen before the commit
    change.commit()
    return store


def test_an_update_rewrites_its_buckets_alone(spark, store):
    old = store.head()
    updates = spark.range(0, 1000, 100).select("id", F.lit("admitted").alias("state"), F.when(F.col("id") == 300, "failed").otherwise("ready").alias("expected"))
    inserts = spark.createDataFrame([(5, "new", {}), (2000, "new", {"a": "b"})], "id long, state string, labels map<string,string>")
    change = store.begin()
    touched = change.update("items", updates, inserts, guard="state")
    new = change.commit()
    before, after = parts(old, "items"), parts(new, "items")
    moved = {int(b) for b in after if after[b] != before.get(b)}
    assert moved == set(touched) and len(moved) <= 12
    # the guard kept 300 as it was, so its bucket was written again and still is equal
    assert set(changed_buckets(old, new, "items")) <= set(touched)
    states = {r["id"]: r["state"] for r in new.read("items").collect()}
    assert len(states) == 1001 and states[5] == "ready" and states[2000] == "new"
    assert {i for i, s in states.items() if s == "admitted"} == {0, 100, 200, 400, 500, 600, 700, 800, 900}
    assert {r["state"] for r in old.read("items").collect()} == {"ready"}  # the old version is as it was


def test_of_two_writers_one_is_rejected(spark, store):
    first, second = store.begin(), store.begin()
    for change, state_ in ((first, "admitted"), (second, "failed")):
        change.update("items", spark.range(7, 8).select("id", F.lit(state_).alias("state")))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert store.numbers() == [1, 2] and [r["state"] for r in store.head().read("items").where("id = 7").collect()] == ["admitted"]


def test_buckets_that_are_equal_are_not_read(spark, store):
    old = store.head()
    change = store.begin()
    change.update("items", spark.range(7, 8).select("id", F.create_map(F.lit("k"), F.lit("8")).alias("labels")))
    new = change.commit()
    differ = changed_buckets(old, new, "items")
    assert len(differ) == 1
    files = new.read("items", differ).inputFiles()
    assert all(f"/bucket={differ[0]}/" in f for f in files) and len(files) < len(new.read("items").inputFiles())
    assert changed_buckets(old, old, "items") == [] and old.read("items", []).count() == 0
    # the order in which a map holds its entries is no difference, a null is
    rows = lambda labels: spark.createDataFrame([(1, labels)], "id long, labels map<string,string>")
    versions = []
    for labels in ({"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "1", "b": None}):
        change = store.begin()
        change.create("other", rows(labels), ["id"], 4)
        versions.append(change.commit())
    assert changed_buckets(versions[0], versions[1], "other") == [] and len(changed_buckets(versions[1], versions[2], "other")) == 1


def test_frozen_facts_between_versions(spark, tmp_path):
    from stagebook.plans import passes
    from stagebook.sources.fixtures import Ledger

    t = Ledger(spark, "/root/testdata/sf0.001")
    new_runs = passes._spoiled(t)["pipeline_runs"].select(*t.full_runs.columns)
    store = Snapshots(spark, str(tmp_path))
    change = store.begin()
    change.create("pipeline_runs", t.full_runs, ["run_key"], 16)
    change.create("run_memberships", t.run_memberships, ["run_key", "member_ordinal"], 16)
    old = change.commit()
    change = store.begin()
    change.create("pipeline_runs", new_runs, ["run_key"], 16)
    change.create("run_memberships", t.run_memberships.where("work_item_id <> 3").unionByName(t.run_memberships.where("work_item_id = 4")), ["run_key", "member_ordinal"], 16)
    new = change.commit()
    as_set = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert as_set(integrity.changed_facts_between(old, new)) == as_set(integrity.changed_facts(t.full_runs, new_runs)) != []
    closed = {r[0] for r in t.full_runs.where("registration_closed_at IS NOT NULL").select("run_key").collect()}
    moved = [(r["run_key"], r["work_item_id"], "removed" if r["work_item_id"] == 3 else "added") for r in t.run_memberships.where("work_item_id IN (3, 4)").collect() if r["run_key"] in closed]
    assert sorted((r["run_key"], r["work_item_id"], r["change"]) for r in integrity.frozen_members_between(old, new).collect()) == sorted(moved) != []


def nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_a_log_is_compacted_and_read_in_one_scan(spark, tmp_path):
    store, sizes = Snapshots(spark, str(tmp_path)), []
    total = lambda log: log.groupBy("key").agg(F.sum("n").alias("n"))
    for k in range(21):
        change = store.begin()
        change.append("log", spark.createDataFrame([("a", 1), (f"b{k % 3}", k)], "key string, n long"), ["key"], 4, total if k % 2 else None)
        version = change.commit(k)
        sizes.append(nodes(version.read("log")))
        assert all(sum(x[1] == level for x in e) < 4 for e in version.tables["log"].entries.values() for level in range(4))
    assert set(sizes) == {sizes[0]}  # the plan does not grow with the batches
    assert {r["key"]: r["n"] for r in total(store.head().read("log")).collect()} == {"a": 21, **{f"b{j}": sum(range(j, 21, 3)) for j in range(3)}}
    assert max(x[1] for e in store.head().tables["log"].entries.values() for x in e) == 2
    assert max(map(len, store.head().tables["log"].entries.values())) <= 9  # three of a level, three levels


# ---------------------------------------------------------------- streams

EVENTS = "work_item_id long, seq long, new_state string, run_key string, closes boolean"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_runs_settle_once_over_batches_and_restarts(spark, tmp_path):
    """A member of two runs fails, is retried and succeeds; members and runs come late; every batch is a start of its own."""
    runs = spark.createDataFrame([("a", True), ("b", True), ("open", False), ("empty", True), ("done", True)], "run_key string, closed boolean")
    runs = runs.withColumn("registration_closed_at", F.when(F.col("closed"), F.to_timestamp(F.lit("2026-01-01"))))
    members = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("open", 2), ("done", 9), ("a", 8)], "run_key string, work_item_id long")
    states = spark.createDataFrame([(1, "admitted"), (2, "admitted"), (9, "failed")], "work_item_id long, state string")  # 8 has no stage
    start, all_runs = state.open_at_start(runs, members, states)
    assert {r["run_key"] for r in all_runs.where("released").collect()} == {"empty", "done"}
    path, held, got = str(tmp_path / "in"), str(tmp_path / "held"), []
    move = lambda i, s, n: (i, s, n, None, None)
    batches = [
        [move(1, 1, "failed")],
        [move(1, 2, "ready"), move(7, 3, "admitted"), (7, 4, None, "late", None), (None, None, None, "later", True)],
        [move(1, 5, "succeeded"), move(2, 6, "cancelled"), (None, None, None, "late", True)],
        [move(2, 7, "ready"), (None, None, None, "open", True), move(9, 8, "ready")],
        [move(2, 10, "admitted"), move(2, 9, "failed"), move(7, 11, "failed"), move(7, 11, "failed")],
        [move(2, 12, "failed"), move(9, 13, "succeeded"), move(1, 14, "ready")],
        [move(1, 15, "cancelled")],
    ]
    for rows in batches:
        put(spark, path, rows, EVENTS)
        stream = folds.read_files(spark, path, spark.createDataFrame([], EVENTS).schema)
        out = folds.run_once(spark, state.settled_runs(stream, start, all_runs.where("NOT released")), state=held)
        got.append(sorted(r["run_key"] for r in out.collect()))
    assert got == [["a"], ["later"], ["b"], [], ["late"], ["open"], []]


def test_moves_in_the_order_of_time_with_late_ones_rejected(spark, tmp_path):
    path, held = str(tmp_path / "in"), str(tmp_path / "held")
    schema = "work_item_id long, seq long, new_state string, second long"
    batches = [
        [(1, 2, "succeeded", 20), (1, 1, "admitted", 10), (2, 1, "admitted", 12)],
        [(2, 3, "failed", 40), (2, 2, "succeeded", 15), (3, 1, "admitted", 31)],  # behind the greatest time, within the delay
        [(3, 2, "failed", 29), (3, 3, "failed", 60), (1, 3, "ready", 25)],  # before 40 - 10: two late ones
        [(None, -1, "", 1000)],
    ]
    out = []
    for rows in batches:
        put(spark, path, rows, schema)
        stream = folds.read_files(spark, path, spark.createDataFrame([], schema).schema).withColumn("ts", F.timestamp_seconds(F.col("second") + 1_000_000)).drop("second")
        out += [tuple(r) for r in folds.run_once(spark, state.ordered_moves(stream, "10 seconds"), state=held).collect()]
    assert sorted(out, key=lambda r: (r[0], r[1])) == [
        (1, 1, "ready", "admitted", "accepted"), (1, 2, "admitted", "succeeded", "accepted"), (1, 3, None, "ready", "late"),
        (2, 1, "ready", "admitted", "accepted"), (2, 2, "admitted", "succeeded", "accepted"), (2, 3, "succeeded", "failed", "illegal"),
        (3, 1, "ready", "admitted", "accepted"), (3, 2, None, "failed", "late"), (3, 3, "admitted", "failed", "accepted"),
    ]


def test_live_counts_go_on_in_another_process_and_count_nothing_twice(spark, tmp_path):
    items = spark.createDataFrame([(1, "c"), (2, "c"), (3, "d")], "work_item_id long, campaign_key string")
    moves = lambda *m: spark.createDataFrame([(i, s, o, n, True) for s, (i, o, n) in enumerate(m)], "work_item_id long, seq long, old_state string, new_state string, accepted boolean")
    base = str(tmp_path / "counts")
    folds.LiveCounts(spark, items, base, 4)(moves((1, "ready", "admitted"), (3, "ready", "cancelled")), 0)
    for k in (0, 1, 1, 0, 2):  # batches that come again, each to a process that knows the folder alone
        folds.LiveCounts(spark, base=base, buckets=4)(moves((1, "admitted", "failed")) if k == 1 else moves((1, "failed", "ready")) if k == 2 else moves((2, "ready", "admitted")), k)
        folds.LiveCounts(spark, base=base, buckets=4)
    got = {(r["campaign_key"], r["state"]): r["n"] for r in folds.LiveCounts(spark, base=base).now().collect()}
    assert got == {("c", "ready"): 2, ("d", "cancelled"): 1} and folds.LiveCounts(spark, base=base).store.head().batch == 2


def test_registration_knows_items_of_earlier_batches(spark, tmp_path):
    runs = spark.createDataFrame([(f"r{k}", "p", 1, "cfg", None) for k in range(9)], "run_key string, pipeline_key string, pipeline_version int, execution_config_reference string, closed string")
    runs = runs.withColumn("registration_closed_at", F.to_timestamp("closed")).drop("closed")
    items = spark.createDataFrame([], "campaign_key string, work_key string, work_item_id long, origin_run_key string, input_reference string, labels map<string,string>, rank long, priority int")
    one = lambda run, *works: spark.createDataFrame([(run, "c", n, w, f"in:{w}", {"a": "b"}, 0) for n, w in enumerate(works)], "run_key string, campaign_key string, member_ordinal int, work_key string, input_reference string, labels map<string,string>, priority int")
    base, sizes = str(tmp_path / "registration"), []
    for k in range(9):
        registration = folds.Registration(spark, items, runs, base, 4)
        members = one(f"r{k}", "shared", f"own{k}")
        registration(members, k)
        registration(one(f"r{k}", "never"), k)  # the batch comes again
        sizes.append(nodes(registration.known(members)))
    kinds = sorted((r["run_key"], r["work_key"], r["kind"]) for r in registration.read("members").collect())
    assert kinds == sorted([("r0", "shared", "new"), *[(f"r{k}", "shared", "same") for k in range(1, 9)], *[(f"r{k}", f"own{k}", "new") for k in range(9)]])
    assert registration.read("items").count() == 10 and registration.read("rejects").count() == 0
    assert len(set(sizes)) == 1


def test_a_failed_and_repeated_tick_leaves_one_version(spark, store):
    done = []

    def admit(change):
        change.update("items", spark.range(3).select("id", F.lit("admitted").alias("state"), F.lit("ready").alias("expected")), guard="state")

    def release(change):
        done.append(change.now().read("items").where("state = 'admitted'").count())  # sees what the pass before it did
        if len(done) == 1:
            raise RuntimeError("lost")
        change.append("outbox", change.now().read("items").where("state = 'admitted'").select("id"), ["id"], 4)

    tick = folds.committed(store, admit, release)
    with pytest.raises(RuntimeError):
        tick(0)
    assert store.numbers() == [1] and store.head().read("items").where("state = 'admitted'").count() == 0
    assert [tick(0), tick(0), folds.committed(store, admit, release)(0)] == [True, False, False]
    assert store.numbers() == [1, 2] and done == [3, 3] and store.head().read("outbox").count() == 3
    assert folds.periodically(spark, folds.committed(store, release), 0.2, times=2) == 2 and store.head().batch >= 1


def test_files_of_a_stream_follow_each_other_and_keep_their_rows(spark, tmp_path):
    """Files from a number on are added behind those that are there, an empty one too, and each row is dealt out once."""
    rows = spark.range(60).withColumn("seq", F.col("id"))
    file = F.when(F.col("id") < 20, 0).when(F.col("id") < 40, 1).otherwise(3)  # nothing for 2
    path = folds.in_files(rows.where("id < 40"), file, 2, "dealt")
    assert folds.in_files(rows.where("id >= 40"), file, 2, "dealt", path, 2) == path
    out = folds.run_once(spark, folds.read_files(spark, path, rows.schema), numbered=True)
    assert sorted((r["id"], r["batch"]) for r in out.collect()) == [(k, (0, 1, 3)[k // 20]) for k in range(60)]


def test_streams_keep_a_bounded_number_of_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "999")
    try:
        with state.for_streams(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= max(4, spark.sparkContext.defaultParallelism)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "999"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_memberships_at_the_start_are_looked_up_and_not_put_into_the_state(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS work_item_id", "value AS seq", "'failed' AS new_state", "CAST(NULL AS STRING) AS run_key", "false AS closes")
    members = spark.createDataFrame([(1, "a", True)], "work_item_id long, run_key string, open boolean")
    runs = spark.createDataFrame([("a", 1, True, False)], "run_key string, open long, closed boolean, released boolean")
    plan = state.settled_runs(stream, members, runs)._jdf.queryExecution().logical().toString()
    assert plan.count("TransformWithStateIn") == 2 and plan.count("LocalRelation <empty>") >= 2
