"""Keyset pages that open few files, status kept up to date, the paged admission pass, and a database as a source."""

import random

import pytest
from pyspark.sql import functions as F

from stagebook.operators import admission, status, views
from stagebook.sources import pages, schemas
from stagebook.sources.snapshots import Snapshots

EXECUTIONS = "stage_execution_id long, work_item_id long, stage_key string, stage_index int, state string"


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("ordered"))
    runs = spark.range(2005).select(
        F.format_string("r%04d", "id").alias("run_key"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("campaign_key"), F.timestamp_seconds(F.col("id") % 50).alias("created_at"),
        F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.lit(99))).alias("registration_closed_at"), F.lit(7).alias("registered_member_count"),
    )
    members = spark.range(20_050).select(F.format_string("r%04d", F.col("id") % 2005).alias("run_key"), F.floor(F.col("id") / 2005).cast("int").alias("member_ordinal"), F.col("id").alias("work_item_id"))
    return pages.write_ordered(runs, ["campaign_key", "created_at", "run_key"], f"{base}/runs", 100), pages.write_ordered(members, ["run_key", "member_ordinal"], f"{base}/members", 1000), runs, members


def test_a_page_opens_the_files_behind_its_cursor(spark, ordered):
    by_created, by_run, runs, members = ordered
    assert by_created.bounds().count() == 21
    cursor, seen = None, []
    want = [r["run_key"] for r in runs.where("campaign_key = 'a'").orderBy("created_at", "run_key").collect()]
    for _ in range(3):
        assert len(by_created.files(["a"], cursor, 5)) <= 2
        page = by_created.page(["a"], cursor, 5)
        assert "PushedFilters: [" in page._jdf.queryExecution().executedPlan().toString() and len(page.inputFiles()) <= 2
        rows = page.collect()
        seen += [r["run_key"] for r in rows]
        cursor = [rows[-1]["created_at"], rows[-1]["run_key"]]
    assert seen == want[:15]
    assert [r["run_key"] for r in by_created.page(["b"], None, 9).collect()] == [f"r{k}" for k in range(2000, 2005)]
    assert by_created.page(["none"], None, 9).count() == 0 and by_created.page(["b"], [cursor[0].replace(year=2100), "z"], 9).count() == 0
    assert [r["run_key"] for r in by_created.page(["a"], None, 3, F.col("run_key") > "r1990").collect()] == [k for k in want if k > "r1990"][:3]
    one = status.runs_page(by_created, by_run, "a", None, 5)
    old = status.list_runs(runs, members, "a", None, 5)
    assert sorted(map(tuple, one.select("run_key", "member_count").collect())) == sorted(map(tuple, old.select("run_key", "member_count").collect()))
    assert len(by_run.of_keys(["r0001", "r0003"]).inputFiles()) <= 2 and by_run.of_keys(["r0001", "r0003"]).count() == 20


def test_readers_by_pages_agree_with_whole_tables(spark, tmp_path):
    rng = random.Random(4)
    executions = spark.createDataFrame([(i * 10 + k, i, "s", k, rng.choice(["ready", "failed", "succeeded"])) for i in range(300) for k in range(i % 4)], EXECUTIONS)
    items = spark.createDataFrame([("c" if i % 5 else "d", i, f"w{i}", f"in:{i}") for i in range(300)], "campaign_key string, work_item_id long, work_key string, input_reference string")
    members = spark.createDataFrame([(f"r{i % 3}", i // 3, i) for i in range(300)], "run_key string, member_ordinal int, work_item_id long")
    at = lambda rows, keys, name, n=40: pages.write_ordered(rows, keys, str(tmp_path / name), n)
    by_campaign, by_item, stages, by_run = at(items, ["campaign_key", "work_item_id"], "a"), at(items, ["work_item_id"], "b"), at(executions, ["work_item_id"], "c"), at(members, ["run_key", "member_ordinal"], "d")
    columns = ["work_item_id", "state"]
    for cursor, limit in ((None, 10), (100, 25), (290, 50)):
        got = status.work_items_page(by_campaign, stages, "c", None if cursor is None else [cursor], limit).select(*columns).collect()
        assert got == status.list_work_items(items, executions, "c", None, cursor, limit).select(*columns).collect()
        got = status.run_members_page(by_run, by_item, stages, "r1", None if cursor is None else [cursor // 4], limit).select("member_ordinal", *columns).collect()
        want = status.page(status.run_members(members, items, executions, "r1"), ["member_ordinal"], None if cursor is None else [cursor // 4], limit)
        assert got == want.select("member_ordinal", *columns).collect()


def test_the_status_view_equals_a_full_recomputation(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 10 + k, i, "s", k, rng.choice(["ready", "admitted"])) for i in range(200) for k in range(i % 4)]
    items = spark.createDataFrame([(i, f"c{i % 3}") for i in range(205)], "work_item_id long, campaign_key string")
    members = spark.createDataFrame([(f"r{j}", i) for i in range(205) for j in range(3) if i % (j + 1) == 0], "run_key string, work_item_id long")
    store = Snapshots(spark, str(tmp_path))
    change = store.begin()
    views.build(change, spark.createDataFrame(rows, EXECUTIONS), items, members, 16)
    change.commit()
    as_set = lambda df: sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    for step in range(3):
        at = store.head()
        stages = at.read("stages").collect()
        chosen = rng.sample(stages, 12)
        updates = spark.createDataFrame([(r["stage_execution_id"], r["work_item_id"], rng.choice(["succeeded", "failed", "cancelled", "ready"]), r["state"] if k else "never") for k, r in enumerate(chosen)], "stage_execution_id long, work_item_id long, state string, expected string")
        added = spark.createDataFrame([(9000 + step * 10 + k, i, "t", 7, "ready") for k, i in enumerate((step, 202 + step, 4))], EXECUTIONS)
        change = store.begin()
        touched = views.update_stages(change, updates, added, guard="state")
        new = change.commit()
        assert len(touched) < 16
        executions = new.read("stages")
        assert executions.count() == len(stages) + 3
        assert as_set(new.read("status")) == as_set(status.work_item_status(executions).select("work_item_id", "stage_execution_id", "stage_key", "stage_index", "state"))
        assert as_set(views.campaign_counts(new)) == as_set(status.campaign_state_counts(items, executions))
        assert as_set(views.run_counts(new)) == as_set(status.run_state_counts(members, executions))


def by_pages(candidates, controls, batch, skips):
    """The rule page by page. candidates: (id, stage, blocked, labels, declared) in order; controls: id, stage, selector, capacity, occupied, paused."""
    occupied = {c[0]: c[4] for c in controls}
    full, excluded, fates, at, admitted, considered = set(), set(), {}, 0, 0, 0
    match = lambda row: [c for c in controls if c[1] == row[1] and all(row[3].get(k) == v for k, v in c[2].items())]
    while admitted < batch and considered < batch + skips:
        limit, page = min(batch - admitted, batch + skips - considered), []
        for k in range(at, len(candidates)):
            if len(page) == limit:
                break
            row = candidates[k]
            if row[1] not in excluded and not any(c[5] or c[0] in full for c in match(row)):
                page.append(row)
                at = k + 1
        if not page:
            break
        considered += len(page)
        excluded |= {row[1] for row in page if not any(c[1] == row[1] and not c[2] for c in controls)}
        for row in page:
            if row[1] in excluded:
                fates[row[0]] = "unconfigured"
            elif row[2]:
                fates[row[0]] = "barrier"
            elif short := {c[0] for c in match(row) if occupied[c[0]] >= c[3]}:
                fates[row[0]] = "capacity"
                full |= short
            elif not row[4]:
                fates[row[0]] = "mismatched"
            else:
                fates[row[0]] = "admitted"
                admitted += 1
                for c in match(row):
                    occupied[c[0]] += 1
                    if occupied[c[0]] >= c[3]:
                        full.add(c[0])
                if admitted >= batch:
                    break
    return fates


def test_the_paged_pass_against_the_rule(spark):
    rng = random.Random(12)
    kinds = set()
    for case in range(6):
        batch, skips = rng.choice([(3, 4), (10, 5), (25, 1000), (60, 1000)])
        stages = ["x", "y", "z", "w"]
        rows, executions = [], []
        for i in range(60):
            blocked = rng.random() < 0.2
            stage = rng.choice(stages)
            executions += [(i * 10, i, "low", 0, "admitted" if blocked else "succeeded", False), (i * 10 + 1, i, stage, 1, "ready", True)]
            rows.append((i * 10 + 1, i, stage, 1, "ready", True, {"c": rng.choice("ab"), "d": rng.choice("ab")}, rng.randrange(3), rng.randrange(100), "p", 1))
        controls = [(1, "x", {}, rng.randrange(1, 20), 0, False), (2, "x", {"c": "a"}, rng.randrange(1, 5), rng.randrange(3), False), (3, "y", {}, rng.randrange(9), 0, False), (4, "y", {"d": "b"}, 5, 0, True), (5, "z", {"c": "a"}, 3, 0, False), (6, "w", {}, 50, 0, False)]
        table = spark.createDataFrame(rows, "stage_execution_id long, work_item_id long, stage_key string, stage_index int, state string, barrier boolean, labels map<string,string>, priority int, rank long, pipeline_key string, pipeline_version int")
        every = spark.createDataFrame(executions, EXECUTIONS + ", barrier boolean")
        occupancy = spark.createDataFrame([(c[0], "p", 1, c[1], c[2], c[3], c[4], c[5]) for c in controls], "stage_control_id long, pipeline_key string, pipeline_version int, stage_key string, selector map<string,string>, capacity int, occupied long, paused boolean")
        declared = spark.createDataFrame([("p", 1, s) for s in "xyz"], "pipeline_key string, pipeline_version int, stage_key string")
        state = {e[0]: e[4] for e in executions}
        order = sorted(rows, key=lambda r: (r[7], r[8], r[0]))
        want = by_pages([(r[0], r[2], state[r[0] - 1] != "succeeded", r[6], r[2] != "w") for r in order], controls, batch, skips)
        got = {r["stage_execution_id"]: r["reason"] for r in admission.paged_pass(every, table, occupancy, declared, batch, skips).collect()}
        assert got == want, case
        kinds |= set(want.values())
    assert kinds == {"admitted", "capacity", "barrier", "mismatched", "unconfigured"}


def test_a_database_is_scanned_in_ranges_with_pushed_filters(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/ledger;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1000).select(F.col("id").alias("stage_execution_id"), (F.col("id") / 4).cast("long").alias("work_item_id"), F.lit("s").alias("stage_key"), (F.col("id") % 4).cast("int").alias("stage_index"), F.when(F.col("id") % 3 == 0, "ready").otherwise("failed").alias("state"))
    rows.write.format("jdbc").options(url=url, dbtable="stage_executions", driver=driver, createTableColumnTypes="stage_key VARCHAR(64), state VARCHAR(64)").save()
    table = schemas.read_table_jdbc(spark, "stage_executions", url, "stage_executions", "stage_execution_id", (0, 1000, 4), driver=driver)
    assert table.dtypes == spark.createDataFrame([], schemas.TABLES["stage_executions"]).dtypes and table.rdd.getNumPartitions() == 4
    ready = table.where("state = 'ready' AND stage_index = 1")
    plan = ready._jdf.queryExecution().executedPlan().toString()
    assert "numPartitions=4" in plan and "EqualTo(STATE,ready)" in plan.replace("state", "STATE")
    assert {r["stage_execution_id"] for r in ready.collect()} == {i for i in range(1000) if i % 3 == 0 and i % 4 == 1}
    assert ready.where("output_reference IS NULL").count() == ready.count()  # columns that the database does not have are null
