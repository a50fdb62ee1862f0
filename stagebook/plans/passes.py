"""Queries over whole passes of the ledger: admission, controls, registration, outcomes, completion, recovery, integrity, streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import admission as A
from ..operators import changes as C
from ..operators import completion as B
from ..operators import integrity as I
from ..operators import outcomes as O
from ..operators import recovery as V
from ..operators import registration as R
from ..operators import status as S
from ..operators import views as W
from ..sources import pages, schemas, seeders
from ..sources.fixtures import Ledger
from ..sources.shared import apart, narrow, shared_dir
from ..sources.snapshots import Conflict, Snapshots, buckets_for
from ..streaming import folds, state, ticks
from .queries import _CANDIDATES_SQL, _CONFIGURED_SQL, _PAUSE_SQL, RANK_SQL, _controls, query

_AT = "2026-07-17 12:00:00"


def _now():
    return F.to_timestamp(F.lit(_AT))


# ---------------------------------------------------------------- admission

#: The sequential rule, one row of each stage at a time; ``room`` has the free places of all controls by id.
_PLAN_SQL = f"""
ranked AS (SELECT w.*, {RANK_SQL.format(c='campaign_key', w='work_key')} AS rank FROM {_CANDIDATES_SQL} w),
spare AS (SELECT c.stage_control_id AS id, greatest(CASE WHEN c.stage_control_id = 2 THEN 40 WHEN c.stage_control_id IN (3, 4) THEN 15 ELSE c.capacity - o.occupied END, 0) AS free
  FROM stage_controls c JOIN occupancy o USING (stage_control_id)),
start AS (SELECT list(free ORDER BY id) AS room FROM spare),
matched AS (SELECT r.*, (SELECT list(c.stage_control_id ORDER BY c.stage_control_id) FROM stage_controls c WHERE c.pipeline_version = r.pipeline_version AND c.stage_key = r.stage_key
       AND (c.label_key IS NULL OR (c.label_key = 'segment' AND r.segment = c.label_value) OR (c.label_key = 'priority' AND r.urgency = c.label_value))) AS ids FROM ranked r),
able AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY pipeline_version, stage_key, ids ORDER BY priority, rank, stage_execution_id) AS nth_of_set FROM matched m), start
  WHERE nth_of_set <= list_min(list_transform(ids, lambda i: room[i]))),
queue AS (SELECT stage_execution_id, pipeline_key, pipeline_version, stage_key, priority, rank, ids,
    row_number() OVER (PARTITION BY pipeline_version, stage_key ORDER BY priority, rank, stage_execution_id) AS nth FROM able),
walk AS (
  SELECT DISTINCT pipeline_version, stage_key, 0::BIGINT AS nth, room, NULL::BIGINT AS taken FROM queue, start
  UNION ALL
  SELECT w.pipeline_version, w.stage_key, q.nth, CASE WHEN q.ok THEN list_transform(range(1, 10), lambda i: w.room[i] - CASE WHEN list_contains(q.ids, i::INTEGER) THEN 1 ELSE 0 END) ELSE w.room END,
    CASE WHEN q.ok THEN q.stage_execution_id END
  FROM walk w, LATERAL (SELECT x.*, list_min(list_transform(x.ids, lambda i: w.room[i])) > 0 AS ok FROM queue x WHERE x.pipeline_version = w.pipeline_version AND x.stage_key = w.stage_key AND x.nth = w.nth + 1) q),
plan AS (SELECT q.stage_execution_id, q.pipeline_key, q.pipeline_version, q.stage_key, q.priority, q.rank FROM walk w JOIN queue q ON q.stage_execution_id = w.taken ORDER BY q.priority, q.rank, q.stage_execution_id LIMIT 10000)
"""


@query("SELECT * FROM plan", more=_PLAN_SQL)
def admission_plan(t):
    controls = _controls(t)
    return C.plan_admission(C.ready_candidates(t.stage_executions, _items_rows(t), controls), controls)


@query("SELECT pipeline_key, pipeline_version, stage_key, count(*) AS admitted FROM plan GROUP BY ALL", more=_PLAN_SQL)
def admission_summary(t):
    return admission_plan(t).groupBy(*C.STAGE).agg(F.count("*").alias("admitted"))


def _items_rows(t: Ledger) -> DataFrame:
    return C.admission_rows(t.stage_executions, t.full_items, t.pipeline_runs)


#: Every third ready stage holds its next attempt already, prepared by an earlier retry.
_PREPARED_SQL = """
prepared AS (SELECT stage_execution_id, 1 AS attempt_number, concat('wf-', stage_execution_id, '-prepared') AS workflow_id FROM stage_executions WHERE state = 'ready' AND stage_execution_id % 3 = 0),
pass AS (SELECT w.*, a.attempt_number IS NULL AS appended,
  coalesce(a.workflow_id, 'drp-' || sha256('{"campaign_key":"' || campaign_key || '","pipeline_key":"' || w.pipeline_key || '","pipeline_version":' || w.pipeline_version || ',"stage_index":' || stage_index || ',"stage_key":"' || w.stage_key || '","work_key":"' || work_key || '"}') || '-a1') AS workflow_id
  FROM plan p JOIN arows w USING (stage_execution_id) LEFT JOIN prepared a USING (stage_execution_id))
"""


def _pass(t: Ledger, batch: int = 10_000) -> A.Pass:
    none = F.lit(None).cast("timestamp")

    def attempts(planned: DataFrame) -> DataFrame:
        """Of planned stages alone, so that the full tables are not derived for them."""
        of = lambda rows: rows.join(F.broadcast(planned), "stage_execution_id", "left_semi")
        ready = of(t.stage_executions).where("state = 'ready' AND stage_execution_id % 3 = 0")
        prepared = ready.select("stage_execution_id", F.lit(1).alias("attempt_number"), F.concat(F.lit("wf-"), F.col("stage_execution_id").cast("string"), F.lit("-prepared")).alias("workflow_id"))
        kept = t.derived("full_attempts", stage_attempts=of(t.stage_attempts), full_executions=t.derived("full_executions", stage_executions=F.broadcast(of(t.stage_executions))))
        kept = kept.select("stage_execution_id", "attempt_number", "workflow_id", "admitted_at", "terminal_at")
        return kept.unionByName(prepared.withColumn("admitted_at", none).withColumn("terminal_at", none))

    executions = t.stage_executions.withColumn("current_attempt", F.when((F.col("state") == "ready") & (F.col("stage_execution_id") % 3 == 0), 1).otherwise(F.col("current_attempt")))
    facts = partial(C.admission_rows, executions, t.full_items, t.pipeline_runs)
    return A.admission_pass(executions, facts(), _controls(t), attempts, t.declared_stages, _now(), batch, facts=facts)


@query(f"SELECT stage_execution_id, 'admitted' AS state, 1 AS current_attempt, '{_AT}' AS updated_at, 'ready' AS expected FROM pass", more=f"{_PLAN_SQL}, {_PREPARED_SQL}")
def admission_changes(t):
    return _pass(t).executions.withColumn("updated_at", F.col("updated_at").cast("string"))


@query("SELECT stage_execution_id, 1 AS attempt_number, workflow_id, appended FROM pass", more=f"{_PLAN_SQL}, {_PREPARED_SQL}")
def admission_attempts(t):
    return _pass(t).attempts.drop("admitted_at")


@query("""SELECT stage_execution_id, concat('queue-', stage_key) AS queue_name, workflow_id, nullif(priority, 0) AS priority,
  '{"campaign_key":"' || campaign_key || '","work_key":"' || work_key || '","work_item_id":' || work_item_id || ',"origin_run_key":"' || origin_run_key || '","input_reference":"' || coalesce(input_reference, item_input)
  || '","labels":{"segment":"' || segment || '","priority":"' || urgency || '"},"pipeline_key":"' || pipeline_key || '","pipeline_version":' || pipeline_version || ',"stage_key":"' || stage_key || '","stage_index":' || stage_index || ',"attempt_number":1}' AS payload
FROM pass""", more=f"{_PLAN_SQL}, {_PREPARED_SQL}")
def admission_outbox(t):
    return _pass(t).outbox


@query(f"""SELECT w.pipeline_key, w.pipeline_version, w.stage_key, CASE WHEN p.stage_execution_id IS NOT NULL THEN 'admitted' WHEN NOT {_CONFIGURED_SQL} THEN 'unconfigured' WHEN {_PAUSE_SQL} THEN 'paused'
  WHEN w.barrier AND g.blocked THEN 'barrier' ELSE 'capacity' END AS reason, count(*) AS n
FROM arows w JOIN gate g USING (stage_execution_id) LEFT JOIN plan p USING (stage_execution_id), reach
WHERE w.state = 'ready' AND (reach.n < 10000 OR row(w.priority, {RANK_SQL.format(c='w.campaign_key', w='w.work_key')}, w.stage_execution_id) <= reach.last) GROUP BY ALL""",
    more=f"{_PLAN_SQL}, reach AS (SELECT count(*) AS n, max(row(priority, rank, stage_execution_id)) AS last FROM plan)")
def admission_pass_summary(t):
    """Rows by what became of them, up to the last admitted one if the batch of 10,000 is full."""
    return _pass(t).summary


@query(f"""SELECT w.stage_execution_id, CASE WHEN NOT {_CONFIGURED_SQL} THEN 'unconfigured' WHEN w.stage_key = 'eval_fanin' AND w.pipeline_version = 1 THEN 'mismatched' WHEN {_PAUSE_SQL} THEN 'paused'
  WHEN w.barrier AND g.blocked THEN 'barrier' ELSE 'candidate' END AS fate FROM arows w JOIN gate g USING (stage_execution_id) WHERE w.state = 'ready' AND NOT (w.stage_key = 'optim_step' AND w.pipeline_version = 2)""")
def admission_fates(t):
    """With one stage that is not declared and one that is excluded."""
    declared = t.declared_stages.where("NOT (stage_key = 'eval_fanin' AND pipeline_version = 1)")
    excluded = t.declared_stages.where("stage_key = 'optim_step' AND pipeline_version = 2").select(*C.STAGE)
    rows = C.admission_rows(t.stage_executions, t.work_items, t.pipeline_runs)
    return A.candidates_by_fate(t.stage_executions, rows, t.stage_controls, declared, excluded).select("stage_execution_id", "fate")


@query(f"""SELECT w.pipeline_key, w.pipeline_version, w.stage_key, CASE WHEN NOT {_CONFIGURED_SQL} THEN 'unconfigured' WHEN w.barrier AND g.blocked THEN 'barrier' WHEN p.stage_execution_id IS NOT NULL THEN 'admitted' ELSE 'capacity' END AS reason, count(*) AS n
FROM arows w JOIN gate g USING (stage_execution_id) LEFT JOIN plan p USING (stage_execution_id) WHERE w.state = 'ready' AND NOT {_PAUSE_SQL} GROUP BY ALL""", more=_PLAN_SQL.replace(" LIMIT 10000", ""))
def admission_pass_paged(t):
    """The paged pass, with pages that hold all that is ready: every candidate has its fate."""
    rows = _items_rows(t)
    ready = max(1, t.stage_executions.where("state = 'ready'").count())
    seen = A.paged_pass(t.stage_executions, rows, _controls(t), t.declared_stages, batch=ready)
    return seen.groupBy(*C.STAGE, "reason").agg(F.count("*").alias("n"))


#: The stages after two rounds of changes: ready stages of every fifth item admitted, then admitted ones of every third item ended.
_AFTER_SQL = """
once AS (SELECT * REPLACE (CASE WHEN state = 'ready' AND work_item_id % 5 = 0 THEN 'admitted' ELSE state END AS state) FROM stage_executions),
later AS (SELECT * REPLACE (CASE WHEN state = 'admitted' AND work_item_id % 3 = 0 THEN CASE WHEN stage_index % 2 = 0 THEN 'succeeded' ELSE 'failed' END ELSE state END AS state) FROM once),
shown AS (SELECT work_item_id, state FROM (SELECT *, row_number() OVER (PARTITION BY work_item_id ORDER BY CASE state WHEN 'failed' THEN 0 WHEN 'cancelled' THEN 1 WHEN 'admitted' THEN 2 WHEN 'ready' THEN 3 ELSE 4 END,
    CASE WHEN state = 'succeeded' THEN -stage_index ELSE stage_index END, stage_execution_id) AS nth FROM later) WHERE nth = 1)
"""


def _viewed(t: Ledger, **counted: DataFrame):
    """The version of the status view after both rounds, with what status and the counts asked for follow from."""
    store = Snapshots(t.spark, shared_dir(t.spark, "views"))
    change = store.begin()
    stages = t.stage_executions.select("stage_execution_id", "work_item_id", "stage_key", "stage_index", "state")
    W.build(change, stages, buckets=buckets_for(stages, _BUCKETS), **counted)
    change.commit()
    for state_, condition, new in (("ready", "work_item_id % 5 = 0", F.lit("admitted")), ("admitted", "work_item_id % 3 = 0", F.when(F.col("stage_index") % 2 == 0, "succeeded").otherwise("failed"))):
        change = store.begin()
        rows = change.now().read("stages").where(condition).where(F.col("state") == state_)
        W.update_stages(change, rows.select("stage_execution_id", "work_item_id", new.alias("state"), F.lit(state_).alias("expected")), guard="state")
        change.commit()
    return store.head()


@query("SELECT campaign_key, state, count(*) AS n FROM work_items JOIN shown USING (work_item_id) GROUP BY ALL", more=_AFTER_SQL)
def view_campaign_counts(t):
    """Counts kept up to date over two rounds of changes, without working out the status of items that did not change."""
    return W.campaign_counts(_viewed(t, items=t.work_items))


@query("SELECT run_key, state, count(*) AS n FROM run_memberships JOIN shown USING (work_item_id) GROUP BY ALL", more=_AFTER_SQL)
def view_run_counts(t):
    return W.run_counts(_viewed(t, memberships=t.run_memberships))


@query("""SELECT run_key, member_ordinal, work_item_id, work_key, input_reference, state FROM run_memberships JOIN work_items USING (work_item_id) LEFT JOIN status USING (work_item_id)
WHERE run_key = (SELECT max(run_key) FROM pipeline_runs WHERE run_key LIKE 'run-all-%') AND member_ordinal > 5 ORDER BY member_ordinal LIMIT 50""")
def keyset_run_members(t):
    """A page of the last nation's run, read from tables in key order by the bounds of their files."""
    folder = shared_dir(t.spark, "ordered")
    members = pages.write_ordered(t.run_memberships.select("run_key", "member_ordinal", "work_item_id"), ["run_key", "member_ordinal"], f"{folder}/members", 5_000)
    items = pages.write_ordered(t.work_items.select("work_item_id", "work_key", "input_reference"), ["work_item_id"], f"{folder}/items", 5_000)
    stages = pages.write_ordered(t.stage_executions, ["work_item_id"], f"{folder}/stages", 20_000)
    run = t.pipeline_runs.where("run_key LIKE 'run-all-%'").agg(F.max("run_key")).first()[0]
    rows = S.run_members_page(members, items, stages, run, [5], 50)
    return rows.select("run_key", "member_ordinal", "work_item_id", "work_key", "input_reference", "state")


@query("""SELECT campaign_key, work_item_id, work_key, state FROM work_items JOIN status USING (work_item_id)
WHERE campaign_key = (SELECT min(campaign_key) FROM work_items) AND work_item_id > 1000 ORDER BY work_item_id LIMIT 40""")
def keyset_work_items(t):
    folder = shared_dir(t.spark, "ordered")
    items = pages.write_ordered(t.work_items.select("campaign_key", "work_item_id", "work_key"), ["campaign_key", "work_item_id"], f"{folder}/items", 5_000)
    stages = pages.write_ordered(t.stage_executions, ["work_item_id"], f"{folder}/stages", 20_000)
    campaign = t.work_items.agg(F.min("campaign_key")).first()[0]
    return S.work_items_page(items, stages, campaign, [1000], 40).select("campaign_key", "work_item_id", "work_key", "state")


@query("SELECT e.stage_execution_id, CASE WHEN p.stage_execution_id IS NOT NULL THEN 'admitted' ELSE e.state END AS state FROM stage_executions e LEFT JOIN plan p USING (stage_execution_id)", more=_PLAN_SQL)
def tick_admission(t):
    """Stages after a tick of admission on a store; the first try fails on its way, and the tick is given again after it was done."""
    controls = _controls(t).select("stage_control_id", *C.STAGE, "selector", "capacity", "paused")
    attempts = t.full_attempts.select(F.concat_ws("#", "stage_execution_id", "attempt_number").alias("attempt"), "stage_execution_id", "attempt_number", "workflow_id", "admitted_at", "terminal_at")
    store = Snapshots(t.spark, shared_dir(t.spark, "ticks"))
    change = store.begin()
    ticks.put(change, {"stage_executions": t.stage_executions, "stage_attempts": attempts, "pipeline_runs": t.full_runs, "work_items": t.full_items, "stage_controls": controls}, _BUCKETS)
    change.commit()
    admit, tries = ticks.admission_tick(t.declared_stages, _now()), []

    def fails_once(_) -> None:
        tries.append(1)
        if len(tries) == 1:
            raise ConnectionError("lost")

    tick = folds.committed(store, admit, fails_once)
    for _ in range(3):
        try:
            tick(0)
        except ConnectionError:
            pass
    if store.numbers() != [1, 2]:
        raise RuntimeError("a tick was committed more than once")
    return store.head().read("stage_executions").select("stage_execution_id", "state")


#: Routes of a stage of every campaign, after the labels of its items: by segment, by both labels, or by priority.
_ROUTES_SQL = """
routes AS (SELECT campaign_key, CAST(row_number() OVER (PARTITION BY campaign_key ORDER BY segment, urgency) AS INT) AS ordinal, CASE WHEN kind < 2 THEN segment END AS segment, CASE WHEN kind > 0 THEN urgency END AS urgency
  FROM (SELECT DISTINCT campaign_key, segment, urgency, priority % 3 AS kind FROM work_items) AS labels)
"""


@query("""SELECT a.campaign_key, a.ordinal, b.ordinal AS other FROM routes a JOIN routes b ON a.campaign_key = b.campaign_key AND a.ordinal < b.ordinal
WHERE (a.segment = b.segment OR a.urgency = b.urgency) AND coalesce(a.segment = b.segment, true) AND coalesce(a.urgency = b.urgency, true)""", more=_ROUTES_SQL)
def route_overlaps(t):
    rows = t.spark.sql(f"WITH {_ROUTES_SQL.replace('FROM work_items', 'FROM {items}')} SELECT * FROM routes", items=t.work_items)
    entries = F.filter(F.array(F.struct(F.lit("segment").alias("key"), F.col("segment").alias("value")), F.struct(F.lit("priority").alias("key"), F.col("urgency").alias("value"))), lambda e: e["value"].isNotNull())
    routes = rows.select(F.col("campaign_key").alias("pipeline_key"), F.lit(1).alias("pipeline_version"), F.lit("eval_row").alias("stage_key"), "ordinal", F.map_from_entries(entries).alias("selector"), F.concat(F.lit("q"), F.col("ordinal").cast("string")).alias("queue_name"))
    return C.route_problems(routes).where("problem = 'overlap'").select(F.col("pipeline_key").alias("campaign_key"), "ordinal", "other")


# ---------------------------------------------------------------- controls


@query("SELECT w.work_item_id, c.stage_control_id, c.capacity FROM work_items w JOIN pipeline_runs r ON r.run_key = w.origin_run_key JOIN stage_controls c ON c.pipeline_version = r.pipeline_version AND c.stage_key = 'eval_row' AND (c.label_key IS NULL OR (c.label_key = 'segment' AND w.segment = c.label_value) OR (c.label_key = 'priority' AND w.urgency = c.label_value))")
def item_controls(t):
    stages = t.work_items.join(t.pipeline_runs.select(F.col("run_key").alias("origin_run_key"), "pipeline_key", "pipeline_version"), "origin_run_key")
    stages = stages.select("work_item_id", "labels", "pipeline_key", "pipeline_version", F.lit("eval_row").alias("stage_key"))
    return A.list_controls(t.stage_controls, stages, labels=True).select("work_item_id", "stage_control_id", "capacity")


#: A capacity for every segment of every stage and version, a pause of each stage as a whole, a resume of the urgent rows, and bad capacities.
_WANTED_SQL = f"""
wanted AS (
  SELECT 'evaluation' AS pipeline_key, v AS pipeline_version, k AS stage_key, 'segment' AS label_key, segment AS label_value, 'capacity' AS action, CAST(n AS INT) AS capacity
  FROM (SELECT segment, count(*) % 1000 - CASE WHEN segment = 'HOUSEHOLD' THEN 10000 ELSE 0 END AS n FROM work_items GROUP BY segment) AS s, (VALUES (1), (2)) AS u(v), (VALUES ('optim_step'), ('eval_row'), ('eval_fanin')) AS w(k)
  UNION ALL SELECT 'evaluation', v, k, CAST(NULL AS STRING), CAST(NULL AS STRING), 'pause', CAST(NULL AS INT) FROM (VALUES (1), (2)) AS u(v), (VALUES ('optim_step'), ('eval_row'), ('eval_fanin')) AS w(k)
  UNION ALL SELECT 'evaluation', v, 'eval_row', 'priority', '1-URGENT', 'resume', CAST(NULL AS INT) FROM (VALUES (1), (2)) AS u(v))
"""
_JUDGED_SQL = """
judged AS (SELECT w.*, c.stage_control_id, CASE WHEN w.action = 'capacity' AND (w.capacity IS NULL OR w.capacity < 0) THEN 'bad_capacity' WHEN w.action <> 'capacity' AND c.stage_control_id IS NULL THEN 'absent' END AS reason
  FROM wanted w LEFT JOIN stage_controls c ON c.pipeline_version = w.pipeline_version AND c.stage_key = w.stage_key AND c.label_key IS NOT DISTINCT FROM w.label_key AND c.label_value IS NOT DISTINCT FROM w.label_value)
"""


def _control_changes(t: Ledger) -> tuple[DataFrame, DataFrame]:
    wanted = t.spark.sql(f"WITH {_WANTED_SQL.replace('FROM work_items', 'FROM {items}')} SELECT * FROM wanted", items=t.work_items)
    selector = F.when(F.col("label_key").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map("label_key", "label_value"))
    return A.control_changes(t.stage_controls.withColumn("updated_at", _now()), wanted.withColumn("selector", selector).withColumn("updated_at", _now()))


_SELECTOR_SQL = "CASE WHEN label_key IS NULL THEN '{}' ELSE '{\"' || label_key || '\":\"' || label_value || '\"}' END"


@query(f"""SELECT pipeline_version, stage_key, {_SELECTOR_SQL} AS selector, capacity, paused, count(*) AS n FROM (
  SELECT c.pipeline_version, c.stage_key, c.label_key, c.label_value, CASE WHEN j.action = 'capacity' THEN j.capacity ELSE c.capacity END AS capacity, CASE j.action WHEN 'pause' THEN true WHEN 'resume' THEN false ELSE c.paused END AS paused
  FROM stage_controls c LEFT JOIN judged j ON j.stage_control_id = c.stage_control_id AND j.reason IS NULL
  UNION ALL SELECT pipeline_version, stage_key, label_key, label_value, capacity, false FROM judged WHERE reason IS NULL AND stage_control_id IS NULL) GROUP BY ALL""", more=f"{_WANTED_SQL}, {_JUDGED_SQL}")
def control_upserts(t):
    new, _ = _control_changes(t)
    return new.select("pipeline_version", "stage_key", X.canonical("selector").alias("selector"), "capacity", "paused").groupBy("pipeline_version", "stage_key", "selector", "capacity", "paused").agg(F.count("*").alias("n"))


@query(f"SELECT pipeline_version, stage_key, {_SELECTOR_SQL} AS selector, action, reason FROM judged WHERE reason IS NOT NULL", more=f"{_WANTED_SQL}, {_JUDGED_SQL}")
def control_rejects(t):
    _, rejects = _control_changes(t)
    return rejects.select("pipeline_version", "stage_key", F.col("selector_key").alias("selector"), "action", "reason")


# ---------------------------------------------------------------- registration

_FACTS = ", ".join(R.PROVENANCE)


@query(f"""SELECT run_key, campaign_key, kind, reason FROM (SELECT d.*, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN r.run_key IS NULL THEN 'new'
  WHEN row({', '.join('d.' + f for f in R.PROVENANCE)}) IS DISTINCT FROM row({', '.join('r.' + f for f in R.PROVENANCE)}) THEN 'conflict' WHEN r.registration_closed_at IS NOT NULL THEN 'closed' ELSE 'replay' END AS kind
  FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY run_key) > 1 THEN 'declared_once' WHEN run_completion_key = 'bad key' THEN 'valid_keys' WHEN pipeline_version <= 0 THEN 'version_positive' WHEN expected_member_count < 0 THEN 'members_not_negative'
    WHEN (manifest_reference IS NULL) <> (membership_digest IS NULL) THEN 'manifest_with_digest' WHEN run_completion_key IS NOT NULL AND manifest_reference IS NULL THEN 'completion_has_manifest' END AS reason
    FROM (SELECT DISTINCT run_key, {_FACTS} FROM run_declarations)) d LEFT JOIN full_runs r ON r.run_key = d.run_key)""")
def run_registration(t):
    return R.register_runs(t.run_declarations, t.full_runs).select("run_key", "campaign_key", "kind", "reason")


@query("SELECT run_key, membership_digest, registered_member_count AS registered_count, created_work_count AS created_count, reused_work_count AS reused_count, CAST(registration_closed_at AS VARCHAR) AS registration_closed_at FROM full_runs WHERE registration_closed_at IS NOT NULL")
def registration_receipts(t):
    return R.receipts(t.full_runs).withColumn("registration_closed_at", F.col("registration_closed_at").cast("string"))


_MEMBERS_JUDGED = """
judged AS (SELECT m.*, w.work_item_id, CASE WHEN m.member_ordinal < 0 THEN 'ordinal_not_negative' WHEN m.work_key LIKE '%!%' THEN 'valid_work_key' WHEN m.input_reference = '' THEN 'input_given' WHEN m.priority < 0 THEN 'priority_in_range'
    WHEN count(*) OVER (PARTITION BY m.run_key, m.work_key) > 1 THEN 'one_row_of_a_work_key' WHEN count(*) OVER (PARTITION BY m.run_key, m.member_ordinal) > 1 THEN 'one_row_of_an_ordinal' END AS wrong,
  CASE WHEN w.work_item_id IS NULL THEN 'new' WHEN w.input_reference <> m.input_reference OR r.pipeline_version <> s.pipeline_version THEN 'conflict' WHEN w.priority <> m.priority THEN 'priority_change' ELSE 'same' END AS kind
  FROM member_requests m LEFT JOIN work_items w ON w.campaign_key = m.campaign_key AND w.work_key = m.work_key LEFT JOIN pipeline_runs r ON r.run_key = w.origin_run_key LEFT JOIN pipeline_runs s ON s.run_key = m.run_key
  WHERE m.run_key NOT IN (SELECT run_key FROM pipeline_runs WHERE registration_closed_at IS NOT NULL))
"""


@query("SELECT run_key, member_ordinal, work_key, wrong AS reason FROM judged WHERE wrong IS NOT NULL UNION ALL SELECT run_key, member_ordinal, work_key, 'conflict' FROM judged WHERE kind = 'conflict'", more=_MEMBERS_JUDGED)
def registration_rejects(t):
    return R.register_members(t.member_requests, t.full_items, t.full_runs)[1]


@query("SELECT run_key, member_ordinal, work_key, kind FROM judged WHERE run_key NOT IN (SELECT run_key FROM judged WHERE wrong IS NOT NULL OR kind = 'conflict')", more=_MEMBERS_JUDGED)
def registration_members(t):
    return R.register_members(t.member_requests, t.full_items, t.full_runs)[0].select("run_key", "member_ordinal", "work_key", "kind")


@query("""SELECT * FROM (SELECT run_key, member_ordinal, work_item_id, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'missing' WHEN coalesce(a.n, 0) < coalesce(b.n, 0) THEN 'other' END AS difference
FROM (SELECT run_key, member_ordinal, work_item_id, count(*) AS n FROM run_memberships GROUP BY ALL) a FULL JOIN (SELECT run_key, member_ordinal, work_item_id, count(*) AS n FROM stored_memberships GROUP BY ALL) b USING (run_key, member_ordinal, work_item_id)) WHERE difference IS NOT NULL""")
def membership_differences(t):
    return R.membership_differences(t.run_memberships, t.stored_memberships)


_DIGEST_SQL = """
digests AS (SELECT run_key, count(*) AS n, sha256('{"entries":[' || string_agg('{"input_reference":"' || input_reference || '","ordinal":' || member_ordinal || ',"work_key":"' || work_key || '"}', ',' ORDER BY member_ordinal)
  || '],"expected_member_count":' || count(*) || ',"schema":"run-membership/v1"}') AS digest FROM run_memberships JOIN work_items USING (work_item_id) GROUP BY run_key)
"""


@query("SELECT run_key, digest AS membership_digest, n AS members FROM digests", more=_DIGEST_SQL)
def ordered_digests(t):
    return R.ordered_digests(t.run_memberships, t.work_items, "run-membership/v1")


_CLOSURES_SQL = f"""{_DIGEST_SQL},
closing AS (SELECT r.run_key, CASE WHEN r.expected_member_count % 3 = 0 THEN NULL WHEN r.expected_member_count % 3 = 1 THEN coalesce(d.digest, sha256('{{"entries":[],"expected_member_count":0,"schema":"run-membership/v1"}}')) ELSE 'digest:other' END AS membership_digest,
    r.expected_member_count, coalesce(d.digest, sha256('{{"entries":[],"expected_member_count":0,"schema":"run-membership/v1"}}')) AS digest
  FROM pipeline_runs r LEFT JOIN digests d USING (run_key)),
counted AS (SELECT c.*, coalesce(m.n, 0) AS n, coalesce(m.created, 0) AS created, coalesce(m.ok, true) AS ok FROM closing c LEFT JOIN (SELECT x.run_key, count(*) AS n, count(*) FILTER (origin_run_key = x.run_key) AS created,
    min(member_ordinal) = 0 AND max(member_ordinal) = count(*) - 1 AND count(DISTINCT member_ordinal) = count(*) AS ok FROM run_memberships x JOIN work_items USING (work_item_id) WHERE x.work_item_id % 97 <> 0 GROUP BY 1) m USING (run_key)),
fulls AS (SELECT run_key, sha256('{{"entries":[' || string_agg('{{"input_reference":"' || input_reference || '","ordinal":' || member_ordinal || ',"work_key":"' || work_key || '"}}', ',' ORDER BY member_ordinal)
  || '],"expected_member_count":' || count(*) || ',"schema":"run-membership/v1"}}') AS found FROM run_memberships JOIN work_items USING (work_item_id) WHERE work_item_id % 97 <> 0 GROUP BY run_key),
closures AS (SELECT c.*, CASE WHEN NOT ok THEN 'gapless' WHEN n <> expected_member_count THEN 'complete'
  WHEN membership_digest IS NOT NULL AND membership_digest <> coalesce(f.found, sha256('{{"entries":[],"expected_member_count":0,"schema":"run-membership/v1"}}')) THEN 'digest_equal' END AS reason FROM counted c LEFT JOIN fulls f USING (run_key))
"""


def _closures(t: Ledger) -> tuple[DataFrame, DataFrame]:
    """All runs as if they were open, some members lost; a third declare no digest, a third their own and a third another one."""
    none = F.sha2(F.lit('{"entries":[],"expected_member_count":0,"schema":"run-membership/v1"}'), 256)
    own = R.ordered_digests(t.run_memberships, t.work_items, "run-membership/v1").select("run_key", F.col("membership_digest").alias("own"))
    share = F.col("expected_member_count") % 3
    runs = t.pipeline_runs.join(own, "run_key", "left").withColumn("registration_closed_at", F.lit(None).cast("timestamp"))
    runs = runs.withColumn("membership_digest", F.when(share == 1, F.coalesce("own", none)).when(share == 2, F.lit("digest:other")))
    return R.close_runs(runs, t.run_memberships.where("work_item_id % 97 <> 0"), t.work_items, "run-membership/v1", _now())


@query(f"SELECT run_key, membership_digest, n::INT AS registered_count, created::INT AS created_count, (n - created)::INT AS reused_count, '{_AT}' AS registration_closed_at FROM closures WHERE reason IS NULL", more=_CLOSURES_SQL)
def registration_closures(t):
    return _closures(t)[0].withColumn("registration_closed_at", F.col("registration_closed_at").cast("string"))


@query("SELECT run_key, reason FROM closures WHERE reason IS NOT NULL", more=_CLOSURES_SQL)
def registration_left_open(t):
    return _closures(t)[1]


# ---------------------------------------------------------------- outcomes

_APPLIED_SQL = """
located AS (SELECT o.*, e.stage_execution_id AS sid, e.work_item_id, e.stage_key, e.stage_index, e.state, e.current_attempt, e.updated_at, a.attempt_number, r.pipeline_version, w.rank, w.priority,
    CASE WHEN e.stage_execution_id % 67 = 0 THEN e.updated_at ELSE a.terminal_at END AS ended_at
  FROM outcome_batch o LEFT JOIN full_attempts a USING (workflow_id) LEFT JOIN full_executions e ON e.stage_execution_id = a.stage_execution_id LEFT JOIN full_items w ON w.work_item_id = e.work_item_id LEFT JOIN pipeline_runs r ON r.run_key = w.origin_run_key),
following AS (SELECT workflow_id, stage_key, stage_index, input_reference, barrier FROM successor_requests WHERE workflow_id IN (SELECT workflow_id FROM outcome_batch)
  UNION ALL SELECT l.workflow_id, n.stage_key, l.stage_index + 1, l.output_reference, false FROM located l JOIN declared_stages d ON d.pipeline_version = l.pipeline_version AND d.stage_key = l.stage_key
    JOIN declared_stages n ON n.pipeline_version = d.pipeline_version AND n.position = d.position + 1 WHERE l.linear AND l.succeeded),
judged_next AS (SELECT f.*, l.work_item_id, l.rank, l.priority, l.completed_at, x.stage_execution_id AS old_id, x.priority AS old_priority, CASE WHEN f.stage_index <= l.stage_index THEN 1
    WHEN count(*) OVER (PARTITION BY f.workflow_id, f.stage_index) > 1 THEN 2 WHEN f.stage_key NOT IN ('optim_step', 'eval_row', 'eval_fanin') THEN 3
    WHEN x.stage_execution_id IS NOT NULL AND (x.stage_key <> f.stage_key OR x.barrier <> f.barrier OR (f.input_reference IS NOT NULL AND f.input_reference IS DISTINCT FROM x.input_reference)) THEN 4 END AS wrong
  FROM following f JOIN located l USING (workflow_id) LEFT JOIN full_executions x ON x.work_item_id = l.work_item_id AND x.stage_index = f.stage_index),
reasons AS (SELECT l.*, CASE WHEN l.sid IS NULL THEN 'unknown' WHEN expected_pipeline_version <> pipeline_version OR expected_stage_key <> stage_key OR expected_stage_index <> stage_index THEN 'identity'
    WHEN attempt_number = current_attempt AND state = 'cancelled' THEN 'cancelled' WHEN attempt_number <> current_attempt OR state <> 'admitted' THEN 'not_current' WHEN succeeded AND coalesce(output_reference, '') = '' THEN 'no_output'
    WHEN succeeded AND evidence_reference IS NOT NULL THEN 'evidence_of_success' WHEN NOT succeeded AND output_reference IS NOT NULL THEN 'output_of_failure' WHEN NOT succeeded AND n > 0 THEN 'successors_of_failure' WHEN ended_at IS NOT NULL THEN 'ended_before'
    WHEN completed_at < updated_at THEN 'time_goes_back' WHEN j.wrong = 4 THEN 'successor_conflict' WHEN j.wrong = 1 THEN 'successor_index' WHEN j.wrong = 2 THEN 'successor_twice' WHEN j.wrong = 3 THEN 'successor_not_declared' END AS reason
  FROM located l LEFT JOIN (SELECT workflow_id, min(wrong) AS wrong, count(*) AS n FROM judged_next GROUP BY 1) j USING (workflow_id))
"""


def _applied(t: Ledger) -> O.Applied:
    following = t.successor_requests.groupBy("workflow_id").agg(F.collect_list(F.struct("stage_key", "stage_index", "input_reference", "barrier")).alias("successors"))
    outcomes = t.outcome_batch.join(apart(following), "workflow_id", "left")
    attempts = t.full_attempts.join(apart(t.full_executions.select("stage_execution_id", "updated_at")), "stage_execution_id")
    attempts = attempts.withColumn("terminal_at", F.when(F.col("stage_execution_id") % 67 == 0, F.col("updated_at")).otherwise(F.col("terminal_at")))
    return O.apply_outcomes(outcomes, attempts.drop("updated_at"), t.full_executions, t.full_items, t.full_runs, t.declared_stages)


@query("""SELECT workflow_id, sid AS stage_execution_id, reason, CASE WHEN reason IS NULL THEN 'apply' WHEN reason = 'unknown' THEN 'unknown' WHEN reason IN ('identity', 'not_current') THEN 'mismatch' WHEN reason = 'cancelled' THEN 'ignored'
  WHEN reason = 'successor_conflict' THEN 'conflict' ELSE 'rejected' END AS kind FROM reasons""", more=_APPLIED_SQL)
def outcome_kinds(t):
    return _applied(t).kinds


@query("SELECT sid AS stage_execution_id, CASE WHEN succeeded THEN 'succeeded' ELSE 'failed' END AS state, CASE WHEN succeeded THEN output_reference END AS output_reference, CAST(completed_at AS VARCHAR) AS updated_at, 'admitted' AS expected FROM reasons WHERE reason IS NULL", more=_APPLIED_SQL)
def outcome_changes(t):
    return _applied(t).executions.withColumn("updated_at", F.col("updated_at").cast("string"))


@query("""SELECT sid AS stage_execution_id, attempt_number, CAST(completed_at AS VARCHAR) AS terminal_at, CASE WHEN succeeded THEN '{"outcome":"succeeded"}'
  ELSE '{"outcome":"failed","producer":"application_failure","error_type":"' || error_type || '","message":"' || message || '"}' END AS terminal_summary, evidence_reference FROM reasons WHERE reason IS NULL""", more=_APPLIED_SQL)
def outcome_attempts(t):
    return _applied(t).attempts.withColumn("terminal_at", F.col("terminal_at").cast("string"))


@query("SELECT j.work_item_id, j.stage_key, j.stage_index, 'ready' AS state, 0 AS current_attempt, j.rank, j.priority, j.input_reference, j.barrier, CAST(j.completed_at AS VARCHAR) AS created_at FROM judged_next j JOIN reasons r USING (workflow_id) WHERE r.reason IS NULL AND j.old_id IS NULL", more=_APPLIED_SQL)
def outcome_successors(t):
    return _applied(t).successors.withColumn("created_at", F.col("created_at").cast("string"))


#: Every run once more, under another name and campaign: items of several runs belong to the smallest.
_AGAIN_SQL = """
again AS (SELECT concat(m.run_key, '-again') AS run_key, concat(w.campaign_key, '-again') AS campaign_key, m.member_ordinal, w.work_key FROM run_memberships m JOIN work_items w USING (work_item_id)),
brought AS (SELECT campaign_key, work_key, min(run_key) AS origin FROM again GROUP BY 1, 2)
"""


@query("""SELECT concat(r.run_key, '-again') AS run_key, count(a.work_key) AS registered_count, count(*) FILTER (b.origin = a.run_key) AS created_count, count(*) FILTER (b.origin <> a.run_key) AS reused_count
FROM pipeline_runs r LEFT JOIN again a ON a.run_key = concat(r.run_key, '-again') LEFT JOIN brought b ON b.campaign_key = a.campaign_key AND b.work_key = a.work_key GROUP BY r.run_key, r.expected_member_count HAVING count(a.work_key) = r.expected_member_count""", more=_AGAIN_SQL)
def submit_receipts(t):
    """Runs registered with all their members and closed by one job; those whose members are not as many as expected stay open."""
    renamed = lambda c: F.concat(c, F.lit("-again"))
    declarations = t.full_runs.withColumn("run_key", renamed("run_key")).withColumn("campaign_key", renamed("campaign_key")).withColumn("membership_digest", F.lit(None).cast("string")).withColumn("manifest_reference", F.lit(None).cast("string")).withColumn("run_completion_key", F.lit(None).cast("string"))
    members = t.run_memberships.join(t.full_items, "work_item_id").select(renamed("run_key").alias("run_key"), renamed("campaign_key").alias("campaign_key"), "member_ordinal", "work_key", "input_reference", "labels", "priority")
    done = R.submit(declarations, members, t.full_runs, t.full_items, t.run_memberships, t.declared_stages, "run-membership/v1", _now())
    return done.receipts.select("run_key", F.col("registered_count").cast("long"), F.col("created_count").cast("long"), F.col("reused_count").cast("long"))


# ---------------------------------------------------------------- completion

_BARRIER_SQL = f"""
page AS (SELECT e.run_key, e.run_key <= 'run-5' AS turn FROM eligible e ORDER BY turn, e.run_key LIMIT 120),
counts AS (SELECT run_key, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled FROM run_memberships JOIN status USING (work_item_id) GROUP BY 1),
looked AS (SELECT r.*, p.turn, coalesce(c.succeeded, 0) AS succeeded, coalesce(c.failed, 0) AS failed, coalesce(c.cancelled, 0) AS cancelled,
    CASE WHEN coalesce(c.succeeded + c.failed + c.cancelled, 0) <> r.expected_member_count THEN 'not_covered' WHEN r.pipeline_version = 2 THEN 'completion_differs' END AS reason
  FROM page p JOIN full_runs r USING (run_key) LEFT JOIN counts c USING (run_key)),
seen AS (SELECT * FROM (SELECT *, coalesce(count(*) FILTER (reason IS NULL) OVER (ORDER BY turn, run_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM looked) WHERE before < 40)
"""


def _barrier(t: Ledger) -> B.Barrier:
    declared = t.declared_stages.withColumn("run_completion_key", F.when(F.col("pipeline_version") == 2, "other").otherwise(F.col("run_completion_key")))
    return B.barrier_pass(t.full_runs, t.run_memberships, t.stage_executions, declared, "run-5", _now(), batch=40, budget=120)


_WFR_SQL = """'drp-run-' || sha256('{"pipeline_key":"' || pipeline_key || '","pipeline_version":' || pipeline_version || ',"run_completion_key":"' || run_completion_key || '","run_key":"' || run_key || '"}')"""
_FROZEN_SQL = """'[{"state":"succeeded","count":' || succeeded || '},{"state":"failed","count":' || failed || '},{"state":"cancelled","count":' || cancelled || '}]'"""


@query(f"SELECT run_key, '{_AT}' AS released_at, {_FROZEN_SQL} AS release_terminal_state_counts FROM seen WHERE reason IS NULL", more=_BARRIER_SQL)
def barrier_releases(t):
    return _barrier(t).runs.select("run_key", F.col("released_at").cast("string").alias("released_at"), F.to_json("release_terminal_state_counts").alias("release_terminal_state_counts"))


@query(f"""SELECT run_key, {_WFR_SQL} || '-a1' AS workflow_id, '{{"campaign_key":"' || campaign_key || '","run_key":"' || run_key || '","pipeline_key":"evaluation","pipeline_version":' || pipeline_version || ',"execution_config_reference":"' || execution_config_reference
  || '","manifest_reference":"' || manifest_reference || '","membership_digest":"' || membership_digest || '","member_count":' || expected_member_count || ',"released_at":"2026-07-17T12:00:00Z","release_terminal_state_counts":' || {_FROZEN_SQL} || '}}' AS payload
FROM seen WHERE reason IS NULL""", more=_BARRIER_SQL)
def barrier_outbox(t):
    return _barrier(t).outbox


@query("SELECT run_key, reason FROM seen WHERE reason IS NOT NULL", more=_BARRIER_SQL)
def barrier_failures(t):
    return _barrier(t).failures


@query("SELECT count(*) AS examined, count(*) FILTER (reason IS NULL) AS released, count(*) FILTER (reason IS NOT NULL) AS failed, (SELECT run_key FROM seen ORDER BY turn DESC, run_key DESC LIMIT 1) AS last_run_key FROM seen", more=_BARRIER_SQL)
def barrier_summary(t):
    return _barrier(t).summary


@query(f"""SELECT k.run_key, CASE WHEN e.state IS NULL THEN 'unknown' WHEN e.state <> 'failed' THEN 'not_failed' WHEN e.run_completion_execution_id % 5 = 2 THEN 'time_goes_back' ELSE 'retry' END AS disposition,
  CASE WHEN e.state = 'failed' AND e.run_completion_execution_id % 5 <> 2 THEN e.current_attempt + 1 END AS attempt_number, CASE WHEN e.state = 'failed' AND e.run_completion_execution_id % 5 <> 2 THEN k.wf || '-a' || (e.current_attempt + 1) END AS workflow_id
FROM (SELECT run_key, {_WFR_SQL} AS wf FROM pipeline_runs) k LEFT JOIN run_completion_executions e USING (run_key)""")
def retry_completions_all(t):
    ends = F.when(F.col("run_completion_execution_id") % 5 == 2, F.to_timestamp(F.lit("2026-08-01"))).otherwise(F.col("terminal_at"))
    return B.retry_completions(t.pipeline_runs, t.pipeline_runs, t.full_completions, t.full_completion_attempts.withColumn("terminal_at", ends), _now())


# ---------------------------------------------------------------- recovery

#: Of the feed's executors those that are live by three lists; the resolver is silent in the second query.
_LIVE_SQL = """
live AS (SELECT DISTINCT trim(executor_id) AS executor_id FROM workflow_status WHERE trim(executor_id) IN ('worker-0', 'worker-1', 'worker-2')),
admitted AS (SELECT e.stage_execution_id, c.workflow_id FROM stage_executions e JOIN current c USING (stage_execution_id) WHERE e.state = 'admitted'),
swept AS (SELECT a.*, f.status, CASE WHEN f.status = 'CANCELLED' THEN 'workflow_cancelled' WHEN f.status IN ('ERROR', 'MAX_RECOVERY_ATTEMPTS_EXCEEDED') THEN 'workflow_error'
    WHEN f.status = 'PENDING' AND nullif(trim(f.app_version), '') IS NOT NULL AND f.executor_id IS NOT NULL THEN CASE WHEN trim(f.app_version) <> 'v2' THEN 'stale_app_version'
      WHEN f.executor_id NOT IN (SELECT executor_id FROM live) THEN 'dead_executor' END END AS reason
  FROM admitted a LEFT JOIN workflow_status f ON f.workflow_id = a.workflow_id)
"""


def _admitted(t: Ledger) -> DataFrame:
    current = t.stage_attempts.select("stage_execution_id", F.col("attempt_number").alias("current_attempt"), "workflow_id")
    return t.stage_executions.where("state = 'admitted'").join(current, ["stage_execution_id", "current_attempt"])


def _live(t: Ledger, failed: bool = False, version: str | None = "v2") -> V.Live:
    seen = t.workflow_status.select("executor_id").distinct()
    only = lambda *names: seen.where(F.col("executor_id").isin(*names)).select(F.concat(F.lit(" "), "executor_id").alias("executor_id"))
    return V.live_identity(version, only("worker-1"), only("worker-2"), only("worker-0").unionByName(t.spark.sql("SELECT '  ' AS executor_id")), failed)


@query("SELECT executor_id FROM live", more=_LIVE_SQL)
def live_executors(t):
    return _live(t).executors


@query("""SELECT count(*) AS inspected, count(reason) AS projected, count(*) FILTER (reason = 'workflow_cancelled') AS workflow_cancelled, count(*) FILTER (reason = 'workflow_error') AS workflow_error,
  count(*) FILTER (reason = 'stale_app_version') AS stale_app_version, count(*) FILTER (reason = 'dead_executor') AS dead_executor, false AS identity_unavailable FROM swept""", more=_LIVE_SQL)
def sweep_summary(t):
    live = _live(t)
    return V.sweep_summary(V.sweep_live(_admitted(t), t.workflow_status, live), live)


@query("SELECT stage_execution_id, reason FROM swept WHERE reason IN ('workflow_cancelled', 'workflow_error')", more=_LIVE_SQL)
def sweep_without_identity(t):
    """No version and a resolver that failed: nothing pending is taken for abandoned."""
    live = _live(t, failed=True, version=" ")
    return V.sweep_live(_admitted(t), t.workflow_status, live).where("reason IS NOT NULL").select("stage_execution_id", "reason")


@query("""SELECT stage_execution_id, CASE WHEN state = 'admitted' AND r.reason IS NOT NULL AND stage_execution_id % 2 = 0 THEN CASE WHEN r.reason = 'workflow_cancelled' THEN 'cancelled' ELSE 'failed' END ELSE state END AS state
FROM stage_executions LEFT JOIN (SELECT stage_execution_id, reason FROM swept) r USING (stage_execution_id)""", more=_LIVE_SQL)
def sweep_applied(t):
    """The sweep's changes on a snapshot in which the attempt of every odd execution has moved on."""
    swept = V.sweep_live(_admitted(t), t.workflow_status, _live(t)).where("reason IS NOT NULL")
    stale = F.col("current_attempt") - F.col("stage_execution_id") % 2
    updates = swept.select("stage_execution_id", F.col("new_state").alias("state"), F.lit("admitted").alias("expected_state"), stale.alias("expected_current_attempt"))
    return C.apply_changes(t.stage_executions, "stage_execution_id", updates, guard=["state", "current_attempt"]).select("stage_execution_id", "state")


@query("SELECT e.stage_execution_id, CASE WHEN e.state <> 'failed' THEN 'not_failed' WHEN e.stage_execution_id % 3 = 0 THEN 'open_attempt' ELSE 'retry' END AS disposition, CASE WHEN e.state = 'failed' AND e.stage_execution_id % 3 <> 0 THEN e.current_attempt + 1 END AS attempt_number FROM stage_executions e UNION ALL SELECT -stage_execution_id, 'unknown', NULL FROM stage_executions")
def retry_ended_stages(t):
    known = t.stage_executions.select("stage_execution_id")
    ends = F.when(F.col("stage_execution_id") % 3 != 0, F.col("terminal_at"))
    return V.retry_stages(known.unionByName(known.select((-F.col("stage_execution_id")).alias("stage_execution_id"))), t.stage_executions, t.full_attempts.withColumn("terminal_at", ends))


_PRIORITY_SQL = """
asked AS (SELECT campaign_key, CASE WHEN work_item_id % 13 = 0 THEN concat(work_key, '-none') ELSE work_key END AS work_key, CASE WHEN work_item_id % 17 = 0 THEN -1 ELSE CAST(work_item_id % 10 AS INT) END AS priority FROM work_items
  UNION ALL SELECT campaign_key, work_key, 77 FROM work_items WHERE work_item_id % 19 = 0),
told AS (SELECT a.*, w.work_item_id, CASE WHEN w.work_item_id IS NULL THEN 'unknown' WHEN count(*) OVER (PARTITION BY a.campaign_key, a.work_key) > 1 THEN 'repeated' WHEN a.priority < 0 THEN 'out_of_range' END AS reason
  FROM asked a LEFT JOIN work_items w ON w.campaign_key = a.campaign_key AND w.work_key = a.work_key)
"""


def _priorities(t: Ledger) -> V.Priorities:
    wanted = t.work_items.select("campaign_key", F.when(F.col("work_item_id") % 13 == 0, F.concat("work_key", F.lit("-none"))).otherwise(F.col("work_key")).alias("work_key"), F.when(F.col("work_item_id") % 17 == 0, -1).otherwise((F.col("work_item_id") % 10).cast("int")).alias("priority"))
    wanted = wanted.unionByName(t.work_items.where("work_item_id % 19 = 0").select("campaign_key", "work_key", F.lit(77).alias("priority")))
    return V.set_priorities(wanted, t.work_items, t.full_executions, t.stage_attempts, F.to_timestamp(F.lit("2026-07-03")))


@query("SELECT e.stage_execution_id, p.priority, CAST(greatest(TIMESTAMP '2026-07-03', e.created_at) AS VARCHAR) AS updated_at, e.state AS expected FROM full_executions e JOIN told p USING (work_item_id) WHERE p.reason IS NULL AND e.state IN ('ready', 'admitted', 'failed')", more=_PRIORITY_SQL)
def priority_changes(t):
    return _priorities(t).executions.withColumn("updated_at", F.col("updated_at").cast("string"))


@query("SELECT c.workflow_id, p.priority FROM stage_executions e JOIN told p USING (work_item_id) JOIN current c USING (stage_execution_id) WHERE p.reason IS NULL AND e.state = 'admitted'", more=_PRIORITY_SQL)
def priority_workflows(t):
    return _priorities(t).workflows.drop("stage_execution_id")


@query("SELECT campaign_key, work_key, priority, reason FROM told WHERE reason IS NOT NULL", more=_PRIORITY_SQL)
def priority_rejects(t):
    return _priorities(t).rejects


# ---------------------------------------------------------------- integrity of all tables

#: The ledger with some rows of every table spoiled, some repeated and some lost; both engines read the same text.
SPOILED = {
    "pipeline_runs": """SELECT run_key, campaign_key, pipeline_key, CASE WHEN expected_member_count % 11 = 3 THEN 0 ELSE pipeline_version END AS pipeline_version, execution_config_reference, CASE WHEN expected_member_count % 11 = 4 THEN -1 ELSE expected_member_count END AS expected_member_count,
        CASE WHEN expected_member_count % 11 = 5 THEN NULL ELSE manifest_reference END AS manifest_reference, membership_digest, run_completion_key, created_at, CASE WHEN expected_member_count % 11 = 6 THEN CAST('2025-01-01' AS TIMESTAMP) ELSE registration_closed_at END AS registration_closed_at,
        registered_member_count, created_work_count, CASE WHEN expected_member_count % 11 = 7 THEN NULL ELSE reused_work_count END AS reused_work_count, CASE WHEN expected_member_count % 11 = 8 THEN CAST('2025-06-01' AS TIMESTAMP) ELSE released_at END AS released_at, release_facts FROM full_runs WHERE expected_member_count % 11 <> 9""",
    "work_items": "SELECT work_item_id, campaign_key, work_key, origin_run_key, CASE WHEN work_item_id % 101 = 0 THEN -rank ELSE rank END AS rank, CASE WHEN work_item_id % 103 = 0 THEN -1 ELSE priority END AS priority FROM full_items WHERE work_item_id % 107 <> 0 UNION ALL SELECT work_item_id + 1000000000, campaign_key, work_key, origin_run_key, rank, priority FROM full_items WHERE work_item_id % 109 = 0",
    "run_memberships": "SELECT run_key, CASE WHEN work_item_id % 113 = 0 THEN -1 ELSE member_ordinal END AS member_ordinal, work_item_id FROM run_memberships UNION ALL SELECT run_key, member_ordinal, work_item_id FROM run_memberships WHERE work_item_id % 127 = 0",
    "stage_executions": """SELECT stage_execution_id, work_item_id, stage_key, CASE WHEN stage_execution_id % 131 = 0 THEN -1 ELSE stage_index END AS stage_index, CASE WHEN stage_execution_id % 137 = 0 THEN 'lost' ELSE state END AS state, CASE WHEN stage_execution_id % 139 = 0 THEN -1 ELSE current_attempt END AS current_attempt,
        rank, CASE WHEN stage_execution_id % 149 = 0 THEN -1 ELSE priority END AS priority, created_at, CASE WHEN stage_execution_id % 151 = 0 THEN CAST('2026-01-01' AS TIMESTAMP) ELSE updated_at END AS updated_at FROM full_executions WHERE stage_execution_id % 157 <> 0""",
    "stage_attempts": """SELECT stage_attempt_id, stage_execution_id, CASE WHEN stage_attempt_id % 163 = 0 THEN 0 ELSE attempt_number END AS attempt_number, CASE WHEN stage_attempt_id % 167 = 0 THEN 'wf-same' ELSE workflow_id END AS workflow_id, CASE WHEN stage_attempt_id % 173 = 0 THEN 'text' ELSE terminal_summary END AS terminal_summary,
        created_at, CASE WHEN stage_attempt_id % 179 = 0 THEN CAST('2026-01-01' AS TIMESTAMP) ELSE admitted_at END AS admitted_at, CASE WHEN stage_attempt_id % 181 = 0 THEN CAST('2026-01-01' AS TIMESTAMP) ELSE terminal_at END AS terminal_at FROM full_attempts""",
    "stage_controls": """SELECT CAST(stage_control_id AS BIGINT) AS stage_control_id, pipeline_key, CASE WHEN stage_control_id = 9 THEN 0 ELSE pipeline_version END AS pipeline_version, stage_key, CASE WHEN stage_control_id IN (3, 4) THEN 'same' ELSE concat(coalesce(label_key, ''), '=', coalesce(label_value, '')) END AS selector_key,
        CASE WHEN stage_control_id = 8 THEN -1 ELSE capacity END AS capacity FROM stage_controls""",
    "run_barrier_cursor": "SELECT run_key <> 'run-1' AS singleton, run_key AS last_run_key FROM full_runs",
    "run_completion_executions": "SELECT run_completion_execution_id, CASE WHEN run_completion_execution_id % 7 = 0 THEN 'run-1' ELSE run_key END AS run_key, CASE WHEN run_completion_execution_id % 5 = 0 THEN 0 ELSE current_attempt END AS current_attempt, CASE WHEN run_completion_execution_id % 11 = 0 THEN 'succeeded' ELSE state END AS state, output_reference, error_summary, enqueued_at, CASE WHEN run_completion_execution_id % 13 = 0 THEN CAST('2025-01-01' AS TIMESTAMP) ELSE terminal_at END AS terminal_at FROM full_completions WHERE run_completion_execution_id % 17 <> 0",
    "run_completion_attempts": "SELECT run_completion_attempt_id, run_completion_execution_id, CASE WHEN run_completion_execution_id % 3 = 0 THEN 1 ELSE attempt_number END AS attempt_number, workflow_id, CASE WHEN run_completion_execution_id % 19 = 0 THEN 'text' ELSE terminal_summary END AS terminal_summary, created_at, CASE WHEN run_completion_execution_id % 23 = 0 THEN CAST('2025-01-01' AS TIMESTAMP) ELSE enqueued_at END AS enqueued_at, terminal_at FROM full_completion_attempts",
}


def _spoiled(t: Ledger, *names: str) -> dict[str, DataFrame]:
    """The spoiled tables of these names (none: all); only what they are made from is derived."""
    import re

    out = {}
    for name in names or SPOILED:
        sql = SPOILED[name]
        used = set(re.findall(r"FROM (\w+)", sql))
        out[name] = t.spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", sql), **{u: getattr(t, u) for u in used})
    return out


_SPOILED_SQL = ", ".join(f"spoiled_{name} AS MATERIALIZED ({sql})" for name, sql in SPOILED.items())
_join = lambda keys: " || '#' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"table\", '{rule}' AS rule, CAST({I.KEYS[name]} AS VARCHAR) AS key FROM spoiled_{name} WHERE NOT coalesce({cond}, true)" for name in SPOILED for rule, cond in I.CHECKS[name].items()), more=_SPOILED_SQL)
def check_violations_all(t):
    return I.check_all(_spoiled(t))


@query(" UNION ALL ".join(f"SELECT '{name}' AS \"table\", '{', '.join(keys)}' AS columns, {_join(keys)} AS key, count(*) AS n FROM spoiled_{name} GROUP BY {', '.join(keys)} HAVING count(*) > 1" for name, keys in I.UNIQUE), more=_SPOILED_SQL)
def unique_violations_all(t):
    return I.unique_all(_spoiled(t))


@query(" UNION ALL ".join(f"SELECT '{child}' AS \"table\", '{', '.join(keys)}' AS columns, {_join('c.' + k for k in keys)} AS key, count(*) AS n FROM spoiled_{child} c WHERE NOT EXISTS (SELECT 1 FROM spoiled_{parent} p WHERE {' AND '.join(f'p.{a} = c.{b}' for a, b in zip(at, keys, strict=True))}) GROUP BY {', '.join('c.' + k for k in keys)}" for child, keys, parent, at in I.FOREIGN), more=_SPOILED_SQL)
def fk_violations_all(t):
    return I.foreign_all(_spoiled(t))


@query("SELECT run_key, 'gone' AS fact FROM full_runs WHERE expected_member_count % 11 = 9 UNION ALL SELECT run_key, 'provenance' FROM full_runs WHERE expected_member_count % 11 IN (3, 4) OR (expected_member_count % 11 = 5 AND manifest_reference IS NOT NULL) UNION ALL SELECT run_key, 'closure' FROM full_runs WHERE registration_closed_at IS NOT NULL AND expected_member_count % 11 IN (6, 7) UNION ALL SELECT run_key, 'release' FROM full_runs WHERE released_at IS NOT NULL AND expected_member_count % 11 = 8")
def immutable_facts(t):
    return I.changed_facts(t.full_runs, _spoiled(t, "pipeline_runs")["pipeline_runs"])


#: Buckets of the tables of the snapshot queries at least.
_BUCKETS = 16


def _store(t: Ledger, **tables: tuple[DataFrame, list[str]]) -> Snapshots:
    store = Snapshots(t.spark, shared_dir(t.spark, "store"))
    change = store.begin()
    for name, (rows, keys) in tables.items():
        change.create(name, rows, keys, buckets_for(rows, _BUCKETS))
    change.commit()
    return store


@query("SELECT stage_execution_id, CASE WHEN work_item_id % 100 = 0 AND state = 'ready' THEN 'cancelled' ELSE state END AS state, current_attempt FROM stage_executions UNION ALL SELECT -stage_execution_id, 'ready', 0 FROM stage_executions WHERE work_item_id % 100 = 0")
def snapshot_update(t):
    """Cancels what is ready of every hundredth item, by copy-on-write under a guard, and adds rows; of two writers that begin together the second is rejected."""
    rows = t.stage_executions.select("stage_execution_id", "state", "current_attempt")
    store = _store(t, stages=(rows, ["stage_execution_id"]))
    chosen = t.stage_executions.where("work_item_id % 100 = 0")
    first, second = store.begin(), store.begin()
    updates = chosen.select("stage_execution_id", F.lit("cancelled").alias("state"), F.lit("ready").alias("expected"))
    added = chosen.select((-F.col("stage_execution_id")).alias("stage_execution_id"), F.lit("ready").alias("state"), F.lit(0).alias("current_attempt"))
    first.update("stages", updates, added, guard="state")
    first.commit()
    second.update("stages", updates.withColumn("state", F.lit("failed")), guard="state")
    try:
        second.commit()
    except Conflict:
        return store.head().read("stages")
    raise RuntimeError("two writers committed one version")


@query("SELECT run_key, 'gone' AS fact FROM full_runs WHERE expected_member_count % 11 = 9 UNION ALL SELECT run_key, 'provenance' FROM full_runs WHERE expected_member_count % 11 IN (3, 4) OR (expected_member_count % 11 = 5 AND manifest_reference IS NOT NULL) UNION ALL SELECT run_key, 'closure' FROM full_runs WHERE registration_closed_at IS NOT NULL AND expected_member_count % 11 IN (6, 7) UNION ALL SELECT run_key, 'release' FROM full_runs WHERE released_at IS NOT NULL AND expected_member_count % 11 = 8")
def snapshot_immutable_facts(t):
    """As ``immutable_facts``, between two versions: buckets with equal digests are not read."""
    store = _store(t, pipeline_runs=(t.full_runs, ["run_key"]))
    change = store.begin()
    change.create("pipeline_runs", _spoiled(t, "pipeline_runs")["pipeline_runs"].select(*t.full_runs.columns), ["run_key"], store.head().tables["pipeline_runs"].buckets)
    return I.changed_facts_between(store.head(), change.commit())


@query("SELECT m.run_key, m.member_ordinal, m.work_item_id, 'removed' AS change FROM run_memberships m JOIN pipeline_runs USING (run_key) WHERE registration_closed_at IS NOT NULL AND work_item_id % 3700 = 37 UNION ALL SELECT m.run_key, m.member_ordinal + 1000000, m.work_item_id, 'added' FROM run_memberships m JOIN pipeline_runs USING (run_key) WHERE registration_closed_at IS NOT NULL AND work_item_id % 3700 = 74")
def snapshot_frozen_memberships(t):
    """Members that a closed run lost or gained between two versions."""
    own = t.run_memberships.select("run_key", "member_ordinal", "work_item_id")
    store = _store(t, run_memberships=(own, ["run_key", "member_ordinal"]), pipeline_runs=(t.pipeline_runs, ["run_key"]))
    change = store.begin()
    more = own.where("work_item_id % 3700 = 74").withColumn("member_ordinal", (F.col("member_ordinal") + 1_000_000).cast("int"))
    change.create("run_memberships", own.where("work_item_id % 3700 <> 37").unionByName(more), ["run_key", "member_ordinal"], store.head().tables["run_memberships"].buckets)
    return I.frozen_members_between(store.head(), change.commit())


# ---------------------------------------------------------------- readers with rejects, clusters, seeded ledgers


@query("SELECT campaign_key, CAST(min(r.created_at) AS VARCHAR) AS created_at, count(*) AS run_count, (SELECT count(*) FROM work_items w WHERE w.campaign_key = r.campaign_key) AS work_item_count FROM pipeline_runs r WHERE campaign_key IN (SELECT concat('campaign-', n_nationkey) FROM nation WHERE n_nationkey < 20) GROUP BY campaign_key")
def inspect_campaigns(t):
    wanted = t.nation.where("n_nationkey < 20").select(F.concat(F.lit("campaign-"), F.col("n_nationkey").cast("string")).alias("campaign_key"))
    rows, _ = S.inspect_campaigns(wanted, t.pipeline_runs, t.work_items)
    return schemas.conform(rows, schemas.READERS["campaign_summary"]).withColumn("created_at", F.col("created_at").cast("string"))


@query("SELECT concat(run_key, '-none') AS run_key FROM pipeline_runs")
def unknown_runs(t):
    runs = t.pipeline_runs.select("run_key")
    return S.unknown_keys(runs.unionByName(runs.select(F.concat("run_key", F.lit("-none")).alias("run_key"))), t.pipeline_runs, "run_key")


_RANGES_SQL = "ranges AS (SELECT work_item_id, CASE WHEN work_item_id % 4 = 0 THEN NULL ELSE CAST(work_item_id % 3 AS INT) END AS above, CASE WHEN work_item_id % 5 = 0 THEN NULL ELSE CAST(work_item_id % 7 AS INT) END AS below FROM work_items)"


def _ranges(t: Ledger) -> DataFrame:
    return t.spark.sql(f"WITH {_RANGES_SQL.replace('FROM work_items', 'FROM {items}')} SELECT * FROM ranges", items=t.work_items)


@query("SELECT e.stage_execution_id, e.work_item_id, e.stage_index FROM ranges r JOIN stage_executions e USING (work_item_id) WHERE coalesce(above < below, true) AND (above IS NULL OR e.stage_index > above) AND (below IS NULL OR e.stage_index < below)", more=_RANGES_SQL)
def stages_in_ranges(t):
    return S.stages_in_ranges(_ranges(t), t.stage_executions)[0].select("stage_execution_id", "work_item_id", "stage_index")


@query("SELECT work_item_id, above, below FROM ranges WHERE above >= below", more=_RANGES_SQL)
def empty_ranges(t):
    return S.stages_in_ranges(_ranges(t), t.stage_executions)[1]


@query("""SELECT work_item_id, fanin_index, fanin_id, optim_index, CASE WHEN problem IS NULL THEN coalesce(ids, '') END AS eval_ids, problem FROM (SELECT *, CASE WHEN fanin_id IS NULL THEN 'no_row' WHEN NOT waits THEN 'not_barrier' WHEN optim_index IS NULL THEN 'no_optim' WHEN alien > 0 THEN 'foreign_key' WHEN n <> fanin_index - optim_index - 1 THEN 'gap' END AS problem
FROM (SELECT q.work_item_id, q.fanin_index, any_value(f.stage_execution_id) AS fanin_id, any_value(f.barrier) AS waits, any_value(q.optim_index) AS optim_index, count(b.stage_index) AS n, count(*) FILTER (b.stage_key <> 'eval_row') AS alien, string_agg(b.stage_execution_id, ',' ORDER BY b.stage_index) AS ids
  FROM (SELECT w.work_item_id, w.fanin_index, (SELECT max(o.stage_index) FROM kept o WHERE o.work_item_id = w.work_item_id AND o.stage_key = 'optim_step' AND o.stage_index < w.fanin_index) AS optim_index
        FROM (SELECT work_item_id, stage_index AS fanin_index FROM stage_executions UNION SELECT work_item_id, 99 FROM work_items) w) q
  LEFT JOIN kept f ON f.work_item_id = q.work_item_id AND f.stage_index = q.fanin_index LEFT JOIN kept b ON b.work_item_id = q.work_item_id AND b.stage_index > q.optim_index AND b.stage_index < q.fanin_index GROUP BY 1, 2))""",
    more="kept AS (SELECT work_item_id, stage_index, stage_execution_id, barrier, CASE WHEN stage_execution_id % 23 = 0 AND stage_key = 'eval_row' THEN 'alien' ELSE stage_key END AS stage_key FROM stage_executions WHERE stage_execution_id % 11 <> 0)")
def cluster_resolution(t):
    """Every index of every item as a fan-in, and one that is not there; some stages are lost, some have another key."""
    kept = t.stage_executions.where("stage_execution_id % 11 <> 0").withColumn("stage_key", F.when((F.col("stage_execution_id") % 23 == 0) & (F.col("stage_key") == "eval_row"), "alien").otherwise(F.col("stage_key")))
    wanted = t.stage_executions.select("work_item_id", F.col("stage_index").alias("fanin_index")).unionByName(t.work_items.select("work_item_id", F.lit(99).alias("fanin_index")))
    found = S.resolve_clusters(wanted, kept)
    return found.withColumn("eval_ids", F.array_join(F.transform("eval_rows", lambda x: x.cast("string")), ",")).drop("eval_rows")


@query("""SELECT work_item_id, fanin_index, optim_index, n AS eval_count, CAST(NULL AS VARCHAR) AS problem FROM (SELECT w.work_item_id, w.work_item_id % 4 + 1 AS n, ((k + 1) * (w.work_item_id % 4 + 3) - 1)::INT AS fanin_index, (k * (w.work_item_id % 4 + 3))::INT AS optim_index
FROM work_items w, (VALUES (0), (1)) t(k) WHERE k <= w.work_item_id % 2)""")
def seeded_episodes(t):
    """Clusters of one or two seeded episodes for every item."""
    seeded = seeders.episodes(t.full_items, F.col("work_item_id") % 4 + 1, F.col("work_item_id") % 2 + 1)
    return S.barrier_clusters(seeded).drop("fanin_id")


@query("SELECT work_item_id AS origin_id, work_item_id % 5 + 1 AS rows, CAST(NULL AS VARCHAR) AS problem FROM work_items")
def seeded_fanouts(t):
    origins = t.work_items.select(F.col("work_item_id").alias("origin_id"), F.lit(3).alias("origin_index"))
    return C.fanout_problems(seeders.fanouts(origins, F.col("origin_id") % 5 + 1), seeders.EVALUATED, seeders.FANIN)


# ---------------------------------------------------------------- streams

_MOVES_SQL = """
moves_in AS (SELECT user_id + 1 AS work_item_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'admitted' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS new_state,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
folded AS (
  SELECT DISTINCT work_item_id, 0::BIGINT AS seq, 0::BIGINT AS nth, '' AS old_state, '' AS new_state, true AS accepted, 'ready' AS now FROM moves_in
  UNION ALL
  SELECT f.work_item_id, m.seq, m.nth, f.now, m.new_state, ok, CASE WHEN ok THEN m.new_state ELSE f.now END
  FROM folded f, LATERAL (SELECT x.*, (f.now, x.new_state) IN (('ready', 'admitted'), ('ready', 'cancelled'), ('admitted', 'succeeded'), ('admitted', 'failed'), ('admitted', 'cancelled'), ('failed', 'ready'), ('failed', 'cancelled')) AS ok
    FROM moves_in x WHERE x.work_item_id = f.work_item_id AND x.nth = f.nth + 1) m),
moves AS (SELECT * FROM folded WHERE nth > 0),
states AS (SELECT work_item_id, arg_max(now, nth) AS state FROM folded GROUP BY 1)
"""


def _moves(t: Ledger) -> DataFrame:
    return folds.run_once(t.spark, folds.folded_moves(folds.read_events(t.spark, t.sf_dir)))


@query("SELECT work_item_id, arg_max(now, nth) AS state, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected FROM moves GROUP BY 1", more=_MOVES_SQL)
def stream_current_state(t):
    return folds.current_states(_moves(t))


@query("SELECT work_item_id, seq, old_state, new_state FROM moves WHERE NOT accepted", more=_MOVES_SQL)
def stream_rejected_moves(t):
    return _moves(t).where("NOT accepted").drop("accepted")


#: Events of a file of a stream at most; and files at least.
_FILE_ROWS, _FILES = 250_000, 8
_FILE_SQL = "((event_id - low) * files // (high - low + 1))"
_SPAN_SQL = f"""
span AS (SELECT min(event_id) AS low, max(event_id) AS high, greatest({_FILES}, count(*) // {_FILE_ROWS}) AS files, epoch_ms(min(ts)) AS first, epoch_ms(max(ts)) AS last FROM events)
"""


def _files(t: Ledger) -> tuple[int, Column]:
    """How many files the events fill, and each one's file in the order of ids."""
    low, high, n = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    files = max(_FILES, n // _FILE_ROWS)
    return files, F.floor((F.col("seq") - (low or 0)) * files / F.lit((high or 0) - (low or 0) + 1)).cast("int")


def _moves_of_files(t: Ledger) -> DataFrame:
    """Moves with the ``batch`` that took them, a file of events each."""
    files, file = _files(t)
    events = folds.event_moves(t.spark.read.parquet(f"{t.sf_dir}/events.parquet")).drop("ts")
    stream = folds.read_files(t.spark, folds.in_files(events, file, files, "events"), events.schema)
    return folds.run_once(t.spark, folds.folded_moves(stream), numbered=True)


@query("SELECT campaign_key, coalesce(s.state, 'ready') AS state, count(*) AS n FROM work_items LEFT JOIN states s USING (work_item_id) GROUP BY ALL", more=_MOVES_SQL)
def stream_state_counts(t):
    """A file of events a batch; after some files another process takes over the stream and the log of counts."""
    files, file = _files(t)
    events = folds.event_moves(t.spark.read.parquet(f"{t.sf_dir}/events.parquet")).drop("ts")
    path, held = folds.in_files(events.where(file < files // 2), file, files // 2, "events"), shared_dir(t.spark, "counted")
    counts = folds.LiveCounts(t.spark, t.work_items)
    stream = folds.folded_moves(folds.read_files(t.spark, path, events.schema))
    folds.run_once(t.spark, stream, each=counts, state=held)
    folds.in_files(events.where(file >= files // 2), file, files - files // 2, "events", path, files // 2)
    folds.run_once(t.spark, stream, each=folds.LiveCounts(t.spark, base=counts.store.base), state=held)
    return folds.LiveCounts(t.spark, base=counts.store.base).now()


def _settled(t: Ledger, moves: DataFrame, file: Column, files: int) -> DataFrame:
    """Runs that are released at the start, and those that the stream of accepted moves releases."""
    members, runs = state.open_at_start(t.pipeline_runs, t.run_memberships, S.work_item_status(t.stage_executions))
    accepted = moves.where("accepted")
    # an item that never moves tells its runs nothing, so batches need not look for theirs among such items
    members = members.join(narrow(accepted.select("work_item_id").distinct()), "work_item_id", "left_semi")
    rows = accepted.select("work_item_id", "seq", "new_state", F.lit(None).cast("string").alias("run_key"), F.lit(False).alias("closes"), file.alias("at"))
    stream = folds.read_files(t.spark, folds.in_files(rows, F.col("at"), files, "moves"), rows.schema)
    released = folds.run_once(t.spark, state.settled_runs(stream, members, runs.where("NOT released")))
    return runs.where("released").select("run_key").unionByName(released)


@query("""SELECT r.run_key FROM pipeline_runs r WHERE r.registration_closed_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_memberships m LEFT JOIN states s USING (work_item_id) LEFT JOIN status d USING (work_item_id)
  WHERE m.run_key = r.run_key AND CASE WHEN s.state IS NOT NULL AND EXISTS (SELECT 1 FROM moves x WHERE x.work_item_id = m.work_item_id AND x.accepted) THEN s.state ELSE d.state END NOT IN ('succeeded', 'failed', 'cancelled') AND d.state IS NOT NULL)
UNION SELECT r.run_key FROM pipeline_runs r WHERE r.registration_closed_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_memberships m JOIN status d USING (work_item_id) WHERE m.run_key = r.run_key AND d.state NOT IN ('succeeded', 'failed', 'cancelled'))""", more=_MOVES_SQL)
def stream_run_settled(t):
    """Runs released at the start or by all moves in one batch; items without an accepted move are as the ledger has them."""
    return _settled(t, _moves(t), F.lit(0), 1)


@query("""SELECT run_key FROM (SELECT r.run_key, b.k, count(*) FILTER (o.open) AS n
  FROM pipeline_runs r CROSS JOIN (SELECT unnest(range(-1, files)) AS k FROM span) b LEFT JOIN run_memberships m ON m.run_key = r.run_key LEFT JOIN openness o ON o.work_item_id = m.work_item_id AND o.k = b.k
  WHERE r.registration_closed_at IS NOT NULL GROUP BY 1, 2) GROUP BY run_key HAVING min(n) = 0""", more=f"""{_MOVES_SQL}, {_SPAN_SQL},
taken AS (SELECT m.*, (m.seq - low) * files // (high - low + 1) AS k FROM moves m, span WHERE accepted),
members_of AS (SELECT DISTINCT work_item_id FROM run_memberships),
ends AS (SELECT work_item_id, k, arg_max(new_state, seq) AS state FROM taken GROUP BY 1, 2),
openness AS (SELECT i.work_item_id, b.k, coalesce(coalesce(last_value(e.state IGNORE NULLS) OVER (PARTITION BY i.work_item_id ORDER BY b.k), d.state) NOT IN ('succeeded', 'failed', 'cancelled'), false) AS open
  FROM members_of i CROSS JOIN (SELECT unnest(range(-1, files)) AS k FROM span) b LEFT JOIN ends e ON e.work_item_id = i.work_item_id AND e.k = b.k LEFT JOIN status d ON d.work_item_id = i.work_item_id)""")
def stream_runs_settled_by_batch(t):
    """Runs released at the end of any batch, each once, whatever becomes of their members afterwards."""
    moves = _moves_of_files(t)
    return _settled(t, moves, F.col("batch").cast("int"), _files(t)[0])


#: Every tenth event comes a file later than it should, and every tenth three files later, mostly beyond the delay of one and a half files.
_ORDERED_SQL = f"""{_SPAN_SQL},
arrived AS (SELECT user_id + 1 AS work_item_id, event_id AS seq, epoch_ms(ts) AS ms, 3 * (last - first) // (2 * files) AS delay,
  CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'admitted' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS new_state,
  least(files - 1, {_FILE_SQL} + CASE event_id % 10 WHEN 3 THEN 1 WHEN 7 THEN 3 ELSE 0 END) AS file FROM events, span),
clock AS (SELECT file, max(max(ms)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM arrived GROUP BY file),
timed AS (SELECT a.*, coalesce(a.ms < c.seen - a.delay, false) AS late FROM arrived a JOIN clock c USING (file)),
intime AS (SELECT *, row_number() OVER (PARTITION BY work_item_id ORDER BY ms, seq) AS nth FROM timed WHERE NOT late),
folded_in_time AS (
  SELECT DISTINCT work_item_id, 0::BIGINT AS seq, 0::BIGINT AS nth, '' AS old_state, '' AS new_state, true AS accepted, 'ready' AS now FROM intime
  UNION ALL
  SELECT f.work_item_id, m.seq, m.nth, f.now, m.new_state, ok, CASE WHEN ok THEN m.new_state ELSE f.now END
  FROM folded_in_time f, LATERAL (SELECT x.*, (f.now, x.new_state) IN (('ready', 'admitted'), ('ready', 'cancelled'), ('admitted', 'succeeded'), ('admitted', 'failed'), ('admitted', 'cancelled'), ('failed', 'ready'), ('failed', 'cancelled')) AS ok
    FROM intime x WHERE x.work_item_id = f.work_item_id AND x.nth = f.nth + 1) m)
"""


@query("""SELECT work_item_id, seq, old_state, new_state, CASE WHEN accepted THEN 'accepted' ELSE 'illegal' END AS fate FROM folded_in_time WHERE nth > 0
UNION ALL SELECT work_item_id, seq, NULL, new_state, 'late' FROM timed WHERE late""", more=_ORDERED_SQL)
def stream_ordered_moves(t):
    """Events that come out of order, a file a batch: taken in the order of their time up to a delay, and rejected as late beyond it."""
    files, file = _files(t)
    events = folds.event_moves(t.spark.read.parquet(f"{t.sf_dir}/events.parquet"))
    first, last = events.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    delay = 3 * ((last or 0) - (first or 0)) // (2 * files)
    shift = F.when(F.col("seq") % 10 == 3, 1).when(F.col("seq") % 10 == 7, 3).otherwise(0)
    path = folds.in_files(events, F.least(F.lit(files - 1), file + shift), files, "late-events")
    beat = t.spark.range(1).select(F.lit(None).cast("long").alias("work_item_id"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("new_state"), F.timestamp_millis(F.lit((last or 0) + 2 * delay + 1000)).alias("ts"))
    beat.coalesce(1).write.mode("append").parquet(path)
    return folds.run_once(t.spark, state.ordered_moves(folds.read_files(t.spark, path, events.schema), f"{delay} milliseconds"))


@query("""SELECT run_key, member_ordinal, work_key, kind FROM (SELECT m.*, CASE WHEN w.work_item_id IS NULL THEN 'new' WHEN w.input_reference <> m.input_reference THEN 'conflict' WHEN w.priority <> m.priority THEN 'priority_change' ELSE 'same' END AS kind
  FROM members m LEFT JOIN work_items w ON w.campaign_key = m.campaign_key AND w.work_key = m.work_key) WHERE run_key NOT IN (SELECT m.run_key FROM members m JOIN work_items w ON w.campaign_key = m.campaign_key AND w.work_key = m.work_key WHERE w.input_reference <> m.input_reference)""")
def stream_registration(t):
    """The members of open runs as a stream of several batches, whole runs each."""
    path = folds.in_files(t.members, F.pmod(F.xxhash64("run_key"), F.lit(_FILES)).cast("int"), _FILES, "members")
    registration = folds.Registration(t.spark, t.full_items, t.full_runs)
    folds.run_once(t.spark, folds.read_files(t.spark, path, t.members.schema), each=registration)
    return registration.read("members").select("run_key", "member_ordinal", "work_key", "kind")


@query("SELECT CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'admitted' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS state, count(*) AS n FROM events GROUP BY 1")
def stream_event_counts(t):
    return folds.run_once(t.spark, folds.event_counts(folds.read_events(t.spark, t.sf_dir)), "complete")
