"""Queries of the readers for many requests at once; every item, run, member and stage of the ledger is the cursor of a request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import readers as P
from ..sources.fixtures import Ledger
from .queries import query

# Requests, in words that both engines read alike. Some have a fault, several of them more than one.
_ITEMS = """
SELECT work_item_id AS request_id, CASE WHEN work_item_id % 101 = 0 THEN 'campaign-none' ELSE campaign_key END AS campaign_key,
  CASE work_item_id % 7 WHEN 1 THEN 'succeeded' WHEN 2 THEN 'ready' WHEN 3 THEN 'failed' WHEN 4 THEN CASE WHEN work_item_id % 13 = 0 THEN 'odd' ELSE 'admitted' END END AS state,
  CASE WHEN work_item_id % 17 = 0 THEN NULL WHEN work_item_id % 19 = 0 THEN -work_item_id WHEN work_item_id % 23 = 0 THEN work_item_id + 1 ELSE work_item_id END AS cursor,
  CAST(work_item_id % 6 AS INT) AS page_size
FROM {items}"""
_RUNS = """
SELECT row_number() OVER (ORDER BY run_key) AS request_id, CASE WHEN expected_member_count % 13 = 12 THEN 'campaign-none' ELSE campaign_key END AS campaign_key,
  CASE WHEN expected_member_count % 11 = 3 THEN NULL WHEN expected_member_count % 11 = 4 THEN concat(run_key, '-none') ELSE run_key END AS cursor, expected_member_count % 9 AS page_size
FROM {runs}"""
_MEMBERS = """
SELECT work_item_id * 2 + CASE WHEN run_key LIKE 'run-all-%' THEN 1 ELSE 0 END AS request_id, CASE WHEN work_item_id % 97 = 0 THEN concat(run_key, '-none') ELSE run_key END AS run_key,
  CASE WHEN work_item_id % 17 = 0 THEN NULL WHEN work_item_id % 19 = 0 THEN -1 WHEN work_item_id % 23 = 0 THEN 1000000 ELSE member_ordinal END AS cursor, CAST(work_item_id % 5 AS INT) AS page_size
FROM {members}"""
_OUTPUTS = """
SELECT stage_execution_id AS request_id, CASE WHEN stage_execution_id % 103 = 0 THEN 0 ELSE work_item_id END AS work_item_id, CASE WHEN stage_execution_id % 29 = 0 THEN -1 ELSE stage_index END AS below,
  CASE WHEN work_item_id % 3 = 0 THEN 'eval_row' END AS stage_key, CASE WHEN work_item_id % 5 = 1 THEN 0 WHEN work_item_id % 5 = 2 THEN -2 END AS above, CASE WHEN work_item_id % 7 = 1 THEN 2 END AS up_to
FROM {executions}"""


def _cte(name: str, sql: str, **tables: str) -> str:
    return f"{name} AS ({sql.format(**tables).strip()})"


#: The first rule that a request breaks, and the pages of the others.
_ITEMS_SQL = _cte("asked", _ITEMS, items="work_items") + """,
judged AS (SELECT q.*, CASE WHEN page_size <= 0 THEN 'bad_page_size' WHEN state = 'odd' THEN 'bad_state' WHEN campaign_key = 'campaign-none' THEN 'unknown_campaign' WHEN cursor <= 0 THEN 'bad_cursor'
  WHEN cursor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM work_items w WHERE w.work_item_id = q.cursor AND w.campaign_key = q.campaign_key) THEN 'unknown_cursor' END AS reason FROM asked q),
shown AS (SELECT w.work_item_id, w.campaign_key, w.work_key, w.origin_run_key, w.segment, s.stage_execution_id, s.stage_key, s.stage_index, s.state FROM work_items w JOIN status s USING (work_item_id)),
pages AS (SELECT * FROM (SELECT q.request_id, q.page_size, row_number() OVER (PARTITION BY q.request_id ORDER BY w.work_item_id) AS nth, w.*
  FROM judged q JOIN shown w ON w.campaign_key = q.campaign_key AND (q.state IS NULL OR w.state = q.state) AND (q.cursor IS NULL OR w.work_item_id > q.cursor) WHERE q.reason IS NULL) WHERE nth <= page_size)
"""
_RUNS_SQL = _cte("asked", _RUNS, runs="full_runs") + """,
judged AS (SELECT q.*, r.created_at AS since, CASE WHEN page_size <= 0 THEN 'bad_page_size' WHEN q.campaign_key = 'campaign-none' THEN 'unknown_campaign' WHEN q.cursor IS NOT NULL AND r.run_key IS NULL THEN 'unknown_cursor' END AS reason
  FROM asked q LEFT JOIN full_runs r ON r.run_key = q.cursor AND r.campaign_key = q.campaign_key),
sized AS (SELECT r.*, CASE WHEN registration_closed_at IS NOT NULL THEN registered_member_count ELSE coalesce(n, 0) END::INT AS size FROM full_runs r LEFT JOIN (SELECT run_key, count(*) AS n FROM run_memberships GROUP BY 1) USING (run_key)),
pages AS (SELECT * FROM (SELECT q.request_id, q.page_size, row_number() OVER (PARTITION BY q.request_id ORDER BY r.created_at, r.run_key) AS nth, r.*
  FROM judged q JOIN sized r ON r.campaign_key = q.campaign_key AND (q.cursor IS NULL OR (r.created_at, r.run_key) > (q.since, q.cursor)) WHERE q.reason IS NULL) WHERE nth <= page_size)
"""
_SEEN = """,
judged AS (SELECT q.*, CASE WHEN page_size <= 0 THEN 'bad_page_size' WHEN run_key LIKE '%-none' THEN 'unknown_run' WHEN cursor < 0 THEN 'bad_cursor'
  WHEN cursor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM run_memberships m WHERE m.run_key = q.run_key AND m.member_ordinal = q.cursor) THEN 'unknown_cursor' END AS reason FROM asked q),
shown AS (SELECT m.run_key, m.member_ordinal, m.work_item_id, w.work_key, w.input_reference, s.stage_execution_id, s.stage_key, s.stage_index, s.state, c.terminal_summary, c.evidence_reference
  FROM run_memberships m JOIN work_items w USING (work_item_id) LEFT JOIN status s USING (work_item_id) LEFT JOIN current c USING (stage_execution_id)),
pages AS (SELECT * FROM (SELECT q.request_id, q.page_size, row_number() OVER (PARTITION BY q.request_id ORDER BY m.member_ordinal) AS nth, m.*
  FROM judged q JOIN shown m ON m.run_key = q.run_key AND (q.cursor IS NULL OR m.member_ordinal > q.cursor) WHERE q.reason IS NULL{more}) WHERE nth <= page_size)
"""
_MEMBERS_SQL = _cte("asked", _MEMBERS, members="run_memberships") + _SEEN.format(more="")
_FAILED_SQL = _cte("asked", _MEMBERS, members="run_memberships") + _SEEN.format(more=" AND m.state = 'failed' AND json_extract_string(m.terminal_summary, '$.producer') = 'application_failure'")
_OUTPUTS_SQL = _cte("asked", _OUTPUTS, executions="stage_executions") + """,
judged AS (SELECT *, coalesce(up_to, below) AS top, CASE WHEN work_item_id <= 0 THEN 'bad_item' WHEN below < 0 THEN 'bad_bound' WHEN up_to > below THEN 'bound_over_stage' WHEN above < 0 THEN 'bad_bound'
  WHEN above >= coalesce(up_to, below) THEN 'empty_range' END AS reason FROM asked)
"""


def _item_pages(t: Ledger) -> P.Read:
    return P.work_item_pages(t.spark.sql(_ITEMS, items=t.work_items), t.pipeline_runs, t.full_items, t.stage_executions)


@query("SELECT request_id, nth, work_item_id, campaign_key, work_key, origin_run_key, segment, stage_execution_id AS current_stage_execution_id, stage_key AS current_stage_key, stage_index AS current_stage_index, state FROM pages", more=_ITEMS_SQL)
def pages_of_items(t):
    return _item_pages(t).rows.withColumn("segment", F.col("labels")["segment"]).drop("labels")


def _run_pages(t: Ledger) -> P.Read:
    return P.run_pages(t.spark.sql(_RUNS, runs=t.full_runs), t.full_runs, t.run_memberships)


@query("""SELECT request_id, nth, run_key, campaign_key, pipeline_key, pipeline_version, execution_config_reference, expected_member_count, manifest_reference, membership_digest, CAST(created_at AS VARCHAR) AS created_at,
  CAST(registration_closed_at AS VARCHAR) AS registration_closed_at, size AS registered_member_count, CAST(released_at AS VARCHAR) AS released_at FROM pages""", more=_RUNS_SQL)
def pages_of_runs(t):
    return _run_pages(t).rows.withColumns({c: F.col(c).cast("string") for c in ("created_at", "registration_closed_at", "released_at")})


@query("""SELECT n.n_nationkey::BIGINT AS request_id, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY c.campaign_key) AS nth, c.* FROM nation n
JOIN (SELECT campaign_key, CAST(min(created_at) AS VARCHAR) AS created_at, count(*) AS run_count, (SELECT count(*) FROM work_items w WHERE w.campaign_key = r.campaign_key) AS work_item_count FROM pipeline_runs r GROUP BY 1) c
  ON c.campaign_key > concat('campaign-', n.n_nationkey)""")
def pages_of_campaigns(t):
    requests = t.nation.select(F.col("n_nationkey").cast("long").alias("request_id"), F.concat(F.lit("campaign-"), F.col("n_nationkey").cast("string")).alias("cursor"), F.lit(None).cast("int").alias("page_size"))
    return P.campaign_pages(requests, t.pipeline_runs, t.work_items).rows.withColumn("created_at", F.col("created_at").cast("string"))


def _member_pages(t: Ledger, **more) -> P.Read:
    attempts = lambda stages: t.derived("stage_attempts", stage_executions=stages)
    return P.run_member_pages(t.spark.sql(_MEMBERS, members=t.run_memberships), t.pipeline_runs, t.run_memberships, t.work_items, t.stage_executions, attempts, **more)


@query("SELECT request_id, nth, member_ordinal, work_key, work_item_id, input_reference, stage_key AS current_stage_key, stage_index AS current_stage_index, state FROM pages", more=_MEMBERS_SQL)
def pages_of_members(t):
    return _member_pages(t).rows.drop("stage_execution_id", "terminal_summary", "evidence_reference")


@query("SELECT request_id, nth, member_ordinal, work_key, work_item_id, input_reference, stage_key AS current_stage_key, stage_index AS current_stage_index, state, stage_execution_id, terminal_summary, evidence_reference FROM pages", more=_FAILED_SQL)
def pages_of_failed_members(t):
    return _member_pages(t, condition=X.terminal_filter(producer="application_failure", state="failed"), states=("failed",)).rows


@query("""SELECT e.work_item_id AS request_id, row_number() OVER (PARTITION BY e.work_item_id ORDER BY stage_index, stage_execution_id) AS nth, e.stage_execution_id, stage_key, stage_index, state, current_attempt, rank, priority, input_reference, output_reference,
  barrier, CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at, coalesce(a.ids, '') AS workflow_ids
FROM full_executions e LEFT JOIN (SELECT stage_execution_id, string_agg(workflow_id, ',' ORDER BY attempt_number) AS ids FROM stage_attempts GROUP BY 1) a USING (stage_execution_id)""")
def records_of_stages(t):
    rows = P.stage_records(t.work_items.select("work_item_id"), t.full_executions, t.full_attempts).rows
    ids = F.array_join(F.transform("attempts", lambda a: a["workflow_id"]), ",")
    return rows.withColumn("workflow_ids", ids).withColumns({c: F.col(c).cast("string") for c in ("created_at", "updated_at")}).drop("attempts", "work_item_id")


def _outputs(t: Ledger) -> P.Read:
    return P.predecessor_records(t.spark.sql(_OUTPUTS, executions=t.stage_executions), t.stage_executions)


@query("""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY e.stage_index) AS nth, e.stage_index, e.stage_key, e.input_reference, e.output_reference
FROM judged q JOIN stage_executions e ON e.work_item_id = q.work_item_id AND e.state = 'succeeded' AND e.output_reference IS NOT NULL AND (q.stage_key IS NULL OR e.stage_key = q.stage_key)
  AND (q.above IS NULL OR e.stage_index > q.above) AND e.stage_index < q.top WHERE q.reason IS NULL""", more=_OUTPUTS_SQL)
def records_of_outputs(t):
    return _outputs(t).rows


def _rejects(t: Ledger, readers: dict[str, P.Read]) -> DataFrame:
    return reduce(DataFrame.unionByName, [read.rejects.withColumn("reader", F.lit(name)) for name, read in readers.items()])


def _renamed(sql: str, name: str) -> str:
    """The judged requests of one reader as a common table expression of its own."""
    return f"{name} AS (WITH {sql.split('shown AS (')[0].split('sized AS (')[0].strip().rstrip(',')} SELECT request_id, reason FROM judged WHERE reason IS NOT NULL)"


_REJECTS_SQL = {"items": _ITEMS_SQL, "runs": _RUNS_SQL, "members": _MEMBERS_SQL, "outputs": _OUTPUTS_SQL}


@query(" UNION ALL ".join(f"SELECT request_id, reason, '{name}' AS reader FROM refused_{name}" for name in _REJECTS_SQL), more=",\n".join(_renamed(sql, f"refused_{name}") for name, sql in _REJECTS_SQL.items()))
def reader_rejects(t):
    return _rejects(t, {"items": _item_pages(t), "runs": _run_pages(t), "members": _member_pages(t), "outputs": _outputs(t)})
