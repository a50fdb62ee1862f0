"""A ledger derived from the order tables: one SQL text per table that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import apart, few, shared_dir

SOURCES = ("nation", "customer", "orders", "lineitem", "events")

#: In order of dependence; ``{{name}}`` is a table of the driver, a plain name an earlier ledger table.
TABLES: dict[str, str] = {
    "pipeline_runs": """
SELECT concat('run-', c_custkey) AS run_key, concat('campaign-', c_nationkey) AS campaign_key, 'evaluation' AS pipeline_key,
       CAST(1 + c_nationkey % 2 AS INT) AS pipeline_version, concat('config:', c_nationkey % 2) AS execution_config_reference,
       CAST(coalesce(n, 0) AS INT) AS expected_member_count,
       CASE WHEN c_custkey % 5 <> 2 THEN concat('manifest:run-', c_custkey) END AS manifest_reference,
       CASE WHEN c_custkey % 5 <> 2 THEN 'finalize' END AS run_completion_key,
       CAST(CAST('2026-01-01' AS DATE) + CAST(c_custkey % 97 AS INT) AS TIMESTAMP) AS created_at,
       CASE WHEN c_custkey % 10 <> 0 THEN CAST(CAST('2026-01-02' AS DATE) + CAST(c_custkey % 97 AS INT) AS TIMESTAMP) END AS registration_closed_at,
       CASE WHEN c_custkey % 10 <> 0 THEN CAST(coalesce(n, 0) AS INT) END AS registered_member_count,
       CASE WHEN c_custkey % 10 = 1 THEN CAST(CAST('2026-01-03' AS DATE) + CAST(c_custkey % 97 AS INT) AS TIMESTAMP) END AS released_at
FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey
UNION ALL
SELECT concat('run-all-', n_nationkey), concat('campaign-', n_nationkey), 'evaluation', CAST(1 + n_nationkey % 2 AS INT), concat('config:', n_nationkey % 2),
       CAST(coalesce(n, 0) AS INT), concat('manifest:run-all-', n_nationkey), 'finalize', CAST('2026-06-01' AS TIMESTAMP), CAST('2026-06-02' AS TIMESTAMP), CAST(coalesce(n, 0) AS INT), CAST(NULL AS TIMESTAMP)
FROM {nation} LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey) ON k = n_nationkey""",
    "work_items": """
SELECT o_orderkey + 1 AS work_item_id, concat('campaign-', c_nationkey) AS campaign_key, concat('work-', o_orderkey) AS work_key,
       concat('run-', o_custkey) AS origin_run_key, concat('input:', o_orderkey) AS input_reference,
       c_mktsegment AS segment, o_orderpriority AS urgency, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS priority
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "run_memberships": """
SELECT concat('run-', o_custkey) AS run_key, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS member_ordinal, o_orderkey + 1 AS work_item_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT concat('run-all-', c_nationkey), CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS INT), o_orderkey + 1
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "stage_executions": """
SELECT stage_execution_id, work_item_id, stage_key, stage_index, state,
       CASE WHEN state = 'ready' THEN 0 WHEN stage_execution_id % 7 = 0 THEN 2 ELSE 1 END AS current_attempt,
       concat('in:', stage_execution_id) AS input_reference, CASE WHEN state = 'succeeded' THEN concat('out:', stage_execution_id) END AS output_reference,
       stage_key = 'eval_fanin' AS barrier
FROM (SELECT l_orderkey * 100 + i + 1 AS stage_execution_id, l_orderkey + 1 AS work_item_id, CAST(i AS INT) AS stage_index,
             CASE WHEN n < 3 THEN 'execute' WHEN i = 0 THEN 'optim_step' WHEN i = n - 1 THEN 'eval_fanin' ELSE 'eval_row' END AS stage_key,
             CASE WHEN o_custkey % 4 = 3 AND (o_orderstatus = 'O' OR (o_orderstatus = 'P' AND l_returnflag = 'N')) THEN 'succeeded'
                  WHEN o_orderstatus = 'F' THEN CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN 'failed' ELSE 'succeeded' END
                  WHEN o_orderstatus = 'O' THEN CASE WHEN l_linestatus = 'O' THEN 'ready' ELSE 'succeeded' END
                  WHEN l_returnflag = 'N' THEN 'admitted' WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'succeeded' END AS state
      FROM (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity, o_custkey, o_orderstatus, count(*) OVER (PARTITION BY l_orderkey) AS n,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS i
            FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) AS numbered) AS staged""",
    "stage_attempts": """
SELECT stage_execution_id * 10 + a AS stage_attempt_id, stage_execution_id, CAST(a AS INT) AS attempt_number, concat('wf-', stage_execution_id, '-a', a) AS workflow_id,
       CASE WHEN a < current_attempt THEN '{{"outcome":"failed","producer":"application_failure","error_type":"builtins.ValueError"}}'
            WHEN state = 'failed' AND stage_execution_id % 3 = 0 THEN '{{"outcome":"failed","producer":"abandonment","reason":"dead_executor"}}'
            WHEN state = 'failed' THEN '{{"outcome":"failed","producer":"application_failure","error_type":"builtins.RuntimeError"}}'
            WHEN state = 'cancelled' THEN '{{"outcome":"cancelled","producer":"cancellation","reason":"operator_requested"}}'
            WHEN state = 'succeeded' THEN '{{"outcome":"succeeded"}}' END AS terminal_summary,
       CASE WHEN a = current_attempt AND state = 'failed' AND stage_execution_id % 2 = 0 THEN concat('evidence:', stage_execution_id) END AS evidence_reference
FROM stage_executions CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2) AS numbers WHERE a <= current_attempt""",
    "workflow_status": """
SELECT workflow_id, CASE stage_execution_id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'ENQUEUED' WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'ERROR' ELSE 'SUCCESS' END AS status,
       CASE WHEN stage_execution_id % 11 = 0 THEN ' ' WHEN stage_execution_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS app_version,
       CASE WHEN stage_execution_id % 13 = 0 THEN NULL WHEN stage_execution_id % 5 = 0 THEN 'worker-dead' ELSE concat('worker-', stage_execution_id % 3) END AS executor_id
FROM stage_attempts WHERE stage_execution_id % 17 <> 0""",
    "run_completion_executions": """
SELECT c_custkey + 1 AS run_completion_execution_id, concat('run-', c_custkey) AS run_key, CASE WHEN c_custkey % 20 = 11 THEN 2 ELSE 1 END AS current_attempt,
       CASE c_custkey % 30 WHEN 1 THEN 'enqueued' WHEN 11 THEN 'succeeded' ELSE 'failed' END AS state,
       CASE WHEN c_custkey % 30 = 11 THEN concat('aggregate:run-', c_custkey) END AS output_reference,
       CASE WHEN c_custkey % 30 = 21 THEN '{{"error_type":"builtins.ValueError","message":"broken"}}' END AS error_summary
FROM {customer} WHERE c_custkey % 10 = 1""",
    "run_completion_attempts": """
SELECT run_completion_execution_id * 10 + a AS run_completion_attempt_id, run_completion_execution_id, CAST(a AS INT) AS attempt_number,
       concat('wfr-', run_key, '-a', a) AS workflow_id, a < current_attempt OR state <> 'enqueued' AS terminal
FROM run_completion_executions CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 2) AS numbers WHERE a <= current_attempt""",
    "completion_status": """
SELECT workflow_id, CASE run_completion_execution_id % 8 WHEN 0 THEN 'ERROR' WHEN 2 THEN 'PENDING' WHEN 4 THEN 'PENDING' ELSE 'ENQUEUED' END AS status,
       CASE WHEN run_completion_execution_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS app_version, 'worker-0' AS executor_id
FROM run_completion_attempts""",
    "completion_outcomes": """
SELECT a.workflow_id, e.run_completion_execution_id % 4 <> 0 AS succeeded,
       CASE WHEN e.run_completion_execution_id % 4 <> 0 AND e.run_completion_execution_id % 7 <> 0 THEN concat('aggregate:', e.run_key) END AS output_reference,
       CASE WHEN e.run_completion_execution_id % 4 = 0 THEN '{{"error_type":"builtins.ValueError","message":"broken"}}' END AS error_summary
FROM run_completion_attempts AS a JOIN run_completion_executions AS e ON e.run_completion_execution_id = a.run_completion_execution_id
UNION ALL
SELECT concat(workflow_id, '-lost'), true, 'aggregate:lost', NULL FROM run_completion_attempts WHERE run_completion_execution_id % 40 = 2""",
    "members": """
SELECT m.run_key, w.campaign_key, m.member_ordinal, w.input_reference AS known_input,
       CASE WHEN o % 3 = 0 THEN concat(w.work_key, '-new') ELSE w.work_key END AS work_key,
       CASE WHEN o % 13 = 0 THEN concat('other:', o) ELSE w.input_reference END AS input_reference,
       CASE WHEN o % 7 = 0 THEN 9 ELSE w.priority END AS priority, w.segment, w.urgency
FROM (SELECT run_key, member_ordinal, work_item_id, work_item_id - 1 AS o FROM run_memberships) AS m JOIN work_items AS w ON w.work_item_id = m.work_item_id
JOIN {customer} ON m.run_key = concat('run-', c_custkey) WHERE c_custkey % 10 = 0""",
    "stage_outcomes": """
SELECT a.workflow_id, a.stage_execution_id % 5 <> 0 AS succeeded, CASE WHEN a.stage_execution_id % 19 = 0 THEN 'other' ELSE e.stage_key END AS expected_stage_key,
       CASE WHEN a.stage_execution_id % 5 <> 0 AND a.stage_execution_id % 23 <> 0 THEN concat('out:', a.stage_execution_id) END AS output_reference
FROM stage_attempts AS a JOIN stage_executions AS e ON e.stage_execution_id = a.stage_execution_id WHERE e.state IN ('admitted', 'cancelled')""",
    # the tables with all columns of the ledger; RANK_OF(campaign, work) is the rank in the words of each engine
    "full_runs": """
SELECT r.run_key, r.campaign_key, r.pipeline_key, r.pipeline_version, r.execution_config_reference, r.expected_member_count, r.manifest_reference,
       CASE WHEN r.manifest_reference IS NOT NULL THEN concat('digest:', r.run_key) END AS membership_digest, r.run_completion_key, r.created_at, r.registration_closed_at, r.registered_member_count,
       CASE WHEN r.registration_closed_at IS NOT NULL THEN CAST(coalesce(m.n, 0) AS INT) END AS created_work_count,
       CASE WHEN r.registration_closed_at IS NOT NULL THEN CAST(r.registered_member_count - coalesce(m.n, 0) AS INT) END AS reused_work_count, r.released_at,
       CASE WHEN r.released_at IS NOT NULL THEN 'frozen' END AS release_facts
FROM pipeline_runs AS r LEFT JOIN (SELECT origin_run_key, count(*) AS n FROM work_items GROUP BY origin_run_key) AS m ON m.origin_run_key = r.run_key""",
    "full_items": "SELECT w.*, RANK_OF(w.campaign_key, w.work_key) AS rank FROM work_items AS w",
    "full_executions": """
SELECT e.stage_execution_id, e.work_item_id, e.stage_key, e.stage_index, e.state, e.current_attempt, w.rank, w.priority, e.input_reference, e.output_reference, e.barrier,
       CAST(CAST('2026-07-01' AS DATE) + e.stage_index AS TIMESTAMP) AS created_at, CAST(CAST('2026-07-02' AS DATE) + e.stage_index AS TIMESTAMP) AS updated_at
FROM stage_executions AS e JOIN full_items AS w ON w.work_item_id = e.work_item_id""",
    "full_attempts": """
SELECT a.stage_attempt_id, a.stage_execution_id, a.attempt_number, a.workflow_id, a.terminal_summary, CASE WHEN e.state = 'succeeded' THEN e.output_reference END AS terminal_reference, a.evidence_reference,
       e.created_at, e.created_at AS admitted_at, CASE WHEN a.terminal_summary IS NOT NULL THEN e.updated_at END AS terminal_at
FROM stage_attempts AS a JOIN full_executions AS e ON e.stage_execution_id = a.stage_execution_id""",
    "full_completions": """
SELECT e.*, r.released_at AS enqueued_at, CASE WHEN e.state <> 'enqueued' THEN r.released_at END AS terminal_at FROM run_completion_executions AS e JOIN pipeline_runs AS r ON r.run_key = e.run_key""",
    "full_completion_attempts": """
SELECT a.run_completion_attempt_id, a.run_completion_execution_id, a.attempt_number, a.workflow_id, CASE WHEN a.terminal THEN '{{"outcome":"failed"}}' END AS terminal_summary,
       e.enqueued_at AS created_at, e.enqueued_at, CASE WHEN a.terminal THEN e.enqueued_at END AS terminal_at
FROM run_completion_attempts AS a JOIN full_completions AS e ON e.run_completion_execution_id = a.run_completion_execution_id""",
    "declared_stages": """
SELECT 'evaluation' AS pipeline_key, v AS pipeline_version, CAST(k AS INT) AS position, s AS stage_key, concat('queue-', s) AS queue_name, 'finalize' AS run_completion_key
FROM (VALUES (0, 'optim_step'), (1, 'eval_row'), (2, 'eval_fanin')) AS t(k, s) CROSS JOIN (VALUES (1), (2)) AS u(v)""",
    # inputs of whole passes, with some rows of every fault
    "run_declarations": """
SELECT CASE WHEN c_custkey % 4 = 0 THEN concat(r.run_key, '-new') ELSE r.run_key END AS run_key, r.campaign_key, r.pipeline_key,
       CASE WHEN c_custkey % 23 = 5 THEN 0 WHEN c_custkey % 7 = 3 THEN 3 - r.pipeline_version ELSE r.pipeline_version END AS pipeline_version, r.execution_config_reference,
       CASE WHEN c_custkey % 11 = 5 THEN -1 ELSE r.expected_member_count END AS expected_member_count, CASE WHEN c_custkey % 13 = 6 THEN NULL ELSE r.manifest_reference END AS manifest_reference,
       r.membership_digest, CASE WHEN c_custkey % 10 = 7 THEN 'finalize' WHEN c_custkey % 29 = 3 THEN 'bad key' ELSE r.run_completion_key END AS run_completion_key
FROM full_runs AS r JOIN {customer} ON r.run_key = concat('run-', c_custkey)
UNION ALL
SELECT r.run_key, 'campaign-twice', r.pipeline_key, r.pipeline_version, r.execution_config_reference, r.expected_member_count, r.manifest_reference, r.membership_digest, r.run_completion_key
FROM full_runs AS r JOIN {customer} ON r.run_key = concat('run-', c_custkey) WHERE c_custkey % 31 = 1""",
    "member_requests": """
SELECT m.run_key, m.campaign_key, CASE WHEN o % 53 = 1 THEN -1 ELSE m.member_ordinal END AS member_ordinal, CASE WHEN o % 53 = 2 THEN concat(m.work_key, '!') ELSE m.work_key END AS work_key,
       CASE WHEN o % 53 = 3 THEN '' ELSE m.input_reference END AS input_reference, CASE WHEN o % 53 = 4 THEN -5 ELSE m.priority END AS priority, m.segment, m.urgency
FROM (SELECT *, CAST(substr(known_input, 7) AS BIGINT) AS o FROM members) AS m
UNION ALL
SELECT m.run_key, m.campaign_key, m.member_ordinal + 100000, m.work_key, m.input_reference, m.priority, m.segment, m.urgency FROM (SELECT *, CAST(substr(known_input, 7) AS BIGINT) AS o FROM members) AS m WHERE o % 53 = 5
UNION ALL
SELECT m.run_key, m.campaign_key, m.member_ordinal, concat(m.work_key, '-again'), m.input_reference, m.priority, m.segment, m.urgency FROM (SELECT *, CAST(substr(known_input, 7) AS BIGINT) AS o FROM members) AS m WHERE o % 53 = 6""",
    "stored_memberships": """
SELECT run_key, CASE WHEN work_item_id % 41 = 0 THEN member_ordinal + 1 ELSE member_ordinal END AS member_ordinal, work_item_id FROM run_memberships WHERE work_item_id % 37 <> 0
UNION ALL SELECT run_key, member_ordinal, work_item_id FROM run_memberships WHERE work_item_id % 43 = 0""",
    "outcome_batch": """
SELECT o.workflow_id, o.succeeded, o.output_reference, CASE WHEN id % 47 = 0 OR (NOT o.succeeded AND id % 2 = 0) THEN concat('evidence:', id) END AS evidence_reference,
       CASE WHEN NOT o.succeeded THEN 'builtins.ValueError' END AS error_type, CASE WHEN NOT o.succeeded THEN 'broken' END AS message, id % 4 = 1 AS linear,
       CAST(CASE WHEN id % 43 = 0 THEN '2026-06-01' ELSE '2026-07-17' END AS TIMESTAMP) AS completed_at, 'evaluation' AS expected_pipeline_key,
       CASE WHEN id % 53 = 0 THEN 9 ELSE v END AS expected_pipeline_version, o.expected_stage_key, CASE WHEN id % 59 = 0 THEN i + 1 ELSE i END AS expected_stage_index
FROM (SELECT o.*, e.stage_execution_id AS id, e.stage_index AS i, r.pipeline_version AS v FROM stage_outcomes AS o JOIN stage_attempts AS a ON a.workflow_id = o.workflow_id
      JOIN stage_executions AS e ON e.stage_execution_id = a.stage_execution_id JOIN work_items AS w ON w.work_item_id = e.work_item_id JOIN pipeline_runs AS r ON r.run_key = w.origin_run_key) AS o
UNION ALL
SELECT concat(workflow_id, '-lost'), true, 'out:lost', NULL, NULL, NULL, false, CAST('2026-07-17' AS TIMESTAMP), 'evaluation', 1, 'eval_row', 1 FROM stage_attempts WHERE stage_execution_id % 61 = 0""",
    "successor_requests": """
SELECT a.workflow_id, CASE WHEN id % 29 = 0 THEN 'other' ELSE 'eval_row' END AS stage_key, CAST(CASE WHEN id % 31 = 0 THEN i WHEN id % 37 = 0 THEN i + 50 WHEN id % 41 = 0 THEN i + k ELSE i + 100 + k END AS INT) AS stage_index,
       CASE WHEN id % 3 = 0 THEN NULL ELSE concat('next:', id) END AS input_reference, k = 2 AS barrier
FROM (SELECT a.workflow_id, e.stage_execution_id AS id, e.stage_index AS i FROM stage_attempts AS a JOIN stage_executions AS e ON e.stage_execution_id = a.stage_execution_id
      WHERE e.state = 'admitted' AND e.stage_execution_id % 4 = 0) AS a CROSS JOIN (VALUES (1), (2)) AS t(k)""",
    "stage_controls": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, 'evaluation', {v}, '{s}', {k}, {w}, {c}, {p})" for i, v, s, k, w, c, p in (
        (1, 1, "optim_step", "NULL", "NULL", 100000, "false"), (2, 1, "eval_row", "NULL", "NULL", 1000000, "false"), (3, 1, "eval_row", "'segment'", "'BUILDING'", 100000, "false"),
        (4, 1, "eval_row", "'priority'", "'1-URGENT'", 100000, "false"), (5, 1, "eval_row", "'segment'", "'MACHINERY'", 10, "true"), (6, 1, "eval_fanin", "NULL", "NULL", 100000, "false"),
        (7, 2, "eval_row", "NULL", "NULL", 5, "false"), (8, 2, "eval_fanin", "'segment'", "'FURNITURE'", 100, "false"), (9, 2, "optim_step", "NULL", "NULL", 100000, "true"),
    ))
    + ") AS t(stage_control_id, pipeline_key, pipeline_version, stage_key, label_key, label_value, capacity, paused)",
}


# The rank of an item, in the words of each engine.
_RANK_JSON = """concat('{"campaign_key":"', \\1, '","work_key":"', \\2, '"}')"""
_RANK = {
    "spark": f"CAST(CAST(conv(substr(sha2({_RANK_JSON}, 256), 1, 16), 16, 10) AS DECIMAL(20,0)) % 9223372036854775807 + 1 AS BIGINT)",
    "duckdb": f"CAST(CAST(concat('0x', substr(sha256({_RANK_JSON}), 1, 16)) AS UBIGINT) % 9223372036854775807 + 1 AS BIGINT)",
}


def _ranked(sql: str, engine: str, braces: bool = False) -> str:
    """Put the engine's expression for RANK_OF; ``braces`` doubles its own braces for a later format()."""
    rank = _RANK[engine].replace("{", "{{").replace("}", "}}") if braces else _RANK[engine]
    return re.sub(r"RANK_OF\((\S+), (\S+)\)", rank, sql)


def oracle_tables() -> dict[str, str]:
    """Each ledger table's SQL for the oracle, worked out once however often a query names it."""
    names = {s: s for s in SOURCES}
    return {name: f"{name} AS MATERIALIZED ({_ranked(sql.format(**names), 'duckdb')})" for name, sql in TABLES.items()}


#: Where the tables of a session and folder were written, and the schemas of all that was read: each is looked up once.
_WRITTEN: dict[tuple[str, str, str], str] = {}
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def _read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table under the schema that it is known to have; only what is read for the first time is asked for it."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = schema or spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


class Ledger:
    """The ledger tables of a folder; labels are maps as the operators want them.

    A table is derived when it is first asked for and written to the shared folder; later queries of the session scan it there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.built: dict[str, DataFrame] = {s: _read(spark, f"{sf_dir}/{s}.parquet") for s in SOURCES}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.built:
            return self.built[name]
        if name not in TABLES:
            raise AttributeError(name)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        df = None
        if key in _WRITTEN:
            try:
                df = _read(self.spark, _WRITTEN[key])
            except AnalysisException:  # the folder was cleared
                pass
        if df is None:
            path = shared_dir(self.spark, f"ledger-{name}")
            derived = self._derive(name)
            derived.write.parquet(path, compression="zstd")
            df, _WRITTEN[key] = _read(self.spark, path, derived.schema), path
        self.built[name] = df
        return df

    def path(self, name: str) -> str:
        """The folder of a table that was written."""
        getattr(self, name)
        return _WRITTEN[self.spark.sparkContext.applicationId, self.sf_dir, name]

    def derived(self, name: str, **given: DataFrame) -> DataFrame:
        """A table as it follows from few rows of others, not written."""
        return self._derive(name, given)

    def _joined(self, name: str) -> DataFrame:
        """A table for the joins of another one: a ledger table of many rows is not taken for as small as its files are."""
        df = getattr(self, name)
        return apart(df) if name in TABLES and not few(df) else df

    def _derive(self, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
        earlier = "|".join(TABLES)
        sql = re.sub(rf"\b(FROM|JOIN) ({earlier})\b", r"\1 {\2}", _ranked(TABLES[name], "spark", braces=True))
        df = self.spark.sql(sql, **{t: given[t] if given and t in given else self._joined(t) for t in set(re.findall(r"(?<!\{)\{(\w+)\}", sql))})
        if name in ("work_items", "members", "full_items", "member_requests"):
            df = df.withColumn("labels", F.create_map(F.lit("segment"), "segment", F.lit("priority"), "urgency"))
        if name == "stage_controls":
            df = df.withColumn("selector", F.when(F.col("label_key").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map("label_key", "label_value")))
        return df
