"""Explicit schemas of the ledger's tables and of what readers return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Tables and columns of the ledger.
TABLES = {
    "pipeline_runs": """run_key string, campaign_key string, pipeline_key string, pipeline_version int, execution_config_reference string, expected_member_count int,
        manifest_reference string, membership_digest string, run_completion_key string, created_at timestamp, registration_closed_at timestamp, registered_member_count int,
        created_work_count int, reused_work_count int, released_at timestamp, release_terminal_state_counts array<struct<state:string,count:int>>""",
    "run_barrier_cursor": "singleton boolean, last_run_key string",
    "work_items": "work_item_id bigint, campaign_key string, work_key string, origin_run_key string, input_reference string, labels map<string,string>, rank bigint, priority int",
    "run_memberships": "run_key string, member_ordinal int, work_item_id bigint",
    "stage_executions": """stage_execution_id bigint, work_item_id bigint, stage_key string, stage_index int, state string, current_attempt int, rank bigint, priority int,
        input_reference string, output_reference string, barrier boolean, created_at timestamp, updated_at timestamp""",
    "stage_attempts": """stage_attempt_id bigint, stage_execution_id bigint, attempt_number int, workflow_id string, terminal_summary string, terminal_reference string,
        evidence_reference string, created_at timestamp, admitted_at timestamp, terminal_at timestamp""",
    "stage_controls": "stage_control_id bigint, pipeline_key string, pipeline_version int, stage_key string, selector map<string,string>, capacity int, paused boolean, updated_at timestamp",
    "run_completion_executions": """run_completion_execution_id bigint, run_key string, current_attempt int, state string, enqueued_at timestamp, output_reference string,
        error_summary string, terminal_at timestamp""",
    "run_completion_attempts": """run_completion_attempt_id bigint, run_completion_execution_id bigint, attempt_number int, workflow_id string, terminal_summary string,
        terminal_reference string, created_at timestamp, enqueued_at timestamp, terminal_at timestamp""",
    "workflow_status": "workflow_id string, status string, error string, app_version string, executor_id string",
}

# Columns that readers return.
READERS = {
    "campaign_summary": "campaign_key string, created_at timestamp, run_count bigint, work_item_count bigint",
    "work_item": """work_item_id bigint, campaign_key string, work_key string, origin_run_key string, labels map<string,string>, current_stage_execution_id bigint,
        current_stage_key string, current_stage_index int, state string""",
    "run": """run_key string, campaign_key string, pipeline_key string, pipeline_version int, execution_config_reference string, expected_member_count int,
        manifest_reference string, membership_digest string, created_at timestamp, registration_closed_at timestamp, registered_member_count int, released_at timestamp""",
    "run_member": """member_ordinal int, work_key string, work_item_id bigint, input_reference string, current_stage_key string, current_stage_index int, state string,
        stage_execution_id bigint, terminal_summary string, evidence_reference string""",
    "stage_execution": TABLES["stage_executions"],
    "stage_attempt": TABLES["stage_attempts"],
    "predecessor_output": "stage_index int, stage_key string, input_reference string, output_reference string",
    "bulk_status": "work_key string, present boolean, work_item_id bigint, current_stage_key string, current_stage_index int, state string",
    "control": "stage_control_id bigint, pipeline_key string, pipeline_version int, stage_key string, selector map<string,string>, capacity int, paused boolean, updated_at timestamp",
    "receipt": "run_key string, membership_digest string, registered_count int, created_count int, reused_count int, registration_closed_at timestamp",
}


def schema_of(columns: str) -> StructType:
    return StructType.fromDDL(columns)


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A ledger table from Parquet under its own schema; nothing is inferred."""
    return spark.read.schema(schema_of(TABLES[name])).parquet(path)


def read_table_jdbc(spark: SparkSession, name: str, url: str, table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A ledger table from a database, read in ranges of ``key`` (low, high, number of ranges) by as many tasks.

    Filters on its columns are pushed to the database; columns that it does not have are null.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        low, high, n = bounds
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
    return conform(reader.load(), TABLES[name])


def conform(rows: DataFrame, columns: str) -> DataFrame:
    """The named columns in order and type; columns that are not there are null.

    A column that has its type is left as it is: even a cast of text to text, which a database's VARCHAR gets, keeps filters
    from being pushed to the source.
    """
    have = {f.name: f.dataType for f in rows.schema.fields}
    typed = lambda f: F.col(f.name) if have.get(f.name) == f.dataType else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
    return rows.select(*[typed(f).alias(f.name) for f in schema_of(columns).fields])
