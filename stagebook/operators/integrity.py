"""Integrity of the whole ledger: checks, unique keys and foreign keys of its tables, and facts that may not change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import apart, parts
from ..sources.snapshots import Version, changed_buckets
from .changes import violations

# Keys of tables, rules that must not be false, unique keys and foreign keys.
KEYS = {
    "pipeline_runs": "run_key", "work_items": "work_item_id", "run_memberships": "concat(run_key, '#', member_ordinal)", "stage_executions": "stage_execution_id", "stage_attempts": "stage_attempt_id",
    "stage_controls": "stage_control_id", "run_completion_executions": "run_completion_execution_id", "run_completion_attempts": "run_completion_attempt_id",
    "run_barrier_cursor": "singleton",
}
_TIMES = lambda begin: {f"{begin}_in_time": f"{begin}_at IS NULL OR {begin}_at >= created_at", "terminal_in_time": "terminal_at IS NULL OR terminal_at >= created_at", "times_in_order": f"{begin}_at IS NULL OR terminal_at IS NULL OR terminal_at >= {begin}_at"}
CHECKS = {
    "pipeline_runs": {
        "version": "pipeline_version > 0", "member_count": "expected_member_count >= 0", "manifest_binding": "(manifest_reference IS NULL) = (membership_digest IS NULL)",
        "completion_manifest": "run_completion_key IS NULL OR manifest_reference IS NOT NULL", "registration_time": "registration_closed_at IS NULL OR registration_closed_at >= created_at",
        "registration_count": "(registration_closed_at IS NULL) = (registered_member_count IS NULL)",
        "receipt_presence": "(registration_closed_at IS NULL) = (created_work_count IS NULL) AND (registration_closed_at IS NULL) = (reused_work_count IS NULL)",
        "receipt_counts": "registration_closed_at IS NULL OR (registered_member_count = expected_member_count AND created_work_count >= 0 AND reused_work_count >= 0 AND created_work_count + reused_work_count = registered_member_count)",
        "release_time": "released_at IS NULL OR (registration_closed_at IS NOT NULL AND released_at >= registration_closed_at)", "release_counts": "(released_at IS NULL) = (release_facts IS NULL)",
    },
    "work_items": {"rank": "rank > 0", "priority": "priority >= 0 AND priority <= 2147483647"},
    "run_memberships": {"ordinal": "member_ordinal >= 0"},
    "stage_executions": {
        "index": "stage_index >= 0", "state": "state IN ('ready', 'admitted', 'succeeded', 'failed', 'cancelled')", "current_attempt": "current_attempt >= 0", "rank": "rank > 0",
        "priority": "priority >= 0 AND priority <= 2147483647", "updated_time": "updated_at >= created_at",
    },
    "stage_attempts": {"number": "attempt_number > 0", "summary_object": "terminal_summary IS NULL OR terminal_summary LIKE '{%}'", **_TIMES("admitted")},
    "stage_controls": {"version": "pipeline_version > 0", "capacity": "capacity >= 0"},
    "run_completion_executions": {
        "state": "state IN ('enqueued', 'succeeded', 'failed')", "attempt": "current_attempt > 0", "terminal_time": "terminal_at IS NULL OR terminal_at >= enqueued_at",
        "outcome": "(state = 'enqueued' AND terminal_at IS NULL AND output_reference IS NULL AND error_summary IS NULL) OR (state = 'succeeded' AND terminal_at IS NOT NULL AND output_reference IS NOT NULL AND error_summary IS NULL) OR (state = 'failed' AND terminal_at IS NOT NULL AND output_reference IS NULL AND error_summary IS NOT NULL)",
    },
    "run_completion_attempts": {"number": "attempt_number > 0", "summary_object": "terminal_summary IS NULL OR terminal_summary LIKE '{%}'", **_TIMES("enqueued")},
    "run_barrier_cursor": {"singleton": "singleton"},
}
UNIQUE = (
    ("pipeline_runs", ("run_key",)), ("work_items", ("work_item_id",)), ("work_items", ("campaign_key", "work_key")), ("run_memberships", ("run_key", "member_ordinal")), ("run_memberships", ("run_key", "work_item_id")),
    ("stage_executions", ("stage_execution_id",)), ("stage_executions", ("work_item_id", "stage_index")), ("stage_attempts", ("stage_attempt_id",)), ("stage_attempts", ("stage_execution_id", "attempt_number")),
    ("stage_attempts", ("workflow_id",)), ("stage_controls", ("pipeline_key", "pipeline_version", "stage_key", "selector_key")), ("run_completion_executions", ("run_key",)),
    ("run_completion_attempts", ("run_completion_execution_id", "attempt_number")), ("run_completion_attempts", ("workflow_id",)), ("run_barrier_cursor", ("singleton",)),
)
FOREIGN = (
    ("work_items", ("origin_run_key",), "pipeline_runs", ("run_key",)), ("run_memberships", ("run_key",), "pipeline_runs", ("run_key",)), ("run_memberships", ("work_item_id",), "work_items", ("work_item_id",)),
    ("stage_executions", ("work_item_id", "rank"), "work_items", ("work_item_id", "rank")), ("stage_attempts", ("stage_execution_id",), "stage_executions", ("stage_execution_id",)),
    ("run_completion_executions", ("run_key",), "pipeline_runs", ("run_key",)), ("run_completion_attempts", ("run_completion_execution_id",), "run_completion_executions", ("run_completion_execution_id",)),
)
FROZEN = {
    "provenance": ("campaign_key", "pipeline_key", "pipeline_version", "execution_config_reference", "expected_member_count", "manifest_reference", "membership_digest", "run_completion_key", "created_at"),
    "closure": ("registration_closed_at", "registered_member_count", "created_work_count", "reused_work_count"),
    "release": ("released_at", "release_facts"),
}


def _text(keys: tuple[str, ...]) -> Column:
    return F.concat_ws("#", *[F.col(k).cast("string") for k in keys])


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rule, key`` of every broken rule, one scan of each table."""
    found = [violations(df.withColumn("_key", F.expr(KEYS[name]).cast("string")), "_key", CHECKS[name]).select(F.lit(name).alias("table"), "rule", "key") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, found)


def unique_all(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, columns, key, n`` of every key that several rows have; rows with a null in a key do not repeat."""
    found = []
    for name, keys in UNIQUE:
        rows = tables[name].dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        found.append(rows.select(F.lit(name).alias("table"), F.lit(", ".join(keys)).alias("columns"), _text(keys).alias("key"), "n"))
    return reduce(DataFrame.unionByName, found)


def foreign_all(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, columns, key, n`` of references that lead nowhere, with the number of rows; a null refers to nothing."""
    found = []
    for child, keys, parent, at in FOREIGN:
        n = parts(tables[child].sparkSession, tables[child], tables[parent])
        rows = tables[child].dropna(subset=list(keys)).select(*keys).repartition(n, *keys)
        there = tables[parent].select(*[F.col(p).alias(k) for p, k in zip(at, keys, strict=True)]).repartition(n, *keys)
        # only what leads nowhere is counted
        rows = rows.join(apart(there), list(keys), "left_anti").groupBy(*keys).agg(F.count("*").alias("n"))
        found.append(rows.select(F.lit(child).alias("table"), F.lit(", ".join(keys)).alias("columns"), _text(keys).alias("key"), "n"))
    return reduce(DataFrame.unionByName, found)


def changed_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """``run_key, fact``: runs whose provenance changed, whose closure changed after they were closed, whose release changed after they were released, or that are gone."""
    names = [c for group in FROZEN.values() for c in group]
    both = old.select("run_key", *[F.col(c).alias(f"old_{c}") for c in names]).join(new.select("run_key", *names, F.lit(True).alias("there")), "run_key", "left")
    differs = lambda group: reduce(Column.__or__, [~F.col(f"old_{c}").eqNullSafe(F.col(c)) for c in FROZEN[group]])
    gone = F.col("there").isNull()
    facts = F.array(
        F.when(gone, "gone"), F.when(~gone & differs("provenance"), "provenance"), F.when(~gone & F.col("old_registration_closed_at").isNotNull() & differs("closure"), "closure"),
        F.when(~gone & F.col("old_released_at").isNotNull() & differs("release"), "release"),
    )
    return both.select("run_key", F.explode(F.filter(facts, lambda f: f.isNotNull())).alias("fact"))


def changed_facts_between(old: Version, new: Version, name: str = "pipeline_runs") -> DataFrame:
    """``changed_facts`` between two versions of the runs; only buckets whose digests differ are read."""
    differ = changed_buckets(old, new, name)
    return changed_facts(old.read(name, differ), new.read(name, differ))


def frozen_members_between(old: Version, new: Version, memberships: str = "run_memberships", runs: str = "pipeline_runs") -> DataFrame:
    """``run_key, member_ordinal, work_item_id, change`` (removed or added) of runs that were closed in the old version.

    Only membership buckets whose digests differ are read, and one join compares them; repeated rows count.
    """
    key, differ = ["run_key", "member_ordinal", "work_item_id"], changed_buckets(old, new, memberships)
    tally = lambda v, name: v.read(memberships, differ).groupBy(*key).agg(F.count("*").alias(name))
    both = tally(old, "before").join(tally(new, "after"), key, "full")
    before, after = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    moved = both.where(before != after).select(*key, F.when(before > after, "removed").otherwise("added").alias("change"))
    closed = old.read(runs).where("registration_closed_at IS NOT NULL").select("run_key")
    return moved.join(closed, "run_key", "left_semi")
