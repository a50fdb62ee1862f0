"""Derived status and counts that are kept up to date from changes, instead of being worked out over all stages again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from ..sources.snapshots import Change, Version
from .status import work_item_status

#: Tables of the view beside ``stages``, ``items`` and ``members``, which lie in buckets by item.
STATUS, BY_CAMPAIGN, BY_RUN = "status", "campaign_counts", "run_counts"
_SHOWN = ("work_item_id", "stage_execution_id", "stage_key", "stage_index", "state")


def summed(scope: str):
    """Merges a log of changes of counts."""
    return lambda log: log.groupBy(scope, "state").agg(F.sum("n").alias("n"))


def build(change: Change, executions: DataFrame, items: DataFrame | None = None, memberships: DataFrame | None = None, buckets: int = 64) -> None:
    """Put stages, items and memberships into a store in buckets by item, with the status of every item and the counts over it.

    Without items no counts by campaign are kept, without memberships none by run.
    """
    change.create("stages", executions, ["work_item_id"], buckets)
    if items is not None:
        change.create("items", items.select("work_item_id", "campaign_key"), ["work_item_id"], buckets)
    if memberships is not None:
        change.create("members", memberships.select("work_item_id", "run_key"), ["work_item_id"], buckets)
    change.create(STATUS, work_item_status(change.now().read("stages")).select(*_SHOWN), ["work_item_id"], buckets)
    none = change.now().read(STATUS, []).select("work_item_id", "state")
    _count(change, none, change.now().read(STATUS).select("work_item_id", "state"), None, buckets, level=12)


def _count(change: Change, old: DataFrame, new: DataFrame, touched: list[int] | None, buckets: int, level: int = 0) -> None:
    """Add to the logs what items that changed from ``old`` to ``new`` state change in the counts."""
    moved = old.withColumn("n", F.lit(-1).cast("long")).unionByName(new.withColumn("n", F.lit(1).cast("long")))
    moved = materialize(moved.groupBy("work_item_id", "state").agg(F.sum("n").alias("n")).where("n <> 0"), "moved-states")
    for scope, table, log in (("campaign_key", "items", BY_CAMPAIGN), ("run_key", "members", BY_RUN)):
        if table not in change.tables:
            continue
        known = change.now().read(table, touched).select("work_item_id", scope)
        rows = moved.join(known, "work_item_id").groupBy(scope, "state").agg(F.sum("n").alias("n")).where("n <> 0")
        change.append(log, rows, [scope, "state"], buckets, summed(scope), level=level)


def update_stages(change: Change, updates: DataFrame, inserts: DataFrame | None = None, guard: str | list[str] | None = None) -> list[int]:
    """Change stages (by stage_execution_id; rows carry their work_item_id) and with them the status and counts of their items.

    Only the buckets of the items concerned are read, of stages, items, memberships and status alike. Returns these buckets.
    """
    touched = change.update("stages", updates, inserts, guard, key="stage_execution_id")
    if touched:
        now = change.now()
        items = updates.select("work_item_id")
        items = materialize((items if inserts is None else items.unionByName(inserts.select("work_item_id"))).distinct(), "changed-items")
        status = work_item_status(now.read("stages", touched).join(items, "work_item_id", "left_semi")).select(*_SHOWN)
        new = materialize(status, "new-status")
        old = materialize(now.read(STATUS, touched).join(items, "work_item_id", "left_semi").select("work_item_id", "state"), "old-status")
        change.update(STATUS, new, new)
        _count(change, old, new.select("work_item_id", "state"), touched, now.tables["stages"].buckets)
    return touched


def campaign_counts(version: Version) -> DataFrame:
    """``campaign_key, state, n`` as ``campaign_state_counts`` gives them, from the log of counts alone."""
    return summed("campaign_key")(version.read(BY_CAMPAIGN)).where("n <> 0")


def run_counts(version: Version) -> DataFrame:
    """``run_key, state, n`` as ``run_state_counts`` gives them."""
    return summed("run_key")(version.read(BY_RUN)).where("n <> 0")
