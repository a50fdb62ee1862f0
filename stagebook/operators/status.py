"""Derived status of work items, counts over it, and readers with keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import index_order, precedence
from ..sources.pages import Ordered
from ..sources.shared import apart, few


def work_item_status(executions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The execution that stands for each item, with the columns to ``carry``: one row per item. Partial aggregates are shuffled, not rows."""
    row = F.struct("stage_execution_id", "stage_key", "stage_index", "state", *carry)
    order = F.struct(precedence("state"), index_order("state", "stage_index"), F.col("stage_execution_id"))
    return executions.groupBy("work_item_id").agg(F.min_by(row, order).alias("s")).select("work_item_id", "s.*")


def campaign_state_counts(items: DataFrame, executions: DataFrame) -> DataFrame:
    status = work_item_status(executions.select("work_item_id", "stage_execution_id", "stage_key", "stage_index", "state"))
    return items.select("work_item_id", "campaign_key").join(status, "work_item_id").groupBy("campaign_key", "state").agg(F.count("*").alias("n"))


def run_state_counts(memberships: DataFrame, executions: DataFrame) -> DataFrame:
    """Status once per item, fanned out by membership afterwards."""
    return memberships.select("run_key", "work_item_id").join(work_item_status(executions), "work_item_id").groupBy("run_key", "state").agg(F.count("*").alias("n"))


def bulk_run_state_counts(keys: DataFrame, runs: DataFrame, memberships: DataFrame, executions: DataFrame) -> DataFrame:
    """For requested runs: ``present``, and a row per state; a present run without members has one row with a null state."""
    wanted = keys.select("run_key").dropDuplicates()
    members = memberships.join(wanted, "run_key", "left_semi")
    scoped = executions.join(members.select("work_item_id"), "work_item_id", "left_semi")
    counts = run_state_counts(members, scoped)
    present = runs.select("run_key", F.lit(True).alias("present"))
    return wanted.join(present, "run_key", "left").join(counts, "run_key", "left").select("run_key", F.coalesce("present", F.lit(False)).alias("present"), "state", F.coalesce("n", F.lit(0)).alias("n"))


def _requested(keys: DataFrame, items: DataFrame, executions: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The distinct requested (campaign, work), and the items among them with their status. Few keys go to the tables; many meet them
    in shuffles, and the join by item leaves out the status of others."""
    asked = ["campaign_key", "work_key"]
    some, wanted = few(keys), keys.select(*asked).dropDuplicates()
    known = items.select(*asked, "work_item_id").join(F.broadcast(wanted) if some else apart(wanted), asked, "left_semi")
    if some and few(known):
        executions = executions.join(F.broadcast(known.select("work_item_id")), "work_item_id", "left_semi")
    return wanted, apart(known).join(work_item_status(executions, carry), "work_item_id")


def bulk_work_statuses(keys: DataFrame, items: DataFrame, executions: DataFrame) -> DataFrame:
    """One row per requested (campaign, work); an item without executions counts as absent."""
    wanted, found = _requested(keys, items, executions)
    return wanted.join(apart(found), ["campaign_key", "work_key"], "left").select("campaign_key", "work_key", F.col("work_item_id").isNotNull().alias("present"), "work_item_id", F.col("stage_key").alias("current_stage_key"), F.col("stage_index").alias("current_stage_index"), "state")


def with_current_attempt(rows: DataFrame, executions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Add the current attempt's summary and evidence to rows with a stage_execution_id (left join); rows may carry its number."""
    if "current_attempt" not in rows.columns:
        rows = rows.join(executions.select("stage_execution_id", "current_attempt"), "stage_execution_id", "left")
    current = attempts.select("stage_execution_id", F.col("attempt_number").alias("current_attempt"), "terminal_summary", "evidence_reference")
    return rows.join(apart(current), ["stage_execution_id", "current_attempt"], "left").drop("current_attempt")


def bulk_terminal_statuses(keys: DataFrame, items: DataFrame, executions: DataFrame, attempts: DataFrame, condition: Column | None = None) -> DataFrame:
    """As ``bulk_work_statuses`` with the current attempt; with a condition, present rows that miss it are left out."""
    wanted, found = _requested(keys, items, executions, ("current_attempt",))
    found = with_current_attempt(found, executions, attempts)
    out = wanted.join(apart(found), ["campaign_key", "work_key"], "left").withColumn("present", F.col("work_item_id").isNotNull())
    out = out if condition is None else out.where(~F.col("present") | condition)
    return out.select("campaign_key", "work_key", "present", "work_item_id", "stage_execution_id", "stage_key", "stage_index", "state", "terminal_summary", "evidence_reference")


def campaign_summaries(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Both sides are aggregated before they join."""
    by_runs = runs.groupBy("campaign_key").agg(F.min("created_at").alias("created_at"), F.count("*").alias("run_count"))
    by_items = items.groupBy("campaign_key").agg(F.count("*").alias("work_item_count"))
    return by_runs.join(by_items, "campaign_key", "left").select("campaign_key", "created_at", "run_count", F.coalesce("work_item_count", F.lit(0)).alias("work_item_count"))


def page(rows: DataFrame, keys: list[str], cursor: list | None, limit: int) -> DataFrame:
    """A keyset page: rows after the cursor in key order, at most ``limit`` (the page size is the feature)."""
    if cursor is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, cursor, strict=True)]))
    return rows.orderBy(*keys).limit(limit)


def list_runs(runs: DataFrame, memberships: DataFrame, campaign: str, cursor: list | None, limit: int) -> DataFrame:
    """The page first, then the members of its runs: a closed run has its stored count."""
    rows = page(runs.where(F.col("campaign_key") == campaign), ["created_at", "run_key"], cursor, limit)
    counts = memberships.join(F.broadcast(rows.select("run_key")), "run_key", "left_semi").groupBy("run_key").agg(F.count("*").alias("live"))
    count = F.when(F.col("registration_closed_at").isNotNull(), F.col("registered_member_count")).otherwise(F.coalesce("live", F.lit(0))).cast("long")
    return rows.join(counts, "run_key", "left").withColumn("member_count", count).drop("live")


def list_work_items(items: DataFrame, executions: DataFrame, campaign: str, state: str | None, cursor: int | None, limit: int) -> DataFrame:
    scoped = items.where(F.col("campaign_key") == campaign)
    scoped = scoped if cursor is None else scoped.where(F.col("work_item_id") > cursor)
    status = work_item_status(executions.join(scoped.select("work_item_id"), "work_item_id", "left_semi"))
    rows = scoped.join(status, "work_item_id")
    rows = rows if state is None else rows.where(F.col("state") == state)
    return rows.orderBy("work_item_id").limit(limit)


def runs_page(runs: Ordered, memberships: Ordered, campaign: str, cursor: list | None, limit: int) -> DataFrame:
    """``list_runs`` over tables in key order: runs by (campaign_key, created_at, run_key), memberships by (run_key, member_ordinal).

    Files of runs behind the cursor are opened, and those of memberships that hold open runs of the page.
    """
    rows = runs.page([campaign], cursor, limit)
    found = rows.collect()  # a page
    live = [r["run_key"] for r in found if r["registration_closed_at"] is None]
    counts = memberships.of_keys(live).groupBy("run_key").agg(F.count("*").alias("live"))
    count = F.when(F.col("registration_closed_at").isNotNull(), F.col("registered_member_count")).otherwise(F.coalesce("live", F.lit(0))).cast("long")
    page = runs.spark.createDataFrame(found, runs.schema)
    return page.join(F.broadcast(counts), "run_key", "left").withColumn("member_count", count).drop("live")


def work_items_page(items: Ordered, executions: Ordered, campaign: str, cursor: list | None, limit: int) -> DataFrame:
    """Items of a campaign in order of id with their status: items lie by (campaign_key, work_item_id), stages by work_item_id.

    Only items that have a stage are shown, so the page is filled from as many further pages of items as that takes.
    """
    shown = None
    while True:
        found = items.page([campaign], cursor, limit).collect()
        ids = [r["work_item_id"] for r in found]
        page = items.spark.createDataFrame(found, items.schema).join(work_item_status(executions.of_keys(ids)), "work_item_id")
        shown = page if shown is None else shown.unionByName(page)
        if len(found) < limit or shown.count() >= limit:
            return shown.orderBy("work_item_id").limit(limit)
        cursor = [ids[-1]]


def run_members_page(memberships: Ordered, items: Ordered, executions: Ordered, run: str, cursor: list | None, limit: int) -> DataFrame:
    """Members of a run by ordinal, after the cursor: memberships lie by (run_key, member_ordinal), items and stages by work_item_id."""
    found = memberships.page([run], cursor, limit).collect()  # a page
    ids = [r["work_item_id"] for r in found]
    page = memberships.spark.createDataFrame(found, memberships.schema)
    named = page.join(items.of_keys(ids).select("work_item_id", "work_key", "input_reference"), "work_item_id")
    return named.join(work_item_status(executions.of_keys(ids)), "work_item_id", "left").orderBy("member_ordinal")


def run_members(memberships: DataFrame, items: DataFrame, executions: DataFrame, run: str) -> DataFrame:
    members = memberships.where(F.col("run_key") == run)
    scoped = executions.join(members.select("work_item_id"), "work_item_id", "left_semi")
    return members.join(items.select("work_item_id", "work_key", "input_reference"), "work_item_id").join(work_item_status(scoped), "work_item_id", "left")


def stage_history(executions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Executions with their attempts in order, as an array (a handful for each)."""
    history = attempts.groupBy("stage_execution_id").agg(F.sort_array(F.collect_list(F.struct("attempt_number", "workflow_id", "terminal_summary"))).alias("attempts"))
    return executions.join(history, "stage_execution_id", "left")


def filter_executions(executions: DataFrame, stage_key: str | None = None, above: int | None = None, below: int | None = None, state: str | None = None) -> DataFrame:
    """Conditions are joined by and; index bounds are exclusive and must leave room between them."""
    if above is not None and below is not None and above >= below:
        raise ValueError("the index range is empty")
    for given, cond in ((stage_key, F.col("stage_key") == stage_key), (above, F.col("stage_index") > above), (below, F.col("stage_index") < below), (state, F.col("state") == state)):
        executions = executions.where(cond) if given is not None else executions
    return executions


def predecessor_outputs(wanted: DataFrame, executions: DataFrame) -> DataFrame:
    """For rows (work_item_id, above, below): succeeded stages with an output, strictly between the bounds (a null bound is open)."""
    done = executions.where("state = 'succeeded' AND output_reference IS NOT NULL").select("work_item_id", "stage_index", "stage_key", "input_reference", "output_reference")
    inside = (F.col("above").isNull() | (F.col("stage_index") > F.col("above"))) & (F.col("stage_index") < F.col("below"))
    return wanted.join(done, "work_item_id").where(inside)


def barrier_gate(executions: DataFrame) -> DataFrame:
    """``blocked``: a lower stage of the item has not succeeded. One shuffle by item, no self join."""
    lower = Window.partitionBy("work_item_id").orderBy("stage_index").rowsBetween(Window.unboundedPreceding, -1)
    return executions.withColumn("blocked", F.coalesce(F.max(F.col("state") != "succeeded").over(lower), F.lit(False)))


def barrier_clusters(executions: DataFrame, optim: str = "optim_step", evaluated: str = "eval_row") -> DataFrame:
    """Every barrier stage with the latest ``optim`` stage below it and how many lie between; ``problem`` says what is wrong.

    Problems in this order: no_optim, foreign_key (another stage key between), gap (indexes are not contiguous). Running counts
    over one ordering of each item give all of it, in one shuffle.
    """
    w = Window.partitionBy("work_item_id").orderBy("stage_index")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    is_optim = F.col("stage_key") == optim
    counted = executions.select("work_item_id", "stage_execution_id", "stage_index", "stage_key", "barrier").withColumn("place", F.row_number().over(w)).withColumn("evaluated", F.count_if(F.col("stage_key") == evaluated).over(below))
    last = lambda c: F.last(F.when(is_optim, F.col(c)), ignorenulls=True).over(below)
    marked = counted.withColumn("optim_index", last("stage_index")).withColumn("optim_place", last("place")).withColumn("optim_evaluated", last("evaluated"))
    between = F.when(F.col("optim_index").isNull(), F.lit(0)).otherwise(F.col("place") - F.col("optim_place") - 1).cast("long")
    found = marked.where("barrier").withColumn("eval_count", between).withColumn("foreign_count", F.col("eval_count") - (F.col("evaluated") - F.col("optim_evaluated")))
    problem = F.when(F.col("optim_index").isNull(), "no_optim").when(F.col("foreign_count") > 0, "foreign_key").when(F.col("eval_count") != F.col("stage_index") - F.col("optim_index") - 1, "gap")
    return found.select("work_item_id", F.col("stage_execution_id").alias("fanin_id"), F.col("stage_index").alias("fanin_index"), "optim_index", "eval_count", problem.alias("problem"))


def resolve_clusters(wanted: DataFrame, executions: DataFrame, optim: str = "optim_step", evaluated: str = "eval_row") -> DataFrame:
    """For rows (work_item_id, fanin_index): the ``optim`` stage, the stages to evaluate in order (``eval_rows``) and the fan-in, or the ``problem``.

    Problems in this order: no_row (nothing at the index), not_barrier, no_optim, foreign_key, gap. The two keys must differ.
    """
    if optim == evaluated:
        raise ValueError("the optimisation step and the rows to evaluate need different stage keys")
    stages = executions.select("work_item_id", "stage_index", "stage_execution_id", "stage_key", "barrier")
    rows = wanted.select("work_item_id", "fanin_index").dropDuplicates().join(stages, "work_item_id", "left").where("stage_index IS NULL OR stage_index <= fanin_index")
    at = F.col("stage_index") == F.col("fanin_index")
    lower = F.col("stage_index") < F.col("fanin_index")
    found = rows.groupBy("work_item_id", "fanin_index").agg(
        F.max(F.when(at, F.col("stage_execution_id"))).alias("fanin_id"), F.max(F.when(at, F.col("barrier"))).alias("waits"), F.max(F.when(lower & (F.col("stage_key") == optim), F.col("stage_index"))).alias("optim_index"),
        F.collect_list(F.when(lower, F.struct("stage_index", "stage_execution_id", "stage_key"))).alias("lower"),
    )
    asked = wanted.select("work_item_id", "fanin_index").dropDuplicates().join(found, ["work_item_id", "fanin_index"], "left")
    inside = F.array_sort(F.filter("lower", lambda r: r["stage_index"] > F.col("optim_index")))
    asked = asked.withColumn("inside", inside)
    size = F.size(F.array_distinct(F.transform("inside", lambda r: r["stage_index"])))
    problem = (
        F.when(F.col("fanin_id").isNull(), "no_row").when(~F.col("waits"), "not_barrier").when(F.col("optim_index").isNull(), "no_optim")
        .when(F.exists("inside", lambda r: r["stage_key"] != evaluated), "foreign_key").when(size != F.col("fanin_index") - F.col("optim_index") - 1, "gap")
    )
    ids = F.transform("inside", lambda r: r["stage_execution_id"])
    return asked.select("work_item_id", "fanin_index", "fanin_id", "optim_index", F.when(problem.isNull(), ids).alias("eval_rows"), problem.alias("problem"))


def inspect_campaigns(wanted: DataFrame, runs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of the requested campaigns, and the unknown ones."""
    keys = wanted.select("campaign_key").dropDuplicates()
    found = campaign_summaries(runs.join(keys, "campaign_key", "left_semi"), items.join(keys, "campaign_key", "left_semi"))
    return found, keys.join(runs.select("campaign_key"), "campaign_key", "left_anti")


def unknown_keys(wanted: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Requested keys (of campaigns, runs, cursors or items) that are not there: the rejects of a reader."""
    return wanted.select(*keys).dropDuplicates().join(known.select(*keys), list(keys), "left_anti")


def stages_in_ranges(wanted: DataFrame, executions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (work_item_id, above, below; null is open, bounds are exclusive): executions by index and id, and the rows whose range is empty."""
    empty = F.coalesce(F.col("above") >= F.col("below"), F.lit(False))
    inside = (F.col("above").isNull() | (F.col("stage_index") > F.col("above"))) & (F.col("below").isNull() | (F.col("stage_index") < F.col("below")))
    rows = wanted.where(~empty).join(apart(executions), "work_item_id").where(inside)
    return rows.orderBy("work_item_id", "stage_index", "stage_execution_id"), wanted.where(empty)
