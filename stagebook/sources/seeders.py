"""Seeders of ledgers for tests and trials: deferral episodes of any number and size, made by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import stable_rank

# Stage keys and the forms of references.
OPTIM, EVALUATED, FANIN = "optim_step", "eval_row", "eval_fanin"


def work_items(work: DataFrame, stage_key: str, priority: int = 0) -> tuple[DataFrame, DataFrame]:
    """Items for rows (campaign_key, work_key), and a ready first stage for each."""
    items = work.select(
        F.xxhash64("campaign_key", "work_key").alias("work_item_id"), "campaign_key", "work_key", F.concat(F.lit("run-"), F.col("campaign_key")).alias("origin_run_key"), F.concat(F.lit("input:"), F.col("work_key")).alias("input_reference"),
        F.create_map(F.lit("kind"), F.lit("sample")).alias("labels"), stable_rank("campaign_key", "work_key").alias("rank"), F.lit(priority).alias("priority"),
    )
    stages = items.select(
        F.xxhash64("work_item_id", F.lit(0)).alias("stage_execution_id"), "work_item_id", F.lit(stage_key).alias("stage_key"), F.lit(0).alias("stage_index"), F.lit("ready").alias("state"), F.lit(0).alias("current_attempt"),
        "rank", "priority", "input_reference", F.lit(None).cast("string").alias("output_reference"), F.lit(False).alias("barrier"),
    )
    return items, stages


def succeeded(stages: DataFrame, output: Column, at: Column) -> DataFrame:
    """The stages as they are after an attempt of each has succeeded with ``output``."""
    attempt = F.greatest(F.col("current_attempt"), F.lit(1))
    return stages.withColumn("output_reference", output).withColumn("state", F.lit("succeeded")).withColumn("current_attempt", attempt).withColumn("updated_at", at)


def episodes(items: DataFrame, rows: Column, count: Column | None = None) -> DataFrame:
    """Stages of ``count`` (one) deferral episodes for each item: an optimisation step, ``rows`` rows to evaluate, then a fan-in that waits.

    ``items`` has ``work_item_id`` and ``rank``; earlier episodes have succeeded, of the last one the fan-in is ready.
    """
    count = F.lit(1) if count is None else count
    per = items.select("work_item_id", "rank", rows.cast("int").alias("n"), count.cast("int").alias("episodes")).where("n >= 1 AND episodes >= 1")
    each = per.withColumn("episode", F.explode(F.sequence(F.lit(0), F.col("episodes") - 1)))
    each = each.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") + 1)))
    index = F.col("episode") * (F.col("n") + 2) + F.col("place")
    key = F.when(F.col("place") == 0, OPTIM).when(F.col("place") == F.col("n") + 1, FANIN).otherwise(EVALUATED)
    fanin = key == FANIN
    open_ = fanin & (F.col("episode") == F.col("episodes") - 1)
    name = F.when(key == OPTIM, "optim").when(fanin, "fanin").otherwise("row")
    nth = F.when(key == OPTIM, F.col("episode")).when(fanin, F.col("episode") + 1).otherwise(F.col("place")).cast("string")
    return each.select(
        F.xxhash64("work_item_id", index).alias("stage_execution_id"), "work_item_id", key.alias("stage_key"), index.cast("int").alias("stage_index"), F.when(open_, "ready").otherwise("succeeded").alias("state"),
        F.when(open_, 0).otherwise(1).alias("current_attempt"), "rank", F.concat(name, F.lit(":in:"), nth).alias("input_reference"), F.when(~open_, F.concat(name, F.lit(":out:"), nth)).alias("output_reference"), fanin.alias("barrier"),
    )


def fanouts(origins: DataFrame, rows: Column) -> DataFrame:
    """Successors of each origin (``origin_id, origin_index``) as an outcome would list them: rows to evaluate and one fan-in that waits."""
    n = origins.select("origin_id", "origin_index", rows.cast("int").alias("n")).where("n >= 1")
    each = n.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") + 1)))
    last = F.col("k") == F.col("n") + 1
    return each.select("origin_id", "origin_index", F.when(last, FANIN).otherwise(EVALUATED).alias("stage_key"), (F.col("origin_index") + F.col("k")).cast("int").alias("stage_index"), last.alias("barrier"))
