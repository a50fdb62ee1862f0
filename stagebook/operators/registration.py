"""Registration of runs and their members as one job: declarations, members, memberships, closure with receipts, and rejects."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import stable_rank, valid_key, valid_priority
from ..sources.shared import materialize, narrow
from .changes import classify_members, closure_check

# What a run key is bound to for good.
PROVENANCE = ("campaign_key", "pipeline_key", "pipeline_version", "execution_config_reference", "expected_member_count", "manifest_reference", "membership_digest", "run_completion_key")


def first_reason(**checks: Column) -> Column:
    """The name of the first check that does not hold; a check that is null holds not."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])


def register_runs(declarations: DataFrame, runs: DataFrame) -> DataFrame:
    """Each declared run with its ``kind``: rejected (and a ``reason``), new, replay, closed (a replay of a closed run), or conflict.

    A known run is a replay only if all eight facts of its provenance are equal, nulls as values. A closed run's replay returns
    the stored receipt, and its members are not looked at. Of one run declared several times with equal facts one row is left;
    with other facts all are rejected.
    """
    facts = F.struct(*PROVENANCE)
    declared = declarations.select("run_key", *PROVENANCE).distinct()
    times = declared.groupBy("run_key").agg(F.count("*").alias("times"))
    held = runs.select("run_key", facts.alias("old"), F.col("registration_closed_at").isNotNull().alias("closed"))
    rows = declared.join(times, "run_key").join(held, "run_key", "left")
    keys = valid_key("run_key") & valid_key("campaign_key") & valid_key("pipeline_key") & (F.col("run_completion_key").isNull() | valid_key("run_completion_key"))
    reason = first_reason(
        declared_once=F.col("times") == 1, valid_keys=keys, version_positive=F.col("pipeline_version") > 0, config_given=F.col("execution_config_reference") != "",
        members_not_negative=F.col("expected_member_count") >= 0, manifest_with_digest=F.col("manifest_reference").isNull() == F.col("membership_digest").isNull(),
        completion_has_manifest=F.col("run_completion_key").isNull() | F.col("manifest_reference").isNotNull(),
    )
    kind = F.when(reason.isNotNull(), "rejected").when(F.col("old").isNull(), "new").when(~F.col("old").eqNullSafe(facts), "conflict").when(F.col("closed"), "closed").otherwise("replay")
    return rows.select("run_key", *PROVENANCE, kind.alias("kind"), reason.alias("reason"))


def receipts(runs: DataFrame) -> DataFrame:
    """The stored receipts of closed runs."""
    closed = runs.where("registration_closed_at IS NOT NULL")
    return closed.select("run_key", "membership_digest", F.col("registered_member_count").alias("registered_count"), F.col("created_work_count").alias("created_count"), F.col("reused_work_count").alias("reused_count"), "registration_closed_at")


def member_problems(members: DataFrame) -> DataFrame:
    """Members that may not be registered, with the first ``reason``: values out of range, or a work key or ordinal that a run has twice."""
    rows = members.select("run_key", "member_ordinal", "work_key", "input_reference", "labels", "priority")
    # keys meet as hashes; only rows whose hash is there twice, and faulty ones, are looked at by their keys
    rows = rows.withColumns({"h_work": F.xxhash64(F.lit(0), "run_key", "work_key"), "h_ordinal": F.xxhash64(F.lit(1), "run_key", "member_ordinal")})
    hashes = rows.select(F.explode(F.array("h_work", "h_ordinal")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    suspects = narrow(materialize(hashes, "repeated-hashes"))
    for h in ("h_work", "h_ordinal"):
        rows = rows.join(suspects.select(F.col("h").alias(h), F.lit(True).alias(f"{h}_again")), h, "left")
    named = F.coalesce(F.forall(F.map_values("labels"), lambda v: v.isNotNull()), F.lit(False))
    values = {
        "ordinal_not_negative": F.col("member_ordinal") >= 0, "valid_work_key": valid_key("work_key"), "input_given": F.col("input_reference") != "", "labels_are_texts": named,
        "priority_in_range": valid_priority("priority"),
    }
    rows = rows.where(first_reason(**values).isNotNull() | F.col("h_work_again") | F.col("h_ordinal_again"))
    once = lambda key: F.col("run_key").isNull() | (F.count("*").over(Window.partitionBy("run_key", key)) == 1)
    rows = rows.withColumns({"one_row_of_a_work_key": once("work_key"), "one_row_of_an_ordinal": once("member_ordinal")})
    reason = first_reason(**values, one_row_of_a_work_key=F.col("one_row_of_a_work_key"), one_row_of_an_ordinal=F.col("one_row_of_an_ordinal"))
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("run_key", "member_ordinal", "work_key", "reason")


def open_members(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Members of runs that are still open; those of closed runs are left out before any work."""
    return members.join(runs.where("registration_closed_at IS NOT NULL").select("run_key"), "run_key", "left_anti")


def register_members(members: DataFrame, items: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of open runs by kind (new, same, priority_change), and the rejects with a reason.

    A run with a rejected member registers none of its members: a chunk is one transaction.
    """
    # both results and the rejects follow from what each member is, which is worked out once
    classified = materialize(classify_members(open_members(members, runs), items, runs), "classified")
    conflicts = classified.where("kind = 'conflict'").select("run_key", "member_ordinal", "work_key", F.lit("conflict").alias("reason"))
    rejects = materialize(member_problems(classified).unionByName(conflicts), "rejected-members")
    return classified.join(narrow(rejects.select("run_key").distinct()), "run_key", "left_anti"), rejects


def membership_differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs (ordinal, item) of a run that only one side has: ``missing`` from the stored ones, or ``other`` than expected. Repeats count."""
    key = ["run_key", "member_ordinal", "work_item_id"]
    tally = lambda rows, name: rows.groupBy(*key).agg(F.count("*").alias(name))
    both = tally(expected, "wanted").join(tally(stored, "found"), key, "full")
    wanted, found = F.coalesce("wanted", F.lit(0)), F.coalesce("found", F.lit(0))
    return both.where(wanted != found).select(*key, F.when(wanted > found, "missing").otherwise("other").alias("difference"))


def ordered_digests(memberships: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    """``run_key, membership_digest, members``: sha256 over the ordered JSON of a run's members, their number and the name of the format.

    Members are sorted within partitions (which may spill) and hashed as they pass by, so that a run of any size takes no more
    memory than a batch.
    """
    json = F.to_json(F.struct("input_reference", F.col("member_ordinal").alias("ordinal"), "work_key"))
    rows = memberships.join(items.select("work_item_id", "work_key", "input_reference"), "work_item_id").select("run_key", "member_ordinal", json.alias("json"))

    def run(batches):
        key, state, n = None, None, 0
        for batch in batches:
            keys, digests, counts = [], [], []

            def close() -> None:
                state.update(f'],"expected_member_count":{n},"schema":"{schema}"}}'.encode())
                keys.append(key)
                digests.append(state.hexdigest())
                counts.append(n)

            for k, entry in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        close()
                    key, state, n = k, hashlib.sha256(b'{"entries":['), 0
                state.update((("," if n else "") + entry).encode())
                n += 1
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(digests), pa.array(counts, pa.int64())], ["run_key", "membership_digest", "members"])
        if state is not None:
            keys, digests, counts = [], [], []
            state.update(f'],"expected_member_count":{n},"schema":"{schema}"}}'.encode())
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], ["run_key", "membership_digest", "members"])

    return rows.repartition("run_key").sortWithinPartitions("run_key", "member_ordinal").mapInArrow(run, "run_key string, membership_digest string, members long")


def close_runs(runs: DataFrame, memberships: DataFrame, items: DataFrame, schema: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Receipts of open runs that can be closed, and the others with a ``reason``: they stay open.

    Ordinals must run from 0 without gaps, the count must be as expected, and a declared digest must equal the members' own.
    """
    todo = runs.where("registration_closed_at IS NULL")
    # members are put in order and digested for runs that declared a digest alone
    told = todo.where("membership_digest IS NOT NULL").select("run_key")
    own = memberships.drop("origin_run_key").join(narrow(told), "run_key", "left_semi")
    none = hashlib.sha256(f'{{"entries":[],"expected_member_count":0,"schema":"{schema}"}}'.encode()).hexdigest()
    found = ordered_digests(own, items, schema).select("run_key", F.col("membership_digest").alias("found_digest"))
    rows = closure_check(todo, memberships, items).join(todo.select("run_key", "membership_digest"), "run_key").join(found, "run_key", "left").withColumn("found_digest", F.coalesce("found_digest", F.lit(none)))
    reason = first_reason(gapless=F.col("contiguous"), complete=F.col("complete"), digest_equal=F.col("membership_digest").isNull() | (F.col("membership_digest") == F.col("found_digest")))
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason IS NULL")
    receipt = good.select("run_key", "membership_digest", F.col("members").cast("int").alias("registered_count"), F.col("created").cast("int").alias("created_count"), F.col("reused").cast("int").alias("reused_count"), at.alias("registration_closed_at"))
    return receipt, judged.where("reason IS NOT NULL").select("run_key", "reason")


@dataclass
class Submission:
    """Rows to add: ``runs``, ``items``, ``memberships``, ``executions``. ``receipts`` of closed runs, stored ones included. ``rejects``: a row per run, or member, with a reason."""

    runs: DataFrame
    items: DataFrame
    memberships: DataFrame
    executions: DataFrame
    receipts: DataFrame
    rejects: DataFrame


def submit(declarations: DataFrame, members: DataFrame, runs: DataFrame, items: DataFrame, memberships: DataFrame, declared: DataFrame, schema: str, at: Column) -> Submission:
    """Register declared runs with their members and close them, as one job over any number of runs.

    Runs are new, replays, or turned away (``register_runs``); of a closed run the stored receipt comes back and its members are
    not looked at. A run with a rejected member registers nothing; runs of one call that bring different facts for one new item
    are rejected all. A new item belongs to the smallest of the runs that bring it; its first declared stage is seeded as
    ready. Memberships that are there already are kept, and a run of which they differ from what is submitted is rejected. Runs
    that are gapless, complete and have the declared digest are closed; the others stay open and are among the rejects.
    """
    facts = lambda df: df.select("run_key", *PROVENANCE)
    judged = materialize(register_runs(declarations, runs), "judged-runs")
    opened = judged.where("kind IN ('new', 'replay')")
    new_runs = judged.where("kind = 'new'")
    open_at = F.lit(None).cast("timestamp")
    all_runs = materialize(facts(opened).withColumn("registration_closed_at", open_at), "open-runs")
    known_runs = facts(runs).withColumn("registration_closed_at", open_at).unionByName(facts(new_runs).withColumn("registration_closed_at", open_at))
    provenance = F.struct("pipeline_key", "pipeline_version", "execution_config_reference").alias("provenance")
    todo = members.join(all_runs.select("run_key", "campaign_key", provenance), ["run_key", "campaign_key"])
    good, wrong = register_members(todo, items, known_runs)
    good = good.select("run_key", "campaign_key", "member_ordinal", "work_key", "input_reference", "labels", "priority", "kind", "work_item_id", "old_origin")
    # new items with the smallest of their runs, and whether their runs say the same of them; ids follow the greatest one and are fixed when they are written
    item, top = ["campaign_key", "work_key"], items.agg(F.max("work_item_id")).first()[0] or 0
    first = F.min_by(F.struct(F.col("run_key").alias("origin_run_key"), "input_reference", "labels", "priority"), "run_key").alias("m")
    said = F.struct("input_reference", F.array_sort(F.map_entries("labels")).alias("labels"), "priority")
    brought = good.where("kind = 'new'").groupBy(*item).agg(first, (~F.min(said).eqNullSafe(F.max(said))).alias("mixed"))
    brought = materialize(brought.withColumn("work_item_id", F.monotonically_increasing_id() + top + 1), "brought-items")
    disputed = narrow(brought.where("mixed").select(*item))
    other = good.where("kind = 'new'").join(disputed, item, "left_semi").select("run_key", "member_ordinal", "work_key", F.lit("disputed").alias("reason"))
    member_rejects = materialize(wrong.unionByName(other), "member-rejects")
    turned_away = narrow(member_rejects.select("run_key").distinct())
    good = good.join(turned_away, "run_key", "left_anti")
    # an item whose smallest run was turned away belongs to the smallest of the others
    lost = narrow(brought.join(turned_away.withColumnRenamed("run_key", "gone"), F.col("m.origin_run_key") == F.col("gone"), "left_semi").select(*item, "work_item_id"))
    kept = brought.join(lost.select("work_item_id"), "work_item_id", "left_anti").select("work_item_id", *item, "m.*")
    again = good.where("kind = 'new'").join(lost, item, "left_semi").groupBy(*item).agg(first).join(lost, item).select("work_item_id", *item, "m.*")
    made = kept.unionByName(again).withColumn("rank", stable_rank(*item)).select("work_item_id", *item, "origin_run_key", "input_reference", "labels", "rank", "priority")
    fresh = made.select(*item, F.col("work_item_id").alias("made"), F.col("origin_run_key").alias("made_by"))
    wanted = good.select("run_key", "member_ordinal", *item, "work_item_id", "old_origin").join(fresh, item, "left")
    wanted = materialize(wanted.select("run_key", "member_ordinal", F.coalesce("work_item_id", "made").alias("work_item_id"), F.coalesce("old_origin", "made_by").alias("origin_run_key"), F.col("work_item_id").isNull().alias("fresh")), "wanted-members")
    key = ["run_key", "member_ordinal", "work_item_id"]
    stored = materialize(memberships.select(*key).join(all_runs.select("run_key"), "run_key", "left_semi"), "stored-members")
    # rows that only the store has are those of runs that have rows there
    compared = wanted.join(narrow(stored.select("run_key").distinct()), "run_key", "left_semi")
    differ = materialize(membership_differences(compared, stored).where("difference = 'other'").select("run_key").distinct(), "other-members")
    gone = narrow(differ)
    made = made.join(gone.withColumnRenamed("run_key", "origin_run_key"), "origin_run_key", "left_anti")
    wanted = wanted.join(gone, "run_key", "left_anti")
    settled = all_runs.join(turned_away, "run_key", "left_anti").join(gone, "run_key", "left_anti")
    both = items.select("work_item_id", "work_key", "input_reference").unionByName(made.select("work_item_id", "work_key", "input_reference"))
    owned = wanted.join(gone.select(F.col("run_key").alias("origin_run_key"), F.lit(True).alias("fresh")), ["origin_run_key", "fresh"], "left_anti")
    closed, left = close_runs(settled, owned.select(*key, "origin_run_key"), both, schema, at)
    wanted = wanted.select(*key)
    start = declared.groupBy("pipeline_key", "pipeline_version").agg(F.min_by("stage_key", "position").alias("stage_key"))
    owner = known_runs.select(F.col("run_key").alias("origin_run_key"), "pipeline_key", "pipeline_version")
    seeds = made.join(owner, "origin_run_key").join(F.broadcast(start), ["pipeline_key", "pipeline_version"]).select(
        "work_item_id", "stage_key", F.lit(0).alias("stage_index"), F.lit("ready").alias("state"), F.lit(0).alias("current_attempt"), "rank", "priority", "input_reference", F.lit(False).alias("barrier"), at.alias("created_at"),
    )
    no_member = [F.lit(None).cast("int").alias("member_ordinal"), F.lit(None).cast("string").alias("work_key")]
    turned = judged.where("kind IN ('rejected', 'conflict')").select("run_key", *no_member, F.coalesce("reason", "kind").alias("reason"))
    rejects = turned.unionByName(member_rejects).unionByName(differ.select("run_key", *no_member, F.lit("other_members").alias("reason"))).unionByName(left.select("run_key", *no_member, "reason"))
    replayed = receipts(runs).join(judged.where("kind = 'closed'").select("run_key"), "run_key", "left_semi")
    return Submission(facts(new_runs), made, wanted.join(stored, key, "left_anti"), seeds, closed.unionByName(replayed), rejects)
