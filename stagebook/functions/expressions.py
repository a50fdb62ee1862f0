"""Column builders over ledger tables: identities, digests, label selectors, terminal filters, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States by precedence, moves between them, id prefixes, the syntax and the length of keys.
PRECEDENCE = ("failed", "cancelled", "admitted", "ready")
MOVES = (("ready", "admitted"), ("ready", "cancelled"), ("admitted", "succeeded"), ("admitted", "failed"), ("admitted", "cancelled"), ("failed", "ready"), ("failed", "cancelled"))
STAGE_PREFIX, COMPLETION_PREFIX = "drp-", "drp-run-"
PRIORITY_MAX = 2_147_483_647
KEY_SYNTAX, KEY_LENGTH = r"^[A-Za-z0-9][A-Za-z0-9._:/-]*$", 128


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def precedence(state: str | Column) -> Column:
    out = F.lit(len(PRECEDENCE))
    for k, s in reversed(list(enumerate(PRECEDENCE))):
        out = F.when(c(state) == s, k).otherwise(out)
    return out


def index_order(state: str | Column, index: str | Column) -> Column:
    """Lowest index first, but of succeeded stages the highest."""
    return F.when(c(state) == "succeeded", -c(index)).otherwise(c(index))


def json_digest(**fields: str | Column) -> Column:
    """sha256 of the JSON object with its keys sorted."""
    return F.sha2(F.to_json(F.struct(*[c(v).alias(k) for k, v in sorted(fields.items())])), 256)


def stable_rank(campaign: str | Column, work: str | Column) -> Column:
    head = F.substring(json_digest(campaign_key=campaign, work_key=work), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(2**63 - 1).cast("decimal(20,0)") + 1).cast("long")


def stage_workflow_id(campaign, work, pipeline, version, stage, index, attempt) -> Column:
    digest = json_digest(campaign_key=campaign, work_key=work, pipeline_key=pipeline, pipeline_version=version, stage_key=stage, stage_index=index)
    return F.concat(F.lit(STAGE_PREFIX), digest, F.lit("-a"), c(attempt).cast("string"))


def completion_workflow_id(run, pipeline, version, completion, attempt) -> Column:
    digest = json_digest(run_key=run, pipeline_key=pipeline, pipeline_version=version, run_completion_key=completion)
    return F.concat(F.lit(COMPLETION_PREFIX), digest, F.lit("-a"), c(attempt).cast("string"))


def contains(labels: str | Column, selector: str | Column) -> Column:
    """Whether the labels hold every entry of the selector; the empty selector matches all."""
    return F.forall(F.map_entries(c(selector)), lambda e: F.coalesce(c(labels)[e["key"]] == e["value"], F.lit(False)))


def canonical(selector: str | Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c(selector)))))


def valid_key(key: str | Column) -> Column:
    return F.coalesce(c(key).rlike(KEY_SYNTAX) & (F.length(c(key)) <= KEY_LENGTH), F.lit(False))


def valid_priority(priority: str | Column) -> Column:
    return F.coalesce((c(priority) >= 0) & (c(priority) <= PRIORITY_MAX), F.lit(False))


def not_before(time: Column, bound: str | Column) -> Column:
    """A time of change, moved up to the bound where it lies before that."""
    return F.greatest(time, c(bound))


def blank_as_absent(x: str | Column) -> Column:
    return F.nullif(F.trim(c(x)), F.lit(""))


def terminal_filter(producer: str | None = None, state: str | None = None, error_type: str | None = None, has_evidence: bool | None = None) -> Column:
    """All given conditions on an execution's state and its current attempt's summary; at least one is needed."""
    field = lambda name: F.get_json_object("terminal_summary", f"$.{name}")
    parts = [cond for given, cond in ((producer, field("producer") == producer), (state, F.col("state") == state), (error_type, field("error_type") == error_type), (has_evidence, F.col("evidence_reference").isNotNull() == F.lit(has_evidence))) if given is not None]
    if not parts:
        raise ValueError("a terminal filter needs a condition")
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def may_move(old: str | Column, new: str | Column) -> Column:
    out = F.lit(False)
    for a, b in MOVES:
        out = out | ((c(old) == a) & (c(new) == b))
    return out
