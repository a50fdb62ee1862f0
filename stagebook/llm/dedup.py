"""Exact deduplication by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, fresh, marked, materialize, text_of

#: Texts are equal without these characters: space and the controls from tab to carriage return.
IGNORED = " \t\n\x0b\x0c\r"
PREFIX = 64


def normalised(text: Column) -> Column:
    return F.translate(text, IGNORED, "")


@dataclass
class Refined:
    """``survivors``: (length, prefix hash) of more than one row. ``rows``: narrow rows with digests. ``groups``: digest, group_size, and the row that stays (best)."""

    survivors: DataFrame
    rows: DataFrame
    groups: DataFrame


def _prefix_hash(norm: str) -> Column:
    return F.xxhash64(F.substring(norm, 1, PREFIX))


def refine(docs: DataFrame, everywhere: bool = False) -> Refined:
    """Group by length, then by prefix hash, then by the digest of full content, each on what the last left in groups.

    Lengths, hashes, digests and ids are computed where the texts lie and leave that place as narrow rows: no exchange holds a
    text, whatever the number of surviving keys (``marked`` finds their rows by a table of bounded size, an exact join of the
    narrow rows follows). ``everywhere`` digests all rows, for reports that show every digest.
    """
    sized = docs.select("doc_id", normalised(text_of()).alias("norm"), F.char_length(text_of()).alias("n_points")).withColumn("n_bytes", F.octet_length("norm").cast("long"))
    lengths = materialize(sized.groupBy("n_bytes").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes"), "lengths")
    repeated = marked(sized, F.col("n_bytes"), lengths, "repeated").withColumn("prefix_hash", F.when(F.col("repeated"), _prefix_hash("norm")))
    by_prefix = repeated.where("repeated").groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n"))
    survivors = materialize(by_prefix.where("n > 1").select("n_bytes", "prefix_hash"), "survivors")
    digested = repeated
    if not everywhere:
        pair = F.xxhash64("n_bytes", "prefix_hash")
        digested = marked(repeated.where("repeated"), pair, survivors.select(pair.alias("pair")), "survives").where("survives")
    rows = materialize(digested.select("doc_id", "n_points", "n_bytes", "prefix_hash", F.sha2(F.col("norm").cast("binary"), 256).alias("digest")), "digests")
    shared = rows.join(bounded(survivors), ["n_bytes", "prefix_hash"], "left_semi")
    best = F.min(F.struct((-F.col("n_points")).alias("order"), F.col("doc_id").alias("doc_id"))).alias("best")
    groups = shared.groupBy("digest").agg(F.count("*").alias("group_size"), best).where("group_size > 1")
    return Refined(survivors, rows.drop("n_bytes", "prefix_hash"), materialize(groups, "groups"))


def duplicate_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, and all empty texts are equal. Of equal texts the one with the most code points stays, then
    the smallest id (a null id before all); of rows that tie in both, exactly one is marked as kept. Ids keep their type; other
    columns play no part. An empty table gives no rows.
    """
    r = refine(docs, everywhere=True)
    order = Window.partitionBy("digest", "doc_id").orderBy(F.col("n_points").desc())
    rows = r.rows.withColumn("nth", F.row_number().over(order)).join(bounded(r.groups), "digest", "left")
    alone = F.col("group_size").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("nth") == 1))
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        stays.alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rules as in ``duplicate_report``.

    Rows that cannot be among those to go pass without a join that shuffles them; only the others are digested again and
    looked up by id, length and digest. Of rows alike in all three, the first in the order of all their columns stays.
    """
    r = refine(docs)
    key = ["doc_id", "n_points", "digest"]
    members = r.rows.join(bounded(r.groups.select("digest", "best")), "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_points") == -F.col("best.order"))
    counted = members.groupBy(*key).agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    suspects = materialize(counted.where("NOT stays OR n > 1").select(*key, "stays"), "suspects")
    mark, points, digest, nth, of, of_points, of_digest, stays = fresh(docs, "suspect", "points", "digest", "nth", "of", "of_points", "of_digest", "stays")
    pair = materialize(suspects.select(F.xxhash64("doc_id", "n_points").alias("pair")).distinct(), "suspect-keys")
    seen = marked(docs.withColumn(points, F.char_length(text_of())), F.xxhash64("doc_id", points), pair, mark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clear = seen.where(~F.col(mark)).select(*columns)
    doubtful = seen.where(F.col(mark)).withColumn(digest, F.sha2(normalised(text_of()).cast("binary"), 256))
    found = suspects.select(F.col("doc_id").alias(of), F.col("n_points").alias(of_points), F.col("digest").alias(of_digest), F.col("stays").alias(stays))
    at = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(points) == F.col(of_points)) & (F.col(digest) == F.col(of_digest))
    looked = doubtful.join(bounded(found), at, "left")
    kept = clear.unionByName(looked.where(F.col(stays).isNull()).select(*columns))
    if suspects.where("stays").isEmpty():
        return kept
    # a second row of the same id, length and text is rare
    alike = Window.partitionBy("doc_id", points, digest).orderBy(F.to_json(F.struct(*columns)))
    first = looked.where(F.col(stays)).withColumn(nth, F.row_number().over(alike)).where(F.col(nth) == 1)
    return kept.unionByName(first.select(*columns))
