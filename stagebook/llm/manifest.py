"""A Merkle manifest of a dataset: trees of fixed fanout over leaves in order, and a proof for every leaf, by a butterfly exchange.

1. ``ranked``: every leaf's number within its group, from a range partitioning and running sums over partitions.
2. Aligned blocks of fanout^DEPTH leaves are put through their own levels in one step each (``block_roots``).
3. ``butterfly``: round by round, aligned runs of ``fanout`` subtrees swap their roots. A block sends its subtree's root to one
   block of each other subtree of the run and hashes what it gets to the next root, as do all blocks of the subtree: the work is
   done by each of them anew, and after the last round each block holds the proof from its own root to the top. Nothing has to
   be sent down again. A shorter last subtree serves the others' blocks in turn.
4. ``proofs``: leaves meet their block's upper proof, and get their own within the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, materialize

FANOUT, DEPTH = 3, 6
#: Leaves of a task's group, and of a partition of the ranking.
GROUP_ROWS, RANKED_ROWS = 20_000, 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place:int,siblings:string>>"


def digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns' strings, one after the other."""
    return F.sha2(F.concat(*columns).cast("binary"), 256)


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    width = 64

    def step(node: Column, p: Column) -> Column:
        before = p["place"] * width
        return digest(F.substring(p["siblings"], F.lit(1), before), node, F.substring(p["siblings"], before + 1, F.char_length(p["siblings"])))

    return F.aggregate(proof, leaf, step)


def siblings(proof: Column) -> Column:
    """All siblings of a proof, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda p: p["siblings"]), "")


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (``key``: their group, ``node``, and others) with ``rank`` from 0 within the group and ``total``, its leaves.

    Leaves stand in the order of ``order`` (nulls first), then of node; equal ones in the order in which they were read.
    """
    rows = materialize(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANKED_ROWS)
    by = ["key", *order, "node", "_row"]
    dealt = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)).drop("_row"), "sorted-leaves")
    counts = dealt.groupBy("key", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("key")).alias("total")
    begins = materialize(counts.select("key", "_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), total), "leaf-counts")
    placed = dealt.join(bounded(begins), ["key", "_part"])
    return placed.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _levels(nodes: list[str], depth: int | None) -> Iterator[list[str]]:
    """The levels below the root of a block, or of a whole tree if ``depth`` is None, and then the root."""
    while True:
        yield nodes
        if depth == 0 or depth is None and len(nodes) == 1:
            return
        depth = None if depth is None else depth - 1
        nodes = [hashlib.sha256("".join(nodes[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(nodes), FANOUT)]


def _blocks(table: pa.Table, levels: int) -> Iterator[tuple[str, int, np.ndarray, list[list[str]]]]:
    """Key, number, rows (places in the table, by rank) and levels of each block of a group of blocks."""
    rank, total = (np.asarray(table.column(c)) for c in ("rank", "total"))
    key, node = table.column("key").to_pylist(), table.column("node").to_pylist()
    size = FANOUT**levels
    rows: dict[tuple[str, int], list[int]] = {}
    for k in np.argsort(rank, kind="stable").tolist():
        rows.setdefault((key[k], int(rank[k]) // size), []).append(k)
    for (name, block), at in rows.items():
        yield name, block, np.array(at), list(_levels([node[k] for k in at], levels if total[at[0]] > size else None))


def _grouped(rows: DataFrame, block: Column, leaves: int) -> DataFrame:
    groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), leaves // GROUP_ROWS)
    return rows.withColumn("_group", F.pmod(F.xxhash64("key", block), F.lit(groups))).repartition(groups, "_group")


def block_roots(leaves: DataFrame, count: int, depth: int = DEPTH) -> DataFrame:
    """``key, block, blocks, node``: the root of every block of ranked leaves, and how many blocks its group has."""

    def run(table: pa.Table) -> pa.Table:
        found = [(name, block, levels[-1][0]) for name, block, _, levels in _blocks(table, depth)]
        return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["key", "block", "node"])

    block = F.floor(F.col("rank") / F.lit(FANOUT**depth))
    narrow = _grouped(leaves.select("key", "rank", "total", "node"), block, count)
    roots = materialize(narrow.groupBy("_group").applyInArrow(run, "key string, block long, node string"), "block-roots")
    many = roots.groupBy("key").agg(F.count("*").alias("blocks"))
    return roots.join(bounded(materialize(many, "block-counts")), "key")


def butterfly(blocks: DataFrame) -> DataFrame:
    """``key, block, top, proof``: every block with its group's root and the proof from its own root to it."""
    state = blocks.select("key", "block", "blocks", "node", F.array().cast(PROOF).alias("proof"))
    most, span = blocks.agg(F.max("blocks")).first()[0] or 0, 1
    while span < most:
        state = _round(state, span)
        span *= FANOUT
    return state.select("key", "block", F.col("node").alias("top"), "proof")


def _round(state: DataFrame, span: int) -> DataFrame:
    """Subtrees of ``span`` blocks swap their roots in runs of FANOUT."""
    n, block = F.col("blocks"), F.col("block")
    trees = F.ceil(n / F.lit(span))
    tree = F.floor(block / F.lit(span))
    size = lambda t: F.least(F.lit(span).cast("long"), n - t * span)
    at = block - tree * span

    def to(k: int) -> Column:
        """Blocks of the k-th subtree of the run that take this block's root; of its own subtree itself."""
        other = F.floor(tree / F.lit(FANOUT)) * FANOUT + k
        takes = F.when((other < trees) & (at < size(other)), F.sequence(other * span + at, other * span + size(other) - 1, size(tree)))
        return F.when(other == tree, F.array(block)).otherwise(F.coalesce(takes, F.array().cast("array<bigint>")))

    sent = state.withColumn("to", F.explode(F.concat(*(to(k) for k in range(FANOUT))))).withColumn("own", F.col("to") == block)
    message = F.struct(F.pmod(tree, F.lit(FANOUT)).cast("int").alias("place"), "node")
    mine = F.when(F.col("own"), F.struct(message.alias("m"), "proof"))
    got = sent.groupBy("key", F.col("to").alias("block")).agg(
        F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(message)).alias("run"), F.first(mine, ignorenulls=True).alias("mine"),
    )
    place, node = F.col("mine.m.place"), F.col("mine.m.node")
    others = F.array_join(F.transform(F.filter("run", lambda m: m["place"] != place), lambda m: m["node"]), "")
    step = F.struct(place.alias("place"), others.alias("siblings"))
    above = trees > 1
    return got.select(
        "key", "block", "blocks",
        F.when(above, digest(F.array_join(F.transform("run", lambda m: m["node"]), ""))).otherwise(node).alias("node"),
        F.when(above, F.concat("mine.proof", F.array(step))).otherwise(F.col("mine.proof")).alias("proof"),
    )


def proofs(leaves: DataFrame, uppers: DataFrame, count: int, depth: int = DEPTH) -> DataFrame:
    """Ranked leaves with the columns of their block in ``uppers``; its ``proof`` goes on from the leaf's own proof within the block."""
    more = [c for c in uppers.columns if c not in ("key", "block", "proof")]
    kept = [c for c in leaves.columns if c not in ("rank", "total")]

    def run(rows: pa.Table, tops: pa.Table) -> pa.Table:
        above = {(k, b): (p, i) for i, (k, b, p) in enumerate(zip(*(tops.column(c).to_pylist() for c in ("key", "block", "proof")), strict=True))}
        order, top, found = [], [], []
        for name, block, at, levels in _blocks(rows, depth):
            upper, k = above[name, block]
            sides = []  # per level: the run's others of every node
            for nodes in levels[:-1]:
                sides.append(["".join(nodes[r : r + FANOUT][:p] + nodes[r : r + FANOUT][p + 1 :]) for j in range(len(nodes)) for r, p in ((j - j % FANOUT, j % FANOUT),)])
            for j in range(len(at)):
                own, place = [], j
                for side in sides:
                    own.append({"place": place % FANOUT, "siblings": side[place]})
                    place //= FANOUT
                found.append(own + upper)
            order.extend(at.tolist())
            top.extend([k] * len(at))
        picked, tops = rows.select(kept).take(pa.array(order, pa.int64())), tops.select(more).take(pa.array(top, pa.int64()))
        proof = pa.array(found, pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())])))
        return pa.table([*picked.columns, *tops.columns, proof], names=[*kept, *more, "proof"])

    kinds = {f.name: f.dataType.simpleString() for df in (leaves, uppers) for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*kept, *more)), f"proof {PROOF}"])
    left = _grouped(leaves, F.floor(F.col("rank") / F.lit(FANOUT**depth)), count).groupBy("_group")
    right = _grouped(uppers, F.col("block"), count).groupBy("_group")
    return left.cogroup(right).applyInArrow(run, schema)


def trees(leaves: DataFrame, order: list[str], depth: int = DEPTH) -> tuple[DataFrame, DataFrame, int]:
    """Ranked leaves, their blocks with ``top`` and ``proof``, and how many leaves there are."""
    rows = materialize(ranked(leaves, order), "ranked-leaves")
    count = rows.count()
    return rows, materialize(butterfly(block_roots(rows, count, depth)), "upper-proofs"), count


def leaves_of(docs: DataFrame, fields: tuple = FIELDS, **changed: Column) -> Column:
    """The digest of a row's fields, or of what it would be with other values for some."""
    return digest(*(field(changed.get(c, F.col(c))) for c in fields))


def manifest(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``leaves`` (``source, doc_id, leaf`` and columns to carry) with ``subroot``, ``root`` and ``proof``.

    ``proof``: a step (place, siblings' digests as one string) for every level from the leaf to the root, first within its
    source, then over the subroots of all sources. Within a source leaves ascend by id (null first), then by digest; equal
    rows are leaves each. Blocks have FANOUT^``depth`` leaves. Sources ascend bytewise, null first. A run of one node is hashed like any other; a source of one leaf
    has that as its subroot, and a dataset of one source its subroot as root. An empty table gives no rows. Columns named
    ``key``, ``node``, ``rank``, ``total`` or ``proof`` can't be carried.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # sorts null first
    rows, blocks, count = trees(leaves.withColumn("key", key).withColumnRenamed("leaf", "node"), ["doc_id"], depth)
    subroots = materialize(blocks.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("tree"), F.col("top").alias("node")), "subroots")
    upper_rows, upper_blocks, trees_count = trees(subroots, ["tree"], depth)
    proven = proofs(upper_rows, upper_blocks.withColumnRenamed("top", "root"), trees_count, depth)
    above = materialize(proven.select(F.col("tree").alias("key"), "root", F.col("proof").alias("_above")), "tree-proofs")
    uppers = blocks.join(bounded(above), "key").select("key", "block", F.col("top").alias("subroot"), "root", F.concat("proof", "_above").alias("proof"))
    return proofs(rows, materialize(uppers, "whole-proofs"), count, depth).withColumnRenamed("node", "leaf").drop("key")


def document_manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """The manifest of documents by FIELDS: ``doc_id, source, leaf, subroot, root, proof, shown``.

    ``shown`` is the leaf of the row with ``tampered`` as its text where that is not null, else the leaf itself. Nulls of any
    field are told apart from empty values. Ids of any whole type come back as long; other columns play no part.
    """
    leaf = leaves_of(docs)
    text = F.col("text") if tampered is None else tampered
    shown = F.when(text.isNull() | text.eqNullSafe(F.col("text")), leaf).otherwise(leaves_of(docs, text=text))
    return manifest(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), shown.alias("shown")), depth)
