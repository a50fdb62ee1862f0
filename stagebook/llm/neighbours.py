"""Nearest neighbours by inner product: a block matrix join with int8 tiles and bounds on their error."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Queries and candidates of a cell of the grid at most: with 64 components, 17 and 34 MB.
QUERIES, CANDIDATES = 32_768, 65_536
TILE = 2_048


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the L1 norms of the rows that they stand for."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    with np.errstate(over="ignore"):
        return np.rint(x / scale[:, None]).astype(np.int8), scale, np.abs(x).sum(axis=1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, v`` (array of double): rows with an id and a vector of the most common size that is not zero and all finite.

    Vectors of other sizes cannot be compared with the rest and take no part either.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


class _Best:
    """The k best of each query seen so far, as heaps with the worst on top (ties to the smaller id)."""

    def __init__(self, n: int, k: int) -> None:
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        self.least, self.k = np.full(n, -np.inf), k

    def add(self, query: int, score: float, vec: int) -> None:
        heap, item = self.heaps[query], (score, -vec)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.least[query] = heap[0][0]


#: Pairs whose products are computed at once.
EXACT = 65_536


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; what only its parts overflow is summed anew on a smaller scale, and what is too large in all is infinite."""
    out = np.empty(len(q))
    for a in range(0, len(q), EXACT):
        one, other = q[a : a + EXACT], x[a : a + EXACT]
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.einsum("ij,ij->i", one, other)
            if len(bad := np.nonzero(~np.isfinite(s))[0]):
                up, over = (np.frexp(np.abs(v[bad]).max(axis=1))[1] for v in (one, other))
                small = np.einsum("ij,ij->i", np.ldexp(one[bad], -up[:, None]), np.ldexp(other[bad], -over[:, None]))
                s[bad] = np.ldexp(small, up + over)
        out[a : a + EXACT] = s
    return out


def _tile(best: _Best, q: tuple, ids: np.ndarray, x: np.ndarray) -> None:
    """Offer one tile of candidates to all queries of the cell.

    With q = a*Q + r and x = b*X + s, where no component of r or s is over half of a or b, the product differs from
    a*b*(Q.X) by at most |q|_1 * b/2 + |x|_1 * a/2 + d*a*b/4. Pairs whose upper bound misses the query's k-th best lower
    bound (of the tile, or the k-th best score so far) are dropped; the rest are computed from the original vectors. A pair
    whose estimate or bound overflows has no bound and is always computed.
    """
    qid, qx, q8, qs, q1 = q
    x8, xs, x1 = _quantised(x)
    d = x.shape[1]
    # the products of int8 are whole numbers under 2**24 for up to 1,000 components, so float32 holds them exactly
    kind = np.float32 if d * 127 * 127 < 2**24 else np.float64
    x8 = x8.astype(kind)
    for lo in range(0, len(qid), 512):
        part = slice(lo, lo + 512)
        with np.errstate(over="ignore", invalid="ignore"):
            near = (q8[part].astype(kind) @ x8.T).astype(np.float64) * qs[part, None] * xs
            error = (q1[part, None] * xs / 2 + x1 * (qs[part, None] / 2) + d / 4 * qs[part, None] * xs) * (1 + 1e-9) + 1e-12
            lower, upper = near - error, near + error
        open_ = ~(np.isfinite(lower) & np.isfinite(upper))
        upper[open_] = np.inf
        lower[open_ | (qid[part, None] == ids)] = -np.inf
        floor = best.least[part].copy()
        if lower.shape[1] > best.k:
            floor = np.maximum(floor, np.partition(lower, lower.shape[1] - best.k, axis=1)[:, -best.k])
        row, col = np.nonzero((upper >= floor[:, None]) & (qid[part, None] != ids))
        for a in range(0, len(row), EXACT):
            of, at = row[a : a + EXACT], col[a : a + EXACT]
            score = products(qx[part][of], x[at])
            for r, s, v in zip((of + lo).tolist(), score.tolist(), ids[at].tolist(), strict=True):
                if s >= best.least[r]:
                    best.add(r, s, v)


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of every ``every``-th id's vector: ``query_id, rank, vec_id, score``, ties to the smaller id.

    Queries and candidates are dealt into blocks of bounded size, and each block of queries meets each block of candidates in
    a cell of its own; vectors go there by a shuffle and never through the driver. A cell gives k for each of its queries, and
    heaps merge the cells' lists. A row whose vector takes no part is neither query nor candidate. With a repeated id, each
    row is a candidate for other ids' queries, and its queries are answered once for each row. Products beyond the range of
    doubles are infinite and tie. Ids of any whole type come
    back as long, other columns play no part. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d, total = (sizes[0]["d"], sizes[0]["count"]) if sizes else (1, 0)
    # numbers of rows are dealt out, not ids: they are even whatever repeats, and fixed by the files
    numbered = materialize(rows.where(F.size("v") == d), "vectors").withColumn("row", F.monotonically_increasing_id())
    queries = numbered.where(F.col("id") % every == 0)
    asked = queries.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-asked // QUERIES))
    across = max(1, -(-total // CANDIDATES), min(-(-partitions // down), -(-total // (2 * TILE))))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ask = queries.select(block(down).alias("down"), every_block(across).alias("across"), F.col("row").alias("query"), "id", "v")
    offer = numbered.select(every_block(down).alias("down"), block(across).alias("across"), F.lit(None).cast("long").alias("query"), "id", "v")
    cells = ask.unionByName(offer).repartition(max(partitions, down * across), "down", "across")
    lists = cells.groupBy("down", "across").applyInArrow(_cell(d, k), "query long, query_id long, vec_id long, score double")
    return _merged(lists, k, max(1, asked * across * k // 200_000))


def _cell(d: int, k: int):
    """The k best candidates of each query within a block of queries and a block of candidates."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = np.asarray(table.column("query").is_valid())
        ids, x = np.asarray(table.column("id")), _matrix(table.column("v").chunk(0), d) if len(table) else np.zeros((0, d))
        row, qid, qx = np.asarray(table.column("query").drop_null()), ids[asks], x[asks]
        q, best = (qid, qx, *_quantised(qx)), _Best(len(qid), k)
        ids, x = ids[~asks], x[~asks]
        for lo in range(0, len(ids) if len(qid) else 0, TILE):
            _tile(best, q, ids[lo : lo + TILE], x[lo : lo + TILE])
        count = [len(heap) for heap in best.heaps]
        flat = [item for heap in best.heaps for item in heap]
        return pa.table(
            [pa.array(np.repeat(row, count), pa.int64()), pa.array(np.repeat(qid, count), pa.int64()), pa.array([-v for _, v in flat], pa.int64()), pa.array([s for s, _ in flat], pa.float64())],
            names=["query", "query_id", "vec_id", "score"],
        )

    return run


def _merged(lists: DataFrame, k: int, groups: int) -> DataFrame:
    """Heaps over the cells' lists: ``query_id, rank, vec_id, score``; a group has the lists of some queries, at most some 200,000 rows."""

    def merge(table: pa.Table) -> pa.Table:
        heaps: dict[int, list] = {}
        names: dict[int, int] = {}
        for q, name, v, s in zip(*(table.column(n).to_pylist() for n in ("query", "query_id", "vec_id", "score")), strict=True):
            heap = heaps.setdefault(q, [])
            names[q] = name
            if len(heap) < k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
        rows = [(names[q], i + 1, -v, s) for q, heap in heaps.items() for i, (s, v) in enumerate(sorted(heap, reverse=True))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["query_id", "rank", "vec_id", "score"])

    partitions = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(groups, partitions)
    dealt = lists.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups))).repartition(groups, "group")
    return dealt.groupBy("group").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
