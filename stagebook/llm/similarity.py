"""N-gram Jaccard join: all links between documents' shingle sets, as components, by T-occurrence search.

1. ``signatures``: every text's set of shingles, as two 64-bit set ids, and a prefix of its smallest hashes. Equal sets are
   one class from here on, so groups of copies never meet as pairs.
2. ``survivors``: linked sets share at least ``least_shared`` of their prefix hashes, so only classes survive of which as many
   prefix hashes occur in other classes.
3. ``rare_prefixes``: of survivors, the n - T + 1 shingles rarest among survivors (T: the least overlap of a linked set). Two
   linked sets have one of them in common, so these short inverted lists say which sets have to meet in a block of the search.
4. First search. Each set stands at the one of its rare shingles that most sets have, at most some thousand at a place. A block's
   inverted lists are built over whole sets, and DivideSkip finds what links from these lists alone: a heap merges the short
   lists, binary search probes the long ones (``divide_skip``). The smallest set that none has found is the next query
   (``stars``), so a group of near copies costs a search or a few.
5. What that left. Only short lists that hold several components go on: each set meets the nearest of another component, then
   all that are left, if sizes and bitmaps (``may_link``, a bound without false negatives) allow a link, and is searched in the
   lists of those it meets. Lists over SPLIT sets are dealt into pieces, so a task compares at most 2 * SPLIT sets of a list.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, bounded, fresh, id_of, in_arrow, marked, materialize, text_of
from .scan import mix, parts, shingle_sets

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT, WIDTH = 80, 5
#: Sets that a query meets at once in the later searches, sets of a block of the first, and of a piece of a long list.
CHUNK, BLOCK, SPLIT = 256, 1024, 4096
_SALT = np.uint64(0xD6E8FEB86659FD93)


def least_overlap(n, percent: int = PERCENT):
    """T: what a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def _extra(n):
    return np.maximum(1, -(-n // 10))


def prefix_length(n, percent: int = PERCENT):
    """Sets that link share as many hashes of their prefixes as the smaller's ``least_shared``."""
    return np.minimum(n, n - least_overlap(n, percent) + _extra(n))


def least_shared(n, percent: int = PERCENT):
    return _extra(least_overlap(n, percent))


def pair_overlap(a, b, percent: int = PERCENT):
    """The intersection that sets of a and b need to link."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """512 bits, each the parity of the hashes that fall on it."""
    return np.packbits((np.bincount((hashes >> np.uint64(23)).astype(np.int64) & 511, minlength=512) & 1).astype(np.uint8))


def may_link(bits: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets may link, and how many bits differ: never more than the elements that only one of two sets has."""
    apart = np.bitwise_count(others ^ bits).sum(axis=1, dtype=np.int64)
    return (apart <= n + sizes - 2 * pair_overlap(n, sizes)) & (np.minimum(n, sizes) >= least_overlap(np.maximum(n, sizes))), apart


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def row_key() -> Column:
    """A 64-bit key of a row's id and text, which no null leaves empty."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, row, n, s1, s2, prefix`` of whole texts (null counts as empty: n is 0)."""

    def run(batches):
        for batch in batches:
            for part, data, at in parts(batch):
                sets = shingle_sets(data, at, WIDTH)
                n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                s1 = np.fromiter((mix(s).sum(dtype=np.uint64) for s in sets), dtype=np.uint64, count=len(sets))
                s2 = np.fromiter((mix(s ^ _SALT).sum(dtype=np.uint64) for s in sets), dtype=np.uint64, count=len(sets))
                p = prefix_length(n).tolist()
                prefix = _blobs([s[:k] for s, k in zip(sets, p, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), _long(s1), _long(s2), prefix], ["doc_id", "row", "n", "s1", "s2", "prefix"])

    rows = docs.select(id_of(), row_key().alias("row"), text_of().alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, row long, n long, s1 long, s2 long, prefix binary")


def _pieces(h: np.ndarray, sid: np.ndarray, lengths: np.ndarray, bucket: np.ndarray, meet: bool, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Where entries go (their places, and buckets): those of long lists to pieces, which are negative numbers.

    A list's sets are dealt into blocks of about ``split``. A piece is one block, or, if all have to ``meet``, two of them.
    """
    hot = np.nonzero(lengths > split)[0]
    if not len(hot):
        return np.arange(len(h)), bucket
    blocks = -(-lengths[hot] // split)
    own = (mix(sid[hot].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
    if meet:
        times = blocks - 1
        at = np.repeat(np.arange(len(hot)), times)
        other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        other += other >= own[at]
        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
    else:
        at, low, high = np.arange(len(hot)), own, own
    piece = -(mix(h[hot][at] ^ mix((low * (1 << 32) + high).astype(np.uint64))) >> np.uint64(1)).astype(np.int64) - 1
    cold = np.nonzero(lengths <= split)[0]
    return np.concatenate([cold, hot[at]]), np.concatenate([bucket[cold], piece])


def _spread(rows: DataFrame, blob: str, buckets: int, numbers: list[str], step: str | None = None, closed: frozenset = frozenset(), split: int = 0) -> DataFrame:
    """Entries of the rows' blobs by range of hash: ``bucket, hashes`` and a blob for each of ``numbers``; equal entries of a batch are sent once.

    For a ``step`` of pairing, ``lengths`` has each entry's list length; entries of ``closed`` lists stay behind.
    """

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            read = lambda c, kind: [np.frombuffer(b, dtype=kind) for b in batch.column(batch.schema.get_field_index(c)).to_pylist()]
            arrays = read(blob, np.uint64)
            size = np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))
            h = np.concatenate([np.zeros(0, dtype=np.uint64), *arrays])
            columns = [np.repeat(_numbers(batch.column(batch.schema.get_field_index(c))), size, axis=0) for c in numbers]
            if step:
                columns.append(np.concatenate([np.zeros(0, dtype=np.int64), *read("lengths", np.int64)]))
            order = np.lexsort((columns[0], h))
            h, columns = h[order], [c[order] for c in columns]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (columns[0][1:] != columns[0][:-1])
            if closed:
                new &= ~np.isin(h.view(np.int64), np.array(sorted(closed), dtype=np.int64))
            h, columns = h[new], [c[new] for c in columns]
            bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            if step:
                place, bucket = _pieces(h, columns[numbers.index("s1")], columns.pop(), bucket, step in ("near", "rest"), split)
                order = np.argsort(bucket, kind="stable")
                place, bucket = place[order], bucket[order]
                h, columns = h[place], [c[place] for c in columns]
            edges = [0, *(np.nonzero(np.diff(bucket))[0] + 1).tolist(), len(h)]
            cut = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in cut], pa.int64()), *[_blobs([c[a:b] for a, b in cut]) for c in (h, *columns)]], ["bucket", "hashes", *numbers])

    out = rows.transform(in_arrow, run, ", ".join(["bucket long, hashes binary", *[f"{c} binary" for c in numbers]]))
    return _dealt(out, "bucket", buckets)


def _dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """Rows by key over as many partitions as the number of groups asks for, four groups each, so that more data means more tasks."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 4), key)


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of bitmaps as rows of eight words."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, 8)
    return np.asarray(column)


def _buckets(rows: DataFrame, blob: str) -> int:
    total = rows.agg(F.sum(F.octet_length(blob))).first()[0] or 0
    return max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // 8 // 500_000)


def _entries(table: pa.Table, numbers: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A bucket's distinct entries, sorted by hash and first number."""
    read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind)
    h = read("hashes", np.uint64)
    columns = [read(c, np.uint64).reshape(-1, 8) if c == "bits" else read(c, np.int64) for c in numbers]
    order = np.lexsort((columns[0], h))
    h, columns = h[order], [c[order] for c in columns]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (columns[0][1:] != columns[0][:-1])
    return h[new], [c[new] for c in columns]


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted hashes: where each run begins, and each entry's run length."""
    begin = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.concatenate([begin, [len(h)]]))
    return begin, np.repeat(length, length)


def survivors(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with at least ``least_shared`` prefix hashes that other classes have in their prefixes too: ``s1, s2, n, rep``."""

    def shared(table: pa.Table) -> pa.Table:
        h, (sid,) = _entries(table, ["s1"])
        _, length = _runs(h)
        sid, count = np.unique(sid[length > 1], return_counts=True)
        return pa.table([pa.array(sid), pa.array(count)], names=["s1", "shared"])

    spread = _spread(signed.where("n > 0").select("s1", "prefix"), "prefix", _buckets(signed, "prefix"), ["s1"])
    counts = spread.groupBy("bucket").applyInArrow(shared, "s1 long, shared long").groupBy("s1").agg(F.sum("shared").alias("shared"))
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * PERCENT / 100) / 10))
    return classes.join(counts, "s1").where(F.col("shared") >= least).select("s1", "s2", "n", "rep", "first")


def survivor_sets(docs: DataFrame, alive: DataFrame, signed: DataFrame) -> DataFrame:
    """``s1, n, bits, hashes``: whole sets of surviving classes, one each, from the text of one of its rows (``rep``: that row's key).

    Texts stay where they are: marked rows are read as sets there, and the sets of other rows drop out by an exact join. Of rows
    that repeat id and text one set is left; only these are shuffled for that.
    """

    def run(batches):
        for batch in batches:
            for part, data, at in parts(batch):
                sets = shingle_sets(data, at, WIDTH)
                s1 = np.fromiter((mix(s).sum(dtype=np.uint64) for s in sets), dtype=np.uint64, count=len(sets))
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), _long(s1), n, _blobs([bitmap(s) for s in sets]), _blobs(sets)], ["rep", "s1", "n", "bits", "hashes"])

    seen = marked(docs.select(row_key().alias("rep"), text_of().alias("text")), F.col("rep"), alive.select("rep"), "wanted").where("wanted")
    found = seen.select("rep", "text").transform(in_arrow, run, "rep long, s1 long, n long, bits binary, hashes binary")
    own = found.join(bounded(alive.select("rep", "s1", "n")), ["rep", "s1", "n"])
    times = signed.groupBy(F.col("row").alias("rep")).agg(F.count("*").alias("times")).where("times > 1")
    repeated = materialize(times.join(alive.select("rep"), "rep", "left_semi"), "repeated-rows")
    if repeated.isEmpty():
        return own.select("s1", "n", "bits", "hashes")
    marked_own = own.join(bounded(repeated), "rep", "left")
    several = marked_own.where("times IS NOT NULL").groupBy("rep", "s1", "n").agg(F.first("bits").alias("bits"), F.first("hashes").alias("hashes"))
    return marked_own.where("times IS NULL").select("s1", "n", "bits", "hashes").unionByName(several.select("s1", "n", "bits", "hashes"))


def rare_prefixes(sets: DataFrame) -> DataFrame:
    """``s1, n, bits, prefix, lengths``: of the n - T + 1 shingles rarest among the sets, those that more than one set has, and how many have them."""
    groups = _buckets(sets, "hashes")

    def lists(table: pa.Table) -> pa.Table:
        """The bucket's entries of lists of two and more, sent back by groups of sets."""
        h, (sid, n) = _entries(table, ["s1", "n"])
        _, length = _runs(h)
        many = length > 1
        columns = [sid[many], n[many], h[many], length[many]]
        group = (mix(columns[0].view(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, columns = group[order], [c[order] for c in columns]
        begin, _ = _runs(group)
        cut = list(zip(begin.tolist(), [*begin[1:].tolist(), len(group)], strict=False))
        return pa.table([pa.array(group[begin]), *[_blobs([c[a:b] for a, b in cut]) for c in columns]], names=["group", "s1", "n", "hashes", "lengths"])

    def choose(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind)
        sid, n, h, length = read("s1", np.int64), read("n", np.int64), read("hashes", np.uint64), read("lengths", np.int64)
        order = np.lexsort((h, length, sid))
        sid, n, h, length = sid[order], n[order], h[order], length[order]
        begin, many = _runs(sid)
        # shingles of no other set come first; a set of which too few are shared links with nothing
        many, size = many[begin], n[begin]
        need = np.where(many >= least_overlap(size), many - least_overlap(size) + 1, 0)
        keep = np.nonzero(need > 0)[0]
        cut = [(begin[k], begin[k] + need[k]) for k in keep]
        return pa.table([pa.array(sid[begin[keep]]), pa.array(size[keep]), _blobs([h[a:b] for a, b in cut]), _blobs([length[a:b] for a, b in cut])], names=["s1", "n", "prefix", "lengths"])

    spread = _spread(sets.select("s1", "n", "hashes"), "hashes", groups, ["s1", "n"])
    found = _dealt(spread.groupBy("bucket").applyInArrow(lists, "group long, s1 binary, n binary, hashes binary, lengths binary"), "group", groups)
    chosen = found.groupBy("group").applyInArrow(choose, "s1 long, n long, prefix binary, lengths binary")
    return chosen.join(sets.select("s1", "bits").dropDuplicates(["s1"]), "s1").select("s1", "n", "bits", "prefix", "lengths")


def long_lists(rows: DataFrame, split: int) -> DataFrame:
    """``list, low, high``: lists of over ``split`` sets with their least and greatest component; partial results leave each task."""

    def run(batches):
        for batch in batches:
            read = lambda c, kind: [np.frombuffer(b, dtype=kind) for b in batch.column(batch.schema.get_field_index(c)).to_pylist()]
            h, length = read("prefix", np.int64), read("lengths", np.int64)
            comp = np.repeat(np.asarray(batch.column(batch.schema.get_field_index("comp"))), list(map(len, h)))
            h, length = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (h, length))
            of = np.nonzero(length > split)[0]
            order = of[np.lexsort((comp[of], h[of]))]
            begin, _ = _runs(h[order])
            last = np.concatenate([begin[1:], [len(order)]])[: len(begin)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(h[order][begin]), pa.array(comp[order][begin]), pa.array(comp[order][last])], ["list", "low", "high"])

    found = rows.select("prefix", "lengths", "comp").transform(in_arrow, run, "list long, low long, high long")
    return found.groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _pairs(rows: DataFrame, step: str, closed: frozenset = frozenset(), split: int = SPLIT) -> DataFrame:
    """Sets that have to meet, as pairs ``a, b``, each once: they share a short list and may link by sizes and bitmaps.

    ``heads``: of each component in a list one set, with the nearest of these. ``near``: in lists of several components, each
    set with the nearest of another component. ``rest``: in such lists, all pairs across components. Of long lists, ``heads``
    looks at pieces alone; ``near`` and ``rest`` look at every two pieces together, so nothing is lost. ``heads`` and ``near`` only save work for ``rest``.
    """
    numbers = {"heads": ["comp", "s1", "n", "bits"]}.get(step, ["s1", "n", "bits", "comp"])

    def find(table: pa.Table) -> pa.Table:
        h, columns = _entries(table, numbers)
        at = dict(zip(numbers, columns, strict=True))
        order = np.lexsort((at["s1"], at["n"], h))
        h, (sid, n, bits) = h[order], (at[c][order] for c in ("s1", "n", "bits"))
        comp = at["comp"][order]
        begin, _ = _runs(h)
        pairs = set()

        def add(k: int, others: np.ndarray, nearest: bool) -> None:
            if len(others):
                fit, apart = may_link(bits[k], n[k], bits[others], n[others])
                others, apart = others[fit], apart[fit]
                if nearest and len(others):
                    others = others[[apart.argmin()]]
                pairs.update((int(min(sid[k], sid[o])), int(max(sid[k], sid[o]))) for o in others)

        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(h)], strict=False):
            if step == "heads":  # by windows of like sizes, so that the work stays linear
                for low in range(a, b, split):
                    high = min(b, low + split)
                    for k in range(low, high):
                        add(k, np.delete(np.arange(low, high), k - low), True)
            elif (comp[a:b] != comp[a]).any():
                for k in range(a, b):
                    first = a if step == "near" else k + 1
                    add(k, np.nonzero(comp[first:b] != comp[k])[0] + first, step == "near")
        ab = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        return pa.table([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    spread = _spread(rows.select("prefix", "lengths", *numbers), "prefix", _buckets(rows, "prefix"), numbers, step, closed, split if step != "heads" else 1 << 62)
    return spread.groupBy("bucket").applyInArrow(find, "a long, b long").distinct()


class Lists:
    """Inverted lists over the sets of a block: for every shingle the places, ascending, of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        h = np.concatenate([np.zeros(0, dtype=np.uint64), *sets])
        order = np.argsort(h, kind="stable")
        h, self.places = h[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.begin, _ = _runs(h)
        self.shingles, self.end = h[self.begin], np.concatenate([self.begin[1:], [len(h)]])[: len(self.begin)]

    def of(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of a query's shingles, shortest first."""
        if not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        at = at[np.argsort(self.end[at] - self.begin[at], kind="stable")]
        return [self.places[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]


def divide_skip(query: np.ndarray, lists: Lists, weight: float = 0.0085, seen: dict | None = None) -> list[int]:
    """T-occurrence search over inverted lists: the places of the sets that link with the query's.

    Any such set is in at least T of the query's lists. The lists are divided: of the longest, L < T are left out (as many as
    ``weight`` makes worthwhile for their length). What links is in T - L or more of the short ones, which a heap merges in
    order of place; only for such sets are the long lists probed, by binary search, until a set has the overlap that its size
    needs or can no longer reach it. ``seen`` counts entries merged, lists skipped and probes.
    """
    found = lists.of(query)
    least = int(least_overlap(len(query)))
    if not len(query) or len(found) < least:
        return []
    skip = min(least - 1, int(least / (weight * log2(max(2, len(found[-1]))) + 1)))
    short, long = [x.tolist() for x in found[: len(found) - skip]], found[len(found) - skip :]
    out, probes = [], 0
    heap = [(places[0], k, 0) for k, places in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        place, count = heap[0][0], 0
        while heap and heap[0][0] == place:
            _, k, at = heap[0]
            count += 1
            if at + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if count < least - skip:
            continue
        need, left = int(pair_overlap(len(query), lists.sizes[place])), len(long)
        for probe in long:
            if count >= need or count + left < need:
                break
            k = bisect_left(probe, place)
            count += int(k < len(probe) and probe[k] == place)
            left -= 1
            probes += 1
        if count >= need:
            out.append(place)
    if seen is not None:
        for name, n in (("merged", sum(map(len, short))), ("skipped", len(long)), ("probes", probes), ("longest", len(found[-1]))):
            seen[name] = max(seen.get(name, 0), n) if name == "longest" else seen.get(name, 0) + n
    return out


def stars(sets: list[np.ndarray], seen: dict | None = None) -> list[tuple[int, int]]:
    """Links of a block, found from its inverted lists: the smallest set that no other has found yet is the next query.

    Sets that a query finds are not queries themselves, so a group of near copies costs one search. What they alone would have
    found is left to later steps, which look at lists of several components.
    """
    lists, out = Lists(sets), []
    free = np.ones(len(sets), dtype=bool)
    for k in np.argsort(lists.sizes, kind="stable").tolist():
        if free[k]:
            free[k] = False
            for place in divide_skip(sets[k], lists, seen=seen):
                if place != k:
                    free[place] = False
                    out.append((k, place))
    return out


def _meeting_places(lists: DataFrame, most: int) -> DataFrame:
    """``s1, place``: where a set stands in the first search: at the one of its rare shingles that most sets have (ties: the smallest
    hash), or at a piece of it if over ``most`` have it."""

    def run(batches):
        for batch in batches:
            read = lambda c, kind: [np.frombuffer(b, dtype=kind) for b in batch.column(batch.schema.get_field_index(c)).to_pylist()]
            sid, places = np.asarray(batch.column(0)), []
            for s, h, length in zip(sid.tolist(), read("prefix", np.uint64), read("lengths", np.int64), strict=True):
                k = np.lexsort((h, -length))[0]
                pieces = -(-int(length[k]) // most)
                piece = int(mix(np.array([s], dtype=np.int64).view(np.uint64))[0] % np.uint64(pieces))
                places.append(int(mix(h[k : k + 1] ^ mix(np.array([piece], dtype=np.uint64))).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64())], ["s1", "place"])

    return lists.where(F.octet_length("prefix") > 0).select("s1", "prefix", "lengths").transform(in_arrow, run, "s1 long, place long")


def first_links(lists: DataFrame, sets: DataFrame, most: int = BLOCK) -> DataFrame:
    """``a, b``: links found by T-occurrence search within the blocks of sets that stand at one place (some may be found later only)."""

    def search(table: pa.Table) -> pa.Table:
        blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
        for place, s, h in zip(*(table.column(x).to_pylist() for x in ("place", "s1", "hashes")), strict=True):
            blocks.setdefault(place, []).append((s, np.frombuffer(h, dtype=np.uint64)))
        found = [(b[i][0], b[j][0]) for b in blocks.values() if len(b) > 1 for i, j in stars([h for _, h in b])]
        return pa.table([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    at = materialize(_meeting_places(lists, most), "places")
    several = at.groupBy("place").agg(F.count("*").alias("sets")).where("sets > 1").select("place")
    met = at.join(bounded(materialize(several, "shared-places")), "place").join(sets.select("s1", "hashes"), "s1")
    size = sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    groups = max(2 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size) // 16_000_000)
    dealt = _dealt(met.select("place", "s1", "hashes").withColumn("group", F.pmod("place", F.lit(groups))), "group", groups)
    return dealt.groupBy("group").applyInArrow(search, "a long, b long").distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, found by ``divide_skip`` in blocks: a query and up to about CHUNK of the sets it has to meet."""
    # sets of a query fall into as many blocks as their number asks for
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    sizes = materialize(sizes, "queries")
    large = bounded(sizes.where("chunks > 1"))
    chunk = F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1)))).cast("int")
    salted = pairs.join(large, "a", "left").withColumn("chunk", chunk)
    asked = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    one = salted.select("a", "chunk", "b").join(sets.select(F.col("s1").alias("b"), "hashes"), "b").select("a", "chunk", "b", "hashes")
    query = asked.join(sets.select(F.col("s1").alias("a"), "hashes"), "a").select("a", F.col("chunk").cast("int"), F.lit(None).cast("long").alias("b"), "hashes")

    def search(table: pa.Table) -> pa.Table:
        blocks: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        queries: dict[tuple[int, int], np.ndarray] = {}
        for a, c, b, h in zip(*(table.column(x).to_pylist() for x in ("a", "chunk", "b", "hashes")), strict=True):
            if b is None:
                queries[a, c] = np.frombuffer(h, dtype=np.uint64)
            else:
                blocks.setdefault((a, c), {})[b] = np.frombuffer(h, dtype=np.uint64)
        found = []
        for key, block in blocks.items():
            names = list(block)
            found += [(key[0], names[k]) for k in divide_skip(queries[key], Lists(list(block.values())))]
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    total = sets.agg(F.avg(F.octet_length("hashes"))).first()[0] or 1
    groups = max(2 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs.count() * total) // 16_000_000)
    blocks = one.unionByName(query).withColumn("group", F.pmod(F.xxhash64("a", "chunk"), F.lit(groups)))
    return _dealt(blocks, "group", groups).groupBy("group").applyInArrow(search, "a long, b long")


def components(links: DataFrame, label: str = "comp") -> DataFrame:
    """``s1`` and the least id of its component, for all ends of links: least labels of neighbours, with pointer jumping."""
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("l")).select("v", "l"), "labels")
    while True:
        known = bounded(labels)
        near = both.join(known.select(F.col("v").alias("u"), F.col("l").alias("m")), "u").groupBy("v").agg(F.min("m").alias("m"))
        least = known.join(near, "v").select("v", F.least("l", "m").alias("m"), "l")
        jumped = least.join(known.select(F.col("v").alias("m"), F.col("l").alias("j")), "m").select("v", F.least("m", "j").alias("new"), "l")
        step = materialize(jumped, "labels")
        moved = step.where("new <> l").isEmpty()
        labels = step.select("v", F.col("new").alias("l"))
        if moved:
            return labels.select(F.col("v").alias("s1"), F.col("l").alias(label))


def all_links(sets: DataFrame, split: int = SPLIT) -> DataFrame:
    """``s1, comp``: the components of all links between sets, for those that have any."""
    lists = materialize(rare_prefixes(sets), "lists")
    links = materialize(first_links(lists, sets, min(BLOCK, split)), "links")
    comps = components(links)
    for step in ("heads", "near", "rest"):
        labelled = materialize(lists.join(bounded(comps), "s1", "left").withColumn("comp", F.coalesce("comp", "s1")), "lists")
        known = materialize(long_lists(labelled, split), "long-lists")
        if step == "heads" and known.isEmpty():
            continue
        # a long list of one component has nothing more to give; so many long lists at most are named in the tasks
        done = known.where("low = high").select("list").limit(BROADCAST_ROWS).collect()
        more = materialize(_pairs(labelled, step, frozenset(r["list"] for r in done), split), "pairs")
        if more.isEmpty():
            if step == "heads":
                continue
            break
        links = links.unionByName(materialize(_links(more, sets), "links"))
        comps = components(links)
    return comps


def grouped_documents(docs: DataFrame, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and for the classes of components with several rows: ``s1, s2, n, comp, first`` (its smallest id)."""
    signed = materialize(signatures(docs), "signatures")
    classes = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("docs"))
    classes = materialize(classes, "classes")
    alive = materialize(survivors(signed, classes), "survivors")
    comps = all_links(materialize(survivor_sets(docs, alive, signed), "sets"), split)
    linked = comps.join(alive.select("s1", "s2", "n", "first"), "s1")
    smallest = linked.groupBy("comp").agg(F.min("first").alias("smallest"))
    linked = linked.join(smallest, "comp").select("s1", "s2", "n", "comp", "smallest")
    known = classes.join(linked, ["s1", "s2", "n"], "left").where(F.col("comp").isNotNull() | (F.col("docs") > 1))
    first = F.when(F.col("comp").isNull(), F.col("first")).otherwise(F.col("smallest"))
    return signed, materialize(known.select("s1", "s2", "n", F.coalesce("comp", "s1").alias("comp"), first.alias("first")), "components")


def similar_documents(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, for shingles of five words and a similarity of 0.8.

    Texts with fewer words have their whole sequence as one shingle; texts without words (null too) have none, link with
    nothing and are components of their own. Documents with equal sets are linked. Rows of a repeated id are kept each. A row
    with a null id links as any other, but its id names no component; a component without any id has null. Ids of any whole
    type come back as long, other columns play no part. An empty table gives no rows.
    """
    signed, known = grouped_documents(docs, split)
    out = signed.select("doc_id", "n", "s1", "s2").join(bounded(known.withColumn("found", F.lit(True))), ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("found"), F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest id, a null id after all others.

    Of several rows with that id, the one of the fewest shingles stays, then by the text's key, then the first in the order of
    all columns. Texts without words all stay. Rows that cannot be among those to go pass without a shuffle of their texts.
    """
    signed, known = grouped_documents(docs)
    members = signed.join(bounded(known.select("s1", "s2", "n", "comp")), ["s1", "s2", "n"]).select("comp", "doc_id", "n", "row")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "n", "row")
    best = materialize(members.groupBy("comp").agg(F.min(order).alias("best")), "best")
    stays = F.col("row") == F.col("best.row")
    counted = members.join(bounded(best), "comp").groupBy("row", "doc_id").agg(F.max(stays).alias("stays"), F.count("*").alias("n"))
    suspects = materialize(counted.where("NOT stays OR n > 1").select("row", "doc_id", "stays"), "suspects")
    row, mark, of, of_id, stays, nth = fresh(docs, "row", "suspect", "of", "of_id", "stays", "nth")
    seen = marked(docs.withColumn(row, row_key()), F.col(row), suspects.select("row"), mark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = suspects.select(F.col("row").alias(of), F.col("doc_id").alias(of_id), F.col("stays").alias(stays))
    at = (F.col(row) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of_id))
    looked = seen.where(F.col(mark)).join(bounded(found), at, "left")
    kept = seen.where(~F.col(mark)).select(*columns).unionByName(looked.where(F.col(stays).isNull()).select(*columns))
    if suspects.where("stays").isEmpty():
        return kept
    alike = Window.partitionBy(row, "doc_id").orderBy(F.to_json(F.struct(*columns)))
    first = looked.where(F.col(stays)).withColumn(nth, F.row_number().over(alike)).where(F.col(nth) == 1)
    return kept.unionByName(first.select(*columns))
