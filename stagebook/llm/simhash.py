"""SimHash near duplicates: fingerprints that differ in few bits meet at anchors, the words of a covering code.

The code is a product of perfect codes over the 64 bits: two binary Golay codes (23 bits, radius 3) and two repetition codes (9
bits, radius 4), 2^26 words with a covering radius of 14. Every fingerprint has one home, the word nearest to it in every part.
If x has its home at c, a fingerprint y within ``distance`` of x lies within radius plus ``distance`` of c, and, part by part,
exceeds the radii by no more than ``distance`` in all. So y is replicated to all words that it exceeds so little (some 71 for
two bits), and at every anchor the fingerprints at home are compared with all that came there: no link is lost.

Equal fingerprints are one from the start. An anchor that is home to more than ``limit`` fingerprints would be too much for one
task; what came there goes to finer anchors instead, where every word of 64 bits is one: fingerprints two bits apart have a word
between them that is one bit from both, so each goes to itself and its 64 neighbours, and at most 65 meet at any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_of, in_arrow, marked, materialize, text_of
from .similarity import components

WIDTH, SEED, DISTANCE = 3, 42, 2
#: Fingerprints at home at an anchor at most, and entries of a task that compares them.
AT_HOME, TASK_ENTRIES = 512, 4_000_000


def fingerprint(text: str | None) -> int:
    """64 bits, each 1 if it is set in over half the hashes (XXH64) of the text's shingles, repeats included; without words 0."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and white space as \\x20\\x09-\\x0D
    if len(words) < WIDTH:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 65_536):
        votes += np.unpackbits(h[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h), bitorder="little").tobytes(), "little")


class Part:
    """A perfect linear code over ``length`` of the 64 bits from ``shift`` on, by the syndromes of its single bits.

    A fingerprint's part lies at a distance of w from a code word for every error pattern of weight w that has its syndrome.
    Patterns are listed by syndrome and excess, what their weight has over the radius (0 for the nearest word, of which there
    is one).
    """

    def __init__(self, length: int, shift: int, radius: int, syndromes: list[int], most: int) -> None:
        self.length, self.shift = length, shift
        self.low, self.high = self._table(syndromes[:12]), self._table(syndromes[12:])
        patterns, excess, of = [], [], []
        for weight in range(radius + most + 1):
            for bits in combinations(range(length), weight):
                patterns.append(sum(1 << b for b in bits))
                excess.append(max(0, weight - radius))
                of.append(self._xor(syndromes[b] for b in bits))
        patterns, excess, of = (np.array(x, dtype=np.int64) for x in (patterns, excess, of))
        self.at, self.masks = [], []
        for e in range(most + 1):
            keep = np.nonzero(excess == e)[0]
            keep = keep[np.argsort(of[keep], kind="stable")]
            self.at.append(np.searchsorted(of[keep], np.arange((1 << max(s.bit_length() for s in syndromes)) + 1)))
            self.masks.append(patterns[keep].astype(np.uint64) << np.uint64(shift))

    @staticmethod
    def _xor(values) -> int:
        out = 0
        for v in values:
            out ^= v
        return out

    @staticmethod
    def _table(syndromes: list[int]) -> np.ndarray:
        table = np.zeros(1, dtype=np.int64)
        for s in syndromes:
            table = np.concatenate([table, table ^ s])
        return table

    def syndromes(self, prints: np.ndarray) -> np.ndarray:
        y = ((prints >> np.uint64(self.shift)) & np.uint64((1 << self.length) - 1)).astype(np.int64)
        return self.low[y & 0xFFF] ^ self.high[y >> 12]

    def reach(self, syndrome: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """For rows of syndromes: the row of each pattern of this excess, and the pattern."""
        begin, end = self.at[excess][syndrome], self.at[excess][syndrome + 1]
        row = np.repeat(np.arange(len(syndrome)), end - begin)
        place = np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[row]
        return row, self.masks[excess][place]


#: Fixed value: the Golay code's generator, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


@cache
def covering_code(most: int = DISTANCE) -> tuple[Part, ...]:
    golay, s = [], 1
    for _ in range(23):
        golay.append(s)
        s = s << 1 ^ (GOLAY if s >> 10 & 1 else 0)
    repetition = [0xFF, *(1 << k for k in range(8))]
    return (Part(23, 0, 3, golay, most), Part(23, 23, 3, golay, most), Part(9, 46, 4, repetition, most), Part(9, 55, 4, repetition, most))


def homes(prints: np.ndarray) -> np.ndarray:
    """The code word nearest to each fingerprint."""
    out = prints.copy()
    for part in covering_code():
        out ^= part.reach(part.syndromes(prints), 0)[1]
    return out


def anchors(prints: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """The row of each anchor of the fingerprints, and the anchor: all code words that exceed the radii by ``most`` in all, without the homes."""
    parts, home = covering_code(), homes(prints)
    syndromes = [p.syndromes(prints) for p in parts]
    rows, words = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    # from the home's own error pattern of a part to another one of the same part
    change = [[(row, mask ^ p.reach(s, 0)[1][row]) for row, mask in (p.reach(s, e) for e in range(1, most + 1))] for p, s in zip(parts, syndromes, strict=True)]
    for one in change:
        for row, mask in one:
            rows.append(row)
            words.append(home[row] ^ mask)
    for k, l in combinations(range(len(parts)), 2) if most > 1 else ():
        row, mask = change[k][0]
        other, more = change[l][0]
        begin = np.searchsorted(other, np.arange(len(prints) + 1))
        n = (begin[1:] - begin[:-1])[row]
        pair = np.repeat(np.arange(len(row)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + begin[row[pair]]
        rows.append(row[pair])
        words.append(home[row[pair]] ^ mask[pair] ^ more[place])
    return np.concatenate(rows), np.concatenate(words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _unsigned(column: pa.Array) -> np.ndarray:
    return np.asarray(column).view(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (the 64 bits as a long) of whole texts; null counts as empty."""

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(prints)], ["doc_id", "print"])

    return docs.select(id_of(), text_of().alias("text")).transform(in_arrow, run, "doc_id long, print long")


def _at_home(prints: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(homes(_unsigned(batch.column(0))))], ["print", "anchor"])

    return prints.select("print").transform(in_arrow, run, "print long, anchor long")


def _visits(prints: DataFrame, most: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            all_prints = _unsigned(batch.column(0))
            for a in range(0, len(all_prints), 1_000):
                prints = all_prints[a : a + 1_000]
                row, words = anchors(prints, most)
                yield pa.RecordBatch.from_arrays([_signed(prints[row]), _signed(words)], ["print", "anchor"])

    return prints.select("print").transform(in_arrow, run, "print long, anchor long")


def _between(prints: DataFrame) -> DataFrame:
    """Each fingerprint at itself and at its 64 neighbours."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))
    flips = F.concat(F.array(F.lit(0).cast("long")), flips)
    return prints.select("print", F.explode(F.transform(flips, lambda m: F.col("print").bitwiseXOR(m))).alias("anchor"), F.lit(True).alias("home"))


def compared(entries: DataFrame, most: int, rows: int) -> DataFrame:
    """``a, b``: fingerprints at home at an anchor, and those there that differ from them in at most ``most`` bits.

    Entries stream by, sorted by anchor and those at home first; only these are held, for one anchor at a time.
    """

    def run(batches):
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        for batch in batches:
            if not len(batch):
                continue
            old = len(held[0])
            anchor, seen = (np.concatenate([h, np.asarray(batch.column(k))]) for h, k in zip(held, (0, 1), strict=True))
            home = np.concatenate([np.ones(old, dtype=bool), np.asarray(batch.column(2))])
            begin = np.nonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))[0]
            run_of = np.repeat(np.arange(len(begin)), np.diff(np.concatenate([begin, [len(anchor)]])))
            at_home = np.add.reduceat(home.astype(np.int64), begin)
            place = np.arange(len(anchor))
            # one that is at home itself meets those before it, any other all that are at home
            n = np.where(home, place - begin[run_of], at_home[run_of])
            n[:old] = 0
            yield from _close(seen, begin[run_of], n, most)
            last = begin[-1]
            keep = slice(last, last + at_home[-1])
            held = (anchor[keep], seen[keep])

    # the partitions follow from the entries, and a partition is sorted outside Python, with spilling
    partitions = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ENTRIES)
    dealt = entries.select("anchor", "print", "home").repartition(partitions, "anchor").sortWithinPartitions("anchor", F.desc("home"))
    return dealt.transform(in_arrow, run, "a long, b long")


def _close(seen: np.ndarray, begin: np.ndarray, n: np.ndarray, most: int, chunk: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows k against the n[k] rows from begin[k] on, some at a time."""
    edges = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + chunk, chunk), side="left")
    edges = np.unique(np.concatenate([[0], edges, [len(n)]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        count = n[a:b]
        row = np.repeat(np.arange(a, b), count)
        other = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]
        near = np.bitwise_count((seen[row] ^ seen[other]).view(np.uint64)) <= most
        x, y = seen[row[near]], seen[other[near]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def linked_prints(prints: DataFrame, most: int = DISTANCE, limit: int = AT_HOME) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints (a materialised ``print``) that differ in at most ``most`` bits (two or fewer)."""
    if not 0 <= most <= DISTANCE:
        raise ValueError(f"distances over {DISTANCE} need another code")
    home = materialize(_at_home(prints), "anchors")
    occupied = materialize(home.groupBy("anchor").agg(F.count("*").alias("n")), "occupied")
    crowded = materialize(occupied.where(F.col("n") > limit).select("anchor"), "crowded")
    # most code words are nobody's home as long as fingerprints are fewer than words; visits there would be in vain
    visits = marked(_visits(prints, most), F.col("anchor"), occupied.select("anchor"), "lived_in").where("lived_in")
    entries = home.select("anchor", "print", F.lit(True).alias("home")).unionByName(visits.select("anchor", "print", F.lit(False).alias("home")))
    if crowded.isEmpty():
        entries = materialize(entries, "anchor-entries")
        return compared(entries, most, entries.count())
    entries = materialize(entries.join(bounded(crowded.withColumn("crowded", F.lit(True))), "anchor", "left"), "anchor-entries")
    calm = entries.where("crowded IS NULL")
    finer = materialize(entries.where("crowded").select("print").distinct(), "crowded-prints")
    return compared(calm, most, calm.count()).unionByName(compared(_between(finer), most, 65 * finer.count()))


def near_duplicates(docs: DataFrame, most: int = DISTANCE, limit: int = AT_HOME) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document; fingerprints link at ``most`` or fewer differing bits.

    Shingles are three words with A-Z in lower case, joined by a space; fewer words are one shingle, and a text without words
    (null too) has the fingerprint zero, which links like any other. Rows of a repeated id are kept each. A row with a null id
    links as any other, but its id names no component; a component without any id has null. Ids of any whole type come back
    as long, other columns play no part. An empty table gives no rows.
    """
    signed = materialize(fingerprints(docs), "fingerprints")
    prints = materialize(signed.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")), "prints")
    links = materialize(linked_prints(prints, most, limit).distinct(), "print-links")
    comps = components(links).select(F.col("s1").alias("print"), "comp").join(prints.select("print", "first"), "print")
    smallest = comps.groupBy("comp").agg(F.min("first").alias("smallest"))
    named = comps.join(smallest, "comp").select("print", F.col("smallest"), F.lit(True).alias("linked"))
    several = prints.join(named, "print", "left").where("linked OR docs > 1")
    known = materialize(several.select("print", F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("first")).alias("least"), F.lit(True).alias("found")), "print-components")
    out = signed.join(bounded(known), "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
