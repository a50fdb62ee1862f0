"""Spelling variants: words one edit apart, found by scanning sorted word lists with rows of an edit matrix that neighbours share.

1. ``spellings``: the vocabulary, counted over all texts with partial sums before the shuffle.
2. ``placed``: words one edit apart agree before the edit and after it. For a shorter word of ``size`` code points the edit lies in
   one of two windows of places, so both words stand in one list: that of the window, what is before it and what is after it.
   A list of over ``limit`` words is dealt anew by two halves of its window, until windows of one place leave lists that the
   alphabet bounds. Nothing is dropped, and no list depends on how many rows repeat a word.
3. ``one_edit_apart``: within a list, sorted so that what all share comes first, each word scans those after it. A row of the
   banded edit matrix belongs to a prefix, so the next word takes up the rows of the prefix that it shares with the last one
   (their LCP); a prefix whose row is over one edit throughout ends all words that begin with it, and the scan goes on behind them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_of, materialize

#: Letters of words, and those that are put in lower case.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a list beyond which its window is halved, and list entries of a task's group.
LIST_WORDS, GROUP_ROWS = 512, 20_000


def slips(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id slips nowhere."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.coalesce(h % every == 0, F.lit(False)), cut).otherwise(run)


def spellings(docs: DataFrame, shortest: int = 7, least: int = 2, every: int | None = 31) -> DataFrame:
    """``word, n``: words of at least ``shortest`` code points that occur at least ``least`` times; ``every``: see ``slips``."""
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    said = docs.select(id_of(), F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run") if every is None else slips(F.col("doc_id"), F.col("run"), every)
    words = said.select(word.alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: of the size, the window and what a word has before and after it (two lists that fall on one key are told apart later)."""
    after = F.col("size") - F.col("hi")
    tail = F.substring("word", F.char_length("word") - after + 1, after)
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), tail))


def placed(words: DataFrame, shortest: int, limit: int = LIST_WORDS) -> DataFrame:
    """``key, word, n, size, lo, hi``: the lists of each word, as one of ``size`` code points and as one of a code point more."""
    whole = words.select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("size")).where(F.col("size") >= shortest)
    half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")

    def halved(rows: DataFrame) -> DataFrame:
        windows = F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi").alias("hi")))
        return _keyed(rows.withColumn("w", F.explode(windows)).select("word", "n", "size", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")))

    rows, done = materialize(halved(whole.withColumn("lo", F.lit(0)).withColumn("hi", F.col("size"))), "word-lists"), None
    while True:
        counts = rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("words"))
        large = materialize(counts.where(F.col("words") > limit).select("key"), "long-word-lists")
        last = large.isEmpty()
        settled = rows if last else rows.join(bounded(large), "key", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        again = rows.where("hi - lo > 1").join(bounded(large), "key", "left_semi")
        # lists of one place that share a key with a large one are bounded and stay as they are
        done = done.unionByName(rows.where("hi - lo <= 1").join(bounded(large), "key", "left_semi"))
        rows = materialize(halved(again), "word-lists")


def shared_prefixes(words: list[str]) -> list[int]:
    """For sorted words, how many code points each has in common with the one before it."""
    out = [0] * len(words)
    for k in range(1, len(words)):
        a, b, d = words[k - 1], words[k], 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            d += 1
        out[k] = d
    return out


def one_edit_apart(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j), i < j, of all words of a sorted list without repeats that differ by exactly one edit.

    A row has the edit distances of a prefix of d code points to the first d - 1, d and d + 1 of the query: all that can be
    within one edit. Words that share a prefix with the query itself have the row 1, 0, 1 there.
    """
    lcp = shared_prefixes(words)
    n = len(words)
    for i in range(n - 1):
        q = words[i]
        m, query = len(q), q + "\0\0\0"
        j = i + 1
        known = lcp[j]
        rows = [(1, 0, 1)] * (known + 1)
        while j < n:
            v = words[j]
            size, d = len(v), known
            a, b, c = rows[d]
            alive = True
            while d < size:
                ch, pa_, pb, pc = v[d], a, b, c
                a = min(pb + 1, pa_ + (ch != query[d - 1])) if d else 1
                b = min(pb + (ch != query[d]), pc + 1, a + 1)
                c = min(pc + (ch != query[d + 1]), b + 1) if d < m else 2
                d += 1
                if d < len(rows):
                    rows[d] = (a, b, c)
                else:
                    rows.append((a, b, c))
                if a > 1 and b > 1 and c > 1:
                    alive = False
                    break
                if d > m + 1:
                    alive = False
                    break
            if alive:
                if -1 <= m - size <= 1 and (a, b, c)[m - size + 1] == 1:
                    yield i, j
                j += 1
                known = lcp[j] if j < n else 0
                continue
            # the prefix v[:d] is over one edit; behind it only a code point that matches can keep the row before it within one
            a, b, c = rows[d - 1]
            nxt = None
            if a and b and c:
                at = d - 1
                fit = [query[k] for k, cell in ((at - 1, a), (at, b), (at + 1, c)) if cell == 1 and 0 <= k < m and query[k] > v[at]]
                nxt = v[:at] + (min(fit) if fit else "\U0010ffff")
            else:
                nxt = v[:d] + "\U0010ffff"
            k = bisect_left(words, nxt, j + 1)
            known = min(lcp[j + 1 : k + 1]) if k < n else 0
            j = k


def _search(shortest: int):
    """Near pairs of the lists of a group; each pair is given by the window that holds the first place where its words differ."""

    def run(table: pa.Table) -> pa.Table:
        lists: dict[tuple, dict[str, int]] = defaultdict(dict)
        for word, n, size, lo, hi in zip(*(table.column(c).to_pylist() for c in ("word", "n", "size", "lo", "hi")), strict=True):
            lists[size, lo, hi, word[:lo], word[len(word) - (size - hi) :]][word] = n
        out: list[tuple] = []
        for (size, lo, hi, head, tail), counts in lists.items():
            if len(counts) < 2:
                continue
            back = len(tail) > len(head)
            words = sorted(w[::-1] for w in counts) if back else sorted(counts)
            for i, j in one_edit_apart(words):
                a, b = (words[i][::-1], words[j][::-1]) if back else (words[i], words[j])
                if min(len(a), len(b)) != size:
                    continue
                at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), size)
                if lo <= at < hi or at == hi == size:
                    out.append((a, counts[a], b, counts[b]))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["a", "a_n", "b", "b_n"])

    return run


def near_words(words: DataFrame, shortest: int, limit: int = LIST_WORDS) -> DataFrame:
    """``word, n, near, near_n`` of all words one edit apart, both ways round."""
    lists = materialize(placed(words, shortest, limit), "placed-words")
    groups = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), lists.count() // GROUP_ROWS)
    dealt = lists.withColumn("group", F.pmod("key", F.lit(groups))).drop("key").repartition(groups, "group")
    pairs = materialize(dealt.groupBy("group").applyInArrow(_search(shortest), "a string, a_n long, b string, b_n long"), "near-words")
    ahead = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    return ahead.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the last word that forms lead to. Counts grow tenfold a step, so a few rounds of jumps do."""
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(reach.join(bounded(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "word-roots")
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reach


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, every: int | None = 31, limit: int = LIST_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``shortest`` letters and ``least`` occurrences.

    Words are maximal runs of letters in whole texts, A-Z in lower case; ``every`` plants slips (see ``slips``; None: none). A
    word's ``form`` is the most frequent of the words one edit apart (ties: the smallest in code-point order) if it occurs at
    least ``ratio`` times as often, else null. Null and empty texts have no words, repeated rows count each, a row with a null
    id counts without slips; other columns play no part. An empty table gives no rows.
    """
    words = materialize(spellings(docs, shortest, least, every), "spellings")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near"))).alias("best")
    around = near_words(words, shortest, limit).groupBy("word").agg(F.count("*").alias("n_near"), best)
    out = words.join(around, "word", "left").withColumn("fits", F.coalesce(-F.col("best.order") >= ratio * F.col("n"), F.lit(False)))
    form = F.when(F.col("fits"), F.col("best.near")).alias("form")
    known = materialize(out.select("word", form, "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("fits"), -F.col("best.order")).alias("form_n")), "variants")
    ends = roots(materialize(known.where("form IS NOT NULL").select("word", "form"), "forms"))
    return known.join(bounded(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
