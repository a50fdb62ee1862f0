"""Byte-pair encoding of many short byte strings at once.

A word is a row of a matrix of live symbols. Over its byte positions stands a segment tree whose nodes hold the
smallest ``rank * width + position`` of the pairs below, so the root is the leftmost pair of minimum rank. A merge
changes the pairs at the merged position, at its live left neighbour and at the symbol that vanished; each is one
point update along a path of log2(width) nodes. All words of a width take their next merge together, in numpy.
Longer words (over 64 bytes) use the same tree one word at a time, so the cost stays n log n.
"""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field

import numpy as np
import regex

NO_PAIR = np.int32(2**31 - 1)
WIDEST = 64
#: Words whose matrices are held at once.
ROWS = 8_000
#: Entries of a generation of the cache of encoded units; two generations are kept (some 200 bytes an entry).
CACHE_ENTRIES = 100_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Ranks:
    """Merges as an open-addressed table from ``left << 32 | right`` to the rank; ``made``: the id by rank; ``start``: the ids of the 256 bytes; ``whole``: words with an id that merging does not reach."""

    pairs: dict[int, int]
    made: np.ndarray
    start: np.ndarray
    whole: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bits = max(8, (8 * len(self.pairs) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, dtype=np.int32)
        todo = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        rank, at = np.fromiter(self.pairs.values(), dtype=np.int32, count=len(self.pairs)), self._slot(todo)
        while len(todo):
            free = np.nonzero(self.keys[at] == -1)[0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = todo[won], rank[won]
            rest = np.ones(len(todo), dtype=bool)
            rest[won] = False
            todo, rank, at = todo[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, -1 where they do not merge (an id of -1 never does)."""
        key = (left << 32) | right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        got = self.keys[at]
        rank = np.where(got == key, self.values[at], -1)
        more = np.nonzero((got != key) & (got != -1))[0]
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[more]]
            hit = got == key[more]
            rank[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (got != -1)]
        return rank


def ranks_of_tiktoken(path: str) -> Ranks:
    """From a file of ``base64 rank`` lines: a pair may merge if its bytes together have a rank."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    ranks = _ranks(ids, [(a[:i], a[i:], n) for a, n in ids.items() for i in range(1, len(a)) if a[:i] in ids and a[i:] in ids])
    words = list(ids)
    flat, counts = encode_words(words, ranks)
    ends = np.cumsum(counts)
    ranks.whole = {w: ids[w] for w, n, e in zip(words, counts.tolist(), ends.tolist(), strict=True) if n != 1 or flat[e - 1] != ids[w]}
    return ranks


def ranks_of_json(path: str) -> Ranks:
    """From a byte-level BPE tokenizer file: its merges in their order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in byte_letters().items()}
    raw = lambda s: bytes(back[c] for c in s)
    ids = {raw(s): n for s, n in model["vocab"].items() if all(c in back for c in s)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return _ranks(ids, [(raw(a), raw(b), k) for k, (a, b) in enumerate(merges)])


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _ranks(ids: dict[bytes, int], merges: list[tuple[bytes, bytes, int]]) -> Ranks:
    made = np.full(max(k for *_, k in merges) + 1, -1)
    for a, b, k in merges:
        made[k] = ids[a + b]
    return Ranks({(ids[a] << 32) | ids[b]: k for a, b, k in merges}, made, np.array([ids[bytes([b])] for b in range(256)]))


def encode_words(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row (uint32) and how many each has: greedy merging by rank, leftmost first."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(length) - length
    raw = np.frombuffer(b"".join(words) + bytes(WIDEST), dtype=np.uint8)
    counts, done = np.zeros(len(words), dtype=np.int64), []
    odd = [k for k, w in enumerate(words) if w in ranks.whole] if ranks.whole else []
    width_of = np.where(length > WIDEST, 0, np.maximum(2, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)))
    width_of[odd] = 1
    for width in np.unique(width_of).tolist():
        of = np.nonzero(width_of == width)[0]
        if width < 2:
            for k in of.tolist():
                ids = np.array([ranks.whole[words[k]]], dtype="<u4") if width else _encode_long(words[k], ranks)
                counts[k] = len(ids)
                done.append((np.array([k]), ids))
            continue
        for lo in range(0, len(of), ROWS):
            part = of[lo : lo + ROWS]
            ids, counts[part] = _encode_width(raw, begin[part], length[part], width, ranks)
            done.append((part, ids))
    flat, place = np.empty(counts.sum(), dtype="<u4"), np.cumsum(counts) - counts
    for part, ids in done:
        n = counts[part]
        flat[np.repeat(place[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return flat, counts


def _encode_width(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Matrices have a further column of -1, which stands for no neighbour on either side (index ``width`` or -1)."""
    n, w1 = len(begin), width + 1
    at = np.arange(w1)
    live = at < length[:, None]
    symbol = np.where(live, ranks.start[raw[begin[:, None] + np.minimum(at, width - 1)]], -1)
    after = np.where(at + 1 < length[:, None], at + 1, width)
    before = np.broadcast_to(at - 1, (n, w1)).copy()
    tree = np.full((n, 2 * width), NO_PAIR)
    row, col = np.nonzero(live[:, 1:])
    rank = ranks.find(symbol[row, col], symbol[row, col + 1])
    tree[row, width + col] = np.where(rank >= 0, rank * width + col, NO_PAIR)
    level = width
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    live, symbol, after, before, tree = (x.reshape(-1) for x in (live, symbol, after, before, tree))

    rows = np.arange(n)
    root = tree[2 * width * rows + 1]
    while True:
        keep = root < NO_PAIR
        rows, root = rows[keep], root[keep].astype(np.int64)
        if not len(rows):
            break
        base, top = rows * w1, 2 * width * rows
        rank, here = np.divmod(root, width)
        gone = after[base + here]
        then = after[base + gone]
        symbol[base + here] = ranks.made[rank]
        after[base + here] = then
        before[base + then] = here
        live[base + gone] = False
        left = before[base + here]
        left = np.where(left < 0, width, left)
        mine, its = symbol[base + here], symbol[base + left]
        pair = ranks.find(np.concatenate([mine, its]), np.concatenate([symbol[base + then], mine]))
        leaf = np.concatenate([gone, here, np.where(left < width, left, gone)])
        value = np.where(pair >= 0, pair * width + np.concatenate([here, left]), NO_PAIR)
        node = np.concatenate([top, top, top]) + leaf + width
        tree[node] = np.concatenate([np.full(len(rows), NO_PAIR), value])
        tops, leaf = np.concatenate([top, top, top]), leaf + width
        for _ in range(width.bit_length() - 1):
            leaf >>= 1
            child = tops + 2 * leaf
            tree[tops + leaf] = np.minimum(tree[child], tree[child + 1])
        root = tree[top + 1]
    live = live.reshape(n, w1)
    return symbol.reshape(n, w1)[live].astype("<u4"), live.sum(axis=1)


def _encode_long(word: bytes, ranks: Ranks) -> np.ndarray:
    n = len(word)
    width = 1 << (n - 1).bit_length()
    none = 2**62
    symbol = ranks.start[np.frombuffer(word, dtype=np.uint8)]
    rank = ranks.find(symbol[:-1], symbol[1:]).astype(np.int64)
    leaves = np.full(width, none)
    leaves[: n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), none)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = np.concatenate([np.array([none]), *levels[::-1]]).tolist()
    made, symbol, after, before = ranks.made, symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def pair(left: int, right: int) -> int:
        found = ranks.pairs.get((symbol[left] << 32) | symbol[right])
        return none if found is None else found * width + left

    while tree[1] < none:
        here = tree[1] % width
        gone = after[here]
        symbol[here] = int(made[tree[1] // width])
        symbol[gone] = -1
        then = after[here] = after[gone]
        put(gone, none)
        if then < n:
            before[then] = here
        put(here, pair(here, then) if then < n else none)
        if before[here] >= 0:
            put(before[here], pair(before[here], here))
    return np.array([s for s in symbol if s >= 0], dtype="<u4")


#: White space in the patterns' sense is a part of what ``re`` calls \s, so fewer places count as safe, never more.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def plain_spaces(text: str) -> bool:
    """Whether each space has a letter or sign on either side (sufficient test; other white space than line feeds says no)."""
    return not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _RARE_SPACE))


class UnitCache:
    """Bytes per unit of text, in two generations: what is used stays, what is not goes, and memory stays bounded."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.entries = entries

    def missing(self, units) -> list[str]:
        """Units that neither generation has; those of the old one move to the new."""
        out = []
        for u in set(units).difference(self.new):
            if (v := self.old.get(u)) is not None:
                self.new[u] = v
            else:
                out.append(u)
        return out

    def rotate(self) -> None:
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}


class ByteBPE:
    """Whole texts to ids (little-endian uint32 bytes) with a splitting pattern and ranks.

    No match of a byte-level pattern holds a space behind another character, so a text falls apart, without change of
    its ids, before each single space between two other characters. The parts are encoded once and remembered.
    """

    def __init__(self, ranks: Ranks, pattern: str, entries: int = CACHE_ENTRIES) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.spaced, self.first = UnitCache(entries), UnitCache(entries // 4)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") if plain_spaces(t) else None for t in texts]
        odd = {k: _SAFE.split(t) for k, t in enumerate(texts) if parts[k] is None}
        first = {p[0] for p in parts if p}.union(*odd.values())
        self._learn(self.spaced, set().union(*(p[1:] for p in parts if p)), " ")
        self._learn(self.first, first, "")
        lead, rest = self.first.new, self.spaced.new.__getitem__
        out = [b"".join(map(lead.__getitem__, odd[k])) if p is None else lead[p[0]] + b"".join(map(rest, p[1:])) for k, p in enumerate(parts)]
        self.spaced.rotate()
        self.first.rotate()
        return out

    def forget(self) -> None:
        """Drop the remembered units: a worker that waits for its next task keeps the vocabulary alone."""
        self.spaced, self.first = UnitCache(self.spaced.entries), UnitCache(self.first.entries)

    def _learn(self, cache: UnitCache, units: set[str], before: str) -> None:
        todo = cache.missing(units)
        if not todo:
            return
        if before:  # spaced units may stand in one string, which they are safe to be cut from
            found = self.pattern.findall(f" {' '.join(todo)}")
        else:
            found = [m for u in todo for m in self.pattern.findall(u)]
        order: dict[str, int] = {}
        which = np.fromiter((order.setdefault(m, len(order)) for m in found), dtype=np.int64, count=len(found))
        flat, counts = self.merge(list(order))
        start = np.cumsum(counts) - counts
        n = counts[which]
        ids = flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        chars = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        ends = np.cumsum(np.fromiter(map(len, todo), dtype=np.int64, count=len(todo)) + len(before))
        cut = (4 * np.concatenate([[0], np.cumsum(n)])[np.searchsorted(chars, ends, side="right")]).tolist()
        cache.new.update(zip(todo, map(ids.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))

    def merge(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return encode_words([m.encode() for m in matches], self.ranks)
