"""Token ids of whole texts, Spark side: encode and decode (2), packing (1), token files (7), token counts (10)."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import CACHE_ENTRIES, ByteBPE, UnitCache, byte_letters, ranks_of_tiktoken
from .common import bounded, id_of, in_arrow, materialize, text_of

#: Characters of text that are taken up at once within a task.
BATCH_CHARS = 2_000_000


def shares(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BATCH_CHARS of text (one row at least), so that a task's memory is bounded."""
    lengths = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0))
    group = np.cumsum(lengths) // BATCH_CHARS
    edges = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(lengths)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same parts with their texts as strings."""
    for part in shares(batch, text):
        yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]


def spans(flat: np.ndarray, begin: np.ndarray, count: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """flat[begin : begin + count] of all spans on end, taken in blocks of spans."""
    out = [flat[:0]]
    for k in range(0, len(begin), block):
        n = count[k : k + block]
        out.append(flat[np.repeat(begin[k : k + block] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(out)


# ---------------------------------------------------------------- encoders, one for each process and file


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> ByteBPE:
    """Segment-tree merging by the ranks of a file of ``base64 rank`` lines."""
    return ByteBPE(ranks_of_tiktoken(path), pattern, entries=100_000)


@lru_cache(maxsize=2)
def decoder_table(path: str) -> list[bytes | None]:
    import base64

    with open(path, "rb") as f:
        ids = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    return [ids.get(k) for k in range(max(ids) + 1)]


class _LibraryBytes(ByteBPE):
    """As ByteBPE, with the merges done by a library that reads the same vocabulary; texts with a string of a special token go to the tokenizer itself."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None
        model, back = spec["model"], {c: b for b, c in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {bytes(back[c] for c in s): n for s, n in model["vocab"].items() if s not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        # ids in the order of the merges, after those of the bytes: then ranks and merges say the same
        self.direct = plain and made == list(range(256, 256 + len(made))) and not any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
        self.path, self.special = path, special
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.core = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ids, special_tokens={}) if self.direct else None
        self.lengths = np.zeros(max(ids.values()) + 1, dtype=np.int64)
        for raw, n in ids.items():
            self.lengths[n] = len(raw)
        self.spaced, self.first = UnitCache(), UnitCache()

    @cached_property
    def whole(self):
        """The tokenizer itself, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        odd = [k for k, t in enumerate(texts) if not self.direct or any(s in t for s in self.special)]
        if not odd:
            return super().encode_batch(texts)
        out, rest = [b""] * len(texts), sorted(set(range(len(texts))) - set(odd))
        for k, ids in zip(rest, super().encode_batch([texts[k] for k in rest]), strict=True):
            out[k] = ids
        for k in odd:
            out[k] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def _learn(self, cache: UnitCache, units: set[str], before: str) -> None:
        todo = cache.missing(units)
        if before and todo:
            ids = np.array(self.core.encode_ordinary(f" {' '.join(todo)}"), dtype="<u4")
            ends = np.cumsum(np.fromiter((len(u.encode()) for u in todo), dtype=np.int64, count=len(todo)) + 1)
            cut = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="right")).tolist()
            raw = ids.tobytes()
            cache.new.update(zip(todo, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
        else:
            cache.new.update((u, np.array(self.core.encode_ordinary(u), dtype="<u4").tobytes()) for u in todo)


#: Fixed value: the splitting pattern of byte-level tokenizers.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Stands for the end of a word; parts of text that hold it go to the tokenizer itself.
MARK = "\0"
#: Ranges of characters whose classes are compared, and ranges that are letters in every version of Unicode since 5.2.
PROBED = [(0x1, 0x3400), (0xF900, 0x10000), (0x1F000, 0x1FB00)]
LETTERS = [(0x3400, 0x4DB6), (0x4E00, 0x9FCC), (0xAC00, 0xD7A4)]


class _LibraryWords:
    """Ids by a tokenizer whose matches hold no white space: a text is cut at its spaces and each distinct part is encoded once.

    Parts are told apart by Arrow's dictionary encoding. The ids of parts lie on end in one array (``flat``), where
    ``begin`` and ``count`` say those of each; ``slot`` has the place of a part. A full pool keeps what the last batch used.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole, self.entries = Tokenizer.from_file(path), 2 * CACHE_ENTRIES
        self._hold([], np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"]
        first = pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre
        # proven for this shape: a split that keeps matches of a pattern without white space or lookaround, then bytes to letters
        self.direct = pre["type"] == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"] and first["behavior"] == "Removed" and first["invert"] and not pre["pretokenizers"][1]["use_regex"] and not pre["pretokenizers"][1]["add_prefix_space"] and not re.search(r"\(\?|\\s[+*?]|\. | ", first["pattern"].get("Regex", "(?"))
        self.direct = self.direct and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.direct = self.direct and self._ranked(spec["model"])
        if self.direct:
            self.pattern = regex.compile(first["pattern"]["Regex"])
            self.odd = self._unlike()

    def _unlike(self) -> re.Pattern:
        """Characters that the two libraries' Unicode tables may put in other classes; parts of text with them go to the tokenizer itself."""
        known = [chr(c) for low, high in PROBED for c in range(low, high) if not chr(c).isspace()]
        probe = " ".join(f"{c}{c}a" for c in known)  # a letter gives one match, a number three, others two
        theirs = np.array([a for _, (a, _) in self.whole.pre_tokenizer.pre_tokenize_str(probe)])
        ours = np.array([m.start() for m in self.pattern.finditer(probe)])
        at = np.arange(len(known) + 1) * 4
        begins = [np.searchsorted(x, at) for x in (theirs, ours)]
        same = np.diff(begins[0]) == np.diff(begins[1])
        taken = "".join(f"{chr(low)}-{chr(high - 1)}" for low, high in [*PROBED[1:], *LETTERS])
        rest = "".join(re.escape(c) for c, ok in zip(known, same.tolist(), strict=True) if not ok)
        spaces = "".join(c for c in map(chr, range(PROBED[0][1])) if c.isspace())
        return re.compile(rf"[{MARK}{re.escape(spaces)}{rest}]|[^\x01-{chr(PROBED[0][1] - 1)}{taken}]")

    def _ranked(self, model: dict) -> bool:
        """The same merges by a library that works on ranks of bytes; an unused byte (MARK) stands for the end of a word.

        True where ids follow the order of the merges, so that ranks and merges say the same, and no merge holds that byte.
        """
        import tiktoken

        end, letter = model.get("end_of_word_suffix"), byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = ["".join(m) for m in merges]
        begins = [*map(letter.__getitem__, range(256)), *(letter[b] + (end or "") for b in range(256))]
        vocab, mark = model["vocab"], letter[ord(MARK)]
        if not end or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "byte_fallback")) or any(mark in m for m in made) or not all(t in vocab for t in [*begins, *made]):
            return False
        back = {c: bytes([b]) for b, c in letter.items()}
        raw = [b"".join(map(back.__getitem__, t.removesuffix(end))) + (MARK.encode() if t.endswith(end) else b"") for t in [*begins, *made]]
        if len(set(raw)) != len(raw) or [vocab[t] for t in made] != list(range(512, 512 + len(made))):
            return False
        self.ids = np.array([vocab[t] for t in [*begins, *made]], dtype="<u4")
        self.core = tiktoken.Encoding("words", pat_str=f"[^{MARK} ]+{MARK}| ", mergeable_ranks=dict(zip(raw, range(len(raw)), strict=True)), special_tokens={})
        return True

    def _hold(self, units: list[str], flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        self.slot = dict(zip(units, range(len(units)), strict=True))
        self.flat, self.begin, self.count = flat, begin, count

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        flat, counts = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end and how many each has; a null counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        alone = np.full(len(texts), not self.direct)
        for s in self.special:
            alone |= np.asarray(pc.match_substring(texts, s))
        if not alone.any():
            return self._by_units(texts)
        flat, counts = self._by_units(pc.if_else(pa.array(alone), pa.scalar("", texts.type), texts))
        begin, more = np.cumsum(counts) - counts, [flat]
        self._instead(begin, counts, more, np.nonzero(alone)[0].tolist(), texts.filter(pa.array(alone)).to_pylist())
        return spans(np.concatenate(more), begin, counts), counts

    def _instead(self, begin: np.ndarray, count: np.ndarray, more: list[np.ndarray], places: list[int], texts: list[str]) -> None:
        """Put ids by the tokenizer itself in the given places: behind the arrays that are there."""
        end = sum(map(len, more))
        for k, t in zip(places, texts, strict=True):
            ids = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4")
            begin[k], count[k], end = end, len(ids), end + len(ids)
            more.append(ids)

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].copy()
        at = at - at[0]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:] = (data == 32) | (data == 10) | (data == 9)
        data[cut[1:]] = 32
        cut[at] = True
        edges = np.nonzero(cut)[0]  # a unit ends behind a space or with its text
        units = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        words = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.slot.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(new := np.nonzero(slots < 0)[0]):
            todo = [words[k] for k in new.tolist()]
            flat, begin, count = self._learn([u.removesuffix(" ") for u in todo])
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update(zip(todo, slots[new].tolist(), strict=True))
            self.begin, self.count = np.concatenate([self.begin, begin + len(self.flat)]), np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, flat])
        begin, count = self.begin[slots], self.count[slots]
        codes = np.asarray(units.indices)
        out, n = spans(self.flat, begin[codes], count[codes]), count[codes]
        if len(self.slot) > self.entries:
            self._hold(words, spans(self.flat, begin, count), np.cumsum(count) - count, count)
        return out, np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(edges, at)])

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units without spaces: all on end, and where those of each begin and how many they are."""
        joined = " ".join(units)
        odd = [k for k, u in enumerate(units) if self.odd.search(u)] if self.odd.search(joined.replace(" ", "")) else []
        lower = joined.lower().split(" ")  # what the normaliser does to ASCII without white space
        if not joined.isascii():
            wide = [k for k, u in enumerate(units) if not u.isascii()]
            wide = sorted(set(wide).difference(odd))
            found = self.whole.normalizer.normalize_str(" ".join(units[k] for k in wide)).split(" ")
            for k, v in zip(wide, found if wide else [], strict=True):
                lower[k] = v
            if self.odd.search("".join(found)):
                odd += [k for k in wide if self.odd.search(lower[k])]
        for k in odd:
            lower[k] = ""
        ranks = np.array(self.core.encode_ordinary(self.pattern.sub(rf"\g<0>{MARK}", " ".join(lower))), dtype=np.int64)
        cut = np.nonzero(ranks == ord(" "))[0]  # a space between two units is a piece of its own
        count = np.diff(np.concatenate([[-1], cut, [len(ranks)]])) - 1
        begin, more = np.cumsum(count) - count, [self.ids[np.delete(ranks, cut)]]
        self._instead(begin, count, more, odd, [units[k] for k in odd])
        return np.concatenate(more), begin, count


@lru_cache(maxsize=2)
def library_bytes(path: str) -> _LibraryBytes:
    return _LibraryBytes(path)


@lru_cache(maxsize=2)
def library_words(path: str) -> _LibraryWords:
    return _LibraryWords(path)


# ---------------------------------------------------------------- 2: encode and decode


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Byte-level BPE ids of whole texts: ``doc_id, ids`` (little-endian uint32 in one binary).

    A null text counts as empty and has no ids. Rows are independent: repeated rows, ties and null ids pass through. Ids of any
    whole type come back as long, other columns play no part. An empty table gives no rows.
    """

    def run(batches):
        encoder = byte_encoder(path, pattern)
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.encode_batch(texts), pa.binary())], ["doc_id", "ids"])

    return docs.select(id_of(), text_of().alias("text")).transform(in_arrow, run, "doc_id long, ids binary")


def _decoded(ids: list[bytes], path: str) -> pa.Array:
    piece = decoder_table(path).__getitem__
    return pa.array([b"".join(map(piece, np.frombuffer(x, dtype="<u4").tolist())) for x in ids], pa.binary())


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes that ids stand for: ``doc_id, ids, decoded``. An id without bytes is an error; no ids are no bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(batch.column(1).to_pylist(), path)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").transform(in_arrow, run, "doc_id long, ids binary, decoded binary")


def recode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` as ``encode_documents`` and ``decode_documents`` give them, in one Python worker for both."""

    def run(batches):
        encoder = byte_encoder(path, pattern)
        for batch in batches:
            for part, texts in slices(batch):
                ids = encoder.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), _decoded(ids, path)], ["doc_id", "ids", "decoded"])

    return docs.select(id_of(), text_of().alias("text")).transform(in_arrow, run, "doc_id long, ids binary, decoded binary")


# ---------------------------------------------------------------- 1: best-fit packing


def plan_packing(counts: dict[int, int], size: int) -> np.ndarray:
    """Best fit over the counts of lengths, longest first: rows (length, first rank, end rank, sequence, per sequence, offset).

    The items of a length with ranks first..end-1 fill sequences from ``sequence`` on, ``per sequence`` in each, from ``offset``.
    Open sequences with the same room are kept as runs, so work and memory depend on ``size`` and not on the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs (first sequence, how many)
    rows, fresh_id = [], 0
    for length in sorted((n for n, c in counts.items() if c and n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                per = size // length
                n = -(-left // per)
                first, fresh_id, free = fresh_id, fresh_id + n, size
            else:
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                per = free // length
                if n * per > left:  # only a part of the run is needed
                    need = -(-left // per)
                    if need < n:
                        room.setdefault(free, []).append((first + need, n - need))
                    n = need
            placed = min(left, n * per)
            rows.append((length, rank, rank + placed, first, per, size - free))
            full, rest = divmod(placed, per)
            for k, of, used in ((first, full, per), (first + full, 1 if rest else 0, rest)):
                if of and free - used * length > 0:
                    room.setdefault(free - used * length, []).append((k, of))
            rank, left = rank + placed, left - placed
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def document_pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """Documents as ids with an end id, cut to pieces of at most ``size``; of a longer one the first piece is the short one."""

    def run(batches):
        encoder = library_bytes(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part, texts in slices(batch):
                ids, rows = part.column(0).to_pylist(), []
                for doc, raw in zip(ids, encoder.encode_batch(texts), strict=True):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()

    return docs.select(id_of(), text_of().alias("text")).transform(in_arrow, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialised pieces by best fit on the histogram of lengths.

    The plan depends on at most ``size`` counts. A piece takes the slot of its rank within its length, by a join with the plan.
    Ranks are counted within (length, bucket), and a small table of prefix sums over buckets makes them global, so that no
    length meets in one task: the prefix sums of a length have as many rows as there are buckets.
    """
    spark = pieces.sparkSession
    buckets = max(16, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    counts = materialize(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "lengths")
    # at most ``size`` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, size)
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before.select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = ["p_length", "first", "end", "sequence", "per", "base"]
    slots = spark.createDataFrame(plan.tolist(), ", ".join(f"{c} long" for c in columns))
    # the plan follows ``size`` and not the input (some thousand rows for 2,048); a length has a few rows, of which one has the rank
    placed = ranked.join(bounded(slots), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("end")))
    nth = F.col("_rank") - F.col("first")
    sequence = F.col("sequence") + F.floor(nth / F.col("per")).cast("long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("base") + nth % F.col("per") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Best-fit packing of documents into sequences of at most ``size`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null or empty text is the end id alone.
    Repeated rows are packed each; ties of rank are broken by id, piece and content, and equal rows are interchangeable. Ids of
    any whole type come back as long (null stays), other columns play no part. An empty table gives no rows.
    """
    return pack_pieces(materialize(document_pieces(docs, path, size, end_id), "pieces"), size)


# ---------------------------------------------------------------- 7: token files


def write_token_files(docs: DataFrame, encode: Callable[[], object], path: str, end_id: int, row_group_mb: int = 32, page_kb: int = 256, rows_per_file: int = 20_000) -> None:
    """Token files: Parquet in ascending order of ``doc_id`` over files and rows.

    Columns ``doc_id, n_tokens, ids_crc32`` and ``tokens`` (list of int). Dictionary encoding is on for tokens (with delta
    encoding where a dictionary grows too large) and off for the ids, row groups and pages are bounded, and page indexes and
    column statistics are written, so that a reader can take the numbers alone or the tokens of a range of documents alone.
    Rows without an id come first, rows of one id follow each other, in several files if they are many. A null or empty text has the end id alone. Ids of any whole
    type are written as long, other columns are not. An empty table gives files without rows.
    """

    def run(batches):
        encoder = encode()
        for batch in batches:
            for part in shares(batch):
                ids, n = encoder.encode_column(part.column(1))
                flat, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                edges = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                tokens = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(crc, pa.int64()), tokens], ["doc_id", "n_tokens", "ids_crc32", "tokens"])

    # files follow the number of rows (which Parquet's footers give), and rows of one id, or of none, may fill several
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows_per_file)
    numbered = docs.select(id_of(), text_of().alias("text"), F.monotonically_increasing_id().alias("_row"))
    parts = numbered.repartitionByRange(files, "doc_id", "_row").select("doc_id", "text")
    encoded = parts.sortWithinPartitions("doc_id", "text").transform(in_arrow, run, "doc_id long, n_tokens long, ids_crc32 long, tokens array<int>")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#ids_crc32": "false", "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10)}
    encoded.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents with ``start``, the ids before each in file order (from the numbers' columns alone), and their tokens.

    Equal ids follow each other in the order of their token counts and checksums. A running sum within each file follows
    from the file's own rows, and one row per file carries the totals before it.
    """
    rows = spark.read.schema("doc_id long, n_tokens long, ids_crc32 long, tokens array<int>").parquet(path).withColumn("_file", F.input_file_name())
    return _starts(rows.select("doc_id", "n_tokens", "ids_crc32", "_file"))


def _starts(rows: DataFrame) -> DataFrame:
    """Running sums in three levels: rows of a file, files of a group, groups. No level takes more than its own share to a task."""
    within = Window.partitionBy("_file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("doc_id", "n_tokens", "ids_crc32", "_file").withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return starts.join(bounded(_file_starts(rows)), "_file").select("doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def _file_starts(rows: DataFrame) -> DataFrame:
    """``_file, _base``: the tokens of all files before each, in the order of their ids."""
    files = materialize(rows.groupBy("_file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "files")
    order = [F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), F.col("_file")]
    groups = max(1, int(files.count() ** 0.5))
    dealt = materialize(files.repartitionByRange(groups, *order).withColumn("group", F.spark_partition_id()), "file-groups")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as the square root of the number of files
    totals = dealt.groupBy("group").agg(F.sum("n").alias("all")).withColumn("_before", F.coalesce(F.sum("all").over(before(Window.orderBy("group"))), F.lit(0)))
    inside = dealt.withColumn("_in", F.coalesce(F.sum("n").over(before(Window.partitionBy("group").orderBy(*order))), F.lit(0)))
    return materialize(inside.join(totals, "group").select("_file", (F.col("_before") + F.col("_in")).alias("_base")), "file-starts")


def checked_token_files(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files``, with counts and checksums taken anew from the tokens that the files give back.

    The tokens are read in one pass without a shuffle; only counts and checksums of documents go on to the running sums.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            raw = flat.astype("<u4", copy=False)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2)], ["doc_id", "n_tokens", "ids_crc32", "_file"])

    rows = spark.read.schema("doc_id long, n_tokens long, ids_crc32 long, tokens array<int>").parquet(path)
    seen = rows.select("doc_id", "tokens", F.input_file_name().alias("_file")).transform(in_arrow, run, "doc_id long, n_tokens long, ids_crc32 long, _file string")
    return _starts(materialize(seen, "token-counts"))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, tokens`` of a range of ids; row groups and pages outside it are skipped. Rows without an id are in no bounded range,
    repeated rows come each; files without rows give none."""
    rows = spark.read.schema("doc_id long, n_tokens long, ids_crc32 long, tokens array<int>").parquet(path)
    for bound, keep in ((low, F.col("doc_id") >= F.lit(low)), (high, F.col("doc_id") <= F.lit(high))):
        rows = rows.where(keep) if bound is not None else rows
    return rows.select("doc_id", "tokens")


# ---------------------------------------------------------------- 10: token counts


class PieceCounter:
    """Token counts by a sentencepiece model.

    Where no piece of the model holds the word mark behind another character, a text's tokens never cross from a character to
    a space behind it: such a place is a stable boundary, whatever stands around. Long texts are encoded in overlapping chunks
    with offsets and spliced at a stable boundary that both chunks have in their overlap; without one the overlap is widened.
    Shorter texts are cut at their spaces and each distinct word is counted once.
    """

    def __init__(self, path: str, chunk: int = 1 << 16, overlap: int = 1 << 9) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        # proof of the boundary, and of the form of normalisation it needs: a dummy prefix, no removal or mapping of characters
        self.stable = not any(re.search("[^▁]▁", p) for p in pieces) and self.model.encode("a  b", out_type=str) == self.model.encode("a", out_type=str) + self.model.encode(" b", out_type=str) and self._identity()
        self.words: dict[str, int] = {}
        self.last: dict[str, int] = {}

    def _identity(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(self.model.serialized_model_proto())
        n = m.normalizer_spec
        return n.add_dummy_prefix and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not m.trainer_spec.treat_whitespace_as_suffix and not any(p.type == 4 for p in m.pieces)

    def count_batch(self, texts: list[str]) -> list[int]:
        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk and self.stable and "▁" not in t and t]
        parts = {k: texts[k].split(" ") for k in short}
        parts = {k: p for k, p in parts.items() if "" not in p}
        self._learn(set().union(*parts.values()))
        get = self.words.__getitem__
        return [sum(map(get, parts[k])) if k in parts else self.count_long(t) if len(t) > self.chunk else len(self.model.encode(t)) for k, t in enumerate(texts)]

    def _learn(self, units: set[str]) -> None:
        if len(self.words) > 2 * UnitCache().entries:
            self.last, self.words = self.words, {}
        todo = []
        for u in units.difference(self.words):
            if (n := self.last.get(u)) is not None:
                self.words[u] = n
            else:
                todo.append(u)
        self.words.update(zip(todo, map(len, self.model.encode(todo, num_threads=1) if todo else []), strict=True))

    def _begins(self, text: str, begin: int, end: int) -> np.ndarray:
        """Byte offsets, from ``begin``, of the tokens of text[begin:end]; a chunk that starts at a space gives that space to the model's dummy prefix."""
        drop = begin > 0
        proto = self.model.encode(text[begin + drop : end], return_type="proto")
        return np.array([p.begin for p in proto.pieces], dtype=np.int64) + drop

    def count_long(self, text: str) -> int:
        """Tokens of a long text, by chunks; the whole text at once if the model proves no stable boundary."""
        if not self.stable or "▁" in text:
            return len(self.model.encode(text))
        total, begin, n, width = 0, 0, len(text), self.overlap
        end = min(n, self.chunk)
        while begin < n:
            cut = self._boundary(text, max(begin + 1, end - width), end) if end < n else n
            mine = None if cut is None else self._begins(text, begin, end)
            if mine is not None and cut < n:
                here = len(text[begin:cut].encode())
                at = int(np.searchsorted(mine, here))
                # the next chunk begins with a token at the cut; this one must have a token that begins there as well
                aligned = at < len(mine) and mine[at] in (here, here + 1)
            if cut is None or (cut < n and not aligned):
                width, end = 2 * width, min(n, end + width)
                continue
            total += at if cut < n else len(mine)
            begin, width, end = cut, self.overlap, min(n, cut + self.chunk)
        return total

    @staticmethod
    def _boundary(text: str, low: int, high: int) -> int | None:
        """The last place in low..high with a single space between two characters that are no spaces."""
        at = text.rfind(" ", low, high)
        while at > low:
            if text[at - 1] != " " and at + 1 < len(text) and text[at + 1] != " ":
                return at
            at = text.rfind(" ", low, at)
        return None


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of whole texts; a null text counts as empty and has no tokens.

    Rows are independent: repeated rows, ties and null ids pass through. Ids of any whole type come back as long, other columns
    play no part. An empty table gives no rows.
    """

    def run(batches):
        counter = piece_counter(path)
        for batch in batches:
            for part, texts in slices(batch):
                n = np.array(counter.count_batch(texts), dtype=np.int64)
                size = pa.array(np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_of(), text_of().alias("text")).transform(in_arrow, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


