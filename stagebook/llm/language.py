"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are relative frequencies of byte pairs of the lower-cased text, with everything but letters as a space.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, held_out, in_arrow, text_of
from .scan import parts, sums

#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi mr ne bn gu pa ur".split(),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_KEEP = np.full(256, 32, dtype=np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
UNKNOWN = "und"


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def _pairs(data: np.ndarray) -> np.ndarray:
    b = _KEEP[data].astype(np.int32)
    return b[:-1] * 256 + b[1:] if len(b) > 1 else b[:0]


def _lower(batch: pa.RecordBatch) -> pa.RecordBatch:
    k = batch.schema.get_field_index("text")
    return batch.set_column(k, "text", pc.utf8_lower(batch.column(k)))


@dataclass
class LanguageModel:
    """``languages`` by family; each machine separates two names with a weight for every frequent pair, a last one of 0 for all
    others, and a bias. ``place`` says which weight each of the 65,536 pairs has, the same for all machines."""

    languages: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float]]
    place: np.ndarray

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        index, n = self.place[_pairs(data)], len(at) - 1
        total = np.maximum(at[1:] - at[:-1] - 1, 0)
        begin = np.minimum(at[:-1], len(index))
        margin = {}
        for pair, (weights, bias) in self.machines.items():
            value = sums(weights[index], begin, begin + total) / np.maximum(total, 1) + bias
            margin[pair] = 1 / (1 + np.exp(-np.clip(4 * value, -60, 60)))

        def choose(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if len(names) == 1:
                return np.zeros(n, dtype=int), np.ones(n)
            wins = np.zeros((len(names), n))
            for i, j in combinations(range(len(names)), 2):
                p = margin[names[i], names[j]]
                wins[i] += p
                wins[j] += 1 - p
            wins *= 2 / (len(names) * (len(names) - 1))
            best = wins.argmax(axis=0)
            return best, np.clip(wins[best, np.arange(n)] * (len(names) / 2 if len(names) > 2 else 1), 0, 1)

        names = sorted(self.languages)
        of, score = choose(names)
        out = [UNKNOWN] * n
        for k, name in enumerate(names):
            inside = self.languages[name]
            best, p = choose(inside)
            for i in np.nonzero(of == k)[0].tolist():
                out[i] = inside[best[i]]
                score[i] *= p[i]
        return out, score


def _machine(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge loss, by accelerated gradient steps in single precision; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    top = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(12):  # the largest curvature, by power iteration
        top = x.T @ (weight * (x @ (top / np.linalg.norm(top))))
    decay = x.dtype.type(decay)
    step = x.dtype.type(1 / (2 * float(np.linalg.norm(top)) + float(decay)))
    w = v = np.zeros(x.shape[1], dtype=x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (decay * v - 2 * (x.T @ (weight * y * slack)))
        v = new + x.dtype.type(k / (k + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


def fit_languages(docs: DataFrame, sample: int = 800, features: int = 2048) -> LanguageModel:
    """Learn from rows with a language that are not held out: about ``sample`` of each language, chosen by a hash.

    The sample bounds what is sent to the driver: the pair shares of ``sample`` texts for each language (some 3 MB each). It is
    the only part of the corpus that the model is fitted on. Machines are fitted one pair of names after another.
    """
    rows = docs.select("doc_id", text_of().alias("text"), "lang").where(F.col("lang").isNotNull() & ~held_out() & (F.col("lang") != UNKNOWN))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel({}, {}, np.zeros(65536, dtype=np.int32))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, sample / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 200)), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(chance < F.element_at(share, F.col("lang")))

    def run(batches):
        for batch in batches:
            for part, data, at in parts(_lower(batch)):
                lists = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    key, n = np.unique(_pairs(data[a:b]), return_counts=True)
                    lists.append((key, n / max(1, n.sum())))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("lang")), pa.array([k for k, _ in lists], pa.list_(pa.int32())), pa.array([v for _, v in lists], pa.list_(pa.float32()))], ["lang", "pair", "share"])

    got = taken.select("text", "lang").transform(in_arrow, run, "lang string, pair array<int>, share array<float>").toArrow()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    size = np.array(pc.list_value_length(got.column("pair")).to_pylist(), dtype=np.int64)
    pair = np.concatenate([np.zeros(0, dtype=np.int32), *[np.asarray(c.flatten()) for c in got.column("pair").chunks]])
    value = np.concatenate([np.zeros(0, dtype=np.float32), *[np.asarray(c.flatten()) for c in got.column("share").chunks]])
    frequent = np.argsort(-np.bincount(pair, minlength=65536), kind="stable")[:features]
    place = np.full(65536, -1)
    place[frequent] = np.arange(len(frequent))
    known = place[pair] >= 0
    row, column, value = np.repeat(np.arange(len(langs)), size)[known], place[pair[known]], value[known]
    begin = np.searchsorted(row, np.arange(len(langs) + 1))
    square = np.bincount(column, weights=value.astype(np.float64) ** 2, minlength=len(frequent)) / max(1, len(langs))
    scale = 1 / (np.sqrt(square) + 1e-4) / np.sqrt(len(frequent) / 16)
    value = value * scale[column].astype(np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        """The rows of one pair of names alone, so that memory does not follow the number of languages."""
        x = np.zeros((len(rows), len(frequent)), dtype=np.float32)
        for k, r in enumerate(rows.tolist()):
            x[k, column[begin[r] : begin[r + 1]]] = value[begin[r] : begin[r + 1]]
        return x

    languages: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        languages.setdefault(family(lang), []).append(lang)
    machines = {}

    def learn(names: np.ndarray, one: str, other: str) -> None:
        rows = np.nonzero((names == one) | (names == other))[0]
        w, bias = _machine(dense(rows), np.where(names[rows] == one, 1.0, -1.0))
        machines[one, other] = (np.append(w * scale, 0.0), bias)

    families = np.array([family(x) for x in langs], dtype=object)
    for one, other in combinations(sorted(languages), 2):
        learn(families, one, other)
    for inside in languages.values():
        for one, other in combinations(inside, 2):
            learn(langs, one, other)
    return LanguageModel(languages, machines, np.where(place < 0, len(frequent), place).astype(np.int32))


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``pred`` and ``score`` beside the columns to keep. Null text, text without a letter, or a model that learned nothing: und, 0."""
    (text,) = fresh(docs, "_whole_text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 kB for each pair of families, and of languages of a family, whatever the input
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], text_of().alias(text))
    schema = StructType([*kept.schema.fields[:-1], StructField(pred, StringType()), StructField(score, DoubleType())])

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text)
            low = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(k))], ["text"])
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(low.column(0), r"\p{L}"), False).to_numpy(zero_copy_only=False))
            names, scores = [], []
            for _, data, at in parts(low):
                n, s = shared.value.predict(data, at)
                names += n
                scores += s.tolist()
            known = letters & (len(shared.value.languages) > 0)
            names = [n if ok else UNKNOWN for n, ok in zip(names, known.tolist(), strict=True)]
            rest = [c for i, c in enumerate(batch.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(np.where(known, scores, 0.0))], schema=pa.schema([*[f for i, f in enumerate(batch.schema) if i != k], pa.field(pred, pa.string()), pa.field(score, pa.float64())]))

    return kept.transform(in_arrow, run, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the documents' own languages, then predict all: ``doc_id, held_out, lang_pred, score``.

    Null and empty texts, and any without a letter, are und with a score of 0, as are all texts where no row teaches a language.
    Texts are read whole. Repeated rows and null ids (held out) pass through; ids keep their type, other columns play no part.
    An empty table gives no rows.
    """
    model = fit_languages(docs)
    out = predict_languages(docs, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is predicted with a score of ``least`` or more, with all their columns; und goes.

    Null and empty texts are und. Repeated rows are judged alike and each stays or goes; an empty table gives no rows.
    """
    pred, score = fresh(docs, "lang_pred", "lang_score")
    out = predict_languages(docs, fit_languages(docs), docs.columns, pred, score)
    return out.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
