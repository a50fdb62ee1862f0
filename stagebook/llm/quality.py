"""Quality classifier: regularised quadratic discriminant over transformed statistics of documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, held_out, id_of, in_arrow, materialize, text_of
from .scan import parts, sums, word_hashes, words

STATISTICS = ("n_words", "word_length", "upper", "symbols", "marks", "digits", "beyond_ascii", "line_words", "stops", "commas", "bare_symbols", "distinct", "twice", "odd_ends", "long_words", "repeats")
_KIND = np.zeros((256, 8), dtype=np.float64)
_KIND[65:91, 0] = 1  # upper case
_KIND[[ord(c) for c in "#$%&*+<=>@^_{|}~\\/[]"], 1] = 1  # signs
_KIND[[ord(c) for c in "!?"], 2] = 1
_KIND[48:58, 3] = 1
_KIND[128:, 4] = 1
_KIND[10, 5] = 1
_KIND[[ord(c) for c in ".:;"], 6] = 1
_KIND[ord(","), 7] = 1
_WORD_END = np.zeros(256, dtype=bool)
_WORD_END[[*range(97, 123), *range(128, 256), *map(ord, ".,;:?")]] = True


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of statistics for each text, transformed to be nearer to normal; an empty text has them all at their base."""
    begin, end, first = words(data, at)
    n_words = np.diff(first).astype(np.float64)
    n_bytes = np.diff(at).astype(np.float64)
    per_byte = 1 / np.maximum(n_bytes, 1)
    per_word = 1 / np.maximum(n_words, 1)
    kinds = [sums(_KIND[:, k][data], at[:-1], at[1:]) for k in range(8)]
    length = (end - begin).astype(np.float64)
    by_text = lambda v: sums(v.astype(np.float64), first[:-1], first[1:])
    bare = by_text(length == 1) * per_word
    odd = by_text(~_WORD_END[data[end - 1]] if len(end) else length) * per_word
    h = word_hashes(data, begin, end)
    # distinct words and distinct pairs of words, by sorting the hashes within each text
    text = np.repeat(np.arange(len(n_words)), np.diff(first))
    inside = text[1:] == text[:-1]  # a pair of words never reaches into the next text
    distinct = _distinct(h, text, len(n_words))
    twice = _distinct((h[:-1] * np.uint64(3) + h[1:])[inside], text[:-1][inside], len(n_words)) + (n_words > 0)
    again = np.concatenate([(h[1:] == h[:-1]) & (text[1:] == text[:-1]), np.zeros(min(1, len(h)), dtype=bool)])
    share = lambda x: np.log(0.002 + x)
    return np.column_stack([
        np.log1p(n_words), np.log1p(by_text(length) * per_word), share(kinds[0] * per_byte), share(kinds[1] * per_byte), share(kinds[2] * per_byte), share(kinds[3] * per_byte),
        np.sqrt(kinds[4] * per_byte), share(kinds[5] * per_word), share(kinds[6] * per_word), share(kinds[7] * per_word), share(bare), share(1.001 - distinct * per_word), share(np.maximum(1.001 - twice * per_word, 0)), share(odd), share(by_text(length > 20) * per_word), share(by_text(again) * per_word),
    ])


def _distinct(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, text))
    h, t = h[order], text[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    return np.bincount(t[new], minlength=n).astype(np.float64)


@dataclass
class QualityModel:
    """Of both classes: mean, inverse of the Cholesky factor of the shrunk covariance, half its log determinant, log share."""

    classes: list[tuple[np.ndarray, np.ndarray, float, float]]
    tempered: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), float(self.tempered))
        density = []
        for mean, inverse, half_log, log_share in self.classes:
            z = (x - mean) @ inverse.T
            density.append(log_share - half_log - 0.5 * (z**2).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(self.tempered * (density[1] - density[0]), -60, 60)))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (array of double) of every whole text; null counts as empty."""

    def run(batches):
        for batch in batches:
            for part, data, at in parts(batch):
                x = statistics(data, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "x"])

    return docs.select(id_of(), text_of().alias("text")).transform(in_arrow, run, "doc_id long, x array<double>")


def fit_quality(stats: DataFrame, labels: DataFrame, shrink: float = 0.2, ridge: float = 1e-3, temper: float = 0.25) -> QualityModel:
    """Fit on all labelled documents that are not held out: sums, products and counts by class are added up in the tasks.

    Of labels that contradict each other for one document the higher one holds. A class's covariance is drawn by ``shrink`` toward the pooled one, which keeps a diagonal ``ridge``. Statistics of a text
    depend on each other, so log densities are scaled by ``temper``. With one class only its share is the score, with none 1.
    """
    d = len(STATISTICS)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))

    def run(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for k in (0, 1):
                of = x[y == k]
                acc[k] += np.concatenate([[len(of)], of.sum(axis=0), (of.T @ of).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(acc.tolist(), pa.list_(pa.float64())), pa.array([0, 1], pa.int32())], ["sums", "y"])

    moments = stats.join(known, "doc_id").select("x", "y").transform(in_arrow, run, "sums array<double>, y int")
    # a row per class and statistic pair leaves the tasks; a few hundred numbers in all reach the driver
    added = moments.select("y", F.posexplode("sums").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    acc = np.zeros((2, 1 + d + d * d))
    for r in added:
        acc[r["y"], r["k"]] = r["v"]
    n = acc[:, 0]
    if min(n) < 2:
        return QualityModel([], float(n[1] / n.sum()) if n.sum() else 1.0)
    mean = acc[:, 1 : d + 1] / n[:, None]
    cov = [acc[k, d + 1 :].reshape(d, d) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum() + ridge * np.eye(d)
    classes = []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * cov[k] + shrink * pooled + ridge * np.eye(d))
        classes.append((mean[k], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n[k] / n.sum()))))
    return QualityModel(classes, temper)


def _scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)  # two factors of fixed size

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").transform(in_arrow, run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Null and empty texts are scored as texts without words, repeated rows alike; rows with a null id are scored and held out.
    Ids of any whole type come back as long, other columns play no part. An empty table gives no rows.
    """
    stats = materialize(document_statistics(docs), "statistics")
    scored = _scored(stats, fit_quality(stats, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents whose score is ``least`` or more, with all their columns. Texts are read twice and never shuffled.

    Null and empty texts are scored as texts without words. Repeated rows are judged alike and each stays or goes; an empty table
    gives no rows.
    """
    stats = materialize(document_statistics(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(stats, labels))
    text, score = fresh(docs, "_whole_text", "quality_score")

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text)
            for part, data, at in parts(batch, text):
                rest = [c for i, c in enumerate(part.columns) if i != k]
                fields = [f for i, f in enumerate(part.schema) if i != k]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(model.value.score(statistics(data, at)))], schema=pa.schema([*fields, pa.field(score, pa.float64())]))

    out = docs.withColumn(text, text_of()).transform(in_arrow, run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))
    return out.where(F.col(score) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
