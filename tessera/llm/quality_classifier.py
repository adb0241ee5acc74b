"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per class, mean and covariance of the statistics are estimated from distributed sums over all labelled rows of
the training folds; each covariance is shrunk towards the pooled one and towards a multiple of the identity.
A document's score comes from the difference of the two log densities, by Mahalanobis distances through Cholesky
factors that are made once. A logistic curve in that difference, fitted to a histogram of the training rows,
turns it into a probability.

Defined cases: null and empty texts have statistics of zero and are scored like any other; a document with
contradictory labels counts once for each; without labels of both classes every score is 0.5; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import docs_of, map_arrow, materialize, slices, texts

SLICE_BYTES = 2 << 20
TO_POOLED = 0.1
TO_IDENTITY = 0.05
THRESHOLD = 0.7
_BINS = 400
_SPAN = 60.0

NAMES = ("words", "word_length", "length_spread", "upper", "digits", "punctuation", "symbols", "not_ascii", "distinct", "repeated", "line_words", "lines", "dotted", "capitals", "shouted", "bangs", "pipes")


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CLASSES = {
    "upper": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _mask("0123456789"),
    "punctuation": _mask(".,;:'\"()-"),
    "symbols": _mask("#*$%&<>@=+_~^{}[]\\/"),
    "not_ascii": np.arange(256) >= 128,
    "bangs": _mask("!?"),
    "pipes": _mask("|"),
}


def statistics(column: pa.Array) -> np.ndarray:
    """A row for each text, a column for each of NAMES."""
    words = w.split(column)
    n_docs = len(column)
    size = np.diff(words.bounds)
    n = np.diff(words.first)
    some, chars = np.maximum(n, 1), np.maximum(size, 1)
    length = words.end - words.start
    mean = words.per_doc(length) / some
    spread = np.sqrt(np.maximum(words.per_doc(length * length) / some - mean**2, 0))
    out = {"words": np.log1p(n), "word_length": np.log1p(mean), "length_spread": np.log1p(spread)}
    for name, table in _CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(table[words.data])])
        out[name] = np.sqrt((sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / chars)
    key = w.mix(words.hash ^ w.mix(words.doc.astype(w.U)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["distinct"] = 1 - words.per_doc(again) / some
    at, runs = words.runs(3)
    doc = words.doc[at] if len(at) else np.empty(0, np.int64)
    key = np.sort(w.mix(runs ^ w.mix(doc.astype(w.U))))
    runs_of = np.bincount(doc, minlength=n_docs)
    keyed = w.mix(runs ^ w.mix(doc.astype(w.U)))
    place = np.searchsorted(key, keyed)
    out["repeated"] = np.sqrt(np.bincount(doc, weights=(place + 1 < len(key)) & (key[np.minimum(place + 1, len(key) - 1)] == keyed) if len(key) else None, minlength=n_docs) / np.maximum(runs_of, 1))
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    lines = 1 + breaks[words.bounds[1:]] - breaks[words.bounds[:-1]]
    out["line_words"], out["lines"] = np.log1p(n / lines), np.log1p(lines)
    last, initial = words.data[words.end - 1], words.data[words.start]
    out["dotted"] = np.sqrt(words.per_doc(_mask(".")[last]) / some)
    capital = _CLASSES["upper"][initial]
    out["capitals"] = np.sqrt(words.per_doc(capital) / some)
    second = words.data[np.minimum(words.start + 1, words.end - 1)]
    out["shouted"] = np.sqrt(words.per_doc(capital & (length > 1) & _CLASSES["upper"][second]) / some)
    return np.stack([out[name] for name in NAMES], 1).astype(np.float64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = texts(batch.column(1))
        for lo, hi in slices(column, SLICE_BYTES):
            x = statistics(column.slice(lo, hi - lo))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), flat], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: count, sums and sums of products."""
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            part = x[y == c]
            total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["quality", "sums"])


class Discriminant:
    """Class means with inverse Cholesky factors and log determinants."""

    def __init__(self, sums: np.ndarray) -> None:
        d = len(NAMES)
        n = sums[:, 0]
        self.fitted = bool((n > 0).all())
        if not self.fitted:
            return
        self.means = sums[:, 1 : 1 + d] / n[:, None]
        raw = np.stack([sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(self.means[c], self.means[c]) for c in (0, 1)])
        pooled = (n[:, None, None] * raw).sum(0) / n.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.scale, self.factors, self.logs = scale, [], []
        for c in (0, 1):
            s = ((1 - TO_POOLED) * raw[c] + TO_POOLED * pooled) / np.outer(scale, scale)
            s = (1 - TO_IDENTITY) * s + TO_IDENTITY * max(np.trace(s) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(s)
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(2 * np.log(np.diag(factor)).sum())
        self.slope, self.shift = 1.0, float(np.log(n[1] / n[0]))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, squashed to a bounded scale."""
        logs = []
        for c in (0, 1):
            z = ((x - self.means[c]) / self.scale) @ self.factors[c].T
            logs.append(-0.5 * ((z * z).sum(1) + self.logs[c]))
        return _SPAN * np.tanh((logs[1] - logs[0]) / _SPAN)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.shift)))

    def calibrate(self, counts: np.ndarray) -> None:
        """Logistic curve by Newton steps over (class, bin) counts of differences."""
        at = (np.arange(_BINS) + 0.5) / _BINS * 2 * _SPAN - _SPAN
        a, b = 0.1, self.shift
        n, ones = counts.sum(0), counts[1]
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * at + b)))
            v = n * p * (1 - p)
            grad = np.array([((ones - n * p) * at).sum() - 1e-3 * a, (ones - n * p).sum()])
            hess = np.array([[(v * at * at).sum() + 1e-3, (v * at).sum()], [(v * at).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(float(a), 1e-3), float(b)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: fold, score and prediction."""
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    features = materialize(map_arrow(docs_of(docs), _features, "doc_id long, x array<double>"), "statistics").withColumn("held_out", held)
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`quality`").cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    training = features.where(~F.col("held_out")).join(known, "doc_id").select("x", "quality")
    sums = np.zeros((2, 1 + len(NAMES) + len(NAMES) ** 2))
    totals = map_arrow(training, _moments, "quality int, sums array<double>").groupBy("quality").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(sums.shape[1])]).alias("sums"))
    for row in totals.collect():  # two rows
        sums[row.quality] = row.sums
    model = Discriminant(sums)
    if model.fitted:
        raw = spark.sparkContext.broadcast(model)

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(2 * _BINS, np.int64)
            for batch in batches:
                bins = np.clip(((raw.value.difference(_matrix(batch.column(0))) + _SPAN) / (2 * _SPAN) * _BINS).astype(np.int64), 0, _BINS - 1)
                counts += np.bincount(bins + _BINS * batch.column(1).to_numpy(zero_copy_only=False), minlength=2 * _BINS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * _BINS)), pa.array(counts)], ["bin", "n"])

        counts = np.zeros(2 * _BINS)
        for row in map_arrow(training, histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # 2 * _BINS rows
            counts[row.bin] = row.n
        model.calibrate(counts.reshape(2, _BINS))
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(features, scored, "doc_id long, held_out boolean, score double, predicted int")
