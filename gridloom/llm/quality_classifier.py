"""Quality classifier: regularised quadratic discriminant over document statistics.

Every class has its own covariance, shrunk towards the pooled one and towards
its diagonal.  A score is the difference of the two Mahalanobis log-densities,
from Cholesky factors computed once and shipped with the model, turned into a
probability by a logistic curve that is fitted on rows left out of the fold's
model.  Moments add, so all labelled rows count and only sums reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, read_table, row_key, written
from .quality_rules import base_statistics

HELD_OUT_MOD, HELD_OUT_REST = 4, 2
FOLDS = 4
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.05
RIDGE = 1e-3
ACCEPT = 0.7
PUNCT = b".,;:!?"
DIGITS = b"0123456789"

FEATURES = ("log_words", "word_length", "symbol_rate", "upper_rate", "digit_rate", "punct_rate", "shout_rate", "pipe_rate", "line_words", "dup_line_rate", "repeat_rate", "distinct_rate", "run_rate", "top_word_rate")


def features(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty text has a vector too."""
    n, chars, symbols, dup, repeat, lines, upper, shouts, runs = base_statistics(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    w, c = max(n, 1), max(chars, 1)
    if n:
        distinct = set(words)
        h = np.fromiter(map(hash, words), np.int64, n)
        h.sort()
        edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        top = int(np.diff(edges).max())
    else:
        distinct, top = (), 0
    log = np.log
    return [
        float(log(n + 1.0)),
        float(log((chars + 4.0) / (n + 1.0))),
        float(log((symbols + 0.2) / (w + 4.0))),
        float(log((upper + 1.0) / (c + 20.0))),
        float(log((len(raw) - len(raw.translate(None, DIGITS)) + 0.5) / (c + 20.0))),
        float(log((len(raw) - len(raw.translate(None, PUNCT)) + 1.0) / (w + 10.0))),
        float(log((shouts + 0.2) / (w + 4.0))),
        float(log((raw.count(b"|") + 0.2) / (w + 4.0))),
        float(log((n + 10.0) / (lines + 1.0))),
        float(log((dup + 0.2) / (lines + 2.0))),
        float(log((repeat + 1.0) / (w + 20.0))),
        float(log((len(distinct) + 1.0) / (w + 2.0)) / log(w + 10.0) * 3.0),
        float(log((runs + 0.3) / (w + 10.0))),
        float(log((top + 1.0) / (w + 10.0))),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("fold"), batch.column("row_key"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "held_out", "fold", "row_key", "x"])

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = F.coalesce(crc % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce((crc / HELD_OUT_MOD).cast("long") % FOLDS, F.lit(0)).cast("int").alias("fold"), row_key().alias("row_key"), "text")
    return map_batches(slim, run, "doc_id long, held_out boolean, fold int, row_key long, x array<double>")


def moments(labelled: DataFrame) -> np.ndarray:
    """[fold, class] -> count, sums and products of the features, summed over all labelled rows."""
    d = len(FEATURES)
    size = 1 + d + d * d

    def run(batches):
        acc = np.zeros((FOLDS, 2, size))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False))
            k = b.column("fold").to_numpy(zero_copy_only=False)
            y = b.column("y").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                for c in (0, 1):
                    z = x[(k == f) & (y == c)]
                    acc[f, c, 0] += len(z)
                    acc[f, c, 1 : 1 + d] += z.sum(0)
                    acc[f, c, 1 + d :] += (z.T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(acc.size)], pa.int32()), pa.array(acc.ravel())], names=["i", "v"])

    sums = np.zeros((FOLDS, 2, size))
    for r in labelled.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums.flat[r["i"]] = r["v"]
    return sums


class Discriminant:
    """Two Gaussians; holds means, Cholesky factors' inverses and log-determinants."""

    def __init__(self, sums: np.ndarray):
        d = len(FEATURES)
        count = sums[:, 0]
        known = np.maximum(count, 1.0)
        mean = sums[:, 1 : 1 + d] / known[:, None]
        cov = [sums[c, 1 + d :].reshape(d, d) / known[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
        pooled = (cov[0] * count[0] + cov[1] * count[1]) / max(count.sum(), 1.0)
        scale = np.sqrt(np.diag(pooled) + RIDGE)
        self.scale, self.mean, self.whiten, self.offset = scale, mean, [], []
        for c in (0, 1):
            lone = d / (d + count[c])  # a small class leans on the pooled covariance
            a = max(SHRINK_POOLED, lone)
            s = ((1 - a) * cov[c] + a * pooled) / np.outer(scale, scale)
            s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(d)
            factor = np.linalg.cholesky(s)
            self.whiten.append(np.linalg.inv(factor).T)
            self.offset.append(-np.log(np.diag(factor)).sum())
        self.usable = bool(count.min() >= 2)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        if not self.usable:
            return np.zeros(len(x))
        out = []
        for c in (0, 1):
            z = ((x - self.mean[c]) / self.scale) @ self.whiten[c]
            out.append(self.offset[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return np.clip(out[1] - out[0], -80.0, 80.0)


BIN = 0.25


def calibration(labelled: DataFrame, models: list[Discriminant]) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, from left-out differences in bins."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False))
            k = b.column("fold").to_numpy(zero_copy_only=False)
            z = np.zeros(len(x))
            for f in range(FOLDS):
                z[k == f] = models[f].difference(x[k == f])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(z / BIN).astype(np.int32)), b.column("y")], names=["bin", "y"])

    bins = labelled.mapInArrow(run, "bin int, y int").groupBy("bin", "y").agg(F.count("*").alias("n")).collect()
    z, y, w = (np.array([r[c] for r in bins], float) for c in ("bin", "y", "n"))
    a, b = 0.3, 0.0
    if not len(bins) or not 0 < (y * w).sum() < w.sum():
        return a, float(np.log(((y * w).sum() + 1) / (w.sum() - (y * w).sum() + 1))) if len(bins) else b
    z = z * BIN
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([(w * (p - y) * z).sum() + 1e-2 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(b)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``ACCEPT`` on), one row per input row.

    Empty and null texts are scored as texts without words.  A null id is never
    held out and never labelled.  Without labels of both classes every score is
    the prior's.  Repeated rows get equal scores; an empty table gives no rows.
    """
    table = written(with_features(docs), "quality-features")
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    labelled = written(table.filter(~F.col("held_out")).join(known, "doc_id").select("fold", "x", "y"), "quality-labelled")
    sums = moments(labelled)
    whole = Discriminant(sums.sum(0))
    slope, intercept = calibration(labelled, [Discriminant(sums.sum(0) - sums[f]) for f in range(FOLDS)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack(batch.column("x").to_numpy(zero_copy_only=False))
        score = 1 / (1 + np.exp(-(slope * whole.difference(x) + intercept)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32)), batch.column("row_key")], names=["doc_id", "held_out", "score", "predicted", "row_key"])

    return map_batches(table, lambda b: run(b) if b.num_rows else None, "doc_id long, held_out boolean, score double, predicted int, row_key long")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
