"""Quality by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded, cut, held_out
from foliant.llm.docstats import COUNTS, FEATURES, features, with_counts


@dataclass
class Model:
    """A linear score over standardised features and their squares; serialises as plain arrays."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([z, np.abs(z), np.ones(len(z))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of the positive class from rows of COUNTS."""
        return 1 / (1 + np.exp(-np.clip(self.inputs(features(rows)) @ self.weights, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative PU risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with Adam and the logistic loss.

    Where the estimated negative risk of a mini-batch falls below zero, its gradient is turned round, so that
    the model doesn't fit noise of the unlabelled rows below what the prior allows.
    """
    xp, xu = features(positive), features(unlabelled)
    model = Model(xu.mean(0), np.maximum(xu.std(0), 1e-6), np.zeros(2 * len(FEATURES) + 1), prior)
    p, u, rng = model.inputs(xp), model.inputs(xu), np.random.default_rng(seed)
    w, m, v = model.weights, 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), min(len(p), 2048))], u[rng.integers(0, len(u), min(len(u), 4096))]
        za, zb = a @ w, b @ w
        to_minus = (b * sigmoid(zb)[:, None]).mean(0) - prior * (a * sigmoid(za)[:, None]).mean(0)
        minus = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        plus = -prior * (a * (1 - sigmoid(za))[:, None]).mean(0)
        g = (plus + to_minus if minus >= 0 else -to_minus) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights = w
    return model


def train(counted: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model | None:
    """Fit on counted rows (doc_id, COUNTS). Trusted positives are the documents labelled 1; every document is unlabelled.

    Labels whose held-out remainder (crc32 of the id mod 3 is 1) is met are never read. The class prior is the
    share of positives among the labels that are read. About ``max_rows`` positives and as many unlabelled rows
    (never over twice that), chosen by a hash, reach the driver. None: there is no positive to learn from.
    """
    known = labels.where(~held_out(F.col("doc_id"), 3, 1)).where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality"), F.count("*")).first()
    if not share[1] or not share[0]:
        return None

    def sample(rows: DataFrame) -> np.ndarray:
        return np.array(sorted(tuple(r) for r in bounded(rows, max_rows, 11, "doc_id", *COUNTS).select(*COUNTS).collect()), np.int64).reshape(-1, len(COUNTS))

    positive = sample(counted.join(known.where("quality = 1"), "doc_id", "left_semi"))
    unlabelled = sample(counted)
    if not len(positive) or not len(unlabelled):
        return None
    return fit_nnpu(positive, unlabelled, float(np.clip(share[0], 0.02, 0.98)))


def score(counted: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of counted rows; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(k + 1).to_numpy() for k in range(len(COUNTS))])
            found = model.score(rows) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    return counted.select("doc_id", *COUNTS).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    The score depends on the whole text only. Null and empty texts are scored like any other; repeated rows and
    rows without doc_id are scored as rows (a null id counts as the text '' for held_out). Labels with a null or
    another value are ignored; a document labelled twice is positive if one of its labels is. Without usable
    labels every score is 0.5. Other columns are ignored; an empty table gives no rows.
    """
    counted = cut(with_counts(docs))
    scored = score(counted, train(counted, labels, max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
