"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bounded, cut
from foliant.llm.docstats import BASE, COUNTS, FEATURES, features, with_counts

#: Direction in which a feature may move the score: -1 means that more of it never makes a text better.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "bang_rate": -1, "bar_rate": -1, "top_word_rate": -1}


@dataclass
class Trees:
    """All trees as flat arrays: an inner node has a feature, a threshold and its children; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row at once: all rows go down one level of one tree per step."""
        out = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                goes_left = x[row, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 20, monotone: dict[str, int] | None = None) -> Trees:
    """Boosted trees for the logistic loss with histogram splits.

    A split on a constrained feature is taken only if its leaf values keep the direction, and both children are
    bound by the middle of the two values, so that the whole score is monotone in that feature.
    """
    signs = np.array([(MONOTONE if monotone is None else monotone).get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    rate_1 = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    margin = np.full(len(y), bias := float(np.log(rate_1 / (1 - rate_1))))
    nodes: list[list[float]] = []
    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows: np.ndarray, level: int, low: float, high: float, g=g, h=h) -> int:
            sg, sh = g[rows].sum(), h[rows].sum()
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(np.clip(-sg / (sh + ridge), low, high)) * rate])
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    width = len(c) + 1
                    hg, hh, hn = (np.cumsum(np.bincount(code[rows, k], w, width))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = np.clip(-hg / (hh + ridge), low, high), np.clip(-(sg - hg) / (sh - hh + ridge), low, high)
                    gain = hg**2 / (hh + ridge) + (sg - hg) ** 2 / (sh - hh + ridge) - sg**2 / (sh + ridge)
                    gain[(hn < least) | (len(rows) - hn < least) | (signs[k] * (vr - vl) < 0)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), k, j, float(vl[j]), float(vr[j]))
            _, k, j, vl, vr = best
            if k >= 0:
                middle = (vl + vr) / 2
                left_bound, right_bound = ((low, middle), (middle, high)) if signs[k] > 0 else ((middle, high), (low, middle)) if signs[k] < 0 else ((low, high), (low, high))
                to_left = code[rows, k] <= j
                nodes[me][:2] = [k, float(cuts[k][j])]
                nodes[me][2] = grow(rows[to_left], level + 1, *left_bound)
                nodes[me][3] = grow(rows[~to_left], level + 1, *right_bound)
            return me

        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        flat = np.array(nodes)
        one = Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots[-1:]), 0.0)
        margin += one.margin(x)
    flat = np.array(nodes).reshape(-1, 5)
    return Trees(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), bias)


def train(counted: DataFrame, labels: DataFrame, max_rows: int = 40_000) -> Trees | None:
    """Fit on about ``max_rows`` labelled rows (never over twice that), chosen by a hash; None without both classes."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = bounded(counted.join(known, "doc_id"), max_rows, 5, "doc_id", *COUNTS).select("quality", *COUNTS).collect()
    both = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, len(COUNTS) + 1)
    if len(set(both[:, 0].tolist())) < 2:
        return None
    return fit(features(both[:, 1:]), both[:, 0].astype(float))


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, BASE counts, base_failed, score, kept) for every row of docs (doc_id, text).

    base_failed: fewer than 10 words, or over a fifth of them in repeated 5-word windows. kept is false for
    those; for the others it says whether the trees' probability of good quality reaches ``threshold``.
    Null and empty texts have zero counts and fail; repeated rows and rows without doc_id are judged as rows.
    Labels that are null or no 0 or 1 are ignored; a document labelled twice counts as good if one label says so.
    Without labels of both kinds the base rules decide alone. Other columns are ignored; no row in, no row out.
    """
    counted = cut(with_counts(docs))
    trees = train(counted, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(k + 1).to_numpy() for k in range(len(COUNTS))])
            words, again = rows[:, 0], rows[:, COUNTS.index("n_repeat_words")]
            failed = (words < 10) | (100 * again > 20 * words)
            score = 1 / (1 + np.exp(-trees.margin(features(rows)))) if trees else np.ones(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    return counted.select("doc_id", *COUNTS).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")
