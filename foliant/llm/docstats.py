"""Counts over whole texts that the rule and classifier operators use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import slices, utf8

#: ASCII white space and the characters counted as symbols.
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PUNCT = b".,;:!?"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars", "n_lines", "n_upper", "n_lower", "n_digits", "n_bang", "n_punct", "n_distinct", "n_bars", "n_other", "top_word", "long_words", "short_words")
COUNTS = BASE + EXTRA


def _count(text: bytes, some: bytes) -> int:
    return len(text) - len(text.translate(None, some))


def counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text. n_repeat_words: words in 5-word windows found twice or more, the first included."""
    words = text.split()
    n = len(words)
    chars = len(text) - _count(text, bytes(range(0x80, 0xC0)))
    word_chars = chars - _count(text, WHITE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n > 5:
        h = np.zeros(n - 4, np.uint64)
        u = a.astype(np.uint64)
        for k in range(5):
            h = h * np.uint64(0x9E3779B97F4A7C15) + u[k : n - 4 + k] + np.uint64(1)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(n - 4, bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    upper, lower, digits = _count(text, _UPPER), _count(text, _LOWER), _count(text, _DIGIT)
    sizes = np.fromiter(map(len, words), np.int64, n)
    top = int(np.bincount(a).max()) if n else 0
    other = chars - upper - lower - digits - _count(text, WHITE)
    return (
        n, word_chars, _count(text, SYMBOLS), len(lines) - len(set(lines)), repeated,
        chars, len(lines), upper, lower, digits, text.count(b"!"), _count(text, _PUNCT), len(ids), text.count(b"|"), other, top, int((sizes > 14).sum()), int((sizes < 3).sum()),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1024):
                rows = np.array([counts(x) for x in utf8(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(rows: np.ndarray) -> np.ndarray:
    """Rates and logarithms from rows of COUNTS; an empty text gives zeros."""
    c = {k: rows[:, i].astype(np.float64) for i, k in enumerate(COUNTS)}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / letters, c["n_digits"] / chars, c["n_bang"] / words, c["n_punct"] / words, c["n_distinct"] / words,
        c["n_bars"] / words, c["n_other"] / chars, c["top_word"] / words, c["long_words"] / words, c["short_words"] / words, c["n_words"] / lines,
    ])


FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "bang_rate", "punct_rate", "distinct_rate", "bar_rate", "other_rate", "top_word_rate", "long_rate", "short_rate", "line_words")
