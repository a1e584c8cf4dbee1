"""Places where a caller supplies a model: embedding and generation, with deterministic defaults."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

DIMENSIONS = 64


def embedding_function(make: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function from a factory of ``texts -> matrix``; the factory runs once for each worker's stream."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), np.float32)))

    return embed


def _bag() -> Callable[[list[str]], np.ndarray]:
    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return model


#: The default embedding: a signed hashed bag of words of unit length.
hashed_bag = embedding_function(_bag)

#: What a client's message says of a failure that may pass, where it has no status of its own.
_TRANSIENT = re.compile(r"time(?:d )?-?out|rate limit|connection|network|socket|\b(?:http|status|code|error)\W{0,3}(?:408|429|5\d\d)\b", re.IGNORECASE)


class GenerationError(RuntimeError):
    """A generator's failure with the status of its service, and the seconds that it asks to wait, if it does."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None) -> None:
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def _pause(problem: Exception, usual: float, longest: float) -> float | None:
    """Seconds to wait before the same call again; None if it would fail the same way, or asks for more than the longest wait."""
    status = getattr(problem, "status", None)
    if status is not None:
        passing = status in (408, 429) or status >= 500
    else:
        passing = isinstance(problem, TimeoutError | ConnectionError) or bool(_TRANSIENT.search(str(problem)))
    asked = getattr(problem, "retry_after", None)
    pause = usual if asked is None else float(asked)
    return pause if passing and pause <= longest else None


def llm_map(
    rows: DataFrame, prompt: str, generate: Callable[..., str], tries: int = 3, wait: float = 0.5, output: str = "answer", options: dict | None = None, longest: float = 60.0
) -> DataFrame:
    """Rows with the columns ``output`` and ``error`` from a caller's generator.

    ``options`` (temperature, system prompt, most tokens, and what else it knows) go to every call by name. A failure
    that may pass is tried again, after the time that the service asks for or else with doubled waits; a lasting one,
    or one that asks for more than ``longest`` seconds, fills ``error`` and doesn't fail the job.
    """
    schema = StructType([*rows.schema.fields, StructField(output, StringType()), StructField("error", StringType())])
    named = options or {}

    def call(text: str) -> tuple[str | None, str | None]:
        for attempt in range(tries):
            try:
                return generate(text, **named), None
            except Exception as problem:  # whatever a caller's client raises is told in the row
                pause = _pause(problem, wait * 2**attempt, longest)
                if attempt + 1 == tries or pause is None:
                    return None, str(problem) or type(problem).__name__
                time.sleep(pause)
        return None, "no attempt"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [call(x or "") for x in batch[prompt]]
            yield batch.assign(**{output: [a for a, _ in answers], "error": [e for _, e in answers]})

    return rows.mapInPandas(run, schema)


def capitalised_pairs(text: str) -> str:
    """The default triplet extractor: neighbouring capitalised words as a JSON array."""
    import json
    import re

    words = re.findall(r"[A-ZÀ-Þ]\w{3,}", text)
    return json.dumps([{"subject": a, "relation": "related_to", "object": b} for a, b in zip(words, words[1:], strict=False)])
