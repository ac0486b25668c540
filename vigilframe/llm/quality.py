"""Quality classifier by compression: how much better a text packs with the dictionary of good than with that of bad labelled text.

Two zstandard dictionaries are trained on a bounded sample of labelled rows. A text's compressed sizes with the good, the bad and no
dictionary give the normalised size difference and the packing rates, which a logistic curve fitted on other labelled rows turns into a score.
Scoring is one map over the documents: no shuffle, and no row meets another.

Null and empty texts get the score of an empty text. Fewer than ``MIN_TEXTS`` training texts in a class: every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.common import fold, trim

FOLDS = 5
THRESHOLD = 0.3
SAMPLE_PER_CLASS = 1600  # labelled rows of each class, by hash of the id; half make the dictionary, half the curve
SAMPLE_CHARS = 20_000  # a sampled text may be as long; longer ones are scored like all others, but not learned from
DICTIONARY_BYTES = 1 << 16
LEVEL = 1
MIN_TEXTS = 4


@dataclass
class Model:
    good: bytes
    bad: bytes
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the texts are too few to train one, their bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:].lstrip(b"\x37\xa4\x30\xec") or b"\n"


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    if dictionary is None:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


def _measures(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, plain: zstandard.ZstdCompressor) -> np.ndarray:
    """Per text: normalised size difference, the three packing rates, length."""
    sizes = np.array([(len(good.compress(t)), len(bad.compress(t)), len(plain.compress(t)), len(t)) for t in texts], dtype=float).reshape(-1, 4)
    g, b, p, n = sizes.T
    return np.stack([(g - b) / (g + b + 40), np.log((p + 20) / (n + 20)), np.log((g + 20) / (n + 20)), np.log((b + 20) / (n + 20)), np.log(n + 1)], axis=1)


def _terms(x: np.ndarray) -> np.ndarray:
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i + 1)]
    return np.stack([np.ones(len(x)), *x.T, *pairs], axis=1)


def fit(good: list[str], bad: list[str], share_good: float) -> Model | None:
    """Dictionaries from the even texts of each list, the curve from the odd ones, weighted to ``share_good`` of all labelled rows."""
    if min(len(good), len(bad)) < MIN_TEXTS:
        return None
    sides = [[t.encode() for t in x] for x in (good, bad)]
    dictionaries = [_dictionary(x[::2]) for x in sides]
    held = [x[1::2] for x in sides]
    x = _measures(held[0] + held[1], _compressor(dictionaries[0]), _compressor(dictionaries[1]), _compressor(None))
    y = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    weight = np.where(y == 1, share_good / y.mean(), (1 - share_good) / (1 - y.mean()))
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = _terms((x - middle) / spread)
    w = np.zeros(a.shape[1])
    for _ in range(40):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (weight * (y - p)) - 0.1 * w)
    return Model(*dictionaries, middle, spread, w)


def learn(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on rows outside the held-out fold. The sample of ids and texts is bounded by the parameters above at any size of the tables."""
    seen = labels.where((fold("doc_id", FOLDS) != 0) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    shares = {r[0]: r[1] for r in seen.groupBy("quality").count().collect()}
    texts: dict[int, list[str]] = {}
    for label in (1, 0):
        ids = [r[0] for r in seen.where(F.col("quality") == label).select("doc_id").dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class).collect()]
        rows = docs.where(F.col("doc_id").isin(ids) & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "text").limit(sample_per_class).collect() if ids else []
        texts[label] = [r[1] for r in rows]
    total = sum(shares.values())
    return fit(texts[1], texts[0], shares.get(1, 0) / total) if total else None


def with_score(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""
    if model is None:
        return docs.withColumn(score, F.lit(0.5))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = _compressor(model.good), _compressor(model.bad), _compressor(None)
        for batch in batches:
            x = _measures([(t or "").encode() for t in batch], *tools)
            z = _terms((x - model.middle) / model.spread) @ model.weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            del batch, x, z
            trim()

    return docs.withColumn(score, scored(F.coalesce(F.col(text), F.lit(""))))
