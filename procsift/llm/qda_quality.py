"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsift.llm.common import crc_remainder, fresh, hash_sample, text_of

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
MAX_LABELLED = 50_000
SHRINKAGE = 0.1
RIDGE = 1e-4
#: Added to the size below each share, so that a text of a few words has no extreme one.
PRIOR_BYTES, PRIOR_WORDS = 40, 6

FEATURES = (
    "log_words",
    "word_bytes",
    "symbols",
    "upper",
    "exclaim",
    "digits",
    "stops",
    "bars",
    "repeats",
    "variety",
    "log_line_words",
)
_OTHER, _LETTER, _UPPER, _DIGIT, _WHITE, _STOP, _SYMBOL, _EXCLAIM = range(8)
_BLOCK = 1 << 20


def _classes() -> np.ndarray:
    """The kind of each byte; bytes of longer code points count as letters."""
    table = np.full(256, _LETTER, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        if c.isupper():
            table[b] = _UPPER
        elif c.isdigit():
            table[b] = _DIGIT
        elif c in " \t\n\x0b\f\r":
            table[b] = _WHITE
        elif c in ".,;:?'\"()-":
            table[b] = _STOP
        elif c == "!":
            table[b] = _EXCLAIM
        elif not c.isalpha():
            table[b] = _SYMBOL if b >= 32 else _OTHER
    return table


_TABLE = _classes()


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one whole UTF-8 text; an empty text has zeros.

    Shares enter as square roots, sizes as logarithms: both make their spread
    about even over the range, which a covariance can then describe.
    """
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    kinds = np.zeros(8, dtype=np.int64)
    data = np.frombuffer(text, dtype=np.uint8)
    for start in range(0, len(data), _BLOCK):
        kinds += np.bincount(_TABLE[data[start : start + _BLOCK]], minlength=8)
    solid = len(data) - int(kinds[_WHITE])
    repeats = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    return np.array(
        [
            np.log1p(n),
            min(20.0, solid / n),
            (kinds[_SYMBOL] / (solid + PRIOR_BYTES)) ** 0.5,
            (kinds[_UPPER] / (solid + PRIOR_BYTES)) ** 0.5,
            (kinds[_EXCLAIM] / (solid + PRIOR_BYTES)) ** 0.5,
            (kinds[_DIGIT] / (solid + PRIOR_BYTES)) ** 0.5,
            (kinds[_STOP] / (solid + PRIOR_BYTES)) ** 0.5,
            (words.count(b"|") / (n + PRIOR_WORDS)) ** 0.5,
            (repeats / (n + PRIOR_WORDS)) ** 0.5,
            np.log1p(distinct) / np.log1p(n),
            np.log1p(n / (text.count(b"\n") + 1)),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """A normal density for each class: mean, inverse Cholesky factor of the
    covariance, and what doesn't depend on the text."""

    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]
    middle: np.ndarray
    scale: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of log densities."""
        z = (rows - self.middle) / self.scale
        logs = []
        for k in (0, 1):
            away = (z - self.means[k]) @ self.whiten[k].T  # Mahalanobis: |L^-1 (x - mean)|^2
            logs.append(self.offsets[k] - 0.5 * (away * away).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit_discriminant(
    rows: np.ndarray, labels: np.ndarray, shrinkage: float = SHRINKAGE, ridge: float = RIDGE
) -> Discriminant:
    """Class covariances, shrunk towards the diagonal of the pooled one.

    A class without rows takes the moments of all; without any row at all both
    classes are the same and every score is a half.
    """
    width = rows.shape[1] if rows.size else len(FEATURES)
    rows = rows.reshape(-1, width)
    middle = rows.mean(axis=0) if len(rows) else np.zeros(width)
    scale = rows.std(axis=0) if len(rows) else np.ones(width)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (rows - middle) / scale
    groups = [z[labels == k] for k in (0, 1)]
    centred = [g - g.mean(axis=0) if len(g) else g for g in groups]
    pooled = np.vstack(centred)
    spread = (pooled**2).mean(axis=0) if len(pooled) else np.ones(width)
    means, whiten, offsets = [], [], []
    for group, around in zip(groups, centred, strict=True):
        n = len(group)
        own = around.T @ around / n if n else np.diag(spread)
        cov = (1 - shrinkage) * own + shrinkage * np.diag(spread) + ridge * np.eye(width)
        factor = np.linalg.cholesky(cov)
        means.append(group.mean(axis=0) if n else np.zeros(width))
        whiten.append(np.linalg.inv(factor))
        prior = np.log((n + 1) / (len(rows) + 2))
        offsets.append(float(prior - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(whiten), tuple(offsets), middle, scale)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series([statistics(t) for t in series])


def held_out(doc_id: Column) -> Column:
    return crc_remainder(doc_id, FOLDS) == HELD_OUT


def learn(
    docs: DataFrame,
    labels: DataFrame,
    shrinkage: float = SHRINKAGE,
    max_labelled: int = MAX_LABELLED,
) -> Discriminant:
    """Fit on labelled rows outside the held-out fold.

    At most ``max_labelled`` labels are used, those of the smallest hash of the
    id, so that the sample is bounded and the same on any layout. Labels other
    than 0 and 1 are ignored; of several labels of one id the largest counts.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
    )
    sample = hash_sample(known, max_labelled, "doc_id")
    base = docs.select("doc_id", text_of(docs).cast("binary").alias("text"))
    found = (
        base.join(F.broadcast(sample), "doc_id")  # at most max_labelled rows
        .select("label", _statistics("text").alias("x"))
        .toPandas()
    )
    rows = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_discriminant(rows, found["label"].to_numpy(dtype=int), shrinkage)


def quality_score(model: Discriminant, text: Column) -> Column:
    """The score of each whole text, 0 to 1; a null text counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            rows = np.array([statistics(t) for t in series]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(rows))

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = learn(docs, labels)
    return docs.select("doc_id", quality_score(model, docs["text"]).alias("score")).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    model = learn(docs, labels)
    name = fresh(docs, "_quality_score")
    rows = docs.withColumn(name, quality_score(model, docs["text"]))
    return rows.where(F.col(name) >= threshold).drop(name)
