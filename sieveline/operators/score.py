"""Scores of a model that Python calls, as a column.

A scorer is loaded once in each Python worker from what the driver shares, and
is given bounded batches: neither Arrow's number of rows nor their lengths
decide how much it holds at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of values that a scorer is given at once.
BATCH_BYTES = 16 << 20


class Scorer(Protocol):
    """One row of scores for each value, in order."""

    def score(self, values: list[Any]) -> np.ndarray: ...


def _size(value: Any) -> int:
    if value is None:
        return 0
    return value.nbytes if isinstance(value, np.ndarray) else len(value) if isinstance(value, (str, bytes)) else 8


def bounded(values: pd.Series, most: int) -> Iterator[list[Any]]:
    """Consecutive values of about so many bytes, one at least."""
    held, size = [], 0
    for value in values:
        if held and size + _size(value) > most:
            yield held
            held, size = [], 0
        held.append(value)
        size += _size(value)
    if held:
        yield held


def score_column(column: Column, model: Broadcast, load: Callable[[Any], Scorer], width: int, most: int = BATCH_BYTES) -> Column:
    """array<double> of ``width`` scores; null values get null. A scorer that
    gives another number of rows or scores is an error."""

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load(model.value)
        for values in batches:
            known = values[values.notna()]
            rows: list[np.ndarray] = []
            for part in bounded(known, most):
                got = np.asarray(scorer.score(part), float)
                if got.shape != (len(part), width):
                    raise ValueError(f"the scorer gave {got.shape} scores for {len(part)} values of {width}")
                rows += list(got)
            out = pd.Series([None] * len(values), index=values.index, dtype=object)
            out[known.index] = pd.Series(rows, index=known.index, dtype=object)
            yield out

    return scores(column)


class Centroids:
    """Cosines of vectors with the centroids of classes, in the order of names."""

    def __init__(self, rows: list[tuple[Any, list[float]]]) -> None:
        self.names = [name for name, _ in rows]
        self.unit = self._unit(np.array([v for _, v in rows], float))

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(sizes > 0, sizes, 1)

    def score(self, values: list[Any]) -> np.ndarray:
        return self._unit(np.array([np.asarray(v, float) for v in values])) @ self.unit.T


def nearest(df: DataFrame, centroids: DataFrame, vector: str, name: str = "label", centroid: str = "centroid") -> DataFrame:
    """df with scores (by class, in order), best (the class of the largest
    score, the first of equal ones) and best_score. Classes are few: their
    centroids are a model that the driver shares."""
    rows = sorted((r[name], list(r[centroid])) for r in centroids.select(name, centroid).collect())
    shared = df.sparkSession.sparkContext.broadcast(rows)
    scored = df.withColumn("scores", score_column(F.col(vector), shared, Centroids, len(rows)))
    at = F.array_position("scores", F.array_max("scores")).cast("int")
    return scored.withColumn("best", F.get(F.array(*[F.lit(n) for n, _ in rows]), at - 1)).withColumn("best_score", F.array_max("scores"))
