"""Kernel models evaluated a batch at a time.

A batch of rows meets all vectors of a model as one matrix product; models
travel once to each executor, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .models import MAX_VECTORS, KernelModel

#: Kernel values that are held at a time.
CELLS = 4_000_000


@dataclass(frozen=True)
class Matrices:
    """A radial-basis model as arrays."""

    gamma: float
    rho: float
    coef: np.ndarray
    vectors: np.ndarray
    prob_a: float | None
    prob_b: float | None

    @classmethod
    def of(cls, model: KernelModel) -> Matrices:
        if len(model.coef) > MAX_VECTORS:
            raise ValueError(f"{len(model.coef)} support vectors; at most {MAX_VECTORS}")
        vectors = np.array(model.vectors, float)
        return cls(model.gamma, model.rho, np.array(model.coef, float), vectors.reshape(len(model.coef), -1), model.prob_a, model.prob_b)

    def values(self, rows: np.ndarray) -> np.ndarray:
        """Decision (or regression) values of rows of features, which may be fewer than a vector has: the rest are 0."""
        wide = np.zeros((len(rows), self.vectors.shape[1]))
        width = min(rows.shape[1], wide.shape[1])
        if rows.shape[1] > width and np.abs(rows[:, width:]).max(initial=0) > 0:  # features that no vector has still count as distance
            extra = (rows[:, width:] ** 2).sum(1)
        else:
            extra = np.zeros(len(rows))
        wide[:, :width] = rows[:, :width]
        out = np.empty(len(rows))
        own = (self.vectors ** 2).sum(1)
        step = max(1, CELLS // max(1, len(self.coef)))
        for lo in range(0, len(rows), step):
            some = wide[lo:lo + step]
            apart = np.maximum((some ** 2).sum(1)[:, None] + own - 2 * some @ self.vectors.T, 0) + extra[lo:lo + step, None]
            out[lo:lo + step] = np.exp(-self.gamma * apart) @ self.coef - self.rho
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Platt's sigmoid, kept 1e-7 away from 0 and 1."""
        with np.errstate(over="ignore"):
            return np.clip(1 / (1 + np.exp(self.prob_a * values + self.prob_b)), 1e-7, 1 - 1e-7)


def _stacked(features: pd.Series, some: np.ndarray) -> np.ndarray:
    return np.array([np.asarray(f, float) for f in features[some]]) if some.any() else np.zeros((0, 0))


def values_udf(spark: SparkSession, models: dict[str, KernelModel]):
    """A function of (name, features): the value by the model of that name; null without a model or with a null feature."""
    shared = spark.sparkContext.broadcast({name: Matrices.of(m) for name, m in models.items()})

    @F.pandas_udf("double")
    def values(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, features in batches:
            out = np.full(len(names), np.nan)
            whole = np.array([f is not None and not any(x is None or x != x for x in f) for f in features], bool)
            for name, model in shared.value.items():
                some = (names == name).to_numpy(bool) & whole
                if some.any():
                    out[some] = model.values(_stacked(features, some))
            yield pd.Series([None if x != x else x for x in out], dtype="float64")

    return values


def decisions(features: Column, spark: SparkSession, model: KernelModel) -> Column:
    """Decision values by one model."""
    return values_udf(spark, {"one": model})(F.lit("one"), features)


def classified(spark: SparkSession, models: dict[str, KernelModel]):
    """A function of (name, features): decision value ``dec_value`` and probability ``p`` by the model of that name."""
    missing = [n for n, m in models.items() if m.prob_a is None or m.prob_b is None]
    if missing:
        raise ValueError(f"no probabilities in the model {', '.join(missing)}")
    shared = spark.sparkContext.broadcast({name: Matrices.of(m) for name, m in models.items()})

    @F.pandas_udf("dec_value double, p double")
    def classify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, features in batches:
            value, p = np.full(len(names), np.nan), np.full(len(names), np.nan)
            whole = np.array([f is not None and not any(x is None or x != x for x in f) for f in features], bool)
            for name, model in shared.value.items():
                some = (names == name).to_numpy(bool) & whole
                if some.any():
                    value[some] = model.values(_stacked(features, some))
                    p[some] = model.probabilities(value[some])
            yield pd.DataFrame({"dec_value": value, "p": p}).astype(object).where(lambda d: d.notna(), None).astype("float64")

    return classify
