"""A small dense model in numpy: fitted per partition with averaged gradients, scored by an Arrow UDF."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """sigmoid(w x + b)."""

    weights: tuple[float, ...]
    bias: float = 0.0

    def score(self, x: Column) -> Column:
        """Probability, in the JVM."""
        dot = F.aggregate(F.zip_with(x, F.array(*map(F.lit, self.weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return 1 / (1 + F.exp(-(dot + self.bias)))

    def input_gradient(self, x: Column, y: Column, scale: float = 1.0) -> Column:
        """Gradient of the cross-entropy by the inputs."""
        d = (self.score(x) - y.cast("double")) * scale
        return F.transform(F.array(*map(F.lit, self.weights)), lambda w: w * d)

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "bias": self.bias})

    @staticmethod
    def from_json(text: str) -> Logistic:
        d = json.loads(text)
        return Logistic(tuple(d["weights"]), d["bias"])


def fit_logistic(rows: DataFrame, x: str, y: str, dim: int, epochs: int = 5, lr: float = 0.5) -> Logistic:
    """Full-batch gradient descent: partitions return one gradient each, which are averaged."""
    w = np.zeros(dim + 1)
    for _ in range(epochs):
        now = w.copy()

        def partial(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(dim + 1), 0
            for pdf in batches:
                if len(pdf):
                    a = np.column_stack([np.stack(pdf[x].to_list()).astype(float), np.ones(len(pdf))])
                    p = 1 / (1 + np.exp(-a @ now))
                    total += a.T @ (p - pdf[y].to_numpy(float))
                    n += len(pdf)
            yield pd.DataFrame({"g": [total], "n": [n]})

        parts = rows.select(x, y).mapInPandas(partial, "g array<double>, n long")
        sums = parts.agg(*[F.sum(F.get("g", F.lit(i))) for i in range(dim + 1)], F.sum("n")).first()
        w = w - lr * np.array([float(v or 0) for v in sums[:-1]]) / max(sums[-1] or 0, 1)
    return Logistic(tuple(w[:-1]), float(w[-1]))


@dataclass
class LossScale:
    """Dynamic loss scaling: a non-finite gradient divides the scale, a good run multiplies it."""

    scale: float = 1024.0
    growth_interval: int = 2000
    good: int = 0

    def update(self, finite: bool) -> float:
        if not finite:
            self.scale, self.good = self.scale / 4, 0
        else:
            self.good += 1
            if self.good >= self.growth_interval:
                self.scale, self.good = self.scale * 2, 0
        return self.scale


def scorer(model, columns: list[str]):
    """Arrow UDF of any ``model(array of columns) -> scores``."""

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model(*[np.stack(c.to_list()) if c.dtype == object else c.to_numpy() for c in cols]), float))

    return score(*columns)
