"""One-class SVM with an RBF kernel, approximated by random Fourier features.

Rahimi, Recht: Random Features for Large-Scale Kernel Machines, NIPS 2007. The kernel becomes a
dot product of ``2 * waves`` cosines and sines, the dual problem becomes a primal one in a weight
vector of that length, and each step of the solver is one scan in which every task returns a sum
of its rows' feature maps. The result is an approximation of the kernel solution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col
from strayrow.functions.sampling import sample_rows
from strayrow.operators.scaling import Prepared, finish_model, fit_scores, matrix, prepare, score_counts

# Share of rows outside, and the seed of the waves.
NU = 0.5
SEED = 42

WAVES = 512
STEPS = 10
_PILOT_ROWS = 20_000
_CHUNK = 4096


@dataclass
class Waves:
    """Frequencies of the feature map for ``exp(-gamma * distance²)``."""

    frequencies: np.ndarray

    @staticmethod
    def draw(features: int, gamma: float, waves: int, seed: int) -> Waves:
        rng = np.random.default_rng(seed)
        return Waves(rng.normal(0.0, np.sqrt(2 * gamma), (features, waves)))

    def map(self, x: np.ndarray) -> np.ndarray:
        # Single precision: far below the error of the approximation itself.
        angles = x.astype(np.float32) @ self.frequencies.astype(np.float32)
        scale = np.float32(1 / np.sqrt(self.frequencies.shape[1]))
        return np.hstack([np.cos(angles), np.sin(angles)]) * scale


@dataclass
class SvmModel:
    waves: Waves
    weights: np.ndarray
    offset: float

    def decision(self, x: np.ndarray) -> np.ndarray:
        parts = [
            self.waves.map(x[i : i + _CHUNK]) @ self.weights for i in range(0, len(x), _CHUNK)
        ]
        return np.concatenate(parts or [np.empty(0)]) - self.offset


def _map_sum(vectors: DataFrame, waves: Waves, model: SvmModel | None) -> tuple[np.ndarray, int]:
    """Sum of the feature maps of all rows, or of those the model puts outside, and their number.

    Tasks emit one number per component; these are added up by a grouped sum, so that the driver
    receives one vector whatever the number of tasks.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((waves, model))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps, current = shared.value
        total, rows = np.zeros(2 * maps.frequencies.shape[1]), 0
        for batch in batches:
            for i in range(0, len(batch), _CHUNK):
                z = maps.map(batch.iloc[i : i + _CHUNK].to_numpy(float))
                counted = np.ones(len(z), np.float32)
                if current is not None:
                    counted = (z @ current.weights.astype(np.float32) < current.offset) * counted
                total += counted @ z
                rows += int(counted.sum())
        yield pd.DataFrame(
            {"component": np.arange(len(total) + 1), "amount": np.append(total, float(rows))}
        )

    sums = (
        vectors.mapInPandas(partial, "component int, amount double")
        .groupBy("component")
        .agg(F.sum("amount").alias("amount"))
        .toPandas()
        .sort_values("component")["amount"]
        .to_numpy()
    )
    shared.destroy()
    return sums[:-1], int(sums[-1])


def fit_svm(
    prepared: Prepared,
    key: list[str] | None = None,
    nu: float = NU,
    waves: int = WAVES,
    steps: int = STEPS,
    seed: int = SEED,
) -> SvmModel:
    """Subgradient steps over all rows; a bounded pilot sample only tracks the offset."""
    names = prepared.names
    features = len(names)
    keyed = prepared.vectors(*[col(k) for k in key or []])
    pilot = sample_rows(keyed, _PILOT_ROWS, key, seed, prepared.n)
    pilot = pilot.select(*names).toPandas().to_numpy(float)
    if not len(pilot):
        raise ValueError("no rows to fit")
    maps = Waves.draw(features, 1 / features, waves, seed)
    pilot_map = maps.map(pilot)

    # Only the scaled features are kept; what an executor takes with it is computed again.
    vectors = prepared.vectors().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total, n = _map_sum(vectors, maps, None)
        weights = total / n
        model = SvmModel(maps, weights, float(np.quantile(pilot_map @ weights, nu)))
        for t in range(1, steps + 1):
            outside, _ = _map_sum(vectors, maps, model)
            target = outside / (nu * n)
            weights = weights - 2 / (t + 1) * (weights - target)
            model = SvmModel(maps, weights, float(np.quantile(pilot_map @ weights, nu)))
    finally:
        vectors.unpersist()
    return model


def score_svm(prepared: Prepared, model: SvmModel, out: str = "raw_score") -> DataFrame:
    """Add the raw score: how far a row is outside the boundary."""
    shared = prepared.rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scorer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(-shared.value.decision(matrix(batch)))

    return prepared.rows.withColumn(out, scorer(*prepared.scaled))


def one_class_svm(
    df: DataFrame,
    features: list[str],
    contamination: float = 0.1,
    key: list[str] | None = None,
    waves: int = WAVES,
    steps: int = STEPS,
    seed: int = SEED,
) -> DataFrame:
    prepared = prepare(df, features)
    model = fit_svm(prepared, key, NU, waves, steps, seed)
    scored = score_svm(prepared, model)
    fitted = fit_scores(score_counts(scored, "raw_score"), contamination)
    return finish_model(scored, "raw_score", fitted)
