"""Fitted detectors as small tables that can be saved, loaded and applied to other rows.

``fit_model`` learns from one table what the detector of that name learns; ``Model.score`` adds the
same columns to any table with these features, batch or stream, as one projection without a
shuffle. On the rows it was fitted on, a model gives what the detector gives. The tables do not
grow with the data: a row for each feature, at most 10,001 probability steps, and the nodes of the
forest or the weights of the boundary. Scores beyond those seen get the first or last probability.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.functions.ranking import ScoreDistribution, score_distribution
from strayrow.operators.forest import SEED, TREE_ROWS, TREES, Forest, fit_forest, score_forest
from strayrow.operators.iqr import Fences, distance, fit_fences, outside
from strayrow.operators.scaling import (
    Fitted,
    Prepared,
    finish_model,
    fit_medians,
    fit_scores,
    median_impute,
    prepare,
    scaled,
    score_counts,
)
from strayrow.operators.scoring import finish
from strayrow.operators.svm import NU, STEPS, WAVES, SvmModel, Waves, fit_svm, score_svm
from strayrow.operators.zscore import Moments, column_moments, largest_zscore, zscore_max

_INFO = "info"


@dataclass
class Model:
    """``info`` holds single numbers, ``tables`` the rest, by name."""

    method: str
    features: list[str]
    info: dict[str, float | int | None] = field(default_factory=dict)
    tables: dict[str, pa.Table] = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """Add the detector's columns to the rows of ``df``."""
        return _KINDS[self.method][1](self, df)

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet table for each part, below ``path``; fails if there is one already."""
        head = pa.table(
            {"method": [self.method], "features": [self.features], "numbers": [json.dumps(self.info)]}
        )
        for name, table in {_INFO: head, **self.tables}.items():
            # Bounded by the model, so one file; row numbers keep the order.
            placed = table.append_column("place", pa.array(np.arange(len(table)), pa.int64()))
            spark.createDataFrame(placed).coalesce(1).write.parquet(os.path.join(path, name))

    # What several kinds of models keep

    def _put_steps(self, distribution: ScoreDistribution) -> None:
        steps = distribution.steps()
        self.tables["steps"] = pa.table(
            {
                "score": pa.array([float(s) for s, _ in steps], pa.float64()),
                "probability": pa.array([float(p) for _, p in steps], pa.float64()),
            }
        )
        self.info |= {"rows": distribution.n, "low": distribution.low, "high": distribution.high}

    def _distribution(self) -> ScoreDistribution:
        steps = list(zip(*(self.tables["steps"][c].to_pylist() for c in ("score", "probability"))))
        return ScoreDistribution(None, self.info["rows"], self.info["low"], self.info["high"], steps)

    def _put_per_feature(self, name: str, names: tuple[str, ...], values: dict[str, tuple]) -> None:
        columns = {n: pa.array([v[i] for v in values.values()], pa.float64()) for i, n in enumerate(names)}
        self.tables[name] = pa.table({"feature": list(values), **columns})

    def _per_feature(self, name: str) -> dict[str, tuple]:
        first, *rest = (c.to_pylist() for c in self.tables[name].columns)
        return dict(zip(first, zip(*rest)))

    def _fitted(self) -> Fitted:
        return Fitted(
            self.info["raw_low"], self.info["raw_high"], self.info["threshold"], self._distribution()
        )

    def _prepared(self, df: DataFrame) -> Prepared:
        medians = {c: m for c, (m,) in self._per_feature("medians").items()}
        moments: Moments = self._per_feature("moments")
        rows = median_impute(df, self.features, medians)
        return Prepared(rows, [scaled(c, moments) for c in self.features], self.info["rows"])


def fit_model(df: DataFrame, method: str, features: list[str], **params: Any) -> Model:
    """Learn what the detector ``method`` learns from ``df``."""
    if method not in _KINDS:
        raise ValueError(f"no model of this name: {method}")
    return _KINDS[method][0](df, features, **params)


def load_model(spark: SparkSession, path: str) -> Model:
    """A model that ``Model.save`` wrote."""

    def table(name: str) -> pa.Table:
        return spark.read.parquet(os.path.join(path, name)).orderBy("place").drop("place").toArrow()

    head = table(_INFO).to_pylist()[0]
    names = _KINDS[head["method"]][2]
    return Model(head["method"], head["features"], json.loads(head["numbers"]), {n: table(n) for n in names})


# Statistical detectors


def _fit_zscore(df: DataFrame, features: list[str], threshold: float = 3.0) -> Model:
    model = Model("zscore", list(features), {"threshold": float(threshold)})
    moments = column_moments(df, features)
    model._put_per_feature("moments", ("mean", "deviation"), moments)
    model._put_steps(score_distribution(df, largest_zscore(features, moments)))
    return model


def _score_zscore(model: Model, df: DataFrame) -> DataFrame:
    scored = zscore_max(df, model.features, model._per_feature("moments"))
    score = F.col("max_zscore")
    return finish(scored, score > F.lit(model.info["threshold"]), score, model._distribution())


def _fit_iqr(df: DataFrame, features: list[str]) -> Model:
    model = Model("iqr", list(features))
    fences = fit_fences(df, features)
    model._put_per_feature("fences", ("lower", "upper"), fences)
    model._put_steps(score_distribution(df, distance(fences)))
    return model


def _score_iqr(model: Model, df: DataFrame) -> DataFrame:
    fences: Fences = model._per_feature("fences")
    return finish(df, outside(fences), distance(fences), model._distribution())


# Models over imputed and scaled features


def _put_preparation(model: Model, df: DataFrame) -> Prepared:
    medians = fit_medians(df, model.features)
    prepared = prepare(df, model.features, medians)
    model._put_per_feature("medians", ("median",), {c: (m,) for c, m in medians.items()})
    model._put_per_feature("moments", ("mean", "deviation"), prepared.moments)
    return prepared


def _put_scores(model: Model, scored: DataFrame, contamination: float) -> Model:
    fitted = fit_scores(score_counts(scored, "raw_score"), contamination)
    model._put_steps(fitted.distribution)
    model.info |= {"raw_low": fitted.low, "raw_high": fitted.high, "threshold": fitted.threshold}
    return model


def _fit_isolation_forest(
    df: DataFrame,
    features: list[str],
    contamination: float = 0.1,
    key: list[str] | None = None,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = SEED,
) -> Model:
    model = Model("isolation_forest", list(features))
    prepared = _put_preparation(model, df)
    forest = fit_forest(prepared, key, trees, tree_rows, seed)
    model.tables["nodes"] = pa.table({n: getattr(forest, n) for n in ("feature", "split", "left", "right", "path")})
    model.tables["roots"] = pa.table({"root": forest.roots})
    model.info |= {"depth": forest.depth, "tree_rows": forest.tree_rows}
    return _put_scores(model, score_forest(prepared, forest), contamination)


def _score_isolation_forest(model: Model, df: DataFrame) -> DataFrame:
    nodes = {n: model.tables["nodes"][n].to_numpy() for n in ("feature", "split", "left", "right", "path")}
    roots = model.tables["roots"]["root"].to_numpy()
    forest = Forest(**nodes, roots=roots, depth=model.info["depth"], tree_rows=model.info["tree_rows"])
    return finish_model(score_forest(model._prepared(df), forest), "raw_score", model._fitted())


def _fit_one_class_svm(
    df: DataFrame,
    features: list[str],
    contamination: float = 0.1,
    key: list[str] | None = None,
    waves: int = WAVES,
    steps: int = STEPS,
    seed: int = SEED,
) -> Model:
    model = Model("one_class_svm", list(features))
    prepared = _put_preparation(model, df)
    boundary = fit_svm(prepared, key, NU, waves, steps, seed)
    model.tables["waves"] = pa.table({"frequency": boundary.waves.frequencies.ravel()})
    model.tables["weights"] = pa.table({"weight": np.asarray(boundary.weights, float)})
    model.info["offset"] = boundary.offset
    return _put_scores(model, score_svm(prepared, boundary), contamination)


def _score_one_class_svm(model: Model, df: DataFrame) -> DataFrame:
    frequencies = model.tables["waves"]["frequency"].to_numpy().reshape(len(model.features), -1)
    weights = model.tables["weights"]["weight"].to_numpy()
    boundary = SvmModel(Waves(frequencies), weights, model.info["offset"])
    return finish_model(score_svm(model._prepared(df), boundary), "raw_score", model._fitted())


_KINDS = {
    "zscore": (_fit_zscore, _score_zscore, ("moments", "steps")),
    "iqr": (_fit_iqr, _score_iqr, ("fences", "steps")),
    "isolation_forest": (
        _fit_isolation_forest, _score_isolation_forest, ("medians", "moments", "nodes", "roots", "steps")
    ),
    "one_class_svm": (
        _fit_one_class_svm, _score_one_class_svm, ("medians", "moments", "waves", "weights", "steps")
    ),
}

