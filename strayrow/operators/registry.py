"""Detectors by name, open for new ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from strayrow.functions.materialize import pin_table
from strayrow.functions.sampling import sample_rows
from strayrow.operators.dbscan import dbscan
from strayrow.operators.forest import isolation_forest
from strayrow.operators.iqr import iqr_detect
from strayrow.operators.lof import local_outlier_factor
from strayrow.operators.svm import one_class_svm
from strayrow.operators.zscore import zscore_detect

SAMPLE_ROWS = 50_000  # fixed value


@dataclass(frozen=True)
class Detector:
    """``run(df, features, **params)`` adds anomaly, score, probability and tier columns."""

    run: Callable[..., DataFrame]
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    sampled: bool = False
    takes_key: bool = False


DETECTORS: dict[str, Detector] = {
    "zscore": Detector(zscore_detect, "statistical", {"threshold": 3.0}),
    "iqr": Detector(iqr_detect, "statistical"),
    "isolation_forest": Detector(
        isolation_forest, "ml", {"contamination": 0.1}, takes_key=True
    ),
    "lof": Detector(local_outlier_factor, "ml", {"contamination": 0.1}, sampled=True),
    "one_class_svm": Detector(
        one_class_svm, "ml", {"contamination": 0.1}, sampled=True, takes_key=True
    ),
    "dbscan": Detector(dbscan, "ml", {"eps": 0.5, "min_rows": 5}, takes_key=True),
}


def register_detector(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


def ml_sample_policy(
    df: DataFrame, method: str, key: list[str] | None = None, limit: int = SAMPLE_ROWS
) -> DataFrame:
    """All rows, or ``limit`` random ones for detectors that are sampled by default.

    The sample is written once: a detector passes over it many times.
    """
    if not DETECTORS[method].sampled:
        return df
    total = df.count()
    return df if total <= limit else pin_table(sample_rows(df, limit, key, total=total), "sample")


def detect(
    df: DataFrame,
    method: str,
    features: list[str],
    key: list[str] | None = None,
    sample: bool = False,
    **params: Any,
) -> DataFrame:
    """Run a registered detector; ``sample`` applies the default sample policy first."""
    if method not in DETECTORS:
        raise ValueError(f"unknown detector: {method}")
    detector = DETECTORS[method]
    if sample:
        df = ml_sample_policy(df, method, key)
    options = detector.params | params
    if detector.takes_key:
        options["key"] = key
    return detector.run(df, features, **options)
