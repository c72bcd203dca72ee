"""Scores, daily rates and alerts over a stream, with a model that was fitted before.

Rows are scored one by one with the model's tables; nothing is kept between batches. Daily counts
are kept until the watermark, the latest event time seen less the allowed delay, has passed the end
of their day: rows that come later than that are left out. State is one row for each open day and
group, and is combined on the map side before it is shuffled, whatever the number of rows of a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.columns import col
from strayrow.operators.insights import _rate
from strayrow.operators.models import Model

DELAY = "1 day"
ALERT_FACTOR = 1.5  # fixed value


def stream_score(stream: DataFrame, model: Model) -> DataFrame:
    """Add the model's flag, score, probability and tier to the rows of a stream."""
    return model.score(stream)


def _zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def _wall_clock(time: Column, zone: str) -> Column:
    """The time that a clock of the session's zone shows, as if it were UTC.

    Event-time windows are cut at UTC days, and watermarks need timestamps with a zone.
    """
    return F.from_utc_timestamp(time.cast("timestamp"), zone)


def stream_daily_rate(
    scored: DataFrame, time: str, by: list[str] | None = None, delay: str = DELAY
) -> DataFrame:
    """Anomalies, rows and rate of each calendar day, and of each group ``by`` in it.

    Of a stream, in append mode: each day once, when it is over; in update mode: each day whenever
    its counts change. Rows without a time count nowhere; days without rows do not show. A batch
    table gives all days.
    """
    zone, by = _zone(scored), by or []
    timed = scored.select(
        _wall_clock(col(time), zone).alias("event_time"), *[col(c) for c in by], "anomaly"
    ).where(F.col("event_time").isNotNull())
    counted = (
        timed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("window"), *[col(c) for c in by])
        .agg(
            F.sum("anomaly").cast("bigint").alias("anomalies"),
            F.count("anomaly").alias("total"),
        )
    )
    start = F.to_date(F.to_utc_timestamp("window.start", zone))
    return counted.select(
        start.alias("day"), *[col(c) for c in by], "anomalies", "total",
        _rate("anomalies", "total").alias("anomaly_rate"),
    )


def alerts_of(rates: DataFrame, baseline: float, factor: float = ALERT_FACTOR) -> DataFrame:
    """Days whose rate is above ``factor`` times the baseline rate (in percent)."""
    limit = F.lit(float(baseline) * factor)
    return rates.where(F.col("anomaly_rate") > limit).withColumns(
        {
            "baseline_rate": F.lit(float(baseline)),
            "alert_rate": limit,
            "ratio": F.try_divide(F.col("anomaly_rate"), F.lit(float(baseline))),
        }
    )


def stream_alert(
    scored: DataFrame,
    time: str,
    baseline: float,
    by: list[str] | None = None,
    delay: str = DELAY,
    factor: float = ALERT_FACTOR,
) -> DataFrame:
    """Alerts for days that are over: each is judged once, on all rows that were not too late."""
    return alerts_of(stream_daily_rate(scored, time, by, delay), baseline, factor)
