"""The two operators that also run on unbounded input: minute resampling and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meridia.operators.circadian import resample_minute
from meridia.operators.scoring import ScoringModel


def live_minutes(readings: DataFrame, channels: list[str], late: str = "10 minutes") -> DataFrame:
    """One-minute means of a stream; a minute is emitted once the watermark has passed it."""
    return resample_minute(readings.withWatermark("ts", late), channels)


def live_scores(rows: DataFrame, model: ScoringModel, keep: list[str]) -> DataFrame:
    """Scores of a stream of feature rows; stateless, same contract check as in batch."""
    return model.score(rows, keep)
