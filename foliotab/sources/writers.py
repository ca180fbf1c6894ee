"""Sinks for results and events."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(df: DataFrame, path: str, experiment: str = "experiment_id", fmt: str = "json") -> None:
    """One folder per experiment."""
    df.write.mode("overwrite").partitionBy(experiment).format(fmt).save(path)


def append_events(df: DataFrame, path: str) -> None:
    """One JSON object per line, added to what is there."""
    df.write.mode("append").json(path)
