"""Windowed aggregation and stateful runs over event streams; the same functions serve batch frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and sum per window and key; late bounds how long a window waits in a stream."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, width, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Sessions that end after a gap without events."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n", "total")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch of a stream, by state kept per key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def resumed(fetched: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What an interrupted crawl still has to fetch."""
    return wanted.join(fetched.select(*keys), keys, "left_anti")
