"""Queries over signal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signals_for_instrument(signals: DataFrame, instrument_id: str) -> DataFrame:
    return signals.filter(F.col("instrument_id") == instrument_id.strip())


def signals_since(signals: DataFrame, now: Column, minutes: int) -> DataFrame:
    """The last ``minutes``, clamped to 1..1440, before ``now``."""
    minutes = min(1440, max(1, int(minutes)))
    return signals.filter(F.col("detected_at") >= now - F.expr(f"interval {minutes} minutes"))


def signal_summary(signals: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    counts = signals_since(signals, now, minutes).groupBy("signal_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "signal_type")


def recent_signals(signals: DataFrame, limit: int = 50, instrument_id: str | None = None) -> DataFrame:
    """Newest first, 1..500 of them; ties by signal_id."""
    chosen = signals_for_instrument(signals, instrument_id) if instrument_id else signals
    return chosen.orderBy(F.desc("detected_at"), "signal_id").limit(min(500, max(1, int(limit))))
