"""Sinks: signal tables, topics, threshold tables, fan-out. Candles have a store of their own (``store.py``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.schemas import SIGNAL
from tapewright.sources.store import write_candles

__all__ = ["signal_fanout", "topic_rows", "write_candles", "write_signals", "write_signals_jdbc", "write_threshold_overrides", "write_topic"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def write_signals(signals: DataFrame, path: str, batch_id: int | str | None = None) -> None:
    """Add to a Parquet table partitioned by day and batch. With a ``batch_id`` (that of a micro-batch) a
    redelivery replaces what the same batch wrote before, whole or half, and nothing is
    read. Without one, rows whose deterministic signal_id the days it touches already
    hold are left out; other days aren't read."""
    spark = signals.sparkSession
    dated = signals.dropDuplicates(["signal_id"]).withColumns({"date": F.to_date("detected_at"), "batch": F.lit("rows" if batch_id is None else str(batch_id))})
    if batch_id is not None:
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
        return
    dated = dated.persist()
    try:
        fresh = dated
        if _exists(spark, path):
            days = [r.date for r in dated.select("date").distinct().collect()]  # a row a day
            known = spark.read.schema(f"{SIGNAL}, date date, batch string").parquet(path).filter(F.col("date").isin(days))
            fresh = dated.join(known.select("signal_id", "date"), ["signal_id", "date"], "left_anti").select(*dated.columns)
        fresh.write.mode("append").partitionBy("date", "batch").parquet(path)
    finally:
        dated.unpersist()


def write_signals_jdbc(signals: DataFrame, url: str, table: str = "market_signals", **options: str) -> None:
    """Append to a table (whose key is signal_id). Rows whose id the table already holds at the
    batch's times are left out, so a redelivery after a half-written attempt adds the rest only."""
    once = signals.dropDuplicates(["signal_id"]).persist()
    try:
        span = once.agg(F.min("detected_at").alias("a"), F.max("detected_at").alias("b")).first()  # one row
        if span.a is None:
            return
        reader = once.sparkSession.read.options(**options)
        known = reader.jdbc(url, table).select("signal_id", "detected_at").filter(F.col("detected_at").between(span.a, span.b))
        once.join(known.select("signal_id"), "signal_id", "left_anti").select(*signals.columns).write.mode("append").options(**options).jdbc(url, table)
    finally:
        once.unpersist()


def topic_rows(rows: DataFrame, key: str = "instrument_id") -> DataFrame:
    """key and JSON value, as the Kafka sink takes them; nulls are left out of the JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def write_topic(rows: DataFrame, options: dict[str, str], stream: bool = False):
    """Events or signals keyed by instrument. Needs the Kafka connector."""
    out = topic_rows(rows)
    if stream:
        return out.writeStream.format("kafka").options(**options).start()
    out.write.format("kafka").options(**options).save()


def signal_fanout(table: Callable[..., None], topic: Callable[[DataFrame], None] | None = None, alerts: Sequence[Callable[[DataFrame], None]] = ()):
    """A foreachBatch function: the batch goes to the table (called with its id, if it takes two
    arguments), then the topic, then to alert
    sinks; a failing alert is told and never stops the others. Table and topic failures
    fail the batch as a whole, which is then redelivered."""
    with_id = len([p for p in signature(table).parameters.values() if p.default is p.empty]) > 1

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table(batch, batch_id) if with_id else table(batch)
            if topic:
                topic(batch)
            for alert in alerts:
                try:
                    alert(batch)
                except Exception as e:  # noqa: BLE001
                    print(f"alert sink failed on batch {batch_id}: {e}")
        finally:
            batch.unpersist()

    return run


def write_threshold_overrides(thresholds: DataFrame, path: str, generated_at, lookback_days: int, multiplier: float, metric: str = "hourly_abs_return_bps_mean") -> None:
    """Replaces the set as a whole: instruments that didn't pass drop out."""
    named = thresholds.select(
        "instrument_id", F.col("threshold_bps").alias("price_move_absolute_threshold_bps"), F.lit(generated_at).alias("generated_at"),
        F.lit(lookback_days).alias("lookback_days"), F.lit(metric).alias("metric"), F.lit(multiplier).alias("multiplier"),
    )
    named.write.mode("overwrite").parquet(path)
