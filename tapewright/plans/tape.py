"""The given tables seen as a market tape, candles, instruments and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.schemas import Settings

HOUR = 3600
SETTINGS = Settings(
    sample_every_seconds=6 * HOUR, min_baseline_points=5, baseline_points=20, trade_window_seconds=48 * HOUR, price_window_seconds=72 * HOUR, alert_cooldown_seconds=24 * HOUR,
    volume_zscore_threshold=1.513, trade_count_zscore_threshold=1.513, price_return_zscore_threshold=1.513, spread_zscore_threshold=1.513, imbalance_zscore_threshold=1.213,
    imbalance_absolute_threshold=0.5, combo_enabled=True, combo_freshness_seconds=48 * HOUR, combo_min_score=4, combo_alert_cooldown_seconds=48 * HOUR,
)
#: Instruments whose frames differ from the others', to have several groups of frames.
NARROW = SETTINGS.with_({"trade_window_seconds": 36 * HOUR, "volume_zscore_threshold": 1.713})


def us(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """click/purchase: buy/sell trade; signup: last price; view: book; error: status."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = lambda *x: F.col("t").isin(*x)
    d = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instrument_id"), us("ts").alias("us"), F.col("event_id").alias("seq"), F.col("event_type").alias("t"), "value", k.alias("k"))
    side = lambda price, qty: F.when(kind("view"), F.array(F.struct(price.alias("price"), qty.cast("double").alias("quantity"))))
    return d.select(
        "instrument_id", "us", "seq",
        F.when(kind("click", "purchase"), "trade").when(kind("signup"), "last_price").when(kind("view"), "orderbook").when(kind("error"), "trading_status").alias("event_type"),
        F.when(kind("click", "purchase"), F.col("value")).alias("quantity"),
        F.when(kind("click", "purchase", "signup"), 100 + F.col("k") / 10).alias("price"),
        F.when(kind("click"), "BUY").when(kind("purchase"), "SELL").alias("direction"),
        side(100 - F.col("value") / 100, F.col("k") + 1).alias("bids"),
        side(100 + F.col("value") / 100, 100 - F.col("k")).alias("asks"),
        F.when(kind("error"), F.element_at(F.array(F.lit("NORMAL"), F.lit("BREAK"), F.lit("CLOSE")), F.col("k") % 3 + 1)).alias("trading_status"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as ticks: instrument_id, us, price, volume and a total order."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.col("l_suppkey").cast("string").alias("instrument_id"), us("l_shipdate").alias("at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles per supplier: us, open, high, low, close, volume, is_complete, seq."""
    t = ticks(spark, sf_dir)
    order = F.struct("at", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    day = (F.col("at") - F.pmod(F.col("at"), F.lit(86_400_000_000))).alias("us")
    c = t.groupBy("instrument_id", day).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("ticks")
    )
    return c.select("instrument_id", "us", "open", "high", "low", "close", "volume", (F.col("ticks") >= 1).alias("is_complete"), F.floor(F.col("us") / 86_400_000_000).alias("seq"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    d = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return d.select(
        F.col("s_suppkey").cast("string").alias("instrument_id"), F.col("s_name").alias("ticker"), F.col("n_name").alias("class_code"), F.lower("s_name").alias("alias"),
        F.concat(F.lit("F"), "s_suppkey").alias("figi"), F.concat(F.lit("U"), "s_suppkey").alias("uid"), F.col("s_suppkey").alias("load_order"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of lineitem with one of three ids each, to be enriched."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_suppkey").alias("k"), F.max("l_quantity").alias("quantity"))
    by = F.col("l_orderkey") % 4
    return d.select(
        F.col("l_orderkey").alias("seq"), "quantity", F.when(by == 0, F.col("k").cast("string")).alias("instrument_id"),
        F.when(by == 1, F.concat(F.lit("F"), "k")).when(by == 3, F.concat(F.lit("NO"), "k")).alias("figi"), F.when(by == 2, F.concat(F.lit("U"), "k")).alias("uid"),
    )


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
