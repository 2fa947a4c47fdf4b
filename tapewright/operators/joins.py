"""Lookups, subscriptions, overlaps and positional alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSION = ("instrument_id", "ticker", "class_code", "alias", "figi", "uid")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null key: the last in load order."""
    whole = F.max_by(F.struct(*df.columns), F.col(order)).alias("r")
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(whole).select("__k", "r.*")


def enrich_events(events: DataFrame, instruments: DataFrame, order: str = "load_order") -> DataFrame:
    """Event names from ``instruments`` by instrument_id, else figi, else uid; the last
    duplicate wins. A miss falls back to the first non-empty of the three, or 'unknown',
    and a lower-case alias. ``events`` has instrument_id, figi, uid; other columns stay.
    Most ids of a row are null: rows without a key are dealt by the row instead, so they
    don't meet in one task. Tasks hold their part of the instruments, which are unique by key, and stream
    events past them unsorted."""
    out = events.withColumn("__row", F.pmod(F.xxhash64(*events.columns), F.lit(1 << 20)).cast("int"))
    for key in ("instrument_id", "figi", "uid"):
        side = last_by(instruments, key, order)
        side = side.select("__k", F.lit(-1).alias("__n"), F.struct(*DIMENSION).alias(f"__by_{key}")).hint("shuffle_hash")
        dealt = F.when(F.col(key).isNull(), F.col("__row")).otherwise(F.lit(-1))
        out = out.join(side, (F.col(key) == F.col("__k")) & (dealt == F.col("__n")), "left").drop("__k", "__n")
    hit = F.coalesce("__by_instrument_id", "__by_figi", "__by_uid")
    full = lambda c: F.when(F.length(c) > 0, F.col(c))
    own = F.coalesce(full("instrument_id"), full("figi"), full("uid"), F.lit("unknown"))
    out = out.withColumn("__hit", hit).withColumn("__own", own)
    missing = F.col("__hit").isNull()
    named = {
        "instrument_id": F.when(missing, F.col("__own")).otherwise(F.col("__hit.instrument_id")),
        "ticker": F.when(missing, F.col("__own")).otherwise(F.col("__hit.ticker")),
        "class_code": F.col("__hit.class_code"),
        "alias": F.when(missing, F.lower("__own")).otherwise(F.col("__hit.alias")),
        "figi": F.coalesce("__hit.figi", "figi"),
        "uid": F.coalesce("__hit.uid", "uid"),
    }
    rest = [c for c in events.columns if c not in named]
    return out.select(*rest, *(c.alias(k) for k, c in named.items()))


def subscription_filter(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events of kinds their instrument subscribes to. ``subscriptions`` has
    instrument_id, trades, last_price, info, order_book_depth, candles. Books are cut to
    the depth asked for."""
    wanted = F.array_compact(F.array(
        F.when(F.col("trades"), F.lit("trade")), F.when(F.col("last_price"), F.lit("last_price")), F.when(F.col("info"), F.lit("trading_status")),
        F.when(F.col("order_book_depth") > 0, F.lit("orderbook")), F.when(F.col("candles"), F.lit("candle")),
    ))
    table = subscriptions.select(F.col("instrument_id").alias("__i"), F.explode(wanted).alias("__t"), F.col("order_book_depth").alias("__d"))
    kept = events.join(table, (F.col("instrument_id") == F.col("__i")) & (F.col("event_type") == F.col("__t")))
    for side in ("bids", "asks"):
        if side in events.columns:
            kept = kept.withColumn(side, F.when(F.col("event_type") == "orderbook", F.slice(side, F.lit(1), F.col("__d"))).otherwise(F.col(side)))
    return kept.select(*events.columns)


def instrument_lookup(requests: DataFrame, instruments: DataFrame, order: str = "load_order") -> DataFrame:
    """``requests(id_type, class_code, id)`` joined to the instrument whose figi, ticker or
    uid (by id_type; unspecified is figi) is ``id`` within the class; last duplicate wins."""
    kinds = F.array(*(F.struct(F.lit(k).alias("__kind"), F.col(k).alias("__id")) for k in ("figi", "ticker", "uid")))
    listed = instruments.select("*", F.explode(kinds).alias("__x")).select("*", "__x.*").drop("__x").filter("__id is not null")
    index = listed.groupBy("__kind", F.col("class_code").alias("__class"), "__id").agg(F.max_by(F.struct(*instruments.columns), order).alias("instrument"))
    kind = F.when(F.col("id_type").isin("figi", "ticker", "uid"), F.col("id_type")).otherwise("figi")
    on = (kind == F.col("__kind")) & (F.col("class_code") == F.col("__class")) & (F.col("id") == F.col("__id"))
    return requests.join(index, on).drop("__kind", "__class", "__id")


def range_overlap(requests: DataFrame, stored: DataFrame, key: str = "instrument_id", chunk: int = 86_400_000_000 * 32) -> DataFrame:
    """Overlaps of requested and stored ranges ``(key, start, end)``, touching ends count.
    Both sides are cut into time chunks and joined by key and chunk, so that a key with
    many ranges isn't paired up with itself; a pair reports in its first common chunk."""
    chunks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / chunk), F.floor(F.col(b) / chunk))).alias("c")
    r = requests.select(key, F.col("start").alias("rs"), F.col("end").alias("re"), chunks("start", "end"))
    c = stored.select(key, F.col("start").alias("cs"), F.col("end").alias("ce"), chunks("start", "end"))
    both = r.join(c, [key, "c"]).filter("rs <= ce and cs <= re").withColumn("start", F.greatest("rs", "cs")).withColumn("end", F.least("re", "ce"))
    return both.filter(F.floor(F.col("start") / chunk) == F.col("c")).select(key, F.col("rs").alias("request_start"), F.col("cs").alias("stored_start"), "start", "end")


def align_signals_to_candles(signals: DataFrame, candles: DataFrame, key: str = "instrument_id") -> DataFrame:
    """``signals(key, us)`` with ``position``, the index of the candle they fall on:
    int((t - t0) / (tn - t0) * n), at most n - 1, and that candle's ``candle_us``."""
    ends = candles.groupBy(key).agg(F.min("us").alias("t0"), F.max("us").alias("tn"), F.count("*").alias("n"))
    at = F.when(F.col("tn") > F.col("t0"), ((F.col("us") - F.col("t0")) / (F.col("tn") - F.col("t0")) * F.col("n")).cast("bigint")).otherwise(F.lit(0))
    placed = signals.join(ends, key).filter("us >= t0").withColumn("position", F.least(at, F.col("n") - 1))
    order = Window.partitionBy(key).orderBy("us")
    numbered = candles.select(key, F.col("us").alias("candle_us"), (F.row_number().over(order) - 1).cast("bigint").alias("position"))
    return placed.join(numbered, [key, "position"]).drop("t0", "tn", "n")


