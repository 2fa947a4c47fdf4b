"""Column functions over quotations, times, books and payloads. All null-safe:
a null input gives null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 1_000_000_000
#: Microseconds of 0001-01-01 UTC, a Monday, from which aligned times count.
ORIGIN_US = -62_135_596_800_000_000
SECOND, DAY = 1_000_000, 86_400_000_000
# fixed values: lengths of candle intervals and the longest range one request may ask for, in seconds
INTERVAL_SECONDS = {
    "1_MIN": 60, "2_MIN": 120, "3_MIN": 180, "5_MIN": 300, "10_MIN": 600, "15_MIN": 900, "30_MIN": 1800,
    "HOUR": 3600, "2_HOUR": 7200, "4_HOUR": 14400, "DAY": 86400, "WEEK": 604800, "MONTH": 2592000, "UNSPECIFIED": 60,
}
MAX_SPAN_SECONDS = {
    "1_MIN": 86400, "2_MIN": 86400, "3_MIN": 86400, "5_MIN": 86400, "10_MIN": 86400, "15_MIN": 86400, "30_MIN": 86400,
    "HOUR": 604800, "2_HOUR": 604800, "4_HOUR": 604800, "DAY": 31536000, "WEEK": 31536000, "MONTH": 94608000,
}
ALIASES = {"1m": "ONE_MINUTE", "5m": "FIVE_MINUTES", "15m": "FIFTEEN_MINUTES", "1h": "ONE_HOUR", "1d": "ONE_DAY"}
# fixed values: codes of trading statuses, candle intervals and trade directions
TRADING_STATUS = {
    "UNSPECIFIED": 0, "NOT_AVAILABLE_FOR_TRADING": 1, "OPENING_PERIOD": 2, "CLOSING_PERIOD": 3, "BREAK_IN_TRADING": 4, "NORMAL_TRADING": 5,
    "CLOSING_AUCTION": 6, "DARK_POOL_AUCTION": 7, "DISCRETE_AUCTION": 8, "OPENING_AUCTION_PERIOD": 9, "TRADING_AT_CLOSING_AUCTION_PRICE": 10,
    "SESSION_ASSIGNED": 11, "SESSION_CLOSE": 12, "SESSION_OPEN": 13, "DEALER_NORMAL_TRADING": 14, "DEALER_BREAK_IN_TRADING": 15, "DEALER_NOT_AVAILABLE_FOR_TRADING": 16,
}
CANDLE_INTERVAL = {
    "UNSPECIFIED": 0, "1_MIN": 1, "5_MIN": 2, "15_MIN": 3, "HOUR": 4, "DAY": 5, "2_MIN": 6, "3_MIN": 7, "10_MIN": 8, "30_MIN": 9, "2_HOUR": 10, "4_HOUR": 11, "WEEK": 12, "MONTH": 13,
}
TRADE_DIRECTION = {"UNSPECIFIED": 0, "BUY": 1, "SELL": 2}


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small constant table, ``default`` (a literal) where the key is missing."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def enum_code(table: dict, name: Column, prefix: str = "") -> Column:
    """Code of a name, with or without the enumeration's prefix; null for what it doesn't have."""
    return lookup(table, F.regexp_replace(F.upper(F.trim(name)), f"^{prefix}", "") if prefix else F.upper(F.trim(name)))


def enum_name(table: dict, code: Column) -> Column:
    """Name of a code, without a prefix."""
    return lookup({v: k for k, v in table.items()}, code.cast("int"))


def quotation_to_double(q: Column) -> Column:
    return q["units"] + q["nano"] / NANO


def quotation_to_decimal(q: Column) -> Column:
    return (q["units"].cast("decimal(19,0)") + q["nano"].cast("decimal(10,0)") / F.lit(NANO).cast("decimal(10,0)")).cast("decimal(28,9)")


def decimal_to_quotation(d: Column) -> Column:
    """Normalised: 0 <= nano < 1e9, also for negative values."""
    d = d.cast("decimal(28,9)")
    units = F.floor(d)
    return F.struct(units.cast("bigint").alias("units"), ((d - units) * NANO).cast("int").alias("nano"))


def signed_quantity(direction: Column, quantity: Column) -> Column:
    """+q for a buy, -q for a sell, 0 for anything else, nulls included."""
    side = F.upper(F.trim(direction))
    signed = F.when(side.isin("TRADE_DIRECTION_BUY", "BUY", "1"), quantity).when(side.isin("TRADE_DIRECTION_SELL", "SELL", "2"), -quantity)
    return F.coalesce(signed, F.lit(0.0))


def severity(z: Column) -> Column:
    return F.when(z >= 6, 3).when(z >= 4, 2).otherwise(1)


def proto_timestamp(seconds: Column, nanos: Column) -> Column:
    return F.timestamp_micros(seconds * SECOND + F.expr("1") * F.floor(nanos / 1000).cast("bigint"))


def to_proto(t: Column):
    us = F.unix_micros(t)
    return F.struct(F.floor(us / SECOND).cast("bigint").alias("seconds"), (F.pmod(us, F.lit(SECOND)) * 1000).cast("int").alias("nanos"))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 with Z or an offset; without one it is UTC (the session's zone is to be
    UTC). What isn't a time gives null."""
    return F.try_to_timestamp(text)


def source_time(time: Column, last_trade_ts: Column, now: Column) -> Column:
    return F.coalesce(parse_timestamp(time), parse_timestamp(last_trade_ts), now)


def instrument_key(ticker: Column, class_code: Column) -> Column:
    return F.concat_ws("_", ticker, class_code)


def floor_us(us: Column, step: int) -> Column:
    return us - F.pmod(us - F.lit(ORIGIN_US), F.lit(step))


def ceil_us(us: Column, step: int) -> Column:
    return us + F.pmod(F.lit(ORIGIN_US) - us, F.lit(step))


def floor_minute(t: Column) -> Column:
    return F.date_trunc("minute", t)


def request_ranges(start: Column, end: Column, interval: str) -> Column:
    """Array of struct<start, end> in microseconds: pieces of the interval's longest
    span, the last one only if a whole interval fits. Empty if none does."""
    step, span = INTERVAL_SECONDS[interval] * SECOND, MAX_SPAN_SECONDS[interval] * SECOND
    starts = F.when(start + step <= end, F.sequence(start, end - step, F.lit(span).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + span, end).alias("end")))


def top_sum(side: Column, levels: int = 3) -> Column:
    """Quantity of the first levels of a side of the book; null quantities are 0."""
    return F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda a, x: a + F.coalesce(x["quantity"], F.lit(0.0)))


def book_metrics(bids: Column, asks: Column) -> Column:
    """struct<best_bid, best_ask, spread_bps, imbalance_abs, bid_share>; null for a book
    with an empty side, a best price that isn't positive, or no quantity on top."""
    bid, ask = F.get(bids, F.lit(0))["price"], F.get(asks, F.lit(0))["price"]
    b, a = top_sum(bids), top_sum(asks)
    mid = (bid + ask) / 2
    whole = F.struct(
        bid.alias("best_bid"),
        ask.alias("best_ask"),
        ((ask - bid) / mid * 10_000).alias("spread_bps"),
        F.abs((b - a) / (b + a)).alias("imbalance_abs"),
        (b / (b + a)).alias("bid_share"),
    )
    return F.when((bid > 0) & (ask > 0) & (b + a > 0), whole)


def move_bps(now: Column, before: Column) -> Column:
    """Null where ``before`` isn't positive."""
    return F.when(before > 0, F.abs((now - before) / before) * 10_000)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """A flat baseline makes 999 of anything above it and 0 of the rest."""
    return F.when(std <= 1e-12, F.when(value > mean, 999.0).otherwise(0.0)).otherwise((value - mean) / std)


def prune_empty(c: Column) -> Column:
    """Empty strings, arrays and maps to null; ``to_json`` leaves nulls out."""
    return F.when(F.size(c) > 0, c)


def two_places(c: Column) -> Column:
    """Rounded half up by its decimal digits, so that texts don't hang on the last bit."""
    return F.round(c.cast("decimal(28,10)"), 2).cast("double")


def alert_text(s) -> Column:
    """Chat text of a signal row; ``s`` maps names to columns."""
    return F.format_string("[%s] %s\n%s\nSeverity=%d z=%.2f", s["signal_type"], s["ticker"], s["summary"], s["severity"], two_places(s["z_score"]))


def notification(s) -> Column:
    title = F.left(F.concat_ws(" | ", s["ticker"], s["signal_type"]), F.lit(64))
    body = F.left(F.format_string("%s\nSeverity=%d | z=%.2f", s["summary"], s["severity"], two_places(s["z_score"])), F.lit(240))
    return F.struct(title.alias("title"), body.alias("body"))


def summary_text(kind: Column, ticker: Column, metric: Column, baseline: Column, z: Column, window: Column) -> Column:
    """Sentence of a z-score signal."""
    metric, baseline, z = two_places(metric), two_places(baseline), two_places(z)
    said = lambda what, unit="": F.format_string(f"%s {what} %.2f{unit} vs baseline %.2f (z=%.2f).", ticker, metric, baseline, z)
    return (
        F.when(kind == "volume_spike", said("rolling volume hit", " lots"))
        .when(kind == "trade_rate_spike", said("trade count reached"))
        .when(kind == "spread_widening", said("spread widened to", " bps"))
        .when(kind == "orderbook_imbalance", said("order book imbalance reached"))
        .when(kind == "price_jump", F.format_string("%s moved %.2f bps in %ds vs baseline %.2f (z=%.2f).", ticker, metric, window, baseline, z))
    )
