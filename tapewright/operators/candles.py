"""Candle history: cleaning, merging, coverage, thresholds. Times are bigint ``us``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.scalars import DAY, ORIGIN_US, SECOND, floor_us, quotation_to_decimal

KEY = "instrument_id"
CHUNK = 32 * DAY


def complete_candles(candles: DataFrame) -> DataFrame:
    return candles.filter("is_complete")


def candles_in_range(candles: DataFrame, start: int, end: int) -> DataFrame:
    return candles.filter(F.col("us").between(start, end))


def fresh_candles(candles: DataFrame, now: int, interval_seconds: int) -> DataFrame:
    return candles.filter(F.col("us") >= floor_us(F.lit(now), interval_seconds * SECOND))


def priced_candles(candles: DataFrame) -> DataFrame:
    return candles.filter("open is not null and close is not null and open > 0")


def candle_abs_return_bps(open_: Column, close: Column) -> Column:
    return F.when(open_ > 0, F.abs((close - open_) / open_) * 10_000)


def hourly_thresholds(candles: DataFrame, now: int, lookback_days: int = 7, multiplier: float = 1.0, at_least: int = 24, complete_only: bool = False) -> DataFrame:
    """Per instrument: mean absolute return in bps times ``multiplier``, to 4 places, if at
    least ``at_least`` usable candles lie in the look-back."""
    recent = candles.filter(F.col("us") >= now - lookback_days * DAY)
    usable = priced_candles(complete_candles(recent) if complete_only else recent)
    agg = usable.groupBy(KEY).agg(F.avg(candle_abs_return_bps(F.col("open"), F.col("close"))).alias("mean_bps"), F.count("*").alias("n"))
    return agg.filter(F.col("n") >= at_least).select(KEY, F.round(F.col("mean_bps") * multiplier, 4).alias("threshold_bps"), "n")


def drop_superseded(candles: DataFrame, arrival: str = "seq") -> DataFrame:
    """Of a run of candles with equal time, the last to arrive."""
    w = Window.partitionBy(KEY).orderBy("us", arrival)
    return candles.withColumn("__next", F.lead("us").over(w)).filter("__next is null or __next > us").drop("__next")


def latest_per_bucket(candles: DataFrame, interval_seconds: int, arrival: str = "seq") -> DataFrame:
    """The last candle to arrive in each interval, which live candles replace."""
    bucket = floor_us(F.col("us"), interval_seconds * SECOND).alias("bucket_us")
    return candles.groupBy(KEY, bucket).agg(F.max_by(F.struct(*[c for c in candles.columns if c != KEY]), arrival).alias("c")).select(KEY, "bucket_us", "c.*")


def late_candles(candles: DataFrame, interval_seconds: int, arrival: str = "seq") -> DataFrame:
    """Candles whose interval is over when they arrive: a later interval came first."""
    seen = Window.partitionBy(KEY).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    bucket = floor_us(F.col("us"), interval_seconds * SECOND)
    return candles.withColumn("__top", F.max(bucket).over(seen)).filter(bucket < F.col("__top")).drop("__top")


def merge_candles(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by time; where both have a candle, the first one's stays."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1)))
    w = Window.partitionBy(KEY, "us").orderBy("__p")
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__p", "__r")


def dedupe_chunks(candles: DataFrame) -> DataFrame:
    """Chunks of a history overlap: equal in all fields means one candle."""
    return candles.dropDuplicates()


def candle_count_check(candles: DataFrame, short_seconds: int, long_seconds: int, interval_seconds: int) -> DataFrame:
    n = F.count("*")
    return candles.groupBy(KEY).agg(n.alias("n"), (n >= (short_seconds + long_seconds) / interval_seconds).alias("enough"))


def trading_density(candles: DataFrame, interval_seconds: int) -> DataFrame:
    span = F.max("us") - F.min("us")
    return candles.groupBy(KEY).agg(F.when(span > 0, F.count("*") / (span / F.lit(interval_seconds * SECOND))).alias("density"))


def coalesced(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges ``(keys.., start, end)`` that overlap or touch become one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def coverage_coalesce(ranges: DataFrame) -> DataFrame:
    """Ranges ``(instrument_id, start, end)`` that overlap or touch become one."""
    return coalesced(ranges, [KEY])


def coverage_gaps(requests: DataFrame, stored: DataFrame, interval_seconds: int) -> DataFrame:
    """What of ``requests`` isn't in ``stored`` (both instrument_id, start, end; any number of ranges a
    key, in any order, overlapping or not): ``(instrument_id, start, end)`` of the holes before and between
    stored ranges, and of a tail up to where requests end if a whole interval fits. Requests that
    overlap or touch are one. Ranges with a null or an end before their start are left out.

    A sweep: each start and end is a point, points carry how many requests and stored ranges
    begin less how many end there, and running totals tell where something is wanted and
    nothing stored. No range meets another in a join."""

    def points(ranges: DataFrame, wanted: int) -> DataFrame:
        ok = ranges.filter("start <= end")
        step = lambda at, by: F.struct(F.col(at).cast("bigint").alias("at"), F.lit(by * wanted).alias("wanted"), F.lit(by * (1 - wanted)).alias("stored"), F.lit(by > 0 and not wanted).alias("begins"))
        return ok.select(KEY, F.explode(F.array(step("start", 1), step("end", -1))).alias("p")).select(KEY, "p.*")

    both = points(requests, 1).unionByName(points(stored, 0))
    at = both.groupBy(KEY, "at").agg(F.sum("wanted").alias("wanted"), F.sum("stored").alias("stored"), F.bool_or("begins").alias("begins"))
    w = Window.partitionBy(KEY).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = at.withColumns({"asked": F.sum("wanted").over(so_far) > 0, "open": (F.sum("wanted").over(so_far) > 0) & (F.sum("stored").over(so_far) == 0)})
    # points at which a hole begins or ends; a stored range without length ends one and begins the next
    moved = d.withColumn("was", F.coalesce(F.lag("open").over(w), F.lit(False))).filter("open <> was or (open and begins)")
    ended = moved.withColumns({"end": F.lead("at").over(w), "stored_there": F.lead("begins").over(w)})
    long_enough = F.col("stored_there") | (F.col("at") + interval_seconds * SECOND <= F.col("end"))
    return ended.filter(F.col("open") & long_enough).select(KEY, F.col("at").alias("start"), "end")


def rounded_coverage(ranges: DataFrame, interval_seconds: int) -> DataFrame:
    """Ranges as they are stored: ends floored to the interval."""
    return ranges.withColumn("end", floor_us(F.col("end"), interval_seconds * SECOND))


def within(candles: DataFrame, ranges: DataFrame) -> DataFrame:
    """``candles`` that lie in one of ``ranges (instrument_id, start, end)``, once each. Ranges are
    cut into chunks of time, so a candle meets the ranges of its chunk only."""
    cut = ranges.filter("start <= end").select(KEY, F.col("start").alias("__s"), F.col("end").alias("__e"))
    cut = cut.withColumn("__c", F.explode(F.sequence(F.floor(F.col("__s") / CHUNK), F.floor(F.col("__e") / CHUNK))))
    placed = candles.withColumn("__c", F.floor(F.col("us") / CHUNK))
    on = (placed[KEY] == cut[KEY]) & (placed["__c"] == cut["__c"]) & placed["us"].between(cut["__s"], cut["__e"])
    return placed.join(cut, on, "left_semi").drop("__c")


def stitched_candles(stored: DataFrame, coverage: DataFrame, loaded: DataFrame, requests: DataFrame, interval_seconds: int) -> DataFrame:
    """Candles of ``requests`` (any number a key): stored ones, and loaded ones that are
    complete and lie in a gap; then one per time. Where both touch, stored ones win."""
    gaps = coverage_gaps(requests, coverage, interval_seconds)
    new = within(complete_candles(loaded), gaps).dropDuplicates([KEY, "us"])
    return merge_candles(within(stored, requests), new)


def candle_rows(quoted: DataFrame) -> DataFrame:
    """Quotation candles to decimals."""
    return quoted.withColumns({c: quotation_to_decimal(F.col(c)) for c in ("open", "high", "low", "close")})


assert ORIGIN_US % DAY == 0  # days and shorter intervals align with the epoch too
