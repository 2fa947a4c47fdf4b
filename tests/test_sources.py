"""Sources and sinks on files as their users write them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.operators.joins import enrich_events
from tapewright.schemas import Settings
from tapewright.sources import readers as R
from tapewright.sources import sinks as K

INSTRUMENTS = """
instruments:
  - ticker: " abc "
    class_code: main
    alias: Abc
    subscriptions:
      trades: true
      info: false
      order_book_depth: 50
      candles: true
      candle_interval: 5m
  - ticker: DEF
    class_code: MAIN
    subscriptions:
      last_price: false
      order_book_depth:
  - ticker: 77
    class_code: side
"""


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_instruments_of_a_file(spark, tmp_path):
    pytest.importorskip("yaml")
    got = {r.instrument_id: r.asDict() for r in R.read_instruments(spark, write(tmp_path, "i.yaml", INSTRUMENTS)).collect()}
    flags = lambda r: tuple(r[k] for k in ("alias", "trades", "last_price", "info", "order_book_depth", "candles", "candle_interval"))
    assert {k: flags(v) for k, v in got.items()} == {
        "ABC_MAIN": ("abc", True, True, False, 50, True, "5m"),
        "DEF_MAIN": ("def", True, False, True, None, False, "1m"),
        "77_SIDE": ("77", True, True, True, None, False, "1m"),
    }
    with pytest.raises(Exception, match="mapping"):
        R.read_instruments(spark, write(tmp_path, "bad.yaml", "instruments: [x]")).collect()
    assert R.read_instruments(spark, write(tmp_path, "none.yaml", "{}")).count() == 0


def test_settings_of_files(spark, tmp_path):
    pytest.importorskip("yaml")
    main = write(tmp_path, "d.yaml", "detector:\n  volume_zscore_threshold: 3\n  unheard_of: 1\nper_instrument:\n  ' A ': {trade_window_seconds: 30}\n  5: {combo_enabled: true}\n  B: {min_baseline_points: 3}\n  '': {}\n")
    own = write(tmp_path, "o.yaml", "per_instrument:\n  B:\n    volume_zscore_threshold: 99.0\n")
    default, blocks = R.read_detector_settings(spark, main, own)
    base = Settings(volume_zscore_threshold=3.0)
    assert default == base
    assert blocks == {"A": base.with_({"trade_window_seconds": 30}), "5": base.with_({"combo_enabled": True}), "B": base.with_({"volume_zscore_threshold": 99.0})}


def candle(who, time):
    return (who, "DAY", time, 1, 1, 1, 1, 5, True)


def test_candles_of_a_range_read_its_months_only(spark, tmp_path):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(days=20 * k) for k in range(20)]
    schema = "instrument_id string, interval string, time timestamp, open int, high int, low int, close int, volume bigint, is_complete boolean"
    rows = spark.createDataFrame([candle("a", t) for t in times], schema).withColumns({c: F.col(c).cast("decimal(28,9)") for c in ("open", "high", "low", "close")})
    path = str(tmp_path / "c")
    K.write_candles(rows, path)
    got = R.read_candles(spark, path, "DAY", times[3], times[5])
    assert sorted(r.time for r in got.collect()) == times[3:6]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 2024-03-01)" in plan and "<= 2024-04-01)" in plan
    assert R.read_candles(spark, path).count() == 20


def test_signals_are_written_once_a_day_touched(spark, tmp_path):
    from tapewright.schemas import SIGNAL

    day = lambda d, k: (f"{d}-{k}", dt.datetime(2024, 1, d, 5), "a", None, None, None, "trade", "volume_spike", 1, 1.0, 1.0, 1.0, 60, "s", "{}")
    path = str(tmp_path / "s")
    for batch in ([day(1, 0), day(2, 0)], [day(2, 0), day(2, 1)], [day(3, 0), day(3, 0)], []):
        K.write_signals(spark.createDataFrame(batch, SIGNAL), path)
    assert sorted(r.signal_id for r in R.read_signals(spark, path).collect()) == ["1-0", "2-0", "2-1", "3-0"]


def test_enrich_of_mostly_null_keys(spark):
    names = spark.createDataFrame([("I", "T", "C", "al", "F", "U", 1), ("J", "T2", "C", "al2", "F", "V", 2)], "instrument_id string, ticker string, class_code string, alias string, figi string, uid string, load_order int")
    events = [(1, None, None, "U"), (2, None, "F", "U"), (3, "I", "F", None), (4, None, None, None), (5, None, "?", "V"), (6, "", None, "x")]
    got = enrich_events(spark.createDataFrame(events, "seq int, instrument_id string, figi string, uid string"), names)
    assert {r.seq: (r.instrument_id, r.alias) for r in got.collect()} == {1: ("I", "al"), 2: ("J", "al2"), 3: ("I", "al"), 4: ("unknown", "unknown"), 5: ("J", "al2"), 6: ("x", "x")}
    assert "__row" not in got.columns
