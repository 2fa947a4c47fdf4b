"""Every registered query of the market library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tapewright.plans import catalog, tape

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, data, db, name):
    got = catalog.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    expected = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    rows = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(tuple(map(norm, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(norm, r)) for r in rows)


def test_signals_of_an_instrument_come_from_its_events_alone(spark, data):
    lines = catalog.QUERIES["signals_for_instrument"](spark, data)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scans = [k for k, line in enumerate(lines) if "Relation" in line]
    assert scans and all("Filter" in lines[k - 1] and "= 7" in lines[k - 1] for k in scans)


def test_orders_against_a_loop(spark, data):
    rows = {}
    from tapewright.operators import strategy as M
    from tapewright.plans.table_queries import _features

    for r in M.ma_close_signals(M.ma_open_signals(_features(spark, data))).collect():
        rows.setdefault(r.instrument_id, []).append(r)
    expected = []
    for who, x in rows.items():
        long_open = short_open = False
        position = 0
        for r in sorted(x, key=lambda r: r.us):
            lots = int(100_000.0 // r.price)
            go_long, go_short = not long_open and r.may_long and lots > 0, not short_open and r.may_short and lots > 0
            end_long, end_short = long_open and (r.end_long or go_short), short_open and (r.end_short or go_long)
            expected += [(who, r.us, "open", "long", lots)] * go_long + [(who, r.us, "open", "short", lots)] * go_short
            expected += [(who, r.us, "close", "long", position)] * end_long + [(who, r.us, "close", "short", position)] * end_short
            if end_long or end_short:
                position = 0
            long_open, short_open = (long_open and not end_long) or go_long, (short_open and not end_short) or go_short
            if go_long or go_short:
                position = lots
    first = catalog.QUERIES["closing_before_opening"](spark, data).collect()
    assert [(r.us, r.action != "close") for r in first] == sorted((r.us, r.action != "close") for r in first)
    assert expected and sorted(map(tuple, catalog.QUERIES["ma_order_signals"](spark, data).collect())) == sorted(expected)


def test_empty_tables(spark, data, tmp_path):
    for t in ("events", "lineitem", "orders", "supplier", "nation", "customer"):
        tape.table(spark, data, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("detect_all", "stream_detect_replay", "signal_summary", "candle_build", "hourly_thresholds", "coverage_gaps", "merge_candles", "ma_order_signals", "enrich_events", "mav_rows", "stitched_candles", "write_signals", "write_candles", "read_candles", "read_instruments", "read_detector_settings", "stream_detect_live", "refresh_settings", "closing_before_opening"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_join_settings_keeps_overrides_in_spark(spark, data, monkeypatch):
    """However many users have an override, none comes to the driver or falls to a limit."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*args):
        raise AssertionError("overrides are cut or pulled to the driver")

    for name in ("limit", "collect", "toLocalIterator", "first"):
        monkeypatch.setattr(DataFrame, name, refused)
    d = catalog.QUERIES["join_settings"](spark, data)
    monkeypatch.undo()
    assert d.filter("trade_window_seconds = 36 * 3600 and cast(instrument_id as bigint) % 10 = 0").count() == d.filter("cast(instrument_id as bigint) % 10 = 0").count() > 0


def test_candle_csv_holds_all_instruments(spark, data, monkeypatch):
    """One call reads the folders of all instruments."""
    from tapewright.plans import table_queries as T

    paths, read = [], T.R.read_candle_csv
    monkeypatch.setattr(T.R, "read_candle_csv", lambda s, path, *a, **b: (paths.append(path), read(s, path, *a, **b))[1])
    assert catalog.QUERIES["read_candle_csv"](spark, data).count() > 0
    assert len(paths) == 1
    assert read(spark, paths[0], partition="instrument_id").count() == tape.candles(spark, data).count()


def test_enrich_events_does_not_sort_events(spark, data):
    """However large the instruments, events stream past them; sorted ones would fill a task's memory."""
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["enrich_events"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    feed = plan.split("SortAggregate")[0]
    assert plan.count("ShuffledHashJoin") >= 3 and "SortMergeJoin" not in feed
