"""What is written again, half-written, or asked for in many pieces."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import candles as C
from tapewright.operators import strategy as M
from tapewright.schemas import SIGNAL, Settings
from tapewright.sources import readers as R
from tapewright.sources import sinks as K
from tapewright.sources import store

SECOND = 1_000_000
RAW = "instrument_id string, interval string, time timestamp, open int, high int, low int, close int, volume bigint, is_complete boolean"


def candles(spark, rows):
    d = spark.createDataFrame([(who, interval, t, 1, 1, 1, close, 5, True) for who, interval, t, close in rows], RAW)
    return d.withColumns({c: F.col(c).cast("decimal(28,9)") for c in ("open", "high", "low", "close")})


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def held(d):
    return sorted((r.instrument_id, r.interval, r.time, int(r.close)) for r in d.collect())


def test_candles_written_twice_and_half(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = [("a", "DAY", at(k), 1) for k in range(0, 60, 3)] + [("b", "HOUR", at(5), 1)]
    second = [("a", "DAY", at(k), 2) for k in range(0, 60, 2)] + [("c", "DAY", at(200), 2)]
    assert store.read_candles(spark, path).count() == 0 and store.coverage(spark, path).count() == 0
    ranges = spark.createDataFrame([("a", "DAY", 0, 10), ("a", "DAY", 20, 30)], store.RANGE)
    for _ in range(2):
        K.write_candles(candles(spark, first), path, ranges)
    assert held(R.read_candles(spark, path)) == sorted(first)
    # the write dies after its files, before its manifest: nothing is lost, nothing is there twice
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            K.write_candles(candles(spark, second), path, spark.createDataFrame([("a", "DAY", 8, 25)], store.RANGE))
    assert held(R.read_candles(spark, path)) == sorted(first)
    assert {(r.start, r.end) for r in store.coverage(spark, path).collect()} == {(0, 10), (20, 30)}
    K.write_candles(candles(spark, second), path, spark.createDataFrame([("a", "DAY", 8, 25)], store.RANGE))
    known = {r[:3]: r for r in second} | {r[:3]: r for r in first}  # what the store had stays
    assert held(R.read_candles(spark, path)) == sorted(known.values())
    assert {(r.start, r.end) for r in store.coverage(spark, path).collect()} == {(0, 30)}
    assert held(R.read_candles(spark, path, "HOUR")) == [("b", "HOUR", at(5), 1)]
    # two writers from one version: the later one is told
    old = store.manifest(spark, path)
    with pytest.raises(RuntimeError, match="another write"):
        store._commit(spark, path, {**old, "version": old["version"]})


def test_a_month_is_dealt_and_a_range_opens_its_months(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"i{n % 50}", "DAY", at(n // 50), n) for n in range(50 * 70)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which makes one file of these few rows
    try:
        K.write_candles(candles(spark, rows), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    d = R.read_candles(spark, path, "DAY", at(31), at(40))
    assert d.count() == 50 * 10
    files = d.inputFiles()
    assert len(files) > 1 and all("month=2024-02-01" in f for f in files)
    counts = [r["count"] for r in R.read_candles(spark, path, "DAY", at(0), at(20)).groupBy(F.input_file_name()).count().collect()]
    assert max(counts) < 0.5 * sum(counts)


def test_csv_by_its_header(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = candles(spark, [("a", "DAY", at(1), 3), ("b", "DAY", at(2), -4)]).withColumn("close", F.col("close") + F.lit("0.25").cast("decimal(28,9)"))
    store.write_candle_csv(rows, path)
    store.write_candle_csv(rows.filter("instrument_id = 'a'"), path)
    got = sorted((r.instrument_id, r.time, float(r.close), r.volume) for r in R.read_candle_csv(spark, path, partition="instrument_id").collect())
    assert got == [("a", at(1), 3.25, 5), ("b", at(2), -3.75, 5)]
    cell = '"{\'units\': 7, \'nano\': 500000000}"'
    (tmp_path / "own").mkdir()
    one = tmp_path / "own" / "1.csv"
    one.write_text(f"volume,extra,close,time,open,high,low,is_complete\n9,x,{cell},2024-01-05T00:00:00Z,{cell},{cell},{cell},true\n")
    r = R.read_candle_csv(spark, str(tmp_path / "own")).first()
    assert (r.volume, float(r.close), r.time, r.is_complete) == (9, 7.5, at(4), True)
    (tmp_path / "own" / "2.csv").write_text(f"time,open,high,low,close,volume,is_complete,extra\n2024-01-05T00:00:00Z,{cell},{cell},{cell},{cell},9,true,x\n")
    with pytest.raises(Exception):
        R.read_candle_csv(spark, str(tmp_path / "own")).collect()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "1.csv").write_text("time,open\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        R.read_candle_csv(spark, str(tmp_path / "none"))


def signal(k, day=1):
    return (f"s{k}", dt.datetime(2024, 1, day, 5), "a", None, None, None, "trade", "volume_spike", 1, 1.0, 1.0, 1.0, 60, "s", "{}")


def test_a_redelivered_batch_replaces_itself(spark, tmp_path):
    """The topic fails after the table was written; the batch comes again."""
    path, fails = str(tmp_path / "signals"), [True]

    def topic(batch):
        if fails.pop() if fails else False:
            raise OSError("no topic")

    run = K.signal_fanout(lambda b, i: K.write_signals(b, path, i), topic)
    batches = [[signal(1), signal(2)], [signal(3), signal(4, 2)], [signal(5, 2)]]
    with pytest.raises(OSError):
        run(spark.createDataFrame(batches[0], SIGNAL), 0)
    for n, rows in enumerate(batches):
        run(spark.createDataFrame(rows, SIGNAL), n)
    run(spark.createDataFrame(batches[2], SIGNAL), 2)
    assert sorted(r.signal_id for r in R.read_signals(spark, path).collect()) == ["s1", "s2", "s3", "s4", "s5"]
    # a table of batches takes rows without a batch, too
    K.write_signals(spark.createDataFrame([signal(5, 2), signal(6, 2)], SIGNAL), path)
    assert sorted(r.signal_id for r in R.read_signals(spark, path).collect()) == ["s1", "s2", "s3", "s4", "s5", "s6"]


def test_a_redelivered_batch_in_a_database(spark):
    url = "jdbc:derby:memory:signals;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([signal(0)], SIGNAL).write.options(**options).jdbc(url, "market_signals", mode="overwrite")
    rows = spark.createDataFrame([signal(1), signal(2), signal(2)], SIGNAL)
    K.write_signals_jdbc(rows.filter("signal_id = 's1'"), url, **options)  # half a batch
    for _ in range(2):
        K.write_signals_jdbc(rows, url, **options)
    assert sorted(r.signal_id for r in spark.read.options(**options).jdbc(url, "market_signals").collect()) == ["s0", "s1", "s2"]


def test_thresholds_go_back_into_settings(spark, tmp_path):
    path = str(tmp_path / "t")
    found = spark.createDataFrame([("a", 12.5), ("b", 7.0)], "instrument_id string, threshold_bps double")
    K.write_threshold_overrides(found, path, at(0), 7, 1.0)
    assert {r.metric for r in spark.read.parquet(path).collect()} == {"hourly_abs_return_bps_mean"}
    main = spark.createDataFrame([("b", 99), ("c", 30)], "instrument_id string, trade_window_seconds int")
    names = [c for c in R.threshold_blocks(spark, path).columns if c not in main.columns]
    main = main.select("*", *(F.lit(None).cast(R.threshold_blocks(spark, path).schema[c].dataType).alias(c) for c in names))
    got = {r.s_instrument: (r.price_move_absolute_threshold_bps, r.trade_window_seconds) for r in R.resolve_blocks(Settings(), main, R.threshold_blocks(spark, path)).collect()}
    assert got == {"a": (12.5, 60), "b": (7.0, 60), "c": (0.0, 30)}  # the overrides' block replaces the main one's


def gaps_by_hand(asked, stored, interval):
    out = set()
    islands = []
    for s, e in sorted(asked):
        if islands and s <= islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], e)
        else:
            islands.append([s, e])
    for s, e in islands:
        reach = s
        for a, b in sorted(stored):
            if b < s or a > e:
                continue
            a, b = max(a, s), min(b, e)
            if a > reach:
                out.add((reach, a))
            reach = max(reach, b)
        if reach + interval <= e:
            out.add((reach, e))
    return out


def test_coverage_of_many_requests(spark):
    r = random.Random(1)
    asked, stored, expected = [], [], {}
    for key in range(150):
        ranges = lambda n, most: [(s := r.randint(0, 60) * SECOND, s + r.randint(0, most) * SECOND) for _ in range(n)]
        a, b = ranges(r.randint(1, 5), 25), ranges(r.randint(0, 6), 9)
        asked += [(str(key), *x) for x in a]
        stored += [(str(key), *x) for x in b]
        expected[str(key)] = gaps_by_hand(a, b, 3 * SECOND)
    df = lambda rows: spark.createDataFrame(rows, "instrument_id string, start bigint, end bigint")
    got = {k: set() for k in expected}
    listed = C.coverage_gaps(df([*asked, ("x", 9, 3), (None, 1, 2), ("x", None, 3)]), df(stored), 3).filter("instrument_id is not null").collect()
    for x in listed:
        got[x.instrument_id].add((x.start, x.end))
    assert got == expected and len(listed) == sum(map(len, expected.values()))
    minutes = lambda *x: [("k", a * 60 * SECOND, b * 60 * SECOND) for a, b in x]
    two = C.coverage_gaps(df(minutes((0, 10), (20, 30))), df(minutes((2, 4), (22, 24))), 60)
    assert sorted((x.start // 60 // SECOND, x.end // 60 // SECOND) for x in two.collect()) == [(0, 2), (4, 10), (20, 22), (24, 30)]


def test_stitching_many_requests(spark):
    row = lambda k, close: ("k", k * SECOND, close, True)
    schema = "instrument_id string, us bigint, close int, is_complete boolean"
    df = lambda rows: spark.createDataFrame(rows, "instrument_id string, start bigint, end bigint")
    stored, loaded = spark.createDataFrame([row(k, 1) for k in range(0, 20)], schema), spark.createDataFrame([row(k, 2) for k in range(0, 60)], schema)
    asked = df([("k", 5 * SECOND, 25 * SECOND), ("k", 15 * SECOND, 30 * SECOND), ("k", 50 * SECOND, 52 * SECOND)])
    out = C.stitched_candles(stored, df([("k", 0, 19 * SECOND)]), loaded, asked, 1)
    assert sorted((x.us // SECOND, x.close) for x in out.collect()) == [*((k, 1) for k in range(5, 20)), *((k, 2) for k in range(20, 31)), *((k, 2) for k in range(50, 53))]


def test_sides_of_a_hot_instrument(spark):
    """Composed blocks against a loop; one instrument holds most rows, in many blocks and batches."""
    r = random.Random(2)
    data = [("hot" if n % 8 else f"k{n % 3}", n * SECOND, r.choice((0, 0, 0, 1, 2, 3, 4, 8, 12, 9, 15, 5))) for n in range(1500)]
    expected, open_ = {}, {}
    for who, us, code in data:
        expected[who, us] = open_.get(who, 0)
        open_[who] = int(M.TRANSITIONS[code, open_.get(who, 0)])
    df = spark.createDataFrame(data, "instrument_id string, us bigint, code int").repartition(3)
    for rows_a_batch in ("10000", "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        try:
            for block_us in (7 * SECOND, 100 * SECOND, 10**12):
                got = {(x.instrument_id, x.us): x.state for x in M.open_sides(df, block_us).collect()}
                assert got == expected, (rows_a_batch, block_us)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({*expected.values()}) == 4
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = M.open_sides(df, 10 * SECOND).filter("instrument_id = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1


def test_positions_of_a_hot_instrument(spark):
    """Lots of the last opening, carried over blocks and batches, against a loop; both passes share one exchange."""
    r = random.Random(3)
    data = [("hot" if n % 8 else f"k{n % 3}", n * SECOND, r.randrange(1, 50), r.choice((0, 0, 0, 1, 2, 3, 4, 8, 12, 9, 15, 5))) for n in range(800)]
    expected, held = {}, {}
    for who, us, lots, code in data:
        state, position = held.get(who, (0, 0))
        expected[who, us] = (state, position)
        opens = bool(code & 1 & ~state) or bool(code & 2 & ~state)
        after = int(M.TRANSITIONS[code, state])
        closes = bool(state & 1 and (code & 4 or code & 2 & ~state)) or bool(state & 2 and (code & 8 or code & 1 & ~state))
        held[who] = (after, lots if opens else 0 if closes else position)
    df = spark.createDataFrame(data, "instrument_id string, us bigint, lots bigint, code int").repartition(3)
    for rows_a_batch, block_us in (("37", 100 * SECOND), ("10000", 7 * SECOND)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        try:
            found = M.open_sides(df, block_us)
            assert {(x.instrument_id, x.us): (x.state, x.position) for x in found.collect()} == expected
            assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_composition_is_in_order():
    maps = np.array([[1, 0, 2, 3], [0, 2, 1, 3], [3, 3, 3, 0], [2, 2, 2, 2]], np.int8)
    got = M.composed(maps, np.array([True, False, False, True]))
    assert got.tolist() == [[1, 0, 2, 3], [2, 0, 1, 3], [3, 3, 3, 0], [2, 2, 2, 2]]


def test_live_candles_close_by_the_clock(spark, tmp_path):
    """An interval that nothing follows closes once the clock passed its end; a candle of it is late then."""
    import time

    from tapewright.streaming.candles import live_candles

    schema = "instrument_id string, us bigint, seq bigint, close double"
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    batches = [[("a", 10, 1, 1.0), ("a", 20, 2, 2.0), ("b", 5, 3, 9.0)], [("a", 30, 6, 3.0), ("b", 4, 7, 1.0)]]
    expected = [[("a", 0, 2.0, 2, False), ("b", 0, 9.0, 1, False)], [("a", 0, 2.0, 2, False), ("a", 0, 3.0, 1, True), ("b", 0, 1.0, 1, True), ("b", 0, 9.0, 1, False)]]
    kinds = "instrument_id string, bucket_us bigint, us bigint, seq bigint, close double, n bigint, late boolean"
    (tmp_path / "in").mkdir()
    stream = live_candles(spark.readStream.schema(schema).parquet(src), 86_400, 1)
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(processingTime="1 second").start()
    try:
        for rows, wanted in zip(batches, expected):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            began, got = time.time(), None
            while got != wanted and time.time() - began < 60:
                time.sleep(1)
                found = spark.read.schema(kinds).parquet(out)
                got = sorted((x.instrument_id, x.bucket_us, x.close, x.n, x.late) for x in found.collect())
            assert got == wanted
    finally:
        running.stop()


def test_live_candles_of_many_instruments(spark, tmp_path, monkeypatch):
    """Against a loop over three micro-batches, of which the first ends no interval; state goes by lanes, and so
    do calls of Python."""
    import datetime
    from decimal import Decimal

    from tapewright.streaming import candles as live

    monkeypatch.setattr(live, "LANES", 3, raising=False)
    schema = "instrument_id string, us bigint, seq bigint, close double, volume bigint, note string, at timestamp, price decimal(20,4), units struct<units: bigint, nano: int>, book array<double>"
    rng, seq, batches = np.random.default_rng(5), 0, []
    for size in (1, 30, 20):
        rows = []
        for k in rng.permutation(np.repeat(np.arange(40), size)).tolist():
            seq, us = seq + 1, int(rng.integers(0, 86_400_000_000 * (1 if size == 1 else 12)))
            at, some = datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=us), rng.random(5) < 0.8
            rows.append((f"x{k}", us, seq, us / 7 if some[0] else None, us if some[1] else None, f"n{us % 50}" if some[2] else None, at if some[3] else None, Decimal(us % 999) / 4 if some[4] else None, (us % 5, 3), [us / 3, 1.0]))
        batches.append([rows[k] for k in rng.permutation(len(rows))])
        spark.createDataFrame(batches[-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wanted, held = [], {}
    for row in (r for rows in batches for r in sorted(rows, key=lambda r: r[2])):
        bucket = row[1] - row[1] % 86_400_000_000
        was = held.get(row[0])
        if was and bucket < was[0]:
            wanted.append((row[0], bucket, *row[1:], 1, True))
            continue
        if was and bucket > was[0]:
            wanted.append((row[0], was[0], *was[2][1:], was[1], False))
        held[row[0]] = (bucket, was[1] + 1 if was and bucket == was[0] else 1, row)
    stream = live.live_candles(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 86_400)
    running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    running.awaitTermination()
    found = spark.read.schema(schema.replace("us bigint, ", "bucket_us bigint, us bigint, ", 1) + ", n bigint, late boolean").parquet(str(tmp_path / "out")).collect()
    plain = lambda r: repr([tuple(x) if isinstance(x, tuple) else x.normalize() if isinstance(x, Decimal) else x for x in r])
    assert sorted(map(plain, found)) == sorted(map(plain, wanted))
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_csv_files_do_not_follow_instruments(spark, tmp_path, monkeypatch):
    """Folders are of many instruments, whose ids come back as they were; others of a folder stay."""
    monkeypatch.setattr(store, "CSV_PARTS", 4)
    path, ids = str(tmp_path / "csv"), [f"x{n}" for n in range(60)] + ['a"b', " c,d ", "007", "1.0"]
    price = ", ".join(f"cast({k} as decimal(28,9)) as {c}" for k, c in enumerate(("open", "high", "low", "close")))
    rows = spark.createDataFrame([(i,) for i in ids], "instrument_id string").selectExpr("instrument_id", "timestamp'2024-01-01' as time", *price.replace(" as decimal(28,9))", ".5 as decimal(28,9))").split(", "), "7L as volume", "true as is_complete")
    store.write_candle_csv(rows, path)
    assert len(list(tmp_path.glob("csv/*/*.csv"))) <= 4
    store.write_candle_csv(rows.filter("instrument_id in ('x5', '007')").selectExpr("*").withColumn("volume", F.lit(8).cast("bigint")), path)
    got = {r.instrument_id: (r.volume, float(r.close), r.is_complete) for r in R.read_candle_csv(spark, path, partition="instrument_id").collect()}
    assert got == {i: (8 if i in ("x5", "007") else 7, 3.5, True) for i in ids}
    assert R.read_candle_csv(spark, path, partition="instrument_id").count() == len(ids)


def test_quotation_cells_in_any_form(spark):
    cells = ["{'units': -3, 'nano': -250000000}", "{'units': 0, 'nano': 0}", "{'nano': 5, 'units': 7}", "{ 'units':1,'nano':2 }", '{"units": 4, "nano": 6}', "{'units': 01, 'nano': 2}", "{'units': 1}", "no", None]
    d = spark.createDataFrame([(n, c) for n, c in enumerate(cells)], "n int, c string").select("n", R.quotation_cell(F.col("c")).alias("q"), F.from_json(F.translate("c", "'", '"'), R.QUOTATION).alias("j"))
    assert all(r.q == r.j for r in d.collect())
    assert d.orderBy("n").first().q == (-3, -250_000_000)


def test_a_write_runs_its_plan_once(spark, tmp_path):
    path, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    for k in range(2):  # into an empty store and into one that has some of the months
        rows = [("a", "DAY", at(d), 1) for d in range(30 * k, 30 * k + 60)]
        d = candles(spark, rows).coalesce(1)
        before = seen.value
        K.write_candles(d.mapInPandas(count, d.schema), path)
        assert seen.value - before == 60
    assert store.read_candles(spark, path).count() == 90
    assert not list((tmp_path / "store" / "staged").iterdir())
