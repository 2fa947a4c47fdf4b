"""The detectors on batch and stream: worked cases, and batch against stream."""

import json

import pytest
from pyspark.sql import functions as F

from tapewright.operators import windows as W
from tapewright.operators.detectors import detect, signals
from tapewright.plans import tape
from tapewright.schemas import SIGNAL, TAPE, Settings
from tapewright.streaming.detect import stream_detect

BASE = Settings(sample_every_seconds=5, min_baseline_points=5, baseline_points=20, trade_window_seconds=60, price_window_seconds=60, alert_cooldown_seconds=0)


def trade(t, qty, price, direction=None, who="AAA"):
    return (who, "trade", t, float(qty), price, direction, None, None, None)


def book(t, bid, ask, bq, aq):
    return ("AAA", "orderbook", t, None, None, None, [(bid, float(bq))], [(ask, float(aq))], None)


def status(t, s):
    return ("AAA", "trading_status", t, None, None, None, None, None, s)


def rows(spark, events):
    data = [(w, int(t * 1_000_000), n, k, q, p, d, b, a, s) for n, (w, k, t, q, p, d, b, a, s) in enumerate(events)]
    return spark.createDataFrame(data, TAPE)


def both(spark, events, settings, overrides=None):
    df = rows(spark, events)
    key = lambda d: sorted((r.instrument_id, r.us, r.seq, r.signal_type, r.severity, round(r.metric_value, 6), round(r.z_score, 6)) for r in d.collect())
    batch, stream = key(detect(df, settings, overrides)), key(stream_detect(df, settings, overrides))
    assert batch == stream
    return batch


SPIKE = [trade(t, 100, 100.0) for t in range(0, 30, 5)] + [trade(35, 3000, 101.0)]


def test_volume_spike(spark):
    found = both(spark, SPIKE, BASE)
    assert [(x[3], x[4]) for x in found] == [("price_jump", 3), ("volume_spike", 3)]
    assert found[1][5] == 3600 and round(found[1][6], 2) == 19.03
    assert found[0][6] == 999


@pytest.mark.parametrize("history, value", [([1, 2, 2, 2, 1, 1, 1, 1, 2, 2, 3, 1, 2, 2, 1, 2, 2], 4), ([1] * 13 + [3, 1, 1, 1], 3)])
def test_scores_right_at_a_bound(spark, history, value):
    """Four deviations exactly; other orders of steps give 3.999.. in the batch plan (first case) or the fold (second)."""
    settings = BASE.with_({"trade_window_seconds": 4, "volume_zscore_threshold": 3.9, "price_return_zscore_threshold": 1e9, "trade_count_zscore_threshold": 1e9})
    found = [x for x in both(spark, [trade(5 * k, q, 100.0) for k, q in enumerate([*history, value])], settings) if x[1] == 5_000_000 * len(history)]
    assert [(x[3], x[4], x[6]) for x in found] == [("volume_spike", 2, 4.0)]


def test_net_volume_right_at_a_bound(spark):
    """Ten lots of 0.1 are added up to 0.9999999999999999 as doubles, in the SQL too; exactly they are 1."""
    settings = COMBO.with_({"trade_window_seconds": 60, "trade_count_zscore_threshold": 1e9, "combo_min_score": 2, "combo_delta_points": 2, "combo_delta_min_abs_qty": 1.0})
    for side in ("BUY", "SELL"):
        found = [x for x in both(spark, [trade(5 * k, 0.1, 100.0, side) for k in range(12)], settings) if x[3].startswith("microstructure")]
        assert [x[1] for x in found][:1] == [50_000_000]


def test_plain_sums(spark):
    """Of at most ``FEW`` values as doubles in order of time, of more exactly; other rows and values don't count."""
    data = [("a", t * 1_000_000, t, None if t % 2 else 0.1) for t in range(200)]
    df = spark.createDataFrame(data, "instrument_id string, us bigint, seq bigint, v double")
    for seconds in (18, 2 * W.FEW - 2, 2 * W.FEW):
        got = {r.seq: r.s for r in W.rolling(df, {"s": W.Rolling("sum", F.col("v"), seconds, plain=True)}).collect()}
        for t in range(0, 200, 2):
            values = [v for _, _, n, v in data if t - seconds <= n <= t and v is not None]
            added = 0.0
            for v in values:
                added += v
            assert got[t] == (added if len(values) <= W.FEW else round(0.1 * len(values), 6))


def test_override(spark):
    strict = BASE.with_({"volume_zscore_threshold": 99.0})
    assert [x[3] for x in both(spark, SPIKE, BASE, {"AAA": strict})] == ["price_jump"]
    narrow = {"AAA": BASE.with_({"trade_window_seconds": 30}), "BBB": BASE}
    assert "volume_spike" in {x[3] for x in both(spark, SPIKE + [trade(36, 5, 1.0, who="BBB")], BASE, narrow)}


def test_status(spark):
    found = both(spark, [status(0, "NORMAL_TRADING"), status(5, "NOT_AVAILABLE_FOR_TRADING"), status(6, " ")], BASE)
    assert [(x[1], x[3], x[4]) for x in found] == [(5_000_000, "trading_status_changed", 2)]


def combo_events():
    buys = [trade(t, 10, 100.0, "BUY") for t in (0, 3, 6, 9)]
    books = [book(t, 100.0, 100.1, 100, 100) for t in (1, 4, 7)]
    return sorted(buys + books, key=lambda x: x[2]) + [book(12, 99.0, 101.5, 900, 100)] + [trade(t, 50, 101.0, "BUY") for t in (12.1, 12.2, 12.3, 12.4)]


COMBO = BASE.with_(dict(
    sample_every_seconds=0, min_baseline_points=3, baseline_points=30, trade_window_seconds=2, trade_count_zscore_threshold=1.0, spread_zscore_threshold=1.0, imbalance_zscore_threshold=1.0,
    imbalance_absolute_threshold=0.5, combo_enabled=True, combo_freshness_seconds=30, combo_alert_cooldown_seconds=0,
))


def test_combo_long(spark):
    found = [x for x in both(spark, combo_events(), COMBO) if x[3] == "microstructure_combo_long"]
    assert found and found[0][5] >= 6 and found[0][4] == 2 and found[-1][1] == 12_400_000


def test_ties_and_edges(spark):
    assert both(spark, [], BASE) == []
    assert both(spark, SPIKE[:1], BASE) == []
    events = [trade(t // 3, 1 + t % 5, 50.0 + t % 7, "SELL" if t % 2 else "buy ") for t in range(60)] + [trade(30, 0, 1.0), ("AAA", "trade", 31, None, None, None, None, None, None), ("AAA", "candle", 32, 1.0, 1.0, None, None, None, None), book(33, 0.0, 1.0, 1, 1)]
    both(spark, events, BASE.with_({"sample_every_seconds": 1, "volume_zscore_threshold": 1.013, "trade_count_zscore_threshold": 1.013, "price_return_zscore_threshold": 0.513}))


def test_tape_counts_and_stream(spark, data):
    ev = tape.events(spark, data)
    found = detect(ev, tape.SETTINGS).cache()
    counts = {r.signal_type: r["count"] for r in found.groupBy("signal_type").count().collect()}
    assert counts == {
        "volume_spike": 26, "trade_rate_spike": 30, "price_jump": 43, "spread_widening": 15, "orderbook_imbalance": 14, "trading_status_changed": 98,
        "microstructure_combo_long": 25, "microstructure_combo_short": 18,
    }
    key = lambda d: sorted((r.instrument_id, r.us, r.signal_type, r.severity, round(r.z_score, 6), r.note) for r in d.collect())
    assert key(found) == key(stream_detect(ev.withColumn("seq", F.col("us")), tape.SETTINGS))
    full = signals(found)
    assert full.schema.simpleString() == spark.createDataFrame([], SIGNAL).schema.simpleString()
    assert full.filter("summary is null or signal_id is null").count() == 0
    # what a signal was measured by is the same text from stream and batch, but for digits of doubles
    told = lambda d: sorted((r.instrument_id, r.us, r.signal_type, r.detail) for r in d.filter("signal_type not like 'micro%'").collect())
    assert told(found) == told(stream_detect(ev.withColumn("seq", F.col("us")), tape.SETTINGS).withColumn("x", F.lit(1)))
    whole = {r.signal_type: json.loads(r.payload) for r in signals(found, events=ev).collect()}
    assert whole["volume_spike"]["baseline_label"] == "rolling volume" and whole["volume_spike"]["event_payload"]["quantity"] > 0
    assert whole["trading_status_changed"]["previous_status"] != whole["trading_status_changed"]["current_status"]
    assert whole["microstructure_combo_long"]["score"] >= 4 and "event_payload" not in whole["microstructure_combo_long"]


def test_a_hot_instrument_and_gates_over_batches(spark):
    """One instrument holds nine tenths of a long tape; batch and stream agree on it."""
    events = [trade(t * 0.7, 1 + (t * 7) % 11, 50.0 + (t * 5) % 13, "SELL" if t % 3 else "BUY", who="AAA" if t % 10 else f"B{t % 7}") for t in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        found = both(spark, events, BASE.with_({"volume_zscore_threshold": 1.313, "trade_count_zscore_threshold": 1.313, "price_return_zscore_threshold": 0.513, "alert_cooldown_seconds": 7}))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) > 50


def test_gates_in_blocks_without_pauses(spark):
    """Blocks of a key change no outcome, against a loop; ties, nulls, dependent gates and
    intervals of their own included, and keys that never pause."""
    import random

    from tapewright.operators import gates as G

    r = random.Random(3)
    data, at = [], {}
    for n in range(3000):
        who = "hot" if n % 10 else f"k{n % 40}"
        at[who] = at.get(who, 0) + r.choice((0, 1, 1, 2, 3) if who == "hot" else (0, 1, 9, 40))
        data.append((who, at[who], n, r.choice((True, True, False, None)), r.choice((True, False)), r.random() < 0.8, 4, 7))
    df = spark.createDataFrame(data, "who string, us bigint, seq bigint, a boolean, b boolean, c boolean, short bigint, long bigint")
    listed = (G.Gate("g_a", "short", "a"), G.Gate("g_b", "long", "b"), G.Gate("g_c", "short", ("g_a", "g_b"), "c"))
    expected, last = [], {}
    for who, us, seq, a, b, c, short, long in data:
        ok = {}
        for name, interval, on in (("g_a", short, lambda: a), ("g_b", long, lambda: b), ("g_c", short, lambda: c and (ok["g_a"] or ok["g_b"]))):
            before = last.get((who, name))
            ok[name] = bool(on()) and (before is None or us - before >= interval)
            if ok[name]:
                last[who, name] = us
        expected.append((seq, *ok.values()))
    for block_us in (None, 1, 30, 1000, 10**9):
        out = G.greedy_gate(df, ["who"], ["us", "seq"], listed, block_us)
        assert out.columns == [*df.columns, "g_a", "g_b", "g_c"]
        assert sorted((x.seq, x.g_a, x.g_b, x.g_c) for x in out.collect()) == expected, block_us


def test_a_regular_tape_in_blocks(spark):
    """A tick a second and no pause: gates of many chains that never meet."""
    from tapewright.operators import gates as G

    df = spark.range(20_000).selectExpr("'x' as who", "id as us", "cast(7 as bigint) as every", "id % 3 > 0 as ok")
    gate = [G.Gate("g", "every", "ok")]
    plain = G.greedy_gate(df, ["who"], ["us"], gate).filter("g").select("us").collect()
    blocks = G.greedy_gate(df, ["who"], ["us"], gate, block_us=1000)
    assert sorted(blocks.filter("g").select("us").collect()) == sorted(plain)
    parts = {r.p for r in G._entries(df.withColumn("__block", F.floor(F.col("us") / 1000).cast("bigint")), ["who"], ["us"], gate).select(F.col("__block").alias("p")).collect()}
    assert parts == set(range(20))


def test_windows_of_a_hot_instrument(spark):
    """Nine tenths of the rows are one instrument's; sums, counts, first and latest values against
    loops, and its rows lie in several partitions."""
    import random

    from tapewright.operators import windows as W

    r = random.Random(5)
    data = [("hot" if r.random() < 0.9 else f"k{r.randint(0, 3)}", r.randint(0, 400) * 500_000, n, r.choice((None, 0.1, 0.7, 1e6, 3.3))) for n in range(2000)]
    df = spark.createDataFrame(data, "instrument_id string, us bigint, seq bigint, v double")
    v = F.col("v")
    wanted = {"s": W.Rolling("sum", v, 9), "c": W.Rolling("count", v, 5), "f": W.Rolling("first", v, 9)}
    d = W.rolling(df, wanted)
    spread = d.filter("instrument_id = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 1 and max(x["count"] for x in spread) < 0.8 * sum(x["count"] for x in spread)
    got = {x.seq: (x.s, x.c, x.f) for x in d.collect()}
    before = {x.seq: x.b for x in W.as_of(df, {"b": v}, earlier=True, bucket_us=7_000_000).collect()}
    here = {x.seq: x.b for x in W.as_of(df, {"b": v}, bucket_us=7_000_000).collect()}
    assert len(got) == len(before) == len(here) == len(data)
    by = {}
    for x in data:
        by.setdefault(x[0], []).append(x)
    for rows_ in by.values():
        rows_.sort(key=lambda x: (x[1], x[2]))
        for n, (_, us, seq, value) in enumerate(rows_):
            within = lambda s, upto: [y[3] for y in upto if us - s * 1_000_000 <= y[1] and y[3] is not None]  # noqa: B023, E731
            arrived = rows_[: n + 1]
            same = within(9, [y for y in rows_ if y[1] <= us])
            s, c, f = got[seq]
            assert (round(s, 6), c, f) == (round(sum(within(9, arrived)), 6), len(within(5, arrived)), same[0] if same else None)
            known = [y[3] for y in arrived if y[3] is not None]
            assert here[seq] == (known[-1] if known else None)
            known = [y[3] for y in rows_[:n] if y[3] is not None]
            assert before[seq] == (known[-1] if known else None)


def test_one_hot_instrument_alone(spark):
    """Windows, gates and as-of values of one instrument in many buckets and blocks: batch and stream agree."""
    from tapewright.operators import detectors as D

    events = []
    for t in range(4000):
        who = "AAA" if t % 10 else "BBB"
        kind = t % 4
        if kind == 3:
            events.append(("AAA", "orderbook", t * 0.5, None, None, None, [(99.0 - t % 5, float(1 + t % 9))], [(101.0 + t % 3, float(1 + t % 4))], None))
        elif kind == 2 and t % 40 == 2:
            events.append(status(t * 0.5, "ABC"[t % 3]))
        else:
            events.append(trade(t * 0.5, 1 + (t * 7) % 11, 50.0 + (t * 5) % 13, "SELL" if t % 3 else "BUY", who=who))
    settings = COMBO.with_(dict(sample_every_seconds=3, trade_window_seconds=10, price_window_seconds=15, alert_cooldown_seconds=20, combo_min_score=3, volume_zscore_threshold=1.313, price_return_zscore_threshold=0.513))
    old = D.SAMPLES_A_BLOCK
    try:
        D.SAMPLES_A_BLOCK = 5
        found = both(spark, events, settings)
    finally:
        D.SAMPLES_A_BLOCK = old
    assert {x[3] for x in found} >= {"volume_spike", "trading_status_changed", "microstructure_combo_long", "spread_widening"}


def test_rules_of_ones_own(spark):
    """A sixth rule, of each way to measure, beside the five: batch and stream agree on all of them."""
    from tapewright.operators import rules as R

    events = [trade(t * 1.5, 1 + (t * 7) % 23, 50.0 + (t * t) % 17, "SELL" if t % 3 else "BUY", who="AAA" if t % 5 else "B") for t in range(900)]
    df = rows(spark, events)
    money = lambda: F.when(R.is_trade(), F.col("price") * F.col("quantity"))
    settings = BASE.with_({"volume_zscore_threshold": 1.313, "alert_cooldown_seconds": 9, "sample_every_seconds": 2})
    for how in ("value", "sum", "count", "move"):
        rule = R.ZRule("mine", "mine", money, how, 30, "mine", 1.013, "mine", floor=0.5, least=2.0)
        rules = [*R.market_rules(), rule]
        key = lambda d: sorted((r.instrument_id, r.us, r.seq, r.signal_type, round(r.metric_value, 6), round(r.z_score, 5), r.window_seconds) for r in d.collect())
        batch = key(detect(df, settings, rules=rules))
        assert batch == key(stream_detect(df, settings, rules=rules))
        assert sum(x[3] == "mine" for x in batch) > 2, how
    with pytest.raises(ValueError):
        R.ZRule("x", "x", None, "median", 1, "x", 1.0, "x")
    with pytest.raises(ValueError):
        detect(df, settings, only=["nothing"])


def test_state_written_follows_events_not_windows():
    """A window of many points: an event more writes the slices it touches."""
    from tapewright.streaming.detect import SLICES, Total, _Stored

    class State(dict):
        written = 0

        def containsKey(self, k):
            return k in self

        def getValue(self, k):
            return self[k]

        def removeKey(self, k):
            self.pop(k, None)

        def updateValue(self, k, v):
            self[k] = v
            State.written += len(v[0])

    state, kept, seen = State(), None, []
    for batch in range(60):
        points = _Stored(state)
        total = Total("m", points, kept)
        for n in range(20):
            us = (batch * 20 + n) * 1000
            total.add(us, 0.1 * (n + 1), 640_000)
            seen.append((us, 0.1 * (n + 1)))
        points.flush()
        kept = (total.total, total.n, total.oldest, total.newest)
        inside = [v for t, v in seen if t >= seen[-1][0] - 640_000]
        assert total.n == len(inside) and total.first == inside[0] and abs(total.sum - sum(inside)) < 1e-9
    assert len(state) <= SLICES + 2 and kept[1] == 641
    assert State.written < 60 * 4 * (20 + 640 // SLICES)  # and not 60 times 641


def test_stream_keeps_state_between_batches(spark, data, tmp_path):
    ev = tape.events(spark, data).withColumn("seq", F.col("us"))
    expected = stream_detect(ev, tape.SETTINGS).count()
    cut = ev.approxQuantile("us", [0.5], 0)[0]
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    for part in (ev.filter(F.col("us") <= cut), ev.filter(F.col("us") > cut)):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(TAPE).parquet(src)
        stream_detect(stream, refresh=settings_now).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(out).count() == expected


def test_stream_deals_instruments_over_lanes(spark, tmp_path, monkeypatch):
    """Three micro-batches agree with the replay; state has a row a lane, and rows of its own only for windows of
    many points."""
    import random

    from tapewright.streaming import detect as live

    monkeypatch.setattr(live, "LANES", 3, raising=False)
    r, events = random.Random(9), []
    for t in range(1500):
        who, kind = "hot" if t % 2 else f"k{t % 39}", r.random()
        if kind < 0.6:
            events.append(trade(t, r.randint(1, 9), 50.0 + r.randint(0, 9), r.choice(("BUY", "SELL")), who=who))
        elif kind < 0.9:
            events.append((who, "orderbook", t, None, None, None, [(99.0 - r.random(), r.randint(1, 9) * 1.0)], [(101.0 + r.random(), r.randint(1, 9) * 1.0)], None))
        else:
            events.append((who, "trading_status", t, None, None, None, None, None, r.choice(("A", "B", None, " "))))
    settings = COMBO.with_(dict(sample_every_seconds=3, trade_window_seconds=400, price_window_seconds=300, alert_cooldown_seconds=5, volume_zscore_threshold=1.313, price_return_zscore_threshold=0.513, combo_min_score=3))
    df, src = rows(spark, events), str(tmp_path / "in")
    for start, end in ((0, 700), (700, 710), (710, 1500)):
        df.filter(F.col("seq").between(start, end - 1)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 1).parquet(src)
    running = stream_detect(stream, settings).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    running.awaitTermination()
    told = lambda d: sorted(tuple(map(str, x)) for x in d.collect())
    expected = told(stream_detect(df, settings))
    assert {x[4] for x in expected} >= {"volume_spike", "spread_widening", "trading_status_changed", "microstructure_combo_long"} and {x[0] for x in expected} >= {"hot", "k3"}
    assert told(spark.read.schema(live.OUT).parquet(str(tmp_path / "out"))) == expected
    assert 3 < running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 + 4 * (live.SLICES + 2)


def settings_now():
    return tape.SETTINGS, {}


def test_bad_settings():
    with pytest.raises(ValueError):
        Settings(min_baseline_points=0)
    with pytest.raises(ValueError):
        Settings().with_({"nonsense": 1})


def test_latest_of_a_window_comes_from_whole_windows(spark):
    """Rows of a halo see a part of their window; nothing is carried from them."""
    rows = [("a", t * 1_000_000, n, v) for n, (t, v) in enumerate([(25, 100.0), (35, 1.0), (41, None), (60, None), (61, 7.0), (62, None)])]
    d = spark.createDataFrame(rows, "instrument_id string, us bigint, seq bigint, v double")
    d = W.rolling(d, {"here": W.Rolling("sum", F.col("v"), 10)}, {"latest": F.when(F.col("v").isNotNull(), F.col("here"))})
    assert [(r.here, r.latest, r["__closing"]) for r in d.orderBy("us").collect()] == [(100.0, 100.0, False), (101.0, 101.0, True), (1.0, None, False), (0.0, None, False), (7.0, 7.0, False), (7.0, 7.0, True)]
