"""Scalar, source, join, candle, coverage and strategy queries on the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tapewright.functions import scalars as S
from tapewright.operators import candles as C
from tapewright.operators import joins as J
from tapewright.operators import strategy as M
from tapewright.operators import windows as W
from tapewright.plans import tape
from tapewright.sources import readers as R
from tapewright.sources import sinks as K
from tapewright.sources.store import write_candle_csv

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400_000_000
DAY_S = 86_400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lineitem(spark, sf_dir):
    return tape.table(spark, sf_dir, "lineitem")


def _quoted(spark, sf_dir, sign: int = 1):
    """Prices as decimals and as quotations, negative ones for odd orders."""
    d = _lineitem(spark, sf_dir)
    amount = (F.when(F.col("l_orderkey") % 2 == 1, -1).otherwise(1) * F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,9)")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", amount.alias("d")).withColumn("q", S.decimal_to_quotation(F.col("d")))


QUOTED_SQL = "with x as (select l_orderkey, l_linenumber, l_partkey, (case when l_orderkey % 2 = 1 then -1 else 1 end * l_extendedprice::decimal(18,2))::decimal(28,9) as d from lineitem)"
ROW = ("l_orderkey", "l_linenumber", "l_partkey")
ROW_SQL = "l_orderkey, l_linenumber, l_partkey"


@query(QUOTED_SQL + f" select {ROW_SQL}, floor(d)::bigint as units, ((d - floor(d)) * 1000000000)::int as nano from x")
def decimal_to_quotation(spark, sf_dir):
    return _quoted(spark, sf_dir).select(*ROW, "q.units", "q.nano")


@query(QUOTED_SQL + f" select {ROW_SQL}, d::double as value from x")
def quotation_to_double(spark, sf_dir):
    return _quoted(spark, sf_dir).select(*ROW, S.quotation_to_double(F.col("q")).alias("value"))


@query(QUOTED_SQL + f" select {ROW_SQL}, d::decimal(28,9) as value from x")
def quotation_to_decimal(spark, sf_dir):
    return _quoted(spark, sf_dir).select(*ROW, S.quotation_to_decimal(F.col("q")).alias("value"))


@query(QUOTED_SQL + " select l_orderkey, sum(d)::double as total, max(abs(d))::double as largest, (count(*) filter (where d < 0))::bigint as negative, (max(d) - min(d))::double as spread from x group by 1")
def quotation_arith(spark, sf_dir):
    v = S.quotation_to_decimal(F.col("q"))
    d = _quoted(spark, sf_dir).select("l_orderkey", v.alias("v")).groupBy("l_orderkey")
    return d.agg(F.sum("v").cast("double").alias("total"), F.max(F.abs("v")).cast("double").alias("largest"), F.count(F.when(F.col("v") < 0, 1)).alias("negative"), (F.max("v") - F.min("v")).cast("double").alias("spread"))


@query("select event_id, case when value >= 60 then 3 when value >= 40 then 2 else 1 end as severity from events")
def severity(spark, sf_dir):
    return tape.table(spark, sf_dir, "events").select("event_id", S.severity(F.col("value") / 10).alias("severity"))


@query("select event_id, epoch_us(ts) as us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as iso from events")
def parse_timestamp(spark, sf_dir):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    d = tape.table(spark, sf_dir, "events").select("event_id", text.alias("iso"))
    return d.select("event_id", F.unix_micros(S.parse_timestamp(F.col("iso"))).alias("us"), "iso")


@query("select event_id, floor(epoch_us(ts) / 1000000)::bigint as seconds, (epoch_us(ts) % 1000000 * 1000)::int as nanos, epoch_us(ts) as us from events")
def proto_timestamp(spark, sf_dir):
    d = tape.table(spark, sf_dir, "events").select("event_id", S.to_proto(F.col("ts").cast("timestamp")).alias("p"))
    return d.select("event_id", "p.seconds", "p.nanos", F.unix_micros(S.proto_timestamp(F.col("p.seconds"), F.col("p.nanos"))).alias("us"))


@query("select event_id, case when event_id % 3 = 2 then 0 else epoch_us(ts) end as us from events")
def source_time(spark, sf_dir):
    """Time, else last trade time, else a given now."""
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    by = F.col("event_id") % 3
    got = S.source_time(F.when(by == 0, iso), F.when(by == 1, iso), F.timestamp_micros(F.lit(0)))
    return tape.table(spark, sf_dir, "events").select("event_id", F.unix_micros(got).alias("us"))


@query("select s_suppkey, s_name || '_' || n_name as instrument_id from supplier join nation on s_nationkey = n_nationkey")
def instrument_key(spark, sf_dir):
    return tape.instruments(spark, sf_dir).select(F.col("load_order").alias("s_suppkey"), S.instrument_key(F.col("ticker"), F.col("class_code")).alias("instrument_id"))


INTERVALS = ("5_MIN", "HOUR", "DAY", "WEEK")


@query(
    "with o as (select event_id, epoch_us(ts) + 62135596800000000 as t from events), i as (select * from (values ('5_MIN', 300000000), ('HOUR', 3600000000), ('DAY', 86400000000), ('WEEK', 604800000000)) v(interval, d)) "
    "select event_id, interval, t - t % d - 62135596800000000 as us from o, i"
)
def floor_time(spark, sf_dir):
    return _aligned(spark, sf_dir, S.floor_us)


@query(
    "with o as (select event_id, epoch_us(ts) + 62135596800000000 as t from events), i as (select * from (values ('5_MIN', 300000000), ('HOUR', 3600000000), ('DAY', 86400000000), ('WEEK', 604800000000)) v(interval, d)) "
    "select event_id, interval, t + (d - t % d) % d - 62135596800000000 as us from o, i"
)
def ceil_time(spark, sf_dir):
    return _aligned(spark, sf_dir, S.ceil_us)


def _aligned(spark, sf_dir, f):
    d = tape.table(spark, sf_dir, "events").select("event_id", tape.us("ts").alias("t"))
    each = F.array(*(F.struct(F.lit(i).alias("interval"), f(F.col("t"), S.INTERVAL_SECONDS[i] * S.SECOND).alias("us")) for i in INTERVALS))
    return d.select("event_id", F.inline(each))


@query("select event_id, epoch_us(date_trunc('minute', ts)) as us from events")
def floor_minute_range(spark, sf_dir):
    return tape.table(spark, sf_dir, "events").select("event_id", F.unix_micros(S.floor_minute(F.col("ts").cast("timestamp"))).alias("us"))


@query(
    "with r as (select o_custkey as id, min(epoch_us(o_orderdate)) as a, max(epoch_us(o_orderdate)) as b from orders group by 1), s as (select id, b, unnest(generate_series(a, b - 3600000000, 604800000000)) as s from r) "
    "select id, s as range_start, least(s + 604800000000, b) as range_end from s"
)
def request_ranges(spark, sf_dir):
    d = tape.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(tape.us("o_orderdate")).alias("a"), F.max(tape.us("o_orderdate")).alias("b"))
    return d.select("id", F.inline(S.request_ranges(F.col("a"), F.col("b"), "HOUR"))).withColumnsRenamed({"start": "range_start", "end": "range_end"})


@query("select event_type, (case event_type when 'click' then 60 when 'view' then 3600 when 'error' then 86400 when 'signup' then 2592000 when 'purchase' then 60 end)::bigint as seconds, count(*) as n from events group by 1, 2")
def interval_to_duration(spark, sf_dir):
    name = F.create_map(*(F.lit(x) for x in ("click", "1_MIN", "view", "HOUR", "error", "DAY", "signup", "MONTH", "purchase", "UNSPECIFIED")))[F.col("event_type")]
    d = tape.table(spark, sf_dir, "events").select("event_type", S.lookup(S.INTERVAL_SECONDS, name).cast("bigint").alias("seconds"))
    return d.groupBy("event_type", "seconds").agg(F.count("*").alias("n"))


@query("select a, case a when '1h' then 'ONE_HOUR' when '1d' then 'ONE_DAY' else 'ONE_MINUTE' end as subscription, count(*) as n from (select case event_type when 'click' then '1h' when 'view' then '1d' else 'other' end as a from events) group by 1, 2")
def interval_aliases(spark, sf_dir):
    a = F.when(F.col("event_type") == "click", "1h").when(F.col("event_type") == "view", "1d").otherwise("other")
    d = tape.table(spark, sf_dir, "events").select(a.alias("a"))
    return d.withColumn("subscription", S.lookup(S.ALIASES, F.col("a"), "ONE_MINUTE")).groupBy("a", "subscription").agg(F.count("*").alias("n"))


def _codes_sql() -> str:
    values = lambda t: "[" + ", ".join(f"'{k}'" for k, _ in sorted(t.items(), key=lambda x: x[1])) + "]"
    status, interval, side = (f"({values(t)})[(event_id % {len(t)})::int + 1]" for t in (S.TRADING_STATUS, S.CANDLE_INTERVAL, S.TRADE_DIRECTION))
    return (
        f"select event_id, (event_id % {len(S.TRADING_STATUS)})::int as status, {status} as status_name, (event_id % {len(S.CANDLE_INTERVAL)})::int as interval_code, {interval} as interval_name, "
        f"(event_id % {len(S.TRADE_DIRECTION)})::int as direction, {side} as direction_name from events"
    )


@query(_codes_sql())
def enum_codes(spark, sf_dir):
    """Every code to its name and back, the prefix of the wire included."""
    d = tape.table(spark, sf_dir, "events").select("event_id")
    out = ["event_id"]
    for table, code, name, prefix in ((S.TRADING_STATUS, "status", "status_name", "SECURITY_TRADING_STATUS_"), (S.CANDLE_INTERVAL, "interval_code", "interval_name", "CANDLE_INTERVAL_"), (S.TRADE_DIRECTION, "direction", "direction_name", "TRADE_DIRECTION_")):
        d = d.withColumn(name, S.enum_name(table, F.col("event_id") % len(table)))
        d = d.withColumn(code, S.enum_code(table, F.concat(F.lit(prefix), name), prefix))
        out += [code, name]
    return d.select(*out)


def _scratch(spark, name: str) -> str:
    """A folder that all executors share, for queries that write and read again."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        import tempfile

        # a running session refuses to change the setting itself; only a local one gets a folder of its own
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tapewright-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/tapewright/{name}-{uuid.uuid4().hex}"


def _messages(spark, sf_dir):
    """Feed messages from the events table, one JSON member each; errors are pings."""
    d = tape.table(spark, sf_dir, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    units = F.floor("value").cast("bigint")
    q = F.struct(units.alias("units"), F.round((F.col("value") - units) * S.NANO).cast("int").alias("nano"))
    body = F.to_json(F.struct(F.col("user_id").cast("string").alias("figi"), iso.alias("time"), q.alias("price"), F.lit(5.0).alias("quantity"), F.when(F.col("event_type") == "click", "BUY").alias("direction")))
    member = F.when(F.col("event_type").isin("click", "purchase"), "trade").when(F.col("event_type") == "signup", "last_price").when(F.col("event_type") == "view", "candle").otherwise("ping")
    return d.select(*(F.when(member == k, body).alias(k) for k in (*R.KINDS, *R.CONTROL)))


NORMAL_SQL = "select user_id::varchar as figi, case when event_type in ('click', 'purchase') then 'trade' when event_type = 'signup' then 'last_price' else 'candle' end as event_type, epoch_us(ts) as us, round(value, 6) as price from events where event_type <> 'error'"


def _normal(messages):
    e = R.with_payload(R.normalize_events(messages, F.timestamp_micros(F.lit(0))))
    return e.select("figi", "event_type", F.unix_micros("source_time").alias("us"), F.round(S.quotation_to_double(F.col("p.price")), 6).alias("price"))


@query(NORMAL_SQL)
def normalize_events(spark, sf_dir):
    return _normal(_messages(spark, sf_dir))


@query(NORMAL_SQL)
def read_raw_messages(spark, sf_dir):
    path = _scratch(spark, "messages")
    _messages(spark, sf_dir).write.json(path)
    return _normal(R.read_raw_messages(spark, path))


def _envelopes(spark, sf_dir):
    return R.normalize_events(_messages(spark, sf_dir), F.timestamp_micros(F.lit(0))).withColumns({c: F.lit(None).cast("string") for c in ("ticker", "class_code", "alias")})


@query(NORMAL_SQL)
def read_events(spark, sf_dir):
    """Envelopes to JSON lines and back."""
    path = _scratch(spark, "events")
    K.topic_rows(_envelopes(spark, sf_dir), "figi").select("value").write.text(path)
    e = R.with_payload(R.read_events(spark, path))
    return e.select("figi", "event_type", F.unix_micros("source_time").alias("us"), F.round(S.quotation_to_double(F.col("p.price")), 6).alias("price"))


@query("select user_id::varchar as key, count(*) as n from events where event_type <> 'error' group by 1")
def write_event_topic(spark, sf_dir):
    """Keys and JSON values as the topic sink takes them."""
    rows = K.topic_rows(_envelopes(spark, sf_dir), "figi")
    return rows.filter(F.get_json_object("value", "$.payload").isNotNull() & ~F.col("value").contains('"ticker"')).groupBy("key").agg(F.count("*").alias("n"))


@query(NORMAL_SQL)
def json_decode(spark, sf_dir):
    e = R.decode_events(K.topic_rows(_envelopes(spark, sf_dir), "figi"))
    e = R.with_payload(e)
    return e.select("figi", "event_type", F.unix_micros("source_time").alias("us"), F.round(S.quotation_to_double(F.col("p.price")), 6).alias("price"))


@query("select n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as json from nation")
def json_encode(spark, sf_dir):
    return tape.table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", F.lit(None).cast("string").alias("gone"))).alias("json"))


@query("select event_id, case when k % 2 = 0 then '{\"id\":' || event_id || ',\"tags\":[' || k || ']}' else '{\"id\":' || event_id || '}' end as json from (select event_id, json_extract_string(props, '$.k')::int as k from events)")
def prune_empty_json(spark, sf_dir):
    """Nulls and empty containers leave the JSON."""
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.when(k % 2 == 0, F.array(k)).otherwise(F.array().cast("array<int>"))
    return tape.table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), S.prune_empty(tags).alias("tags"))).alias("json"))


INSTRUMENTS_SQL = "i as (select s_suppkey::varchar as instrument_id, s_name as ticker, n_name as class_code, lower(s_name) as alias, 'F' || s_suppkey as figi, 'U' || s_suppkey as uid from supplier join nation on s_nationkey = n_nationkey)"


@query(
    "with " + INSTRUMENTS_SQL + """, f as (select l_orderkey as seq, max(l_suppkey) as k from lineitem group by 1), g as (
  select seq, case when seq % 4 = 0 then k::varchar end as a, case when seq % 4 = 1 then 'F' || k when seq % 4 = 3 then 'NO' || k end as f, case when seq % 4 = 2 then 'U' || k end as u from f)
select seq, coalesce(i.instrument_id, g.a, g.f, g.u, 'unknown') as instrument_id, coalesce(i.ticker, g.a, g.f, g.u, 'unknown') as ticker, i.class_code, coalesce(i.alias, lower(coalesce(g.a, g.f, g.u, 'unknown'))) as alias
from g left join i on g.a = i.instrument_id or g.f = i.figi or g.u = i.uid"""
)
def enrich_events(spark, sf_dir):
    return J.enrich_events(tape.feed(spark, sf_dir), tape.instruments(spark, sf_dir)).select("seq", "instrument_id", "ticker", "class_code", "alias")


@query(
    "with " + INSTRUMENTS_SQL + """, r as (select o_orderkey as seq, (o_orderkey % 3)::int as t, 1 + o_orderkey % (select max(s_suppkey) from supplier) as k from orders)
select seq, i.instrument_id from r join i on i.instrument_id = (case when r.k > 0 then r.k end)::varchar"""
)
def instrument_lookup(spark, sf_dir):
    """Requests by figi, ticker and uid in turn, with the class of the instrument."""
    i = tape.instruments(spark, sf_dir)
    top = i.agg(F.max("load_order").alias("top"))
    r = tape.table(spark, sf_dir, "orders").crossJoin(F.broadcast(top)).select(F.col("o_orderkey").alias("seq"), (1 + F.col("o_orderkey") % F.col("top")).alias("k"))
    r = r.join(i, F.col("k") == F.col("load_order"))
    by = F.col("seq") % 3
    r = r.select("seq", "class_code", F.when(by == 0, "unspecified").when(by == 1, "ticker").otherwise("uid").alias("id_type"), F.when(by == 0, F.col("figi")).when(by == 1, F.col("ticker")).otherwise(F.col("uid")).alias("id"))
    return J.instrument_lookup(r, i).select("seq", "instrument.instrument_id")


@query("select user_id::varchar as instrument_id, epoch_us(ts) as us, case when event_type in ('click', 'purchase') then 'trade' when event_type = 'signup' then 'last_price' when event_type = 'view' then 'orderbook' end as event_type from events where event_type in ('click', 'purchase') or (event_type = 'signup' and user_id % 2 = 0) or (event_type = 'view' and user_id % 3 > 0)")
def subscription_filter(spark, sf_dir):
    ev = tape.events(spark, sf_dir)
    k = F.col("instrument_id").cast("bigint")
    subs = ev.select("instrument_id").distinct().select("instrument_id", F.lit(True).alias("trades"), (k % 2 == 0).alias("last_price"), F.lit(False).alias("info"), (k % 3).cast("int").alias("order_book_depth"), F.lit(False).alias("candles"))
    return J.subscription_filter(ev, subs).select("instrument_id", "us", "event_type")


@query("select upper(s_name) || '_' || upper(n_name) as instrument_id, lower(s_name) as alias, true as trades, false as last_price, s_suppkey % 3 > 0 as info, case when s_suppkey % 2 = 0 then (s_suppkey % 50)::int end as order_book_depth, s_suppkey % 5 = 0 as candles, case when s_suppkey % 5 = 0 then '5m' else '1m' end as candle_interval from supplier join nation on s_nationkey = n_nationkey")
def read_instruments(spark, sf_dir):
    """All suppliers as files of 500 instruments each (JSON, which is YAML), read back."""
    path, k = _scratch(spark, "instruments"), F.col("load_order")
    info, five = F.when(k % 3 == 0, False), F.when(k % 5 == 0, True)
    subscriptions = F.struct(F.lit(False).alias("last_price"), info.alias("info"), F.when(k % 2 == 0, (k % 50).cast("int")).alias("order_book_depth"), five.alias("candles"), F.when(five, "5m").alias("candle_interval"))
    item = F.struct(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), F.lower("class_code").alias("class_code"), F.when(k % 2 == 0, F.upper("alias")).alias("alias"), subscriptions.alias("subscriptions"))
    files = tape.instruments(spark, sf_dir).groupBy(F.floor(k / 500).alias("file")).agg(F.collect_list(item).alias("instruments"))
    files.select("file", F.to_json(F.struct("instruments")).alias("value")).write.partitionBy("file").text(path)
    return R.read_instruments(spark, path).drop("ticker", "class_code")


@query("select c_custkey, case when c_custkey % 7 = 0 then 99.0 when c_custkey % 10 = 0 then 5.0 else 3.0 end::double as volume_zscore_threshold, case when c_custkey % 7 = 0 then 60 when c_custkey % 10 = 0 then 30 else 60 end as trade_window_seconds from customer")
def read_detector_settings(spark, sf_dir):
    """Defaults from a settings file, and tables of blocks for the customers: an override
    block replaces the whole block of the main table."""
    from tapewright.operators.detectors import join_settings

    main, blocks, own = (_scratch(spark, x) for x in ("settings", "blocks", "overrides"))
    text = json.dumps({"detector": {"volume_zscore_threshold": 3.0, "of_no_use": 1}, "per_instrument": {" none ": {"volume_zscore_threshold": 1}}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(main)
    c = tape.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("instrument_id"))
    c.filter("c_custkey % 10 = 0").select("instrument_id", F.lit(5.0).alias("volume_zscore_threshold"), F.lit(30).alias("trade_window_seconds")).write.json(blocks)
    c.filter("c_custkey % 7 = 0").select("instrument_id", F.lit(99.0).alias("volume_zscore_threshold")).write.json(own)
    default, _ = R.read_detector_settings(spark, main)
    table = R.resolve_blocks(default, R.read_setting_blocks(spark, blocks), R.read_setting_blocks(spark, own))
    return join_settings(c, default, table).select("c_custkey", "volume_zscore_threshold", "trade_window_seconds")


CANDLE_SQL = """t as (select l_suppkey::varchar as id, epoch_us(l_shipdate) as at_, l_extendedprice / l_quantity as price, l_quantity as volume, (epoch_us(l_shipdate), l_orderkey, l_linenumber, l_partkey, l_extendedprice) as o from lineitem),
c as (select id, at_ - at_ % 86400000000 as us, arg_min(price, o) as open, max(price) as high, min(price) as low, arg_max(price, o) as close, sum(volume) as volume from t group by 1, 2)"""
N6 = ("open", "high", "low", "close")


def _six(d, *columns):
    return d.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in d.columns))


@query("with " + CANDLE_SQL + " select id as instrument_id, us, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from c")
def candle_build(spark, sf_dir):
    return _six(tape.candles(spark, sf_dir).drop("seq", "is_complete"), *N6)


def _stored(spark, sf_dir):
    """Candles as the wire has them: quotations, timestamps, an interval name."""
    c = tape.candles(spark, sf_dir)
    q = {x: S.decimal_to_quotation(F.round(x, 6).cast("decimal(28,9)")) for x in N6}
    return c.select("instrument_id", F.lit("DAY").alias("interval"), F.timestamp_micros("us").alias("time"), *(v.alias(k) for k, v in q.items()), F.col("volume").cast("bigint").alias("volume"), "is_complete")


WIRE_SQL = "with " + CANDLE_SQL + " select id as instrument_id, us, round(round(open, 6)::decimal(28,9)::double, 6) as open, round(round(close, 6)::decimal(28,9)::double, 6) as close, volume::bigint as volume from c"


def _read(d):
    return d.select("instrument_id", F.unix_micros("time").alias("us"), F.round(F.col("open").cast("double"), 6).alias("open"), F.round(F.col("close").cast("double"), 6).alias("close"), "volume")


@query(WIRE_SQL)
def candle_events(spark, sf_dir):
    return _read(C.candle_rows(_stored(spark, sf_dir)))


@query(WIRE_SQL)
def write_candles(spark, sf_dir):
    """All candles, the first half twice, by interval and month; and all of them back, once."""
    path, rows = _scratch(spark, "candles"), C.candle_rows(_stored(spark, sf_dir))
    K.write_candles(rows.filter(F.col("time") < "1995-06-17"), path)
    K.write_candles(rows, path)
    return _read(R.read_candles(spark, path))


@query(WIRE_SQL + " where us >= epoch_us(timestamp '1995-01-15') and us <= epoch_us(timestamp '1996-12-10')")
def read_candles(spark, sf_dir):
    """All candles are stored; the reader cuts a range out of them."""
    import datetime as dt

    path = _scratch(spark, "candles")
    K.write_candles(C.candle_rows(_stored(spark, sf_dir)), path)
    return _read(R.read_candles(spark, path, "DAY", dt.datetime(1995, 1, 15), dt.datetime(1996, 12, 10)))


@query(WIRE_SQL)
def read_candle_csv(spark, sf_dir):
    path = _scratch(spark, "csv")
    write_candle_csv(C.candle_rows(_stored(spark, sf_dir)), path)
    return _read(R.read_candle_csv(spark, path, partition="instrument_id"))


@query("with " + CANDLE_SQL + " select id as instrument_id, us from c where volume >= 50")
def complete_candles(spark, sf_dir):
    c = tape.candles(spark, sf_dir).withColumn("is_complete", F.col("volume") >= 50)
    return C.complete_candles(c).select("instrument_id", "us")


A95, A96 = 788_918_400_000_000, 820_454_400_000_000  # 1995-01-01, 1996-01-01


@query(f"with {CANDLE_SQL} select id as instrument_id, us from c where us between {A95} and {A96}")
def candles_in_range(spark, sf_dir):
    return C.candles_in_range(tape.candles(spark, sf_dir), A95, A96).select("instrument_id", "us")


@query(f"with {CANDLE_SQL} select id as instrument_id, us from c where us >= {A96 + 5 * DAY} - ({A96 + 5 * DAY} + 62135596800000000) % 604800000000")
def fresh_candles(spark, sf_dir):
    return C.fresh_candles(tape.candles(spark, sf_dir), A96 + 5 * DAY, 7 * DAY_S).select("instrument_id", "us")


@query("with " + CANDLE_SQL + " select id as instrument_id, us from c where open > 0 and us % 172800000000 = 0")
def priced_candles(spark, sf_dir):
    odd = tape.candles(spark, sf_dir).withColumn("open", F.when(F.col("us") % (2 * DAY) == 0, F.col("open")))
    return C.priced_candles(odd).select("instrument_id", "us")


@query("with " + CANDLE_SQL + " select id as instrument_id, us, round(abs((close - open) / open) * 10000, 6) as bps from c")
def candle_abs_return_bps(spark, sf_dir):
    return tape.candles(spark, sf_dir).select("instrument_id", "us", F.round(C.candle_abs_return_bps(F.col("open"), F.col("close")), 6).alias("bps"))


@query(f"with {CANDLE_SQL}, m as (select id, avg(abs((close - open) / open) * 10000) as b, count(*) as n from c where us >= {A96} - 90 * 86400000000 and us <= {A96} and open > 0 group by 1) select id as instrument_id, round(b * 1.5, 4) as threshold_bps, n from m where n >= 24")
def hourly_thresholds(spark, sf_dir):
    recent = tape.candles(spark, sf_dir).filter(F.col("us") <= A96)
    return C.hourly_thresholds(recent, A96, 90, 1.5)


@query(f"with {CANDLE_SQL}, m as (select id, avg(abs((close - open) / open) * 10000) as b, count(*) as n from c where us >= {A96} - 400 * 86400000000 and us <= {A96} and open > 0 group by 1) select id as instrument_id, round(b, 4) as price_move_absolute_threshold_bps, 400 as lookback_days from m where n >= 24")
def write_threshold_overrides(spark, sf_dir):
    """Written as a whole set, twice, and read again."""
    import datetime as dt

    path, c = _scratch(spark, "thresholds"), tape.candles(spark, sf_dir).filter(F.col("us") <= A96)
    for days in (90, 400):
        K.write_threshold_overrides(C.hourly_thresholds(c, A96, days), path, dt.datetime(1996, 1, 1), days, 1.0)
    return spark.read.parquet(path).select("instrument_id", "price_move_absolute_threshold_bps", "lookback_days")


def _thresholds_sql() -> str:
    from tapewright.plans.detector_queries import MEASURED_SQL, SIGNALS_SELECT, gate_sql, z_sql

    sql = "with recursive " + MEASURED_SQL
    sql += ", own as (select id, avg(abs((close - open) / open) * 10000) as bps, count(*) as n from " + TICK_CANDLES + " group by 1 having count(*) >= 5)"
    sql += ", e_price as (select m.* from measured m left join own using (id) where move is not null and (bps is null or move >= round(bps * 0.05, 4)))"
    sql += gate_sql("g_price", "e_price", "id", 6 * 3_600_000_000) + ", z_move as " + z_sql("move", "g_price")
    sql += ", candidates as (select id, 'price_jump' as kind, us, seq, v, b, z, case when z >= 6 then 3 when z >= 4 then 2 else 1 end as severity from z_move where z >= 1.513)"
    return sql + gate_sql("found", "candidates", "id, kind", 24 * 3_600_000_000) + SIGNALS_SELECT


#: Daily candles of the market tape's own trades.
TICK_CANDLES = "(select id, us // 86400000000 as day, arg_min(price, (us, seq)) as open, arg_max(price, (us, seq)) as close from tape where kind = 'trade' group by 1, 2)"


@query(_thresholds_sql())
def threshold_overrides_in_force(spark, sf_dir):
    """Candles to thresholds, thresholds to a table, the table to settings, settings to ``detect_price_jump``."""
    import datetime as dt

    from tapewright.operators import detectors as D
    from tapewright.plans.detector_queries import shown

    ev, path = tape.events(spark, sf_dir), _scratch(spark, "thresholds")
    order = F.struct("us", "seq")
    days = ev.filter("event_type = 'trade'").groupBy("instrument_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"))
    candles = days.select("instrument_id", (F.col("day") * DAY).alias("us"), "open", "close", F.lit(True).alias("is_complete"))
    K.write_threshold_overrides(C.hourly_thresholds(candles, 1 << 60, 1 << 24, 0.05, at_least=5), path, dt.datetime(2024, 1, 1), 1 << 24, 0.05)
    blocks = R.threshold_blocks(spark, path)
    own = R.resolve_blocks(tape.SETTINGS, blocks.limit(0), blocks)
    return shown(D.detect(ev, tape.SETTINGS, own, only=("price_jump",)))


def _live(spark, sf_dir):
    """Ticks as live candles: arrival order is the tick order."""
    t = tape.ticks(spark, sf_dir)
    d = t.withColumn("us", F.col("at") - F.pmod(F.col("at"), F.lit(DAY))).withColumn("close", F.col("price"))
    return tape.numbered(d, "instrument_id", "at", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").select("instrument_id", "us", F.col("k").alias("seq"), "close")


@query("with " + CANDLE_SQL + " select id as instrument_id, us, round(close, 6) as close from c")
def drop_superseded_candles(spark, sf_dir):
    return _six(C.drop_superseded(_live(spark, sf_dir)).drop("seq"), "close")


@query("with " + CANDLE_SQL + " select id as instrument_id, us - (us + 62135596800000000) % 604800000000 as bucket_us, round(arg_max(close, us), 6) as close from c group by 1, 2")
def latest_candle_per_bucket(spark, sf_dir):
    return _six(C.latest_per_bucket(_live(spark, sf_dir), 7 * DAY_S).select("instrument_id", "bucket_us", "close"), "close")


@query("with t as (select l_suppkey::varchar as id, epoch_us(l_shipdate) as u, l_orderkey * 10 + l_linenumber as s, l_partkey, l_extendedprice from lineitem), k as (select *, row_number() over (partition by id order by s, l_partkey, l_extendedprice, u) as k, u - (u + 62135596800000000) % 604800000000 as b from t) select id as instrument_id, count(*) as late from (select id, b, max(b) over (partition by id order by k rows between unbounded preceding and 1 preceding) as top from k) where b < top group by 1")
def late_candles(spark, sf_dir):
    t = tape.ticks(spark, sf_dir).withColumn("s", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    d = tape.numbered(t, "instrument_id", "s", "l_partkey", "l_extendedprice", "at").select("instrument_id", F.col("at").alias("us"), F.col("k").alias("seq"))
    return C.late_candles(d, 7 * DAY_S).groupBy("instrument_id").agg(F.count("*").alias("late"))


def _halves(spark, sf_dir):
    """Two candle sets that overlap on every third day; the second one's closes are off by 1."""
    c = tape.candles(spark, sf_dir).select("instrument_id", "us", "close")
    d = F.floor(F.col("us") / DAY)
    return c.filter(d % 3 != 1), c.filter(d % 3 != 0).withColumn("close", F.col("close") + 1)


@query("with " + CANDLE_SQL + " select id as instrument_id, us, round(case when (us // 86400000000) % 3 = 1 then close + 1 else close end, 6) as close from c")
def merge_candles(spark, sf_dir):
    return _six(C.merge_candles(*_halves(spark, sf_dir)), "close")


@query("with " + CANDLE_SQL + " select id as instrument_id, count(*) as n from c group by 1")
def dedupe_chunks(spark, sf_dir):
    c = tape.candles(spark, sf_dir)
    return C.dedupe_chunks(c.unionByName(c.filter(F.col("us") % (2 * DAY) == 0))).groupBy("instrument_id").agg(F.count("*").alias("n"))


@query("with " + CANDLE_SQL + " select id as instrument_id, count(*) as n, count(*) >= 530 as enough from c group by 1")
def candle_count_check(spark, sf_dir):
    return C.candle_count_check(tape.candles(spark, sf_dir), 30 * DAY_S, 500 * DAY_S, DAY_S)


@query("with " + CANDLE_SQL + " select id as instrument_id, round(count(*) / ((max(us) - min(us)) / 86400000000), 9) as density from c group by 1 having max(us) > min(us)")
def trading_density(spark, sf_dir):
    return _six(C.trading_density(tape.candles(spark, sf_dir), DAY_S).filter("density is not null"), "").withColumn("density", F.round("density", 9))


def _ranges(spark, sf_dir):
    """Each order of a customer covers 20 days from its date."""
    return tape.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("instrument_id"), tape.us("o_orderdate").alias("start"), (tape.us("o_orderdate") + 20 * DAY).alias("end"))


RANGE_SQL = "r as (select o_custkey::varchar as id, epoch_us(o_orderdate) as s, epoch_us(o_orderdate) + 1728000000000 as e from orders)"
MERGED_SQL = RANGE_SQL + """, m as (select *, case when s > max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from r),
g as (select id, grp, min(s) as s, max(e) as e from (select *, sum(n) over (partition by id order by s, e rows unbounded preceding) as grp from m) group by 1, 2)"""


@query("with " + MERGED_SQL + " select id as instrument_id, s as range_start, e as range_end from g")
def coverage_coalesce(spark, sf_dir):
    return C.coverage_coalesce(_ranges(spark, sf_dir)).withColumnsRenamed({"start": "range_start", "end": "range_end"})


def _requests(spark, sf_dir):
    return _ranges(spark, sf_dir).select("instrument_id").distinct().select("instrument_id", F.lit(A95).cast("bigint").alias("start"), F.lit(A96).cast("bigint").alias("end"))


GAPS_SQL = MERGED_SQL + f""", i as (select id, greatest(s, {A95}) as s, least(e, {A96}) as e from g where s <= {A96} and e >= {A95}), q as (select distinct id from r),
p as (select id, s, coalesce(lag(e) over (partition by id order by s), {A95}) as before from i),
gaps as (select id, before as s, s as e from p where s > before union all
  select q.id, coalesce(z.e, {A95}), {A96} from q left join (select id, max(e) as e from i group by 1) z on q.id = z.id where coalesce(z.e, {A95}) + 86400000000 <= {A96})"""


@query("with " + GAPS_SQL + " select id as instrument_id, s as gap_start, e as gap_end from gaps")
def coverage_gaps(spark, sf_dir):
    return C.coverage_gaps(_requests(spark, sf_dir), _ranges(spark, sf_dir), DAY_S).withColumnsRenamed({"start": "gap_start", "end": "gap_end"})


MANY_SQL = """r as (select o_custkey::varchar as id, epoch_us(o_orderdate) - 864000000000 as s, epoch_us(o_orderdate) + 4320000000000 as e from orders),
c as (select o_custkey::varchar as id, epoch_us(o_orderdate) as s, epoch_us(o_orderdate) + 1728000000000 as e from orders where o_orderkey % 3 > 0),
rm as (select *, case when s > max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from r),
ri as (select id, min(s) as s, max(e) as e from (select *, sum(n) over (partition by id order by s, e rows unbounded preceding) as g from rm) group by id, g),
cm as (select *, case when s > max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from c),
ci as (select id, min(s) as s, max(e) as e from (select *, sum(n) over (partition by id order by s, e rows unbounded preceding) as g from cm) group by id, g),
i as (select ri.id, ri.s as rs, ri.e as re, greatest(ci.s, ri.s) as s, least(ci.e, ri.e) as e from ri join ci on ri.id = ci.id and ci.s <= ri.e and ci.e >= ri.s),
p as (select *, coalesce(lag(e) over (partition by id, rs order by s), rs) as before from i)
select id as instrument_id, before as gap_start, s as gap_end from p where s > before
union all select ri.id, coalesce(z.e, ri.s), ri.e from ri left join (select id, rs, max(e) as e from i group by 1, 2) z on ri.id = z.id and ri.s = z.rs where coalesce(z.e, ri.s) + 86400000000 <= ri.e"""


@query("with " + MANY_SQL)
def coverage_gaps_many(spark, sf_dir):
    """Many requests a key that overlap: each order asks for ten days before and fifty after it, two
    orders of three cover twenty."""
    o = tape.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("instrument_id"), tape.us("o_orderdate").alias("at"), "o_orderkey")
    asked = o.select("instrument_id", (F.col("at") - 10 * DAY).alias("start"), (F.col("at") + 50 * DAY).alias("end"))
    stored = o.filter("o_orderkey % 3 > 0").select("instrument_id", F.col("at").alias("start"), (F.col("at") + 20 * DAY).alias("end"))
    return C.coverage_gaps(asked, stored, DAY_S).withColumnsRenamed({"start": "gap_start", "end": "gap_end"})


@query(
    "with t as (select l_suppkey::varchar as id, epoch_us(l_shipdate) as u, l_orderkey * 10 + l_linenumber as s, l_partkey, l_extendedprice, l_extendedprice / l_quantity as p from lineitem), "
    "k as (select *, row_number() over (partition by id order by s, l_partkey, l_extendedprice, u) as k, u - (u + 62135596800000000) % 604800000000 as b from t), "
    "m as (select *, max(b) over (partition by id order by k rows between unbounded preceding and 1 preceding) as top, max(b) over (partition by id) as last from k), "
    "f as (select * from m where top is null or b >= top) "
    "select id as instrument_id, b as bucket_us, round(arg_max(p, k), 6) as close, false as late, count(*) as n from f where b < last group by 1, 2 "
    "union all select id, b, round(p, 6), true, 1 from m where b < top"
)
def live_candles(spark, sf_dir):
    """A stream of live candles in two micro-batches: what their intervals came to, and late ones aside."""
    from tapewright.streaming.candles import live_candles as live

    t = tape.ticks(spark, sf_dir).withColumn("s", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    d = tape.numbered(t, "instrument_id", "s", "l_partkey", "l_extendedprice", "at").select("instrument_id", F.col("at").alias("us"), F.col("k").cast("bigint").alias("seq"), F.col("price").alias("close"))
    feed, source, out, state = (_scratch(spark, x) for x in ("feed", "live", "candles", "state"))
    d.write.parquet(feed)  # numbered once for both
    d, half = spark.read.schema(d.schema).parquet(feed), F.col("seq") <= 300
    for part in (d.filter(half), d.filter(~half)):
        part.write.mode("append").parquet(source)
        found = live(spark.readStream.schema(d.schema).parquet(source), 7 * DAY_S)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    schema = "instrument_id string, bucket_us bigint, us bigint, seq bigint, close double, n bigint, late boolean"
    return spark.read.schema(schema).parquet(out).select("instrument_id", "bucket_us", F.round("close", 6).alias("close"), "late", "n")


@query(f"with {RANGE_SQL} select id as instrument_id, s as stored_start, greatest(s, {A95}) as overlap_start, least(e, {A96}) as overlap_end from r where s <= {A96} and e >= {A95}")
def range_overlap(spark, sf_dir):
    d = J.range_overlap(_requests(spark, sf_dir), _ranges(spark, sf_dir))
    return d.select("instrument_id", "stored_start", F.col("start").alias("overlap_start"), F.col("end").alias("overlap_end"))


@query(f"with {CANDLE_SQL} select id as instrument_id, us, round(case when us <= {A95 + 100 * DAY} or us > {A95 + 200 * DAY} then close else close + 1 end, 6) as close from c where us between {A95} and {A96}")
def stitched_candles(spark, sf_dir):
    """Stored but for days 100 to 200 of the year; the rest is loaded (closes off by 1)."""
    c = tape.candles(spark, sf_dir).select("instrument_id", "us", "close", "is_complete")
    ids = c.select("instrument_id").distinct()
    cover = ids.select("instrument_id", F.lit(A95).cast("bigint").alias("start"), F.lit(A95 + 100 * DAY).cast("bigint").alias("end"))
    cover = cover.unionByName(ids.select("instrument_id", F.lit(A95 + 200 * DAY + 1).cast("bigint").alias("start"), F.lit(A96).cast("bigint").alias("end")))
    stored = c.filter((F.col("us") <= A95 + 100 * DAY) | (F.col("us") > A95 + 200 * DAY))
    want = ids.select("instrument_id", F.lit(A95).cast("bigint").alias("start"), F.lit(A96).cast("bigint").alias("end"))
    out = C.stitched_candles(stored, cover, c.withColumn("close", F.col("close") + 1), want, DAY_S)
    return _six(out.drop("is_complete"), "close")


FEATURE_SQL = CANDLE_SQL + """, f as (select id, us, close as p, avg(close) over (w range between 863999999999 preceding and current row) as s, avg(close) over (w range between 2591999999999 preceding and current row) as l,
  stddev_pop(close) over (w range between 2591999999999 preceding and current row) as d, last_value(close) over (w range between unbounded preceding and 864000000000 preceding) as o from c window w as (partition by id order by us))"""


def _features(spark, sf_dir):
    return M.ma_features(tape.candles(spark, sf_dir), 10 * DAY_S, 30 * DAY_S, 30 * DAY_S)


@query("with " + FEATURE_SQL + " select id as instrument_id, us, round(p, 5) as price, round(s, 5) as ma_short, round(l, 5) as ma_long, round(d, 5) as std, round(o, 5) as ma_long_start from f")
def ma_features(spark, sf_dir):
    d = _features(spark, sf_dir)
    return d.select("instrument_id", "us", *(F.round(c, 5).alias(c) for c in ("price", "ma_short", "ma_long", "std", "ma_long_start")))


@query("with " + FEATURE_SQL + " select id as instrument_id, us, round(s, 5) as ma from f")
def moving_average(spark, sf_dir):
    return tape.candles(spark, sf_dir).select("instrument_id", "us", F.round(W.moving_average(F.col("close"), 10 * DAY_S), 5).alias("ma"))


@query("with " + FEATURE_SQL + " select id as instrument_id, us, round(d, 5) as std from f")
def moving_std(spark, sf_dir):
    return tape.candles(spark, sf_dir).select("instrument_id", "us", F.round(W.moving_std(F.col("close"), 30 * DAY_S), 5).alias("std"))


@query("with " + FEATURE_SQL + " select id as instrument_id, us, round(o, 5) as start_close from f where o is not null")
def asof_first_candle_before(spark, sf_dir):
    d = tape.candles(spark, sf_dir).select("instrument_id", "us", F.round(W.first_candle_before(F.col("close"), 10 * DAY_S), 5).alias("start_close"))
    return d.filter("start_close is not null")


@query("with " + FEATURE_SQL + " select id as instrument_id, us, coalesce(s > l and l > o and abs((p - l) / l) < d, false) as may_long, coalesce(s < l and l < o and abs((p - l) / l) < d, false) as may_short from f")
def ma_open_signals(spark, sf_dir):
    return M.ma_open_signals(_features(spark, sf_dir)).select("instrument_id", "us", "may_long", "may_short")


@query("with " + FEATURE_SQL + " select id as instrument_id, us, p > l + 1.513 * d or p < l - 1.213 * d as end_long, p < l - 1.513 * d or p > l + 1.213 * d as end_short from f")
def ma_close_signals(spark, sf_dir):
    return M.ma_close_signals(_features(spark, sf_dir), 1.513, 1.213).select("instrument_id", "us", "end_long", "end_short")


def _orders(spark, sf_dir):
    return M.ma_order_signals(_features(spark, sf_dir).withColumn("balance", F.lit(100_000.0)))


# the fold candle by candle: which sides are open, and the lots of the last opening
ORDERS_SQL = "with recursive " + FEATURE_SQL + """, r as (
  select id, us, row_number() over (partition by id order by us) as k, case when p > 0 then floor(100000.0 / p)::bigint else 0 end as lots,
    coalesce(s > l and l > o and abs((p - l) / l) < d, false) as may_long, coalesce(s < l and l < o and abs((p - l) / l) < d, false) as may_short,
    p > l + 10.0 * d or p < l - 3.0 * d as end_long, p < l - 10.0 * d or p > l + 3.0 * d as end_short from f
), w(id, k, us, is_long, is_short, held, lots, open_long, open_short, close_long, close_short, before) as (
  select distinct id, 0::bigint, 0::bigint, false, false, 0::bigint, 0::bigint, false, false, false, false, 0::bigint from r
  union all
  select id, k, us, (is_long and not close_long) or open_long, (is_short and not close_short) or open_short,
    case when open_long or open_short then lots when close_long or close_short then 0 else held end, lots, open_long, open_short, close_long, close_short, held
  from (
    select *, is_long and (end_long or open_short) as close_long, is_short and (end_short or open_long) as close_short from (
      select r.id, r.k, r.us, w.is_long, w.is_short, w.held, r.lots, r.end_long, r.end_short,
        not w.is_long and r.may_long and r.lots > 0 as open_long, not w.is_short and r.may_short and r.lots > 0 as open_short
      from w join r on w.id = r.id and r.k = w.k + 1)))
select id as instrument_id, us, 'open' as action, 'long' as direction, lots from w where open_long
union all select id, us, 'open', 'short', lots from w where open_short
union all select id, us, 'close', 'long', before from w where close_long
union all select id, us, 'close', 'short', before from w where close_short"""


@query(ORDERS_SQL)
def ma_order_signals(spark, sf_dir):
    """A fold over each instrument."""
    return _orders(spark, sf_dir)


@query(f"select * from ({ORDERS_SQL}) order by us, action <> 'close', instrument_id, direction")
def closing_before_opening(spark, sf_dir):
    return M.closing_before_opening(_orders(spark, sf_dir))


@query("with " + CANDLE_SQL + ", n as (select id, floor(10 * (count(*) / ((max(us) - min(us)) / 86400000000)) + 1e-9) as n from c group by 1 having max(us) > min(us)), k as (select c.id, us, close, n, row_number() over (partition by c.id order by us) as k from c join n using (id)) select a.id as instrument_id, a.us, round(avg(b.close), 5) as mav from k a join k b on a.id = b.id and b.k > a.k - a.n and b.k <= a.k where a.k >= a.n group by 1, 2")
def mav_rows(spark, sf_dir):
    d = W.mav_rows(tape.candles(spark, sf_dir).select("instrument_id", "us", "close"), "close", 10 * DAY_S, DAY_S)
    return d.filter("mav is not null").select("instrument_id", "us", F.round("mav", 5).alias("mav"))


@query(
    "with " + CANDLE_SQL + ", e as (select id, min(us) as a, max(us) as b, count(*) as n from c group by 1), s as (select l_suppkey::varchar as id, epoch_us(l_shipdate) as us, l_orderkey as o from lineitem), "
    "p as (select s.id, s.o, s.us, least(trunc((s.us - a) / (b - a) * n)::bigint, n - 1) as position from s join e on s.id = e.id where b > a), q as (select id, us, row_number() over (partition by id order by us) - 1 as position from c) "
    "select p.id as instrument_id, p.o as l_orderkey, p.us, p.position, q.us as candle_us from p join q on p.id = q.id and p.position = q.position"
)
def align_signals_to_candles(spark, sf_dir):
    t = tape.ticks(spark, sf_dir).select("instrument_id", F.col("at").alias("us"), "l_orderkey")
    return J.align_signals_to_candles(t, tape.candles(spark, sf_dir)).select("instrument_id", "l_orderkey", "us", "position", "candle_us")


@query("with " + CANDLE_SQL + " select id as instrument_id, us, volume from c order by us, id")
def sort_candles(spark, sf_dir):
    return tape.candles(spark, sf_dir).select("instrument_id", "us", "volume").orderBy("us", "instrument_id")


def _signal_rows(spark, sf_dir):
    from tapewright.operators.detectors import detect, signals

    return signals(detect(tape.events(spark, sf_dir), tape.SETTINGS, only=("volume_spike",)))


def _counted(d):
    return d.groupBy("instrument_id").agg(F.count("*").alias("n"), F.countDistinct("signal_id").alias("ids"))


def _spikes_sql() -> str:
    from tapewright.plans.detector_queries import FOUND_SQL

    return FOUND_SQL + " select id as instrument_id, count(*) as n, count(*) as ids from found where kind = 'volume_spike' group by 1"


@query(_spikes_sql())
def write_signals(spark, sf_dir):
    """Appended twice, as on redelivery: no row twice."""
    path, found = _scratch(spark, "signals"), _signal_rows(spark, sf_dir)
    for _ in range(2):
        K.write_signals(found, path)
    return _counted(R.read_signals(spark, path))


@query(_spikes_sql())
def read_signals(spark, sf_dir):
    path = _scratch(spark, "signals")
    K.write_signals(_signal_rows(spark, sf_dir), path)
    return _counted(R.read_signals(spark, path))


@query(_spikes_sql())
def signal_fanout(spark, sf_dir):
    path, topic = _scratch(spark, "signals"), _scratch(spark, "topic")

    def broken(_):
        raise RuntimeError("no such chat")

    K.signal_fanout(lambda b: K.write_signals(b, path), lambda b: K.topic_rows(b).write.parquet(topic), [broken])(_signal_rows(spark, sf_dir), 0)
    sent = spark.read.parquet(topic).select(F.col("key").alias("instrument_id"), F.get_json_object("value", "$.signal_id").alias("signal_id"))
    return _counted(sent.join(R.read_signals(spark, path), ["instrument_id", "signal_id"], "left_semi"))


@query(_spikes_sql())
def write_signal_topic(spark, sf_dir):
    sent = K.topic_rows(_signal_rows(spark, sf_dir))
    return _counted(sent.select(F.col("key").alias("instrument_id"), F.get_json_object("value", "$.signal_id").alias("signal_id")))
