"""Event, window, gate, as-of and detector queries on the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import scalars as S
from tapewright.operators import detectors as D
from tapewright.operators import rules as R
from tapewright.operators import signals as Q
from tapewright.operators import windows as W
from tapewright.operators.gates import Gate, greedy_gate
from tapewright.plans import tape
from tapewright.schemas import SIGNAL_TYPES
from tapewright.streaming.detect import OUT, stream_detect

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
H = 3_600_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TAPE_SQL = """tape as (
  select user_id::varchar as id, epoch_us(ts) as us, event_id as seq,
    case when event_type in ('click', 'purchase') then 'trade' when event_type = 'signup' then 'last_price' when event_type = 'view' then 'orderbook' when event_type = 'error' then 'trading_status' end as kind,
    case when event_type in ('click', 'purchase') then value end as qty,
    case when event_type in ('click', 'purchase', 'signup') then 100 + k / 10 end as price,
    case when event_type = 'click' then value when event_type = 'purchase' then -value end as signed,
    case when event_type = 'view' then 100 - value / 100 end as bid, case when event_type = 'view' then 100 + value / 100 end as ask,
    case when event_type = 'view' then (k + 1)::double end as bq, case when event_type = 'view' then (100 - k)::double end as aq,
    case when event_type = 'error' then ['NORMAL', 'BREAK', 'CLOSE'][k % 3 + 1] end as status
  from (select *, json_extract_string(props, '$.k')::int as k from events))"""
MEASURED_SQL = (
    TAPE_SQL
    + f""", base as (
  select *, kind = 'trade' and price is not null and coalesce(qty, 0) > 0 as is_trade,
    (kind = 'trade' and price is not null and coalesce(qty, 0) > 0) or (kind = 'last_price' and price > 0) as is_price,
    case when bid > 0 and ask > 0 and bq + aq > 0 then (ask - bid) / ((bid + ask) / 2) * 10000 end as spread,
    case when bid > 0 and ask > 0 and bq + aq > 0 then abs((bq - aq) / (bq + aq)) end as imbalance,
    case when bid > 0 and ask > 0 and bq + aq > 0 then bq / (bq + aq) end as bid_share
  from tape
), win as (
  select *, coalesce(sum(case when is_trade then qty end) over tw, 0) as volume, count(case when is_trade then qty end) over tw as rate,
    coalesce(sum(case when is_trade then signed end) over tw, 0) as delta_here,
    first_value(case when is_price then price end ignore nulls) over pw as p0, count(case when is_price then price end) over pw as np,
    last_value(case when status <> '' then status end ignore nulls) over (partition by id order by us, seq rows between unbounded preceding and 1 preceding) as status_before
  from base
  window tw as (partition by id order by us range between {48 * H} preceding and current row), pw as (partition by id order by us range between {72 * H} preceding and current row)
), measured as (
  select *, case when is_price and np >= 2 and p0 > 0 then abs((price - p0) / p0) * 10000 end as move,
    coalesce(last_value(case when is_trade then delta_here end ignore nulls) over (partition by id order by us, seq rows between unbounded preceding and current row), 0) as delta,
    coalesce(kind = 'trading_status' and status_before is not null and status <> status_before, false) as status_changed
  from win)"""
)


def gate_sql(name: str, source: str, keys: str, interval: int) -> str:
    """Recursive greedy gate over ``source(keys.., us, seq)``; ``name`` gets (keys.., us, seq)."""
    on = " and ".join(f"g.{k} = e.{k}" for k in keys.split(", "))
    own = ", ".join(f"e.{k}" for k in keys.split(", "))
    return f""", {name}_t as (
  select {keys}, min(us) as us from {source} group by {keys}
  union all
  select {own}, min(e.us) as us from {name}_t g join {source} e on {on} and e.us >= g.us + {interval} group by {own}
), {name} as (select e.* from {source} e join {name}_t g on {on} and e.us = g.us)"""


def z_sql(value: str, gate: str) -> str:
    return f"""(select id, us, seq, {value} as v, avg({value}) over w as b, count({value}) over w as n,
    case when count({value}) over w >= 5 then case when stddev_pop({value}) over w <= 1e-12 then case when {value} > avg({value}) over w then 999.0 else 0.0 end else ({value} - avg({value}) over w) / stddev_pop({value}) over w end end as z
  from {gate} window w as (partition by id order by us, seq rows between 20 preceding and 1 preceding))"""


SCORED_SQL = (
    "with recursive "
    + MEASURED_SQL
    + ", e_trade as (select * from measured where is_trade), e_price as (select * from measured where move is not null), e_book as (select * from measured where spread is not null)"
    + gate_sql("g_trade", "e_trade", "id", 6 * H)
    + gate_sql("g_price", "e_price", "id", 6 * H)
    + gate_sql("g_book", "e_book", "id", 6 * H)
    + f""", z_volume as {z_sql("volume", "g_trade")}, z_rate as {z_sql("rate", "g_trade")}, z_move as {z_sql("move", "g_price")}, z_spread as {z_sql("spread", "g_book")}, z_imbalance as {z_sql("imbalance", "g_book")}
, fired as (
  select id, us, seq, 'volume_spike' as kind, v, b, z from z_volume where z >= 1.513
  union all select id, us, seq, 'trade_rate_spike', v, b, z from z_rate where z >= 1.513
  union all select id, us, seq, 'price_jump', v, b, z from z_move where z >= 1.513
  union all select id, us, seq, 'spread_widening', v, b, z from z_spread where z >= 1.513
  union all select id, us, seq, 'orderbook_imbalance', v, b, z from z_imbalance where z >= 1.213 and v >= 0.5
), e_combo as (select id, us, seq, delta, null::double as share from g_trade union all select id, us, seq, delta, bid_share from g_book)"""
    + gate_sql("g_combo", "e_combo", "id", 6 * H)
    + f""", marks as (
  select id, us, seq, delta, share, true as evaluated, null::bigint as a1, null::bigint as a2, null::bigint as a3 from g_combo
  union all select id, us, seq, null, share, false, null, null, null from e_combo
  union all select id, us, seq, null, null, false, case when kind = 'spread_widening' then us end, case when kind = 'trade_rate_spike' then us end, case when kind = 'orderbook_imbalance' then us end from fired
), asof_ as (
  select id, us, seq, delta, evaluated, max(a1) over w as s1, max(a2) over w as s2, max(a3) over w as s3,
    last_value(share ignore nulls) over (partition by id order by us, seq, evaluated rows between unbounded preceding and current row) as sh
  from marks window w as (partition by id order by us, seq range between unbounded preceding and current row)
), scores as (
  select id, us, seq, delta, sh, coalesce(s1 >= us - {48 * H}, false) as spread_on, coalesce(s2 >= us - {48 * H}, false) as rate_on, coalesce(s3 >= us - {48 * H}, false) as imbalance_on
  from (select *, row_number() over (partition by id, us, seq order by evaluated desc) as r from asof_ where evaluated) where r = 1
), combo as (
  select *, spread_on::int + 2 * rate_on::int + case when imbalance_on and sh >= 0.8 then 1 else 0 end + case when delta >= 1 then 2 else 0 end as long_score,
    spread_on::int + 2 * rate_on::int + case when imbalance_on and sh <= 0.2 then 1 else 0 end + case when delta <= -1 then 2 else 0 end as short_score
  from scores
), candidates as (
  select id, kind, us, seq, v, b, z, case when z >= 6 then 3 when z >= 4 then 2 else 1 end as severity from fired
  union all select id, 'trading_status_changed', us, seq, 1.0, 0.0, 0.0, 2 from measured where status_changed
), combos as (
  select id, 'microstructure_combo_long' as kind, us, seq, long_score::double as v, 4.0 as b, 0.0 as z, case when long_score >= 6 then 3 else 2 end as severity from combo where long_score >= 4
  union all select id, 'microstructure_combo_short', us, seq, short_score, 4.0, 0.0, case when short_score >= 6 then 3 else 2 end from combo where short_score >= 4
)"""
)
FOUND_SQL = SCORED_SQL + gate_sql("ready", "candidates", "id, kind", 24 * H) + gate_sql("ready_combo", "combos", "id, kind", 48 * H)
FOUND_SQL += ", found as (select * from ready union all select * from ready_combo)"
# two decimals, rounded half up as format_string does
FOUND_SQL += ", rounded as (select *, " + ", ".join(f"round({c}::decimal(28, 10), 2)::double as {c}2" for c in "vbz") + " from ready)"
SIGNALS_SELECT = " select id as instrument_id, us, kind as signal_type, severity::int as severity, round(v, 7) as metric_value, round(b, 7) as baseline_value, round(z, 7) as z_score from found"


def shown(found):
    return found.select("instrument_id", "us", "signal_type", "severity", *(F.round(c, 7).alias(c) for c in ("metric_value", "baseline_value", "z_score")))


def _one(kind: str, name: str):
    def run(spark, sf_dir):
        return shown(D.detect(tape.events(spark, sf_dir), tape.SETTINGS, only=(kind,)))

    run.__name__ = name
    query(FOUND_SQL + SIGNALS_SELECT + f" where kind = '{kind}'")(run)


for _kind, _name in zip(SIGNAL_TYPES, ("detect_volume_spike", "detect_trade_rate_spike", "detect_price_jump", "detect_spread_widening", "detect_orderbook_imbalance", "detect_status_change", "detect_combo_long", "detect_combo_short")):
    _one(_kind, _name)


@query(FOUND_SQL + SIGNALS_SELECT)
def detect_all(spark, sf_dir):
    return shown(D.detect(tape.events(spark, sf_dir), tape.SETTINGS))


@query(FOUND_SQL + SIGNALS_SELECT)
def stream_detect_replay(spark, sf_dir):
    """The streaming fold over the whole table, in order."""
    return shown(stream_detect(tape.events(spark, sf_dir).withColumn("seq", F.col("us")), tape.SETTINGS))


def _streamed(spark, sf_dir, *in_force):
    """Both halves of the tape, by time, arrive one after the other at one stream, whose
    state outlives the first run; ``in_force`` are the settings of each."""
    from tapewright.plans.table_queries import _scratch

    ev = tape.events(spark, sf_dir).withColumn("seq", F.col("us"))
    ends = ev.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()  # one row
    cut = ((ends.a or 0) + (ends.b or 0)) // 2
    source, out, state = (_scratch(spark, x) for x in ("arrived", "signals", "state"))
    for part, settings in zip((ev.filter(F.col("us") <= cut), ev.filter(F.col("us") > cut)), in_force):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        found = stream_detect(stream, refresh=lambda s=settings: (s, {}))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.schema(OUT).parquet(out))


@query(FOUND_SQL + SIGNALS_SELECT)
def stream_detect_live(spark, sf_dir):
    """The stateful stream over files that arrive in two micro-batches."""
    return _streamed(spark, sf_dir, tape.SETTINGS, tape.SETTINGS)


STRICT = tape.SETTINGS.with_(dict.fromkeys(("volume_zscore_threshold", "trade_count_zscore_threshold", "price_return_zscore_threshold", "spread_zscore_threshold"), 1.913))


@query(FOUND_SQL.replace("where z >= 1.513", "where z >= case when us <= (select (min(us) + max(us)) // 2 from tape) then 1.513 else 1.913 end") + SIGNALS_SELECT)
def refresh_settings(spark, sf_dir):
    """Thresholds change between two micro-batches; windows, samples and cooldowns stay."""
    return _streamed(spark, sf_dir, tape.SETTINGS, STRICT)


def _found(spark, sf_dir):
    return D.signals(D.detect(tape.events(spark, sf_dir), tape.SETTINGS))


@query(FOUND_SQL + ", n as (select max(us) as now from tape) select kind as signal_type, count(*) as n from found, n where us >= now - 86400000000 group by 1")
def signal_summary(spark, sf_dir):
    now = tape.events(spark, sf_dir).agg(F.timestamp_micros(F.max("us")).alias("now"))
    found = _found(spark, sf_dir).crossJoin(F.broadcast(now))  # one row
    return Q.signal_summary(found, F.col("now"), 5000)


@query(FOUND_SQL + " select id as instrument_id, kind as signal_type, us from found order by us desc, id, kind limit 200")
def recent_signals(spark, sf_dir):
    d = _found(spark, sf_dir).withColumn("signal_id", F.concat_ws("|", "instrument_id", "signal_type"))
    return Q.recent_signals(d, 200).select("instrument_id", "signal_type", F.unix_micros("detected_at").alias("us"))


@query(FOUND_SQL + " select kind as signal_type, us from found where id = '7'")
def signals_for_instrument(spark, sf_dir):
    # no signal depends on another instrument's events, and Spark can't push a filter through the gates
    own = Q.signals_for_instrument(tape.events(spark, sf_dir), " 7 ")
    found = D.signals(D.detect(own, tape.SETTINGS))
    return Q.signals_for_instrument(found, " 7 ").select("signal_type", F.unix_micros("detected_at").alias("us"))


@query(FOUND_SQL + ", n as (select max(us) as now from tape) select id as instrument_id, kind as signal_type, us from found, n where us >= now - 36000000000")
def signals_since(spark, sf_dir):
    now = tape.events(spark, sf_dir).agg(F.timestamp_micros(F.max("us")).alias("now"))
    d = Q.signals_since(_found(spark, sf_dir).crossJoin(F.broadcast(now)), F.col("now"), 600)
    return d.select("instrument_id", "signal_type", F.unix_micros("detected_at").alias("us"))


@query(
    FOUND_SQL
    + """ select id as instrument_id, kind as signal_type, us,
  case kind when 'volume_spike' then printf('%s rolling volume hit %.2f lots vs baseline %.2f (z=%.2f).', id, v2, b2, z2) when 'trade_rate_spike' then printf('%s trade count reached %.2f vs baseline %.2f (z=%.2f).', id, v2, b2, z2)
    when 'spread_widening' then printf('%s spread widened to %.2f bps vs baseline %.2f (z=%.2f).', id, v2, b2, z2) when 'orderbook_imbalance' then printf('%s order book imbalance reached %.2f vs baseline %.2f (z=%.2f).', id, v2, b2, z2)
    else printf('%s moved %.2f bps in 259200s vs baseline %.2f (z=%.2f).', id, v2, b2, z2) end as summary
  from rounded where kind <> 'trading_status_changed'"""
)
def signal_summary_text(spark, sf_dir):
    kinds = ["volume_spike", "trade_rate_spike", "price_jump", "spread_widening", "orderbook_imbalance"]
    d = D.detect(tape.events(spark, sf_dir), tape.SETTINGS, only=kinds)
    return D.signals(d).select("instrument_id", "signal_type", F.unix_micros("detected_at").alias("us"), "summary")


@query(
    FOUND_SQL
    + """, a as (select id, us, printf('%s rolling volume hit %.2f lots vs baseline %.2f (z=%.2f).', id, v2, b2, z2) as summary, severity, z2 from rounded where kind = 'volume_spike')
  select id as instrument_id, us, printf('[volume_spike] %s%s%s%sSeverity=%d z=%.2f', id, chr(10), summary, chr(10), severity, z2) as alert,
    left(id || ' | volume_spike', 64) as title, left(printf('%s%sSeverity=%d | z=%.2f', summary, chr(10), severity, z2), 240) as body from a"""
)
def alert_text(spark, sf_dir):
    d = D.signals(D.detect(tape.events(spark, sf_dir), tape.SETTINGS, only=("volume_spike",))).withColumn("ticker", F.col("instrument_id"))
    s = {c: F.col(c) for c in d.columns}
    note = S.notification(s)
    return d.select("instrument_id", F.unix_micros("detected_at").alias("us"), S.alert_text(s).alias("alert"), note["title"].alias("title"), note["body"].alias("body"))


@query("with " + TAPE_SQL + " select kind as event_type, count(*) as n from tape where kind in ('trade', 'last_price', 'orderbook', 'trading_status') group by 1")
def route_by_type(spark, sf_dir):
    return D.route(tape.events(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("with " + TAPE_SQL + " select id as instrument_id, us, price from tape where kind = 'trade' and price is not null and coalesce(qty, 0) > 0")
def valid_trades(spark, sf_dir):
    return tape.events(spark, sf_dir).filter(D.valid_trade()).select("instrument_id", "us", "price")


@query("with " + TAPE_SQL + " select id as instrument_id, us, price from tape where kind = 'last_price' and price > 0")
def valid_last_prices(spark, sf_dir):
    return tape.events(spark, sf_dir).filter(D.valid_last_price()).select("instrument_id", "us", "price")


@query("with " + MEASURED_SQL + " select id as instrument_id, us from measured where spread is not null")
def valid_books(spark, sf_dir):
    return tape.events(spark, sf_dir).filter(S.book_metrics(F.col("bids"), F.col("asks")).isNotNull()).select("instrument_id", "us")


@query("with " + TAPE_SQL + " select id as instrument_id, us, status from tape where kind = 'trading_status' and trim(status) <> ''")
def valid_statuses(spark, sf_dir):
    return tape.events(spark, sf_dir).filter(D.valid_status()).select("instrument_id", "us", F.col("trading_status").alias("status"))


@query("with " + MEASURED_SQL + " select id as instrument_id, us, bid as best_bid, ask as best_ask, round(spread, 6) as spread_bps, round(imbalance, 6) as imbalance_abs, round(bid_share, 6) as bid_share from measured where spread is not null")
def book_metrics(spark, sf_dir):
    b = S.book_metrics(F.col("bids"), F.col("asks"))
    d = tape.events(spark, sf_dir).withColumn("b", b).filter("b is not null")
    return d.select("instrument_id", "us", "b.best_bid", "b.best_ask", *(F.round(f"b.{c}", 6).alias(c) for c in ("spread_bps", "imbalance_abs", "bid_share")))


@query("with " + TAPE_SQL + " select id as instrument_id, us, bq as top_bids, aq as top_asks from tape where kind = 'orderbook'")
def top_level_sum(spark, sf_dir):
    d = tape.events(spark, sf_dir).filter("event_type = 'orderbook'")
    return d.select("instrument_id", "us", S.top_sum(F.col("bids")).alias("top_bids"), S.top_sum(F.col("asks")).alias("top_asks"))


@query("with " + TAPE_SQL + " select id as instrument_id, us, signed as signed_quantity, price * qty as notional from tape where kind = 'trade'")
def signed_quantity(spark, sf_dir):
    d = tape.events(spark, sf_dir).filter("event_type = 'trade'")
    return d.select("instrument_id", "us", S.signed_quantity(F.col("direction"), F.col("quantity")).alias("signed_quantity"), (F.col("price") * F.col("quantity")).alias("notional"))


@query("with " + TAPE_SQL + " select id as instrument_id, round(sum(price * qty), 2) as notional from tape where kind = 'trade' group by 1")
def notional(spark, sf_dir):
    d = tape.events(spark, sf_dir).filter("event_type = 'trade'")
    return d.groupBy("instrument_id").agg(F.round(F.sum(F.col("price") * F.col("quantity")), 2).alias("notional"))


def _trades(spark, sf_dir):
    return tape.events(spark, sf_dir).filter(D.valid_trade())


@query("with " + MEASURED_SQL + " select id as instrument_id, us, round(volume, 4) as volume from measured where is_trade")
def rolling_volume(spark, sf_dir):
    d = W.rolling(_trades(spark, sf_dir), {"volume": W.Rolling("sum", F.col("quantity"), 48 * 3600)})
    return d.select("instrument_id", "us", F.round("volume", 4).alias("volume"))


@query("with " + MEASURED_SQL + " select id as instrument_id, us, rate as trades from measured where is_trade")
def rolling_trade_count(spark, sf_dir):
    return W.rolling(_trades(spark, sf_dir), {"trades": W.Rolling("count", F.col("quantity"), 48 * 3600)}).select("instrument_id", "us", "trades")


@query("with " + MEASURED_SQL + " select id as instrument_id, us, round(delta_here, 4) as delta from measured where is_trade")
def rolling_signed_delta(spark, sf_dir):
    signed = S.signed_quantity(F.col("direction"), F.col("quantity"))
    return W.rolling(_trades(spark, sf_dir), {"delta": W.Rolling("sum", signed, 48 * 3600)}).select("instrument_id", "us", F.round("delta", 4).alias("delta"))


@query("with " + MEASURED_SQL + " select id as instrument_id, us, p0 as first_price, np as n from measured where is_price")
def rolling_first_price(spark, sf_dir):
    d = tape.events(spark, sf_dir).filter(D.valid_trade() | D.valid_last_price())
    d = W.rolling(d, {"first_price": W.Rolling("first", F.col("price"), 72 * 3600), "n": W.Rolling("count", F.col("price"), 72 * 3600)})
    return d.select("instrument_id", "us", "first_price", "n")


@query("with " + MEASURED_SQL + " select id as instrument_id, us, round(move, 6) as move_bps from measured where move is not null")
def move_bps(spark, sf_dir):
    d = tape.events(spark, sf_dir).filter(D.valid_trade() | D.valid_last_price())
    d = W.rolling(d, {"p": W.Rolling("first", F.col("price"), 72 * 3600), "n": W.Rolling("count", F.col("price"), 72 * 3600)})
    d = d.filter("n >= 2").withColumn("m", S.move_bps(F.col("price"), F.col("p"))).filter("m is not null")
    return d.select("instrument_id", "us", F.round("m", 6).alias("move_bps"))


@query("with " + MEASURED_SQL + " select id as instrument_id, us, status_before from measured where kind = 'trading_status'")
def status_lag(spark, sf_dir):
    d = tape.events(spark, sf_dir).filter(D.valid_status())
    return W.as_of(d, {"status_before": F.trim("trading_status")}, earlier=True).select("instrument_id", "us", "status_before")


@query("with recursive " + MEASURED_SQL + ", e_trade as (select * from measured where is_trade)" + gate_sql("g_trade", "e_trade", "id", 6 * H) + " select id as instrument_id, us, seq from g_trade")
def sample_gate(spark, sf_dir):
    d = _trades(spark, sf_dir).select("instrument_id", "us", "seq", F.lit(6 * H).cast("bigint").alias("interval"), F.lit(True).alias("ok"))
    return greedy_gate(d, ["instrument_id"], ["us", "seq"], [Gate("sampled", "interval", "ok")], block_us=32 * 6 * H).filter("sampled").select("instrument_id", "us", "seq")


@query(SCORED_SQL + gate_sql("ready", "candidates", "id, kind", 24 * H) + " select id as instrument_id, kind as signal_type, us from ready")
def cooldown_gate(spark, sf_dir):
    d = D.candidates(tape.events(spark, sf_dir), tape.SETTINGS, only=SIGNAL_TYPES[:6]).withColumn("ok", F.lit(True))
    return greedy_gate(d, ["instrument_id", "signal_type"], ["us", "seq"], [Gate("ready", "cooldown_us", "ok")]).filter("ready").select("instrument_id", "signal_type", "us")


@query(SCORED_SQL + " select id as instrument_id, us, round(v, 4) as volume, round(b, 7) as mean, n, round(z, 7) as z from z_volume")
def zscore_baseline(spark, sf_dir):
    d = W.rolling(_trades(spark, sf_dir), {"v": W.Rolling("sum", F.col("quantity"), 48 * 3600)})
    d = d.select("instrument_id", "us", "seq", "v", F.lit(6 * H).cast("bigint").alias("i"), F.lit(True).alias("ok"))
    s = greedy_gate(d, ["instrument_id"], ["us", "seq"], [Gate("g", "i", "ok")]).filter("g").withColumn("b", W.baseline(F.col("v"), 20, "instrument_id"))
    z = F.when(F.col("b.n") >= 5, S.z_score(F.col("v"), F.col("b.mean"), F.col("b.std")))
    return s.select("instrument_id", "us", F.round("v", 4).alias("volume"), F.round("b.mean", 7).alias("mean"), F.col("b.n").alias("n"), F.round(z, 7).alias("z"))


#: A sixth detector: the money a trade moves, in a slot of its own.
MONEY = dict(signal_type="notional_spike", label="notional", window="trade_window_seconds")
MONEY_SQL = (
    "with recursive "
    + MEASURED_SQL
    + ", e_money as (select *, price * qty as money from measured where is_trade)"
    + gate_sql("g_money", "e_money", "id", 6 * H)
    + ", z_money as "
    + z_sql("money", "g_money")
    + ", candidates as (select id, us, seq, v, b, z from z_money where z >= 1.713)"
    + gate_sql("ready", "candidates", "id", 24 * H)
    + " select id as instrument_id, us, 'notional_spike' as signal_type, case when z >= 6 then 3 when z >= 4 then 2 else 1 end::int as severity, round(v, 6) as metric_value, round(b, 6) as baseline_value, round(z, 6) as z_score from ready"
)


def _money():
    return F.when(D.valid_trade(), F.col("price") * F.col("quantity"))


def _shown_money(d):
    return d.select("instrument_id", "us", "signal_type", "severity", *(F.round(c, 6).alias(c) for c in ("metric_value", "baseline_value", "z_score")))


@query(MONEY_SQL)
def zscore_detector(spark, sf_dir):
    """A detector made of a column, a threshold and the name of its slot."""
    return _shown_money(D.zscore_detector(tape.events(spark, sf_dir), _money(), 1.713, "money", tape.SETTINGS, **MONEY))


@query(MONEY_SQL)
def zscore_detector_stream(spark, sf_dir):
    """The same rule folded by the stream's code, beside the market's own rules."""
    rules = [*R.market_rules(), R.ZRule(metric="money", of=_money, how="value", slot="money", threshold=1.713, **MONEY)]
    found = stream_detect(tape.events(spark, sf_dir).withColumn("seq", F.col("us")), tape.SETTINGS, rules=rules)
    return _shown_money(found.filter("signal_type = 'notional_spike'"))


@query("with " + TAPE_SQL + " select id as instrument_id, round(avg(qty), 6) as mean, round(stddev_pop(qty), 6) as std, count(qty) as n from tape where kind = 'trade' group by 1")
def baseline_stats(spark, sf_dir):
    q = F.col("quantity")
    return tape.events(spark, sf_dir).filter("event_type = 'trade'").groupBy("instrument_id").agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("std"), F.count(q).alias("n"))


@query(SCORED_SQL + " select id as instrument_id, kind as signal_type, us, severity::int as severity from candidates")
def emit_from_history(spark, sf_dir):
    """Scores over their threshold, before any cooldown."""
    return D.candidates(tape.events(spark, sf_dir), tape.SETTINGS, only=SIGNAL_TYPES[:6]).select("instrument_id", "signal_type", "us", "severity")


@query(SCORED_SQL + " select id as instrument_id, kind as signal_type, us, v::int as score from combos")
def combo_score(spark, sf_dir):
    d = D.candidates(tape.events(spark, sf_dir), tape.SETTINGS, only=SIGNAL_TYPES[6:])
    return d.select("instrument_id", "signal_type", "us", F.col("metric_value").cast("int").alias("score"))


ASOF_SQL = "select id, us, seq, last_value({c} ignore nulls) over (partition by id order by us, seq rows between unbounded preceding and current row) as v from measured"


@query("with " + MEASURED_SQL + " select id as instrument_id, us, round(v, 6) as bid_share from (" + ASOF_SQL.format(c="bid_share") + ") where v is not null")
def asof_book_ratio(spark, sf_dir):
    d = tape.events(spark, sf_dir).withColumn("b", S.book_metrics(F.col("bids"), F.col("asks"))["bid_share"])
    return W.as_of(d, {"share": F.col("b")}).select("instrument_id", "us", F.round("share", 6).alias("bid_share")).filter("bid_share is not null")


@query("with " + MEASURED_SQL + " select id as instrument_id, us, round(delta, 4) as delta from measured where kind = 'orderbook'")
def asof_signed_delta(spark, sf_dir):
    trade = D.valid_trade()
    signed = F.when(trade, S.signed_quantity(F.col("direction"), F.col("quantity")))
    d = W.rolling(tape.events(spark, sf_dir), {"here": W.Rolling("sum", signed, 48 * 3600)})
    d = W.as_of(d, {"delta": F.when(trade, F.col("here"))}).filter("event_type = 'orderbook'")
    return d.select("instrument_id", "us", F.round(F.coalesce("delta", F.lit(0.0)), 4).alias("delta"))


@query("with " + MEASURED_SQL + " select id as instrument_id, us, round(delta_here, 4) as delta from measured where kind = 'orderbook'")
def asof_signed_delta_strict(spark, sf_dir):
    """Signed volume of the window that ends at each book, not at the trade before it."""
    signed = F.when(D.valid_trade(), S.signed_quantity(F.col("direction"), F.col("quantity")))
    d = W.as_of_window(tape.events(spark, sf_dir), signed, 48 * 3600, "delta").filter("event_type = 'orderbook'")
    return d.select("instrument_id", "us", F.round("delta", 4).alias("delta"))


@query(f"with {MEASURED_SQL}, a as (select id, us, kind, max(case when spread > 150 then us end) over (partition by id order by us, seq) as seen from measured) select id as instrument_id, us, coalesce(seen >= us - {48 * H}, false) as active from a where kind = 'trade'")
def asof_active(spark, sf_dir):
    """Was a wide spread seen in the 48 hours up to each trade?"""
    wide = S.book_metrics(F.col("bids"), F.col("asks"))["spread_bps"] > 150
    d = W.as_of(tape.events(spark, sf_dir), {"at": F.when(wide, F.col("us"))}).filter("event_type = 'trade'")
    return d.select("instrument_id", "us", F.coalesce(F.col("at") >= F.col("us") - 48 * H, F.lit(False)).alias("active"))


@query("with " + TAPE_SQL + " select id as instrument_id, us, case when id::bigint % 10 = 0 then 36 else 48 end * 3600 as trade_window_seconds, case when id::bigint % 10 = 0 then 1.713 else 1.513 end::double as volume_zscore_threshold from tape")
def join_settings(spark, sf_dir):
    ev = tape.events(spark, sf_dir)
    s = tape.table(spark, sf_dir, "events").select("user_id").filter("user_id % 10 = 0").distinct()
    own = s.select(F.col("user_id").cast("string").alias("s_instrument"), *(F.lit(v).alias(k) for k, v in tape.NARROW.as_dict().items()))
    d = D.join_settings(ev, tape.SETTINGS, own)
    return d.select("instrument_id", "us", "trade_window_seconds", "volume_zscore_threshold")
