"""The detectors as one acyclic batch plan, made from the table of rules (``rules.py``).

    events -> window columns -> gates, one per slot -> samples -> gate of the combo ->
    baselines over samples -> z-scores -> as-of columns for the combo -> candidate
    signals -> cooldown gates -> signals

Events are taken in order of (us, seq). Up to the samples no step needs all events of an
instrument in one task: windows work by instrument and bucket of time with a halo, gates by
blocks of time that are composed. Samples and candidates are bounded by time (one
in ``sample_every_seconds`` a slot, and a row a bucket) however many events there are, so what follows
works by instrument. Status changes are a plan of their own over status events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import scalars as S
from tapewright.operators import rules as R
from tapewright.operators import windows as W
from tapewright.operators.gates import Gate, greedy_gate
from tapewright.schemas import SIGNAL_TYPES, Settings

TRADE, PRICE, BOOK, STATUS = ("trade",), ("trade", "last_price"), ("orderbook",), ("trading_status",)
#: Length of a gate's block in sampling intervals: how many samples a block yields at most.
SAMPLES_A_BLOCK = 512
CHANGED, COMBO = "trading_status_changed", "microstructure_combo_"
#: Signals that the combined score looks at.
PARTS = ("spread_widening", "trade_rate_spike", "orderbook_imbalance")


def settings_frame(spark, default: Settings, overrides: Mapping[str, Settings]) -> DataFrame:
    """A row per override, and one with a null instrument for everything else."""
    rows = [{"s_instrument": k, **v.as_dict()} for k, v in [(None, default), *overrides.items()]]
    kinds = {int: "int", float: "double", bool: "boolean"}
    schema = "s_instrument string, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in default.as_dict().items())
    return spark.createDataFrame(rows, schema)


def join_settings(events: DataFrame, default: Settings, overrides: Mapping[str, Settings] | DataFrame | None = None) -> DataFrame:
    """Events with their instrument's settings as columns. Overrides are configuration,
    or a table with ``s_instrument`` (unique) and all settings as columns; Spark
    broadcasts it if it is small."""
    names = list(default.as_dict())
    if isinstance(overrides, DataFrame):
        table = overrides.filter("s_instrument is not null")
    elif not overrides:
        return events.select("*", *(F.lit(v).alias(k) for k, v in default.as_dict().items()))
    else:
        table = settings_frame(events.sparkSession, default, overrides).filter("s_instrument is not null")
    joined = events.join(table, F.col("instrument_id") == F.col("s_instrument"), "left")
    filled = [F.when(F.col("s_instrument").isNull(), F.lit(getattr(default, k))).otherwise(F.col(k)).alias(k) for k in names]
    return joined.select(*events.columns, *filled)


def route(events: DataFrame, kinds: Sequence[str] = (*PRICE, *BOOK, *STATUS)) -> DataFrame:
    """Events of kinds that a detector reads; candles and unknown kinds go."""
    return events.filter(F.col("event_type").isin(*kinds))


valid_trade, valid_last_price = R.is_trade, R.is_last_price


def valid_status() -> Column:
    return (F.col("event_type") == "trading_status") & (F.trim("trading_status") != "")


def _measure(events: DataFrame, rules: Sequence[R.ZRule], combo: bool, lengths: Mapping[str, int]) -> DataFrame:
    """Metrics of one group of instruments that share the frames' lengths."""
    seconds = lambda x: lengths.get(x, x)
    d = events.withColumns({f"in_{r.metric}": r.input() for r in rules})
    rolled = R.windows(rules, seconds)
    if combo:
        trade = F.coalesce(valid_trade(), F.lit(False))
        d = d.withColumns({"is_trade": trade, "in_delta": F.when(trade, S.signed_quantity(F.col("direction"), F.col("quantity"))), "bid_share": R.book("bid_share")})
        # signed volume as of the latest trade, also when it is read at a book; lots often meet their bound exactly
        rolled["delta_here"] = W.Rolling("sum", F.col("in_delta"), seconds("trade_window_seconds"), plain=True)
    taking = F.col("is_trade") if combo else F.lit(False)
    for r in rules:
        taking = taking | F.col(f"in_{r.metric}").isNotNull()
    d = d.filter(taking)
    if combo:
        d = W.rolling(d, rolled, {"delta": F.when(F.col("is_trade"), F.col("delta_here"))})
    elif rolled:
        d = W.rolling(d, rolled)
    d = d.withColumns({r.metric: R.measured(r) for r in rules})
    on = {}
    for slot, members in R.slots(rules).items():
        some = F.lit(False)
        for r in members:
            some = some | F.col(r.metric).isNotNull()
        on[f"on_{slot}"] = some
    return d.withColumns({**on, "gate_us": F.col("sample_every_seconds").cast("bigint") * S.SECOND})


def _by_frames(events: DataFrame, default: Settings, overrides: Mapping[str, Settings] | DataFrame, names: Sequence[str], work) -> DataFrame:
    """Frame bounds are literals: instruments that share them are worked on together."""
    if isinstance(overrides, DataFrame):  # whose bounds are the default's, ``_framed`` sees to it
        return work(events, *(getattr(default, n) for n in names))
    groups: dict[tuple, list[str]] = {}
    for k, s in overrides.items():
        groups.setdefault(tuple(getattr(s, n) for n in names), []).append(k)
    usual = tuple(getattr(default, n) for n in names)
    special = [(key, ids) for key, ids in groups.items() if key != usual]
    if not special:
        return work(events, *usual)
    same = lambda key: [F.col(n) == F.lit(v) for n, v in zip(names, key)]
    out = None
    for key in dict.fromkeys([usual, *(k for k, _ in special)]):
        condition = F.lit(True)
        for c in same(key):
            condition = condition & c
        part = work(events.filter(condition), *key)
        out = part if out is None else out.unionByName(part)
    return out


def _framed(overrides: DataFrame, default: Settings, names: Sequence[str]) -> DataFrame:
    """A table of overrides, which fails where it changes the length of a window or baseline: these
    are literals of the plan."""
    same = {n: F.when(F.col(n) == getattr(default, n), F.col(n)).otherwise(F.raise_error(F.lit(f"a table of overrides can't change {n}"))) for n in names}
    return overrides.withColumns(same)


def _row(kind: str, on: Column, severity: Column, metric: Column, base: Column, z: Column, window: Column, cooldown: Column, detail: Mapping[str, Column], note: Column | None = None) -> Column:
    return F.when(on, F.struct(
        F.lit(kind).alias("signal_type"), severity.cast("int").alias("severity"), metric.cast("double").alias("metric_value"), base.cast("double").alias("baseline_value"),
        z.cast("double").alias("z_score"), window.cast("int").alias("window_seconds"), (cooldown.cast("bigint") * S.SECOND).alias("cooldown_us"),
        (F.lit(None) if note is None else note).cast("string").alias("note"), F.to_json(F.struct(*(c.alias(k) for k, c in detail.items()))).alias("detail"),
    ))


def _listed(d: DataFrame, rows: Sequence[Column]) -> DataFrame:
    listed = d.select("instrument_id", "us", "seq", F.col("event_type").alias("source_event_type"), F.explode(F.array_compact(F.array(*rows))).alias("s"))
    return listed.select("instrument_id", "us", "seq", "source_event_type", "s.*")


def status_changes(events: DataFrame, default: Settings, overrides: Mapping[str, Settings] | DataFrame) -> DataFrame:
    """Candidates of status events whose status isn't the one before."""
    valid = events.filter(valid_status()).withColumn("now", F.trim("trading_status"))
    d = W.as_of(valid, {"before": F.col("now")}, earlier=True).filter("before is not null and now <> before")
    d = join_settings(d, default, overrides)
    note = F.concat(F.lit(" trading status changed from "), F.col("before"), F.lit(" to "), F.col("now"), F.lit("."))
    detail = {"previous_status": F.col("before"), "current_status": F.col("now")}
    zero = F.lit(0.0)
    return _listed(d, [_row(CHANGED, F.lit(True), F.lit(2), F.lit(1.0), zero, zero, F.lit(0), F.col("alert_cooldown_seconds"), detail, note)])


def _combos(d: DataFrame, fired: Mapping[str, Column], only: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """Samples with what the combined score reads as of them, and its rows."""
    fresh = F.col("us") - F.col("combo_freshness_seconds").cast("bigint") * S.SECOND
    d = d.withColumns({f"{k}_on": F.coalesce(W.latest(F.col("us"), fired[k]) >= fresh, F.lit(False)) for k in PARTS})
    d = d.withColumns({"share": W.latest(F.col("bid_share"), F.col("g_book")), "delta": F.coalesce(W.latest(F.col("delta")), F.lit(0.0))})
    points = lambda on, c: F.when(on, F.col(c)).otherwise(0)
    both = points(F.col("spread_widening_on"), "combo_spread_points") + points(F.col("trade_rate_spike_on"), "combo_tick_rate_points")
    least, lean = F.col("combo_delta_min_abs_qty"), F.col("orderbook_imbalance_on")
    scores = {
        "long": both + points(lean & (F.col("share") >= F.col("combo_imbalance_long_threshold")), "combo_imbalance_points") + points(F.col("delta") >= least, "combo_delta_points"),
        "short": both + points(lean & (F.col("share") <= F.col("combo_imbalance_short_threshold")), "combo_imbalance_points") + points(F.col("delta") <= -least, "combo_delta_points"),
    }
    shown = lambda c: F.when(F.col(c), "True").otherwise("False")
    rows = []
    for side, score in scores.items():
        share = F.when(F.col("share").isNull(), "n/a").otherwise(F.format_string("%.2f", "share"))
        note = F.format_string(f" combo-{side} score=%d (spread=%s, imbalance=%s tick_rate=%s, delta=%.2f).", score, shown("spread_widening_on"), share, shown("trade_rate_spike_on"), F.col("delta"))
        detail = {
            "score": score, "min_score": F.col("combo_min_score"), "spread_active": F.col("spread_widening_on"), "tick_rate_active": F.col("trade_rate_spike_on"),
            "imbalance_ratio": F.col("share"), "signed_delta_qty": F.col("delta"),
        }
        high = F.when(score >= F.col("combo_min_score") + 2, 3).otherwise(2)
        if COMBO + side in only:
            on = F.col("g_combo") & (score >= F.col("combo_min_score"))
            rows.append(_row(COMBO + side, on, high, score, F.col("combo_min_score"), F.lit(0.0), F.col("combo_freshness_seconds"), F.col("combo_alert_cooldown_seconds"), detail, note))
    return d, rows


def candidates(events: DataFrame, default: Settings, overrides: Mapping[str, Settings] | DataFrame | None = None, only: Sequence[str] | None = None, rules: Sequence[R.ZRule] | None = None, hot: bool = True) -> DataFrame:
    """Signals before their cooldown: instrument_id, us, seq, source_event_type,
    signal_type, severity, metric_value, baseline_value, z_score, window_seconds,
    cooldown_us, note and detail, which texts and payloads are made of. ``rules`` are the market's
    and any others; ``only`` picks types of signals. ``overrides`` are settings by instrument, or a table
    of them (``resolve_blocks``). ``hot``: instruments may hold more events
    than fit a task, so gates are cut into blocks."""
    table = isinstance(overrides, DataFrame)
    overrides, rules = overrides if table else dict(overrides or {}), R.market_rules() if rules is None else tuple(rules)
    only = [*(r.signal_type for r in rules), *SIGNAL_TYPES[5:]] if only is None else list(only)
    unknown = {*only} - {r.signal_type for r in rules} - {*SIGNAL_TYPES[5:]}
    if unknown:
        raise ValueError(f"no rule makes {sorted(unknown)}")
    combo = any(x.startswith(COMBO) for x in only)
    needed = {*only, *(PARTS if combo else ())}
    rules = [r for r in rules if r.signal_type in needed]
    if combo and {*PARTS} - {r.signal_type for r in rules}:
        raise ValueError(f"the combined score needs rules for {PARTS}")
    changes = [status_changes(events, default, overrides)] if CHANGED in only else []
    if not rules:
        return changes[0]

    names = tuple(dict.fromkeys([*R.frames(rules), *(["trade_window_seconds"] if combo else [])]))
    if table:
        overrides = _framed(overrides, default, [*names, "baseline_points"])
    set_ = join_settings(events, default, overrides)
    d = _by_frames(set_, default, overrides, names, lambda part, *key: _measure(part, rules, combo, dict(zip(names, key))))
    slots, metrics = R.slots(rules), dict.fromkeys(r.metric for r in rules)
    extra = ["bid_share", "delta", "__closing"] if combo else []
    own = table or bool(overrides)
    settings = list(default.as_dict()) if own else ["combo_enabled"] if combo else []
    any_on = " or ".join(f"on_{s}" for s in slots)
    d = d.select("instrument_id", "us", "seq", "event_type", *metrics, *(f"on_{s}" for s in slots), "gate_us", *extra, *settings)
    d = d.filter(f"{any_on} or (__closing and delta is not null)" if combo else any_on)
    block_us = max(1, default.sample_every_seconds) * SAMPLES_A_BLOCK * S.SECOND if hot else None
    d = greedy_gate(d, ["instrument_id"], ["us", "seq"], [Gate(f"g_{s}", "gate_us", f"on_{s}") for s in slots], block_us)
    sampled = " or ".join(f"g_{s}" for s in slots)
    d = d.filter(f"{sampled} or __closing" if combo else sampled)
    if combo:  # samples are few: a key is one task
        d = greedy_gate(d.withColumn("opens", (F.col("g_trade") | F.col("g_book")) & F.col("combo_enabled")), ["instrument_id"], ["us", "seq"], [Gate("g_combo", "gate_us", "opens")])
    if not own:  # settings are literals, which needn't go through the gates
        d = d.withColumns({k: F.lit(v) for k, v in default.as_dict().items()})

    def score(d: DataFrame, points: int) -> DataFrame:
        for r in rules:
            sample = F.col(f"g_{r.slot}") & F.col(r.metric).isNotNull()
            d = d.withColumn(f"{r.metric}_b", W.baseline(F.col(r.metric), points, "instrument_id", sample))
            d = d.withColumn(f"{r.metric}_z", F.when(sample & (F.col(f"{r.metric}_b.n") >= F.col("min_baseline_points")), S.z_score(F.col(r.metric), F.col(f"{r.metric}_b.mean"), F.col(f"{r.metric}_b.std"))))
        return d

    d = _by_frames(d, default, overrides, ("baseline_points",), score)
    fired, rows = {}, []
    for r in rules:
        z, also = F.col(f"{r.metric}_z"), F.lit(True) if r.least is None else F.col(r.metric) >= R.setting(r.least)
        fired[r.signal_type] = F.coalesce((z >= R.setting(r.threshold)) & also, F.lit(False))
        if r.signal_type in only:
            detail = {"baseline_label": F.lit(r.label)}
            rows.append(_row(r.signal_type, fired[r.signal_type], S.severity(z), F.col(r.metric), F.col(f"{r.metric}_b.mean"), z, R.setting(r.window), F.col("alert_cooldown_seconds"), detail))
    if combo:
        d, more = _combos(d, fired, only)
        rows += more
    out = _listed(d, rows)
    return out.unionByName(changes[0]) if changes else out


def detect(events: DataFrame, default: Settings = Settings(), overrides: Mapping[str, Settings] | DataFrame | None = None, only: Sequence[str] | None = None, rules: Sequence[R.ZRule] | None = None, hot: bool = True) -> DataFrame:
    """Signals of an event table with the columns of ``schemas.TAPE``: candidates that
    pass their cooldown. Rows with null instrument or time are left out."""
    found = candidates(events.filter("instrument_id is not null and us is not null"), default, overrides, only, rules, hot)
    ready = greedy_gate(found.withColumn("candidate", F.lit(True)), ["instrument_id", "signal_type"], ["us", "seq"], [Gate("ready", "cooldown_us", "candidate")])
    return ready.filter("ready").drop("candidate", "ready", "cooldown_us")


def zscore_detector(
    events: DataFrame, metric: Column, threshold: str | float, gate_key: str, default: Settings = Settings(), overrides: Mapping[str, Settings] | DataFrame | None = None, *,
    signal_type: str = "zscore", how: str = "value", window: str | int = 0, label: str = "metric", least: str | float | None = None, floor: str | float | None = None,
) -> DataFrame:
    """Signals of a metric of one's own: ``metric`` is any column over an event, null where the event
    takes no part; ``gate_key`` names its sampling slot. The other arguments are those of a rule."""
    rule = R.ZRule(signal_type, "metric", metric, how, window, gate_key, threshold, label, floor, least)
    return detect(events, default, overrides, rules=[rule], only=[signal_type])


def signals(found: DataFrame, names: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """``detect`` output as rows of ``schemas.SIGNAL``; ``names(instrument_id, ticker,
    class_code, alias)`` is optional. The id is a hash, so redelivery makes no duplicates.
    The payload says what the signal was measured by and, given the tape's ``events``,
    holds the event itself as ``event_payload``."""
    d = found if names is None else found.join(names, "instrument_id", "left")
    d = d.withColumns({c: F.lit(None).cast("string") for c in ("ticker", "class_code", "alias") if names is None})
    payload = F.col("detail")
    if events is not None:
        own = F.to_json(F.struct("quantity", "price", "direction", "bids", "asks", "trading_status")).alias("__event")
        d = d.join(events.select("instrument_id", "us", "seq", own), ["instrument_id", "us", "seq"], "left")
        within = F.concat(F.expr("left(detail, length(detail) - 1)"), F.lit(',"event_payload":'), F.col("__event"), F.lit("}"))
        payload = F.when(F.col("signal_type").startswith("microstructure") | F.col("__event").isNull(), payload).otherwise(within)
    ticker = F.coalesce("ticker", "instrument_id")
    text = F.coalesce(F.concat(ticker, F.col("note")), S.summary_text(F.col("signal_type"), ticker, F.col("metric_value"), F.col("baseline_value"), F.col("z_score"), F.col("window_seconds")))
    return d.select(
        F.sha2(F.concat_ws("|", "instrument_id", "signal_type", "us", "seq"), 256).alias("signal_id"),
        F.timestamp_micros("us").alias("detected_at"),
        "instrument_id", "ticker", "class_code", "alias", "source_event_type", "signal_type", "severity", "metric_value", "baseline_value", "z_score", "window_seconds",
        text.alias("summary"),
        payload.alias("payload"),
    )
