"""Explicit schemas of events, signals and candles, and detector settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

QUOTATION = "struct<units: bigint, nano: int>"
LEVEL = f"struct<price: {QUOTATION}, quantity: double>"
# fixed values: names of the columns of events and signals, and the types of signals
ENVELOPE = (
    "event_id string, event_type string, instrument_id string, ticker string, class_code string, alias string, "
    "figi string, uid string, source_time timestamp, received_at timestamp, payload string"
)
PAYLOAD = (
    f"quantity double, price {QUOTATION}, direction string, bids array<{LEVEL}>, asks array<{LEVEL}>, trading_status string, "
    f"open {QUOTATION}, high {QUOTATION}, low {QUOTATION}, close {QUOTATION}, volume bigint, interval string, time string, last_trade_ts string"
)
#: What detectors read: time in microseconds, ``seq`` breaks ties, sides of a book best first.
TAPE = (
    "instrument_id string, us bigint, seq bigint, event_type string, quantity double, price double, direction string, "
    "bids array<struct<price: double, quantity: double>>, asks array<struct<price: double, quantity: double>>, trading_status string"
)
SIGNAL = (
    "signal_id string, detected_at timestamp, instrument_id string, ticker string, class_code string, alias string, "
    "source_event_type string, signal_type string, severity int, metric_value double, baseline_value double, "
    "z_score double, window_seconds int, summary string, payload string"
)
CANDLE = (
    "instrument_id string, interval string, time timestamp, open decimal(28,9), high decimal(28,9), low decimal(28,9), "
    "close decimal(28,9), volume bigint, is_complete boolean"
)
SIGNAL_TYPES = (
    "volume_spike",
    "trade_rate_spike",
    "price_jump",
    "spread_widening",
    "orderbook_imbalance",
    "trading_status_changed",
    "microstructure_combo_long",
    "microstructure_combo_short",
)


@dataclass(frozen=True)
class Settings:
    """Detector settings of an instrument; seconds, points and z thresholds."""

    # fixed values: the defaults
    sample_every_seconds: int = 5
    min_baseline_points: int = 12
    baseline_points: int = 120
    trade_window_seconds: int = 60
    price_window_seconds: int = 90
    orderbook_window_seconds: int = 120
    alert_cooldown_seconds: int = 120
    volume_zscore_threshold: float = 4.0
    trade_count_zscore_threshold: float = 4.0
    price_return_zscore_threshold: float = 3.5
    spread_zscore_threshold: float = 3.0
    imbalance_zscore_threshold: float = 3.0
    imbalance_absolute_threshold: float = 0.65
    price_move_absolute_threshold_bps: float = 0.0
    combo_enabled: bool = False
    combo_freshness_seconds: int = 15
    combo_min_score: int = 6
    combo_alert_cooldown_seconds: int = 180
    combo_spread_points: int = 1
    combo_imbalance_points: int = 1
    combo_tick_rate_points: int = 2
    combo_delta_points: int = 2
    combo_imbalance_long_threshold: float = 0.80
    combo_imbalance_short_threshold: float = 0.20
    combo_delta_min_abs_qty: float = 1.0

    def __post_init__(self):
        if self.min_baseline_points < 1 or self.baseline_points < self.min_baseline_points:
            raise ValueError("min_baseline_points is at least 1 and at most baseline_points")

    def with_(self, changes: dict) -> Settings:
        kinds = {f.name: type(f.default) for f in fields(self)}
        unknown = changes.keys() - kinds.keys()
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: kinds[k](v) for k, v in changes.items()})

    def laid_over(self, block: dict) -> Settings:
        """With the values of a configuration block; keys that aren't settings are ignored."""
        return self.with_({k: v for k, v in block.items() if k in self.as_dict()})

    def as_dict(self) -> dict:
        return asdict(self)
