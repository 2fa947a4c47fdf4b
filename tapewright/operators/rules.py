"""Z-score detectors as a table of rules.

A rule says what is measured (a column per event, null where the event takes no part, and
what to make of it over a window), which sampling slot it shares, what a sample or an alert
has to reach besides its score, and its threshold. The batch plan and the stream are both
made from these rows, so a detector of one's own is one more row.

A sample is tested against up to ``baseline_points`` earlier samples of its metric and
joins them afterwards, whatever the outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions import scalars as S
from tapewright.operators.windows import Rolling


@dataclass(frozen=True)
class ZRule:
    signal_type: str
    #: name of the metric; rules may share one
    metric: str
    #: input per event, or a function that makes it
    of: Column | Callable[[], Column]
    #: ``value`` (the input itself), ``sum`` or ``count`` over the window, or ``move``: basis points from the window's first input
    how: str
    #: window in seconds, or the setting that holds it; what signals show
    window: str | int
    #: rules of a slot are sampled together, at most once in ``sample_every_seconds``
    slot: str
    #: score, or the setting that holds it
    threshold: str | float
    #: how signals name the baseline
    label: str
    #: a positive value (or setting) under which a value is no sample at all
    floor: str | float | None = None
    #: value (or setting) under which a sample is remembered but not tested
    least: str | float | None = None

    def __post_init__(self):
        if self.how not in ("value", "sum", "count", "move"):
            raise ValueError(f"unknown way to measure: {self.how!r}")

    def input(self) -> Column:
        return self.of() if callable(self.of) else self.of


def setting(x: str | float | None) -> Column:
    """A setting's column, or a constant."""
    return F.col(x) if isinstance(x, str) else F.lit(x)


def value_of(x: str | float | None, settings) -> float | None:
    return getattr(settings, x) if isinstance(x, str) else x


def is_trade() -> Column:
    return (F.col("event_type") == "trade") & F.col("price").isNotNull() & (F.coalesce("quantity", F.lit(0.0)) > 0)


def is_last_price() -> Column:
    return (F.col("event_type") == "last_price") & (F.col("price") > 0)


def book(field: str) -> Column:
    return F.when(F.col("event_type") == "orderbook", S.book_metrics(F.col("bids"), F.col("asks"))[field])


def market_rules() -> tuple[ZRule, ...]:
    """The five detectors of the market tape."""
    # fixed values: names of signals and settings, and what payloads call the baselines
    quantity = lambda: F.when(is_trade(), F.col("quantity"))
    price = lambda: F.when(is_trade() | is_last_price(), F.col("price"))
    return (
        ZRule("volume_spike", "volume", quantity, "sum", "trade_window_seconds", "trade", "volume_zscore_threshold", "rolling volume"),
        ZRule("trade_rate_spike", "rate", quantity, "count", "trade_window_seconds", "trade", "trade_count_zscore_threshold", "trade count"),
        ZRule("price_jump", "move", price, "move", "price_window_seconds", "price", "price_return_zscore_threshold", "price move", floor="price_move_absolute_threshold_bps"),
        ZRule("spread_widening", "spread", lambda: book("spread_bps"), "value", "orderbook_window_seconds", "book", "spread_zscore_threshold", "spread"),
        ZRule("orderbook_imbalance", "imbalance", lambda: book("imbalance_abs"), "value", "orderbook_window_seconds", "book", "imbalance_zscore_threshold", "imbalance", least="imbalance_absolute_threshold"),
    )


def slots(rules: Sequence[ZRule]) -> dict[str, list[ZRule]]:
    """Rules by slot, in order."""
    out: dict[str, list[ZRule]] = {}
    for r in rules:
        out.setdefault(r.slot, []).append(r)
    return out


def frames(rules: Sequence[ZRule]) -> tuple[str, ...]:
    """Settings that are lengths of windows."""
    return tuple(dict.fromkeys(r.window for r in rules if r.how != "value" and isinstance(r.window, str)))


def windows(rules: Sequence[ZRule], seconds: Callable[[str | int], int]) -> dict[str, Rolling]:
    """What the rules roll up, over the columns ``in_`` and the metric's name."""
    out = {}
    for r in rules:
        value = F.col(f"in_{r.metric}")
        if r.how == "move":
            out[f"from_{r.metric}"] = Rolling("first", value, seconds(r.window))
            out[f"n_{r.metric}"] = Rolling("count", value, seconds(r.window))
        elif r.how != "value":
            out[f"all_{r.metric}"] = Rolling(r.how, value, seconds(r.window))
    return out


def measured(r: ZRule) -> Column:
    """The metric of a row, null where it is no sample."""
    value = F.col(f"in_{r.metric}")
    if r.how == "move":
        out = F.when(F.col(f"n_{r.metric}") >= 2, S.move_bps(value, F.col(f"from_{r.metric}")))
    else:
        out = F.when(value.isNotNull(), (value if r.how == "value" else F.col(f"all_{r.metric}")).cast("double"))
    floor = setting(r.floor)
    return out if r.floor is None else F.when((floor <= 0) | (out >= floor), out)
