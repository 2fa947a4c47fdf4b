"""Sources: events, signals, feed messages, candles, instruments, settings."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import scalars as S
from tapewright.schemas import ENVELOPE, PAYLOAD, QUOTATION, SIGNAL, Settings
from tapewright.sources.store import CSV_PART, read_candles

__all__ = [
    "decode_events", "normalize_events", "normalize_instruments", "quotation_cell", "read_candle_csv", "read_candles", "read_detector_settings", "read_events", "read_instruments",
    "read_raw_messages", "read_setting_blocks", "read_signals", "resolve_blocks", "resolve_settings", "tape", "threshold_blocks", "with_payload",
]

# fixed values: kinds of feed messages; payload kinds in the order in which they are tried
CONTROL = ("subscribe_candles_response", "subscribe_order_book_response", "subscribe_trades_response", "subscribe_info_response", "subscribe_last_price_response", "ping")
KINDS = ("trade", "last_price", "orderbook", "trading_status", "candle")
MESSAGE = ", ".join(f"{k} string" for k in (*KINDS, *CONTROL))


def decode_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON envelopes in ``value`` to columns of the envelope; a payload that came as an
    object is kept as JSON text. What isn't JSON gives a row of nulls."""
    v = F.col(value).cast("string")
    e = raw.select(F.from_json(v, ENVELOPE).alias("e"), F.get_json_object(v, "$.payload").alias("p"))
    return e.select("e.*", "p").withColumn("payload", F.coalesce("p", "payload")).drop("p")


def with_payload(events: DataFrame) -> DataFrame:
    """Envelope rows with the typed payload in ``p``."""
    return events.withColumn("p", F.from_json("payload", PAYLOAD))


def tape(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Typed events to the columns that detectors read."""
    side = lambda c: F.transform(c, lambda x: F.struct(S.quotation_to_double(x["price"]).alias("price"), x["quantity"].alias("quantity")))
    p = F.col("p")
    return with_payload(events).select(
        "instrument_id", F.unix_micros("source_time").alias("us"), F.col(seq).cast("bigint").alias("seq"), "event_type",
        p["quantity"].alias("quantity"), S.quotation_to_double(p["price"]).alias("price"), p["direction"].alias("direction"),
        side(p["bids"]).alias("bids"), side(p["asks"]).alias("asks"), p["trading_status"].alias("trading_status"),
    )


def read_events(spark: SparkSession, path: str | None = None, stream: bool = False, kafka: Mapping[str, str] | None = None) -> DataFrame:
    """Envelopes from a folder of JSON lines, as table or stream, or from Kafka (whose
    connector has to be on the class path) from the latest offset on."""
    reader = spark.readStream if stream else spark.read
    if kafka:
        raw = reader.format("kafka").options(**({"startingOffsets": "latest"} if stream else {}) | dict(kafka)).load()
        return decode_events(raw)
    return decode_events(reader.text(path))


def read_signals(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(SIGNAL).parquet(path)


def read_raw_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Feed messages, JSON lines with one member each; members stay JSON text."""
    return (spark.readStream if stream else spark.read).schema(MESSAGE).json(path)


def normalize_events(messages: DataFrame, received_at=None) -> DataFrame:
    """Drops control messages; the first non-empty member in fixed order gives event_type
    and payload. Ids come from the payload; the event id is a hash of kind and payload."""
    none = lambda c: F.col(c).isNull() | F.col(c).isin("{}", "null", "")
    control = F.lit(False)
    for c in CONTROL:
        control = control | F.col(c).isNotNull()
    kind = F.coalesce(*(F.when(~none(k), F.lit(k)) for k in KINDS))
    payload = F.coalesce(*(F.when(~none(k), F.col(k)) for k in KINDS))
    d = messages.filter(~control).select(kind.alias("event_type"), payload.alias("payload")).filter("event_type is not null")
    at = F.current_timestamp() if received_at is None else received_at
    got = lambda k: F.get_json_object("payload", f"$.{k}")
    return d.select(
        F.sha2(F.concat_ws("|", "event_type", "payload"), 256).alias("event_id"), "event_type", got("instrument_id").alias("instrument_id"), got("figi").alias("figi"),
        F.coalesce(got("instrument_uid"), got("uid")).alias("uid"), S.source_time(got("time"), got("last_trade_ts"), at).alias("source_time"), at.alias("received_at"), "payload",
    )


def quotation_cell(c):
    """Text like {'units': 1, 'nano': 500000000} to a quotation. Cells in just this form, which are
    all that ``write_candle_csv`` writes, need no JSON parser."""
    usual = c.rlike(r"^\{'units': -?(0|[1-9][0-9]{0,17}), 'nano': -?(0|[1-9][0-9]{0,8})\}\z")
    units = F.substring_index(F.substring_index(c, ",", 1), " ", -1).try_cast("bigint")
    nano = F.substring_index(F.substring_index(c, "}", 1), " ", -1).try_cast("int")
    return F.when(usual, F.struct(units.alias("units"), nano.alias("nano"))).otherwise(F.from_json(F.translate(c, "'", '"'), QUOTATION))


def read_candle_csv(spark: SparkSession, path: str, start=None, end=None, partition: str | None = None) -> DataFrame:
    """CSV with a header of time, open, high, low, close, volume and is_complete, in any order and with any others
    beside them, and quotation cells; ``partition`` names the column that the folders under
    ``path`` stand for, if any, or a column of the files that ``write_candle_csv`` wrote. A missing column is an error, and so is a file whose header isn't the first one's."""
    wanted = ("time", "open", "high", "low", "close", "volume", "is_complete")
    found = spark.read.option("header", True).option("escape", '"').csv(path).columns
    folder = CSV_PART if CSV_PART in found else partition
    header = [c for c in found if c != folder]
    missing = [c for c in wanted if c not in header]
    if header and missing:
        raise ValueError(f"the header of {path} lacks {missing}")
    kinds = {"volume": "bigint", "is_complete": "boolean"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header or wanted) + (f", {folder} string" if folder else "")
    d = spark.read.schema(schema).option("escape", '"').option("enforceSchema", False).csv(path, header=True)
    d = d.select(*([partition] if partition else []), *wanted)
    d = d.withColumn("time", S.parse_timestamp(F.col("time"))).withColumns({c: S.quotation_to_decimal(quotation_cell(F.col(c))) for c in ("open", "high", "low", "close")})
    if start is not None:
        d = d.filter(F.col("time") >= start)
    return d if end is None else d.filter(F.col("time") <= end)


def _parse(text: str) -> dict:
    """A YAML document; without a YAML parser, which not every installation has, JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text) or {}
    return yaml.safe_load(text) or {}


def _mapping(x, what: str) -> Mapping:
    if x is None:
        return {}
    if not isinstance(x, Mapping):
        raise ValueError(f"{what} is a mapping, not {x!r}")
    return x


INSTRUMENT = (
    "ticker string, class_code string, alias string, trades boolean, last_price boolean, info boolean, "
    "order_book_depth int, candles boolean, candle_interval string"
)


def normalize_instruments(raw: DataFrame) -> DataFrame:
    """Upper-case ticker and class, lower-case alias (by default the ticker), flags with
    defaults, instrument_id from both names. No depth: no book is subscribed to."""
    ticker, code = F.upper(F.trim("ticker")), F.upper(F.trim("class_code"))
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c)
    return raw.select(
        S.instrument_key(ticker, code).alias("instrument_id"), ticker.alias("ticker"), code.alias("class_code"), F.lower(F.trim(F.coalesce("alias", "ticker"))).alias("alias"),
        flag("trades", True), flag("last_price", True), flag("info", True), "order_book_depth", flag("candles", False), flag("candle_interval", "1m"),
    )


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Instruments of a configuration file, or of a folder of them, each parsed in a task:
    a list ``instruments`` of names with a mapping ``subscriptions`` of flags."""
    flags = [c.split()[0] for c in INSTRUMENT.split(", ")][3:]

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in INSTRUMENT.split(", "))])
        for b in batches:
            rows = []
            for text in b.column("value").to_pylist():
                listed = _mapping(_parse(text), "an instrument file").get("instruments") or []
                if not isinstance(listed, list):
                    raise ValueError("'instruments' is a list")
                for x in listed:
                    subs = _mapping(_mapping(x, "an instrument").get("subscriptions"), "'subscriptions'")
                    names = {k: None if x.get(k) is None else str(x[k]) for k in ("ticker", "class_code", "alias")}
                    rows.append(names | {k: subs.get(k) for k in flags})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return normalize_instruments(spark.read.text(path, wholetext=True).mapInArrow(items, INSTRUMENT))


def resolve_settings(main: Mapping, overrides: Mapping | None = None) -> tuple[Settings, dict[str, Settings]]:
    """The ``detector`` block over the defaults; per instrument, the override file's block
    replaces the main file's whole block, and is laid over the ``detector`` block. Keys
    that aren't settings are ignored, names of instruments are trimmed, empty ones go."""
    default = Settings().laid_over(_mapping(main.get("detector"), "'detector'"))
    blocks = {**_mapping(main.get("per_instrument"), "'per_instrument'"), **_mapping((overrides or {}).get("per_instrument"), "'per_instrument'")}
    named = {str(k).strip(): _mapping(v, f"the block of {k!r}") for k, v in blocks.items()}
    return default, {k: default.laid_over(v) for k, v in named.items() if k}


def read_detector_settings(spark: SparkSession, path: str, overrides_path: str | None = None) -> tuple[Settings, dict[str, Settings]]:
    """Settings files, read by Spark so that any store works."""
    files = [spark.read.text(p, wholetext=True).first() for p in (path, overrides_path) if p]
    return resolve_settings(*(_mapping(_parse(f[0]), "a settings file") if f else {} for f in files))


def read_setting_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of many instruments as JSON lines: instrument_id and any settings, null where
    the block doesn't have them."""
    kinds = {int: "int", float: "double", bool: "boolean"}
    names = ", ".join(f"{k} {kinds[type(v)]}" for k, v in Settings().as_dict().items())
    return spark.read.schema(f"instrument_id string, {names}").json(path)


def resolve_blocks(default: Settings, main: DataFrame, overrides: DataFrame) -> DataFrame:
    """``resolve_settings`` for tables of blocks: a row per instrument, as ``join_settings``
    takes them. Nothing comes to the driver."""
    rest = main.join(overrides.select("instrument_id"), "instrument_id", "left_anti")
    both = overrides.unionByName(rest).withColumn("s_instrument", F.trim("instrument_id")).filter("s_instrument <> ''")
    return both.select("s_instrument", *(F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in default.as_dict().items()))


def threshold_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_threshold_overrides`` wrote, as blocks that ``resolve_blocks`` lays over
    the settings: one setting each, null for all others."""
    own = spark.read.parquet(path).select("instrument_id", F.col("price_move_absolute_threshold_bps").cast("double"))
    kinds = {int: "int", float: "double", bool: "boolean"}
    rest = [F.lit(None).cast(kinds[type(v)]).alias(k) for k, v in Settings().as_dict().items() if k != "price_move_absolute_threshold_bps"]
    return own.select("*", *rest)
