"""A candle store that can be written again: data files, coverage and a manifest.

    path/data/write=<id>/interval=<i>/month=<m>/..   files of one write
    path/staged/<id>/..                              a write's candles before they are merged; deleted then
    path/coverage/<id>/..                            ranges that are known, per instrument and interval
    path/manifest/<n>.json                           which folder holds each month, and which coverage holds

A write merges what the months it touches hold with the new candles, writes these months
and the new coverage to folders of its own, and commits by renaming one manifest file into place. Until then
readers see the store as it was; a write that died leaves folders nobody reads, and can be
repeated. Months that a write doesn't touch are not read. The manifest has a row a month and
interval, so it is small whatever the number of instruments and candles.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.schemas import CANDLE

KEY, SLOT = ["instrument_id", "interval"], ["instrument_id", "interval", "time"]
RANGE = "instrument_id string, interval string, start bigint, end bigint"
#: Tasks (and files) that a month of an interval is dealt over.
FILES_A_MONTH = 8
#: Folders that instruments' CSV is dealt over, and what they are named by.
CSV_PARTS, CSV_PART = 256, "tw_part"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def manifest(spark: SparkSession, path: str) -> dict:
    """The latest committed manifest; an empty one for a store that isn't there."""
    fs, where = _fs(spark, f"{path}/manifest")
    if not fs.exists(where):
        return {"version": 0, "parts": {}, "coverage": None}
    versions = [int(n[:-5]) for f in fs.listStatus(where) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
    if not versions:
        return {"version": 0, "parts": {}, "coverage": None}
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{max(versions):08d}.json"))
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, new: dict) -> None:
    fs, _ = _fs(spark, path)
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{name}")
    draft, final = at(f".{uuid.uuid4().hex}"), at(f"{new['version']:08d}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another write committed version {new['version']} of {path}; write again")


def _part(interval: str, month) -> str:
    return f"{interval}|{month}"


def _read(spark: SparkSession, path: str, parts: dict[str, str]) -> DataFrame:
    schema = f"{CANDLE}, write string, month date"
    if not parts:
        return spark.createDataFrame([], schema)
    folders = ["{}/data/write={}/interval={}/month={}".format(path, w, *p.split("|")) for p, w in sorted(parts.items())]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)


def _write_months(rows: DataFrame, path: str) -> None:
    dealt = rows.repartition("interval", "month", F.pmod(F.xxhash64("instrument_id"), F.lit(FILES_A_MONTH)))
    dealt.sortWithinPartitions("interval", "month", "time", "instrument_id").write.partitionBy("interval", "month").parquet(path)


def write_candles(candles: DataFrame, path: str, ranges: DataFrame | None = None) -> None:
    """Add ``candles`` (columns of ``CANDLE``) to the store at ``path``; of candles with equal instrument, interval and
    time the one that the store has stays, so a batch may be written any number of times.
    ``ranges`` (``RANGE``, microseconds) says what the candles cover and joins the coverage."""
    spark = candles.sparkSession
    from tapewright.operators.candles import coalesced

    old, write = manifest(spark, path), uuid.uuid4().hex
    dated = candles.withColumn("month", F.trunc(F.col("time").cast("date"), "month")).filter("interval is not null and month is not null").dropDuplicates(SLOT)
    # the plan of the candles runs once: what it came to is the write itself in an empty store, else it is merged from a folder of its own
    final = f"{path}/data/write={write}"
    staged = f"{path}/staged/{write}" if old["parts"] else final
    _write_months(dated, staged)
    fresh = spark.read.schema(f"{CANDLE}, month date").parquet(staged)
    touched = {_part(r.interval, r.month) for r in fresh.select("interval", "month").distinct().collect()}  # a row a month
    if staged != final and touched:
        stored = _read(spark, path, {p: w for p, w in old["parts"].items() if p in touched}).drop("write")
        if touched & old["parts"].keys():
            fresh = fresh.join(stored.select(*SLOT), SLOT, "left_anti")
        _write_months(stored.unionByName(fresh.select(*stored.columns)), final)
    if staged != final:
        fs, where = _fs(spark, staged)
        fs.delete(where, True)
    cover = old["coverage"]
    if ranges is not None:
        known = coverage(spark, path).unionByName(ranges.select("instrument_id", "interval", "start", "end"))
        coalesced(known.filter("start <= end"), KEY).select("instrument_id", "interval", "start", "end").write.parquet(f"{path}/coverage/{write}")
        cover = write
    _commit(spark, path, {"version": old["version"] + 1, "parts": {**old["parts"], **dict.fromkeys(sorted(touched), write)}, "coverage": cover})


def read_candles(spark: SparkSession, path: str, interval: str | None = None, start=None, end=None) -> DataFrame:
    """Candles of the store, of an interval and within [start, end]. Folders of other
    intervals and months aren't opened; files are sorted by time, so pages out of the range are skipped."""
    first, last = (None if x is None else str(x.date().replace(day=1)) for x in (start, end))
    wanted = {}
    for p, w in manifest(spark, path)["parts"].items():
        own, month = p.split("|")
        if (interval is None or own == interval) and (first is None or month >= first) and (last is None or month <= last):
            wanted[p] = w
    d = _read(spark, path, wanted)
    if interval:
        d = d.filter(F.col("interval") == interval)
    month = lambda x: F.trunc(F.lit(x).cast("date"), "month")
    if start is not None:
        d = d.filter((F.col("time") >= start) & (F.col("month") >= month(start)))
    if end is not None:
        d = d.filter((F.col("time") <= end) & (F.col("month") <= month(end)))
    return d.drop("month", "write")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """What is known: ranges per instrument and interval, as they were committed."""
    folder = manifest(spark, path)["coverage"]
    return spark.read.schema(RANGE).parquet(f"{path}/coverage/{folder}") if folder else spark.createDataFrame([], RANGE)


def write_candle_csv(candles: DataFrame, path: str) -> None:
    """CSV with the cells that ``read_candle_csv`` reads, instruments dealt over ``CSV_PARTS`` folders by a hash, so
    that the number of files doesn't follow that of instruments. A new call replaces the instruments it names and
    leaves the others; folders that none of them is in aren't touched. Ids are cells, so they hold no line breaks."""
    from tapewright.functions.scalars import decimal_to_quotation

    spark = candles.sparkSession
    cell = lambda c: F.concat(F.lit("{'units': "), c["units"], F.lit(", 'nano': "), c["nano"], F.lit("}"))
    prices = {c: cell(decimal_to_quotation(F.col(c))) for c in ("open", "high", "low", "close")}
    rows = candles.withColumns({"time": F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), **prices}).select("instrument_id", "time", *prices, F.col("volume").cast("string"), F.col("is_complete").cast("string"))
    rows = rows.withColumn(CSV_PART, F.pmod(F.xxhash64("instrument_id"), F.lit(CSV_PARTS)).cast("int"))
    fs, where = _fs(spark, path)
    if fs.exists(where) and any(x.isDirectory() for x in fs.listStatus(where)):
        if not any(x.getPath().getName().startswith(f"{CSV_PART}=") for x in fs.listStatus(where)):
            raise ValueError(f"{path} has a folder an instrument, which can be read but not written to")
        named = rows.select("instrument_id", CSV_PART).distinct()
        known = spark.read.schema(", ".join(f"{c} string" for c in rows.columns[:-1]) + f", {CSV_PART} int").option("escape", '"').csv(path, header=True)
        kept = known.join(named.select(CSV_PART).distinct(), CSV_PART, "left_semi")
        same = [kept["instrument_id"].eqNullSafe(named["instrument_id"]), kept[CSV_PART] == named[CSV_PART]]
        rows = rows.unionByName(kept.join(named, same, "left_anti"))
    sorted_ = rows.repartition(CSV_PART).sortWithinPartitions(CSV_PART, "instrument_id", "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(CSV_PART)
    sorted_.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
