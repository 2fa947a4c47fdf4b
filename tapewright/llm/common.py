"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inside of a character class: ASCII white space, the only white space that separates words here.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes in one Arrow batch sent to a Python worker, so that long texts don't add up.
ARROW_BATCH_BYTES = 4 << 20
#: Rows sampled for each shuffle partition to find the keys that own most rows.
SAMPLED_A_PARTITION = 400


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where
    it is unset the context's checkpoint folder. Only a local session, whose executors
    are the driver, gets a temporary one; a cluster has to name a folder.
    A running session refuses to change the setting itself."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if found:
        return found
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tapewright-"))
    return context.getCheckpointDir()


#: Folders of tables that ``materialize`` wrote, as long as someone holds them.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tapewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, which nothing may read any more."""
    for t in tables:
        path = _WRITTEN.pop(t, None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes instead of by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def frequent(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct ``keys`` that own a large part of ``df``: an eighth of a shuffle
    partition's share or more. At most eight for each partition, so they may be broadcast.
    They are told from a sample and decide only how rows are dealt, never a result."""
    n = partitions(df.sparkSession)
    total = df.count()
    wanted = SAMPLED_A_PARTITION * n
    drawn = df.select(*keys) if total <= wanted else df.select(*keys).sample(wanted / total, seed=5)
    least = max(2, min(total, wanted) // (8 * n))
    return drawn.groupBy(*keys).agg(F.count("*").alias("__tw_rows")).filter(F.col("__tw_rows") >= least).select(*keys)


def salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Column, salt: str, mark: str | None = None) -> DataFrame:
    """``df`` with ``salt``: 0, but for rows of a ``hot`` key one of as many numbers as
    there are shuffle partitions, from a hash of ``by``. ``hot`` is bounded (``frequent``).
    ``mark`` names a column that tells these rows, if one is wanted."""
    found = "__tw_hot"
    joined = df.join(F.broadcast(hot.withColumn(found, F.lit(True))), list(keys), "left").withColumn(found, F.col(found).isNotNull())
    dealt = F.pmod(F.xxhash64(by), F.lit(partitions(df.sparkSession))).cast("int")
    out = joined.withColumn(salt, F.when(F.col(found), dealt).otherwise(F.lit(0)))
    return out.withColumnRenamed(found, mark) if mark else out.drop(found)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """Inner join on ``key`` where ``right`` has one row a key and the bounded table
    ``hot`` names keys that own a large part of ``left``: their rows are dealt over all
    partitions by ``by``, and their row of ``right`` is repeated so often."""
    s, mark = "__tw_salt", "__tw_hot"
    n = partitions(left.sparkSession)
    left = salted(left, hot, [key], F.col(by), s)
    right = right.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    right = right.withColumn(s, F.explode(F.when(F.col(mark), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))).drop(mark)
    return left.join(right, [key, s]).drop(s)
