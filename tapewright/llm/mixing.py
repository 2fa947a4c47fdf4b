"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws a key: an exponential variate divided by its quality weight,
from a hash of its id, so reruns agree. A source whose target is over its size
first gives whole epochs, every document once each; what is left of the target is
filled with documents in the order of their keys, whose sizes are prefix-summed
up to the budget. A document is in if its middle lies within the budget, so a
source misses its target by half of the last document at most.

The prefix sum is spread: keys map monotonically into buckets, buckets into blocks;
blocks are summed first, then buckets within a block, and only rows of one bucket are
sorted together. A source with most of the rows is dealt over as many buckets as it
needs. Rows are ordered by the key itself; the map, of key times the source's mean
weight, only says where a row is summed.

Null text has size 0, a null source is a source of its own, last in order. Null
ids and repeated rows draw by id and text; equal rows (same id, text and source) share a key,
the budget may end between them, and the mix repeats them as often in all as they were
taken together. Null, negative or NaN quality counts as 0 and the weight never falls
under 0.01. An empty table gives an empty result. Whole texts are counted, however long;
columns other than doc_id, source and text pass through ``sample_documents``, names that
begin with ``__tw_`` are the operator's own. One summary row per source is
ranked in one task; it joins the documents by size-checked broadcast or shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tapewright.llm.common import SPACE_CHARS, materialize, word_count

WEIGHTS = (5, 2, 1)
#: No target is over so many times the size of its source.
MOST_EPOCHS = 3
ROWS_A_BUCKET, BUCKETS_A_BLOCK = 500, 512


def text_quality(text: Column) -> Column:
    """A document's quality weight between 0.5 and 1.5, from the share of characters
    that are letters, digits or marks rather than the symbols of markup and code."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(text, "#*$%&|<>{}[]\\~^_=+" + SPACE_CHARS, ""))
    return 0.5 + F.coalesce(plain / F.nullif(F.length(F.translate(text, SPACE_CHARS, "")), F.lit(0)), F.lit(0.0))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS, share: float = 1.0) -> DataFrame:
    """``sizes(source, source_size, ..)`` with ``target``: ``share`` of all words by weight,
    sources in code point order taking the weights in turn, null last; what lies
    over ``most_epochs`` sizes goes to the others by weight until none is above.

    Raising a common level fills sources in the order of cap over weight, so the
    result is min(cap, weight * level) with the level found by prefix sums."""
    if not weights or min(weights) <= 0 or not 0 <= share <= most_epochs:
        raise ValueError("weights are positive and share is between 0 and most_epochs")
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.array(*(F.lit(float(x)) for x in weights))
    ranked = sizes.withColumn("w", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most_epochs))
    ranked = ranked.withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    below = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(rest)
    # the first source, in this order, whose cap the level doesn't reach sets it for itself and all after it
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("w") * F.col("level"))
    first = leveled.withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * F.col("final")))
    return first.select(*sizes.columns, target.alias("target"))


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most_epochs: int = MOST_EPOCHS, share: float = 1.0, seed: int = 11) -> DataFrame:
    """``rows(doc_id, source, size, quality, tie)`` with source_size, target, ``times``
    (how often the mix takes the document) and ``taken`` (words so taken)."""
    weight = F.greatest(F.coalesce(F.nanvl(F.col("quality"), F.lit(0.0)), F.lit(0.0)), F.lit(0.01))
    # 52 bits of a digest: a draw that any engine can repeat
    digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie").cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = materialize(rows.withColumns({"weight": weight, "key": -F.log(u) / weight}))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("weight").alias("mean"))
    goals = materialize(targets(sizes, weights, most_epochs, share))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    goals = goals.withColumn("left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    goals = goals.withColumn("buckets", F.ceil(F.col("n") / ROWS_A_BUCKET))
    goals = goals.select(F.col("source").alias("s"), "source_size", "target", "mean", "epochs", "left", "buckets")
    placed = rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # of equal weights this is 1 - exp(-key), nearly uniform over its range; of any others it is monotone still
    spread = F.greatest(1 - 1 / (1 + F.col("key") * F.col("mean")), F.lit(0.0))
    placed = placed.withColumn("bucket", F.least(F.floor(spread * F.col("buckets")), F.col("buckets") - 1))
    sums = materialize(placed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))).withColumn("block", F.floor(F.col("bucket") / BUCKETS_A_BLOCK))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = sums.groupBy("source", "block").agg(F.sum("in_bucket").alias("in_block"))
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), so_far("in_block", before("source", "block")).alias("block_start"))
    within_block = so_far("in_bucket", before("source", "block", "bucket"))
    starts = sums.withColumn("within", within_block).join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    starts = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("block_start") + F.col("within")).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    middle = F.col("start") + F.sum("size").over(within) - F.col("size") / 2
    extra = ((F.col("left") > 0) & (middle <= F.col("left"))).cast("long")
    placed = placed.withColumn("times", F.col("epochs") + extra)
    return placed.withColumn("taken", F.col("times") * F.col("size")).drop("key", "weight", "mean", "epochs", "left", "buckets", "bucket", "start")


def measured(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        text_quality(F.col("text")).alias("quality"),
        _tie().alias("tie"),
    )


def _tie() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, source, times."""
    return mix(measured(docs), **how).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def sample_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of
    ``docs``. Rows equal in id, text and source share what they were taken together, the first ones, by
    a hash of their other columns, more."""
    key = ["__tw_dk", "__tw_tie", "__tw_src"]
    own = {"__tw_dk": F.xxhash64("doc_id", F.col("doc_id").isNull()), "__tw_src": F.md5(F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))).cast("binary"))}
    took = mix(measured(docs), **how).withColumns(own)
    took = took.groupBy("__tw_dk", F.col("tie").alias("__tw_tie"), "__tw_src").agg(F.sum("times").alias("__tw_n"), F.count("*").alias("__tw_rows")).filter("__tw_n > 0")
    keyed = docs.withColumns({**own, "__tw_tie": _tie()})
    out = keyed.join(took.hint("merge"), key)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source") and not isinstance(docs.schema[c].dataType, MapType)]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(0), *rest)))
    copies = F.expr("__tw_n div __tw_rows") + (F.col("__tw_nth") <= F.col("__tw_n") % F.col("__tw_rows")).cast("long")
    out = out.withColumn("__tw_nth", nth).withColumn("__tw_copies", copies).filter("__tw_copies > 0")
    return out.withColumn("__tw_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tw_copies")))).select(*docs.columns)


ORACLE_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), q as (
  select doc_id, source, size, md5(t) as tie, length(translate(t, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) as solid,
         length(translate(t, '#*$%&|<>{}[]\~^_=+' || chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) as plain from d
), k as (
  select doc_id, source, size, tie,
         -ln((('0x' || left(md5('11|' || coalesce(doc_id::varchar, '') || '|' || tie), 13))::bigint::double + 0.5) / 4503599627370496.0)
           / greatest(0.5 + coalesce(plain / nullif(solid, 0)::double, 0.0), 0.01) as key from q
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double as w from s
), r as (
  -- the level at which targets of the sources from here on, by cap over weight, use up what those before leave
  select *, row_number() over f as nth, (sum(source_size) over () - coalesce(sum(3 * source_size) over (f rows between unbounded preceding and 1 preceding), 0))::double
            / sum(w) over (f rows between current row and unbounded following) as level
  from w window f as (order by 3 * source_size / w, source is null, encode(source))
), o as (
  select min(nth) as nth, arg_min(level, nth) as level from r where 3 * source_size > w * level
), g as (
  select source, source_size, case when o.nth is null or r.nth < o.nth then 3.0 * source_size else least(3.0 * source_size, w * o.level) end::double as target from r, o
), e as (
  select *, case when source_size > 0 then floor(target / source_size + 1e-12) else 0 end::bigint as epochs from g
), x as (
  select k.*, source_size, target, epochs, greatest(target - epochs * source_size, 0) as rest,
         sum(size) over (partition by k.source order by key, doc_id nulls first, tie rows unbounded preceding) - size / 2.0 as middle
  from k join e on k.source is not distinct from e.source
), y as (
  select *, epochs + (rest > 0 and middle <= rest)::bigint as times from x
)
select doc_id, size, source_size, target, times * size as taken, source, times from y
"""
