"""Line de-duplication over the corpus. DataFrame functions only.

Long lines are reduced to two 64-bit hashes of their key and range-partitioned by
hash and salt; within a partition they are sorted by hash, document (largest
first) and position, and streamed: the first row of each document under a hash
counts that document, the first one of all is the document that keeps the line, and
the rest of a line with enough documents is dropped in that same pass. A line that
owns a large part of all rows (found in a sample) is dealt over as many ranges as
there are partitions, by document; its ranges' counts are then added up, and its rows
decided, in a second step over such lines alone. What comes back is one compressed
bitmap per document (64 lines a word, only words that drop anything; no row where
nothing is dropped), never text: callers apply bitmaps where the text already is. Texts
and bitmaps meet by one hash join at every size of the input.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Keys of ``min_chars`` (20) code points found in ``min_docs`` (3) documents lose all
their lines outside of the largest doc_id that holds them. Null or empty text is
one empty line. Null ids count as one document, smaller than any other. Repeated
rows are one document and are treated alike. An empty table gives an empty result.
Documents and lines are told apart by 128 bits of hashes. Columns other than doc_id
and text pass through; names that begin with ``__tw_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import SPACE_CHARS, ascii_lower, frequent, materialize, release, salted

MIN_CHARS, MIN_DOCS = 20, 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys() -> dict[str, Column]:
    """``dk`` and ``tk``, hashes of id and text: which document a line or bitmap is of."""
    return {"__tw_dk": F.xxhash64("doc_id", F.col("doc_id").isNull()), "__tw_tk": F.xxhash64(F.coalesce("text", F.lit("")))}


DOC = ("__tw_dk", "__tw_tk")


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, doc_id, __tw_dk, __tw_tk, pos)`` of every line long enough to matter."""
    listed = docs.select("doc_id", *(c.alias(k) for k, c in _keys().items()), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = listed.withColumn("line", ascii_lower(F.btrim("line", F.lit(SPACE_CHARS)))).filter(F.length("line") >= min_chars)
    return keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc_id", *DOC, "pos")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(__tw_dk, __tw_tk, pos)`` of the lines to drop."""
    lines = materialize(long_lines(docs, min_chars))
    hot = materialize(frequent(lines, "h1", "h2"))
    group = ["h1", "h2", "salt"]
    dealt = salted(lines, hot, ["h1", "h2"], F.col("__tw_dk"), "salt", "split")
    stream = Window.partitionBy(*group).orderBy(F.desc_nulls_last("doc_id"), *DOC, "pos")
    head = F.row_number().over(stream) == 1
    new = head | ~F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id"))
    passed = dealt.repartitionByRange(*group).withColumns({"head": head, "new": new, "keeper": F.first("doc_id").over(stream)})
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    passed = passed.withColumn("n_docs", F.sum(F.col("new").cast("long")).over(whole))
    goes = (F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    found = materialize(passed.filter(F.col("split") | goes).select("h1", "h2", "split", "head", "n_docs", "keeper", "doc_id", *DOC, "pos"))
    release(lines, hot)
    parts = found.filter("split and head").groupBy("h1", "h2").agg(F.sum("n_docs").alias("all_docs"), F.max("keeper").alias("last"))
    # at most a row for each hot line, whose number is bounded
    late = found.filter("split").join(F.broadcast(parts.filter(F.col("all_docs") >= min_docs)), ["h1", "h2"])
    late = late.filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return found.filter("not split").select(*DOC, "pos").unionByName(late.select(*DOC, "pos"))


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(__tw_dk, __tw_tk, __tw_n, __tw_dropped)`` of documents that lose lines: their
    number and, sorted, an array of (word, bits) for words of 64 lines with a bit set for
    each dropped one."""
    gone = dropped_lines(docs, min_chars, min_docs).repartition(*DOC)
    bit = F.expr("shiftleft(1L, pos % 64)")
    by_word = gone.groupBy(*DOC, F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return by_word.groupBy(*DOC).agg(F.sum(F.bit_count("bits")).cast("long").alias("__tw_n"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("__tw_dropped"))


def kept_text(text: Column, dropped: str) -> Column:
    """``text`` without the lines whose bit is set in column ``dropped``; null drops none.
    Words that drop nothing come back as zeros while a row is worked on."""
    dense = F.expr(f"""flatten(zip_with({dropped}, concat(array(named_struct('word', -1, 'bits', 0L)), slice({dropped}, 1, size({dropped}) - 1)),
        (e, p) -> concat(array_repeat(0L, e.word - p.word - 1), array(e.bits))))""")
    words = F.when(F.col(dropped).isNotNull(), dense)
    # the words are made once a row: they travel through the fold beside the lines
    row = F.transform(F.array(F.struct(split_lines(text).alias("lines"), words.alias("words"))), _stay)
    return F.when(F.col(dropped).isNull(), F.coalesce(text, F.lit(""))).otherwise(F.element_at(row, 1))


def _stay(row: Column) -> Column:
    gone = lambda i: F.call_function("getbit", F.coalesce(F.get(row["words"], (i / 64).cast("int")), F.lit(0).cast("long")), i % 64) == 1
    return F.array_join(F.filter(row["lines"], lambda _, i: ~gone(i)), "\n")


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    found = materialize(bitmaps(docs, min_chars, min_docs))
    # bitmaps are a small part of their texts, so a partition's fit where its texts do; a
    # hash join needs no sort of the texts and is the same plan at every size
    return docs.withColumns(_keys()).join(found.hint("shuffle_hash"), list(DOC), "left")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_lines, n_dropped, kept_sha256."""
    joined = _with_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    return joined.select(
        "doc_id",
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("__tw_n", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), "__tw_dropped"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its columns; texts without their dropped lines, and n_chars, where
    there is one, counted anew for them. Texts that lose nothing stay as they are."""
    joined = _with_bitmaps(docs, min_chars, min_docs)
    changed = F.col("__tw_dropped").isNotNull()
    out = joined.withColumn("text", F.when(changed, kept_text(F.col("text"), "__tw_dropped")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE_SQL = r"""
with lines as (
  select doc_id, t.pos, t.line,
         translate(trim(t.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) as t from documents)
), shared as (
  select k, max(doc_id) as keeper from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), marked as (
  select l.doc_id, l.pos, l.line, s.keeper is not null and l.doc_id <> s.keeper as gone from lines l left join shared s on l.k = s.k
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
