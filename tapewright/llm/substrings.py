"""Removing passages that repeat, by FM-indexes of shards.

A window is a run of ``window`` words. Windows that start twice or more in the corpus
lose all their words. The order of work:

1. Each window chooses the smallest hash (its high 40 bits) of its grams of ``gram`` words, the leftmost at ties. Equal windows
   choose equal grams, so a window whose gram is chosen at one place only is unique. Spark counts
   chosen grams, (block, gram) rows, and joins the repeated ones back to blocks of documents.
2. Windows that chose the same place of a document form a segment (its words as 64-bit
   hashes), keyed by the gram. Segments of repeated grams are counted by name, an MD5 of
   their words. A segment that stands twice repeats as a whole; words are shipped only for keys of several
   segments, each segment once.
3. Keys are dealt; a shard is a row of whole keys up to about ``SHARD_WORDS`` words. Each shard gets an
   FM-index: suffix array, Burrows-Wheeler transform, and a wavelet tree of bit-packed
   levels with rank directories, which is all that is kept. Segments are streamed
   through it: backward search from an end position goes left as long as two places
   match, which gives the matching statistic there. Matches of a window or more are the intervals
   reported; the next search starts where the first undecided window ends.
4. A key of more than ``CROWDED`` segments (one passage in as many contexts) would be one
   task's work. Its segments are cut into their windows, which are counted by name instead.
5. Intervals go back to the blocks whose documents hold the segments.

Nothing is compared pair by pair, and no index, gram table or segment table is broadcast or collected.
Words are told apart by 64-bit XXH3 hashes, segments by MD5 of these.

Null and empty texts have no words. Texts under a window lose nothing. A text that repeats within
itself loses that, too; so do repeated rows, which are documents of their own. Words of a window are removed
wherever it stands, first place included. Long texts are worked on whole. An empty table gives an empty
result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import frequent, materialize, partitions, release, small_batches, spread_join

WINDOW, GRAM = 35, 16
BLOCK_CHARS, SHARD_WORDS = 16 << 20, 1 << 18
#: Segments of a key from which they are worked on by window. Decides how rows are dealt, never a result.
CROWDED = 256
#: Low bits of a gram's rank that hold its place; the high ones are its hash's.
_PLACE = np.uint64((1 << 24) - 1)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_PIECES = "kind int, block int, doc_id long, n_words long, kept_sha256 string, text string, key long, segment binary, words binary, n long"


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of these columns; the schema's others are null."""
    n = len(next(iter(columns.values())))
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[t]) if c in columns else pa.nulls(n, _KINDS[t]) for c, t in names], [c for c, _ in names])


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode().split() if text else []


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, put together from runs of powers of two."""
    out, size, piece, width = None, 0, h, 1

    def after(x: np.ndarray, n_x: int, y: np.ndarray) -> np.ndarray:
        y = y[n_x:]
        x = x[: len(y)]
        z = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + y[: len(x)] * np.uint64(0x9E3779B97F4A7C15)
        return z ^ (z >> np.uint64(32))

    while n:
        if n & 1:
            out, size = (piece, width) if out is None else (after(out, size, piece), size + width)
        n >>= 1
        if n:
            piece, width = after(piece, width, piece), 2 * width
    return out


def chosen(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the place of the gram it chooses."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x, width = rolled(h, gram), window - gram + 1
    if len(x) > int(_PLACE):
        wide = np.lib.stride_tricks.sliding_window_view(x >> np.uint64(24), width)
        return x, np.arange(len(wide)) + wide.argmin(axis=1)
    least, k = x & ~_PLACE | np.arange(len(x), dtype=np.uint64), 1
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    return x, (least & _PLACE).astype(np.int64)


def segments(x: np.ndarray, place: np.ndarray, wanted: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """``(gram, start, end)`` of a document's segments whose gram is in the sorted ``wanted``."""
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    if not len(cuts) or not len(wanted):
        return []
    ends, grams = np.append(cuts[1:], len(place)), x[place[cuts]]
    at = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
    found = np.flatnonzero(wanted[at] == grams)
    return list(zip(grams[found].astype(np.int64).tolist(), cuts[found].tolist(), (ends[found] - 1 + window).tolist()))


def _name(raw: bytes) -> bytes:
    return hashlib.md5(raw, usedforsecurity=False).digest()


class WaveletTree:
    """Levels of packed bits, most significant bit of the symbols first; each level holds the symbols of the
    one above, zeros before ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        s = symbols
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            ones = (s >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            upto = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)])
            self.levels.append((bit, packed, upto, len(s) - int(ones.sum())))
            s = np.concatenate([s[~ones], s[ones]])
        every = np.arange(n_symbols)
        self.first = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, upto, zeros in self.levels:
            word = at >> 6
            ones = upto[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        return self._walk(symbol, at) - self.first[symbol]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s``, by doubling; a suffix that ends is the smaller one."""
    n = len(s)
    rank, k = s.astype(np.int64), 1
    while True:
        key = (rank + 1) * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(sorted_, prepend=sorted_[:1]) != 0)
        if rank.max() == n - 1 or k >= n:
            return order
        k *= 2


class FmIndex:
    """Backward search over texts of numbers."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts])
        names, flat = np.unique(np.concatenate(texts), return_inverse=True)
        # each text ends with a separator of its own, smaller than all words; one symbol stands for all of them
        ends = np.cumsum(sizes + 1) - 1
        whole, words = np.empty(len(flat) + len(texts), np.int64), np.ones(len(flat) + len(texts), bool)
        words[ends] = False
        whole[ends], whole[words] = np.arange(len(texts)), flat + len(texts)
        order = suffix_array(whole)
        symbols = np.zeros(len(whole), np.int64)
        symbols[words] = flat + 1
        self.tree = WaveletTree(symbols[order - 1], len(names) + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(names) + 1))])
        self.symbols, self.starts, self.sizes = symbols, ends - sizes, sizes

    def matches(self, text: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each text and an end place in it, the start of the longest run of words up
        to there that stands twice or more in the index."""
        start = end + 1
        live = np.arange(len(text))
        low, high = np.zeros(len(text), np.int64), np.full(len(text), len(self.symbols))
        while len(live):
            live = live[start[live] > 0]
            c = self.symbols[self.starts[text[live]] + start[live] - 1]
            new_low, new_high = (self.before[c] + self.tree.rank(c, x[live]) for x in (low, high))
            two = new_high - new_low >= 2
            live = live[two]
            low[live], high[live] = new_low[two], new_high[two]
            start[live] -= 1
        return start

    def intervals(self, window: int) -> list[list[tuple[int, int]]]:
        """Per text, runs of ``window`` or more words that stand twice or more, by matching statistics."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        # a word that stands once can't be in such a run
        once = np.append(0, np.cumsum(np.diff(self.before)[self.symbols] < 2))
        text, end = np.arange(len(self.sizes)), self.sizes - 1
        while len(text):
            first = self.starts[text] + end - window + 1
            hopeless = once[first + window] > once[first]
            start = np.where(hopeless, end + 1, 0)
            at = np.flatnonzero(~hopeless)
            start[at] = self.matches(text[at], end[at])
            for t, s, e in zip(text[at].tolist(), start[at].tolist(), end[at].tolist()):
                if e + 1 - s >= window:
                    out[t].append((s, e + 1))
            end = np.minimum(end - 1, start + window - 2)
            stay = (start > 0) & (end >= window - 1)
            text, end = text[stay], end[stay]
        return out


def _chosen_grams(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, grams, counts = [], [], []
            for block, text in zip(b.column("block").to_pylist(), b.column("text").to_pylist()):
                x, place = chosen(hashes(split(text)), window, gram)
                values, n = np.unique(x[np.unique(place)], return_counts=True)
                blocks.append(np.full(len(values), block, np.int32))
                grams.append(values.astype(np.int64))
                counts.append(n.astype(np.int64))
            if blocks:
                yield _batch("block int, gram long, n long", block=np.concatenate(blocks), gram=np.concatenate(grams), n=np.concatenate(counts))

    return docs.select("block", "text").mapInArrow(run, "block int, gram long, n long")


def _blockwise(b: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """``(block, kind, rows)`` of runs of both."""
    blocks, kinds = np.asarray(b.column("block")), np.asarray(b.column("kind"))
    cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(kinds)]
    return ((int(blocks[s]), int(kinds[s]), b.slice(s, e - s)) for s, e in zip(cuts, cuts[1:]) if e > s)


def _pieces(dealt: DataFrame, window: int, gram: int, texts: bool) -> DataFrame:
    """From a block's repeated grams and then its documents, in this order: a row per document (kind 2,
    with its text, if it holds a segment, else 1 and finished), and per distinct segment of the block (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, table = None, [], None
        held: dict[bytes, list] = {}

        def distinct() -> pa.RecordBatch:
            rows = [(k, s, w, n) for s, (k, w, n) in held.items()]
            return _batch(_PIECES, kind=[3] * len(rows), block=[now] * len(rows), **dict(zip(("key", "segment", "words", "n"), zip(*rows))))

        for b in batches:
            for block, kind, part in _blockwise(b):
                if block != now:
                    if held:
                        yield distinct()
                    now, grams, table, held = block, [], None, {}
                if kind == 0:
                    grams.append(np.asarray(part.column("gram")).astype(np.uint64))
                    continue
                if table is None:
                    table = np.sort(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
                documents = []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = split(text)
                    h = hashes(words)
                    found = segments(*chosen(h, window, gram), table, window)
                    for key, start, end in found:
                        raw = h[start:end].tobytes()
                        held.setdefault(_name(raw), [key, raw, 0])[2] += 1
                    digest = None if found else hashlib.sha256(b" ".join(words)).hexdigest()
                    documents.append((2 if found else 1, block, i, len(words), digest, text if found or texts else None))
                yield _batch(_PIECES, **dict(zip(("kind", "block", "doc_id", "n_words", "kept_sha256", "text"), zip(*documents))))
        if held:
            yield distinct()

    return dealt.mapInArrow(run, _PIECES)


def repeated_runs(distinct: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(key, segment, words, n)`` of distinct segments, n times each, to ``(segment, runs)`` of those that stand
    once: runs of words, starts and ends as int32, in windows that stand twice or more. Segments without one have no row."""
    dealt = distinct.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, often, size, key = [], [], [], 0, None

        def shard() -> pa.RecordBatch:
            # segments that stand twice are in the index, and known to repeat as a whole
            found = FmIndex(texts).intervals(window)
            rows = [(s, np.array(r, "<i4").tobytes()) for s, r, n in zip(names, found, often) if r and n == 1]
            return _batch("segment binary, runs binary", segment=[r[0] for r in rows], runs=[r[1] for r in rows])

        for b in batches:
            for k, name, words, n in zip(*(b.column(c).to_pylist() for c in ("key", "segment", "words", "n"))):
                if k != key and size >= shard_words:
                    yield shard()
                    names, texts, often, size = [], [], [], 0
                key = k
                names.append(name)
                texts.append(np.frombuffer(words, "<u8"))
                often.append(n)
                size += len(texts[-1])
        if names:
            yield shard()

    return dealt.select("key", "segment", "words", "n").mapInArrow(run, "segment binary, runs binary")


def repeated_windows(distinct: DataFrame, window: int) -> DataFrame:
    """What ``repeated_runs`` says, by counting windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, raw, n in zip(*(b.column(c).to_pylist() for c in ("segment", "words", "n"))):
                rows += [(_name(raw[8 * k : 8 * (k + window)]), name, k, n) for k in range(len(raw) // 8 - window + 1)]
            yield _batch("name binary, segment binary, start int, n long", **dict(zip(("name", "segment", "start", "n"), zip(*rows))))

    cut_ = materialize(distinct.select("segment", "words", "n").mapInArrow(cut, "name binary, segment binary, start int, n long"))
    twice = cut_.groupBy("name").agg(F.sum("n").alias("all")).filter("all > 1").select("name")
    found = spread_join(cut_.filter("n = 1").select("name", "segment", "start"), twice, "name", "segment", frequent(cut_, "name"))
    starts = found.groupBy("segment").agg(F.collect_list("start").alias("starts"))  # windows of one segment

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array([(k, k + window) for k in x], "<i4").tobytes() for x in b.column("starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("segment"), pa.array(packed, pa.binary())], ["segment", "runs"])

    return starts.mapInArrow(runs, "segment binary, runs binary")


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int | None = None, texts: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256, ``removed`` (runs of
    removed words, starts and ends, ends exclusive) and, if ``texts``, the text that is ``kept``."""
    if window < 1:
        raise ValueError("a window holds a word or more")
    gram = min(GRAM, (window + 1) // 2) if gram is None else gram
    if not 1 <= gram <= window:
        raise ValueError("a gram holds one word or more and fits the window")
    spark = docs.sparkSession
    small_batches(spark)
    chars = docs.agg(F.sum(F.length("text").cast("long") + 64)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars), partitions(spark))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block.alias("block"))

    grams = materialize(_chosen_grams(named, window, gram).groupBy("block", "gram").agg(F.sum("n").alias("n")))
    repeated = grams.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    wanted = spread_join(grams.select("block", "gram"), repeated, "gram", "block", frequent(grams, "gram"))
    both = wanted.withColumn("kind", F.lit(0)).unionByName(named.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    pieces = materialize(_pieces(both.repartition("block").sortWithinPartitions("block", "kind"), window, gram, texts))
    release(grams)

    held = pieces.filter("kind = 3")
    names = materialize(held.groupBy("key", "segment").agg(F.sum("n").alias("n")))
    kinds = names.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key", (F.col("kinds") > CROWDED).alias("crowded"))
    hot = frequent(names, "key")
    open_ = spread_join(held.select("key", "segment", "words", "n"), kinds, "key", "segment", hot)
    open_ = materialize(open_.groupBy("key", "segment", "crowded").agg(F.first("words").alias("words"), F.sum("n").alias("n")))
    found = repeated_runs(open_.filter("not crowded"), window).unionByName(repeated_windows(open_.filter("crowded"), window))
    # no runs: the whole segment
    answers = names.filter("n > 1").select("segment", F.lit(None).cast("binary").alias("runs")).unionByName(found)
    back = spread_join(held.select("block", "key", "segment"), answers, "segment", "block", frequent(held, "segment"))
    both = back.withColumn("kind", F.lit(0)).unionByName(pieces.filter("kind = 2").select("kind", "block", "doc_id", "text"), allowMissingColumns=True)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: int, end: int>>, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        now, keys, runs, table = None, [], {}, None
        for b in batches:
            for block, kind, part in _blockwise(b):
                if block != now:
                    now, keys, runs, table = block, [], {}, None
                if kind == 0:
                    keys.append(np.asarray(part.column("key")).astype(np.uint64))
                    runs.update(zip(part.column("segment").to_pylist(), part.column("runs").to_pylist()))
                    continue
                if table is None:
                    table = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
                out = []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    words = split(text)
                    h = hashes(words)
                    edges = np.zeros(len(words) + 1, np.int64)
                    for _, start, end in segments(*chosen(h, window, gram), table, window):
                        name = _name(h[start:end].tobytes())
                        if name in runs:
                            r = np.array([[start, end]]) if runs[name] is None else np.frombuffer(runs[name], "<i4").reshape(-1, 2) + start
                            np.add.at(edges, r[:, 0], 1)
                            np.add.at(edges, r[:, 1], -1)
                    gone = np.cumsum(edges)[: len(words)] > 0
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                    kept = b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])
                    removed = [{"start": s, "end": e} for s, e in flips.tolist()]
                    out.append((i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), removed, kept.decode() if texts else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pairs, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"])

    kept = F.array_join(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")), " ") if texts else F.lit(None).cast("string")
    done = pieces.filter("kind = 1").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        F.array().cast("array<struct<start: int, end: int>>").alias("removed"), F.coalesce(kept, F.lit("") if texts else F.lit(None)).alias("kept"),
    )
    out = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema).unionByName(done)
    return out if texts else out.drop("kept")
