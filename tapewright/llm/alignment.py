"""Aligning the tokens of two tokenizers over the same texts.

Both tokenizers read a space and the text. Each gives a rising list of byte offsets at
which its tokens end. The offsets common to both lists cut the tokens into groups; they
are found by galloping: each offset of the shorter list is looked for in the longer one by
doubling steps from where the last one was, then by binary search in the last step's
range. Ranks of common offsets in the two lists slice the groups, and differences of ranks
say how many tokens of each side share one.

Texts are cut where both tokenizers provably cut, before a lone space in front of a word, so
words that a block repeats are tokenized and aligned once. Tokenizers for which this isn't
known get whole texts. Documents are dealt into blocks of about
``BLOCK_CHARS`` by a hash. A block names each distinct link (a pair of ids) once with the
number of its documents, so what Spark adds up over the corpus, and joins back, is
far less than a row a document and link. A second pass over the blocks' compact
rows, which comes after the counts of its links, sums them up by document. No table of
counts is broadcast and none comes to the driver.

Null and empty texts have no tokens; neither have texts whose joined token bytes differ from
space and text on either side (say, texts with U+2581): zeros and an empty digest. Long texts are never cut
off; a text longer than a block's share is worked on whole. Repeated rows are documents of their own, each
counts and each has a row. Empty tables give empty results. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import materialize, partitions, small_batches
from tapewright.llm.tokens import _PROBES, MARK

BLOCK_CHARS = 16 << 20
#: Chunks that are tokenized in a row.
RUN = 2000
#: Characters of new chunks that are tokenized and aligned at once, and rows that are cut at once: the
#: libraries' results take several hundred bytes a token. A longer chunk is worked on whole.
ALIGNED_CHARS, CUT_ROWS = 1 << 17, 500
#: A link is one number: the first id times this, plus the second.
_SHIFT = 32
_CUT = re.compile(r"(?<! )(?= \S)")
_PLAIN = re.compile(r" (?=\s|$)")
_DOCUMENT = "block int, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary, times binary, first binary, place binary, n_documents binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def gallop(wanted: np.ndarray, among: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per number of ``wanted`` the first place from ``start`` on in the rising list ``among`` whose
    number isn't smaller: doubling steps, then binary search within the last step. All
    numbers take their steps together."""
    n = len(among)
    low, high, step = start.copy(), start.copy(), np.ones(len(wanted), np.int64)
    open_ = np.flatnonzero((high < n) & (among[np.minimum(high, n - 1)] < wanted))
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] += step[open_]
        step[open_] *= 2
        open_ = open_[(high[open_] < n) & (among[np.minimum(high[open_], n - 1)] < wanted[open_])]
    high = np.minimum(high, n)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = among[middle] < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the numbers that both rising lists hold; the shorter
    list drives. ``a_start`` says for each number of ``a`` where to begin in ``b``, and the other way round."""
    if len(a) > len(b):
        j, i = common_ends(b, a, b_start, a_start)
        return i, j
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = gallop(a, b, a_start)
    hit = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a))
    return hit, at[hit]


class ByteLevel:
    """Side A: a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        named = json.loads(self.library.to_str())
        before = named.get("pre_tokenizer") or {}
        self.cuts = named.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        # the byte-level alphabet: printable Latin-1 characters are themselves, the other bytes follow from U+0100 on
        shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        hidden = [x for x in range(256) if x not in shown]
        byte = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(hidden)}
        self.bytes = {i: bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p, i in self.library.get_vocab().items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)}
        inner = any(MARK in p.lstrip(MARK) for i, p in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.cuts = not inner and all(sp.normalize(x) == (MARK + x).replace(" ", MARK) for x in _PROBES)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists, and the lists' lengths."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges ``first .. first + size`` one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Aligner:
    """Both tokenizers. Chunks with a single space in front follow each other in a text as they do
    in any other, so they are tokenized in runs."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        self.cuts = all(side.cuts for side in self.sides)
        self.sizes = [np.array([len(side.bytes.get(i, b"")) for i in range(max(side.bytes) + 1)], np.int64) for side in self.sides]
        self.span = max(map(len, self.sizes))
        #: an id as text with what follows it: within a side, before the other side, after a group, after a chunk
        self.texts = [f"{i}{x}" for x in ",|;\n" for i in range(self.span)]

    def cut(self, text: str) -> list[str]:
        whole = " " + text
        if not self.cuts:
            return [whole]
        if _PLAIN.search(whole) is None:
            return [" " + w for w in text.split(" ")]
        return [c for c in _CUT.split(whole) if c]

    def _tokens(self, side: int, chunks: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and their numbers, none for chunks whose bytes the tokens don't give."""
        one, size = self.sides[side], self.sizes[side]
        runs = [chunks[k : k + RUN] for k in range(0, len(chunks), RUN)] if self.cuts and all(c[1:2] != " " for c in chunks) else [[c] for c in chunks]
        parts, counts, offset = [], [], 0
        for run, ids in zip(runs, one.encode(["".join(r) for r in runs])):
            ids = np.array(ids, np.int64)
            own = ends[offset : offset + len(run)]
            token_ends = np.cumsum(size[ids]) + (ends[offset - 1] if offset else 0)
            last = np.searchsorted(token_ends, own)
            offset += len(run)
            if len(ids) and last[-1] == len(ids) - 1 and (token_ends[last] == own).all() and b"".join([one.bytes[i] for i in ids.tolist()]) == "".join(run).encode():
                parts.append(ids)
                counts.append(np.diff(last, prepend=-1))
            elif len(run) == 1:
                counts.append(np.zeros(1, np.int64))
            else:  # some chunk's bytes differ
                alone, n = _flat(one.encode(run))
                joined = [b"".join([one.bytes[i] for i in alone[e - k : e].tolist()]) == c.encode() for c, k, e in zip(run, n.tolist(), np.cumsum(n).tolist())]
                parts.append(alone[np.repeat(joined, n)])
                counts.append(np.where(joined, n, 0))
        return np.concatenate([*parts, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])

    def align(self, chunks: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per chunk ``n_a, n_b, n_groups, n_links`` and its groups as text, and all links one
        chunk after the other with their number a chunk."""
        if not chunks:
            return np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        (a, n_a), (b, n_b) = (self._tokens(side, chunks, ends) for side in (0, 1))
        good = (n_a > 0) & (n_b > 0)
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a * good, n_b * good
        a_end, b_end = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        of_a, of_b = (np.repeat(np.arange(len(chunks)), n) for n in (n_a, n_b))
        i, j = common_ends(a_end, b_end, (np.cumsum(n_b) - n_b)[of_a], (np.cumsum(n_a) - n_a)[of_b])
        per_a, per_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        n_links, chunk = per_a * per_b, of_a[i] if len(i) else np.zeros(0, np.int64)
        number = lambda weights=None: np.bincount(chunk, weights, len(chunks)).astype(np.int64)
        numbers = np.stack([n_a, n_b, number(), number(n_links)], axis=1)
        within = _spread(np.zeros(len(i), np.int64), n_links)
        wide = np.repeat(per_b, n_links)
        link = a[np.repeat(i + 1 - per_a, n_links) + within // np.maximum(wide, 1)] << _SHIFT | b[np.repeat(j + 1 - per_b, n_links) + within % np.maximum(wide, 1)]
        # the text: a group's first side, then its second one
        base = np.cumsum(per_a + per_b) - per_a - per_b
        codes = np.empty(len(a) + len(b), np.int64)
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[i], after_b[j] = 1, np.where(np.append(chunk[1:] != chunk[:-1], True)[: len(j)], 3, 2)
        codes[_spread(base, per_a)] = a + self.span * after_a
        codes[_spread(base + per_a, per_b)] = b + self.span * after_b
        said = iter("".join(map(self.texts.__getitem__, codes.tolist())).split("\n"))
        return numbers, [next(said) if ok else "" for ok in good.tolist()], link, numbers[:, 3]


def _parts(chunks: list[str]) -> Iterator[list[str]]:
    """The chunks in order, in lists of about ``ALIGNED_CHARS``."""
    first = held = 0
    for n, c in enumerate(chunks):
        held += len(c)
        if held >= ALIGNED_CHARS:
            yield chunks[first : n + 1]
            first, held = n + 1, 0
    if first < len(chunks):
        yield chunks[first:]


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class _Block:
    """Distinct chunks of a block and, per document, which of them it holds how often."""

    def __init__(self, number: int):
        self.number, self.at, self.held = number, {}, []
        self.numbers, self.groups = np.zeros((0, 4), np.int64), []
        self.link, self.n_links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, aligner: Aligner, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        parts = [aligner.cut(t) if t else [] for t in texts]
        new = list({c: None for p in parts for c in p if c not in self.at})
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        known = [self.numbers]
        for part in _parts(new):
            numbers, groups, link, n_links = aligner.align(part)
            known.append(numbers)
            self.groups += groups
            self.link.append(link)
            self.n_links.append(n_links)
        self.numbers = np.concatenate(known)
        rows = []
        for p in parts:
            idx = list(map(self.at.__getitem__, p))
            at = np.array(idx, np.int32)
            own = self.numbers[at]
            if not idx or not own[:, 0].all():
                rows.append((0, 0, 0, 0, "", b"", b""))
                continue
            chunks, times = np.unique(at, return_counts=True)
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, idx)).encode()).hexdigest()
            self.held.append(chunks)
            rows.append((*own.sum(axis=0).tolist(), digest, chunks.astype("<i4").tobytes(), times.astype("<i4").tobytes()))
        return _batch(self.number, 1, ids, *zip(*rows))

    def links(self) -> pa.RecordBatch:
        """The block's own row: per chunk its links, and how many documents hold each link."""
        link, sizes = np.concatenate(self.link), np.concatenate(self.n_links)
        first = np.append(0, np.cumsum(sizes))
        names, place = np.unique(link, return_inverse=True)
        documents = np.zeros(len(names), np.int64)
        for chunks in self.held:
            documents[np.unique(place[_spread(first[chunks], sizes[chunks])])] += 1
        return _batch(self.number, 2, [None], *[(None,)] * 7, *((x.tobytes(),) for x in (first.astype("<i8"), place.astype("<i4"))), ((names.astype("<i8").tobytes() + documents.astype("<i8").tobytes()),))


def _batch(block: int, kind: int, ids: list, *columns) -> pa.RecordBatch:
    n = len(ids)
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split() for c in _DOCUMENT.split(", ")]
    values = [[block] * n, [kind] * n, ids, *columns]
    values += [[None] * n] * (len(names) - len(values))
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(values, names)], [c for c, _ in names])


def _described(docs: DataFrame, a_path: str, b_path: str, blocks: int) -> DataFrame:
    """A row per document, and after a block's documents one with its links."""
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = _aligner(a_path, b_path), None
        for b in batches:
            numbers = np.asarray(b.column("block"))
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if block is None or block.number != int(numbers[s]):
                    if block is not None:
                        yield block.links()
                    block = _Block(int(numbers[s]))
                for k in range(s, e, CUT_ROWS):
                    n = min(CUT_ROWS, e - k)
                    yield block.add(aligner, b.column("doc_id").slice(k, n).to_pylist(), b.column("text").slice(k, n).to_pylist())
        if block is not None:
            yield block.links()

    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, _DOCUMENT)


def link_counts(links: DataFrame) -> DataFrame:
    """``(block, link, n)`` to ``(link, count, best)``: documents of the corpus that hold a link,
    and whether no link of the same first id is held by more. A first id has at most as
    many links as the second vocabulary has ids."""
    counts = links.groupBy("link").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("link", _SHIFT)))
    return counts.withColumn("best", F.col("count") == top)


def _unpacked(rows: DataFrame) -> DataFrame:
    """The blocks' links as rows ``(block, link, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("n_documents").to_pylist()):
                both = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(both.shape[1], block, np.int32)), pa.array(both[0]), pa.array(both[1])], ["block", "link", "n"])

    return rows.filter("kind = 2").select("block", "n_documents").mapInArrow(run, "block int, link long, n long")


def align(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``RESULT`` for ``docs(doc_id, text)``; both files have to be at their paths on each
    executor. Texts are shuffled once, by block; the compact rows of documents once more, to
    meet the counts of their block's links."""
    spark = docs.sparkSession
    small_batches(spark)
    chars = docs.agg(F.sum(F.length("text").cast("long") + 64)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars), partitions(spark))
    rows = materialize(_described(docs, a_path, b_path, blocks))
    links = _unpacked(rows)
    known = links.join(link_counts(links), "link").select("block", F.lit(0).alias("kind"), "link", "count", "best")
    both = known.withColumnRenamed("link", "id_pair").unionByName(rows, allowMissingColumns=True)
    # a block's counts come first, then its links by chunk, then its documents
    order = F.when(F.col("kind") == 2, 1).when(F.col("kind") == 1, 2).otherwise(0)
    dealt = both.withColumn("__order", order).repartition("block").sortWithinPartitions("block", "__order").drop("__order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, sums, bests = None, [], None, None
        for b in batches:
            blocks_, kinds = np.asarray(b.column("block")), np.asarray(b.column("kind"))
            cuts = [0, *(np.flatnonzero((np.diff(blocks_) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(kinds)]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if int(blocks_[s]) != now:
                    now, counts, sums, bests = int(blocks_[s]), [], None, None
                part = b.slice(s, e - s)
                if kinds[s] == 0:
                    counts.append([np.asarray(part.column(c).cast(pa.int64())) for c in ("id_pair", "count", "best")])
                elif kinds[s] == 2:
                    first, place = (np.frombuffer(part.column(c)[0].as_py(), t) for c, t in (("first", "<i8"), ("place", "<i4")))
                    pair, count, best = (np.concatenate(x) for x in zip(*counts)) if counts else (np.zeros(0, np.int64),) * 3
                    at = np.argsort(pair)[place]  # places count the block's links in order of their ids
                    sums, bests = (np.diff(np.append(0, np.cumsum(v[at]))[first]) for v in (count, best))
                    counts = []
                else:
                    held = [[np.frombuffer(x, "<i4") for x in part.column(c).to_pylist()] for c in ("chunks", "times")]
                    out = [[int(v[c] @ t) for c, t in zip(*held)] for v in (bests, sums)]
                    own = {c: part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                    own |= {"n_best": pa.array(out[0], pa.int64()), "count_sum": pa.array(out[1], pa.int64())}
                    names = [c.split()[0] for c in RESULT.split(", ")]
                    yield pa.RecordBatch.from_arrays([own[c] for c in names], names)

    return dealt.mapInArrow(run, RESULT)
