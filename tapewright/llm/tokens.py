"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score, then by
position: the best pair merges, its new neighbours join the agenda, and entries whose
symbols have changed leave it. Since no piece of the vocabulary holds a space mark after
another character, nothing merges across the start of a run of space marks: texts are
cut there and each chunk is encoded once per worker and kept in a bounded cache.

The new short chunks of an Arrow batch share one agenda, an array of entries (rank of
the score, place) in order of their chunks; in each round every chunk takes its best
entry, merges it and enters the new pairs. Long chunks have an agenda of their own, a heap.
Both merge the same pairs in the same order. Each Arrow batch hands its new chunks to the
sentencepiece library as well, to encode and to decode again; where ids or texts should
ever differ, the library's are taken and counted in ``n_differing``.

Null text counts as empty; an empty text has no piece, only the end id. Nothing
is cut off, however long. Repeated rows give repeated results. An empty table gives an
empty result. Only doc_id and text are read, so other columns can't clash.
Models whose normaliser changes texts, and those with pieces of their user's, which
match before any merge, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.llm.common import small_batches

MARK = "▁"
#: Chunks longer than this have a heap of their own and aren't cached.
CACHED_CHARS = 48
#: No entry.
_NONE = np.int64(1) << 62
#: Entries of one generation of the cache; two generations are kept.
CACHED_CHUNKS = 200_000
#: Texts that normalisers are known to change: compatibility forms, marks to compose, runs of spaces, controls.
_PROBES = ("ﬁ Ａ①", "e\u0301 q", "  two  spaces ", "tab\there\x07\u200b\ufeff", "İßΣ")
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string, n_differing long"


class Vocabulary:
    """Pieces, scores and byte pieces of a merge-type model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[x] for p, x in scores.items()}  # equal scores: equal ranks
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        self.texts = [" \u2047 " if i == self.unknown else "" if i in self.control else None if i in self.byte_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.numbers = list(map(str, range(n)))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character: texts can't be cut at space marks")
        for probe in _PROBES:
            if sp.normalize(probe) != (MARK + probe).replace(" ", MARK):
                raise ValueError("the model's normaliser changes texts")
        self._pair_table()

    def _pair_table(self) -> None:
        """Symbols (pieces, and characters that pieces hold) as numbers, and a hash table
        from pairs of symbols that merge to the rank and number of the merged one."""
        symbols = sorted({*self.ids, *(c for p in self.ids for c in p)})
        number = {x: n for n, x in enumerate(symbols)}
        self.of_char = np.full(0x110000, len(symbols), np.int32)  # the last number never merges
        for x, n in number.items():
            if len(x) == 1:
                self.of_char[ord(x)] = n
        self.id_of = np.array([self.ids.get(x, -1) for x in symbols] + [-1], np.int32)
        rows = [(number[p[:k]] << 32 | number[p[k:]], self.ranks[p], number[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        keys, ranks, merged = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.slots, self.slot_rank, self.slot_merged = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = keys[left[free]]
            own = self.slots[at[left]] == keys[left]
            placed = left[own]
            self.slot_rank[at[placed]], self.slot_merged[at[placed]] = ranks[placed], merged[placed]
            left = left[~own]
            at[left] = at[left] + 1 & size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & len(self.slots) - 1

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and numbers of merged symbols; rank -1 where a pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & len(self.slots) - 1
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] != keys[open_]) & (found[open_] >= 0)]
        rank = np.where(found == keys, self.slot_rank[at], -1)
        return rank, self.slot_merged[at]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of normalised chunks, by one agenda for all of them."""
        if not chunks:
            return []
        text = "".join(chunks)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(c) for c in chunks])
        owner = np.repeat(np.arange(len(chunks)), sizes)
        symbol, origin = self.of_char[codes], np.arange(len(codes))
        last = np.zeros(len(codes), bool)
        last[np.cumsum(sizes) - 1] = True

        def entries(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Agenda entries of the pairs that begin at these places."""
            rank, merged = self.look_up(symbol[at], symbol[np.minimum(at + 1, len(symbol) - 1)])
            return np.where((rank < 0) | last[at], _NONE, rank << 32 | origin[at]), merged

        agenda, result = entries(np.arange(len(symbol)))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(agenda, starts)
            live = best != _NONE
            if not live.all():
                per = np.diff(np.append(starts, len(symbol)))
                stay = np.repeat(live, per)
                done.append((owner[~stay], symbol[~stay], origin[~stay]))
                owner, symbol, origin, last, agenda, result = (x[stay] for x in (owner, symbol, origin, last, agenda, result))
                best = best[live]
                if not len(symbol):
                    break
            at = np.searchsorted(origin, best & 0xFFFFFFFF)
            symbol[at] = result[at]
            last[at] = last[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after the merged symbols are gone
            owner, symbol, origin, last, agenda, result = (x[keep] for x in (owner, symbol, origin, last, agenda, result))
            before = at[at > 0] - 1
            for new in (at, before[~last[before]]):
                agenda[new], result[new] = entries(new)
        owner, symbol, origin = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(origin, kind="stable")
        owner, symbol, origin = owner[order], symbol[order], origin[order]
        ids = self.id_of[symbol].tolist()
        odd = np.flatnonzero(self.id_of[symbol] < 0)
        for k in odd.tolist():
            # a symbol that is no piece: the bytes of its characters, or the unknown id
            size = (origin[k + 1] if k + 1 < len(origin) else len(text)) - origin[k]
            raw = text[origin[k] : origin[k] + size].encode()
            ids[k] = [self.bytes[b] for b in raw] if self.bytes else [self.unknown]
        ends = np.searchsorted(owner, np.arange(len(chunks)), "right").tolist()
        out = [ids[s:e] for s, e in zip([0, *ends], ends)]
        for c in set(owner[odd].tolist()):
            out[c] = [j for i in out[c] for j in (i if type(i) is list else (i,))]
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a normalised chunk (spaces already marks), by the agenda.

        An entry is one number: rank of the piece's score, then the left symbol's
        place, then the pair's length. Place and length name a piece of the chunk,
        so an entry still holds if the symbols there have that length together."""
        symbols, ranks = list(chunk), self.ranks
        n = len(symbols)
        bits = 24 if n < 1 << 24 else 40
        low, place = (1 << bits) - 1, 2 * bits
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [ranks[p] << place | i << bits | 2 for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in ranks]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry >> bits & low
            piece, right = symbols[left], after[left]
            if not piece or right < 0 or len(piece) + len(symbols[right]) != entry & low:
                continue
            symbols[left] = piece = piece + symbols[right]
            symbols[right] = ""
            after[left] = beyond = after[right]
            if (ahead := before[left]) >= 0 and (p := symbols[ahead] + piece) in ranks:
                heapq.heappush(agenda, ranks[p] << place | ahead << bits | len(p))
            if beyond >= 0:
                before[beyond] = left
                if (p := piece + symbols[beyond]) in ranks:
                    heapq.heappush(agenda, ranks[p] << place | left << bits | len(p))
        out: list[int] = []
        for s in filter(None, symbols):
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend([self.bytes[b] for b in s.encode()])
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int], keep_first_space: bool = False) -> str:
        """Text of ids: control ids vanish, runs of byte pieces are read as UTF-8
        (what isn't UTF-8 becomes U+FFFD), marks become spaces; the space that
        encoding puts in front goes."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i is not None:
                out.append(self.texts[i])
        text = "".join(out)
        return text if keep_first_space else text.removeprefix(" ")


#: What a cache holds of a chunk; callers ask for one or more.
NUMBERS, BYTES, TEXT = "ids as decimal text", "ids as int32 bytes", "decoded text"


class _Chunks(dict):
    """chunk -> a tuple of those ``parts`` (NUMBERS, BYTES, TEXT) that are asked for. Two
    generations: a full young one becomes the old one, whose entries come back
    when they are asked for."""

    def __init__(self, vocabulary: Vocabulary, parts: tuple[str, ...] = (NUMBERS, BYTES, TEXT)):
        self.v, self.old, self.parts = vocabulary, {}, parts

    def text(self, ids: list[int]) -> str:
        texts = [self.v.texts[i] for i in ids]
        return self.v.decode(ids, keep_first_space=True) if None in texts else "".join(texts)

    def entry(self, ids: list[int], text: str) -> tuple:
        make = {NUMBERS: lambda: " ".join([self.v.numbers[i] for i in ids]), BYTES: lambda: array("i", ids).tobytes(), TEXT: lambda: text}
        return tuple([make[p]() for p in self.parts])

    def enter(self, wanted: set[str]) -> tuple[dict[str, tuple], set[str]]:
        """Encode those of ``wanted`` chunks that aren't known, compare them with the
        library, and know the short ones from then on. Returns the long ones, which the
        caller forgets, and the chunks in which the library differed."""
        v, new, long_ = self.v, [], []
        for c in wanted - self.keys():
            if c in self.old:
                self[c] = self.old[c]
            else:
                (new if len(c) <= CACHED_CHARS else long_).append(c)
        names = new + long_
        made = v.encode_chunks(new) + [v.encode_chunk(c) for c in long_]
        texts = [self.text(ids) for ids in made]
        checked = [k for k, c in enumerate(names) if c != MARK]  # a lone mark can't be told from no text
        expected = v.library.encode([names[k][1:].replace(MARK, " ") for k in checked], num_threads=1)
        # chunks begin with marks, so they decode in a row as they do alone
        told = v.library.decode([i for ids in expected for i in ids]) == "".join([texts[k] for k in checked]).removeprefix(" ")
        wrong = set()
        for k, ids in zip(checked, expected):
            if made[k] != ids or not told and texts[k].removeprefix(" ") != v.library.decode(ids):
                made[k], texts[k] = ids, " " + v.library.decode(ids)
                wrong.add(names[k])
        entries = [self.entry(ids, text) for ids, text in zip(made, texts)]
        self.update(zip(new, entries))
        return dict(zip(long_, entries[len(new) :])), wrong

    def age(self) -> None:
        if len(self) > CACHED_CHUNKS:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=1)
def _vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


@lru_cache(maxsize=1)
def _chunks(model_file: str, parts: tuple[str, ...]) -> _Chunks:
    return _Chunks(_vocabulary(model_file), parts)


def cut(text: str | None) -> list[str]:
    """The text's chunks, spaces as marks and one mark in front."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_texts(texts: list[str | None], chunks: _Chunks) -> tuple[list[list[tuple]], list[int]]:
    """Per text the entries of its chunks, and in how many of them the library differed."""
    parts = [cut(t) for t in texts]
    longer, wrong = chunks.enter(set().union(*parts))
    get = chunks.__getitem__ if not longer else lambda c: longer.get(c) or chunks[c]
    return [list(map(get, p)) for p in parts], [sum(c in wrong for c in p) if wrong else 0 for p in parts]


def _encoder(model_file: str, columns: tuple[str, ...]):
    # bytes always: they count the ids
    wanted = (BYTES, *(p for p, names in ((NUMBERS, {"ids_sha256"}), (TEXT, {"decoded", "decoded_sha256"})) if names & {*columns}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(model_file, wanted)
        at = {p: k for k, p in enumerate(wanted)}
        end_text, end_bytes = str(chunks.v.end), np.array([chunks.v.end], "int32").tobytes()
        for batch in batches:
            encoded, differing = encode_texts(batch.column("text").to_pylist(), chunks)
            ids = [b"".join([e[at[BYTES]] for e in x] + [end_bytes]) for x in encoded]
            sizes = [len(b) // 4 for b in ids]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64()), "n_differing": pa.array(differing, pa.int64())}
            if "ids" in columns:
                values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(ids))])
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
            if "ids_sha256" in columns:
                out["ids_sha256"] = pa.array([hashlib.sha256(" ".join([e[at[NUMBERS]] for e in x] + [end_text]).encode()).hexdigest() for x in encoded], pa.string())
            if "decoded" in columns or "decoded_sha256" in columns:
                decoded = ["".join([e[at[TEXT]] for e in x])[1:] for x in encoded]
                out["decoded"] = pa.array(decoded, pa.string()) if "decoded" in columns else None
                out["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())
            chunks.age()
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], list(columns))

    return run


def encode_documents(docs: DataFrame, model_file: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Encode every whole text of ``docs(doc_id, text)`` with an end id, and decode
    it again. ``columns`` picks from ``SCHEMA``; other columns of ``docs`` are not
    read. A narrow job: no shuffle, one pass, memory of one Arrow batch and a
    bounded cache per worker. ``model_file`` has to be at that path on each executor."""
    small_batches(docs.sparkSession)
    kinds = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    kinds["doc_id"] = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encoder(model_file, columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def decode_documents(tokens: DataFrame, model_file: str) -> DataFrame:
    """``tokens(doc_id, ids)`` back to ``(doc_id, text)``; null ids give a null text."""
    small_batches(tokens.sparkSession)

    def run(batches):
        v = _vocabulary(model_file)
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
