"""Secret scans: an Aho-Corasick automaton finds keywords, anchored regular
expressions run only where a keyword stands, and formats that carry a checksum
are validated by it.

Base kinds: ``assign`` (a password-like name, a sign, a value), ``access`` (AKIA
keys) and ``hex`` (runs of hex digits, which have no keyword: the run anchors
itself). Kinds with checksums: ``github`` and ``npm`` tokens end in six base-62
digits of the CRC-32 of what stands between, ``xprv`` keys in four bytes of a
double SHA-256. A string of these formats whose checksum fails is not reported.

Matches of a kind are leftmost and don't overlap; matches that fail a length or a
checksum use up their place all the same. Offsets are code points, ends exclusive.
Null text counts as empty. Repeated rows give repeated results; an empty table gives an
empty one. Whole texts are scanned, however long; columns other than doc_id and text are
not read, so none can clash. Narrow, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.llm.common import LOWER, UPPER, small_batches

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def crc62(token: str) -> bool:
    """prefix_ + body + six base-62 digits of the body's CRC-32."""
    body = token.partition("_")[2]
    n, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = _B62[r] + digits
    return digits == body[-6:]


def base58check(key: str) -> bool:
    n = 0
    for c in key:
        n = n * 58 + _B58.index(c)
    raw = n.to_bytes(82, "big") if n.bit_length() <= 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


KINDS = (
    # fixed values: names, patterns and least lengths of the base kinds
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    Kind("hex", (), re.compile(r"[0-9a-f]{16,}"), lambda m: True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc62(m[0])),
    Kind("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: crc62(m[0])),
    Kind("xprv", ("xprv",), re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-Za-z])"), lambda m: base58check(m[0])),
)
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            a.add_word(word, (k, len(word)))
    a.make_automaton()
    return a


def find(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)``, sorted."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case and would move offsets
        low = text.translate(_ASCII_LOWER)
    out, over = [], [0] * len(KINDS)
    for last, (k, size) in _automaton().iter(low):
        start, kind = last + 1 - size, KINDS[k]
        if start >= over[k] and (m := kind.pattern.match(text, start)):
            over[k] = m.end()
            if kind.valid(m):
                out.append((start, k, m.end()))
    for k, kind in enumerate(KINDS):
        if not kind.keywords:
            out += [(m.start(), k, m.end()) for m in kind.pattern.finditer(text) if kind.valid(m)]
    return sorted(out)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k].name}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_assign, n_access, n_hex, base_sha256
    (digest of the base kinds' spans) and spans (of all kinds, kind:start:end)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(len(BASE))]
            digests = [hashlib.sha256(written([x for x in f if x[1] < len(BASE)]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(written, found), pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
