"""SimHash near-duplicates.

A document's 64-bit fingerprint has a bit set where over half of its shingles'
XXH64 hashes have it. Fingerprints that differ in at most ``max_bits`` (2) bits
are linked, and linked documents form groups.

Candidates come from an inverted index over byte positions. Lists of one byte would
grow with the square of the input, so a posting holds the bytes at four positions.
Of the 70 sets of four positions the index takes the 14 whose numbers (0 to 7) XOR to
zero. Two positions lie in three of these, and three in one, so two fingerprints share
three postings or more exactly if they share six bytes or more, one if they share five,
and one or none with four. Postings are tallied for each pair; two differing bits leave
six bytes equal, so pairs that reach a tally of three are retained and their bits
counted.

A list of more than ``MAX_POSTING`` members is split by two more of its bytes, in all
six ways: members within two bits share two of the other four bytes at least, and so
meet; they count once for the list. Fingerprints that agree on six bytes and still make
such a long list differ in 16 known bits: they are written under themselves and their
16 one-bit neighbours, and two meet under one of these exactly if they are within two
bits. That path is linear, and its pairs have the six bytes that a tally has to show.

Equal fingerprints are one node before any of this. Null text and a text without words
have fingerprint zero. A null doc_id takes part in the links but never names a group
unless all ids of the group are null. Repeated rows give repeated results. An empty table
gives an empty result. Texts of any length are one row's work; columns other than
doc_id and text pass through ``drop_near_duplicates``, names that begin with ``__tw_``
are the operator's own.

With a ``similarity`` texts are compared themselves. Nodes are sets of shingles (copies
are one node); ``tables`` fingerprints of a node, which count each of its shingles once, come from as many hash functions. Here a
posting holds three bytes, at 8 of the 56 sets of three positions: no two positions lie in
two of these, so that sets seldom fail together, and each five positions hold one, so that
five equal bytes, which three differing bits leave at least, are sure to meet, and fewer often
do. Candidates meet in one table, differ there in at most ``max_bits``, have sets whose sizes allow
the similarity, and are verified by exact Jaccard similarity: no false link is made, and
links are missed where texts just over 0.8 share too few bytes in every table (the README has figures).
Pairs left over after the first round may also differ in all tables together by no more than five standard
deviations over what that similarity lets expect.

Of rows with equal id and text and unlike other columns the one with the smallest hash of
these stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from tapewright.llm.common import frequent, materialize, partitions, release, small_batches, spread_join

SEED = 42
#: Longest posting list whose members are paired up, or searched for near ones, before anything else.
MAX_POSTING = 48
#: Four of the eight byte positions, so that each three positions lie in one set.
QUADS = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)
#: Three of the eight byte positions: these are the points of a plane of three by three but
#: for its origin, and the sets are the lines of that plane that miss the origin.
_POINTS = tuple(divmod(n, 3) for n in range(1, 9))
TRIPLES = tuple(t for t in combinations(range(8), 3) if all(sum(_POINTS[i][axis] for i in t) % 3 == 0 for axis in (0, 1)))
#: Fingerprints of a node where texts are compared.
TABLES = 28


#: Sets of fewer shingles have fingerprints that differ more at the same similarity.
FEW = 32


def most_apart(similarity: float, tables: int, few: bool) -> int:
    """Bits in which the fingerprints of all tables together may differ: what two sets of that
    similarity are expected to differ in, and five standard deviations more. A bit differs by
    the angle of the sets, or for sets of few shingles at most a quarter more often."""
    p = acos(2 * similarity / (1 + similarity)) / pi * (1.25 if few else 1.03)
    n = 64 * tables
    return ceil(n * p + 5 * sqrt(n * p * (1 - p)))


def least_tally(max_bits: int) -> int:
    """Postings that two fingerprints share at least if at most ``max_bits`` bits differ."""
    return min(sum(not set(q) & set(spoilt) for q in QUADS) for spoilt in combinations(range(8), max_bits))


def _wide(positions) -> int:
    """Mask over the bytes at these positions."""
    return sum(0xFF << 8 * i for i in positions)


def _long(x: int) -> Column:
    """Literal of 64 bits."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _equal_bytes(x: Column) -> Column:
    """Bit i is set if byte i of the XOR ``x`` is zero."""
    return sum(F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(0xFF)) == 0, 1 << i).otherwise(0) for i in range(8))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter((digest(g, SEED) for g in grams), np.uint64)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        part = h[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    return _majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row and its ``fingerprint`` as a signed long; narrow."""
    small_batches(docs.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(prints)], [*keep, "fingerprint"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("fingerprint", LongType())])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _remixed(h: np.ndarray, table: int) -> np.ndarray:
    """Hashes as another hash function would give them; table 0 leaves them alone."""
    if table:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(2 * table * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return h


def _majorities(h: np.ndarray, tables: int) -> list[int]:
    """A document's fingerprint in each table."""
    ones = np.zeros((tables, 64), np.int64)
    for k in range(0, len(h), 1024):
        part = np.stack([_remixed(h[k : k + 1024], t) for t in range(tables)])
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(tables, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8").ravel().tolist()


def _sketches(docs: DataFrame, shingle: int, tables: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, ``sk``, a hash of the set of shingles, ``m``, its size, and ``fp0`` and on, a
    fingerprint for each table; narrow."""
    small_batches(docs.sparkSession)
    keep, prints = list(keep), [f"fp{k}" for k in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            hashes = [shingle_hashes(t, shingle) for t in b.column("text").to_pylist()]
            sets = [np.unique(h) for h in hashes]
            sk = np.array([xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            sizes = np.array([len(h) for h in sets], np.int64)
            fps = np.array([_majorities(h, tables) for h in sets], np.uint64).reshape(-1, tables).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sk), pa.array(sizes), *(pa.array(fps[:, k]) for k in range(tables))], [*keep, "sk", "m", *prints])

    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(c, LongType()) for c in ("sk", "m", *prints))])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two arrays of distinct hashes; two empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``texts(sk, text)`` have that Jaccard similarity."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, stay = {}, []
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "ta", "tb"))
            for k, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
                for key, text in ((x, ta), (y, tb)):
                    if key not in sets:
                        sets[key] = np.unique(shingle_hashes(text[k].as_py(), shingle))
                stay.append(jaccard(sets[x], sets[y]) >= similarity)
            kept = pa.array(stay, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], ["a", "b"])

    one = pairs.join(texts.select(F.col("sk").alias("a"), F.col("text").alias("ta")), "a")
    return one.join(texts.select(F.col("sk").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def similar_groups(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int, tables: int, max_bits: int, similarity: float) -> DataFrame:
    """``(node, root)`` of every linked one of the distinct ``nodes(sk, m, fp0, ..)``. Nodes
    are candidates if they share a posting of three positional bytes in a table, differ
    there in at most ``max_bits`` and have ``m`` shingles each that allow the similarity, and linked if their texts, which ``texts_of`` finds for
    a table of ``sk``, are verified.

    First each node is verified against two members of its lists that stand first there: the
    smallest one and the one with the fewest differing bits, so that a group of near copies
    costs two pairs a node, however many lists its nodes share. Then pairs that are not yet
    in one group are compared, and all of these; a pair is taken from its first posting in a table."""

    if tables * len(TRIPLES) > 256:
        raise ValueError("a posting's table and set have eight bits")

    def posting(nth: int) -> Column:
        key = F.col("table") * len(TRIPLES) + nth
        for i in TRIPLES[nth]:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(_long(0xFF)))
        return (key - (1 << 31)).cast("int")

    prints = F.array(*(F.struct(_long(t).alias("table"), F.col(f"fp{t}").alias("fp")) for t in range(tables)))
    each = nodes.select("sk", "m", F.explode(prints).alias("p")).select("sk", "m", "p.*")
    every = each.select("sk", "m", "fp", F.explode(F.array(*(posting(m) for m in range(len(TRIPLES))))).alias("key"))
    key = "key"

    def alike(a: Column | str, b: Column | str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * similarity - 1e-9

    def near_to(x: Column) -> Column:
        return (F.col("sk") != x["sk"]) & (F.bit_count(F.col("fp").bitwiseXOR(x["fp"])) <= max_bits) & alike(F.col("m"), x["m"])

    # postings are shuffled once; most lists hold one node, or none that is near another, and end here
    listed, own = Window.partitionBy(key), F.struct("sk", "fp", "m")
    shared = every.withColumn("n", F.count("*").over(listed)).filter("n > 1")
    short = F.collect_list(F.when(F.col("n") <= MAX_POSTING, own)).over(listed)
    shared = shared.withColumns({"first": F.min(own).over(listed), "short": short})
    posted = materialize(shared.filter((F.col("n") > MAX_POSTING) | F.exists("short", near_to)).drop("n", "short"))

    def paired(d: DataFrame) -> DataFrame:
        """Pairs of different roots, each once, from the first table and posting in which they meet."""
        left, right = (d.select(key, *(F.col(c).alias(f"{side}_{c}") for c in ("sk", "fp", "m", "root", "fps"))) for side in "ab")
        code = F.col(key).cast("long") + (1 << 31)
        table, nth = F.shiftright(code, 24).cast("int") / len(TRIPLES), F.shiftright(code, 24) % len(TRIPLES)
        x = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
        first = F.coalesce(*(F.when(x.bitwiseAND(_long(_wide(at))) == 0, m) for m, at in enumerate(TRIPLES)))
        near = left.join(right, key).filter("a_sk < b_sk and a_root <> b_root").filter(F.bit_count(x) <= max_bits).filter(first == nth).filter(alike("a_m", "b_m"))
        apart = sum(F.bit_count(F.col("a_fps")[t].bitwiseXOR(F.col("b_fps")[t])) for t in range(tables))
        near = near.filter(apart <= F.when(F.least("a_m", "b_m") < FEW, most_apart(similarity, tables, True)).otherwise(most_apart(similarity, tables, False)))

        def met(y: Column) -> Column:
            equal = F.lit(False)
            for at in TRIPLES:
                equal = equal | (y.bitwiseAND(_long(_wide(at))) == 0)
            return (F.bit_count(y) <= max_bits) & equal

        before = F.slice(F.zip_with("a_fps", "b_fps", lambda a, b: a.bitwiseXOR(b)), F.lit(1), F.floor(table).cast("int"))
        return near.filter(~F.exists(before, met)).select(F.col("a_sk").alias("a"), F.col("b_sk").alias("b"))

    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp")))
    firsts = posted.filter(near_to(F.col("first"))).select("sk", F.col("first.sk").alias("to"), bits.alias("bits"))
    firsts = firsts.groupBy("sk").agg(F.min("to").alias("low"), F.min(F.struct("bits", "to")).alias("close"))
    pairs = materialize(firsts.select(F.explode(F.array_distinct(F.array("low", "close.to"))).alias("a"), F.col("sk").alias("b")))
    texts = materialize(texts_of(posted.select("sk").distinct()))
    edges = materialize(verified(pairs, texts, shingle, similarity))
    roots = materialize(components(edges))
    owned = posted.select(key, "sk", "fp", "m").join(roots.withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))
    mixed = owned.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select(key)
    left = materialize(owned.join(mixed, key).join(nodes.select("sk", F.array(*(f"fp{t}" for t in range(tables))).alias("fps")), "sk"))
    if not left.isEmpty():
        more = verified(materialize(paired(left)), texts, shingle, similarity)
        roots = materialize(components(edges.unionByName(more)))
    release(posted, pairs, texts, edges, left)
    return roots


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints ``prints(fp)`` that span the same
    groups as all pairs within ``max_bits`` (1 or 2) differing bits."""
    if not 1 <= max_bits <= 2:
        raise ValueError("long lists are split for 1 or 2 differing bits")
    key = ["list", "value"]
    quads = [F.struct(F.lit(m).alias("list"), F.col("fp").bitwiseAND(_long(_wide(q))).alias("value")) for m, q in enumerate(QUADS)]
    every = prints.select("fp", F.explode(F.array(*quads)).alias("k")).select("fp", "k.*")
    sizes = every.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    posted = materialize(every.join(sizes.hint("merge"), key))

    def met(d: DataFrame, key: list[str]) -> DataFrame:
        left, right = d.select(*key, F.col("fp").alias("a")), d.select(*key, F.col("fp").alias("b"))
        return left.join(right, key).filter("a < b")

    # lists that are too long: once for each two of the other four bytes
    ways = [[F.struct(F.lit(n).alias("way"), F.col("fp").bitwiseAND(_long(_wide([*q, *two]))).alias("six"), F.lit(sum(1 << i for i in two)).alias("two"), _long(_wide(set(range(8)) - {*q, *two})).alias("free")) for n, two in enumerate(combinations([i for i in range(8) if i not in q], 2))] for q in QUADS]
    way = F.element_at(F.array(*(F.array(*w) for w in ways)), F.col("list") + 1)
    split = posted.filter(F.col("n") > MAX_POSTING).select("fp", "list", F.explode(way).alias("w")).select("fp", "list", "w.*")
    fine = ["list", "way", "six"]
    longer = split.groupBy(fine).agg(F.count("*").alias("n")).filter("n > 1")
    split = materialize(split.join(longer, fine))
    others = F.element_at(F.array(*(F.lit(0xFF - sum(1 << i for i in q)) for q in QUADS)), F.col("list") + 1)
    # of the ways in which a pair meets in one list, the first counts: its two bytes are the lowest equal ones
    same = _equal_bytes(F.col("a").bitwiseXOR(F.col("b"))).bitwiseAND(others)
    lowest = same.bitwiseAND(-same)
    rest = same - lowest
    parted = met(split.filter(F.col("n") <= MAX_POSTING), [*fine, "two"]).filter(F.col("two") == lowest + rest.bitwiseAND(-rest))
    both = met(posted.filter(F.col("n") <= MAX_POSTING), key).select("a", "b").unionByName(parted.select("a", "b"))
    tallied = both.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least_tally(max_bits))
    near = tallied.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")

    # lists of six equal bytes that are still too long
    dense = split.filter(F.col("n") > MAX_POSTING).select("fp", "free").distinct()
    bits = F.array(*(_long(1 << i) for i in range(64)))
    flips = F.transform(F.filter(bits, lambda b: b.bitwiseAND(F.col("free")) != 0), lambda b: F.col("fp").bitwiseXOR(b))
    around = dense.select("fp", "free", F.explode(F.concat(F.array("fp"), flips)).alias("middle"))
    meet = around.groupBy("free", "middle").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 17 members at most
    if max_bits == 1:
        meet = meet.filter(F.array_contains("fps", F.col("middle")))
    centre = F.col("middle") if max_bits == 1 else F.array_min("fps")
    star = meet.select(centre.alias("c"), F.explode("fps").alias("m")).filter("c <> m").select(F.least("c", "m").alias("a"), F.greatest("c", "m").alias("b"))
    return near.unionByName(star).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node of
    its component. Alternates large-star and small-star steps until nothing moves;
    each round is written to the shared folder."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None

    def lowered(all_edges: DataFrame, lowest: DataFrame) -> DataFrame:
        lowest = materialize(lowest)
        # at most eight hubs for each partition
        hot = lowest.filter(F.col("n") >= max(2, all_edges.count() // (8 * partitions(all_edges.sparkSession)))).select("a")
        return spread_join(all_edges, lowest.drop("n"), "a", "b", hot)

    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = lowered(both, lowest).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = lowered(large, lowest).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, edges = edges, materialize(small.select("e.a", "e.b").filter("a <> b").distinct())
        release(before, large)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct fingerprint of ``prints(doc_id,
    fingerprint)``. The root is a fingerprint and tells groups apart; ids may not."""
    distinct = materialize(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    member = materialize(components(links(distinct.select("fp"), max_bits)))
    named = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = materialize(named.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(spread_join(grouped, smallest, "root", "fp", frequent(grouped, "root")).select("fp", "root", "component_id"))


def _classed(prints: DataFrame, max_bits: int, by: str) -> DataFrame:
    """``prints(doc_id, fingerprint, ..)`` with their class; rows of a fingerprint that
    many documents share are dealt over all partitions."""
    prints = prints.withColumnRenamed("fingerprint", "fp")
    return spread_join(prints, classes(prints.select("doc_id", F.col("fp").alias("fingerprint")), max_bits), "fp", by, frequent(prints, "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links, its own included)."""
    out = _classed(materialize(fingerprints(docs, shingle)), max_bits, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The id as a string and whether it is null: plain columns as keys of a join.
OWN, NONE = "__tw_id", "__tw_null"


def _plain(d: DataFrame) -> DataFrame:
    return d.withColumns({OWN: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), NONE: F.col("doc_id").isNull()})


def _roots(keyed: DataFrame, text_key: str, shingle: int, max_bits: int, similarity: float | None, tables: int) -> DataFrame:
    """``(doc_id, text_key, root)`` of each row."""
    if similarity is None:
        prints = materialize(fingerprints(keyed.select("doc_id", text_key, "text"), shingle, ("doc_id", text_key)))
        return _classed(prints, max_bits, text_key).select("doc_id", text_key, "root")
    fps = [f"fp{k}" for k in range(tables)]
    prints = materialize(_sketches(keyed.select("doc_id", text_key, "text"), shingle, tables, ("doc_id", text_key)))
    # exact copies share a node: one row of each goes on
    rank = F.struct(F.col("doc_id").isNull().alias(NONE), "doc_id", text_key)
    nodes = materialize(prints.groupBy("sk").agg(*(F.min(c).alias(c) for c in ("m", *fps)), F.min(rank).alias("s")).select("sk", "m", *fps, "s.doc_id", f"s.{text_key}"))
    keys = [OWN, NONE, text_key]

    def texts_of(wanted: DataFrame) -> DataFrame:
        chosen = materialize(_plain(nodes.join(wanted, "sk")).select("sk", *keys))
        # a merge join at every size: texts are shuffled once here, by the keys that de-duplication needs
        return _plain(keyed.select("doc_id", text_key, "text")).join(chosen.hint("merge"), keys).dropDuplicates(keys).select("sk", "text")

    member = similar_groups(nodes.select("sk", "m", *fps), texts_of, shingle, tables, max_bits, similarity)
    return nodes.join(member.withColumnRenamed("node", "sk"), "sk", "left").select("doc_id", text_key, F.coalesce("root", "sk").alias("root"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, similarity: float | None = None, tables: int = TABLES) -> DataFrame:
    """Rows of ``docs`` that stay: of each group the one with the smallest doc_id
    (null ids last, then by the text's hash; of rows with that id and text, one). All columns of ``docs`` come back unchanged.
    With a ``similarity``, texts are linked if they meet in the postings of one of ``tables``
    fingerprints, differ there in at most ``max_bits``, and their sets of shingles have that
    Jaccard similarity; equal sets always are."""
    text_key = "__tw_text"
    keyed = docs.withColumn(text_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = _roots(keyed, text_key, shingle, max_bits, similarity, tables)
    rank = F.struct(F.col("doc_id").isNull().alias(NONE), "doc_id", text_key)
    first = found.groupBy("root").agg(F.min(rank).alias("s")).select("s.doc_id", f"s.{text_key}")
    # plain columns as keys: join and de-duplication then share one shuffle of the texts
    keys = [OWN, NONE, text_key]
    stay = materialize(_plain(first).select(*keys).distinct())
    rest = [c for c in docs.columns if c not in ("doc_id", "text") and not isinstance(docs.schema[c].dataType, MapType)]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(0), *rest)))
    return _plain(keyed).join(stay, keys, "left_semi").withColumn("__tw_nth", nth).filter("__tw_nth = 1").select(*docs.columns)
