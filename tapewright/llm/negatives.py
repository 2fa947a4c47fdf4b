"""Hard-negative mining by a vertical branch-and-bound scan (BOND) over columnar vectors.

Vectors lie in blocks column by column, one dimension after the other, with each
dimension's least and greatest value. An anchor reads the dimensions in the order of its
own descending magnitude and adds up partial inner products. What the unread dimensions
may still add lies between the sums of their least and greatest products, so every
candidate has a lower and an upper bound, and the bitmap of candidates shrinks at each
step, until the rest have exact scores. Two scans use this:

* positives: rows of the anchor's label; a row stays while its upper bound reaches the
  k-th best lower bound;
* negatives: rows of other labels, for the windows [low % , high %] of the positives'
  scores; a row stays while its bounds meet a window above the k-th best lower bound
  of rows that are surely inside.

Anchors are dealt into chunks of at most about ``CHUNK`` and blocks into parts; a cell (chunk, part)
is one task, which gets its anchors first and streams the blocks past them. Each anchor goes
to every part once and each block to every chunk once; no pairs of rows or blocks are
shuffled. Memory is a chunk, its best rows so far, and one block. Results of the parts
merge by anchor.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component
take no part. Rows with the anchor's id are never its candidates, nor are vectors of another
length. Anchors that are equal in id, label and vector are asked once; rows that share only the id are
anchors of their own. Repeated candidates are repeated results. Ties go to the
smaller id. Anchors without positives or negatives have no row, nor has an empty table. Only
vec_id, embedding and label are read, so other columns can't clash. A component or a
returned score that doesn't fit a long fails with a message.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, small_batches

#: Vectors of a block, anchors of a chunk, and rows of a part; dimensions read between two looks at the bounds.
BLOCK, CHUNK, PART, STEP = 4096, 16_384, 1_000_000, 8
_FITS, _EXACT = 1 << 62, float(1 << 53)
_SIDE = "key binary, anchor_id long, anchor_label long, vector array<bigint>, positive_ids array<bigint>, positive_scores array<bigint>"
_BLOCK = "dim int, width int, ids binary, labels binary, data binary"


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, label, vector)`` of the rows that take part; components are floor(scale * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def _columnar(rows: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK vectors of one length, packed where they lie."""

    def block(dim: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, labels, data = (np.concatenate(x) for x in zip(*held))
        if np.abs(data).max() >= _FITS:
            raise ValueError("a scaled component doesn't fit a long")
        width = next(w for w in (2, 4, 8) if data.min() >= -(1 << 8 * w - 1) and data.max() < 1 << 8 * w - 1)
        binary = (ids.astype("<i8"), labels.astype("<i8"), data.T.astype(f"<i{width}"))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([width], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in binary)], [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            vector = b.column("vector")
            sizes, flat = np.asarray(vector.value_lengths()), np.asarray(vector.flatten())
            starts = np.cumsum(sizes) - sizes
            ids, labels = np.asarray(b.column("vec_id")), np.asarray(b.column("label"))
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for k in range(0, len(own), BLOCK):
                    at = own[k : k + BLOCK]
                    held.setdefault(dim, []).append((ids[at], labels[at], flat[starts[at][:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[dim]) >= BLOCK:
                        yield block(dim, held.pop(dim))
        for dim, parts in held.items():
            yield block(dim, parts)

    return rows.mapInArrow(run, _BLOCK)


class Columns:
    """A block, dimension by dimension."""

    def __init__(self, dim: int, width: int, ids: bytes, labels: bytes, data: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.x = np.frombuffer(data, f"<i{width}").reshape(dim, -1)
        self.floats = self.x.astype("float64")
        self.low, self.high = self.floats.min(axis=1), self.floats.max(axis=1)
        self.reach = np.maximum(np.abs(self.low), np.abs(self.high))

    def scan(self, anchor: np.ndarray, alive: np.ndarray, undecided: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places ``alive`` that stay undecided to the end, and their exact
        scores. ``undecided`` judges lower and upper bounds."""
        exact = float(np.abs(anchor.astype("float64")) @ self.reach) < _EXACT
        # beyond what doubles hold, the same steps run on Python's integers
        a, x, low, high = (anchor.astype("float64"), self.floats, self.low, self.high) if exact else (v.astype(object) for v in (anchor, self.x, self.x.min(axis=1), self.x.max(axis=1)))
        order = np.argsort(-np.abs(a), kind="stable")
        ends = np.stack([a * low, a * high])[:, order]
        rest = [np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0))]
        score = np.zeros(len(alive), a.dtype)
        for s in range(0, len(order), STEP):
            if not len(alive):
                break
            d = order[s : s + STEP]
            score = score + a[d] @ (x[d] if len(alive) == x.shape[1] else x[d[:, None], alive])
            e = min(s + STEP, len(order))
            stay = undecided(score + rest[0][e], score + rest[1][e])
            alive, score = alive[stay], score[stay]
        return alive, score


def _kth(x: np.ndarray, k: int):
    return np.sort(x)[-k] if x.dtype == object else np.partition(x, -k)[-k]


class Best:
    """The ``k`` highest scores so far, at most ``high``; ``floor`` is what a new one has to reach."""

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high, self.rows = k, low, high, []

    @property
    def floor(self):
        return -self.rows[-1][0] if len(self.rows) == self.k else self.low

    def undecided(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        floor, inside = self.floor, low
        if self.high is not None:
            inside = low[(low >= self.low) & (high <= self.high)]
        if len(inside) >= self.k:
            sure = _kth(inside, self.k)
            floor = sure if floor is None else max(floor, sure)
        out = np.ones(len(low), bool) if floor is None else high >= floor
        return out if self.high is None else out & (low <= self.high)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = np.ones(len(ids), bool) if self.floor is None else scores >= self.floor
        if self.high is not None:
            fits &= scores <= self.high
        at = np.flatnonzero(fits)
        if len(at) > self.k:  # ties at the k-th place stay, ids choose below
            at = at[scores[at] >= _kth(scores[at], self.k)]
        self.rows = sorted([*self.rows, *((-int(scores[i]), int(ids[i])) for i in at)])[: self.k]


class _Anchor:
    def __init__(self, row: dict, k: int, window: tuple[int, int] | None):
        self.row, self.vector = row, np.array(row["vector"], np.int64)
        if window is None:
            self.best = [Best(k)]
        else:
            ranges = [(-(-window[0] * p // 100), window[1] * p // 100) for p in row["positive_scores"]]
            self.best = [Best(k, low, high) if low <= high else None for low, high in ranges]
        self.same = window is None

    def meet(self, c: Columns) -> None:
        open_ = [b for b in self.best if b]
        if len(self.vector) != len(c.x) or not open_:
            return
        alive = np.flatnonzero(((c.labels == self.row["anchor_label"]) == self.same) & (c.ids != self.row["anchor_id"]))
        alive, score = c.scan(self.vector, alive, lambda low, high: np.logical_or.reduce([b.undecided(low, high) for b in open_]))
        if len(alive):
            for b in open_:
                b.add(c.ids[alive], score)


def _sides(rows: DataFrame) -> DataFrame:
    """Distinct anchors with a key of id, label and vector."""
    key = F.unhex(F.md5(F.to_json(F.struct("vec_id", "label", "vector")))).alias("key")
    return rows.select(key, F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "vector").dropDuplicates(["key"])


def _cells(anchors: DataFrame, blocks: DataFrame, chunks: int, parts: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """``(key, anchor_id, positive, candidate_id, score)``: per cell and anchor the best
    rows, of the same label without a ``window``, else of other labels per positive."""
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks)) * parts
    left = anchors.withColumn("cell", F.explode(F.sequence(chunk, chunk + parts - 1))).withColumn("kind", F.lit(0))
    part = F.pmod(F.xxhash64("ids", "data"), F.lit(parts))
    right = blocks.withColumn("cell", F.explode(F.sequence(part, F.lit((chunks - 1) * parts) + part, F.lit(parts)))).withColumn("kind", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("cell", F.col("cell").cast("int"))
    dealt = both.repartition(chunks * parts, "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def found() -> pa.RecordBatch:
            rows = [(a.row["key"], a.row["anchor_id"], n, i, -s) for a in held for n, b in enumerate(a.best) if b for s, i in b.rows]
            if any(abs(r[4]) >= 1 << 63 for r in rows):
                raise ValueError("a score doesn't fit a long")
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], ["key", "anchor_id", "positive", "candidate_id", "score"])

        for b in batches:
            for n in range(b.num_rows):
                row = {c: b.column(c)[n].as_py() for c in b.schema.names}
                if row["cell"] != cell:
                    if held:
                        yield found()
                    cell, held = row["cell"], []
                if row["kind"] == 0:
                    held.append(_Anchor(row, k, window))
                elif held:
                    block = Columns(*(row[c] for c in ("dim", "width", "ids", "labels", "data")))
                    for a in held:
                        a.meet(block)
        if held:
            yield found()

    return dealt.mapInArrow(run, "key binary, anchor_id long, positive int, candidate_id long, score long")


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each row of ``anchors`` and each of its ``positives`` best rows of its label in
    ``vectors`` (both vec_id, embedding, label): the ``negatives`` best rows of other labels whose scores
    lie between ``low`` and ``high`` percent of the positive's. Columns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    if positives < 1 or negatives < 1:
        raise ValueError("at least one positive and one negative are wanted")
    small_batches(vectors.sparkSession)
    blocks, asked = _columnar(whole_vectors(vectors, scale)), _sides(whole_vectors(anchors, scale))
    chunks = max(1, -(-anchors.count() // CHUNK))
    parts = max(1, -(-2 * partitions(vectors.sparkSession) // chunks), -(-vectors.count() // PART))

    def top(found: DataFrame, k: int, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "candidate_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    near = top(_cells(asked, blocks, chunks, parts, positives, None), positives, "key")
    listed = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate_id", "score"))).alias("p"))  # ``positives`` rows a key
    paired = asked.join(listed, "key").select("*", F.col("p.candidate_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")).drop("p")
    far = top(_cells(paired, blocks, chunks, parts, negatives, (low, high)), negatives, "key", "positive")
    named = far.join(near.select("key", (F.col("rank") - 1).alias("positive"), F.col("candidate_id").alias("positive_id"), F.col("score").alias("positive_score")), ["key", "positive"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("candidate_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """``mine`` as the query wants it: labels of every seventh id move on by one, every
    hundredth row is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", moved.alias("label"))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


ORACLE_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(a.e) = len(c.e)
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where same
), w as (
  select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.n order by s.score desc, s.vec_id) as rank
  from p join s on p.n <= 5 and s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from w where rank <= 10
"""
