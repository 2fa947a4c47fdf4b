"""Exact top-k search by inner product, with multi-resolution segment statistics.

Components are made integers (floor of ``SCALE`` times the component). A vector is
cut into segments; with a segment's mean m, deviation norm s and length n,

    <x, q>  <=  sum over segments of (n * m_x * m_q + s_x * s_q),

equivalently a lower bound on the distance |x - q|. The bound is taken over the
whole vector first, then over 4 and 16 segments; candidates that can't reach the
k-th best score found so far fall out at each level, and only the survivors get
their exact integer score, so nothing is lost.

Rows are packed into blocks where they lie, with their statistics. Blocks of candidates
are dealt into as many parts as there are shuffle partitions, and blocks of queries go to
every part. In a part the blocks of candidates come in a row for each block of queries,
whose best scores so far are carried on and prune the next ones; a part gives its own top
k for each query, and these merge by query. Nothing is collected, and memory is one pair
of blocks.

Vectors that are null or empty or hold a null or a non-finite component, or a
null id, take no part. Vectors of another length than the query's aren't its
candidates. All rows with the query's id are its own; repeated rows are repeated
candidates, a repeated query (same id and vector) is asked once. Ties go to the
smaller id. Queries without candidates have no row. An empty table gives an empty
result; columns other than vec_id and embedding are not read, so none can clash. Vectors
of any length work. A component or a result's score that doesn't fit a long (finite components
over about a million, for most lengths) fails the query with a message that says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, small_batches

SCALE, BLOCK, LEVELS = 256, 1024, (1, 4, 16)
_FITS = 1 << 62
#: Above this product of norms, double precision can't hold every integer.
_EXACT = float(1 << 53)


def usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment: mean times the root of the length, and deviation norm. A
    bound is then the inner product of the first plus that of the second."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    mean = np.stack([x[:, p].mean(axis=1) for p in parts], axis=1)
    spread = np.stack([np.sqrt(((x[:, p] - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, mean.T)], axis=1)
    return mean * np.sqrt([len(p) for p in parts]), spread


def _packed(vectors: DataFrame, scale: int) -> DataFrame:
    """Blocks ``(dim, ids, data, stats)`` of up to BLOCK vectors of one length: int64 bytes,
    and the statistics of all levels side by side as float64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids, data = np.array([i for i, _ in rows], "<i8"), np.stack([x for _, x in rows])
            if np.abs(data).max() >= _FITS:
                raise ValueError(f"a component times {scale} doesn't fit a long")
            stats = np.concatenate([x for level in LEVELS for x in statistics(data, level)], axis=1)
            columns = [ids, data.astype("<i8"), stats.astype("<f8")]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["dim", "ids", "data", "stats"])

        for b in batches:
            for i, x in zip(b.column("vec_id").to_pylist(), b.column("embedding")):
                v = np.floor(scale * np.asarray(x.values, "float64"))
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == BLOCK:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "dim int, ids binary, data binary, stats binary")


class Block:
    """Vectors of one length, their ids, and per level the two halves of the bound."""

    def __init__(self, dim: int, ids: bytes, data: bytes, stats: bytes):
        self.ids, self.data = np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(-1, dim)
        self.floats = self.data.astype("float64")
        self.norm = float(np.linalg.norm(self.floats, axis=1).max())
        stats, at, self.levels = np.frombuffer(stats, "<f8").reshape(len(self.ids), -1), 0, []
        for level in LEVELS:
            # mean and spread side by side: a bound is one inner product
            width = 2 * min(level, dim)
            self.levels.append(stats[:, at : at + width])
            at += width


def best_so_far(q: Block, c: Block, k: int, held: list[list[tuple[int, int]]]) -> None:
    """Merge each query's best ``(-score, id)`` of one more block of candidates into ``held``."""
    safe = q.norm * c.norm < _EXACT
    coarse = q.levels[0] @ c.levels[0].T
    # rounding in the bounds: far under one unit of an integer score unless the values are huge
    slack = 1e-9 * (1 + np.abs(coarse).max())
    for r in range(len(q.ids)):

        def exact(at: np.ndarray) -> np.ndarray:
            if safe:
                return (c.floats[at] @ q.floats[r]).astype("int64")
            return np.array([sum(int(a) * int(b) for a, b in zip(c.data[i], q.data[r])) for i in at], object)

        alive = np.flatnonzero(c.ids != q.ids[r])
        if len(held[r]) < k:
            seed = alive[np.argsort(-coarse[r, alive], kind="stable")[: 4 * k]]
            known = sorted([-s for s, _ in held[r]] + exact(seed).tolist(), reverse=True)
        else:
            known = [-s for s, _ in held[r]]
        if len(known) >= k:
            cut = float(known[k - 1]) - slack
            for n, level in enumerate(c.levels):
                bound = coarse[r, alive] if n == 0 else level[alive] @ q.levels[n][r]
                alive = alive[bound >= cut]
        if len(alive):
            score = exact(alive)
            top = np.lexsort((c.ids[alive], -score))[:k]
            held[r] = sorted([*held[r], *((-int(score[i]), int(c.ids[alive[i]])) for i in top)])[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the ``k`` best rows
    of ``vectors`` (both vec_id, embedding) with another id."""
    if k < 1:
        raise ValueError("k is at least 1")
    small_batches(vectors.sparkSession)
    asked = usable(queries.select("vec_id", "embedding")).dropDuplicates(["vec_id", "embedding"])
    q = _packed(asked, scale).toDF("q_dim", "q_ids", "q_data", "q_stats")
    c = _packed(usable(vectors.select("vec_id", "embedding")), scale)
    # blocks of candidates are dealt into parts, blocks of queries go to every part
    parts = max(16, partitions(vectors.sparkSession))
    c = c.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).repartition(parts, "dim", "part")
    q = q.withColumns({"q_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "q_block": F.xxhash64("q_ids", "q_data")}).repartition(parts, "q_dim", "q_part")
    pairs = c.join(q, (F.col("dim") == F.col("q_dim")) & (F.col("part") == F.col("q_part")))  # of blocks, not rows
    pairs = pairs.select("dim", "part", "ids", "data", "stats", "q_block", "q_ids", "q_data", "q_stats").sortWithinPartitions("dim", "part", "q_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, held = None, None, []

        def found() -> pa.RecordBatch:
            rows = [(int(i), v, -s) for i, best in zip(q.ids, held) for s, v in best]
            if any(abs(s) >= 1 << 63 for _, _, s in rows):
                raise ValueError("a score doesn't fit a long")
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                p = {n: b.column(n)[i].as_py() for n in ("dim", "part", "q_block")}
                get = lambda *names: [b.column(n)[i].as_py() for n in names]  # noqa: B023, E731
                if p != now:
                    if q is not None:
                        yield found()
                    now, q = p, Block(p["dim"], *get("q_ids", "q_data", "q_stats"))
                    held = [[] for _ in q.ids]
                best_so_far(q, Block(p["dim"], *get("ids", "data", "stats")), k, held)
        if q is not None:
            yield found()

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""
