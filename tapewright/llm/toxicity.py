"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of two hashed rows, one for the lower-cased word
and one for its first ``PREFIX`` characters, so that unseen endings of a known
stem still mean something. Filters of widths 1, 2 and 3 run over the words of the
whole text, each filter keeps its maximum, and a logistic layer reads the maxima.
All labelled rows teach. They are dealt over shards of about ``SHARD_ROWS`` rows; in each
round a task a shard goes on from the same model with numpy, and the shards' models are averaged, weighted by
their rows, by a shuffle of slices of them. Up to one shard this is one task that goes through its rows ``epochs``
times. The driver holds a model and a histogram; scoring runs
in Arrow batches over all rows. A model is about two megabytes whatever the input.

Scores depend on the text alone. They are shifted so that 0.5 is the best cut on
the calibration part, every fifth row of a shard, by a histogram of its logits in steps of 1 / ``STEPS``;
``Model.thresholds`` has besides one cut per language, which callers may apply to the score (the pipeline does).

Null text counts as empty; a text without words scores like any other. Rows
without label, or with a null label or id, teach nothing. With no labelled rows
of either class the score is the constant share of label 1 (0 without any).
Repeated rows give repeated scores; of repeated labels of one id the larger one counts,
of its repeated texts the smallest one teaches. An empty table gives an empty result.
Whole texts are scored, however long; other columns pass through ``drop_toxic``.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapewright.llm.common import small_batches

BUCKETS, DIM, WIDTHS, FILTERS, PREFIX = 1 << 15, 8, (1, 2, 3), 8, 5
#: What a shard of labelled rows holds on average at most, in rows and in characters.
SHARD_ROWS, SHARD_CHARS = 8192, 64_000_000
#: Parts of a model that are averaged apart, and steps of a calibrated logit.
SLICES, STEPS = 8, 256
#: Words whose embeddings a worker keeps.
KEPT_WORDS = 150_000
#: Words convolved at once.
CONVOLVED = 1 << 17
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id):
    """Column: crc32 of the id as text leaves remainder 0 modulo 5. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Words(dict):
    """word -> row of a growing table of embeddings; row 0 is padding."""

    def __init__(self, table: np.ndarray):
        self.table, self.pairs = table, (array("i", [-1]), array("i", [-1]))
        self.rows = np.zeros((1, table.shape[1]), "float32")

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        stem = word[:PREFIX].encode("utf-8", "surrogatepass")
        self.pairs[0].append(zlib.crc32(raw) % BUCKETS)
        self.pairs[1].append(zlib.crc32(b"^" + stem) % BUCKETS)
        self[word] = n = len(self.pairs[0]) - 1
        return n

    def ids(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))

    def vectors(self) -> np.ndarray:
        if (known := len(self.rows)) < len(self.pairs[0]):
            self.rows = np.concatenate([self.rows, self.table[self.pairs[0][known:]] + self.table[self.pairs[1][known:]]])
        return self.rows

    def shed(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()
            self.__init__(self.table)

    def packed(self, text: str | None) -> np.ndarray:
        """Both rows of each word in one number from 1 on; 0 is padding."""
        ids = self.ids(text)
        word, stem = (np.frombuffer(p, np.int32)[ids] for p in self.pairs)
        return word * BUCKETS + stem + 1


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def maxima(self, docs: list[np.ndarray], vectors: np.ndarray, where: bool = False):
        """Maximum of each filter in each document, and, on demand, the word it starts at."""
        pad = max(WIDTHS) - 1
        sizes = np.array([max(1, len(d)) + pad for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros(starts[-1], np.int32)
        for d, s in zip(docs, starts):
            ids[s : s + len(d)] = d
        flat = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in self.filters], axis=1)
        parts = vectors[ids] @ flat
        n, total, conv, at = len(ids), [], [], 0
        for w in WIDTHS:
            c = parts[:, at : at + FILTERS].copy()
            for j in range(1, w):
                c[: n - j] += parts[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            conv.append(c)
        conv = np.concatenate(conv, axis=1)
        cuts = np.stack([starts[:-1], starts[1:] - pad], axis=1).ravel()
        total = np.maximum.reduceat(conv, cuts[:-1], axis=0)[::2]
        if not where:
            return total
        return total, np.stack([conv[s : e - pad].argmax(axis=0) + s for s, e in zip(starts, starts[1:])]), ids

    def logits(self, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        """Long documents are convolved in overlapping pieces, whose maxima merge."""
        pieces, owner, held, groups = [], [], 0, []
        for k, d in enumerate(docs):
            for s in range(0, max(1, len(d)), CONVOLVED):
                pieces.append(d[s : s + CONVOLVED + max(WIDTHS) - 1])
                owner.append(k)
                held += len(pieces[-1]) + max(WIDTHS)
                if held > CONVOLVED:
                    groups.append((pieces, owner))
                    pieces, owner, held = [], [], 0
        if pieces:
            groups.append((pieces, owner))
        top = np.full((len(docs), len(self.bias)), -np.inf, "float32")
        for p, o in groups:
            np.maximum.at(top, o, self.maxima(p, vectors))
        return np.maximum(top + self.bias, 0) @ self.out[:-1] + self.out[-1]

    def scores(self, docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        z = self.logits(docs, vectors).astype("float64") - self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def best_cut(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Cut with the best F1, halfway between neighbouring scores. With ``counts`` a score stands for so many
    rows, of which ``labels`` are the number with label 1."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits, upto = np.cumsum(y), np.cumsum(np.ones(len(y)) if counts is None else counts[order])
    f1 = 2 * hits / (upto + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1)) / 2)


def fresh_model(scale: float = 0.05, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, scale, (BUCKETS, DIM)).astype("float32")
    filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype("float32") for w in WIDTHS]
    return Model(table, filters, np.zeros(FILTERS * len(WIDTHS), "float32"), np.append(rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0).astype("float32"))


def descend(m: Model, docs: list[np.ndarray], labels: np.ndarray, positive: float, epochs: Sequence[int], of: int, batch: int = 32, rate: float = 0.02, decay: float = 0.001, seed: int = 7) -> None:
    """Adam on the logistic loss with decaying embeddings, over ``docs`` of packed words, in place: the ``epochs`` out of ``of``;
    label 1 weighs ``positive``."""
    rng = np.random.default_rng([seed, *epochs])
    rows, weight = np.arange(len(docs)), np.where(labels == 1, positive, 1.0)
    params = [m.table, *m.filters, m.bias, m.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in epochs:
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            own = rows[k : k + batch]
            used, local = np.unique(np.concatenate([docs[i] for i in own] + [np.zeros(1, np.int32)]), return_inverse=True)
            word, stem = np.divmod(np.maximum(used - 1, 0), BUCKETS)
            vectors = m.table[word] + m.table[stem]
            vectors[used == 0] = 0
            cuts = np.cumsum([len(docs[i]) for i in own])[:-1]
            top, at, ids = m.maxima(np.split(local[:-1], cuts), vectors, where=True)
            hidden = np.maximum(top + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.out[:-1] + m.out[-1], -30, 30)))
            delta = ((p - labels[own]) * weight[own] / weight[own].sum()).astype("float32")
            back = delta[:, None] * m.out[:-1] * (hidden > 0)
            grads = [np.zeros_like(m.table), *(np.zeros_like(f) for f in m.filters), back.sum(0), np.append(delta @ hidden, delta.sum())]
            local_grad = np.zeros_like(vectors)
            for n, w in enumerate(WIDTHS):
                g, a = back[:, n * FILTERS : (n + 1) * FILTERS], at[:, n * FILTERS : (n + 1) * FILTERS]
                for j in range(w):
                    there = ids[np.minimum(a + j, len(ids) - 1)]
                    grads[1 + n][j] += np.einsum("bf,bfd->df", g, vectors[there])
                    np.add.at(local_grad, there.ravel(), (g[:, :, None] * m.filters[n][j].T[None]).reshape(-1, DIM))
            local_grad[used == 0] = 0
            np.add.at(grads[0], word, local_grad)
            np.add.at(grads[0], stem, local_grad)
            step += 1
            pace = rate * (1 - 0.8 * epoch / of) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, u, v in zip(params, grads, first, second):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= (pace * u / (np.sqrt(v) + 1e-8)).astype("float32")
        m.table *= 1 - decay


def packed_logits(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    used, local = np.unique(np.concatenate([*docs, np.zeros(1, np.int32)]), return_inverse=True)
    word, stem = np.divmod(np.maximum(used - 1, 0), BUCKETS)
    vectors = m.table[word] + m.table[stem]
    vectors[used == 0] = 0
    return m.logits(np.split(local[:-1], np.cumsum([len(d) for d in docs])[:-1]), vectors)


def flat(m: Model) -> np.ndarray:
    return np.concatenate([p.ravel() for p in (m.table, *m.filters, m.bias, m.out)])


def unflat(weights: np.ndarray) -> Model:
    like, out, at = fresh_model(), [], 0
    for p in (like.table, *like.filters, like.bias, like.out):
        out.append(weights[at : at + p.size].reshape(p.shape).copy())
        at += p.size
    return Model(out[0], out[1:-2], out[-2], out[-1])


def calibrate(m: Model, langs: Sequence[str | None], bins: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> None:
    """Shift and cuts per language, from rows and rows with label 1 by language and logit."""
    z = (bins + 0.5) / STEPS
    m.shift = best_cut(z, hits, counts)
    of = {x: np.array([y == x for y in langs]) for x in {*langs} - {None}}
    for lang, own in of.items():
        if hits[own].sum() >= 5 and (counts - hits)[own].sum() >= 5:
            cut = best_cut(z[own], hits[own], counts[own]) - m.shift
            m.thresholds[lang] = min(0.9, max(0.1, float(1 / (1 + np.exp(-np.clip(cut, -500, 500))))))


def train(texts: list[str | None], labels: np.ndarray, langs: list[str | None], epochs: int = 8) -> Model:
    """A model of rows in memory, as ``fit`` learns one of one shard."""
    m, labels, words = fresh_model(), np.asarray(labels, "float64"), Words(np.zeros((1, 1), "float32"))
    if len(labels) == 0 or labels.min() == labels.max():
        m.constant = float(labels.mean()) if len(labels) else 0.0
        return m
    docs, apart = [words.packed(t) for t in texts], np.arange(len(labels)) % 5 == 4
    if len(set(labels[apart])) < 2 or len(set(labels[~apart])) < 2:
        apart[:] = False
    rows, part = np.flatnonzero(~apart), np.flatnonzero(apart) if apart.any() else np.arange(len(docs))
    y = labels[rows]
    descend(m, [docs[i] for i in rows], y, max(1.0, (y == 0).sum() / (y == 1).sum()), range(epochs), epochs)
    bins = np.floor(packed_logits(m, [docs[i] for i in part]) * STEPS)
    calibrate(m, [langs[i] for i in part], bins, labels[part], np.ones(len(part)))
    return m


def likely_in(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """``docs`` without most of the rows whose doc_id isn't among the ``n`` ids or fewer of ``known``, so that a
    join needn't shuffle their texts. A broadcast bitmap of hashes, 16 to 32 bits an id, tells them:
    no row of these ids goes, one in 16 of the others at most stays for the join to drop."""
    if docs.schema["doc_id"].dataType != known.schema["doc_id"].dataType:  # equal ids of unlike types have unlike hashes
        return docs
    bits = 1 << max(15, (16 * n).bit_length())
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = known.groupBy(F.bitmap_bucket_number(at).alias("__tw_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__tw_map"))
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring("__tw_map", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("__tw_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "__tw_bucket")
    return found.filter(F.getbit(byte, place % 8) == 1).select(*docs.columns)


def training_rows(docs: DataFrame, labels: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Labelled rows that are not held out: doc_id, text, lang, toxic. All of them, unless a caller
    bounds the characters they have together; whole texts or none, by a hash of the id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    found = likely_in(docs.select("doc_id", "text", lang), known, labels.count()).join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d"), F.first("toxic").alias("toxic"))
    found = found.select("doc_id", "d.text", "d.lang", "toxic")
    if max_chars is None:
        return found
    # one task sees the lengths of what a caller bounds
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = found.withColumn("upto", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(upto))
    return sized.filter(F.col("upto") <= max_chars).drop("upto")


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(np.zeros((1, 1), "float32"))
        for b in batches:
            packed = [words.packed(t).tobytes() for t in b.column("text").to_pylist()]
            words.shed()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("toxic"), pa.array(packed, pa.binary())], ["doc_id", "lang", "toxic", "words"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], rows.schema["lang"], *StructType.fromDDL("toxic int, words binary").fields]))


def _round(rows: DataFrame, m: Model, positive: float, apart: bool, epochs: Sequence[int], of: int) -> Model:
    """One round over the shards of ``rows``, and the average of what they came to."""
    shared = rows.sparkSession.sparkContext.broadcast(flat(m))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def learned(shard: int, docs: list, labels: list) -> pa.RecordBatch:
            own = unflat(shared.value)
            descend(own, docs, np.array(labels, "float64"), positive, epochs, of)
            parts = np.array_split(flat(own), SLICES)
            columns = [range(SLICES), [shard] * SLICES, [len(docs)] * SLICES, [p.tobytes() for p in parts]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["slice", "shard", "n", "weights"])

        held, docs, labels = None, [], []
        for b in batches:
            for shard, y, out, words in zip(*(b.column(c).to_pylist() for c in ("shard", "toxic", "apart", "words"))):
                if shard != held:
                    if docs:
                        yield learned(held, docs, labels)
                    held, docs, labels = shard, [], []
                if not (apart and out):
                    docs.append(np.frombuffer(words, np.int32))
                    labels.append(y)
        if docs:
            yield learned(held, docs, labels)

    def average(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")  # sums of floats in one order
        total, n = 0.0, 0
        for rows_, weights in zip(t["n"].to_pylist(), t["weights"]):
            total, n = total + rows_ * np.frombuffer(weights.as_buffer(), np.float32).astype("float64"), n + rows_
        return pa.table({"slice": pa.array([t["slice"][0].as_py()], pa.int32()), "weights": pa.array([(total / n).astype("float32").tobytes()], pa.binary())})

    learned = rows.mapInArrow(learn, "slice int, shard int, n bigint, weights binary")
    got = learned.groupBy("slice").applyInArrow(average, "slice int, weights binary").toArrow().sort_by("slice")  # one model
    shared.destroy()
    return unflat(np.concatenate([np.frombuffer(w.as_buffer(), np.float32) for w in got["weights"]]))


def _histogram(rows: DataFrame, m: Model, apart: bool) -> pa.Table:
    """Rows, and rows with label 1, by language and step of the logit."""
    shared = rows.sparkSession.sparkContext.broadcast(flat(m))

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unflat(shared.value)
        for b in batches:
            if b.num_rows:
                bins = np.floor(packed_logits(own, [np.frombuffer(w, np.int32) for w in b.column("words").to_pylist()]) * STEPS)
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(np.clip(bins, -64 * STEPS, 64 * STEPS).astype("int32")), b.column("toxic")], ["lang", "bin", "toxic"])

    part = rows.filter("apart") if apart else rows
    found = part.select("lang", "toxic", "words").mapInArrow(logits, StructType([rows.schema["lang"], *StructType.fromDDL("bin int, toxic int").fields]))
    return found.groupBy("lang", "bin").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")).orderBy("bin", "lang").toArrow()


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 8, **bounds) -> Model:
    """Learn from all rows of ``training_rows``, shard by shard."""
    small_batches(docs.sparkSession)
    known, rows, m = _packed(training_rows(docs, labels, **bounds)).persist(StorageLevel.DISK_ONLY), None, fresh_model()
    try:
        size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("words") / 4), F.lit(0)), F.coalesce(F.avg("toxic"), F.lit(0.0))).first()  # one row
        if size[2] in (0, 1):
            m.constant = float(size[2])
            return m
        shards = max(1, -(-size[0] // SHARD_ROWS), -(-int(size[1]) * 6 // SHARD_CHARS))
        draw = F.xxhash64("doc_id")
        dealt = known.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")).repartition(shards, "shard")
        k = F.row_number().over(Window.partitionBy("shard").orderBy(draw, "doc_id"))
        rows = dealt.select("shard", k.alias("k"), (k % 5 == 0).alias("apart"), "lang", "toxic", "words").sortWithinPartitions("shard", "k").persist(StorageLevel.DISK_ONLY)
        n = {(r.apart, r.toxic): r["count"] for r in rows.groupBy("apart", "toxic").count().collect()}  # four rows at most
        known.unpersist()
        apart = len(n) == 4
        count = lambda y: n.get((False, y), 0) + (0 if apart else n.get((True, y), 0))
        positive = max(1.0, count(0) / count(1))
        for part in [range(epochs)] if shards == 1 else [range(e, e + 1) for e in range(epochs)]:
            m = _round(rows, m, positive, apart, part, epochs)
        h = _histogram(rows, m, apart)
        calibrate(m, h["lang"].to_pylist(), h["bin"].to_numpy(), h["hits"].to_numpy(), h["n"].to_numpy())
        return m
    finally:
        known.unpersist()
        if rows is not None:
            rows.unpersist()


def score_documents(docs: DataFrame, model: Model, keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all) columns of ``docs`` and ``toxicity`` (0 to 1), from ``text`` alone. Narrow."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(docs.columns if keep is None else keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = Words(m.table)
        for b in batches:
            ids = [words.ids(t) for t in b.column("text").to_pylist()]
            scores = m.scores(ids, words.vectors())
            words.shed()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, "toxicity"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("toxicity", DoubleType())])
    return docs.mapInArrow(run, schema)


def threshold(model: Model, lang):
    """Column: the cut for a language, 0.5 where none was calibrated."""
    cut = F.lit(0.5)
    for name, value in sorted(model.thresholds.items()):
        cut = F.when(lang == name, F.lit(value)).otherwise(cut)
    return cut


def toxicity(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (score >= 0.5) and
    ``rejected`` (score at or over its language's cut)."""
    model = fit(docs, labels, **sample)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    scored = score_documents(docs.select("doc_id", "text", lang), model, ("doc_id", "lang"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        (F.col("toxicity") >= threshold(model, F.col("lang"))).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """Rows of ``docs`` under their language's cut, with the columns of ``docs``."""
    model = fit(docs, labels, **sample)
    plain = docs.withColumnRenamed("toxicity", "__tw_toxicity") if "toxicity" in docs.columns else docs
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    kept = score_documents(plain, model).filter(F.col("toxicity") < threshold(model, lang)).drop("toxicity")
    return kept.toDF(*docs.columns)
