"""Each query on the given small tables against its brute-force version."""

import math
import zlib

import pytest

from tapewright.llm import queries as Q

from . import brute


@pytest.fixture(scope="module")
def docs(spark, data):
    return [(r.doc_id, r.text, r.source) for r in Q.documents(spark, data).select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def pairs(docs):
    return [d[:2] for d in docs]


def got(df, *columns):
    rows = [tuple(r) for r in df.select("doc_id", *columns).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_op1(spark, data, pairs):
    df = Q.op1_sentencepiece(spark, data)
    assert got(df, "n_tokens", "ids_sha256", "decoded_sha256") == brute.op1(pairs, Q.piece_model())
    assert df.filter("n_differing <> 0").count() == 0


def test_op2(spark, data, pairs):
    rows = {r.doc_id: r for r in Q.op2_toxicity(spark, data).collect()}
    assert rows.keys() == {i for i, _ in pairs}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op2_held_out_accuracy(spark, data):
    bigger = data.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{bigger}/labels.parquet").collect()}
    held = [r for r in Q.op2_toxicity(spark, bigger).filter("held_out").collect() if r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hit / sum(labels[r.doc_id] for r in held) >= 0.85  # a tenth of these labels is noise
    assert hit / max(1, sum(r.predicted for r in held)) >= 0.9


def test_op3(spark, data, pairs):
    assert got(Q.op3_simhash(spark, data), "fingerprint", "component_id") == brute.op3(pairs)


def test_op4(spark, data, docs):
    rows = Q.op4_mixing(spark, data).collect()
    expected = brute.op4_targets(docs)
    sizes = {i: len(brute.SPACE.findall(t or "")) for i, t, _ in docs}
    taken, largest = {}, {}
    for r in rows:
        size, target = expected[r.source]
        assert (r.size, r.source_size) == (sizes[r.doc_id], size)
        assert math.isclose(r.target, target, rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        epochs = int(target / size + 1e-12) if size else 0
        assert r.taken in (epochs * r.size, (epochs + 1) * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s, (_, target) in expected.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1
    again = {(r.doc_id, r.taken) for r in Q.op4_mixing(spark, data).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_op5(spark, data, pairs):
    df = Q.op5_licenses(spark, data)
    assert got(df, "n_words", "n_base", "first_word", "last_word", "base_labels") == brute.op5(pairs)
    for r in df.collect():
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels) and 0 <= r.score <= 1


def test_op6(spark, data, pairs):
    df = Q.op6_quality(spark, data)
    assert got(df, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.op6(pairs)
    assert df.filter("base_failed and kept").count() == 0


def test_op7(spark, data, pairs):
    assert got(Q.op7_secrets(spark, data), "n_assign", "n_access", "n_hex", "base_sha256") == brute.op7(pairs)


def test_op8(spark, data, pairs):
    assert got(Q.op8_line_dedup(spark, data), "n_lines", "n_dropped", "kept_sha256") == brute.op8(pairs)[0]


def test_op9(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    expected = brute.op9(rows, {i for i, _ in rows if i % 50 == 0})
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in Q.op9_top_k(spark, data).collect()) == expected


def test_op10(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = Q.op10_chat(spark, data)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}
    assert found == brute.op10(rows)


def test_oracles(spark, data):
    import os

    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        p = f"{data}/{t}.parquet"
        db.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name, sql in Q.ORACLE_SQL.items():
        got = Q.QUERIES[name](spark, data)
        expected = db.sql(sql)
        assert sorted(expected.columns) == sorted(got.columns), name
        rows = expected.select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
        assert sorted(tuple(map(norm, r)) for r in rows) == sorted(tuple(map(norm, r)) for r in got.collect()), name
