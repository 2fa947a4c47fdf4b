"""Hard negatives, repeated passages, aligned tokens, and what stages owe their queries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapewright.llm import alignment, licenses, mixing, negatives, simhash, substrings
from tapewright.llm import queries as Q

from . import brute


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
REPEATS = ("doc_id", "n_words", "n_removed", "kept_sha256")
ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op11(spark, data):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in NEGATIVES) for r in Q.op11_negatives(spark, data).collect())
    assert got == brute.op11(rows) and len(got) > 50


VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def test_negatives_of_odd_rows(spark, monkeypatch):
    """Nulls, other lengths, ties, repeats, hot labels; many chunks and parts; small blocks and steps."""
    r = random.Random(4)
    rows = [(i, [float(r.randint(-3, 3)) / 2 for _ in range(4 if i % 9 else 3)], 0 if i % 3 else r.randint(0, 3)) for i in range(0, 600)]
    odd = [(700, None, 1), (701, [1.0, None, 1.0, 1.0], 1), (702, [math.nan] * 4, 1), (703, [math.inf] * 4, 1), (704, [1.0] * 4, None), (None, [1.0] * 4, 0), (800, [], 1)]
    df = spark.createDataFrame([(*x, 0.5, 1) for x in rows + odd], VECTORS).repartition(3)
    expected = brute.op11(rows)
    assert expected
    for block, chunk, step in ((4096, 16_384, 8), (7, 2, 1)):
        for name, n in (("BLOCK", block), ("CHUNK", chunk), ("STEP", step), ("PART", 10 * block)):
            monkeypatch.setattr(negatives, name, n)
        got = negatives.mine(df, df.filter("vec_id % 100 = 0"))
        assert sorted(tuple(x[c] for c in NEGATIVES) for x in got.collect()) == expected
    # repeated candidates are repeated results, a repeated anchor is asked once
    twice = spark.createDataFrame([(0, [2.0, 0.0], 1), (0, [2.0, 0.0], 1), (1, [4.0, 0.0], 1), (2, [2.0, 0.0], 2), (2, [2.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    got = rows_of(negatives.mine(twice, twice.filter("vec_id = 0")), "positive_id", "rank", "negative_id")
    assert got == [(1, 1, 2), (1, 2, 2)]
    assert negatives.mine(df.limit(0), df.limit(0)).count() == 0 and negatives.mine(df, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(df, df, positives=0)


def test_negatives_beyond_doubles(spark):
    """Scores over 2**53 are exact; those that fit no long are told."""
    big = [(0, [1e5, 1.0], 0), (1, [2e5, 3.0], 0), (2, [1e5, 5.0], 1), (3, [1e5, 5.25], 1), (4, [-1e5, 1.0], 1)]
    df = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>, label int")
    scale = 1 << 14
    ints = {i: [math.floor(scale * x) for x in v] for i, v, _ in big}
    dot = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b]))
    got = rows_of(negatives.mine(df(big), df(big[:1]), scale=scale), "negative_id", "negative_score", "positive_score")
    assert got == sorted([(2, dot(0, 2), dot(0, 1)), (3, dot(0, 3), dot(0, 1))], key=str) and dot(0, 2) > 1 << 53
    with pytest.raises(Exception, match="fit a long"):
        negatives.mine(df([(0, [1e9], 0), (1, [1e9], 0)]), df([(0, [1e9], 0)]), scale=1 << 10).collect()


def test_bounds_hold_at_every_step():
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (20, 50))
    block = negatives.Columns(20, 8, np.arange(50).astype("<i8").tobytes(), np.zeros(50, "<i8").tobytes(), x.astype("<i8").tobytes())
    anchor, seen = r.integers(-300, 300, 20), []

    def watch(low, high):
        seen.append((low.copy(), high.copy()))
        return np.ones(len(low), bool)

    alive, score = block.scan(anchor, np.arange(50), watch)
    assert (score == anchor @ x).all() and len(alive) == 50
    widths = [(high - low).max() for low, high in seen]
    assert all((low <= score).all() and (score <= high).all() for low, high in seen) and widths == sorted(widths, reverse=True) and widths[-1] == 0


def test_op12(spark, data):
    rows = [tuple(r) for r in Q.documents(spark, data).select("doc_id", "text").collect()]
    expected = brute.op12(rows)
    assert rows_of(Q.op12_substrings(spark, data), *REPEATS) == expected and sum(x[2] for x in expected) > 1000


@pytest.mark.parametrize("crowded", [256, 1])
@pytest.mark.parametrize("window,gram", [(1, 1), (2, 1), (5, 3), (8, 4), (5, 5)])
def test_repeats_of_odd_texts(spark, monkeypatch, crowded, window, gram):
    """Passages in unlike contexts, copies, periods, nulls, repeated rows, one hot passage; few
    words a shard, several blocks."""
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    r = random.Random(7)
    base = [str(r.randint(0, 9)) for _ in range(60)]
    rows = [(1, None), (2, ""), (None, " \t\n"), (3, "a " * 300), (4, "x y z　w " * 9), (5, "one two"), (5, "one two"), (6, "A a A a " * 20)]
    for i in range(150):
        w = [str(r.randint(0, 40)) for _ in range(r.randint(0, 50))]
        if r.random() < 0.6:
            k = r.randint(0, 45)
            w[10:10] = base[k : k + r.randint(3, 15)] if r.random() < 0.5 else base[:14]
        rows.append((10 + i % 140, " ".join(w)))
    df = spark.createDataFrame([(*x, 0, "s") for x in rows], "doc_id long, text string, block int, segment string").repartition(3)
    out = substrings.drop_repeats(df, window, gram, texts=True, block_chars=2000).collect()
    expected = brute.op12(rows, window)
    assert sorted((tuple(x[c] for c in REPEATS) for x in out), key=str) == expected
    assert all(brute.sha(x.kept) == x.kept_sha256 and sum(y.end - y.start for y in x.removed) == x.n_removed for x in out)


def test_repeats_edges(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert substrings.drop_repeats(df.limit(0)).count() == 0
    for bad in (dict(window=0), dict(window=3, gram=4)):
        with pytest.raises(ValueError):
            substrings.drop_repeats(df, **bad)
    long = " ".join(str(n * n % 1009) for n in range(30_000))
    rows = [(1, long), (2, long[1000:9000]), (3, "other words " + long[20_000:20_300])]
    got = rows_of(substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")), *REPEATS)
    assert got == brute.op12(rows)


def test_index_against_counting():
    r = random.Random(2)
    for _ in range(60):
        texts = [np.array([r.randint(0, 3) for _ in range(r.randint(5, 40))], np.uint64) for _ in range(r.randint(1, 8))]
        w = r.randint(1, 5)
        seen = Counter(tuple(t[k : k + w]) for t in texts for k in range(len(t) - w + 1))
        for t, runs in zip(texts, substrings.FmIndex(texts).intervals(w)):
            assert {j for a, b in runs for j in range(a, b)} == {j for k in range(len(t) - w + 1) if seen[tuple(t[k : k + w])] > 1 for j in range(k, k + w)}
        flat = np.concatenate(texts).astype(np.int64)
        order = substrings.suffix_array(flat)
        assert order.tolist() == sorted(range(len(flat)), key=lambda k: flat[k:].tolist())
        tree = substrings.WaveletTree(flat, 4)
        at = np.array([r.randint(0, len(flat)) for _ in range(20)])
        symbol = np.array([r.randint(0, 3) for _ in range(20)])
        assert tree.rank(symbol, at).tolist() == [int((flat[:a] == s).sum()) for s, a in zip(symbol, at)]


def test_op13(spark, data):
    rows = [tuple(r) for r in Q.documents(spark, data).select("doc_id", "text").collect()]
    assert rows_of(Q.op13_alignment(spark, data), *ALIGNED) == brute.op13(rows, Q.byte_vocabulary(), Q.piece_model())


ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "word and <|more|> of it, cc by\n" * 400), (6, "ünïcødé ﬁ 　x ▁▁ \x00 😀 İ K"), (7, "<|endoftext|> a <s> </s> <0x41> <unk>"), (None, "no id"),
    (8, "a  b   c\n\n d \t e\x1c f \x85 g  h "), (9, "x"), (9, "x"), (10, "it's we'll 'a  's"), (11, " " * 50), (12, "\n \n  x\r\n y"), (13, "漢字 かな \U0010ffff é́"), (14, "long" * 5000),
]


def test_alignment_of_odd_texts(spark):
    r = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "b", "é", "ab", "'s", "1", "!", "漢", " ", "\x1c", "　", "▁", "<0x0A>", "\r", "x"]
    rows = ODD + [(100 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(1500)]
    df = spark.createDataFrame([(*x, 0, "s") for x in rows], "doc_id long, text string, block int, link string").repartition(3)
    expected = brute.op13(rows, Q.byte_vocabulary(), Q.piece_model())
    for chars in (1 << 24, 300):
        assert rows_of(alignment.align(df, Q.byte_vocabulary(), Q.piece_model(), chars), *ALIGNED) == expected
    assert alignment.align(df.limit(0), Q.byte_vocabulary(), Q.piece_model()).count() == 0


def test_whole_texts_align_as_chunks_do():
    a = alignment.Aligner(Q.byte_vocabulary(), Q.piece_model())
    assert a.cuts
    texts = [t for _, t in ODD if t]
    cut = [a.align(a.cut(t)) for t in texts]
    a.cuts = False
    for t, (numbers, groups, link, _) in zip(texts, cut):
        whole = a.align(a.cut(t))
        if numbers[:, 0].all():
            assert (whole[0][0] == numbers.sum(axis=0)).all() and whole[1][0] == ";".join(groups) and whole[2].tolist() == link.tolist()
        else:
            assert not whole[0][0].any()


def test_galloping():
    r = random.Random(3)
    for _ in range(300):
        a, b = (np.array(sorted(r.sample(range(200), r.randint(0, n))), np.int64) for n in (60, 150))
        i, j = alignment.common_ends(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))
        assert a[i].tolist() == b[j].tolist() == sorted({*a.tolist()} & {*b.tolist()})


def test_near_duplicates_meet_an_exact_join(spark, data):
    """Pairs of unlike texts that an exact join on 5-word shingles finds at 0.8 or more: nearly all of
    them are in one group, also of those under 0.825."""
    docs = Q.documents(spark, data.replace("sf0.001", "sf0.1"))
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        sets.setdefault(np.unique(simhash.shingle_hashes(r.text, 5)).tobytes(), r.doc_id)
    sets = {i: np.frombuffer(h, np.uint64) for h, i in sets.items()}
    values, counts = np.unique(np.concatenate([*sets.values()]), return_counts=True)
    lists = defaultdict(list)
    for i, h in sets.items():
        rare = np.argsort(counts[np.searchsorted(values, h)], kind="stable")
        for v in h[rare[: len(h) // 5 + 1]].tolist():
            lists[v].append(i)
    pairs = {(a, b) for x in lists.values() for k, b in enumerate(x) for a in x[:k]}
    alike = [(a, b, s) for a, b in pairs if (s := simhash.jaccard(sets[a], sets[b])) >= 0.8]
    keyed = docs.withColumn("tk", simhash.F.xxhash64("text"))
    root = {r.doc_id: r.root for r in simhash._roots(keyed, "tk", 5, 10, 0.8, simhash.TABLES).collect()}
    met = [(s, root[a] == root[b]) for a, b, s in alike]
    low = [ok for s, ok in met if s < 0.825]
    assert len(met) >= 40 and len(low) >= 15
    assert sum(ok for _, ok in met) >= 0.95 * len(met) and sum(low) >= 0.9 * len(low)


def test_stages_take_what_their_queries_take(spark):
    """Rows of equal id and text: other sources are other rows, other columns decide in a fixed order."""
    r = random.Random(1)
    rows = [(i % 9, f"w{i % 9} " * (1 + i % 4), "en", f"s{i % 3}", i) for i in range(60)] + [(None, "a b", "en", None, 1), (None, "a b", "en", "s1", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = ("doc_id", "source")
    size = lambda x: tuple(x[k] for k in key)
    query, stage = Counter(), Counter()
    for x in mixing.mix_documents(df).collect():
        query[(*size(x), x["size"])] += x.times
    first = [tuple(x) for x in mixing.sample_documents(df.repartition(5)).collect()]
    for x in first:
        stage[(x[0], x[3], len(x[1].split()))] += 1
    assert +stage == +query and len(query) > 30
    r.shuffle(rows)
    again = spark.createDataFrame(rows, df.schema).repartition(3)
    assert Counter(first) == Counter(tuple(x) for x in mixing.sample_documents(again).collect())
    stay = lambda d: Counter(tuple(x) for x in simhash.drop_near_duplicates(d, 5, 10, 0.8).collect())
    assert stay(df) == stay(again) and max(stay(df).values()) == 1


def licence_spans(text):
    """Labels and score by plain loops: hits of 2-grams, diagonals, merged ones, rising runs."""
    words = brute.re.findall(licenses.WORD, (text or "").translate(brute.UP))
    labels, score = set(), 0.0
    for n, (template, label) in enumerate([*licenses.PHRASES.items(), *licenses.NOTICES.items()]):
        t = template.split()
        at = defaultdict(list)
        for k, g in enumerate(zip(t, t[1:])):
            at[g].append(k)
        hits = [(pos, a) for pos, g in enumerate(zip(words, words[1:])) for a in at.get(g, ())]
        by = defaultdict(set)
        for pos, a in hits:
            by[pos - a].add(a)
        full, drift = len(t) - 1, min(licenses.DRIFT, len(t) // 4)
        if any(len(x) == full for x in by.values()):
            labels.add(label)
            score = 1.0
        if n < len(licenses.PHRASES):
            continue
        islands, before = [], None
        for d in sorted(by):
            if before is None or d - before > drift:
                islands.append([])
            islands[-1].append(d)
            before = d
        for island in islands:
            if any(len(by[d]) == full for d in island):
                continue
            best = 0
            for d in island:
                own = sorted((e + a, -a) for e in island if d <= e <= d + drift for a in by[e])
                if len({a for _, a in own}) < licenses.SHARE * full:
                    continue
                run = [0] * full
                for _, back in own:
                    run[-back] = max(run[-back], 1 + max(run[:-back], default=0))
                best = max(best, max(run))
            if best / full >= licenses.SHARE:
                labels.add(label)
                score = max(score, best / full)
    return ",".join(sorted(labels)), round(score, 9)


def test_licence_labels_and_scores(spark, data):
    r = random.Random(5)
    texts = ["public license mozilla public", "rights reserved all rights", "public license eclipse public", "mozilla public license", "mozilla public x license"]
    notices = list(licenses.NOTICES)
    for _ in range(300):
        w = r.choice(notices).split()
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(w) + 1)
            if r.random() < 0.5:
                w[k:k] = r.choice((["so"], ["the", "license"], ["all", "rights"], w[:4]))
            elif k < len(w):
                del w[k]
        if r.random() < 0.3:
            k = r.randrange(len(w))
            w = w[k:] + w[:k]
        texts.append(" ".join(r.choice((["x"], [], ["of", "the"])) + w + r.choice(([], ["public", "license"]))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.scan(df).collect()}
    assert got == {k: licence_spans(t) for k, t in enumerate(texts)}
    assert [got[k] for k in range(4)] == [("", 0.0)] * 3 + [("mpl", 1.0)]
    assert 20 < sum(0 < s < 1 for _, s in got.values())
    whole = {x.doc_id: (x.labels, round(x.score, 9)) for x in Q.op5_licenses(spark, data).collect()}
    assert whole == {x.doc_id: licence_spans(x.text) for x in Q.documents(spark, data).collect()}


def test_alignment_takes_new_chunks_in_parts(monkeypatch):
    """However many new words a batch brings, the libraries get a bounded part of them at once."""
    a = alignment.Aligner(Q.byte_vocabulary(), Q.piece_model())
    seen, whole = [], a.align
    monkeypatch.setattr(a, "align", lambda chunks: (seen.append(sum(map(len, chunks))), whole(chunks))[1])
    texts = [" ".join(f"word{n}x{k}" for k in range(2_000)) for n in range(20)]
    block = alignment._Block(0)
    got = block.add(a, list(range(20)), texts).to_pylist()
    assert len(seen) > 1 and max(seen) < 140_000
    alone = [alignment._Block(0).add(a, [n], [t]).to_pylist()[0] for n, t in enumerate(texts)]
    assert [(r["n_links"], r["groups_sha256"]) for r in got] == [(r["n_links"], r["groups_sha256"]) for r in alone]
