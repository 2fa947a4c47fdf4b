"""Quality rules as weak supervision. DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). A naive Bayes label model with
one accuracy per rule and a class share is fitted by expectation-maximisation on
the counts of vote patterns (at most 3 to the number of rules, whatever the
input), and a document's posterior probability of being good replaces the test
that all rules pass. Documents that fail a hard base rule are never kept.

Null text has no words. Counts of repeated words come from 8-word windows, hashed
twice over within the row; no window leaves its document. Repeated rows vote
repeatedly; a null id is an id. An empty table gives an empty result. Whole texts are
measured, however long; columns other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import SPACE, SPACE_CHARS, materialize

SYMBOLS = "[#*$%&|<>]"
SYMBOL_CHARS = "#*$%&|<>"
WINDOW = 8
ROUNDS, KEEP_AT = 12, 0.5


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars_all."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"))
    d = d.withColumn("w", F.array_remove(F.split("t", f"[{SPACE}]+"), ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOL_CHARS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # hashes of 2, 4 and then 8 words in a row; pairing with the shifted array leaves nulls at the end, which fall off
    for step in (1, 2, 4):
        d = d.withColumn("h", F.expr(f"case when size(h) > {step} then zip_with(slice(h, 1, size(h) - {step}), slice(h, {step} + 1, size(h) - {step}), (a, b) -> xxhash64(a, b)) else array() end"))
    d = d.withColumn("repeats", F.size("h") > F.size(F.array_distinct("h")))
    sorted_at = F.expr("sort_array(transform(h, (x, i) -> struct(x as x, i as i)))")
    d = d.withColumn("s", F.when(F.col("repeats"), sorted_at))
    # a window is found twice if a neighbour in hash order is equal; starts go back into text order
    twice = F.expr("""sort_array(transform(filter(transform(s, (e, k) -> struct(e.i as i,
        coalesce(get(s, k - 1).x = e.x, false) or coalesce(get(s, k + 1).x = e.x, false) as r)), e -> e.r), e -> e.i))""")
    d = d.withColumn("at", twice)
    covered = F.expr(f"aggregate(zip_with(at, slice(at, 2, size(at)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (acc, x) -> acc + x)")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes on the columns of ``features``. Thresholds are rates, so they hold at any length."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    mean = c("word_chars") / n
    return {
        "length": _vote(c("n_words") >= 50, c("n_words") < 20),
        "word_size": _vote(mean.between(3.0, 9.0), (mean < 2.5) | (mean > 12.0)),
        "symbols": _vote(c("n_symbols") <= 0.02 * n, c("n_symbols") > 0.1 * n),
        "dup_lines": _vote(c("n_dup_lines") <= 0.1 * F.greatest(c("n_lines"), F.lit(1)), c("n_dup_lines") > 0.3 * F.greatest(c("n_lines"), F.lit(1))),
        "repeats": _vote(c("n_repeat_words") <= 0.05 * n, c("n_repeat_words") > 0.2 * n),
        "lines": F.when(c("n_words") < 20, 0).otherwise(_vote(c("n_words") >= 5 * c("n_lines"), c("n_words") < 2 * c("n_lines"))),
    }


def fit_label_model(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, float]]:
    """Class share and rule accuracies from vote columns ``names``, by expectation-
    maximisation. Spark counts the patterns of votes; at most 3 to the number of rules
    of them, whatever the input, come to the driver, where the rounds run."""
    patterns = [tuple(r) for r in votes.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    share, accuracy = 0.8, [0.8] * len(names)
    for _ in range(rounds if patterns else 0):
        total = good = 0.0
        right, cast = [0.0] * len(names), [0] * len(names)
        for *vote, n in sorted(patterns):
            logit = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(vote, accuracy))
            p = 1 / (1 + math.exp(-logit))
            total, good = total + n, good + n * p
            for k, v in enumerate(vote):
                if v:
                    right[k] += n * (p if v == 1 else 1 - p)
                    cast[k] += n
        # a rule is taken to be better than chance, and no estimate becomes certain
        share = min(0.99, max(0.01, (good + 1) / (total + 2)))
        accuracy = [min(0.98, max(0.55, (r + 2) / (c + 3))) for r, c in zip(right, cast)]
    return share, dict(zip(names, accuracy))


def posterior(share: float, accuracy: dict[str, float]) -> Column:
    """Column: probability of good, given the votes."""
    logit = F.lit(math.log(share / (1 - share)))
    for k, a in accuracy.items():
        logit = logit + F.col(k) * math.log(a / (1 - a))
    return 1 / (1 + F.exp(-logit))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rounds: int = ROUNDS, keep_at: float = KEEP_AT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the features, base_failed, ``quality`` (the
    posterior) and kept (false if base_failed, else quality >= keep_at)."""
    measured = materialize(features(docs))
    votes = measured.withColumns(rules())
    share, accuracy = fit_label_model(votes, list(rules()), rounds)
    return votes.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (posterior(share, accuracy) >= keep_at)).alias("kept"),
        posterior(share, accuracy).alias("quality"),
    )
