"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each, the posterior decides.

A rule never decides alone. The label model (Dawid and Skene, one latent class per document, rules independent given the
class) learns from vote patterns how often each rule votes against good and against bad documents. Only pattern counts,
at most 3 to the number of rules, are gathered; they are computed over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes, window_hashes, word_hashes

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper_words", "n_end_marks", "n_symbol_words", "n_other_chars",
]
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
SYMBOLS = b"#*$%&|<>"
#: White space, letters and digits, and all beyond ASCII.
PLAIN = bytes(c for c in range(256) if c <= 32 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)


def repeat_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    windows = window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[at] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The counts named in COUNTS; all 0 for null or empty texts."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    chars = np.frombuffer(b"".join(words), np.uint8)
    seen: set[bytes] = set()
    repeated = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    hashes = word_hashes(words)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    marks = sum(1 for w in words if w.endswith((b"!", b"?", b"...")))
    return (
        len(words),
        int(np.count_nonzero((chars & 0xC0) != 0x80)),
        len(text) - len(text.translate(None, SYMBOLS)),
        repeated,
        repeat_words(hashes),
        lines,
        len(np.unique(hashes)),
        upper,
        marks,
        sum(1 for w in words if w[-1] in SYMBOLS or w[0] in SYMBOLS),
        len(text.translate(None, PLAIN)),
    )


@F.arrow_udf(STATS)
def count_text(column):
    """Text to the struct of COUNTS."""
    import pyarrow as pa

    rows = np.array([text_counts(x) for x in as_bytes(column)], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(len(COUNTS))], COUNTS)


@dataclass(frozen=True)
class Rule:
    """A rule votes -1 where ``against`` holds, else 1 where ``favour`` holds, else 0."""

    name: str
    against: Callable[[dict[str, Column]], Column]
    favour: Callable[[dict[str, Column]], Column]

    def vote(self, x: dict[str, Column]) -> Column:
        return F.when(self.against(x), -1).when(self.favour(x), 1).otherwise(0)


#: Rules on shares, so that document length does not matter. Between the two bounds a rule abstains.
RULES = [
    Rule("symbols", lambda x: x["n_symbols"] * 10 > x["n_words"], lambda x: x["n_symbols"] * 50 < x["n_words"]),
    Rule("symbol_words", lambda x: x["n_symbol_words"] * 10 > x["n_words"] * 2, lambda x: x["n_symbol_words"] * 50 < x["n_words"]),
    Rule("other_characters", lambda x: x["n_other_chars"] * 10 > x["word_chars"], lambda x: x["n_other_chars"] * 20 < x["word_chars"]),
    Rule("duplicate_lines", lambda x: x["n_dup_lines"] * 10 > x["n_lines"] * 3, lambda x: x["n_dup_lines"] * 20 < x["n_lines"]),
    Rule("repeats", lambda x: x["n_repeat_words"] * 10 > x["n_words"] * 3, lambda x: x["n_repeat_words"] * 10 < x["n_words"]),
    Rule(
        "word_length",
        lambda x: (x["word_chars"] < x["n_words"] * 3) | (x["word_chars"] > x["n_words"] * 12),
        lambda x: (x["word_chars"] >= x["n_words"] * 4) & (x["word_chars"] <= x["n_words"] * 8),
    ),
    Rule("capitals", lambda x: x["n_upper_words"] * 10 > x["n_words"] * 4, lambda x: x["n_upper_words"] * 10 < x["n_words"]),
    Rule("end_marks", lambda x: x["n_end_marks"] * 10 > x["n_words"] * 3, lambda x: x["n_end_marks"] * 10 < x["n_words"]),
    Rule(
        "variety",
        # a text of n words from a natural vocabulary holds far more than 2 sqrt(n) different ones
        lambda x: x["n_distinct_words"] * x["n_distinct_words"] < x["n_words"] * 4,
        lambda x: x["n_distinct_words"] * x["n_distinct_words"] > x["n_words"] * 16,
    ),
]
MIN_WORDS = 50
#: How often a rule is believed to vote against good and bad documents before any are seen.
BELIEF_GOOD, BELIEF_BAD = 0.005, 0.3


def base_failed(x: dict[str, Column]) -> Column:
    """Under MIN_WORDS words, or more than half of them in repeated windows."""
    return (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > 50 * x["n_words"])


@dataclass(frozen=True)
class LabelModel:
    """The prior of good and, for each rule, how often it votes against good and against bad documents when it votes."""

    prior_good: float
    against_good: tuple[float, ...]
    against_bad: tuple[float, ...]

    def accuracy(self) -> list[float]:
        """Share of right votes of each rule."""
        p = self.prior_good
        return [p * (1 - g) + (1 - p) * b for g, b in zip(self.against_good, self.against_bad, strict=True)]

    def log_odds(self, votes: list[Column]) -> Column:
        total = F.lit(math.log(self.prior_good / (1 - self.prior_good)))
        for vote, g, b in zip(votes, self.against_good, self.against_bad, strict=True):
            total = total + F.when(vote < 0, math.log(g / b)).when(vote > 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return total

    def probability(self, votes: list[Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, trust: float = 0.05) -> LabelModel:
    """EM over vote patterns (``votes``: patterns x rules in -1, 0, 1; ``counts``: documents of each).

    Abstaining says nothing. Which class is the good one, and that votes against good documents are rare, no vote can tell:
    that belief (BELIEF_GOOD) enters as if ``trust`` of the documents had confirmed it; what bad documents look like is left to
    the votes but for one pseudo-document. So the fit is the same for any number of documents with the same shares of patterns.
    No documents: the belief itself.
    """
    m, total = votes.shape[1], counts.sum()
    g, b, prior = np.full(m, BELIEF_GOOD), np.full(m, BELIEF_BAD), 0.8
    decided, against = (votes != 0).astype(float), (votes < 0).astype(float)
    for _ in range(rounds if total else 0):
        odds = math.log(prior / (1 - prior)) + against @ np.log(g / b) + (decided - against) @ np.log((1 - g) / (1 - b))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        before = prior
        prior = float((counts @ good + 0.8) / (total + 1))
        g = ((counts * good) @ against + trust * total * BELIEF_GOOD) / ((counts * good) @ decided + trust * total)
        b = ((counts * (1 - good)) @ against + BELIEF_BAD) / ((counts * (1 - good)) @ decided + 1)
        if abs(prior - before) < 1e-10:
            break
    return LabelModel(prior, tuple(map(float, np.clip(g, 1e-9, 1 - 1e-9))), tuple(map(float, np.clip(b, 1e-9, 1 - 1e-9))))


def vote_columns(x: dict[str, Column], rules: list[Rule] = RULES) -> list[Column]:
    return [rule.vote(x) for rule in rules]


def learn(counted: DataFrame, rules: list[Rule] = RULES) -> LabelModel:
    """Fit the label model on all rows of ``counted`` (the columns of COUNTS) that pass the base rules."""
    x = {c: F.col(c) for c in COUNTS}
    names = [r.name for r in rules]
    # failing documents are told apart in the key: a filter would count every text once more
    patterns = (
        counted.select(base_failed(x).alias("failed"), *[v.alias(n) for n, v in zip(names, vote_columns(x, rules), strict=True)])
        .groupBy("failed", *names).count().collect()
    )
    passed = [p for p in patterns if not p["failed"]]
    votes = np.array([[p[n] for n in names] for p in passed], np.int64).reshape(-1, len(rules))
    return fit_label_model(votes, np.array([p["count"] for p in passed], float))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of COUNTS, one row per document row."""
    return docs.select("doc_id", count_text(F.col("text")).alias("__c")).select("doc_id", "__c.*")


def judge(counts: DataFrame, model: LabelModel, rules: list[Rule] = RULES) -> DataFrame:
    """Add base_failed, p_good (posterior probability) and kept to a table of counts.

    A document is kept if the base rules pass and p_good is at least 0.5. Null and empty texts have no words, so they fail.
    """
    x = {c: F.col(c) for c in COUNTS}
    return counts.withColumn("base_failed", base_failed(x)).withColumn(
        "p_good", model.probability(vote_columns(x, rules))
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judge` keeps; learned on ``docs`` itself.

    Rows are judged in place: repeated ids, null ids and other columns do not matter.
    """
    model = learn(counted(docs.select("doc_id", "text")), rules)
    c = count_text(F.col("text"))
    x = {name: c[name] for name in COUNTS}
    return docs.where(~base_failed(x) & (model.probability(vote_columns(x, rules)) >= 0.5))
