"""Spelling variants by pivotal bigrams.

Bigrams are ordered by rarity. Two words one edit apart share a bigram that is a pivot of the one and in the prefix of the
other: an edit spoils at most one of two disjoint bigrams, and the prefix is long enough to hold two of those. The word's
prefix is its three rarest bigrams (and any of the same rank), its pivots are the two disjoint ones of them that occur least,
found by dynamic programming. Position limits make the index selective: all text on one side of a surviving bigram is
unchanged, and of the other side at least one half is. What meets in the index is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_ASCII, as_bytes, cut_lineage

RUN = re.compile("[a-zÀ-ÿ]+")


@dataclass(frozen=True)
class SpellingRule:
    """Words of at least ``letters`` code points and ``least`` occurrences; a form has ``times`` the occurrences of its variant.

    ``slip``: a run loses a letter in a document if this number divides its hash; 0 leaves all runs as they are.
    """

    letters: int = 6
    least: int = 5
    times: int = 5
    slip: int = 199
    #: a touched side of at most so many letters is not halved
    whole: int = 3
    #: words a task holds before it hands on their counts
    held: int = 200_000


def slipped(run: str, start: int, slip: int) -> str:
    """The run as its document has it; ``start`` is the checksum of the document's id and a colon."""
    h = zlib.crc32(run.encode(), start)
    if slip and h % slip == 0:
        k = h % len(run)
        return run[:k] + run[k + 1 :]
    return run


def _counts(batches, rule: SpellingRule):
    import pyarrow as pa

    totals: Counter = Counter()

    def batch_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, raw in zip(batch["doc"].to_pylist(), as_bytes(batch["text"]), strict=True):
            if not raw:
                continue
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            text = raw.translate(LOWER_ASCII).decode()
            runs = RUN.findall(text) if len(text) < 1 << 22 else (m.group() for m in RUN.finditer(text))
            for run, n in Counter(runs).items():
                if len(run) >= rule.letters:
                    word = slipped(run, start, rule.slip)
                    if len(word) >= rule.letters:
                        totals[word] += n
            if len(totals) >= rule.held:
                yield batch_of(totals)
                totals = Counter()
    if totals:
        yield batch_of(totals)


def vocabulary(docs: DataFrame, rule: SpellingRule = SpellingRule()) -> DataFrame:
    """word, n: occurrences over all documents. Null and empty texts have no words; a null id counts as an empty one."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(lambda b: _counts(b, rule), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.least)


def pivots(prefix: list[tuple[int, int]]) -> list[int]:
    """Positions of the two disjoint bigrams of least total weight. ``prefix``: (position, weight), by position.

    least[i] is the lightest bigram among the first i; the best pair that ends at a bigram takes the lightest before it that
    does not overlap it.
    """
    best, chosen = None, []
    least: list[tuple[int, int]] = []  # (weight, position) of the lightest of the first bigrams
    for i, (at, weight) in enumerate(prefix):
        apart = i - 1
        while apart >= 0 and prefix[apart][0] > at - 2:
            apart -= 1
        if apart >= 0 and (best is None or least[apart][0] + weight < best):
            best, chosen = least[apart][0] + weight, [least[apart][1], at]
        least.append(min((weight, at), least[-1]) if least else (weight, at))
    return chosen


def _side_keys(kept: str, touched: str, side: int, whole: int):
    """(role, key) of one bigram when the edit lies in ``touched``: role 0 for a partner of equal length, 1 for a longer one
    and 2 for a shorter one. Keys carry the shorter word's length of the touched side, whose halves are compared."""
    for role in (0, 1, 2):
        short = len(touched) - (role == 2)
        if short < 0:
            continue
        law = (short << 4) | (side << 3) | (4 if role else 0)
        if short <= whole:
            yield role, xxhash.xxh3_64_intdigest(kept.encode(), law)
        else:
            half = short // 2
            rest = short - half
            near, far = (touched[:half], touched[-rest:]) if side else (touched[-half:], touched[:rest])
            yield role, xxhash.xxh3_64_intdigest(f"{kept}\0{near}".encode(), law | 1)
            yield role, xxhash.xxh3_64_intdigest(f"{kept}\0{far}".encode(), law | 2)


def gram_keys(word: str, at: int, whole: int):
    """Index keys of the bigram at ``at``: edit to its right, edit to its left."""
    yield from _side_keys(word[: at + 2], word[at + 2 :], 1, whole)
    yield from _side_keys(word[at:], word[:at], 0, whole)


def prefix_of(word: str, weight: dict[str, int]) -> list[tuple[int, int]]:
    """(position, weight) of the three rarest bigrams and those of the same rank as the third, by position."""
    grams = [(weight[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1)]
    last = sorted(grams)[min(2, len(grams) - 1)][:2]
    return [(i, w) for w, g, i in grams if (w, g) <= last]


#: A probe of one role meets index entries of the other word's role.
PARTNER = (0, 2, 1)


def _entries(batches, weight: dict[str, int], whole: int):
    """word, n, probe (null for an index entry), role and key."""
    import pyarrow as pa

    for batch in batches:
        words, ns = batch["word"].to_pylist(), batch["n"].to_pylist()
        for lo in range(0, len(words), 500):
            rows, counts, keys, probes = [], [], [], []
            for word, n in zip(words[lo : lo + 500], ns[lo : lo + 500], strict=True):
                prefix = prefix_of(word, weight)
                own = pivots(prefix)
                seen = set()
                for at, _ in prefix:
                    for role, key in gram_keys(word, at, whole):
                        seen.add((False, (key + role) & ((1 << 64) - 1)))
                        if at in own:
                            seen.add((True, (key + PARTNER[role]) & ((1 << 64) - 1)))
                for probe, key in seen:
                    rows.append(word)
                    counts.append(n)
                    probes.append(probe)
                    keys.append(key - (1 << 64) if key >> 63 else key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.string()), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.array(probes, pa.bool_())],
                ["word", "n", "key", "probe"],
            )


def near_pairs(words: DataFrame, rule: SpellingRule = SpellingRule()) -> DataFrame:
    """word, n, other, other_n: both directions of all pairs of ``words`` (word, n: distinct) exactly one edit apart.

    The weights of bigrams are their numbers of words: at most 90 squared rows, as the alphabet has 90 letters.
    """
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    weight = {r.gram: r.n for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not weight:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).where("false")
    shared = words.sparkSession.sparkContext.broadcast(weight)
    entries = words.select("word", "n").mapInArrow(
        lambda b: _entries(b, shared.value, rule.whole), "word string, n bigint, key bigint, probe boolean"
    )
    entries = cut_lineage(entries)
    index = entries.where("NOT probe").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = entries.where("probe").select("key", "word", "n").join(index, "key").where("word <> other")
    found = met.where(F.levenshtein("word", "other", 1) == 1)
    pair = found.select(
        F.least("word", "other").alias("a"),
        F.greatest("word", "other").alias("b"),
        F.when(F.col("word") < F.col("other"), F.col("n")).otherwise(F.col("other_n")).alias("n_a"),
        F.when(F.col("word") < F.col("other"), F.col("other_n")).otherwise(F.col("n")).alias("n_b"),
    ).distinct()
    return pair.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
                F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
            )
        ).alias("p")
    ).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form (word, form). Each step doubles the way; a form is more frequent than its
    variant by a factor, so the way is at most the logarithm of the corpus."""
    here = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = here.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        moved = here.join(step, F.col("root") == F.col("__at"), "left")
        there = cut_lineage(moved.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        if not there.where("moved").limit(1).count():
            return there.select("word", "root")
        here = there.select("word", "root")


def spelling_groups(docs: DataFrame, rule: SpellingRule = SpellingRule()) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``docs`` (doc_id, text; other columns are not read).

    near: exactly one code point inserted, deleted or replaced. form: the near word of largest n, the smallest of equal ones,
    if it has ``rule.times`` the occurrences; else null, as is form_n. root: the last of the chain of forms, the word itself
    without one. Null and empty texts add nothing, repeated rows count again, and no words give no rows.
    """
    words = cut_lineage(vocabulary(docs, rule))
    best = near_pairs(words, rule).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    )
    joined = words.join(best, "word", "left")
    enough = -F.col("best.less") >= rule.times * F.col("n")
    judged = cut_lineage(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
