"""Spelling groups against all pairs."""

import itertools
import zlib
from collections import Counter

import pytest

from tidemark.llm.common import prepare
from tidemark.llm.pivotgrams import SpellingRule, pivots, spelling_groups


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, letters=6, least=5, slip=199):
    import re

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(table)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    near = {w: [] for w in n}
    shapes = {}
    for w in n:  # one-wildcard and one-deletion shapes find all pairs one edit apart
        for k in range(len(w)):
            shapes.setdefault(w[:k] + "*" + w[k + 1 :], set()).add(w)
            shapes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        shapes.setdefault(w, set()).add(w)
    pairs = {p for s in shapes.values() for p in itertools.permutations(s, 2) if one_edit(*p)}
    for a, b in pairs:
        near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_all_documents_match_all_pairs(spark, folder):
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling_groups(docs)) == brute(rows)


def test_dense_words_match_all_pairs(spark):
    prepare(spark)
    words = {"".join(w) for w in itertools.product("ab", repeat=7)} | {"".join(w) for w in itertools.product("ab", repeat=6)}
    text = " ".join(w for k, w in enumerate(sorted(words)) for _ in range(5 + 23 * (k % 7)))
    rows = [(1, text), (2, "statión station Station STATIOÑ " * 6), (3, None), (4, ""), (4, "aaaaaaé " * 9)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    assert got(spelling_groups(df)) == brute(rows)


def test_long_words_and_chain_of_forms(spark):
    prepare(spark)
    long = "q" * 3000
    chain = "abcdefg " * 2000 + "abcdefh " * 300 + "abcdeih " * 50 + "abcjeih " * 8
    rows = [(7, chain), (8, f"{long} {long}x " * 5), (9, f"{long} " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(spelling_groups(df))
    assert found == brute(rows)
    assert ("abcjeih", "abcdeih", "abcdefg") in {r[:3] for r in found}


def test_no_words(spark):
    prepare(spark)
    df = spark.createDataFrame([(None, None), (1, ""), (2, "few")], "doc_id long, text string")
    assert spelling_groups(df, SpellingRule()).count() == 0
    assert spelling_groups(df.where("false")).count() == 0


@pytest.mark.parametrize("prefix, expected", [([(0, 5), (1, 1), (4, 3)], [1, 4]), ([(0, 1), (1, 9), (2, 1)], [0, 2]), ([(0, 2), (2, 2), (5, 1)], [0, 5])])
def test_pivots_are_disjoint_and_lightest(prefix, expected):
    assert pivots(prefix) == expected
