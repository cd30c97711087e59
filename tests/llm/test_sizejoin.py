"""The size-aware join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import prepare
from tidemark.llm.sizejoin import JoinRule, _meetings, block_links, boundary, set_join, subset_keys

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    w = min(width, len(words))
    return frozenset(tuple(words[i : i + w]) for i in range(len(words) - w + 1))


def brute(rows, width=4, least=85, of=100):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    seen = set()
    for ids in lists.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if of * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                        up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_all_documents_match_all_pairs(spark, folder):
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(set_join(docs)) == brute(rows)


def near_copies(seed, groups, copies, low, high):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{g}x{draw.randrange(10**6)}" for _ in range(draw.randint(low, high))]
        for _ in range(copies):
            own = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                k = draw.randrange(len(own) + 1)
                own[k : k + draw.randrange(2)] = [f"z{draw.randrange(10**6)}"] * draw.randrange(2)
            rows.append((draw.randrange(10**9), " ".join(own)))
    return rows


@pytest.mark.parametrize("low, high", [(3, 14), (8, 30), (60, 140)])
def test_small_and_large_sets(spark, low, high):
    prepare(spark)
    rows = near_copies(low, 40, 6, low, high) + [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (None, "lone null"), (None, "one")]
    df = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, n int, digest binary")
    assert got(set_join(df)) == brute(rows)


def test_group_over_many_blocks(spark):
    """Blocks of eight sets: links between blocks are found by hubs and visits."""
    prepare(spark)
    rows = near_copies(5, 3, 60, 70, 90)
    shared = " ".join(f"passage{k}" for k in range(60))
    rows += [(10**9 + k, shared + " " + " ".join(f"p{k}q{j}" for j in range(8 + k % 5))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(set_join(df, JoinRule(block_sets=8))) == brute(rows)


def test_repeated_ids_and_no_rows(spark):
    prepare(spark)
    a, b = "a b c d e f", "g h i j k l"
    rows = [(3, a), (5, a), (5, b), (7, b), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(set_join(df)) == brute(rows)
    assert set_join(df.where("false")).count() == 0


def test_subset_keys_meet_only_in_equal_subsets():
    a, b = np.array([1, 2, 3, 9], np.uint64), np.array([1, 2, 3, 7], np.uint64)
    assert len(set(subset_keys(a, 3)) & set(subset_keys(b, 3))) == 1
    assert not set(subset_keys(a, 4)) & set(subset_keys(b, 4))


def test_boundary_follows_cost():
    rule = JoinRule()
    assert boundary({}, rule) == 0
    assert 5 <= boundary({n: 1000 for n in range(1, 25)}, rule) < 24
    assert rule.need(20, 17) == 17 and rule.together(17) == 37


def test_scan_links_what_sets_say():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], draw.integers(0, 2**63, k % 7).astype(np.uint64)])) for k in range(12)]
    linked = {i for pair in block_links(sets, np.zeros(12, bool), JoinRule()) for i in pair[:2]}
    true = {i for i in range(12) for j in range(12) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert linked == true


def test_sets_with_too_few_lists_in_common_do_not_visit(spark):
    """Of 300 shingles each, linked sets share 22 lists at least: with two in common no text is sent, with 22 both are."""
    rule = JoinRule()
    for common, names in ((2, []), (10, []), (22, [1, 2])):
        rows = [(key, 0, name, 300, 40, bytes([name])) for key in range(common) for name in (1, 2)]
        keyed = spark.createDataFrame(rows, "key long, block int, name long, n int, shared long, component binary")
        guests = keyed.where("name = 2").select("key", "name", "n", "shared", keyed.component.alias("own"))
        spots = keyed.groupBy("key", "block").agg(
            *[F.expr(e) for e in ("min(component) AS lo", "max(component) AS hi", "min(n) AS n_lo", "max(n) AS n_hi", "max(shared) AS most")]
        )
        visits, hosts = _meetings(keyed, guests, spots, rule)
        assert [r.name for r in visits.collect()] == names[1:] and sorted(r.name for r in hosts.collect()) == names
