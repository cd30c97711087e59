"""Token alignment against whole-text encodings and all pairs."""

import hashlib
import json
from collections import Counter

import pytest

from tidemark.llm import tokenalign
from tidemark.llm.common import prepare
from tidemark.llm.queries import align_models


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    models = align_models()
    a_side = Tokenizer.from_file(models.a)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=models.b)
    name = {v: k for k, v in json.load(open(models.a))["model"]["vocab"].items()}
    letters = tokenalign.byte_letters()

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for doc, text in rows:
        groups, links = [], []
        if text:
            raw = (" " + text).encode()
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            ab, bb = [bytes(letters[c] for c in name[i]) for i in a], [b_bytes(i) for i in b]
            if b"".join(ab) == raw and b"".join(bb) == raw:
                i = j = 0
                while i < len(a):
                    ga, gb, x, y = [a[i]], [b[j]], len(ab[i]), len(bb[j])
                    i, j = i + 1, j + 1
                    while x != y:
                        if x < y:
                            ga.append(a[i])
                            x, i = x + len(ab[i]), i + 1
                        else:
                            gb.append(b[j])
                            y, j = y + len(bb[j]), j + 1
                    groups.append((ga, gb))
                    links += [(p, q) for p in ga for q in gb]
        docs.append((doc, groups, links))
    held = Counter(p for _, _, links in docs for p in set(links))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for doc, groups, links in docs:
        joined = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(joined.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  lead and  two\n\n new \t tab \r\n"), (5, "under▁score"), (6, "nul\x00 and \x1c x"),
    (7, "<|endoftext|> <s> </s> <unk> <0x0A> it's we'll THEY'RE"), (8, "　wide   nbsp  x"), (9, "é ﬁ \U0001f469‍\U0001f4bb café"),
    (9, "twice the id"), (None, "no id"), (None, "no id"), (10, "a" * 5000), (11, "中文" * 400), (12, "x" + " " * 700 + "y  "), (13, "1234567890 3.14 -7"),
    (14, "\U0001f600" * 300 + "กำ" * 300),
]


def test_odd_texts(spark):
    prepare(spark)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in ODD], "doc_id long, text string, row int, pair string")
    assert got(tokenalign.align(df, align_models())) == brute(ODD)


def test_texts_that_end_in_one_space(spark):
    prepare(spark)
    rows = [(1, "ends in a space "), (2, "x "), (3, "é "), (4, "line\n next "), (5, "中 "), (6, "two  "), (7, "ends in a space"), (8, " ")]
    found = got(tokenalign.align(spark.createDataFrame(rows, "doc_id long, text string"), align_models()))
    assert found == brute(rows)
    assert all(row[1] for row in found)


def test_all_documents(spark, folder):
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(tokenalign.align(docs, align_models())) == brute(rows)


def test_no_documents(spark):
    prepare(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenalign.align(df, align_models()).count() == 0


@pytest.mark.parametrize("links", [1, 7, 100])
def test_slices_of_links_change_nothing(links, monkeypatch):
    import pyarrow as pa

    units = tokenalign.Units(align_models())
    names = [pa.array([str(i) for i in range(len(n))], pa.large_string()) for n in (units.length_a, units.length_b)]
    texts = [t for _, t in ODD]
    whole = tokenalign.aligned(units, texts, *names)
    monkeypatch.setattr(tokenalign, "SLICE_LINKS", links)
    assert {k: v.to_pylist() for k, v in tokenalign.aligned(units, texts, *names).items()} == {k: v.to_pylist() for k, v in whole.items()}


def test_totals_joined_by_shuffle_give_the_same(spark, folder, monkeypatch):
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    sent = got(tokenalign.align(docs, align_models()))
    monkeypatch.setattr(tokenalign, "SMALL_TOTALS", 0)
    assert got(tokenalign.align(docs, align_models())) == sent


def test_words_are_not_encoded_again_among_many_others(monkeypatch):
    units = tokenalign.Units(align_models())
    for k in range(0, 350_000, 50_000):
        units.learn({f"w{i}" for i in range(k, k + 50_000)})
    met = []
    monkeypatch.setattr(units, "_first", lambda words: met.extend(words) or [[0]] * len(words))
    units.learn({f"w{i}" for i in range(1_000)})
    assert not met
