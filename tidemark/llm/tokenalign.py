"""Alignment of two tokenizations, as an Arrow pipeline.

The token lists of a batch are flattened; list parents tell each token's document, and cumulative sums of byte lengths, counted
from the document's start, its end. A hash join of both sides' (document, end) keys finds where both end; between two such
places lies a group. Links of a document come from a hash join of both sides on the group and are counted by ``group_by``. Spark
adds up the partial counts of all batches and joins the totals back.

Words between single spaces are encoded once and remembered: both tokenizers cut before a space that follows another character.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, only_cache

#: Bytes of text aligned at once, and links joined at once.
CHUNK_BYTES = 512 << 10
SLICE_LINKS = 2_000_000
#: Id pairs whose totals are sent to all executors; more of them are joined by a shuffle.
SMALL_TOTALS = 1_500_000


@dataclass(frozen=True)
class Tokenizers:
    """Paths of a byte-level tokenizer file (A) and of a word-piece model with byte fallback (B) that all executors have."""

    a: str
    b: str

    def sizes(self) -> tuple[int, int]:
        import sentencepiece
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.a).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=self.b).get_piece_size()


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units(dict):
    """A word, without the space before it, to its ids by A and by B as little-endian bytes.

    New words of a few texts are encoded together. Words are kept in two generations of at most ``most`` each, words over 64
    letters not at all.
    """

    def __init__(self, models: Tokenizers, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.most, self.old = most, {}
        self.first = Tokenizer.from_file(models.a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=models.b)
        letters = byte_letters()
        names = [self.first.id_to_token(i) for i in range(self.first.get_vocab_size())]
        spelled = [bytes(letters[c] for c in n) if all(c in letters for c in n) else None for n in names]
        self.length_a = np.array([len(x) if x is not None else len(n.encode()) for n, x in zip(names, spelled, strict=True)], np.int64)
        self.length_b = np.array([self._bytes(i) for i in range(self.second.get_piece_size())], np.int64)
        self.quick = self._quick(models.a, names, spelled)
        self.space = [self.second.piece_to_id("▁")]

    @staticmethod
    def _quick(path: str, names: list[str], spelled: list[bytes | None]):
        """A faster encoder of A for Latin words, where A's ids are the order of its merges; else none."""
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        if names[256 : 256 + len(pairs)] != pairs:
            return None
        ranks = {x: i for i, x in enumerate(spelled[: 256 + len(pairs)])}
        return tiktoken.Encoding("latin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _bytes(self, i: int) -> int:
        return 1 if self.second.is_byte(i) else len(self.second.id_to_piece(i).replace("▁", " ").encode())

    def _first(self, words: list[str]) -> list[list[int]]:
        whole = [f" {w}" for w in words]
        latin = [self.quick is not None and (w.isascii() or max(w) < "\u0250") for w in whole]
        others = iter(self.first.encode_batch_fast([w for w, plain in zip(whole, latin, strict=True) if not plain], add_special_tokens=False))
        return [self.quick(w) if plain else next(others).ids for w, plain in zip(whole, latin, strict=True)]

    def learn(self, words: set[str]) -> list[str]:
        """Encode what is not known; gives the long words, to be forgotten after use."""
        if len(self) + len(words) > self.most:
            self.old = dict(self)
            self.clear()
        unknown = [w for w in words if w not in self]
        self.update({w: self.old[w] for w in unknown if w in self.old})
        new = [w for w in unknown if w not in self]
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            for w, x, y in zip(part, self._first(part), self.second.encode(part, num_threads=1), strict=True):
                if not w:  # a space that ends the text: B adds none to an empty text
                    y = self.space
                self[w] = struct.pack(f"<{len(x)}i", *x), struct.pack(f"<{len(y)}i", *y)
        return [w for w in new if len(w) > 64]


#: A space at the start or after white space: there a word may begin with spaces, and a single space does not cut.
ODD_SPACE = re.compile(r"(?:\A|\s) ")
CUT = re.compile(r"(?<=\S) ")


def words_of(text: str) -> list[str]:
    """Pieces of space + text, each without its first space: cut at each space that follows another character than white space."""
    return CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")


def _ids(units: Units, texts: list[str | None]):
    """Arrow lists of both sides' ids, and the bytes of each document (0: no tokens)."""
    import pyarrow as pa

    first, second, sizes = [], [], []
    words = [words_of(text) if text else [] for text in texts]
    long = units.learn(set().union(*words))
    for text, own in zip(texts, words, strict=True):
        found = list(map(units.__getitem__, own))
        first.append(b"".join([f[0] for f in found]))
        second.append(b"".join([f[1] for f in found]))
        sizes.append(len(text.encode()) + 1 if text else 0)
    for w in long:
        del units[w]

    def lists(parts):
        offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))
        return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return lists(first), lists(second), np.array(sizes, np.int64)


def _ends(ids, lengths):
    """Flat ids, their documents, and their ends in bytes from the document's start: cumulative sums by segment."""
    import pyarrow as pa
    import pyarrow.compute as pc

    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.take(lengths, flat))
    upto = pa.concat_arrays([pa.array([0], pa.int64()), upto])
    starts = pc.take(upto, ids.offsets.slice(0, len(ids)))
    return flat, parent, pc.subtract(upto.slice(1), pc.take(starts, parent)), pc.subtract(pc.take(upto, ids.offsets.slice(1)), starts)


def _kept(ids, valid: np.ndarray):
    """The lists, empty where not valid."""
    import pyarrow as pa
    import pyarrow.compute as pc

    keep = pc.take(pa.array(valid), pc.list_parent_indices(ids))
    n = np.where(valid, np.diff(ids.offsets.to_numpy()), 0)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int64()), pc.filter(pc.list_flatten(ids), keep))


def _joined(texts, owner: np.ndarray, owners: int, mark: str):
    """Per owner its texts with ``mark`` between; ``owner`` is in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    offsets = pa.array(np.searchsorted(owner, np.arange(owners + 1)), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, texts), pa.scalar(mark, pa.large_string()))


def _pairs(doc, a, group_a, b, group_b, wide: int):
    """doc, pair, n: occurrences of each linked id pair of each document, a limited number of links at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    first = np.searchsorted(group_b, group_a)
    often = np.searchsorted(group_b, group_a, side="right") - first
    upto = np.cumsum(often)
    parts, lo = [], 0
    while lo < len(often):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE_LINKS, side="right")))
        end = int(first[hi - 1] + often[hi - 1])
        left = pa.table({"group": group_a[lo:hi], "doc": doc[lo:hi], "a": a[lo:hi]})
        right = pa.table({"group": group_b[first[lo] : end], "b": b[first[lo] : end]})
        linked = left.join(right, "group", join_type="inner", use_threads=False)
        pair = pc.add(pc.multiply(linked["a"].cast(pa.int64()), wide), linked["b"].cast(pa.int64()))
        parts.append(pa.table({"doc": linked["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]))
        lo = hi
    if not parts:
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    whole = pa.concat_tables(parts).rename_columns(["doc", "pair", "n"])
    if len(parts) > 1:
        whole = whole.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["doc", "pair", "n"])
    return whole.sort_by([("doc", "ascending"), ("pair", "ascending")])


def aligned(units: Units, texts: list[str | None], names_a, names_b) -> dict:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (lists) of a few texts.

    Both tokenizers spell texts as they are, byte by byte, but for the space mark of B: its three bytes come back as one. So a
    text is spelled out if and only if the lengths of its tokens add up.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ids_a, ids_b, size = _ids(units, texts)
    total_a, total_b = (_ends(i, pa.array(n))[3].to_numpy() for i, n in ((ids_a, units.length_a), (ids_b, units.length_b)))
    valid = (total_a == size) & (total_b == size) & (size > 0)
    ids_a, ids_b = _kept(ids_a, valid), _kept(ids_b, valid)
    a, doc_a, end_a, _ = _ends(ids_a, pa.array(units.length_a))
    b, doc_b, end_b, _ = _ends(ids_b, pa.array(units.length_b))

    # one number for (document, end): a text has less than 2 ** 40 bytes
    key_a = pa.table({"key": pc.add(pc.multiply(doc_a, 1 << 40), end_a), "at_a": np.arange(len(a))})
    key_b = pa.table({"key": pc.add(pc.multiply(doc_b, 1 << 40), end_b), "at_b": np.arange(len(b))})
    both = key_a.join(key_b, "key", join_type="inner", use_threads=False)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[both["at_a"].to_numpy()] = 1
    last_b[both["at_b"].to_numpy()] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())

    text = pc.binary_join_element_wise(
        _joined(pc.take(names_a, a), group_a, groups, ","), _joined(pc.take(names_b, b), group_b, groups, ","), pa.scalar("|", pa.large_string())
    )
    n_docs = len(texts)
    group_doc = doc_a.to_numpy()[last_a == 1]
    joined = _joined(text, group_doc, n_docs, ";")

    pairs = _pairs(doc_a.to_numpy(), a.to_numpy(), group_a, b.to_numpy(), group_b, len(units.length_b))
    cuts = pa.array(np.searchsorted(pairs["doc"].to_numpy(), np.arange(n_docs + 1)), pa.int32())
    links = np.bincount(doc_a.to_numpy(), weights=np.bincount(group_b, minlength=groups)[group_a], minlength=n_docs) if len(a) else np.zeros(n_docs)
    return {
        "n_a": pa.array(np.diff(ids_a.offsets.to_numpy())),
        "n_b": pa.array(np.diff(ids_b.offsets.to_numpy())),
        "n_groups": pa.array(np.bincount(group_doc, minlength=n_docs)),
        "n_links": pa.array(links.astype(np.int64)),
        "groups_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(joined, valid, strict=True)], pa.string()),
        "pairs": pa.ListArray.from_arrays(cuts, pairs["pair"].combine_chunks()),
        "times": pa.ListArray.from_arrays(cuts, pairs["n"].combine_chunks().cast(pa.int32())),
    }


def _chunks(sizes: list[int]):
    """Ranges of texts of at most ``CHUNK_BYTES`` bytes; a longer text is one on its own."""
    lo, held = 0, 0
    for k, n in enumerate(sizes):
        if k > lo and held + n > CHUNK_BYTES:
            yield lo, k
            lo, held = k, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _align(batches, models: Tokenizers):
    import pyarrow as pa
    import pyarrow.compute as pc

    units: Units = only_cache(("token units", models), lambda: Units(models))
    names_a = pa.array([str(i) for i in range(len(units.length_a))], pa.large_string())
    names_b = pa.array([str(i) for i in range(len(units.length_b))], pa.large_string())
    for batch in batches:
        for lo, hi in _chunks(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
            found = aligned(units, batch["text"].slice(lo, hi - lo).to_pylist(), names_a, names_b)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *found.values()], ["doc_id", *found])
        pa.default_memory_pool().release_unused()


def _partial_counts(batches):
    """How many documents hold each pair: a document has it once in its list."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        counted = pa.table({"pair": pc.list_flatten(batch["pairs"])}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        yield from counted.rename_columns(["pair", "n"]).combine_chunks().to_batches()


def alignments(docs: DataFrame, models: Tokenizers) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times, one row per row of ``docs``: a written table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(
        lambda b: _align(b, models),
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>",
    )
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def pair_counts(found: DataFrame, wide: int) -> DataFrame:
    """pair, n and best (the highest n of the pair's A id, ties included); ``wide``: number of B ids."""
    counts = found.select("pairs").mapInArrow(_partial_counts, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.withColumn("a", F.expr(f"pair div {wide}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row per A id at most
    return cut_lineage(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align(docs: DataFrame, models: Tokenizers) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs`` (doc_id, text).

    Null and empty texts, and texts that the ids of A or B do not spell out, have zeros and an empty digest. Rows that repeat a
    doc_id, or have none, count as documents of their own. Other columns are not read. Totals of pairs go to all executors if
    their counted number is at most ``SMALL_TOTALS``; else they are joined by a shuffle, where one side is unique by pair.
    """
    found = alignments(docs, models)
    totals = pair_counts(found, models.sizes()[1])
    if totals.count() <= SMALL_TOTALS:
        totals = F.broadcast(totals)
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("k"))
    per_row = each.join(totals, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).cast("bigint").alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("bigint")
    return found.drop("pairs", "times").join(per_row, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
