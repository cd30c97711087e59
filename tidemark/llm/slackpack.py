"""Best-fit packing of token sequences by minimum bin slack.

A bin is filled by the largest waiting length and the subset of the other lengths that leaves least slack; a bitset over
fill levels says which sums can be reached. All pieces of one length are alike, so the packer works on the count of each
length, at most ``capacity`` numbers at any corpus size, and uses a found combination as often as the counts allow. Pieces
then look up their place by their rank among those of their length.
"""

from __future__ import annotations

import re
import struct
import zlib
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_ASCII, as_bytes, cut_lineage, numbered, only_cache

CAPACITY = 4096
END_ID = 1


# --- tokens ---------------------------------------------------------------------------------------------------------------


#: The byte-level alphabet: printable bytes are their own letter, the others take the letters from U+0100 on, in order.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _OWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_OWN)))}


def is_plain(text: str) -> bool:
    """Lower-case composed Latin letters only: the tokenizer neither changes nor splits such a word."""
    return text.isalpha() and (text.islower() if text.isascii() else max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text))


class WordIds(dict):
    """White-space separated word to its token ids as little-endian bytes.

    The tokenizer lower-cases, and normalises and splits inside words only, so ids of a text are the ids of its words in order.
    Words are kept in two generations of at most ``most`` each: those not met while the younger one fills are forgotten.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.merges = self.tokenizer.model.tokenize
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            if is_plain(text):  # goes to the vocabulary's merges as it is
                found = [t.id for t in self.merges(word.decode("latin-1").translate(BYTE_LETTERS))]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


#: Marks that end a word after an ASCII letter: the tokenizer parts them from it, whatever they are.
END_MARKS = re.compile(rb"(?<=[a-z])([!-/:-@\[-`{-~]+)(?=[ \t\n\r\x0b\x0c]|\Z)")


def words_of(text: bytes | None) -> list[bytes]:
    """Pieces of a text whose ids, one after another, are the ids of the text. Fewer spellings make fewer words to encode."""
    if not text:
        return []
    if b"<|" in text:  # may hold a special token, which is matched as it is written
        return text.split()
    return END_MARKS.sub(rb" \1", text.translate(LOWER_ASCII)).split()


def _cut(batches, path: str, capacity: int, with_ids: bool):
    import pyarrow as pa

    ids_of: WordIds = only_cache(("word ids", path), lambda: WordIds(path))
    for batch in batches:
        docs, texts = batch["doc_id"].to_pylist(), as_bytes(batch["text"])
        for lo in range(0, len(texts), 512):
            rows = []
            for doc, text in zip(docs[lo : lo + 512], texts[lo : lo + 512], strict=True):
                ids = np.append(ids_of.of(words_of(text)), np.array([END_ID], "<u4"))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    raw = own.astype("<u4").tobytes()
                    rows.append((doc, piece, start, len(own), zlib.crc32(raw), own.tolist() if with_ids else None))
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            if not with_ids:
                kinds, names = kinds[:-1], names[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, ids: documents as token ids with an end id, cut at ``capacity``.

    A null or empty text is the end id alone. ``tokenizer``: path of a tokenizer file that every executor has.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _cut(b, tokenizer, capacity, with_ids),
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{extra}",
    )


# --- bins -----------------------------------------------------------------------------------------------------------------


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The combination (length, how many) that holds the largest length and leaves least slack.

    Lengths come in descending order, each in lots of 1, 2, 4 … up to its count; reachable fills are the bits of one integer.
    """
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        lot = 1
        while left > 0 and not reach >> room & 1:
            n = min(lot, left)
            steps.append((reach, length, n))
            reach |= reach << (length * n) & mask
            left -= n
            lot *= 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    taken: dict[int, int] = {first: 1}
    for before, length, n in reversed(steps):
        if not before >> fill & 1:
            taken[length] = taken.get(length, 0) + n
            fill -= length * n
    return sorted(taken.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often each combination is used: (bins, [(length, how many)]). Each use exhausts a length or nearly so."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        combination = fullest(counts, capacity)
        bins = min(counts[length] // n for length, n in combination)
        out.append((bins, combination))
        for length, n in combination:
            counts[length] -= n * bins
            if not counts[length]:
                del counts[length]
    return out


class Places:
    """For each length, runs of ranks with their first bin, pieces per bin and offset."""

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for bins, combination in plan:
            offset = 0
            for length, n in combination:
                rank = used.get(length, 0)
                runs.setdefault(length, []).append((rank, first, n, offset))
                used[length] = rank + bins * n
                offset += length * n
            first += bins
        self.runs = {length: np.array(r, np.int64) for length, r in runs.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            runs = self.runs[int(length)]
            rank, first, n, offset = runs[np.searchsorted(runs[:, 0], ranks[own], side="right") - 1].T
            k = ranks[own] - rank
            bins[own], offsets[own] = first + k // n, offset + k % n * length
        return bins, offsets


def _place(batches, shared):
    import pyarrow as pa

    for batch in batches:
        bins, offsets = shared.value.of(batch["length"].to_numpy(), batch["rank"].to_numpy())
        names = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(bins), pa.array(offsets)], [*names, "sequence_id", "offset"])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (doc_id, piece, start, length, …; 1 <= length <= capacity).

    Pieces of a sequence follow each other without gaps from offset 0. Equal pieces and repeated rows each take their place.
    """
    counts = {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = cut.sparkSession.sparkContext.broadcast(Places(plan_bins(counts, capacity)))
    ranked = numbered(cut, "length", ["doc_id", "piece", "ids_crc32"], "rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.select(*cut.columns, "rank").mapInArrow(lambda b: _place(b, shared), schema)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; an empty table gives no rows."""
    return pack(cut_lineage(pieces(docs, tokenizer, capacity, with_ids)), capacity)
