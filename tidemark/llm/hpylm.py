"""Language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sampling on Spark.

One restaurant stands at the root, one for each context. The context of a token is the word before it, whatever its count (the
end mark at the start of a text): the number of restaurants grows with the vocabulary. All have the root as parent, whose own
parent is uniform over the vocabulary and one unknown word. Customers are counted over all training tokens. A Gibbs sweep draws
the number of tables of each (context, word) given all other seats: exactly, from the distribution that generalised Stirling
numbers give, up to ``STIRLING`` customers, else from the limit of that distribution for many customers. Dishes are dealt over
tasks by word, so all seats of a word, with its root restaurant, lie together. Between sweeps the tables of each context are
summed over these buckets in parts, which are ranges of context hashes, and each bucket is sent the totals of its own contexts
only; no task, nor the driver, holds all contexts. The contexts of a word of more than ``HOT_TOKENS`` tokens are dealt over
buckets of their own by context, and the driver seats these few words at the root. Predictive probabilities are averaged over the kept sweeps.

Texts are coded once: rows of ``CHUNK_TOKENS`` tokens with word numbers of their own, kept as a table; counts and
probabilities travel as byte blocks in the order of those numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_ASCII, as_bytes, cut_lineage, each_row, kept_by, leanly, row_dicts

#: The end mark is a token, not a word: no word is empty.
END = b""
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_250_000
HOT_TOKENS = BUCKET_TOKENS // 2
#: A word of less than this share of a chunk's tokens is not looked at there when hot words are sought.
OFTEN = 20_000
#: (bucket, context) sums added up in one task
PART_SUMS = 2_000_000
STIRLING = 512


@dataclass(frozen=True)
class ModelRule:
    """burn_in and kept: sweeps before and in the average; strength: of contexts and root; seed."""

    burn_in: int = 2
    kept: int = 3
    strength: float = 1.0
    root_strength: float = 10.0
    seed: int = 20_240_917


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 7 is 2; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# --- coding texts ---------------------------------------------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd", 1).compress(x.tobytes(), asbytes=True) if len(x) else b""


def _unpack(x: bytes, kind, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.Codec("zstd").decompress(x, n * np.dtype(kind).itemsize, asbytes=True), kind) if n else np.empty(0, kind)


def _pack_hashes(x: np.ndarray) -> bytes:
    """Ascending 64-bit hashes as steps, the bytes of one place together: those of the high places are nearly all zero."""
    return _pack(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy())


def _unpack_hashes(x: bytes, n: int) -> np.ndarray:
    steps = _unpack(x, np.uint8, 8 * n).reshape(8, n).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


class Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


CHUNK = "part int, n_docs int, n_tokens bigint, n_words bigint, end_mark bigint, docs binary, held binary, nulls binary, lengths binary, tokens binary, words binary, n_often bigint, often binary, often_counts binary"


def _chunk(part: int, ids, held, lengths, tokens, numbers: Numbers):
    """One coded row. Word numbers are ordered by word hash, so blocks of hashes are runs of numbers."""
    import pyarrow as pa

    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    tokens = place[np.concatenate(tokens)] if tokens else np.empty(0, np.uint32)
    blank = np.array([x is None for x in ids])
    own = np.array([0 if x is None else x for x in ids], np.int64)
    n_word = np.bincount(tokens, minlength=len(hashes))
    often = np.flatnonzero(n_word * OFTEN >= len(tokens))
    columns = [
        part, len(ids), len(tokens), len(hashes), int(place[numbers[END]]), _pack(own), _pack(np.array(held, bool)), _pack(blank),
        _pack(np.array(lengths, np.int64)), _pack(tokens), _pack_hashes(hashes[order]),
        len(often), _pack_hashes(hashes[order][often]), _pack(n_word[often]),
    ]
    names = [c.strip().split()[0] for c in CHUNK.split(",")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.large_binary()}
    types = [pa.binary() if k == "binary" else kinds[k] for k in (c.strip().split()[1] for c in CHUNK.split(","))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(columns, types, strict=True)], names)


def _code(batches, chunk_tokens: int):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def fresh():
        return {"ids": [], "held": [], "lengths": [], "tokens": [], "numbers": Numbers(), "n": 0}

    state = fresh()
    for batch in batches:
        for doc, held, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), as_bytes(batch["text"]), strict=True):
            words = text.translate(LOWER_ASCII).split() if text else []
            words.append(END)
            state["tokens"].append(np.fromiter(map(state["numbers"].__getitem__, words), np.uint32, len(words)))
            state["ids"].append(doc)
            state["held"].append(held)
            state["lengths"].append(len(words))
            state["n"] += len(words)
            if state["n"] >= chunk_tokens:
                state.pop("n")
                yield leanly(_chunk, part, **state)
                state.clear()
                state = leanly(fresh)
    if state.pop("n"):
        yield leanly(_chunk, part, **state)
        leanly(state.clear)


class Coded:
    """A coded row as arrays. ``train``: for each token, whether its document is learned from."""

    def __init__(self, row: dict):
        self.n_docs, n, self.n_words = row["n_docs"], row["n_tokens"], row["n_words"]
        self.docs = _unpack(row["docs"], np.int64, self.n_docs)
        self.held = _unpack(row["held"], bool, self.n_docs)
        self.nulls = _unpack(row["nulls"], bool, self.n_docs)
        self.lengths = _unpack(row["lengths"], np.int64, self.n_docs)
        self.tokens = _unpack(row["tokens"], np.uint32, n)
        self.words = _unpack_hashes(row["words"], self.n_words) if row.get("words") is not None else None
        self.end_mark = row["end_mark"]
        self.train = np.repeat(~self.held, self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (word, context) keys in order, training counts of each, and the key of each token.

        Both are word numbers of this row: a key is word * n_words + context.
        """
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]  # a text follows the end mark of the one before
        before[:1] = self.end_mark
        before += self.tokens.astype(np.int64) * self.n_words
        keys, at = np.unique(before, return_inverse=True)
        return keys, np.bincount(at, weights=self.train, minlength=len(keys)).astype(np.int64), at


def _train_tokens(row):
    import pyarrow as pa

    n_docs = row["n_docs"]
    held, lengths = _unpack(row["held"], bool, n_docs), _unpack(row["lengths"], np.int64, n_docs)
    return pa.RecordBatch.from_arrays([pa.array([int(lengths[~held].sum())])], ["n"])


def _often(row):
    import pyarrow as pa

    words, n = _unpack_hashes(row["often"], row["n_often"]), _unpack(row["often_counts"], np.int64, row["n_often"])
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


# --- customers ------------------------------------------------------------------------------------------------------------


SEATS = (
    "bucket int, chunk bigint, n_words bigint, n_pairs bigint, n_contexts bigint, words binary, widths binary, names binary, "
    "contexts binary, counts binary"
)


def _range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of equal width."""
    return (hashes // np.uint64(-(-(1 << 64) // n))).astype(np.int64)


@dataclass
class Deal:
    """Buckets of words by hash; behind them those of the hot words (hashes in order), by hash of the context."""

    n_buckets: int
    n_hot: int
    hot: np.ndarray

    def pairs(self, words: np.ndarray, word_of: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each pair, and the order of pairs by bucket."""
        bucket = _range_of(words, self.n_buckets)[word_of]
        rows = np.flatnonzero(np.isin(words, self.hot)[word_of])
        if len(rows):
            bucket[rows] = self.n_buckets + _range_of(words[context[rows]], self.n_hot)
        return bucket, np.argsort(bucket, kind="stable")

    def places(self, row: dict) -> np.ndarray | None:
        """Of the words of a bucket of hot words among all hot words; None for other buckets."""
        return np.searchsorted(self.hot, _unpack_hashes(row["words"], row["n_words"])) if row["bucket"] >= self.n_buckets else None


def _emit_counts(row, deal: Deal):
    """For each bucket with words of a chunk: these words, how many contexts each has, those contexts, and training counts.

    names: hashes of the contexts, once each and in order; contexts: their places there.
    """
    import pyarrow as pa

    own = Coded(row)
    keys, counts, _ = own.pairs()
    word_of, context = keys // own.n_words, (keys % own.n_words).astype(np.uint32)
    bucket, order = deal.pairs(own.words, word_of, context)
    bucket, word_of, context, counts = bucket[order], word_of[order], context[order], counts.astype(np.uint32)[order]
    found, starts = np.unique(bucket, return_index=True)
    out = []
    for k, x, y in zip(found, starts, np.append(starts[1:], len(bucket)), strict=True):
        words, widths = np.unique(word_of[x:y], return_counts=True)
        names, at = np.unique(context[x:y], return_inverse=True)
        hashes = _pack_hashes(own.words[words]), _pack_hashes(own.words[names])
        widths, at, counts_ = map(_pack, (widths.astype(np.uint32), at.astype(np.uint32), counts[x:y]))
        out.append((int(k), row["chunk"], len(words), int(y - x), len(names), hashes[0], widths, hashes[1], at, counts_))
    names = [c.strip().split()[0] for c in SEATS.split(",")]
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


BUCKET = (
    "bucket int, n_words bigint, n_pairs bigint, n_contexts bigint, vocabulary bigint, singles bigint, doubles bigint, "
    "words binary, word_at binary, names binary, contexts binary, counts binary, chunks array<bigint>, chunk_words array<bigint>, chunk_pairs array<bigint>, word_places binary, pair_places binary"
)


def _steps(places: list[np.ndarray]) -> np.ndarray:
    """Ascending places of several blocks, each as steps from the one before: small numbers, which pack well."""
    return np.concatenate([np.diff(p, prepend=p.dtype.type(0)).astype(np.uint32) for p in places])


def _merged(blocks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All distinct hashes of several blocks, in order, and the places of each block's own among them."""
    every, places = np.unique(np.concatenate(blocks), return_inverse=True)
    return every, np.split(places.astype(np.int32), np.cumsum([len(x) for x in blocks])[:-1])


def _gather(key, table, hot_from: float = math.inf):
    """All blocks of one bucket to one row: distinct pairs with their counts, and where each chunk finds its own.

    Buckets from ``hot_from`` on, which share their words, have their hashes too, and leave it to the driver to count them.
    """
    import pyarrow as pa

    rows = sorted(row_dicts(table), key=lambda r: r["chunk"])
    every, at = _merged([_unpack_hashes(r["words"], r["n_words"]) for r in rows])
    known, own = _merged([_unpack_hashes(r["names"], r["n_contexts"]) for r in rows])
    wide = len(known)
    # filled block by block: what is wide lies there once
    ends = np.cumsum([r["n_pairs"] for r in rows])
    keys, counts = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.uint32)
    for r, word, context, end in zip(rows, at, own, ends, strict=True):
        block = slice(end - r["n_pairs"], end)
        keys[block] = np.repeat(word.astype(np.int64) * wide, _unpack(r["widths"], np.uint32, r["n_words"]))
        keys[block] += context[_unpack(r["contexts"], np.uint32, r["n_pairs"])]
        counts[block] = _unpack(r["counts"], np.uint32, r["n_pairs"])
    keys, pair_places = np.unique(keys, return_inverse=True)
    total = np.bincount(pair_places, weights=counts, minlength=len(keys)).astype(np.int64)
    pair_places, counts = pair_places.astype(np.int32), None
    word_at = keys // wide
    of_word = np.bincount(word_at, weights=total, minlength=len(every))
    hot = rows[0]["bucket"] >= hot_from
    values = [
        rows[0]["bucket"], len(every), len(keys), len(known), 0 if hot else int((of_word > 0).sum()), int((total == 1).sum()), int((total == 2).sum()),
        _pack_hashes(every) if hot else b"", _pack(word_at.astype(np.uint32)), _pack_hashes(known), _pack((keys % wide).astype(np.uint32)), _pack(total),
        [r["chunk"] for r in rows], [r["n_words"] for r in rows], [r["n_pairs"] for r in rows],
        _pack(_steps(at)), _pack(_steps(np.split(pair_places, ends[:-1]))),
    ]
    names = [c.strip().split()[0] for c in BUCKET.split(",")]
    kinds = [pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * 5, *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 2]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


def _hot_counts(row, deal: Deal):
    """Training counts of the hot words of a bucket."""
    import pyarrow as pa

    word, counts = _unpack(row["word_at"], np.uint32, row["n_pairs"]), _unpack(row["counts"], np.int64, row["n_pairs"])
    n = np.bincount(word, weights=counts, minlength=row["n_words"]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(deal.places(row), pa.int32()), pa.array(n)], ["place", "n"])


def _hot_sums(rows: DataFrame, n_hot: int) -> np.ndarray:
    """Sums over buckets for each of the hot words, which are few."""
    out = np.zeros(n_hot, np.int64)
    for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect() if n_hot else ():
        out[r.place] = r.n
    return out


# --- contexts -------------------------------------------------------------------------------------------------------------

PLACES = "part int, bucket int, n bigint, places binary, totals binary"


def _emit_contexts(row, n_parts: int):
    """For each part with contexts of a bucket: their hashes, in order, and their customers there."""
    import pyarrow as pa

    starts = np.array([k * -(-(1 << 64) // n_parts) for k in range(1, n_parts)], np.uint64)  # ranges of equal width
    names = _unpack_hashes(row["names"], row["n_contexts"])
    counts = _unpack(row["counts"], np.int64, row["n_pairs"])
    customers = np.bincount(_unpack(row["contexts"], np.uint32, row["n_pairs"]), weights=counts, minlength=len(names)).astype(np.int64)
    cuts = np.searchsorted(names, starts)
    out = [
        (k, row["bucket"], len(a), _pack(a), _pack(b))
        for k, (a, b) in enumerate(zip(np.split(names, cuts), np.split(customers, cuts), strict=True))
        if len(a)
    ]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["part", "bucket", "n", "names", "sums"])


def _place(key, table):
    """Where each bucket finds its contexts among those of a part, as steps from the one before, and their customers in all."""
    import pyarrow as pa

    rows = row_dicts(table)
    names = [_unpack(r["names"], np.uint64, r["n"]) for r in rows]
    _, places = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(places, weights=np.concatenate([_unpack(r["sums"], np.int64, r["n"]) for r in rows])).astype(np.int64)
    own = np.split(places, np.cumsum([len(x) for x in names])[:-1])
    out = [
        (r["part"], r["bucket"], r["n"], _pack(np.diff(at, prepend=0).astype(np.uint32)), _pack(total[at]))
        for r, at in zip(rows, own, strict=True)
    ]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.table(columns, names=[c.strip().split()[0] for c in PLACES.split(",")])


def _add_up(key, left, right):
    """Sums of the buckets over the contexts of one part; each bucket gets the totals of its own contexts."""
    import pyarrow as pa

    at = {r["bucket"]: np.cumsum(_unpack(r["places"], np.uint32, r["n"]), dtype=np.int64) for r in row_dicts(right)}
    total = np.zeros(1 + max((int(x[-1]) for x in at.values()), default=-1), np.int64)
    for r in row_dicts(left):
        own = at[r["bucket"]]
        total[own] += _unpack(r["sums"], np.int64, len(own))  # a bucket names a context once
    out = [(int(key[0].as_py()), k, len(x), _pack(total[x])) for k, x in at.items()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
    return pa.table(columns, names=["part", "bucket", "n", "totals"])


def _with_bucket(table: DataFrame, other: DataFrame) -> DataFrame:
    """Join rows of a bucket: one on either side, so by hash table; a sort would hold a page for each side of each join."""
    return table.join(other.hint("shuffle_hash"), "bucket")


def _by_bucket(totals: DataFrame) -> DataFrame:
    """bucket, parts: all totals sent to a bucket, in the order of its contexts."""
    return totals.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("part", "n", "totals"))).alias("parts"))


def _totals_of(parts: list[dict]) -> np.ndarray:
    return np.concatenate([_unpack(p["totals"], np.int64, p["n"]) for p in parts])


# --- seating --------------------------------------------------------------------------------------------------------------


def log_stirling(n: int, discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t), c and t up to n: the weight of all seatings of c at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, c + 2)
        stay = np.maximum(c - t * discount, 0.0)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(stay))
    return out


def draw_tables(counts: np.ndarray, other: np.ndarray, parent: np.ndarray, discount: float, strength: float, table: np.ndarray, rng) -> np.ndarray:
    """Draw tables of dishes given the other tables of their restaurants and the parent's probability of each dish.

    P(t) is in proportion to S_d(c, t) * parent**t * prod_{j<t} (strength + discount * (other + j)).
    """
    out = np.minimum(counts, 1)
    most = table.shape[0] - 1
    base = strength / discount + other
    for c in np.unique(counts[(counts > 1) & (counts <= most)]):
        rows = np.flatnonzero(counts == c)
        for part in np.array_split(rows, max(1, len(rows) * int(c) // 250_000)):
            step = np.log(parent[part] * discount)[:, None] + np.log(base[part][:, None] + np.arange(c)[None, :])
            weight = np.cumsum(step, axis=1) + table[c, 1 : c + 1][None, :]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (weight < rng.random(len(part))[:, None] * weight[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(counts > most)
    # for many customers S_d(c, t) goes as 1 / (discount**(t - 1) * (t - 1)!): t - 1 is negative binomial
    if len(rows):
        more = rng.negative_binomial(base[rows] + 1, np.clip(1 - parent[rows], 1e-12, 1))
        out[rows] = np.minimum(1 + more, counts[rows])
    return out


@dataclass
class Totals:
    """What restaurants know of themselves: customers and tables of each context at hand, and of the root."""

    customers: np.ndarray | None
    tables: np.ndarray
    root_customers: int
    root_tables: int


def root_probability(customers, tables, totals: Totals, discount: float, rule: ModelRule, vocabulary: int) -> np.ndarray:
    """Predictive probability of words at the root; the parent is uniform over the vocabulary and one unknown word."""
    rest = (rule.root_strength + discount * totals.root_tables) / (vocabulary + 1)
    return (np.maximum(customers - discount * tables, 0) + rest) / (rule.root_strength + totals.root_customers)


SWEEP = (
    "bucket int, tables binary, root binary, of_context array<struct<part: int, sums: binary>>, root_customers bigint, root_tables bigint, "
    "hot array<struct<place: int, n: bigint>>"
)


def _sweep(row, p: dict, rule: ModelRule, number: int):
    """One Gibbs sweep over buckets: tables of each (context, word), then root tables of each word but the hot ones."""
    import pyarrow as pa

    hot = p["deal"].places(row)
    totals = Totals(None, _totals_of(row["parts"]), *p["root"]) if p["root"] else None
    n, words = row["n_pairs"], row["n_words"]
    counts = _unpack(row["counts"], np.int64, n)
    context, word = _unpack(row["contexts"], np.uint32, n), _unpack(row["word_at"], np.uint32, n)
    rng = np.random.default_rng([rule.seed, number, row["bucket"]])
    if totals is None:
        tables = np.minimum(counts, 1)
    else:
        before, root_before = _unpack(row["tables"], np.int64, n), _unpack(row["root"], np.int64, words)
        at_root = np.bincount(word, weights=before, minlength=words)
        if hot is not None:
            at_root, root_before = (x[hot] for x in p["hot"])
        parent = root_probability(at_root, root_before, totals, p["root_discount"], rule, p["vocabulary"])[word]
        other = np.maximum(totals.tables[context] - before, 0).astype(float)
        tables = draw_tables(counts, other, parent, p["discount"], rule.strength, p["stirling"], rng)
    at_root = np.bincount(word, weights=tables, minlength=words).astype(np.int64)
    if hot is not None:
        root = np.zeros(words, np.int64)
    elif totals is None:
        root = np.minimum(at_root, 1)
    else:
        other = np.maximum(totals.root_tables - root_before, 0).astype(float)
        flat = np.full(words, 1 / (p["vocabulary"] + 1))
        root = draw_tables(at_root, other, flat, p["root_discount"], rule.root_strength, p["root_stirling"], rng)
    sums = np.bincount(context, weights=tables, minlength=row["n_contexts"]).astype(np.int64)
    sums = np.split(sums, np.cumsum([x["n"] for x in row["parts"]])[:-1])
    of_context = [{"part": x["part"], "sums": _pack(n)} for x, n in zip(row["parts"], sums, strict=True)]
    values = [row["bucket"], _pack(tables), _pack(root), of_context, int(at_root.sum()), int(root.sum())]
    values.append([] if hot is None else [{"place": int(k), "n": int(n)} for k, n in zip(hot, at_root, strict=True)])
    names = ["bucket", "tables", "root", "of_context", "root_customers", "root_tables", "hot"]
    sent = pa.list_(pa.struct([("part", pa.int32()), ("sums", pa.binary())]))
    kinds = [pa.int32(), pa.binary(), pa.binary(), sent, pa.int64(), pa.int64(), pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int64())]))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)


def _seat_hot(at_root: np.ndarray, p: dict, rule: ModelRule, number: int) -> np.ndarray:
    """Root tables of the hot words, given their customers there, as ``_sweep`` draws those of the others."""
    if p["root"] is None:
        return np.minimum(at_root, 1)
    other = np.maximum(p["root"][1] - p["hot"][1], 0).astype(float)
    flat = np.full(len(at_root), 1 / (p["vocabulary"] + 1))
    rng = np.random.default_rng([rule.seed, number, p["deal"].n_buckets])
    return draw_tables(at_root, other, flat, p["root_discount"], rule.root_strength, p["root_stirling"], rng)


def _discount(singles: int, doubles: int) -> float:
    """The usual estimate from counts of counts, kept inside (0, 1)."""
    return min(0.95, max(0.05, singles / (singles + 2 * doubles))) if singles + doubles else 0.5


# --- scores ---------------------------------------------------------------------------------------------------------------

BACK = "chunk bigint, bucket int, counts binary, scores binary, lowest double, n_words bigint, n_pairs bigint"
#: Log probabilities travel as one of so many levels between 0 and the lowest of their bucket: within 0.0001 for a token.
LEVELS = 65_535


def _predict(row, p: dict, rule: ModelRule):
    """Averaged predictive log10 probabilities of all pairs of a bucket, dealt back to the chunks."""
    import pyarrow as pa

    hot, n, words = p["deal"].places(row), row["n_pairs"], row["n_words"]
    counts = _unpack(row["counts"], np.int64, n)
    context, word = _unpack(row["contexts"], np.uint32, n), _unpack(row["word_at"], np.uint32, n)
    sum_p, customers = np.zeros(n), _totals_of(row["customers"])
    for k, of_root in enumerate(p["kept"]):
        totals = Totals(customers, _totals_of(row[f"parts_{k}"]), *of_root)
        tables, root = _unpack(row[f"tables_{k}"], np.int64, n), _unpack(row[f"root_{k}"], np.int64, words)
        at_root = np.bincount(word, weights=tables, minlength=words)
        if hot is not None:
            at_root, root = (x[hot] for x in p["kept_hot"][k])
        parent = root_probability(at_root, root, totals, p["root_discount"], rule, p["vocabulary"])[word]
        from_parent = (rule.strength + p["discount"] * totals.tables[context]) * parent
        sum_p += (np.maximum(counts - p["discount"] * tables, 0) + from_parent) / (rule.strength + totals.customers[context])
    score = np.log10(sum_p / len(p["kept"]))
    of_word = np.bincount(word, weights=counts, minlength=words).astype(np.int64)
    n_words, n_pairs = row["chunk_words"], row["chunk_pairs"]
    word_steps = np.split(_unpack(row["word_places"], np.uint32, sum(n_words)), np.cumsum(n_words)[:-1])
    pair_steps = np.split(_unpack(row["pair_places"], np.uint32, sum(n_pairs)), np.cumsum(n_pairs)[:-1])
    lowest = float(score.min(initial=0.0))
    level = np.rint(score / (lowest or 1.0) * LEVELS).astype(np.uint16)
    rows = [
        (c, row["bucket"], _pack(of_word[np.cumsum(a)]), _pack(level[np.cumsum(b)]), lowest, len(a), len(b))
        for c, a, b in zip(row["chunks"], word_steps, pair_steps, strict=True)
    ]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64()]
    names = [c.strip().split()[0] for c in BACK.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


SCORES = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(left, right, p: dict, id_kind):
    """A coded row and what its buckets sent back, to one row per document."""
    import pyarrow as pa

    own = Coded(row_dicts(left)[0])
    blocks = sorted(row_dicts(right), key=lambda r: r["bucket"])
    counts = [_unpack(r["counts"], np.int64, r["n_words"]) for r in blocks if r["bucket"] < p["deal"].n_buckets]
    scores = np.concatenate([_unpack(r["scores"], np.uint16, r["n_pairs"]) * (r["lowest"] / LEVELS) for r in blocks])
    keys, _, at = own.pairs()
    if len(p["deal"].hot):
        _, order = p["deal"].pairs(own.words, keys // own.n_words, keys % own.n_words)
        scores[order] = scores.copy()
        hot, known = np.isin(own.words, p["deal"].hot), np.empty(own.n_words, np.int64)
        known[~hot] = np.concatenate([np.empty(0, np.int64), *counts])
        known[hot] = p["hot_counts"][np.searchsorted(p["deal"].hot, own.words[hot])]
        counts = [known]
    counts = np.concatenate(counts)
    n, v = p["train_tokens"], p["vocabulary"]
    base = np.log10((counts + 1) / (n + 1 * (v + 1)))
    starts = np.concatenate([[0], np.cumsum(own.lengths)[:-1]])
    ids = pa.array([None if x else int(d) for x, d in zip(own.nulls, own.docs, strict=True)], pa.int64()).cast(id_kind)
    return pa.table(
        [
            ids, pa.array(own.held), pa.array(own.lengths),
            pa.array(np.add.reduceat((counts > 0)[own.tokens].astype(np.int64), starts)),
            pa.array(np.full(own.n_docs, n, np.int64)),
            pa.array(np.add.reduceat(base[own.tokens], starts)),
            pa.array(np.add.reduceat(scores[at], starts)),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def language_model_scores(
    docs: DataFrame, rule: ModelRule = ModelRule(), chunk_tokens: int = CHUNK_TOKENS, part_sums: int = PART_SUMS, hot_tokens: int = HOT_TOKENS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per document row.

    score: the model's log10 probability of the text with its end mark; perplexity is 10 ** (-score / n_tokens). base_score: the
    same under add-one word counts. Null and empty texts are the end mark alone. doc_id must be of an integer type, null ids are
    given back as null. Without training tokens every token has probability 1 under both. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    # rows of megabytes: a batch holds few of them
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    id_type = docs.schema["doc_id"].dataType
    coded = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(lambda b: _code(b, chunk_tokens), CHUNK)
    # numbered before it is written: the number is part of the table and stays the same in all later reads
    # kept by chunk, so that the tokens are not shuffled when scores come back
    coded = kept_by(coded.withColumn("chunk", F.monotonically_increasing_id()), "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")))

    train_tokens = int(coded.select("n_docs", "held", "lengths").mapInArrow(lambda b: each_row(b, _train_tokens), "n bigint").agg(F.sum("n")).first()[0] or 0)
    n_buckets = max(4, math.ceil(train_tokens / BUCKET_TOKENS))
    often = coded.select("n_often", "often", "often_counts").mapInArrow(lambda b: each_row(b, _often), "word bigint, n bigint")
    hot = {r.word: r.n for r in often.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > hot_tokens).collect()}
    n_hot = max(2, math.ceil(sum(hot.values()) / BUCKET_TOKENS)) if hot else 0
    deal = Deal(n_buckets, n_hot, np.sort(np.array([*hot], np.int64).view(np.uint64)))
    n_all = n_buckets + n_hot
    blocks = coded.drop("n_often", "often", "often_counts").mapInArrow(lambda b: each_row(b, lambda r: _emit_counts(r, deal)), SEATS)
    # all tables of buckets are kept by bucket, so that the large ones are never shuffled again when sweeps join them
    buckets = kept_by(blocks.groupBy("bucket").applyInArrow(lambda key, t: leanly(_gather, key, t, n_buckets), BUCKET), "bucket", n_all)

    counted = ("vocabulary", "singles", "doubles", "n_contexts")
    sums = buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted]).first()
    hot_rows = buckets.where(F.col("bucket") >= n_buckets).select("bucket", "n_words", "n_pairs", "words", "word_at", "counts")
    hot_counts = _hot_sums(hot_rows.mapInArrow(lambda b: each_row(b, lambda r: _hot_counts(r, deal)), "place int, n bigint"), len(hot))
    vocabulary = sums.vocabulary + int((hot_counts > 0).sum())
    n_parts = max(1, math.ceil(sums.n_contexts / part_sums))
    named = buckets.select("bucket", "n_pairs", "n_contexts", "names", "contexts", "counts").mapInArrow(
        lambda b: each_row(b, lambda r: _emit_contexts(r, n_parts)), "part int, bucket int, n bigint, names binary, sums binary"
    )
    places = cut_lineage(named.groupBy("part").applyInArrow(lambda key, t: leanly(_place, key, t), PLACES))
    customers = kept_by(_by_bucket(places.select("part", "bucket", "n", "totals")), "bucket", n_all)
    places = places.select("part", "bucket", "n", "places")

    discount = _discount(sums.singles, sums.doubles)
    settings = {"root": None, "vocabulary": vocabulary, "deal": deal, "hot": None, "discount": discount, "root_discount": discount}
    settings |= {"stirling": (s := log_stirling(STIRLING, discount)), "root_stirling": s}
    seats, parts, kept, kept_hot, saved = None, customers, [], [], []
    seat = buckets.select("bucket", "n_pairs", "n_words", "n_contexts", "counts", "contexts", "words", "word_at")
    for number in range(1 + rule.burn_in + rule.kept):
        value = spark.sparkContext.broadcast(dict(settings))
        table = _with_bucket(seat if seats is None else _with_bucket(seat, seats), parts)
        swept = table.mapInArrow(lambda b, v=value, k=number: each_row(b, lambda r: _sweep(r, v.value, rule, k)), SWEEP)
        swept = kept_by(swept, "bucket", n_all)
        ends = swept.agg(F.sum("root_customers").alias("c"), F.sum("root_tables").alias("t")).first()
        at_root = _hot_sums(swept.select(F.inline("hot")), len(hot))
        root = _seat_hot(at_root, settings, rule, number)
        settings |= {"root": (int(ends.c or 0), int(ends.t or 0) + int(root.sum())), "hot": (at_root, root)}
        sent = swept.select("bucket", F.inline("of_context"))
        added = sent.groupBy("part").cogroup(places.groupBy("part")).applyInArrow(
            lambda key, left, right: leanly(_add_up, key, left, right), "part int, bucket int, n bigint, totals binary"
        )
        parts = kept_by(_by_bucket(added), "bucket", n_all)
        seats = swept.select("bucket", "tables", "root")
        if number > rule.burn_in:
            kept.append(settings["root"])
            kept_hot.append(settings["hot"])
            saved.append((seats, parts))

    final = spark.sparkContext.broadcast(
        {"kept": kept, "kept_hot": kept_hot, "hot_counts": hot_counts, "train_tokens": train_tokens}
        | {k: settings[k] for k in ("vocabulary", "deal", "discount", "root_discount")}
    )
    table = _with_bucket(buckets.drop("names"), customers.withColumnRenamed("parts", "customers"))
    for k, (seats, parts) in enumerate(saved):
        table = _with_bucket(table, seats.select("bucket", F.col("tables").alias(f"tables_{k}"), F.col("root").alias(f"root_{k}")))
        table = _with_bucket(table, parts.select("bucket", F.col("parts").alias(f"parts_{k}")))
    back = table.mapInArrow(lambda b: each_row(b, lambda r: _predict(r, final.value, rule)), BACK)
    kind = to_arrow_type(id_type)
    return coded.drop("n_often", "often", "often_counts", *([] if hot else ["words"])).groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        lambda key, left, right: leanly(_score, left, right, final.value, kind), f"doc_id {id_type.simpleString()}, {SCORES}"
    )
