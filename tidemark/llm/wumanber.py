"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. Test strings are all windows of ``width`` consecutive words of a
benchmark item, or the whole item where it is shorter. For each pattern length there is one
shift table over blocks of two words: a block that ends no window says how far the search may
jump. A block that ends some window selects a suffix bucket, whose entries are told apart by
their first words and confirmed by direct comparison.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import as_bytes

#: Lower-cases A-Z and blanks ASCII characters outside words; words are then what white space separates.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Benchmark text in one set of tables; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class PatternTable:
    """Shift table, suffix buckets and test strings of one pattern length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.longest_shift = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))

    def add(self, words: tuple, items: list[int]) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = words[end - b : end]
            self.shift[key] = min(self.shift.get(key, self.longest_shift), m - end)
        self.buckets[words[m - b :]][words[:b]].append((words, items))

    def scan(self, words: list[bytes], spans: list, found: set) -> None:
        m, b, n = self.length, self.block, len(words)
        shift, buckets, far = self.shift.get, self.buckets, self.longest_shift
        end = m
        while end <= n:
            key = tuple(words[end - b : end])
            jump = shift(key, far)
            if jump:
                end += jump
                continue
            start = end - m
            for pattern, items in buckets[key].get(tuple(words[start : start + b]), ()):
                if tuple(words[start:end]) == pattern:
                    spans.append((start, end))
                    found.update(items)
            end += 1


class Matcher:
    """Tables of one benchmark block. ``items``: (id as text, text as bytes)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.names: list[str] = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple, set[int]] = defaultdict(set)
        for name, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                owners[tuple(words[i : i + width])].add(place[name])
        tables: dict[int, PatternTable] = {}
        for pattern, own in owners.items():
            tables.setdefault(len(pattern), PatternTable(len(pattern))).add(pattern, sorted(own))
        self.tables = list(tables.values())

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Disjoint spans of hit words in order, and the ids of items with an occurring window, sorted as text."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for table in self.tables:
            table.scan(words, spans, found)
        return union_of(spans), [self.names[i] for i in sorted(found)]


def union_of(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_matchers: dict = {}


def _matcher(key: str, shared, width: int) -> Matcher:
    """The tables of a broadcast block, built once per worker."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(shared.value, width)
    return _matchers[key]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _search_column(text: Column, shared, width: int) -> Column:
    key = uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def search(column):
        import pyarrow as pa

        matcher, counts, spans, items = _matcher(key, shared, width), [], [], []
        for value in as_bytes(column):
            words = words_of(value)
            where, which = matcher.find(words)
            counts.append(len(words))
            spans.append([x for span in where for x in span])
            items.append(which)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "spans", "items"],
        )

    return search(text)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _union_spans(column):
    import pyarrow as pa

    out = []
    for blocks in column.to_pylist():
        pairs = [(flat[i], flat[i + 1]) for flat in blocks for i in range(0, len(flat), 2)]
        out.append([x for span in union_of(pairs) for x in span])
    return pa.array(out, pa.list_(pa.int32()))


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Broadcast the items in blocks of about ``block_bytes`` of text."""
    spark = benchmark.sparkSession
    items = benchmark.where("text IS NOT NULL").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast([(r.name, bytes(r.text)) for r in part.collect()])


def search(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in every document.

    Input: ``docs`` (doc_id, text), ``benchmark`` (item_id, text); other columns are ignored.
    Result, one row per document row: doc_id, n_words, spans (array of word offsets: start, end, start, end …, disjoint, in
    order), items (ids of items with an occurring window, sorted as text). A null or empty text has no words and no hits; a
    null benchmark text is no item; a null item id counts as ''; repeated ids are one item; an empty benchmark hits nothing.

    The benchmark is broadcast in blocks of ``block_bytes``, so its size is bounded at any time; with more than one block each
    pass keeps only documents with hits and their spans are united per (doc_id, text).
    """
    shared = list(_blocks(benchmark, block_bytes))
    if len(shared) == 1:
        return with_hits(docs.select("doc_id", "text"), shared[0], width).select(
            "doc_id", "__found.n_words", "__found.spans", "__found.items"
        )
    return _united(docs, shared, width).drop("__key")


def _united(docs: DataFrame, shared: list, width: int) -> DataFrame:
    """The result of :func:`search` over several blocks, with the hash of the text as __key."""
    own = docs.select("doc_id", "text")
    passes = [
        with_hits(own, one, width)
        .select("doc_id", F.xxhash64("text").alias("__h"), F.col("__found.spans").alias("s"), F.col("__found.items").alias("i"))
        .where(F.size("s") > 0)
        for one in shared
    ]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionAll(more)
    # a document has at most one row per block here, repeated rows have equal ones
    hits = every.distinct().groupBy(F.col("doc_id").alias("__d"), "__h").agg(
        F.collect_list("s").alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("items")
    )
    none = with_hits(own, docs.sparkSession.sparkContext.broadcast([]), width)
    return (
        none.withColumn("__key", F.xxhash64("text"))
        .join(hits, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__h")), "left")
        .select(
            "doc_id",
            "__key",
            "__found.n_words",
            _union_spans(F.coalesce("s", F.array().cast("array<array<int>>"))).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def with_hits(docs: DataFrame, shared, width: int = 13) -> DataFrame:
    """``docs`` with ``__found``: the hits of one broadcast benchmark block in ``text``."""
    return docs.withColumn("__found", _search_column(F.col("text"), shared, width))


def hit_words(spans: Column) -> Column:
    """Number of words inside disjoint spans: ends minus starts."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def verdicts(found: DataFrame) -> DataFrame:
    """From :func:`search`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated. Rows without text stay."""
    shared = list(_blocks(benchmark, block_bytes))
    if len(shared) == 1:
        found = _search_column(F.col("text"), shared[0], width)
        bad = is_contaminated(hit_words(found["spans"]), found["n_words"])
        return docs.where(~F.coalesce(bad, F.lit(False)))
    found = _united(docs, shared, width)
    bad = found.where(is_contaminated(hit_words(F.col("spans")), F.col("n_words"))).select(F.col("doc_id").alias("__bad"), "__key").distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__bad")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(bad, same, "left_anti")
