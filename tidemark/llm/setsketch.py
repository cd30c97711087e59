"""Near duplicates by SetSketch registers, banding, likelihood and exact verification.

A SetSketch register holds floor(1 - log_b(h)), h being the smallest exponential variate over the shingles; the registers of a
union are the element-wise maxima. Equal registers tell of similar sets: bands of registers give candidate groups. Within a
group, all three counts of a pair (registers above, below, equal) and both set sizes give the maximum-likelihood similarity.
What it cannot rule out is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER_ASCII, as_bytes, cut_lineage, mixed, window_hashes, word_hashes
from tidemark.llm.components import connected


@dataclass(frozen=True)
class SketchRule:
    """Shingle width, similarity as a fraction, register law and banding.

    ``bands`` follows from ``miss``: a pair exactly at the threshold shares no band with at most that probability.
    """

    width: int = 3
    least: int = 85
    of: int = 100
    rows: int = 6
    miss: float = 1e-6
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65_534
    #: documents, and shingles, compared in one block; larger candidate groups take several blocks
    block_docs: int = 512
    block_shingles: int = 1_000_000

    @property
    def threshold(self) -> float:
        return self.least / self.of

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - self.threshold**self.rows))

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows of a text; a shorter text is one shingle, one without words none."""
    words = text.translate(LOWER_ASCII).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(width, len(words))))


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    draw = mixed(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (draw[:m] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draw[m:] >> np.uint64(32)).astype(np.uint32)


_coefficients: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def registers(shingles: np.ndarray, rule: SketchRule) -> np.ndarray:
    """The truncated logarithmic minima; 0 throughout for the empty set."""
    m = rule.registers
    if m not in _coefficients:
        _coefficients[m] = _multipliers(m)
    times, plus = _coefficients[m]
    if not len(shingles):
        return np.zeros(m, np.int32)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * times + plus).min(axis=0), out=least)
    h = -np.log1p(-(least + 0.5) / 2**32) / rule.rate
    return np.clip(np.floor(1 - np.log(h) / math.log(rule.base)), 0, rule.limit + 1).astype(np.int32)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(values: np.ndarray, rule: SketchRule) -> np.ndarray:
    """One 64-bit key per band of registers."""
    rows = values.reshape(rule.bands, rule.rows).astype(np.uint64)
    key = mixed(np.arange(1, rule.bands + 1, dtype=np.uint64))
    for k in range(rule.rows):
        key = mixed(key + rows[:, k])
    return key.view(np.int64)


def likely_similarity(above, below, equal, size_a, size_b, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their register counts and set sizes, on a grid of 1/200."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 201)[None, :] * top[:, None]

    def p(x):  # probability that one register lies above the other
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base)

    over, under = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = sum(np.where(n[:, None] > 0, n[:, None] * np.log(np.maximum(q, 1e-300)), 0) for n, q in ((above, over), (below, under), (equal, 1 - over - under)))
    return j[np.arange(len(j)), np.argmax(value, axis=1)]


class Forest:
    """Union-find over positions; the root is the smallest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray, rule: SketchRule) -> bool:
    """The exact test on full sets."""
    if not len(a) or not len(b) or min(len(a), len(b)) * rule.of < rule.least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return rule.of * common >= rule.least * (len(a) + len(b) - common)


def block_links(texts: list[bytes], visitor: np.ndarray, rule: SketchRule) -> Forest:
    """Link the texts of one block: all pairs if there are no visitors, else pairs of a visitor and another text.

    A pair whose ends are already connected needs no test. Others are tested exactly unless their likely similarity lies five
    standard deviations of the estimate below the threshold.
    """
    forest = Forest(len(texts))
    sets = [shingle_set(t, rule.width) for t in texts]
    size = np.array([len(s) for s in sets], float)
    values = np.stack([registers(s, rule) for s in sets])
    m, t = rule.registers, rule.threshold
    doubt = t - 5 * math.sqrt(t * (1 - t) / m)
    some = visitor.any()
    for i in range(len(texts)):
        if some and not visitor[i]:
            continue
        others = np.flatnonzero(~visitor) if some else np.arange(i + 1, len(texts))
        others = others[(np.minimum(size[others], size[i]) >= t * np.maximum(size[others], size[i])) & (size[others] > 0)]
        if not len(others) or not size[i]:
            continue
        equal = (values[others] == values[i]).sum(axis=1)
        near = equal >= m * max(0.0, doubt - 0.1)
        others, equal = others[near], equal[near]
        if not len(others):
            continue
        above = (values[i] > values[others]).sum(axis=1)
        likely = likely_similarity(above, m - above - equal, equal, np.full(len(others), size[i]), size[others], rule.base)
        for j in others[np.argsort(-likely, kind="stable")][: int((likely >= doubt).sum())]:
            if forest.root(i) != forest.root(j) and linked(sets[i], sets[j], rule):
                forest.join(i, int(j))
    return forest


def _sketches(batches, rule: SketchRule):
    import pyarrow as pa

    for batch in batches:
        sizes, digests, keys = [], [], []
        for text in as_bytes(batch["text"]):
            own = shingle_set(text, rule.width)
            sizes.append(len(own))
            digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            keys.append(band_keys(registers(own, rule), rule) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "keys"],
        )


def sketches(docs: DataFrame, rule: SketchRule) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set and its band keys (both null for texts without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda b: _sketches(b, rule), f"doc_id {kind}, n_shingles bigint, digest binary, keys array<bigint>"
    )


def _compare(batches, rule: SketchRule):
    """Rows sorted by (label, block, part) to links (a, b): each document and its root in the block."""
    import pyarrow as pa

    held: dict = {"key": None, "ids": [], "texts": [], "visitor": []}

    def links():
        ids = held["ids"]
        if len(ids) < 2:
            return
        forest = block_links(held["texts"], np.array(held["visitor"], bool), rule)
        pairs = [(ids[i], ids[r]) for i in range(len(ids)) if (r := forest.root(i)) != i]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], ["a", "b"])

    for batch in batches:
        for key, rep, text, visitor in zip(
            zip(batch["label"].to_pylist(), batch["block"].to_pylist(), batch["part"].to_pylist(), strict=True),
            batch["rep"].to_pylist(),
            as_bytes(batch["text"]),
            batch["visitor"].to_pylist(),
            strict=True,
        ):
            if key != held["key"]:
                yield from links()
                held.update(key=key, ids=[], texts=[], visitor=[])
            held["ids"].append(rep)
            held["texts"].append(text)
            held["visitor"].append(visitor)
    yield from links()


def _block_links(rows: DataFrame, kind: str, rule: SketchRule) -> DataFrame:
    return (
        rows.select("label", "block", "part", "rep", "text", "visitor")
        .repartition("label", "block", "part")
        .sortWithinPartitions("label", "block", "part", "rep")
        .mapInArrow(lambda b: _compare(b, rule), f"a {kind}, b {kind}")
    )


#: Bits of the filter that spares texts outside all groups the way through the shuffle: half a megabyte at any size of the corpus.
FILTER_BITS = 1 << 22


def perhaps_among(ids: DataFrame, column: str) -> Column:
    """A test on ``column`` that holds for all ids of ``ids`` and for some others: a bit for each hash, set on the executors.

    It only spares work. With very many ids most bits are set and it lets nearly all rows pass.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    cut = F.lit(32_768)
    maps = ids.groupBy(F.floor(slot / cut).alias("part")).agg(F.bitmap_construct_agg(slot % cut).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:
        bits[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(np.unpackbits(bits, bitorder="little").astype(bool))

    @F.arrow_udf(T.BooleanType())
    def passes(slots):
        import pyarrow as pa

        return pa.array(shared.value[slots.to_numpy(zero_copy_only=False)])

    return passes(slot)


def near_duplicates(docs: DataFrame, rule: SketchRule = SketchRule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per document row.

    component_id: the smallest doc_id reachable over links of at least ``rule.threshold``; kept: whether it is the row's own id.
    Texts without words (null, empty, white space) link with nothing. Rows of one doc_id are one vertex. A row with a null id
    takes the component of its equal texts, if any, and is not kept then; alone, its component is null and it is kept.

    Equal sets are one class from the start. Classes that share a band key with others form candidate groups; only their texts
    travel, once. A group is compared within blocks of bounded size. A group of several blocks is then tied together by a few
    ambassadors sent to each block; at last, each class outside its group's largest component visits the other blocks in which
    a class of another component shares a band key with it, so no candidate pair is left out. The guests of a block come in parts
    of bounded size, each compared with the block on its own, so no group is gathered.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = cut_lineage(sketches(docs, rule))
    classes = cut_lineage(
        sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    )
    bands = classes.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key", "lo")
    groups = connected(bands.join(shared, "key").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")))

    sizes = F.greatest(F.ceil(F.count(F.lit(1)) / rule.block_docs), F.ceil(F.sum("n") / rule.block_shingles)).cast("int")
    sized = classes.groupBy("rep").agg(F.max("n").alias("n")).join(groups.withColumnRenamed("node", "rep"), "rep")
    blocks = sized.groupBy("component").agg(sizes.alias("blocks"))
    members = sized.join(blocks, "component").select(
        "rep", F.col("component").alias("label"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "blocks", "n"
    )
    members = cut_lineage(members)
    own = docs.select(F.col("doc_id").alias("rep"), "text").where(perhaps_among(members, "rep"))
    texts = cut_lineage(own.join(members, "rep").withColumn("visitor", F.lit(False)).withColumn("part", F.lit(0)))
    links = cut_lineage(_block_links(texts, kind, rule))
    large = texts.where("blocks > 1")
    if large.select("rep").limit(1).count():
        links = _tied(large, links, classes, kind, rule)
    found = connected(links)

    class_of = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("digest").alias("__digest"), F.coalesce("component", "rep").alias("component_id")
    )
    out = sketch.join(class_of, F.col("digest") == F.col("__digest"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", F.when(F.col("digest").isNull() | F.col("component_id").isNull(), F.col("doc_id"))).alias("component_id"),
    )
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.withColumn("kept", kept)


AMBASSADORS = 16


def _tied(large: DataFrame, links: DataFrame, classes: DataFrame, kind: str, rule: SketchRule) -> DataFrame:
    """Links between the blocks of groups that take several."""
    from pyspark.sql import Window

    linked_ids = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("rep", F.lit("ambassador")), "rep")
    chosen = (
        large.join(linked_ids, "rep", "left_semi").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= AMBASSADORS)
    )
    sent = chosen.withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
    rows = large.select("label", "block", "part", "rep", "text", "visitor").unionAll(
        sent.select("label", "block", "part", "rep", "text", F.lit(True).alias("visitor"))
    )
    links = cut_lineage(links.unionAll(_block_links(rows, kind, rule)))

    now = connected(links).withColumnRenamed("node", "rep")
    placed = cut_lineage(
        large.select("label", "block", "rep").distinct().join(now, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    )
    counts = placed.groupBy("label", "component").count()
    main = counts.groupBy("label").agg(F.max(F.struct("count", "component")).alias("m")).select("label", F.col("m.component").alias("main"))
    keyed = placed.join(classes.select("rep", "keys"), "rep").select("label", "block", "rep", "component", F.explode("keys").alias("key"))
    keyed = cut_lineage(keyed)
    rest = keyed.join(main, "label").where("component <> main").select("key", "label", "rep", F.col("block").alias("home"), F.col("component").alias("own"))
    # what a block has of a key is two components at most: another than a guest's own is among them if there is any
    spots = keyed.groupBy("key", "label", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    homes = rest.select("key", "label", "home").distinct()
    met = homes.join(spots, ["key", "label"]).where("block <> home")
    visits = cut_lineage(
        rest.join(met, ["key", "label", "home"]).where("lo <> own OR hi <> own").select("label", "block", "rep").distinct()
    )
    guests = visits.join(large.select("rep", "n"), "rep").groupBy("label", "block")
    parts = cut_lineage(
        guests.agg(F.greatest(F.ceil(F.count(F.lit(1)) / rule.block_docs), F.ceil(F.sum("n") / rule.block_shingles)).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("rep", F.lit("guest")), F.col("parts")).cast("int")
    guests = visits.join(parts, ["label", "block"]).select("label", "block", part.alias("part"), "rep").join(large.select("rep", "text"), "rep")
    hosts = large.drop("part").join(parts, ["label", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = hosts.select("label", "block", "part", "rep", "text", "visitor").unionAll(
        guests.select("label", "block", "part", "rep", "text", F.lit(True).alias("visitor"))
    )
    return cut_lineage(links.unionAll(_block_links(rows, kind, rule)))


def one_of_each(docs: DataFrame, rule: SketchRule = SketchRule()) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is kept. Rows sharing a doc_id stay or go together, null ids stay."""
    gone = near_duplicates(docs, rule).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
