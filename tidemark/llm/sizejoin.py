"""N-gram Jaccard join by set size: small sets by their subsets, large sets by inverted lists.

Two sets of n and m shingles are linked if they share at least ``need(n, m)``. A small set is written out as all its subsets of
each size a link may need; sets that meet in a subset of size c are linked if and only if c is enough for their sizes, so all
links of a meeting place follow from its smallest set. A large set is looked up in the inverted lists of its rarest shingles, of
which linked sets share one; sets that meet there are gathered in blocks of bounded size, in which one scan of the inverted
lists of a set counts what it shares with every other. The size at which the ways part is the one of least estimated cost.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, cut_lineage, mixed
from tidemark.llm.components import connected
from tidemark.llm.setsketch import Forest, perhaps_among, shingle_set


@dataclass(frozen=True)
class JoinRule:
    """Shingle width and similarity as a fraction ``least / of``; bounds of one block; estimated costs."""

    width: int = 4
    least: int = 85
    of: int = 100
    block_sets: int = 512
    block_shingles: int = 1_000_000
    #: no set larger than this is written out as subsets, whatever the estimate says
    most_small: int = 24
    #: estimated cost of a shingle of a set that is gathered and scanned, against one entry of an index
    scan_cost: float = 0.5
    #: counters that tell rare shingles from frequent ones, the same number at any size of the corpus
    counters: int = 1 << 20
    #: hubs of a group that are sent to all its blocks
    ambassadors: int = 16

    def need(self, n: int, m: int) -> int:
        return -(-self.least * (n + m) // (self.least + self.of))

    def partners(self, n: int) -> range:
        """Sizes a set of ``n`` can be linked with."""
        return range(-(-self.least * n // self.of), self.of * n // self.least + 1)

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({self.need(n, m) for m in self.partners(n)} & set(range(1, n + 1)))

    def prefix(self, n: int) -> int:
        """A linked partner holds at least one of any so many shingles."""
        return n - -(-self.least * n // self.of) + 1

    def together(self, c: int) -> int:
        """The largest n + m for which c common shingles are enough."""
        return c * (self.least + self.of) // self.least


def boundary(sizes: dict[int, int], rule: JoinRule) -> int:
    """The size up to which subsets cost least. ``sizes``: number of sets of each size up to ``most_small``.

    Sets just below the boundary may be linked with larger ones, so they are in both indexes.
    """

    def cost(b: int) -> float:
        small = sum(k * sum(math.comb(n, c) for c in rule.subset_sizes(n)) for n, k in sizes.items() if n <= b)
        large = sum(k * (rule.prefix(n) + rule.scan_cost * n) for n, k in sizes.items() if n >= rule.partners(b + 1)[0])
        return small + large

    return min(range(rule.most_small + 1), key=cost)


def _survey(batches, rule: JoinRule):
    """Per row its set's size and digest; at the end of the task, in parts, how often its shingles fell on each counter."""
    import pyarrow as pa

    counts = np.zeros(rule.counters, np.int64)
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        sizes, digests = [], []
        for text in as_bytes(batch["text"]):
            own = shingle_set(text, rule.width)
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            np.add.at(counts, (own & np.uint64(rule.counters - 1)).astype(np.int64), 1)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["th"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array([None if d is None else name_of(d) for d in digests], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            ["doc_id", "th", "n_shingles", "digest", "name", "part", "counts"],
        )
    if kind is not None:
        parts = counts.reshape(-1, min(rule.counters, 1 << 14))
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()),
             pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())],
            ["doc_id", "th", "n_shingles", "digest", "name", "part", "counts"],
        )


def _added(batches):
    """Rows sorted by part to one row per part, the counts added up."""
    import pyarrow as pa

    now, total = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["part", "counts"])

    for batch in batches:
        for part, raw in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    yield row()
                now, total = part, np.zeros(len(raw) // 4)
            total += np.frombuffer(raw, "<i4")
    if now is not None:
        yield row()


_SECOND = np.uint64(0x9E3779B97F4A7C15)


def subset_keys(own: np.ndarray, c: int):
    """Two 64-bit sums for each subset of c of the shingles: all but those left out."""
    first, second = mixed(own), mixed(own ^ _SECOND)
    every = np.array([first.sum(), second.sum()])
    for out in itertools.combinations(range(len(own)), len(own) - c):
        k = list(out)
        yield tuple(every - np.array([first[k].sum(), second[k].sum()]))


def name_of(digest: bytes) -> int:
    """A short name of a set for the index; two sets of one name are told apart when they are compared."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _entries(batches, counts: np.ndarray, bound: int, rule: JoinRule):
    """Each set's entries in the two indexes: digest, n, subset (its size), key and key2 of subsets; name and key of shingles."""
    import pyarrow as pa

    floor = rule.partners(bound + 1)[0]
    mask = np.uint64(rule.counters - 1)

    def batch_of(rows, digest, name, n, subset, keys, key2):
        both = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (keys, key2)]
        kinds = [(digest, pa.binary()), (name, pa.int64()), (n, pa.int32()), (subset, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.array([v] * rows, t) if v is not None else pa.nulls(rows, t) for v, t in kinds] + both, ["digest", "name", "n", "subset", "key", "key2"]
        )

    for batch in batches:
        for raw in as_bytes(batch["text"]):
            own = shingle_set(raw, rule.width)
            n = len(own)
            if not n:
                continue
            digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            if n <= bound:
                for c in rule.subset_sizes(n):
                    both = list(subset_keys(own, c))
                    yield batch_of(len(both), digest, None, n, c, [b[0] for b in both], [b[1] for b in both])
            if n >= floor:
                p = rule.prefix(n)
                often = counts[(own & mask).astype(np.int64)]
                rare = own[np.lexsort((own, often))[:p]]
                yield batch_of(p, None, name_of(digest), None, None, rare, np.zeros(p, np.uint64))


def _packed(batches, most: int = 20_000):
    """Small batches put together."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def scan(lists: tuple, own: np.ndarray, members: int) -> np.ndarray:
    """What ``own`` has in common with each member: one scan of the inverted lists of its shingles."""
    tokens, starts, owners = lists
    if not len(tokens):
        return np.zeros(members, np.int64)
    at = np.searchsorted(tokens, own)
    at[at == len(tokens)] = 0
    at = at[tokens[at] == own]
    lo, n = starts[at], starts[at + 1] - starts[at]
    where = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return np.bincount(owners[where], minlength=members)


def inverted(sets: list[np.ndarray], shared_only: bool) -> tuple:
    """Sorted shingles, where the list of each begins, and the owners in the lists."""
    if not sets:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int64)
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    ends = np.append(first[1:], len(tokens))
    if shared_only:  # a shingle of one member tells nothing when members look up each other
        keep = ends - first > 1
        owners = owners[np.repeat(keep, ends - first)]
        n = (ends - first)[keep]
        return tokens[first[keep]], np.concatenate(([0], np.cumsum(n))), owners
    return tokens[first], np.append(first, len(tokens)), owners


def block_links(sets: list[np.ndarray], visitor: np.ndarray, rule: JoinRule):
    """Links (member, hub, links of the hub) of a block: all pairs if there are no visitors, else pairs of a visitor and a host.

    Members come in order of size, so that a scan that has linked all members ends the work.
    """
    size = np.array([len(s) for s in sets])
    forest, left = Forest(len(sets)), len(sets) - 1
    hosts = np.flatnonzero(~visitor) if visitor.any() else np.arange(len(sets))
    lists = inverted([sets[i] for i in hosts], not visitor.any())
    for i in np.flatnonzero(visitor) if visitor.any() else hosts:
        common = scan(lists, sets[i], len(hosts))
        near = hosts[(common > 0) & (rule.of * common >= rule.least * (size[hosts] + size[i] - common))]
        near = near[near != i]
        for j in near:
            a, b = forest.root(int(i)), forest.root(int(j))
            if a != b:
                forest.join(a, b)
                left -= 1
                yield int(j), int(i), len(near)
        if not left:
            return


def _compare(batches, rule: JoinRule):
    """Rows sorted by (label, block, part) to links (a, b, hub): digests, and the number of links of b."""
    import pyarrow as pa

    held: dict = {"key": None, "names": [], "sets": [], "visitor": []}

    def links():
        names = held["names"]
        found = list(block_links(held["sets"], np.array(held["visitor"], bool), rule)) if len(names) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _, _ in found], pa.binary()), pa.array([names[j] for _, j, _ in found], pa.binary()),
                 pa.array([n for _, _, n in found], pa.int32())],
                ["a", "b", "hub"],
            )

    for batch in batches:
        for key, name, text, visitor in zip(
            zip(batch["label"].to_pylist(), batch["block"].to_pylist(), batch["part"].to_pylist(), strict=True),
            batch["digest"].to_pylist(),
            as_bytes(batch["text"]),
            batch["visitor"].to_pylist(),
            strict=True,
        ):
            if key != held["key"]:
                yield from links()
                held.update(key=key, names=[], sets=[], visitor=[])
            held["names"].append(name)
            held["sets"].append(shingle_set(text, rule.width))
            held["visitor"].append(visitor)
    yield from links()


def _scanned(rows: DataFrame, rule: JoinRule) -> DataFrame:
    return (
        rows.select("label", "block", "part", "digest", "text", "visitor")
        .repartition("label", "block", "part")
        .sortWithinPartitions("label", "block", "part", "digest")
        .mapInArrow(lambda b: _compare(b, rule), "a binary, b binary, hub int")
    )


def _parts(rule: JoinRule):
    """Blocks of bounded size for the rows of a group."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / rule.block_sets), F.ceil(F.sum("n") / rule.block_shingles)).cast("int")


def _small_links(entries: DataFrame, rule: JoinRule) -> DataFrame:
    """Links of sets that meet in a subset: each with the smallest set there, if the subset is enough for both sizes.

    If it is enough for two sets, it is so for either of them and the smallest one, so nothing is lost.
    """
    keys = ["subset", "key", "key2"]
    rows = entries.where("subset IS NOT NULL")
    least = rows.groupBy(*keys).agg(F.min(F.struct("n", "digest")).alias("least"), F.max("digest").alias("hi"), F.min("digest").alias("lo"))
    met = rows.join(least.where("lo < hi").select(*keys, "least"), keys).where(F.col("digest") != F.col("least.digest"))
    together = F.floor(F.col("subset") * (rule.least + rule.of) / rule.least)
    return met.where(F.col("n") + F.col("least.n") <= together).select(F.col("digest").alias("a"), F.col("least.digest").alias("b")).distinct()


def set_join(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs`` (doc_id, text; other columns are not read).

    component_id: the smallest doc_id reachable over links of similarity ``least / of`` or more. A row is a vertex; rows of equal
    sets are one class, and rows that merely share a doc_id are not linked by it. Texts without words (null, empty, white
    space) link with nothing: n_shingles is 0 and component_id their own id. A null id counts only where no other is in reach.
    No link is left out: prefixes, subsets and numbers of shared shingles are exact filters, and all sets of a list that are not
    linked yet visit each other. Classes are never expanded into pairs, and no group is gathered in one task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    survey = cut_lineage(
        rows.mapInArrow(lambda b: _survey(b, rule), f"doc_id {kind}, th bigint, n_shingles bigint, digest binary, name bigint, part int, counts binary")
    )
    sketch = survey.where("part IS NULL").select("doc_id", "th", "n_shingles", "digest", "name")
    classes = cut_lineage(
        sketch.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least_id"), F.first("n_shingles").cast("int").alias("n"), F.first("name").alias("name"))
    )
    parts = survey.where("part IS NOT NULL").select("part", "counts").repartition("part").sortWithinPartitions("part")
    summed = {r.part: r.counts for r in parts.mapInArrow(_added, "part int, counts binary").collect()}  # four megabytes, always
    often = np.concatenate([np.frombuffer(summed[k], "<f4") for k in sorted(summed)]) if summed else np.zeros(rule.counters, "<f4")
    sizes = {r.n: r["count"] for r in classes.where(F.col("n") <= rule.most_small).groupBy("n").count().collect()}
    bound = boundary(sizes, rule)
    shared = docs.sparkSession.sparkContext.broadcast(often)
    entries = cut_lineage(
        docs.select("text")
        .where("text IS NOT NULL")
        .mapInArrow(lambda b: _packed(_entries(b, shared.value, bound, rule)), "digest binary, name bigint, n int, subset int, key bigint, key2 bigint")
    )
    links = cut_lineage(_small_links(entries, rule).unionAll(_large_links(docs, classes, entries, rule)))
    found = connected(links)
    joined = classes.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("component", "digest"))
    joined = cut_lineage(joined.select("digest", "root", "least_id"))
    named = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    class_of = joined.join(named, "root").select(F.col("digest").alias("__digest"), "component_id")
    return sketch.join(class_of, F.col("digest") == F.col("__digest"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _large_links(docs: DataFrame, classes: DataFrame, entries: DataFrame, rule: JoinRule) -> DataFrame:
    """Links (a, b: digests) of sets that meet in the inverted list of a rare shingle.

    Sets that share an eighth of their prefix with the least of the list are gathered first; then all others of a list are held
    against it, if the number of their shared shingles lets them be linked at all.
    """
    list_of = Window.partitionBy("key")
    prefix = entries.where("name IS NOT NULL").select("name", "key")
    lists = prefix.select("name", "key", F.min("name").over(list_of).alias("lo"), F.max("name").over(list_of).alias("hi"))
    postings = cut_lineage(lists.where("lo < hi").select("name", "key", "lo").distinct())
    sizes = classes.groupBy("name").agg(F.max("n").alias("n"))
    shared = cut_lineage(postings.groupBy("name").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "name"))
    edges = postings.where("name <> lo").groupBy("name", "lo").count().join(sizes, "name").where(8 * F.col("count") >= _prefix(F.col("n"), rule))
    groups = connected(edges.select(F.col("name").alias("a"), F.col("lo").alias("b")))
    sized = classes.select("digest", "name", "rep", "n").join(groups.withColumnRenamed("node", "name"), "name")
    blocks = sized.groupBy("component").agg(_parts(rule).alias("blocks"))
    members = cut_lineage(
        sized.join(blocks, "component").select(
            "digest", "rep", "n", F.col("component").alias("label"), F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"), "blocks"
        )
    )
    texts = cut_lineage(_with_texts(docs, members).withColumn("part", F.lit(0)).withColumn("visitor", F.lit(False)))
    links = cut_lineage(_scanned(texts, rule))
    large = texts.where("blocks > 1")
    if large.select("digest").limit(1).count():
        links = cut_lineage(links.unionAll(_hubs_visit(large, links, rule)))
    return links.unionAll(_across(docs, classes, _linkable(postings, shared, rule), links, rule)).select("a", "b")


def _may(n_from, n_to, most, rule: JoinRule):
    """Can a set (n, shared) be linked with one of a size from ``n_from`` to ``n_to`` that is in ``most`` lists?

    With c shingles common to both prefixes, two sets share at most c and what the one whose prefix ends first has beyond its
    prefix; c is at most the number of lists either is in.
    """
    smallest = F.greatest(n_from, F.ceil(F.col("n") * rule.least / rule.of))
    largest = F.least(n_to, F.floor(F.col("n") * rule.of / rule.least))

    def need(m):
        return F.ceil((F.col("n") + m) * rule.least / (rule.least + rule.of))

    beyond = lambda m: m - _prefix(m, rule)
    enough = F.least("shared", most)
    return (smallest <= largest) & ((need(smallest) - beyond(F.col("n")) <= enough) | (need(largest) - beyond(largest) <= enough))


def _linkable(postings: DataFrame, shared: DataFrame, rule: JoinRule) -> DataFrame:
    """name, key, n, shared: entries of sets that can be linked with another of the list. In a list of two, the other is known."""
    whole = Window.partitionBy("key")
    sums = {"k": F.count(F.lit(1)), "n_lo": F.min("n"), "n_hi": F.max("n"), "n_all": F.sum("n"), "s_hi": F.max("shared"), "s_all": F.sum("shared")}
    rows = postings.select("name", "key").join(shared, "name").select("*", *[e.over(whole).alias(c) for c, e in sums.items()])
    two = F.col("k") == 2
    other, its = F.col("n_all") - F.col("n"), F.col("s_all") - F.col("shared")
    may = _may(F.when(two, other).otherwise(F.col("n_lo")), F.when(two, other).otherwise(F.col("n_hi")), F.when(two, its).otherwise(F.col("s_hi")), rule)
    return cut_lineage(rows.where(may).select("name", "key", "n", "shared"))


def _prefix(n, rule: JoinRule):
    return n - F.ceil(n * rule.least / rule.of) + 1


def _with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (digest, rep, other columns) with a text of each digest. Texts of one id are made one where they meet the members."""

    def place(doc_id, th):
        return [th.alias("__th"), F.coalesce(doc_id.cast("string"), F.lit("")).alias("__doc"), doc_id.isNull().alias("__null")]

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    reps = members.select(*[c for c in members.columns if c != "rep"], *place(F.col("rep.doc_id"), F.col("rep.th")))
    own = own.where(perhaps_among(reps.select(F.col("__th").alias("th")), "th"))
    at = ["__th", "__doc", "__null"]
    own = own.select("text", *place(F.col("doc_id"), F.col("th"))).dropDuplicates(at)
    return own.join(reps, at).drop(*at)


def _hubs_visit(large: DataFrame, links: DataFrame, rule: JoinRule) -> DataFrame:
    """Links between the blocks of groups that take several: the sets with most links visit every block of their group."""
    hubs = links.groupBy(F.col("b").alias("digest")).agg(F.max("hub").alias("hub"))
    order = Window.partitionBy("label").orderBy(F.desc("hub"), "digest")
    chosen = large.join(hubs, "digest").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= rule.ambassadors)
    sent = chosen.withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
    sent = sent.select("label", "block", "part", "digest", "text", F.lit(True).alias("visitor"))
    visited = large.join(sent.select("label", "block").distinct(), ["label", "block"], "left_semi")
    return _scanned(visited.select("label", "block", "part", "digest", "text", "visitor").unionAll(sent), rule)


def _meetings(keyed: DataFrame, guests: DataFrame, spots: DataFrame, rule: JoinRule) -> tuple[DataFrame, DataFrame]:
    """Guests and the blocks they visit, and the hosts they may be linked with there: (block, name) each.

    Where two sets meet in a list, one at least is a guest. So of the lists common to a linked pair, one of the two is a guest in
    half or more, all of them in the other's block: a guest, and likewise a host, with fewer lists in a block has no link there.
    """
    met = guests.join(spots, "key").where("lo <> own OR hi <> own").where(_may(F.col("n_lo"), F.col("n_hi"), F.col("most"), rule))
    met = cut_lineage(met.select("key", "block", "name", "n", "shared", "n_lo", "n_hi", "most"))

    def enough(rows: DataFrame) -> DataFrame:
        least, most = (F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi")), F.least(F.max("most"), 2 * F.count(F.lit(1))).alias("most")
        sums = rows.groupBy("block", "name").agg(F.max("n").alias("n"), F.max("shared").alias("shared"), *least, most)
        return sums.where(_may(F.col("n_lo"), F.col("n_hi"), F.col("most"), rule)).select("block", "name")

    visits = cut_lineage(enough(met))
    visited = met.join(visits, ["block", "name"], "left_semi").groupBy("key", "block").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("shared").alias("most")
    )
    hosts = enough(keyed.select("key", "block", "name", "n", "shared").join(visited, ["key", "block"]))
    return visits, hosts


def _across(docs: DataFrame, classes: DataFrame, postings: DataFrame, links: DataFrame, rule: JoinRule) -> DataFrame:
    """Links of sets that are in one list (``postings``) but not yet in one component.

    In each list, the sets outside its most frequent component visit the blocks that hold others of it, if these have a set of a
    size for which the shared shingles are enough.
    """
    now = connected(links.select("a", "b"))
    of_class = classes.select("digest", "name").join(now.withColumnRenamed("node", "digest"), "digest", "left")
    placed = of_class.groupBy("name").agg(F.min(F.coalesce("component", "digest")).alias("component"))
    blocks = max(1, math.ceil(postings.select("name").distinct().count() / rule.block_sets))
    keyed = cut_lineage(postings.join(placed, "name").withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")))
    counts = keyed.groupBy("key", "component").count().groupBy("key").agg(
        F.max(F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("components")
    )
    mixed_lists = cut_lineage(counts.where("components > 1").select("key", F.col("most.component").alias("main")))
    keyed = cut_lineage(keyed.join(mixed_lists, "key"))
    # of a list, a block is told by two components at most: if it has any but a guest's own, one of the two is it
    spots = keyed.groupBy("key", "block").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("shared").alias("most")
    )
    guests = keyed.where("component <> main").select("key", "name", "n", "shared", F.col("component").alias("own"))
    visits, hosts = _meetings(keyed, guests, spots, rule)
    named = classes.select("name", "digest", "rep", "n")
    come = visits.join(named, "name")
    parts = cut_lineage(come.groupBy("block").agg(_parts(rule).alias("parts")))
    part = F.pmod(F.xxhash64("digest", F.lit("guest")), F.col("parts")).cast("int")
    come = come.join(parts, "block").select("block", part.alias("part"), "digest", "rep", F.lit(True).alias("visitor"))
    stay = hosts.join(parts, "block").join(named, "name").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "digest", "rep", F.lit(False).alias("visitor")
    )
    rows = cut_lineage(come.unionAll(stay).withColumn("label", F.lit(0)))
    return _scanned(_with_texts(docs, rows), rule)
