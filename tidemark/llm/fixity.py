"""Merkle fixity audit of archived web records.

Each record of an archive is hashed; records are ordered by offset, cut into offset ranges of equal width, and hashed upwards
into a tree with a fixed fan-out. Two replicas are compared at the root; only the children of differing nodes are looked at, and
only records of differing leaf ranges are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage

LEAF_BYTES = 1 << 20
FAN_OUT = 16


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record as bytes: header lines, payload, two line ends. A null payload is empty, a null url is ''."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(header.cast("binary"), body, F.lit(b"\r\n\r\n"))


def record_manifest(pages: DataFrame) -> DataFrame:
    """page_id, length and digest of each page's record. The page itself goes no further."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select("page_id", F.length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def with_offsets(manifest: DataFrame, blocks: int | None = None) -> DataFrame:
    """Add offset: records lie one after another in order of page_id (ties: by digest), the first at 0.

    Ranges of ids are summed on their own; their totals, one row per range, are the starts. Repeated rows follow each other.
    """
    n = blocks or max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)
    placed = cut_lineage(manifest.repartitionByRange(n, "page_id", "digest").withColumn("__block", F.spark_partition_id()))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__block").agg(F.sum("length").alias("__n")).select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    own = Window.partitionBy("__block").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("__i", F.coalesce(F.sum("length").over(own), F.lit(0)))
        .join(F.broadcast(starts), "__block")  # one row per range
        .withColumn("offset", (F.col("__from") + F.col("__i")).cast("long"))
        .drop("__block", "__i", "__from")
    )


def merkle_levels(manifest: DataFrame, leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Trees of a manifest (offset, length, digest), leaves first: node, hash. The last level has one row, the root.

    A leaf hashes 'offset:length:digest' of the records that start in its range, in offset order; an inner node hashes
    'node:hash' of its children. Ranges without records have no node. The number of levels follows the last offset; an empty
    manifest has one empty level.
    """
    level = _hashed(manifest.select(F.floor(F.col("offset") / leaf_bytes).alias("node"), "offset", F.concat_ws(":", "offset", "length", "digest").alias("line")))
    last = manifest.agg(F.max("offset")).first()[0]
    levels, top = [cut_lineage(level)], (last or 0) // leaf_bytes
    while top > 0:
        below = levels[-1]
        level = _hashed(below.select(F.floor(F.col("node") / fan_out).alias("node"), F.col("node").alias("offset"), F.concat_ws(":", "node", "hash").alias("line")))
        levels.append(cut_lineage(level))
        top //= fan_out
    return levels


def _hashed(lines: DataFrame) -> DataFrame:
    """A node has the records of one offset range, or ``fan_out`` children: its lines are bounded."""
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct("offset", "line"))), lambda x: x["line"])
    return lines.groupBy("node").agg(F.sha2(F.array_join(sorted_lines, "\n"), 256).alias("hash"))


def differing_leaves(ours: list[DataFrame], theirs: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """Leaf ranges (node) whose hashes differ or that one side lacks, found from the roots down.

    Trees of unequal height are compared from the lower one's top level on.
    """
    suspects: DataFrame | None = None
    for a, b in zip(reversed(ours[: len(theirs)]), reversed(theirs[: len(ours)]), strict=True):
        if suspects is not None:
            a, b = (x.join(suspects, F.floor(F.col("node") / fan_out) == F.col("__parent"), "left_semi") for x in (a, b))
        both = a.withColumnRenamed("hash", "ours").join(b.withColumnRenamed("hash", "theirs"), "node", "full")
        found = cut_lineage(both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("node"))
        suspects = found.withColumnRenamed("node", "__parent")
    return found


def audit(ours: DataFrame, theirs: DataFrame, leaf_bytes: int = LEAF_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """Records of the master manifest (page_id, offset, length, digest) and of a replica that disagree: offset, status.

    status: 'corrupt' (other bytes at the offset), 'missing' (not in the replica), 'extra' (only there). Both manifests must be
    written tables. Equal replicas, also two empty ones, give no rows.
    """
    trees = [merkle_levels(m, leaf_bytes, fan_out) for m in (ours, theirs)]
    leaves = differing_leaves(*trees, fan_out).withColumnRenamed("node", "__leaf")
    a, b = (
        m.select("offset", F.struct("length", "digest").alias(name)).join(leaves, F.floor(F.col("offset") / leaf_bytes) == F.col("__leaf"), "left_semi")
        for m, name in ((ours, "mine"), (theirs, "other"))
    )
    status = F.when(F.col("other").isNull(), "missing").when(F.col("mine").isNull(), "extra").when(F.col("mine") != F.col("other"), "corrupt")
    return a.join(b, "offset", "full").select("offset", status.alias("status")).where("status IS NOT NULL")
