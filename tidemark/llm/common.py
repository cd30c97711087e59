"""What the training-data operators share: words as bytes, word hashes, gapless numbers, blob columns."""

from __future__ import annotations

import math
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_folder, cut_lineage, ship_package

__all__ = [
    "LOWER_ASCII", "WordHashes", "as_bytes", "cut_lineage", "documents", "each_row", "kept_by", "leanly", "mixed", "numbered",
    "only_cache", "prepare", "row_dicts", "window_hashes", "word_hashes",
]

#: A-Z to a-z; every other byte of UTF-8 stays. ``bytes.split()`` then cuts at the six white-space characters of ASCII.
LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and let them take texts in small batches, as a row may hold megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return ship_package(spark)


def documents(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a driver table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


#: For rows of packed blobs of megabytes: a codec, a dictionary and least and greatest values would each hold copies of a blob,
#: and a page would otherwise be cut after 100 rows only.
PACKED = {
    "compression": "none", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false",
    "parquet.size.statistics.enabled": "false", "parquet.page.size.row.check.min": "1",
}


def kept_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df``, rows of packed blobs, as a table bucketed by ``key`` in the shared checkpoint folder: tables of one bucket number
    join without a shuffle."""
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(df.sparkSession)}/{name}"
    df.write.format("parquet").options(**PACKED).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def row_dicts(table) -> list[dict]:
    """Rows of an Arrow table or batch; blobs are not copied."""
    import pyarrow as pa

    def values(column):
        blob = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        return [x.as_buffer() for x in column] if blob else column.to_pylist()

    names = table.schema.names
    return [dict(zip(names, row, strict=True)) for row in zip(*map(values, table.columns), strict=True)]


def leanly(make, *args, **named):
    """Call ``make``; what it freed goes back to the system, as a reused worker would keep it through all later tasks."""
    import pyarrow as pa

    pool = pa.system_memory_pool()
    pa.set_memory_pool(pool)
    out = make(*args, **named)
    pool.release_unused()
    return out


def each_row(batches, make):
    """``make(row)`` for each row, one by one, as each may hold megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield leanly(lambda: make(row_dicts(batch.slice(i, 1))[0]))  # noqa: B023: called at once


def as_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (None where null), without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHashes(dict):
    """Word to 64-bit hash. Forgets everything at ``most`` words, so a worker's memory stays bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_cache: dict = {}


def only_cache(key, make):
    """The worker's one cache, kept over tasks: asking for another key drops the one before, so caches do not add up."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words, remembered by the worker."""
    return only_cache("word hashes", WordHashes).of(words)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive word hashes, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] * _ODD[0]
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _ODD[k % 5] + words[k : k + n]
    return mixed(out)


def numbered(df: DataFrame, group: str, order: list[str], out: str, rows_per_block: int = 50_000) -> DataFrame:
    """Add ``out``: gapless numbers from 0 within each value of ``group``.

    ``df`` must give the same rows whenever it runs (a written table). A group is cut
    into hash blocks of about ``rows_per_block`` rows, each numbered on its own;
    block counts, summed in block order, are the offsets. So a group that holds a third
    of all rows is still spread over many tasks.
    """
    blocks = max(1, math.ceil(df.count() / rows_per_block))
    cut = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n")).select(
        group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from")
    )
    own = Window.partitionBy(group, "__block").orderBy(*order)
    return (
        cut.withColumn("__i", F.row_number().over(own) - 1)
        .join(offsets, [group, "__block"])
        .withColumn(out, (F.col("__from") + F.col("__i")).cast("long"))
        .drop("__block", "__i", "__from")
    )
