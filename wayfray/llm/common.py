"""Shared helpers of the text operators: checkpoints, word hashing, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components
from ..operators.components import release, shared_folder

#: A word of every contract here: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; texts may be long, so batches hold few of them.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frozen(df: DataFrame) -> DataFrame:
    """df in the shared checkpoint folder, its lineage cut and the shuffle files of what led to it let go: texts leave large ones."""
    out = components.frozen(df)
    del df
    release(out.sparkSession)
    return out


def arrow_map(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, batch: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with small batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    return df.mapInArrow(each, schema)


class Scratch:
    """Tables of one run, written as Parquet in a folder of its own below the session's checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again: its lineage ends here."""
        path = f"{self.folder}/{len(self._paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Tables that are not read any more go."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths[id(df)][0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered while under ``most`` words so that memory is bounded."""

    def __init__(self, most: int = 250_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(29)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word runs of a text, given its words' hashes."""
    h = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + len(h)]) * _M
        h ^= h >> _S
    return h


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


_BIT = np.uint64(0xD6E8FEB86659FD93)


def bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each 64-bit hash in a map of ``bits`` bits (a power of two)."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _BIT
    h ^= h >> np.uint64(32)
    mask = np.uint64(bits - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) * _BIT >> np.uint64(20) & mask).astype(np.int64)


def bit_map(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A map of ``bits`` bits with the places of all keys (long). At most bits / 64 rows reach the driver.

    It lets through every key and, the fuller it is, others too: an exact join must follow."""

    def each(batches):
        for b in batches:
            at = np.concatenate(bit_places(b.column(0).to_numpy().view(np.uint64), bits))
            one = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(one.view(np.int64))], ["w", "b"])

    rows = arrow_map(keys.select(column), each, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def in_map(have: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a map lets through."""
    ok = np.ones(len(h), bool)
    for at in bit_places(h, 64 * len(have)):
        ok &= (have[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return ok


def null_safe(c: Column | str) -> Column:
    """A string key that tells null from every string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its 0-based place in a total order, by range partitions and their counts.

    No task sees more than a range of rows; only one count per range meets in a window."""
    from pyspark.sql import Window as W

    parts = frozen(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = (
        parts.groupBy("_p").count()
        .withColumn("_b", F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
        .select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))
    )
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn(name, own.cast("long")).join(before, "_p").withColumn(name, F.col(name) + F.col("_b")).drop("_p", "_b")
