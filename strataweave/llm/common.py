"""Shared plumbing of the training-data operators: Arrow batch limits, intermediate tables, joins on hot keys, bitmaps that thin a join."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop, drop_path, new_path, ship

__all__ = ["drop", "drop_path", "drop_table", "key_join", "new_path", "partitions", "prepare", "read", "table", "thinned", "tidy"]

#: Arrow batches handed to Python hold at most this many rows and about this many bytes.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20
#: A key with more than a thousandth of the rows, and more than LEAST_HOT, is hot; there are at most HOT such keys, which bounds their broadcast.
HOT = 1000
LEAST_HOT = 512
#: Bits of a bitmap: 16 for every key, between these; at most 4096 buckets of 4 KB are broadcast.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27
_BUCKET = 1 << 15

table, drop_table = cut, drop


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and keep Arrow batches small enough for long texts.

    The two settings stay, as results are lazy and their plans run later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def tidy() -> None:
    """Give the memory that a finished task of a Python worker has freed back to the system; the worker lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_join(rows: DataFrame, keys: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with keys (one row a key; weight: how many of the `total` rows have it) such that no hot key fills a task.

    Hot keys, HOT at most, are told by their hashes and broadcast, and their rows stay where they are; the others meet by a shuffle.
    """
    place = F.xxhash64(key)
    hot = [r[0] for r in keys.filter(F.col(weight) > max(LEAST_HOT, total // HOT)).select(place).distinct().collect()]
    if not hot:
        return rows.join(keys, key)
    is_hot = F.expr(f"xxhash64(`{key}`) in ({', '.join(map(str, hot))})")
    return rows.filter(is_hot).join(F.broadcast(keys.filter(is_hot)), key).unionByName(rows.filter(~is_hot).join(keys.filter(~is_hot), key))


def thinned(rows: DataFrame, on: list[str], wanted: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """rows with a column that tells those whose key may be among the n keys of `wanted`: never false for a key that is.

    The keys' hashes set bits of a map, bounded by MOST_BITS whatever their number; rows look their own bit up. What passes
    must still be joined; what doesn't needs no shuffle.
    """
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    bucket, at = (place / _BUCKET).cast("int"), F.pmod(place, F.lit(_BUCKET))
    # bitmap_bit_position counts from 1.
    maps = wanted.select(bucket.alias("__bucket"), at.alias("__at")).groupBy("__bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("__at") + 1)).alias("__map"))
    marked = rows.withColumn("__bucket", bucket).withColumn("__at", at).join(F.broadcast(maps), "__bucket", "left")
    bit = "shiftright(cast(conv(hex(substring(__map, cast(__at div 8 as int) + 1, 1)), 16, 10) as int), cast(__at % 8 as int)) & 1"
    return marked, F.expr(f"coalesce(({bit}) = 1, false)")
