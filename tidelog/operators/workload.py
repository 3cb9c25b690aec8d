"""Workload generators and the reductions over ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the characters of keys and values.
CHARSET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def random_string(seed: Column, length: int) -> Column:
    """``length`` characters of a-z, A-Z and 0-9 that follow from the seed alone."""
    at = lambda i: F.pmod(F.xxhash64(seed, i), F.lit(len(CHARSET))).cast("int") + 1
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.lit(CHARSET).substr(at(i), F.lit(1))), "")


def key_set(spark: SparkSession, count: int, ranks: int, length: int = 16) -> DataFrame:
    """``count`` keys for each rank: (rank, i, key)."""
    ids = spark.range(count * ranks)
    return ids.select((F.col("id") % ranks).cast("int").alias("rank"), F.floor(F.col("id") / ranks).alias("i"), random_string(F.col("id"), length).alias("key"))


def put_phase(keys: DataFrame, value_len: int) -> DataFrame:
    """One put for each key, in epoch 0."""
    return keys.select("rank", "i", F.lit(0).cast("bigint").alias("epoch"), F.lit("PUT").alias("op"), "key", random_string(F.hash("key"), value_len).alias("value"))


def mix(spark: SparkSession, count: int, ranks: int, update_ratio: int) -> DataFrame:
    """Operation i of a rank is an update if i % 100 is below the ratio, else a get: (rank, i, op)."""
    ids = spark.range(count * ranks)
    i = F.floor(F.col("id") / ranks)
    return ids.select((F.col("id") % ranks).cast("int").alias("rank"), i.alias("i"), F.when(i % 100 < update_ratio, "UPDATE").otherwise("GET").alias("op"))


def uniform_probe(ops: DataFrame, n_keys: int, seed: int) -> DataFrame:
    """Each operation with the number of one of ``n_keys`` keys, evenly chosen."""
    return ops.withColumn("key_no", F.pmod(F.xxhash64(F.lit(seed), "rank", "i"), F.lit(n_keys)))


def delete_phase(keys: DataFrame) -> DataFrame:
    """One delete for each key, in epoch 1."""
    return keys.select("rank", "i", F.lit(1).cast("bigint").alias("epoch"), F.lit("DEL").alias("op"), "key", F.lit(None).cast("string").alias("value"))


def reduce_ranks(times: DataFrame, group: list[str], value: str = "t") -> DataFrame:
    """Least, greatest, summed and mean time over ranks."""
    return times.groupBy(*group).agg(F.min(value).alias("t_min"), F.max(value).alias("t_max"), F.round(F.sum(value), 2).alias("t_sum"), F.round(F.sum(value) / F.count(value), 4).alias("t_avg"))


def rates(size: Column, count: Column, key_len: int, value_len: int, avg: Column) -> tuple[Column, Column]:
    """Thousand requests and MiB a second from ranks, operations of each, and the mean time."""
    krps = F.try_divide(size * count, avg) / 1000
    mbps = F.try_divide((key_len + value_len) * size * count, avg) / (1 << 20)
    return krps, mbps


def dataset_size(key_len: Column, value_len: Column, count: Column, ranks: Column) -> list[Column]:
    """Bytes, KB, MB and GB of a data set."""
    total = ((key_len + value_len) * count * ranks).cast("bigint")
    return [total.alias("bytes"), (total / 1024.0).alias("kb"), (total / 1048576.0).alias("mb"), (total / 1073741824.0).alias("gb")]
