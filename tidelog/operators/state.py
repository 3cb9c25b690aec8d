"""Last-writer-wins state of an operation log: point, buffered and batch reads, deletes, sorted runs, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with further operations; columns are matched by name."""
    return log.unionByName(rows, allowMissingColumns=True)


def writes(log: DataFrame) -> DataFrame:
    """Puts and deletes, without reads."""
    return log.where(F.col("op").isin("PUT", "DEL"))


def latest(log: DataFrame, *order: str) -> DataFrame:
    """One row per key: the operation that is last in ``order`` (seq unless given), deletes included.

    A partial aggregate before the shuffle leaves one row for each key and task, so hot keys don't hurt.
    """
    by = F.struct(*(order or ("seq",)))
    last = writes(log).groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), by).alias("w"))
    return last.select("key", "w.op", F.when(F.col("w.op") == "PUT", F.col("w.value")).alias("value"), "w.seq")


def live(log: DataFrame) -> DataFrame:
    """Keys whose last write is a put."""
    return latest(log).where("op = 'PUT'").select("key", "value", "seq")


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose last write is a delete."""
    return latest(log).where("op = 'DEL'").select("key", "seq")


def status(op: Column) -> Column:
    """FOUND, DELETED or NOT_FOUND from the last write's op (null: none)."""
    return F.when(op == "PUT", "FOUND").when(op == "DEL", "DELETED").otherwise("NOT_FOUND")


def buffered(op: Column, value: Column, size: int) -> tuple[Column, Column, Column]:
    """Status, true length and copied value for a buffer of ``size`` bytes; a longer value isn't copied."""
    length = F.octet_length(value)
    too_small = (op == "PUT") & (length > size)
    return (
        F.when(too_small, "BUFFER_TOO_SMALL").otherwise(status(op)),
        F.when(op == "PUT", length).otherwise(0).cast("bigint"),
        F.when((op == "PUT") & ~too_small, value),
    )


def answer(op: Column, value: Column, size: int | None) -> list[Column]:
    """Columns status and value, and with a buffer's ``size`` value_len between them."""
    if size is None:
        return [status(op).alias("status"), F.when(op == "PUT", value).alias("value")]
    s, n, v = buffered(op, value, size)
    return [s.alias("status"), n.alias("value_len"), v.alias("value")]


def get(log: DataFrame, key: str) -> DataFrame:
    """One row: status and value of a key. The key's predicate reaches the scan."""
    one = writes(log).where(F.col("key") == key).agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    return one.select(F.lit(key).alias("key"), status(F.col("w.op")).alias("status"), F.when(F.col("w.op") == "PUT", F.col("w.value")).alias("value"))


def get_buffered(log: DataFrame, key: str, size: int) -> DataFrame:
    """One row: status, true length and value for a buffer of ``size`` bytes."""
    one = writes(log).where(F.col("key") == key).agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    s, n, v = buffered(F.col("w.op"), F.col("w.value"), size)
    return one.select(F.lit(key).alias("key"), s.alias("status"), n.alias("value_len"), v.alias("value"))


def multi_get(log: DataFrame, probes: DataFrame, size: int | None = None) -> DataFrame:
    """Batch of reads: every row of ``probes`` (key) with status, length and value. The sides' sizes choose the join."""
    found = probes.join(latest(log).select("key", "op", "value"), "key", "left")
    s, n, v = buffered(F.col("op"), F.col("value"), (1 << 31) - 1 if size is None else size)
    return found.select("key", s.alias("status"), n.alias("value_len"), v.alias("value"))


def sorted_run(log: DataFrame) -> DataFrame:
    """The state with deletes, in the bytewise order of keys."""
    return latest(log).orderBy("key")


def memtable_bytes(log: DataFrame) -> DataFrame:
    """Per epoch: entries and bytes (key, value and one flag byte) of the table that its last writes make."""
    last = writes(log).groupBy("epoch", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    size = F.octet_length("key") + F.when(F.col("w.op") == "PUT", F.octet_length("w.value")).otherwise(0) + 1
    return last.groupBy("epoch").agg(F.count("*").alias("entries"), F.sum(size).cast("bigint").alias("bytes"))


def cache_invalidate(cache: DataFrame, flushed: DataFrame) -> DataFrame:
    """Cache entries whose key isn't among those of a flushed table."""
    return cache.join(flushed.select("key").distinct(), "key", "left_anti")


def tier_lookup(probes: DataFrame, tiers: list[DataFrame], size: int | None = None) -> DataFrame:
    """Status of each probe in the first tier (key, op, value) that has the key; newer tiers come first.

    With a buffer's ``size``, also the true length; a longer value isn't copied.
    """
    every = None
    for rank, tier in enumerate(tiers):
        own = tier.select("key", F.lit(rank).alias("tier"), "op", "value")
        every = own if every is None else every.unionByName(own)
    first = every.groupBy("key").agg(F.min_by(F.struct("tier", "op", "value"), "tier").alias("w"))
    found = probes.join(first, "key", "left").select("key", F.col("w.tier").alias("tier"), F.col("w.op").alias("op"), F.col("w.value").alias("value"))
    return found.select("key", "tier", *answer(F.col("op"), F.col("value"), size))
