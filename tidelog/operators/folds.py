"""Inherently sequential operators: memtable rollover and byte-bounded LRU caches, as streaming folds per owner.

Rows of an owner are sorted and pass through one task; what is kept is the table or the cache, which its option
bounds, never the log and never the store: what a read finds below the cache is resolved before, by an as-of lookup.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.tables import latest_before


class Memtable:
    """Bytes of a table: key and value and one flag byte for an entry, the value's difference for an overwrite."""

    def __init__(self):
        self.sizes: dict[bytes, int] = {}
        self.bytes = 0

    def put(self, key: bytes, value_len: int) -> None:
        old = self.sizes.get(key)
        self.bytes += value_len - old if old is not None else len(key) + value_len + 1
        self.sizes[key] = value_len


class LRUCache:
    """Keys with a size each; bytes are those of key and value; least recently used entries go while over the limit."""

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.entries: OrderedDict = OrderedDict()

    def get(self, key):
        """The entry (made most recent), or None."""
        if key not in self.entries:
            return None
        self.entries.move_to_end(key)
        return self.entries[key]

    def put(self, key, status: str, value_len: int) -> None:
        if key in self.entries:
            self.bytes += value_len - self.entries[key][1]
            self.entries.move_to_end(key)
        else:
            self.bytes += len(key) + value_len
        self.entries[key] = (status, value_len)
        while self.bytes > self.limit and self.entries:
            old, (_, n) = self.entries.popitem(last=False)
            self.bytes -= len(old) + n

    def __len__(self) -> int:
        """Bytes of all entries, as the limit counts them."""
        return self.bytes

    def clear(self) -> None:
        """Forget all entries."""
        self.entries.clear()
        self.bytes = 0

    def invalidate(self, keys) -> None:
        for key in keys:
            if key in self.entries:
                _, n = self.entries.pop(key)
                self.bytes -= len(key) + n


def fold(log: DataFrame, columns: list[str], schema: T.StructType, start: Callable, end: Callable | None = None) -> DataFrame:
    """Rows of each owner in order of seq through ``start(owner)``, a function from a row to a list of output rows."""
    dealt = log.select("owner", "seq", *columns).repartition("owner").sortWithinPartitions("owner", "seq")

    def run(batches: Iterator[pa.RecordBatch]):
        now, step, state = object(), None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[0] != now:
                    if step is not None and end is not None:
                        out += end(state)
                    now = row[0]
                    step, state = start(now)
                out += step(row)
            yield _batch(out, schema)
        if step is not None and end is not None:
            yield _batch(end(state), schema)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def memtable_rollover(log: DataFrame, limit: int = 100) -> DataFrame:
    """Tables sealed when they hold more than ``limit`` bytes after an insert: owner, number, last seq, entries, bytes."""
    schema = T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("last_seq", T.LongType()), T.StructField("entries", T.LongType()), T.StructField("bytes", T.LongType())])

    def start(owner):
        state = {"table": Memtable(), "run": 0}

        def step(row):
            _, seq, op, key, value = row
            if op == "GET":
                return []
            table = state["table"]
            table.put(key.encode(), len(value.encode()) if op == "PUT" and value is not None else 0)
            if table.bytes <= limit:
                return []
            state["run"] += 1
            state["table"] = Memtable()
            return [(owner, state["run"], seq, len(table.sizes), table.bytes)]

        return step, state

    return fold(log, ["op", "key", "value"], schema, start)


def resolved(log: DataFrame) -> DataFrame:
    """The log with what the store below the cache holds when each operation comes: columns below (op) and below_len.

    A window within each epoch of a key, and the key's state carried over its epochs; no owner's store is held anywhere.
    """
    length = F.when((F.col("op") == "PUT") & F.col("value").isNotNull(), F.octet_length("value")).otherwise(0)
    marked = log.withColumn("w", F.when(F.col("op") != "GET", F.struct("op", length.alias("n"))))
    seen = latest_before(marked, ["key"], "epoch", ["epoch", "seq"], "w", "r")
    return seen.select("owner", "seq", "op", "key", F.col("r.op").alias("below"), F.coalesce("r.n", F.lit(0)).cast("bigint").alias("below_len"))


def through_cache(cache: LRUCache, op: str, key: bytes, below: str | None, below_len: int) -> tuple[str, bool] | None:
    """One operation on a cache: None for a write, which drops its key's entry; (status, hit) for a read.

    A read that falls through is cached with what the store holds, whatever its status.
    """
    if op != "GET":
        cache.invalidate([key])
        return None
    found = cache.get(key)
    if found is not None:
        return found[0], True
    status = "FOUND" if below == "PUT" else "DELETED" if below == "DEL" else "NOT_FOUND"
    cache.put(key, status, below_len)
    return status, False


def lru_reads(log: DataFrame, limit: int = 1000) -> DataFrame:
    """Each GET with its status and whether the owner's cache had the answer.

    The cache is filled by reads that fell through, with any status; a write drops its key's entry, as a flush does.
    """
    schema = T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), T.StructField("hit", T.BooleanType())])

    def start(owner):
        cache = LRUCache(limit)

        def step(row):
            _, seq, op, key, below, n = row
            found = through_cache(cache, op, key.encode(), below, n)
            return [] if found is None else [(owner, seq, *found)]

        return step, None

    return fold(resolved(log), ["op", "key", "below", "below_len"], schema, start)


def lru_hit_ratio(log: DataFrame, limit: int = 1000) -> DataFrame:
    """Per owner: reads, hits and their share."""
    return lru_reads(log, limit).groupBy("owner").agg(F.count("*").alias("reads"), F.sum(F.col("hit").cast("bigint")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("ratio"))
