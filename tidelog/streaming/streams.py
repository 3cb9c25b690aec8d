"""The operation log as a stream: last-writer-wins state, and reads through a cache with keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidelog.operators.folds import LRUCache, through_cache
from tidelog.operators.tables import fresh_folder
from tidelog.sources.events import to_oplog

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, per_trigger: int = 100) -> DataFrame:
    """The ``events`` table, a file or a folder of files, as a stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(per_trigger))
    return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else stream.parquet(f"{sf_dir}/events.parquet")


def latest_stream(log: DataFrame) -> DataFrame:
    """Running state of a log stream: the last write of each key, kept in the state store."""
    w = log.where(F.col("op").isin("PUT", "DEL")).groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("w"))
    return w.select("key", "w.op", F.when(F.col("w.op") == "PUT", F.col("w.value")).alias("value"), "w.seq")


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that is available of a stream, run to its end into a table of the shared folder, read as a batch.

    Each micro-batch writes a folder of its own, so a batch that is run again replaces what it wrote.
    """
    spark = stream.sparkSession
    out, kept = fresh_folder(spark, name), fresh_folder(spark, f"{name}-progress")
    schema = stream.schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", kept).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "complete":
        last = found.agg(F.max("batch")).first()[0]
        found = found.where(F.col("batch") == last)
    return found.drop("batch")


def stream_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after the whole log went through the stream."""
    return drained(latest_stream(to_oplog(read_events(spark, sf_dir))), "complete", "lww")


READS = "owner int, seq bigint, status string, hit boolean"
#: The state store that has maps as state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Reads of a frame that goes out.
FRAME = 100_000


class CachedReads(StatefulProcessor):
    """Reads of an owner through its byte-bounded cache.

    The last write of each key is an entry of a map state, so a micro-batch loads only the keys it touches; the cache,
    which its limit bounds, is a value of its own. Within a micro-batch a key's entry is read once at most and written once
    at most; of its rows some 30 bytes each are held, to be put in order, and each key once.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.last = handle.getMapState("last", "key string", "op string, n bigint")
        self.cached = handle.getValueState("cached", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cache = pickle.loads(self.cached.get()[0]) if self.cached.exists() else LRUCache(self.limit)
        ids, ops, parts = {}, {}, []
        for part in rows:
            at = np.fromiter((ids.setdefault(k, len(ids)) for k in part["key"]), np.int32, len(part))
            op = np.fromiter((ops.setdefault(o, len(ops)) for o in part["op"]), np.int8, len(part))
            parts.append((part["seq"].to_numpy(), op, at, part["n"].to_numpy()))
        columns = [np.concatenate(c) for c in zip(*parts)]
        del parts
        order = np.argsort(columns[0], kind="stable")
        keys, names, kinds = list(ids), [k.encode() for k in ids], list(ops)
        last, written, out = {}, set(), []
        for begin in range(0, len(order), FRAME):
            some = order[begin : begin + FRAME]
            for seq, o, i, n in zip(*(c[some].tolist() for c in columns)):
                op, name, below, length = kinds[o], names[i], None, 0
                if op != "GET":
                    last[i] = (op, n)
                    written.add(i)
                elif cache.get(name) is None:
                    if i not in last:
                        last[i] = self.last.getValue((keys[i],)) if self.last.containsKey((keys[i],)) else (None, 0)
                    below, length = last[i]
                found = through_cache(cache, op, name, below, length)
                if found is not None:
                    out.append((key[0], seq, *found))
            yield pd.DataFrame(out, columns=["owner", "seq", "status", "hit"])
            out = []
        for i in written:
            self.last.updateValue((keys[i],), last[i])
        self.cached.update((pickle.dumps(cache),))

    def close(self) -> None:
        pass


def lru_stream(log: DataFrame, limit: int = 1000) -> DataFrame:
    """Reads of a log stream through each owner's byte-bounded cache. It needs the state store ``ROCKSDB``."""
    length = F.when((F.col("op") == "PUT") & F.col("value").isNotNull(), F.octet_length("value")).otherwise(0).cast("bigint")
    dealt = log.select("owner", "seq", "op", "key", length.alias("n")).groupBy("owner")
    return dealt.transformWithStateInPandas(CachedReads(limit), READS, "Append", "None")


def stream_lru(spark: SparkSession, sf_dir: str, limit: int = 1000) -> DataFrame:
    """Per owner: reads and hits, from the stream."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        found = drained(lru_stream(to_oplog(read_events(spark, sf_dir)), limit), "append", "lru")
    finally:
        spark.conf.set(name, before)
    return found.groupBy("owner").agg(F.count("*").alias("reads"), F.sum(F.col("hit").cast("bigint")).alias("hits"))
