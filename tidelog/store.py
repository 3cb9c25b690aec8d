"""A thin facade: put, get, delete, checkpoint and finalize on one store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import hash_exact, owner_of
from tidelog.model import OPLOG, READANDWRITE, SEQUENTIAL, KVOptions
from tidelog.operators import state, storage


class Store:
    """A key-value store under a folder: operations since the last checkpoint, above the stored generations.

    Single operations are gathered on the driver, as a client's buffer; ``put_all`` takes a table of any size. A store opens
    with what its folder holds, SEQUENTIAL and READANDWRITE unless the options say otherwise.
    """

    def __init__(self, spark: SparkSession, root: str, ranks: int = 1, options: KVOptions | None = None):
        self.spark, self.root, self.ranks = spark, root, ranks
        self.options = options or KVOptions(consistency=SEQUENTIAL, mode=READANDWRITE)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        self.epoch = storage.highest_generation(storage.open_store(spark, root)) + 1 if there else 0
        self.stored = there
        self.seq = 0
        self.held: list[tuple] = []
        self.log = spark.createDataFrame([], OPLOG)

    def _add(self, op: str, key: str, value: str | None) -> None:
        self.held.append((self.seq, op, key, value))
        self.seq += 1

    def put(self, key: str, value: str) -> None:
        self._add("PUT", key, value)

    def delete(self, key: str) -> None:
        self._add("DEL", key, None)

    def put_all(self, rows: DataFrame) -> None:
        """Puts of a table (key, value); of rows with one key, the greatest value is the last."""
        self._settle()
        last = rows.groupBy("key").agg(F.max("value").alias("value"))
        self.log = self.log.unionByName(self._placed(last.select(F.lit(self.seq).cast("bigint").alias("seq"), F.lit("PUT").alias("op"), "key", "value")))
        self.seq += 1

    def _placed(self, rows: DataFrame) -> DataFrame:
        owner = owner_of(hash_exact(F.col("key")), self.ranks)
        return rows.select("seq", F.lit(self.epoch).cast("bigint").alias("epoch"), F.lit(0).alias("writer"), owner.alias("owner"), "op", "key", "value")

    def _settle(self) -> None:
        if self.held:
            self.log = self.log.unionByName(self._placed(self.spark.createDataFrame(self.held, "seq bigint, op string, key string, value string")))
            self.held = []

    def get_all(self, probes: DataFrame, size: int | None = None) -> DataFrame:
        """Status and value of each probe's key: what was written since the checkpoint, else what is stored."""
        self._settle()
        tiers = [state.latest(self.log)]
        if self.stored:
            op = F.when(F.col("tombstone"), "DEL").otherwise("PUT")
            tiers.append(storage.newest(storage.open_store(self.spark, self.root)).select("key", op.alias("op"), "value"))
        return state.tier_lookup(probes, tiers, size).drop("tier")

    def get(self, key: str, size: int | None = None):
        """The row of one key: status, value, and with a buffer's ``size`` value_len."""
        return self.get_all(self.spark.createDataFrame([(key,)], "key string"), size).first()

    def checkpoint(self) -> None:
        """Write what is held as the next generation."""
        self._settle()
        if state.writes(self.log).take(1):
            storage.checkpoint(storage.run_of(self.log), self.root)
            self.stored = True
            self.epoch += 1
        self.log = self.spark.createDataFrame([], OPLOG)

    def finalize(self) -> None:
        """A last checkpoint; the data persists."""
        self.checkpoint()
