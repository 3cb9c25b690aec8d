"""Generations: sorted, Bloom-filtered Parquet runs by owner; reading the newest of each key; merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.state import answer, writes
from tidelog.operators.tables import durable


def run_of(log: DataFrame, gen: str = "epoch") -> DataFrame:
    """Last write of each key in each generation: (gen, owner, key, tombstone, value)."""
    last = writes(log).groupBy(F.col(gen).alias("gen"), "key").agg(F.max_by(F.struct("owner", "op", "value"), "seq").alias("w"))
    return last.select("gen", "w.owner", "key", (F.col("w.op") == "DEL").alias("tombstone"), F.when(F.col("w.op") == "PUT", F.col("w.value")).alias("value"))


#: Folders for each owner that one checkpoint writes, at most: a folder costs the same however little it holds.
FOLDERS = 32


def _folders(runs: DataFrame) -> list[int]:
    """The newest generation of each folder: every generation up to ``FOLDERS`` of them, else quantiles by rows."""
    known = runs.where("gen IS NOT NULL")
    few = [r["gen"] for r in known.select("gen").distinct().orderBy("gen").limit(FOLDERS + 1).collect()]
    if len(few) <= FOLDERS:
        return few
    r = known.agg(F.percentile_approx("gen", [i / FOLDERS for i in range(1, FOLDERS)]).alias("parts"), F.max("gen").alias("last")).first()
    return sorted({*r["parts"], r["last"]})


def checkpoint(runs: DataFrame, root: str, mode: str = "append") -> None:
    """Write generations: a folder for each gen and owner, sorted by key, with a Bloom filter on the key.

    Of more than ``FOLDERS`` generations, consecutive ones share a folder, which is called by the newest that it may
    hold; ``run`` is a row's own. Empty generations write nothing. A filter is sized for the rows of its file, up to the
    next power of two: files are counted, and those of one size class are written together.
    """
    runs = durable(runs)
    newest_of = _folders(runs)
    if not newest_of:
        return
    folder = F.coalesce(*[F.when(F.col("gen") <= g, F.lit(g)) for g in newest_of]).cast("bigint")
    runs = runs.select(folder.alias("gen"), "owner", "key", "tombstone", "value", F.col("gen").cast("bigint").alias("run"))
    files = runs.groupBy("gen", "owner").agg(F.count("*").alias("n"))
    files = durable(files.withColumn("size_class", F.ceil(F.log2(F.greatest("n", F.lit(2)))).cast("int")).drop("n"))
    for i, r in enumerate(files.select("size_class").distinct().orderBy("size_class").collect()):
        some = runs.join(F.broadcast(files.where(F.col("size_class") == r["size_class"]).drop("size_class")), ["gen", "owner"], "left_semi")
        dealt = some.repartition("gen", "owner").sortWithinPartitions("gen", "owner", "key", "run")
        out = dealt.write.mode(mode if i == 0 else "append").option("parquet.enable.dictionary", "false").partitionBy("gen", "owner")
        out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(1 << r["size_class"])).parquet(root)


def open_store(spark: SparkSession, root: str) -> DataFrame:
    """All generations under ``root``; files without ``run`` hold their folder's generation alone."""
    found = spark.read.schema("key string, tombstone boolean, value string, run bigint, gen bigint, owner int").parquet(root)
    return found.select("key", "tombstone", "value", F.coalesce("run", "gen").alias("gen"), "owner")


def highest_generation(store: DataFrame) -> int:
    """The newest generation's number; 0 where there is none."""
    return store.agg(F.max("gen")).first()[0] or 0


def newest(store: DataFrame) -> DataFrame:
    """The newest run's record of each key, deletes included."""
    return store.groupBy("key").agg(F.max_by(F.struct("gen", "tombstone", "value"), "gen").alias("w")).select("key", "w.gen", "w.tombstone", "w.value")


def read(store: DataFrame, probes: DataFrame, size: int | None = None) -> DataFrame:
    """Status and value of each probe's key over all generations; the newest record wins.

    With a buffer's ``size``, also the true length; a longer value isn't copied.
    """
    found = probes.join(newest(store), "key", "left")
    op = F.when(F.col("tombstone"), "DEL").when(F.col("gen").isNotNull(), "PUT")
    return found.select("key", *answer(op, F.col("value"), size))


def of_key(store: DataFrame, key: str, owner: int) -> DataFrame:
    """A key's records in all generations. The literal owner prunes folders; the literal key prunes row groups, by their
    bounds and their Bloom filters."""
    return store.where((F.col("owner") == owner) & (F.col("key") == key))


def read_key(store: DataFrame, key: str, owner: int) -> DataFrame:
    """One key's newest record; see ``of_key`` for what is read."""
    return newest(of_key(store, key, owner))


def get_key(store: DataFrame, key: str, owner: int, size: int | None = None) -> DataFrame:
    """One row: status and value of a key, and with a buffer's ``size`` the true length."""
    w = of_key(store, key, owner).agg(F.max_by(F.struct("tombstone", "value"), "gen").alias("w"))
    op = F.when(F.col("w.tombstone"), "DEL").when(F.col("w").isNotNull(), "PUT")
    return w.select(F.lit(key).alias("key"), *answer(op, F.col("w.value"), size))


def flush(log: DataFrame, root: str, after: int | None = None) -> int:
    """Write the generations of the log that come after ``after`` (default: the newest one stored); the newest stored now.

    What is written is on disk when this returns; generations that are stored already aren't written again.
    """
    spark = log.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if after is None:
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        after = highest_generation(open_store(spark, root)) if there else -1
    checkpoint(run_of(log.where(F.col("epoch") > after)), root)
    last = writes(log).agg(F.max("epoch")).first()[0]
    return after if last is None else max(after, last)


def close(log: DataFrame, root: str) -> DataFrame:
    """Shut a store down: a last fence makes all writes visible, what isn't stored is flushed, and the data persists.

    The store, opened again; the state in it is that after the fence.
    """
    flush(log, root)
    return open_store(log.sparkSession, root)


def merge(store: DataFrame) -> DataFrame:
    """All generations as one: the newest record of each key, deletes dropped. Bounds what a read has to look at."""
    last = store.groupBy("key").agg(F.max_by(F.struct("gen", "owner", "tombstone", "value"), "gen").alias("w"))
    return last.select("w.gen", "w.owner", "key", "w.tombstone", "w.value").where("NOT tombstone")


def drop_store(spark: SparkSession, root: str) -> None:
    """Delete all generations."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
