"""Visibility of writes: sequential replay, relaxed reads bounded by fences, and the timeline of options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.state import answer, latest
from tidelog.operators.tables import latest_before


def replay_sequential(log: DataFrame, size: int | None = None) -> DataFrame:
    """Status and value of every GET when each read sees all earlier writes; with a buffer's ``size``, the true length too.

    No join: a window within each epoch of a key, and the key's state carried over its epochs.
    """
    marked = log.withColumn("w", F.when(F.col("op") != "GET", F.struct("op", "value")))
    seen = latest_before(marked, ["key"], "epoch", ["epoch", "seq"], "w", "r").where("op = 'GET'")
    return seen.select("seq", "key", *answer(F.col("r.op"), F.col("r.value"), size))


def replay_relaxed(log: DataFrame, size: int | None = None) -> DataFrame:
    """Status and value of every GET under the guaranteed minimum of the relaxed level; with a buffer's ``size``, the
    true length too.

    A read of a remote key first sees its rank's own write of this epoch; then what the owner itself wrote in this
    epoch; then the state that the last fence left, where writes sent by others come after the owner's own. Each of
    the three is an as-of lookup: two windows within an epoch of a key, one over a row for each epoch and key.
    """
    w = F.struct("op", "value")
    write = F.col("op") != "GET"
    marked = log.withColumn("w", F.when(write, w)).withColumn("own", F.when(write & (F.col("writer") == F.col("owner")), w))
    before = (Window.unboundedPreceding, -1)
    mine = Window.partitionBy("key", "epoch", "writer").orderBy("seq").rowsBetween(*before)
    here = Window.partitionBy("key", "epoch").orderBy("seq").rowsBetween(*before)
    seen = marked.withColumn("mine", F.last("w", ignorenulls=True).over(mine)).withColumn("here", F.last("own", ignorenulls=True).over(here))
    sent = (F.col("writer") != F.col("owner")).cast("int")
    ends = marked.groupBy("key", "epoch").agg(F.max_by("w", F.when(write, F.struct(sent, F.col("seq")))).alias("end"))
    fenced = ends.withColumn("fenced", F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("epoch").rowsBetween(*before))).drop("end")
    remote = F.col("writer") != F.col("owner")
    reads = seen.where("op = 'GET'").join(fenced, ["key", "epoch"], "left")
    reads = reads.withColumn("r", F.coalesce(F.when(remote, F.col("mine")), F.col("here"), F.col("fenced")))
    return reads.select("seq", "key", *answer(F.col("r.op"), F.col("r.value"), size))


def relaxed_final_state(log: DataFrame) -> DataFrame:
    """State after a last fence: the greatest (epoch, sent by another rank, seq) of each key wins."""
    sent = log.withColumn("sent", (F.col("writer") != F.col("owner")).cast("int"))
    return latest(sent, "epoch", "sent", "seq")


def remote_cache_hits(log: DataFrame, options: DataFrame) -> DataFrame:
    """Reads of remote keys with whether the reader's remote cache had the answer: seq, writer, key, hit.

    Answers from other ranks are cached in epochs that are both SEQUENTIAL and READONLY, as nothing may change there; a
    read is a hit if the rank has read the key before in the same run of such epochs. A change of options empties the cache.
    The first read of each run, rank and key is found by a partial aggregate, so hot keys don't hurt.
    """
    spans = options.withColumn("span", F.row_number().over(Window.orderBy("epoch")))  # over the changes only
    timed = options_timeline(log, spans).where("op = 'GET' AND writer != owner")
    cached = (F.col("consistency") == "SEQUENTIAL") & (F.col("mode") == "READONLY")
    first = timed.where(cached).groupBy("writer", "key", "span").agg(F.min("seq").alias("first"))
    found = timed.join(first, ["writer", "key", "span"], "left")
    return found.select("seq", "writer", "key", F.coalesce(F.col("seq") > F.col("first"), F.lit(False)).alias("hit"))


def options_timeline(log: DataFrame, options: DataFrame, strict: bool = False) -> DataFrame:
    """Operations with the consistency and mode in force in their epoch.

    ``options``: (epoch, consistency, mode), one row for each fence that changed them; the last one holds on. Mode
    READONLY is advisory; ``strict`` leaves out its writes.
    """
    last = log.agg(F.max("epoch").alias("last"))
    until = F.coalesce(F.lead("epoch").over(Window.orderBy("epoch")), F.col("last") + 1)  # over the changes only
    spans = options.crossJoin(F.broadcast(last)).withColumn("until", until).where("until > epoch")
    more = [c for c in options.columns if c not in ("epoch", "consistency", "mode")]
    known = spans.select(F.explode(F.sequence("epoch", F.col("until") - 1)).alias("epoch"), "consistency", "mode", *more)
    out = log.join(known, "epoch", "left")
    return out.where((F.col("mode") != "READONLY") | (F.col("op") == "GET") | F.col("mode").isNull()) if strict else out
