"""Durable intermediate tables and the as-of operator that others build on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session on one machine (master ``local``) gets a temporary one; on a cluster that is an error,
    as executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; it survives the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` as a stored table with ``out``, the sum of ``value`` over the earlier rows of a group, and ``<out>_all``, the group's.

    Rows are dealt by ranges of (group, order), so a large group lies in many parts; a window adds up inside a part, and
    one row for each part and group carries sums on. Rows that tie in ``order`` follow each other in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy(*group, "__part").agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*group, "__part", (F.sum("__sum").over(over) - F.col("__sum")).alias("__before"), F.sum("__sum").over(Window.partitionBy(*group)).alias(f"{out}_all"))
    local = placed.withColumn("__upto", F.sum(value).over(inside) - F.col(value))
    named = sums.select(*[F.col(c).alias(f"__{c}") for c in [*group, "__part"]], "__before", f"{out}_all")
    on = None
    for c in [*group, "__part"]:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        on = one if on is None else on & one
    joined = local.join(named, on).withColumn(out, F.col("__upto") + F.col("__before"))
    return joined.drop("__upto", "__before", "__part", *[f"__{c}" for c in [*group, "__part"]])


def latest_before(df: DataFrame, group: list[str], step: str, order: list[str], value: str, out: str) -> DataFrame:
    """A column with the latest non-null ``value`` of earlier rows of the same group.

    ``step`` is a column that divides a group into consecutive runs (order begins with it). Within a run a window
    finds the value; across runs it is carried over one row for each run. A hot group is split by its runs, so no
    task gets all of its rows.
    """
    inside = Window.partitionBy(*group, step).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*group, step).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    before = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    local = df.withColumn("__local", F.last(value, ignorenulls=True).over(inside))
    return local.join(carried, [*group, step], "left").withColumn(out, F.coalesce("__local", "__carry")).drop("__local", "__carry")
