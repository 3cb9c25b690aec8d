"""Adapters from tables to the operation log and to measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_oplog(events: DataFrame, ranks: int = RANKS, per_epoch: int = 1000) -> DataFrame:
    """Events as operations: sign-ups and purchases put, errors delete, all others get. Order is event_id."""
    op = F.when(F.col("event_type").isin("signup", "purchase"), "PUT").when(F.col("event_type") == "error", "DEL").otherwise("GET")
    return events.select(
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / per_epoch).cast("bigint").alias("epoch"),
        F.pmod(F.col("event_id") * 7, F.lit(ranks)).cast("int").alias("writer"),
        F.pmod("user_id", F.lit(ranks)).cast("int").alias("owner"),
        op.alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operation log of the driver's ``events`` table."""
    return to_oplog(read(spark, sf_dir, "events"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed operations of the driver's ``lineitem`` table: db, rank, owner, run, optime, op, seq."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("db"),
        F.col("l_linenumber").cast("int").alias("rank"),
        F.pmod("l_suppkey", F.lit(7)).cast("int").alias("owner"),
        F.pmod("l_suppkey", F.lit(10)).cast("int").alias("run"),
        F.col("l_extendedprice").alias("optime"),
        F.col("l_linestatus").alias("op"),
        F.col("l_orderkey").alias("seq"),
    )
