"""Measurement files: timed operations, throughput lines, scalars, CSV and free text; and sinks of the same forms.

Dimensions that only the path has (store, ratio, ranks, run, table size, rank) become columns. Missing files are
skipped; all readers take a folder or a glob and read the whole tree as one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import OPTIME

# The fields of a throughput line, in order.
LINE_FIELDS = ("rank_count", "keylen", "vallen", "count", "update_ratio", "batch_size", "put_time", "get_update_time")
LINE = "^" + ",".join(f"{f}:([0-9]+)" for f in LINE_FIELDS) + r"\s*$"


def path_dimensions(path: Column) -> dict[str, Column]:
    """Dimensions of a measurement file's path; null where the path doesn't have one."""

    def number(pattern: str) -> Column:
        found = F.regexp_extract(path, pattern, 1)
        return F.when(found != "", found).cast("int")

    def word(pattern: str) -> Column:
        found = F.regexp_extract(path, pattern, 1)
        return F.when(found != "", found)

    return {
        "db": word(r"/([^/]+)/(?:ratio[0-9]+|ranks[0-9]+)/"),
        "ratio": number(r"/ratio([0-9]+)/"),
        "ranks": number(r"/ranks([0-9]+)/"),
        "run": number(r"/run([0-9]+)/"),
        "mem_table_size": number(r"/mt([0-9]+)/"),
        "op": word(r"/([a-z_]+)[0-9]+\.txt$"),
        "rank": number(r"/[a-z_]+([0-9]+)\.txt$"),
        "key_size": number(r"/([0-9]+)ksize"),
        "value_size": number(r"ksize([0-9]+)vsize"),
    }


def _files(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")


def read_optimes(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Blank-separated ``optime owner`` lines with the path's dimensions; ``owner`` as an integer."""
    raw = _files(spark).option("pathGlobFilter", glob).schema(OPTIME).option("sep", " ").csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"))
    return raw.withColumn("owner", F.col("owner").cast("int")).withColumns(path_dimensions(F.col("file")))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Throughput lines as typed columns; lines that don't match have nulls. One match and one split for each line."""
    split = lines.withColumn("__parts", F.when(F.col(value).rlike(LINE), F.split(F.rtrim(F.col(value)), "[:,]")))
    return split.withColumns({f: F.col("__parts")[2 * i + 1].cast("bigint") for i, f in enumerate(LINE_FIELDS)}).drop("__parts")


def read_lines(spark: SparkSession, path: str, glob: str = "out*.txt") -> DataFrame:
    """Throughput lines of all files up to the first line of each that isn't one, with file and line number."""
    raw = _files(spark).option("pathGlobFilter", glob).text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line_no", "value"))
    bad = F.when(~F.col("value").rlike(LINE), F.col("line_no"))
    first = F.min(bad).over(Window.partitionBy("file"))
    kept = raw.withColumn("first_bad", first).where("first_bad IS NULL OR line_no < first_bad").drop("first_bad")
    return parse_lines(kept).drop("value").withColumns(path_dimensions(F.col("file")))


def read_scalars(spark: SparkSession, path: str, glob: str = "put_total*.txt") -> DataFrame:
    """One integer per file."""
    raw = _files(spark).option("pathGlobFilter", glob).text(path, wholetext=True)
    raw = raw.select(F.trim(F.regexp_replace("value", r"\s+$", "")).try_cast("bigint").alias("value"), F.col("_metadata.file_path").alias("file"))
    return raw.withColumns(path_dimensions(F.col("file")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comparator measurements: a CSV with a header."""
    schema = T.StructType([T.StructField("bench_name", T.StringType()), T.StructField("key_len", T.IntegerType()), T.StructField("equal", T.IntegerType()), T.StructField("cycles", T.LongType())])
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_runtimes(spark: SparkSession, path: str, glob: str = "run.txt") -> DataFrame:
    """All ``[OVERALL], RunTime(ms), N`` of each file, in seconds."""
    raw = _files(spark).option("pathGlobFilter", glob).text(path, wholetext=True)
    found = F.regexp_extract_all("value", F.lit(r"\[OVERALL\], RunTime\(ms\), ([0-9]+)"), F.lit(1))
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(found).alias("nth", "ms"))
    return raw.select("file", "nth", (F.col("ms").cast("bigint") / 1000.0).alias("runtime")).withColumns(path_dimensions(F.col("file")))


def write_optimes(df: DataFrame, root: str, mode: str = "append") -> None:
    """Timed operations (optime, owner and dimensions) as blank-separated text, a folder for each store, ratio, ranks and run."""
    parts = [c for c in ("db", "ratio", "ranks", "run", "op", "rank") if c in df.columns]
    df.select(*parts, "optime", "owner").write.mode(mode).partitionBy(*parts).option("sep", " ").csv(root)


def write_run_config(spark: SparkSession, config: dict, path: str) -> None:
    """``name: value`` lines, one file."""
    spark.createDataFrame([(f"{k}: {v}",) for k, v in config.items()], "value string").coalesce(1).write.mode("overwrite").text(path)
