"""Analytics of measurements: throughput, shapes of distributions, run numbers, grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.tables import durable, running_total


def label(df: DataFrame, **labels) -> DataFrame:
    """Literal label columns."""
    return df.withColumns({k: F.lit(v) for k, v in labels.items()})


def local_remote(df: DataFrame, owner: str = "owner", rank: str = "rank") -> DataFrame:
    """A column that tells operations on the rank's own keys from remote ones."""
    return df.withColumn("place", F.when(F.col(owner) == F.col(rank), "local").otherwise("remote"))


def throughput(value: str = "optime") -> Column:
    """Thousand (1024) operations a second from nanoseconds; 0 where there are none."""
    return F.coalesce(F.try_divide(F.count(value) * F.lit(1e9), F.sum(value)) / 1024, F.lit(0.0))


def throughput_per_rank(df: DataFrame, group: list[str], rank: str = "rank", value: str = "optime") -> DataFrame:
    return df.groupBy(*group, rank).agg(throughput(value).alias("throughput"))


def throughput_total(df: DataFrame, group: list[str], rank: str = "rank", value: str = "optime") -> DataFrame:
    """Sum of the ranks' throughputs."""
    return throughput_per_rank(df, group, rank, value).groupBy(*group).agg(F.sum("throughput").alias("throughput"))


def throughput_micro(df: DataFrame, group: list[str], value: str = "optime") -> DataFrame:
    """Throughput of all ranks' operations taken together."""
    return df.groupBy(*group).agg(throughput(value).alias("throughput"))


def bandwidth(df: DataFrame, value_size: Column | str, throughput: str = "throughput") -> DataFrame:
    """Throughput times value size, in KiB for each unit; the same unit for every operation."""
    size = F.col(value_size) if isinstance(value_size, str) else value_size
    return df.withColumn("bandwidth", F.col(throughput) * size / 1024)


def scalar_throughput(df: DataFrame, group: list[str], count: str = "count", total_ns: str = "value") -> DataFrame:
    """Sum over ranks of operations by total time, a second."""
    return df.groupBy(*group).agg(F.sum(F.try_divide(F.col(count), F.col(total_ns)) * 1e9).alias("throughput"))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number of each row within its group, from 0; a large group is dealt out by ranges of its order."""
    found = running_total(df.withColumn("__one", F.lit(1).cast("bigint")), group, order, "__one", out)
    return found.select(*df.columns, F.col(out).cast("bigint").alias(out))


def op_sequence(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Number of each operation within its file, from 0."""
    return numbered(df, group, order, "nth")


def run_number(df: DataFrame, file: str, config: list[str], order: list[str]) -> DataFrame:
    """How many lines of the same configuration came before in the file."""
    return numbered(df, [file, *config], order, "run")


def unpivot_ops(df: DataFrame, ids: list[str], times: dict[str, str], value: str = "time") -> DataFrame:
    """A row for each of the time columns: ``times`` maps a column to the operation's name."""
    pairs = ", ".join(f"'{name}', `{column}`" for column, name in times.items())
    return df.selectExpr(*ids, f"stack({len(times)}, {pairs}) AS (optype, `{value}`)")


def group_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums by keys; rows with a null key go."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.sum(value).alias(value))


def quantiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, linear between ranks: a column for each name of ``at``. Nulls don't count.

    Values are counted first, and counts are added up over ranges of (group, value), so no task holds a large group. Of
    the distinct values only those that hold a rank that is asked for go on.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    placed = running_total(counts, group, ["__v"], "__n", "__first")
    first, last, n = F.col("__first"), F.col("__first") + F.col("__n") - 1, F.col("__first_all")
    ranks = {f"{name}_{side}": f((n - 1) * F.lit(float(q))) for name, q in at.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    has = {name: (first <= rank) & (rank <= last) for name, rank in ranks.items()}
    some = None
    for condition in has.values():
        some = condition if some is None else some | condition
    found = placed.where(some).groupBy(*group).agg(F.first("__first_all").alias("__all"), *[F.max(F.when(c, F.col("__v"))).alias(f"__{name}") for name, c in has.items()])
    out = []
    for name, q in at.items():
        spot = (F.col("__all") - 1) * F.lit(float(q))
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return found.select(*group, *out)


def box_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quartiles (linear between ranks) and the fences at 1.5 interquartile ranges."""
    q = quantiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"low": F.col("q1") - 1.5 * iqr, "high": F.col("q3") + 1.5 * iqr})


def approximate_box_stats(df: DataFrame, group: list[str], value: str, accuracy: int = 10000) -> DataFrame:
    """Quartiles from a mergeable sketch of bounded size, for groups too large for exact ones."""
    q = df.groupBy(*group).agg(F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy).alias("q"))
    return q.select(*group, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def whiskers(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quartiles, the extreme values within the fences, and the number of values beyond."""
    inside = F.when(F.col(value).between(F.col("low"), F.col("high")), F.col(value))
    both = df.join(durable(box_stats(df, group, value)), group)
    beyond = F.when(~F.col(value).between(F.col("low"), F.col("high")), 1).otherwise(0)
    return both.groupBy(*group, "q1", "median", "q3").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), F.sum(beyond).cast("bigint").alias("outliers"))


def outliers(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows beyond the fences of their group."""
    both = df.join(durable(box_stats(df, group, value).select(*group, "low", "high")), group)
    return both.where(~F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")


def ecdf(df: DataFrame, hue: list[str], value: str) -> DataFrame:
    """Share of a hue's rows up to each distinct value.

    Counts come first, so windows see distinct values only; these are dealt by ranges of (hue, value), so a large
    hue lies in many parts, whose totals are carried over.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*hue, value).agg(F.count("*").alias("n"))
    found = running_total(counts, hue, [value], "n", "before")
    return found.select(*hue, value, "n", ((F.col("before") + F.col("n")) / F.col("before_all")).alias("share"))


def log_histogram(df: DataFrame, group: list[str], value: str, width: float = 0.05) -> DataFrame:
    """Counts in bins of the decimal logarithm, anchored at 0; values up to 0 have no bin."""
    bins = F.floor(F.log10(F.col(value)) / width).cast("bigint")
    return df.where(F.col(value) > 0).groupBy(*group, bins.alias("bin")).agg(F.count("*").alias("n"))


def mean_line(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean and the half-width of its 95 % interval by the normal approximation."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.coalesce(half, F.lit(0.0)).alias("half_width"))
