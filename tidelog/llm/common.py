"""What the training-data operators share: reading, Arrow mapping, durable tables, native spans."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a text function gets at most (one longer text is a call of its own).
CHUNK_BYTES = 1_000_000
#: Rows and bytes of an Arrow batch, at most (one longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, pruned to the columns named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session on one machine (master ``local``) gets a temporary one; on a cluster that is an error,
    as executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder. The files survive the loss of an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder, and read from there.

    Unlike a checkpoint it hands nothing of the old plan on. Iterative joins need that: constraints that a checkpoint
    keeps would multiply with every round.
    """
    path = f"{shared_folder(df.sparkSession)}/tidelog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slim_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to ours: rows here are whole texts, and several tasks share a machine."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub("[bB]$", "", str(spark.conf.get(f"spark.sql.execution.arrow.{name}"))) or 0)
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def release() -> None:
    """Give memory that Arrow and the C library hold back to the system: workers live on when a task ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


#: Rows up to which a table of a few short fields is broadcast.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A durable table, with the hint to broadcast it if its rows (or their weights), summed here, are ``most`` at most."""
    total = df.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of rows whose texts have at most ``most`` bytes together."""
    import pyarrow.compute

    begin = held = 0
    for i, n in enumerate(pyarrow.compute.binary_length(texts).to_pylist()):
        n = n or 0
        if i > begin and held + n > most:
            yield begin, i - begin
            begin, held = i, 0
        held += n
    if len(texts) > begin:
        yield begin, len(texts) - begin


def map_text(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., Sequence]],
    also: Sequence[str] = (),
    rows: bool = False,
) -> DataFrame:
    """Columns computed from ``text`` beside those of ``keep``, by one Arrow pass without a shuffle.

    ``make()`` is called once per partition. It returns a function from a list of texts (with None), and a list for
    each column of ``also``, to one list per field. With ``rows`` those lists may have any length and ``keep`` is
    empty. A kept column with the name of a new field gives way to the new one.
    """
    slim_batches(df.sparkSession)
    new = {name for name, _ in fields}
    keep = [c for c in keep if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    # what the function gets travels under names of its own, so kept columns may be called alike
    sent = df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{text}`").cast("string").alias("__text"),
        *[F.col(f"`{c}`").alias(f"__also{i}") for i, c in enumerate(also)],
    )
    assert not (rows and keep)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        apply = make()
        for batch in batches:
            for at, n in chunks(batch.column(len(keep))):
                part = batch.slice(at, n)
                found = apply(*[part.column(len(keep) + i).to_pylist() for i in range(1 + len(also))])
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                cols += [pa.array(c, type=arrow.field(len(keep) + i).type) for i, c in enumerate(found)]
                yield pa.RecordBatch.from_arrays(cols, names=arrow.names)
        del apply
        release()

    return sent.mapInArrow(run, schema)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def exact_sample(df: DataFrame, key: str, text: str, label: str, most: int, total: int) -> DataFrame:
    """(text, label): different rows of each label that isn't null, by a hash of key and text; repeated rows count once.

    Every label has ``most`` rows at most, or its part of ``total`` where there are too many labels for that, but one at
    least. Labels are counted by sketches; about twice the rows wanted are moved, as small numbers until they are cut.
    """
    rows = df.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{text}`").alias(text), F.col(f"`{label}`").alias(label), F.xxhash64(F.lit("sample"), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).alias("__spot"))
    counts = durable(rows.groupBy(label).agg(F.approx_count_distinct("__spot").alias("__n")))
    most = max(1, min(most, total // max(1, counts.count())))
    # twice the share, and 20 rows, so that neither the sketch's error nor chance leaves a label short
    share = F.least(F.lit(1.0), F.lit(2.0 * most + 20) / F.greatest("__n", F.lit(1)))
    near = rows.join(sized(counts.select(label, share.alias("__share"))), label).where(F.pmod("__spot", F.lit(1 << 30)) < F.col("__share") * (1 << 30))
    spots = near.select(label, "__spot").distinct()
    order = Window.partitionBy(label).orderBy(F.pmod("__spot", F.lit(1 << 30)), "__spot")
    drawn = sized(durable(spots.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= most).select(label, "__spot")))
    return rows.join(drawn, [label, "__spot"]).groupBy(label, "__spot").agg(F.first(text).alias(text)).select(text, label)


def with_spans(df: DataFrame, text: str, out: str, pattern: str, valid: Callable[[Column], Column] | None = None, group: int = 0, context: int = 0, where: Column | None = None) -> DataFrame:
    """A column of all matches of a Java pattern: array<struct<s, e, m, g, left, right>>, by SQL functions only.

    ``s`` and ``e`` are code points, the end exclusive; ``g`` is the group asked for; ``left`` and ``right`` are up
    to ``context`` code points beside the match, as far as its neighbours of the same pattern. ``valid`` tells from
    ``m`` and ``g`` which matches stay. ``where`` is a cheap condition that holds for every text with a match; others
    aren't searched. Null texts have none. Positions are running sums over the lengths of the
    pieces between matches and of the matches, in blocks of 256, so a text with very many matches stays cheap.
    The steps are columns of their own: inside one expression the searches would run again and again.
    """
    found, groups, pieces, blocks, starts = (F.col(f"__{out}_{x}") for x in ("m", "g", "p", "b", "a"))
    n = F.size(found)

    def running(lengths: Column, start: Column) -> Column:
        return F.aggregate(
            lengths,
            F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def span(x: Column) -> Column:
        return F.struct(
            (x["at"] + F.length(x["l"])).alias("s"),
            (x["at"] + F.length(x["l"]) + F.length(x["m"])).alias("e"),
            x["m"].alias("m"),
            x["g"].alias("g"),
            (F.right(x["l"], F.lit(context)) if context else F.lit("")).alias("left"),
            (F.left(x["r"], F.lit(context)) if context else F.lit("")).alias("right"),
        )

    t = F.coalesce(F.col(text), F.lit(""))
    every = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    df = df.withColumn(f"__{out}_m", every if where is None else F.when(where, every).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"__{out}_p", F.when(n > 0, F.split(t, pattern, -1)))
    df = df.withColumn(f"__{out}_g", F.when(n > 0, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))) if group else found)
    lengths = F.zip_with(F.slice(pieces, 1, n), found, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
    df = df.withColumn(f"__{out}_l", F.when(n > 0, lengths))
    chunk = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(256)).cast("int")), lambda b: F.slice(F.col(f"__{out}_l"), b * 256 + 1, 256))
    df = df.withColumn(f"__{out}_b", F.when(n > 0, chunk))
    df = df.withColumn(f"__{out}_a", running(F.transform(blocks, total), F.lit(0).cast("bigint")))
    zipped = F.arrays_zip(
        F.flatten(F.zip_with(blocks, starts, running)).alias("at"),
        F.slice(pieces, 1, n).alias("l"),
        found.alias("m"),
        groups.alias("g"),
        F.slice(pieces, 2, n).alias("r"),
    )
    if valid is not None:
        zipped = F.filter(zipped, lambda x: valid(x))
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,g:string,left:string,right:string>>")
    df = df.withColumn(out, F.when(n > 0, F.transform(zipped, span)).otherwise(none))
    return df.drop(*[f"__{out}_{x}" for x in "mpglba"])


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs with these three fields, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
