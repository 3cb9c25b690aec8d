"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontam, jaccard, langid, pii
from tidelog.llm.common import durable, sized, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null text, no letter in it, or far from every codeword of the classifier.

    The classifier learns from ``docs``. ``langid.identify`` says what far is; ambiguous documents stay (a text in two
    languages is not unclean), and so do all with a letter where fewer than two labels were learned.
    """
    found = langid.identify(docs, langid.train(langid.held_in(docs)), keep=tuple(docs.columns))
    return found.where(~F.col("rejected")).select(docs.columns)


def _named(docs: DataFrame) -> DataFrame:
    """Rows with what tells them apart: the id as text, and a hash of the text."""
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "__hash": F.xxhash64("text")})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the row least by doc_id (null last) and hash of the text stays.

    Documents without words stay. Rows are told apart by doc_id and a hash of the text, so one row of a component stays
    whatever ids its rows share or lack; of repeated rows that one stays whose columns come first (any of them, where the
    columns have no order). Texts are moved only where rows repeat, and then a row of each task at most.
    """
    names = ["__id", "__hash"]
    named = _named(docs)
    found = durable(jaccard.similar(named.select("doc_id", "text", *names), keep=tuple(names)).select("doc_id", *names, "n_shingles", "component"))
    linked = found.where("n_shingles > 0")
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", "__id")).alias("r"))
    stay = sized(durable(least.select(*[F.col(f"r.{c}").alias(c) for c in names])))
    gone = sized(durable(linked.select(*names).distinct().join(stay, names, "left_anti")))
    again = sized(durable(found.groupBy(*names).count().where("count > 1").select(*names)))
    kept = named.join(gone, names, "left_anti")
    pick = F.first if "map<" in docs.schema.simpleString() or "variant" in docs.schema.simpleString() else F.min
    single = kept.join(again, names, "left_semi").groupBy(*names).agg(pick(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return kept.join(again, names, "left_anti").select(docs.columns).unionByName(single.select(docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth and more lies in benchmark windows."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=tuple(docs.columns))
    return found.where(~decontam.is_contaminated()).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in square brackets; n_chars follows the text."""
    names = ["__id", "__hash"]
    named = _named(docs)
    found = pii.extract(named.select("text", *names), keep=tuple(names)).where(F.size("spans") > 0)
    found = sized(durable(found.select(*names, F.col("spans").alias("__spans")).dropDuplicates(names)), weight=F.size("__spans"))
    out = pii.redact(named.join(found, names, "left"), "text", "__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, their sums, and the ids as little-endian 32-bit integers."""
    import public_tokenizers

    return bpe.bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=("doc_id",), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("tokens", tokens)]

#: The stages learn, iterate and merge tokens: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what a stage returns is checkpointed before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
