"""The corpus pipeline: toxicity, exact dedup, near-dedup, secret scans and packing, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents for the rows that they keep, so each stage works on what the one before has kept. Rows without a
doc_id cannot be named as copies and stay.

Where one doc_id stands on several texts, each text is judged on its own: exact and near copies drop rows by
id and text. Of rows that repeat both id and text, one stays. The rows that stay keep their doc_id.

Cases: null and empty texts are equal texts to exact dedup, and clean, unlike any other and without secrets to the
other stages; very long texts are read whole; an empty table gives empty tables; extra columns, whatever their names,
go through all stages but the last. Ties: of equal texts the one of most code points stays, then of the smallest id;
of near copies the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.exact_dedup import exact_dedup
from leafmill.llm.minhash import near_duplicates
from leafmill.llm.packing import PLAIN, pack_examples
from leafmill.llm.secrets import redact_secrets
from leafmill.llm.session import cut, drop_scratch, held_out, scratch_path
from leafmill.llm.toxicity import drop_toxic, train


ROW_KEY, TEXT_HASH = "__row_key", "__text_hash"


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (the whole row) and a key of its own for each text: its doc_id, or a number above all ids where
    an id has more texts. Rows that repeat both id and text become one row.
    """
    docs = docs.select("doc_id", "text", F.struct(*[_column(c).alias(c) for c in docs.columns]).alias("row"))
    ids = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if ids.isEmpty():
        return docs.withColumn(ROW_KEY, F.col("doc_id"))
    repeated = docs.join(ids, "doc_id", "left_semi").withColumn(TEXT_HASH, F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = cut(repeated.select("doc_id", TEXT_HASH).distinct())
    first = texts.groupBy("doc_id").agg(F.min(TEXT_HASH).alias("first"))
    above = docs.agg(F.max("doc_id")).first()[0] + 1
    keyed = texts.withColumn("number", F.lit(above) + F.monotonically_increasing_id()).join(first, "doc_id")
    keys = keyed.select("doc_id", TEXT_HASH, F.when(F.col(TEXT_HASH) == F.col("first"), F.col("doc_id")).otherwise(F.col("number")).alias(ROW_KEY))
    rows = cut(repeated.dropDuplicates(["doc_id", TEXT_HASH]).join(keys, ["doc_id", TEXT_HASH]).select("doc_id", "text", "row", ROW_KEY))
    return docs.join(ids, "doc_id", "left_anti").withColumn(ROW_KEY, F.col("doc_id")).unionByName(rows)


def _without_copies(docs: DataFrame, judge: Callable[..., DataFrame]) -> DataFrame:
    """The rows of docs that ``judge`` keeps, text by text."""
    keyed = _keyed(docs)
    dropped = judge(keyed.drop("row"), id_col=ROW_KEY).where("not kept").select(F.col("doc_id").alias(ROW_KEY))
    return keyed.join(dropped, ROW_KEY, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; learnt from the labels of documents that are not held out. Nulls score as empty texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train(docs.where(~held_out()), labels.where(~held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without_copies(docs, exact_dedup)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return _without_copies(docs, near_duplicates)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that look live replaced in their texts. Null texts stay null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens that hold every document."""
    import public_tokenizers

    return pack_examples(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), PLAIN)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("secrets", secrets), ("packing", packing)]

#: Trained scores, signatures and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again.

    A table goes when the next one is written; the last stays, as the result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_scratch(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
