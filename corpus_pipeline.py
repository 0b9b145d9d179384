"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next one.

toxicity drops what it rejects; minhash keeps one document of each group; repeats takes long repeated passages out of
the texts; secrets blanks the secrets in them; packing turns what is left into fixed-length sequences.

Defined cases: null and empty texts stay, as documents of the end id alone; of rows that share id and text, or share a
text and have no id, one stays, and no other row of a group of near copies; texts are worked on whole; an empty table
gives no rows; further columns go along to the last stage whatever their names, which returns pieces only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import near_dedup, packing, secret_scan, suffix_dedup, toxicity
from ratingloom.llm.common import Scratch, read_table

#: Bytes of a passage that counts as repeated: what over 50 words take at three letters each, in any of the languages.
REPEATED = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold; rows without an id stay if their text does."""
    model = toxicity.train_in_parts(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(suffix_dedup.without_repeats(docs, REPEATED))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(docs)
    return with_length(found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secret_spans"))).drop("secret_spans"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


def with_length(docs: DataFrame) -> DataFrame:
    """docs whose n_chars, if there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_copies), ("repeats", cut_repeats), ("secrets", blank_secrets), ("packing", pack)]

#: SQL cannot express these stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = scratch.keep(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(docs)
        docs = made
    return docs
