"""The corpus pipeline: from raw documents to token ids, each stage by an operator of ``emberscope.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.llm import decontaminate, langid, mixing, near_dedup, token_output
from emberscope.llm.common import free_name, read
from emberscope.llm.queries import END_ID, MIX_POWER, MIX_SEED, tokenizer_path
from emberscope.session import fresh_dir, pin_utc, remove_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without a letter or unlike every language go."""
    shares = langid.trigram_shares(docs)
    prototypes = langid.prototypes_of(shares)
    said = free_name(docs, "__said")
    judged = docs.withColumn(said, langid.predict(docs, prototypes, spreads=langid.spreads_of(shares, prototypes)))
    return judged.filter((F.col(f"{said}.lang_pred") != langid.UNKNOWN) & ~F.col(f"{said}.foreign")).drop(said)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return near_dedup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("items") == 0).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that a source's share is as the square root of its size, in random order."""
    return mixing.mix(docs, mixing.rates(docs, power=MIX_POWER), MIX_SEED).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in order of document id, and each document's place as read back from them."""
    return token_output.read_tokens(token_output.write_tokens(docs, tokenizer_path(), END_ID))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: Near duplicates and token ids are beyond SQL; the tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread as the input of the next."""
    docs, last = read(pin_utc(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_dir(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
