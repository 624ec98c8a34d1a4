"""A corpus pipeline: language identification, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and rereads for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, mixing, pii, resemblance, simhash
from millrace.llm.common import discard, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that was learnt go: without a letter, or too far from every profile. Learns from the rows it is given, fold 2 left out; without a labelled row nothing can be rejected and all stay."""
    labelled = docs.where(~langid.held_out(F.col("doc_id")))
    profiles = langid.learn(labelled)
    if not profiles.names:
        return docs
    least = langid.least_score(labelled, profiles)
    found = langid.identify(docs, profiles, into=("_lang_pred", "_score"))
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= least)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return simhash.deduplicate(docs, find=resemblance.grouped)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, terms that disclose it are generalised or removed; no document goes."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time a document is taken, with its shard, pass and order."""
    return mixing.mixed(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", sanitise_personal_data),
    ("mixing sources to target weights", mix_sources),
]

#: Alignment, components and hashed draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage{k}"))
        if last:
            discard(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
