"""A training corpus from ``documents``, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which run() writes as Parquet and rereads as the docs of
the next one. Every stage works on all rows its predecessor kept. All stages
but the last return the columns of documents; the last adds how often the mix
takes each document.

Null or empty texts score 0 in the first stage and go. Null ids are kept (they
are never near copies); rows that repeat an id are reduced to one by the second
stage. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trolley.llm import decontaminate, mixing, ngram_join, quality, recompression
from trolley.llm.common import Stages, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the quality classifier scores below its threshold."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies (n-gram Jaccard >= 0.75)."""
    return ngram_join.one_of_each(docs, Stages(spark, "near-copies"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words or more that an earlier document, or the same one, already has."""
    return recompression.without_repeats(docs, Stages(spark, "repeats"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some twice, so that sources meet their target weights; column ``takes`` says how often."""
    return mixing.taken(docs, Stages(spark, "mix"))


STAGES = [
    ("quality", keep_quality),
    ("near-copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
]

#: The classifier, the tiling and the sampling have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stages = Stages(spark, "pipeline")
    for _, stage in STAGES:
        docs = stages.put(stage(spark, docs, sf_dir))
    return docs
