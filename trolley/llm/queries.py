"""The operators applied to the driver's tables: one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, conversation_trie, cover_tree, decontaminate, html_extract, license_scan, lm_score, mixing, ngram_join, quality, recompression, token_counts, toxicity,
)
from .common import Stages, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), Stages(spark, "op1"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered template spans of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"), Stages(spark, "op4"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, losses and score of every document; target: documents labelled good and not toxic."""
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_corpus(docs, lm_score.good_ids(table(spark, sf_dir, "labels")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"), Stages(spark, "op6"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, with the items."""
    return decontaminate.leaking_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Stages(spark, "op8")
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return recompression.dedup_report(table(spark, sf_dir, "documents"), Stages(spark, "op9"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return ngram_join.report(table(spark, sf_dir, "documents"), Stages(spark, "op10"))


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """turns with the first h of each conversation c taken from conversation c - c % 20, h = crc32(c) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("_h")
    own = turns.where(F.col("pos") > h)
    heads = turns.where((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)).withColumnRenamed("conv_id", "_base")
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("_base"), h)
    return own.unionByName(wanted.join(heads, "_base").where(F.col("pos") <= F.col("_h")).select(turns.columns))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    stages = Stages(spark, "op11")
    turns = stages.put(conversation_trie.turns_of(table(spark, sf_dir, "conversations")))
    ids = turns.select("conv_id").distinct()
    return conversation_trie.prefix_trie(rebuilt(turns, ids), ids, stages)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations with faults put in, as the repair query asks for.

    By crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its text, 2
    takes its full stops and exclamation and question marks out, 3 repeats it, 4
    makes it the user's. Nulls count as one space.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat_ws(":", shown[0], shown[1]).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(shown[3], "[.!?]", "")).otherwise(shown[3])
    rows = conversations.where(fate != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(shown[2]).alias("role"),
        text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: faults after damage, cheapest repair and its digest."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(damaged(conversations), Stages(spark, "op12"), conversations)


#: Token limit of the report, and the tokenizer file it counts with.
TOKEN_LIMIT = 512
TOKENIZER = "byte_bpe_50k.json"


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, token_counts.frequent_table(docs, public_tokenizers.path(TOKENIZER)))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


SPARK = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_license_scan, op3_quality_classifier, op4_mixing, op5_lm_scoring, op6_html_extraction,
        op7_toxicity, op8_decontamination, op9_substring_dedup, op10_ngram_join, op11_conversation_trie, op12_conversation_repair,
        op13_token_counts,
    )
}
ORACLE: dict[str, str] = {}
