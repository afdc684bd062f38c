"""Corpus pipeline: documents in, tokens out. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from netlog.llm import bpe, lines, minhash, mixing, toxicity
from netlog.llm.queries import RANKS, held_out, table
from netlog.llm.text import small_batches, word_count
from netlog.session import as_table

# Where line dedup leaves the runs that it deleted; no table has such a column.
RUNS = "\0runs deleted"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit. Learns from the labelled rows that are not held out.

    Null and empty texts score like texts without a known term, which stay. Repeated rows stay or go together, rows with a
    null doc_id are judged by their text. An empty table gives none; other columns pass, whatever they are called.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))


def drop_line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs. A document that is nothing but such copies goes.

    Of equal runs the first by doc_id stays, null first, then by the text's hash, then by line. ``n_chars`` is counted anew
    where lines go. Null and empty texts stay as they are; rows of equal id and text change alike. An empty table gives
    none; other columns pass, whatever they are called.
    """
    kept = lines.drop_repeated_runs(docs, runs=RUNS)
    changed = F.size(RUNS) > 0
    kept = kept.where(~changed | F.col("text").isNull() | (F.col("text") != ""))
    n_chars = F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Documents without words, null texts among them, are alike to nothing and stay, and so do rows with a null doc_id. Rows of
    one doc_id stay or go together. An empty table gives none; other columns pass, whatever they are called.
    """
    small_batches(spark)
    return minhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a document can go, or come up to three times.

    Null sources are one source. Null and empty texts have size 0 and are taken like others of their source. Of rows of one
    doc_id, null among them, each is taken by one of the id's counts. An empty table gives none; other columns pass.
    """
    return mixing.emit_copies(docs, mixing.systematic_mix(docs, word_count(F.col("text"))))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed little-endian 32-bit), and whether they decode to its text.

    Null and empty texts have no tokens, which decode to the empty text. A row in is a row out: doc_id, lang and source as
    they were, null or not, n_tokens, ids and round_trip. An empty table gives none; other columns are left out.
    """
    small_batches(spark)
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.recode_bpe(docs, ranks, pattern)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
                          "ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_line_runs),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

# Nearest examples, minima and a byte-level tokenizer have no form in SQL; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
