"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir
from . import alignment, ann, bpe, exact, iblt, lines, lm, minhash, mixing, phrases, secrets, substrings, toxicity
from .text import small_batches, word_count

RANKS = "byte_bpe_multi_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark, "spark-warehouse/checkpoints")
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.systematic_mix(docs, word_count(F.col("text")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def held_out(doc_id) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op5_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels)
    predicted = F.when(F.col("score") >= toxicity.REJECT, 1).otherwise(0).cast("int").alias("predicted")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted, "evidence")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_runs(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")))
    length = F.transform("deleted_runs", lambda r: (r["end"] - r["start"] + 1).cast("long"))
    return kept.select(
        "doc_id", "n_lines", F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_deleted"),
        F.array_join(F.transform("deleted_runs", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("runs"),
        F.sha2("text", 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.recode_bpe(docs, ranks, pattern).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = iblt.fingerprint_versions(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next")


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_exact_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"), every_digest=True)
    return found.withColumnRenamed("digest", "text_sha256")


def op12_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, pieces = (public_tokenizers.path(name) for name in ALIGNED)
    aligned = alignment.align(table(spark, sf_dir, "documents"), byte_level, pieces)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    counted = alignment.count_links(aligned.withColumn("groups_sha256", digest).drop("groups"), alignment.piece_count(pieces))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_suffix_automata": op1_suffix_automata,
    "op2_pseudo_likelihood": op2_pseudo_likelihood,
    "op3_iblt_fingerprint": op3_iblt_fingerprint,
    "op4_systematic_mix": op4_systematic_mix,
    "op5_nearest_toxicity": op5_nearest_toxicity,
    "op6_line_runs": op6_line_runs,
    "op7_minhash": op7_minhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_adaptive_scan": op9_adaptive_scan,
    "op10_crf_secrets": op10_crf_secrets,
    "op11_exact_refinement": op11_exact_refinement,
    "op12_prefix_free_parsing": op12_prefix_free_parsing,
    "op13_merge_path": op13_merge_path,
}
