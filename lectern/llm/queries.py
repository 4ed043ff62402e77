"""The numbered queries: thin digests over the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, fim, jaccard, license_scan, line_dedup, lm, minhash, negatives, quality_model, quality_rules, sharding, toxicity
from lectern.llm.classify import fold
from lectern.session import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), shards=16)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("_ld_lines").alias("n_lines"),
        F.col("_ld_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the licences found in it, the best score, and the number of matching units."""
    hits = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return hits.select(
        "doc_id",
        F.size("_ls_hits").cast("long").alias("n_hits"),
        F.concat_ws(",", F.array_sort(F.array_distinct("_ls_hits.license_id"))).alias("license_ids"),
        F.round(F.array_max("_ls_hits.dice"), 6).alias("best_dice"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return marked.select(
        "doc_id",
        F.col("_dc_words").alias("n_words"),
        decontaminate.n_hit(F.col("_dc_spans")).alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_dc_spans") > 0).alias("contaminated"),
    )


def vocabulary_path() -> str:
    """The byte-level vocabulary; LECTERN_BPE may name another file."""
    if named := os.environ.get("LECTERN_BPE"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    vocabulary = bpe.load(path)
    coded = bpe.encode(docs.select("doc_id", "text"), vocabulary, keep_text=False, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return judged.select(
        "doc_id", "_qr.n_words", "_qr.word_chars", "_qr.n_symbols", "_qr.n_dup_lines", "_qr.n_repeat_words",
        F.col("_qr_failed").alias("base_failed"), F.col("_qr_kept").alias("kept"),
    )


def _classified(spark: SparkSession, sf_dir: str, module, threshold: float) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = module.learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return module.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, 0.7)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, train=fold(F.col("doc_id"), 7) != 2)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_model, 0.5)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.items(e, label, F.col("embedding"), F.col("vec_id")), F.col("id") % 50 == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scans": op4_license_scans,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_bpe": op6_bpe,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_minhash": op11_minhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_in_middle": op13_fill_in_middle,
}
