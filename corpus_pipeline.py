"""From raw documents to token ids: quality rules, line deduplication, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of ``documents``. Only whole documents that a stage rejects go; line deduplication removes lines, not documents.

Near duplicates are sought in what line deduplication left. A copy has lost every line of ten characters or more that it
shares with an earlier document, so what is left of exact and near copies is a few short or changed lines: those texts are
small or empty, no longer alike, and stay as the documents they now are. The stage finds copies that are alike below the
level of lines, such as the same words broken into other lines.

Defined cases, alike in all stages: null and empty texts have no words; repeated rows are taken one by one, and all stay or go
together; an empty table gives an empty table; extra columns of ``documents`` are kept up to the last stage, whatever their
names, but for names that start with ``_ld_``, ``_dc_`` or ``_qr``, which operators use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, line_dedup, quality_rules
from lectern.llm.queries import bpe_digest, vocabulary_path
from lectern.session import cut, forget, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null or empty text has too few words and goes; a null lang is judged by the plain rules alone."""
    return quality_rules.judge(docs).where("_qr_kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one owns, and ``n_chars`` of what is left; a document may be left empty (never null)."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates; empty texts are alike with nothing and stay, and so do rows with null doc_id."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a hit of the benchmark; one without words has none."""
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).where(F.size("_dc_spans") == 0).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of what they decode to; an empty text has no tokens."""
    return bpe_digest(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("bpe", tokens),
]

#: SQL can't express the encoding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
