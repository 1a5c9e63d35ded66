"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination and byte-level BPE, in this order.

Every stage works on the whole of what its predecessor kept. A null text passes through every stage; in an empty table
every stage returns none. All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, lines, toxicity
from tessera.llm.common import table, written

#: Documents scored so or higher go.
TOXIC = 0.5
#: Lines found in so many documents stay only where they come first.
COMMON_LINE = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out fold, doesn't find toxic."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, "_score").where(F.col("_score") < TOXIC).drop("_score")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repetitions of common lines; a document goes if it loses lines and nothing but blank ones stays.

    The first document with a common line keeps it, so that of a group of copies one is left. n_chars is counted anew.
    """
    out = lines.dedup_lines(docs, 1, COMMON_LINE, keep_first=True)
    blank = F.btrim(F.col("text"), F.lit(lines.SPACE)) == ""
    out = out.where(F.coalesce((F.col("n_dropped") == 0) | ~blank, F.lit(True)))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles connect, at similarity 0.8, the smallest doc_id.

    Documents with a null doc_id are in no group and stay; so do all rows of a doc_id that stays.
    """
    groups = jaccard.near_duplicates(docs, 5, 80)
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays")).where(~F.col("stays"))
    return docs.join(written(gone.select("doc_id"), "near-duplicates"), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    out = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(out).withColumnRenamed("ids", "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]
#: The classifier and the groups of near duplicates can't be told in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
