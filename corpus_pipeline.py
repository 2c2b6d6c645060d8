"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from textloom.llm.common import free, table, written

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rule ensemble scores below 0.5.

    The model learns from labelled rows of its own input outside the held-out third.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = free(docs.columns, "_score")
    return quality.score(docs, model, out).filter(F.col(out) >= 0.5).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the smallest id; full hashes only where length and beginning recur."""
    return exact_dedup.first_of_equal(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class keep the row with the smallest id; rows go by id and text together."""
    gone = near_dedup.near_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    h = free(docs.columns, "_text_hash")
    rows = docs.withColumn(h, F.xxhash64("text"))
    # a merge join at every size, so that texts move once
    return rows.join(gone.hint("merge"), (rows["doc_id"] == gone["_id"]) & (rows[h] == gone["_h"]), "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: range-partitioned and sorted by position.

    The stage's files, in the order of their numbers, hold the mixture; the next stage reads it off them.
    """
    i, s, p = (free(docs.columns, name) for name in ("_id", "_source", "_position"))
    placed = mixing.mix(docs).select(F.col("doc_id").alias(i), F.col("source").alias(s), "position")
    placed = written(placed.groupBy(i, s).agg(F.min("position").alias(p)), "pipeline-mix")
    same = docs["doc_id"].eqNullSafe(placed[i]) & docs["source"].cast("string").eqNullSafe(placed[s])
    ordered = docs.join(placed.hint("merge"), same).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), p)
    return ordered.sortWithinPartitions(p).select(*docs.columns)


def _numbered(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with ``out``: the rows' numbers, from 0, in the order of the files they were read from.

    Null where ``docs`` is no plain read of files and so has no order.
    """
    f, r, n = (free(docs.columns, name) for name in ("_file", "_row", "_start"))
    try:
        rows = docs.select(*docs.columns, F.col("_metadata.file_name").alias(f), F.col("_metadata.row_index").alias(r))
    except AnalysisException:
        return docs.withColumn(out, F.lit(None).cast("long"))
    part = F.regexp_extract(f, r"part-(\d+)", 1).cast("long")
    order = Window.orderBy(part, f).rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = rows.groupBy(f).agg(F.count(F.lit(1)).alias("_n")).select(F.col(f).alias("_f"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias(n))
    return rows.join(starts, F.col(f) == F.col("_f")).select(*docs.columns, (F.col(n) + F.col(r)).alias(out))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, the digests of its ids and decoded text, and its position in the mixture."""
    out = bpe.bpe_round_trip(_numbered(docs.select("doc_id", "text"), "position"), bpe.default_vocab(), keep=("position",))
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "position")


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The learned and hashed stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
