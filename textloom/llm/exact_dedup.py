"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WS, free, table, written

LEVEL = ["n_bytes", "prefix_hash"]


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def signature(text: Column, prefix_chars: int = 256) -> list[Column]:
    """The first two levels of a text: its normalised length and the hash of its beginning."""
    norm = normalised(text)
    return [F.octet_length(norm).cast("long").alias("n_bytes"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix_hash")]


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _twice(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once; written, so that a join on them exchanges both sides and a hot key's part can be split."""
    return written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "exact-level")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, prefix_hash.

    Texts are equal when identical after each run of ASCII white space becomes one space; a null
    text counts as empty. Of equal texts the smallest id stays. The refinement works on narrow
    rows: only lengths that occur twice are looked at by prefix hash, and only (length, prefix)
    pairs that occur twice by full hash. Without ``digest_all`` the full content is read for those
    survivors alone and text_sha256 is null for all others; with it the caller wants the digest of
    every row, so one scan yields all three levels and the text never moves.

    A third of all rows may be equal: every grouping is an aggregate with map-side combine, and
    the joins back are plain equi-joins whose large partitions adaptive execution splits. Rows are
    matched by the levels, never by id, so one id with several texts, and null ids, are judged text
    by text. Repeated rows with one id and equal texts count each in group_size and share the
    decision. A row with a null id stays only if its whole group has null ids. An empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    cols = [F.col(id_col).alias("doc_id"), *signature(F.col(text_col), prefix_chars)]
    sig = written(docs.select(*cols, *([full_hash(F.col(text_col)).alias("text_sha256")] if digest_all else [])), "exact-sig")
    same_length = sig.join(_twice(sig, "n_bytes"), "n_bytes", "left_semi")
    level = _twice(same_length, *LEVEL)
    if digest_all:
        survivors = sig.join(level, LEVEL, "left_semi")
    else:
        full = docs.select(*cols, F.col(text_col).alias("_text")).join(level, LEVEL, "left_semi")
        survivors = written(full.select("doc_id", *LEVEL, full_hash(F.col("_text")).alias("text_sha256")), "exact-full")
    keys = [*LEVEL, "text_sha256"]
    groups = written(survivors.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "exact-groups")
    if digest_all:
        rows = sig.join(groups, keys, "left")
    else:
        rest = sig.join(level, LEVEL, "left_anti").select("doc_id", *LEVEL, F.lit(None).cast("string").alias("text_sha256"))
        rows = survivors.join(groups, keys, "left").unionByName(rest, allowMissingColumns=True)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", *LEVEL)


def first_of_equal(docs: DataFrame, *, prefix_chars: int = 256) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows go by id, length, prefix and full hash together; the full hash of a row is computed only
    where the other three are those of a dropped row.
    """
    found = exact_dedup(docs, prefix_chars=prefix_chars)
    gone = found.filter("NOT kept").groupBy("doc_id", *LEVEL).agg(F.collect_set("text_sha256").alias("_digests"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("n_bytes").alias("_n"), F.col("prefix_hash").alias("_p"), "_digests")
    n, p = free(docs.columns, "_n_bytes"), free(docs.columns, "_prefix_hash")
    size, prefix = signature(F.col("text"), prefix_chars)
    rows = docs.withColumns({n: size, p: prefix})
    same = rows["doc_id"].eqNullSafe(gone["_id"]) & (rows[n] == gone["_n"]) & (rows[p] == gone["_p"]) & F.array_contains(gone["_digests"], full_hash(rows["text"]))
    return rows.join(gone.hint("merge"), same, "left_anti").select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its decision and digest."""
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
