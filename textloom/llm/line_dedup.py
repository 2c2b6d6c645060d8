"""Line deduplication over content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, written


def _ends(lines: Column, divisor: int) -> Column:
    """The numbers (from 1) of the lines that end a chunk.

    A rolling hash over the last two lines' hashes chooses them, so the choice depends on those
    two lines alone and boundaries come back in step after an insertion or deletion.
    """
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    ends = lambda h: F.filter(
        F.sequence(F.lit(1), F.size(h)),
        lambda i: (i == F.size(h)) | ((i > 1) & (F.pmod(F.xxhash64(F.get(h, i - 2), F.get(h, i - 1)), F.lit(divisor)) == 0)),
    )
    return F.element_at(F.transform(F.array(hashes), ends), 1)


def _cut(at: Column, n: Column) -> Column:
    return F.array_join(F.slice("_lines", at, n), "\n")


def _place(at: Column, n: Column) -> Column:
    """Where n lines stand, from line ``at`` (from 1), and the hash and length of their bytes."""
    return F.struct(at.alias("at"), n.alias("n"), F.xxhash64(_cut(at, n)).alias("hash"), F.octet_length(_cut(at, n)).alias("n_bytes"))


def _places(source: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    """The chunks of more than ``min_lines`` lines of each text, and its windows of ``min_lines`` lines."""
    bounds = F.zip_with(F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.size("_ends") - 1)), F.col("_ends"), lambda a, b: F.struct((a + 1).alias("at"), (b - a).alias("n")))
    chunks = F.transform(F.filter(bounds, lambda c: c["n"] > min_lines), lambda c: _place(c["at"], c["n"]))
    windows = F.transform(F.sequence(F.lit(1), F.size("_lines") - (min_lines - 1)), lambda at: _place(at, F.lit(min_lines)))
    rows = source.withColumn("_ends", _ends(F.col("_lines"), divisor))
    return rows.select("doc_id", "_h", F.explode(F.concat(chunks, windows)).alias("c")).select("doc_id", "_h", "c.*").distinct()


def line_dedup(docs: DataFrame, *, divisor: int = 4, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove multi-line chunks that occurred before; per row: doc_id, n_lines, n_removed, kept_text.

    A text's lines are what ``\\n`` separates (null: none; an empty text is one empty line).
    Content-defined chunks are matched whole by hash and length. An exact step follows for what
    chunk boundaries miss: every window of ``min_lines`` adjacent lines outside the repeated chunks
    is matched likewise, so every run of at least ``min_lines`` lines that occurred before goes,
    wherever it begins. The first occurrence of a chunk or window, by doc_id, line number and text
    hash, stays; the lines of a later one go if its bytes equal the first's, in its own text too.

    Texts with a null id and null texts come back unchanged, without taking part. One id may have
    several texts: each is judged by itself, by (doc_id, text hash). Equal rows of one id are one
    text and each keep what the first keeps. Other columns are not read.

    Candidates are found on narrow rows (hash, length, place). Only texts that hold a repeated
    place go through the byte comparison, and each place is compared with the one first occurrence:
    rows grow with the input, and a chunk that a third of all documents share meets in joins that
    adaptive execution can split. Texts move twice, and the joins that move them are merge joins
    at every size, so a small run shows what a large one costs.
    """
    uid = ["doc_id", "_h"]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_h"))
    source = base.filter("doc_id IS NOT NULL AND _text IS NOT NULL").withColumn("_lines", F.split("_text", "\n", -1)).filter(F.size("_lines") >= min_lines)
    places = written(_places(source, divisor, min_lines), "line-places")
    keys = ["hash", "n_bytes", "n"]
    firsts = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "at", "_h")).alias("first")).filter("_n > 1").drop("_n")
    firsts = written(firsts, "line-firsts")  # written, so that both sides of the join are exchanged and a hot chunk can be split
    repeated = places.join(firsts, keys).withColumn("is_first", F.struct("doc_id", "at", "_h") == F.col("first"))
    asked = repeated.groupBy(*uid).agg(F.collect_list(F.struct("at", "n", "hash", "n_bytes", "is_first")).alias("_asked"))
    chunks = F.filter("_asked", lambda c: (c["n"] > min_lines) & ~c["is_first"])
    open_ = F.filter("_asked", lambda w: w["is_first"] | (w["n"] > min_lines) | ~F.exists("_chunks", lambda c: (c["at"] <= w["at"]) & (w["at"] + w["n"] <= c["at"] + c["n"])))
    asked = written(asked.withColumn("_chunks", chunks).select(*uid, open_.alias("_asked")), "line-asked")

    # the bytes of the wanted places, each cut from its own text
    cut = lambda c: F.struct(*[c[k].alias(k) for k in ("at", *keys, "is_first")], _cut(c["at"], c["n"]).alias("bytes"))
    texts = source.join(asked.hint("shuffle_merge"), uid).select(*uid, F.explode(F.transform("_asked", cut)).alias("c")).select(*uid, "c.*")
    texts = written(texts, "line-texts")
    originals = texts.filter("is_first").select(*keys, F.col("bytes").alias("original")).dropDuplicates(keys)
    gone = texts.filter("NOT is_first").join(originals, keys).filter(F.col("bytes") == F.col("original"))
    lines = gone.select(*uid, F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("line"))
    removed = written(lines.groupBy(*uid).agg(F.collect_set("line").alias("_gone")), "line-removed")

    rows = base.withColumn("_lines", F.split("_text", "\n", -1)).join(removed.hint("shuffle_merge"), uid, "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.col("_gone")), lambda i: F.get("_lines", i - 1))
    touched = F.col("_gone").isNotNull()
    return rows.select(
        "doc_id",
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(touched, F.size("_gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("_text")).alias("kept_text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 of the text that is left."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, pos, l[pos] || chr(10) || l[pos + 1] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS pos FROM d)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) > 1 AS gone FROM p),
r AS (SELECT doc_id, list(line) AS ls FROM (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS line FROM f WHERE gone) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(ls), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ls IS NULL THEN l ELSE list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(ls, i)), lambda i: l[i]) END, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
