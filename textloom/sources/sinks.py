"""Sinks: chunk and record exports, manifests, metric tables, the table of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, *, jsonl: bool = False) -> None:
    (chunks.write.mode("overwrite").json if jsonl else chunks.write.mode("overwrite").parquet)(path)


def write_records(records: DataFrame, path: str) -> None:
    """Training and validation rows, one folder each."""
    records.write.mode("overwrite").partitionBy("split").json(path)


def write_json_document(one_row: DataFrame, path: str) -> None:
    """A single nested record as one JSON line."""
    one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_manifest(entries: DataFrame, path: str) -> None:
    stamped = entries.withColumn("retrieved_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    stamped.write.mode("overwrite").json(path)


def latest_by_title(pages: DataFrame, order: str = "pos") -> DataFrame:
    """One record a title, the last one."""
    w = Window.partitionBy("title").orderBy(F.desc(order))
    return pages.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def write_dense_index(index: DataFrame, path: str, model: str) -> None:
    index.write.mode("overwrite").parquet(path)
    index.sparkSession.createDataFrame([(model,)], "model string").write.mode("overwrite").parquet(path.rstrip("/") + ".meta")


def append_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One prediction for each (system, id)."""
    return spark.read.parquet(path).dropDuplicates(["system", "id"])


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(metrics: DataFrame) -> str:
    """A Markdown table of a metric frame: all rows, passed to the driver partition by partition."""
    rows = metrics.toLocalIterator()
    head = "| " + " | ".join(metrics.columns) + " |\n|" + "---|" * len(metrics.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def source_table(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, line): title, status, characters and chunk count, padded to columns."""
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    joined = manifest.join(counts, "source", "left")
    cell = lambda c, w: F.rpad(F.coalesce(c, F.lit("")), w, " ")
    line = F.concat(cell(F.substring("title", 1, 56), 56), F.lit(" "), cell(F.substring("status", 1, 20), 20), F.lpad(F.format_number(F.coalesce("char_count", F.lit(0)), 0), 12, " "), F.lpad(F.format_number(F.coalesce("n", F.lit(0)), 0), 8, " "))
    return joined.select("source", line.alias("line"))


def chunk_counts(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, chunks), 0 for a source without any."""
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return manifest.select("source").join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("chunks"))


def replace_table(spark: SparkSession, path: str, change) -> None:
    """Rewrite a table from itself: the new version is written beside it, then the folders are swapped."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    change(spark.read.parquet(path)).write.parquet(new)
    jvm = spark.sparkContext._jvm
    old_path, new_path = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = old_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(new + "-old")
    fs.rename(old_path, aside)
    fs.rename(new_path, old_path)
    fs.delete(aside, True)


def training_log(log: DataFrame, path: str) -> None:
    """(step, loss, eval_loss) as CSV."""
    write_metrics(log.orderBy("step"), path)
