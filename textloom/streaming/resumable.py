"""Resumable processing: a ledger in batch mode, a checkpoint in streaming mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def pending(chunks: DataFrame, ledger: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks that the ledger does not hold, in order of pos, at most ``most``."""
    left = chunks.join(ledger.select("id").distinct(), "id", "left_anti")
    return left if most is None else left.orderBy("pos", "id").limit(most)


def pending_predictions(items: DataFrame, predictions: DataFrame, systems: DataFrame) -> DataFrame:
    """(system, id) without a prediction."""
    return items.select("id").join(F.broadcast(systems.select("system"))).join(predictions.select("system", "id"), ["system", "id"], "left_anti")


def process(spark: SparkSession, chunks: DataFrame, out: str, make: Callable[[DataFrame], DataFrame], *, most: int | None = None) -> int:
    """One resumable step: records of ``make`` are appended first, rejects next, the ledger last.

    So a chunk counts as done only after its records are safe; a crash in between repeats it, and
    ``read_records`` keeps one row for each content key. Returns the number of chunks done.
    """
    ledger = _read(spark, f"{out}/ledger", "id string")
    todo = pending(chunks, ledger, most).persist()
    records = make(todo).persist()
    records.write.mode("append").parquet(f"{out}/records")
    todo.join(records.select("id"), "id", "left_anti").select("id", F.lit("no accepted item").alias("reason")).write.mode("append").parquet(f"{out}/rejects")
    n = todo.count()
    todo.select(F.col("id").cast("string").alias("id")).write.mode("append").parquet(f"{out}/ledger")
    records.unpersist()
    todo.unpersist()
    return n


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """Records once each, by a hash of all their columns."""
    got = spark.read.parquet(f"{out}/records")
    key = F.sha2(F.to_json(F.struct(*sorted(got.columns))), 256)
    w = Window.partitionBy("_key").orderBy("id")
    return got.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_key", "_r")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], *, files: int = 1) -> None:
    """All new files once: each micro-batch writes records and rejects to folders of its own number.

    The checkpoint knows which files are done. A batch that is run again after a failure
    overwrites its own folders, so nothing is doubled.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        records = make(batch)
        records.write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        batch.join(records.select("id"), "id", "left_anti").select("id", F.lit("no accepted item").alias("reason")).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        batch.unpersist()

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Progress(StreamingQueryListener):
    """Reports every ``each`` rows: ``report(rows so far, rows a second)``."""

    def __init__(self, report: Callable[[int, float], None], each: int = 25):
        self.report, self.each, self.rows, self.told = report, each, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.each:
            self.told = self.rows
            self.report(self.rows, event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def event_windows(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and time window, with a watermark: an extension for streams of events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
