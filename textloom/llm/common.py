"""What the operators of this subpackage share: table access, scratch tables, numbering."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.tables import table

__all__ = ["WS", "drop_path", "free", "gapless", "hash60", "list_column", "pieces", "release", "scratch_path", "shared_dir", "table", "word_lists", "words_of", "written"]

#: ASCII white space, as the contracts define it.
WS = r"[\x20\x09-\x0D]+"

#: Whether the shuffle files of a plan are deleted as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-process session (tests) may fall back on a local temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.sparkContext._conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    The files survive the loss of executors; they go by ``release`` or when the interpreter ends.
    What the plan has shuffled goes at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that no plan to come reads."""
    for t in tables:
        drop_path(t.sparkSession, t._scratch)
        _scratch.remove((t.sparkSession, t._scratch))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, in a stopped session too: the JVM outlives it."""
    jvm, live = SparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(live.hadoopConfiguration() if live else jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            drop_path(spark, path)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of anything but ASCII white space; none for null."""
    if not text:
        return []
    return text.split() if text.isascii() and not _ODD.search(text) else _WORD.findall(text)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII characters that str.split() takes for white space beside the six.
_ODD = re.compile(r"[\x1c-\x1f]")


def word_lists(texts: pa.Array) -> pa.ListArray:
    """``words_of`` for a column of texts, as a column of lists."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten()
    real = pc.not_equal(words, "")  # white space at an end leaves an empty word
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(before[split.offsets.to_numpy()], pa.int32()), words.filter(real))


def pieces(batch: pa.RecordBatch, most: int = 600_000) -> Iterator[pa.RecordBatch]:
    """The batch, cut where its texts pass ``most`` bytes, so memory follows that and the longest text."""
    sizes, at = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), 0
    while at < len(sizes):
        start, size = at, 0
        while at < len(sizes) and size < most:
            size, at = size + sizes[at], at + 1
        yield batch.slice(start, at - start)


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list for each array."""
    bounds = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def free(taken: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to clash with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def hash60(value: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text, as a long; null hashes as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def gapless(df: DataFrame, key: str, order: list[str], total: int, out: str = "slot", per_bucket: int = 1_000) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in the order of ``order``.

    ``order[0]`` is a long that spreads evenly over [0, 2**60), so its top bits split a key into
    ranges of about ``per_bucket`` rows or fewer: no task ever sorts a whole key, however hot. Rows
    that are equal in ``order[0]`` (one id many times, null ids) are one range. A small table of
    counts per range gives each range its first number.
    """
    bits = max(0, (max(1, total) // per_bucket).bit_length())
    bucket = F.shiftright(F.col(order[0]), 60 - bits).cast("int") if bits else F.lit(0)
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_b").orderBy(*order)
    numbered = rows.withColumn("_r", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, numbered[key].eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return joined.withColumn(out, F.col("_start") + F.col("_r")).drop("_b", "_k", "_kb", "_start", "_r")
