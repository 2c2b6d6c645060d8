"""Numbering of rows, in all or within a key, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.tables import stored


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with ``out`` = 1, 2, 3, ... within each key, in the order of ``order``, which must tell rows apart.

    Rows are range-partitioned by key and order, so a hot key spreads over as many partitions as
    its size asks for. Each partition numbers its own rows; a table of counts with a row for each
    key and partition gives what comes before. Rows are stored once, so that the partition
    numbers hold even if executors are lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(parts, *keys, *order).withColumn("_nb_part", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_nb_part").agg(F.count(F.lit(1)).alias("_nb_count"))
    before = Window.partitionBy(*keys).orderBy("_nb_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_nb_k{i}") for i, k in enumerate(keys)], F.col("_nb_part").alias("_nb_q"), F.coalesce(F.sum("_nb_count").over(before), F.lit(0)).alias("_nb_start"))
    local = placed.withColumn("_nb_local", F.row_number().over(Window.partitionBy(*keys, "_nb_part").orderBy(*order)))
    same = F.col("_nb_part") == F.col("_nb_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_nb_k{i}"))
    joined = local.join(starts, same)
    return joined.withColumn(out, F.col("_nb_start") + F.col("_nb_local")).drop("_nb_part", "_nb_q", "_nb_start", "_nb_local", *[f"_nb_k{i}" for i in range(len(keys))])
