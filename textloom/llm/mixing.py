"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import gapless, hash60, scratch_path, table


def default_weight(rows: int, exponent: float = 0.5) -> Fraction:
    """The ``exponent`` power of a source's row count, as an exact multiple of 2**-20."""
    return Fraction(max(1, math.isqrt(rows << 40) if exponent == 0.5 else math.floor(rows**exponent * 2**20)), 2**20)


def schedule(blocks: dict[str, int], weights: dict[str, Fraction | float]) -> Iterator[tuple[str, int, int, int]]:
    """Slot by slot (source, block, release, deadline), until all ``blocks`` are placed.

    The target is the fluid mixture: at any time the sources that have something left share it by
    their exact weights. Block k of a source flows from virtual time k/w to (k+1)/w; its release
    and deadline are the slots in which that begins and ends, in whole-number arithmetic, so
    nothing is rounded to a period and no error adds up. The fluid mixture shows that all windows
    can be met, and earliest deadline first among the released blocks then meets them: every prefix holds
    each source's target to within one block, to the last slot. Time is that of one heap step a block.
    """
    n = {s: c for s, c in blocks.items() if c > 0}
    exact = {s: Fraction(weights[s]) for s in n}
    scale = math.lcm(*(w.denominator for w in exact.values())) if n else 1
    w = {s: int(x * scale) for s, x in exact.items()}
    order = sorted(n, key=lambda s: Fraction(n[s], w[s]))
    ends = [Fraction(n[s], w[s]) for s in order]  # when a source runs out
    gone, active = [0], [sum(w.values())]  # blocks of those that have, and the weight of the others
    for s in order:
        gone.append(gone[-1] + n[s])
        active.append(active[-1] - w[s])
    stage = dict.fromkeys(n, 0)

    def slots(s: str, k: int) -> tuple[int, int]:
        """The slots that hold the moment k/w: its floor and its ceiling."""
        i = stage[s]
        if i < len(ends) and ends[i].numerator * w[s] <= k * ends[i].denominator:
            i = stage[s] = bisect.bisect_right(ends, Fraction(k, w[s]))
        return gone[i] + k * active[i] // w[s], gone[i] - (-k * active[i] // w[s])

    waiting = [(0, s, 0) for s in n]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(sum(n.values())):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (slots(s, k + 1)[1], s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, release, deadline
        if k + 1 < n[s]:
            heapq.heappush(waiting, (slots(s, k + 1)[0], s, k + 1))


def _written_schedule(spark: SparkSession, blocks: dict[str, int], weights: dict[str, Fraction | float], rows: int = 500_000) -> DataFrame:
    """(k, b, slot) of each block, written ``rows`` at a time, so the driver never holds the whole."""
    path, placed, at = scratch_path(spark, "mix-schedule"), schedule(blocks, weights), 0
    while True:
        part = list(itertools.islice(placed, rows))
        columns = {"k": pa.array([p[0] for p in part], pa.string()), "b": pa.array([p[1] for p in part], pa.int64()), "slot": pa.array(range(at, at + len(part)), pa.int64())}
        spark.createDataFrame(pa.table(columns)).write.mode("append").parquet(path)
        at += len(part)
        if len(part) < rows:
            break
    return spark.read.schema("k string, b long, slot long").parquet(path)


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, block: int = 8, exponent: float = 0.5, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Give every row a place in the mixture: doc_id, source, block, slot, place, position.

    A source's rows are shuffled by a seeded hash of the id and cut into blocks of ``block`` rows.
    ``schedule`` interleaves the blocks, so every prefix holds each source's exact share to within
    one block. All rows are kept: a source that has run out leaves its slots to the others. position
    is slot * block + place: it numbers the mixed rows, with gaps after a source's short last block.

    ``weights`` maps sources to target weights; by default, and for sources it does not name, a
    source weighs the ``exponent`` power of its row count. Every source has its own blocks, however
    many there are; the driver holds one count a source. The schedule is made on the driver, one heap
    step a block, and written in pieces, so its memory is that of the sources and its time some three
    microseconds a block: give ``block`` as many rows as keeps the blocks below 10**8. A null source
    is a source of its own, a null id hashes as ''; repeated rows are rows. Text is not read.

    A hot source is never one task's work: rows are numbered in ranges of their hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    rows = rows.withColumn("_h", hash60(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    found = rows.groupBy("source", "_key").agg(F.count(F.lit(1)).alias("n")).collect()
    named = weights or {}
    target = {r["_key"]: Fraction(named[r["source"]]) if r["source"] in named else default_weight(r["n"], exponent) for r in found}
    if any(w <= 0 for w in target.values()):
        raise ValueError("a weight must be positive")
    total = sum(r["n"] for r in found)
    numbered = gapless(rows, "_key", ["_h", "doc_id"], total, out="_i").withColumn("block", F.floor(F.col("_i") / block)).withColumn("place", F.pmod("_i", F.lit(block)).cast("int"))
    plan = _written_schedule(spark, {r["_key"]: -(-r["n"] // block) for r in found}, target)
    placed = numbered.join(plan, (F.col("_key") == F.col("k")) & (F.col("block") == F.col("b")))
    return placed.select("doc_id", "source", "block", "slot", "place", (F.col("slot") * block + F.col("place")).alias("position"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source."""
    return mix(table(spark, sf_dir, "documents"))


#: Windows of all blocks in whole numbers, then one recursion a slot: the released block of earliest deadline.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key, row_number() OVER (PARTITION BY source ORDER BY substr(md5(coalesce('mix:' || doc_id::VARCHAR, 'mix')), 1, 15), doc_id) - 1 AS i FROM documents),
s AS (SELECT key, ((count(*) + 7) // 8)::HUGEINT AS n, floor(sqrt(count(*)) * 1048576)::HUGEINT AS w, row_number() OVER (ORDER BY key) AS r FROM d GROUP BY key),
b AS (SELECT key, r, n, w, unnest(range(0, n::BIGINT + 1)) AS k FROM s),
t AS (SELECT b.key, b.r, b.k, b.n, b.w, coalesce(sum(o.n) FILTER (o.n * b.w <= b.k * o.w), 0)::HUGEINT AS gone, coalesce(sum(o.w) FILTER (o.n * b.w > b.k * o.w), 0)::HUGEINT AS active FROM b, s o GROUP BY ALL),
v AS (SELECT key, r, k, n, gone + (k * active) // w AS floor_slot, gone + (k * active + w - 1) // w AS ceil_slot FROM t),
win AS (SELECT a.key, a.r, a.k, a.floor_slot AS release, z.ceil_slot AS deadline FROM v a JOIN v z ON z.r = a.r AND z.k = a.k + 1),
run AS (
  SELECT 0 AS slot, (SELECT list(0::BIGINT) FROM s) AS done, NULL::STRUCT(deadline HUGEINT, key VARCHAR, r BIGINT, k BIGINT) AS pick
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, j: CASE WHEN j = p.r THEN x + 1 ELSE x END), p
  FROM (SELECT slot, done, min(struct_pack(deadline := deadline, key := key, r := r, k := k)) AS p FROM run JOIN win ON win.k = run.done[win.r] AND win.release <= run.slot GROUP BY slot, done)),
plan AS (SELECT slot - 1 AS slot, pick.key AS key, pick.k AS block FROM run WHERE slot > 0)
SELECT doc_id, source, block::BIGINT AS block, slot::BIGINT AS slot, (i % 8)::INT AS place, (slot * 8 + i % 8)::BIGINT AS position FROM d JOIN plan ON plan.key = d.key AND plan.block = d.i // 8
"""
