"""Substring deduplication against a log-structured index of window fingerprints."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import drop_path, list_column, pieces, release, scratch_path, table, word_lists, written

# ---------------------------------------------------------------------------- hashes of words


class ByteHashes:
    """64-bit hashes of words from their bytes, all words at once and no table of words: random
    values of the bytes, each times a power of an odd base by its place in the word, are added and mixed.
    """

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng((seed, 64))
        self.values, self.base = rng.integers(0, 2**64, 256, dtype=np.uint64), int(rng.integers(0, 2**61)) * 8 + 5
        self.powers = np.ones(1, dtype=np.uint64)

    def of_lists(self, words: pa.ListArray) -> list[np.ndarray]:
        """An array for each list of ``word_lists``."""
        flat = words.flatten().cast(pa.large_binary())
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        out = np.empty(len(flat), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(flat), 50_000):  # memory follows this many words, and the longest one
                edges = offsets[at : at + 50_001]
                sizes, starts = np.diff(edges), edges[:-1] - edges[0]
                if len(self.powers) < (longest := int(sizes.max())):
                    steps = np.full(2 * longest, self.base, dtype=np.uint64)
                    steps[0] = 1
                    self.powers = np.multiply.accumulate(steps)
                data = np.frombuffer(flat.buffers()[2], np.uint8)[edges[0] : edges[-1]]
                place = np.arange(len(data)) - np.repeat(starts, sizes)
                out[at : at + len(sizes)] = np.add.reduceat(self.values[data] * self.powers[place], starts)
            out = mix64(out)
        bounds = words.offsets.to_numpy()
        return [out[a:b] for a, b in itertools.pairwise((bounds - bounds[0]).tolist())]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Roller:
    """Polynomial hashes, modulo 2**64, of every run of k values."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = 2 * n + 1024
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def runs(self, values: np.ndarray, k: int) -> np.ndarray:
        n = len(values)
        if n < k:
            return np.empty(0, dtype=np.uint64)
        self._grow(n)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * self.up[:n], dtype=np.uint64)])
            return mix64((total[k:] - total[:-k]) * self.down[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


class Fingerprints:
    """Anchors and window hashes of one document's words.

    A window's anchor is the smallest hash of the ``k``-word runs inside it, so equal windows
    have equal anchors; a document has about 2 anchors for each (window - k + 2) words.
    """

    def __init__(self, window: int):
        self.window, self.k = window, max(1, window // 2)
        self.first, self.second = Roller(0x9E3779B97F4A7C15), Roller(0xD1B54A32D192ED03)
        self.words, self.others = ByteHashes(), ByteHashes(seed=1)

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The anchor of each window, in order of the windows."""
        if len(h) < self.window:
            return np.empty(0, dtype=np.uint64)
        return sliding_min(self.first.runs(h, self.k), self.window - self.k + 1)

    def windows(self, h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each window, over word hashes of different seeds: the fingerprint and its verification."""
        return self.first.runs(h, self.window), self.second.runs(other, self.window)


# ---------------------------------------------------------------------------- the index


@dataclass
class Run:
    """An immutable table of (key, check, doc_id), bucketed and sorted by (key, check), one file a bucket."""

    name: str
    path: str
    level: int


@contextlib.contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take the order of a run's files as given and do not sort them again."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class RunIndex:
    """Sorted immutable runs. New rows become a run of level 0; ``fanout`` runs of a level are compacted into one of the next."""

    spark: SparkSession
    kind: str
    path: str
    buckets: int
    fanout: int = 4
    runs: list[Run] = field(default_factory=list)

    def _write(self, rows: DataFrame, level: int) -> Run:
        name = f"textloom_{self.kind}_{uuid.uuid4().hex}"
        path = f"{self.path}/{name}"
        rows = rows.select("key", "check", "doc_id").repartition(self.buckets, "key", "check")
        rows.write.bucketBy(self.buckets, "key", "check").sortBy("key", "check").option("path", path).saveAsTable(name)
        return Run(name, path, level)

    def add(self, rows: DataFrame) -> list[Run]:
        """Index ``rows``; the runs that a compaction has replaced come back, to be dropped once the manifest no longer names them."""
        self.runs.append(self._write(rows, 0))
        level, replaced = 0, []
        while len(same := [r for r in self.runs if r.level == level]) >= self.fanout:
            merged = self.spark.table(same[0].name)
            for r in same[1:]:
                merged = merged.unionAll(self.spark.table(r.name))
            self.runs = [r for r in self.runs if r.level != level] + [self._write(merged, level + 1)]
            replaced += same
            level += 1
        return replaced

    def attach(self, runs: list[dict]) -> None:
        """Name the tables of another session's runs in this one."""
        self.runs = [Run(**r) for r in runs]
        for r in self.runs:
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r.name} (key BIGINT, `check` BIGINT, doc_id BIGINT) USING parquet CLUSTERED BY (key, `check`) SORTED BY (key, `check`) INTO {self.buckets} BUCKETS LOCATION '{r.path}'")

    def matching(self, keys: DataFrame) -> DataFrame | None:
        """The rows of all runs whose (key, check) is among ``keys``: a merge join with each run, which is neither exchanged nor sorted again."""
        out = None
        for r in self.runs:
            hits = self.spark.table(r.name).join(keys.hint("merge"), ["key", "check"], "left_semi")
            out = hits if out is None else out.unionAll(hits)
        return out

    def drop(self, runs: list[Run] | None = None) -> None:
        for r in self.runs if runs is None else runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.name}")
            drop_path(self.spark, r.path)
        if runs is None:
            self.runs = []


# ---------------------------------------------------------------------------- the operator

def _shas(words: pa.ListArray) -> list[str]:
    return [hashlib.sha256(x).hexdigest() for x in pc.binary_join(words, " ").cast(pa.binary()).to_pylist()]


def _describe(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(window)
        for part in itertools.chain.from_iterable(pieces(b) for b in batches):
            words = word_lists(part.column("text"))
            anchors = [np.unique(prints.anchors(h)).view(np.int64) for h in prints.words.of_lists(words)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "h": part.column("h"), "n_words": pa.array(np.diff(words.offsets.to_numpy()), pa.int64()),
                "sha": pa.array(_shas(words), pa.string()), "anchors": list_column(anchors, pa.int64()),
            })

    return run


_TOLD = "doc_id long, h long, n_words long, sha string, anchors array<long>"


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(window)
        for part in itertools.chain.from_iterable(pieces(b) for b in batches):
            words, asked = word_lists(part.column("text")), part.column("asked")
            edges, asked, out = (asked.offsets.to_numpy() - asked.offsets[0].as_py()).tolist(), asked.flatten().to_numpy().view(np.uint64), []
            for (lo, hi), h, other in zip(itertools.pairwise(edges), prints.words.of_lists(words), prints.others.of_lists(words), strict=True):
                pos = np.flatnonzero(np.isin(prints.anchors(h), asked[lo:hi]))
                a, b = prints.windows(h, other)
                out.append((a[pos].view(np.int64), b[pos].view(np.int64), pos))
            made = {name: list_column([o[k] for o in out], kind) for k, (name, kind) in enumerate([("key", pa.int64()), ("check", pa.int64()), ("pos", pa.int32())])}
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "h": part.column("h"), **made})

    return run


def _cut(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc_id, h, text, starts in zip(f["doc_id"], f["h"], f["text"], f["starts"], strict=True):
                words = word_lists(pa.array([text], pa.string())).flatten()
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                starts = np.unique(np.asarray(starts, dtype=np.int64))
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(change[::2], change[1::2], strict=True)]
                left = words.filter(pa.array(~gone))
                out.append((doc_id, h, int(gone.sum()), _shas(pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), left))[0], spans))
            yield pd.DataFrame(out, columns=["doc_id", "h", "n_removed", "kept_sha256", "spans"])

    return run


_CUT = "doc_id long, h long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


class SubstringDedup:
    """Incremental: each ``add`` judges one batch against all before it and itself, then indexes it.

    The ids of a batch must lie above those already indexed. The index lives in the folder ``path``
    (default: a scratch folder), and a manifest there names its runs after every batch: a later
    session that gives the same ``path`` goes on where the last complete ``add`` ended. ``archive``
    holds every document added so far, for the texts that an old anchor newly met has to be read
    again for; within a session it is the batches themselves.
    """

    def __init__(self, spark: SparkSession, *, path: str | None = None, archive: DataFrame | None = None, window: int = 50, buckets: int | None = None, fanout: int = 4):
        self.spark, self.window, self.path = spark, window, path or scratch_path(spark, "sub-index")
        known = self._manifest()
        if known and known["window"] != window:
            raise ValueError(f"the index at {self.path} has windows of {known['window']} words")
        if known and archive is None:
            raise ValueError("an index that is continued needs the archive of its documents")
        buckets = known["buckets"] if known else buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.version = known["version"] if known else 0
        self.copies = RunIndex(spark, "digests", self.path, buckets, fanout)
        self.anchors = RunIndex(spark, "anchors", self.path, buckets, fanout)
        if known:
            self.copies.attach(known["copies"])
            self.anchors.attach(known["anchors"])
        self.archive = self._rows(archive) if known else None

    @staticmethod
    def _rows(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).filter("doc_id IS NOT NULL")

    def _manifest(self) -> dict | None:
        """The last complete manifest: a folder that Spark has marked as written to the end."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        done = sorted(f.getPath().getParent().toString() for f in found or [])
        return json.loads(self.spark.read.text(done[-1]).first()[0]) if done else None

    def _commit(self) -> None:
        self.version += 1
        state = {"version": self.version, "window": self.window, "buckets": self.anchors.buckets, **{i.kind: [asdict(r) for r in i.runs] for i in (self.copies, self.anchors)}}
        state["copies"] = state.pop("digests")
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:09d}")

    def add(self, batch: DataFrame) -> DataFrame:
        rows = self._rows(batch)
        told = written(rows.mapInArrow(_describe(self.window), _TOLD), "sub-told")
        half = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
        keyed = told.withColumn("key", half(1)).withColumn("check", half(17))

        # whole copies: only the smallest id of a word sequence is looked at any further
        heads = written(keyed.filter(F.col("n_words") >= self.window).groupBy("key", "check").agg(F.min("doc_id").alias("doc_id")), "sub-heads")
        with _sorted_buckets(self.spark):
            older = self.copies.matching(heads.select("key", "check"))
            fresh = heads if older is None else heads.join(older.select("key", "check").distinct(), ["key", "check"], "left_anti")
            fresh = written(fresh, "sub-fresh")
        is_fresh = keyed.join(fresh.withColumnRenamed("doc_id", "_head"), ["key", "check"], "left").withColumn("fresh", (F.col("n_words") < self.window) | F.col("_head").eqNullSafe(F.col("doc_id")))
        judged = written(is_fresh.select("doc_id", "h", "n_words", "sha", "anchors", "fresh"), "sub-judged")

        # anchors that stand in two documents, this batch's or older ones
        new = judged.filter("fresh").select(F.explode("anchors").alias("key"), F.lit(0).cast("long").alias("check"), "doc_id").distinct()
        met = written(new.groupBy("key", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "sub-met")
        with _sorted_buckets(self.spark):
            old = self.anchors.matching(met.select("key", "check"))
            old = old if old is None else written(old, "sub-old")
        shared = met.filter("lo < hi").select("key")
        if old is not None:
            shared = shared.unionAll(old.select("key")).distinct()
        shared = written(shared, "sub-shared")  # an aggregate that is joined by its own keys is written first: then both sides are exchanged and a hot key's part can be split
        asked = new.join(shared.hint("merge"), "key", "left_semi").select("doc_id", "key")
        if old is not None:
            asked = asked.unionAll(old.select("doc_id", "key"))
        asked = asked.groupBy("doc_id").agg(F.collect_set("key").alias("asked"))
        known = rows if self.archive is None else self.archive.unionAll(rows)
        texts = written(known.join(asked.hint("merge"), "doc_id").select("doc_id", "h", "text", "asked"), "sub-texts")

        # exact judgement of the windows that hold a shared anchor
        spots = texts.mapInArrow(_window_rows(self.window), "doc_id long, h long, key array<long>, check array<long>, pos array<int>")
        spots = written(spots.select("doc_id", "h", F.explode(F.arrays_zip("key", "check", "pos")).alias("w")).select("doc_id", "h", "w.key", "w.check", "w.pos"), "sub-spots")
        first = spots.groupBy("key", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
        first = written(first.select("key", "check", "lo"), "sub-first")
        uid = ["doc_id", "h"]
        gone = spots.join(first.hint("merge"), ["key", "check"]).filter("doc_id > lo").groupBy(*uid).agg(F.collect_set("pos").alias("starts"))
        mine = judged.filter("fresh").select(*uid)
        touched = texts.join(gone.hint("merge"), uid).join(mine.hint("merge"), uid, "left_semi").select(*uid, "text", "starts").mapInPandas(_cut(self.window), _CUT)
        touched = written(touched.dropDuplicates(uid), "sub-cut")

        none = F.lit(hashlib.sha256(b"").hexdigest())
        whole = judged.join(touched, uid, "left")
        all_gone = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
        out = whole.select(
            "doc_id", "n_words",
            F.when(~F.col("fresh"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(~F.col("fresh"), none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(~F.col("fresh"), all_gone).otherwise(F.coalesce("spans", F.slice(all_gone, 1, 0))).alias("spans"),
        )
        out = written(out, "sub-out")
        replaced = [(i, i.add(rows_)) for i, rows_ in ((self.copies, fresh), (self.anchors, new))]
        self._commit()
        for index, runs in replaced:
            index.drop(runs)
        self.archive = known
        release(told, heads, fresh, judged, met, shared, texts, spots, first, touched, *([] if old is None else [old]))
        return out


def substring_dedup(docs: DataFrame, *, window: int = 50, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, spans (the word ranges removed).

    Words are runs of anything but ASCII white space. A word goes if a window of ``window`` words
    around it has the same words as one that starts in a document of smaller id; windows are
    judged on the input. The documents enter in ``batches`` ranges of ids, each judged against the
    index of all before; with the defaults the third batch meets a compacted run.

    The index holds, for every window, the smallest hash of the half-window runs inside it (its
    anchor): equal windows have equal anchors, so a window that recurs has an anchor that recurs.
    Where one does, the windows around it are hashed in full, verified by a second 64-bit hash over
    other word hashes, and compared by their smallest document. Whole copies are settled by digest
    first. Very common passages meet in aggregates with map-side combine and in joins that adaptive
    execution can split; no group is ever gathered in one task.

    Null and empty texts have no words; texts shorter than the window lose nothing. One id may have
    several texts: each is judged by itself, by (doc_id, text hash), and none of them removes
    words of another. Equal rows come out equal. A row with a null id comes back whole. Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    index = SubstringDedup(spark, window=window, fanout=fanout)
    edges = [None, *sorted(set(cuts or [])), None]
    out = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows.filter("doc_id IS NOT NULL")
        part = part if lo is None else part.filter(F.col("doc_id") > lo)
        part = part if hi is None else part.filter(F.col("doc_id") <= hi)
        got = index.add(part)
        out = got if out is None else out.unionAll(got)
    index.copies.drop()
    index.anchors.drop()
    rest = rows.filter("doc_id IS NULL").withColumn("h", F.xxhash64("text")).mapInArrow(_describe(window), _TOLD)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.unionAll(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), none.alias("spans")))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 50 words."""
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
m AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM s),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) < doc_id AS gone FROM m),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM f WHERE gone),
r AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(qs, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
