"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import table, written


@dataclass
class Tree:
    """Inner node i sends x left if x . dirs[i] < cuts[i]; kids below 0 are leaves (leaf = -1 - kid)."""

    dirs: np.ndarray
    cuts: np.ndarray
    kids: np.ndarray
    leaves: int


def build_tree(points: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split at the median along the line between two random points of a node, down to ``leaf`` points."""
    dirs, cuts, kids = [], [], []
    leaves = 0
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        split = None
        if len(rows) > leaf:
            for _ in range(5):
                a, b = points[rng.choice(rows, 2, replace=False)]
                length = float(np.linalg.norm(a - b))
                if length < 1e-12:
                    continue
                d = (a - b) / length
                at = points[rows] @ d
                cut = float(np.median(at))
                left = at < cut
                if 0 < left.sum() < len(rows):
                    split = d, cut, left
                    break
        if split is None:
            me, leaves = -1 - leaves, leaves + 1
        else:
            me = len(dirs)
            dirs.append(split[0])
            cuts.append(split[1])
            kids.append([0, 0])
            todo += [(rows[split[2]], me, 0), (rows[~split[2]], me, 1)]
        if parent >= 0:
            kids[parent][side] = me
    dim = points.shape[1]
    return Tree(np.array(dirs, dtype=np.float32).reshape(-1, dim), np.array(cuts, dtype=np.float32), np.array(kids, dtype=np.int32).reshape(-1, 2), max(1, leaves))


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``x``."""
    at = np.zeros(len(x), dtype=np.int32) if len(tree.dirs) else np.full(len(x), -1, dtype=np.int32)
    live = np.flatnonzero(at >= 0)
    while len(live):
        node = at[live]
        right = np.einsum("ij,ij->i", x[live], tree.dirs[node]) >= tree.cuts[node]
        at[live] = tree.kids[node, right.astype(np.int32)]
        live = live[at[live] >= 0]
    return -1 - at


def visit(trees: list[Tree], margins: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(tree, leaf) pairs, nearest first by one priority queue over all trees.

    A branch's priority is the sum of the squared margins of the cuts that the query lies on the
    wrong side of; the near side of a cut keeps its parent's priority.
    """
    heap = [(0.0, t, 0 if len(tree.dirs) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(heap)
    while heap:
        far, t, node = heapq.heappop(heap)
        while node >= 0:  # down the near side, whose priority is the same
            m = float(margins[t][node])
            left, right = trees[t].kids[node]
            heapq.heappush(heap, (far + m * m, t, int(right if m < 0 else left)))
            node = int(left if m < 0 else right)
        yield t, -1 - node


def margins_of(trees: list[Tree], q: np.ndarray) -> list[np.ndarray]:
    return [t.dirs @ q - t.cuts if len(t.dirs) else np.empty(0) for t in trees]


def calibrate(trees: list[Tree], points: np.ndarray, k: int, target: float, queries: int, rng: np.random.Generator) -> float:
    """The share of rows (counted once a tree) to visit so that recall@k on the sample reaches ``target``."""
    leaf_of = [assign(t, points) for t in trees]
    sizes = [np.bincount(a, minlength=t.leaves).astype(float) for a, t in zip(leaf_of, trees, strict=True)]
    asked = rng.choice(len(points), min(queries, len(points)), replace=False)
    need = []
    for i in asked:
        score = points[:, :-1] @ points[i, :-1]
        score[i] = -np.inf
        m = min(k, len(points) - 1)
        best = set(np.argpartition(-score, m - 1)[:m].tolist()) if m else set()
        holds: dict[tuple[int, int], list[int]] = {}
        for t, a in enumerate(leaf_of):
            for b in best:
                holds.setdefault((t, int(a[b])), []).append(b)
        rows = 0.0
        for key in visit(trees, margins_of(trees, np.append(points[i, :-1], np.float32(0)))):
            if not best:
                break
            rows += sizes[key[0]][key[1]]
            for b in holds.get(key, ()):
                if b in best:
                    best.discard(b)
                    need.append(rows)
    return min(float(len(trees)), float(np.quantile(need, target)) / len(points)) if need else 1.0


def pack(sizes: np.ndarray, group_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each leaf, parts of each group): leaves side by side in groups of about ``group_rows`` rows; a larger leaf is a group of its own, in parts."""
    group, parts, filled = np.empty(len(sizes), dtype=np.int64), [], math.inf
    for i, size in enumerate(sizes.tolist()):
        if filled + size > group_rows:
            parts.append(max(1, math.ceil(size / group_rows)))
            filled = 0.0
        group[i] = len(parts) - 1
        filled += size
    return group, np.array(parts, dtype=np.int64)


def nearest(vectors: DataFrame, *, k: int = 20, is_query: str = "vec_id % 20 = 0", trees: int = 4, leaf: int = 256, sample: int = 65_536, target: float = 0.94, group_rows: int = 20_000, query_slice: int = 4_000, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors of largest inner product found for each query: query_id, rank, vec_id, score.

    Inner products become distances by one more component, sqrt(largest norm squared - own norm
    squared). The trees' cuts are fitted on at most ``sample`` vectors (those of smallest id
    hash); every vector is then put into a leaf of every tree. A query visits leaves of all trees
    by one shared priority queue. How many is fitted too: the share of rows by which a fraction
    ``target`` of the sample's own true neighbours is reached. All rows of the visited leaves are
    reranked by their exact inner product in double precision.

    Leaves are dealt into groups of about ``group_rows`` rows, a larger leaf into parts, and a group's
    queries into slices of about ``query_slice``: what meets in one task is bounded, however many
    rows a leaf has. Only a group that more than ``query_slice`` queries visit is copied.

    Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of
    different lengths have no inner product: each length is searched by itself. Equal vectors are one
    entry with their k + 1 smallest ids, which is all that an answer can hold, so a very common vector
    weighs no more than another. Repeated equal rows count once; an id with several vectors asks once
    with each, and a query's own id is no candidate. Ties go to the smaller id. A table with fewer
    than two vectors gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec")).filter(
        "vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vec, x -> x != 0)"
    )
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in base.groupBy(F.size("vec").alias("dim")).count().orderBy("dim").collect():
        out = out.unionAll(_nearest(base.filter(F.size("vec") == r["dim"]), k, is_query, trees, leaf, sample, target, group_rows, query_slice, seed))
    return out


def _nearest(base: DataFrame, k: int, is_query: str, trees: int, leaf: int, sample: int, target: float, group_rows: int, query_slice: int, seed: int) -> DataFrame:
    """``nearest`` over (vec_id, vec) of one length."""
    spark = base.sparkSession
    base = base.dropDuplicates(["vec_id", "vec"]).withColumn("h", F.xxhash64("vec"))
    few = base.withColumn("_r", F.row_number().over(Window.partitionBy("h", "vec").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    entries = written(few.groupBy("h", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "ids", "vec"), "ann-entries")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, top = entries.agg(F.count(F.lit(1)), F.max(norm2)).first()
    fitted = entries.orderBy(F.xxhash64("rep", "vec"), "rep").limit(sample).select("rep", "vec").toPandas()

    points = augment(np.stack(fitted["vec"].to_numpy()).astype(np.float32), top)
    rng = np.random.default_rng(seed)
    forest = [build_tree(points, max(8, round(leaf * len(points) / n)), rng) for _ in range(trees)]
    share = calibrate(forest, points, k, target, 150, rng)
    sizes = [np.bincount(assign(t, points), minlength=t.leaves) * (n / len(points)) for t in forest]
    budget = share * n
    first_leaf = np.cumsum([0] + [t.leaves for t in forest])
    group, parts = pack(np.concatenate(sizes), group_rows)
    shared = spark.sparkContext.broadcast((forest, sizes, first_leaf, group))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, _, first, group = shared.value
        for f in frames:
            if not len(f):
                continue
            x = augment(np.stack(f["vec"].to_numpy()), top).astype(np.float32)
            for t, tree in enumerate(forest):
                leaves = assign(tree, x) + first[t]
                yield f.assign(leaf=leaves.astype("int64"), g=group[leaves])[["g", "leaf", "rep", "ids", "vec"]]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, sizes, first, group = shared.value
        for f in frames:
            out = []
            for qid, h, vec in zip(f["query_id"], f["h"], f["vec"], strict=True):
                q = np.append(np.asarray(vec, dtype=np.float32), np.float32(0))
                by: dict[int, list[int]] = {}
                seen = 0.0
                for t, leaf_no in visit(forest, margins_of(forest, q)):
                    x = int(first[t] + leaf_no)
                    by.setdefault(int(group[x]), []).append(x)
                    seen += sizes[t][leaf_no]
                    if seen >= budget:
                        break
                out += [(g, qid, h, vec, xs) for g, xs in by.items()]
            yield pd.DataFrame(out, columns=["g", "query_id", "h", "vec", "leaves"])

    def rerank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["query_id", "h", "hits"], dtype=object)
        left = left.sort_values("leaf", kind="stable")
        v, q = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        reps, ids = left["rep"].to_numpy(), left["ids"].to_numpy()
        single, entry = np.array([len(i) == 1 for i in ids]), np.array([hash(x.tobytes()) for x in v])  # an entry comes once a tree
        leaf_no, starts = np.unique(left["leaf"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(left))
        asking: dict[int, list[int]] = {}
        for i, leaves in enumerate(right["leaves"]):
            for x in leaves:
                asking.setdefault(int(x), []).append(i)
        scores: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        places: list[list[tuple[int, int]]] = [[] for _ in range(len(q))]
        for x, lo, hi in zip(leaf_no.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if who := asking.get(x):
                for i, row in zip(who, q[who] @ v[lo:hi].T, strict=True):
                    scores[i].append(row)
                    places[i].append((lo, hi))
        out = []
        most = (trees + 1) * (k + 1)
        for i, (qid, h) in enumerate(zip(right["query_id"], right["h"], strict=True)):
            if not scores[i]:
                continue
            score = np.concatenate(scores[i])
            rows = np.concatenate([np.arange(lo, hi) for lo, hi in places[i]])
            score[(reps[rows] == qid) & single[rows]] = -np.inf
            if len(rows) > most:
                part = np.argpartition(-score, most)[:most]
                score, rows = score[part], rows[part]
            score, rows = score[score > -np.inf], rows[score > -np.inf]
            _, once = np.unique(entry[rows], return_index=True)
            score, rows = score[once], rows[once]
            if len(rows) > k + 1:  # a margin over rounding in the product above
                rows = rows[score >= np.partition(score, -(k + 1))[-(k + 1)] - 1e-9]
            score = np.array([math.fsum(p) for p in (v[rows] * q[i]).tolist()])  # exactly rounded: equal products tie
            best = np.lexsort((reps[rows], -score))[: k + 1]
            out.append((qid, h, [{"d": -float(score[b]), "rep": int(reps[rows[b]]), "ids": [int(j) for j in ids[rows[b]]]} for b in best]))
        return pd.DataFrame(out, columns=["query_id", "h", "hits"], dtype=None if out else object)

    hit = "array<struct<d:double,rep:long,ids:array<long>>>"
    asked = base.filter(is_query).select(F.col("vec_id").alias("query_id"), "h", "vec").repartition(spark.sparkContext.defaultParallelism)
    right = written(asked.mapInPandas(search, "g long, query_id long, h long, vec array<double>, leaves array<long>"), "ann-asked")
    # one row a group: as many as leaves at most, which the sample bounds
    dealt = spark.createDataFrame([(g, int(p)) for g, p in enumerate(parts)], "g long, parts int")
    dealt = F.broadcast(right.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / query_slice).cast("int").alias("slices")).join(dealt, "g"))
    left = entries.mapInPandas(index, "g long, leaf long, rep long, ids array<long>, vec array<double>").join(dealt, "g")
    left = left.withColumn("p", F.pmod(F.xxhash64("rep", "vec"), F.col("parts")).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("parts", "slices")
    right = right.join(dealt, "g").withColumn("s", F.pmod(F.xxhash64("query_id", "h"), F.col("slices")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "slices")
    found = left.groupBy("g", "p", "s").cogroup(right.groupBy("g", "p", "s")).applyInPandas(rerank, f"query_id long, h long, hits {hit}")
    best = found.groupBy("query_id", "h").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, k + 1).alias("hits"))
    one = best.select("query_id", "h", F.explode("hits").alias("x")).select("query_id", "h", (-F.col("x.d")).alias("score"), F.explode("x.ids").alias("vec_id")).filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def augment(x: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that the largest inner product is the smallest distance."""
    rest = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))))
    return np.concatenate([x, rest[:, None].astype(x.dtype)], axis=1)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vec_id divisible by 20 against all other vectors of embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"))
