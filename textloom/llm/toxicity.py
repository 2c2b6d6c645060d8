"""Toxicity by the nearest labelled examples under TF-IDF cosine, with block-max inverted indexes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import table, written

_TOKEN = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """A whole text's lower-case words."""
    return _TOKEN.findall((text or "").lower())


def _slices(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all given ranges, one after the other."""
    n = stop - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(int(n.sum()))


class ExampleIndex:
    """Exact top-k cosine over sparse vectors, by inverted lists in blocks of examples with each term's largest weight in a block.

    A block's bound for a query is the sum over the query's terms of query weight times that largest
    weight. The blocks of highest bound are scored first; of the others only those are scored whose
    bound reaches the k-th best cosine found, by their own rows, or by the query's inverted lists if
    those are shorter. Ties go to the example that was given first.
    """

    def __init__(self, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 16):
        # alike vectors side by side make tight bounds: by their heaviest terms
        order = sorted(range(len(vectors)), key=lambda i: vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist())
        self.given, self.labels, self.block = np.array(order, dtype=np.int64), labels[order].astype(float), block
        sizes = np.array([len(vectors[i][0]) for i in order], dtype=np.int64)
        self.row = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.term = np.concatenate([vectors[i][0] for i in order] or [[]]).astype(np.int32)
        self.weight = np.concatenate([vectors[i][1] for i in order] or [[]]).astype(float)
        owner = np.repeat(np.arange(len(order)), sizes)
        by = np.lexsort((owner, self.term))
        self.list_at = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=terms))]).astype(np.int64)
        self.list_owner, self.list_weight = owner[by].astype(np.int32), self.weight[by]
        self.blocks = -(-len(order) // block)
        key = self.term[by].astype(np.int64) * max(1, self.blocks) + self.list_owner // block
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
        self.most = np.maximum.reduceat(self.list_weight, head) if len(head) else np.empty(0)
        self.most_block = (key[head] % max(1, self.blocks)).astype(np.int32)
        self.most_at = np.concatenate([[0], np.cumsum(np.bincount(self.term[by][head], minlength=terms))]).astype(np.int64)
        self.terms = terms

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "dense"}

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None, lead: int = 1) -> list[tuple[float, int, float]]:
        """The k best (cosine, number of the example, label), but for example ``skip``; examples without a common term do not count."""
        start, stop = self.most_at[terms], self.most_at[terms + 1]
        at = _slices(start, stop)
        bound = np.bincount(self.most_block[at], weights=self.most[at] * np.repeat(weights, stop - start), minlength=self.blocks)
        score = np.zeros(len(self.given))
        first = np.argsort(-bound, kind="stable")[:lead]
        if not hasattr(self, "dense"):
            self.dense = np.zeros(self.terms)
        self.dense[terms] = weights

        def rows(blocks: np.ndarray) -> None:
            for b in blocks.tolist():
                lo, hi = b * self.block, min((b + 1) * self.block, len(self.given))
                x, y = self.row[lo], self.row[hi]
                score[lo:hi] = np.add.reduceat(self.dense[self.term[x:y]] * self.weight[x:y], self.row[lo:hi] - x)

        rows(first)
        mine = np.flatnonzero(self.given == skip) if skip is not None else np.empty(0, dtype=np.int64)
        score[mine] = 0
        floor = np.partition(score, -k)[-k] if len(score) > k else 0.0
        bound[first] = -1
        live = np.flatnonzero((bound > 0) & (bound >= floor - 1e-12))
        if len(live):
            start, stop = self.list_at[terms], self.list_at[terms + 1]
            if int((stop - start).sum()) < 2 * int((self.row[np.minimum((live + 1) * self.block, len(self.given))] - self.row[live * self.block]).sum()):
                at = _slices(start, stop)
                score = np.bincount(self.list_owner[at], weights=self.list_weight[at] * np.repeat(weights, stop - start), minlength=len(self.given))
            else:
                rows(live)
            score[mine] = 0
        self.dense[terms] = 0
        floor = np.partition(score, -k)[-k] if len(score) > k else 0.0
        hits = np.flatnonzero(score >= max(floor - 1e-12, 1e-12))
        best = sorted(((float(score[h]), int(self.given[h]), float(self.labels[h])) for h in hits), key=lambda x: (-round(x[0], 12), x[1]))
        return best[:k]


def favour(n0: np.ndarray, n1: np.ndarray, total0: int, total1: int, gain: float) -> np.ndarray:
    """1 to 1 + ``gain`` for each term: more, the surer (chi-squared, full from 30) and stronger (odds ratio, full from 6) a label goes with it.

    n0 and n1 are the examples of either label that hold the term. A term of one example gets 1.
    """
    absent0, absent1 = total0 - n0, total1 - n1
    chi2 = (total0 + total1) * (n0 * absent1 - n1 * absent0) ** 2 / np.maximum(1e-9, float(total0) * total1 * (n0 + n1) * (absent0 + absent1))
    odds = np.abs(np.log((n1 + 0.5) * (absent0 + 0.5) / ((n0 + 0.5) * (absent1 + 0.5))))
    return 1 + gain * np.minimum(1, chi2 / 30) * np.minimum(1, odds / math.log(6)) * (n0 + n1 >= 2)


def vector(t: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit TF-IDF vector: (1 + ln tf) times the term's weight."""
    w = (1 + np.log(tf)) * weight[t]
    length = math.sqrt(float((w * w).sum()))
    return t, w / length if length > 0 else w


def vote(near: list[tuple[float, int, float]], prior: float, strength: float = 0.5) -> float:
    """The share of label 1 among the neighbours, each weighted by its squared cosine, drawn to the prior."""
    w = [c * c for c, _, _ in near]
    return (sum(x * y for x, (_, _, y) in zip(w, near, strict=True)) + strength * prior) / (sum(w) + strength)


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the label on the vote's log odds, by Newton's method."""
    z = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / (1 - np.clip(raw, 1e-4, 1 - 1e-4)))
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - goal) * z).sum() + 1e-2 * (a - 1), (p - goal).sum() + 1e-2 * b
        haa, hab, hbb = (w * z * z).sum() + 1e-2, (w * z).sum(), w.sum() + 1e-2
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return (a, b) if a > 0 and math.isfinite(a) and math.isfinite(b) else (1.0, 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = 3_000, gain: float = 5.0, k: int = 15, evidence: int = 15, holdout: tuple[int, int] = (5, 0)) -> DataFrame:
    """Per row: doc_id, score (0 to 1), neighbours (cosine, doc_id, label of the ``evidence`` nearest examples).

    Examples are at most ``sample`` labelled documents outside the held-out part, those of
    smallest id hash; of an id with several texts, the one of smallest text hash. Terms are all
    words of the examples' whole texts. A term's weight is its IDF, from document frequencies over
    all documents, times 1 to 1 + ``gain`` by how far it goes with a label, see ``favour``; no term
    is left out. A row's score is the vote of its k nearest examples by exact cosine, calibrated on
    all examples' own leave-one-out votes; a row without any term gets the smoothed rate among the
    examples without any.

    Null and empty texts have no terms. Repeated rows are scored each; a row with a null id is never
    an example. With no examples every score is 0.5 at most. To the driver come the examples' term
    counts and the counts of their terms, bounded by the words of ``sample`` texts. Other columns are not read.
    """
    spark = docs.sparkSession
    parts, part = holdout
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    small = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxic-labels")
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: dict[str, list[int]] = {}
            for text, y in zip(f["text"], f["y"], strict=True):
                for w in set(words_of(text)):
                    seen.setdefault(w, [0, 0])[y] += 1
            terms, both = list(seen), list(seen.values())
            yield pd.DataFrame({"term": terms, "n0": [v[0] for v in both], "n1": [v[1] for v in both]})

    chosen = rows.join(F.broadcast(small), "doc_id").withColumn("h", F.xxhash64("text"))
    chosen = chosen.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))).filter("at = 1").select("doc_id", "y", "text", "h")
    chosen = written(chosen, "toxic-examples")
    counted = chosen.select("text", "y").mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1")).toPandas().sort_values("term")
    total = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    number = {t: i for i, t in enumerate(counted["term"].tolist())}
    numbers = spark.sparkContext.broadcast(number)

    def sparse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = numbers.value.get
        for f in frames:
            for at in range(0, len(f), 500):
                part = f.iloc[at : at + 500]
                out = [np.unique(np.array([i for w in words_of(text) if (i := find(w)) is not None], dtype=np.int32), return_counts=True) for text in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "h": part["h"].array, "t": [t for t, _ in out], "tf": [c.astype(np.int32) for _, c in out]})

    narrow = written(rows.withColumn("h", F.xxhash64("text")).mapInPandas(sparse, f"doc_id {id_type}, h long, t array<int>, tf array<int>"), "toxic-terms")
    df = np.zeros(len(number))
    for r in narrow.select(F.explode("t").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = (np.log((1 + narrow.count()) / (1 + df)) + 1) * favour(counted["n0"].to_numpy(), counted["n1"].to_numpy(), total.get(0, 0), total.get(1, 0), gain)
    mine = narrow.join(F.broadcast(chosen.select("doc_id", "h", "y")), ["doc_id", "h"]).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    ids, y = mine["doc_id"].tolist(), mine["y"].to_numpy(dtype=float)
    made = lambda t, tf: vector(np.asarray(t, dtype=np.int64), np.asarray(tf, dtype=np.int64), weight)
    vectors = [made(t, tf) for t, tf in zip(mine["t"], mine["tf"], strict=True)]
    full = np.flatnonzero([len(t) > 0 for t, _ in vectors])
    prior = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    empty = np.setdiff1d(np.arange(len(y)), full)
    bare = float((y[empty].sum() + 0.5 * prior) / (len(empty) + 0.5)) if len(empty) else prior
    index = ExampleIndex(y[full], [vectors[i] for i in full], len(number))
    own = np.array([vote(index.top(*vectors[i], k, skip=n), prior) for n, i in enumerate(full)])
    slope, shift = platt(own, y[full]) if 0 < y[full].sum() < len(full) else (1.0, 0.0)
    shared = spark.sparkContext.broadcast((index, [ids[i] for i in full], weight))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, ids, weight = shared.value
        for f in frames:
            scores, found = [], []
            for t, tf in zip(f["t"], f["tf"], strict=True):
                near = index.top(*vector(np.asarray(t, dtype=np.int64), np.asarray(tf, dtype=np.int64), weight), k) if len(t) else []
                scores.append(calibrated(vote(near, prior), slope, shift) if near else bare)
                found.append([{"cosine": c, "doc_id": ids[i], "label": int(label)} for c, i, label in near[:evidence]])
            yield pd.DataFrame({"doc_id": f["doc_id"].array, "score": scores, "neighbours": found})

    return narrow.mapInPandas(search, f"doc_id {id_type}, score double, neighbours array<struct<cosine:double,doc_id:{id_type},label:int>>")


def calibrated(raw: float, slope: float, shift: float) -> float:
    raw = min(max(raw, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * math.log(raw / (1 - raw)) + shift))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with held_out, score, predicted and its three nearest examples."""
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), evidence=3)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("neighbours").alias("evidence"))
