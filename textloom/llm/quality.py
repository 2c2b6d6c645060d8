"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import free, table

#: Deletion tables for counting bytes of a class in UTF-8 text.
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_NOT_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
_NOT_MARK = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace() or chr(b) in ".,;:'\"?-()")
_NOT_STOP = bytes(b for b in range(256) if chr(b) not in ".?!")

STATS = ["log_chars", "words", "word_len", "distinct_words", "repeat_next", "upper", "digits", "letters", "marks", "mark_words", "stops", "lines", "distinct_lines", "line_words", "short_words", "top_word", "tags"]

_TAG = re.compile(r"<[a-zA-Z/][^<>]{0,200}>|[{};]\s*\n")


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of STATS; all 0 for a null or empty one."""
    if not text:
        return (0.0,) * len(STATS)
    raw = text.encode("utf-8", "replace")
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    size = len(raw)
    letters = len(raw.translate(None, _NOT_LETTER))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return (
        math.log1p(len(text)),
        math.log1p(len(words)),
        (len(text) - n + 1) / n,
        len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(raw.translate(None, _NOT_UPPER)) / max(1, letters),
        len(raw.translate(None, _NOT_DIGIT)) / size,
        letters / size,
        len(raw.translate(None, _NOT_MARK)) / size,
        sum(c for w, c in counts.items() if not w.isalnum() and not any(ch.isalnum() for ch in w)) / n,
        len(raw.translate(None, _NOT_STOP)) / n,
        math.log1p(len(lines)),
        len(set(lines)) / m,
        math.log1p(n / m),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        max(counts.values(), default=0) / n,
        len(_TAG.findall(text)) / n if "<" in text or "{" in text or ";" in text else 0.0,
    )


def stats_column(text: Column) -> Column:
    """A struct of STATS, from an Arrow-batched function over whole texts."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([statistics(t) for t in texts], columns=STATS)

    return run(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: low <= statistic < high."""

    bounds: tuple[tuple[int, float, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, low, high in self.bounds:
            out &= (x[:, f] >= low) & (x[:, f] < high)
        return out

    def column(self, stats: Column) -> Column:
        out = None
        for f, low, high in self.bounds:
            for part in ([stats[STATS[f]] >= low] if low > -math.inf else []) + ([stats[STATS[f]] < high] if high < math.inf else []):
                out = part if out is None else out & part
        return F.lit(True) if out is None else out

    def __str__(self) -> str:
        return " and ".join(f"{low:.4g} <= {STATS[f]} < {high:.4g}" for f, low, high in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.of(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The score as a column expression over a struct of STATS."""
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(stats), F.lit(w)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def _grow(x: np.ndarray, codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on quantile codes: the rules of all its nodes but the root, and its values."""
    rules: list[Rule] = []
    value = np.zeros(len(x))
    todo: list[tuple[np.ndarray, dict[int, tuple[float, float]], int]] = [(np.arange(len(x)), {}, 0)]
    while todo:
        rows, bounds, level = todo.pop()
        g, h = grad[rows], hess[rows]
        value[rows] = g.sum() / (h.sum() + 1.0)
        if bounds:
            rules.append(Rule(tuple(sorted((f, lo, hi) for f, (lo, hi) in bounds.items()))))
        if level == depth or len(rows) < 2 * least:
            continue
        best = (1e-6, -1, 0)
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            k = len(e) + 1
            c = codes[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, minlength=k))[:-1] for w in (g, h, np.ones(len(rows))))
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), f, i)
        _, f, i = best
        if f < 0:
            continue
        cut = float(edges[f][i])
        left = codes[rows, f] <= i
        lo, hi = bounds.get(f, (-math.inf, math.inf))
        todo += [(rows[left], bounds | {f: (lo, cut)}, level + 1), (rows[~left], bounds | {f: (cut, hi)}, level + 1)]
    return rules, value


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, bins: int = 48, rate: float = 0.4, least: int = 4, penalty: float = 2e-4, steps: int = 600) -> RuleModel:
    """Boost small trees on the logistic loss, take their node paths as rules, and weight the rules by the lasso.

    With no rows or one class only the model is the smoothed rate of label 1.
    """
    n = len(y)
    rate1 = (float(y.sum()) + 0.5) / (n + 1)
    bias = math.log(rate1 / (1 - rate1))
    if n == 0 or y.min() == y.max():
        return RuleModel((), (), bias)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="midpoint")) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    z = np.full(n, bias)
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rules, value = _grow(x, codes, edges, y - p, p * (1 - p), depth, least)
        found |= dict.fromkeys(rules)
        z += rate * value
    # rules that hold for the same rows are one
    once: dict[bytes, Rule] = {}
    for r in found:
        once.setdefault(np.packbits(r.of(x)).tobytes(), r)
    rules = list(once.values())
    a = np.stack([r.of(x) for r in rules], axis=1).astype(np.float64)
    mean = a.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    a = (a - mean) / scale
    # accelerated proximal gradient for mean logistic loss + penalty * |w|
    w = np.zeros(a.shape[1])
    v, b, bv, t = w.copy(), bias, bias, 1.0
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / n + 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ v + bv)))
        gw, gb = a.T @ (p - y) / n, float((p - y).mean())
        new = v - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = bv - step * gb
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, bv = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    live = np.flatnonzero(np.abs(w) > 1e-9)
    weights = w[live] / scale[live]
    return RuleModel(tuple(rules[i] for i in live), tuple(float(q) for q in weights), float(b - (weights * mean[live]).sum()))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 20_000) -> RuleModel:
    """Fit on at most ``sample`` labelled documents, those of smallest id hash outside the held-out third.

    Of an id with several texts the one of smallest text hash is learnt from. The bound makes what
    comes to the driver, and what is broadcast, at most ``sample`` rows.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(known), "doc_id")
    one = rows.select("doc_id", "_y", F.xxhash64("_text").alias("h"), stats_column(F.col("_text")).alias("s")).groupBy("doc_id", "_y").agg(F.min(F.struct("h", "s")).alias("x"))
    got = one.select("doc_id", "_y", "x.s.*").toPandas().sort_values("doc_id")
    return fit(got[STATS].to_numpy(dtype=float).reshape(-1, len(STATS)), got["_y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: RuleModel, out: str = "_score") -> DataFrame:
    """``docs`` with ``out``, 0 to 1; every row stays, with all its columns. A null text scores as an empty one."""
    stats = free([*docs.columns, out], "_stats")
    with_stats = docs.withColumn(stats, stats_column(F.col("text")))
    return with_stats.withColumn(out, model.column(F.col(stats))).drop(stats)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with held_out, score and predicted. Repeated rows are scored each; a null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
