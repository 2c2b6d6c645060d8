"""Fusion, reranking and the retrieval plan over its four modes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import dense, lexical

MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")


def fuse(*lists: DataFrame, k: int = 60, top: int = 20, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists: score = sum of weight / (k + rank).

    In each list blank ids and repeats are skipped, and ranks advance on accepted ids only. Ties
    go to the smaller id, as strings. All weights are 1 unless given.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    parts = None
    for n, ranked in enumerate(lists):
        kept = ranked.filter(F.col("id").isNotNull() & (F.trim(F.col("id").cast("string")) != "")).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        weight = 1.0 if weights is None else float(weights[n])
        part = kept.select("query_id", "id", (F.lit(weight) / (k + place)).alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    return lexical.top_k(parts.groupBy("query_id", "id").agg(F.sum("score").alias("score")), top, digits=12)


def rerank(candidates: DataFrame, score: Column | Callable[[list[tuple[str, str]]], list[float]], k: int = 5, batch: int = 16) -> DataFrame:
    """Re-score (query_id, id, rank, question, text); ties keep the candidates' order.

    ``score`` is a column expression or a model's function over (question, text) pairs, which
    runs on Arrow batches.
    """
    if isinstance(score, Column):
        scored = candidates.withColumn("score", score)
    else:

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in batches:
                pairs = list(zip(q, t, strict=True))
                yield pd.Series([float(x) for at in range(0, len(pairs), batch) for x in score(pairs[at : at + batch])])

        scored = candidates.withColumn("score", run("question", "text"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.col("rank"))
    return scored.withColumn("_new", F.row_number().over(w)).filter(F.col("_new") <= k).drop("rank").withColumnRenamed("_new", "rank")


@dataclass
class Retriever:
    """A plan builder: ``search`` returns the ranked chunks of a batch of queries as one DataFrame.

    corpus: (id, text, ...); index: (id, pos, embedding) for the dense modes; scorer for reranking.
    With lexical_index, built once and stored, the lexical part reads its postings instead of all texts.
    """

    corpus: DataFrame
    index: DataFrame | None = None
    scorer: Column | Callable | None = None
    candidate_k: int = 50
    fused_k: int = 20
    rrf_k: int = 60
    weights: list[float] | None = None
    bm25: dict[str, float] = field(default_factory=dict)
    lexical_index: lexical.LexicalIndex | None = None

    def search(self, queries: DataFrame, mode: str, k: int = 5) -> DataFrame:
        """queries: (query_id, question) and, for the dense modes, embedding. Fused modes never return more than fused_k rows."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
        if mode != "bm25" and self.index is None:
            raise FileNotFoundError("no dense index was given")
        if mode == "bm25":
            return self._lexical(queries, k)
        if mode == "dense":
            return dense.search(self.index, queries, k)
        fused = fuse(self._lexical(queries, self.candidate_k), dense.search(self.index, queries, self.candidate_k), k=self.rrf_k, top=self.fused_k, weights=self.weights)
        if mode == "hybrid":
            return fused.filter(F.col("rank") <= k)
        if self.scorer is None:
            raise ValueError("hybrid_rerank needs a scorer")
        texts = fused.join(self.corpus.select("id", "text"), "id").join(queries.select("query_id", "question"), "query_id")
        return rerank(texts, self.scorer, k).select("query_id", "id", "score", "rank")

    def _lexical(self, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.select("query_id", "question")
        if self.lexical_index is None:
            return lexical.top_k(lexical.bm25_scores(self.corpus, asked, **self.bm25), k)
        return lexical.top_k(lexical.search_index(self.lexical_index, asked, **self.bm25), k)


def hard_negatives(ranked: DataFrame, gold: DataFrame, allowed: DataFrame, excluded: DataFrame, n: int) -> DataFrame:
    """The first n ids a query of a ranked list that are allowed, neither gold nor excluded: (query_id, id, rank, place)."""
    kept = ranked.join(allowed.select("id"), "id", "left_semi").join(excluded.select("id"), "id", "left_anti").join(gold.select("query_id", "id"), ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("place", place).filter(F.col("place") <= n).select("query_id", "id", "rank", "place")


def phrase_absent(ranked: DataFrame, corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, absent): is a question's key phrase in none of its ranked chunks, ignoring case?"""
    seen = ranked.join(corpus.select("id", "text"), "id").join(questions.select("query_id", "phrase"), "query_id")
    hit = seen.groupBy("query_id").agg(F.max(F.contains(F.lower("text"), F.lower("phrase"))).alias("hit"))
    return questions.select("query_id").join(hit, "query_id", "left").select("query_id", (~F.coalesce("hit", F.lit(False))).alias("absent"))
