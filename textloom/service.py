"""Batch answering and the functions behind an HTTP surface."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import qa
from textloom.operators.ranking import MODES, Retriever


class NotFound(KeyError):
    """HTTP 404."""


class BadRequest(ValueError):
    """HTTP 400 or 422."""


@dataclass(frozen=True)
class Ask:
    """A validated request: a question of 3 to 500 characters and a retrieval mode."""

    question: str
    mode: str = "hybrid"
    top_k: int = 5
    adapted: bool = False

    def __post_init__(self) -> None:
        if not 3 <= len(self.question.strip()) <= 500:
            raise BadRequest("a question has 3 to 500 characters")
        if self.mode not in (*MODES, "no_retrieval"):
            raise BadRequest(f"unknown mode {self.mode!r}")


def public_chunk(chunk: DataFrame, chars: int = 800) -> DataFrame:
    return chunk.withColumn("text", T.snippet(F.col("text"), chars))


def result_lines(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, line): rank, title, year, family, score to 4 digits and 200 characters of text."""
    title, year, family = F.coalesce("title", F.lit("Unknown title")), F.coalesce(F.col("year").cast("string"), F.lit("-")), F.coalesce("family", F.lit("-"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), title, F.lit(" ("), year, F.lit(", "), family, F.lit(") "), F.format_string("%.4f", "score"), F.lit(" | "), T.snippet(F.col("text"), 200))
    return ranked.select("query_id", "rank", line.alias("line"))


def cited_passages(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, number, id, snippet) of each valid citation, 200 characters each."""
    cited = answers.select("query_id", F.posexplode("cited_ids").alias("number", "id"))
    return cited.join(corpus.select(F.col("id").cast("string").alias("id"), "text"), "id").select("query_id", (F.col("number") + 1).alias("number"), "id", T.snippet(F.col("text"), 200).alias("snippet"))


class Answerer:
    """Retrieve, prompt, generate and resolve citations for a batch of questions."""

    def __init__(self, retriever: Retriever, generate: Callable[[list[list[dict]]], list[str]], system: str, baseline: str):
        self.retriever, self.generate, self.system, self.baseline = retriever, generate, system, baseline

    def answer(self, queries: DataFrame, mode: str = "hybrid", k: int = 5) -> DataFrame:
        """query_id, question, answer, abstained, cited_ids, invalid_citations, context (ids), messages."""
        none = F.array().cast("array<struct<rank:int,id:string,title:string,year:int,text:string>>")
        if mode == "no_retrieval":
            with_context = queries.withColumn("passages", none)
        else:
            hits = self.retriever.search(queries, mode, k)
            corpus = self.retriever.corpus
            have = set(corpus.columns)
            extra = [F.col("title") if "title" in have else F.lit(None).cast("string").alias("title"), F.col("year") if "year" in have else F.lit(None).cast("int").alias("year")]
            texts = hits.join(corpus.select("id", "text", *extra), "id")
            lists = texts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id"), "title", "year", "text"))).alias("passages"))
            with_context = queries.join(lists, "query_id", "left").withColumn("passages", F.coalesce("passages", none))
        use = mode != "no_retrieval"
        asked = with_context.withColumn("messages", qa.prompt(F.col("question"), F.col("passages"), self.system if use else self.baseline, use_context=use))
        generate = self.generate

        @F.pandas_udf("string")
        def run(messages: pd.Series) -> pd.Series:
            return pd.Series(generate([list(m) for m in messages]))

        answered = asked.withColumn("answer", run("messages")).withColumn("context", F.transform("passages", lambda p: p["id"]))
        return qa.resolve_citations(answered).select("query_id", "question", "answer", "abstained", "cited_ids", "invalid_citations", "context", "messages")


class Service:
    """health, source and ask, as plain functions for any web layer."""

    def __init__(self, answerer: Answerer, adapted: Answerer | None = None):
        self.answerer, self.adapted = answerer, adapted

    def health(self) -> dict:
        return {"status": "ok", "dense": self.answerer.retriever.index is not None, "adapted": self.adapted is not None}

    def source(self, chunk_id: str, chars: int = 10_000) -> dict:
        rows = public_chunk(self.answerer.retriever.corpus.filter(F.col("id") == chunk_id), chars).limit(1).collect()
        if not rows:
            raise NotFound(chunk_id)
        return rows[0].asDict(recursive=True)

    def ask(self, request: Ask) -> dict:
        if request.adapted and self.adapted is None:
            raise BadRequest("no adapter is loaded")
        began = time.perf_counter()
        corpus = self.answerer.retriever.corpus
        queries = corpus.sparkSession.createDataFrame([(0, request.question.strip())], "query_id long, question string")
        row = (self.adapted if request.adapted else self.answerer).answer(queries, request.mode, request.top_k).first()
        return row.asDict(recursive=True) | {"mode": request.mode, "latency_ms": {"total": (time.perf_counter() - began) * 1000}}
