"""BM25: index statistics and batch search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import scoring as S
from textloom.functions import text as T


def check_parameters(k1: float, b: float) -> None:
    if k1 <= 0:
        raise ValueError("k1 must be positive")
    if not 0 <= b <= 1:
        raise ValueError("b must lie between 0 and 1")


@dataclass
class LexicalIndex:
    """postings(term, id, tf, len), term_stats(term, df, idf) and corpus_stats(n, avg_len)."""

    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame

    @classmethod
    def of(cls, corpus: DataFrame) -> LexicalIndex:
        """From (id, text). Empty documents count in n and in the mean length.

        One pass tokenises and counts within a document as an array, so the only shuffle is that
        of the document frequencies, pre-aggregated by term.
        """
        docs = corpus.select("id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
        stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
        flat = docs.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
        postings = flat.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return cls(postings, terms, stats)

    def write(self, path: str) -> None:
        """Postings ranged by term and id: files hold term ranges, and a term of very many documents has several files."""
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        stored = spark.read.parquet(f"{path}/postings")
        stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/term_stats")
        self.corpus_stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_stats", "corpus_stats")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qn): a term repeated in a query counts as often."""
    return queries.select("query_id", F.explode(T.tokens("question")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))


def bm25_scores(corpus: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, small_batch: int = 200_000) -> DataFrame:
    """(query_id, id, score) of every matching pair; the idf is that of the whole corpus.

    Only the postings of asked terms are kept: the set of distinct query terms filters the
    exploded tokens before anything is shuffled. A batch of up to ``small_batch`` query terms is
    counted and then broadcast; a larger one is joined by shuffles.
    """
    check_parameters(k1, b)
    asked = query_terms(queries)
    small = asked.limit(small_batch + 1).count() <= small_batch
    docs = corpus.select("id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    flat = docs.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    terms = asked.select("term").distinct()
    postings = flat.join(F.broadcast(terms) if small else terms, "term", "left_semi").groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _score(postings, df, stats, asked, k1, b, small)


def search_index(index: LexicalIndex, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, small_batch: int = 200_000) -> DataFrame:
    """(query_id, id, score) as by ``bm25_scores``, off a stored index: no text is tokenised again.

    A batch of up to ``small_batch`` query terms is counted and then broadcast to the postings; a larger
    one is joined by shuffles. Up to 10 different terms also filter the scan by their names.
    """
    check_parameters(k1, b)
    asked = query_terms(queries)
    small = asked.limit(small_batch + 1).count() <= small_batch
    few = [r["term"] for r in asked.select("term").distinct().limit(11).collect()]
    postings = index.postings.filter(F.col("term").isin(few)) if len(few) <= 10 else index.postings
    return _score(postings, index.term_stats, index.corpus_stats, asked, k1, b, small)


def _score(postings: DataFrame, df: DataFrame, stats: DataFrame, asked: DataFrame, k1: float, b: float, small: bool = False) -> DataFrame:
    known = df.join(F.broadcast(asked) if small else asked, "term")
    weights = known.join(F.broadcast(stats)).select("query_id", "term", "avg_len", (F.col("qn") * S.idf(F.col("n"), F.col("df"))).alias("w"))  # stats has one row
    hits = postings.join(F.broadcast(weights) if small else weights, "term")
    part = F.col("w") * S.saturation(F.col("tf"), F.col("len"), F.col("avg_len"), k1, b)
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, *, tie: str = "string", digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank): score descending, ties (equal to ``digits``) by id, as strings or as they are."""
    by = F.col("id").cast("string") if tie == "string" else F.col("id")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), by)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_one(corpus: DataFrame, question: str, k: int = 5, **parameters: float) -> DataFrame:
    """One question: the plan ends in a take-ordered of k rows, with the text joined after the cut."""
    spark = corpus.sparkSession
    scores = bm25_scores(corpus, spark.createDataFrame([(0, question)], "query_id long, question string"), **parameters)
    best = scores.orderBy(F.desc(F.round("score", 9)), F.col("id").cast("string")).limit(k).select("id", "score")
    return best.join(corpus, "id").select("id", "score", "text")
