"""Exact cosine search over stored vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import scoring as S

#: Fixed value: what an encoder of queries puts before the question.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def build(corpus: DataFrame, encode: Callable[[list[str]], np.ndarray], *, batch: int = 32) -> DataFrame:
    """(id, pos, embedding) of (id, text): ``encode`` runs on Arrow batches; an encoder that returns another number of vectors fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                vectors = np.asarray(encode(part["text"].fillna("").tolist()), dtype=np.float32)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                yield pd.DataFrame({"id": part["id"].array, "pos": part["pos"].array, "embedding": list(vectors)})

    with_pos = corpus if "pos" in corpus.columns else corpus.withColumn("pos", F.col("id").cast("long"))
    kind = with_pos.schema["id"].dataType.simpleString()
    raw = with_pos.select("id", "pos", "text").mapInPandas(run, f"id {kind}, pos long, embedding array<float>")
    return raw.withColumn("embedding", F.transform(S.normalise(F.col("embedding")), lambda x: x.cast("float")))


def encode_queries(queries: DataFrame, encode: Callable[[list[str]], np.ndarray], prefix: str = QUERY_PREFIX) -> DataFrame:
    """(query_id, embedding) of (query_id, question), each question behind the instruction."""
    asked = queries.select(F.col("query_id").alias("id"), F.col("query_id").cast("long").alias("pos"), F.concat(F.lit(prefix), "question").alias("text"))
    return build(asked, encode).select(F.col("id").alias("query_id"), "embedding")


def read_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """A stored index; with ``model``, an error if another model made its vectors."""
    if model is not None:
        made_by = spark.read.parquet(path.rstrip("/") + ".meta").first()["model"]
        if made_by != model:
            raise ValueError(f"the index was made by {made_by!r}, not {model!r}")
    return spark.read.parquet(path)


def search(index: DataFrame, queries: DataFrame, k: int = 5, *, block: int = 20_000, query_block: int = 2_000) -> DataFrame:
    """(query_id, id, score, rank) of the k largest cosines: ties (to 9 digits) by index position.

    Vectors of (id, pos, embedding) and queries of (query_id, embedding) are normalised and
    met in blocks: one matrix product a pair of blocks, which returns k rows a query, so memory is
    bounded by the block sizes and rows by queries times blocks. Vectors or queries that are null
    are left out; those of another length than the query never match.
    """
    n, m = index.count(), queries.count()
    blocks, slices = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    kind = index.schema["id"].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    left = index.filter("embedding IS NOT NULL").select("id", "pos", S.normalise(F.col("embedding")).alias("v"), F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    right = queries.filter("embedding IS NOT NULL").select("query_id", S.normalise(F.col("embedding")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("s"))

    def meet(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "id", "pos", "score"]
        if not len(vs) or not len(qs):
            return pd.DataFrame(columns=columns)
        out = []
        for dim, some in qs.groupby(qs["q"].map(len)):
            those = vs[vs["v"].map(len) == dim]
            if not len(those):
                continue
            v, q = np.stack(those["v"].to_numpy()), np.stack(some["q"].to_numpy())
            ids, pos = those["id"].to_numpy(), those["pos"].to_numpy()
            for qid, row in zip(some["query_id"], q @ v.T, strict=True):
                best = np.lexsort((pos, -np.round(row, 9)))[:k]
                out += [(qid, ids[i], int(pos[i]), float(row[i])) for i in best]
        return pd.DataFrame(out, columns=columns)

    hits = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(meet, f"query_id {qkind}, id {kind}, pos long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def search_one(index: DataFrame, vector: list[float], k: int = 5) -> DataFrame:
    """One query as a pure expression plan: dot product, then take-ordered."""
    q = S.normalise(F.array(*[F.lit(float(x)) for x in vector]))
    scored = index.select("id", "pos", S.dot(S.normalise(F.col("embedding")), q).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "pos").limit(k).select("id", "score")


def resolve(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of ranked ids; ids without a chunk are dropped after the cut, so fewer than k rows may stay."""
    return hits.join(chunks, "id")
