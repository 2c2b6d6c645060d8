"""The reference operators' queries over the test tables, and their DuckDB oracles, by name.

Bindings: documents are chunks, pages or units (source = family or document), benchmark items are
questions with their text as evidence, embeddings pair with documents and items by number, labels
give classes. Every query runs over its whole tables and whole texts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions import scoring as S
from textloom.functions import text as T
from textloom.operators import chunking, cleaning, dense, evaluation, lexical, qa, ranking, records, splitting
from textloom.sources import documents as sources
from textloom.sources import sinks
from textloom.sources.tables import new_path, stored, table
from textloom.streaming import resumable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# ------------------------------------------------------------------- inputs and shared SQL


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), "embedding", "label")


def hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select(F.col("id").alias("query_id"), "embedding")
    return questions(spark, d).join(v, "query_id", "left")


TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[''’][a-z0-9]+)?')"
BM25 = f"""
tok AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgl FROM tok),
post AS (SELECT id, len AS dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qs AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgl)))) AS score
       FROM qs JOIN dfs USING (term) JOIN post USING (term), st GROUP BY query_id, id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id::VARCHAR) AS rank FROM sc)"""
UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"


def dense_sql(asked: str) -> str:
    return f"""
vec AS (SELECT vec_id AS id, {UNIT} AS v FROM embeddings WHERE embedding IS NOT NULL),
dq AS ({asked}),
ds AS (SELECT query_id, id, list_dot_product(q, v) AS score FROM dq, vec),
den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM ds)"""


BY_ITEM = "SELECT item_id AS query_id, v AS q FROM benchmark JOIN vec ON vec.id = item_id"
FUSED = """
fp AS (SELECT query_id, id, 1.0 / (60 + rank) AS s FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM den WHERE rank <= 50),
fs AS (SELECT query_id, id, sum(s) AS score FROM fp GROUP BY query_id, id),
fus AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id::VARCHAR) AS rank FROM fs) WHERE rank <= 20)"""
WORDS = r"regexp_extract_all(lower({}), '[a-z]+(?:[''’][a-z]+)?')"
#: The share of a's distinct words, stop words aside, that b has.
OVERLAP = "len(list_filter(list_distinct(" + WORDS.format("{a}") + "), lambda w: NOT list_contains(" + sql_list(fixed.OVERLAP_STOP) + ", w) AND list_contains(" + WORDS.format("{b}") + ", w)))::DOUBLE / greatest(1, len(list_filter(list_distinct(" + WORDS.format("{a}") + "), lambda w: NOT list_contains(" + sql_list(fixed.OVERLAP_STOP) + ", w))))"
RERANKED = f"""
rr AS (SELECT query_id, id, round({OVERLAP.format(a="b.text", b="d.text")}, 9) AS score, rank FROM fus JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id),
rer AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM rr)"""

rounded = lambda c, n=6: F.round(c, n).alias(c)


def ranked_out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------- lexical search


@query(f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10")
def bm25_batch_topk(spark, d):
    return ranked_out(lexical.top_k(lexical.bm25_scores(corpus(spark, d), questions(spark, d)), 10))


@query(f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10")
def search_index(spark, d):
    """The index built once, stored, read again and searched by the retriever."""
    path = new_path(spark, "index")
    lexical.LexicalIndex.of(corpus(spark, d)).write(path)
    r = ranking.Retriever(corpus(spark, d), lexical_index=lexical.LexicalIndex.read(spark, path))
    return ranked_out(r.search(questions(spark, d), "bm25", 10))


ONE = "the of and"


@query(
    f"WITH {BM25.replace('FROM benchmark', f'FROM (SELECT 0 AS item_id, {ONE!r} AS text)')} SELECT id, round(score, 6) AS score FROM lex WHERE rank <= 10"
)
def bm25_topk(spark, d):
    return lexical.search_one(corpus(spark, d), ONE, 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, st")
def term_stats(spark, d):
    index = lexical.LexicalIndex.of(corpus(spark, d))
    return index.term_stats.join(F.broadcast(index.corpus_stats)).select("term", "df", F.round(S.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"SELECT doc_id AS id, len({TOKENS})::BIGINT AS len FROM documents")
def doc_lengths(spark, d):
    return corpus(spark, d).select("id", F.size(T.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("len"))


@query(f"WITH {BM25} SELECT n, round(avgl, 6) AS avg_len FROM st")
def corpus_stats(spark, d):
    return lexical.LexicalIndex.of(corpus(spark, d)).corpus_stats.select("n", F.round("avg_len", 6).alias("avg_len"))


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 100")
def vocabulary_topn(spark, d):
    return cleaning.vocabulary(corpus(spark, d)).orderBy(F.desc("n"), "word").limit(100)


# ------------------------------------------------------------------- dense search, fusion, reranking

EVERY_100 = "SELECT vec_id AS query_id, v AS q FROM (SELECT id AS vec_id, v FROM vec WHERE id % 100 = 0)"


@query(f"WITH {dense_sql(EVERY_100)} SELECT query_id, id, round(score, 6) AS score, rank FROM den WHERE rank <= 10")
def dense_batch_topk(spark, d):
    v = vectors(spark, d)
    return ranked_out(dense.search(v, v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 10))


FIRST = "SELECT 0 AS query_id, v AS q FROM vec WHERE id = 0"


@query(f"WITH {dense_sql(FIRST)} SELECT id, round(score, 6) AS score FROM den WHERE rank <= 10")
def dense_topk(spark, d):
    v = vectors(spark, d)
    return dense.search_one(v, v.filter("id = 0").first()["embedding"], 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, list_transform({UNIT}, lambda x: CASE WHEN round(x, 5) = 0 THEN 0.0 ELSE round(x, 5) END) AS v FROM embeddings")
def dense_normalised(spark, d):
    return vectors(spark, d).select("id", F.transform(S.normalise(F.col("embedding")), lambda x: F.round(x, 5)).alias("v"))


def retriever(spark, d) -> ranking.Retriever:
    return ranking.Retriever(corpus(spark, d), vectors(spark, d), scorer=F.round(S.support_overlap(F.col("question"), F.col("text")), 9))


@query(f"WITH {BM25}, {dense_sql(BY_ITEM)}, {FUSED} SELECT query_id, id, round(score, 6) AS score, rank FROM fus")
def rrf_fusion(spark, d):
    q = hybrid_queries(spark, d)
    a = lexical.top_k(lexical.bm25_scores(corpus(spark, d), q), 50)
    return ranked_out(ranking.fuse(a, dense.search(vectors(spark, d), q.select("query_id", "embedding"), 50)))


@query(f"WITH {BM25}, {dense_sql(BY_ITEM)}, {FUSED} SELECT query_id, id, round(score, 6) AS score, rank FROM fus WHERE rank <= 5")
def hybrid_topk(spark, d):
    return ranked_out(retriever(spark, d).search(hybrid_queries(spark, d), "hybrid", 5))


@query(f"WITH {BM25}, {dense_sql(BY_ITEM)}, {FUSED.replace('1.0 / (60 + rank) AS s', '2.0 / (60 + rank) AS s')} SELECT query_id, id, round(score, 6) AS score, rank FROM fus WHERE rank <= 5")
def weighted_fusion(spark, d):
    r = retriever(spark, d)
    r.weights = [2.0, 1.0]
    return ranked_out(r.search(hybrid_queries(spark, d), "hybrid", 5))


@query(f"WITH {BM25}, {dense_sql(BY_ITEM)}, {FUSED}, {RERANKED} SELECT query_id, id, round(score, 6) AS score, rank FROM rer WHERE rank <= 5")
def rerank_topk(spark, d):
    return ranked_out(retriever(spark, d).search(hybrid_queries(spark, d), "hybrid_rerank", 5))


@query(f"WITH {dense_sql(BY_ITEM)} SELECT query_id, id, rank, d.source FROM den JOIN documents d ON d.doc_id = id WHERE rank <= 5")
def dense_resolved(spark, d):
    hits = retriever(spark, d).search(hybrid_queries(spark, d), "dense", 5)
    return dense.resolve(hits, corpus(spark, d)).select("query_id", "id", "rank", "source")


NEG = f"""WITH {BM25}, g AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents x ON contains(x.text, b.text)),
k AS (SELECT l.query_id, l.id, l.rank FROM lex l JOIN documents x ON x.doc_id = l.id WHERE l.rank <= 100 AND x.lang = 'en' AND NOT coalesce(x.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0), false)
      AND NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = l.query_id AND g.id = l.id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k)
SELECT query_id, id, rank, place FROM p WHERE place <= 3"""


def gold(spark, d) -> DataFrame:
    """(query_id, id): documents that hold a benchmark text word for word.

    The evaluation set is small by nature; it travels as one literal array, so each document is read once.
    """
    items = table(spark, d, "benchmark").orderBy("item_id").collect()
    shared = F.array(*[F.struct(F.lit(i["item_id"]).alias("query_id"), F.lit(i["text"]).alias("q")) for i in items if i["text"] is not None])
    held = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.filter(shared, lambda i: F.contains(F.col("text"), i["q"]))).alias("i"))
    return held.select("i.query_id", "id")


@query(NEG)
def hard_negatives(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    hits = lexical.top_k(lexical.bm25_scores(docs.select("id", "text"), questions(spark, d)), 100)
    bad = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return ranking.hard_negatives(hits, gold(spark, d), docs.filter("lang = 'en'").select("id"), bad, 3)


@query(f"""WITH {BM25}, p AS (SELECT item_id AS query_id, substr(text, 1, 20) AS phrase FROM benchmark)
SELECT p.query_id, NOT coalesce(bool_or(contains(lower(d.text), lower(p.phrase))), false) AS absent
FROM p LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) l ON l.query_id = p.query_id LEFT JOIN documents d ON d.doc_id = l.id GROUP BY p.query_id""")
def unanswerable_check(spark, d):
    hits = lexical.top_k(lexical.bm25_scores(corpus(spark, d), questions(spark, d)), 10)
    return ranking.phrase_absent(hits, corpus(spark, d), questions(spark, d).withColumn("phrase", F.substring("question", 1, 20)))


# ------------------------------------------------------------------- retrieval metrics

ITEMS = """items AS (SELECT b.item_id AS query_id, list(d.doc_id::VARCHAR ORDER BY d.doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id)"""
MODES3 = f"""WITH {BM25}, {dense_sql(BY_ITEM)}, {FUSED}, {ITEMS},
allr AS (SELECT 'bm25' AS mode, query_id, id, rank FROM lex WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, id, rank FROM den WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, id, rank FROM fus WHERE rank <= 10),
ml AS (SELECT mode, query_id, list(id::VARCHAR ORDER BY rank) AS ranked FROM allr GROUP BY ALL),
grid AS (SELECT m.mode, i.query_id, i.gold, coalesce(ml.ranked, []) AS ranked FROM (SELECT DISTINCT mode FROM allr) m CROSS JOIN items i LEFT JOIN ml ON ml.mode = m.mode AND ml.query_id = i.query_id),
fr AS (SELECT *, list_min(list_filter(list_transform(range(1, len(ranked) + 1), lambda i: CASE WHEN list_contains(gold, ranked[i]) THEN i END), lambda x: x IS NOT NULL)) AS first FROM grid)"""


def all_modes(spark, d) -> DataFrame:
    """The two candidate lists are searched and stored once; every mode is read off them."""
    q = hybrid_queries(spark, d)
    lex = stored(lexical.top_k(lexical.bm25_scores(corpus(spark, d), q), 50))
    den = stored(dense.search(vectors(spark, d), q.select("query_id", "embedding"), 50))
    modes = {"bm25": lex, "dense": den, "hybrid": ranking.fuse(lex, den)}
    return functools.reduce(DataFrame.unionAll, [hits.filter("rank <= 10").select(F.lit(mode).alias("mode"), "query_id", "id", "rank") for mode, hits in modes.items()])


def gold_items(spark, d) -> DataFrame:
    lists = gold(spark, d).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")).alias("gold"))
    return lists.join(questions(spark, d), "query_id")


@query(f"""{MODES3} SELECT mode, count(*) AS n, count_if(coalesce(first <= 1, false)) AS hit_1, count_if(coalesce(first <= 3, false)) AS hit_3, count_if(coalesce(first <= 5, false)) AS hit_5, count_if(coalesce(first <= 10, false)) AS hit_10,
round(avg(len(list_intersect(ranked[1:5], gold))::DOUBLE / len(gold)), 6) AS recall_5, round(avg(len(list_intersect(ranked[1:10], gold))::DOUBLE / len(gold)), 6) AS recall_10,
round(avg(coalesce(1.0 / first, 0)), 6) AS mrr_10 FROM fr GROUP BY mode""")
def retrieval_metrics(spark, d):
    got = evaluation.retrieval_metrics(evaluation.per_query(gold_items(spark, d), all_modes(spark, d), ["mode"]), ["mode"])
    return got.select("mode", "n", "hit_1", "hit_3", "hit_5", "hit_10", rounded("recall_5"), rounded("recall_10"), rounded("mrr_10"))


@query(f"""{MODES3}, h AS (SELECT mode, count(*)::DOUBLE AS n, count_if(coalesce(first <= 5, false))::DOUBLE AS k FROM fr GROUP BY mode)
SELECT mode, k::BIGINT || '/' || n::BIGINT || ' (' || round_even(100 * k / n, 0)::BIGINT || '%)' AS hit_5,
round(greatest(0, ((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, ((k / n + 3.8416 / (2 * n)) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM h""")
def hit_wilson(spark, d):
    got = evaluation.retrieval_metrics(evaluation.per_query(gold_items(spark, d), all_modes(spark, d), ["mode"]), ["mode"])
    return got.select("mode", S.share_text(F.col("hit_5"), F.col("n")).alias("hit_5"), F.round("hit_5_low", 6).alias("low"), F.round("hit_5_high", 6).alias("high"))


@query(f"{MODES3} SELECT mode, fr.query_id, first AS first_gold_rank, substr(b.text, 1, 100) AS question FROM fr JOIN benchmark b ON b.item_id = fr.query_id")
def first_gold_ranks(spark, d):
    return evaluation.first_ranks(evaluation.per_query(gold_items(spark, d), all_modes(spark, d), ["mode"]), ["mode"]).withColumn("first_gold_rank", F.col("first_gold_rank").cast("long"))


@query(f"""{MODES3}, gs AS (SELECT mode, query_id, list_distinct(list(coalesce(source, '?'))) AS s FROM (SELECT mode, query_id, unnest(gold) AS id FROM grid) x LEFT JOIN documents d ON d.doc_id::VARCHAR = x.id GROUP BY ALL),
ts AS (SELECT mode, query_id, list_distinct(list(coalesce(source, '?'))) AS s FROM (SELECT mode, query_id, unnest(ranked[1:5]) AS id FROM grid) x LEFT JOIN documents d ON d.doc_id::VARCHAR = x.id GROUP BY ALL)
SELECT mode, count_if(list_has_any(gs.s, ts.s)) AS same_source_5 FROM gs LEFT JOIN ts USING (mode, query_id) GROUP BY mode""")
def same_source_hits(spark, d):
    meta = corpus(spark, d).select("id", "source", F.col("source").alias("family"))
    got = evaluation.retrieval_metrics(evaluation.per_query(gold_items(spark, d), all_modes(spark, d), ["mode"]), ["mode"], meta)
    return got.select("mode", "same_source_5")


@query(f"{MODES3} SELECT mode, round(avg((query_id * 37 + length(mode)) % 101 + 0.5), 6) AS latency_mean FROM fr GROUP BY mode")
def retrieval_latency(spark, d):
    """The mean latency of the retrieval summary, over latencies made from the items' numbers."""
    lists = evaluation.per_query(gold_items(spark, d), all_modes(spark, d), ["mode"])
    times = lists.select("mode", "query_id", ((F.col("query_id") * 37 + F.length("mode")) % 101 + 0.5).cast("double").alias("latency_ms"))
    return evaluation.retrieval_metrics(lists, ["mode"], latency=times).select("mode", rounded("latency_mean"))


@query(f"""{MODES3}, e AS (SELECT a.mode, a.query_id, min(CASE WHEN trim(b.text) <> '' AND contains(lower(regexp_replace(d.text, '\\s+', ' ', 'g')), lower(regexp_replace(trim(b.text), '\\s+', ' ', 'g'))) THEN a.rank END) AS first
FROM allr a JOIN documents d ON d.doc_id = a.id JOIN benchmark b ON b.item_id = a.query_id GROUP BY ALL)
SELECT mode, count_if(coalesce(first <= 1, false)) AS evidence_1, count_if(coalesce(first <= 3, false)) AS evidence_3, count_if(coalesce(first <= 5, false)) AS evidence_5, count_if(coalesce(first <= 10, false)) AS evidence_10 FROM e GROUP BY mode""")
def evidence_hit_at_k(spark, d):
    items = questions(spark, d).select("query_id", F.array("question").alias("evidence"))
    return evaluation.evidence_hits(all_modes(spark, d), corpus(spark, d), items, ["mode"])


# ------------------------------------------------------------------- answer metrics

#: Answers derived from the items by the same text for both engines: two systems, some abstaining.
PREDICTIONS = f"""
SELECT s.system, b.item_id AS id, b.item_id % 3 <> 0 AS answerable,
       CASE WHEN b.item_id % 5 = 0 THEN '{fixed.ABSTENTION}' WHEN s.system = 'A' THEN concat(substr(b.text, 1, 60), ' [1] and [3].') ELSE concat('the answer is ', substr(b.text, 20, 90), ' [2][9]') END AS answer,
       b.text AS reference_answer, b.text AS passage, (b.item_id * 37 + CASE WHEN s.system = 'A' THEN 11 ELSE 5 END) % 101 + 0.5 AS latency_ms
FROM benchmark b CROSS JOIN (SELECT 'A' AS system UNION ALL SELECT 'B' AS system) s"""


def predictions(spark, d) -> DataFrame:
    """The same rows as PREDICTIONS."""
    b = table(spark, d, "benchmark").withColumn("system", F.explode(F.array(F.lit("A"), F.lit("B"))))
    a = F.col("system") == "A"
    answer = F.when(F.col("item_id") % 5 == 0, fixed.ABSTENTION).when(a, F.concat(F.substring("text", 1, 60), F.lit(" [1] and [3]."))).otherwise(F.concat(F.lit("the answer is "), F.substring("text", 20, 90), F.lit(" [2][9]")))
    return b.select("system", F.col("item_id").alias("id"), (F.col("item_id") % 3 != 0).alias("answerable"), answer.alias("answer"), F.col("text").alias("reference_answer"), F.col("text").alias("passage"), ((F.col("item_id") * 37 + F.when(a, 11).otherwise(5)) % 101 + 0.5).cast("double").alias("latency_ms"))


ATOK = "regexp_extract_all(regexp_replace(lower({}), '\\[[0-9]+\\]', ' ', 'g'), '[a-z0-9]+')"
STOPS = sql_list(fixed.ANSWER_STOP)
ANS = f"""WITH p AS ({PREDICTIONS}), t AS (SELECT *, {ATOK.format('answer')} AS a, {ATOK.format('reference_answer')} AS r, contains(lower(answer), lower('{fixed.ABSTENTION}')) AS abst FROM p),
c AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(r, lambda x: x = w)))))::DOUBLE AS common,
 list_filter(r, lambda w: NOT list_contains({STOPS}, w)) AS rs, list_filter(a, lambda w: NOT list_contains({STOPS}, w)) AS aws FROM t),
m AS (SELECT *, CASE WHEN coalesce(common, 0) = 0 THEN 0 ELSE 2 * (common / len(a)) * (common / len(r)) / (common / len(a) + common / len(r)) END AS f1,
 CASE WHEN len(rs) = 0 THEN 0 ELSE len(list_filter(rs, lambda w: list_contains(a, w)))::DOUBLE / len(rs) END AS cont,
 CASE WHEN len(aws) = 0 THEN 0 ELSE len(list_filter(aws, lambda w: NOT list_contains(r, w)))::DOUBLE / len(aws) END AS unsup FROM c)"""


@query(f"{ANS} SELECT system, id, round(f1, 6) AS f1 FROM m")
def token_f1(spark, d):
    return predictions(spark, d).select("system", "id", F.round(S.token_f1(F.col("answer"), F.col("reference_answer")), 6).alias("f1"))


@query(f"{ANS} SELECT system, id, round(cont, 6) AS containment FROM m")
def containment(spark, d):
    return predictions(spark, d).select("system", "id", F.round(S.containment(F.col("answer"), F.col("reference_answer")), 6).alias("containment"))


@query(f"{ANS} SELECT system, id, round(unsup, 6) AS unsupported FROM m")
def unsupported_share(spark, d):
    return predictions(spark, d).select("system", "id", F.round(S.unsupported(F.col("answer"), F.array("passage")), 6).alias("unsupported"))


@query(f"""{ANS}, l AS (SELECT system, list_sort(list(latency_ms)) AS ls FROM m GROUP BY system)
SELECT system, count_if(answerable) AS n_answerable, count_if(NOT answerable) AS n_unanswerable, round(avg(f1) FILTER (answerable), 6) AS token_f1, round(avg(cont) FILTER (answerable), 6) AS containment,
count_if(answerable AND id % 2 = 0) AS retrieval_hits, count_if(answerable AND id % 4 = 0) AS cited_gold, count_if(answerable AND abst) AS false_refusals, count_if(NOT answerable AND abst) AS correct_refusals,
round(coalesce(avg(unsup) FILTER (answerable AND NOT abst), 0), 6) AS unsupported, round(avg(latency_ms), 6) AS latency_mean, any_value(ls[round_even(0.95 * (len(ls) - 1), 0)::INT + 1]) AS latency_p95
FROM m JOIN l USING (system) GROUP BY system""")
def answer_summary(spark, d):
    p = predictions(spark, d)
    named = lambda m: F.when(F.col("id") % m == 0, F.array(F.col("id").cast("string"))).otherwise(F.array(F.lit("none")))
    pred = p.select("system", "id", "answer", T.mentions_abstention(F.col("answer")).alias("abstained"), named(4).alias("cited_ids"), named(2).alias("retrieved_ids"), F.array("passage").alias("context"), "latency_ms")
    items = p.filter("system = 'A'").select("id", "answerable", "reference_answer", F.array(F.col("id").cast("string")).alias("gold"))
    got = evaluation.answer_metrics(pred, items)
    return got.select("system", "n_answerable", "n_unanswerable", rounded("token_f1"), rounded("containment"), "retrieval_hits", "cited_gold", "false_refusals", "correct_refusals", rounded("unsupported"), rounded("latency_mean"), "latency_p95")


@query("""WITH l AS (SELECT event_type, list_sort(list(value)) AS ls FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, len(ls)::BIGINT AS n, ls[round_even(0.95 * (len(ls) - 1), 0)::INT + 1] AS value FROM l""")
def latency_p95_nearest_rank(spark, d):
    return evaluation.nearest_rank_by(table(spark, d, "events"), "event_type", "value")


@query(f"WITH p AS ({PREDICTIONS}) SELECT system, id, trim(answer) = '{fixed.ABSTENTION}' AS exactly, contains(lower(answer), lower('{fixed.ABSTENTION}')) AS mentioned FROM p")
def abstention_flags(spark, d):
    a = F.col("answer")
    return predictions(spark, d).select("system", "id", T.abstained_exactly(a).alias("exactly"), T.mentions_abstention(a).alias("mentioned"))


@query(f"""WITH p AS ({PREDICTIONS}), n AS (SELECT system, id, answer, list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: x::INT) AS ns FROM p),
c AS (SELECT *, ['c1', 'c2', 'c3'] AS ctx FROM n)
SELECT system, id, trim(answer) = '{fixed.ABSTENTION}' AS abstained, array_to_string(list_transform(list_filter(ns, lambda x: x BETWEEN 1 AND 3), lambda x: ctx[x]), ',') AS cited, array_to_string(list_filter(ns, lambda x: x NOT BETWEEN 1 AND 3), ',') AS invalid FROM c""")
def citations_resolved(spark, d):
    p = predictions(spark, d).withColumn("context", F.array(F.lit("c1"), F.lit("c2"), F.lit("c3")))
    return qa.resolve_citations(p).select("system", "id", "abstained", F.array_join("cited_ids", ",").alias("cited"), F.array_join(F.transform("invalid_citations", lambda x: x.cast("string")), ",").alias("invalid"))


@query(f"""WITH p AS ({PREDICTIONS}), f AS (SELECT system, id % 2 = 0 AS present, contains(lower(answer), lower('{fixed.ABSTENTION}')) AS abst, id % 4 = 0 AS ok FROM p)
SELECT system, present, count(*) AS n, count_if(abst) AS refused, count_if(NOT abst AND ok) AS cited FROM f GROUP BY system, present""")
def evidence_split(spark, d):
    p = predictions(spark, d).select("system", (F.col("id") % 2 == 0).alias("present"), T.mentions_abstention(F.col("answer")).alias("abstained"), (F.col("id") % 4 == 0).alias("cited_ok"))
    return evaluation.evidence_split(p)


SCORED = "SELECT l.doc_id, l.quality = 1 AS positive, l.toxic = 1 AS toxic, (d.n_chars % 97)::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)"


def scored(spark, d) -> DataFrame:
    """Labels with a score that has many ties."""
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select("doc_id", (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 1).alias("toxic"), (F.col("n_chars") % 97).cast("double").alias("score"))


@query(f"""WITH s AS ({SCORED}), c AS (SELECT score, count_if(positive)::DOUBLE AS p, count_if(NOT positive)::DOUBLE AS n FROM s GROUP BY score)
SELECT round(sum(a.p * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / ((SELECT sum(p) FROM c) * (SELECT sum(n) FROM c)), 6) AS auroc FROM c a, c b""")
def auroc_quality(spark, d):
    return evaluation.auroc(scored(spark, d)).select(F.round("auroc", 6).alias("auroc"))


@query(f"""WITH s AS ({SCORED}), u AS (SELECT DISTINCT score FROM s), c AS (SELECT min(score) - 1 AS t FROM s UNION ALL SELECT max(score) + 1 FROM s UNION ALL
SELECT (score + nx) / 2 FROM (SELECT score, lead(score) OVER (ORDER BY score) AS nx FROM u) WHERE nx IS NOT NULL),
r AS (SELECT t, count_if(positive AND score >= t)::DOUBLE / (SELECT count_if(positive) FROM s) AS tpr, count_if(NOT positive AND score < t)::DOUBLE / (SELECT count_if(NOT positive) FROM s) AS tnr FROM c, s GROUP BY t)
SELECT round((tpr + tnr) / 2, 6) AS balance, t AS threshold, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr FROM r ORDER BY round((tpr + tnr) / 2, 12) DESC, t LIMIT 1""")
def best_threshold(spark, d):
    return evaluation.best_threshold(scored(spark, d)).select(rounded("balance"), "threshold", rounded("tpr"), rounded("tnr"))


@query(f"""WITH s AS ({SCORED}), g AS (SELECT CASE WHEN NOT positive THEN 'unanswerable' WHEN doc_id % 2 = 0 THEN 'answerable_evidence_in' ELSE 'answerable_evidence_absent' END AS "group", score < 40 AS gate, score < 40 OR toxic AS ref, doc_id % 3 = 0 AS ok FROM s)
SELECT "group", count(*) AS n, count_if(gate) AS gate_refused, count_if(ref) AS refused, count_if("group" = 'answerable_evidence_in' AND NOT ref AND ok) AS cited FROM g GROUP BY "group\"""")
def gate_groups(spark, d):
    rows = scored(spark, d).select(F.col("positive").alias("answerable"), (F.col("doc_id") % 2 == 0).alias("present"), "score", F.col("toxic").alias("abstained"), (F.col("doc_id") % 3 == 0).alias("cited_ok"))
    return evaluation.gate_groups(rows, 40.0)


#: Items with an id of remainder 0 by 3 count as unanswerable; those with an odd id tune the gate, the others are judged.
GATE = rf"""WITH {BM25}, {dense_sql(BY_ITEM)}, {FUSED}, {RERANKED},
txt AS (SELECT r.query_id, r.rank, r.score, trim(b.text) <> '' AND contains(lower(regexp_replace(d.text, '\s+', ' ', 'g')), lower(regexp_replace(trim(b.text), '\s+', ' ', 'g'))) AS found
 FROM rer r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 5),
top AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS score, bool_or(found) AS found FROM txt GROUP BY query_id),
gi AS (SELECT b.item_id AS query_id, b.item_id % 3 <> 0 AS answerable, t.score, coalesce(t.found, false) AS present FROM benchmark b LEFT JOIN top t ON t.query_id = b.item_id),
tu AS (SELECT score, answerable AND present AS positive FROM gi WHERE query_id % 2 = 1 AND score IS NOT NULL), u AS (SELECT DISTINCT score FROM tu),
ca AS (SELECT min(score) - 1 AS t FROM tu UNION ALL SELECT max(score) + 1 FROM tu UNION ALL SELECT (score + nx) / 2 FROM (SELECT score, lead(score) OVER (ORDER BY score) AS nx FROM u) WHERE nx IS NOT NULL),
ra AS (SELECT t, coalesce(count_if(positive AND score >= t)::DOUBLE / nullif((SELECT count_if(positive) FROM tu), 0), 0) AS tpr, coalesce(count_if(NOT positive AND score < t)::DOUBLE / nullif((SELECT count_if(NOT positive) FROM tu), 0), 0) AS tnr FROM ca, tu GROUP BY t),
cut AS (SELECT (tpr + tnr) / 2 AS balance, t AS threshold, tpr, tnr FROM ra ORDER BY round((tpr + tnr) / 2, 12) DESC, t LIMIT 1)"""


def _score_gate(spark, d):
    """The whole gate: reranked search of every item, the cut from the odd items, its effect on the others."""
    q = hybrid_queries(spark, d)
    items = q.select("query_id", (F.col("query_id") % 3 != 0).alias("answerable"), F.array("question").alias("evidence"))
    ready = stored(evaluation.gate_inputs(retriever(spark, d).search(q, "hybrid_rerank", 5), corpus(spark, d), items))
    i = F.col("query_id")
    given = q.select("query_id", (i % 5 == 0).alias("abstained"), F.when(i % 4 == 0, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array(F.lit("no"))).alias("cited_ids"), F.array(F.lit("no"), F.lit("yes")).alias("retrieved_ids"), F.array(F.lit("nothing"), F.concat(F.lit("so: "), F.col("question"))).alias("context"))
    return evaluation.score_gate(ready.filter("query_id % 2 = 1"), ready.filter("query_id % 2 = 0"), given)


@query(f"{GATE} SELECT round(balance, 6) AS balance, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr FROM cut")
def score_gate_cut(spark, d):
    return _score_gate(spark, d)[0].select(*[rounded(c) for c in ("balance", "threshold", "tpr", "tnr")])


@query(f"""{GATE}, gr AS (SELECT CASE WHEN NOT answerable THEN 'unanswerable' WHEN present THEN 'answerable_evidence_in' ELSE 'answerable_evidence_absent' END AS "group",
 coalesce(score < threshold, true) AS gate, query_id FROM gi, cut WHERE query_id % 2 = 0)
SELECT "group", count(*) AS n, count_if(gate) AS gate_refused, count_if(gate OR query_id % 5 = 0) AS refused, count_if("group" = 'answerable_evidence_in' AND NOT gate AND query_id % 5 <> 0 AND query_id % 4 = 0) AS cited FROM gr GROUP BY "group\"""")
def score_gate_groups(spark, d):
    return _score_gate(spark, d)[1]


# ------------------------------------------------------------------- evidence and support


@query(f"SELECT b.item_id, d.doc_id, round({OVERLAP.format(a='b.text', b='d.text')}, 6) AS overlap FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def support_overlap(spark, d):
    j = table(spark, d, "benchmark").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("body")), F.col("doc_id") == F.col("item_id"))
    return j.select("item_id", "doc_id", F.round(S.support_overlap(F.col("text"), F.col("body")), 6).alias("overlap"))


@query("""SELECT doc_id, contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), lower(regexp_replace(trim(substr(text, 11, 40), E' \\n\\t'), '\\s+', ' ', 'g')))
 AND contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), lower(regexp_replace(trim(source || ' x', E' \\n\\t'), '\\s+', ' ', 'g'))) AS both_in,
 contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), lower(regexp_replace(trim(substr(text, 11, 40), E' \\n\\t'), '\\s+', ' ', 'g'))) AS first_in FROM documents""")
def evidence_supported(spark, d):
    docs = table(spark, d, "documents")
    q = F.substring("text", 11, 40)
    return docs.select("doc_id", S.all_quotes_in(F.array(q, F.concat("source", F.lit(" x"))), F.col("text")).alias("both_in"), S.all_quotes_in(F.array(q), F.col("text")).alias("first_in"))


# ------------------------------------------------------------------- text functions

TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CLEAN = TRIMMED.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\r\n?', E'\n', 'g'), '[ \t\f\x0B]+', ' ', 'g'), ' *\n *', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g')")


@query(f"SELECT doc_id, {CLEAN.format('text')} AS text FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.coalesce("text", F.lit(""))).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '.txt' AS file FROM documents")
def slug_filename(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug_filename(F.substring("text", 1, 60)).alias("file"))


@query(r"SELECT doc_id, source, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) AS snippet FROM documents")
def snippet_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", T.snippet(F.col("text"), 200).alias("snippet"))


@query(r"""SELECT page_id, list_extract(string_split(url, '/'), -1) AS last_part, upper(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g')) AS slug FROM pages""")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_last_part(F.col("url")).alias("last_part"), F.upper(F.regexp_replace("url", "[^A-Za-z0-9]+", "_")).alias("slug"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct, max(length(line))::BIGINT AS longest FROM l GROUP BY doc_id""")
def line_explode_stats(spark, d):
    lines = cleaning.page_lines(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), "text"))
    return lines.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("line").alias("n_distinct"), F.max(F.length("line")).cast("long").alias("longest"))


@query(f"WITH t AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents), w AS (SELECT id, ts, unnest(range(0, len(ts), 64)) AS s FROM t) SELECT id, (s // 64)::INT AS \"window\", array_to_string(ts[s + 1 : s + 64], ' ') AS text FROM w")
def fixed_token_windows(spark, d):
    tokens = corpus(spark, d).select("id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return chunking.fixed_windows(tokens, 64).select("id", "window", F.array_join("tokens", " ").alias("text"))


@query("SELECT event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS value, count(*) AS n FROM events GROUP BY ALL")
def props_json_extract(spark, d):
    key = F.element_at(F.json_object_keys("props"), 1)
    value = F.element_at(F.from_json("props", "map<string,string>"), key)
    return table(spark, d, "events").select("event_type", value.alias("value")).groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- cleaning and metadata

#: Documents as pages of their source, in order of doc_id, each with a running head and a page number.
PAGES = "SELECT doc, page, concat('Annual report ', doc, ' of 2021', E'\\n', text, E'\\nPage ', page + 1) AS text FROM (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, text FROM documents)"


def pages(spark, d) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    p = table(spark, d, "documents").select(F.col("source").alias("doc"), (F.row_number().over(w) - 1).alias("page"), "text")
    head = F.concat(F.lit("Annual report "), F.col("doc"), F.lit(" of 2021\n"))
    return p.select("doc", "page", F.concat(head, "text", F.lit("\nPage "), (F.col("page") + 1).cast("string")).alias("text"))


FURN = rf"""WITH pg AS ({PAGES}), ln AS (SELECT doc, page, generate_subscripts(string_split(text, E'\n'), 1) AS pos, unnest(string_split(text, E'\n')) AS line FROM pg),
ne AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS up, row_number() OVER (PARTITION BY doc, page ORDER BY pos DESC) AS down FROM ln WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
ed AS (SELECT DISTINCT doc, page, lower(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS key FROM ne WHERE (up <= 3 OR down <= 3)
 AND NOT (regexp_matches(trim(line), '(?i)^(?:(?:page|pg\.?)\s*)?[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?[.:]?$') AND NOT regexp_matches(trim(line), '(?i)^[0-9]{{1,2}}\s+of\s+(?:18|19|20)[0-9]{{2}}\.?$')
  AND (regexp_matches(trim(line), '(?i)^(?:page|pg\.?)\s*|\bof\b|/') OR try_cast(regexp_extract(trim(line), '^([0-9]{{1,4}})[.:]?$', 1) AS INT) = page + 1))),
tot AS (SELECT doc, count(DISTINCT page) AS total FROM pg GROUP BY doc),
fu AS (SELECT doc, key, count(*) AS pages FROM ed JOIN tot USING (doc) GROUP BY doc, key, total HAVING count(*) > 1 AND count(*) > 0.3 * total)"""


@query(f"{FURN} SELECT doc, key, pages FROM fu")
def page_furniture(spark, d):
    return cleaning.furniture(pages(spark, d))


LINE = TRIMMED.format("line")
PAGE_NO = rf"""(regexp_matches({LINE}, '(?i)^(?:(?:page|pg\.?)\s*)?[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?[.:]?$') AND NOT regexp_matches({LINE}, '(?i)^[0-9]{{1,2}}\s+of\s+(?:18|19|20)[0-9]{{2}}\.?$')
  AND (regexp_matches({LINE}, '(?i)^(?:page|pg\.?)\s*|\bof\b|/') OR coalesce(try_cast(regexp_extract({LINE}, '^([0-9]{{1,4}})[.:]?$', 1) AS INT) = page + 1, false)))"""


@query(
    rf"""{FURN}, lk AS (SELECT *, lower(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')) AS key FROM ln),
kp AS (SELECT doc, page, string_agg(line, E'\n' ORDER BY pos) AS text FROM lk WHERE NOT ((EXISTS (SELECT 1 FROM fu WHERE fu.doc = lk.doc AND fu.key = lk.key) AND NOT regexp_matches({LINE}, '(?i)^[0-9]{{1,2}}\s+of\s+(?:18|19|20)[0-9]{{2}}\.?$') AND {LINE} <> '') OR {PAGE_NO}) GROUP BY doc, page),
cl AS (SELECT pg.doc, pg.page, {CLEAN.format("kp.text")} AS text FROM pg LEFT JOIN kp USING (doc, page))
SELECT doc, page, sha256(text) AS sha, length(text) AS n_chars FROM cl"""
)
def pages_cleaned(spark, d):
    return cleaning.clean_pages(pages(spark, d)).select("doc", "page", F.sha2("text", 256).alias("sha"), F.length("text").alias("n_chars"))


@query(f"{FURN}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pages DESC, key) AS k FROM fu) SELECT doc, key, pages FROM r WHERE k <= 12")
def removed_line_report(spark, d):
    return cleaning.removed_lines(pages(spark, d))


VOCAB = "SELECT word FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 100"
ENGLISH = rf"""WITH vo AS (SELECT list(word) AS v FROM ({VOCAB})), x AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '\p{{L}}'))::DOUBLE AS letters, len(regexp_extract_all(text, '[\x{{0900}}-\x{{097F}}\x{{A8E0}}-\x{{A8FF}}]')) AS dev,
 regexp_extract_all(lower(text), '[a-z]+(?:[''’][a-z]+)?') AS ws FROM documents),
er AS (SELECT doc_id, source, text, CASE WHEN contains(text, '�') THEN 'replacement_character' WHEN letters > 0 AND dev / letters > 0.15 THEN 'devanagari'
 WHEN len(ws) = 0 OR len(list_filter(ws, lambda w: list_contains(v, w)))::DOUBLE / len(ws) < 0.05 THEN 'not_english' END AS reason FROM x, vo)"""


def known_words(spark: SparkSession, d: str):
    """The corpus's 100 commonest words stand in for a word list, which is a parameter."""
    return [r["word"] for r in vocabulary_topn(spark, d).collect()]


@query(f"{ENGLISH} SELECT doc_id, reason FROM er")
def english_filter_reason(spark, d):
    return table(spark, d, "documents").select("doc_id", cleaning.english_reason(F.col("text"), known_words(spark, d)).alias("reason"))


@query(f"{ENGLISH} SELECT source, reason, count(*) AS units, sum(length({CLEAN.format('text')}))::BIGINT AS chars, 0::BIGINT AS stripped_chars FROM er GROUP BY source, reason")
def english_loss_report(spark, d):
    return cleaning.english_report(cleaning.filter_english(table(spark, d, "documents").select("source", "text"), known_words(spark, d)))


@query()
def word_repair(spark, d):
    units = table(spark, d, "documents").select("doc_id", "text")
    return cleaning.repair_words(units).select("doc_id", F.size("fixes").alias("n_fixes"), F.sha2("text", 256).alias("sha"))


@query(r"""WITH f AS (SELECT doc_id, source || '_guide_' || (1990 + doc_id % 40) || '.html' AS name, CASE WHEN doc_id % 7 = 0 THEN 'wikipedia' ELSE 'manual' END AS st, text FROM documents),
k AS (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS stem, trim(regexp_replace(lower(regexp_replace(name, '\.[^.]*$', '')), '[^a-z0-9]+', ' ', 'g')) AS key FROM f)
SELECT doc_id, CASE WHEN st = 'wikipedia' THEN 'encyclopedia' WHEN regexp_matches(key || ' ' || lower(text), '\b(draft|consultation|recommendation)\b') THEN 'draft_or_consultation' ELSE 'final_regulation' END AS doc_type,
 CASE WHEN st <> 'wikipedia' THEN (1990 + doc_id % 40)::INT END AS year,
 CASE WHEN st = 'wikipedia' THEN 'WIKIPEDIA_' ELSE 'MANUAL_' END || upper(regexp_replace(stem, '[^A-Za-z0-9]+', '_', 'g')) AS family FROM k""")
def document_metadata(spark, d):
    f = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("_guide_"), (1990 + F.col("doc_id") % 40).cast("string"), F.lit(".html")).alias("name"), F.when(F.col("doc_id") % 7 == 0, "wikipedia").otherwise("manual").alias("source_type"), F.lit(None).cast("string").alias("title"), F.col("text").alias("first_page"))
    return cleaning.infer_metadata(f).select("doc_id", "doc_type", "year", "family")


@query(r"""WITH f AS (SELECT source, string_agg(CASE WHEN doc_id % 3 = 0 THEN '# Part ' || doc_id || E' #\n' ELSE '' END || 'line ' || doc_id, E'\n' ORDER BY doc_id) AS text FROM documents GROUP BY source),
l AS (SELECT source, generate_subscripts(string_split(text, E'\n'), 1) AS pos, unnest(string_split(text, E'\n')) AS line FROM f),
n AS (SELECT *, regexp_matches(line, '^#{1,6}\s+(.+?)\s*#*\s*$') AS head, sum(regexp_matches(line, '^#{1,6}\s+(.+?)\s*#*\s*$')::INT) OVER (PARTITION BY source ORDER BY pos) AS no FROM l)
SELECT source, no::INT AS section_no, coalesce(max(CASE WHEN head THEN trim(regexp_extract(line, '^#{1,6}\s+(.+?)\s*#*\s*$', 1)) END), source) AS section, string_agg(line, E'\n' ORDER BY pos) FILTER (NOT head) AS text FROM n GROUP BY source, no HAVING count_if(NOT head) > 0""")
def markdown_sections(spark, d):
    line = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Part "), F.col("doc_id").cast("string"), F.lit(" #\n"))).otherwise(""), F.lit("line "), F.col("doc_id").cast("string"))
    files = table(spark, d, "documents").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return sources.markdown_units(files)


@query()
def html_text(spark, d):
    p = table(spark, d, "pages")
    return sources.html_units(p, F.col("page_id").cast("string"), F.col("html")).select("source", "doc_title", F.size("section").alias("n_headings"), F.sha2("text", 256).alias("sha"))


# ------------------------------------------------------------------- QA data

_LINES = r"list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x, E' \t\r')), lambda x: x <> '')"
_NUMS = r"regexp_extract_all({}, '[0-9]+(?:[.,/%:-][0-9]+)*')"
REJECT = rf"""WITH x AS (SELECT doc_id, source, text, {_LINES} AS ls, len(regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)?')) AS words, len({_NUMS.format('text')}) AS nums FROM documents),
y AS (SELECT *, len(list_filter(ls, lambda l: regexp_matches(l, '\.{{2,}}|\s[0-9]{{1,3}}\s*$'))) AS toc, len(list_filter(ls, lambda l: len({_NUMS.format('l')}) >= 4)) AS rows4,
 len(list_filter(ls, lambda l: regexp_matches(l, '(?i)\b(address|road|street|floor|complex|avenue|building)\b'))) AS addr,
 len(list_filter(ls, lambda l: regexp_matches(l, '{fixed.EMAIL}') OR len(list_filter(regexp_extract_all(' ' || l || ' ', '[^0-9A-Za-z_](\+?[0-9][0-9\s().-]{{7,}}[0-9])[^0-9A-Za-z_]', 1), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= 10)) > 0)) AS reach,
 len(list_filter(ls, lambda l: regexp_matches(l, '{fixed.CONTACT_LINE}'))) AS heads FROM x),
rj AS (SELECT doc_id, source, CASE WHEN upper(source) = 'QOS' AND regexp_matches(text, '(?i)input of stakeholders|analysis and conclusion') THEN 'qos_stakeholder_discussion'
 WHEN regexp_matches(coalesce(ls[1], ''), '(?i)^(contents|table of contents|index)$') AND (toc >= 2 OR words < 100) THEN 'table_of_contents_or_index'
 WHEN len(ls) >= 3 AND heads > 0 AND (reach >= 4 OR addr >= 4) THEN 'address_or_contact_list'
 WHEN (nums >= 20 AND nums::DOUBLE / greatest(1, words + nums) >= 0.6) OR (rows4 >= 4 AND rows4::DOUBLE / greatest(1, len(ls)) >= 0.25) THEN 'mostly_numbers_or_tables'
 WHEN words < 40 THEN 'under_40_words' END AS reason FROM y)"""


def chunks_as(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("source").alias("family"), F.col("lang"))


@query(f"{REJECT} SELECT doc_id AS id, reason FROM rj")
def qa_rejection_reason(spark, d):
    return qa.annotate(chunks_as(spark, d)).select("id", F.col("qa_rejection_reason").alias("reason"))


@query(f"{REJECT} SELECT source, count_if(reason IS NULL) AS usable, count_if(reason IS NOT NULL) AS unusable FROM rj GROUP BY source")
def qa_quality_by_source(spark, d):
    return qa.quality_report(qa.annotate(chunks_as(spark, d)))


@query(f"{REJECT}, k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS place FROM rj WHERE reason IS NOT NULL) SELECT doc_id AS id, reason, place FROM k WHERE place <= 5")
def rejection_examples(spark, d):
    return qa.rejection_examples(qa.annotate(chunks_as(spark, d))).select("id", F.col("qa_rejection_reason").alias("reason"), "place")


SYSTEM = "Answer only from the passages."


@query(f"""WITH c AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn) AS ps FROM conversations GROUP BY conv_id)
SELECT conv_id, '{SYSTEM}' AS system, E'Context passages:\\n' || array_to_string(list_transform(ps, lambda p, i: '[' || i || '] ' || coalesce(nullif(p.role, ''), 'Unknown title') || ' (' || CASE WHEN p.turn % 2 = 0 THEN (2000 + p.turn)::VARCHAR ELSE 'year unknown' END || E')\\n' || regexp_replace(coalesce(p.text, ''), '^\\s+|\\s+$', '', 'g')), E'\\n\\n') || E'\\n\\nQuestion: what is said?' AS asked FROM c""")
def prompt_messages(spark, d):
    c = table(spark, d, "conversations")
    ctx = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda p: F.struct(p["role"].alias("title"), F.when(p["turn"] % 2 == 0, 2000 + p["turn"]).alias("year"), p["text"].alias("text")))
    m = c.groupBy("conv_id").agg(ctx.alias("context")).withColumn("m", qa.prompt(F.lit(" what is said? "), F.col("context"), SYSTEM))
    return m.select("conv_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("asked"))


@query("""WITH r AS (SELECT doc_id, list_sort(list_transform(['g', 'n1', 'n2', 'n3'], lambda c: sha256('42:' || doc_id || ':' || c) || c)) AS o FROM documents),
s AS (SELECT doc_id, list_transform(o, lambda x: substr(x, 65)) AS ids FROM r),
l AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN list_append(list_filter(ids, lambda x: x <> 'g'), 'g') ELSE ids END AS ids FROM s)
SELECT doc_id, array_to_string(ids, ',') AS context, 'fact [' || list_position(ids, 'g') || ']' AS answer FROM l""")
def sft_records(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    r = qa.sft_record(F.lit("g"), F.array(F.lit("n1"), F.lit("n2"), F.lit("n3")), F.lit("fact [2] [7]"), F.concat(F.lit("42:"), F.col("doc_id").cast("string")), gold_last=F.col("doc_id") % 10 == 1)
    return docs.withColumn("r", r).select("doc_id", F.array_join("r.context", ",").alias("context"), F.col("r.answer").alias("answer"))


@query()
def generated_items(spark, d):
    items = qa.generate(chunks_as(spark, d).select("id", "text"), qa.mock_items, 1)
    joined = items.join(chunks_as(spark, d).select("id", "text"), "id")
    return joined.select("id", "key", F.size("items").alias("made"), F.size(qa.valid_items(F.col("items"), F.col("text"))).alias("valid"))


@query()
def near_duplicate_pairs(spark, d):
    q = questions(spark, d).select(F.col("query_id").alias("id"), F.col("question").alias("text"))
    edited = q.select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("please: "), F.replace("text", F.lit(" the "), F.lit(" a "))).alias("text"))
    both = q.unionAll(edited)
    return qa.similar_pairs(both, both, 0.88, same=True).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query()
def distinct_questions(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text").withColumn("id", F.col("pos"))
    return qa.greedy_distinct(turns).select("id", "accepted")


@query()
def leakage_similarity(spark, d):
    q = questions(spark, d).select(F.col("query_id").alias("id"), F.col("question").alias("text"))
    training = q.filter("id % 2 = 0").select(F.col("id"), F.concat("text", F.lit(" again")).alias("text"))
    return splitting.closest_questions(q, training, 0.9).select("id", "train_id", F.round("ratio", 6).alias("ratio"))


# ------------------------------------------------------------------- chunks and ids


@query()
def recursive_chunks(spark, d):
    units = table(spark, d, "documents").select(F.col("doc_id").alias("unit_pos"), "source", "text")
    meta = F.concat(F.lit('{"source": "'), F.col("source"), F.lit('"}'))
    return chunking.with_ids(chunking.chunk_texts(units), meta, ["unit_pos", "chunk_pos"]).select("unit_pos", "chunk_pos", "id", F.length("text").alias("n_chars"))


@query("""WITH k AS (SELECT doc_id, '{"lang": "' || lang || '"}' AS m, text, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) - 1 AS o FROM documents)
SELECT doc_id, substr(sha256(m || E'\\n' || text || E'\\n' || o), 1, 16) AS id FROM k""")
def stable_chunk_ids(spark, d):
    units = table(spark, d, "documents").select("doc_id", "lang", "text")
    return chunking.with_ids(units, T.canonical_json({"lang": F.col("lang")}), ["doc_id"]).select("doc_id", "id")


@query("""WITH k AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 2 AS g FROM documents)
SELECT source, min(doc_id) AS first, max(doc_id) AS second FROM k GROUP BY source, g HAVING count(*) = 2""")
def adjacent_pairs(spark, d):
    return splitting.adjacent_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "source"))


@query("""WITH h AS (SELECT lang AS family, source, min(doc_id) AS id FROM documents GROUP BY lang, source), one AS (SELECT source, arg_min(family, id) AS family, min(id) AS id FROM h GROUP BY source),
f AS (SELECT family, min(source) AS s FROM one GROUP BY family) SELECT o.family, a.id AS first, o.id AS second FROM one o JOIN f USING (family) JOIN one a ON a.source = f.s WHERE o.source <> f.s""")
def family_pairs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "source", F.col("lang").alias("family"))
    return splitting.family_pairs(docs)


# ------------------------------------------------------------------- splits and samples

FAMS = "SELECT source, 'F' || (substr(source, 4)::INT % 9) AS family, count(*) AS chunks FROM documents GROUP BY source"


def family_chunks(spark, d) -> DataFrame:
    no = F.substring("source", 4, 5).cast("int")
    return table(spark, d, "documents").select("source", F.concat(F.lit("F"), F.pmod(no, F.lit(9)).cast("string")).alias("family"), F.lit("manual").alias("source_type"))


@query(f"SELECT family, sum(chunks)::BIGINT AS chunks, 0::BIGINT AS wiki_chunks, 0::BIGINT AS wiki_sources, count(*) AS sources FROM ({FAMS}) GROUP BY family")
def family_stats(spark, d):
    return splitting.family_stats(splitting.document_stats(family_chunks(spark, d)))


@query(f"""WITH f AS (SELECT family, sum(chunks)::BIGINT AS chunks, row_number() OVER (ORDER BY family) - 1 AS i FROM ({FAMS}) GROUP BY family), t AS (SELECT sum(chunks) AS total, count(*) AS k FROM f),
m AS (SELECT unnest(range(1, (1 << (SELECT k FROM t)::INT)::BIGINT)) AS mask), s AS (SELECT mask, sum(chunks) AS n, max(chunks) AS big, count(*) AS k, list(family ORDER BY family) AS fs FROM m JOIN f ON (mask >> i::INT) & 1 = 1 GROUP BY mask),
b AS (SELECT fs FROM s, t WHERE list_contains(fs, 'F1') AND big * 100 <= n * 30 AND list_contains(fs, 'F4') ORDER BY abs(n - total * 0.4), s.k, fs LIMIT 1)
SELECT family, chunks, CASE WHEN list_contains((SELECT fs FROM b), family) THEN 'eval' ELSE 'train' END AS split FROM f""")
def family_split(spark, d):
    return splitting.split_families(family_chunks(spark, d), eval_fraction=0.4, regulations=["F1"], mandatory=["F1"], operators=["F4"])


@query("""WITH k AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS turn FROM documents) SELECT id, source, turn FROM k WHERE turn <= 15""")
def doc_cap_sample(spark, d):
    return splitting.cap_per_document(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), splitting.document_cap(100, 0.15), 42)


@query("""WITH k AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS turn FROM documents) SELECT id, source, turn, row_number() OVER (ORDER BY turn, sha256('42:' || source), source) AS place FROM k""")
def round_robin_sample(spark, d):
    return splitting.round_robin(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), 42).select("id", "source", "turn", "place")


@query("""WITH k AS (SELECT c_custkey AS id, c_mktsegment AS kind, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer) SELECT id, kind, turn FROM k WHERE turn <= CASE kind WHEN 'BUILDING' THEN 20 WHEN 'MACHINERY' THEN 15 ELSE 0 END""")
def quota_sample(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return splitting.take_quotas(rows, {"BUILDING": splitting.quotas(100)["unanswerable"], "MACHINERY": splitting.quotas(100)["multi"]}, ["id"])


@query("""WITH k AS (SELECT doc_id AS id, toxic = 0 AS answerable, row_number() OVER (PARTITION BY toxic = 0 ORDER BY doc_id) AS turn FROM labels) SELECT id, answerable, turn FROM k WHERE turn <= 10""")
def answerable_head(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("answerable"))
    return splitting.head_by_answerable(rows, 20, ["id"])


@query("""WITH f AS (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source), source) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT d.doc_id AS id, d.source AS family, CASE WHEN n > 1 AND p <= greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM documents d JOIN f USING (source)""")
def family_val_split(spark, d):
    return splitting.family_validation(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("family")))


@query("SELECT source, count(DISTINCT doc_id) AS items, round(count(DISTINCT doc_id)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents), 6) AS share FROM documents GROUP BY source HAVING count(DISTINCT doc_id)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) > 0.04")
def share_violations(spark, d):
    got = splitting.share_violations(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), 0.04)
    return got.select("source", "items", rounded("share"))


@query("""WITH u AS (SELECT DISTINCT doc_id + 13 AS id FROM labels WHERE toxic = 1), k AS (SELECT u.id, d.source, d.lang FROM u JOIN documents d ON d.doc_id = u.id)
SELECT id, 'source' AS problem FROM k WHERE source IN ('src1', 'src2') UNION ALL SELECT id, 'family' FROM k WHERE lang = 'de' UNION ALL SELECT id, 'unknown' FROM u WHERE id NOT IN (SELECT doc_id FROM documents)""")
def leakage_semi_anti(spark, d):
    used = table(spark, d, "labels").filter("toxic = 1").select((F.col("doc_id") + 13).alias("id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("family"))
    return splitting.leakage(used, docs, spark.createDataFrame([("src1",), ("src2",)], "source string"), spark.createDataFrame([("de",)], "family string"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_anti_candidates(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    keep = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("c"))
    drop = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return orders.join(keep, "c", "left_semi").join(drop, "id", "left_anti").select("id")


# ------------------------------------------------------------------- review, manifests, resuming


@query("""SELECT b.item_id AS id, CASE WHEN item_id % 4 = 1 THEN 'edited ' || item_id ELSE text END AS question, CASE WHEN item_id % 4 = 1 THEN 'new' ELSE 'old' END AS answer, item_id % 4 <> 3 AS verified FROM benchmark b WHERE item_id % 4 <> 0""")
def decision_merge(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("old").alias("answer"), F.lit(False).alias("verified"))
    action = F.when(F.col("id") % 4 == 0, "delete").when(F.col("id") % 4 == 1, "edit").otherwise("keep")
    decisions = items.filter("id % 4 <> 3").select("id", action.alias("action"), F.concat(F.lit("edited "), F.col("id").cast("string")).alias("question"), F.lit("new").alias("answer"))
    return evaluation.apply_decisions(items, decisions)


@query("""WITH s AS (SELECT DISTINCT source FROM documents UNION SELECT 'missing') SELECT s.source, count(d.doc_id) AS chunks FROM s LEFT JOIN documents d ON d.source = s.source GROUP BY s.source""")
def manifest_chunk_counts(spark, d):
    docs = table(spark, d, "documents")
    manifest = docs.select("source").union(spark.createDataFrame([("missing",)], "source string")).distinct()
    return sinks.chunk_counts(manifest, docs)


@query(f"""SELECT doc, count(*) AS pages, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS chars_per_page, CASE WHEN avg(length(text)) < 2000 THEN 'likely_scanned_skipped' ELSE 'available' END AS status FROM ({PAGES}) GROUP BY doc""")
def manifest_status(spark, d):
    stats = sources.page_stats(pages(spark, d)).withColumn("doc_type", F.lit("final_regulation")).withColumn("error", F.lit(None).cast("string"))
    return sources.manifest_status(stats, 2000.0).select("doc", "pages", "chars", rounded("chars_per_page"), "status")


@query("""WITH k AS (SELECT doc_id, lang AS title, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS z FROM documents)
SELECT doc_id, title, CASE WHEN r = 1 THEN 'downloaded' ELSE 'duplicate_redirect' END AS status FROM k""")
def redirect_dedupe(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), F.col("doc_id").alias("request_pos"))
    return sources.mark_redirects(p).select("doc_id", "title", "status")


@query("SELECT source AS title, max(doc_id) AS pos FROM documents GROUP BY source")
def latest_by_title(spark, d):
    return sinks.latest_by_title(table(spark, d, "documents").select(F.col("source").alias("title"), F.col("doc_id").alias("pos")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumable_pending(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return resumable.pending(docs, table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT s.system, b.item_id AS id FROM benchmark b CROSS JOIN (SELECT 'A' AS system UNION ALL SELECT 'B') s WHERE NOT (s.system = 'A' AND b.item_id % 2 = 0)")
def pending_predictions(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    done = items.filter("id % 2 = 0").select(F.lit("A").alias("system"), "id")
    return resumable.pending_predictions(items, done, spark.createDataFrame([("A",), ("B",)], "system string"))


@query("SELECT event_id AS id, upper(event_type) AS kind FROM events WHERE value >= 0.5")
def resumable_stream(spark, d):
    """All of events through the stream, one file a batch, against the same filter in one go."""
    from textloom.sources.tables import shared_folder, stored

    events = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    kept = stored(events)
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    out = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{abs(hash((d, id(kept))))}"
    resumable.stream(spark, folder, events.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), out, out + "-checkpoint", lambda b: b.filter("value >= 0.5").select("id", F.upper("event_type").alias("kind")), files=100)
    return spark.read.schema("id long, kind string").option("recursiveFileLookup", True).parquet(out + "/records")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return resumable.event_windows(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query()
def training_records(spark, d):
    """The whole training build with the mock generator, over documents as chunks."""
    chunks, train, asked = _build_inputs(spark, d)
    got = records.build_training(chunks, train.filter("NOT ev"), qa.mock_items, unanswerable=asked, target=60, share=0.2)
    return got.select("question", F.size("context").alias("n_context"), "answer", "answerable", "family", "split")


@query()
def evaluation_set(spark, d):
    """The whole evaluation build with the mock generator."""
    chunks, train, asked = _build_inputs(spark, d)
    got = records.build_evaluation(chunks, train.filter("ev"), qa.mock_items, unanswerable=asked, target=20, share=0.3)
    return got.select("id", "question", "category", "answerable", F.size("gold_chunk_ids").alias("n_gold"))


def _build_inputs(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.col("source").alias("family"), F.col("doc_id").alias("pos"))
    split = docs.select("source").distinct().withColumn("ev", F.col("source").isin("src1", "src2", "src3", "src4"))
    features = ["zeppelin insurance", "moon tariffs", "refunds in seashells", "satellite umbrellas"]
    templates = ["Can I get {feature} with my plan?", "Does my provider offer {feature}?", "Is {feature} included?", "Who pays for {feature}?"]
    return chunks, split, qa.unsupported_questions(spark, templates, features)


@query(f"WITH p AS ({PREDICTIONS}) SELECT system, id, round(len(list_filter(list_distinct({WORDS.format('answer')}), lambda w: list_contains({WORDS.format('passage')}, w)))::DOUBLE / greatest(1, len(list_distinct({WORDS.format('answer')}))), 6) AS share FROM p")
def word_overlap(spark, d):
    words = lambda c: F.array_distinct(T.english_words(F.lower(c)))
    p = predictions(spark, d)
    return p.select("system", "id", F.round(F.size(F.array_intersect(words("answer"), words("passage"))) / F.greatest(F.lit(1), F.size(words("answer"))), 6).alias("share"))


@query("WITH k AS (SELECT item_id AS id, text AS question, row_number() OVER (ORDER BY item_id) AS number FROM benchmark WHERE item_id % 3 <> 0) SELECT id, question, number FROM k WHERE number BETWEEN 5 AND 12")
def review_batch(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), (F.col("item_id") % 3 == 0).alias("verified"))
    return evaluation.review_batch(items, 5, 12, ["id"]).select("id", "question", "number")


@query(rf"""WITH g AS (SELECT b.item_id AS query_id, b.text AS question, list(d.doc_id ORDER BY d.doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.item_id % 3 <> 0 GROUP BY b.item_id, b.text),
e AS (SELECT query_id, question, generate_subscripts(gold, 1) - 1 AS place, unnest(gold) AS id FROM g UNION ALL SELECT query_id, question, len(gold) AS place, -1 AS id FROM g)
SELECT query_id, question, place::INT AS place, coalesce(d.source, '?') AS source, coalesce(substr(trim(regexp_replace(d.text, '\s+', ' ', 'g')), 1, 700), '') AS passage FROM e LEFT JOIN documents d ON d.doc_id = e.id""")
def review_passages(spark, d):
    """Unverified items with each gold passage; every item also names a chunk that is not there."""
    items = gold_items(spark, d).filter("query_id % 3 <> 0").withColumn("gold_chunk_ids", F.concat("gold", F.array(F.lit("-1"))))
    return evaluation.with_passages(items, corpus(spark, d)).select("query_id", "question", "place", "source", "passage")


@query("SELECT doc_id AS id, quality FROM labels WHERE toxic = 1")
def verified_items(spark, d):
    items = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", F.when(F.col("toxic") == 1, True).when(F.col("quality") == 1, False).alias("verified"))
    return evaluation.verified(items).select("id", "quality")


# ------------------------------------------------------------------- sinks, written and read again


def round_trip(spark, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    path = new_path(spark, "sink")
    write(path)
    return read(path)


CHUNK_ROWS = "SELECT doc_id::VARCHAR AS id, text, source FROM documents"


def chunk_rows(spark, d) -> DataFrame:
    """Documents in the stored form of chunks."""
    meta = F.struct(*[F.col("source").alias("source") if name == "source" else F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in sources.META.split(", "))])
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", meta.alias("metadata"), F.lit(True).alias("usable_for_qa"), F.lit(None).cast("string").alias("qa_rejection_reason"))


@query(CHUNK_ROWS)
def chunks_parquet(spark, d):
    return round_trip(spark, lambda p: sinks.write_chunks(chunk_rows(spark, d), p), lambda p: sources.read_chunks(spark, p)).select("id", "text", F.col("metadata.source").alias("source"))


@query(CHUNK_ROWS)
def chunks_jsonl(spark, d):
    return round_trip(spark, lambda p: sinks.write_chunks(chunk_rows(spark, d), p + ".jsonl", jsonl=True), lambda p: sources.read_chunks(spark, p + ".jsonl")).select("id", "text", F.col("metadata.source").alias("source"))


@query("SELECT text AS question, CASE WHEN item_id % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM benchmark")
def records_written(spark, d):
    rows = questions(spark, d).select("question", F.when(F.col("query_id") % 4 == 0, "val").otherwise("train").alias("split"))
    return round_trip(spark, lambda p: sinks.write_records(rows, p), lambda p: spark.read.schema("question string, split string").json(p))


@query("SELECT DISTINCT source AS family FROM documents")
def split_document(spark, d):
    """A nested record as one JSON document, and the families read off it."""
    one = table(spark, d, "documents").select(F.col("source").alias("family")).distinct().agg(F.collect_list(F.struct("family")).alias("eval_families"))
    return round_trip(spark, lambda p: sinks.write_json_document(one, p), lambda p: spark.createDataFrame([(f,) for f in sources.read_split(spark, p)], "family string"))


@query("SELECT source, count(*) AS n, true AS stamped FROM documents GROUP BY source")
def manifest_written(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    got = round_trip(spark, lambda p: sinks.write_manifest(rows, p), lambda p: spark.read.schema("source string, n long, retrieved_at string").json(p))
    return got.select("source", "n", F.col("retrieved_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d").alias("stamped"))


@query(f"WITH p AS ({PREDICTIONS}) SELECT system, id, answer FROM p")
def predictions_appended(spark, d):
    """Two appends, the second of which repeats half of the first: one row for each system and item."""
    rows = predictions(spark, d).select("system", "id", "answer")

    def write(path):
        sinks.append_predictions(rows, path)
        sinks.append_predictions(rows.filter("id % 2 = 0"), path)

    return round_trip(spark, write, lambda p: sinks.read_predictions(spark, p))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source")
def metrics_csv(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))
    return round_trip(spark, lambda p: sinks.write_metrics(rows, p), lambda p: spark.read.option("header", True).schema("source string, n long, mean double").csv(p)).select("source", "n", rounded("mean"))


@query(f"WITH {dense_sql(FIRST)} SELECT id, round(score, 6) AS score FROM den WHERE rank <= 10")
def dense_index_stored(spark, d):
    """The dense index written with its model's name, read back under that name and searched."""
    got = round_trip(spark, lambda p: sinks.write_dense_index(vectors(spark, d), p, "test vectors"), lambda p: dense.read_index(spark, p, "test vectors"))
    return dense.search_one(got, got.filter("id = 0").first()["embedding"], 10).select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id::VARCHAR AS id, n_chars < 200 AS usable_for_qa FROM documents")
def table_replaced(spark, d):
    """A table rewritten from itself."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "n_chars")

    def write(path):
        rows.write.parquet(path)
        sinks.replace_table(spark, path, lambda df: df.select("id", (F.col("n_chars") < 200).alias("usable_for_qa")))

    return round_trip(spark, write, lambda p: spark.read.parquet(p))


@query(r"SELECT source, '| ' || source || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY source")
def markdown_metrics(spark, d):
    """The lines of the Markdown table of a metric frame, beside the source of each."""
    text = sinks.markdown_table(table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    return spark.createDataFrame([(line.split(" | ")[0][2:], line) for line in text.splitlines()[2:]], "source string, line string")


@query("SELECT DISTINCT lang AS title FROM documents WHERE lang <> 'en'")
def purged_titles(spark, d):
    files = table(spark, d, "documents").select(F.col("lang").alias("title")).distinct()
    return sources.purge(files, spark.createDataFrame([("en",)], "title string"))


@query("SELECT 'eval-' || lpad((row_number() OVER (ORDER BY item_id))::VARCHAR, 4, '0') AS id, text AS question FROM benchmark")
def renumbered_items(spark, d):
    return evaluation.renumber(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")), ["id"])


@query("""SELECT s.source, rpad(substr('Title of ' || s.source, 1, 56), 56, ' ') || ' ' || rpad('available', 20, ' ') || lpad(format('{:,}', s.chars), 12, ' ') || lpad(format('{:,}', s.n), 8, ' ') AS line
FROM (SELECT source, sum(n_chars)::BIGINT AS chars, count(*) AS n FROM documents GROUP BY source) s""")
def source_table(spark, d):
    docs = table(spark, d, "documents")
    manifest = docs.groupBy("source").agg(F.sum("n_chars").alias("char_count")).select("source", F.concat(F.lit("Title of "), "source").alias("title"), F.lit("available").alias("status"), "char_count")
    return sinks.source_table(manifest, docs)


@query("SELECT doc_id AS id FROM documents WHERE lang <> 'de'")
def drafts_dropped(spark, d):
    units = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "draft_or_consultation").otherwise("final_regulation").alias("doc_type"))
    return cleaning.drop_drafts(units).select("id")


@query("""WITH m AS (SELECT doc_id, 'T' || doc_id AS requested_title, 'Title ' || (doc_id % 50) AS title, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'downloaded' END AS status, 'f' || lpad(doc_id::VARCHAR, 9, '0') AS file FROM documents),
k AS (SELECT 0 AS o, requested_title AS key, file, title FROM m WHERE status = 'downloaded' UNION ALL SELECT 1, title, file, title FROM m WHERE status = 'downloaded')
SELECT key, arg_min(file, o || file) AS file FROM k GROUP BY key""")
def download_cache(spark, d):
    i = F.col("doc_id")
    m = table(spark, d, "documents").select(F.concat(F.lit("T"), i.cast("string")).alias("requested_title"), F.concat(F.lit("Title "), (i % 50).cast("string")).alias("title"), F.lit(None).cast("string").alias("url"), F.when(i % 3 == 0, "error").otherwise("downloaded").alias("status"), F.concat(F.lit("f"), F.lpad(i.cast("string"), 9, "0")).alias("file"))
    return sources.download_cache(m).select("key", "file")


@query("""SELECT doc_id, doc_id AS line_no, 'x' || doc_id AS text, CASE WHEN doc_id % 2 = 0 THEN 'Title' ELSE 'record ' || doc_id END AS source, 'wikipedia' AS source_type, 'encyclopedia' AS doc_type FROM documents""".replace("doc_id, doc_id AS", "doc_id AS"))
def json_record_units(spark, d):
    """JSON lines with a byte order mark and missing fields, made from documents."""
    i = F.col("doc_id")
    value = F.concat(F.lit("\ufeff"), F.to_json(F.struct(F.concat(F.lit("x"), i.cast("string")).alias("text"), F.when(i % 2 == 0, "Title").alias("title"))))
    return sources.json_units(table(spark, d, "documents").select(i.alias("line_no"), value.alias("value"))).select("line_no", "text", "source", "source_type", "doc_type")


@query(f"""WITH {BM25}, h AS (SELECT query_id, count(*) AS n FROM lex WHERE rank <= 3 GROUP BY query_id)
SELECT b.item_id AS query_id, substr(b.text, 1, 40) || ' [1] [9]' AS answer, false AS abstained, 1 AS n_cited, 1 AS n_invalid, coalesce(h.n, 0)::INT AS n_context FROM benchmark b JOIN h ON h.query_id = b.item_id""")
def batch_answers(spark, d):
    """Retrieve, prompt, generate (a deterministic stand-in for a model) and resolve citations for every item."""
    from textloom.service import Answerer

    def model(batch):
        return [f"{m[-1]['content'].rsplit('Question: ', 1)[-1][:40]} [1] [9]" if "[1]" in m[-1]["content"] else fixed.ABSTENTION for m in batch]

    got = Answerer(retriever(spark, d), model, SYSTEM, "Answer directly.").answer(questions(spark, d), "bm25", 3)
    return got.select("query_id", "answer", "abstained", F.size("cited_ids").alias("n_cited"), F.size("invalid_citations").alias("n_invalid"), F.size("context").alias("n_context"))


@query(f"""WITH {BM25} SELECT query_id, rank, rank || '. ' || coalesce(d.source, 'Unknown title') || ' (' || (2000 + d.doc_id % 20) || ', ' || d.lang || ') ' || format('{{:.4f}}', score) || ' | ' || substr(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 1, 200) AS line
FROM lex JOIN documents d ON d.doc_id = id WHERE rank <= 3""")
def search_result_lines(spark, d):
    from textloom.service import result_lines

    hits = lexical.top_k(lexical.bm25_scores(corpus(spark, d), questions(spark, d)), 3)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"), (2000 + F.col("doc_id") % 20).alias("year"), F.col("lang").alias("family"))
    return result_lines(hits.join(docs, "id"))


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents")
def seeded_shuffle(spark, d):
    """A shuffle that every engine repeats, numbered without a global sort in one task."""
    from textloom.operators.numbering import numbered

    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id")).withColumn("h", splitting.seeded(42, F.col("id")))
    return numbered(rows, [], ["h", "id"], "place").select("id", "place")


@query("""SELECT doc_id, '{"lang": "' || lang || '", "n_chars": ' || n_chars || ', "source": "' || source || '"}' AS json, substr(sha256('{"lang": "' || lang || '", "n_chars": ' || n_chars || ', "source": "' || source || '"}'), 1, 16) AS key FROM documents""")
def canonical_json_keys(spark, d):
    j = T.canonical_json({"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")})
    return table(spark, d, "documents").select("doc_id", j.alias("json")).withColumn("key", F.substring(F.sha2("json", 256), 1, 16))
