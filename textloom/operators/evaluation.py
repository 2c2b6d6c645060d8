"""Metrics of retrieval, answers and the score gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scoring as S
from textloom.functions import text as T


def ranked_lists(hits: DataFrame) -> DataFrame:
    """(query_id, ranked): ids in rank order."""
    return hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("ranked"))


def per_query(items: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """items (query_id, gold) with the ranked list of each ``keys`` group; an item without hits has an empty list."""
    lists = hits.groupBy(*keys, "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("ranked"))
    groups = lists.select(*keys).distinct()
    grid = items.join(F.broadcast(groups))  # a handful of modes
    return grid.join(lists, [*keys, "query_id"], "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))


def retrieval_metrics(ranked: DataFrame, keys: list[str], chunk_meta: DataFrame | None = None, latency: DataFrame | None = None) -> DataFrame:
    """By group: n, hits at 1, 3, 5 and 10, the Wilson interval of hit@5, recall at 5 and 10, mrr at 10.

    With ``chunk_meta`` (id, source, family) also same_source_5 and same_family_5: an unknown
    chunk counts as "?", which can match itself. With ``latency`` (keys, query_id, latency_ms) also latency_mean.
    """
    first = S.first_gold_rank(F.col("ranked"), F.col("gold"), 10)
    rows = ranked.withColumn("first", first)
    hit = lambda k: F.count_if(F.col("first") <= k)
    lo, hi = S.wilson(hit(5), F.count(F.lit(1)))
    aggregates = [
        F.count(F.lit(1)).alias("n"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(5).alias("hit_5"), hit(10).alias("hit_10"), lo.alias("hit_5_low"), hi.alias("hit_5_high"),
        F.avg(S.recall_at(F.col("ranked"), F.col("gold"), 5)).alias("recall_5"), F.avg(S.recall_at(F.col("ranked"), F.col("gold"), 10)).alias("recall_10"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr_10"),
    ]
    if chunk_meta is not None:
        rows = _with_groups(rows, keys, chunk_meta)
        aggregates += [F.count_if(F.arrays_overlap("gold_source", "top_source")).alias("same_source_5"), F.count_if(F.arrays_overlap("gold_family", "top_family")).alias("same_family_5")]
    if latency is not None:
        rows = rows.join(latency.select(*keys, "query_id", "latency_ms"), [*keys, "query_id"], "left")
        aggregates.append(F.avg("latency_ms").alias("latency_mean"))
    return rows.groupBy(*keys).agg(*aggregates)


def _with_groups(rows: DataFrame, keys: list[str], meta: DataFrame) -> DataFrame:
    meta = meta.select(F.col("id").cast("string").alias("id"), "source", "family")
    out = rows
    for name, ids in (("gold", F.col("gold")), ("top", F.slice("ranked", 1, 5))):
        flat = rows.select(*keys, "query_id", F.explode(ids).alias("id")).join(meta, "id", "left")
        sets = flat.groupBy(*keys, "query_id").agg(F.collect_set(F.coalesce("source", F.lit("?"))).alias(f"{name}_source"), F.collect_set(F.coalesce("family", F.lit("?"))).alias(f"{name}_family"))
        out = out.join(sets, [*keys, "query_id"], "left")
    return out


def first_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The per-question table: first gold rank (null if none) and the question's first 100 characters."""
    return ranked.select(*keys, "query_id", S.first_gold_rank(F.col("ranked"), F.col("gold"), 10).alias("first_gold_rank"), F.substring("question", 1, 100).alias("question"))


def evidence_hits(hits: DataFrame, corpus: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """By group: questions whose evidence (any quote) is in a text of the first 1, 3, 5 and 10 ranks."""
    texts = hits.join(corpus.select("id", "text"), "id").join(items.select("query_id", "evidence"), "query_id")
    found = texts.withColumn("_in", S.any_quote_in(F.col("evidence"), F.array("text")))
    first = found.groupBy(*keys, "query_id").agg(F.min(F.when(F.col("_in"), F.col("rank"))).alias("first"))
    return first.groupBy(*keys).agg(*[F.count_if(F.col("first") <= k).alias(f"evidence_{k}") for k in (1, 3, 5, 10)])


def answer_metrics(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """By system, over the items that have a prediction: counts, token F1, containment, citation and
    refusal shares, unsupported share and latency (mean, nearest-rank 95 %).

    predictions (system, id, answer, abstained, cited_ids, retrieved_ids, context, latency_ms);
    items (id, answerable, reference_answer, gold).
    """
    p = predictions.join(items, "id")
    yes = F.col("answerable")
    judged = yes & (F.size("context") > 0) & ~F.col("abstained")
    return p.groupBy("system").agg(
        F.count_if(yes).alias("n_answerable"), F.count_if(~yes).alias("n_unanswerable"),
        F.coalesce(F.avg(F.when(yes, S.token_f1(F.col("answer"), F.col("reference_answer")))), F.lit(0.0)).alias("token_f1"),
        F.coalesce(F.avg(F.when(yes, S.containment(F.col("answer"), F.col("reference_answer")))), F.lit(0.0)).alias("containment"),
        F.count_if(yes & F.arrays_overlap("gold", "retrieved_ids")).alias("retrieval_hits"),
        F.count_if(yes & F.arrays_overlap("gold", "cited_ids")).alias("cited_gold"),
        F.count_if(yes & F.col("abstained")).alias("false_refusals"), F.count_if(~yes & F.col("abstained")).alias("correct_refusals"),
        F.coalesce(F.avg(F.when(judged, S.unsupported(F.col("answer"), F.col("context")))), F.lit(0.0)).alias("unsupported"),
        F.avg("latency_ms").alias("latency_mean"), S.nearest_rank(F.collect_list("latency_ms")).alias("latency_p95"),
    )


def nearest_rank_by(rows: DataFrame, key: str, value: str, q: float = 0.95) -> DataFrame:
    """(key, n, value at index round(q * (n - 1))) without gathering a group.

    Equal values are counted first; a running count over the distinct values of a key then finds
    the one that holds the wanted index.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(value)
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    at = F.bround(F.lit(q) * (F.col("n") - 1), 0)
    return run.filter((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(key, "n", F.col(value).alias("value"))


def evidence_split(predictions: DataFrame) -> DataFrame:
    """By system and whether the evidence was retrieved: questions, refusals, answers that cite it."""
    return predictions.groupBy("system", "present").agg(F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("refused"), F.count_if(~F.col("abstained") & F.col("cited_ok")).alias("cited"))


def auroc(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, auroc) of (score, positive): the share of pairs ranked rightly, ties half; NaN if a side is empty.

    By average ranks: scores are counted first, so the window runs over distinct scores only.
    """
    keys = list(keys)
    counts = scores.groupBy(*keys, "score").agg(F.count_if("positive").cast("double").alias("p"), F.count_if(~F.col("positive")).cast("double").alias("n"))
    w = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = counts.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0.0)))
    total = won.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return total.select(*keys, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.try_divide("u", F.col("np") * F.col("nn"))).otherwise(F.lit(float("nan"))).alias("auroc"))


def best_threshold(scores: DataFrame) -> DataFrame:
    """(balance, threshold, tpr, tnr): the cut with the best mean of TPR and TNR; the lowest of equal ones.

    Candidates are one below the least score, the midpoints of neighbouring distinct scores, and
    one above the largest; a score of at least the threshold counts as positive.
    """
    counts = scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    w = Window.orderBy("score")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("next", F.lead("score").over(w)).withColumn("p_below", F.sum("p").over(upto)).withColumn("n_below", F.sum("n").over(upto))
    cuts = run.select(F.when(F.col("next").isNull(), F.col("score") + 1).otherwise((F.col("score") + F.col("next")) / 2).alias("threshold"), "p_below", "n_below")
    lowest = scores.agg((F.min("score") - 1).alias("threshold"), F.lit(0).cast("long").alias("p_below"), F.lit(0).cast("long").alias("n_below"))
    totals = scores.agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    every = cuts.unionAll(lowest).join(F.broadcast(totals))  # one row of totals
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rated = every.withColumn("tpr", share(F.col("np") - F.col("p_below"), F.col("np"))).withColumn("tnr", share(F.col("n_below"), F.col("nn")))
    rated = rated.withColumn("balance", (F.col("tpr") + F.col("tnr")) / 2)
    return rated.orderBy(F.desc(F.round("balance", 12)), "threshold").limit(1).select("balance", "threshold", "tpr", "tnr")


def gate_groups(rows: DataFrame, threshold: float | Column) -> DataFrame:
    """By group: n, refusals by the gate (score below the threshold), refusals overall, answers that cite the evidence.

    rows (answerable, present, score, abstained, cited_ok).
    """
    group = F.when(~F.col("answerable"), "unanswerable").when(F.col("present"), "answerable_evidence_in").otherwise("answerable_evidence_absent")
    gated = F.col("score") < threshold
    refused = gated | F.coalesce("abstained", F.lit(False))
    return rows.withColumn("group", group).groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gated).alias("gate_refused"), F.count_if(refused).alias("refused"),
        F.count_if((F.col("group") == "answerable_evidence_in") & ~refused & F.coalesce("cited_ok", F.lit(False))).alias("cited"),
    )


def verified(items: DataFrame) -> DataFrame:
    """The items that a review has confirmed."""
    return items.filter(F.coalesce("verified", F.lit(False)))


def gate_inputs(ranked: DataFrame, corpus: DataFrame, items: DataFrame, top: int = 5) -> DataFrame:
    """items (query_id, answerable, evidence, ...) with score, that of rank 1 (null without hits), and present:
    is some quote of the evidence in a text of the first ``top`` ranks?"""
    shown = ranked.filter(F.col("rank") <= top).join(corpus.select("id", "text"), "id").join(items.select("query_id", "evidence"), "query_id")
    found = shown.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(S.any_quote_in(F.col("evidence"), F.array("text"))).alias("_in"))
    return items.join(found, "query_id", "left").withColumn("present", F.coalesce("_in", F.lit(False))).drop("_in")


def score_gate(tuning: DataFrame, judged: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cut, groups): the threshold found on one set of items, and what it does to another.

    Both sets come from ``gate_inputs``. A question is to be answered if it is answerable and its
    evidence was found. One without hits has no score: it takes no part in the tuning, and the gate
    refuses it. predictions (query_id, abstained, cited_ids, retrieved_ids, context: the texts of
    retrieved_ids); an answer cites the evidence if a cited id's text holds a quote.
    """
    rated = tuning.filter("score IS NOT NULL").select("score", (F.col("answerable") & F.col("present")).alias("positive"))
    cut = best_threshold(rated)
    told = lambda c: F.get("context", (F.array_position("retrieved_ids", c) - 1).cast("int"))
    cited = F.exists("cited_ids", lambda c: (F.array_position("retrieved_ids", c) > 0) & S.any_quote_in(F.col("evidence"), F.array(told(c))))
    rows = judged.join(predictions, "query_id", "left").withColumn("cited_ok", F.coalesce(cited, F.lit(False)))
    rows = rows.join(F.broadcast(cut.select("threshold")))  # one row
    return cut, gate_groups(rows.withColumn("score", F.coalesce("score", F.lit(float("-inf")))), F.col("threshold"))


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items after review: deleted ones go, edited ones take the new question and answer, all others that were judged are verified."""
    d = decisions.select("id", "action", F.col("question").alias("_q"), F.col("answer").alias("_a"))
    joined = items.join(d, "id", "left").filter(~F.col("action").eqNullSafe(F.lit("delete")))
    edit = F.col("action").eqNullSafe(F.lit("edit"))
    return joined.withColumn("question", F.when(edit, F.coalesce("_q", "question")).otherwise(F.col("question"))).withColumn("answer", F.when(edit, F.coalesce("_a", "answer")).otherwise(F.col("answer"))).withColumn("verified", F.coalesce("verified", F.lit(False)) | F.col("action").isNotNull()).drop("action", "_q", "_a")


def renumber(items: DataFrame, order: list[str]) -> DataFrame:
    """id becomes eval-0001, eval-0002, ... in ``order``: an evaluation set is small and read by people."""
    return items.withColumn("id", F.format_string("eval-%04d", F.row_number().over(Window.orderBy(*order))))


def review_batch(items: DataFrame, first: int, last: int, order: list[str]) -> DataFrame:
    """The unverified items numbered first to last."""
    n = F.row_number().over(Window.orderBy(*order))
    return items.filter("NOT verified").withColumn("number", n).filter(F.col("number").between(first, last))


def with_passages(items: DataFrame, corpus: DataFrame, chars: int = 700) -> DataFrame:
    """items for a reviewer, one row a gold id: place, source ("?" if the chunk is unknown) and the passage's first ``chars`` characters."""
    each = items.select("*", F.posexplode_outer("gold_chunk_ids").alias("place", "chunk_id"))
    texts = corpus.select(F.col("id").cast("string").alias("chunk_id"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    joined = each.join(texts, "chunk_id", "left")
    return joined.withColumn("source", F.coalesce("_source", F.lit("?"))).withColumn("passage", T.snippet(F.coalesce("_text", F.lit("")), chars)).drop("_source", "_text")
