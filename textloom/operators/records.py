"""Whole builds: training records and evaluation sets from chunks and a question generator."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scoring as S
from textloom.functions import text as T
from textloom.operators import lexical, qa, ranking, splitting
from textloom.sources.tables import stored


def candidate_items(chunks: DataFrame, generator: Callable[[str, int], list[dict]], valid: Callable[..., Column] = qa.valid_record) -> DataFrame:
    """Generated items of chunks with a place that are ``valid``: (id, source, family, text, question, answer, evidence, place)."""
    made = qa.generate(chunks.select("id", "text"), generator, 1).select("id", "items")
    each = chunks.join(made, "id").select("id", "source", "family", "text", "place", F.explode(qa.valid_items(F.col("items"), F.col("text"))).alias("i"))
    flat = each.select("id", "source", "family", "text", "place", F.col("i.question").alias("question"), F.col("i.answer").alias("answer"), F.col("i.evidence").alias("evidence"))
    return flat.filter(valid(F.col("question"), F.col("answer"), F.col("evidence"), F.col("text")))


def accepted_items(chunks: DataFrame, generator: Callable[[str, int], list[dict]], wanted: int, cap: int, seed: int, threshold: float | None = None, valid: Callable[..., Column] = qa.valid_record) -> DataFrame:
    """The first ``wanted`` accepted items in round-robin order of sources, with pos; fewer only if there are no more.

    Accepted are valid items, unlike all before them if a ``threshold`` is given, and at most ``cap`` a
    source. Acceptance looks back only, so a window of chunks is enough that yields ``wanted``: it grows
    until it does or holds all usable chunks.
    """
    placed = stored(splitting.round_robin(chunks.filter("usable_for_qa"), seed))
    total, most = placed.count(), 4 * wanted
    while True:
        items = stored(candidate_items(placed.filter(F.col("place") <= most), generator, valid).withColumn("pos", F.col("place").cast("long")))
        kept = items if threshold is None else items.join(qa.greedy_distinct(items.select("id", "pos", F.col("question").alias("text")), threshold).filter("accepted").select("pos"), "pos")
        turn = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
        kept = stored(kept.withColumn("turn", turn).filter(F.col("turn") <= cap).orderBy("pos").limit(wanted))
        if most >= total or kept.count() >= wanted:
            return kept
        most *= 4


def build_training(chunks: DataFrame, train_sources: DataFrame, generator: Callable[[str, int], list[dict]], *, unanswerable: DataFrame | None = None, target: int = 2000, seed: int = 42, share: float = 0.15, negatives: int = 3, threshold: float = 0.88) -> DataFrame:
    """Training records: question, context (ids), answer, evidence, gold_chunk_ids, answerable, family, split.

    BM25 statistics come from all chunks; negatives must be usable training chunks other than the
    gold one. Questions too like an earlier one are left out. ``unanswerable`` (question, phrase)
    fills 15 % of the target with questions whose phrase no retrieved chunk holds.
    """
    annotated = stored(qa.annotate(chunks))
    train = annotated.join(train_sources.select("source"), "source", "left_semi")
    quota = splitting.quotas(target, unanswerable=0.15, multi=0.0)
    items = accepted_items(train, generator, quota["single"], splitting.document_cap(target, share), seed, threshold)
    queries = items.select(F.col("pos").alias("query_id"), "question")
    hits = lexical.top_k(lexical.bm25_scores(annotated.select("id", "text"), queries), 100)
    gold = items.select(F.col("pos").alias("query_id"), "id")
    bad = annotated.filter("NOT usable_for_qa").select("id")
    mined = ranking.hard_negatives(hits, gold, train.select("id"), bad, negatives + 1)
    lists = mined.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("neg"))
    rows = items.join(lists, F.col("pos") == F.col("query_id"), "left").withColumn("neg", F.coalesce("neg", F.array().cast("array<string>"))).withColumn("split", F.lit("all"))
    rows = qa.context_plan(rows, ["pos"])
    neg = F.slice("neg", 1, F.when(F.col("five_context"), negatives + 1).otherwise(negatives))
    record = qa.sft_record(F.col("id"), neg, F.col("answer"), F.concat(F.lit(f"{seed}:"), F.col("pos").cast("string")), gold_last=F.col("gold_last"))
    answered = rows.withColumn("r", record).select("question", F.col("r.context").alias("context"), F.col("r.answer").alias("answer"), "evidence", F.array("id").alias("gold_chunk_ids"), F.lit(True).alias("answerable"), "family")
    out = splitting.family_validation(answered, seed=seed)
    if unanswerable is not None:
        asked = stored(unanswerable.withColumn("query_id", F.xxhash64("question")))
        found = lexical.top_k(lexical.bm25_scores(annotated.select("id", "text"), asked), 10)
        clean = ranking.phrase_absent(found, annotated, asked).filter("absent").select("query_id")
        from textloom.functions.fixed import ABSTENTION

        context = found.join(train.select("id"), "id", "left_semi").groupBy("query_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), 1, negatives + 1).alias("context"))
        empty = asked.join(clean, "query_id").join(context, "query_id", "left").orderBy(splitting.seeded(seed, F.col("question")), "question").limit(quota["unanswerable"])
        no = F.array().cast("array<string>")
        out = out.unionByName(empty.select("question", F.coalesce("context", no).alias("context"), F.lit(ABSTENTION).alias("answer"), no.alias("evidence"), no.alias("gold_chunk_ids"), F.lit(False).alias("answerable"), F.lit("UNANSWERABLE").alias("family"), F.lit("train").alias("split")))
    return out


def build_evaluation(chunks: DataFrame, eval_sources: DataFrame, generator: Callable[[str, int], list[dict]], *, unanswerable: DataFrame, target: int = 100, seed: int = 42, share: float = 0.15) -> DataFrame:
    """An evaluation set of exactly ``target`` items, or an error: 20 % unanswerable, 15 % over two neighbouring chunks, the rest over one.

    id, question, reference_answer, evidence, gold_chunk_ids, answerable, category, verified.
    """
    annotated = stored(qa.annotate(chunks))
    part = annotated.join(eval_sources.select("source"), "source", "left_semi")
    quota = splitting.quotas(target)
    single = accepted_items(part, generator, quota["single"], splitting.document_cap(target, share), seed, valid=functools.partial(qa.valid_eval_item, multi=False))
    one = single.select("question", F.col("answer").alias("reference_answer"), "evidence", F.array("id").alias("gold_chunk_ids"), F.lit(True).alias("answerable"), F.lit("single").alias("category"))
    texts = part.select("id", "text")
    pairs = splitting.adjacent_pairs(part.filter("usable_for_qa")).join(texts.select(F.col("id").alias("first"), F.col("text").alias("t1")), "first").join(texts.select(F.col("id").alias("second"), F.col("text").alias("t2")), "second")
    pairs = pairs.select(F.concat_ws("|", "first", "second").alias("id"), "first", "second", F.concat_ws("\n\n", "t1", "t2").alias("text"))
    made = pairs.join(qa.generate(pairs.select("id", "text"), generator, 1).select("id", "items"), "id").withColumn("i", F.get("items", F.lit(0))).filter("i IS NOT NULL")
    both = F.concat(T.strip(F.regexp_replace("i.answer", r"\s*\[\d+\]", "")), F.lit(" [1] [2]"))
    made = made.filter(qa.valid_eval_item(F.col("i.question"), both, F.col("i.evidence"), F.col("text"), multi=True))
    two = made.orderBy(splitting.seeded(seed, F.col("id")), "id").limit(quota["multi"])
    two = two.select(F.col("i.question").alias("question"), both.alias("reference_answer"), F.col("i.evidence").alias("evidence"), F.array("first", "second").alias("gold_chunk_ids"), F.lit(True).alias("answerable"), F.lit("multi").alias("category"))
    asked = stored(unanswerable.withColumn("query_id", F.xxhash64("question")))
    found = lexical.top_k(lexical.bm25_scores(annotated.select("id", "text"), asked), 10)
    free = ranking.phrase_absent(found, annotated, asked).filter("absent").select("query_id")
    from textloom.functions.fixed import ABSTENTION

    no = F.array().cast("array<string>")
    none = asked.join(free, "query_id").orderBy(splitting.seeded(seed, F.col("question")), "question").limit(quota["unanswerable"]).select("question", F.lit(ABSTENTION).alias("reference_answer"), no.alias("evidence"), no.alias("gold_chunk_ids"), F.lit(False).alias("answerable"), F.lit("unanswerable").alias("category"))
    out = stored(one.unionByName(two).unionByName(none).withColumn("verified", F.lit(False)).withColumn("id", F.sha2("question", 256)))
    n = out.count()
    if n != target:
        raise ValueError(f"{n} items could be made, {target} are wanted")
    from textloom.operators.evaluation import renumber

    return renumber(out, ["category", "id"])


def grounded(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """records with overlap: how much of the answer its gold chunks support."""
    flat = records.withColumn("_r", F.xxhash64("question", "answer")).select("*", F.explode("gold_chunk_ids").alias("_g"))
    joined = flat.join(corpus.select(F.col("id").alias("_g"), "text"), "_g")
    return joined.groupBy("question", "answer").agg(F.max(S.support_overlap(F.col("answer"), F.col("text"))).alias("overlap"))
