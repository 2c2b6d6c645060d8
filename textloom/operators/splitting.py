"""Splits, quotas and samples without leakage between training and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import qa
from textloom.operators.numbering import numbered


def seeded(seed: int | str, key: Column) -> Column:
    """A shuffle key that every engine computes alike."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def document_stats(chunks: DataFrame) -> DataFrame:
    """(source, family, source_type, chunks); a source with two families is an error raised on reading."""
    grouped = chunks.groupBy("source").agg(F.min("family").alias("family"), F.max("family").alias("_other"), F.min("source_type").alias("source_type"), F.count(F.lit(1)).alias("chunks"))
    one = F.when(F.col("family").eqNullSafe(F.col("_other")) & F.col("family").isNotNull(), F.col("family")).otherwise(F.raise_error(F.concat(F.lit("a source needs exactly one family: "), "source")).cast("string"))
    return grouped.withColumn("family", one).drop("_other")


def family_stats(documents: DataFrame) -> DataFrame:
    wiki = F.col("source_type") == "wikipedia"
    return documents.groupBy("family").agg(
        F.sum("chunks").alias("chunks"),
        F.coalesce(F.sum(F.when(wiki, F.col("chunks"))), F.lit(0)).alias("wiki_chunks"),
        F.count_distinct(F.when(wiki, F.col("source"))).alias("wiki_sources"),
        F.count_distinct("source").alias("sources"),
    )


def split_families(chunks: DataFrame, *, eval_fraction: float = 0.2, preserved: list[str] | None = None, regulations: list[str] = (), mandatory: list[str] = (), operators: list[str] = (), most: int = 20) -> DataFrame:
    """(family, chunks, split): the subset of families that makes the best evaluation part.

    A subset must hold the mandatory families that exist, at least three of the regulation families (all if
    fewer exist) and one operator family (if any are named), at most two encyclopedia pages, at most 15 % encyclopedia chunks, and no
    family above 30 % of it. Best is the least distance to the target share, then the smallest
    encyclopedia share, then the fewest families, then the smallest list of names.

    The 2^n subsets of plain families are a range with one bit a family, so the search itself is a
    distributed scan; beyond ``most`` plain families it is refused. ``preserved`` names the families of an
    earlier split, which then stay.
    """
    spark = chunks.sparkSession
    families = family_stats(document_stats(chunks)).orderBy("family")
    if preserved is not None:
        if not preserved:
            raise ValueError("the preserved families are empty")
        named = spark.createDataFrame([(f,) for f in sorted(set(preserved))], "family string")
        missing = [r["family"] for r in named.join(families, "family", "left_anti").orderBy("family").collect()]
        if missing:
            raise ValueError(f"preserved families without chunks: {missing}")
        split = F.when(F.col("_in").isNotNull(), "eval").otherwise("train").alias("split")
        return families.join(named.withColumn("_in", F.lit(True)), "family", "left").select("family", "chunks", split)
    chosen = _best_subset(spark, families.collect(), eval_fraction, set(regulations), set(mandatory), set(operators), most)
    return families.select("family", "chunks", F.when(F.col("family").isin(sorted(chosen)), "eval").otherwise("train").alias("split"))


def _best_subset(spark: SparkSession, rows: list, fraction: float, regulations: set[str], mandatory: set[str], operators: set[str], most: int) -> set[str]:
    plain = [r for r in rows if not r["wiki_sources"]]
    wiki = [r for r in rows if r["wiki_sources"]]
    if len(plain) > most:
        raise ValueError(f"{len(plain)} plain families; at most {most} can be enumerated")
    pairs = [()] + [(w,) for w in wiki] + [(a, b) for i, a in enumerate(wiki) for b in wiki[i + 1 :]]
    options = spark.createDataFrame([([w["family"] for w in p], sum(w["chunks"] for w in p), sum(w["wiki_chunks"] for w in p), sum(w["wiki_sources"] for w in p), max((w["chunks"] for w in p), default=0)) for p in pairs], "wf array<string>, wc long, ww long, ws long, wm long").filter("ws <= 2")
    total = sum(r["chunks"] for r in rows)
    bit = lambda i: F.getbit(F.col("id"), F.lit(i)) == 1
    pick = lambda value: sum((F.when(bit(i), F.lit(int(value(r)))).otherwise(0) for i, r in enumerate(plain)), F.lit(0))
    have = {r["family"] for r in rows}
    masks = spark.range(1 << len(plain))
    for i, r in enumerate(plain):
        if r["family"] in mandatory:
            masks = masks.filter(bit(i))
    if regulations & have:
        masks = masks.filter(pick(lambda r: r["family"] in regulations) >= min(3, len(regulations & have)))
    if operators:
        masks = masks.filter(pick(lambda r: r["family"] in operators) >= 1)
    largest = F.greatest(F.lit(0), F.lit(0), *[F.when(bit(i), F.lit(int(r["chunks"]))).otherwise(0) for i, r in enumerate(plain)])
    named = F.filter(F.array(F.lit(None).cast("string"), *[F.when(bit(i), F.lit(r["family"])) for i, r in enumerate(plain)]), lambda x: x.isNotNull())
    masks = masks.select(named.alias("pf"), pick(lambda r: r["chunks"]).cast("long").alias("pc"), largest.cast("long").alias("pm"))
    # every mask meets the few encyclopedia options: an explode of a literal array, no join
    opts = [F.struct(F.array(*[F.lit(x) for x in o["wf"]]).cast("array<string>").alias("wf"), F.lit(o["wc"]).alias("wc"), F.lit(o["ww"]).alias("ww"), F.lit(o["wm"]).alias("wm")) for o in options.collect()]
    each = masks.select("*", F.explode(F.array(*opts)).alias("o"))
    size = F.col("pc") + F.col("o.wc")
    each = each.withColumn("n", size).filter((F.col("n") > 0) & (F.col("o.ww") * 100 <= F.col("n") * 15) & (F.greatest("pm", "o.wm") * 100 <= F.col("n") * 30))
    scored = each.select(F.array_sort(F.concat("pf", "o.wf")).alias("f"), F.abs(F.col("n") - total * fraction).alias("d"), (F.col("o.ww") / F.col("n")).alias("w"))
    best = scored.orderBy("d", "w", F.size("f"), "f").limit(1).collect()
    if not best:
        raise ValueError("no subset of families meets the constraints")
    return set(best[0]["f"])


def split_summary(split: DataFrame) -> DataFrame:
    """One row: total and evaluation chunks with shares and the family lists, as a nested record."""
    ev = F.col("split") == "eval"
    total = F.sum("chunks")
    return split.agg(
        total.alias("total_chunks"), F.sum(F.when(ev, F.col("chunks")).otherwise(0)).alias("eval_chunks"),
        (F.sum(F.when(ev, F.col("chunks")).otherwise(0)) / total).alias("eval_share"),
        F.sort_array(F.collect_list(F.when(ev, F.struct("family", "chunks")))).alias("eval_families"),
        F.sort_array(F.collect_list(F.when(~ev, F.col("family")))).alias("train_families"),
    )


def cap_per_document(rows: DataFrame, cap: int, seed: int, id_col: str = "id") -> DataFrame:
    """At most ``cap`` rows of each source, in seeded order."""
    w = Window.partitionBy("source").orderBy(seeded(seed, F.col(id_col)), id_col)
    return rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= cap)


def document_cap(target: int, share: float) -> int:
    return max(1, int(target * share))


def round_robin(rows: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """rows with turn (within the source) and place: one row of each source a turn, sources in seeded order.

    Both numbers come from range-partitioned numbering, so neither a large source nor the first
    turns, which hold every source, are one task's work.
    """
    shuffled = rows.withColumn("_h", seeded(seed, F.col(id_col))).withColumn("_order", seeded(seed, F.col("source")))
    turned = numbered(shuffled, ["source"], ["_h", id_col], "turn")
    return numbered(turned, [], ["turn", "_order", "source"], "place").drop("_h", "_order")


def quotas(target: int, *, unanswerable: float = 0.2, multi: float = 0.15) -> dict[str, int]:
    """Rows of each kind, halves to even."""
    u, m = round(target * unanswerable), round(target * multi)
    return {"unanswerable": u, "multi": m, "single": target - u - m}


def take_quotas(rows: DataFrame, quota: dict[str, int], order: list[str]) -> DataFrame:
    """The first rows of each kind, up to its quota."""
    w = Window.partitionBy("kind").orderBy(*order)
    limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))]), F.col("kind")), F.lit(0))
    return rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= limit)


def head_by_answerable(rows: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """Half of ``limit`` answerable rows, the rest not."""
    w = Window.partitionBy("answerable").orderBy(*order)
    most = F.when(F.col("answerable"), F.lit(limit // 2)).otherwise(F.lit(limit - limit // 2))
    return rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= most)


def family_validation(records: DataFrame, *, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """records with split: whole families go to validation, at least one if there are two or more."""
    families = records.select("family").distinct()
    n = families.agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(seeded(seed, F.col("family")), "family"))
    wanted = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.bround(F.col("n") * fraction, 0).cast("int"))).otherwise(0)
    marked = families.withColumn("_p", place).join(F.broadcast(n)).select("family", F.when(F.col("_p") <= wanted, "val").otherwise("train").alias("split"))
    return records.join(marked, "family")


def share_violations(items: DataFrame, most: float) -> DataFrame:
    """(source, items, share): sources with more than ``most`` of all items; empty if the cap holds."""
    total = items.agg(F.count_distinct("id").alias("total"))
    return items.groupBy("source").agg(F.count_distinct("id").alias("items")).join(F.broadcast(total)).withColumn("share", F.col("items") / F.col("total")).filter(F.col("share") > most).select("source", "items", "share")


def adjacent_pairs(chunks: DataFrame) -> DataFrame:
    """(source, first, second): neighbours 1+2, 3+4, ... of each source."""
    placed = numbered(chunks.select("source", "pos", "id"), ["source"], ["pos", "id"], "_n").withColumn("_g", F.floor((F.col("_n") - 1) / 2))
    pairs = placed.groupBy("source", "_g").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("p")).filter(F.size("p") == 2)
    return pairs.select("source", F.col("p")[0]["id"].alias("first"), F.col("p")[1]["id"].alias("second"))


def family_pairs(chunks: DataFrame) -> DataFrame:
    """(family, first, second): a family's first chunk with the first chunk of each of its other sources."""
    heads = chunks.groupBy("source").agg(F.min(F.struct("pos", "id", "family")).alias("h")).select("source", "h.id", "h.family")
    low = heads.groupBy("family").agg(F.min(F.struct("source", "id")).alias("f"))
    return heads.join(low, "family").filter(F.col("source") != F.col("f.source")).select("family", F.col("f.id").alias("first"), F.col("id").alias("second"))


def leakage(train_ids: DataFrame, chunks: DataFrame, eval_sources: DataFrame, eval_families: DataFrame) -> DataFrame:
    """(id, problem): training chunks of an evaluation source or family, and ids that no chunk has."""
    used = train_ids.select("id").distinct()
    known = used.join(chunks.select("id", "source", "family"), "id")
    by_source = known.join(eval_sources.select("source"), "source", "left_semi").select("id", F.lit("source").alias("problem"))
    by_family = known.join(eval_families.select("family"), "family", "left_semi").select("id", F.lit("family").alias("problem"))
    unknown = used.join(chunks.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    return by_source.unionAll(by_family).unionAll(unknown)


def require_clean(found: DataFrame) -> None:
    some = [f"{r['id']}: {r['problem']}" for r in found.limit(20).collect()]
    if some:
        raise ValueError("leakage: " + ", ".join(some))


def closest_questions(evaluation: DataFrame, training: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, train_id, ratio): each evaluation question's most similar training question above the threshold."""
    pairs = qa.similar_pairs(evaluation, training, threshold)
    w = Window.partitionBy("a").orderBy(F.desc("ratio"), "b")
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("a").alias("id"), F.col("b").alias("train_id"), "ratio")
