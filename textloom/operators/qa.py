"""Question answering data: rejection rules, evidence, citations, prompts, records, near-duplicates."""

from __future__ import annotations

import difflib
import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from textloom.functions import fixed
from textloom.functions import scoring as S
from textloom.functions import text as T


def rejection_reason(text: Column, family: Column) -> Column:
    """Why a chunk is no source of questions, or null; the first rule that holds."""
    body = F.coalesce(text, F.lit(""))
    rows = T.lines(body)
    words, numbers = F.size(T.english_words(body)), F.size(T.numbers(body))
    count = lambda test: F.size(F.filter(rows, test))
    toc = F.coalesce(F.get(rows, F.lit(0)), F.lit("")).rlike(fixed.TOC_LINE) & ((count(lambda x: x.rlike(fixed.TOC_ENTRY)) >= 2) | (words < 100))
    reach = count(lambda x: x.rlike(fixed.EMAIL) | T.has_phone(x))
    places = count(lambda x: x.rlike(fixed.ADDRESS_LINE))
    contacts = (F.size(rows) >= 3) & F.exists(rows, lambda x: x.rlike(fixed.CONTACT_LINE)) & ((reach >= 4) | (places >= 4))
    table_rows = count(lambda x: F.size(T.numbers(x)) >= 4)
    share = numbers / F.greatest(F.lit(1), words + numbers)
    tabular = ((numbers >= 20) & (share >= 0.6)) | ((table_rows >= 4) & (table_rows / F.greatest(F.lit(1), F.size(rows)) >= 0.25))
    return (
        F.when((F.upper(F.coalesce(family, F.lit(""))) == "QOS") & body.rlike(fixed.DISCUSSION), "qos_stakeholder_discussion")
        .when(toc, "table_of_contents_or_index")
        .when(contacts, "address_or_contact_list")
        .when(tabular, "mostly_numbers_or_tables")
        .when(words < 40, "under_40_words")
    )


def annotate(chunks: DataFrame) -> DataFrame:
    """chunks (text, family, ...) with qa_rejection_reason and usable_for_qa."""
    return chunks.withColumn("qa_rejection_reason", rejection_reason(F.col("text"), F.col("family"))).withColumn("usable_for_qa", F.col("qa_rejection_reason").isNull())


def quality_report(annotated: DataFrame) -> DataFrame:
    """Usable and unusable chunks by source."""
    return annotated.groupBy("source").agg(F.count_if("usable_for_qa").alias("usable"), F.count_if(~F.col("usable_for_qa")).alias("unusable"))


def rejection_examples(annotated: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("qa_rejection_reason").orderBy("id")
    return annotated.filter("NOT usable_for_qa").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def valid_items(items: Column, text: Column) -> Column:
    """Generated items (question, answer, evidence) that are complete and whose quotes all stand in the text word for word."""
    ok = lambda i: (T.strip(i["question"]) != "") & (T.strip(i["answer"]) != "") & (F.size(i["evidence"]) > 0) & F.forall(i["evidence"], lambda q: (T.strip(q) != "") & F.contains(text, q))
    return F.filter(items, ok)


def valid_record(question: Column, answer: Column, evidence: Column, text: Column) -> Column:
    """Supported by its evidence and words, and short enough: 40 question and 120 answer words."""
    count = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return S.all_quotes_in(evidence, text) & (S.support_overlap(answer, text) >= 0.2) & (count(question) <= 40) & (count(answer) <= 120)


def valid_eval_item(question: Column, answer: Column, evidence: Column, text: Column, *, multi: bool) -> Column:
    """An item for evaluation cites passage 1 (and 2 if ``multi``) and asks with 2 to 40 words."""
    expected = F.array(*[F.lit(i) for i in ((1, 2) if multi else (1,))])
    cites = T.citation_numbers(answer)
    count = F.size(F.filter(F.split(question, r"(?U)\s+"), lambda w: w != ""))
    return (F.size(F.array_except(expected, cites)) == 0) & (count >= 2) & valid_record(question, answer, evidence, text)


def resolve_citations(answers: DataFrame) -> DataFrame:
    """answers (answer, context: array of ids) with abstained, cited_ids and invalid_citations."""
    ns = T.citation_numbers(F.col("answer"))
    inside = lambda n: (n >= 1) & (n <= F.size("context"))
    return answers.withColumn("abstained", T.abstained_exactly(F.col("answer"))).withColumn("cited_ids", F.transform(F.filter(ns, inside), lambda n: F.element_at("context", n))).withColumn("invalid_citations", F.filter(ns, lambda n: n.isNull() | ~inside(n)))


def prompt(question: Column, context: Column, system: str, *, use_context: bool = True) -> Column:
    """Chat messages; ``context`` is an array of structs (title, year, text)."""
    asked = T.strip(question)
    if use_context:
        body = F.transform(context, lambda c, i: T.format_passage(i + 1, c["title"], c["year"], c["text"]))
        passages = F.when(F.size(context) > 0, F.array_join(body, "\n\n")).otherwise(fixed.NO_PASSAGES)
        asked = F.concat(F.lit("Context passages:\n"), passages, F.lit("\n\nQuestion: "), asked)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", asked))


def training_text(messages: Column, answer: Column, eos: str = "</s>") -> Column:
    """A row of training text: the messages by role, the answer, the end mark."""
    head = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")
    return F.concat(head, F.lit("\n<|assistant|>\n"), answer, F.lit(eos))


def within_length(rows: DataFrame, text: Column, limit: int) -> DataFrame:
    """Rows of at most ``limit`` tokens; an empty result is an error."""
    kept = rows.filter(F.size(T.extract(text, r"\s+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")) <= limit)
    if kept.isEmpty():
        raise ValueError(f"no row has at most {limit} tokens")
    return kept


def sft_record(gold: Column, negatives: Column, answer: Column, seed: Column, *, gold_last: Column | bool = False) -> Column:
    """struct(context, answer): gold and negatives in a seeded order (or gold last), the answer citing gold's place.

    The order is by a hash of seed and id, the same on every engine. Citations that the answer
    already has are dropped first. Without gold (null) the answer stays as it is.
    """
    mixed = F.array_sort(
        F.transform(F.concat(F.when(gold.isNotNull(), F.array(gold)).otherwise(F.array().cast("array<string>")), negatives), lambda c: F.struct(F.sha2(F.concat_ws(":", seed, c), 256).alias("h"), c.alias("id"))),
    )
    order = F.transform(mixed, lambda x: x["id"])
    last = gold_last if isinstance(gold_last, Column) else F.lit(gold_last)
    order = F.when(last & gold.isNotNull(), F.concat(F.filter(order, lambda x: x != gold), F.array(gold))).otherwise(order)
    bare = T.strip(F.regexp_replace(answer, r"\s*\[\d+\]", ""))
    cited = F.when(gold.isNull(), answer).otherwise(F.concat(bare, F.lit(" ["), F.array_position(order, gold).cast("string"), F.lit("]")))
    return F.struct(order.alias("context"), cited.alias("answer"))


def context_plan(records: DataFrame, order: list[str]) -> DataFrame:
    """Every tenth record gets five contexts, the one after it its gold last."""
    i = F.row_number().over(Window.partitionBy("split").orderBy(*order)) - 1
    return records.withColumn("five_context", F.pmod(i, F.lit(10)) == 0).withColumn("gold_last", F.pmod(i, F.lit(10)) == 1)


# ------------------------------------------------------------------- similar questions


def ratio(a: str, b: str) -> float:
    """The matching-block ratio of two strings, ignoring case; not symmetric."""
    return difflib.SequenceMatcher(None, a.casefold(), b.casefold()).ratio()


@F.pandas_udf(TY.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, *, same: bool = False) -> DataFrame:
    """(a, b, ratio) with ratio(left text, right text) >= threshold; left and right are (id, text).

    Lossless: a ratio of r needs at least r * (total length) / 2 common characters. Lengths within
    the band 2 * min / (la + lb) >= r fall into the same or the next logarithmic length bucket, so
    the pairs come from an equi-join on buckets; a bound on the multiset of characters then
    drops most of them before the sequence matcher runs.
    """
    width = math.log((2 - threshold) / threshold) or 1e-6
    prepare = lambda d: d.select("id", F.lower("text").alias("text"), F.length("text").alias("n")).withColumns({"hist": histogram(F.lower("text")), "bucket": F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / width).cast("int")})
    a = prepare(left).select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("n").alias("na"), F.col("hist").alias("ha"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = prepare(right).select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("n").alias("nb"), F.col("hist").alias("hb"), "bucket")
    pairs = a.join(b, "bucket").filter(2 * F.least("na", "nb") >= threshold * (F.col("na") + F.col("nb")) - 1e-9)
    if same:
        pairs = pairs.filter("a < b")
    common = sum((F.least(F.get("ha", F.lit(i)), F.get("hb", F.lit(i))) for i in range(len(_LETTERS) + 1)), F.lit(0))
    pairs = pairs.filter(common * 2 >= threshold * (F.col("na") + F.col("nb")) - 1e-9)
    return pairs.withColumn("ratio", ratio_udf("ta", "tb")).filter(F.col("ratio") >= threshold).select("a", "b", "ratio")


_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def histogram(text: Column) -> Column:
    """Counts of a to z, of spaces and of all else: the sum of the smaller counts bounds the common characters from above."""
    n = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LETTERS]
    return F.array(*n, F.length(text) - sum(n, F.lit(0)))


def greedy_distinct(questions: DataFrame, threshold: float = 0.88) -> DataFrame:
    """questions (id, pos, text) with accepted: in order of pos, each that is unlike all accepted before.

    The pairs are found by ``similar_pairs``; the order-dependent pass then runs over each
    connected group of pairs, not over all questions: questions without a similar one are accepted
    in place.
    """
    by_pos = questions.select(F.col("pos").alias("id"), "text")
    links = similar_pairs(by_pos, by_pos, threshold, same=True).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    from textloom.operators.graph import components  # the groups of linked questions

    groups = components(links.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    roots = groups.select(F.col("node").alias("hi"), "root").unionAll(groups.select(F.col("root").alias("hi"), "root").distinct())
    edges = links.join(roots, "hi")

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for lo, hi in zip(f["lo"], f["hi"], strict=True):
            near.setdefault(int(hi), []).append(int(lo))
        accepted: set[int] = set()
        for pos in sorted(set(f["lo"]) | set(f["hi"])):
            if not any(p in accepted for p in near.get(int(pos), ())):
                accepted.add(int(pos))
        nodes = sorted(set(f["lo"]) | set(f["hi"]))
        return pd.DataFrame({"pos": nodes, "_ok": [int(p) in accepted for p in nodes]})

    judged = edges.groupBy("root").applyInPandas(walk, "pos long, _ok boolean")
    return questions.join(judged, "pos", "left").withColumn("accepted", F.coalesce("_ok", F.lit(True))).drop("_ok")


# ------------------------------------------------------------------- generators


def first_json_array(response: str) -> list[dict]:
    """The first JSON array of objects in a model's answer; empty if there is none."""
    decoder = json.JSONDecoder()
    at = response.find("[")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(response, at)
        except ValueError:
            value = None
        if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
            return value
        at = response.find("[", at + 1)
    return []


ITEM = TY.ArrayType(TY.StructType([TY.StructField("question", TY.StringType()), TY.StructField("answer", TY.StringType()), TY.StructField("evidence", TY.ArrayType(TY.StringType()))]))


@F.pandas_udf(ITEM)
def parse_items(responses: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[dict]:
        out = []
        for x in first_json_array(text or ""):
            e = x.get("evidence")
            out.append({"question": str(x.get("question") or ""), "answer": str(x.get("answer") or ""), "evidence": [e] if isinstance(e, str) else [str(q) for q in e or []]})
        return out

    return pd.Series([one(t) for t in responses])


def generate(chunks: DataFrame, generator: Callable[[str, int], list[dict]], n: int = 1, cache: DataFrame | None = None, model: str = "mock") -> DataFrame:
    """(key, id, items): a generator of question items over (id, text), through a cache keyed by model, n and text."""
    key = F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(n)), "text"), 256)
    keyed = chunks.select("id", "text", key.alias("key"))

    @F.pandas_udf(ITEM)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([generator(t or "", n) for t in texts])

    if cache is None:
        return keyed.select("key", "id", run("text").alias("items"))
    known = keyed.join(cache.select("key", "items"), "key").select("key", "id", "items")
    return known.unionByName(keyed.join(cache.select("key"), "key", "left_anti").select("key", "id", run("text").alias("items")))


def mock_items(text: str, n: int) -> list[dict]:
    """Snippets of 100 characters, each with a question on the first word that occurs once."""
    words = text.split()
    seen: dict[str, int] = {}
    for w in words:
        k = w.strip(".,;:!?").lower()
        seen[k] = seen.get(k, 0) + 1
    topic = next((w.strip(".,;:!?") for w in words if len(w) > 3 and seen[w.strip(".,;:!?").lower()] == 1), "this")
    out = []
    for i in range(n):
        quote = text[i * 100 : (i + 1) * 100].strip()
        if quote:
            out.append({"question": f"What do the documents say about {topic}?", "answer": f"{quote} [1]", "evidence": [quote]})
    return out


def unsupported_questions(spark, templates: list[str], features: list[str]) -> DataFrame:
    """(question, phrase): every template with every feature; both are short literal lists."""
    return spark.createDataFrame([(t.replace("{feature}", f), f) for f in features for t in templates], "question string, phrase string")
