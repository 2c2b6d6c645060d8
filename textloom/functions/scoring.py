"""Numeric functions of ranking and evaluation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions import text as T


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def normalise(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    return F.transform(d, lambda x: x / F.greatest(norm2(d), F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share, clamped to [0, 1]."""
    p = hits / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - spread), F.least(F.lit(1.0), centre + spread)


def share_text(hits: Column, n: Column) -> Column:
    """``k/n (p%)`` with p rounded half to even."""
    percent = F.bround(100.0 * hits / F.greatest(n, F.lit(1)), 0).cast("long")
    return F.concat(hits.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)"))


def nearest_rank(values: Column, q: float = 0.95) -> Column:
    """The value at index round(q * (n - 1)), half to even, of an array; 0 for an empty one."""
    s = F.sort_array(values)
    at = F.least(F.size(s) - 1, F.bround(F.lit(q) * (F.size(s) - 1), 0).cast("int"))
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.get(s, at))


def counts_of(xs: Column) -> Column:
    return F.map_from_entries(F.transform(F.array_distinct(xs), lambda t: F.struct(t, F.size(F.filter(xs, lambda x: x == t)))))


def shared_tokens(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two short token arrays."""
    common = F.array_intersect(a, b)
    return F.aggregate(common, F.lit(0), lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))


def token_f1(answer: Column, reference: Column) -> Column:
    a, r = T.answer_tokens(answer), T.answer_tokens(reference)
    common = shared_tokens(a, r)
    precision, recall = common / F.size(a), common / F.size(r)
    return F.when(common == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def _counted(tokens: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in fixed.ANSWER_STOP])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def containment(answer: Column, reference: Column) -> Column:
    """The share of the reference's tokens, stop words aside and repeats kept, that the answer has."""
    ref, ans = _counted(T.answer_tokens(reference)), T.answer_tokens(answer)
    return F.when(F.size(ref) == 0, F.lit(0.0)).otherwise(F.size(F.filter(ref, lambda t: F.array_contains(ans, t))) / F.size(ref))


def unsupported(answer: Column, passages: Column) -> Column:
    """The share of the answer's tokens, stop words aside, that no passage has."""
    ans, ctx = _counted(T.answer_tokens(answer)), T.answer_tokens(F.array_join(passages, " "))
    return F.when(F.size(ans) == 0, F.lit(0.0)).otherwise(F.size(F.filter(ans, lambda t: ~F.array_contains(ctx, t))) / F.size(ans))


def support_overlap(answer: Column, text: Column) -> Column:
    """The share of an answer's distinct words, stop words aside, that a text has."""
    stop = F.array(*[F.lit(w) for w in fixed.OVERLAP_STOP])
    words = lambda c: F.array_except(F.array_distinct(T.english_words(F.lower(c))), stop)
    a = words(answer)
    return F.size(F.array_intersect(a, words(text))) / F.greatest(F.lit(1), F.size(a))


def all_quotes_in(quotes: Column, text: Column) -> Column:
    """Every quote, ignoring case and spacing, is in the text; false without quotes; an empty quote is in any text."""
    return (F.size(quotes) > 0) & F.forall(quotes, lambda q: F.contains(T.norm(text), T.norm(T.strip(q))))


def any_quote_in(quotes: Column, passages: Column) -> Column:
    """Some non-empty quote is in some passage."""
    return F.exists(quotes, lambda q: (T.strip(q) != "") & F.exists(passages, lambda p: F.contains(T.norm(p), T.norm(T.strip(q)))))


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.slice(ranked, 1, k), g)) / F.size(g))


def first_gold_rank(ranked: Column, gold: Column, k: int = 10) -> Column:
    """The rank from 1 of the first relevant id among the first k; null if there is none."""
    hits = F.filter(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull())
    return F.array_min(hits)
