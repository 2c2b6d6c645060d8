"""String functions as column expressions. ``(?U)`` makes Java's classes Unicode aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import fixed


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def clean_text(c: Column) -> Column:
    """LF line ends, single blanks, no blanks around line ends, at most one empty line, stripped."""
    lf = F.regexp_replace(c, r"\r\n?", "\n")
    blanks = F.regexp_replace(lf, r"[ \t\f\x0B]+", " ")
    around = F.regexp_replace(blanks, r" *\n *", "\n")
    return strip(F.regexp_replace(around, r"\n{3,}", "\n\n"))


def collapse(c: Column) -> Column:
    """Each run of white space becomes one space; stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    """For comparisons that ignore case and white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", " "))


def snippet(c: Column, n: int) -> Column:
    return F.substring(collapse(c), 1, n)


def furniture_key(c: Column) -> Column:
    """A page line without its numbers and spacing, for finding running heads."""
    return F.lower(F.regexp_replace(collapse(c), r"(?U)\d+", "#"))


def tokens(c: Column) -> Column:
    return extract(F.lower(c), fixed.TOKEN)


def answer_tokens(c: Column) -> Column:
    return extract(F.regexp_replace(F.lower(c), r"\[\d+\]", " "), fixed.ANSWER_TOKEN)


def english_words(c: Column) -> Column:
    return extract(c, fixed.ENGLISH_WORD)


def numbers(c: Column) -> Column:
    return extract(c, "(?U)" + fixed.NUMBER)


def lines(c: Column) -> Column:
    """The stripped non-empty lines."""
    return F.filter(F.transform(F.split(c, r"\R|[\x1c-\x1e]"), strip), lambda x: x != "")


def slug_filename(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(slug, F.lit(".txt"))


def family_slug(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.upper(title), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(slug == "", F.lit("UNKNOWN")).otherwise(slug)


def title_from_stem(stem: Column) -> Column:
    """``initcap`` over blanks: after a digit or an apostrophe a letter stays as it is."""
    return F.initcap(F.trim(F.translate(stem, "_-", "  ")))


def url_last_part(url: Column) -> Column:
    return F.url_decode(F.element_at(F.split(url, "/"), -1))


def url_quote(c: Column) -> Column:
    return F.regexp_replace(F.url_encode(c), r"\+", "%20")


def has_phone(line: Column) -> Column:
    return F.exists(extract(line, fixed.PHONE), lambda m: F.length(F.regexp_replace(m, r"\D", "")) >= 10)


def is_page_number(line: Column, page_index: Column) -> Column:
    """``Page 3 of 9``, ``3/9``, or a bare number that is the page's own; never ``17 of 1933.``"""
    s = strip(line)
    bare = F.try_to_number(F.regexp_extract(s, fixed.BARE_NUMBER, 1), F.lit("9999"))
    named = s.rlike(fixed.NAMED_PAGE)
    return ~s.rlike(fixed.ACT_FRAGMENT) & s.rlike(fixed.PAGE_NUMBER) & (named | F.coalesce(bare == page_index + 1, F.lit(False)))


def format_passage(number: Column, title: Column, year: Column, text: Column) -> Column:
    """``[n] title (year)`` and the text below it."""
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown title")))
    return F.concat(head, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("year unknown")), F.lit(")\n"), strip(F.coalesce(text, F.lit(""))))


def citation_numbers(answer: Column) -> Column:
    """Cited passage numbers, each once, in order of first citation; null for one too large to be a number."""
    return F.array_distinct(F.transform(extract(answer, fixed.CITATION, 1), lambda x: x.try_cast("int")))


def abstained_exactly(answer: Column) -> Column:
    return strip(answer) == fixed.ABSTENTION


def mentions_abstention(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(fixed.ABSTENTION.lower()))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object of strings and numbers with sorted keys and the separators ``", "`` and ``": "``."""
    value = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$"), F.lit('{"v":null}'))
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(F.nullif(F.regexp_extract(value(c), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("")), F.lit("null"))) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ", "), F.lit("}"))


def content_id(metadata_json: Column, text: Column, occurrence: Column) -> Column:
    """16 hex digits that name a chunk by its content and its occurrence number."""
    return F.substring(F.sha2(F.concat_ws("\n", metadata_json, text, occurrence.cast("string")), 256), 1, 16)
