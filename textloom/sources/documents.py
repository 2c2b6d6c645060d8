"""Document sources: HTML, Markdown, text, JSON lines, page texts, a paged REST API."""

from __future__ import annotations

import time
import urllib.parse
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.functions import fixed
from textloom.functions import text as T
from textloom.operators.numbering import numbered

META = "source string, source_type string, page int, section array<string>, doc_type string, year int, doc_title string, family string, license_note string, retrieved_at string"
CHUNK = f"id string, text string, metadata struct<{META.replace(' ', ':').replace(',:', ',')}>, usable_for_qa boolean, qa_rejection_reason string"


# ------------------------------------------------------------------- HTML


class _Page(HTMLParser):
    """Text, title and headings of a page, without the parts that are not content."""

    SKIP = {"script", "style", "noscript", "nav", "footer", "header"}
    HEADS = {"h1", "h2", "h3"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipping: list[str] = []
        self.open: str | None = None
        self.parts: list[str] = []
        self.title, self.headings = "", []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.SKIP:
            self.skipping.append(tag)
        elif not self.skipping and (tag in self.HEADS or tag == "title"):
            self.open = tag
            if tag in self.HEADS:
                self.headings.append("")

    def handle_endtag(self, tag: str) -> None:
        if self.skipping and tag == self.skipping[-1]:
            self.skipping.pop()
        elif tag == self.open:
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.open == "title":
            self.title += data
        elif self.open:
            self.headings[-1] += data
        if data.strip():
            self.parts.append(data.strip())


def parse_page(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    flat = lambda s: " ".join(s.split())
    return {"title": flat(p.title) or None, "headings": [h for h in map(flat, p.headings) if h], "text": "\n".join(p.parts)}


@F.pandas_udf(TY.StructType([TY.StructField("title", TY.StringType()), TY.StructField("headings", TY.ArrayType(TY.StringType())), TY.StructField("text", TY.StringType())]))
def html_fields(pages: pd.Series) -> pd.DataFrame:
    rows = [parse_page(p) for p in pages]
    return pd.DataFrame({k: [r[k] for r in rows] for k in ("title", "headings", "text")})


def html_units(pages: DataFrame, source: Column, html: Column) -> DataFrame:
    """(source, doc_title, section, text): one unit a page that has text."""
    got = pages.select(source.alias("source"), html_fields(html).alias("p"))
    units = got.select("source", F.col("p.title").alias("doc_title"), F.col("p.headings").alias("section"), T.clean_text("p.text").alias("text"))
    return units.filter("text != ''")


# ------------------------------------------------------------------- Markdown, text, JSON lines


def markdown_units(files: DataFrame) -> DataFrame:
    """(source, section_no, section, text) of (source, text): one unit a heading, the part before the first under the file's name."""
    lines = files.select("source", F.posexplode(F.split("text", r"\R")).alias("pos", "line"))
    head = F.col("line").rlike(fixed.HEADING)
    numbered = lines.withColumn("section_no", F.sum(head.cast("int")).over(Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("source", "section_no").agg(
        F.max(F.when(head, T.strip(F.regexp_extract("line", fixed.HEADING, 1)))).alias("heading"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~head, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    stem = F.translate(F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", ""), "_", " ")
    return grouped.select("source", F.col("section_no").cast("int").alias("section_no"), F.coalesce("heading", stem).alias("section"), T.clean_text("body").alias("text")).filter("text != ''")


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(source, text) of whole files, found recursively; excluded and manifest files are left out, unreadable ones too."""
    got = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).text(folder, wholetext=True)
    named = got.select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return named.filter(~F.contains(F.lower("source"), F.lit("excluded")) & ~F.lower("source").endswith("manifest.json"))


def with_positions(units: DataFrame) -> DataFrame:
    """units with unit_pos: their place in the order of source, and of page where there is one."""
    order = [c for c in ("source", "page", "section_no") if c in units.columns]
    return numbered(units, [], order, "unit_pos").withColumn("unit_pos", F.col("unit_pos") - 1)


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def page_texts(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc, page, text) of binaryFile rows by an injected extractor; a file that it fails on has one row with error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    pages, error = extract(content), None
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    pages, error = [None], f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"doc": path, "page": range(len(pages)), "text": pages, "error": error})

    return files.select("path", "content").mapInPandas(run, "doc string, page int, text string, error string")


def page_stats(pages: DataFrame) -> DataFrame:
    """(doc, pages, chars, chars_per_page)."""
    return pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.avg(F.length("text")).alias("chars_per_page"))


def manifest_status(stats: DataFrame, least: float = 200.0) -> DataFrame:
    """stats (doc, doc_type, pages, chars_per_page, error) with status."""
    status = F.when(F.col("error").isNotNull(), "parse_error").when(F.col("doc_type").eqNullSafe(F.lit("draft_or_consultation")), "excluded_draft").when(F.coalesce("chars_per_page", F.lit(0.0)) < least, "likely_scanned_skipped").otherwise("available")
    return stats.withColumn("status", status)


def json_units(lines: DataFrame) -> DataFrame:
    """Units of JSON records (value): text, title, url and defaults for what is missing; a broken line has _corrupt_record."""
    schema = TY.StructType([TY.StructField(n, TY.StringType()) for n in ("text", "title", "url", "source", "source_type", "doc_type", "section", "license_note", "retrieved_at")])
    r = lines.select("line_no", F.from_json(F.regexp_replace("value", "^﻿", ""), schema.add("_corrupt_record", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("line_no", "r.*")
    name = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("record "), F.col("line_no").cast("string")))
    return r.select(
        "line_no", T.clean_text(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("source", "url", name).alias("source"), F.coalesce("source_type", F.lit("wikipedia")).alias("source_type"),
        F.coalesce("doc_type", F.lit("encyclopedia")).alias("doc_type"), F.array(F.coalesce("section", name)).alias("section"), "_corrupt_record",
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows from Parquet, or JSON lines by the explicit schema."""
    return spark.read.schema(CHUNK).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def read_split(spark: SparkSession, path: str) -> list[str]:
    """The evaluation families of an earlier split file."""
    rows = spark.read.schema("eval_families array<struct<family:string>>").option("multiLine", True).json(path)
    return sorted(r["f"] for r in rows.select(F.explode("eval_families.family").alias("f")).collect())


def download_cache(manifest: DataFrame) -> DataFrame:
    """(key, file, title): where a title's file is, by requested title, actual title or the title in its URL, in this order."""
    good = manifest.filter(F.col("status").isin("downloaded", "cached", "duplicate_redirect") & F.col("file").isNotNull())
    keys = F.array(F.struct(F.lit(0).alias("o"), F.col("requested_title").alias("key")), F.struct(F.lit(1).alias("o"), F.col("title").alias("key")), F.struct(F.lit(2).alias("o"), F.translate(T.url_last_part("url"), "_", " ").alias("key")))
    flat = good.select("file", "title", F.explode(keys).alias("k")).filter("k.key IS NOT NULL AND k.key != ''")
    return flat.groupBy(F.col("k.key").alias("key")).agg(F.min(F.struct("k.o", "file", "title")).alias("m")).select("key", "m.file", "m.title")


def mark_redirects(pages: DataFrame) -> DataFrame:
    """pages (title, request_pos, ...) with status: the first request of a title is downloaded, later ones are duplicates."""
    w = Window.partitionBy("title").orderBy("request_pos")
    return pages.withColumn("status", F.when(F.row_number().over(w) == 1, "downloaded").otherwise("duplicate_redirect"))


def purge(files: DataFrame, dropped: DataFrame) -> DataFrame:
    return files.join(dropped.select("title"), "title", "left_anti")


# ------------------------------------------------------------------- a REST API of pages


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds of a Retry-After header: a number or an HTTP date."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    return max(0.0, (at - (now or datetime.now(UTC))).total_seconds())


class PoliteClient:
    """Calls ``get(title, timeout)`` -> (status, headers, body) with a least interval and retries.

    With a ``budget`` the client makes at most so many calls. 429 and 5xx are tried again after Retry-After, else after 1, 2, 4, ... seconds.
    """

    def __init__(self, get: Callable, *, retries: int = 4, interval: float = 1.0, budget: int | None = None, timeout: float = 30.0, sleep: Callable = time.sleep, clock: Callable = time.monotonic):
        self.get, self.retries, self.interval, self.timeout, self.sleep, self.clock = get, retries, interval, timeout, sleep, clock
        self.last: float | None = None
        self.budget, self.calls = budget, 0

    def fetch(self, title: str):
        for attempt in range(self.retries + 1):
            if self.last is not None and (wait := self.interval - (self.clock() - self.last)) > 0:
                self.sleep(wait)
            if self.budget is not None and self.calls >= self.budget:
                raise OSError(f"{title}: the budget of {self.budget} calls is spent")
            self.calls += 1
            self.last = self.clock()
            status, headers, body = self.get(title, self.timeout)
            if status == 200:
                return body
            if attempt == self.retries or not (status == 429 or status >= 500):
                raise OSError(f"{title}: HTTP {status}")
            wait = retry_after(headers.get("Retry-After"))
            self.sleep(2.0**attempt if wait is None else wait)
        raise AssertionError("unreachable")


class PagesSource(DataSource):
    """``spark.read.format("pages_api").option("titles", "a|b")``: one partition, so that the rate limit holds."""

    client_factory: Callable[[], PoliteClient] | None = None

    @classmethod
    def name(cls) -> str:
        return "pages_api"

    def schema(self) -> str:
        return "request_pos int, requested_title string, title string, url string, text string, status string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options, type(self).client_factory)


class _PagesReader(DataSourceReader):
    def __init__(self, options, factory):
        self.titles = [t for t in options.get("titles", "").split("|") if t]
        self.factory = factory

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        client = self.factory()
        for i, title in enumerate(self.titles):
            try:
                page = client.fetch(title)
                url = page.get("url") or "https://" + urllib.parse.quote(title.replace(" ", "_"))
                yield i, title, page.get("title", title), url, page.get("text", ""), "downloaded", None
            except Exception as e:  # noqa: BLE001  one failed page is a row, not the end
                yield i, title, title, None, None, "error", str(e)
