"""Chunks: recursive splitting, packing with overlap, fixed windows, content ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered

#: The default tokenizer: white-space runs, word runs and single marks, which concatenate to the text.
LEXICAL = re.compile(r"\s+|\w+|[^\w\s]")
_SEPARATORS = [re.compile(p) for p in (r"\n\s*\n", r"(?<=[.!?])\s+", r"\s+")]


def lexical_tokens(text: str) -> list[str]:
    return LEXICAL.findall(text)


def _pieces(text: str, separator: re.Pattern) -> list[str]:
    """``text`` cut behind each separator; a separator stays with the piece on its left."""
    out, at = [], 0
    for m in separator.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [p for p in [*out, text[at:]] if p.strip()]


def split_recursive(text: str, limit: int, tokenize: Callable[[str], list[str]] = lexical_tokens) -> Iterator[list[str]]:
    """Token lists of at most ``limit``: by paragraphs, else sentences, else white space, else token windows."""
    stack = [text]
    while stack:
        piece = stack.pop()
        tokens = tokenize(piece)
        if len(tokens) <= limit:
            yield tokens
            continue
        for separator in _SEPARATORS:
            parts = _pieces(piece, separator)
            if len(parts) > 1 and all(len(p) < len(piece) for p in parts):
                stack += reversed(parts)
                break
        else:
            for at in range(0, len(tokens), limit):
                yield tokens[at : at + limit]


def pack(pieces: Iterator[list[str]], size: int, overlap: int) -> Iterator[str]:
    """Chunks of at most ``size`` tokens; each begins with the last ``overlap`` tokens of the one before."""
    current: list[str] = []

    def emit() -> Iterator[str]:
        text = "".join(current)
        if text.strip():
            yield text.strip()

    for piece in pieces:
        if current and len(current) + len(piece) > size:
            yield from emit()
            current = current[-overlap:] if overlap else []
        rest = piece
        while rest:
            room = size - len(current)
            current, rest = current + rest[:room], rest[room:]
            if rest:
                yield from emit()
                current = current[-overlap:] if overlap else []
    if current:
        yield from emit()


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")


def chunk_texts(units: DataFrame, *, size: int = 512, overlap: int = 64, tokenize: Callable[[str], list[str]] = lexical_tokens) -> DataFrame:
    """One row per chunk: the unit's columns but text, then chunk_pos and text. Chunks never cross units."""
    check_sizes(size, overlap)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(pack(split_recursive(t.strip(), size, tokenize), size, overlap)) if t and t.strip() else [] for t in texts])

    rest = [c for c in units.columns if c != "text"]
    return units.select(*rest, F.posexplode(run("text")).alias("chunk_pos", "text"))


def with_ids(chunks: DataFrame, metadata: Column, order: list[str]) -> DataFrame:
    """chunks with id: 16 hex digits of the SHA-256 of metadata, text and occurrence number.

    The occurrence number counts equal (metadata, text) in ``order``, which must tell rows apart,
    from 0. Only the digests and places of chunks that occur twice or more are numbered, by ranges, so texts do
    not move for it and a very common chunk is not one task's work.
    """
    keyed = chunks.withColumn("_meta", metadata)
    narrow = keyed.select(F.sha2(F.concat_ws("\n", "_meta", "text"), 256).alias("_d"), *order)
    twice = narrow.groupBy("_d").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_d")
    later = numbered(narrow.join(twice, "_d", "left_semi"), ["_d"], order, "_n").filter("_n > 1").select(*[F.col(c).alias(f"_o_{c}") for c in order], "_n")
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = keyed.join(later, same, "left")
    body = F.concat_ws("\n", "_meta", "text", (F.coalesce("_n", F.lit(1)) - 1).cast("string"))
    return joined.withColumn("id", F.substring(F.sha2(body, 256), 1, 16)).drop("_meta", "_n", *[f"_o_{c}" for c in order])


def stable_id(metadata: dict, text: str, occurrence: int) -> str:
    """The same id for a single chunk on the driver."""
    body = f"{json.dumps(metadata, sort_keys=True, ensure_ascii=False)}\n{text}\n{occurrence}"
    return hashlib.sha256(body.encode("utf-8")).hexdigest()[:16]


def fixed_windows(tokens: DataFrame, limit: int) -> DataFrame:
    """(id, window, tokens) of (id, tokens): windows of ``limit`` tokens without overlap, as an expression."""
    starts = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(limit))
    some = tokens.filter(F.size("tokens") > 0)
    return some.select("id", F.posexplode(F.transform(starts, lambda i: F.slice("tokens", i + 1, F.lit(limit)))).alias("window", "tokens"))


def size_sweep(units: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """Chunks and mean characters for each (size, overlap)."""
    out = None
    for size, overlap in sizes:
        one = chunk_texts(units, size=size, overlap=overlap).agg(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.count(F.lit(1)).alias("chunks"), F.avg(F.length("text")).alias("mean_chars"))
        out = one if out is None else out.unionAll(one)
    return out
