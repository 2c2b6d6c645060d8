"""BPE encoding and decoding with a pair occurrence index over each batch's distinct words."""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table

#: Fixed values of the vocabulary's own file format: byte-to-character alphabet bounds.
_PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = {b for lo, hi in _PRINTABLE for b in range(lo, hi + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Known:
    """Words and their ids. The ids lie in one array: a word costs little beside its string."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def add(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat])

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at ``places``, one after the other, and their numbers."""
        starts = self.ends[places]
        sizes = self.ends[places + 1] - starts
        return self.flat[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)], sizes


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` JSON file of the kind BPE with word ends.

    The file names the normaliser (NFC, white space to one space, lower case), the pre-token
    pattern, the merges and the special tokens; this class carries them out by itself.
    """

    def __init__(self, spec: dict, max_words: int = 400_000):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.base = max(self.vocab.values()) + 1
        self.rank: dict[int, int] = {}  # of a pair (a, b), as a * base + b
        self.merges: list[tuple[int, int, int]] = []  # by rank: a, b and what they make
        for r, (a, b) in enumerate(model["merges"]):
            self.merges.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
            self.rank.setdefault(self.vocab[a] * self.base + self.vocab[b], r)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.latin_pattern = latin(pattern)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_start = os.path.commonprefix(list(self.special))  # "" is in every text
        self.alphabet = byte_alphabet()
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.strings = [pa.array([f(i) for i in range(max(self.text_of) + 1)], pa.string()) for f in (str, lambda i: self.text_of.get(i, ""))]
        self.byte_ids = np.array([[self.vocab[c + e] for c in self.alphabet] for e in ("", self.end)])
        #: Rank of two neighbouring bytes, -1 for none; [1] where the second ends its word.
        self.byte_ranks = np.array([[self.rank.get(a * self.base + b, -1) for a in self.byte_ids[0].tolist() for b in ids] for ids in self.byte_ids.tolist()])
        self.max_words = max_words
        self.known, self.older = self.specials(), self.specials()  # older: words not met since ``known`` was last full

    def specials(self) -> Known:
        """Special tokens are words with a blank before them: no other word holds white space."""
        out = Known()
        out.add([" " + t for t in self.special], np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64))
        return out

    # encoding of distinct words -------------------------------------------------------------

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after the other, and their numbers. All words lie in one array of symbols, with no pair across words.

        Every adjacent pair is indexed to all its positions. Ranks that occur are taken in
        ascending order from a heap; a rank's positions are merged from left to right and only
        the lists of the neighbouring pairs change. A pair that a merge makes always has a later
        rank than the merge, or else re-enters the heap, so each word ends as it would alone.
        """
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        data = [w.encode("utf-8") for w in words]
        tails = np.cumsum([len(d) for d in data]) - 1
        heads = np.append(0, tails[:-1] + 1)
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        n, is_tail = len(flat), np.zeros(len(flat), np.int64)
        is_tail[tails] = 1
        ids = self.byte_ids[is_tail, flat].tolist()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[tails], before[heads] = -1, -1
        after, before = after.tolist(), before.tolist()
        ranks = np.where(is_tail[:-1], -1, self.byte_ranks[is_tail[1:], flat[:-1] * 256 + flat[1:]])
        at = np.argsort(ranks, kind="stable")[np.count_nonzero(ranks < 0) :]
        heap, starts = (x.tolist() for x in np.unique(ranks[at], return_index=True))  # sorted, so a heap
        at = at.tolist()
        places = {r: at[s:e] for r, (s, e) in zip(heap, itertools.pairwise([*starts, len(at)]), strict=True)}
        base, rank_of = self.base, self.rank.get
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = self.merges[rank]
            for i in sorted(places.pop(rank)):
                if ids[i] != a or (j := after[i]) < 0 or ids[j] != b:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = new, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(new * base + ids[k])) is not None:
                        if r in places:
                            places[r].append(i)
                        else:
                            places[r] = [i]
                            heapq.heappush(heap, r)
                if (h := before[i]) >= 0 and (r := rank_of(ids[h] * base + new)) is not None:
                    if r in places:
                        places[r].append(h)
                    else:
                        places[r] = [h]
                        heapq.heappush(heap, r)
        left = np.array(ids)
        kept = left >= 0  # a merged symbol stands where its first byte was
        return left[kept], np.diff(np.cumsum(kept)[tails], prepend=0)

    def learn(self, words: list[str]) -> np.ndarray:
        """Have all the distinct ``words`` in ``known`` and return their places; at most ``max_words`` are kept besides, those met last."""
        unknown = [w for w in words if w not in self.known.place]
        if len(self.known.place) + len(unknown) > self.max_words // 2:
            self.known, self.older = self.specials(), self.known
            unknown = [w for w in words if w not in self.known.place]
        met = [w for w in unknown if w in self.older.place]
        self.known.add(met, *self.older.ids(self.older.places(met)))
        new = [w for w in unknown if w not in self.older.place]
        self.known.add(new, *self.merge_all(new))
        return self.known.places(words)

    # texts ----------------------------------------------------------------------------------

    def split(self, text: str) -> list[tuple[bool, str]]:
        """(special, piece): special tokens are found in the raw text before it is normalised."""
        if self.special_split is None or self.special_start not in text:
            return [(False, text)]
        return [(p in self.special, p) for p in self.special_split.split(text) if p]

    def words(self, text: str) -> list[str]:
        flat = lower(text if text.isascii() else unicodedata.normalize("NFC", text))
        return (self.pattern if _BEYOND_LATIN.search(flat) else self.latin_pattern).findall(flat)

    def encode_columns(self, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Number of ids, the ids joined by spaces, and the decoded text, as columns.

        Only the batch's distinct words are looked up; NumPy and Arrow put the columns together from their ids.
        """
        flat, bounds = [], [0]
        for t in texts:
            for special, piece in self.split(t):
                if special:
                    flat.append(" " + piece)
                else:
                    flat += self.words(piece)
            bounds.append(len(flat))
        words = pa.array(flat, pa.string()).dictionary_encode()
        collecting = gc.isenabled()
        gc.disable()  # the index is many lists, none of them in a cycle
        try:
            places = self.learn(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        finally:
            if collecting:
                gc.enable()
        ids, sizes = self.known.ids(places[words.indices.to_numpy()])
        starts = np.append(0, np.cumsum(sizes))[bounds]
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x.take(pa.array(ids))) for x in self.strings]
        return pa.array(np.diff(starts)), *(pc.binary_join(x, " ") for x in lists)

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, the ids joined by spaces, the decoded text) of each text."""
        return list(zip(*(c.to_pylist() for c in self.encode_columns(texts)), strict=True))

    def decode(self, ids: list[int]) -> str:
        """A file without a decoder: the tokens' strings joined by spaces; unknown ids are left out."""
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


#: Texts without a character from here on go to ``re``, which is faster than ``regex``.
_LATIN_END = 0x250
_BEYOND_LATIN = re.compile(f"[^\\x00-\\u{_LATIN_END - 1:04x}]")


def latin(pattern: str) -> re.Pattern:
    """A pattern of ``regex`` for ``re``, its classes spelled out: right for the characters before ``_LATIN_END``."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(name, "".join(f"\\u{c:04x}" for c in range(_LATIN_END) if regex.match(name, chr(c))))
    return re.compile(pattern)


def lower(text: str) -> str:
    """Lower case of each character by itself: a final sigma stays a plain one."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder a worker process and file: its words outlive the task. Memory stays bounded by ``max_words``."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            _loaded[path] = WordBpe(json.load(f))
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), batch_chars: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (decimal, joined by spaces), decoded, and the columns named in ``keep``.

    Special tokens in a text are encoded as such, as the vocabulary's library does by default.
    A null or empty text has no ids and decodes to ''. Rows are independent: repeated rows and
    null ids come back as they are. The distinct words of a batch that are not known yet are encoded
    together, see ``WordBpe.merge_all``. A batch is an Arrow batch of the partition, cut where it
    passes ``batch_chars`` characters, so memory follows that and the longest text; the words kept
    between batches are bounded, those met last stay, and ids and decoded texts are put together from them. A single word
    of n bytes takes some 300 n bytes while it is merged. Other columns are not read.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocab_path)
    name = vocab_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(SparkFiles.get(name))
        for batch in batches:
            sizes, at = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist(), 0
            while at < len(sizes):
                start, size = at, 0
                while at < len(sizes) and size <= batch_chars:
                    size, at = size + sizes[at], at + 1
                part = batch.slice(start, at - start)
                n_tokens, ids, decoded = bpe.encode_columns([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": n_tokens, "ids": ids, "decoded": decoded} | {c: part.column(c) for c in keep})

    kind = lambda c: docs.schema[c].dataType.simpleString()
    extra = "".join(f", `{c}` {kind(c)}" for c in keep)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep).mapInArrow(run, f"doc_id {kind(id_col)}, n_tokens long, ids string, decoded string{extra}")


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens and the digests of its ids and of the decoded text."""
    out = bpe_round_trip(table(spark, sf_dir, "documents"), default_vocab())
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
