"""Near-duplicate detection: Order MinHash candidates, verified by banded alignment."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import list_column, pieces, release, table, word_lists, written
from textloom.llm.substring import ByteHashes, Roller, mix64


class OrderMinHash:
    """Sketches that see the order of a text: each keeps the ``tuple_size`` smallest of the text's
    occurrence-labelled k-mers under its own hash, in the order they stand in the text.
    """

    def __init__(self, k: int, sketches: int, tuple_size: int, seed: int = 11):
        self.k, self.tuple_size = k, tuple_size
        rng = np.random.default_rng((seed, k))
        self.seeds = rng.integers(1, 2**63, sketches, dtype=np.uint64)
        self.odd = rng.integers(1, 2**63, sketches, dtype=np.uint64) | np.uint64(1)
        self.roller = Roller(0x9E3779B97F4A7C15)

    def labelled(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the k-mers, each with its occurrence number; a shorter text is one k-mer."""
        if not len(h):
            return h
        grams = self.roller.runs(h, min(self.k, len(h)))
        order = np.argsort(grams, kind="stable")
        sorted_ = grams[order]
        head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        starts = np.flatnonzero(head)
        number = np.empty(len(grams), dtype=np.uint64)
        number[order] = (np.arange(len(grams)) - starts[np.cumsum(head) - 1]).astype(np.uint64)
        return mix64(grams + number * np.uint64(0x9E3779B97F4A7C15))

    def of(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text, given as word hashes, one value per sketch; none for a text without words.

        All texts lie in one array. A sketch hashes it once and goes on with values so small that a
        text of m k-mers has about 16 of them; all k-mers of a text that has too few are taken.
        """
        out = [np.empty(0, dtype=np.uint64)] * len(texts)
        which = [i for i, h in enumerate(texts) if len(h)]
        if not which:
            return out
        grams = [self.labelled(texts[i]) for i in which]
        sizes = np.array([len(g) for g in grams])
        x, owner = np.concatenate(grams), np.repeat(np.arange(len(which)), sizes)
        bound = np.repeat((np.where(sizes > 16, 2.0**64 * 16 / np.maximum(sizes, 17), 0).astype(np.uint64) - np.uint64(1)) | np.uint64(2**32 - 1), sizes)
        least_count = np.minimum(self.tuple_size, sizes)
        values = np.empty((len(which), len(self.seeds)), dtype=np.uint64)
        mixed, is_low = np.empty_like(x), np.empty(len(x), dtype=bool)
        for j, (seed, odd) in enumerate(zip(self.seeds, self.odd, strict=True)):
            np.multiply(np.bitwise_xor(x, seed, out=mixed), odd, out=mixed)
            low = np.flatnonzero(np.less_equal(mixed, bound, out=is_low))  # the upper halves decide; lower ones are mixed below
            count = np.bincount(owner[low], minlength=len(which))
            if (lacking := count < least_count).any():
                low = np.flatnonzero(is_low | lacking[owner])
                count = np.bincount(owner[low], minlength=len(which))
            v, own, starts = mixed[low], owner[low], np.cumsum(count) - count
            v ^= v >> np.uint64(32)
            places, least = np.empty((self.tuple_size, len(which)), dtype=np.int64), np.empty((self.tuple_size, len(which)), dtype=np.uint64)
            for r in range(self.tuple_size):
                least[r] = np.minimum.reduceat(v, starts)
                hit = np.flatnonzero(v == least[r][own])[::-1]
                places[r][own[hit]] = hit  # the first place of each text's smallest value
                v[hit] = _MOST
            least = np.take_along_axis(least, np.argsort(places, axis=0, kind="stable"), axis=0)
            value = np.full(len(which), j + 1000 * self.k, dtype=np.uint64)
            for part in least:
                value = (value * np.uint64(0x9E3779B97F4A7C15)) ^ part
                value ^= value >> np.uint64(29)
            values[:, j] = value
        for i, row in zip(which, mix64(values), strict=True):
            out[i] = row
        return out


_MOST = np.uint64(2**64 - 1)


class Sketcher:
    """Sketches of ``k``-word k-mers; texts of under ``short`` words have some of two-word k-mers too.

    A change of one word changes up to k k-mers, so short texts may share too few long ones.
    """

    def __init__(self, k: int, sketches: int, tuple_size: int, short: int = 125):
        self.long, self.brief, self.short = OrderMinHash(k, sketches, tuple_size), OrderMinHash(2, max(1, sketches // 2), tuple_size), short

    def of(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        brief = self.brief.of([h if len(h) < self.short else h[:0] for h in texts])
        return [np.concatenate(pair) for pair in zip(self.long.of(texts), brief, strict=True)]


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the multiset intersection."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    both = np.concatenate([ua, ub])
    counts = np.concatenate([ca, cb])
    order = np.argsort(both, kind="stable")
    both, counts = both[order], counts[order]
    same = np.flatnonzero(both[1:] == both[:-1])
    return int(np.minimum(counts[same], counts[same + 1]).sum())


def within(a: np.ndarray, b: np.ndarray, limit: int) -> bool:
    """Is the edit distance of two sequences at most ``limit``?"""
    return edits(a, b, limit) <= limit


def edits(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """So many edits turn ``a`` into ``b``, though fewer may do; ``limit`` + 1 if ``limit`` edits do not. Alignment in the band of ``limit`` diagonals each side.

    Shortcuts that prove an answer come first: lengths, the straight alignment, common ends, and
    the multiset bound. Then the furthest cell on each diagonal of the band is carried from d to
    d + 1 edits, all diagonals at once; equal stretches are crossed 16, then 4 words at a time.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if len(a) == len(b) and (straight := int((a != b).sum())) <= limit:
        return straight
    m = min(len(a), len(b))
    diff = np.flatnonzero(a[:m] != b[:m])
    lead = int(diff[0]) if len(diff) else m
    a, b = a[lead:], b[lead:]
    m = min(len(a), len(b))
    diff = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
    tail = int(diff[0]) if len(diff) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if max(n, m) <= limit:
        return max(n, m)
    if max(n, m) - common_words(a, b) > limit:
        return limit + 1
    steps = [(size, _blocks(a, size), _blocks(b, size)) for size in (16, 4)] + [(1, np.append(a, a[:1] * 0), np.append(b, b[:1] * 0))]
    goal = n - m
    # furthest[k + limit + 1]: the most words of a used on diagonal k = i - j after d edits
    furthest = np.full(2 * limit + 3, -(1 << 40), dtype=np.int64)
    diagonals = np.arange(-limit - 1, limit + 2)
    for d in range(limit + 1):
        lo, hi = limit + 1 - d, limit + 2 + d
        if d == 0:
            x = np.zeros(1, dtype=np.int64)
        else:
            x = np.maximum(np.maximum(furthest[lo:hi] + 1, furthest[lo - 1 : hi - 1] + 1), furthest[lo + 1 : hi + 1])
            x = np.minimum(x, np.minimum(n, m + diagonals[lo:hi]))
        k = diagonals[lo:hi]
        live = np.flatnonzero((x >= 0) & (x - k >= 0))
        for step, left, right in steps:
            todo = live
            while len(todo):
                i, j = x[todo], x[todo] - k[todo]
                ok = (i + step <= n) & (j + step <= m)
                todo, i, j = todo[ok], i[ok], j[ok]
                ok = left[i] == right[j]
                todo = todo[ok]
                x[todo] += step
        furthest[lo:hi] = x
        if abs(goal) <= d and furthest[goal + limit + 1] >= n:
            return d
    return limit + 1


_block_rollers: dict[int, Roller] = {}


def _blocks(x: np.ndarray, size: int) -> np.ndarray:
    roller = _block_rollers.setdefault(size, Roller(0xD1B54A32D192ED03))
    return roller.runs(mix64(x.astype(np.uint64)), size)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Edit similarity, 1 - distance / longer length, of at least ``threshold``."""
    longest = max(len(a), len(b))
    return longest == 0 or within(a, b, int((1 - threshold) * longest + 1e-9))


def occurrences(words: np.ndarray) -> np.ndarray:
    """Hashes of words with their occurrence numbers, so that sets of them meet as multisets of words."""
    return OrderMinHash(1, 1, 1).labelled(words)


def shared_words(words: list[np.ndarray]) -> np.ndarray:
    """How many words each two texts have in common, as multisets: one product over the words that two texts hold."""
    labelled = [occurrences(w) for w in words]
    owner = np.repeat(np.arange(len(words)), [len(x) for x in labelled])
    _, which, n = np.unique(np.concatenate(labelled), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    held = np.zeros((len(words), int((n > 1).sum())), dtype=np.float32)
    often = n[which] > 1
    held[owner[often], column[which[often]]] = 1
    return held @ held.T


def compare(words: list[np.ndarray], open_: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the ``open_`` pairs (a symmetric matrix) are similar, as a symmetric matrix.

    Every pair is decided exactly: by the words it has in common (an edit adds one at most), by
    ``edits``, or by two texts' edits to a third one, which together turn the one into the other.
    """
    n = np.array([len(w) for w in words])
    longest = np.maximum.outer(n, n)
    limit = ((1 - threshold) * longest + 1e-9).astype(np.int64)
    todo = open_ & (longest - shared_words(words) <= limit)
    np.fill_diagonal(todo, False)
    out = np.zeros_like(todo)
    for i in range(len(words)):
        others = np.flatnonzero(todo[i])
        if not len(others):
            continue
        far = np.full(len(words), 1 << 40)
        far[others] = [edits(words[i], words[j], int(limit[i, j])) for j in others]
        near = far <= limit[i]
        out[i] |= near
        out[:, i] |= near
        todo[i] = todo[:, i] = False
        if near.sum() > 8:
            both = np.flatnonzero(near)
            at = np.ix_(both, both)
            sure = np.add.outer(far[both], far[both]) <= limit[at]
            out[at] |= todo[at] & sure
            todo[at] &= ~sure
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix a neighbour, or itself, so that these edges connect what the matrix connects."""
    parent, fresh = np.arange(len(linked)), np.ones(len(linked), dtype=bool)
    for start in range(len(linked)):
        if not fresh[start]:
            continue
        fresh[start], stack = False, [start]
        while stack:
            i = stack.pop()
            found = np.flatnonzero(linked[i] & fresh)
            fresh[found], parent[found] = False, i
            stack.extend(found.tolist())
    return parent


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes in the order of their slot's count, ties by hash: one order for all texts, rare ones first."""
    return grams[np.lexsort((grams, counts[slots(grams, len(counts))]))]


def slots(grams: np.ndarray, n: int) -> np.ndarray:
    """The slots, of ``n``, by which grams are counted."""
    return (grams >> np.uint64(40)).astype(np.int64) % n


def prefix_length(n: int, threshold: float) -> int:
    """How many two-word grams of a text of n words must be looked at so that every similar text shares one.

    Of a text of n words and one of m <= n, at most d = (1 - threshold) * n edits apart, all but
    2 d of the longer one's n - 1 grams stand in the other too, for an edit changes two at most. In
    any common order the first 2 d + 1 grams of the longer and the first m - n + 2 d + 1 of the shorter
    then have one in common, which is 2 (1 - threshold) m + 2 at most.
    """
    return 2 * int((1 - threshold) * n + 1e-9) + 2


def meetings(small: int, threshold: float):
    """(family, a, b) of rows (gram, node, n, cls, open) that come sorted by gram.

    Up to ``small`` texts of one gram give the pairs that may be similar: of different classes, alike in
    length, with an open bucket in common. More of them give each text with the first, as one family.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, large, first = None, None, None  # rows of a gram that may go on; or that gram, known to be large, and its first text
        for f in itertools.chain(frames, [None]):
            out: list[tuple[bool, int, int]] = []
            last = f is None
            f = kept if last else f if kept is None else pd.concat([kept, f])
            kept = None
            if f is None or not len(f):
                continue
            gram, node, n, cls, keys = (f[c].to_numpy() for c in ("gram", "node", "n", "cls", "open"))
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            ends = np.append(starts[1:], len(gram))
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                if large is not None and gram[lo] == large:
                    out += [(True, x, first) for x in node[lo:hi].tolist()]
                elif hi - lo > small:
                    large, first = int(gram[lo]), int(node[lo])
                    out += [(True, x, first) for x in node[lo:hi].tolist()]
                elif hi == len(gram) and not last:
                    kept = f.iloc[lo:hi]
                elif hi - lo > 1:
                    for i, j in itertools.combinations(range(lo, hi), 2):
                        alike = cls[i] != cls[j] and min(n[i], n[j]) >= threshold * max(n[i], n[j]) - 1e-6
                        if alike and not set(keys[i]).isdisjoint(keys[j]):
                            out.append((False, int(min(node[i], node[j])), int(max(node[i], node[j]))))
            yield pd.DataFrame(out, columns=["family", "a", "b"]).drop_duplicates()

    return run


def bucket_pairs(threshold: float):
    """(a, b) of rows (key, node, n, cls, bag) that come sorted by key: the pairs of a bucket that may be similar.

    They are of different classes and have so many words in common, as multisets, that edits may make up
    for the rest. A bag holds 16 bits of each word's hash: words that fall together only add pairs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for f in itertools.chain(frames, [None]):
            out: list[tuple[int, int]] = []
            last = f is None
            f = kept if last else f if kept is None else pd.concat([kept, f])
            kept = None
            if f is None or not len(f):
                continue
            key, node, n, cls = (f[c].to_numpy() for c in ("key", "node", "n", "cls"))
            bounds = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(f)]
            if not last:
                bounds.pop()
                kept = f.iloc[bounds[-1] :]
            for lo, hi in itertools.pairwise(bounds):
                i, j = np.triu_indices(hi - lo, 1)
                i, j = i + lo, j + lo
                longest = np.maximum(n[i], n[j])
                limit = ((1 - threshold) * longest + 1e-9).astype(np.int64)
                may = (cls[i] != cls[j]) & (longest - np.minimum(n[i], n[j]) <= limit)
                i, j, least = i[may], j[may], (longest - limit)[may]
                if not len(i):
                    continue
                bags = [np.frombuffer(b, dtype=np.uint16) for b in f["bag"].iloc[lo:hi]]
                if len(i) > 64:
                    common = shared_words([b.astype(np.uint64) for b in bags])[i - lo, j - lo]
                else:
                    common = np.array([common_words(bags[x], bags[y]) for x, y in zip((i - lo).tolist(), (j - lo).tolist(), strict=True)])
                may = common >= least
                out += zip(np.minimum(node[i], node[j])[may].tolist(), np.maximum(node[i], node[j])[may].tolist(), strict=True)
            yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()

    return run


def least_connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and for each the smallest node that it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        for end in (least[x], least[y]):
            np.minimum.at(least, end, low)
        while (least[least] != least).any():
            least = least[least]
    return nodes, nodes[least]


def components(edges: DataFrame, few: int = 1 << 16) -> DataFrame:
    """(node, root): the smallest node of each connected component, by large-star and small-star.

    Every round works on narrow edges with aggregates and equi-joins, is written to the shared
    folder, and nothing comes to the driver but a count and a checksum. Up to ``few`` edges, a
    megabyte, need no rounds: the driver connects them.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "cc-0")
    if edges.count() <= few:
        found = edges.toArrow()
        release(edges)
        nodes, roots = least_connected(*(found.column(c).to_numpy() for c in "ab"))
        roots = pd.DataFrame({"node": nodes, "root": roots}).query("node != root")
        return written(edges.sparkSession.createDataFrame(roots, "node long, root long"), "cc-few")
    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = written(large.filter("a != b").distinct(), "cc-large")
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        joined = large.join(lower, "a")
        small = joined.select("a", F.col("m").alias("b")).unionAll(joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))
        before, edges = edges, written(small.filter("a != b").distinct(), "cc-small")
        release(before, low, large, lower)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


#: Slots of the counts of grams, and how many of them make a row.
_SLOTS, _PART = 1 << 22, 1 << 14


def _digests(words: pa.ListArray) -> np.ndarray:
    """Four longs of each text's SHA-256."""
    joined = pc.binary_join(words, " ").cast(pa.binary()).to_pylist()
    return np.frombuffer(b"".join([hashlib.sha256(x).digest() for x in joined]), dtype=">i8").reshape(-1, 4).astype(np.int64)


def _describe(k: int, sketches: int, tuple_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, hashes = Sketcher(k, sketches, tuple_size), ByteHashes()
        with np.errstate(over="ignore"):
            for part in itertools.chain.from_iterable(pieces(b) for b in batches):
                words = word_lists(part.column("text"))
                texts, digests = hashes.of_lists(words), _digests(words)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "h": part.column("h"), "n": pa.array([len(t) for t in texts], pa.int32()), "node": pa.array(digests[:, 0]),
                    "d2": pa.array(digests[:, 1]), "sketches": list_column([x.view(np.int64) for x in sketcher.of(texts)], pa.int64()),
                })

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = ByteHashes()
    for part in itertools.chain.from_iterable(pieces(b) for b in batches):
        words = word_lists(part.column("text"))
        yield pa.RecordBatch.from_pydict({"node": pa.array(_digests(words)[:, 0]), "w": list_column([x.view(np.int64) for x in hashes.of_lists(words)], pa.int64())})


def near_dedup(docs: DataFrame, *, k: int = 5, sketches: int = 64, tuple_size: int = 2, threshold: float = 0.8, small: int = 16, block: int = 256) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept, text_hash.

    Two texts are near-duplicates if the edit similarity of their word sequences is at least
    ``threshold``; a class is what such links connect, its class_id the smallest doc_id of its rows,
    whose row stays. Words are runs of anything but ASCII white space. text_hash is the xxHash64 of
    the row's own text: with doc_id it tells rows apart.

    Copies (equal word sequences) are one text: they are settled by digest, however many there
    are, and only one of them goes on. Candidates are all pairs of texts with an equal sketch; no
    bucket is capped. Classes need no link inside what is connected already, so the pairs of a bucket
    are decided in three steps, each on whole texts by ``edits``:

    1. every text of a bucket meets its leader, the text that meets most others in all buckets;
    2. of the texts outside the leader's class one, by hash, meets all of other classes;
    3. buckets that still hold several classes are decided without their leaders. In one of up to ``block`` texts
       all pairs meet by bags of words, see ``bucket_pairs``. The texts of larger ones go to an exact join: two similar
       texts share one of their rarest two-word grams, see ``prefix_length``; one that no other text holds makes no row. So a passage that a
       third of all documents hold makes no pairs unless it is most of them. A gram of more than ``small``
       texts makes no rows of its own: its texts go by bucket, a row for each. Those that meet in a bucket of more
       than ``small`` of them are one family, cut into blocks of about ``block`` texts; each two blocks meet in one group, whose
       rows are its texts, not its pairs, and ``compare`` decides all of them. Blocks meet in rounds
       by their distance, in each of which a text is copied 16 times at most, so disk grows with the family only.

    How a pair meets is so a matter of counts, but every pair that shares a bucket is decided, by the
    same measure. Rows grow with the input, and the work in a family of texts that are nearly alike with its
    square over ``block``. Steps move narrow rows; texts move to the pairs that are decided. The
    counts by which grams are rare are 2**22 sums, 16 MB, whatever the input.

    Null and empty texts form one class. A row with a null id takes no part and comes back as a
    class of its own. One id may have several texts: each is judged by itself, and all rows of a
    class's smallest id stay. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    told = written(rows.mapInArrow(_describe(k, sketches, tuple_size), "doc_id long, h long, n int, node long, d2 long, sketches array<long>"), "near-told")
    real = told.filter("doc_id IS NOT NULL")
    heads = written(real.groupBy("node", "d2").agg(F.min(F.struct("doc_id", "n", "sketches")).alias("x"), F.count(F.lit(1)).alias("copies")).select("node", "d2", "copies", "x.*"), "near-heads")

    wide = told, heads
    spread = heads.select("node", "n", F.explode("sketches").alias("key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = written(sizes, "near-sizes")  # written, so that both sides of the join are exchanged and a hot bucket can be split
    full = written(spread.join(sizes, "key"), "near-buckets")
    told, heads = written(told.drop("sketches"), "near-told"), written(heads.drop("sketches"), "near-heads")
    real = told.filter("doc_id IS NOT NULL")
    release(*wide, sizes)
    near = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y) - 1e-6
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def words_for(nodes: DataFrame) -> DataFrame:
        wanted = heads.join(nodes.distinct(), "node", "left_semi").select("doc_id").distinct()
        texts = rows.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_words, "node long, w array<long>")
        return written(texts.dropDuplicates(["node"]), "near-words")

    def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with np.errstate(over="ignore"):
                for f in frames:
                    ok = [similar(np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64), threshold) for x, y in zip(f["wa"], f["wb"], strict=True)]
                    yield f.loc[ok, ["a", "b"]]

        left, right = (words.select(F.col("node").alias(c), F.col("w").alias(f"w{c}")) for c in "ab")
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "wa", "wb")
        return written(both.mapInPandas(run, "a long, b long"), "near-links")

    def renamed(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
        """``column`` as the root of its class."""
        to = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")

    # 1: leaders
    score = full.groupBy("node").agg(F.sum("size").alias("score"))
    leader = full.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("x")).select("key", F.col("x.node").alias("lead"), F.col("x.n").alias("lead_n"))
    leader = written(leader, "near-leaders")
    pairs = full.join(leader, "key").filter((F.col("node") != F.col("lead")) & near("n", "lead_n")).select(*pair("node", "lead")).distinct()
    pairs = written(pairs, "near-pairs")
    words = words_for(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")))
    links = verified(pairs, words)
    roots = components(links)

    # 2: one text outside the leader's class
    classed = renamed(full.select("key", "node", "n", F.col("node").alias("cls")), "cls", roots)
    rest = written(classed.join(renamed(leader.select("key", "lead", F.col("lead").alias("lead_cls")), "lead_cls", roots), "key").filter("node != lead"), "near-rest")
    second = rest.filter("cls != lead_cls").groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node").alias("x"), "node", "n", "cls")).alias("s")).select("key", "s")
    second = written(second, "near-second")
    pairs2 = rest.join(second, "key").filter((F.col("cls") != F.col("s.cls")) & near("n", "s.n")).select(*pair("node", "s.node")).distinct()
    links2 = verified(pairs2, words)
    roots2 = components(renamed(renamed(links2, "a", roots), "b", roots))

    # 3: what is still apart in one bucket
    apart = written(renamed(rest.select("key", "node", "n", "cls"), "cls", roots2), "near-apart")  # read twice
    open_ = written(apart.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("held")).filter("lo != hi").select("key", "held"), "near-open")
    left = written(apart.join(open_, "key"), "near-left")
    release(apart)
    texts = words_for(left.select("node"))

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"].array, "bag": [np.sort(np.asarray(w).astype(np.uint16)).tobytes() for w in f["w"]]})

    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = left.filter(F.col("held") <= block).join(texts.mapInPandas(bags, "node long, bag binary"), "node").select("key", "node", "n", "cls", "bag")
    few = written(few.repartition(shuffled, "key").sortWithinPartitions("key").mapInPandas(bucket_pairs(threshold), "a long, b long").distinct(), "near-few")
    crowd = left.filter(F.col("held") > block).groupBy("node", "n", "cls").agg(F.collect_set(F.hash("key")).alias("open"))
    grams = written(crowd.join(texts, "node"), "near-grams")

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omh, total = OrderMinHash(2, 1, 1), np.zeros(_SLOTS, dtype=np.uint32)
        with np.errstate(over="ignore"):
            for f in frames:
                for w in f["w"]:
                    slot, c = np.unique(slots(omh.labelled(np.asarray(w).view(np.uint64)), _SLOTS), return_counts=True)
                    total[slot] += c.astype(np.uint32)
        held = [(part, x, np.flatnonzero(x)) for part, x in enumerate(total.reshape(-1, _PART)) if x.any()]
        yield pd.DataFrame([(part, at.astype(np.uint16).tobytes(), x[at].tobytes()) for part, x, at in held], columns=["part", "slot", "c"])

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            for part, slot, c in zip(f["part"].tolist(), f["slot"], f["c"], strict=True):
                total.setdefault(part, np.zeros(_PART, dtype=np.int64))[np.frombuffer(slot, dtype=np.uint16)] += np.frombuffer(c, dtype=np.uint32)
        yield pd.DataFrame([(part, np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()) for part, x in total.items()], columns=["part", "c"])

    counts = np.zeros(_SLOTS, dtype=np.uint32)
    tallied = grams.select("w").mapInPandas(tally, "part int, slot binary, c binary").repartition(shuffled, "part")
    for r in tallied.mapInPandas(added, "part int, c binary").collect():
        counts[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["c"], dtype=np.uint32)
    shared = spark.sparkContext.broadcast(counts)
    most = small + 2 * int(counts.sum(dtype=np.int64) // _SLOTS)  # of a slot with one rare gram among what falls there by chance

    def rarest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omh = OrderMinHash(2, 1, 1)
        with np.errstate(over="ignore"):
            for f in frames:
                first = [rare_first(omh.labelled(np.asarray(w).view(np.uint64)), shared.value)[: prefix_length(len(w), threshold)] for w in f["w"]]
                c = [shared.value[slots(x, _SLOTS)] for x in first]
                # alone in its slot, a gram is in no other text
                out = {"often": [bool((y > most).any()) for y in c], "grams": [x[(y > 1) & (y <= most)].view(np.int64) for x, y in zip(first, c, strict=True)]}
                yield pd.DataFrame({**{name: f[name].array for name in ("node", "n", "cls", "open")}, **out})

    rare = written(grams.mapInPandas(rarest, "node long, n int, cls long, open array<int>, often boolean, grams array<long>"), "near-rare")
    posted = rare.select("node", "n", "cls", "open", F.explode("grams").alias("gram"))
    meeting = lambda rows: rows.repartition(shuffled, "gram").sortWithinPartitions("gram").mapInPandas(meetings(small, threshold), "family boolean, a long, b long").distinct()
    met = written(meeting(posted), "near-met")
    # texts with a frequent gram go by bucket, once for each: what shares no bucket need not meet
    often = rare.filter("often").select("node").unionAll(met.filter("family").select(F.col("a").alias("node"))).distinct()
    finer = written(rare.join(often, "node", "left_semi").select("node", "n", "cls", F.explode("open").alias("key")), "near-finer")
    held = written(finer.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("first")), "near-held")
    finer_held = finer.join(held, "key")
    met2 = written(meeting(finer_held.filter(F.col("held") <= small).select(F.col("key").cast("long").alias("gram"), "node", "n", "cls", F.array("key").alias("open"))), "near-met")
    together = finer_held.filter(F.col("held") > small).select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs3 = few.unionAll(met.unionAll(met2).filter("NOT family").select("a", "b")).distinct()
    links3 = verified(pairs3, texts)
    family = components(together)
    family = written(family.unionAll(family.select(F.col("root").alias("node"), "root")).distinct(), "near-family")
    parts = written(family.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "near-parts")
    placed = family.join(parts, "root").withColumn("x", F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")).cast("int"))

    def cut(first: int, last: int) -> DataFrame:
        """Texts by the pairs of blocks, on the circle of their family's, that are ``first`` to ``last`` apart."""
        met = placed.filter(F.col("parts") >= 2 * first).withColumn("far", F.explode(F.sequence(F.lit(first), F.least(F.lit(last), F.floor(F.col("parts") / 2).cast("int")))))
        met = met.withColumn("y", F.explode(F.array_distinct(F.array(F.pmod(F.col("x") + F.col("far"), "parts"), F.pmod(F.col("x") - F.col("far"), "parts")))))
        return met.select("node", "root", "x", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))

    def meet(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            x, cls = f["x"].to_numpy(), f["cls"].to_numpy()
            apart = (cls[:, None] != cls[None, :]) & ((x[:, None] != x[None, :]) | (key[1] == key[2]))
            linked = compare([np.asarray(w).view(np.uint64) for w in f["w"]], apart, threshold)
            ids = f["node"].to_numpy()
            return pd.DataFrame({"a": ids, "b": ids[forest(linked)]})[linked.any(axis=1)]

    largest = parts.agg(F.max("parts")).first()[0] or 1
    rounds = [
        written(cut(o, o + 7).join(grams.select("node", "cls", "w"), "node").groupBy("root", "p", "q").applyInPandas(meet, "a long, b long"), "near-met3")
        for o in range(0, largest // 2 + 1, 8)
    ]
    found = links3
    for r in rounds:
        found = found.unionAll(r)
    roots3 = components(renamed(renamed(renamed(renamed(found, "a", roots), "a", roots2), "b", roots), "b", roots2))

    labelled = heads.select("node", "d2", "copies", "doc_id", F.col("node").alias("cls"))
    for r in (roots, roots2, roots3):
        labelled = renamed(labelled, "cls", r)
    labelled = written(labelled, "near-classes")
    size = written(labelled.groupBy("cls").agg(F.sum("copies").alias("class_size"), F.min("doc_id").alias("class_id")), "near-class-sizes")
    out = real.select("doc_id", "h", "node", "d2").join(labelled.drop("doc_id", "copies"), ["node", "d2"]).join(size, "cls")
    out = out.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"), F.col("h").alias("text_hash"))
    alone = told.filter("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.col("h").alias("text_hash"))
    release(full, leader, pairs, words, links, rest, second, links2, open_, left, texts, few, grams, rare, met, finer, held, met2, links3, family, parts, *rounds)
    return out.unionAll(alone)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class."""
    return near_dedup(table(spark, sf_dir, "documents"))
