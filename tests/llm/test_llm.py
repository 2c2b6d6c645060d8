"""The ten operators against brute force, and on nulls, empty tables, long texts, ties, repeats and clashing columns."""

import collections
import fractions
import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("textloom.llm")

from pyspark.sql import functions as F  # noqa: E402
from textloom.llm import ann, bpe, exact_dedup, line_dedup, mixing, near_dedup, quality, sharding, substring, toxicity  # noqa: E402
from textloom.llm.common import gapless, hash60, word_lists, words_of, written  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  ", None, None, 1), (4, "a  b", "en", "b", 4), (5, "a b", "en", "b", 3), (6, "a\tb", "en", "b", 3),
    (7, "word " * 30_000, "en", "c", None), (8, "Ünïcödé ß 日本語   x", "de", "c", 9), (5, "a b", "en", "b", 3), (9, "line one\nline two\n\nline three", "en", "c", 5),
]


def docs(spark, rows=EDGE):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns whose names the operators use inside."""
    extra = "key check fresh group_size keep_id n_bytes prefix_hash slot shard block place position score class_id words lines h hits vec leaf n pos size copies w asked starts spans".split()
    return df.withColumns({c: F.lit("clash") for c in extra})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def squash(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# ------------------------------------------------------------------ 5 exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[squash(r[1])].append(r[0])
    return sorted((r[0], min(groups[squash(r[1])]), len(groups[squash(r[1])]), r[0] == min(groups[squash(r[1])]), sha(squash(r[1]))) for r in rows)


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(spark, digest_all):
    rng = random.Random(1)
    rows = EDGE + [(100 + i, rng.choice(["same text", "same  text", "x" * 300 + "1", "x" * 300 + "2", f"own {i}"]), "en", "s", 1) for i in range(200)]
    got = exact_dedup.exact_dedup(clashing(docs(spark, rows)), digest_all=digest_all).collect()
    want = brute_exact(rows)
    if digest_all:
        assert sorted(tuple(g[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for g in got) == want
    else:
        assert sorted(tuple(g[c] for c in ("doc_id", "keep_id", "group_size", "kept")) for g in got) == [w[:4] for w in want]
        assert {g.text_sha256 for g in got if g.group_size > 1} == {w[4] for w in want if w[2] > 1}  # survivors only, and of each


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup_of_null_ids_and_several_texts_of_one_id(spark, digest_all):
    long = "x" * 300
    rows = [(None, "same", "en", "s", 1), (None, "same", "en", "s", 1), (3, "same", "en", "s", 1), (4, long + "1", "en", "s", 1), (4, long + "2", "en", "s", 1), (5, long + "2", "en", "s", 1), (None, "alone", "en", "s", 1)]
    got = collections.Counter((g.doc_id, g.keep_id, g.group_size, g.kept) for g in exact_dedup.exact_dedup(docs(spark, rows), digest_all=digest_all).collect())
    assert got == {(None, 3, 3, False): 2, (3, 3, 3, True): 1, (4, 4, 1, True): 1, (4, 4, 2, True): 1, (5, 4, 2, False): 1, (None, None, 1, True): 1}
    kept = exact_dedup.first_of_equal(clashing(docs(spark, rows)))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone"), (3, "same"), (4, long + "1"), (4, long + "2")] and "_n" not in kept.columns


# ------------------------------------------------------------------ 6 sharding


def brute_shard(key, node, path=""):
    while node.shard is None:
        best = []
        for c in node.children:
            u = (int(hashlib.md5(f"{key}|{path}/{c.name}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            best.append((math.log(u) / c.weight, c))
        node = max(best, key=lambda x: x[0])[1]
        path += f"/{node.name}"
    return node.shard


def test_sharding_against_brute_force_and_growth(spark):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(3000)] + [(None, "x", "en", "s", 1)]
    got = sharding.shard(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for g in got[:400]:
        key = "" if g.doc_id is None else g.doc_id
        assert g.shard == brute_shard(key, sharding.tree(40)) and g.grown_shard == brute_shard(key, sharding.tree(41))
    assert all(g.grown_shard in (g.shard, 40) for g in got) and any(g.grown_shard == 40 for g in got)
    for s in range(40):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    assert all(g.size == len(f"text {g.doc_id}") + 16 and g.text_crc32 == zlib.crc32(f"text {g.doc_id}".encode()) for g in got if g.doc_id is not None)


def test_sharding_follows_weights_and_moves_only_in_the_changed_subtree(spark):
    N = sharding.Node
    plain = N("root", (N("r0", (N("k0", (N("s0", shard=0), N("s1", shard=1))),)), N("r1", (N("k0", (N("s2", shard=2),)),))))
    heavy = N("root", (plain.children[0], N("r1", (N("k0", (N("s2", shard=2, leaf_weight=4.0),)),))))
    rows = docs(spark, [(i, "t", "en", "s", 1) for i in range(3000)])
    got = sharding.shard(rows, root=plain, grown=heavy).collect()
    assert all(g.grown_shard in (g.shard, 2) for g in got)
    assert abs(sum(g.shard == 2 for g in got) / 3000 - 1 / 3) < 0.04 and abs(sum(g.grown_shard == 2 for g in got) / 3000 - 2 / 3) < 0.04


def test_gapless_over_many_ranges(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"), hash60(F.col("id")).alias("h"))
    got = gapless(df, "k", ["h", "doc_id"], 5000, per_bucket=50).collect()
    for k in ("hot", "cold"):
        rows = sorted((r for r in got if r.k == k), key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows))) and [r.h for r in rows] == sorted(r.h for r in rows)


# ------------------------------------------------------------------ words of 3 and 4


def test_words_are_hashed_in_columns():
    """Each word by its bytes alone, none of them alike, and new words at less than 0.6 of the time of one by one."""
    rng = random.Random(8)
    texts = ["", None, " \t\n", "a\x1cb  \u00e9\u2003x\u0085 c\r", "ab ba aab", *(" ".join("".join(rng.choices("abcdeéç", k=rng.randint(4, 9))) for _ in range(500)) for _ in range(100))]
    lists = word_lists(pa.array(texts)[1:])
    words = [words_of(t) for t in texts[1:]]
    assert lists.to_pylist() == words
    for hashes in (substring.ByteHashes(), substring.ByteHashes(seed=1)):
        found = dict(zip(itertools.chain(*words), np.concatenate(hashes.of_lists(lists)).tolist(), strict=True))
        assert len(set(found.values())) == len(found)
        assert all([found[w] for w in ws] == h.tolist() for ws, h in zip(words, hashes.of_lists(lists), strict=True))

    def took(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    column = pa.array(texts)
    one_by_one = lambda: [[xxhash.xxh3_64_intdigest(w.encode()) for w in words_of(t)] for t in texts]
    assert min(took(lambda: near_dedup.ByteHashes().of_lists(word_lists(column))) for _ in range(5)) < 0.6 * min(took(one_by_one) for _ in range(5))


def test_substring_describes_texts_in_columns():
    """Words, digest and anchors of an Arrow batch, in at most 1.3 of the time of hashing its new words one by one."""
    rng = random.Random(9)
    texts = ["", None, " a\x1cb ", *(" ".join("".join(rng.choices("abcdeéç", k=rng.randint(4, 9))) for _ in range(500)) for _ in range(200))]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "h": pa.array(range(len(texts))), "text": pa.array(texts)})
    got = [r for part in substring._describe(50)(iter([batch])) for r in part.to_pylist()]
    assert [(r["n_words"], r["sha"]) for r in got] == [(len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for w in map(words_of, texts)]
    assert [bool(r["anchors"]) for r in got] == [len(words_of(t)) >= 50 for t in texts]

    def took(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    one_by_one = lambda: [[xxhash.xxh3_64_intdigest(w.encode()) for w in words_of(t)] for t in texts]
    assert min(took(lambda: list(substring._describe(50)(iter([batch])))) for _ in range(5)) < 1.3 * min(took(one_by_one) for _ in range(5))


# ------------------------------------------------------------------ 7 BPE


@pytest.fixture(scope="session")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocab())


TEXTS = ["", "  ", "Hello WORLD's don't I'LL <|endoftext|>x", "ΑΣΣ ΟΔΟΣ ς", "İ ß ﬁ é é 😀 123 ½", "a\x00b\x1cc d", "कंबल 中文字符 한국어", "aaaaaaaaaaaa", "'''s's'T", "supercalifragilisticexpialidocious " * 50]


def test_bpe_equals_the_library(spark, library):
    rows = EDGE + [(50 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    got = bpe.bpe_round_trip(clashing(docs(spark, rows)), bpe.default_vocab(), batch_chars=500).collect()
    want = collections.Counter()
    for r in rows:
        e = library.encode(r[1] or "", add_special_tokens=False)
        want[r[0], len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)] += 1
    assert collections.Counter((g.doc_id, g.n_tokens, g.ids, g.decoded) for g in got) == want


def test_bpe_random_texts_and_bounded_memory(library):
    with open(bpe.default_vocab(), encoding="utf-8") as f:
        coder = bpe.WordBpe(json.load(f), max_words=50)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeéßшい 1'!.\n") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for at in range(0, 300, 20):
        for t, (n, ids, decoded) in zip(texts[at : at + 20], coder.encode_batch(texts[at : at + 20]), strict=True):
            e = library.encode(t, add_special_tokens=False)
            assert (n, ids) == (len(e.ids), " ".join(map(str, e.ids))) and decoded == library.decode(e.ids, skip_special_tokens=False) == coder.decode(e.ids)


def test_bpe_merges_a_recurring_word_once():
    with open(bpe.default_vocab(), encoding="utf-8") as f:
        coder = bpe.WordBpe(json.load(f), max_words=60)
    merged, plain = collections.Counter(), coder.merge_all
    coder.merge_all = lambda words: (merged.update(words), plain(words))[1]
    for k in "abcdefghijklmnopqrst":
        coder.encode_batch([" ".join(["ever", "always", *(f"only{k}{i}" for i in "abcdefghij")])])
    assert merged["ever"] == merged["always"] == merged["onlyaa"] == 1


# ------------------------------------------------------------------ 9 line dedup


def brute_lines(rows):
    """Each row by itself: the lines of every pair of lines that an earlier place holds, by (doc_id, line)."""
    first = {}
    for i, text, *_ in rows:
        if i is not None and text is not None:
            for k, pair in enumerate(itertools.pairwise(text.split("\n"))):
                first[pair] = min(first.get(pair, (i, k)), (i, k))
    out = collections.Counter()
    for i, text, *_ in rows:
        if text is None:
            out[i, 0, 0, None] += 1
            continue
        ls = text.split("\n")
        gone = set() if i is None else {j for k, pair in enumerate(itertools.pairwise(ls)) if first[pair] != (i, k) for j in (k, k + 1)}
        out[i, len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("divisor", [1, 2, 4])
def test_line_dedup_against_brute_force(spark, divisor):
    rng = random.Random(5)
    block = [f"boiler plate {i} of the site" for i in range(12)]
    rows = [*EDGE, (None, "\n".join(block), "en", "a", 1)]
    for i in range(120):
        own = [f"own line {rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))]
        at, start = rng.randint(0, len(own)), rng.randrange(9)
        rows.append((100 + i, "\n".join(own[:at] + (block if i % 2 else block[start : start + rng.randint(1, 4)]) + own[at:]), "en", "s", 1))
    got = collections.Counter((g.doc_id, g.n_lines, g.n_removed, g.kept_text) for g in line_dedup.line_dedup(clashing(docs(spark, rows)), divisor=divisor).collect())
    want = brute_lines(rows)
    assert got == want and sum(k[2] for k in want) > 300


def test_line_dedup_judges_each_text_of_a_repeated_id(spark):
    common, own = [f"common {i}" for i in range(12)], [f"unique {i}" for i in range(12)]
    rows = [(i, "\n".join(t), "en", "s", 1) for i, t in [(1, common), (7, common), (7, own), (8, own[:3] + ["x"])]]
    got = collections.Counter((g.doc_id, g.n_removed) for g in line_dedup.line_dedup(docs(spark, rows)).collect())
    assert got == {(1, 0): 1, (7, 12): 1, (7, 0): 1, (8, 3): 1}


# ------------------------------------------------------------------ 4 substring dedup


def brute_windows(rows, w):
    words = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    first = {}
    for i, ws in words:
        for p in range(len(ws) - w + 1):
            k = tuple(ws[p : p + w])
            first[k] = min(first.get(k, i), i)
    out = collections.Counter()
    for i, ws in words:
        gone = set()
        for p in range(len(ws) - w + 1):
            if first[tuple(ws[p : p + w])] < i:
                gone |= set(range(p, p + w))
        out[i, len(ws), len(gone), sha(" ".join(x for k, x in enumerate(ws) if k not in gone))] += 1
    return out


@pytest.mark.parametrize("batches,window", [(1, 8), (2, 8), (5, 7)])
def test_substring_dedup_against_brute_force(spark, batches, window):
    rng = random.Random(batches)
    passage = [f"p{i}" for i in range(20)]
    rows = list(EDGE)
    for i in range(60):
        ws = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            at, a = rng.randint(0, len(ws)), rng.randint(0, 8)
            ws[at:at] = passage[a : a + rng.randint(5, 14)]
        if i % 10 == 9:
            ws = rows[-1][1].split()
        rows.append((200 + i, " ".join(ws), "en", "s", 1))
    got = collections.Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in substring.substring_dedup(clashing(docs(spark, rows)), window=window, batches=batches).collect())
    assert got == brute_windows(rows, window)


def test_substring_dedup_judges_each_text_of_a_repeated_id(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(5, [f"a{i}" for i in range(120)] + passage), (5, [f"b{i}" for i in range(5)] + passage), (3, passage), (3, [f"c{i}" for i in range(60)]), (6, [f"c{i}" for i in range(60)]), (None, passage), (7, passage[:49])]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in rows]
    got = collections.Counter((g.doc_id, g.n_words, g.n_removed, g.kept_sha256) for g in substring.substring_dedup(docs(spark, rows)).collect())
    want = brute_windows([r for r in rows if r[0] is not None], 50)
    want[None, 60, 0, sha(" ".join(passage))] += 1
    assert got == want and sum(k[2] for k in want) == 180


def test_run_index_compacts(spark, tmp_path):
    index = substring.RunIndex(spark, "test", f"file://{tmp_path}", buckets=2, fanout=2)
    for i in range(5):
        index.drop(index.add(spark.createDataFrame([(k, 0, 10 * i + k) for k in range(4)], "key long, check long, doc_id long")))
    assert sorted(r.level for r in index.runs) == [0, 2]
    hits = index.matching(spark.createDataFrame([(3, 0), (9, 0), (1, 7)], "key long, check long"))
    assert sorted((r.key, r.doc_id) for r in hits.collect()) == [(3, 3), (3, 13), (3, 23), (3, 33), (3, 43)]
    index.drop()


def test_runs_are_neither_exchanged_nor_sorted_again(spark, tmp_path):
    index = substring.RunIndex(spark, "test", f"file://{tmp_path}", buckets=8)
    index.add(spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("check"), F.col("id").alias("doc_id")))
    with substring._sorted_buckets(spark):
        plan = index.matching(spark.range(50).select(F.col("id").alias("key"), (F.col("id") % 7).alias("check")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "SortMergeJoin" in plan  # those of the asked keys
    index.drop()


def test_a_later_session_continues_the_index(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(12))
    first = docs(spark, [(1, f"a b {passage}", "en", "s", 1), (2, "x " * 12, "en", "s", 1)])
    second = docs(spark, [(3, f"{passage} q r", "en", "s", 1), (4, "x " * 12, "en", "s", 1)])
    at = f"file://{tmp_path}/index"
    substring.SubstringDedup(spark, path=at, window=8, buckets=2, fanout=2).add(first)
    for r in spark.sql("SHOW TABLES").collect():
        if r.tableName.startswith("textloom_"):
            spark.sql(f"DROP TABLE {r.tableName}")  # external: the files stay, as after the end of a session
    with pytest.raises(ValueError, match="archive"):
        substring.SubstringDedup(spark, path=at, window=8)
    again = substring.SubstringDedup(spark, path=at, archive=first, window=8, fanout=2)
    assert {r.doc_id: r.n_removed for r in again.add(second).collect()} == {3: 12, 4: 12}
    assert [r.level for r in again.anchors.runs] == [1] and again.version == 2


# ------------------------------------------------------------------ 3 near dedup


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_within_equals_edit_distance():
    rng = random.Random(2)
    with np.errstate(over="ignore"):
        for _ in range(300):
            v = rng.choice([2, 5, 1000])
            a = [rng.randrange(v) for _ in range(rng.randint(0, 50))]
            b = list(a)
            for _ in range(rng.randint(0, 10)):
                p = rng.randint(0, len(b))
                b[p : p + rng.randint(0, 1)] = [rng.randrange(v)] * rng.randint(0, 1)
            d = edit_distance(a, b)
            for limit in {max(0, d - 1), d, d + 1}:
                assert near_dedup.within(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), limit) == (d <= limit)


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(4)
    rows = list(EDGE)
    for g in range(12):
        base = [f"g{g}w{rng.randrange(200)}" for _ in range(rng.randint(40, 120))]
        for c in range(rng.randint(1, 6) if g else 40):
            ws = list(base)
            for _ in range(rng.randint(0, 2)):
                ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
            rows.append((100 * g + c + 50, " ".join(ws), "en", "s", 1))
    got = near_dedup.near_dedup(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = {r[0]: words_of(r[1]) for r in rows}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            la, lb = len(texts[a]), len(texts[b])
            if min(la, lb) >= 0.8 * max(la, lb) and (texts[a] == texts[b] or (max(la, lb) < 1000 and len(set(texts[a]) & set(texts[b])) >= 0.5 * len(set(texts[a])) and edit_distance(texts[a], texts[b]) <= 0.2 * max(la, lb) + 1e-9)):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert {g.doc_id: g.class_id for g in got} == {i: find(i) for i in ids}
    sizes = collections.Counter(find(r[0]) for r in rows)
    assert all(g.class_size == sizes[g.class_id] and g.kept == (g.doc_id == g.class_id) for g in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (5, 5)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_on_the_driver_and_by_rounds(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)], "a long, b long")
    there, rounds = ({r.node: r.root for r in near_dedup.components(edges, few).collect()} for few in (1 << 16, 0))
    assert there == rounds and len(there) > 200 and len(set(there.values())) > 20


def changed(rng, ws, n):
    out = list(ws)
    for at in rng.sample(range(len(ws)), n):
        out[at] = f"x{rng.randrange(10**7)}"
    return out


def test_near_dedup_finds_scattered_edits_near_the_threshold(spark):
    """Of pairs at an edit similarity of 0.80 to 0.85, at every length, nine in ten and more share a class."""
    rng = random.Random(21)
    rows, i = [], 0
    for n in (10, 30, 60, 100, 124, 130, 200, 400):
        for _ in range(40):
            base = [f"w{rng.randrange(20_000)}" for _ in range(n)]
            for ws in (base, changed(rng, base, int(n * rng.uniform(0.15, 0.2)))):
                rows.append((i, " ".join(ws), "en", "s", 1))
                i += 1
    cls = {g.doc_id: g.class_id for g in near_dedup.near_dedup(docs(spark, rows)).collect()}
    found = [cls[j + 1] == j for j in range(0, i, 2)]
    assert all(c in (j, j - j % 2) for j, c in cls.items())  # and nothing else is linked
    assert min(np.mean(found[g : g + 40]) for g in range(0, len(found), 40)) >= 0.85 and np.mean(found) >= 0.95


def test_near_dedup_decides_every_pair_of_a_large_bucket(spark):
    """A hub with variants that are not alike, a chain of versions, and texts that share a long passage only."""
    rng = random.Random(12)
    hub = [f"h{i}" for i in range(200)]
    rows = [(70, " ".join(hub), "en", "s", 1)] + [(i, " ".join(changed(rng, hub, 24)), "en", "s", 1) for i in range(71, 130)]
    version = [f"v{i}" for i in range(100)]
    for i in range(200, 240):
        rows.append((i, " ".join(version), "en", "s", 1))
        version = changed(rng, version, 4)
    passage = [f"p{i}" for i in range(60)]
    for i in range(300, 400):
        rows.append((i, " ".join(passage + [f"own{rng.randrange(10**7)}" for _ in range(rng.randint(25, 60))]), "en", "s", 1))
    rng.shuffle(rows)
    cls = {g.doc_id: g.class_id for g in near_dedup.near_dedup(docs(spark, rows)).collect()}
    assert {cls[i] for i in range(70, 130)} == {70} and {cls[i] for i in range(200, 240)} == {200}
    assert all(cls[i] == i for i in range(300, 400))


@pytest.mark.parametrize("small", [2, 16])
def test_near_dedup_step_3_joins_what_no_leader_met(spark, monkeypatch, small):
    """With the leaders' links lost, the exact join alone finds every link of texts that share a bucket."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, 9)), "en", "s", 1) for i in range(30)]
    real, calls = near_dedup.components, []

    def lossy(edges):
        calls.append(edges)
        return real(edges.limit(0) if len(calls) < 3 else edges)

    monkeypatch.setattr(near_dedup, "components", lossy)
    got = near_dedup.near_dedup(docs(spark, rows), small=small, block=7).collect()
    assert len(calls) == 4 and len({g.class_id for g in got}) <= 2 and collections.Counter(g.class_id for g in got).most_common(1)[0][1] >= 29


def test_near_dedup_judges_each_text_of_a_repeated_id(spark):
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(1, a), (5, b), (5, a[:-1]), (6, b[:-1]), (None, a)]
    got = near_dedup.near_dedup(docs(spark, [(i, " ".join(w), "en", "s", 1) for i, w in rows]))
    got = sorted((g.doc_id or 0, g.class_id or 0, g.class_size, g.kept) for g in got.collect())
    assert got == [(0, 0, 1, True), (1, 1, 2, True), (5, 1, 2, False), (5, 5, 2, True), (6, 5, 2, False)]


@pytest.mark.parametrize("rows_a_frame", [1, 3, 100])
def test_meetings_over_frames(rows_a_frame):
    rng = random.Random(rows_a_frame)
    rows = sorted((g, node, 100, node % 3, [g % 2, 7]) for g in range(20) for node in rng.sample(range(50), rng.choice([1, 2, 4, 5, 9])))
    frames = [pd.DataFrame(rows[i : i + rows_a_frame], columns=["gram", "node", "n", "cls", "open"]) for i in range(0, len(rows), rows_a_frame)]
    got = {(bool(x.family), x.a, x.b) for f in near_dedup.meetings(4, 0.8)(iter(frames)) for x in f.itertuples()}
    want = set()
    for _, members in itertools.groupby(rows, key=lambda r: r[0]):
        nodes = [r[1] for r in members]
        want |= {(True, x, nodes[0]) for x in nodes} if len(nodes) > 4 else {(False, x, y) for x, y in itertools.combinations(nodes, 2) if x % 3 != y % 3}
    assert got == want


@pytest.mark.parametrize("rows_a_frame", [1, 7, 1000])
def test_bucket_pairs_lose_no_similar_pair(rows_a_frame):
    rng = np.random.default_rng(rows_a_frame)
    rows, texts = [], {}
    for key in range(12):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        for _ in range(int(rng.choice([1, 2, 9, 30]))):
            node, w = len(rows), np.where(rng.random(40) < 0.1, rng.integers(0, 2**63, 40, dtype=np.uint64), base)[: int(rng.integers(34, 41))]
            texts[node] = w
            rows.append((key, node, len(w), int(rng.integers(0, 3)), np.sort(w.astype(np.uint16)).tobytes()))
    frames = [pd.DataFrame(rows[i : i + rows_a_frame], columns=["key", "node", "n", "cls", "bag"]) for i in range(0, len(rows), rows_a_frame)]
    with np.errstate(over="ignore"):
        got = [(x.a, x.b) for f in near_dedup.bucket_pairs(0.8)(iter(frames)) for x in f.itertuples()]
        pairs = [(x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[3] != y[3]]
        similar = {(a, b) for a, b in pairs if near_dedup.similar(texts[a], texts[b], 0.8)}
    assert len(got) == len(set(got)) and similar <= set(got) <= set(pairs) and 20 < len(similar) < len(pairs)


def test_near_dedup_families_need_a_common_bucket(spark, monkeypatch):
    """Texts of ten passages that meet in common phrases are no one family, whose work and copies grow with its square."""
    rng = random.Random(31)
    rows = []
    for g in range(10):
        passage = [f"p{g}x{i}" for i in range(100)]
        for _ in range(12):
            rows.append((len(rows), " ".join(passage + [w for i in rng.sample(range(450), 30) for w in (f"c{i}", f"d{i}")]), "en", "s", 1))
    real, families = near_dedup.written, []

    def seen(df, name):
        out = real(df, name)
        if name == "near-family":
            families.extend(r["count"] for r in out.groupBy("root").count().collect())
        return out

    monkeypatch.setattr(near_dedup, "written", seen)
    got = near_dedup.near_dedup(docs(spark, rows), small=2, block=2).collect()
    assert all(g.class_id == g.doc_id for g in got) and families and max(families) <= 12


def test_near_dedup_frequent_grams_make_no_rows(spark, monkeypatch):
    """60 texts that meet in dozens of frequent grams and buckets go to their family by a row for each bucket, not for each gram of it."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, 9)), "en", "s", 1) for i in range(60)]
    real, calls, written, made = near_dedup.components, [], near_dedup.written, collections.Counter()

    def lossy(edges):
        calls.append(edges)
        return real(edges.limit(0) if len(calls) < 3 else edges)

    def seen(df, name):
        out = written(df, name)
        made[name] += out.filter("family").count() if name == "near-met" else out.count()
        return out

    monkeypatch.setattr(near_dedup, "components", lossy)
    monkeypatch.setattr(near_dedup, "written", seen)
    got = near_dedup.near_dedup(docs(spark, rows), small=2, block=7).collect()
    assert collections.Counter(g.class_id for g in got).most_common(1)[0][1] >= 59
    assert made["near-family"] >= 59 and made["near-met"] < 60


def test_near_dedup_grams_of_one_text_make_no_rows(spark, monkeypatch):
    """Texts with a passage in common and 40 words of their own: only what two of them hold is posted."""
    rng = random.Random(17)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(passage + [f"own{rng.randrange(10**9)}" for _ in range(40)]), "en", "s", 1) for i in range(60)]
    written, posted = near_dedup.written, []

    def seen(df, name):
        out = written(df, name)
        if name == "near-rare":
            posted.append(out.agg(F.sum(F.size("grams"))).first()[0])
        return out

    monkeypatch.setattr(near_dedup, "written", seen)
    got = near_dedup.near_dedup(docs(spark, rows), block=7).collect()
    assert all(g.class_id == g.doc_id for g in got) and len(posted) == 1 and posted[0] < 60


def test_near_dedup_blocks_meet_in_rounds(spark, monkeypatch):
    """Blocks of one text, more than one round: no text of a family is copied more than 16 times in a table, every pair is decided."""
    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, 9)), "en", "s", 1) for i in range(60)]
    real, calls, written, rounds = near_dedup.components, [], near_dedup.written, []

    def lossy(edges):
        calls.append(edges)
        return real(edges.limit(0) if len(calls) < 3 else edges)

    monkeypatch.setattr(near_dedup, "components", lossy)
    monkeypatch.setattr(near_dedup, "written", lambda df, name: (rounds.append(name), written(df, name))[1])
    got = near_dedup.near_dedup(docs(spark, rows), small=2, block=1).collect()
    assert collections.Counter(g.class_id for g in got).most_common(1)[0][1] >= 59 and rounds.count("near-met3") > 1


def test_written_leaves_no_shuffle_files(spark):
    def files():
        return set(re.findall(r"shuffle_\d+_\d+", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    before, df = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = written(df, "test")
    assert not files() - before and out.count() == 7


def test_compare_decides_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 30, 40, dtype=np.uint64)
    texts = [np.delete(np.where(rng.random(40) < 0.06, rng.integers(0, 30, 40, dtype=np.uint64), base), rng.integers(0, 40, rng.integers(0, 6))) for _ in range(50)]
    with np.errstate(over="ignore"):
        got = near_dedup.compare(texts, np.ones((50, 50), dtype=bool), 0.8)
        assert all(got[i, j] == near_dedup.similar(texts[i], texts[j], 0.8) for i in range(50) for j in range(50) if i != j) and 100 < got.sum() < 2400
        assert near_dedup.shared_words(texts)[3, 4] == near_dedup.common_words(texts[3], texts[4])


def test_similar_texts_share_a_rare_gram():
    rng = np.random.default_rng(3)
    omh, counts = near_dedup.OrderMinHash(2, 1, 1), rng.integers(0, 9, 64)
    with np.errstate(over="ignore"):
        for _ in range(400):
            n = int(rng.integers(1, 60))
            a = rng.integers(0, 30, n, dtype=np.uint64)
            b = np.delete(np.where(rng.random(n) < 0.1, rng.integers(0, 30, n, dtype=np.uint64), a), rng.integers(0, n, int(rng.integers(0, 5))))
            if len(b) and near_dedup.similar(a, b, 0.8):
                first = [set(near_dedup.rare_first(omh.labelled(near_dedup.mix64(x)), counts)[: near_dedup.prefix_length(len(x), 0.8)].tolist()) for x in (a, b)]
                assert first[0] & first[1]


# ------------------------------------------------------------------ 1 nearest neighbours


@pytest.mark.parametrize("group_rows,query_slice", [(3000, 4000), (10, 7)])
def test_ann_recall_ties_and_invalid_vectors(spark, group_rows, query_slice):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[400:460] = x[20]  # a very common vector
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(1500)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (2080, [1.0] * 3, 1), (2100, [float("inf")] * 16, 1), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("rep", "ids", "vec", "leaf", "g", "s", "score", "rank")})
    got = collections.defaultdict(list)
    for r in ann.nearest(df, k=20, leaf=16, group_rows=group_rows, query_slice=query_slice).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    recall = []
    for q, hits in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and all(abs(s[h[1]] - h[2]) < 1e-9 for h in hits)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(hits, hits[1:], strict=False))
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:20]
        recall.append(len(set(best.tolist()) & {h[1] for h in hits}) / 20)
    assert np.mean(recall) >= 0.9
    if np.dot(x[20], x[20]) > 0:
        assert {h[1] for h in got[400]} <= set(range(1500))


def test_ann_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    two = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in two] == [(0, 1, 3, 0.5)]


def test_ann_searches_each_length_and_each_vector_of_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (20, [1.0, 0.0, 0.0]), (21, [2.0, 0.0, 5.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 2, 2, 0.0), (20, 1, 21, 2.0)]


# ------------------------------------------------------------------ 2 and 10 classifiers


def prose(rng, n=60):
    return " ".join(rng.choice(["house", "tree", "running", "paint", "moon", "river", "quiet", "letter", "seven", "garden"]) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)) + "."


def labelled(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        text, q, t = prose(rng, rng.randint(20, 90)), 1, 0
        if i % 4 == 0:
            text, q = rng.choice([text.upper().replace(" ", "!! "), "buy now " * 40, text.replace(" ", "### ")]), 0
        elif i % 5 == 0:
            ws = text.split()
            ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "scumbag", "scumlike", "moron"]))
            text, t = " ".join(ws), 1
        rows.append((i, text, "en", "s", 1))
        labels.append((i, q, t))
    return rows, labels


def test_quality_held_out_accuracy_and_rules(spark):
    rows, labels = labelled(random.Random(1))
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7777, None, None)], "doc_id long, quality int, toxic int")
    df = clashing(docs(spark, rows + [(9001, None, None, None, None), (9002, "", "en", "s", 0)]))
    model = quality.train(df, lab)
    got = {r.doc_id: r._score for r in quality.score(df, model).select("doc_id", "_score").collect()}
    assert len(got) == 602 and got[9001] == got[9002] and all(0 <= s <= 1 for s in got.values())
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == q for i, q in held]) > 0.97
    stats = np.array([quality.statistics(r[1]) for r in rows])
    assert np.allclose(model.predict(stats), [got[r[0]] for r in rows], atol=1e-9)  # the compiled columns are the model
    assert model.rules and all(str(r) for r in model.rules)


def test_quality_weights_solve_the_lasso():
    """The optimality conditions of mean logistic loss plus penalty * |w|, on rules standardised as in the fit."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, len(quality.STATS)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 1) | (x[:, 5] > 1.5)).astype(float)
    penalty = 5e-3
    model = quality.fit(x, y, penalty=penalty, steps=4000)
    p = model.predict(x)
    assert 0 < len(model.rules) < 60 and abs((p - y).mean()) < 1e-3
    for rule, weight in zip(model.rules, model.weights, strict=True):
        a = rule.of(x).astype(float)
        scale = max((a.mean() * (1 - a.mean())), 1e-4) ** 0.5
        slope = ((a - a.mean()) / scale * (p - y)).mean()
        assert abs(slope + penalty * np.sign(weight)) < 3e-4
    brute = 1 / (1 + np.exp(-(model.bias + sum(w * np.all([(x[:, f] >= lo) & (x[:, f] < hi) for f, lo, hi in r.bounds], axis=0) for r, w in zip(model.rules, model.weights, strict=True)))))
    assert np.allclose(brute, p)


def test_quality_learns_from_one_text_of_an_id(spark):
    rows, labels = labelled(random.Random(5), 200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    twice = rows + [(r[0], "zzz " * 500, "en", "s", 1) for r in rows]
    a, b = (quality.train(docs(spark, t), lab, sample=150) for t in (twice, twice[::-1]))
    assert a == b


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark)
    assert quality.score(df, quality.train(df, none)).count() == len(EDGE)
    assert quality.fit(np.zeros((3, len(quality.STATS))), np.ones(3)).predict(np.zeros((1, len(quality.STATS))))[0] > 0.5


def test_toxicity_held_out_accuracy(spark):
    rows, labels = labelled(random.Random(2), 900)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(clashing(docs(spark, rows + [(9001, None, None, None, None)])), lab).collect()}
    assert len(got) == 901 and got[9001].score < 0.5
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].score >= 0.5) == t for i, t in held]) > 0.97
    toxic = next(i for i, t in held if t and got[i].neighbours)
    assert got[toxic].neighbours[0].label == 1 and got[toxic].neighbours[0].cosine > 0.5


def test_toxicity_without_labels(spark):
    got = toxicity.score_toxicity(docs(spark), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == len(EDGE) and all(r.score <= 0.5 for r in got)


@pytest.mark.parametrize("lead", [1, 8])
def test_example_index_is_exact(lead):
    rng = random.Random(6)
    vecs = []
    for _ in range(400):
        t = np.array(sorted(rng.sample(range(30), rng.randint(1, 5))))
        w = np.array([rng.random() + 0.1 for _ in t])
        vecs.append((t, w / np.linalg.norm(w)))
    index = toxicity.ExampleIndex(np.array([i % 2 for i in range(400)]), vecs, 30, block=16)
    dense = np.zeros((400, 30))
    for i, (t, w) in enumerate(vecs):
        dense[i, t] = w
    for i in range(60):
        all_ = sorted(((float(c), j) for j, c in enumerate(dense @ dense[i]) if j != i), key=lambda x: (-round(x[0], 12), x[1]))
        want = [(j, round(c, 9)) for c, j in all_[:10] if c > 1e-12]
        got = index.top(*vecs[i], 10, skip=i, lead=lead)
        assert [(j, round(c, 9)) for c, j, _ in got] == want and all(y == j % 2 for _, j, y in got)


def test_toxicity_against_brute_force(spark):
    """Scores and evidence from dense vectors over all words, all examples and all documents."""
    rows, labels = labelled(random.Random(3), 300)
    rows += [(2000 + i, r[1], "en", "s", 1) for i, r in enumerate(rows[:20])] + [(None, "river moon", "en", "s", 1), (3000, None, "en", "s", 1), (3001, "", "en", "s", 1), (7, rows[8][1], "en", "s", 1)]
    lab = spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int")
    got = collections.Counter((r.doc_id, round(r.score, 8), tuple((round(x.cosine, 8), x.doc_id, x.label) for x in r.neighbours)) for r in toxicity.score_toxicity(docs(spark, rows), lab, k=5).collect())
    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5}
    text_of = {r.doc_id: r.text for r in docs(spark, rows).withColumn("h", F.xxhash64("text")).orderBy(F.desc("h")).collect()}  # of id 7 the text of smallest hash
    ids = sorted(truth)
    bags = [collections.Counter(re.findall(r"\w+", text_of[i].lower())) for i in ids]
    terms = sorted(set().union(*bags))
    y = np.array([truth[i] for i in ids])
    all_bags = [collections.Counter(re.findall(r"\w+", (r[1] or "").lower())) for r in rows]
    n = [np.array([sum(w in b for b, t in zip(bags, y, strict=True) if t == side) for w in terms], dtype=float) for side in (0, 1)]
    idf = np.array([math.log((1 + len(rows)) / (1 + sum(w in b for b in all_bags))) + 1 for w in terms])
    weight = idf * toxicity.favour(n[0], n[1], int((y == 0).sum()), int(y.sum()), 5.0)

    def unit(bag):
        v = np.array([(1 + math.log(bag[w])) if bag[w] else 0.0 for w in terms]) * weight
        return v / max(np.linalg.norm(v), 1e-300)

    examples = np.stack([unit(b) for b in bags])
    prior = (y.sum() + 0.5) / (len(y) + 1)

    def nearest(v, skip=None):
        c = examples @ v
        return [(c[j], ids[j], int(y[j])) for j in sorted((j for j in range(len(ids)) if j != skip and c[j] > 1e-12), key=lambda j: (-round(c[j], 12), ids[j]))[:5]]

    slope, shift = toxicity.platt(np.array([toxicity.vote(nearest(e, j), prior) for j, e in enumerate(examples)]), y.astype(float))
    want = collections.Counter()
    for r, bag in zip(rows, all_bags, strict=True):
        near = nearest(unit(bag))
        want[r[0], round(toxicity.calibrated(toxicity.vote(near, prior), slope, shift) if near else prior, 8), tuple((round(c, 8), i, t) for c, i, t in near)] += 1
    assert got == want


# ------------------------------------------------------------------ 8 mixing


@pytest.mark.parametrize("weights", [[1, 2], [1, 1, 5], [4, 9996], [0.1, 0.2, 0.7], [1e-3] * 299 + [0.7], [3**0.5, 2**0.5, 7**0.5, 1.0]])
def test_schedule_stays_within_a_block_of_the_true_weights(weights):
    """At every prefix of 30,000 slots and more, while no source has run out; windows hold to the end."""
    w = {f"s{i:03}": fractions.Fraction(x) for i, x in enumerate(weights)}
    total = sum(w.values())
    blocks = {s: math.ceil(30_000 * x / total) + 1 for s, x in w.items()}
    names, share = sorted(w), np.array([float(w[s] / total) for s in sorted(w)])
    at, seen, worst = {s: i for i, s in enumerate(names)}, np.zeros(len(w)), 0.0
    for slot, (s, k, release, deadline) in enumerate(mixing.schedule(blocks, w)):
        assert release <= slot < deadline and k == seen[at[s]]
        seen[at[s]] += 1
        if slot < 30_000:
            worst = max(worst, float(np.abs(seen - (slot + 1) * share).max()))
    assert worst < 1 - 1e-9 and dict(zip(names, seen.astype(int).tolist(), strict=True)) == blocks


def test_every_prefix_of_a_long_schedule_keeps_the_target_weights():
    blocks = {"big": 5000, "rare": 40} | {f"s{i}": 520 for i in range(19)}
    weights = {s: float(n) ** 0.5 for s, n in blocks.items()} | {"rare": 0.02}
    total = sum(weights.values())
    seen, slots, within = collections.Counter(), 0, True
    for slot, (s, k, release, deadline) in enumerate(mixing.schedule(blocks, weights)):
        assert release <= slot < deadline and k == seen[s]
        seen[s] += 1
        slots = slot + 1
        within = within and max(seen[x] / blocks[x] for x in seen) < 0.99  # no source has run out
        if within:
            assert all(abs(seen[x] - slots * weights[x] / total) < 1 + 1e-6 for x in blocks)
    assert seen == blocks and slots == sum(blocks.values())


def test_mixing_places_every_row(spark):
    rows = [(i, "t", "en", "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(1500)] + [(None, "x", "en", None, 1), (4, "again", "en", "hot", 1)]
    got = mixing.mix(clashing(docs(spark, rows)), block=4, weights={"s1": 30.0, "s2": 60.0}).collect()
    assert len(got) == len(rows)
    assert collections.Counter((g.doc_id, g.source) for g in got) == collections.Counter((r[0], r[3]) for r in rows)
    assert len({g.position for g in got}) == len(rows)
    slots = collections.defaultdict(set)
    for g in got:
        slots[g.slot].add((g.source, g.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    counts = collections.Counter(g.source for g in got)
    w = {s: n**0.5 for s, n in counts.items()} | {"s1": 30.0, "s2": 60.0}
    seen, total = collections.Counter(), sum(w.values())
    for n, slot in enumerate(sorted(slots)[:30], 1):
        seen[next(iter(slots[slot]))[0]] += 1
        assert all(abs(seen[s] - n * w[s] / total) < 1 for s in w)


def test_mixing_schedules_every_source(spark):
    rows = [(i, "t", "en", f"s{i % 300}", 1) for i in range(1500)]
    got = mixing.mix(docs(spark, rows), block=5, weights={"s129": 10_000.0}).collect()
    assert len({(g.source, g.slot) for g in got}) == len({g.slot for g in got}) == 300
    assert {g.source for g in got if g.slot == 0} == {"s129"}
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(docs(spark, rows), weights={"s1": -1.0})


# ------------------------------------------------------------------ all: empty tables


def test_empty_tables(spark):
    none = docs(spark, [])
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [
        exact_dedup.exact_dedup(none, digest_all=True), sharding.shard(none), bpe.bpe_round_trip(none, bpe.default_vocab()), line_dedup.line_dedup(none), mixing.mix(none),
        near_dedup.near_dedup(none), substring.substring_dedup(none), toxicity.score_toxicity(none, lab), quality.score(none, quality.train(none, lab)),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)
