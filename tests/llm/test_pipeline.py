"""The pipeline: each stage against brute force on its own input, edge cases, and the run as a whole."""

import collections
import re

import pytest

pytest.importorskip("textloom.llm")

import corpus_pipeline as cp  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from textloom.llm import bpe, mixing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"
EDGE = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "some text here", "en", "b", 1), (4, "a  b", "en", "b", 4), (5, "a b", "en", "b", 3), (5, "a b", "en", "b", 3), (6, "long " * 20_000, None, "c", None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.quality_stage(spark, docs, SF).persist()
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if model.predict(__import__("numpy").array([quality.statistics(r.text)]))[0] >= 0.5}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()

    exact = cp.exact_stage(spark, kept, SF).persist()
    first = {}
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == sorted(first.values())

    near = cp.near_stage(spark, exact, SF).persist()
    assert near.columns == docs.columns and not rows(near) - rows(exact)
    mixed = cp.mixing_stage(spark, near, SF).persist()
    assert mixed.columns == docs.columns and rows(mixed) == rows(near)
    tokens = {r.doc_id: r for r in cp.bpe_stage(spark, mixed, SF).collect()}
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocab())
    for r in mixed.collect():
        e = library.encode(r.text, add_special_tokens=False)
        assert tokens[r.doc_id].n_tokens == len(e.ids) and tokens[r.doc_id].ids_sha256 == bpe.sha256_hex(" ".join(map(str, e.ids)))
    run = cp.run(spark, SF).collect()
    assert {r.doc_id for r in run} == set(tokens) and sorted(r.position for r in run) == list(range(len(run)))
    place = {r.doc_id: r.position for r in mixing.mix(near).collect()}
    assert [r.doc_id for r in sorted(run, key=lambda r: r.position)] == sorted(place, key=place.get)  # the mixture reaches the output


@pytest.mark.parametrize("clash", [False, True])
def test_edge_rows_and_clashing_columns(spark, clash):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    if clash:
        docs = docs.withColumns({c: F.lit("kept") for c in ("_score", "_Stats", "_id", "_source", "_position", "position", "slot", "kept", "key")})
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert not rows(got) - rows(docs), name
    assert rows(cp.mixing_stage(spark, docs, SF)) == rows(docs)
    assert sorted(r.doc_id for r in cp.exact_stage(spark, docs, SF).collect() if r.doc_id is not None) == [1, 4, 6]


def test_a_repeated_id_loses_only_the_text_that_repeats(spark):
    own, common = " ".join(f"own{i}" for i in range(60)), " ".join(f"common{i}" for i in range(60))
    docs = spark.createDataFrame([(1, common, "en", "a", 1), (7, common + " more", "en", "a", 1), (7, own, "en", "a", 1)], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in cp.near_stage(spark, docs, SF).collect()) == [(1, common), (7, own)]
    docs = spark.createDataFrame([(1, common, "en", "a", 1), (7, common, "en", "a", 1), (7, own, "en", "a", 1)], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in cp.exact_stage(spark, docs, SF).collect()) == [(1, common), (7, own)]


def test_empty_input(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
