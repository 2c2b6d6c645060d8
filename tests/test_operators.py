"""Operators on small cases with values worked out by hand, degenerate inputs and plan shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import config
from textloom.functions import fixed
from textloom.functions import scoring as S
from textloom.functions import text as T
from textloom.operators import chunking, cleaning, dense, evaluation, graph, lexical, qa, ranking, records, splitting
from textloom.service import Answerer, Ask, BadRequest, NotFound, Service
from textloom.sources import documents as sources
from textloom.sources import sinks
from textloom.streaming import resumable


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# ------------------------------------------------------------------ BM25

CORPUS = [("d1", "alpha beta"), ("d2", "alpha"), ("d3", "beta")]


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame(CORPUS, "id string, text string")
    got = {r.id: (r.score, r["rank"]) for r in lexical.top_k(lexical.bm25_scores(corpus, spark.createDataFrame([(0, "alpha")], "query_id long, question string")), 5).collect()}
    assert got["d1"] == (pytest.approx(math.log(1.6) * 2.5 / 3.0625), 2)
    assert got["d2"] == (pytest.approx(math.log(1.6) * 2.5 / (1 + 1.5 * (0.25 + 0.75 / (4 / 3)))), 1)
    assert "d3" not in got


def test_bm25_repeated_terms_no_hits_empty_and_parameters(spark):
    corpus = spark.createDataFrame([*CORPUS, ("d4", ""), ("d5", None)], "id string, text string")
    q = spark.createDataFrame([(0, "beta"), (1, "beta beta"), (2, "absent"), (3, "")], "query_id long, question string")
    got = {(r.query_id, r.id): r.score for r in lexical.bm25_scores(corpus, q).collect()}
    assert got[1, "d3"] == pytest.approx(2 * got[0, "d3"]) and not [k for k in got if k[0] > 1]
    assert lexical.bm25_scores(spark.createDataFrame([], "id string, text string"), q).count() == 0
    for bad in ({"k1": 0.0}, {"b": 1.5}, {"b": -0.1}):
        with pytest.raises(ValueError):
            lexical.bm25_scores(corpus, q, **bad)


def test_bm25_stored_index_equals_direct(spark, tmp_path):
    corpus = spark.createDataFrame(CORPUS, "id string, text string")
    q = spark.createDataFrame([(0, "alpha beta")], "query_id long, question string")
    lexical.LexicalIndex.of(corpus).write(str(tmp_path))
    stored = lexical.search_index(lexical.LexicalIndex.read(spark, str(tmp_path)), q)
    assert {(r.id, round(r.score, 12)) for r in stored.collect()} == {(r.id, round(r.score, 12)) for r in lexical.bm25_scores(corpus, q).collect()}


def test_ties_are_broken_by_string_ids_and_the_plan_takes_ordered(spark):
    corpus = spark.createDataFrame([(i, "same text") for i in (2, 10, 1)], "id long, text string")
    df = lexical.search_one(corpus, "same", 3)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().toString()
    q = spark.createDataFrame([(0, "same")], "query_id long, question string")
    assert [r.id for r in lexical.top_k(lexical.bm25_scores(corpus, q), 3).orderBy("rank").collect()] == [1, 10, 2]


# ------------------------------------------------------------------ dense, fusion, reranking


def make_encoder():
    return lambda texts: np.array([[3.0, 0.0] if "alpha" in t else [0.0, 2.0] for t in texts])


def test_dense_build_normalises_and_searches(spark):
    corpus = spark.createDataFrame([("a", 0, "alpha one"), ("b", 1, "beta")], "id string, pos long, text string")
    encode = make_encoder()
    index = dense.build(corpus, encode).persist()
    assert {r.id: list(r.embedding) for r in index.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    q = dense.encode_queries(spark.createDataFrame([(0, "alpha query")], "query_id long, question string"), encode)
    hits = dense.search(index, q, 2).orderBy("rank").collect()
    assert [(h.id, round(h.score, 6)) for h in hits] == [("a", 1.0), ("b", 0.0)]
    with pytest.raises(Exception, match="vectors for"):
        dense.build(corpus, lambda t: np.zeros((5, 2))).collect()


def test_dense_blocks_ties_nulls_and_missing_chunks(spark):
    rows = [(i, i, [float(i % 3 == 0), float(i % 3 != 0)]) for i in range(60)] + [(90, 90, None), (91, 91, [1.0])]
    index = spark.createDataFrame(rows, "id long, pos long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id long, embedding array<double>")
    hits = dense.search(index, q, 5, block=7).orderBy("rank").collect()
    assert [h.id for h in hits] == [0, 3, 6, 9, 12] and {h.query_id for h in hits} == {0}
    some = spark.createDataFrame([(3,), (9,)], "id long")
    assert sorted(r.id for r in dense.resolve(dense.search(index, q, 5), some).collect()) == [3, 9]


def ranked(spark, *ids):
    return spark.createDataFrame([(0, i, n + 1) for n, i in enumerate(ids)], "query_id long, id string, rank int")


def test_fusion_by_hand(spark):
    got = ranking.fuse(ranked(spark, "a", "b"), ranked(spark, "b", "c")).orderBy("rank").collect()
    assert [(r.id, round(r.score, 12)) for r in got] == [("b", round(1 / 62 + 1 / 61, 12)), ("a", round(1 / 61, 12)), ("c", round(1 / 62, 12))]
    skipped = ranking.fuse(ranked(spark, "", "a", "a", "b")).orderBy("rank").collect()
    assert [(r.id, round(r.score, 12)) for r in skipped] == [("a", round(1 / 61, 12)), ("b", round(1 / 62, 12))]
    assert ranking.fuse(ranked(spark, "a", "b"), ranked(spark, "b", "c"), weights=[5.0, 1.0]).filter("rank = 1").first().id == "b"
    with pytest.raises(ValueError):
        ranking.fuse(ranked(spark, "a"), k=0)


def test_rerank_by_model_and_stable_ties(spark):
    rows = [(0, "s", 1, "q", "x"), (0, "l", 2, "q", "long text"), (0, "m", 3, "q", "long text")]
    c = spark.createDataFrame(rows, "query_id long, id string, rank int, question string, text string")
    got = ranking.rerank(c, lambda pairs: [len(t) for _, t in pairs], 3, batch=2).orderBy("rank").collect()
    assert [r.id for r in got] == ["l", "m", "s"]


def test_retriever_modes(spark):
    corpus = spark.createDataFrame([("a", "alpha yes"), ("b", "beta no")], "id string, text string")
    index = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "id string, pos long, embedding array<double>")
    q = spark.createDataFrame([(0, "alpha beta alpha", [1.0, 0.0])], "query_id long, question string, embedding array<double>")
    r = ranking.Retriever(corpus, index, scorer=F.contains("text", F.lit("yes")).cast("double"))
    for mode in ranking.MODES:
        assert r.search(q, mode, 2).filter("rank = 1").first().id == "a", mode
    assert {x.id for x in r.search(q, "hybrid", 5).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        r.search(q, "other")
    with pytest.raises(FileNotFoundError):
        ranking.Retriever(corpus).search(q, "dense")
    assert ranking.Retriever(corpus).search(q, "bm25").count() == 2


# ------------------------------------------------------------------ metrics


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("m", 0, ["a", "b", "c"], ["b", "c"]), ("m", 1, ["d", "x", "e"], ["e", "f"]), ("m", 2, ["z"], [])], "mode string, query_id long, ranked array<string>, gold array<string>")
    r = evaluation.retrieval_metrics(df.filter("query_id < 2"), ["mode"]).first()
    assert (r.recall_5, r.mrr_10, r.hit_5, r.n) == (0.75, pytest.approx((1 / 2 + 1 / 3) / 2), 2, 2)
    assert evaluation.retrieval_metrics(df, ["mode"]).first().recall_5 == pytest.approx(0.5)
    lo, hi = S.wilson(F.lit(15), F.lit(33))
    assert one(spark, (lo + hi) / 2) == pytest.approx(0.4593, abs=1e-4)
    assert one(spark, S.share_text(F.lit(1), F.lit(8))) == "1/8 (12%)" and one(spark, S.share_text(F.lit(0), F.lit(0))) == "0/0 (0%)"
    assert one(spark, S.nearest_rank(F.array(*map(F.lit, [3.0, 1.0, 10.0, 2.0])))) == 10.0


def test_answer_functions(spark):
    f1 = lambda a, b: one(spark, S.token_f1(F.lit(a), F.lit(b)))
    assert f1("a a b [1]", "a b b") == pytest.approx(2 / 3) and f1("", "x") == 0 and f1("x", "y") == 0
    assert one(spark, S.containment(F.lit("Port the number"), F.lit("the number, the fee"))) == pytest.approx(0.5)
    assert one(spark, S.unsupported(F.lit("fee fee ten"), F.array(F.lit("the fee")))) == pytest.approx(1 / 3)
    assert one(spark, S.support_overlap(F.lit("the port fee"), F.lit("Port numbers"))) == pytest.approx(0.5)
    quotes = lambda q, t: one(spark, S.all_quotes_in(F.array(*map(F.lit, q)) if q else F.array().cast("array<string>"), F.lit(t)))
    assert quotes(["exact  TEXT"], "an Exact text") and not quotes(["missing"], "text") and not quotes([], "text") and quotes([""], "text")
    assert not one(spark, S.any_quote_in(F.array(F.lit("")), F.array(F.lit("text"))))


def test_auroc_and_threshold(spark):
    rows = [(1.0, True), (0.5, True), (0.5, False), (0.2, False)]
    df = spark.createDataFrame(rows, "score double, positive boolean")
    assert evaluation.auroc(df).first().auroc == pytest.approx((2 + 1 + 0.5) / 4)
    assert math.isnan(evaluation.auroc(df.filter("positive")).first().auroc)
    got = evaluation.best_threshold(df).first()
    assert (got.threshold, got.balance) == (pytest.approx(0.35), 0.75)  # the lowest of two equal cuts


def test_review_decisions_and_renumbering(spark):
    items = spark.createDataFrame([("a", "q1", "r1", False), ("b", "q2", "r2", False), ("c", "q3", "r3", False), ("d", "q4", "r4", True)], "id string, question string, answer string, verified boolean")
    decisions = spark.createDataFrame([("a", "keep", None, None), ("b", "edit", "new", None), ("c", "delete", None, None)], "id string, action string, question string, answer string")
    got = {r.id: (r.question, r.answer, r.verified) for r in evaluation.apply_decisions(items, decisions).collect()}
    assert got == {"a": ("q1", "r1", True), "b": ("new", "r2", True), "d": ("q4", "r4", True)}
    assert evaluation.renumber(items, ["question"]).filter("question = 'q2'").first().id == "eval-0002"


# ------------------------------------------------------------------ text and cleaning


def test_text_functions(spark):
    assert one(spark, T.clean_text(F.lit(" a\t\tb \r\n\r\n\r\n\r\n c\rd\f"))) == "a b\n\nc\nd"
    assert one(spark, T.collapse(F.lit("  a  \n b "))) == "a b"
    assert one(spark, T.tokens(F.lit("Don't STOP 4g’s"))) == ["don't", "stop", "4g’s"]
    assert one(spark, T.slug_filename(F.lit("Mobile: number/portability!"))) == "mobile_number_portability.txt"
    assert one(spark, T.family_slug(F.lit("--"))) == "UNKNOWN"
    assert one(spark, T.citation_numbers(F.lit("x [2] y [1][2]"))) == [2, 1]
    assert one(spark, T.has_phone(F.lit("call +91 98765 43210"))) and not one(spark, T.has_phone(F.lit("code 1234567")))
    assert one(spark, T.canonical_json({"b": F.lit(1), "a": F.lit('x"y'), "c": F.lit(None).cast("string")})) == '{"a": "x\\"y", "b": 1, "c": null}'
    assert one(spark, T.format_passage(F.lit(1), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(" t "))) == "[1] Unknown title (year unknown)\nt"
    assert one(spark, T.url_quote(F.lit("a b/c"))) == "a%20b%2Fc" and one(spark, T.url_last_part(F.lit("http://x/wiki/A%20b"))) == "A b"
    assert one(spark, T.mentions_abstention(F.lit("Well, " + fixed.ABSTENTION.upper()))) and not one(spark, T.abstained_exactly(F.lit("Well, " + fixed.ABSTENTION)))


@pytest.mark.parametrize("line,page,want", [("Page 3 of 9", 0, True), ("3/9", 7, True), ("12", 11, True), ("12", 3, False), ("17 of 1933.", 0, False), ("12 apples", 11, False), ("pg. 4", 0, True)])
def test_page_numbers(spark, line, page, want):
    assert one(spark, T.is_page_number(F.lit(line), F.lit(page))) is want


def test_page_furniture_and_cleaning(spark):
    pages = [("d", i, f"Running Head 2021\nbody {'abc'[i]}\n17 of 1933.\nmore {'abc'[i]}\n\nPage {i + 1} of 37") for i in range(3)] + [("d", 3, "clean page\n4"), ("e", 0, "only\nonce")]
    df = spark.createDataFrame(pages, "doc string, page int, text string")
    got = {(r.doc, r.page): r.text for r in cleaning.clean_pages(df).collect()}
    assert got["d", 0] == "body a\n17 of 1933.\nmore a" and got["d", 3] == "clean page" and got["e", 0] == "only\nonce"
    assert [r.key for r in cleaning.removed_lines(df).collect() if r.doc == "d" and "head" in r.key] == ["running head #"]


def test_english_filter(spark):
    vocab = "the rules of this service".split()
    reason = lambda t: one(spark, cleaning.english_reason(F.lit(t), vocab))
    assert reason("the rules") is None and reason("bad � char") == "replacement_character"
    assert reason("यह हिन्दी वाक्य है") == "devanagari" and reason("zxq wvut plmk") == "not_english" and reason("12 34") == "not_english"
    units = spark.createDataFrame([("s", "the rules of this service\nयह\nthe rules apply"), ("s", "यह हिन्दी है")], "source string, text string")
    got = cleaning.filter_english(units, vocab).collect()
    assert sorted((r.reason or "", r.text) for r in got)[0] == ("", "the rules of this service\nthe rules apply")
    assert sum(r.units for r in cleaning.english_report(cleaning.filter_english(units, vocab)).collect()) == 2


def test_word_repair(spark):
    counts = {"service": 30, "ervice": 1, "prepaid": 5, "as": 40, "dot": 9, "are": 50, "valid": 9, "do": 30, "a": 90, "s": 1, "network": 8, "sim": 4, "rules": 12}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = {
        "S ervice": "Service", "pre -paid": "pre-paid", "pre - paid": "pre-paid", "pre-paid": "pre-paid", "a s it": "as it", "Do T": "DoT", "DO T": "DOT", "do t": "dot", "Are a valid": "Are a valid", "servic e": "service", "Servic e.": "Service.",
        "NET WORK": "NETWORK", "Net WORK": "NetWORK", "net work net work": "network network", "n e t work": "n e t work", "si m, ru les\tru\tles": "sim, rules\trules", "": "", None: None,
    }
    got = {r.before: r for r in cleaning.repair_words(spark.createDataFrame([(t, t) for t in want], "before string, text string"), words).collect()}
    assert {k: v.text for k, v in got.items()} == want
    assert got["net work net work"].fixes == ["net work -> network"] * 2 and got["pre-paid"].fixes == [] and got["S ervice"].fixes == ["S ervice -> Service"]
    units = spark.createDataFrame([("the service works",), ("the service is good",), ("serv ice",)], "text string")
    got = cleaning.repair_words(units).collect()
    assert [x for x in got if x.fixes][0].text == "service"
    assert cleaning.fix_report(cleaning.repair_words(units)).first().fix == "serv ice -> service"


@pytest.mark.parametrize(
    "name,kind,page,want",
    [
        ("mnp_regulations_2009.pdf", "manual", "", ("final_regulation", 2009, "MNP")), ("Draft_TCPR_2012.pdf", "manual", "", ("draft_or_consultation", 2012, "TCPR")), ("qos.pdf", "manual", "of 12 May 2017", ("final_regulation", 2017, "QOS")),
        ("airtel_citizen_charter.pdf", "manual", "", ("faq_or_guide", None, "AIRTEL")), ("pib_note_2020.html", "manual", "", ("faq_or_guide", 2020, "MANUAL_PIB_NOTE_2020")), ("Mobile phone.txt", "wikipedia", "in 1999", ("encyclopedia", None, "WIKIPEDIA_MOBILE_PHONE")),
        ("notes.pdf", "manual", "these recommendations", ("final_regulation", None, "MANUAL_NOTES")),
    ],
)
def test_metadata(spark, name, kind, page, want):
    df = spark.createDataFrame([(name, kind, None, page)], "name string, source_type string, title string, first_page string")
    r = cleaning.infer_metadata(df).first()
    assert (r.doc_type, r.year, r.family) == want


# ------------------------------------------------------------------ chunks


def test_chunks_are_bounded_overlap_and_have_stable_ids(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    units = spark.createDataFrame([(0, text), (1, "telecom " * 80), (2, "  "), (3, None), (4, text)], "unit_pos long, text string")
    chunks = chunking.chunk_texts(units, size=32, overlap=8)
    got = chunking.with_ids(chunks, F.lit("{}"), ["unit_pos", "chunk_pos"]).collect()
    assert all(len(chunking.lexical_tokens(r.text)) <= 32 for r in got) and not [r for r in got if r.unit_pos in (2, 3)]
    assert len({r.id for r in got}) == len(got)
    assert {r.id for r in got} == {r.id for r in chunking.with_ids(chunks, F.lit("{}"), ["unit_pos", "chunk_pos"]).collect()}
    first = sorted((r for r in got if r.unit_pos == 1), key=lambda r: r.chunk_pos)
    assert first[0].text[-10:] in first[1].text
    assert next(r.id for r in got if r.unit_pos == 0 and r.chunk_pos == 0) == chunking.stable_id({}, next(r.text for r in got if r.unit_pos == 0 and r.chunk_pos == 0), 0)
    for bad in ((0, 0), (8, 8), (8, -1)):
        with pytest.raises(ValueError):
            chunking.check_sizes(*bad)


def test_recursive_split_keeps_all_text():
    text = "para one. Two here.\n\npara two " + "x" * 30 + " end"
    for limit in (3, 5, 9):
        parts = list(chunking.split_recursive(text, limit))
        assert all(len(p) <= limit for p in parts) and "".join("".join(p) for p in parts).split() == text.split()


# ------------------------------------------------------------------ QA data

GOOD = "This clear section explains how a customer can move a number to another operator within the time that the rules allow and which documents the customer must keep ready for the request to be accepted without any further delay or charge today."


@pytest.mark.parametrize(
    "text,family,want",
    [
        (GOOD, "MNP", None), (GOOD + " Stakeholders submitted views.", "qos", "qos_stakeholder_discussion"), ("Contents\nOne .... 1\nTwo .... 2", "X", "table_of_contents_or_index"), ("too short", "X", "under_40_words"), ("", "X", "under_40_words"), (None, None, "under_40_words"),
        ("Contact centre\n" + "\n".join(f"office {i}@x.org" for i in range(5)), "X", "address_or_contact_list"), ("\n".join("1 2 3 4 5" for _ in range(5)), "X", "mostly_numbers_or_tables"),
    ],
)
def test_rejection_reasons(spark, text, family, want):
    df = spark.createDataFrame([(text, family)], "text string, family string")
    assert qa.annotate(df).first().qa_rejection_reason == want


def test_items_and_citations(spark):
    items = [{"question": "q", "answer": "a", "evidence": ["exact"]}, {"question": "q", "answer": "a", "evidence": ["missing"]}, {"question": "", "answer": "a", "evidence": ["exact"]}, {"question": "q", "answer": "a", "evidence": []}, {"question": "q", "answer": "a", "evidence": [""]}]
    df = spark.createDataFrame([("an exact text", items)], "text string, items array<struct<question:string,answer:string,evidence:array<string>>>")
    assert len(df.select(qa.valid_items(F.col("items"), F.col("text")).alias("x")).first()["x"]) == 1
    answers = spark.createDataFrame([("A [1].", ["c1"]), ("See [3].", ["c1"]), ("none", ["c1"]), (fixed.ABSTENTION, ["c1"]), ("[99999999999]", ["c1"])], "answer string, context array<string>")
    got = [(r.abstained, r.cited_ids, r.invalid_citations) for r in qa.resolve_citations(answers).collect()]
    assert got == [(False, ["c1"], []), (False, [], [3]), (False, [], []), (True, [], []), (False, [], [None])]


def test_generator_output_and_cache(spark):
    assert qa.first_json_array('noise [1] then [{"question": "q"}] tail') == [{"question": "q"}] and qa.first_json_array("none") == []
    df = spark.createDataFrame([('x [{"question": "q", "answer": "a", "evidence": "e"}]',)], "r string")
    assert df.select(qa.parse_items("r").alias("x")).first()["x"][0].evidence == ["e"]
    chunks = spark.createDataFrame([("1", GOOD), ("2", "other words here")], "id string, text string")
    first = qa.generate(chunks, qa.mock_items, 1).persist()
    again = qa.generate(chunks, lambda t, n: [], 1, cache=first.filter("id = '1'"))
    assert {r.id: len(r["items"]) for r in again.collect()} == {"1": 1, "2": 0}


def test_prompt_and_training_text(spark):
    df = spark.createDataFrame([(" why? ", [("T", 2024, "body"), (None, None, "more")])], "q string, c array<struct<title:string,year:int,text:string>>")
    m = df.select(qa.prompt(F.col("q"), F.col("c"), "sys").alias("m"), qa.prompt(F.col("q"), F.col("c"), "base", use_context=False).alias("b"), qa.prompt(F.col("q"), F.slice("c", 1, 0), "sys").alias("e")).first()
    assert m.m[1].content == "Context passages:\n[1] T (2024)\nbody\n\n[2] Unknown title (year unknown)\nmore\n\nQuestion: why?"
    assert m.b[1].content == "why?" and fixed.NO_PASSAGES in m.e[1].content
    rows = df.select(qa.training_text(qa.prompt(F.col("q"), F.col("c"), "sys"), F.lit("done")).alias("t"))
    assert rows.first().t.endswith("<|assistant|>\ndone</s>") and qa.within_length(rows, F.col("t"), 500).count() == 1
    with pytest.raises(ValueError):
        qa.within_length(rows, F.col("t"), 3)


def test_similar_pairs_are_lossless_and_greedy_order(spark):
    import difflib
    import random

    rng = random.Random(1)
    base = ["how do i port my number", "what is the fee for roaming", "can i cancel my plan today"]
    texts = []
    for i in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        texts.append((i, i, "".join(t)))
    df = spark.createDataFrame(texts, "id long, pos long, text string")
    want = {(a, b) for a, _, x in texts for b, _, y in texts if a < b and difflib.SequenceMatcher(None, x, y).ratio() >= 0.88}
    assert {(r.a, r.b) for r in qa.similar_pairs(df, df, 0.88, same=True).collect()} == want
    kept = []
    for i, _, _ in texts:
        if not any((j, i) in want for j in kept):
            kept.append(i)
    assert sorted(r.id for r in qa.greedy_distinct(df).filter("accepted").collect()) == kept


def test_components(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(50, 60)], "a long, b long")
    assert {r.node: r.root for r in graph.components(e).collect()} == {**{i: 0 for i in range(1, 21)}, 60: 50}


# ------------------------------------------------------------------ splits


def family_rows():
    sizes = {"MNP": 60, "TCPR": 50, "QOS": 70, "KYC": 40, "JIO": 30, "AIRTEL": 35, "ACT": 200, "HANDBOOK": 90}
    return [(f"{f}.pdf", f, "manual") for f, n in sizes.items() for _ in range(n)] + [(f"w{i}.txt", f"WIKI{i}", "wikipedia") for i in range(4) for _ in range(12)]


def test_family_split_constraints(spark):
    chunks = spark.createDataFrame(family_rows(), "source string, family string, source_type string")
    got = splitting.split_families(chunks, eval_fraction=0.4, regulations=["MNP", "TCPR", "QOS"], mandatory=["MNP", "TCPR"], operators=["JIO", "AIRTEL"]).collect()
    ev = {r.family: r.chunks for r in got if r.split == "eval"}
    total = sum(ev.values())
    assert {"MNP", "TCPR", "QOS"} <= set(ev) and {"JIO", "AIRTEL"} & set(ev) and max(ev.values()) <= 0.3 * total
    wiki = sum(n for f, n in ev.items() if f.startswith("WIKI"))
    assert wiki <= 0.15 * total and sum(f.startswith("WIKI") for f in ev) <= 2
    kept = splitting.split_families(chunks, preserved=["QOS"]).filter("split = 'eval'").collect()
    assert [r.family for r in kept] == ["QOS"]
    for bad in ([], ["NONE"]):
        with pytest.raises(ValueError):
            splitting.split_families(chunks, preserved=bad)
    summary = splitting.split_summary(splitting.split_families(chunks, preserved=["QOS"])).first()
    assert summary.eval_chunks == 70 and summary.total_chunks == len(family_rows())
    with pytest.raises(Exception, match="exactly one family"):
        splitting.document_stats(spark.createDataFrame([("s", "A", "m"), ("s", "B", "m")], "source string, family string, source_type string")).collect()


def test_quotas_and_leakage(spark):
    assert splitting.quotas(10) == {"unanswerable": 2, "multi": 2, "single": 6} and splitting.document_cap(5, 0.1) == 1
    chunks = spark.createDataFrame([("a", "s1", "F1"), ("b", "s2", "F2"), ("c", "s3", "F1")], "id string, source string, family string")
    found = splitting.leakage(spark.createDataFrame([("a",), ("b",), ("z",)], "id string"), chunks, spark.createDataFrame([("s2",)], "source string"), spark.createDataFrame([("F1",)], "family string"))
    assert sorted((r.id, r.problem) for r in found.collect()) == [("a", "family"), ("b", "source"), ("z", "unknown")]
    with pytest.raises(ValueError):
        splitting.require_clean(found)
    pairs = splitting.adjacent_pairs(chunks.withColumn("source", F.lit("s")).withColumn("pos", F.col("id"))).collect()
    assert [(r.first, r.second) for r in pairs] == [("a", "b")]


def test_record_order_and_citation(spark):
    r = one(spark, qa.sft_record(F.lit("g"), F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit("A fact [1] [2]."), F.lit("7")))
    assert sorted(r.context) == ["g", "x", "y", "z"] and r.answer == f"A fact. [{r.context.index('g') + 1}]"
    last = one(spark, qa.sft_record(F.lit("g"), F.array(*map(F.lit, "wxyz")), F.lit("A"), F.lit("7"), gold_last=True))
    assert last.context[-1] == "g" and last.answer == "A [5]"
    none = one(spark, qa.sft_record(F.lit(None).cast("string"), F.array(F.lit("x")), F.lit("No."), F.lit("7")))
    assert none.context == ["x"] and none.answer == "No."


def test_builds(spark):
    words = "customer number operator request charge roaming tariff network service complaint".split()
    rows = []
    for s in range(6):
        for c in range(6):
            text = f"Topic{s}x{c} " + GOOD.replace("section", words[(s + c) % 10] + str(s * 7 + c)) + f" code{s}{c} unique{c}{s}."
            rows.append((f"s{s}c{c}", text, f"src{s}", f"FAM{s}", c))
    chunks = spark.createDataFrame(rows, "id string, text string, source string, family string, pos long")
    asked = qa.unsupported_questions(spark, ["Can I get {feature}?", "Is {feature} free?"], [f"moon tariff {i}" for i in range(8)])
    train = records.build_training(chunks, spark.createDataFrame([(f"src{i}",) for i in range(4)], "source string"), qa.mock_items, unanswerable=asked, target=10, share=0.5, threshold=0.995).collect()
    yes = [r for r in train if r.answerable]
    assert yes and all(r.gold_chunk_ids[0] in r.context and not r.context[0].startswith(("s4", "s5")) for r in yes)
    assert all(r.answer.endswith(f"[{r.context.index(r.gold_chunk_ids[0]) + 1}]") for r in yes)
    assert all(r.answer == fixed.ABSTENTION for r in train if not r.answerable) and {r.split for r in yes} == {"train", "val"}
    ev = records.build_evaluation(chunks, spark.createDataFrame([("src4",), ("src5",)], "source string"), qa.mock_items, unanswerable=asked, target=8, share=0.9).collect()
    assert len(ev) == 8 and sum(not r.answerable for r in ev) == 2 and any(len(r.gold_chunk_ids) == 2 for r in ev)
    assert all(g.startswith(("s4", "s5")) for r in ev for g in r.gold_chunk_ids)
    with pytest.raises(ValueError):
        records.build_evaluation(chunks, spark.createDataFrame([("src4",)], "source string"), qa.mock_items, unanswerable=asked, target=500)


# ------------------------------------------------------------------ sources and sinks


def test_html_and_markdown(spark):
    html = "<html><head><title> My  page </title><script>x()</script></head><body><nav>menu</nav><h1>Head</h1><p>Body &amp; more</p><footer>f</footer></body></html>"
    pages = spark.createDataFrame([("1", html), ("2", ""), ("3", None)], "id string, html string")
    r = sources.html_units(pages, F.col("id"), F.col("html")).collect()
    assert [(x.source, x.doc_title, x.section) for x in r] == [("1", "My page", ["Head"])] and r[0].text == "My page\nHead\nBody & more"
    md = spark.createDataFrame([("dir/my_file.md", "intro\n# One #\na\n\nb\n## Two\n"), ("e.md", "")], "source string, text string")
    got = [(x.section, x.text) for x in sources.markdown_units(md).orderBy("source", "section_no").collect()]
    assert got == [("my file", "intro"), ("One", "a\n\nb")]


def test_files_and_broken_pdfs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("﻿hello", encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_text("deep", encoding="utf-8")
    (tmp_path / "excluded_c.txt").write_text("no", encoding="utf-8")
    (tmp_path / "x.pdf").write_bytes(b"good")
    (tmp_path / "y.pdf").write_bytes(b"bad")
    assert sorted(r.text for r in sources.text_files(spark, str(tmp_path)).collect()) == ["deep", "hello"]

    def extract(content):
        if content == b"bad":
            raise ValueError("broken")
        return ["page one", "page two"]

    pages = sources.page_texts(sources.binary_files(spark, str(tmp_path)), extract).collect()
    assert sorted((r.page, r.text, r.error) for r in pages if r.error is None) == [(0, "page one", None), (1, "page two", None)]
    assert [r.error for r in pages if r.error] == ["ValueError: broken"]


def test_json_lines(spark):
    lines = spark.createDataFrame([(1, '﻿{"text": " a ", "title": "T"}'), (2, '{"text": "b"}'), (3, "broken")], "line_no long, value string")
    got = {r.line_no: (r.text, r.source, r.source_type) for r in sources.json_units(lines).collect()}
    assert got[1] == ("a", "T", "wikipedia") and got[2] == ("b", "record 2", "wikipedia") and got[3][0] == ""


class FakeClock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def sleep(self, s):
        self.waits.append(round(s, 3))
        self.now += s

    def clock(self):
        return self.now


def test_polite_client_retries(spark):
    answers = [(429, {"Retry-After": "3"}, None), (503, {}, None), (200, {}, {"title": "T"}), (200, {}, {"title": "U"})]
    c = FakeClock()
    client = sources.PoliteClient(lambda t, timeout: answers.pop(0), sleep=c.sleep, clock=c.clock, interval=1.0)
    assert client.fetch("a") == {"title": "T"} and client.fetch("b") == {"title": "U"} and c.waits == [3.0, 2.0, 1.0]
    with pytest.raises(OSError):
        sources.PoliteClient(lambda t, timeout: (404, {}, None), sleep=c.sleep, clock=c.clock).fetch("x")
    assert sources.retry_after("7") == 7 and sources.retry_after("Wed, 21 Oct 2015 07:28:00 GMT") == 0 and sources.retry_after("x") is None and sources.retry_after(None) is None


def test_pages_source(spark):
    class Mine(sources.PagesSource):
        @staticmethod
        def client_factory():
            def get(title, timeout):
                return (200, {}, {"title": title.upper(), "text": "body"}) if title != "gone" else (404, {}, None)

            return sources.PoliteClient(get, interval=0.0)

    spark.dataSource.register(Mine)
    got = {r.requested_title: (r.title, r.status) for r in spark.read.format("pages_api").option("titles", "a|gone").load().collect()}
    assert got == {"a": ("A", "downloaded"), "gone": ("gone", "error")}


def test_sinks_round_trip(spark, tmp_path):
    p = str(tmp_path)
    chunks = spark.createDataFrame([("1", "t", "s")], "id string, text string, source string")
    sinks.write_chunks(chunks, f"{p}/c")
    sinks.replace_table(spark, f"{p}/c", lambda df: df.withColumn("usable_for_qa", F.lit(True)))
    assert spark.read.parquet(f"{p}/c").first().usable_for_qa
    sinks.write_chunks(chunks, f"{p}/c.jsonl", jsonl=True)
    assert sources.read_chunks(spark, f"{p}/c.jsonl").first().id == "1"
    preds = spark.createDataFrame([("A", "1", "x"), ("A", "2", "y")], "system string, id string, answer string")
    sinks.append_predictions(preds, f"{p}/p")
    sinks.append_predictions(preds.limit(1), f"{p}/p")
    assert sinks.read_predictions(spark, f"{p}/p").count() == 2
    assert sinks.markdown_table(preds).splitlines()[0] == "| system | id | answer |"
    sinks.write_json_document(spark.createDataFrame([([("QOS", 3)],)], "eval_families array<struct<family:string,chunks:int>>"), f"{p}/split.json")
    assert sources.read_split(spark, f"{p}/split.json") == ["QOS"]
    sinks.write_records(spark.createDataFrame([("q", "train"), ("r", "val")], "question string, split string"), f"{p}/r")
    assert spark.read.json(f"{p}/r").filter("split = 'val'").first().question == "r"
    sinks.write_metrics(preds, f"{p}/m")
    assert spark.read.option("header", True).csv(f"{p}/m").count() == 2
    sinks.write_manifest(chunks, f"{p}/manifest")
    assert "retrieved_at" in spark.read.json(f"{p}/manifest").columns
    sinks.write_dense_index(spark.createDataFrame([("1", [1.0])], "id string, embedding array<double>"), f"{p}/idx", "model")
    assert dense.read_index(spark, f"{p}/idx").count() == 1 and spark.read.parquet(f"{p}/idx.meta").first().model == "model"


# ------------------------------------------------------------------ resuming, service, settings


def test_resume_in_two_steps(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", i) for i in range(10)], "id string, pos long")
    make = lambda df: df.filter("id != 'c3'").select("id", F.concat(F.lit("q "), "id").alias("question"))
    out = str(tmp_path / "o")
    assert resumable.process(spark, chunks, out, make, most=5) == 5
    left = resumable.pending(chunks, spark.read.parquet(f"{out}/ledger"))
    assert sorted(r.id for r in left.collect()) == [f"c{i}" for i in range(5, 10)]
    assert resumable.process(spark, chunks, out, make) == 5 and resumable.process(spark, chunks, out, make) == 0
    got = resumable.read_records(spark, out)
    assert got.count() == 9 and [r.id for r in spark.read.parquet(f"{out}/rejects").collect()] == ["c3"]
    make(chunks).limit(3).write.mode("append").parquet(f"{out}/records")  # a step that was cut off before its ledger
    assert resumable.read_records(spark, out).count() == 9


def test_stream_processes_each_file_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    make = lambda df: df.filter("id % 2 = 0").select("id")
    spark.range(10).repartition(2).write.parquet(src)
    resumable.stream(spark, src, "id long", out, cp, make)
    spark.range(10, 14).write.mode("append").parquet(src)
    resumable.stream(spark, src, "id long", out, cp, make)
    read = lambda kind: sorted(r.id for r in spark.read.option("recursiveFileLookup", True).parquet(f"{out}/{kind}").collect())
    assert read("records") == [0, 2, 4, 6, 8, 10, 12] and read("rejects") == [1, 3, 5, 7, 9, 11, 13]


def test_progress_listener(spark):
    told = []
    p = resumable.Progress(lambda rows, speed: told.append(rows), each=25)
    event = lambda n: type("E", (), {"progress": type("P", (), {"numInputRows": n, "processedRowsPerSecond": 1.0})})
    for n in (10, 10, 10, 30):
        p.onQueryProgress(event(n))
    assert told == [30, 60]


def test_service(spark):
    corpus = spark.createDataFrame([("a", "alpha text"), ("b", "beta text")], "id string, text string")
    answerer = Answerer(ranking.Retriever(corpus), lambda batch: ["It is so [1] [4]." for _ in batch], "sys", "base")
    service = Service(answerer)
    got = service.ask(Ask("what is alpha", "bm25"))
    assert got["cited_ids"] == ["a"] and got["invalid_citations"] == [4] and got["latency_ms"]["total"] > 0
    assert service.ask(Ask("what is alpha", "no_retrieval"))["context"] == []
    assert service.source("b")["text"] == "beta text" and service.health()["dense"] is False
    with pytest.raises(NotFound):
        service.source("zzz")
    for bad in ({"question": "hi"}, {"question": "x" * 501}, {"question": "fine?", "mode": "other"}):
        with pytest.raises(BadRequest):
            Ask(**bad)
    with pytest.raises(BadRequest):
        service.ask(Ask("what is alpha", adapted=True))


def test_settings(tmp_path):
    s = config.settings({"seed": 7, "chunking": {"chunk_size": 100}})
    assert s.seed == 7 and s.chunking.chunk_size == 100 and s.chunking.overlap == 64 and s.retrieval.rrf_k == 60
    for bad in ({"chunking": {"chunk_size": 0}}, {"retrieval": {"top_k": 0}}, {"max_doc_share": 0}, {"nope": 1}, {"retrieval": {"bm25_weight": -1}}):
        with pytest.raises(ValueError):
            config.settings(bad)
    (tmp_path / "c.json").write_text('{"seed": 3}')
    assert config.load(str(tmp_path / "c.json")).seed == 3


def test_scans_are_pruned_and_filters_pushed(spark):
    from textloom.plans import catalog

    plan = catalog.QUERIES["dense_normalised"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan and "label" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = catalog.QUERIES["semi_anti_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan


def test_stored_index_answers_like_the_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "alpha yes alpha"), ("b", "beta no"), ("c", None), ("d", "alpha beta")], "id string, text string")
    lexical.LexicalIndex.of(corpus).write(str(tmp_path))
    r = ranking.Retriever(corpus, lexical_index=lexical.LexicalIndex.read(spark, str(tmp_path)))
    few = spark.createDataFrame([(0, "alpha alpha"), (1, "beta gamma"), (2, "nothing")], "query_id long, question string")
    many = spark.createDataFrame([(0, "alpha beta no yes " + " ".join(f"w{i}" for i in range(20)))], "query_id long, question string")
    for q in (few, many):
        rows = lambda df: sorted((x.query_id, x.id, round(x.score, 9), x["rank"]) for x in df.collect())
        assert rows(r.search(q, "bm25", 3)) == rows(ranking.Retriever(corpus).search(q, "bm25", 3)) != []


def test_score_gate(spark):
    corpus = spark.createDataFrame([("a", "the fee is two"), ("b", "other")], "id string, text string")
    items = spark.createDataFrame([(i, i != 3, ["fee is"]) for i in range(5)], "query_id long, answerable boolean, evidence array<string>")
    hits = spark.createDataFrame([(0, "a", 0.9, 1), (1, "b", 0.2, 1), (2, "a", 0.8, 1), (3, "a", 0.3, 1)], "query_id long, id string, score double, rank int")
    ready = evaluation.gate_inputs(hits, corpus, items)
    assert {(r.query_id, r.score, r.present) for r in ready.collect()} == {(0, 0.9, True), (1, 0.2, False), (2, 0.8, True), (3, 0.3, True), (4, None, False)}
    given = spark.createDataFrame([(0, False, ["x"], ["y", "x"], ["none", "The  fee is"]), (2, False, ["z"], ["y", "x"], ["none", "fee is"])], "query_id long, abstained boolean, cited_ids array<string>, retrieved_ids array<string>, context array<string>")
    cut, groups = evaluation.score_gate(ready, ready, given)
    c = cut.first()
    assert round(c.threshold, 9) == 0.55 and (c.tpr, c.tnr) == (1.0, 1.0)  # between 0.3, unanswerable, and 0.8
    got = {r.group: (r.n, r.gate_refused, r.refused, r.cited) for r in groups.collect()}
    assert got == {"answerable_evidence_in": (2, 0, 0, 1), "answerable_evidence_absent": (2, 2, 2, 0), "unanswerable": (1, 1, 1, 0)}


def test_model_of_a_dense_index_is_checked(spark, tmp_path):
    sinks.write_dense_index(spark.createDataFrame([("1", [1.0])], "id string, embedding array<double>"), f"{tmp_path}/idx", "one")
    assert dense.read_index(spark, f"{tmp_path}/idx", "one").count() == 1
    with pytest.raises(ValueError):
        dense.read_index(spark, f"{tmp_path}/idx", "two")
