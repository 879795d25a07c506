from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators import preprocess as P


def clean_one(spark, text, max_length=None):
    row = spark.createDataFrame([(1, text)], "doc_id bigint, text string").select(T.clean_text(F.col("text"), max_length)).first()
    return row[0]


@pytest.mark.parametrize("text, expected", [
    (None, None), ("   ", None), ("123456789", None), ("1234567890", "1234567890"),
    ("a\tb\r\n c   d e f g", "a b c d e f g"), ('[alpha, "beta", gamma]', "alpha, beta , gamma"),
    ("hello <{entity_type}> world", "hello   world"), ("mail me at [EMAIL] today [pii]", "mail me at   today"),
    ("<p>some bold text</p>", "some bold text"), ("nul\x00in the middle", "nulin the middle"),
])
def test_clean_text(spark, text, expected):
    assert clean_one(spark, text) == expected


def test_clean_text_cut_at_period_or_with_dots(spark):
    late = "x" * 4499 + "." + "y" * 501
    early = "x" * 2999 + "." + "y" * 2001
    assert clean_one(spark, late) == late
    assert clean_one(spark, late, 5000) == "x" * 4499 + "."
    assert clean_one(spark, early, 5000) == early[:5000] + "..."
    assert clean_one(spark, "z" * 5000, 5000) == "z" * 5000


def test_list_input_is_joined(spark):
    df = spark.createDataFrame([(1, ["alpha beta", "gamma delta"])], "doc_id bigint, text array<string>")
    assert P.clean_documents(df).first()["text"] == "alpha beta gamma delta"


def test_prompt_cleaning_collapses_runs(spark):
    df = spark.createDataFrame([(1, "so so so very very good <b>really</b> fine"), (2, "no no twice only here ok")], "id int, text string")
    got = [r[0] for r in df.orderBy("id").select(T.clean_for_prompt(F.col("text"))).collect()]
    assert got == ["so very very good really fine", "no no twice only here ok"]


@pytest.mark.parametrize("tokens, starts", [(0, []), (1, [0]), (512, [0]), (513, [0, 384]), (896, [0, 384]), (897, [0, 384, 768])])
def test_chunk_starts(spark, tokens, starts):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(tokens)))], "doc_id bigint, text string")
    chunks = P.chunk_documents(df).orderBy("chunk_no").collect()
    assert [r["start_pos"] for r in chunks] == starts
    if tokens > 512:
        covered = {w for r in chunks for w in r["text"].split()}
        assert len(covered) == tokens and chunks[-1]["end_pos"] == tokens


@settings(max_examples=8, deadline=None)
@given(st.integers(1, 60), st.integers(2, 12), st.integers(0, 11))
def test_every_token_is_in_a_chunk(spark, n, size, overlap):
    overlap = min(overlap, size - 1)
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id bigint, text string")
    words = [w for r in P.chunk_documents(df, size, overlap).collect() for w in r["text"].split()]
    assert set(words) == {f"w{i}" for i in range(n)}


def test_ngrams_skip_stop_words_first(spark):
    df = spark.createDataFrame([(1, "The quality of the service")], "doc_id bigint, text string")
    got = {r["term"] for r in P.ngram_counts(df, 1, 3, ["the", "of"]).collect()}
    assert got == {"quality", "service", "quality service"}


def test_ngrams_meet_by_their_beginnings(spark):
    """only the longest n-grams of a chunk and its single words are shuffled; counts are those of all n-grams one by one, for any sizes and chunks."""
    from collections import Counter
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "é", "c1", "dd", "eee", "ab_"]) for _ in range(rng.randrange(9))) for _ in range(60)] + [None, "", "one"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for low, high, chunk in ((1, 3, 1 << 20), (1, 3, 40), (1, 1, 40), (2, 2, 40), (2, 4, 40), (1, 2, 1), (3, 3, 40)):
        want = Counter(" ".join(t.split()[i:i + k]) for t in texts if t for k in range(low, high + 1) for i in range(len(t.split()) - k + 1))
        got = P.ngram_counts(df, low, high, chunk_tokens=chunk).collect()
        assert len(got) == len(want) and {r["term"]: r["n"] for r in got} == want
    plan = P.ngram_counts(df, 1, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "explode" not in plan


def test_title_case(spark):
    df = spark.createDataFrame([("the api of an ios app",), ("vs the world",), ("ßig house",)], "t string")
    got = [r[0] for r in df.select(T.title_case(F.col("t"))).collect()]
    assert got[0] == "The API of an Ios App" and got[1] == "Vs the World" and got[2] == "Ssig House"


def test_preprocess_stats(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "short"), (4, "long enough text"), (5, "y" * 6000)], "doc_id bigint, text string")
    row = P.preprocess_stats(df, 5000).first().asDict()
    assert row == {"total": 5, "valid": 2, "empty_removed": 2, "too_short": 1, "too_long_truncated": 1, "type_converted": 0}


def test_topic_reference_and_unknown(spark):
    q = spark.createDataFrame([(1, "about topic 3 and topic 4"), (2, "Topic 99"), (3, "no number")], "id int, text string")
    known = spark.createDataFrame([(3,), (4,)], "topic int")
    got = {r["id"]: r["topic_filter"] for r in P.resolve_topic_refs(q, known).collect()}
    assert got == {1: 3, 2: None, 3: None}


def test_vector_check(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    half = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "doc_id bigint, embedding array<float>")
    assert P.validate_vectors(docs, half).first()["status"] == "ok"
    zero = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "doc_id bigint, embedding array<float>")
    assert P.validate_vectors(docs, zero).first()["status"] == "mostly_zero"
    assert P.validate_vectors(docs, half.where("doc_id = 1")).first()["status"] == "misaligned"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_shapes_equal_a_plain_grouping_without_sorting_all_tokens(spark, rows):
    texts = [(5, "b a c"), (5, "z"), (2, " ".join(f"w{i % 97}" for i in range(25_000))), (9, "Ünder über ABC"), (None, "x y"), (7, "")]
    tokens = P.tokenize(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1))
    plain = tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("pos").alias("last_pos"),
                                         F.max_by("token", "pos").alias("last_token"), F.min("token").alias("least_token"))
    order = lambda df: sorted(map(str, df.collect()))
    assert order(P.token_shapes(tokens)) == order(plain)
    before_grouping = plan_of(P.token_shapes(tokens)).split("MapInArrow")
    assert "SortAggregate" not in before_grouping[-1] and "SortAggregate" in plan_of(plain)


def test_keywords_are_counted_without_sorting_all_tokens(spark):
    from topicloom.operators import keywords as K

    docs = spark.createDataFrame([(0, 3 << 60, "late late"), (0, 1, "early words early"), (0, 2, "words late")], "topic int, doc_id bigint, text string")
    ranked = K.topic_keyword_list(docs)
    assert [(r["token"], r["n"]) for r in ranked.orderBy("rank").collect()] == [("late", 3), ("early", 2), ("words", 2)]
    assert "SortAggregate" not in plan_of(ranked)
