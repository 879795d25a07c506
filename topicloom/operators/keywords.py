"""Keywords, default names and the topic table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.constants import COMMON_WORDS, ENGLISH_STOP_WORDS
from topicloom.functions import text as T
from topicloom.operators.preprocess import gram_counts
from topicloom.operators.terms import document_terms
from topicloom.plans.execution import BROADCAST_ROWS, lookup_join, materialise, spread_parts, top_k

MARK = "\x1f"  # between a topic and its word


def joined(ranked: DataFrame, key: str, column: str, separator: str, out: str) -> DataFrame:
    """One row per key: its ranked values joined in rank order (at most top-k values per key)."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", column)))
    return ranked.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p[column]), separator).alias(out))


def _likely_first(docs: DataFrame, wanted: Callable[[Column], Column], top_n: int) -> DataFrame:
    """(topic, token, n): the ``top_n`` most frequent words of each topic and all that tie with the last, stored."""
    marked = F.transform(F.filter(T.whitespace_tokens(F.col("text")), wanted), lambda t: F.concat(F.col("topic").cast("string"), F.lit(MARK), t))
    counts = gram_counts(docs.select(marked.alias("tokens")), spread_parts(docs)).select(
        F.substring_index("term", MARK, 1).cast(docs.schema["topic"].dataType).alias("topic"), F.expr(f"substring(term, instr(term, '{MARK}') + 1)").alias("token"), "n")
    place = F.rank().over(Window.partitionBy("topic").orderBy(F.col("n").desc()))
    return materialise(counts.withColumn("_place", place).where(F.col("_place") <= top_n).drop("_place"), "first-words")


def topic_keyword_list(df: DataFrame, max_docs: int | None = None, top_n: int = 10, min_chars: int = 3,
                       stop_words: list[str] = COMMON_WORDS, extra: list[str] = (), stored: bool = False) -> DataFrame:
    """(topic, rank, token, n): the most frequent words of each topic, over all its documents or its first ``max_docs``.

    Ties go to the word that appears first.  ``stored`` texts are read twice: words are counted first, and where a word appears is only looked up for those that may be among the
    first (up to ``BROADCAST_ROWS``, counted).
    """
    docs = df.select("topic", "doc_id", "text")
    if max_docs is not None:
        docs = top_k(docs, ["topic"], [F.col("doc_id")], max_docs)
    wanted = lambda token: (F.length(token) >= min_chars) & ~token.isin([*stop_words, *extra])
    tokens = docs.select("topic", F.col("doc_id").alias("doc"),
                         F.posexplode(T.whitespace_tokens(F.col("text"))).alias("pos", "token"))
    kept = tokens.where(wanted(F.col("token")))
    if stored:
        first = _likely_first(docs, wanted, top_n)
        if first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            kept = kept.join(F.broadcast(first.select("topic", "token")), ["topic", "token"])
    # document and position as one number: with a struct Spark would sort all tokens to group them
    seen = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
    counted = kept.groupBy("topic", "token").agg(F.count("*").alias("n"), F.min(seen).alias("seen"))
    ranked = top_k(counted, ["topic"], [F.col("n").desc(), F.col("seen")], top_n)
    return ranked.select("topic", "rank", "token", "n")


def topic_keywords(df: DataFrame, shown: int = 5, **options) -> DataFrame:
    """(topic, keywords): five words joined by commas; ``topic, <id>`` when no word is left."""
    ranked = topic_keyword_list(df.where(F.col("topic") != -1), **options)
    words = joined(ranked.where(F.col("rank") <= shown), "topic", "token", ", ", "keywords")
    topics = df.where(F.col("topic") != -1).select("topic").distinct()
    fallback = F.concat(F.lit("topic, "), F.col("topic").cast("string"))
    return topics.join(words, "topic", "left").select("topic", F.coalesce("keywords", fallback).alias("keywords"))


def default_names(ranked_terms: DataFrame, words: int = 4) -> DataFrame:
    """(topic, name, display): ``<id>_<w1>_<w2>...`` and the words after the id."""
    names = joined(ranked_terms.where(F.col("rank") <= words), "topic", "term", "_", "_words")
    named = names.select("topic", F.concat_ws("_", F.col("topic").cast("string"), F.col("_words")).alias("name"))
    parts = F.split("name", "_")
    return named.withColumn("display", F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " "))


def topic_info(assignment: DataFrame, keywords: DataFrame, labels: DataFrame | None = None,
               analysis: DataFrame | None = None) -> DataFrame:
    """(topic, count, keywords, human_label, name, analysis), outlier row first, then ascending ids."""
    info = assignment.groupBy("topic").agg(F.count("*").alias("count")).join(keywords, "topic", "left")
    if labels is not None:
        info = info.join(labels.select("topic", F.col("human_label").alias("_label")), "topic", "left")
    else:
        info = info.withColumn("_label", F.lit(None).cast("string"))
    if analysis is not None:
        info = info.join(analysis.select("topic", F.col("analysis").alias("_analysis")), "topic", "left")
    else:
        info = info.withColumn("_analysis", F.lit(None).cast("string"))
    outlier = F.col("topic") == -1
    label = F.when(outlier, "Outliers").otherwise(
        F.coalesce("_label", F.concat(F.lit("Topic "), F.col("topic").cast("string"))))
    return info.select(
        "topic", "count",
        F.when(outlier, "Outliers").otherwise(F.coalesce("keywords", F.lit(""))).alias("keywords"),
        label.alias("human_label"), label.alias("name"),
        F.when(outlier, "").otherwise(F.coalesce("_analysis", F.lit(""))).alias("analysis"),
    ).orderBy("topic")


def normalize_topic_info(info: DataFrame, assignment: DataFrame) -> DataFrame:
    """Fill what is missing: keywords from the word list, label from name or keywords, count from assignments."""
    have = set(info.columns)
    if "topic" not in have and "Topic" in have:
        info = info.withColumnRenamed("Topic", "topic")
    if "keywords" not in have:
        words = F.array_join(F.slice("representation", 1, 5), ", ") if "representation" in have else F.lit("")
        info = info.withColumn("keywords", F.coalesce(words, F.lit("")))
    from topicloom.operators.labels import keyword_label

    candidates = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("human_label", "name") if c in have]
    info = info.withColumn("human_label", F.coalesce(*candidates, keyword_label(F.col("keywords"))))
    if "count" not in have:
        counts = assignment.groupBy("topic").agg(F.count("*").alias("count"))
        info = info.join(counts, "topic", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    if "analysis" not in have:
        info = info.withColumn("analysis", F.lit(""))
    return info.select("topic", "count", "keywords", "human_label", "analysis")


def extend_topic_info(info: DataFrame, docs: DataFrame, first_docs: int | None = None, features: int = 5, words: int = 3) -> DataFrame:
    """(topic, count, name): the given rows plus one row per topic they lack.

    A new topic is named by three words: of its documents' five most
    frequent words, the first three in alphabetical order.
    """
    # both sides are narrow and topic-sized after the distinct
    missing = docs.select("topic").where(F.col("topic") != -1).distinct().join(info.select("topic"), "topic", "left_anti")
    fresh = lookup_join(docs, missing, ["topic"])
    counts = fresh.groupBy("topic").agg(F.count("*").alias("count"))
    first = fresh.select("topic", "doc_id", "text")
    if first_docs is not None:
        first = top_k(first, ["topic"], [F.col("doc_id")], first_docs)
    terms = document_terms(first, keys=("topic",), stop_words=ENGLISH_STOP_WORDS)
    frequent = top_k(terms, ["topic"], [F.col("n").desc(), F.col("term")], features)
    named = frequent.groupBy("topic").agg(F.slice(F.array_sort(F.collect_list("term")), 1, words).alias("_w"))
    rows = counts.join(named, "topic", "left").select(
        "topic", "count",
        F.concat_ws("_", F.col("topic").cast("string"), F.coalesce(F.array_join("_w", "_"), F.lit("split_topic"))).alias("name"))
    return info.select("topic", "count", "name").unionByName(rows)


def stored_keywords(df: DataFrame, **options) -> DataFrame:
    return materialise(topic_keywords(df, **options), "keywords")
