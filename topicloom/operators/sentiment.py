"""Sentiment of documents and topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.constants import ENGLISH_STOP_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS
from topicloom.functions import text as T
from topicloom.operators.terms import top_phrases
from topicloom.plans.execution import materialise, top_k


def score_lexicon(df: DataFrame, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS) -> DataFrame:
    """(doc_id, sentiment, confidence, original_label) from counts of known words."""
    tokens = T.word_tokens(F.col("text"))
    counted = df.select("doc_id", tokens.alias("t")).select(
        "doc_id",
        F.size(F.filter("t", lambda w: w.isin(positive))).alias("p"),
        F.size(F.filter("t", lambda w: w.isin(negative))).alias("n"),
    )
    sentiment = F.when(F.col("p") > F.col("n"), "positive").when(F.col("n") > F.col("p"), "negative").otherwise("neutral")
    share = F.try_divide(F.greatest("p", "n").cast("double"), F.col("p") + F.col("n"))
    return counted.select(
        "doc_id", sentiment.alias("sentiment"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("confidence"),
        F.concat(F.lit("+"), F.col("p").cast("string"), F.lit("/-"), F.col("n").cast("string")).alias("original_label"))


def score_with_model(df: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> DataFrame:
    """(doc_id, label, score) from a user model; it is loaded once per task and fed Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            pairs = score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": [p[0] for p in pairs], "score": [p[1] for p in pairs]})

    return df.select("doc_id", "text").mapInPandas(run, "doc_id bigint, label string, score double")


def map_stars(label: Column) -> Column:
    """Five-star label: 4 and 5 are positive, 1 and 2 negative."""
    return F.when(label.rlike("[45]"), "positive").when(label.rlike("[12]"), "negative").otherwise("neutral")


def map_confidence(label: Column, score: Column, threshold: float = 0.75, text: Column | None = None) -> Column:
    """Binary label: a weak score, or a text of fewer than three characters, is neutral."""
    strong = score > threshold
    if text is not None:
        strong = strong & (F.length(F.trim(text)) >= 3)
    return F.when(strong & (F.upper(label) == "POSITIVE"), "positive").when(
        strong & (F.upper(label) == "NEGATIVE"), "negative").otherwise("neutral")


def sentiment_by_topic(rated: DataFrame) -> DataFrame:
    """(topic, positive, negative, neutral): counts."""
    return rated.groupBy("topic").agg(*[
        F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative", "neutral")])


def base_label(name: Column) -> Column:
    """Up to four different words of more than two letters, without the id in front."""
    parts = F.split(name, "_")
    words = F.when(F.get(parts, F.lit(0)).rlike(r"^\d+$"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    long = F.filter(words, lambda w: F.length(w) > 2)
    lowered = F.transform(long, lambda w: F.lower(w))
    firsts = F.filter(long, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)
    return F.when(F.contains(name, F.lit("_")), F.array_join(F.slice(firsts, 1, 4), " ")).otherwise(name)


def decorate_labels(info: DataFrame, rated: DataFrame, strong: float = 0.7, mixed: float = 0.4) -> DataFrame:
    """(topic, label): the name with a mark for its sentiment; outliers have a label of their own."""
    counts = sentiment_by_topic(rated)
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    shares = counts.select("topic", (F.col("positive") / total).alias("pos"), (F.col("negative") / total).alias("neg"))
    base = base_label(F.col("name"))
    label = (
        F.when(F.col("topic") == -1, "📊 Outliers")
        .when(F.col("pos") > strong, F.concat(F.lit("😊 "), base))
        .when(F.col("neg") > strong, F.concat(F.lit("😔 "), base))
        .when((F.col("pos") > mixed) & (F.col("neg") > mixed), F.concat(F.lit("😐 "), base, F.lit(" (mixed)")))
        .otherwise(F.concat(F.lit("📝 "), base))
    )
    return info.join(shares, "topic", "left").select("topic", label.alias("label"))


def decorate_majority(info: DataFrame, rated: DataFrame, majority: float = 0.6) -> DataFrame:
    """(topic, label): as above with one majority threshold and the full name."""
    counts = sentiment_by_topic(rated)
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    shares = counts.select("topic", (F.col("positive") / total).alias("pos"), (F.col("negative") / total).alias("neg"))
    label = (
        F.when(F.col("topic") == -1, "Outliers")
        .when(F.col("pos").isNull(), F.col("name"))
        .when(F.col("pos") > majority, F.concat(F.lit("😊 "), F.col("name")))
        .when(F.col("neg") > majority, F.concat(F.lit("😞 "), F.col("name")))
        .otherwise(F.concat(F.lit("😐 "), F.col("name")))
    )
    return info.join(shares, "topic", "left").select("topic", label.alias("label"))


def topic_names(docs: DataFrame, rated: DataFrame, first_docs: int | None = None, features: int | None = None) -> DataFrame:
    """(topic, count, name): a mark for the dominant sentiment and three words that do not contradict it.

    Words are the five best TF-IDF terms (one or two words) of the topic's documents.
    """
    inlier = docs.where(F.col("topic") != -1)
    counts = materialise(
        inlier.select("topic", "doc_id").join(rated.select("doc_id", "sentiment"), "doc_id", "left")
        .groupBy("topic").agg(
            F.count("*").alias("count"), *[
                F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "negative")],
            F.count_if(F.coalesce(F.col("sentiment") == "neutral", F.lit(True))).alias("neutral")), "sentiments")
    most = F.greatest("positive", "negative", "neutral")
    dominant = F.when(F.col("positive") == most, "positive").when(F.col("negative") == most, "negative").otherwise("neutral")
    first = inlier.select("topic", "doc_id", "text")
    if first_docs is not None:
        first = top_k(first, ["topic"], [F.col("doc_id")], first_docs).drop("rank")
    terms = top_phrases(first, 1, 2, 5, min_df=1, max_features=features, stop_words=ENGLISH_STOP_WORDS)
    judged = terms.join(counts.select("topic", dominant.alias("dominant")), "topic")
    positive, negative = F.col("term").isin(POSITIVE_WORDS), F.col("term").isin(NEGATIVE_WORDS)
    clash = F.when(F.col("dominant") == "positive", negative).when(F.col("dominant") == "negative", positive).otherwise(
        positive | negative)
    pairs = judged.groupBy("topic", "dominant").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term", clash.alias("clash")))).alias("all"))
    kept = F.filter("all", lambda p: ~p["clash"])
    chosen = F.when(F.size(kept) >= 2, kept).otherwise(F.col("all"))
    mark = F.when(F.col("dominant") == "positive", "😊").when(F.col("dominant") == "negative", "😔").otherwise("😐")
    words = F.array_join(F.transform(F.slice(chosen, 1, 3), lambda p: p["term"]), " ")
    base = F.lower(F.replace(F.concat_ws(" ", mark, words), F.lit(" "), F.lit("_")))
    named = pairs.select("topic", F.concat_ws("_", F.col("topic").cast("string"), base).alias("name"))
    rows = counts.join(named, "topic", "left").select(
        "topic", "count", F.coalesce("name", F.concat(F.col("topic").cast("string"), F.lit("_topic"))).alias("name"))
    outliers = docs.where(F.col("topic") == -1).agg(F.count("*").alias("count")).where("count > 0").select(
        F.lit(-1).alias("topic"), "count", F.lit("-1_outliers").alias("name"))
    return rows.unionByName(outliers)


def split_by_sentiment(rated: DataFrame, share: float = 0.15, small: int = 5) -> DataFrame:
    """(doc_id, topic): topics with both voices get a positive and a negative version.

    New ids follow the largest id, in topic order; neutral documents join the
    positive ones unless they outnumber them.
    """
    counts = materialise(sentiment_by_topic(rated), "sentiments")
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    both = (F.col("positive") >= 1) & (F.col("negative") >= 1)
    strong = (F.col("positive") / total > share) & (F.col("negative") / total > share)
    split = counts.where((F.col("topic") != -1) & both & (strong | (total <= small)))
    own = F.col("neutral") > F.col("positive")
    parts = F.when(own, 3).otherwise(2)
    running = Window.orderBy("topic").rowsBetween(Window.unboundedPreceding, -1)  # topic-sized
    highest = counts.agg(F.max("topic")).first()[0]
    plan = split.select("topic", own.alias("own"), (F.lit((highest if highest is not None else -1) + 1) + F.coalesce(
        F.sum(parts).over(running), F.lit(0))).cast("int").alias("start"))
    from topicloom.plans.execution import lookup_join

    joined = lookup_join(rated.select("doc_id", "topic", "sentiment"), plan, ["topic"], "left")
    shift = F.when(F.col("sentiment") == "negative", 1).when(
        (F.col("sentiment") == "neutral") & F.col("own"), 2).otherwise(0)
    return joined.select("doc_id", F.coalesce(F.col("start") + shift, F.col("topic")).alias("topic"))
