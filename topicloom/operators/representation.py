"""Choosing the words that stand for a topic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators.model_jobs import nearest_docs
from topicloom.operators.similarity import stored_centroids, unit_rows
from topicloom.plans.execution import lookup_join, materialise, top_k

# Where words are taken from, best source first.
PRIORITY = ["mmr", "similarity", "pos", "c_tf_idf"]


def choose_representation(aspects: dict[str, DataFrame], words: int = 8, shown: int = 3) -> DataFrame:
    """(topic, source, keywords, label) from the first source that has the topic.

    Each aspect is a topic-sized table (topic, rank, term).
    """
    tagged = [
        aspects[name].select("topic", "rank", "term", F.lit(i).alias("priority"))
        for i, name in enumerate(PRIORITY) if name in aspects
    ]
    rows = reduce(DataFrame.unionByName, tagged).where(F.col("rank") <= words)
    lists = rows.groupBy("topic", "priority").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("p"))
    best = lists.groupBy("topic").agg(F.min_by(F.struct("priority", "p"), "priority").alias("b"))
    names = F.array(*[F.lit(p) for p in PRIORITY])
    keywords = F.transform("b.p", lambda x: x["term"])
    label = F.when(F.size("b.p") > 0, F.concat(F.lit("Topic: "), F.array_join(F.slice(keywords, 1, shown), ", "))).otherwise(
        F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    return best.select("topic", F.get(names, F.col("b.priority")).alias("source"), keywords.alias("keywords"), label.alias("label"))


def topic_vectors(vectors: DataFrame, docs_per_topic: int = 5) -> DataFrame:
    """(topic, centroid): mean vector of the documents nearest to each topic's centroid."""
    near = nearest_docs(vectors, docs_per_topic).select("doc_id")
    return stored_centroids(lookup_join(vectors.where("topic <> -1"), near, ["doc_id"]))


def scored_candidates(candidates: DataFrame, vectors: DataFrame, embed_terms: Callable[[DataFrame], DataFrame],
                      docs_per_topic: int = 5) -> DataFrame:
    """(topic, term, embedding, similarity): candidate words against their topic's representative documents.

    ``candidates`` is topic-sized, (topic, term); ``embed_terms`` turns (doc_id, text) into
    (doc_id, embedding) in the space of ``vectors``.
    """
    candidates = materialise(candidates.select("topic", "term"), "candidates")
    named = candidates.select("term").distinct().select((F.row_number().over(Window.orderBy("term")) - 1).cast("bigint").alias("doc_id"), F.col("term").alias("text"))
    named = materialise(named, "terms")  # topic-sized
    words = materialise(embed_terms(named).join(named, "doc_id").select(F.col("text").alias("term"), "embedding"), "word-vectors")
    joined = candidates.join(words, "term").join(topic_vectors(vectors, docs_per_topic).select("topic", "centroid"), "topic")
    return joined.select("topic", "term", "embedding", F.round(F.coalesce(
        V.cosine(F.col("embedding"), F.col("centroid")), F.lit(0.0)), 6).alias("similarity"))


def keywords_by_similarity(scored: DataFrame, k: int = 10) -> DataFrame:
    """(topic, rank, term, similarity): candidates ranked by similarity to the representative documents."""
    return top_k(scored, ["topic"], [F.col("similarity").desc(), F.col("term")], k).select("topic", "rank", "term", "similarity")


def mmr(scored: DataFrame, k: int = 10, diversity: float = 0.3) -> DataFrame:
    """(topic, rank, term): maximal marginal relevance (Carbonell and Goldstein 1998).

    Each topic brings a few dozen candidates, so a topic is one small group.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term")
        matrix = unit_rows(np.vstack(pdf["embedding"].to_numpy()).astype("float64"))
        alike = matrix @ matrix.T
        relevance = pdf["similarity"].to_numpy()
        chosen = [int(relevance.argmax())]
        while len(chosen) < min(k, len(pdf)):
            value = np.round((1 - diversity) * relevance - diversity * alike[:, chosen].max(axis=1), 6)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({"topic": pdf["topic"].iloc[0], "rank": range(1, len(chosen) + 1), "term": pdf["term"].to_numpy()[chosen]})

    return scored.groupBy("topic").applyInPandas(pick, "topic int, rank int, term string")
