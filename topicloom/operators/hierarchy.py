"""Topic hierarchy, tree and map.  Everything here is topic-sized."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.clustering import merge_table
from topicloom.operators.keywords import joined
from topicloom.operators.terms import ctfidf, topic_terms, top_terms
from topicloom.plans.execution import lookup_join, materialise, top_k

HIERARCHY = ("parent_id int, parent_name string, topics array<int>, left_id int, left_name string, "
             "right_id int, right_name string, distance double")


def hierarchy(docs: DataFrame, centers: DataFrame, words: int = 4) -> DataFrame:
    """One row per merge of the two nearest groups, with names from their joint class-TF-IDF words.

    ``docs`` is (doc_id, topic, text), ``centers`` is (topic, centroid).
    """
    centers = materialise(centers.where("topic <> -1"), "centers")
    merges = merge_table(centers)
    counts = materialise(topic_terms(docs.where("topic <> -1")), "topic-terms")
    idf = ctfidf(counts, with_idf=True).groupBy("term").agg(F.max("idf").alias("idf"))
    groups = merges.select(F.col("parent_id").alias("node"), F.explode("topics").alias("topic")).unionByName(
        centers.select(F.col("topic").alias("node"), "topic"))
    merged = lookup_join(counts, groups, ["topic"]).groupBy("node", "term").agg(F.sum("n").alias("n"))
    weighted = lookup_join(merged, idf, ["term"]).select(
        F.col("node").alias("topic"), "term", (F.col("n") * F.col("idf")).alias("weight"))
    best = top_terms(weighted, words)
    names = materialise(joined(best, "topic", "term", "_", "name"), "names")
    named = lambda side: names.select(F.col("topic").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    rows = merges
    for side in ("parent", "left", "right"):
        rows = rows.join(named(side), f"{side}_id", "left")
    return rows.select("parent_id", "parent_name", "topics", "left_id", "left_name", "right_id", "right_name",
                       F.round("distance", 6).alias("distance"))


def first_merge(similarity: DataFrame) -> DataFrame:
    """(left_id, right_id, distance): the two nearest topics."""
    pairs = similarity.where("topic_a < topic_b AND topic_a <> -1")
    return pairs.orderBy(F.col("similarity").desc(), "topic_a", "topic_b").limit(1).select(
        F.col("topic_a").alias("left_id"), F.col("topic_b").alias("right_id"), F.round(1 - F.col("similarity"), 6).alias("distance"))


def topic_tree(rows: DataFrame) -> DataFrame:
    """(node_id, parent, left_id, right_id, size, depth, merges): every merge with its place in the tree.

    A node's ancestors are the larger merges that hold one of its topics, so the
    depth needs no loop.
    """
    parents = rows.select(F.col("parent_id").alias("_p"), F.explode(F.array("left_id", "right_id")).alias("node_id"))
    nodes = rows.select(F.col("parent_id").alias("node_id"), "left_id", "right_id", F.size("topics").alias("size"),
                        F.array_min("topics").alias("member"))
    holders = rows.select(F.explode("topics").alias("member"), F.size("topics").alias("_size"))
    above = nodes.join(holders, "member").where(F.col("_size") > F.col("size")).groupBy("node_id").agg(F.count("*").alias("_d"))
    total = F.count("*").over(Window.partitionBy())
    return nodes.join(parents, "node_id", "left").join(above, "node_id", "left").select(
        "node_id", F.coalesce(F.col("_p").cast("string"), F.lit("Root")).alias("parent"), "left_id", "right_id", "size",
        F.coalesce("_d", F.lit(0)).cast("int").alias("depth"), total.alias("merges"))


def topic_map(centers: DataFrame, info: DataFrame, label_chars: int = 30) -> DataFrame:
    """(topic, x, y, count, label): centroids on two principal components, scaled to 0..1."""
    vector = array_to_vector(F.col("centroid").cast("array<double>"))
    rows = centers.where("topic <> -1").select("topic", vector.alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    signs = [float(np.sign(c[np.abs(c).argmax()]) or 1.0) for c in model.pc.toArray().T]
    flat = model.transform(rows).withColumn("_a", vector_to_array("_p"))
    placed = flat.select("topic", *[(F.get("_a", F.lit(i)) * s).alias(c) for i, (c, s) in enumerate(zip("xy", signs))])
    whole = Window.partitionBy()
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)),
                         F.lit(0.5)).alias(c) for c in "xy"]
    return placed.select("topic", *scaled).join(
        info.select("topic", "count", F.substring("human_label", 1, label_chars).alias("label")), "topic")


def document_map(vectors: DataFrame, assignment: DataFrame, info: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, x, y, topic, label) for all documents, or for a sample of n, the same ones in every run."""
    from topicloom.operators.analytics import document_map_sample
    from topicloom.operators.embedding import reduce_dims

    points = reduce_dims(vectors, 2)
    chosen = materialise(assignment if n is None else document_map_sample(assignment, n, seed), "map-sample")
    placed = lookup_join(points.select("doc_id", "reduced"), chosen, ["doc_id"], stored=True)
    label = F.when(F.col("topic") == -1, "Outliers").otherwise(
        F.coalesce("human_label", F.concat(F.lit("Topic "), F.col("topic").cast("string"))))
    return placed.join(info.select("topic", "human_label"), "topic", "left").select(
        "doc_id", F.get("reduced", F.lit(0)).alias("x"), F.get("reduced", F.lit(1)).alias("y"), "topic", label.alias("label"))
