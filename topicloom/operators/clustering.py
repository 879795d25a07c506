"""Clusters and assignments: k-means, seeds, nearest centroids, merging, splitting, outliers.

Row-sized steps are projections over Arrow batches against centroid blocks, or
aggregates combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators.keywords import joined, topic_keyword_list
from topicloom.operators.similarity import (
    SCORE_DIGITS, centroids, nearest, score_pairs, scores, stack, stored_centroids, vector_blocks,
)
from topicloom.constants import SPLIT_COMMON_WORDS
from topicloom.plans.execution import BLOCK_ROWS, MAX_TOPICS, bounded_rows, lookup_join, materialise, running_totals, top_k


# --- k-means ----------------------------------------------------------------------------------

def kmeans_model(vectors: DataFrame, k: int, seed: int = 42, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """(assignment, centers): k-means over rows that have a vector, and (topic, centroid), at most k rows; rows without a vector are outliers."""
    usable = vectors.where(V.nonzero(F.col("embedding")))
    k = min(k, usable.limit(k).count())
    outliers = vectors.where(~V.nonzero(F.col("embedding"))).select("doc_id", F.lit(-1).alias("topic"))
    if k < 2:
        one = usable.select("doc_id", F.lit(0).alias("topic"))
        return one.unionByName(outliers), centroids(usable.select("embedding", F.lit(0).alias("topic"))).select("topic", "centroid")
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    features = usable.select("doc_id", vector.alias("features")).persist()
    model = KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="topic").fit(features)
    features.unpersist()
    centers = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic int, centroid array<double>")
    return model.transform(usable.select("doc_id", vector.alias("features"))).select("doc_id", "topic").unionByName(outliers), centers


def kmeans(vectors: DataFrame, k: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(doc_id, topic): k-means over rows that have a vector; rows without one are outliers."""
    return kmeans_model(vectors, k, seed, max_iter)[0]


def seed_centers(vectors: DataFrame, seeds: DataFrame, k: int, seed: int = 42, space: DataFrame | None = None) -> DataFrame:
    """(topic, centroid): one center per seed, the document nearest to it by dot product, then documents by hash order.

    ``seeds`` is (seed_id, embedding) with ids from 0.  The documents are found by ``vectors``; with ``space`` (doc_id, embedding) the centers are
    their rows there, since a seed itself has none.
    """
    from topicloom.operators.search import knn

    usable = vectors.where(V.nonzero(F.col("embedding")))
    items = usable.select(F.col("doc_id").alias("item_id"), "embedding")
    best = knn(seeds.select(F.col("seed_id").cast("bigint").alias("query_id"), "embedding"), items, 1, "dot")
    chosen = materialise(best.select(F.col("query_id").cast("int").alias("topic"), F.col("item_id").alias("doc_id")), "seeds")
    n = chosen.count()
    draw = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(seed))))
    padding = (
        lookup_join(usable.select("doc_id"), chosen.select("doc_id"), ["doc_id"], "left_anti", stored=True)
        .orderBy(draw).limit(max(k - n, 0)).withColumn("_d", draw)
        .select((F.row_number().over(Window.orderBy("_d")) + (n - 1)).alias("topic"), "doc_id")
    )
    picks = materialise(chosen.where(F.col("topic") < k).unionByName(padding), "picks")
    rows = usable if space is None else space
    return lookup_join(rows.select("doc_id", "embedding"), picks, ["doc_id"], stored=True).select(
        "topic", F.col("embedding").cast("array<double>").alias("centroid"))


def lloyd_step(vectors: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, new centers): nearest center of each row by squared distance, then the means."""
    assigned = nearest(vectors, "embedding", centers, "topic", "centroid", "l2", "topic").withColumn(
        "topic", F.col("topic").cast("int"))
    means = centroids(assigned).select("topic", "centroid", "n")
    kept = centers.select("topic", F.col("centroid").alias("_old")).join(means, "topic", "left")
    return assigned, kept.select("topic", F.coalesce("centroid", "_old").alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def kmeans_seeded(vectors: DataFrame, seeds: DataFrame, k: int, seed: int = 42, max_iter: int = 20, tolerance: float = 1e-4,
                  space: DataFrame | None = None) -> DataFrame:
    """(doc_id, topic): k-means from given seeds, a single start; in the coordinates of ``space`` (doc_id, embedding) if given."""
    centers = materialise(seed_centers(vectors, seeds, k, seed, space), "centers")
    vectors = vectors if space is None else space
    usable = vectors.where(V.nonzero(F.col("embedding"))).select("doc_id", "embedding")
    for _ in range(max_iter):
        _, moved = lloyd_step(usable, centers)
        moved = materialise(moved, "centers")
        shift = moved.join(centers.select("topic", F.col("centroid").alias("_o")), "topic").agg(
            F.max(V.squared_l2(F.col("centroid"), F.col("_o")))).first()[0]
        centers = moved
        if shift is None or shift <= tolerance**2:
            break
    assigned = assign(usable, centers, metric="l2")
    outliers = vectors.where(~V.nonzero(F.col("embedding"))).select("doc_id", F.lit(-1).alias("topic"))
    return assigned.select("doc_id", "topic").unionByName(outliers)


# --- assignment to known vectors --------------------------------------------------------------

def assign(vectors: DataFrame, centers: DataFrame, metric: str = "cosine") -> DataFrame:
    """(doc_id, topic, score): the nearest centroid; a row without a vector is an outlier.

    A stateless projection: it runs unchanged on a streaming DataFrame.
    """
    tagged = nearest(vectors.select("doc_id", "embedding"), "embedding", centers, "topic", "centroid", metric)
    return tagged.select(
        "doc_id", F.when(V.nonzero(F.col("embedding")), F.col("nearest").cast("int")).otherwise(-1).alias("topic"), "score")


def zero_shot(vectors: DataFrame, named: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, topic, score): the nearest named topic when its cosine reaches the threshold, else null."""
    tagged = nearest(vectors.select("doc_id", "embedding"), "embedding", named, "topic", "centroid", "cosine")
    return tagged.select("doc_id", F.when(F.col("score") >= threshold, F.col("nearest").cast("int")).alias("topic"), "score")


def zero_shot_topics(vectors: DataFrame, named: DataFrame, n_topics: int, threshold: float = 0.7, seed: int = 42) -> DataFrame:
    """(doc_id, topic): named topics where they fit, the other documents clustered into ``n_topics`` more.

    New topics are numbered after the largest named one; a zero vector is an outlier (-1).
    """
    tagged = materialise(zero_shot(vectors, named, threshold), "zero-shot")
    rest = vectors.select("doc_id", "embedding").join(tagged.where("topic IS NULL").select("doc_id"), "doc_id", "left_semi")
    found = tagged.where("topic IS NOT NULL").select("doc_id", "topic")
    usable = rest.where(V.nonzero(F.col("embedding"))).limit(n_topics).count()
    if not usable:
        return found.unionByName(rest.select("doc_id", F.lit(-1).alias("topic")))
    start = named.agg(F.coalesce(F.max("topic"), F.lit(-1)) + 1).first()[0]
    new = kmeans(rest, usable, seed)
    return found.unionByName(new.select("doc_id", F.when(F.col("topic") < 0, -1).otherwise(F.col("topic") + int(start)).cast("int").alias("topic")))


MAX_CENTER_CELLS = 8_000_000  # 64 MB of centroids, the most that is sent to a task


def membership(vectors: DataFrame, centers: DataFrame, scale: float = 1.0, block: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, topic, p): softmax of the cosine to every centroid, for rows that have a vector.

    Centroids are taken in blocks: a first look at each keeps the largest value and the sum of the exponentials so far, a second turns a
    block's values into probabilities, so a task holds one block of values for a batch of rows.  The number of topics is limited by the bytes of their centroids alone.
    """
    known = centers.where("topic <> -1").select("topic", "centroid")
    cells = known.agg(F.coalesce(F.sum(F.size("centroid").cast("bigint")), F.lit(0))).first()[0]
    if cells > MAX_CENTER_CELLS:
        raise ValueError(f"the centroids have more than {MAX_CENTER_CELLS} components")
    blocks = list(vector_blocks(known, "topic", "centroid", block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids = batch["doc_id"].to_numpy()[at:at + 256]
                rows = stack(batch["embedding"].iloc[at:at + 256])
                most, total = np.full(len(ids), -np.inf), np.zeros(len(ids))
                for _, matrix in blocks:
                    value = scores(rows, matrix, "cosine") * scale
                    higher = np.maximum(most, value.max(axis=1))
                    total = total * np.exp(most - higher) + np.exp(value - higher[:, None]).sum(axis=1)
                    most = higher
                for topics, matrix in blocks:
                    p = np.exp(scores(rows, matrix, "cosine") * scale - most[:, None]) / total[:, None]
                    yield pd.DataFrame({"doc_id": np.repeat(ids, len(topics)), "topic": np.tile(topics, len(ids)).astype("int32"), "p": p.ravel()})

    return vectors.where(V.nonzero(F.col("embedding"))).select("doc_id", "embedding").mapInPandas(run, "doc_id bigint, topic int, p double")


# --- outliers ---------------------------------------------------------------------------------

HOT_IDF = 4.6  # terms below it may be in most documents
SLACK = 1e-9   # bounds are compared with room for rounding
FEW_TOPICS = 1000       # topics up to which all cosines of a document are computed
CHUNK_TERMS = 500_000   # (document, term) rows of a chunk of documents
CELLS_AT_ONCE = 4_000_000


def outlier_ratio(assignment: DataFrame) -> float:
    return assignment.agg(F.avg((F.col("topic") == -1).cast("double"))).first()[0] or 0.0


def probability_threshold(rows: int) -> float:
    return 0.1 if rows < 500 else 0.05


def reduce_outliers_prob(assignment: DataFrame, probabilities: DataFrame, threshold: float) -> DataFrame:
    """Outliers move to their most probable topic when it is probable enough."""
    best = probabilities.where(F.col("topic") != -1).groupBy("doc_id").agg(
        F.max(F.struct(F.round("p", SCORE_DIGITS).alias("p"), (-F.col("topic")).alias("t"))).alias("b"))
    moved = best.where(F.col("b.p") >= threshold).select("doc_id", (-F.col("b.t")).alias("_to"))
    rows = assignment.join(moved, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("topic") == -1, F.coalesce("_to", "topic")).otherwise(F.col("topic")).alias("topic"))


def unit_topics(weights: DataFrame) -> DataFrame:
    """Stored (term, topic, u, idf): the topics' class-TF-IDF vectors, each of length one; outliers are no topic."""
    inliers = weights.where(F.col("topic") != -1)
    lengths = inliers.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return materialise(lookup_join(inliers, lengths, ["topic"]).where("length > 0").select(
        "term", "topic", (F.col("weight") / F.col("length")).alias("u"), "idf"), "unit-topics")


def split_documents(document_counts: DataFrame, weights: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, head, tail, rest): a document's terms as arrays of (term, v), its vector v of length one.

    Terms stand by the number of topics that have them.  The tail is the longest end of that order whose share in a cosine is under ``threshold`` for every topic;
    ``rest`` is its upper bound.  So a topic without a term of the head is not similar enough, and the terms of most topics meet none of them.
    """
    idf = weights.groupBy("term").agg(F.max("idf").alias("idf"))
    most = topics.groupBy("term").agg(F.max("u").alias("most"), F.count("*").alias("topics"))
    # low idf marks the few terms that may be in most documents
    known = lookup_join(document_counts, idf.join(most, "term", "left"), ["term"], hot=F.col("idf") < HOT_IDF)
    rows = known.withColumn("v", F.col("n") * F.col("idf")).groupBy("doc_id").agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"),
        F.collect_list(F.when(F.col("topics") > 0, F.struct("topics", "term", "v", "most"))).alias("terms"))
    v = lambda t: t["v"] / F.col("length")
    limit = F.lit(float(threshold) - SLACK)
    start = F.struct(F.lit(0.0).alias("rest"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc, t):
        rest = acc["rest"] + v(t) * t["most"]
        fits = acc["open"] & (rest < limit)
        return F.struct(F.when(fits, rest).otherwise(acc["rest"]).alias("rest"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    rows = rows.where(F.col("length") > 0).withColumn("terms", F.sort_array("terms", asc=False))
    rows = rows.withColumn("cut", F.aggregate("terms", start, step))
    parts = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), v(t).alias("v")))
    return rows.withColumn("parts", parts).select(
        "doc_id", F.slice("parts", F.col("cut.n") + 1, F.size("parts")).alias("head"), F.slice("parts", 1, F.col("cut.n")).alias("tail"),
        F.col("cut.rest").alias("rest"))


def _similar_in_chunks(document_counts: DataFrame, weights: DataFrame, topics: DataFrame, threshold: float, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """As ``similar_topics``, for few topics: all cosines of a document with topics that share a term with it.

    Documents stand in chunks.  A chunk asks once for each of its different terms and gets its idf and topics, so a term of many documents is not joined with each of
    them.  Terms are known by two hashes, so another one is not taken for it.
    """
    hashes = F.xxhash64("term").alias("h"), F.hash("term").alias("g")
    counts = materialise(document_counts.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), *hashes, F.col("n").cast("bigint").alias("n")), "hashed-terms")
    chunks = max(1, -(-counts.count() // chunk_terms))
    dealt = counts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
    entries = topics.groupBy("term").agg(F.collect_list(F.struct(F.col("topic").cast("bigint").alias("topic"), "u")).alias("e"))
    known = materialise(weights.groupBy("term").agg(F.max("idf").alias("idf")).join(entries, "term", "left").select(
        *hashes, "idf", F.coalesce("e", F.array().cast("array<struct<topic:bigint,u:double>>")).alias("e")), "topic-lists")

    def ask(rows: pa.Table) -> pa.Table:
        return rows.select(["chunk", "h", "g"]).group_by(["chunk", "h", "g"]).aggregate([])

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, h bigint, g int")
    answered = lookup_join(asked, known, ["h", "g"], stored=True).repartition(chunks, "chunk")

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and held.num_rows:
            kh, kg = (held.column(c).to_numpy() for c in ("h", "g"))
            order = np.lexsort((kg, kh))
            kh, kg = kh[order], kg[order]
            h, g = (rows.column(c).to_numpy() for c in ("h", "g"))
            at = np.minimum(np.searchsorted(kh, h), len(kh) - 1)
            while True:  # past terms that share the first hash only
                wrong = (kh[at] == h) & (kg[at] < g) & (at + 1 < len(kh))
                if not wrong.any():
                    break
                at = at + wrong
            hit = np.flatnonzero((kh[at] == h) & (kg[at] == g))
            entry = order[at[hit]]
            v = rows.column("n").to_numpy()[hit] * held.column("idf").to_numpy()[entry]
            ids, doc = np.unique(rows.column("doc_id").to_numpy()[hit], return_inverse=True)
            length = np.sqrt(np.bincount(doc, v * v, len(ids)))
            lists = held.column("e").combine_chunks()
            size = pc.list_value_length(lists).to_numpy()
            begin = np.cumsum(size) - size
            flat = lists.flatten()
            names, code = np.unique(flat.field(0).to_numpy(), return_inverse=True)
            u = flat.field(1).to_numpy()
            by_doc = np.argsort(doc, kind="stable")
            by_doc = by_doc[(size[entry[by_doc]] > 0) & (length[doc[by_doc]] > 0)]
            step = max(1, CELLS_AT_ONCE // max(1, len(names)))
            for low in range(0, len(ids), step):
                own = by_doc[np.searchsorted(doc[by_doc], low):np.searchsorted(doc[by_doc], low + step)]
                if not len(own):
                    continue
                total, met = np.zeros(step * len(names)), np.zeros(step * len(names), bool)
                before = np.cumsum(size[entry[own]]) // CELLS_AT_ONCE
                for part in np.split(own, np.flatnonzero(before[1:] != before[:-1]) + 1):
                    m = size[entry[part]]
                    place = np.repeat(begin[entry[part]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    cell = np.repeat((doc[part] - low) * len(names), m) + code[place]
                    total += np.bincount(cell, np.repeat(v[part], m) * u[place], len(total))
                    met[cell] = True
                score = np.where(met, total, -np.inf).reshape(step, len(names))[:len(ids) - low]
                score = np.round(score / np.where(length > 0, length, 1)[low:low + step, None], SCORE_DIGITS)
                best = score.argmax(axis=1)  # the smallest of equal topics
                value = score[np.arange(len(best)), best]
                good = np.isfinite(value) & (value >= threshold)
                found.append((ids[low:low + step][good], names[best[good]], value[good]))
        parts = [np.concatenate([np.zeros(0, t), *p]) for t, p in zip(("int64", "int64", "float64"), zip(*found) if found else [[], [], []])]
        return pa.table([pa.array(p) for p in parts], names=["doc_id", "topic", "score"])

    scored = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, "doc_id bigint, topic bigint, score double")
    return scored.select("doc_id", F.col("topic").cast(weights.schema["topic"].dataType).alias("topic"), "score")


def similar_topics(document_counts: DataFrame, weights: DataFrame, threshold: float = 0.1, few_topics: int = FEW_TOPICS) -> DataFrame:
    """(doc_id, topic, score): the topic with the most similar class-TF-IDF vector, of documents that have one with a cosine of ``threshold`` or more.

    Up to ``few_topics`` topics (counted) all cosines are computed, chunk by chunk of the documents.  With more of them it is a sparse join with a prefix filter: the heads of documents meet the topics that have their terms; a topic whose sum over the head, with the bound of the tail, stays under
    ``threshold`` or under the document's best sum is left out; the others are looked up term by term.  Any number of topics and terms; weights are not negative; ties go to the smaller topic.
    """
    topics = unit_topics(weights)
    if topics.select("topic").distinct().limit(few_topics + 1).count() <= few_topics:
        return _similar_in_chunks(document_counts, weights, topics, threshold)
    hot = F.col("idf") < HOT_IDF
    docs = materialise(split_documents(document_counts, weights, topics, threshold), "split")
    heads = docs.select("doc_id", F.inline("head"))
    sums = lookup_join(heads, topics, ["term"], stored=True, hot=hot).groupBy("doc_id", "topic").agg(F.sum(F.col("v") * F.col("u")).alias("sum"))
    sums = materialise(sums, "head-sums")
    best = sums.groupBy("doc_id").agg(F.max("sum").alias("best"))
    known = docs.where(F.size("head") > 0).select("doc_id", "tail", "rest").join(best, "doc_id")
    left = sums.join(known, "doc_id").where(F.col("sum") + F.col("rest") >= F.greatest("best", F.lit(float(threshold))) - SLACK)
    left = materialise(left.select("doc_id", "topic", "sum", "tail"), "left")
    tails = left.select("doc_id", "topic", F.inline("tail"))
    added = lookup_join(tails, topics, ["topic", "term"], stored=True, hot=hot).select(
        "doc_id", "topic", (F.col("v") * F.col("u")).alias("sum"))
    scored = left.select("doc_id", "topic", "sum").unionByName(added).groupBy("doc_id", "topic").agg(F.round(F.sum("sum"), SCORE_DIGITS).alias("score"))
    top = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("topic")).alias("t"))).alias("b"))
    return top.where(F.col("b.score") >= threshold).select("doc_id", (-F.col("b.t")).alias("topic"), F.col("b.score").alias("score"))


def reduce_outliers_ctfidf(assignment: DataFrame, document_counts: DataFrame, weights: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Outliers move to the topic with the most similar class-TF-IDF vector.

    ``document_counts`` is (doc_id, term, n), ``weights`` is (topic, term, weight, idf).
    """
    outliers = assignment.where(F.col("topic") == -1).select("doc_id")
    # the share n / words scales a document's whole vector, so the cosine does not need it
    found = similar_topics(document_counts.join(outliers, "doc_id", "left_semi"), weights, threshold)
    moved = found.select("doc_id", F.col("topic").alias("_to"))
    return assignment.join(moved, "doc_id", "left").select("doc_id", F.coalesce("_to", "topic").alias("topic"))


def reduce_outliers_emb(assignment: DataFrame, vectors: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Outliers move to the topic with the nearest centroid by cosine."""
    tagged = assignment.join(vectors.select("doc_id", "embedding"), "doc_id")
    centers = stored_centroids(tagged.where(F.col("topic") != -1))
    best = assign(tagged.where((F.col("topic") == -1) & V.nonzero(F.col("embedding"))), centers)
    moved = best.where(F.col("score") >= threshold).select("doc_id", F.col("topic").alias("_to"))
    return assignment.join(moved, "doc_id", "left").select("doc_id", F.coalesce("_to", "topic").alias("topic"))


def outlier_advice(assignment: DataFrame, min_size: int = 10) -> DataFrame:
    """One row: the method and parameters that suit the share of outliers."""
    counted = assignment.agg(F.count("*").alias("documents"), F.avg((F.col("topic") == -1).cast("double")).alias("ratio"))
    many, some = F.col("ratio") > 0.30, F.col("ratio") > 0.15
    n = F.col("documents")
    most = F.greatest(F.lit(5), F.floor(n / min_size))
    topics = F.least(most, F.greatest(F.lit(5), F.floor(n / 50)))
    return counted.select(
        "documents", F.round("ratio", 6).alias("outlier_ratio"),
        F.when(many, "kmeans").otherwise("density").alias("method"),
        F.when(many, topics).cast("bigint").alias("topics"),
        F.when(many, F.lit(None)).when(some, max(3, min_size // 3)).otherwise(min_size).cast("int").alias("min_cluster_size"),
        F.when(many, F.lit(None)).when(some, max(1, min_size // 5)).otherwise(max(1, min_size // 2)).cast("int").alias("min_samples"),
        F.lit(min_size).alias("min_topic_size"))


# --- merging ----------------------------------------------------------------------------------

def renumber(mapping: DataFrame) -> DataFrame:
    """(topic, new_topic) -> dense ids 0.. in the order of the target's old id; -1 stays.  Topic-sized."""
    order = Window.orderBy("target")
    return mapping.where(F.col("target") != -1).select(
        "topic", (F.dense_rank().over(order) - 1).cast("int").alias("new_topic")).unionByName(
        mapping.where(F.col("target") == -1).select("topic", F.lit(-1).alias("new_topic")))


def merge_small(vectors: DataFrame, min_size: int = 10) -> DataFrame:
    """(doc_id, topic): small topics join the large topic with the nearest mean vector, then ids become dense.

    Only topics that are large at the start receive, so one pass is exact.  A topic
    whose vectors are all zero has no mean and stays.  ``vectors`` is (doc_id, topic, embedding).
    """
    sizes = materialise(vectors.groupBy("topic").agg(
        F.count("*").alias("count"), F.max(V.nonzero(F.col("embedding")).cast("int")).alias("has_vector")), "sizes")
    small = sizes.where((F.col("topic") != -1) & (F.col("count") < min_size))
    if small.isEmpty():
        return vectors.select("doc_id", "topic")
    means = stored_centroids(vectors.where(F.col("topic") != -1))
    usable = sizes.where("has_vector = 1").select("topic", "count")
    large = means.join(usable.where(F.col("count") >= min_size).select("topic"), "topic", "left_semi")
    lone = means.join(usable.where(F.col("count") < min_size).select("topic"), "topic", "left_semi")
    target = nearest(lone, "centroid", large, "topic", "centroid", "cosine", "_to").select("topic", F.col("_to").cast("int").alias("_to"))
    mapping = sizes.join(target, "topic", "left").select("topic", F.coalesce("_to", "topic").alias("target"))
    return lookup_join(vectors.select("doc_id", "topic"), renumber(mapping), ["topic"]).select(
        "doc_id", F.col("new_topic").alias("topic"))


MERGES = "topics array<int>, left_first int, left_n int, right_first int, right_n int, distance double"


def _merge_rest(rows: list) -> list[tuple]:
    """Rows of MERGES for groups few enough for the driver: the two nearest merge, again and again."""
    if not rows:
        return []
    matrix = np.array([r["embedding"] for r in rows], dtype="float64")
    distance = 1 - np.round(matrix @ matrix.T, SCORE_DIGITS)
    np.fill_diagonal(distance, np.inf)
    members = [list(r["topics"]) for r in rows]
    merges = []
    for _ in range(len(rows) - 1):
        a, b = sorted(divmod(int(distance.argmin()), len(rows)))
        weight = np.array([len(members[a]), len(members[b])], dtype="float64")
        mixed = (weight[0] * distance[a] + weight[1] * distance[b]) / weight.sum()
        merges.append((sorted(members[a] + members[b]), min(members[a]), len(members[a]), min(members[b]), len(members[b]), float(distance[a, b])))
        members[a] = members[a] + members[b]
        distance[a], distance[:, a] = mixed, mixed
        distance[b], distance[:, b], distance[a, a] = np.inf, np.inf, np.inf
    return merges


def merge_table(centers: DataFrame, few: int = MAX_TOPICS) -> DataFrame:
    """(parent_id, topics, left_id, right_id, distance): successive merges of the two nearest groups of topics, average linkage on cosine distance.

    The mean similarity of two groups is the product of the means of their unit vectors, so a group is one vector, however many topics it holds.
    While more than ``few`` groups are left, every round finds each group's nearest and merges all pairs that are each other's nearest;
    for average linkage these are the merges of the one-by-one order.  The rest is merged on the driver.  Merged groups are numbered by distance, after
    the largest topic id.
    """
    from topicloom.operators.search import knn

    spark = centers.sparkSession
    length = V.norm(F.col("centroid"))
    unit = F.transform("centroid", lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))
    groups = materialise(centers.where("topic <> -1").select(
        F.col("topic").cast("bigint").alias("item_id"), unit.alias("embedding"), F.array(F.col("topic").cast("int")).alias("topics")), "groups")
    highest = groups.agg(F.max("item_id")).first()[0]
    if highest is None:
        return spark.createDataFrame([], "parent_id int, topics array<int>, left_id int, right_id int, distance double")
    done = []
    while groups.limit(few + 1).count() > few:
        near = knn(groups.select(F.col("item_id").alias("query_id"), "embedding"), groups.select("item_id", "embedding"), 1, "dot", exclude_self=True)
        near = materialise(near.select("query_id", "item_id", "similarity"), "nearest")
        back = near.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("query_id"))
        pairs = near.join(back, ["query_id", "item_id"]).where("query_id < item_id").select(
            F.col("query_id").alias("left"), F.col("item_id").alias("right"), "similarity")
        side = lambda name: groups.select(F.col("item_id").alias(name), F.col("topics").alias(f"_{name}"), F.col("embedding").alias(f"e_{name}"))  # noqa: B023, E731
        both = materialise(pairs.join(side("left"), "left").join(side("right"), "right"), "pairs")
        done.append(both.select(
            F.array_sort(F.concat("_left", "_right")).alias("topics"), F.col("left").cast("int").alias("left_first"), F.size("_left").alias("left_n"),
            F.col("right").cast("int").alias("right_first"), F.size("_right").alias("right_n"), (1 - F.col("similarity")).alias("distance")))
        mean = F.zip_with("e_left", "e_right", lambda x, y: (x * F.size("_left") + y * F.size("_right")) / (F.size("_left") + F.size("_right")))
        merged = both.select(F.col("left").alias("item_id"), mean.alias("embedding"), F.array_sort(F.concat("_left", "_right")).alias("topics"))
        gone = both.select(F.explode(F.array("left", "right")).alias("item_id"))
        groups = materialise(groups.join(gone, "item_id", "left_anti").unionByName(merged), "groups")
    rest = groups.orderBy("item_id").collect()  # at most ``few`` rows
    merges = spark.createDataFrame(_merge_rest(rest), MERGES)
    for part in done:
        merges = merges.unionByName(part)
    numbered = running_totals(merges.withColumn("first", F.get("topics", F.lit(0))).withColumn("n", F.size("topics")), ["distance", "n", "first"])
    numbered = materialise(numbered.withColumn("parent_id", (F.col("row") + (highest + 1)).cast("int")), "merges")
    # a group is known by its smallest topic and its size
    made = numbered.select("first", "n", F.col("parent_id").alias("id"))
    for name in ("left", "right"):
        own = made.select(F.col("first").alias(f"{name}_first"), F.col("n").alias(f"{name}_n"), F.col("id").alias(f"{name}_id"))
        numbered = numbered.join(own, [f"{name}_first", f"{name}_n"], "left").withColumn(f"{name}_id", F.coalesce(f"{name}_id", f"{name}_first"))
    return materialise(numbered.select("parent_id", "topics", "left_id", "right_id", "distance"), "merges")


AUTO_SIMILARITY = 0.915


def reduce_topics(vectors: DataFrame, nr_topics: int | None, few: int = MAX_TOPICS) -> DataFrame:
    """(doc_id, topic): nearest topics merge until ``nr_topics`` are left, or while they are alike when it is None.

    New ids are dense by size, largest first.
    """
    merges = merge_table(stored_centroids(vectors), few)
    if nr_topics is not None:
        last = merges.agg(F.max("parent_id") - max(nr_topics - 1, 0)).first()[0]
        applied = merges.where(F.col("parent_id") <= (-1 if last is None else last))
    else:
        stop = merges.where(1 - F.col("distance") < AUTO_SIMILARITY).agg(F.min("parent_id")).first()[0]
        applied = merges if stop is None else merges.where(F.col("parent_id") < stop)
    # the last merge that holds a topic says where it ends
    moves = materialise(applied.select(F.explode("topics").alias("topic"), "parent_id").groupBy("topic").agg(F.max("parent_id").alias("_to")), "moves")
    sizes = vectors.groupBy("topic").agg(F.count("*").alias("n"))
    mapped = materialise(sizes.join(moves, "topic", "left").withColumn("target", F.coalesce("_to", "topic")), "targets")
    by_size = mapped.where("target <> -1").groupBy("target").agg(F.sum("n").alias("n"), F.min("topic").alias("first"))
    ranked = by_size.select("target", (F.row_number().over(Window.orderBy(F.col("n").desc(), "first")) - 1).cast("int").alias("new_topic"))  # topic-sized
    final = mapped.join(ranked, "target", "left").select("topic", F.coalesce("new_topic", F.lit(-1)).alias("new_topic"))
    return lookup_join(vectors.select("doc_id", "topic"), final, ["topic"]).select("doc_id", F.col("new_topic").alias("topic"))


# --- splitting --------------------------------------------------------------------------------

def split_topic(docs: DataFrame, vectors: DataFrame, topic: int, k: int, seed: int = 42) -> DataFrame:
    """(part, count, keywords, percent): parts of one topic by k-means on its stored vectors.

    Empty when the topic has fewer than max(10, 2k) documents.
    """
    own = vectors.where(F.col("topic") == topic)
    if own.limit(max(10, 2 * k)).count() < max(10, 2 * k):
        return docs.sparkSession.createDataFrame([], "part int, count bigint, keywords string, percent double")
    parts = materialise(kmeans(own.select("doc_id", "embedding"), k, seed), "parts")
    tagged = docs.select("doc_id", "text").join(parts, "doc_id")
    ranked = topic_keyword_list(tagged, top_n=5, min_chars=4, stop_words=SPLIT_COMMON_WORDS)
    words = joined(ranked, "topic", "token", ", ", "keywords")
    counts = parts.groupBy("topic").agg(F.count("*").alias("count"))
    share = F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 1)  # k rows
    return counts.join(words, "topic", "left").select(F.col("topic").alias("part"), "count", "keywords", share.alias("percent"))


def coherence(vectors: DataFrame, keys: tuple[str, ...] = ("topic",)) -> DataFrame:
    """(keys, n, coherence): mean pairwise cosine of each group, from the sum of its unit vectors."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    length = V.norm(F.col("embedding"))
    unit = F.transform("embedding", lambda x: x.cast("double") / length)
    usable = vectors.where(V.nonzero(F.col("embedding"))).withColumn("_u", unit)
    summed = usable.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector("_u")).alias("_m"), F.count("*").alias("n"))
    total = V.dot(vector_to_array("_m"), vector_to_array("_m")) * F.col("n") * F.col("n")
    n = F.col("n").cast("double")
    return summed.select(*keys, "n", F.round(F.try_divide(total - n, n * (n - 1)), 6).alias("coherence"))


def nearest_in_group(df: DataFrame, group: str, table: DataFrame, part: str = "part", out: str = "part") -> DataFrame:
    """Nearest (cosine) of the few vectors that belong to each row's own group.

    ``table`` is (group, part, centroid), at most three rows per topic.
    """
    rows = bounded_rows(table.select(group, part, "centroid").orderBy(group, part), 4 * MAX_TOPICS, "the part table")
    by_group: dict[int, tuple[list[int], np.ndarray]] = {}
    for g in {r[group] for r in rows}:
        own = [r for r in rows if r[group] == g]
        by_group[g] = ([r[part] for r in own], np.array([r["centroid"] for r in own], dtype="float64"))

    @F.pandas_udf("int")
    def pick(column: pd.Series, groups: pd.Series) -> pd.Series:
        result = np.zeros(len(column), dtype="int32")
        if len(column):
            matrix = stack(column)
            for g in groups.unique():
                at = np.nonzero(groups.to_numpy() == g)[0]
                parts, block = by_group[g]
                result[at] = np.array(parts)[scores(matrix[at], block, "cosine").argmax(axis=1)]
        return pd.Series(result)

    return df.withColumn(out, pick("embedding", group))


def refine_topics(vectors: DataFrame, min_docs: int = 15, min_coherence: float = 0.4, rounds: int = 8, seed: int = 42) -> DataFrame:
    """(doc_id, topic): incoherent topics are split into the two or three parts with the best inner cosine.

    All such topics are split at once; every part keeps at least two documents, the
    first part keeps the topic's id and the others follow the largest id.
    """
    loose = materialise(coherence(vectors.where(F.col("topic") != -1)).where(
        (F.col("n") >= min_docs) & (F.col("coherence") < min_coherence)), "loose")
    if loose.isEmpty():
        return vectors.select("doc_id", "topic")
    members = materialise(lookup_join(
        vectors.where(V.nonzero(F.col("embedding"))).select("doc_id", "topic", "embedding"), loose.select("topic"), ["topic"]), "members")
    draw = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(seed))))
    tries = []
    for k in (2, 3):
        starts = top_k(members.withColumn("_d", draw), ["topic"], [F.col("_d")], k).select(
            "topic", (F.col("rank") - 1).alias("part"), F.col("embedding").cast("array<double>").alias("centroid"))
        starts = materialise(starts, "starts")
        for _ in range(rounds):
            tagged = nearest_in_group(members, "topic", starts)
            starts = materialise(centroids_of_parts(tagged), "starts")
        tries.append(nearest_in_group(members, "topic", starts).withColumn("k", F.lit(k)))
    both = materialise(tries[0].unionByName(tries[1]), "tries")
    quality = coherence(both, ("k", "topic", "part")).groupBy("topic", "k").agg(
        F.min("n").alias("smallest"), F.count("*").alias("parts"), F.avg("coherence").alias("quality"))
    good = quality.where((F.col("smallest") >= 2) & (F.col("parts") >= 2))
    best = good.groupBy("topic").agg(F.max_by("k", F.struct("quality", -F.col("k"))).alias("k"))
    chosen = lookup_join(both.select("doc_id", "topic", "k", "part"), best, ["topic", "k"])
    highest = vectors.agg(F.max("topic")).first()[0]
    ids = materialise(chosen.select("topic", "part").distinct(), "part-ids")
    extra = ids.join(ids.groupBy("topic").agg(F.min("part").alias("_first")), "topic").where("part <> _first").select(
        "topic", "part", (F.row_number().over(Window.orderBy("topic", "part")) + highest).alias("new_topic"))
    moved = lookup_join(chosen, extra, ["topic", "part"]).select("doc_id", "new_topic")
    return vectors.select("doc_id", "topic").join(moved, "doc_id", "left").select(
        "doc_id", F.coalesce("new_topic", "topic").alias("topic"))


def centroids_of_parts(tagged: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    return tagged.groupBy("topic", "part").agg(
        Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("_m")
    ).select("topic", "part", vector_to_array("_m").alias("centroid"))


# --- groups of documents modelled apart -------------------------------------------------------

def group_topic_offsets(grouped: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, topic): local topic ids of each group become one dense numbering, group after group.

    ``grouped`` is (doc_id, group, topic); -1 stays an outlier.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("group"))
    ids = grouped.where(F.col("topic") != -1).select("group", "topic").distinct()
    numbered = ids.select("group", "topic", (F.dense_rank().over(Window.orderBy(place, "topic")) - 1).cast("int").alias("_new"))
    return lookup_join(grouped, numbered, ["group", "topic"], "left").select(
        "doc_id", F.coalesce("_new", F.lit(-1)).alias("topic"))


# --- parameters -------------------------------------------------------------------------------

def auto_params(rows: DataFrame, min_topic_size: int = 10) -> DataFrame:
    """(profile, parameter, value): what the row count suggests, for the three profiles in use."""
    # The limits of size classes and what each class suggests, in all expressions below.
    n = F.col("n")
    root = F.sqrt(n.cast("double"))
    whole = lambda c: F.floor(c).cast("int")
    cap = lambda lo, hi, c: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    counted = rows.agg(F.count("*").alias("n"))
    topics = (
        F.when(n < 50, F.greatest(F.lit(3), F.least(F.lit(6), whole(n / 10))))
        .when(n < 200, F.greatest(F.lit(4), F.least(F.lit(10), whole(n / 15))))
        .when(n < 1000, F.greatest(F.lit(5), F.least(F.lit(20), whole(root * 0.7))))
        .otherwise(F.greatest(F.lit(10), F.least(F.lit(50), whole(F.log2(n) * 3))))
    )
    d = counted.withColumn("t", topics)
    t = F.col("t")
    clusters = F.least(t, F.greatest(F.lit(3), whole(n / 10)))
    small, medium = n < 500, n < 5000
    tiny, middle = n < 100, n < 1000
    min_size = F.when(middle, F.greatest(F.lit(10), whole(n / 50))).when(n < 10000, F.greatest(F.lit(20), whole(n / 100))).otherwise(
        F.greatest(F.lit(100), whole(n / 200)))
    values = {
        ("sentiment", "topics"): t,
        ("sentiment", "neighbours"): F.when(tiny, cap(5, 15, whole(n / 4))).when(middle, F.least(F.lit(30), F.greatest(F.lit(15), whole(root * 0.8)))).otherwise(
            F.least(F.lit(50), F.greatest(F.lit(30), whole(root)))),
        ("sentiment", "components"): F.when(tiny, F.when(t > 2, F.least(F.lit(3), t)).otherwise(2)).when(
            middle, F.when(t > 3, F.least(F.lit(5), t)).otherwise(3)).otherwise(F.least(F.lit(10), F.greatest(F.lit(5), whole(t / 2)))),
        ("sentiment", "min_cluster_size"): F.when(tiny, F.greatest(F.lit(2), whole(n / (clusters * 2)))).when(
            middle, F.greatest(F.lit(5), F.least(F.lit(min_topic_size), whole(n / 30)))).otherwise(
            F.greatest(F.lit(10), F.least(F.lit(min_topic_size), whole(n / 50)))),
        ("sentiment", "max_features"): F.when(n > 1000, 5000).otherwise(1000),
        ("sentiment", "min_df"): F.when(n > 100, 2).otherwise(1),
        ("adaptive", "neighbours"): F.when(small, cap(2, 15, whole(n / 10))).otherwise(15),
        ("adaptive", "clusters"): F.when(small, F.when(n < 30, 3).when(n < 100, F.least(F.lit(8), whole(n / 6))).otherwise(
            F.least(F.lit(15), whole(n / 10)))),
        ("adaptive", "max_features"): F.when(small, 500).when(medium, 2000).otherwise(5000),
        ("adaptive", "min_df"): F.when(small, 1).when(medium, 2).otherwise(5),
        ("adaptive", "min_topic_size"): F.when(small, cap(2, 10, F.lit(min_topic_size))).otherwise(min_topic_size),
        ("recluster", "min_topic_size"): min_size,
        ("recluster", "kmeans_topics"): F.greatest(F.lit(2), F.least(F.greatest(F.lit(5), whole(n / F.greatest(F.lit(2), min_size))),
                                                   F.greatest(F.lit(5), whole(n / 50)))),
        ("recluster", "density_topics"): F.when(middle, F.greatest(F.lit(5), F.least(F.lit(20), whole(n / 50)))).when(
            n < 10000, F.greatest(F.lit(10), F.least(F.lit(50), whole(n / 200)))).otherwise(
            F.greatest(F.lit(20), F.least(F.lit(100), whole(n / 400)))),
    }
    entries = F.array(*[
        F.struct(F.lit(p).alias("profile"), F.lit(name).alias("parameter"), v.cast("int").alias("value")) for (p, name), v in values.items()])
    return d.select(F.inline(entries))
