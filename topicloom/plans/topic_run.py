"""Whole runs composed of operators: a topic run, a run per sentiment, a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators import clustering as D
from topicloom.operators import density as N
from topicloom.operators import embedding as C
from topicloom.operators import keywords as K
from topicloom.operators import labels as L
from topicloom.operators import preprocess as P
from topicloom.operators import search as H
from topicloom.operators import spectral as Y
from topicloom.plans.execution import lookup_join, materialise, running_totals
from topicloom.sources import tables as IO


def cluster_space(vectors: DataFrame, space: str, components: int = 5) -> DataFrame:
    """(doc_id, embedding): the coordinates to cluster in, ``embedding`` itself, its ``pca`` or the ``spectral`` embedding of its neighbour graph.

    A table too small to be reduced keeps its own vectors.
    """
    if space == "pca":
        reduced = C.reduce_dims(vectors, components)
    elif space == "spectral":
        found = Y.spectral_embedding(vectors, components)
        reduced = None if found is None else found[0]
    elif space == "embedding":
        reduced = None
    else:
        raise ValueError(f"unknown space {space!r}")
    if reduced is None:
        return vectors.select("doc_id", "embedding")
    return materialise(reduced.select("doc_id", F.col("reduced").alias("embedding")), "space")


def recluster(docs: DataFrame, vectors: DataFrame, n_topics: int, min_size: int = 10, method: str = "kmeans",
              seeds: DataFrame | None = None, label: bool = True, space: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(assignment, topic table) from stored embeddings: cluster, merge small topics, describe.

    Embeddings are the one table worth keeping between runs; another topic count starts here.  Documents are clustered in ``space``; seeds are looked up, and
    small topics merged, by the embeddings themselves.
    """
    rows = cluster_space(vectors, space)
    if method == "kmeans":
        found = D.kmeans(rows, n_topics) if seeds is None else D.kmeans_seeded(vectors, seeds, n_topics, space=None if space == "embedding" else rows)
    else:
        n = vectors.count()
        usable = vectors.where(C.V.nonzero(F.col("embedding"))).count()
        found = N.density_cluster(rows, N.min_cluster_size(n, usable, n_topics, min_size))
    found = materialise(found, "assignment")
    if min_size > 2:
        found = materialise(D.merge_small(found.join(vectors.select("doc_id", "embedding"), "doc_id"), min_size), "merged")
    tagged = materialise(docs.select("doc_id", "text").join(found, "doc_id"), "tagged", "zstd")  # read several times below
    keywords = K.stored_keywords(tagged, stored=True)
    labels = L.topic_labels(tagged, keywords, stored=True) if label else None
    return found, K.topic_info(found, keywords, labels)


def topic_run(raw: DataFrame, n_topics: int, min_size: int = 10, method: str = "kmeans", dim: int = 64,
              label: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clean, embed, cluster and describe raw documents (doc_id, text)."""
    docs = materialise(P.clean_documents(raw), "clean")
    vectors = materialise(C.embed(docs, dim), "vectors")
    return recluster(docs, vectors, n_topics, min_size, method, label=label)


SENTIMENTS = ["positive", "negative", "neutral"]


LEAF_DOCUMENTS = 500  # groups up to this size take the leaves of the hierarchy


def sentiment_first(vectors: DataFrame, rated: DataFrame, min_size: int = 10) -> DataFrame:
    """(doc_id, topic, probability): each sentiment is clustered on its own, refined, then numbered one after the other.

    The minimum size is halved twice, and never below two.  Groups of up to 500 documents use the leaves of the hierarchy, groups of
    fewer than ten k-means with at most three clusters.  ``probability`` is a document's density level in its cluster, 0 for outliers, 1 from k-means.
    """
    tagged = materialise(vectors.select("doc_id", "embedding").join(rated.select("doc_id", "sentiment"), "doc_id"), "rated")
    size = max(2, max(2, min_size // 2) // 2)
    counts = {r["sentiment"]: r["count"] for r in tagged.groupBy("sentiment").count().collect()}  # three rows
    parts = []
    large = [name for name, n in counts.items() if n >= 10]
    if large:
        own = tagged.where(F.col("sentiment").isin(large))
        plan = tagged.sparkSession.createDataFrame(
            [(name, size, "leaf" if counts[name] <= LEAF_DOCUMENTS else "stability") for name in large], "g string, cluster_size int, selection string")
        found = materialise(N.density_cluster(own, plan, group="sentiment", probability=True), "dense")
        refined = D.refine_topics(materialise(own.join(found.drop("probability"), "doc_id"), "group-topics"))
        parts.append(refined.join(found.select("doc_id", "probability"), "doc_id").join(own.select("doc_id", F.col("sentiment").alias("group")), "doc_id"))
    for name, n in counts.items():
        if n < 10:
            own = tagged.where(F.col("sentiment") == name).select("doc_id", "embedding")
            few = D.kmeans(own, max(1, min(n // 2, 3)))
            parts.append(few.withColumns({"probability": F.when(F.col("topic") == -1, 0.0).otherwise(1.0), "group": F.lit(name)}))
    grouped = parts[0]
    for part in parts[1:]:
        grouped = grouped.unionByName(part)
    grouped = materialise(grouped, "grouped")
    return D.group_topic_offsets(grouped, SENTIMENTS).join(grouped.select("doc_id", "probability"), "doc_id")


def describe_subtopics(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """(topic, subtopic, n, keywords): size and keywords of every part found by ``density.subtopics``; outliers of a topic have no row."""
    named = parts.where("subtopic <> -1").groupBy("topic", "subtopic").agg(F.count("*").alias("n"))
    numbered = materialise(named.withColumn("part", (F.row_number().over(Window.orderBy("topic", "subtopic")) - 1).cast("int")), "part-numbers")  # one row for each part
    tagged = lookup_join(docs.select("doc_id", "text").join(parts, "doc_id"), numbered.select("topic", "subtopic", "part"), ["topic", "subtopic"], stored=True)
    words = K.topic_keywords(tagged.select("doc_id", "text", F.col("part").alias("topic")), min_chars=4, shown=8)
    return numbered.join(words.withColumnRenamed("topic", "part"), "part").select("topic", "subtopic", "n", "keywords")


def chunk_items(docs: DataFrame, assignment: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """(item_id, doc_id, chunk_no, text, embedding, topic): the chunks of all documents with their parent's topic, stored by topic under ``path``.

    The topic is a folder, so a search bound to topics reads the chunks of these only.  ``encode`` turns (doc_id, text) into (doc_id, embedding);
    items are numbered by document and chunk.
    """
    cut = materialise(P.chunk_documents(docs.select("doc_id", "text"), size, overlap).select("doc_id", "chunk_no", "text"), "chunks")
    chunks = running_totals(cut, ["doc_id", "chunk_no"]).withColumnRenamed("row", "item_id")  # the numbered rows are stored
    vectors = encode(chunks.select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item_id")
    topics = assignment.select("doc_id", "topic")
    # the writer reads its rows three times: for their bytes, their ranges and the files
    IO.write_by_topic(materialise(chunks.join(vectors, "item_id").join(topics, "doc_id"), "chunk-vectors"), path)
    return docs.sparkSession.read.parquet(path).select("item_id", "doc_id", "chunk_no", "text", "embedding", "topic")


def answer_batch(questions: DataFrame, items: DataFrame, info: DataFrame, answer: Callable[[DataFrame], DataFrame],
                 k: int = 10, reranked: bool = True, threshold: float = 0.0) -> DataFrame:
    """(query_id, topic_filter, context, answer, sources) for a table of questions.

    ``questions`` is (query_id, text, embedding), ``items`` is (item_id, text, embedding, topic): documents, or chunks as of ``chunk_items``.
    The context of a question about a topic opens with that topic's label and keywords from ``info``.
    ``answer`` adds a column ``answer`` to (query_id, question, context).  A question without
    hits has a null context.
    """
    known = items.select("topic").distinct()
    asked = materialise(P.resolve_topic_refs(questions, known), "questions")
    found = H.search_variants(asked.select("query_id", F.lit(0).alias("variant"), "embedding", "topic_filter"),
                              items, 3 * k if reranked else k, in_topic=True)
    found = materialise(found, "hits")
    texts = lookup_join(items.select("item_id", "text", "topic"), found, ["item_id"], stored=True)
    hits = texts.join(asked.select("query_id", F.col("text").alias("query_text"), F.col("topic_filter").alias("current_topic")), "query_id")
    if reranked:
        hits = H.rerank(hits, k, threshold)
    hits = materialise(hits, "ranked-hits")
    context = H.build_context(hits, info)
    prompts = asked.select("query_id", F.col("text").alias("question"), "topic_filter").join(context, "query_id", "left")
    answered = answer(prompts)
    return answered.join(H.build_sources(hits), "query_id", "left").select(
        "query_id", "topic_filter", "context", "answer", "sources")
