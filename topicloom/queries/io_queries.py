"""Sources, sinks and round trips: tables are written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators import clustering as D
from topicloom.operators import similarity as S
from topicloom.operators import terms as M
from topicloom.plans.execution import lookup_join, materialise, scratch_path
from topicloom.queries import base as B
from topicloom.queries.analytics_queries import INFO, named_info
from topicloom.queries.cluster_queries import ORACLES as CLUSTER_ORACLES
from topicloom.queries.cluster_queries import all_vectors
from topicloom.sources import tables as IO

# --- Spark ------------------------------------------------------------------------------------


def read_csv(spark, sf):
    """The documents written as CSV and read back."""
    path = scratch_path(spark, "csv")
    rows = B.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    IO.write_results(rows, path)
    return IO.read_csv(spark, path, "doc_id bigint, text string, lang string, n_chars bigint")


def text_columns(spark, sf):
    return IO.text_columns(B.table(spark, sf, "documents"))


def results(spark, sf):
    info = named_info(spark, sf)
    rows = B.topic_documents(spark, sf)
    label = lookup_join(rows, info.select("topic", "human_label"), ["topic"], "left")
    return label.select("doc_id", "text", "topic", F.col("human_label").alias("topic_label"))


def export_results(spark, sf):
    path = scratch_path(spark, "results")
    IO.write_results(results(spark, sf), path, "parquet")
    return spark.read.parquet(path)


def export_topic_info(spark, sf):
    """Topics 0 and 5 have an analysis."""
    info = named_info(spark, sf).withColumn("analysis", F.when(F.col("topic").isin(0, 5), F.concat(F.lit("About "), F.col("keywords"))).otherwise(""))
    path = scratch_path(spark, "topic-info")
    IO.write_topic_info(info, path, "parquet")
    return spark.read.parquet(path)


def export_by_topic(spark, sf):
    path = scratch_path(spark, "by-topic")
    IO.write_by_topic(B.topic_documents(spark, sf), path)
    return spark.read.parquet(path).groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def run_report(spark, sf):
    return IO.run_report(B.assignment(spark, sf))


def topic_reports(spark, sf):
    info = materialise(named_info(spark, sf), "info")
    return IO.topic_reports(info, info.select("topic", F.concat(F.lit("About "), F.col("keywords")).alias("summary")))


def report_data(spark, sf):
    rows = results(spark, sf).join(B.sentiment(spark, sf), "doc_id", "left").withColumn("topic_label", F.when(
        F.col("topic") == -1, "Outliers").otherwise(F.concat(F.lit("Topic "), F.col("topic").cast("string"))))
    return IO.report_data(rows).withColumn("documents", F.array_join("documents", "\n"))


def session_roundtrip(spark, sf):
    """Assignment, vectors and topic table saved and loaded; one row per document."""
    path = scratch_path(spark, "session")
    IO.save_session(path, {"assignment": B.assignment(spark, sf), "vectors": B.vectors(spark, sf), "topic_info": named_info(spark, sf)},
                    {"clustering_method": "kmeans"})
    tables, parameters = IO.load_session(spark, path)
    rows = tables["assignment"].join(tables["vectors"].select("doc_id", F.size("embedding").alias("dim")), "doc_id", "left")
    rows = lookup_join(rows, tables["topic_info"].select("topic", "keywords"), ["topic"], "left", stored=True)
    return rows.select("doc_id", "topic", "dim", "keywords", F.lit(parameters["clustering_method"]).alias("method"),
                       F.lit(parameters["min_topic_size"]).alias("min_topic_size"))


def model_roundtrip(spark, sf):
    """A model saved, loaded, and used to assign all documents."""
    path = scratch_path(spark, "model")
    docs = B.topic_documents(spark, sf)
    IO.save_model(path, S.centroids(B.vectors(spark, sf)), M.top_terms(M.ctfidf(M.topic_terms(docs)), 10), named_info(spark, sf), {})
    model, _ = IO.load_model(spark, path)
    return D.assign(all_vectors(spark, sf), model["centers"]).select("doc_id", "topic")


def index_roundtrip(spark, sf):
    """Vectors by topic as cells, saved and loaded, with the consistency check."""
    path = scratch_path(spark, "index")
    vectors = B.vectors(spark, sf)
    index = vectors.select(F.col("doc_id").alias("item_id"), "embedding", F.col("topic").alias("cell"))
    IO.save_index(index, S.centroids(vectors).select(F.col("topic").alias("cell"), F.col("centroid").alias("center")), path)
    items, centers = IO.load_index(spark, path, vectors, vectors)
    state = IO.index_state(items, vectors, B.table(spark, sf, "documents"))
    per_cell = items.join(centers.select("cell"), "cell").groupBy("cell").agg(F.count("*").alias("n"))
    return per_cell.crossJoin(state)  # one row of state


def fingerprint(spark, sf):
    return IO.fingerprint(B.table(spark, sf, "documents"))


def cached_reduction(spark, sf):
    """Word counts computed once and found again under the same fingerprint."""
    folder = scratch_path(spark, "cache")
    docs = B.documents(spark, sf)
    count = lambda df: df.select("doc_id", F.size(T.word_tokens(F.col("text"))).alias("words"))
    IO.cached(docs, {"mode": "words"}, folder, count)
    return IO.cached(docs, {"mode": "words"}, folder, lambda df: df.limit(0).select("doc_id", F.lit(-1).alias("words")))


QUERIES = {
    f.__name__: f for f in (
        read_csv, text_columns, export_results, export_topic_info, export_by_topic, run_report, topic_reports, report_data,
        session_roundtrip, model_roundtrip, index_roundtrip, fingerprint, cached_reduction)
}

# --- DuckDB -----------------------------------------------------------------------------------

ORACLES = {
    "read_csv": "SELECT doc_id, text, lang, n_chars FROM documents",
    "text_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS filled, round(avg(length({c})), 4) AS mean_length FROM documents" for c in ("text", "lang", "source")),
    "export_results": B.with_sql(INFO, body="""SELECT t.doc_id, t.text, t.topic, i.human_label AS topic_label FROM tdocs t LEFT JOIN info i ON t.topic = i.topic"""),
    "export_topic_info": B.with_sql(INFO, body="""SELECT topic, human_label, CASE WHEN topic IN (0, 5) THEN 'About ' || keywords ELSE '' END AS analysis,
        keywords, count FROM info"""),
    "export_by_topic": B.with_sql(B.TDOCS, body="SELECT topic, count(*) AS n, sum(length(text))::BIGINT AS chars FROM tdocs GROUP BY topic"),
    "run_report": B.with_sql(B.ASSIGN,
        "c AS (SELECT topic, count(*) AS n FROM assign WHERE topic <> -1 GROUP BY topic)",
        "o AS (SELECT count(*) FILTER (n::DOUBLE / (SELECT sum(n) FROM c) > 0.30) AS big, count(*) AS topics FROM c)",
        body="""SELECT count(*) AS documents, any_value(o.topics) AS topics, count(*) FILTER (topic = -1) AS outliers,
        round(100.0 * count(*) FILTER (topic <> -1) / count(*), 1) AS coverage, 10 AS min_topic_size, 'kmeans' AS method,
        CASE WHEN any_value(o.big) = 0 THEN 'Balanced' ELSE 'Needs Attention' END AS balance_status, any_value(o.big) AS oversized_topics FROM assign, o"""),
    "topic_reports": B.with_sql(INFO, body="""SELECT topic, 'Topic ' || topic || ': ' || human_label || chr(10) || 'Keywords: ' || keywords || chr(10)
        || 'Documents: ' || count || chr(10) || chr(10) || 'About ' || keywords AS report FROM info"""),
    "report_data": B.with_sql(B.TDOCS, B.SENT,
        "rs AS (SELECT t.*, s.sentiment FROM tdocs t LEFT JOIN sent s ON t.doc_id = s.doc_id)",
        "f AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS r FROM rs WHERE topic <> -1)",
        body="""SELECT 'Topic ' || topic AS topic_label, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM tdocs), 1) AS percentage,
        string_agg(CASE WHEN sentiment IS NULL THEN '' ELSE '[' || upper(sentiment) || '] ' END || text, chr(10) ORDER BY r) FILTER (r <= 20) AS documents
        FROM f GROUP BY topic"""),
    "session_roundtrip": B.with_sql(INFO, body="""SELECT a.doc_id, a.topic, len(e.embedding)::INT AS dim, i.keywords, 'kmeans' AS method, 10 AS min_topic_size
        FROM assign a LEFT JOIN embeddings e ON a.doc_id = e.vec_id LEFT JOIN info i ON a.topic = i.topic"""),
    "model_roundtrip": CLUSTER_ORACLES["assign_nearest"],
    "index_roundtrip": """SELECT label AS cell, count(*) AS n, (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM embeddings) AS vectors,
        (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AS consistent FROM embeddings GROUP BY label""",
    "cached_reduction": f"SELECT doc_id, len({B.words_sql('text')})::INT AS words FROM documents",
}
