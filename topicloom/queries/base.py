"""Tables and common table expressions the queries share.

``label`` of an embedding is the topic of its document; a document without a
vector is an outlier (-1).  ``doc_id`` order stands for row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.constants import COMMON_WORDS, ENGLISH_STOP_WORDS, MASK_NAMES, NON_WORD, WHITESPACE
from topicloom.plans.execution import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    """Documents for text-heavy work, one partition per core when the file is small."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("topic"))


def assignment(spark, sf) -> DataFrame:
    """(doc_id, topic) for every document."""
    ids = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    return ids.join(labels, "doc_id", "left").select("doc_id", F.coalesce("topic", F.lit(-1)).alias("topic"))


def topic_documents(spark, sf) -> DataFrame:
    """(doc_id, text, topic)."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    return documents(spark, sf).join(labels, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))


def sentiment(spark, sf) -> DataFrame:
    """(doc_id, sentiment) of the rated documents: toxic is negative, good quality is positive."""
    return table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("sentiment"),
    )


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


WS = WHITESPACE
ASSIGN = """assign AS (
  SELECT d.doc_id, coalesce(e.label, -1) AS topic
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""
SENT = """sent AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
  FROM labels)"""
# documents with topic
TDOCS = """tdocs AS (
  SELECT d.doc_id, d.text, coalesce(e.label, -1) AS topic
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def squeeze_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}', ' ', 'g'))"


def words_sql(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '{NON_WORD}'), lambda w: w <> '')"


def spaces_sql(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '{WS}'), lambda w: w <> '')"


def clean_sql(expr: str, min_length: int = 10) -> list[str]:
    """Common table expressions that end in ``cleaned(doc_id, text)``; ``expr`` reads from documents."""
    masks = "|".join(MASK_NAMES)
    return [
        f"c1 AS (SELECT doc_id, {squeeze_sql(expr)} AS t FROM documents)",
        f"""c2 AS (SELECT doc_id, t, CASE WHEN starts_with(t, '[') OR starts_with(t, '{{')
             THEN {squeeze_sql("regexp_replace(t, '[\\[\\]{}\"'']', ' ', 'g')")} ELSE t END AS u FROM c1)""",
        f"""c3 AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(u,
             '<\\{{?entity_type\\}}?>', ' ', 'gi'), '<[^>]+>', ' ', 'g'), '\\[({masks}|pii)\\]', ' ', 'gi') AS m FROM c2)""",
        "c4 AS (SELECT doc_id, t, regexp_replace(replace(m, chr(0), ''), '[\\r\\t]', ' ', 'g') AS p FROM c3)",
        "c6 AS (SELECT doc_id, t, trim(p) AS f FROM c4)",
        f"cleaned AS (SELECT doc_id, f AS text FROM c6 WHERE length(t) >= {min_length} AND length(f) >= {min_length})",
    ]


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


STOP_SQL = sql_list(ENGLISH_STOP_WORDS)
COMMON_SQL = sql_list(COMMON_WORDS)
