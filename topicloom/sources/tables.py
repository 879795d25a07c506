"""Readers and writers: CSV in; rows, topics, reports, sessions, models and indexes out."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.operators.analytics import balance, is_outlier, topic_summary
from topicloom.plans.execution import top_k


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a CSV file with quoted fields and line breaks inside quotes; malformed rows are skipped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def text_columns(df: DataFrame) -> DataFrame:
    """(column, filled, mean_length) of the string columns: one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, filled bigint, mean_length double")
    counted = df.agg(*[a for n in names for a in (F.count(n).alias(f"{n}_n"), F.avg(F.length(n)).alias(f"{n}_l"))])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"{n}_n").alias("filled"), F.round(f"{n}_l", 4).alias("mean_length")) for n in names])
    return counted.select(F.inline(rows))


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def topic_info_columns(info: DataFrame) -> DataFrame:
    """The exported columns; the analysis only when some topic has one."""
    has_analysis = "analysis" in info.columns and not info.where(F.trim("analysis") != "").isEmpty()
    return info.select("topic", "human_label", *(["analysis"] if has_analysis else []), "keywords", "count")


def write_topic_info(info: DataFrame, path: str, fmt: str = "csv") -> None:
    write_results(topic_info_columns(info), path, fmt)


FILE_BYTES = 128 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: the length of texts and binaries, eight for each number, arrays by their entries."""
    def of(field) -> Column:
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(name), F.lit(0))
        if isinstance(field.dataType, T.ArrayType):
            return 8 * F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
        return F.lit(8)

    return sum((of(f) for f in df.schema.fields), F.lit(0)).cast("bigint")


def clustered(df: DataFrame, key: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows in ranges of (key, hash) of about ``file_bytes`` each: a small key is written by one task or two, a hot one by as many as its bytes need."""
    total = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return df.repartitionByRange(max(1, -(-total // file_bytes)), F.col(key), F.xxhash64(*df.columns))


def write_by_topic(df: DataFrame, path: str, fmt: str = "parquet", max_records: int = 5_000_000, file_bytes: int = FILE_BYTES) -> None:
    """One folder per topic, with as many files as the topic's bytes need."""
    clustered(df, "topic", file_bytes).write.mode("overwrite").partitionBy("topic").option("maxRecordsPerFile", max_records).format(fmt).save(path)


def run_report(assignment: DataFrame, min_size: int = 10, method: str = "kmeans") -> DataFrame:
    """One row: size, topics, outliers, coverage, parameters, balance."""
    return topic_summary(assignment).select("documents", "topics", "outliers", "coverage").crossJoin(  # one row each
        balance(assignment).select(
            F.lit(min_size).alias("min_topic_size"), F.lit(method).alias("method"),
            F.when(F.col("balanced"), "Balanced").otherwise("Needs Attention").alias("balance_status"),
            F.col("oversized").alias("oversized_topics")))


def topic_reports(info: DataFrame, summaries: DataFrame) -> DataFrame:
    """(topic, report): a text per topic that has a summary."""
    text = F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "), F.col("human_label"), F.lit("\nKeywords: "), F.col("keywords"),
                    F.lit("\nDocuments: "), F.col("count").cast("string"), F.lit("\n\n"), F.col("summary"))
    return info.join(summaries.select("topic", "summary"), "topic").select("topic", text.alias("report"))


def report_data(rows: DataFrame, shown: int = 20) -> DataFrame:
    """(topic_label, count, percentage, documents): the first documents of each label with their sentiment; no outliers.

    ``rows`` is (doc_id, topic_label, text, sentiment).
    """
    counts = rows.groupBy("topic_label").agg(F.count("*").alias("count"))
    total = rows.count()
    shares = counts.where(~F.col("topic_label").contains("Outlier")).withColumn("percentage", F.round(100.0 * F.col("count") / total, 1))
    first = top_k(rows.where(~F.col("topic_label").contains("Outlier")).select("topic_label", "doc_id", "text", "sentiment"),
                  ["topic_label"], [F.col("doc_id")], shown)
    line = F.concat(F.when(F.col("sentiment").isNotNull(), F.concat(F.lit("["), F.upper("sentiment"), F.lit("] "))).otherwise(""), F.col("text"))
    listed = first.select("topic_label", "rank", line.alias("line")).groupBy("topic_label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]).alias("documents"))
    return shares.join(listed, "topic_label")


# --- sessions, models, indexes ----------------------------------------------------------------

SESSION_DEFAULTS = {"min_topic_size": 10, "clustering_method": "HDBSCAN", "model_name": "hashed-tfidf", "source_name": "imported_session"}


def save_session(path: str, tables: dict[str, DataFrame], parameters: dict) -> None:
    """A folder with one Parquet table per part and one JSON row of parameters."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    row = json.dumps({"tables": sorted(tables), "parameters": parameters})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_session(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, parameters) with defaults for missing parameters."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    return tables, {**SESSION_DEFAULTS, **meta["parameters"]}


def save_model(path: str, centers: DataFrame, weights: DataFrame, info: DataFrame, parameters: dict) -> None:
    """A fitted topic model: centroids, class-TF-IDF weights and the topic table."""
    save_session(path, {"centers": centers, "weights": weights, "topic_info": info}, parameters)


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    return load_session(spark, path)


def save_index(index: DataFrame, centers: DataFrame, path: str) -> None:
    """Items by cell, so that a search reads the probed cells only."""
    clustered(index, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    centers.write.mode("overwrite").parquet(f"{path}/centers")


def index_state(index: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(indexed, vectors, chunks, consistent): an index is rebuilt when the three counts differ."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(index, "indexed").crossJoin(one(vectors, "vectors")).crossJoin(one(chunks, "chunks"))  # one row each
    return counts.withColumn("consistent", (F.col("indexed") == F.col("vectors")) & (F.col("vectors") == F.col("chunks")))


def load_index(spark: SparkSession, path: str, vectors: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(items, centers), or None when the index does not fit the data."""
    items = spark.read.parquet(f"{path}/items")
    if not index_state(items, vectors, chunks).first()["consistent"]:
        return None
    return items, spark.read.parquet(f"{path}/centers")


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, code): a code over all rows that does not depend on their order."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0).cast("bigint")).alias("code"),
                  F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("total"))


def cached(df: DataFrame, parameters: dict, folder: str, compute) -> DataFrame:
    """``compute(df)`` stored under a name made of the parameters and the data's fingerprint; reused when it is there."""
    spark = df.sparkSession
    row = fingerprint(df).first()
    key = hashlib.md5(json.dumps([parameters, row["rows"], row["code"], row["total"]], sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{key}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        compute(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
