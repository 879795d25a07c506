"""One query for each operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.chat import format_chats
from topicloom.llm.common import held_out, id_crc, table
from topicloom.llm.integer_kmeans import Plan, cluster_vectors
from topicloom.llm.language import identify, train_filter
from topicloom.llm.merkle import build_manifest, fold, leaf_digest
from topicloom.llm.nn_descent import near_duplicates
from topicloom.llm.oracles import OP2_SQL, OP7_SQL, OP9_SQL, OP10_SQL, OP11_SQL, OP12_SQL
from topicloom.llm.packing import pack
from topicloom.llm.pieces import encode_documents, load_pieces
from topicloom.llm.pii import find_spans
from topicloom.llm.pitman_yor import score, train
from topicloom.llm.quality import line_quality
from topicloom.llm.sharding import shard_by_bytes
from topicloom.llm.simhash import classes
from topicloom.llm.wavelet import read_documents, write_shards
from topicloom.plans.execution import scratch_path

SHARDS = 40
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PIECES = "byte_bpe_50k.json"


def op1_language_filters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = train_filter(docs.where(~held_out(3, 1)))
    found = identify(docs, model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "n_trigrams")


def op2_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    return line_quality(table(spark, sf, "documents")).drop("clean_text")


def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return find_spans(table(spark, sf, "documents"))


def op4_piece_lattice(spark: SparkSession, sf: str, model_file: str = PIECES) -> DataFrame:
    # up to so many units of a partition are grouped in memory (about 200 MB) instead of being sorted on disk
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
    return encode_documents(table(spark, sf, "documents"), load_pieces(model_file))


def op5_length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), buckets=16, token_budget=16_384)


def op6_simhash_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return classes(table(spark, sf, "documents"), shingle_words=3, max_bits=3)


def op7_byte_shards(spark: SparkSession, sf: str) -> DataFrame:
    shards = shard_by_bytes(table(spark, sf, "documents"), SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = train(docs.where(~held_out(7, 2)))
    return score(docs, model).withColumn("held_out", held_out(7, 2))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool use: a user's turn is a call of ``reply``, the assistant's next turn its result.

    The call carries the prompt, its number of words (prompts under five words carry none) and the call two turns before.
    """
    name = lambda turn: F.concat(F.lit("c"), "conv_id", F.lit("-"), turn)
    words = F.regexp_count("text", F.lit(r"\S+"))
    arguments = F.struct(
        F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("after"), F.col("text").alias("prompt"), F.when(words >= 5, words).alias("words"))
    calls = F.to_json(F.array(F.struct(arguments.alias("arguments"), name(F.col("turn")).alias("id"), F.lit("reply").alias("name"))))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~user, F.col("text")).alias("content"), F.when(user, calls).alias("tool_calls"),
        F.when(assistant, name(F.col("turn") - 1)).alias("tool_call_id"))


def op9_tool_links(spark: SparkSession, sf: str) -> DataFrame:
    tools = spark.createDataFrame([("reply", "prompt", "string", True), ("reply", "words", "integer", True), ("reply", "after", "string", False)],
                                  "tool string, field string, type string, required boolean")
    return format_chats(tool_messages(table(spark, sf, "conversations")), tools)


def op10_nn_descent(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "embeddings")).drop("audit_recall")


def op11_midstate_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose id has an even checksum are folded without the line ends of their text."""
    docs = table(spark, sf, "documents")
    tampered = F.when(id_crc() % 2 == 0, leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return fold(build_manifest(docs, replacement=tampered))


def op12_mean_ordered_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_vectors(table(spark, sf, "embeddings"), Plan(clusters=8, rounds=10, dimensions=64, scale=1024, seed=3))


def op13_wavelet_shards(spark: SparkSession, sf: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path(BYTE_PIECES)
    with open(tokenizer_file, encoding="utf-8") as source:
        tokenizer = source.read()  # a vocabulary of bounded size; it travels with the tasks
    folder = scratch_path(spark, "wavelet")
    return read_documents(write_shards(table(spark, sf, "documents"), folder, tokenizer), folder)


QUERIES = {
    "op1_language_filters": op1_language_filters,
    "op2_line_quality": op2_line_quality,
    "op3_personal_data": op3_personal_data,
    "op4_piece_lattice": op4_piece_lattice,
    "op5_length_buckets": op5_length_buckets,
    "op6_simhash_pivots": op6_simhash_pivots,
    "op7_byte_shards": op7_byte_shards,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_tool_links": op9_tool_links,
    "op10_nn_descent": op10_nn_descent,
    "op11_midstate_manifest": op11_midstate_manifest,
    "op12_mean_ordered_kmeans": op12_mean_ordered_kmeans,
    "op13_wavelet_shards": op13_wavelet_shards,
}
ORACLES = {
    "op2_line_quality": OP2_SQL,
    "op7_byte_shards": OP7_SQL,
    "op9_tool_links": OP9_SQL,
    "op10_nn_descent": OP10_SQL,
    "op11_midstate_manifest": OP11_SQL,
    "op12_mean_ordered_kmeans": OP12_SQL,
}
