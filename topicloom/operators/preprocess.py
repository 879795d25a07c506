"""Documents in, usable documents, tokens and chunks out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.constants import COMMON_WORDS, WHITESPACE
from topicloom.functions import text as T
from topicloom.functions.vectors import nonzero
from topicloom.plans.execution import spread_parts, top_k


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text of a column; a list of strings is joined by spaces first."""
    if df.schema[name].dataType.typeName() == "array":
        return F.array_join(F.col(name), " ")
    return F.col(name).cast("string")


def clean_documents(df: DataFrame, max_length: int | None = None, min_length: int = 10) -> DataFrame:
    """(doc_id, text): the survivors of cleaning."""
    cleaned = T.clean_text(text_column(df), max_length, min_length)
    # explode instead of a filter: a filter would be pushed down and clean every text twice
    return df.select("doc_id", F.explode(F.filter(F.array(cleaned), lambda t: t.isNotNull())).alias("text"))


def preprocess_stats(df: DataFrame, max_length: int | None = None, min_length: int = 10) -> DataFrame:
    """One row of counts: what cleaning kept, dropped and cut."""
    raw = text_column(df)
    converted = df.schema["text"].dataType.typeName() not in ("string", "array")
    checked = df.select(
        raw.alias("raw"),
        T.clean_text(raw, max_length, min_length).isNotNull().alias("valid"),
        F.coalesce(T.squeeze(raw) == "", F.lit(True)).alias("empty"),
    )
    stripped = F.length(F.regexp_replace(F.col("raw"), f"^{WHITESPACE}|{WHITESPACE}$", ""))
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid") & F.col("empty")).alias("empty_removed"),
        F.count_if(~F.col("valid") & ~F.col("empty") & (stripped < min_length)).alias("too_short"),
        (F.lit(0).cast("bigint") if max_length is None else F.count_if(F.col("valid") & (F.length("raw") > max_length))).alias(
            "too_long_truncated"),
        (F.count_if("valid") if converted else F.lit(0).cast("bigint")).alias("type_converted"),
    )


def filter_documents(df: DataFrame, min_rows: int | None = None) -> DataFrame:
    """Non-null texts of more than ten characters, stripped; an error when fewer than ``min_rows`` remain."""
    stripped = F.regexp_replace(F.col("text"), f"^{WHITESPACE}|{WHITESPACE}$", "")
    kept = df.select("doc_id", stripped.alias("text")).where(F.length("text") > 10)
    if min_rows is not None and kept.limit(min_rows).count() < min_rows:
        raise ValueError(f"need at least {min_rows} usable documents")
    return kept


def clean_for_prompt(df: DataFrame, per_topic: int | None = None) -> DataFrame:
    """(topic, doc_id, text): the documents of each topic, or its first ``per_topic``, cleaned, longer than 20 characters."""
    first = df if per_topic is None else top_k(df, ["topic"], [F.col("doc_id")], per_topic).drop("rank")
    return (
        first.select("topic", "doc_id", T.clean_for_prompt(F.col("text")).alias("text"))
        .where(F.length("text") > 20)
    )


def tokenize(df: DataFrame, mode: str = "words") -> DataFrame:
    """(doc_id, pos, token); ``mode`` is ``words`` or ``whitespace``."""
    split = T.word_tokens if mode == "words" else T.whitespace_tokens
    return df.select("doc_id", F.posexplode(split(F.col("text"))).alias("pos", "token"))


def token_shapes(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, last_pos, last_token, least_token) of (doc_id, pos, token).

    Strings in an aggregate make Spark sort all tokens by document.  The tokens of a document come one after the other, so every batch sums up its
    runs of equal ids first and only these few rows are grouped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, pos, token = batch.column(0), batch.column(1).to_numpy(), batch.column(2).dictionary_encode()
            known, number = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            start = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (known[1:] != known[:-1])])
            n = np.diff(np.append(start, len(pos)))
            last = np.lexsort((pos, np.repeat(np.arange(len(start)), n)))[start + n - 1]
            order = pc.sort_indices(token.dictionary).to_numpy()
            place = np.empty(len(order), int)
            place[order] = np.arange(len(order))
            least = order[np.minimum.reduceat(place[token.indices.to_numpy()], start)]
            words = token.dictionary
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(start)), pa.array(n), pa.array(pos[last]), words.take(token.indices.take(pa.array(last))), words.take(pa.array(least))],
                names=["doc_id", "n_tokens", "last_pos", "last_token", "least_token"])

    parts = tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "token").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, last_pos int, last_token string, least_token string")
    return parts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("last_pos").alias("last_pos"),
                                       F.max_by("last_token", "last_pos").alias("last_token"), F.min("least_token").alias("least_token"))


def remove_stopwords(tokens: DataFrame, extra: DataFrame | None = None, min_chars: int = 3) -> DataFrame:
    """Drop common words, short words and the user's own words (a table with column ``token``)."""
    kept = tokens.where((F.length("token") >= min_chars) & ~F.col("token").isin(COMMON_WORDS))
    return kept if extra is None else kept.join(extra.select("token").distinct(), "token", "left_anti")


GRAM_TOKENS = 1 << 20  # tokens of a chunk whose n-grams are counted together


def _packed_terms(terms: pa.Array, n: np.ndarray) -> bytes:
    """Sorted terms and their counts, compressed; terms that stand together share their beginnings."""
    terms = pa.concat_arrays([terms])
    offsets = np.frombuffer(terms.buffers()[1], np.int32, len(terms) + 1, 4 * terms.offset)
    planes = [np.asarray(x, kind).view(np.uint8).reshape(len(terms), -1).T.tobytes() for x, kind in ((np.diff(offsets), "<u4"), (n, "<u8"))]
    texts = terms.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if offsets[-1] > offsets[0] else b""
    return pa.compress(b"".join([*planes, texts]), codec="zstd", asbytes=True)


def _unpacked_terms(data: bytes, rows: int, size: int) -> tuple[pa.Array, np.ndarray]:
    """Terms and counts of ``rows`` terms in ``size`` bytes."""
    raw = np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)
    lengths = np.ascontiguousarray(raw[:4 * rows].reshape(4, rows).T).view("<u4").ravel()
    n = np.ascontiguousarray(raw[4 * rows:12 * rows].reshape(8, rows).T).view("<u8").ravel()
    offsets = np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(raw[12 * rows:].tobytes())), n.astype(np.int64)


def _windows(tokens: pa.ListArray, high: int) -> tuple[pa.Array, np.ndarray]:
    """(sorted words, windows): for each token of the rows its number and those of the next ``high`` - 1 tokens of its row, from 1; 0 is none."""
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.string())
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    columns = np.zeros((len(codes), high), np.int64)
    for k in range(min(high, len(codes))):
        columns[:len(codes) - k, k] = np.where(row[:len(codes) - k] == row[k:], codes[k:], 0)
    return words.take(pa.array(order)), columns


def _joined(words: pa.Array, windows: np.ndarray) -> pa.Array:
    """The words of each window, with a space between."""
    sizes = (windows > 0).sum(axis=1)
    flat = words.take(pa.array(windows[windows > 0] - 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), flat), " ")


def ngram_counts(df: DataFrame, low: int = 1, high: int = 3, stop_words: list[str] | None = None,
                 min_chars: int = 1, chunk_tokens: int = GRAM_TOKENS) -> DataFrame:
    """(term, n): n-gram counts over all documents; stop words go before n-grams are formed."""
    tokens = T.without(T.word_tokens(F.col("text")), stop_words or [], min_chars)
    return gram_counts(df.select(tokens.alias("tokens")), spread_parts(df), low, high, chunk_tokens)


def gram_counts(rows: DataFrame, buckets: int, low: int = 1, high: int = 1, chunk_tokens: int = GRAM_TOKENS) -> DataFrame:
    """(term, n): n-gram counts of rows of ``tokens``, which hold no space if there are n-grams of several.

    What is shuffled are the different longest n-grams of a chunk of documents, sorted and compressed, and its single words; the shorter n-grams are their beginnings and are counted where
    these meet.  All n-grams that begin with the same two words meet in one bucket; a task holds one chunk or one bucket.
    """
    first = max(low, min(2, high))  # n-grams with the same ``first`` words meet; shorter ones are counted on their own

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        words, columns = _windows(pa.concat_arrays([b.column(0) for b in held]), high)
        hashes = np.r_[0, np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))].astype(np.uint64)
        rows = [[], [], [], []]
        for part in [columns[columns[:, first - 1] > 0], *(np.where(np.arange(high) < k, columns, 0)[columns[:, k - 1] > 0] for k in range(low, first))]:
            if not len(part):
                continue
            key = part[:, 0]
            for k in range(1, high):  # numbers of the different windows, in the order of their words
                key = np.unique(key, return_inverse=True)[1] * (len(words) + 1) + part[:, k]
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            part, hashed = part[at], np.zeros(len(at), np.uint64)
            for k in range(first):
                hashed = (hashed * np.uint64(0x9E3779B97F4A7C15) + hashes[part[:, k]]) * np.uint64(0xBF58476D1CE4E5B9)
                hashed ^= hashed >> np.uint64(31)
            bucket = (hashed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, n, terms = bucket[order], n[order], _joined(words, part[order])
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            sizes = pc.binary_length(terms).to_numpy().astype(np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                for row, value in zip(rows, (bucket[a], b - a, 12 * (b - a) + sizes[a:b].sum(), _packed_terms(terms.slice(a, b - a), n[a:b]))):
                    row.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "rows", "size", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                held.append(batch)
                n += len(batch.column(0).flatten())
                if n >= chunk_tokens:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def summed(held: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = pa.table([pa.concat_arrays([t for t, _ in held]), pa.array(np.concatenate([n for _, n in held]))], names=["term", "n"])
        table = table.group_by("term").aggregate([("n", "sum")]).select(["term", "n_sum"]).rename_columns(["term", "n"]).combine_chunks()
        sizes = pc.add(pc.count_substring(table["term"], " "), 1).to_numpy() if high > 1 else np.ones(len(table), np.int32)
        for k in range(low, high + 1):
            if k < first or k == high:
                found = table.filter(pa.array(sizes == k))
            else:
                longer = table.filter(pa.array(sizes >= k))
                begins = pc.binary_join(pc.list_slice(pc.split_pattern(longer["term"].combine_chunks(), " "), 0, k), " ")
                found = pa.table([begins, longer["n"]], names=["term", "n"]).group_by("term").aggregate([("n", "sum")]).select(["term", "n_sum"]).rename_columns(["term", "n"])
            yield from found.to_batches(max_chunksize=1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for bucket, rows, size, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != of and held:
                    yield from summed(held)
                    held = []
                of = bucket
                held.append(_unpacked_terms(data, rows, size))
        if held:
            yield from summed(held)

    shuffled = rows.select("tokens").mapInArrow(pack, "bucket int, rows int, size long, data binary").repartition(buckets, "bucket")
    return shuffled.sortWithinPartitions("bucket").mapInArrow(count, "term string, n long")


def chunk_documents(df: DataFrame, size: int = 512, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk_no, text, start_pos, end_pos).

    A document of up to ``size`` tokens is one chunk with character offsets; a
    longer one is cut every ``size - overlap`` tokens and carries token offsets.
    """
    tokens = F.filter(F.split(F.col("text"), WHITESPACE), lambda w: w != "")
    sized = df.select("doc_id", "text", tokens.alias("tokens"))
    n = F.size("tokens")
    long = n > size
    starts = F.when(long, F.sequence(F.lit(0), n - overlap - 1, F.lit(size - overlap))).when(
        n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    chunks = sized.select("doc_id", "text", "tokens", F.posexplode(starts).alias("chunk_no", "start"))
    end = F.least(F.col("start") + size, n)
    return chunks.select(
        "doc_id",
        "chunk_no",
        F.when(long, F.array_join(F.slice("tokens", F.col("start") + 1, F.lit(size)), " "))
        .otherwise(F.col("text")).alias("text"),
        F.when(long, F.col("start")).otherwise(0).alias("start_pos"),
        F.when(long, end).otherwise(F.length("text")).alias("end_pos"),
    )


def parse_seeds(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, seed_id, words): every line of a text is a seed set, its words are separated by commas."""
    lines = df.select(id_column, F.posexplode(F.split("text", "\n")).alias("seed_id", "line"))
    return lines.select(id_column, "seed_id", T.seed_words(F.col("line")).alias("words")).where(F.size("words") > 0)


def validate_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: do vectors and documents pair up, and how many vectors are all zero?"""
    left = documents.select("doc_id", F.lit(True).alias("_d"))
    right = vectors.select("doc_id", F.lit(True).alias("_v"), (~nonzero(F.col("embedding"))).alias("_zero"))
    joined = left.join(right, "doc_id", "full")
    counted = joined.agg(
        F.count("_d").alias("documents"),
        F.count("_v").alias("vectors"),
        F.count_if(F.col("_d").isNotNull() & F.col("_v").isNotNull()).alias("paired"),
        F.count_if("_zero").alias("zero_vectors"),
    )
    aligned = (F.col("documents") == F.col("vectors")) & (F.col("paired") == F.col("documents"))
    status = (
        F.when(~aligned, "misaligned")
        .when(F.col("zero_vectors") > 0.5 * F.col("vectors"), "mostly_zero")
        .otherwise("ok")
    )
    return counted.withColumn("status", status)


def mark_zero_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("is_zero", ~nonzero(F.col("embedding")))


def distinct_queries(df: DataFrame, id_column: str) -> DataFrame:
    """(query_key, first_id, uses): each distinct normalised text once."""
    return (
        df.select(T.query_key(F.col("text")).alias("query_key"), F.col(id_column))
        .groupBy("query_key").agg(F.min(id_column).alias("first_id"), F.count("*").alias("uses"))
    )


def resolve_topic_refs(questions: DataFrame, topic_ids: DataFrame) -> DataFrame:
    """Add ``topic_filter``: the topic a question names, null when there is none or it is unknown."""
    named = questions.withColumn("_named", T.topic_reference(F.col("text")))
    known = topic_ids.select(F.col("topic").alias("_named")).distinct().withColumn("topic_filter", F.col("_named"))
    return named.join(known, "_named", "left").drop("_named")
