"""Document vectors: a hashed TF-IDF encoder in SQL, a hook for a user's encoder, PCA, guided seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions import vectors as V
from topicloom.operators.similarity import nearest, stored_centroids
from topicloom.operators.terms import document_terms
from topicloom.plans.execution import lookup_join, materialise

ENCODER_TERMS = 4_000_000  # 20 bytes each
TOKENS_AT_ONCE = 1 << 20  # tokens of a batch that are counted together
DIGITS = 7  # entries are rounded so that equal texts have equal vectors


def _hash_slot(term: Column, seed: int, dim: int) -> tuple[Column, Column]:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), term))
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    return slot, sign


def fit_encoder(docs: DataFrame, dim: int = 64, seed: int = 42, stop_words: list[str] = (),
                counts: DataFrame | None = None) -> DataFrame:
    """(term, idf, slot, sign, hot): the encoder's vocabulary.  Smooth idf over the given documents."""
    if counts is None:
        terms = F.array_distinct(T.without(T.word_tokens(F.col("text")), list(stop_words), 1))  # only the documents of a term are counted
        counts = docs.select(F.explode(terms).alias("term"))
    total = docs.count()
    slot, sign = _hash_slot(F.col("term"), seed, dim)
    return (
        counts.groupBy("term").agg(F.count("*").alias("df"))
        .select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"), slot.alias("slot"), sign.alias("sign"),
                (F.col("df") > 0.01 * total).alias("hot"))
    )


def encode(docs: DataFrame, vocabulary: DataFrame, dim: int = 64, stop_words: list[str] = (), stored: bool = False,
           counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, embedding): unit vectors; a text without known words has a zero vector."""
    if counts is None:
        counts = document_terms(docs, stop_words=list(stop_words), min_chars=1)
    weighted = lookup_join(counts, vocabulary, ["term"], stored=stored, hot=F.col("hot"))
    slots = weighted.repartition("doc_id").groupBy("doc_id", "slot").agg(F.sum(F.col("n") * F.col("idf") * F.col("sign")).alias("x"))
    rows = slots.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("norm")), F.lit(0.0))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.round(value(i), DIGITS).cast("float"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    encoded = rows.select("doc_id", dense.alias("embedding"))
    return docs.select("doc_id").join(encoded, "doc_id", "left").select("doc_id", F.coalesce("embedding", zero).alias("embedding"))


def encode_in_rows(docs: DataFrame, vocabulary: DataFrame, dim: int, tokens_at_once: int = TOKENS_AT_ONCE) -> DataFrame:
    """As ``encode``, one projection without an exchange: the vocabulary goes to the tasks as sorted (hash, weight, slot)."""
    spark = docs.sparkSession
    packed = vocabulary.select(F.xxhash64("term").alias("h"), (F.col("idf") * F.col("sign")).alias("w"), "slot").orderBy("h").toArrow()
    hashes, weights, slots = (packed.column(i).to_numpy() for i in range(3))
    shared = spark.sparkContext.broadcast((hashes, weights, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, slot = shared.value
        for batch in batches:
            rows, total = batch.num_rows, np.zeros((batch.num_rows, dim))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            flat, start = batch.column(1).flatten().to_numpy(), 0
            while start < rows and len(known):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + tokens_at_once, "right")) - 1)
                owner = np.repeat(np.arange(stop - start), np.diff(ends[start:stop + 1]))
                token = flat[ends[start]:ends[stop]]
                order = np.lexsort((token, owner))
                owner, token = owner[order], token[order]
                first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])]) if len(token) else np.zeros(0, int)
                n, owner, token = np.diff(np.append(first, len(token))), owner[first], token[first]
                at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                hit = known[at] == token
                value = np.bincount(owner[hit] * dim + slot[at[hit]], n[hit] * weight[at[hit]], (stop - start) * dim)
                total[start:stop] = value.reshape(stop - start, dim)
                start = stop
            length = np.sqrt((total * total).sum(axis=1, keepdims=True))
            unit = np.round(np.divide(total, length, out=np.zeros_like(total), where=length > 0), DIGITS).astype("float32")
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * dim + 1, dim), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["doc_id", "embedding"])

    hashed = docs.select("doc_id", F.transform(T.word_tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.mapInArrow(run, "doc_id bigint, embedding array<float>")


def encode_known(docs: DataFrame, vocabulary: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, embedding) by a stored vocabulary.

    Up to ``ENCODER_TERMS`` terms (counted; 80 MB) it travels to the tasks and nothing is exchanged; a larger one is joined by term.  Both give the same vectors.
    """
    if vocabulary.count() <= ENCODER_TERMS:
        return encode_in_rows(docs, vocabulary, dim)
    return encode(docs, vocabulary, dim, stored=True)


def embed(docs: DataFrame, dim: int = 64, seed: int = 42) -> DataFrame:
    """(doc_id, embedding) of all documents by an encoder fitted to them; only the document frequencies are exchanged."""
    return encode_known(docs, materialise(fit_encoder(docs, dim, seed), "vocabulary"), dim)


def embed_with_model(docs: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> DataFrame:
    """(doc_id, embedding) from a user's encoder: loaded once per task, fed Arrow batches, empty text is a zero vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            texts = batch["text"].fillna("").astype(str)
            full = np.zeros((len(batch), dim), dtype="float32")
            filled = texts.str.strip() != ""
            if filled.any():
                vectors = np.asarray(model(texts[filled].tolist()), dtype="float64")
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                full[filled.to_numpy()] = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "embedding": list(full)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, embedding array<float>")


def reduce_dims(vectors: DataFrame, k: int = 5, min_rows: int = 10) -> DataFrame | None:
    """Add ``reduced``: the first k principal components, signs fixed; zero rows stay zero.

    None when fewer than ``min_rows`` rows have a vector.
    """
    usable = vectors.where(V.nonzero(F.col("embedding")))
    if usable.limit(min_rows).count() < min_rows:
        return None
    as_vector = array_to_vector(F.col("embedding").cast("array<double>"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(usable.select(as_vector.alias("_v")))
    loadings = model.pc.toArray()
    signs = [float(np.sign(column[np.abs(column).argmax()]) or 1.0) for column in loadings.T]
    projected = model.transform(vectors.withColumn("_v", as_vector))
    fixed = F.zip_with(vector_to_array("_p"), F.array(*map(F.lit, signs)), lambda x, s: x * s)
    return projected.withColumn("reduced", fixed).drop("_v", "_p")


def guide_with_seeds(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, embedding, seed_id): a document nearest to a seed moves half-way to it.

    ``seeds`` is (seed_id, embedding).  The corpus mean competes with the seeds; a
    document nearest to the mean stays as it is (seed_id -1).
    """
    mean = vectors.select(F.lit(-1).alias("key"), "embedding")
    center = stored_centroids(mean, "key").select(F.lit(-1).cast("bigint").alias("seed_id"), F.col("centroid").alias("center"))
    table = materialise(seeds.select(F.col("seed_id").cast("bigint").alias("seed_id"), F.col("embedding").cast("array<double>").alias("center"))
                        .unionByName(center), "seeds")
    tagged = nearest(vectors.select("doc_id", "embedding"), "embedding", table, "seed_id", "center", "cosine", "seed_id")
    joined = lookup_join(tagged, table.where("seed_id >= 0"), ["seed_id"], "left")
    moved = F.when(F.col("center").isNotNull(), V.mean_of_two(F.col("embedding"), F.col("center"))).otherwise(F.col("embedding"))
    return joined.select("doc_id", moved.alias("embedding"), "seed_id")
