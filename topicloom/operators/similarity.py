"""Arrow kernels: every row of a large table against blocks of vectors of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.plans.execution import BLOCK_ROWS, materialise

SCORE_DIGITS = 10  # scores are rounded before they are compared, so equal vectors tie


def stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, 0))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def scores(rows: np.ndarray, block: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of every row to every block vector; larger is nearer for all metrics."""
    if metric == "cosine":
        value = unit_rows(rows) @ unit_rows(block).T
    elif metric == "dot":
        value = rows @ block.T
    else:  # squared L2, negated
        value = 2 * rows @ block.T - (rows**2).sum(1)[:, None] - (block**2).sum(1)[None, :]
        value = np.minimum(value, 0.0)
    return np.round(value, SCORE_DIGITS)


def vector_blocks(table: DataFrame, id_col: str, vec_col: str, size: int = BLOCK_ROWS) -> Iterator[tuple]:
    """(ids, matrix) blocks of at most ``size`` rows, in id order, of a lookup table such as centroids."""
    ids, vectors = [], []
    for row in table.select(id_col, vec_col).orderBy(id_col).toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == size:
            yield np.array(ids), np.array(vectors, dtype="float64")
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors, dtype="float64")


def _pick_kernel(ids: np.ndarray, matrix: np.ndarray, metric: str):
    @F.pandas_udf("struct<score: double, id: bigint>")
    def pick(column: pd.Series) -> pd.DataFrame:
        if len(column) == 0:
            return pd.DataFrame({"score": [], "id": []})
        value = scores(stack(column), matrix, metric)
        at = value.argmax(axis=1)
        return pd.DataFrame({"score": value[np.arange(len(value)), at], "id": ids[at].astype("int64")})

    return pick


def _pairs_kernel(ids: np.ndarray, matrix: np.ndarray, metric: str):
    @F.pandas_udf("array<double>")
    def pairs(column: pd.Series) -> pd.Series:
        if len(column) == 0:
            return pd.Series([], dtype=object)
        value = scores(stack(column), matrix, metric)
        return pd.Series(list(value))

    return pairs


def nearest(df: DataFrame, vec_col: str, table: DataFrame, id_col: str, table_vec: str,
            metric: str = "cosine", out: str = "nearest", score: str = "score") -> DataFrame:
    """Add the id of the best vector of ``table`` (ties: smallest id) and its score.

    A stateless projection over Arrow batches: no shuffle of ``df``.  A table of
    more than one block adds one projection per block and keeps the best.
    """
    best = [_pick_kernel(ids, matrix, metric)(F.col(vec_col))
            for ids, matrix in vector_blocks(table, id_col, table_vec)]
    if not best:
        return df.withColumn(out, F.lit(None).cast("bigint")).withColumn(score, F.lit(None).cast("double"))
    names = [f"_b{i}" for i in range(len(best))]
    for name, column in zip(names, best):
        df = df.withColumn(name, column)
    ranked = [F.struct(F.col(f"{n}.score").alias("s"), (-F.col(f"{n}.id")).alias("i")) for n in names]
    top = ranked[0] if len(ranked) == 1 else F.greatest(*ranked)
    df = df.withColumn("_top", top)
    return df.withColumn(out, -F.col("_top.i")).withColumn(score, F.col("_top.s")).drop("_top", *names)


def score_pairs(df: DataFrame, vec_col: str, table: DataFrame, id_col: str, table_vec: str,
                metric: str = "cosine", other: str = "other", score: str = "score") -> DataFrame:
    """Every row of ``df`` with its score against every vector of a topic-sized ``table``."""
    parts = [
        df.withColumn("_scores", _pairs_kernel(ids, matrix, metric)(F.col(vec_col)))
        .withColumn("_p", F.explode(F.arrays_zip(F.array(*[F.lit(int(i)).cast("bigint") for i in ids]).alias("other"), F.col("_scores").alias("score"))))
        .withColumn(other, F.col("_p.other")).withColumn(score, F.col("_p.score")).drop("_p", "_scores")
        for ids, matrix in vector_blocks(table, id_col, table_vec)
    ]
    if not parts:
        return df.withColumn(other, F.lit(None).cast("bigint")).withColumn(score, F.lit(None).cast("double")).limit(0)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def centroids(vectors: DataFrame, key: str = "topic", vec_col: str = "embedding") -> DataFrame:
    """(key, centroid, n): mean vector per key, combined before the shuffle."""
    return (
        vectors.groupBy(key)
        .agg(Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>"))).alias("_m"), F.count("*").alias("n"))
        .select(key, vector_to_array("_m").alias("centroid"), "n")
    )


def stored_centroids(vectors: DataFrame, key: str = "topic", vec_col: str = "embedding") -> DataFrame:
    return materialise(centroids(vectors, key, vec_col), "centroids")
