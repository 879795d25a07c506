"""Optimal length buckets and token-budget batches (operator 5).

The histogram of document lengths is counted over all documents.  Dynamic programming over it chooses the bucket boundaries with the least padding:
with prefix counts N and prefix token sums W, a bucket of the lengths (i, j] pads len_j (N_j - N_i) - (W_j - W_i) tokens, so the best previous cut is the lowest of
a set of lines and each bucket costs one pass.  Inside a bucket every batch holds as many documents as its token budget allows at the bucket's width.

A document's place in its bucket is the number of bucket members in earlier stored partitions plus its rank inside its own, so a bucket with most of the
documents is ranked in many tasks.  Only ids and lengths are shuffled.

The histogram is bounded: lengths above 2,048 keep eleven significant bits, rounded up, which gives at most 1,024 values for each doubling.

Defined cases: a null or word-less text has length 0; a document longer than the budget is a batch of its own; fewer distinct lengths than buckets give fewer buckets;
repeated rows get places of their own; ids may be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import materialise, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
EXACT_LENGTHS = 2048


def rounded_length(n: Column) -> Column:
    """The length itself up to 2,048, above that the next multiple of a grid of eleven significant bits."""
    grid = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 10, F.lit(0))).cast("long")
    return F.when(n <= EXACT_LENGTHS, n).otherwise(F.ceil(n / grid) * grid).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding; ``histogram`` holds (length, documents, tokens) by length."""
    lengths = [h[0] for h in histogram]
    n, count, tokens = len(histogram), [0], [0]
    for _, documents, total in histogram:
        count.append(count[-1] + documents)
        tokens.append(tokens[-1] + total)
    if not n:
        return []
    best = [None] * (n + 1)
    best[0] = 0
    cuts: list[list[int]] = []
    for _ in range(min(buckets, n)):
        current, chosen = [None] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, cut), lowest at growing lengths from front to back
        front = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, at = -count[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) - front >= 2:
                    (s1, c1, _), (s2, c2, _) = hull[-2], hull[-1]
                    if (c2 - c1) * (s1 - slope) >= (at - c1) * (s1 - s2):
                        hull.pop()
                    else:
                        break
                hull.append((slope, at, j - 1))
            x = lengths[j - 1]
            while len(hull) - front >= 2 and hull[front + 1][0] * x + hull[front + 1][1] <= hull[front][0] * x + hull[front][1]:
                front += 1
            if len(hull) > front:
                slope, at, i = hull[front]
                current[j], chosen[j] = slope * x + at + x * count[j] - tokens[j], i
        cuts.append(chosen)
        best = current
    bounds, j = [], n
    for chosen in reversed(cuts):
        bounds.append(lengths[j - 1])
        j = chosen[j]
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch, slot): batches are numbered from 0 inside each bucket."""
    length = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("n_tokens"), F.spark_partition_id().alias("part"))
    slim = materialise(slim, "lengths")
    rows = slim.groupBy(rounded_length(F.col("n_tokens")).alias("length")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
    histogram = sorted((r.length, r.n, r.tokens) for r in rows.collect())  # bounded by the grid of lengths
    bounds = optimal_boundaries(histogram, buckets)
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    place = F.size(F.filter(edges, lambda b: b < F.col("length")))
    placed = (
        slim.withColumn("length", rounded_length(F.col("n_tokens"))).withColumn("bucket", place)
        .withColumn("padded_to", F.element_at(edges, F.col("bucket") + 1).cast("long"))
    )
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "part").agg(F.count("*").alias("n")).select(
        "bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("padded_to", F.lit(1)))).cast("long")
    ranked = placed.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["bucket", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "n_tokens", "bucket", "padded_to", F.floor(F.col("rank") / capacity).alias("batch"), (F.col("rank") % capacity).alias("slot"))
