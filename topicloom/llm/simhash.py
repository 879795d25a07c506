"""SimHash near-duplicates with pivot distance tables (operator 6).

A text's fingerprint has a bit for every bit that is set in over half the hashes of its word shingles.  Equal fingerprints are one node, so copies
cost nothing.  For each distinct fingerprint its Hamming distances to a set of reference fingerprints, the pivots, are computed once and travel
with it.  Two fingerprints within d bits differ by at most d in every such distance (triangle inequality), so a pair whose largest coordinate
difference exceeds d is dropped, and the survivors are verified bit by bit.

Pairs meet by equality: of d + 3 blocks of bits, d differing bits leave three blocks untouched, so a pair within d bits agrees on one of the choices of three
blocks.  That is exact, and a bucket holds only distinct fingerprints that share half their bits.  Classes come from connected components.

Defined cases: null and word-less texts have fingerprint 0, linked like any other; texts shorter than a shingle have one shingle, all their words; repeated
rows are members of their class; null ids belong to their class, whose id is the smallest id that is not null; an empty table has no classes; other columns are kept by
``drop_near_duplicates`` and ignored by ``classes``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import arrow_rows, materialise
from topicloom.llm.graph import connected_components

BITS = 64
SEED = 42
STEP = 1 << 15        # shingles whose bits are counted at once
PIVOTS = 16


def fingerprint(text: str | None, shingle_words: int) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle_words]) for i in range(max(1, len(words) - shingle_words + 1))]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), STEP):
        part = shingles[i:i + STEP]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.dtype("<u8"), len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): one row per document; ``fp`` is the fingerprint as a signed long."""
    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(2)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col), F.col(text_col).cast("string").alias("text"))
    return arrow_rows(chosen, rows_of, "doc_id long, text_hash long, fp long")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash")


def pivot_table(prints: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds the distances of ``fp`` to the pivots, eight to a column."""
    rng = np.random.default_rng(SEED)
    points = rng.integers(-(1 << 63), 1 << 63, pivots, dtype=np.int64, endpoint=False)
    for c in range(0, pivots, 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(points[c:c + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))).cast("long"), 8 * i))
        prints = prints.withColumn(f"pv{c // 8}", packed)
    return prints


def _largest_difference(pivots: int) -> Column:
    differences = []
    for i in range(pivots):
        a, b = (F.shiftrightunsigned(F.col(f"{s}.pv{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255)) for s in "xy")
        differences.append(F.abs(a - b))
    return F.greatest(*differences)


def block_masks(max_bits: int) -> list[int]:
    """Masks of every choice of three of max_bits + 3 blocks."""
    n = max_bits + 3
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    masks = [a | b | c for a, b, c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def similar_prints(prints: DataFrame, max_bits: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column ``fp``) within ``max_bits`` bits, each once or more."""
    masks = F.array(*[F.lit(m) for m in block_masks(max_bits)])
    table = pivot_table(prints.select("fp"), pivots)
    keyed = table.select("*", F.posexplode(masks).alias("choice", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
    x, y = keyed.alias("x"), keyed.alias("y")
    near = (
        (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
        & (_largest_difference(pivots) <= max_bits)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits)
    )
    return x.join(y, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _classes(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root): the class of every distinct fingerprint."""
    distinct = materialise(rows.groupBy("fp").agg(F.min(_rank()).alias("least")), "prints")
    linked = connected_components(similar_prints(distinct, max_bits)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    return materialise(rooted, "rooted")


def _rank() -> Column:
    """Order in which a class picks its representative: ids first, then a null id, then the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "fp")


def classes(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document, the class named by its smallest id."""
    rows = materialise(fingerprints(docs, shingle_words, id_col, text_col).select("doc_id", "text_hash", "fp"), "rows")
    rooted = _classes(rows, max_bits)
    names = rooted.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    named = materialise(rooted.join(names, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns: the one with the smallest id.  Texts are shuffled once, in the semi-join."""
    rows = materialise(fingerprints(docs, shingle_words, id_col, text_col), "rows")
    kept = _classes(rows, max_bits).groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.doc_id").alias("_keep_id"), F.col("least.text_hash").alias("_keep_hash"))
    kept = materialise(kept, "kept")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), _text_hash(text_col).alias("_hash"))
    chosen = packed.join(kept, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_hash") == F.col("_keep_hash")), "left_semi")
    repeated = rows.groupBy("doc_id", "text_hash").count().where("count > 1").join(
        kept, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("text_hash") == F.col("_keep_hash")), "left_semi")
    if not repeated.isEmpty():  # rows that agree in id and text
        chosen = chosen.dropDuplicates(["_id", "_hash"])
    return chosen.select("_row.*")
