"""Balanced contiguous shards from global byte-size prefix sums (operator 7).

Documents are put in one global order, (CRC-32 of the text, id), so equal texts stand together.  A range
partitioning realises the order; the bytes of each partition and a running sum inside it give every
document the number of bytes before it, and the shard is that number's place among equal targets.  Only
sizes, checksums and ids are shuffled, never texts.

A hot text is spread over partitions because the id is part of the order.  Rows that agree in id, checksum and size
are counted before the shuffle and expanded afterwards, so they cannot fill one partition either.

Defined cases: a null text has no bytes (size is the overhead, checksum 0); null ids sort first; repeated rows each get a
slot of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import materialise, text_or_empty

OVERHEAD = 16
COPIES_PER_STEP = 1024


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): contiguous shards of nearly equal bytes, slots gapless from 0.

    The bytes of two shards differ by less than the two largest documents together.
    """
    binary = text_or_empty(text_col).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(binary) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(binary).alias("text_crc32"),
    )
    slim = materialise(slim, "sizes")
    order = ["text_crc32", "doc_id", "size"]
    counted = slim.groupBy(*order).agg(F.count("*").alias("copies"))
    ordered = materialise(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")

    # one row for each partition: a table of the size of the job, not of the data
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("part").agg(F.sum(F.col("size") * F.col("copies")).alias("part_bytes"), F.sum("copies").alias("part_rows"))
        .select("part", F.coalesce(F.sum("part_bytes").over(every), F.lit(0)).alias("bytes_before"),
                F.coalesce(F.sum("part_rows").over(every), F.lit(0)).alias("rows_before"),
                F.sum("part_bytes").over(Window.partitionBy()).alias("total"))
    )
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ordered.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("bytes_before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
        .withColumn("row_no", F.col("rows_before") + F.coalesce(F.sum("copies").over(before), F.lit(0)))
    )
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES_PER_STEP))
    left = F.least(F.lit(COPIES_PER_STEP).cast("long"), F.col("copies") - F.col("step") * COPIES_PER_STEP)
    single = (
        placed.withColumn("step", F.explode(steps))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), left - 1)))
        .withColumn("copy", F.col("copy") + F.col("step") * COPIES_PER_STEP)
        .withColumn("row_no", F.col("row_no") + F.col("copy"))
        .withColumn("shard", F.floor((F.col("start") + F.col("copy") * F.col("size")) * F.lit(n_shards).cast("decimal(20,0)")
                                     / F.col("total")).cast("int"))
    )
    firsts = single.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # n_shards rows
    return single.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("first_row")).alias("slot"))
