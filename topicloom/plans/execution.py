"""Durable intermediates and joins that survive a hot key.

``materialise`` writes a table into the shared checkpoint folder and reads it
back: the lineage is cut, an executor loss costs nothing, and the optimiser
knows the real size of the table.  ``lookup_join`` broadcasts only after
counting; past the bound it is a shuffle join.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

MAX_TOPICS = 2000          # the largest topic count the interactive tool offers
BROADCAST_ROWS = 100_000   # bound for a broadcast side, checked by a count
BROADCAST_BYTES = 64 << 20  # and by the size of its stored columns
SPREAD_BYTES = 1 << 20     # compressed and by Spark's estimate of the columns read: about 4 MB of text
BLOCK_ROWS = 4096          # rows of a matrix block shipped to tasks


def checkpoint_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="topicloom-ckpt-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    return f"{checkpoint_root(spark)}/topicloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table; ``codec`` zstd takes less room for texts."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a stored table of texts into partitions of about ``SPREAD_BYTES``, one per core at least, so that what a task counts before a shuffle stays in its memory."""
    parts = spread_parts(df)
    return df.repartition(parts, *keys) if keys else df.repartition(parts)


def spread_parts(df: DataFrame) -> int:
    """How many parts of about ``SPREAD_BYTES`` a table of texts has, one per core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(df) // SPREAD_BYTES))


def stored_bytes(table: DataFrame) -> int:
    """What the plan knows of the stored size of a table's columns; 0 where it knows nothing."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 0 if size >= 1 << 60 else size


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS,
                salts: int = 16, stored: bool = False, hot: Column | None = None) -> DataFrame:
    """Join a row-sized table to a lookup table.

    The lookup side is stored and counted.  Up to ``max_rows`` and ``BROADCAST_BYTES`` it is broadcast, so
    the row-sized side is not shuffled.  Beyond that it is a shuffle join, asked for by a hint: the stored size of a
    compressed table tells little about its rows in memory, and a broadcast chosen by it would go through the driver.  Spark divides
    the partitions of a key with many rows; when the lookup rows for which ``hot`` holds are few, these are shared by ``salts`` tasks from the start.
    """
    table = small if stored else materialise(small, "lookup")
    if stored_bytes(table) <= BROADCAST_BYTES and table.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(table), on, how)
    if hot is not None:
        part = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
        parts = F.sequence(F.lit(0), F.lit(salts - 1))
        hot_keys = table.where(hot).select(*on).distinct().withColumn("_hot", F.lit(True))
        if hot_keys.limit(max_rows + 1).count() <= max_rows:
            marked = big.join(F.broadcast(hot_keys), on, "left")
            salted_big = marked.withColumn("_salt", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot")
            salted_small = table.withColumn("_salt", F.explode(F.when(hot, parts).otherwise(F.array(F.lit(0)))))
            return salted_big.join(salted_small.hint("merge"), [*on, "_salt"], how).drop("_salt")
    return big.join(table.hint("merge"), on, how)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank",
          salts: int = 64) -> DataFrame:
    """Rows ranked 1..k inside each key.

    Spark cuts each map task to k rows per key before the shuffle (window group
    limit) while k is within its threshold; for a larger k a salted first pass
    does the same, so no task ever sorts a whole hot group.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        columns = df.columns
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(salts)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select(*columns)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def rows_at_ranks(rows: DataFrame, key: str, order: str, targets: DataFrame, buckets: int = 64) -> DataFrame:
    """Rows at given zero-based positions of each key, in ascending ``order``.

    ``rows`` has one row per (key, order) with a numeric, per-key unique order;
    ``targets`` is ``(key, pos)``.  A histogram over quantile buckets finds the
    bucket of each position, and only rows of those buckets are sorted, so a key
    with most of the rows is never sorted in one task.
    """
    from pyspark.ml.feature import Bucketizer

    fractions = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx(order, fractions, 10 * buckets)).first()[0] or []
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    bucketed = (
        Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket")
        .transform(rows.withColumn("_order", F.col(order).cast("double")))
        .drop("_order")
    )
    running = Window.partitionBy(key).orderBy("_bucket")
    histogram = (
        bucketed.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
    )
    wanted = (
        histogram.join(targets, key)
        .where((F.col("pos") >= F.col("_before")) & (F.col("pos") < F.col("_before") + F.col("_n")))
        .select(key, "_bucket", "pos", (F.col("pos") - F.col("_before")).alias("_offset"))
    )
    wanted = materialise(wanted, "ranks")
    parts = lookup_join(bucketed, wanted.select(key, "_bucket").distinct(), [key, "_bucket"])
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    numbered = parts.withColumn("_offset", (F.row_number().over(inside) - 1).cast("bigint"))
    return numbered.join(wanted, [key, "_bucket", "_offset"]).drop("_bucket", "_offset")


def running_totals(df: DataFrame, order: list[str], sums: list[str] = ()) -> DataFrame:
    """Stored rows with ``row``, their place in the global order, and for each column of ``sums`` its total up to and with the row (``cum_<column>``).

    Range partitions are counted inside and their totals added up, so a key that fills many partitions is never
    sorted by one task.  Rows that agree in ``order`` stay together: give an order that tells rows apart.
    """
    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_n", LongType()),
                         *[StructField(f"_c_{c}", LongType()) for c in sums]])

    def run(batches):
        part, n, held = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n + 1, n + 1 + batch.num_rows))]
            for c in sums:
                total = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)) + held[c]
                held[c] = int(total[-1])
                columns.append(pa.array(total))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_n", *[f"_c_{c}" for c in sums]])

    stored = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "running")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    ends = stored.groupBy("_part").agg(F.max("_n").alias("_n"), *[F.sum(c).cast("bigint").alias(f"_c_{c}") for c in sums])
    offsets = ends.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_n", *[f"_c_{c}" for c in sums])])
    placed = stored.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_n") + F.col("_b_n") - 1)
    for c in sums:
        placed = placed.withColumn(f"cum_{c}", F.col(f"_c_{c}") + F.col(f"_b_c_{c}"))
    return placed.select(*df.columns, "row", *[f"cum_{c}" for c in sums])


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Bring a table to the driver after checking that it has at most ``max_rows`` rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows")
    return rows
