"""Nearest-neighbour and semantic search over tables of queries.

A few queries (one block, counted) go to the items where they are: each task keeps the k best items per query and only those
are shuffled.  A larger table of queries is joined with the items by parts that hold many cells or a piece of a large one, so a cell with
a third of the items is many tasks, both tables are copied a fixed number of times and neither passes through the driver.  Exact search by distance looks at a cell only
where the triangle inequality leaves a chance (``pruned_search``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators.similarity import SCORE_DIGITS, scores, stack, unit_rows, vector_blocks
from topicloom.plans.execution import BLOCK_ROWS, BROADCAST_ROWS, lookup_join, materialise, top_k

ROWS_AT_ONCE = 1024        # item rows scored in one matrix product
EXACT_LIMIT = 50_000       # items above this number get an index
MAX_CELLS = 4096
MAX_PROBES = 32
MANY_QUERIES = BLOCK_ROWS  # queries sent to the items in one block; beyond it they are joined
MAX_PIVOTS = 1024          # centers of the cells of an exact search
PARTS = 8                  # parts of either side of a join, more where one would have over PART_ROWS rows
PART_ROWS = 65_536
HITS = "query_id bigint, item_id bigint, score double"


def best_of(q: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller item) of each query."""
    order = np.lexsort((item, -score, q))
    q, item, score = q[order], item[order], score[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], item[keep], score[keep]


def _candidates(value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, row) of every score at least as good as the query's k-th best."""
    if value.shape[1] > k:
        floor = np.partition(value, value.shape[1] - k, axis=1)[:, -k]
    else:
        floor = np.full(len(value), -np.inf)
    return np.nonzero((value >= floor[:, None]) & np.isfinite(value))


def _scan(items: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, metric: str, exclude_self: bool, topics: np.ndarray | None) -> DataFrame:
    """One pass over the items for one block of queries; each task returns its k best per query.

    ``topics`` holds the topic each query is restricted to (a negative sentinel for none).
    """
    carried = ["item_id", "embedding"] + (["topic"] if topics is not None else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0))
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[at:at + ROWS_AT_ONCE]
                value = scores(stack(part["embedding"]), matrix, metric).T
                item = part["item_id"].to_numpy("int64")
                if topics is not None:
                    wrong = (topics[:, None] != NO_TOPIC) & (topics[:, None] != part["topic"].to_numpy()[None, :])
                    value = np.where(wrong, -np.inf, value)
                if exclude_self:
                    value = np.where(ids[:, None] == item[None, :], -np.inf, value)
                q, r = _candidates(value, k)
                held = best_of(np.r_[held[0], q], np.r_[held[1], item[r]], np.r_[held[2], value[q, r]], k)
        yield pd.DataFrame({"query_id": ids[held[0]], "item_id": held[1], "score": held[2]})

    return items.select(*carried).mapInPandas(run, HITS)


NO_TOPIC = -(2**31)


def _ranked(hits: DataFrame, k: int, metric: str) -> DataFrame:
    ranked = top_k(hits, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)
    if metric == "l2":
        return ranked.select("query_id", "rank", "item_id", (F.lit(0.0) - F.col("score")).alias("distance"))
    return ranked.select("query_id", "rank", "item_id", F.col("score").alias("similarity"))


def knn(queries: DataFrame, items: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False,
        in_topic: bool = False, many: int = MANY_QUERIES) -> DataFrame:
    """Exact k nearest items: (query_id, rank, item_id, distance | similarity).

    ``queries`` is (query_id, embedding[, topic_filter]); with ``in_topic`` a query
    with a filter sees items of that topic only, so an empty topic gives no rows.
    Up to ``many`` queries are sent to the items in one block; a larger table is joined with them.
    """
    columns = ["query_id", "embedding", *(["topic_filter"] if in_topic else [])]
    asked = queries.select(*columns).limit(many + 1).collect()
    if len(asked) > many:
        return _ranked(_joined_hits(queries, items, k, metric, exclude_self, in_topic), k, metric)
    if not asked:
        return _ranked(items.sparkSession.createDataFrame([], HITS), k, metric)
    ids = np.array([r["query_id"] for r in asked], dtype="int64")
    matrix = np.array([r["embedding"] for r in asked], dtype="float64")
    topics = np.array([NO_TOPIC if r["topic_filter"] is None else r["topic_filter"] for r in asked]) if in_topic else None
    if in_topic and (topics != NO_TOPIC).all():
        items = items.where(F.col("topic").isin(sorted({int(t) for t in topics})))  # of a table stored by topic, only these folders are read
    return _ranked(_scan(items, ids, matrix, k, metric, exclude_self, topics), k, metric)


def _joined_hits(queries: DataFrame, items: DataFrame, k: int, metric: str, exclude_self: bool, in_topic: bool, block: int = 2048) -> DataFrame:
    """Hits of a table of queries of any size: by cells where distances allow it, otherwise block by block."""
    if in_topic:
        free = queries.where(F.col("topic_filter").isNull()).select("query_id", "embedding")
        bound = queries.where(F.col("topic_filter").isNotNull()).select("query_id", "embedding", F.array(F.col("topic_filter").cast("int")).alias("cells"))
        inside = _block_join(bound, items.where(F.col("topic").isNotNull()).withColumn("cell", F.col("topic")), k, metric, exclude_self, block)
        return _joined_hits(free, items, k, metric, exclude_self, False, block).unionByName(inside)
    if metric == "l2":
        return pruned_search(queries, items, k, exclude_self, block=block)[0]
    return _block_join(queries.select("query_id", "embedding", F.array(F.lit(0)).alias("cells")), items.withColumn("cell", F.lit(0)), k, metric, exclude_self, block)


def pruned_search(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = False, pivots: int | None = None, first: int = 2,
                  block: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(hits, visits) of an exact search by distance: HITS with all of each query's k nearest among them, and (query_id, cell, n), the cells looked at.

    Items belong to the cell of their nearest pivot, and a cell has a radius.  A query looks at its ``first`` nearest cells; the distance of its
    k-th item there bounds the others: a cell whose pivot is farther than that bound and its radius together holds nothing nearer.
    """
    spark = items.sparkSession
    n = items.count()
    wanted = max(1, min(MAX_PIVOTS, n // block)) if pivots is None else pivots
    draw = F.md5(F.col("item_id").cast("string"))
    chosen = items.select("item_id", "embedding", draw.alias("_d")).orderBy("_d", "item_id").limit(wanted).collect()
    centers = np.array([r["embedding"] for r in chosen], dtype="float64")
    if not len(centers):
        return spark.createDataFrame([], HITS), spark.createDataFrame([], "query_id bigint, cell int, n bigint")

    @F.pandas_udf("struct<cell: int, away: double>")
    def nearest_pivot(column: pd.Series) -> pd.DataFrame:
        if len(column) == 0:
            return pd.DataFrame({"cell": [], "away": []})
        value = scores(stack(column), centers, "l2")
        at = value.argmax(axis=1)
        return pd.DataFrame({"cell": at.astype("int32"), "away": np.sqrt(-value[np.arange(len(at)), at])})

    index = materialise(items.select("item_id", "embedding", nearest_pivot("embedding").alias("_c")).select("item_id", "embedding", "_c.cell", "_c.away"), "cells")
    sizes = index.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()  # one row for each pivot
    radius, size = np.full(len(centers), -np.inf), np.zeros(len(centers), int)
    for r in sizes:
        radius[r["cell"]], size[r["cell"]] = r["radius"], r["n"]
    filled = np.flatnonzero(size)

    @F.pandas_udf("array<int>")
    def near_cells(column: pd.Series) -> pd.Series:
        if len(column) == 0:
            return pd.Series([], dtype=object)
        value = scores(stack(column), centers[filled], "l2")
        return pd.Series([filled[np.argsort(-row, kind="stable")[:first]].astype("int32") for row in value])

    @F.pandas_udf("array<int>")
    def open_cells(column: pd.Series, bound: pd.Series) -> pd.Series:
        if len(column) == 0:
            return pd.Series([], dtype=object)
        value = scores(stack(column), centers[filled], "l2")
        away = np.sqrt(-value)
        # scores are rounded, so the bound is widened by more than that
        limit = np.where(bound.isna(), np.inf, bound.to_numpy(dtype="float64") * (1 + 1e-6) + 1e-4)
        found = []
        for row, reach, close in zip(away, limit, value):
            done = np.argsort(-close, kind="stable")[:first]
            allowed = row <= reach + radius[filled]
            allowed[done] = False
            found.append(filled[allowed].astype("int32"))
        return pd.Series(found)

    asked = materialise(queries.select("query_id", "embedding"), "queries")
    one = asked.select("query_id", "embedding", near_cells("embedding").alias("cells"))
    hits = materialise(_block_join(one, index, k, "l2", exclude_self, block), "first-hits")
    best = top_k(hits, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)
    bound = best.where(F.col("rank") == k).select("query_id", F.sqrt(-F.col("score")).alias("bound"))
    two = asked.join(bound, "query_id", "left").select("query_id", "embedding", open_cells("embedding", "bound").alias("cells"))
    two = materialise(two, "more-cells")
    more = _block_join(two, index, k, "l2", exclude_self, block)
    counted = spark.createDataFrame([(int(c), int(size[c])) for c in filled], "cell int, n bigint")
    looked = one.select("query_id", "cells").unionByName(two.select("query_id", "cells")).select("query_id", F.explode("cells").alias("cell"))
    return hits.unionByName(more), looked.join(F.broadcast(counted), "cell").select("query_id", "cell", "n")


def knn_pruned(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = False, pivots: int | None = None) -> DataFrame:
    """As ``knn`` by distance, for a table of queries of any size, looking at the cells the triangle inequality leaves."""
    return _ranked(pruned_search(queries, items, k, exclude_self, pivots)[0], k, "l2")


# --- inverted-file index ----------------------------------------------------------------------

def ivf_plan(items: DataFrame) -> DataFrame:
    """(items, kind, cells, probes): exact up to 50,000 items, an index above."""
    n = F.count("*")
    cells = F.least(F.floor(F.sqrt(n.cast("double"))).cast("int"), F.lit(MAX_CELLS))
    plan = items.agg(n.alias("items"), cells.alias("cells"))
    indexed = F.col("items") > EXACT_LIMIT
    return plan.select(
        "items", F.when(indexed, "ivf").otherwise("flat").alias("kind"),
        F.when(indexed, F.col("cells")).otherwise(1).alias("cells"),
        F.when(indexed, F.least(F.lit(MAX_PROBES), F.greatest(F.floor(F.col("cells") / 4).cast("int"), F.lit(1)))).otherwise(1).alias("probes"))


def build_ivf(items: DataFrame, cells: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(index, centers): items with their cell, and (cell, center).  Cells are k-means clusters."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(items.select(vector.alias("_v")))
    index = model.transform(items.withColumn("_v", vector)).drop("_v")
    spark = items.sparkSession
    # at most MAX_CELLS centers
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, center array<double>")
    return index, centers


def _probed(queries: DataFrame, centers: DataFrame, probes: int) -> DataFrame:
    """Add ``cells``, the nearest cells of each query, chosen inside the kernel; ties go to the smaller cell."""
    blocks = list(vector_blocks(centers, "cell", "center"))
    if not blocks:
        return queries.withColumn("cells", F.array().cast("array<int>"))
    ids, matrix = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])

    @F.pandas_udf("array<int>")
    def nearest_cells(column: pd.Series) -> pd.Series:
        if len(column) == 0:
            return pd.Series([], dtype=object)
        value = scores(stack(column), matrix, "l2")
        worst = np.partition(-value, min(probes, len(ids)) - 1, axis=1)[:, min(probes, len(ids)) - 1]
        chosen = []
        for row, limit in zip(value, worst):
            at = np.flatnonzero(-row <= limit)  # a few more than asked for when scores tie
            chosen.append(ids[at[np.lexsort((ids[at], -row[at]))][:probes]].astype("int32"))
        return pd.Series(chosen)

    return queries.withColumn("cells", nearest_cells("embedding"))


def probes_of(queries: DataFrame, centers: DataFrame, probes: int) -> DataFrame:
    """(query_id, cell): the nearest cells of each query."""
    return _probed(queries, centers, probes).select("query_id", F.explode("cells").alias("cell"))


def knn_ivf(queries: DataFrame, index: DataFrame, centers: DataFrame, k: int, probes: int, metric: str = "l2",
            exclude_self: bool = False, block: int = 2048) -> DataFrame:
    """k nearest items among the probed cells of each query: a join on (part of the items, part of the queries).

    A part holds up to ``PART_ROWS`` rows, of many cells or of a piece of one, so no task's memory follows a full cell; ``block`` items are compared at
    once.  The probed cells meet the index first, so of an index stored by cell only their folders are read.
    """
    wanted = _probed(queries.select("query_id", "embedding"), centers, probes)
    return _ranked(_block_join(wanted, index, k, metric, exclude_self, block), k, metric)


knn_join = knn_ivf


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return pc.list_flatten(column).to_numpy().astype("float64").reshape(len(column), -1)


def _best_in_part(ids: np.ndarray, queries: np.ndarray, owner: np.ndarray, wanted: np.ndarray, item: np.ndarray, items: np.ndarray, cell: np.ndarray,
                  k: int, metric: str, exclude_self: bool, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score): the k best items of each query in the cells it wants, given as pairs (owner, wanted).

    Every query keeps its k-th best score so far, so of a further block only better scores are looked at.
    """
    if metric == "cosine":
        queries, items = unit_rows(queries), unit_rows(items)
    q2, i2 = (queries ** 2).sum(1), (items ** 2).sum(1)
    at_least = np.full(len(ids), -np.inf)
    held = (np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0))
    more = k + bool(exclude_self)  # itself may be one of the best
    by_cell, by_wish = np.argsort(cell, kind="stable"), np.argsort(wanted, kind="stable")
    cell, wanted, owner = cell[by_cell], wanted[by_wish], owner[by_wish]
    for c in np.unique(cell):
        members = by_cell[np.searchsorted(cell, c):np.searchsorted(cell, c, "right")]
        askers = owner[np.searchsorted(wanted, c):np.searchsorted(wanted, c, "right")]
        for start in range(0, len(members), block):
            some = members[start:start + block]
            turned = items[some].T
            found = []
            for at in range(0, len(askers), ROWS_AT_ONCE):
                who = askers[at:at + ROWS_AT_ONCE]
                if metric == "l2":
                    value = 2 * queries[who] @ turned
                    value -= q2[who][:, None]
                    value -= i2[some][None, :]
                else:
                    value = queries[who] @ turned
                floor = at_least[who] - 10.0 ** -SCORE_DIGITS  # scores are rounded below
                fresh = np.flatnonzero(np.isinf(floor))
                if len(fresh) and len(some) > more:
                    floor[fresh] = np.partition(value[fresh], len(some) - more, axis=1)[:, -more] - 10.0 ** -SCORE_DIGITS
                row, column = np.nonzero(value >= floor[:, None])
                score = np.round(value[row, column], SCORE_DIGITS)
                if metric == "l2":
                    score = np.minimum(score, 0.0)
                keep = np.isfinite(score)
                if exclude_self:
                    keep &= ids[who[row]] != item[some[column]]
                found.append((who[row[keep]], item[some[column[keep]]], score[keep]))
            if sum(len(f[0]) for f in found):
                held = best_of(*(np.concatenate([h, *parts]) for h, parts in zip(held, zip(*found))), k)
                n = np.bincount(held[0], minlength=len(ids))
                worst = np.full(len(ids), np.inf)
                np.minimum.at(worst, held[0], held[2])
                at_least = np.where(n >= k, worst, -np.inf)
    return held


def _dealt(wanted: DataFrame, plan: DataFrame, parts: int, total: int) -> DataFrame:
    """(query_id, embedding, part, cells): a query once for every part of the items that holds rows of its cells.

    ``plan`` is (cell, n, before).  Up to ``BROADCAST_ROWS`` cells it travels to the tasks; of more cells a query comes once for each cell and part.
    """
    spans = plan.select("cell", F.expr(f"before * {parts} DIV {total}").cast("int").alias("low"), F.expr(f"(before + n - 1) * {parts} DIV {total}").cast("int").alias("high"))
    few = spans.orderBy("cell").limit(BROADCAST_ROWS + 1).toArrow()
    if few.num_rows > BROADCAST_ROWS:
        one = lookup_join(wanted.select("query_id", "embedding", F.explode("cells").alias("cell")), spans, ["cell"])
        return one.select("query_id", "embedding", F.explode(F.sequence("low", "high")).alias("part"), F.array("cell").alias("cells"))
    known, low, high = (few.column(i).to_numpy() for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
                cell = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
                hit = known[at] == cell
                owner, cell, at = owner[hit], cell[hit], at[hit]
                n = high[at] - low[at] + 1
                owner, cell = np.repeat(owner, n), np.repeat(cell, n)
                part = np.repeat(low[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                order = np.lexsort((cell, part, owner))
                owner, cell, part = owner[order], cell[order], part[order]
                if not len(owner):
                    continue
                first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)), pa.int32()), pa.array(cell, pa.int32()))
                rows = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(part[first], pa.int32()), lists],
                                                 names=["query_id", "embedding", "part", "cells"])

    kind = wanted.schema["embedding"].dataType.simpleString()
    rows = wanted.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding", "cells")
    return rows.mapInArrow(run, f"query_id bigint, embedding {kind}, part int, cells array<int>") if len(known) else rows.withColumn("part", F.lit(0)).limit(0)


def _block_join(wanted: DataFrame, index: DataFrame, k: int, metric: str, exclude_self: bool, block: int) -> DataFrame:
    """Hits of (query_id, embedding, cells) on the items of these cells.

    The items stand in a row, cell after cell, and are cut into parts of equal size; the queries are dealt into parts by a hash.  A query goes once to each
    part that holds rows of its cells, an item to each part of the queries.  So what is shuffled is a fixed number of copies of both tables
    and not their pairs of blocks.
    """
    wanted = materialise(wanted, "probed")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row for each cell
    sizes = index.groupBy("cell").agg(F.count("*").alias("n"))
    plan = materialise(sizes.where("cell IS NOT NULL").select(F.col("cell").cast("int").alias("cell"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "cells-in-a-row")
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts_of = lambda n, least: max(1, -(-n // PART_ROWS), min(PARTS, -(-n // least)))
    i_parts, q_parts = parts_of(total, block), parts_of(wanted.count(), min(block, ROWS_AT_ONCE))
    left = _dealt(wanted, plan, i_parts, max(1, total)).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int"))
    place = F.expr(f"(before + pmod(xxhash64(item_id), n)) * {i_parts} DIV {max(1, total)}").cast("int")
    right = lookup_join(index.select(F.col("cell").cast("int").alias("cell"), F.col("item_id").cast("bigint").alias("item_id"), "embedding"), plan, ["cell"], stored=True).select(
        "cell", place.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("qb"), "item_id", "embedding")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "item_id", "score"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        ids, cells = asked.column("query_id").to_numpy(), asked.column("cells")
        owner = np.repeat(np.arange(len(ids)), pc.list_value_length(cells).to_numpy())
        q, item, score = _best_in_part(ids, _rows_of(asked.column("embedding")), owner, pc.list_flatten(cells).to_numpy(), held.column("item_id").to_numpy(),
                                       _rows_of(held.column("embedding")), held.column("cell").to_numpy(), k, metric, exclude_self, block)
        return pa.table([pa.array(ids[q]), pa.array(item), pa.array(score)], names=names)

    return left.groupBy("part", "qb").cogroup(right.groupBy("part", "qb")).applyInArrow(run, HITS)


def neighbours(items: DataFrame, k: int, metric: str = "l2", method: str = "exact", cells: int | None = None,
               probes: int | None = None) -> DataFrame:
    """The k nearest other items of every item.

    ``method`` is the caller's choice and does not depend on the number of items: ``exact`` compares all items,
    ``index`` those in the probed cells of an inverted-file index.
    """
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    if method == "exact":
        return knn(queries, items, k, metric, exclude_self=True)
    plan = ivf_plan(items).first()
    cells = cells or max(1, int(plan["items"] ** 0.5))
    index, centers = build_ivf(items, cells)
    return knn_join(queries, materialise(index, "index"), centers, k, probes or max(1, cells // 16), metric, exclude_self=True)


# --- semantic search and retrieval ------------------------------------------------------------

def semantic_search(queries: DataFrame, items: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, rank, item_id, similarity): best dot products.

    A query's ``scope`` is a topic or null; a topic without items falls back to all.
    """
    known = items.select(F.col("topic").alias("scope")).distinct().withColumn("topic_filter", F.col("scope"))
    scoped = queries.join(known, "scope", "left").select("query_id", "embedding", "topic_filter")
    hits = knn(scoped, items, n, "dot", in_topic=True)
    return hits.withColumn("similarity", F.round("similarity", 3))


def search_variants(variants: DataFrame, items: DataFrame, k: int, in_topic: bool = False) -> DataFrame:
    """(query_id, rank, item_id, distance): several phrasings per query, the smallest distance per item.

    ``variants`` is (query_id, variant, embedding[, topic_filter]).  A query with one
    phrasing looks at k items, others at 2k items per phrasing.
    """
    per_query = variants.groupBy("query_id").agg(F.count("*").alias("phrasings"))
    keyed = materialise(variants.join(per_query, "query_id").withColumn(
        "_key", F.monotonically_increasing_id()), "variants")
    extra = ["topic_filter"] if in_topic else []
    asked = keyed.select(F.col("_key").alias("query_id"), "embedding", *extra)
    hits = knn(asked, items, 2 * k, "l2", in_topic=in_topic).withColumnRenamed("query_id", "_key")
    found = hits.join(keyed.select("_key", "query_id", "phrasings"), "_key").where(
        F.col("rank") <= F.when(F.col("phrasings") > 1, 2 * k).otherwise(k))
    merged = found.groupBy("query_id", "item_id").agg(F.min("distance").alias("distance"))
    return top_k(merged, ["query_id"], [F.col("distance"), F.col("item_id")], k).select("query_id", "rank", "item_id", "distance")


def lift_chunks(hits: DataFrame, chunks: DataFrame, assignment: DataFrame) -> DataFrame:
    """Add the parent document and its topic to hits on chunks (item_id is the chunk's id)."""
    parents = chunks.select("item_id", "doc_id")
    return hits.join(parents, "item_id").join(assignment.select("doc_id", "topic"), "doc_id", "left")


def bm25(hits: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Add ``rerank_score`` to hits (query_id, item_id, query_text, text): BM25 within the hits of each query."""
    words = hits.select("query_id", "item_id", F.array_distinct(T.word_tokens(F.col("query_text"))).alias("q"),
                        T.word_tokens(F.col("text")).alias("t"))
    words = materialise(words, "hit-words")
    sizes = words.groupBy("query_id").agg(F.count("*").alias("hits"), F.avg(F.size("t")).alias("mean_len"))
    matched = words.select("query_id", "item_id", F.size("t").alias("len"), F.explode(
        F.filter("t", lambda w: F.array_contains("q", w))).alias("term"))
    tf = matched.groupBy("query_id", "item_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    joined = tf.join(df, ["query_id", "term"]).join(sizes, "query_id")
    idf = F.log(1 + (F.col("hits") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    summed = joined.groupBy("query_id", "item_id").agg(F.round(F.sum(idf * gain), 6).alias("rerank_score"))
    return hits.join(summed, ["query_id", "item_id"], "left").withColumn(
        "rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def rerank(hits: DataFrame, k: int, threshold: float = 0.0, scorer=bm25) -> DataFrame:
    """The k best hits by a scorer; hits below a positive threshold are dropped.

    ``scorer`` adds ``rerank_score`` to the hits; a model goes in through ``mapInPandas``.
    """
    scored = scorer(hits)
    if threshold > 0:
        scored = scored.where(F.col("rerank_score") >= threshold)
    return top_k(scored.drop("rank"), ["query_id"], [F.col("rerank_score").desc(), F.col("distance"), F.col("item_id")], k)


def build_context(hits: DataFrame, info: DataFrame | None = None, shown: int = 100) -> DataFrame:
    """(query_id, context): numbered excerpts in rank order, headed by the current topic if there is one.

    ``hits`` is (query_id, rank, text, topic[, current_topic]).
    """
    tag = F.when(F.col("topic").isNotNull(), F.concat(F.lit(" [from Topic "), F.col("topic").cast("string"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("[Doc "), F.col("rank").cast("string"), F.lit("]"), tag, F.lit(": "), T.excerpt(F.col("text"), 300))
    lines = hits.where(F.col("rank") <= shown).select(
        "query_id", "rank", line.alias("line"),
        *([F.col("current_topic")] if "current_topic" in hits.columns else [F.lit(None).cast("int").alias("current_topic")]))
    grouped = lines.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]), "\n").alias("body"),
        F.max("current_topic").alias("current_topic"))
    if info is None:
        return grouped.select("query_id", F.col("body").alias("context"))
    head = info.where(F.col("topic") != -1).select(
        F.col("topic").alias("current_topic"),
        F.concat(F.lit("Currently viewing Topic "), F.col("topic").cast("string"), F.lit(": "), F.col("human_label"),
                 F.lit("\nKeywords: "), F.col("keywords"), F.lit("\n")).alias("head"))
    return grouped.join(head, "current_topic", "left").select(
        "query_id", F.concat(F.coalesce("head", F.lit("")), F.col("body")).alias("context"))


def build_sources(hits: DataFrame, shown: int = 3) -> DataFrame:
    """(query_id, sources): the first hits with previews, topic tags and scores."""
    topic = F.when(F.col("topic").isNotNull(), F.concat(F.lit(" [Topic "), F.col("topic").cast("string"), F.lit("]"))).otherwise("")
    score = F.concat(F.lit(" (relevance: "), F.format_number("rerank_score", 3), F.lit(")")) if "rerank_score" in hits.columns else F.lit("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), T.excerpt(F.col("text"), 100), topic, score)
    lines = hits.where(F.col("rank") <= shown).select("query_id", "rank", line.alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]), "\n").alias("sources"))
