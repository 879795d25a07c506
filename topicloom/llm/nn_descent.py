"""Embedding near-duplicates by NN-descent (operator 10).

Equal vectors are one node with a multiplicity.  The first neighbour graph comes from sorting the nodes by random hyperplane codes and comparing
each with the next ones, several times.  Then rounds of neighbours-of-neighbours: every node's forward and reverse neighbours meet in one small group, are compared with each other, and
improve each other's lists.  A list whose worst neighbour is still above the threshold is saturated and is allowed twice the length.  Rounds end when
one finds no new pair at or above the threshold.  An audit compares a fixed number of nodes with all others, and the search goes on with longer lists and edges from
new orders while the recall is too low.  What the audit finds is no part of the result.  A search that does not converge, or stays below the recall, raises.  Pairs at or above the threshold give the classes.

Two dense classes may be close although every list is full of nearer neighbours.  A link that no list can hold lies between saturated nodes, so between classes of at least ``longest``
nodes: these classes are compared with each other in full, block by block, where the cones around two blocks leave a pair possible.

Lists are bounded, dense classes are not: the number of links is therefore counted exactly inside each class, blocks of its members against
blocks, in double precision.  So a class of any size costs no list of that size, and no task holds more than two blocks.

Defined cases: null, empty or zero vectors, vectors with null or non-finite components, and null labels link with nothing; only vectors of equal length are compared;
equal vectors link with each other; repeated rows are vectors of their own; a null id never names a class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import arrow_rows, materialise
from topicloom.llm.graph import connected_components

SLACK = 1e-5   # the search compares single precision; pairs are decided in double precision


@dataclass(frozen=True)
class DescentRules:
    threshold: float = 0.98
    neighbours: int = 8        # length of a list at first
    longest: int = 64          # a saturated list grows up to this length
    orders: int = 5            # hyperplane orders of the first graph
    window: int = 24           # nodes compared with each other in an order
    max_rounds: int = 64       # a search that has not passed its audit by then raises
    audit_nodes: int = 512     # nodes compared with all others
    audit_recall: float = 0.99
    block: int = 256           # members of a class in one block of the exact count
    seed: int = 17


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their key, stored nodes): a node is a distinct (label, vector) that can link."""
    values = F.col(vector_col).cast("array<double>")
    ok = (
        F.col(label_col).isNotNull() & values.isNotNull() & (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), values.alias("v"),
                          F.coalesce(ok, F.lit(False)).alias("ok"))
    rows = rows.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.hash("v", "label"))  # 96 bits name a vector
    distinct = rows.where("ok").groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))

    def unit(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        packed = []
        for v in columns[5]:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x / np.abs(x).max()
            packed.append((x / np.sqrt(x @ x)).tobytes())
        single = [np.frombuffer(p).astype(np.float32).tobytes() for p in packed]
        return pa.RecordBatch.from_arrays([*columns[:5], pa.array(packed, pa.binary()), pa.array(single, pa.binary())],
                                          names=["h1", "h2", "copies", "least", "label", "unit", "short"])

    distinct = arrow_rows(distinct, unit, "h1 long, h2 int, copies long, least long, label string, unit binary, short binary")
    space = F.concat_ws("/", F.length("short"), "label")
    return rows.drop("v"), materialise(distinct.withColumn("space", space).withColumn("node", F.monotonically_increasing_id()), "nodes")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and any(held[0][k][0].as_py() != part[k][0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _edges(source, target, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(target, pa.int64()), pa.array(sim, pa.float32())], names=["u", "v", "sim"])


EDGE = "u long, v long, sim float"


def first_graph(nodes: DataFrame, rules: DescentRules, search: int = 0) -> DataFrame:
    """Edges between nodes that stand close in orders by random hyperplane codes, in their space; every search has orders of its own."""
    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, space = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
        vectors = batch.column(2).to_pylist()
        codes = np.zeros((rules.orders, len(node)), np.int64)
        lengths = np.array([len(v) for v in vectors])
        for length in np.unique(lengths):
            chosen = np.flatnonzero(lengths == length)
            x = np.frombuffer(b"".join(vectors[i] for i in chosen), np.float32).reshape(len(chosen), -1)
            planes = np.random.default_rng(rules.seed + search).normal(size=(x.shape[1], 32 * rules.orders)).astype(np.float32)
            bits = (x @ planes > 0).reshape(len(chosen), rules.orders, 32)
            codes[:, chosen] = (bits @ (1 << np.arange(31, -1, -1, dtype=np.int64))).T
        n = rules.orders
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n), len(node))), pa.array(np.tile(space, n), pa.string()), pa.array(codes.ravel()),
             pa.array(np.tile(node, n)), pa.array(vectors * n, pa.binary())], names=["turn", "space", "code", "node", "short"])

    rows = arrow_rows(nodes.select("node", "space", "short"), coded, "turn long, space string, code long, node long, short binary")
    order = ["turn", "space", "code", "node"]
    size, step = rules.window, rules.window // 2

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for table in _groups_of_batches(batches):
            for part in _groups(iter(table.to_batches()), ["turn", "space"]):
                if rest is not None and rest["turn"][0] == part["turn"][0] and rest["space"][0] == part["space"][0]:
                    part = pa.concat_tables([rest, part])
                node, x = part["node"].to_numpy(), _matrix(part["short"], np.float32)
                for a in range(0, max(1, len(node) - step), step):
                    ids, m = node[a:a + size], x[a:a + size]
                    if len(ids) > 1:
                        sims = m @ m.T
                        np.fill_diagonal(sims, -2)
                        k = min(rules.neighbours, len(ids) - 1)
                        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                        yield _edges(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel())
                rest = part.slice(max(0, len(node) - step))

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, EDGE)


def _groups_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


def best_lists(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(u, v, sim, rank): the best of each node's edges, as many as its list may hold."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    return ranked.join(lengths, "u").where("rank <= length").drop("length")


def descend(nodes: DataFrame, graph: DataFrame, lengths: DataFrame, rules: DescentRules) -> DataFrame:
    """Edges between neighbours of a common node that are better than the worst in one of the two lists."""
    reverse = graph.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).join(
        lengths.select(F.col("u").alias("v"), "length"), "v").where("r <= length").select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = graph.select("u", "v").union(reverse).distinct()
    # a list of the greatest length that is still saturated wants no more: its class is counted in full later
    ample = (F.col("length") >= rules.longest) & (F.col("worst") >= rules.threshold - SLACK)
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n")).join(lengths, "u").select(
        F.col("u").alias("v"),
        F.when(F.col("n") < F.col("length"), -2.0).when(ample, 2.0).otherwise(F.col("worst")).cast("float").alias("worst"))
    members = around.join(worst, "v").join(nodes.select(F.col("node").alias("v"), "short"), "v")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["u"]):
            if group.num_rows < 2:
                continue
            ids, worst_sim, x = group["v"].to_numpy(), group["worst"].to_numpy(), _matrix(group["short"], np.float32)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            i, j = np.nonzero(sims > worst_sim[:, None])
            if len(i):
                yield _edges(ids[i], ids[j], sims[i, j])

    return members.repartition("u").sortWithinPartitions("u").mapInArrow(joined, EDGE)


def audit(nodes: DataFrame, rules: DescentRules) -> DataFrame:
    """(a, b): all pairs at or above the threshold of a fixed number of nodes with every other node."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(rules.audit_nodes).select("node", "space", "unit").collect()
    ids = np.array([r.node for r in chosen], np.int64)
    spaces = np.array([r.space for r in chosen], object)
    by_space = {s: (ids[spaces == s], np.frombuffer(b"".join(bytes(r.unit) for r in chosen if r.space == s)).reshape(int((spaces == s).sum()), -1))
                for s in set(spaces.tolist())}
    shared = nodes.sparkSession.sparkContext.broadcast(by_space)

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        node, space, units = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_pylist()
        for s, (query, q) in shared.value.items():
            here = np.flatnonzero(space == s)
            if len(here):
                sims = q @ np.frombuffer(b"".join(units[i] for i in here)).reshape(len(here), -1).T
                i, j = np.nonzero(sims >= rules.threshold)
                a.append(query[i])
                b.append(node[here[j]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return arrow_rows(nodes.select("node", "space", "unit"), rows_of, "a long, b long")


def _search(nodes: DataFrame, rules: DescentRules) -> tuple[DataFrame, float]:
    """(edges at or above the threshold, recall of the audit)."""
    lengths = nodes.select(F.col("node").alias("u"), F.lit(rules.neighbours).alias("length"))
    graph = materialise(best_lists(first_graph(nodes, rules), lengths), "graph")
    known, longest, search, recall = -1, rules.neighbours, 0, None
    truth = materialise(audit(nodes, rules), "audit")
    n_truth = truth.count()
    for turn in range(rules.max_rounds):
        full = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
        grown = lengths.join(full, "u", "left").withColumn("saturated", (F.col("n") >= F.col("length")) & (F.col("worst") >= rules.threshold - SLACK))
        longer = F.greatest("length", F.least(F.col("length") * 2, F.lit(rules.longest)))
        lengths = materialise(grown.select("u", F.when(F.col("saturated"), longer).otherwise(F.col("length")).alias("length")), "lengths")
        better = descend(nodes, graph, lengths, rules)
        graph = materialise(best_lists(graph.select("u", "v", "sim").union(better), lengths), "graph")
        links = graph.where(F.col("sim") >= rules.threshold - SLACK)
        found, before = links.count(), known
        known = found
        if found == before:
            edges = _verified(links, nodes, rules)
            edges = edges.union(bridges(nodes, materialise(connected_components(edges), "lobes"), rules))
            found_pairs = materialise(connected_components(edges), "classes")
            both = truth.join(found_pairs.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
                found_pairs.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").where("ca = cb")
            recall = both.count() / n_truth if n_truth else 1.0
            if recall >= rules.audit_recall:
                return edges, recall
            # every list may be longer now, and nodes meet in new orders
            longest, search, known = longest * 2, search + 1, -1
            lengths = materialise(lengths.select("u", F.greatest("length", F.lit(longest)).alias("length")), "lengths")
            more = first_graph(nodes, rules, search)
            graph = materialise(best_lists(graph.select("u", "v", "sim").union(more), lengths), "graph")
    raise RuntimeError(f"{rules.max_rounds} rounds did not pass the audit: last recall {recall}, wanted {rules.audit_recall}")


def bridges(nodes: DataFrame, members: DataFrame, rules: DescentRules) -> DataFrame:
    """(a, b): a pair at or above the threshold for any two blocks of different large classes that have one."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= rules.longest)
    blocks = F.ceil(F.col("size") / rules.block).cast("long")
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    placed = materialise(placed.join(nodes.select("node", "space", "unit"), "node").select("component", "block", "node", "space", "unit"), "large")

    def cones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["component", "block"]):
            x = _matrix(group["unit"], np.float64)
            centre = x.mean(axis=0)
            centre /= max(np.sqrt(centre @ centre), 1e-300)
            radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[k][:1].to_pylist(), t) for k, t in (("component", pa.int64()), ("block", pa.int64()), ("space", pa.string()))]
                + [pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], names=["component", "block", "space", "centre", "radius"])

    keys = ["component", "block"]
    cells = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        cones, "component long, block long, space string, centre binary, radius double")
    cells = materialise(cells, "cells")
    # a space may have one label only: its pairs are spread over 16 salts
    left = cells.select(*[F.col(c).alias(f"{c}_i") for c in cells.columns]).withColumn("salt", F.pmod(F.xxhash64("component_i", "block_i"), F.lit(16)))
    right = cells.select(*[F.col(c).alias(f"{c}_j") for c in cells.columns]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    pairs = left.join(right, (F.col("space_i") == F.col("space_j")) & (left["salt"] == right["salt"]) & (F.col("component_i") < F.col("component_j")))
    widest = float(np.arccos(rules.threshold)) + 1e-6

    def possible(batch: pa.RecordBatch) -> pa.RecordBatch:
        cosine = np.array([np.frombuffer(p) @ np.frombuffer(q) for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
        apart = np.arccos(np.clip(cosine, -1, 1))
        return batch.select([2, 3, 4, 5]).filter(pa.array(apart <= batch.column(6).to_numpy() + widest))

    ends = ["component_i", "block_i", "component_j", "block_j"]
    pairs = pairs.select("centre_i", "centre_j", *ends, (F.col("radius_i") + F.col("radius_j")).alias("reach"))
    close = materialise(arrow_rows(pairs, possible, ", ".join(f"{e} long" for e in ends)), "close")
    sides = [close.select(*ends, F.col(f"component_{t}").alias("component"), F.col(f"block_{t}").alias("block")) for t in "ij"]
    met = sides[0].union(sides[1]).join(placed.select("component", "block", "node", "unit"), keys)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ends):
            node, x = group["node"].to_numpy(), _matrix(group["unit"], np.float64)
            here = group["component"].to_numpy() == group["component_i"][0].as_py()
            sims = x[here] @ x[~here].T
            i, j = np.unravel_index(int(sims.argmax()), sims.shape)
            if sims[i, j] >= rules.threshold:
                yield pa.RecordBatch.from_arrays([pa.array([node[here][i]]), pa.array([node[~here][j]])], names=["a", "b"])

    return materialise(met.repartition(*ends).sortWithinPartitions(*ends).mapInArrow(compared, "a long, b long"), "bridges")


def _verified(links: DataFrame, nodes: DataFrame, rules: DescentRules) -> DataFrame:
    """(a, b): the pairs that reach the threshold in double precision."""
    pairs = links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    x, y = (nodes.select(F.col("node").alias(n), F.col("unit").alias(f"unit_{n}")) for n in "ab")

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        cosine = np.array([np.frombuffer(p) @ np.frombuffer(q) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])
        return batch.select([0, 1]).filter(pa.array(cosine >= rules.threshold))

    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "unit_a", "unit_b")
    return materialise(arrow_rows(joined, rows_of, "a long, b long"), "links")


def count_links(nodes: DataFrame, members: DataFrame, rules: DescentRules) -> DataFrame:
    """(node, links): vectors at or above the threshold inside the node's class, copies of the node not counted."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    placed = members.join(sizes, "component").join(nodes.select("node", "copies", "unit"), "node")
    blocks = F.ceil(F.col("size") / rules.block).cast("long")
    placed = placed.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "unit")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["component", "i", "j"]):
            node, copies, mine, x = group["node"].to_numpy(), group["copies"].to_numpy(), group["mine"].to_numpy(), _matrix(group["unit"], np.float64)
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            left, right = mine == i, mine == j
            near = x[left] @ x[right].T >= rules.threshold
            if i == j:
                np.fill_diagonal(near, False)
                yield _counts(node, near @ copies)
            else:
                yield _counts(node[left], near @ copies[right])
                yield _counts(node[right], copies[left] @ near)

    keys = ["component", "i", "j"]
    counts = spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(counted, "node long, n long")
    return counts.groupBy("node").agg(F.sum("n").alias("links"))


def _counts(node, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n.astype(np.int64))], names=["node", "n"])


def near_duplicates(vectors: DataFrame, rules: DescentRules = DescentRules(), id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall): one row per vector."""
    rows, nodes = nodes_of(vectors, id_col, vector_col, label_col)
    edges, recall = _search(nodes, rules)
    members = materialise(connected_components(edges), "members")
    links = count_links(nodes, members, rules)
    rooted = nodes.join(members, "node", "left").withColumn("root", F.coalesce("component", "node")).join(links, "node", "left")
    rooted = materialise(rooted.select("h1", "h2", "root", "least", "copies", F.coalesce("links", F.lit(0)).alias("links")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("name"))
    named = materialise(rooted.join(names, "root").select(
        "h1", "h2", (F.col("links") + F.col("copies") - 1).alias("links"), "name", F.lit(True).alias("ok")), "named")
    joined = rows.join(named, ["h1", "h2", "ok"], "left")
    component = F.when(F.col("ok"), F.coalesce("name", "vec_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))
