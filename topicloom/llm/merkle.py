"""Merkle manifest of a dataset as a tree of SHA-256 midstates (operator 11).

Every document is a leaf; inside a source the leaves ascend by id, and runs of three nodes become their parent until one node, the
source's subroot, is left; the subroots, ordered by source, likewise become the root.  A parent hashes the hex text of its children's
digests, 64 bytes each: one block of SHA-256.  So the hash state before each child's slot is eight words, and the manifest keeps it beside
the child.  To fold a changed document the matching state is resumed with the changed digest and the siblings to its right; what stands
to its left is in the state already and is not read.

A task builds five levels of blocks of at most 243 leaves (vectorised over many blocks); block roots are the leaves of the next
stage, so a tree over n documents takes log3(n) / 5 stages whatever the size of a source.  Folding goes the other way: the path above a
block (states and siblings of every level) is computed once for each block and met by its leaves in one exchange.  Nothing but the root
comes to the driver.

Defined cases: a null in any column is hashed as ``-``, an empty text as ``0:``; null ids and the null source come first; equal ids are ordered by their
digest, rows equal in all columns have equal leaves, neighbouring places and a proof each; a source of one document has its leaf as subroot; a text of
any length is hashed whole; an empty table gives no rows and no root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import materialise
from topicloom.plans.execution import lookup_join

FANOUT = 3
LEVELS = 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# what a node's place in its run says, and what a fold needs of a level: the state before the slot and the siblings from left to right
STEP = np.dtype([("count", "u1"), ("slot", "u1"), ("", "u2"), ("state", "u4", 8), ("side", "u4", (FANOUT - 1, 8))])


# ---- SHA-256 over columns of words

def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** 3 <= x else (low, middle - 1)
    return low


# the first 32 fractional bits of square and cube roots of the first primes, as the standard defines them
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One block into each state: (n, 8) and (n, 16) words."""
    words = list(np.ascontiguousarray(block.T))
    a, b, c, d, e, f, g, h = np.ascontiguousarray(state.T)
    for i in range(64):
        if i >= 16:
            near, far = words[i - 2], words[i - 15]
            words.append(words[i - 16] + (_turn(far, 7) ^ _turn(far, 18) ^ (far >> np.uint32(3))) + words[i - 7]
                         + (_turn(near, 17) ^ _turn(near, 19) ^ (near >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + words[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_bytes(words: np.ndarray) -> np.ndarray:
    """The hex text of digests, (n, 64) bytes, from (n, 8) words."""
    raw = words.astype(">u4").view(np.uint8).reshape(len(words), 32)
    text = np.empty((len(words), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[raw >> 4], HEX[raw & 15]
    return text


def absorb(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The states after one more child."""
    return compress(state, hex_bytes(digest).view(">u4").astype(np.uint32))


def finish(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The digests of parents that have absorbed ``count`` children."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0], last[:, 15] = 1 << 31, count.astype(np.uint32) * 512
    return compress(state, last)


def words_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(n, 8) words of a column of 32-byte digests; a null is zeros."""
    raw = b"".join(bytes(32) if x is None else x for x in column.to_pylist())
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


def binary_of(words: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    raw = words.astype(">u4").view("S32").ravel() if len(words) else np.empty(0, "S32")
    rows = [bytes(w).ljust(32, b"\0") for w in raw]  # numpy drops trailing zero bytes
    return pa.array(rows if present is None else [r if p else None for r, p in zip(rows, present, strict=True)], pa.binary())


def text_of(words: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().decode() for row in hex_bytes(words)], pa.string())


# ---- numbering and the tree

def leaf_digest(columns=COLUMNS, **changed: Column) -> Column:
    """Hex digest of a row's columns; ``changed`` replaces columns by other expressions."""
    parts = []
    for name in columns:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``row``: the place of each row in the global order, from range partitions and one running sum over their sizes."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    stored = materialise(sorted_rows, "ordered").withColumn("_part", F.shiftright("_m", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = stored.groupBy("_part").agg(F.count("*").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_before") + inside).drop("_m", "_part", "_before")


def depth_of(count: str) -> Column:
    """How many levels stand above the leaves of a tree of so many leaves."""
    powers = F.array(*[F.lit(FANOUT ** i).cast("long") for i in range(40)])
    return F.size(F.filter(powers, lambda power: power < F.col(count))).cast("int")


NODE = "base long, depth int, level int, pos long, digest binary, state binary, doc_id long, replacement binary"


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a block ends, from batches sorted by (base, block)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        base, block = rows["base"].to_numpy(), rows["block"].to_numpy()
        cut = int(np.flatnonzero((base != base[-1]) | (block != block[-1]))[-1]) + 1 if base[0] != base[-1] or block[0] != block[-1] else 0
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def build_levels(first: int):
    """Rows of blocks of nodes at level ``first`` -> the same nodes with the state before their slot, and the levels above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            base, depth, pos = (rows[c].to_numpy() for c in ("base", "depth", "pos"))
            digest, doc_id, replacement = words_of(rows["digest"]), rows["doc_id"].combine_chunks(), rows["replacement"].combine_chunks()
            for level in range(first, first + LEVELS + 1):
                block = pos // FANOUT ** (first + LEVELS - level)
                rising = (depth > level) & (level < first + LEVELS)
                state = np.zeros((len(pos), 8), np.uint32)
                heads = np.flatnonzero(_changes(base, block, pos // FANOUT) & rising)
                runs = np.flatnonzero(_changes(base, block, pos // FANOUT))
                count = np.diff(np.append(runs, len(pos)))[np.isin(runs, heads)]
                now = np.broadcast_to(START, (len(heads), 8)).copy()
                for slot in range(FANOUT):
                    has = np.flatnonzero(count > slot)
                    if len(has):
                        state[heads[has] + slot] = now[has]
                        now[has] = absorb(now[has], digest[heads[has] + slot])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(base), pa.array(depth), pa.array(np.full(len(pos), level, np.int32)), pa.array(pos), binary_of(digest),
                     binary_of(state, rising), doc_id, replacement],
                    names=["base", "depth", "level", "pos", "digest", "state", "doc_id", "replacement"])
                if not len(heads):
                    break
                base, depth, pos, digest = base[heads], depth[heads], pos[heads] // FANOUT, finish(now, count)
                doc_id, replacement = pa.nulls(len(pos), pa.int64()), pa.nulls(len(pos), pa.binary())

    return run


def block_of(first: int) -> Column:
    """The block of a node of the stage that starts at level ``first``."""
    return F.expr(f"pos div cast(pow({FANOUT}, {first + LEVELS} - level) as long)")


@dataclass
class Tree:
    """``stages[i]`` holds the nodes from level 5i to 5i + 5; a node without a state is the last of its block in that stage."""

    stages: list[DataFrame]

    def tops(self) -> DataFrame:
        """(base, digest): what remains of each tree."""
        parts = [s.where((F.col("level") == F.col("depth"))).select("base", "depth", "digest") for s in self.stages]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found


def grow(leaves: DataFrame) -> Tree:
    """Trees over (base, depth, pos, digest, doc_id, replacement), one for each base, in stored stages."""
    nodes, stages = leaves.withColumn("level", F.lit(0)), []
    highest = leaves.agg(F.max("depth")).first()[0] or 0
    for first in range(0, max(highest, 1), LEVELS):
        blocks = nodes.withColumn("block", F.expr(f"pos div {FANOUT ** LEVELS}"))
        dealt = blocks.repartition("base", "block").sortWithinPartitions("base", "block", "pos")
        stages.append(materialise(dealt.mapInArrow(build_levels(first), NODE), "merkle"))
        nodes = stages[-1].where((F.col("level") == first + LEVELS) & (F.col("level") < F.col("depth"))).drop("state")
    return Tree(stages)


@dataclass
class Manifest:
    documents: Tree
    sources: Tree
    root: str | None


def build_manifest(docs: DataFrame, columns=COLUMNS, id_col: str = "doc_id", source_col: str = "source",
                   replacement: Column | None = None) -> Manifest:
    """Leaves, nodes with their states, and the root.  ``replacement``: hex digest of what a row is to be folded with, null for its own leaf."""
    own = F.col(source_col).cast("string")
    slim = docs.select(
        F.coalesce(F.concat(F.lit("s"), own), F.lit("")).alias("place"), F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(leaf_digest(columns)).alias("digest"),
        (F.lit(None).cast("binary") if replacement is None else F.unhex(replacement)).alias("replacement"),
        F.monotonically_increasing_id().alias("tie"))
    rows = number_rows(materialise(slim, "leaves"), ["place", "doc_id", "digest", "tie"])
    # a source is known by the row it starts at, which keeps their order
    groups = materialise(rows.groupBy("place").agg(F.min("row").alias("base"), F.count("*").alias("n")).withColumn("depth", depth_of("n")), "sources")
    leaves = lookup_join(rows, groups.select("place", "base", "depth"), ["place"], stored=True).select(
        "base", "depth", (F.col("row") - F.col("base")).alias("pos"), "digest", "doc_id", "replacement")
    documents = grow(leaves)
    tops = number_rows(documents.tops().select("base", "digest"), ["base"])
    n = tops.count()
    top_leaves = tops.withColumn("n", F.lit(n).cast("long")).select(
        F.lit(0).cast("long").alias("base"), depth_of("n").alias("depth"), F.col("row").alias("pos"), "digest", F.col("base").alias("doc_id"),
        F.lit(None).cast("binary").alias("replacement"))
    sources = grow(top_leaves)
    last = sources.tops().first()  # one row
    return Manifest(documents, sources, None if last is None else bytes(last["digest"]).hex())


# ---- folding

def steps_of(rows: pa.Table, first: int) -> tuple:
    """Paths of the leaves of whole blocks: (leaf row numbers, steps (leaf, level), used levels, group of each leaf, subroots).

    Each block opens with one row of level -1 that holds the path above it.
    """
    level, pos = rows["level"].to_numpy(), rows["pos"].to_numpy()
    heads = np.flatnonzero(level < 0)
    group = np.cumsum(level < 0) - 1
    above = [np.frombuffer(p, STEP) for p in rows["path"].take(pa.array(heads)).to_pylist()]
    digest, state = words_of(rows["digest"]), words_of(rows["state"])
    top = rows["state"].is_null().to_numpy() & (level >= 0)

    segments = _changes(group, level)
    starts = np.flatnonzero(segments)
    segment = np.cumsum(segments) - 1
    run = np.cumsum(_changes(group, level, pos // FANOUT)) - 1
    count = np.bincount(run)[run]
    slot = np.where(top, 0, pos % FANOUT)
    at = np.arange(len(pos))
    step = np.zeros(len(pos), STEP)
    step["count"], step["slot"], step["state"] = count, slot, state
    for j in range(FANOUT - 1):
        beside = at - slot + j + (j >= slot)
        has = (j < count - 1) & ~top
        step["side"][has, j] = digest[beside[has]]

    leaves = np.flatnonzero(level == first)
    owner = group[leaves]
    high = np.array([len(a) for a in above])[owner]
    local = np.zeros(len(heads), np.int64)
    np.maximum.at(local, group[level >= 0], level[level >= 0] - first)
    low = local[owner]
    path = np.zeros((len(leaves), int((low + high).max(initial=0))), STEP)
    now = leaves.copy()
    for k in range(int(low.max(initial=0))):
        going = np.flatnonzero(low > k)
        path[going, k] = step[now[going]]
        following = starts[segment[now[going]] + 1]
        now[going] = following + pos[now[going]] // FANOUT - pos[following]
    for g, own in enumerate(np.split(np.arange(len(leaves)), np.flatnonzero(np.diff(owner)) + 1) if len(leaves) else []):
        path[own, local[owner[own[0]]]:local[owner[own[0]]] + len(above[owner[own[0]]])] = above[owner[own[0]]]
    return leaves, path, low + high, rows["subroot"].take(pa.array(heads[owner]))


def fold_up(digest: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The roots that digests lead to: each level resumes the state before the slot with the digest and the siblings to its right."""
    now = digest.copy()
    for k in range(path.shape[1]):
        going = np.flatnonzero(path["count"][:, k] > 0)
        step = path[going, k]
        state = absorb(step["state"], now[going])
        for j in range(FANOUT - 1):
            right = np.flatnonzero((j >= step["slot"]) & (j < step["count"].astype(int) - 1))
            if len(right):
                state[right] = absorb(state[right], step["side"][right, j])
        now[going] = finish(state, step["count"])
    return now


def proofs(path: np.ndarray) -> list[str]:
    """Digest of the siblings of each path, level by level, left to right."""
    n, levels = path.shape
    text = hex_bytes(path["side"].reshape(-1, 8)).reshape(n, levels * (FANOUT - 1), 64)
    used = (np.arange(FANOUT - 1) < path["count"][:, :, None].astype(int) - 1).reshape(n, -1)
    return [hashlib.sha256(text[i, used[i]].tobytes()).hexdigest() for i in range(n)]


PATH = "base long, pos long, doc_id long, path binary, subroot binary"
FOLDED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def emit_paths(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_blocks(batches):
            leaves, path, used, subroot = steps_of(rows, first)
            take = pa.array(leaves)
            own = rows["subroot"].combine_chunks() if not len(leaves) else subroot.combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [rows["base"].take(take).combine_chunks(), rows["pos"].take(take).combine_chunks(), rows["doc_id"].take(take).combine_chunks(),
                 pa.array([path[i, :used[i]].tobytes() for i in range(len(leaves))], pa.binary()), own],
                names=["base", "pos", "doc_id", "path", "subroot"])

    return run


def emit_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_blocks(batches):
        leaves, path, _, subroot = steps_of(rows, 0)
        take = pa.array(leaves)
        digest, changed = words_of(rows["digest"].take(take)), rows["replacement"].take(take)
        start = np.where(changed.is_null().to_numpy()[:, None], digest, words_of(changed))
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"].take(take).combine_chunks(), text_of(digest), text_of(words_of(subroot)), pa.array(proofs(path), pa.string()),
             text_of(fold_up(start, path))],
            names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def descend(tree: Tree, over: DataFrame, last=None) -> DataFrame:
    """Paths of the leaves of a tree, from the paths ``over`` (base, path, subroot) of its tops; ``last`` maps the lowest blocks, or paths are returned."""
    above = None
    for i in range(len(tree.stages) - 1, -1, -1):
        first = i * LEVELS
        nodes = tree.stages[i].withColumn("block", block_of(first)).select(
            "base", "block", "level", "pos", "digest", "state", F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("subroot"),
            "doc_id", "replacement")
        ended = tree.stages[i].where("level = depth").select("base").join(over, "base").select(
            "base", F.lit(0).cast("long").alias("block"), "path", "subroot")
        heads = ended if above is None else ended.unionByName(above.select("base", F.col("pos").alias("block"), "path", "subroot"))
        heads = heads.select("base", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                             F.lit(None).cast("binary").alias("state"), "path", "subroot", F.lit(None).cast("long").alias("doc_id"),
                             F.lit(None).cast("binary").alias("replacement"))
        dealt = nodes.unionByName(heads).repartition("base", "block").sortWithinPartitions("base", "block", "level", "pos")
        if i == 0 and last is not None:
            return dealt.mapInArrow(last, FOLDED)
        above = materialise(dealt.mapInArrow(emit_paths(first), PATH), "paths")
    return above


def fold(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document."""
    whole = manifest.documents.stages[0].sparkSession.createDataFrame([(0, b"", b"")], "base long, path binary, subroot binary")
    tops = manifest.documents.tops().select("base", F.col("digest").alias("subroot"))
    over = descend(manifest.sources, whole).select(F.col("doc_id").alias("base"), "path").join(tops, "base")
    folded = descend(manifest.documents, materialise(over, "subroots"), emit_folds)
    root = F.lit(manifest.root)
    return folded.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
