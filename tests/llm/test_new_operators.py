"""Merkle manifest, integer clustering and wavelet shards against plain versions."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import integer_kmeans as K
from topicloom.llm import merkle as M
from topicloom.llm import wavelet as W
from topicloom.llm.common import id_crc
from topicloom.plans.execution import scratch_path

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """What op11 returns, with whole trees in memory and every run hashed anew."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes: list[str]) -> list[list[str]]:
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def runs(levels: list[list[str]], i: int) -> list[tuple[list[str], int]]:
        found = []
        for level in levels[:-1]:
            found.append((level[i // 3 * 3:i // 3 * 3 + 3], i % 3))
            i //= 3
        return found

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    result = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            path = runs(trees[s], i) + runs(top, k)
            proof = sha("".join(x for run, j in path for m, x in enumerate(run) if m != j))
            even = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
            now = leaf((*r[:4], r[4].replace("\n", ""))) if even and r[4] is not None else leaf(r)
            for run, j in path:
                now = sha("".join(now if m == j else x for m, x in enumerate(run)))
            result.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return result


def manifest_of(docs):
    tampered = F.when(id_crc() % 2 == 0, M.leaf_digest(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return M.fold(M.build_manifest(docs, replacement=tampered))


def same(got, want) -> bool:
    return sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 243, 244, 800])
def test_manifest_of_every_size(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 % 1000, rng.choice(["a", "a", "b", "é", None]) if n > 10 else "a", "en", i, rng.choice(["x\ny", "", None, "abc"])) for i in range(n)]
    assert same(manifest_of(spark.createDataFrame(rows, DOCS)).collect(), plain_manifest(rows))


def test_manifest_edge_cases(spark):
    """Nulls everywhere, repeated rows and ids, an empty source name, many sources of one row, a very long text, clashing columns, no rows."""
    rows = [(1, "a", None, None, "t\n")] * 5 + [(1, "a", "en", 1, "u")] + [(None, None, None, None, None), (None, "a", "x", 2, ""), (2, "", "en", 1, "q\n")]
    rows += [(i, f"s{i}", "en", 1, "one\ntwo") for i in range(10, 30)] + [(4, "b", "en", 5, "word \n" * 300_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("clash") for n in ("leaf", "root", "base", "level", "pos", "row", "digest", "state", "place", "tie")})
    assert same(manifest_of(docs).collect(), plain_manifest(rows))
    assert manifest_of(docs.limit(0)).collect() == []
    assert M.build_manifest(docs.limit(0)).root is None


def test_manifest_states_are_resumable(spark):
    """What is kept beside a child is the hash state before its slot: siblings to its left are not needed."""
    rows = [(i, "a", "en", 1, str(i)) for i in range(30)]
    manifest = M.build_manifest(spark.createDataFrame(rows, DOCS))
    nodes = manifest.documents.stages[0].where("level = 0").orderBy("pos").collect()
    parents = {r["pos"]: r["digest"] for r in manifest.documents.stages[0].where("level = 1").collect()}
    state = lambda r: np.frombuffer(r["state"], ">u4").astype(np.uint32)[None]
    digest = lambda r: np.frombuffer(r["digest"], ">u4").astype(np.uint32)[None]
    for r in nodes:
        run = [x for x in nodes if x["pos"] // 3 == r["pos"] // 3]
        now = state(r)
        for x in run[r["pos"] % 3:]:
            now = M.absorb(now, digest(x))
        assert M.finish(now, np.array([len(run)])).astype(">u4").tobytes() == bytes(parents[r["pos"] // 3])


def test_sha256_against_the_library():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(60)), ">u4").astype(np.uint32).reshape(20, 3, 8)
    for count in (1, 2, 3):
        state = np.broadcast_to(M.START, (20, 8)).copy()
        for k in range(count):
            state = M.absorb(state, digests[:, k])
        got = M.text_of(M.finish(state, np.full(20, count))).to_pylist()
        want = [sha("".join(M.text_of(digests[i, :count]).to_pylist())) for i in range(20)]
        assert got == want


# ---- clustering

def plain_kmeans(rows, k=8, rounds=10, dimensions=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda i: sha(f"3:{'' if i is None else i}")
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        to = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(x) for x in zip(*[v for (_, v), t in zip(kept, to, strict=True) if t == j], strict=True)] if j in to else c
                     for j, c in enumerate(centroids)]
    last = [nearest(v) for _, v in kept]
    inertia = {j: sum(d for d, t in last if t == j) for _, j in last}
    return [(i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, centroids[j])))) for (i, _), (d, j) in zip(kept, last, strict=True)]


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(5, 64))
    rows = [(i, [float(np.float32(x)) for x in base[i % 5] * (0.1 if i % 3 else 1) + 0.05 * rng.normal(size=64)]) for i in range(400)]
    rows += [(1, rows[1][1])] * 20 + [(None, rows[2][1]), (7000, None), (7001, []), (7002, [1.0] * 63), (7003, [1.0] * 63 + [None])]
    rows += [(7004, [1.0] * 63 + [float("nan")]), (7005, [0.0] * 64), (7006, [0.0] * 64), (7007, [1.0] * 100_000), (7008, [float("inf")] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit("clash") for n in ("v", "cluster", "distance", "n", "sums")})
    assert same(K.cluster_vectors(vectors).collect(), plain_kmeans(rows))


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert same(K.cluster_vectors(vectors).collect(), plain_kmeans(rows))
    assert K.cluster_vectors(vectors.limit(0)).collect() == []
    with pytest.raises(Exception, match="after scaling"):
        K.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


@pytest.mark.parametrize("spread", [1, 3, 300, 8_000_000])
def test_search_equals_all_distances(spread):
    """Ties between equal centroids and equal distances, and values near the limit."""
    rng = np.random.default_rng(spread)
    centroids = rng.integers(-spread, spread + 1, (40, 64))
    centroids[7] = centroids[3]
    vectors = np.concatenate([rng.integers(-spread, spread + 1, (300, 64)), centroids, np.zeros((1, 64), np.int64)])
    best, least, _ = K.MeanOrder(centroids).nearest(vectors)
    apart = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()


def test_search_rejects_without_measuring():
    rng = np.random.default_rng(1)
    centroids = np.repeat(np.arange(0, 50_000, 500), 64).reshape(-1, 64) + rng.integers(-9, 9, (100, 64))
    vectors = centroids[rng.integers(0, 100, 1000)] + rng.integers(-9, 9, (1000, 64))
    _, _, measured = K.MeanOrder(centroids).nearest(vectors)
    assert measured < 2.5 * len(vectors)
    centroids = np.zeros((100, 64), np.int64)
    centroids[:, 0], centroids[:, 1] = np.arange(100) * 500, -np.arange(100) * 500  # equal means: only the deviation tells them apart
    _, _, measured = K.MeanOrder(centroids).nearest(centroids)
    assert measured < 60 * len(centroids)


# ---- tokens

@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as source:
        return source.read()


@pytest.mark.parametrize(("high", "n"), [(1, 10), (3, W.BLOCK_BITS), (5, 1000), (50_257, 200_000), (1 << 20, 70_000)])
def test_wavelet_matrix_against_the_ids(high, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n).astype(np.uint32)
    shard = W.Shard(io.BytesIO(W.pack_shard(ids, [1, None], np.array([3, n]))), cached=5)
    assert (shard.ids() == ids).all() and shard.present.tolist() == [True, False] and shard.starts.tolist() == [0, 3]
    assert all(shard.access(int(i)) == ids[i] for i in [0, n - 1, *rng.integers(0, n, 30)])
    for token in {int(ids[0]), int(ids[-1]), 0, 1, high + 5}:
        at = np.flatnonzero(ids == token)
        assert shard.count(token) == len(at)
        assert all(shard.rank(token, k) == (ids[:k] == token).sum() for k in (0, 1, n // 3, n - 1, n, n + 9))
        assert all(shard.select(token, j) == at[j] for j in {0, len(at) // 2, len(at) - 1} if len(at))
        with pytest.raises(IndexError):
            shard.select(token, len(at))
    if n == 1000:
        assert shard.occurrences(2) == np.flatnonzero(ids == 2).tolist()


def test_lookup_reads_little_of_the_file():
    class Counting(io.BytesIO):
        total = 0

        def read(self, size=-1):
            Counting.total += size
            return super().read(size)

    ids = np.random.default_rng(0).integers(0, 50_000, 2_000_000).astype(np.uint32)
    data = W.pack_shard(ids, [1], np.array([len(ids)]))
    shard = W.Shard(Counting(data))
    shard.access(1_234_567)
    assert Counting.total < len(data) / 15


@pytest.mark.parametrize(("kept", "window"), [(50, 64), (1_000_000, 7), (1_000_000, 1 << 23)])
def test_units_encode_like_the_whole(tokenizer, kept, window):
    tokenizers = pytest.importorskip("tokenizers")
    encoder = tokenizers.Tokenizer.from_str(tokenizer)
    units = W.Encoder(tokenizer, kept=kept)
    assert W.cuts_safely(tokenizer)
    for seed in range(8):
        rng = random.Random(seed)
        letters = list("ab,.'-tsre c\n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u2003\u200b\u2028\u3000'sé×÷日😀1!  (é.)\u0301") + ["<|endoftext|>", "don't", "  "]
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(60)] + ["", " ", "a\x1c", "\x1c", "a \u180e", "\u180e b", "é,", ""]
        want = [e.ids for e in encoder.encode_batch(texts, add_special_tokens=False)]
        ids, ends = units.encode(pa.array(["skipped", None, *texts]).slice(1), window)
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == [[], *want] and ends[-1] == len(ids)
    assert [len(x) for x in units.encode(pa.array([], pa.string()))] == [0, 0]


def test_shards_against_plain_encoding(spark, tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    encoder = tokenizers.Tokenizer.from_str(tokenizer)
    rng = random.Random(0)
    rows = [(i, "".join(rng.choices("the cat\n sat é日", k=rng.randint(0, 200)))) for i in range(300)]
    rows += [(None, "none"), (None, None), (500, "same"), (500, "same"), (501, None), (502, ""), (503, "long words " * 60_000), (504, "x" * 600_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("mark", "tie", "start", "shard", "name")})
    folder = scratch_path(spark, "wavelet")
    files = W.write_shards(docs.repartition(5), folder, tokenizer, shard_tokens=700)
    got = [tuple(r) for r in W.read_documents(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, start = [], 0
    for doc_id, text in order:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want and files.count() > 5
    found = W.find_tokens(files, folder, [0, 464]).groupBy("token").agg(F.sum("n").alias("n")).collect()
    assert {r["token"]: r["n"] for r in found}[0] >= len(rows)


def test_no_documents_no_files(spark, tokenizer):
    folder = scratch_path(spark, "wavelet")
    files = W.write_shards(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer)
    assert files.count() == 0 and W.read_documents(files, folder).collect() == []
