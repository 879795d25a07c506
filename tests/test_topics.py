from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import blobs, documents
from topicloom.operators import analytics as A
from topicloom.operators import clustering as D
from topicloom.operators import density as N
from topicloom.operators import keywords as K
from topicloom.operators import labels as L
from topicloom.operators import model_jobs as I
from topicloom.operators import search as H
from topicloom.operators import sentiment as E
from topicloom.operators import similarity as S
from topicloom.operators import terms as M
from topicloom.plans import execution as X
from topicloom.plans import topic_run as R


def vectors(spark, data):
    return spark.createDataFrame([(i, v, t) for i, v, t in data], "doc_id bigint, embedding array<float>, topic int")


def assignment(spark, topics):
    return spark.createDataFrame(list(enumerate(topics)), "doc_id bigint, topic int")


# --- helpers ----------------------------------------------------------------------------------

def test_lookup_join_paths_agree(spark, rows):
    big = spark.range(300).select("id", F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 7).alias("k"))
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k bigint, v string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        want = rows(big.join(small, "k", how), "id")
        assert rows(X.lookup_join(big, small, ["k"], how), "id") == want
        assert rows(X.lookup_join(big, small, ["k"], how, max_rows=2), "id") == want
        assert rows(X.lookup_join(big, small, ["k"], how, max_rows=2, hot=F.col("k") == 1), "id") == want


def test_lookup_join_past_the_bound_neither_broadcasts_nor_repeats_the_lookup(spark):
    big = spark.range(300).select("id", (F.col("id") % 7).alias("k"))
    small = X.materialise(spark.range(5).select(F.col("id").alias("k"), F.lit("v").alias("v")))  # a few hundred bytes: Spark would broadcast it
    plan = X.lookup_join(big, small, ["k"], max_rows=2, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "explode" not in plan
    hot = X.lookup_join(big, small, ["k"], max_rows=2, stored=True, hot=F.col("k") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in hot


def test_top_k_with_and_without_salt(spark, rows):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("x"))
    want = rows(X.top_k(df, ["k"], [F.col("x")], 5))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        assert rows(X.top_k(df, ["k"], [F.col("x")], 5)) == want
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_rows_at_ranks(spark):
    ids = [int(x) for x in np.random.default_rng(1).permutation(5000)[:900]]
    df = spark.createDataFrame([(0 if i % 4 else 1, v) for i, v in enumerate(ids)], "topic int, doc_id bigint")
    targets = spark.createDataFrame([(0, 0), (0, 13), (0, 674), (1, 100), (1, 5000)], "topic int, pos bigint")
    got = {(r["topic"], r["pos"]): r["doc_id"] for r in X.rows_at_ranks(df, "topic", "doc_id", targets, buckets=8).collect()}
    own = {t: sorted(r["doc_id"] for r in df.where(F.col("topic") == t).collect()) for t in (0, 1)}
    assert got == {(0, 0): own[0][0], (0, 13): own[0][13], (0, 674): own[0][674], (1, 100): own[1][100]}


# --- analytics --------------------------------------------------------------------------------

def test_balance_thresholds(spark):
    exact = assignment(spark, [0] * 30 + [1] * 25 + [2] * 25 + [3] * 20)
    assert A.balance(exact).first()["balanced"] is True
    skewed = assignment(spark, [0] * 61 + [1] * 20 + [2] * 19 + [-1] * 10)
    over = A.oversized_topics(skewed).collect()
    assert [(r["topic"], r["suggested_splits"]) for r in over] == [(0, 3)]
    assert A.balance(skewed).first()["outlier_ratio"] == pytest.approx(10 / 110, abs=1e-6)


def test_summary_counts_topics_not_documents(spark):
    row = A.topic_summary(assignment(spark, [0, 0, 1, -1])).first()
    assert (row["documents"], row["topics"], row["outliers"], row["coverage"]) == (4, 2, 1, 75.0)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "doc_id bigint, topic int")
    assert A.topic_distribution(empty).count() == 0
    assert A.balance(empty).first()["balanced"] is False


# --- merging and splitting --------------------------------------------------------------------

def brute_merge(data, min_size):
    topics = np.array([t for _, _, t in data])
    vecs = np.array([v for _, v, _ in data])
    counts = {t: int((topics == t).sum()) for t in set(topics) if t != -1}
    mean = {t: vecs[topics == t].mean(0) for t in counts if np.any(vecs[topics == t])}
    to = {}
    for t, n in counts.items():
        if n < min_size and t in mean:
            large = [u for u in mean if u != t and counts[u] >= min_size]
            cos = lambda u: mean[t] @ mean[u] / np.linalg.norm(mean[t]) / np.linalg.norm(mean[u])
            if large:
                to[t] = max(sorted(large), key=cos)
    merged = [to.get(t, t) for t in topics]
    order = {t: i for i, t in enumerate(sorted({t for t in merged if t != -1}))}
    return [order.get(t, -1) for t in merged] if any(n < min_size for n in counts.values()) else list(topics)


@pytest.mark.parametrize("seed, sizes", [(0, [12, 11, 3, 2]), (1, [2, 3]), (2, [12, 12]), (3, [15, 1, 1, 20, 4])])
def test_merge_small_matches_brute_force(spark, seed, sizes):
    rng = np.random.default_rng(seed)
    data, at = [], 0
    for t, n in enumerate(sizes):
        for _ in range(n):
            data.append((at, [float(x) for x in rng.normal(size=4) + t], t * 2))
            at += 1
    data += [(at + i, [0.0] * 4, 99) for i in range(2)] + [(at + 5, [1.0] * 4, -1)]
    got = {r["doc_id"]: r["topic"] for r in D.merge_small(vectors(spark, data), 10).collect()}
    assert [got[i] for i, _, _ in data] == brute_merge(data, 10)


def test_coherence_equals_pairwise_mean(spark):
    data = blobs(2, 12, 0)
    got = {r["topic"]: r["coherence"] for r in D.coherence(vectors(spark, data)).collect()}
    for t in (0, 1):
        m = np.array([v for _, v, g in data if g == t])
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        sims = u @ u.T
        assert got[t] == pytest.approx((sims.sum() - len(m)) / (len(m) * (len(m) - 1)), abs=1e-5)


def test_refine_splits_mixed_topic(spark):
    rng = np.random.default_rng(0)
    a, b = np.eye(6)[0] * 5, np.eye(6)[1] * 5
    data = [(i, [float(x) for x in (a if i % 2 else b) + rng.normal(size=6) * 0.1], 0) for i in range(20)]
    data += [(100 + i, [float(x) for x in np.eye(6)[2] * 3 + rng.normal(size=6) * 0.1], 1) for i in range(16)]
    got = {r["doc_id"]: r["topic"] for r in D.refine_topics(vectors(spark, data), min_coherence=0.6).collect()}
    assert {got[i] for i in got if i >= 100} == {1}
    odd, even = ({got[i] for i in got if i < 100 and i % 2 == r} for r in (1, 0))
    assert not odd & even and len(odd | even) in (2, 3) and 0 in odd | even


def test_split_by_sentiment_rules(spark):
    def rated(counts, topic, start):
        return [(start + i, topic, s) for i, s in enumerate(sum([[k] * n for k, n in counts.items()], []))]

    data = rated({"positive": 1, "negative": 1, "neutral": 3}, 0, 0)          # small: split, neutral apart
    data += rated({"positive": 15, "negative": 85}, 1, 100)                   # 15 % is not more than 15 %
    data += rated({"positive": 20, "negative": 60, "neutral": 20}, 2, 300)    # split, neutral with positive
    df = spark.createDataFrame(data, "doc_id bigint, topic int, sentiment string")
    got = {r["doc_id"]: r["topic"] for r in E.split_by_sentiment(df).collect()}
    assert [got[i] for i in range(5)] == [3, 4, 5, 5, 5]
    assert {got[100 + i] for i in range(100)} == {1}
    assert {got[300], got[399]} == {6} and got[340] == 7


def test_kmeans_and_zero_rows(spark):
    data = [(i, v, g) for i, v, g in blobs(3, 30, 0)] + [(999, [0.0] * 8, -1)]
    got = {r["doc_id"]: r["topic"] for r in D.kmeans(vectors(spark, data), 3).collect()}
    assert got[999] == -1
    groups = [{got[i] for i, _, g in data if g == k} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_zero_shot_clusters_the_rest(spark):
    data = blobs(4, 25, 0) + [(999, [0.0] * 8, -1)]
    named = spark.createDataFrame([(7, [float(x) for x in np.mean([v for _, v, g in data if g == 0], axis=0)])], "topic int, centroid array<double>")
    got = {r["doc_id"]: r["topic"] for r in D.zero_shot_topics(vectors(spark, data), named, 3, 0.9).collect()}
    assert len(got) == len(data) and got[999] == -1 and {got[i] for i, _, g in data if g == 0} == {7}
    assert {got[i] for i, _, g in data if g in (1, 2, 3)} <= {8, 9, 10}


def test_model_calls_end_in_time_and_in_lists(spark):
    df = spark.createDataFrame([(i, "hang" if i == 1 else f"prompt {i}") for i in range(4)], "topic int, prompt string")

    def slow():
        import time
        return lambda prompt, attempt: time.sleep(60) if prompt == "hang" else prompt.upper()

    got = {r["topic"]: (r["response"], r["tries"]) for r in I.apply_model(df, slow, attempts=2, timeout=0.3).collect()}
    assert got == {0: ("PROMPT 0", 1), 1: (None, 2), 2: ("PROMPT 2", 1), 3: ("PROMPT 3", 1)}
    lists = lambda: lambda prompts, attempt: [p.upper() if attempt or p != "prompt 2" else "" for p in prompts]
    got = {r["topic"]: (r["response"], r["tries"]) for r in I.apply_model(df, lists, batch_size=3).collect()}
    assert got == {0: ("PROMPT 0", 1), 1: ("HANG", 1), 2: ("PROMPT 2", 2), 3: ("PROMPT 3", 1)}


def test_seeded_kmeans_follows_seeds(spark):
    data = blobs(3, 30, 0)
    seeds = spark.createDataFrame([(0, data[65][1]), (1, data[5][1])], "seed_id int, embedding array<float>")
    got = {r["doc_id"]: r["topic"] for r in D.kmeans_seeded(vectors(spark, data), seeds, 2).collect()}
    assert len(set(got.values())) == 2 and min(got.values()) == 0


# --- density ----------------------------------------------------------------------------------

def test_density_finds_blobs_on_both_graph_paths(spark):
    data = blobs(4, 40, 25)
    found = {r["doc_id"]: r["topic"] for r in N.density_cluster(vectors(spark, data), 15).collect()}
    for g in range(4):
        own = [found[i] for i, _, t in data if t == g]
        assert max(own.count(x) for x in set(own)) >= 36
    assert sum(found[i] == -1 for i, _, t in data if t == -1) >= 15
    sizes = [list(found.values()).count(t) for t in set(found.values()) if t != -1]
    assert min(sizes) >= 15


def test_sentiment_first_keeps_groups_apart(spark):
    data = blobs(2, 40, 0)
    mood = ["positive", "negative"]
    rated = [(i, mood[i % 2]) for i, _, _ in data] + [(900 + i, "neutral") for i in range(4)]
    rows = [(i, v) for i, v, _ in data] + [(900 + i, data[i][1]) for i in range(4)]
    found = R.sentiment_first(spark.createDataFrame(rows, "doc_id bigint, embedding array<float>"),
                              spark.createDataFrame(rated, "doc_id bigint, sentiment string"), 20)
    topics = {r["doc_id"]: r["topic"] for r in found.collect()}
    by_mood = {m: {topics[i] for i, x in rated if x == m} - {-1} for m in ("positive", "negative", "neutral")}
    assert max(by_mood["positive"]) < min(by_mood["negative"]) <= max(by_mood["negative"]) < min(by_mood["neutral"])
    every = sorted(set().union(*by_mood.values()))
    assert every == list(range(len(every)))
    for g in (0, 1):  # one blob of one mood is one topic
        own = [topics[i] for i, _, t in data if t == g and i % 2 == 0]
        assert max(own.count(x) for x in set(own)) >= 16


def test_grouped_density_equals_one_run_per_group(spark):
    small = blobs(3, 40, 25)
    large = [(10_000 + i, [50 * x for x in v], g) for i, v, g in blobs(3, 30, 15, seed=5)]
    rows = [(i, v, "small") for i, v, _ in small] + [(i, v, "large") for i, v, _ in large]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, kind string")

    def parts(found):
        topics = {}
        for r in found.collect():
            topics.setdefault(r["topic"], set()).add(r["doc_id"])
        outliers = topics.pop(-1, set())
        return {frozenset(x) for x in topics.values()}, outliers

    together, outside = parts(N.density_cluster(df, 12, group="kind"))
    one, out_one = parts(N.density_cluster(df.where("kind = 'small'"), 12))
    two, out_two = parts(N.density_cluster(df.where("kind = 'large'"), 12, small_graph=0))
    assert together == one | two and outside == out_one | out_two and len(one) == 3


def random_edges(seed: int, n: int, k: int, digits: int) -> list[tuple]:
    """Edges of the k nearest of each point in two groups; few digits make equal distances."""
    rng = random.Random(seed)
    points = [(rng.gauss(4 * rng.randrange(4), 1), rng.gauss(0, 1)) for _ in range(n)]
    edges = set()
    for g, (low, high) in {"a": (0, n // 2), "b": (n // 2, n)}.items():
        for i in range(low, high):
            near = sorted((round(((points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2) ** 0.5, digits), j) for j in range(low, high) if j != i)
            edges |= {(min(i, j), max(i, j), d, g) for d, j in near[:k]}
    return sorted(edges) + [(n + 1, n + 2, 0.0, "c")]


def tree_of(points, clusters):
    """A condensed tree without its numbering: clusters by their members, points by the cluster they lie in."""
    over, members = {c[0]: c[1] for c in clusters}, {}
    for node, c, _ in points:
        while c in over:
            members.setdefault(c, set()).add(node)
            c = over[c]
    name = {c: (min(m), len(m)) for c, m in members.items()}
    return (sorted((name[c[0]], name.get(c[1], ()), round(c[2], 9), c[3], c[4], round(c[5], 6), round(c[6], 9)) for c in clusters),
            sorted((n, name.get(c, ()), -1 if fall is None else round(fall, 9)) for n, c, fall in points))


@pytest.mark.parametrize(("seed", "n", "k", "digits"), [(1, 500, 8, 9), (2, 300, 8, 1)])
def test_condensed_tree_equals_plain_single_linkage(spark, seed, n, k, digits):
    """Distributed path only against merges one by one; the last case has many equal distances, and group c is smaller than its least size."""
    from topicloom.operators import forest
    edges, sizes = random_edges(seed, n, k, digits), {"a": 5, "b": 9, "c": 3}
    table = spark.createDataFrame(edges, "a bigint, b bigint, w double, g string")
    points, clusters = forest.condensed_tree(table, spark.createDataFrame(list(sizes.items()), "g string, cluster_size bigint"))
    clusters = [tuple(r) for r in clusters.collect()]
    plain = forest.plain_tree([dict(zip("abwg", e)) for e in edges], sizes)
    assert tree_of([tuple(r) for r in points.collect()], clusters) == tree_of(*plain)
    for leaf in (False, True):
        given = spark.createDataFrame(clusters, forest.CLUSTERS).withColumn("leaf", F.lit(leaf))
        few, many = (sorted(tuple(r) for r in forest.select_clusters(given, small).collect()) for small in (200_000, 0))
        assert few == many and len({r[1] for r in few}) > 3
        parents = {c[1] for c in clusters}
        if leaf:
            assert {r[1] for r in few} - {None} == {c[0] for c in clusters if c[0] not in parents}


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    """300 clusters split off one after the other, and a random tree: decided as on the driver, in rounds that follow the logarithm of their number."""
    from topicloom.operators import forest
    rng = random.Random(5)
    deep = [(1, None)] + [(i, (i - 1) // 2 * 2 - 1 if i > 3 else 1) for i in range(2, 602)]
    wide = [(1000, None)] + [x for i in range(1, 150) for x in ((1000 + 2 * i - 1, 999 + i), (1000 + 2 * i, 999 + i))]
    stored, real = [], forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df, name="table": stored.append(name) or real(df, name))
    for leaf in (False, True):
        rows = [(c, p, 0.0, g, 9, round(rng.random() * 2 ** (rng.random() * 8), 6), 1.0) for g, tree in (("a", deep), ("b", wide)) for c, p in tree]
        given = spark.createDataFrame(rows, forest.CLUSTERS).withColumn("leaf", F.lit(leaf))
        few = sorted((tuple(r) for r in forest.select_clusters(given).collect()), key=lambda r: r[0])
        stored.clear()
        many = sorted((tuple(r) for r in forest.select_clusters(given, 0).collect()), key=lambda r: r[0])
        assert few == many and len({r[1] for r in few}) > 20
        assert len(stored) < 40


def test_plain_tree_by_hand():
    """Two groups of three at distances 1 and 2, joined at 10, and a straggler at 4 on the second."""
    from topicloom.operators import forest
    edges = [(1, 2, 1.0), (2, 3, 1.0), (4, 5, 2.0), (5, 6, 2.0), (6, 7, 4.0), (3, 4, 10.0)]
    points, clusters = forest.plain_tree([{"a": a, "b": b, "w": w, "g": ""} for a, b, w in edges], {"": 3})
    by_id = {c[0]: c for c in clusters}
    root = next(c for c in clusters if c[1] is None)
    assert root[2] == 0 and root[4] == 7 and root[5] == pytest.approx(0.7)
    inner = {p[0]: (by_id[p[1]][2], p[2]) for p in points}
    assert inner == {**{i: (0.1, 1.0) for i in (1, 2, 3)}, **{i: (0.1, 2.0) for i in (4, 5, 6)}, 7: (0.1, 4.0)}
    values = sorted((c[4], round(c[5], 9), c[6]) for c in clusters if c[1] is not None)
    assert values == [(3, round(3 * (1 - 0.1), 9), 1.0), (4, round(3 * (0.5 - 0.1) + 0.25 - 0.1, 9), 0.5)]


def test_probability_is_the_level_in_the_cluster(spark):
    data = blobs(3, 40, 25)
    for small_graph in (200_000, 0):
        rows = N.density_cluster(vectors(spark, data), 15, probability=True, small_graph=small_graph).collect()
        assert all(r["probability"] == 0 if r["topic"] == -1 else 0 < r["probability"] <= 1 for r in rows)
        for topic in {r["topic"] for r in rows} - {-1}:
            assert max(r["probability"] for r in rows if r["topic"] == topic) == 1


def test_subtopics_of_all_topics_equal_one_run_each(spark):
    first, second, few = blobs(3, 30, 10), [(1000 + i, [x * 9 for x in v], g) for i, v, g in blobs(2, 20, 5, seed=3)], blobs(1, 6, 0)
    rows = [(i, v, 0) for i, v, _ in first] + [(i, v, 1) for i, v, _ in second] + [(5000 + i, v, 2) for i, v, _ in few] + [(9000, [1.0] * len(first[0][1]), -1)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, topic int")

    def parts(found):
        groups = {}
        for r in found.collect():
            groups.setdefault((r["topic"], r["subtopic"]), set()).add(r["doc_id"])
        return groups

    together = parts(N.subtopics(df))
    assert {t for t, _ in together} == {0, 1}
    for topic, own in ((0, first), (1, second)):
        alone = N.density_cluster(df.where(F.col("topic") == topic).select("doc_id", "embedding"), max(3, len(own) // 8)).collect()
        groups = {}
        for r in alone:
            groups.setdefault(r["topic"], set()).add(r["doc_id"])
        assert {frozenset(m) for (t, s), m in together.items() if t == topic and s != -1} == {frozenset(m) for t, m in groups.items() if t != -1}
        assert together.get((topic, -1), set()) == groups.get(-1, set())
    words = R.describe_subtopics(df.select("doc_id", F.format_string("topic%d words%d", "topic", "doc_id").alias("text")), N.subtopics(df)).collect()
    assert {(r["topic"], r["subtopic"]): r["n"] for r in words} == {k: len(m) for k, m in together.items() if k[1] != -1}
    assert all(f"topic{r['topic']}" in r["keywords"] for r in words)


def _forest_of(edges, sizes):
    rows = [{"a": r["a"], "b": r["b"], "w": round(r["w"], 6), "g": r["g"]} for r in edges.collect()]
    points, clusters = N.plain_tree(rows, sizes)
    falls = sorted((p, None if fall is None else round(fall, 5)) for p, _, fall in points)
    return falls, sorted((g, size, round(birth, 4), round(stability, 3)) for _, _, birth, g, size, stability, _ in clusters), {(r["a"], r["b"]): r["w"] for r in rows}


def test_edges_of_many_samples_keep_the_forest_and_not_the_pairs(spark):
    """Neighbours of more than 64 samples were stored and shuffled pair by pair, so their number grew with documents times samples."""
    data = blobs(size=100)
    rows = [(i, v, "one" if t < 3 else "two") for i, v, t in data]
    rows += [(1000 + i, rows[5][1], "one") for i in range(30)] + [(2000, rows[3][1], "alone"), (2001, [0.0] * len(rows[0][1]), "one"), (2002, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, g string")
    plan = spark.createDataFrame([("one", 12, 80), ("two", 12, 20), ("alone", 12, 1)], "g string, cluster_size bigint, samples int")
    sizes = {"one": 12, "two": 12, "alone": 12}
    pairs = N.core_edges(df, 80, 10, "g", plan=plan, many=1000)
    found = N.core_edges(df, 80, 10, "g", plan=plan)
    falls, clusters, weights = _forest_of(pairs, sizes)
    falls_too, clusters_too, few = _forest_of(found, sizes)
    assert falls_too == falls and clusters_too == clusters
    assert all(abs(weights[e] - w) < 1e-5 for e, w in few.items()) and len(few) == found.count()
    assert len(weights) > 10_000 and len(few) < 16 * len(rows)
    items = df.where("doc_id <> 2001 AND g IS NOT NULL").select(F.col("doc_id").alias("item_id"), "embedding", "g")
    small_tasks = N.forest_edges(items, 80, 10, plan, held_scores=500, held_edges=300)
    assert _forest_of(small_tasks, sizes)[:2] == (falls, clusters)
    alone = df.where("g = 'one'").select("doc_id", "embedding")
    assert _forest_of(N.core_edges(alone, 80, 10), {"": 12})[:2] == _forest_of(N.core_edges(alone, 80, 10, many=1000), {"": 12})[:2]


def test_clusters_of_many_samples_are_those_of_all_pairs(spark, monkeypatch):
    df = vectors(spark, blobs(groups=3, size=90)).drop("topic")
    for small_graph in (N.SMALL_GRAPH, 0):
        found = sorted(map(tuple, N.density_cluster(df, 20, samples=70, probability=True, small_graph=small_graph).collect()))
        assert len({t for _, t, _ in found}) > 1
        with monkeypatch.context() as m:
            m.setattr(N, "forest_edges", lambda items, samples, k, plan: N.core_edges(items.withColumnRenamed("item_id", "doc_id"), samples, k, many=1000))
            assert [(d, t, round(p, 5)) for d, t, p in found] == [
                (d, t, round(p, 5)) for d, t, p in sorted(map(tuple, N.density_cluster(df, 20, samples=70, probability=True, small_graph=small_graph).collect()))]


def test_lightest_forest_takes_the_edges_of_kruskal():
    rng = np.random.default_rng(3)
    for n in (2, 5, 40):
        a = rng.integers(0, n, 300)
        b = rng.integers(0, n, 300)
        a, b = np.minimum(a, b), np.maximum(a, b)
        w = rng.integers(0, 4, 300) / 4
        forest, want = N.SmallForest(), set()
        for _, x, y in sorted(zip(np.maximum(w, 1e-9), a, b)):
            if forest.find(x) != forest.find(y):
                forest.join(x, y)
                want.add((x, y))
        keep = N.lightest_forest(a, b, w)
        assert {(x, y) for x, y in zip(a[keep], b[keep])} == want and len(keep) == len(want)
    assert len(N.lightest_forest(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))) == 0


def test_density_takes_very_large_ids(spark):
    shift = 2 ** 62
    data = [(shift + i, v, g) for i, v, g in blobs(2, 30, 5)]
    found = {r["doc_id"]: r["topic"] for r in N.density_cluster(vectors(spark, data), 12).collect()}
    assert len(found) == len(data) and len({t for t in found.values() if t != -1}) == 2


def test_keywords_count_every_document_of_a_topic(spark):
    """The winning word first appears in document 400 of 500; ids are near 2^62."""
    from topicloom.operators import keywords as K
    rows = [(2 ** 62 + i, f"plain{i} " + ("late late late late late late" if i >= 400 else f"other{i % 7}"), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, topic int")
    assert K.topic_keywords(df).first()["keywords"].split(", ")[0] == "late"


def test_labels_are_unique_at_last(spark):
    from topicloom.operators import labels as L
    df = spark.createDataFrame([(t, "Same - Label - Here", "same, label", ["same"]) for t in range(12)],
                               "topic int, human_label string, keywords string, phrases12 array<string>")
    got = [r["human_label"].lower().strip() for r in L.dedupe_labels(df, rounds=1).collect()]
    assert len(set(got)) == 12


def test_variants_with_many_phrasings(spark):
    from topicloom.operators import search as H
    items = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "item_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(1, 1000, [0.0, 0.0]), (2, 0, [5.0, 0.0])], "query_id bigint, variant int, embedding array<float>")
    got = {(r["query_id"], r["item_id"]) for r in H.search_variants(asked, items, 3).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 5), (2, 4), (2, 3)}


def test_pairs_with_an_empty_table(spark):
    from topicloom.operators.similarity import score_pairs
    df = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id bigint, embedding array<float>")
    none = spark.createDataFrame([], "topic bigint, centroid array<float>")
    assert score_pairs(df, "embedding", none, "topic", "centroid").count() == 0


def test_components_large_and_small_graph(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 10), (10, 11), (11, 12), (20, 21), (3, 30)], "a bigint, b bigint")
    assert rows(N.components(edges)) == rows(N.components(edges, small_graph=0))


# --- search -----------------------------------------------------------------------------------

def test_all_cells_probed_equals_exact(spark, rows):
    data = blobs(3, 30, 10)
    items = vectors(spark, data).select(F.col("doc_id").alias("item_id"), "embedding")
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    index, centers = H.build_ivf(items, 4)
    exact = rows(H.knn(queries, items, 3, exclude_self=True), "query_id", "rank", "item_id")
    assert rows(H.knn_ivf(queries, index, centers, 3, 4, exclude_self=True), "query_id", "rank", "item_id") == exact
    assert rows(H.knn_join(queries, index, centers, 3, 4, exclude_self=True, block=7), "query_id", "rank", "item_id") == exact


def test_knn_ties_small_tables_and_empty_topic(spark, rows):
    items = spark.createDataFrame([(5, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [0.0, 1.0], 1)], "item_id bigint, embedding array<float>, topic int")
    queries = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], 7)], "query_id bigint, embedding array<float>, topic_filter int")
    assert rows(H.knn(queries, items, 10, in_topic=True), "query_id", "rank", "item_id") == [(1, 1, 3), (1, 2, 5), (1, 3, 4)]


def test_joined_queries_equal_sent_queries(spark, rows):
    data = blobs(3, 15, 5)
    items = vectors(spark, data).withColumnRenamed("doc_id", "item_id")
    queries = items.select(F.col("item_id").alias("query_id"), "embedding", F.when(F.col("item_id") % 2 == 0, F.col("topic")).alias("topic_filter"))
    for options in ({}, {"exclude_self": True}, {"in_topic": True}):
        sent = rows(H.knn(queries, items, 4, **options), "query_id", "rank", "item_id")
        assert rows(H.knn(queries, items, 4, many=3, **options), "query_id", "rank", "item_id") == sent


def test_many_copies_of_one_vector(spark):
    data = [(i, [1.0, 0.0]) for i in range(300)] + [(1000, [0.0, 1.0])]
    items = spark.createDataFrame(data, "item_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.1])], "query_id bigint, embedding array<float>")
    assert [r["item_id"] for r in H.knn(queries, items, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_rerank_threshold(spark):
    hits = spark.createDataFrame([(1, 10, "red apple", "red apple pie", 0.1), (1, 11, "red apple", "blue sky", 0.2)],
                                 "query_id bigint, item_id bigint, query_text string, text string, distance double")
    assert H.rerank(hits, 5, 0.0).count() == 2
    assert [r["item_id"] for r in H.rerank(hits, 5, 0.5).collect()] == [10]


# --- labels and responses ---------------------------------------------------------------------

def test_three_level_label_and_fallbacks(spark):
    data = [
        (0, ["customer service response", "delivery time"], ["staff", "phone"], "a, b"),
        (1, ["customer service"], ["staff", "phone"], "a, b"),
        (2, [], [], "alpha, beta, gamma, delta"),
        (3, [], [], ""),
    ]
    df = spark.createDataFrame(data, "topic int, phrases23 array<string>, phrases1 array<string>, keywords string")
    got = {r["topic"]: r["human_label"] for r in L.human_labels(df).collect()}
    assert got == {0: "Customer Service Response - Delivery Time - Staff Phone", 1: "Customer Service - Staff Phone",
                   2: "Alpha Beta - Gamma Delta", 3: "Miscellaneous - Topics"}


def test_dedupe_makes_labels_unique(spark):
    data = [(0, "Orders", "late, parcel", None), (1, "orders", "late, parcel", None), (2, "A - B - C - D", "", None)]
    df = spark.createDataFrame(data, "topic int, human_label string, keywords string, phrases12 array<string>")
    got = {r["topic"]: r["human_label"] for r in L.dedupe_labels(df).collect()}
    assert len({v.lower() for v in got.values()}) == 3 and got[2] == "A - B - C - D"
    assert all(v.count(" - ") >= 2 for v in got.values())
    assert got[0].endswith("Variant 1") and got[1].endswith("Variant 2")


def test_parse_labels_rules(spark):
    text = '1: Billing Issues - Card\nTopic 2. "Late parcels again"\n3) Late parcels again\n4: some [odd] label\n5: Solo\n7: Out of range'
    df = spark.createDataFrame([(0, text)], "batch int, response string")
    sizes = spark.createDataFrame([(0, 6)], "batch int, size int")
    got = {r["number"]: r["label"] for r in I.parse_labels(df, sizes=sizes).collect()}
    assert got == {1: "Billing Issues - Card", 2: "Late - parcels again"}


def test_failed_model_calls_end_as_null(spark):
    def load():
        def call(prompt, attempt):
            if prompt == "never":
                raise TimeoutError
            return "fine" if attempt == 1 else None
        return call

    df = spark.createDataFrame([(0, "never"), (1, "later")], "topic int, prompt string")
    got = {r["topic"]: (r["response"], r["tries"]) for r in I.apply_model(df, load).collect()}
    assert got == {0: (None, 3), 1: ("fine", 2)}


# --- terms and whole runs ---------------------------------------------------------------------

def test_top_phrases_empty_when_nothing_repeats(spark):
    df = spark.createDataFrame([(0, 1, "alpha beta"), (0, 2, "gamma delta")], "topic int, doc_id bigint, text string")
    assert M.top_phrases(df, 2, 3, 5).count() == 0


def test_topic_run_recovers_generated_topics(spark):
    data = documents(150)
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id bigint, text string")
    found, info = R.topic_run(df, 5, 5)
    topics = {r["doc_id"]: r["topic"] for r in found.collect()}
    agree = sum(max([topics[i] for i, _, g in data if g == t].count(x) for x in set(topics.values())) for t in range(5))
    assert agree >= 120
    labels = [r["human_label"] for r in info.collect()]
    assert len(set(labels)) == len(labels)
    assert sum(r["count"] for r in info.collect()) == len(topics)


def test_assign_on_a_stream(spark, tmp_path):
    from topicloom.streaming.assign import assign_stream

    data = blobs(3, 20, 0)
    df = vectors(spark, data)
    centers = S.stored_centroids(df)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.select("doc_id", "embedding").write.parquet(source)
    stream = spark.readStream.schema("doc_id bigint, embedding array<float>").parquet(source)
    assign_stream(stream, centers, sink, str(tmp_path / "ckpt")).awaitTermination(120)
    batch = {r["doc_id"]: r["topic"] for r in D.assign(df, centers).collect()}
    assert {r["doc_id"]: r["topic"] for r in spark.read.parquet(sink).collect()} == batch


# --- exact search by cells --------------------------------------------------------------------

def test_cell_join_copies_rows_a_fixed_number_of_times_and_equals_all_pairs(spark, rows):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 3)], int(i % 40)) for i in range(1200)]  # many ties
    index = X.materialise(spark.createDataFrame(data, "item_id bigint, embedding array<float>, cell int"))
    wanted = index.select(F.col("item_id").alias("query_id"), "embedding", F.array(*[F.lit(c) for c in range(0, 40, 2)]).alias("cells"))
    plan = spark.createDataFrame([(c, 30, 30 * c) for c in range(40)], "cell int, n bigint, before bigint")
    dealt = H._dealt(wanted, plan, 8, 1200).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.size("cells")).alias("cells")).agg(F.max("n"), F.min("cells")).first()
    assert dealt[0] <= 8 and dealt[1] >= 20  # twenty cells and hundreds of blocks, but a query goes to eight parts
    matrix = np.array([v for _, v, _ in data], dtype="float64")
    for metric in ("l2", "dot", "cosine"):
        value = S.scores(matrix, matrix, metric)
        np.fill_diagonal(value, -np.inf)
        value[:, [i for i, _, c in data if c % 2]] = -np.inf
        want = sorted((q, n + 1, int(i)) for q in range(1200) for n, i in enumerate(np.lexsort((np.arange(1200), -value[q]))[:4]))
        got = H._ranked(H._block_join(wanted, index, 4, metric, True, 16), 4, metric)
        assert rows(got, "query_id", "rank", "item_id") == want


def test_pruned_search_equals_exact_and_looks_at_little(spark, rows):
    data = blobs(6, 60, 10, dim=4)
    items = vectors(spark, data + [(7000 + i, data[0][1], 0) for i in range(30)]).select(F.col("doc_id").alias("item_id"), "embedding")
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    exact = rows(H.knn(queries, items, 5, exclude_self=True), "query_id", "rank", "item_id")
    assert rows(H.knn(queries, items, 5, exclude_self=True, many=10), "query_id", "rank", "item_id") == exact
    for pivots, block in ((1, 2048), (12, 2048), (12, 16)):
        hits, visits = H.pruned_search(queries, items, 5, True, pivots, block=block)
        assert rows(H._ranked(hits, 5, "l2"), "query_id", "rank", "item_id") == exact
        seen = visits.agg(F.sum("n")).first()[0] / queries.count() / items.count()
        assert seen <= 1 and (pivots == 1 or seen < 0.5)
    few = H.pruned_search(queries.limit(4), items.limit(3), 5)[0]  # fewer items than asked for: all of them
    assert few.count() == 12
    assert H.pruned_search(queries, items.limit(0), 5)[0].count() == 0


# --- merges, membership, reduced spaces -----------------------------------------------------------

def merged_one_by_one(matrix):
    """Average linkage over all pairs of topics, the two nearest groups at a time."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    distance, groups, merges = 1 - unit @ unit.T, {i: [i] for i in range(len(unit))}, []
    names, fresh = {i: i for i in groups}, len(unit)
    mean = lambda x, y: distance[np.ix_(x, y)].mean()
    while len(groups) > 1:
        d, a, b = min((mean(groups[x], groups[y]), x, y) for x in groups for y in groups if x < y)
        merges.append((fresh, sorted(groups[a] + groups[b]), names[a], names[b], float(d)))
        groups[a], names[a] = groups[a] + groups.pop(b), fresh
        fresh += 1
    return merges


def merges_of(table):
    return [tuple(r) for r in table.select("parent_id", "topics", "left_id", "right_id", "distance").orderBy("parent_id").collect()]


def assert_same_merges(got, want):
    assert [m[:4] for m in got] == [m[:4] for m in want]
    assert [m[4] for m in got] == pytest.approx([m[4] for m in want], abs=1e-8)


@pytest.mark.parametrize("few", [2000, 3])
def test_merge_rounds_equal_one_merge_at_a_time(spark, few):
    matrix = np.random.default_rng(4).normal(size=(60, 12))
    centers = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)] + [(-1, [1.0] * 12)], "topic int, centroid array<double>")
    assert_same_merges(merges_of(D.merge_table(centers, few)), merged_one_by_one(matrix))


def test_merge_rounds_on_many_topics(spark):
    """The same tree by rounds and on the driver for 200 topics, and a reduction that agrees."""
    matrix = np.random.default_rng(5).normal(size=(200, 8))
    centers = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "topic int, centroid array<double>")
    assert_same_merges(merges_of(D.merge_table(centers)), merges_of(D.merge_table(centers, 20)))
    rows = centers.select(F.col("topic").cast("bigint").alias("doc_id"), F.col("centroid").alias("embedding"), "topic")
    reduced = [sorted(tuple(r) for r in D.reduce_topics(rows, 30, few).collect()) for few in (2000, 20)]
    assert reduced[0] == reduced[1] and len({t for _, t in reduced[0]}) == 30
    assert len({r["topic"] for r in D.reduce_topics(rows, 1).collect()}) == 1
    assert D.merge_table(centers.limit(0)).collect() == []


def test_membership_of_many_topics_equals_one_block(spark):
    rng = np.random.default_rng(6)
    centers = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(5000, 4)))], "topic int, centroid array<double>")
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3, 4)))] + [(9, [0.0] * 4)], "doc_id bigint, embedding array<double>")
    found = [{(r["doc_id"], r["topic"]): r["p"] for r in D.membership(rows, centers, 5.0, block).collect()} for block in (300, 8192)]
    assert len(found[0]) == 15_000 and found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], rel=1e-9) for k in found[0])
    assert all(sum(p for (d, _), p in found[0].items() if d == i) == pytest.approx(1) for i in range(3))


def test_spectral_steps_without_a_shuffle_equal_the_join(spark):
    from topicloom.operators import spectral

    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (200, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(59)}
    edges = [(a * 7, b * 7, w) for (i, j) in pairs for w in [float(rng.random())] for a, b in ((i, j), (j, i))]
    graph = spark.createDataFrame(edges, "a long, b long, w double")
    block = spark.createDataFrame([(i * 7, rng.normal(size=4).tolist()) for i in range(58)], "doc_id long, x array<double>")  # two nodes are missing
    rows = spectral._step(spectral._rows_of_graph(graph), block, True)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    one, two = ({r.doc_id: (r.x, r.y) for r in step.collect()} for step in (rows, spectral._step(graph, block, False)))
    assert one.keys() == two.keys() and len(one) == 58
    assert all(np.allclose(one[i], two[i]) for i in one)


def test_spectral_space_parts_blobs_and_seeds_are_looked_up(spark):
    from topicloom.operators import spectral
    data = blobs(3, 40, 0) + [(900, [0.0] * len(blobs(1, 1, 0)[0][1]), -1)]
    rows, graph = spectral.spectral_embedding(vectors(spark, data), 3, near=8)
    rows = rows.cache()
    own, rest = spectral.residuals(rows, graph, 3)
    assert np.abs(own - np.eye(3)).max() < 1e-6 and rest.max() < 0.05
    found = {r["doc_id"]: r["reduced"] for r in rows.collect()}
    assert found[900] == [0.0] * 3
    space = R.cluster_space(vectors(spark, data), "spectral", 2)  # two columns part three separate groups
    seeds = spark.createDataFrame([(g, [float(x) for x in next(v for _, v, t in data if t == g)]) for g in range(3)], "seed_id int, embedding array<double>")
    topics = {r["doc_id"]: r["topic"] for r in D.kmeans_seeded(vectors(spark, data), seeds, 3, space=space).collect()}
    assert topics[900] == -1
    for g in range(3):
        own = [topics[i] for i, _, t in data if t == g]
        assert own.count(g) >= 0.9 * len(own)
    assert R.cluster_space(vectors(spark, data[:8]), "spectral").count() == 8  # too few: their own vectors
    with pytest.raises(ValueError, match="unknown space"):
        R.cluster_space(vectors(spark, data), "elsewhere")


# --- sinks and chunk answers ------------------------------------------------------------------

def test_files_of_a_key_follow_its_size(spark, tmp_path):
    """One topic with most of the bytes is many files, every small one is one."""
    from topicloom.sources import tables as IO
    rows = [(i, "x" * 500, 0) for i in range(2000)] + [(5000 + i, "y" * 500, 1 + i % 30) for i in range(300)] + [(9000, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, topic int").repartition(16)
    IO.write_by_topic(df, str(tmp_path / "out"), file_bytes=100_000)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "out").iterdir() if p.is_dir()}
    assert 8 <= files.pop("topic=0") <= 12 and len(files) == 31
    assert max(files.values()) <= 2 and sum(files.values()) <= 31 + 3  # where two ranges meet a key has two
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.where("topic = 0").agg(F.sum(F.length("text"))).first()[0] == 1_000_000
    IO.save_index(df.where("topic IS NOT NULL").select(F.col("doc_id").alias("item_id"), F.array(F.lit(1.0)).alias("embedding"), F.col("topic").alias("cell")),
                  spark.createDataFrame([(0, [1.0])], "cell int, center array<double>"), str(tmp_path / "index"))
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "index" / "items").iterdir() if p.is_dir())


def test_chunks_answer_questions_of_their_topic_only(spark, tmp_path):
    from topicloom.operators import embedding as C
    docs = spark.createDataFrame([(i, text, topic) for i, text, topic in documents(40)] + [(99, "glacier summit " * 700, 0), (100, " ", 0)], "doc_id bigint, text string, topic int")
    vocabulary = X.materialise(C.fit_encoder(docs), "vocabulary")
    encode = lambda rows: C.encode_in_rows(rows, vocabulary, 64)
    items = R.chunk_items(docs, docs, encode, str(tmp_path / "chunks"))
    assert items.where("doc_id = 99").count() == 4 and items.where("doc_id = 100").count() == 0
    assert sorted(r["item_id"] for r in items.collect()) == list(range(44))
    info = spark.createDataFrame([(t, f"Label {t}", f"word{t}") for t in range(5)], "topic int, human_label string, keywords string")
    asked = spark.createDataFrame([(1, "topic 0: glacier ridge"), (2, "violin tempo"), (3, "topic 9: lagoon")], "doc_id bigint, text string")
    questions = encode(asked).join(asked, "doc_id").withColumnRenamed("doc_id", "query_id")
    answer = lambda prompts: prompts.withColumn("answer", F.length("context").cast("string"))
    got = {r["query_id"]: r for r in R.answer_batch(questions, items, info, answer, k=3).collect()}
    assert got[1]["topic_filter"] == 0 and got[1]["context"].startswith("Currently viewing Topic 0: Label 0") and "[from Topic 1]" not in got[1]["context"]
    assert got[2]["topic_filter"] is None and "[from Topic 1]" in got[2]["context"] and "relevance" in got[2]["sources"]
    assert got[3]["topic_filter"] is None


def test_chunks_are_encoded_once(spark, tmp_path):
    """The writer read its rows three times, and each time they were encoded and joined again."""
    docs = spark.createDataFrame(documents(40), "doc_id bigint, text string, topic int")
    seen = spark.sparkContext.accumulator(0)

    def encode(rows):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch.assign(embedding=[[1.0, float(i)] for i in batch["doc_id"]])[["doc_id", "embedding"]]

        return rows.mapInPandas(run, "doc_id bigint, embedding array<float>")

    items = R.chunk_items(docs, docs, encode, str(tmp_path / "chunks"), size=4, overlap=1)
    assert seen.value == items.count() > 40
    ordered = items.orderBy("doc_id", "chunk_no").collect()
    assert [r["item_id"] for r in ordered] == list(range(len(ordered))) and all(r["embedding"] == [1.0, r["item_id"]] for r in ordered)


def test_vectors_count_repeated_words_in_every_batch(spark, rows):
    from topicloom.operators import embedding as C
    docs = spark.createDataFrame([(i, " ".join([text] * (1 + i % 3)), t) for i, text, t in documents(60)] + [(90, "", 0), (91, None, 0)], "doc_id bigint, text string, topic int").coalesce(1)
    vocabulary = X.materialise(C.fit_encoder(docs), "vocabulary")
    counts = M.document_terms(docs, stop_words=[], min_chars=1)
    assert rows(vocabulary) == rows(C.fit_encoder(docs, counts=counts))
    want = rows(C.encode(docs, vocabulary, 64, stored=True))
    assert rows(C.encode_in_rows(docs, vocabulary, 64)) == want
    assert rows(C.encode_in_rows(docs, vocabulary, 64, tokens_at_once=7)) == want


def test_phrases_scored_in_rows_equal_joined_ones(spark, rows):
    docs = spark.createDataFrame([(i, text, topic) for i, text, topic in documents(120, 3)] + [(500, "", 0), (501, None, 1)], "doc_id bigint, text string, topic int")
    for options in ({}, {"words_apart": True, "max_features": 6}):
        both = [rows(M.top_phrases(docs, 1, 3, 8, in_rows=n, **options), "topic", "rank", "term", "score") for n in (1_000_000, 0)]
        assert both[0] == both[1] and len(both[0]) >= 24
    assert M.top_phrases(docs.where("doc_id >= 500"), 1, 2, 5).count() == 0


def test_phrases_scored_in_chunks_equal_those_in_rows(spark, rows):
    docs = spark.createDataFrame([(i, text, topic) for i, text, topic in documents(120, 3)] + [(500, "", 0), (501, None, 1), (502, "One two one two THREE", 2)], "doc_id bigint, text string, topic int")
    for options in ({}, {"words_apart": True}, {"min_df": 1}):
        both = [rows(M.top_phrases(docs, 1, 3, 8, row_bytes=n, chunk_bytes=2000, **options), "topic", "rank", "term", "score") for n in (1 << 30, 0)]
        assert both[0] == both[1] and len(both[0]) >= 24
    assert M.top_phrases(docs.where("doc_id >= 500"), 1, 2, 5, row_bytes=0).count() == 0
    assert rows(M.top_phrases(docs, 2, 3, 5, row_bytes=0, in_rows=3)) == rows(M.top_phrases(docs, 2, 3, 5))


def test_phrases_of_much_text_shuffle_no_strings_of_documents(spark, monkeypatch):
    """A vocabulary past the bound joined every (document, term) as text and sorted it twice."""
    docs = spark.createDataFrame([(i, text, topic) for i, text, topic in documents(60, 3)], "doc_id bigint, text string, topic int")
    monkeypatch.setattr(M, "document_terms", None)
    assert M.top_phrases(docs, 1, 2, 5, row_bytes=0, in_rows=0).count() == 15


def test_phrases_of_much_text_travel_packed(spark, rows, monkeypatch):
    """hashes of n-grams were shuffled row by row, one way, back, and with their weights; stored texts were stored once more."""
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(-2 ** 63, 2 ** 63 - 1, 5000))
    bucket, bounds = M._bucket_cuts(h, 7)
    assert bucket.tolist() == list(range(7)) and bounds[-1] == len(h) and np.diff(bounds).min() > 500
    columns = np.diff(h.view(np.uint64), prepend=np.uint64(0)), rng.integers(0, 1 << 16, len(h)).astype("<u2"), rng.random(len(h))
    back = M._unpack(M._pack(*columns), len(h), "<u8", "<u2", "<f8")
    assert all((a == b).all() for a, b in zip(columns, back)) and (np.cumsum(back[0], dtype=np.uint64).view(np.int64) == h).all()
    docs = X.materialise(spark.createDataFrame([(i, text, topic) for i, text, topic in documents(120, 3)], "doc_id bigint, text string, topic int"))
    names, real = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, name="table", *more: names.append((name, df.columns)) or real(df, name, *more))
    for min_df in (1, 2, 5):
        want, got = (rows(M.top_phrases(docs, 1, 3, 8, min_df, row_bytes=n, chunk_bytes=1000, stored=True), "topic", "rank", "term", "score") for n in (1 << 30, 0))
        assert want == got
    assert not [c for name, c in names if name == "chunks"]
    plan = M._best_in_chunks(docs.withColumn("docs", F.lit(40)), 1, 2, 3, 2, [], False, 4, 1000, False)._jdf.queryExecution().toString()
    assert plan and [c for name, c in names if name == "chunks"]


def test_keywords_of_stored_texts_equal_those_of_one_pass(spark, rows):
    """every word of every topic was shuffled as a row with a decimal for its place; ties, odd tokens, a null text and a topic without words."""
    given = [(i, text + (" same\u001fmark zz" if i % 2 else " tie1 tie2 tie3"), topic) for i, text, topic in documents(80, 3)] + [(900, None, 1), (901, "a b", 7), (902, "late early late early", 8)]
    docs = X.materialise(spark.createDataFrame(given, "doc_id bigint, text string, topic int"))
    for options in ({}, {"top_n": 40, "min_chars": 2, "extra": ["tie1"]}, {"top_n": 3}):
        want, got = (rows(K.topic_keyword_list(docs, stored=stored, **options), "topic", "rank", "token", "n") for stored in (False, True))
        assert want == got and len(got) >= 9
    assert rows(K.topic_keywords(docs, stored=True)) == rows(K.topic_keywords(docs))


def test_texts_are_spread_by_their_size(spark, monkeypatch):
    """A partition per core held all of a core's share of a large table, whose counts then spilled."""
    df = X.materialise(spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")))
    cores = spark.sparkContext.defaultParallelism
    assert X.spread(df, "id").rdd.getNumPartitions() == cores
    monkeypatch.setattr(X, "SPREAD_BYTES", X.stored_bytes(df) // (3 * cores))
    assert X.spread(df, "id").rdd.getNumPartitions() >= 3 * cores


def test_rounds_of_the_forest_write_few_tables(spark, monkeypatch):
    """Every look-up of a round stored and counted its table again, and a pointer was followed one step for each stored table."""
    from topicloom.operators import forest as T

    written = []
    store = X.materialise
    for module in (T, X):
        monkeypatch.setattr(module, "materialise", lambda df, name="table": (written.append(name), store(df, name))[1])
    edges = spark.createDataFrame([(i, i + 1, float(i + 1), "") for i in range(40)], "a bigint, b bigint, w double, g string")
    rounds = T.spanning_rounds(edges)
    assert [r["s"] for r in rounds[0][1].select("s").distinct().collect()] == [0] and len(rounds) == 1
    assert written.count("lookup") == 0 and written.count("moves") <= 5  # the path has 40 steps


def sparse_tables(spark, seed, topics, docs, terms):
    """(counts, weights, best): random Zipf tables and each document's best (score, topic), from a plain loop over all pairs."""
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, terms + 1)
    chance /= chance.sum()
    weights, counts = {}, {}
    idf = np.log(1 + 3 / chance / 1000) + 0.1
    for t in range(-1, topics):
        for x in set(rng.choice(terms, 12, p=chance).tolist()):
            weights[t, x] = float(rng.uniform(0.1, 1) * idf[x])
    for d in range(docs):
        for x, n in zip(*np.unique(rng.choice(terms, 9, p=chance), return_counts=True)):
            counts[d, int(x)] = int(n)
    known = {x for _, x in weights}
    of_topic, of_doc = {}, {}
    for (t, x), w in weights.items():
        of_topic.setdefault(t, {})[x] = w
    for (d, x), n in counts.items():
        of_doc.setdefault(d, {}).update({x: n * float(idf[x])} if x in known else {})
    size = lambda v: sum(a * a for a in v.values()) ** 0.5
    best = {}
    for d, v in of_doc.items():
        found = [(round(sum(a * w.get(x, 0) for x, a in v.items()) / size(v) / size(w), 10), -t) for t, w in of_topic.items() if t >= 0 and v.keys() & w.keys()]
        if found:
            best[d] = (max(found)[0], -max(found)[1])
    counted = spark.createDataFrame([(d, f"w{x}", n) for (d, x), n in counts.items()], "doc_id bigint, term string, n bigint")
    weighted = spark.createDataFrame([(t, f"w{x}", w, float(idf[x])) for (t, x), w in weights.items()], "topic int, term string, weight double, idf double")
    return counted, weighted, best


@pytest.mark.parametrize("seed, topics, threshold", [(1, 30, 0.1), (2, 30, 0.45), (3, 30, 0.0), (4, 2500, 0.3)])
def test_similar_topics_equal_all_pairs(spark, seed, topics, threshold):
    counts, weights, best = sparse_tables(spark, seed, topics, 60, 80)
    found = {r["doc_id"]: (r["score"], r["topic"]) for r in D.similar_topics(counts, weights, threshold).collect()}
    wanted = {d: b for d, b in best.items() if b[0] >= threshold}
    assert found.keys() == wanted.keys()
    assert all(found[d][0] == pytest.approx(wanted[d][0], abs=2e-10) and found[d][1] == wanted[d][1] for d in wanted)


def test_similar_topics_of_chunks_join_no_document_with_a_topic(spark, monkeypatch, rows):
    """With few topics every term of a document met all topics that have it, as rows of a join."""
    counts, weights, best = sparse_tables(spark, 7, 30, 60, 80)
    wanted = {d: b[1] for d, b in best.items() if b[0] >= 0.1}
    joined = {r["doc_id"]: r["topic"] for r in D.similar_topics(counts, weights, 0.1, few_topics=0).collect()}
    monkeypatch.setattr(D, "split_documents", None)
    monkeypatch.setattr(D, "CELLS_AT_ONCE", 50)
    many = {r["doc_id"]: r["topic"] for r in D._similar_in_chunks(counts, weights, D.unit_topics(weights), 0.1, chunk_terms=70).collect()}
    assert {r["doc_id"]: r["topic"] for r in D.similar_topics(counts, weights, 0.1).collect()} == wanted == joined == many


def test_common_terms_stay_out_of_the_first_join(spark):
    counts, weights, _ = sparse_tables(spark, 5, 200, 60, 80)
    topics = D.unit_topics(weights)
    low, high = (D.split_documents(counts, weights, topics, t).collect() for t in (0.1, 0.6))
    assert sum(len(r["tail"]) for r in high) > sum(len(r["tail"]) for r in low) >= 0
    assert all(r["rest"] < 0.6 for r in high) and all(r["rest"] < 0.1 for r in low)
    met = {r["term"]: r["n"] for r in topics.groupBy("term").agg(F.count("*").alias("n")).collect()}
    for r in high:
        heads, tails = ([met[x["term"]] for x in part] for part in (r["head"], r["tail"]))
        assert not heads or not tails or max(heads) <= min(tails)


def test_outliers_without_topics_or_terms_stay(spark):
    counts, weights, _ = sparse_tables(spark, 6, 5, 4, 20)
    rows = assignment(spark, [-1, -1, 0, -1])
    none = D.reduce_outliers_ctfidf(rows, counts, weights.where("topic = -1"))
    assert sorted(tuple(r) for r in none.collect()) == [(0, -1), (1, -1), (2, 0), (3, -1)]
    empty = D.reduce_outliers_ctfidf(rows, counts.limit(0), weights)
    assert sorted(tuple(r) for r in empty.collect()) == [(0, -1), (1, -1), (2, 0), (3, -1)]
