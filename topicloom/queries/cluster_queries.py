"""Clusters, outliers, hierarchy: the label of a vector is its topic."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import analytics as A
from topicloom.operators import clustering as D
from topicloom.operators import density as N
from topicloom.operators import hierarchy as G
from topicloom.operators import similarity as S
from topicloom.operators import terms as M
from topicloom.plans import topic_run as R
from topicloom.plans.execution import lookup_join, materialise, top_k
from topicloom.queries import base as B
from topicloom.queries.analytics_queries import CENTERS, named_info
from topicloom.queries.search_queries import CEN_ARR, VEC, dot_sql, l2_sql
from topicloom.queries.term_queries import CT, WEIGHT, terms_sql

# --- Spark ------------------------------------------------------------------------------------


def all_vectors(spark, sf):
    """(doc_id, topic, embedding) of every document; a document without a vector has a zero vector and topic -1."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    ids = B.table(spark, sf, "documents").select("doc_id")
    return ids.join(B.vectors(spark, sf), "doc_id", "left").select(
        "doc_id", F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("embedding", zero).alias("embedding"))


def with_outliers(spark, sf):
    """Topic 9 counts as outliers that have a vector."""
    return B.vectors(spark, sf).withColumn("topic", F.when(F.col("topic") == 9, -1).otherwise(F.col("topic")))


def centers(spark, sf):
    return S.stored_centroids(B.vectors(spark, sf))


def kmeans_sizes(spark, sf):
    return D.kmeans(all_vectors(spark, sf), 10).groupBy("topic").agg(F.count("*").alias("n"))


def _seeds(spark, sf):
    return centers(spark, sf).where("topic < 4").select(F.col("topic").alias("seed_id"), F.col("centroid").alias("embedding"))


def kmeans_seeded_1step(spark, sf):
    """One round from four seeds and four more documents."""
    start = materialise(D.seed_centers(all_vectors(spark, sf), _seeds(spark, sf), 8), "centers")
    _, moved = D.lloyd_step(B.vectors(spark, sf).select("doc_id", "embedding"), start)
    return moved.select("topic", "n", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6))


def kmeans_seeded(spark, sf):
    return D.kmeans_seeded(all_vectors(spark, sf), _seeds(spark, sf), 8).groupBy("topic").agg(F.count("*").alias("n"))


def density_cluster(spark, sf):
    return N.density_cluster(all_vectors(spark, sf), 10)


def core_components(spark, sf):
    """Connected components of the mutual-reachability edges up to the middle distance."""
    edges = materialise(N.core_edges(B.vectors(spark, sf), 2, 3), "edges")
    middle = edges.agg(F.avg(F.round("w", 6))).first()[0]
    near = edges.where(F.round("w", 6) <= F.round(F.lit(middle), 4))
    return N.components(near.select("a", "b"))


def zero_shot(spark, sf):
    """Named topics: the first vector of each label."""
    named = top_k(B.vectors(spark, sf), ["topic"], [F.col("doc_id")], 1).select("topic", F.col("embedding").cast("array<double>").alias("centroid"))
    return D.zero_shot(B.vectors(spark, sf), materialise(named, "named"), 0.7).withColumn("score", F.round("score", 6))


def assign_nearest(spark, sf):
    return D.assign(all_vectors(spark, sf), centers(spark, sf)).select("doc_id", "topic")


def merge_small_topics(spark, sf):
    """Topics of fewer than 48 documents are small; topic 5 has no usable vector."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    rows = all_vectors(spark, sf).withColumn("embedding", F.when(F.col("topic") == 5, zero).otherwise(F.col("embedding")))
    return D.merge_small(rows, 48)


def reduce_topics(spark, sf):
    """Ten topics become nine."""
    return D.reduce_topics(all_vectors(spark, sf), 9)


def membership(spark, sf):
    return D.membership(all_vectors(spark, sf), centers(spark, sf)).withColumn("p", F.round("p", 6))


def outliers_prob(spark, sf):
    rows = with_outliers(spark, sf)
    p = D.membership(rows.where("topic = -1"), S.stored_centroids(rows.where("topic <> -1")))  # only outliers move
    return D.reduce_outliers_prob(rows.select("doc_id", "topic"), p, 0.12)


def outliers_ctfidf(spark, sf):
    docs = B.topic_documents(spark, sf)
    weights = materialise(M.ctfidf(M.topic_terms(docs), with_idf=True), "weights")
    outliers = docs.where("topic = -1")
    return D.reduce_outliers_ctfidf(B.assignment(spark, sf), M.document_terms(outliers), weights, 0.1)


def outliers_emb(spark, sf):
    rows = with_outliers(spark, sf)
    return D.reduce_outliers_emb(rows.select("doc_id", "topic"), rows)


def outlier_advice(spark, sf):
    all_rows = D.outlier_advice(B.assignment(spark, sf)).withColumn("name", F.lit("documents"))
    some = D.outlier_advice(with_outliers(spark, sf).select("doc_id", "topic")).withColumn("name", F.lit("vectors"))
    return all_rows.unionByName(some)


def split_topic(spark, sf):
    return D.split_topic(B.documents(spark, sf), B.vectors(spark, sf), 3, 3)


def subtopic_sizes(spark, sf):
    """Parts of every topic with enough documents."""
    found = N.subtopics(B.vectors(spark, sf))
    return found.groupBy("topic", "subtopic").agg(F.count("*").alias("n"))


def subtopic_words(spark, sf):
    parts = materialise(N.subtopics(B.vectors(spark, sf)), "subtopics")
    return R.describe_subtopics(B.documents(spark, sf), parts)


def sentiment_first(spark, sf):
    found = R.sentiment_first(B.vectors(spark, sf).select("doc_id", "embedding"), B.sentiment(spark, sf))
    return found.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability"))


def group_topic_offsets(spark, sf):
    grouped = B.assignment(spark, sf).join(B.sentiment(spark, sf), "doc_id").select("doc_id", F.col("sentiment").alias("group"), "topic")
    return D.group_topic_offsets(grouped, R.SENTIMENTS)


def topic_coherence(spark, sf):
    return D.coherence(B.vectors(spark, sf))


def refine_topics(spark, sf):
    return D.refine_topics(B.vectors(spark, sf)).groupBy("topic").agg(F.count("*").alias("n"))


def auto_params(spark, sf):
    return D.auto_params(B.table(spark, sf, "documents"))


def recluster(spark, sf):
    """Clean, embed, cluster and describe the documents."""
    _, info = R.topic_run(B.documents(spark, sf), 10, 10)
    return info


def hierarchy(spark, sf):
    return G.hierarchy(B.topic_documents(spark, sf), centers(spark, sf))


def hierarchy_first_merge(spark, sf):
    return G.first_merge(A.topic_similarity(centers(spark, sf)))


def topic_tree(spark, sf):
    """A chain of merges: each topic joins the group of all smaller ids."""
    ids = B.table(spark, sf, "embeddings").select(F.col("label").alias("t")).distinct()
    chain = ids.where("t > 0").select(
        (F.col("t") + 99).alias("parent_id"), F.sequence(F.lit(0), "t").alias("topics"),
        F.when(F.col("t") == 1, 0).otherwise(F.col("t") + 98).alias("left_id"), F.col("t").alias("right_id"))
    return G.topic_tree(chain)


def topic_map(spark, sf):
    return G.topic_map(centers(spark, sf), named_info(spark, sf))


def document_map(spark, sf):
    return G.document_map(all_vectors(spark, sf), B.assignment(spark, sf), named_info(spark, sf))


QUERIES = {
    f.__name__: f for f in (
        kmeans_sizes, kmeans_seeded_1step, kmeans_seeded, density_cluster, core_components, zero_shot, assign_nearest,
        merge_small_topics, reduce_topics, membership, outliers_prob, outliers_ctfidf, outliers_emb, outlier_advice,
        split_topic, subtopic_sizes, subtopic_words, sentiment_first, group_topic_offsets, topic_coherence, refine_topics, auto_params,
        recluster, hierarchy, hierarchy_first_merge, topic_tree, topic_map, document_map)
}

# --- DuckDB -----------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity({0}, {1}), 10)"
ALLV = """av AS (SELECT d.doc_id, coalesce(e.label, -1) AS topic, e.embedding::DOUBLE[] AS x FROM documents d
  LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""
WO = "wo AS (SELECT vec_id AS doc_id, CASE WHEN label = 9 THEN -1 ELSE label END AS topic, embedding::DOUBLE[] AS x FROM embeddings)"
WOCEN = """wd AS (SELECT topic, generate_subscripts(x, 1) AS dim, unnest(x) AS e FROM wo WHERE topic <> -1),
wc AS (SELECT topic, list(m ORDER BY dim) AS c FROM (SELECT topic, dim, avg(e) AS m FROM wd GROUP BY 1, 2) GROUP BY topic)"""
SIM = f"""sm AS (SELECT a.topic AS ta, b.topic AS tb, {_COS.format('a.c', 'b.c')} AS s FROM cl a JOIN cl b ON a.topic < b.topic)"""


def _member(vec: str, cen: str) -> str:
    return f"""ex AS (SELECT v.doc_id, c.topic, exp({_COS.format('v.x', 'c.c')}) AS e FROM {vec} v CROSS JOIN {cen} c),
mb AS (SELECT doc_id, topic, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM ex)"""


_ADVICE = """SELECT '{0}' AS name, n AS documents, round(r, 6) AS outlier_ratio, CASE WHEN r > 0.30 THEN 'kmeans' ELSE 'density' END AS method,
    CASE WHEN r > 0.30 THEN least(greatest(5, n // 10), greatest(5, n // 50)) END::BIGINT AS topics,
    CASE WHEN r > 0.30 THEN NULL WHEN r > 0.15 THEN 3 ELSE 10 END::INT AS min_cluster_size,
    CASE WHEN r > 0.30 THEN NULL WHEN r > 0.15 THEN 2 ELSE 5 END::INT AS min_samples, 10 AS min_topic_size
    FROM (SELECT count(*) AS n, avg(CASE WHEN topic = -1 THEN 1.0 ELSE 0.0 END) AS r FROM {1})"""

ORACLES = {
    "kmeans_seeded_1step": B.with_sql(VEC, CENTERS, CEN_ARR,
        f"""ch AS (SELECT cl.topic, item_id FROM cl CROSS JOIN v WHERE cl.topic < 4
          QUALIFY row_number() OVER (PARTITION BY cl.topic ORDER BY round({dot_sql('x', 'c')}, 10) DESC, item_id) = 1)""",
        """pd AS (SELECT item_id, (row_number() OVER (ORDER BY md5(item_id || '|42')) + 3)::INT AS nth FROM v
          WHERE item_id NOT IN (SELECT item_id FROM ch) QUALIFY nth < 8)""",
        "st AS (SELECT p.topic, v.x AS c FROM (SELECT topic, item_id FROM ch UNION ALL SELECT nth, item_id FROM pd) p JOIN v ON p.item_id = v.item_id)",
        f"""az AS (SELECT v.item_id, v.x, st.topic AS t FROM v CROSS JOIN st
          QUALIFY row_number() OVER (PARTITION BY v.item_id ORDER BY round({l2_sql('x', 'c')}, 10), st.topic) = 1)""",
        "dd AS (SELECT t, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS e FROM az)",
        "mm AS (SELECT t, dim, avg(e) AS m, count(*) AS n FROM dd GROUP BY 1, 2)",
        "oc AS (SELECT topic, generate_subscripts(c, 1) - 1 AS dim, unnest(c) AS e FROM st)",
        body="""SELECT oc.topic, coalesce(n, 0) AS n, oc.dim::INT AS dim, round(coalesce(m, e), 6) AS value
        FROM oc LEFT JOIN mm ON oc.topic = mm.t AND oc.dim = mm.dim"""),
    "core_components": """WITH RECURSIVE v AS (SELECT vec_id AS i, embedding::DOUBLE[] AS x FROM embeddings),
        pr AS (SELECT a.i AS q, b.i AS t, round(""" + l2_sql("a.x", "b.x") + """, 10) AS d2 FROM v a JOIN v b ON a.i <> b.i),
        nn AS (SELECT q, t, sqrt(d2) AS d, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS r FROM pr QUALIFY r <= 3),
        co AS (SELECT q, max(d) AS core FROM nn WHERE r <= 2 GROUP BY q),
        ed AS (SELECT least(n.q, n.t) AS a, greatest(n.q, n.t) AS b, min(greatest(n.d, x.core, y.core)) AS w
          FROM nn n JOIN co x ON n.q = x.q JOIN co y ON n.t = y.q GROUP BY 1, 2),
        nr AS (SELECT a, b FROM ed WHERE round(w, 6) <= round((SELECT avg(round(w, 6)) FROM ed), 4)),
        bo AS (SELECT a, b FROM nr UNION SELECT b, a FROM nr),
        reach AS (SELECT a AS node, a AS other FROM bo UNION SELECT r.node, bo.b FROM reach r JOIN bo ON r.other = bo.a)
        SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "zero_shot": B.with_sql(VEC,
        "nt AS (SELECT topic, x AS c FROM v QUALIFY row_number() OVER (PARTITION BY topic ORDER BY item_id) = 1)",
        f"""bs AS (SELECT item_id, nt.topic AS t, {_COS.format('x', 'c')} AS s FROM v CROSS JOIN nt
          QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, nt.topic) = 1)""",
        body="SELECT item_id AS doc_id, CASE WHEN s >= 0.7 THEN t END AS topic, round(s, 6) AS score FROM bs"),
    "assign_nearest": B.with_sql(ALLV, CENTERS, CEN_ARR,
        f"""bs AS (SELECT doc_id, cl.topic AS t FROM av CROSS JOIN cl WHERE x IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_COS.format('x', 'c')} DESC, cl.topic) = 1)""",
        body="SELECT av.doc_id, coalesce(t, -1) AS topic FROM av LEFT JOIN bs ON av.doc_id = bs.doc_id"),
    "merge_small_topics": B.with_sql(ALLV, CENTERS, CEN_ARR,
        "sz AS (SELECT topic, count(*) AS n FROM av WHERE topic <> -1 GROUP BY topic)",
        "us AS (SELECT cl.topic, c, sz.n FROM cl JOIN sz ON cl.topic = sz.topic WHERE cl.topic <> 5)",
        f"""tg AS (SELECT s.topic, l.topic AS t FROM us s JOIN us l ON s.n < 48 AND l.n >= 48
          QUALIFY row_number() OVER (PARTITION BY s.topic ORDER BY {_COS.format('s.c', 'l.c')} DESC, l.topic) = 1)""",
        "mp AS (SELECT sz.topic, coalesce(t, sz.topic) AS target FROM sz LEFT JOIN tg ON sz.topic = tg.topic)",
        "rn AS (SELECT topic, (dense_rank() OVER (ORDER BY target) - 1)::INT AS nt FROM mp)",
        body="""SELECT doc_id, CASE WHEN (SELECT min(n) FROM sz) >= 48 THEN av.topic ELSE coalesce(nt, -1) END AS topic
        FROM av LEFT JOIN rn ON av.topic = rn.topic"""),
    "reduce_topics": B.with_sql(ALLV, CENTERS, CEN_ARR, SIM,
        "fm AS (SELECT ta, tb FROM sm ORDER BY s DESC, ta, tb LIMIT 1)",
        "mp AS (SELECT topic, CASE WHEN topic IN (SELECT ta FROM fm UNION ALL SELECT tb FROM fm) THEN 1000 ELSE topic END AS g FROM cl)",
        "gs AS (SELECT g, count(*) AS n, min(av.topic) AS f FROM av JOIN mp ON av.topic = mp.topic GROUP BY g)",
        "rk AS (SELECT g, (row_number() OVER (ORDER BY n DESC, f) - 1)::INT AS nt FROM gs)",
        body="SELECT doc_id, coalesce(nt, -1) AS topic FROM av LEFT JOIN mp ON av.topic = mp.topic LEFT JOIN rk ON mp.g = rk.g"),
    "membership": B.with_sql(ALLV, CENTERS, CEN_ARR, "vv AS (SELECT * FROM av WHERE x IS NOT NULL)", _member("vv", "cl"),
        body="SELECT doc_id, topic, round(p, 6) AS p FROM mb"),
    "outliers_prob": B.with_sql(WO, WOCEN, _member("wo", "wc"),
        "bp AS (SELECT doc_id, topic AS t, round(p, 10) AS p FROM mb QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 10) DESC, topic) = 1)",
        body="SELECT wo.doc_id, CASE WHEN topic = -1 AND p >= 0.12 THEN t ELSE topic END AS topic FROM wo JOIN bp ON wo.doc_id = bp.doc_id"),
    "outliers_ctfidf": B.with_sql(B.TDOCS, CT, WEIGHT.replace("AS weight FROM wf", "AS weight, ln(1 + mean_words / f) AS idf FROM wf"),
        "od AS (SELECT doc_id, text FROM tdocs WHERE topic = -1)", terms_sql("ot", "od", "doc_id"),
        "xi AS (SELECT term, max(idf) AS idf FROM wt GROUP BY term)",
        "dw AS (SELECT doc_id, ot.term, n * idf AS d FROM ot JOIN xi ON ot.term = xi.term)",
        "dn AS (SELECT doc_id, sqrt(sum(d * d)) AS dn FROM dw GROUP BY 1)",
        "tn AS (SELECT topic, sqrt(sum(weight * weight)) AS tn FROM wt WHERE topic <> -1 GROUP BY 1)",
        "dt AS (SELECT doc_id, topic, sum(d * weight) AS dot FROM dw JOIN wt ON dw.term = wt.term WHERE topic <> -1 GROUP BY 1, 2)",
        """bs AS (SELECT dt.doc_id, dt.topic AS t, round(dot / (dn * tn), 10) AS s FROM dt JOIN dn ON dt.doc_id = dn.doc_id JOIN tn ON dt.topic = tn.topic
          QUALIFY row_number() OVER (PARTITION BY dt.doc_id ORDER BY round(dot / (dn * tn), 10) DESC, dt.topic) = 1)""",
        body="SELECT t.doc_id, CASE WHEN s >= 0.1 THEN bs.t ELSE t.topic END AS topic FROM tdocs t LEFT JOIN bs ON t.doc_id = bs.doc_id"),
    "outliers_emb": B.with_sql(WO, WOCEN,
        f"""bs AS (SELECT doc_id, wc.topic AS t, {_COS.format('x', 'c')} AS s FROM wo CROSS JOIN wc WHERE wo.topic = -1
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, wc.topic) = 1)""",
        body="SELECT wo.doc_id, CASE WHEN s >= 0 THEN t ELSE wo.topic END AS topic FROM wo LEFT JOIN bs ON wo.doc_id = bs.doc_id"),
    "outlier_advice": B.with_sql(B.ASSIGN, WO, body=_ADVICE.format("documents", "assign") + " UNION ALL " + _ADVICE.format("vectors", "wo")),
    "group_topic_offsets": B.with_sql(B.ASSIGN, B.SENT,
        "gr AS (SELECT a.doc_id, a.topic, sentiment, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN 2 ELSE 3 END AS p FROM assign a JOIN sent s ON a.doc_id = s.doc_id)",
        "nb AS (SELECT p, topic, (dense_rank() OVER (ORDER BY p, topic) - 1)::INT AS nt FROM (SELECT DISTINCT p, topic FROM gr WHERE topic <> -1))",
        body="SELECT doc_id, coalesce(nt, -1) AS topic FROM gr LEFT JOIN nb ON gr.p = nb.p AND gr.topic = nb.topic"),
    "topic_coherence": B.with_sql(VEC, body="""SELECT a.topic, count(DISTINCT a.item_id) AS n, round(avg(list_cosine_similarity(a.x, b.x)), 6) AS coherence
        FROM v a JOIN v b ON a.topic = b.topic AND a.item_id <> b.item_id GROUP BY a.topic"""),
    "hierarchy_first_merge": B.with_sql(CENTERS, CEN_ARR,
        "sm AS (SELECT a.topic AS ta, b.topic AS tb, round(list_cosine_similarity(a.c, b.c), 6) AS s FROM cl a JOIN cl b ON a.topic < b.topic)",
        body="SELECT ta AS left_id, tb AS right_id, round(1 - s, 6) AS distance FROM sm ORDER BY s DESC, ta, tb LIMIT 1"),
    "topic_tree": """WITH t AS (SELECT DISTINCT label AS t FROM embeddings WHERE label > 0), m AS (SELECT max(t) AS m FROM t)
        SELECT t + 99 AS node_id, CASE WHEN t = m THEN 'Root' ELSE (t + 100)::VARCHAR END AS parent,
        CASE WHEN t = 1 THEN 0 ELSE t + 98 END AS left_id, t AS right_id, t + 1 AS size, m - t AS depth, count(*) OVER () AS merges FROM t, m""",
    "auto_params": """WITH c AS (SELECT count(*) AS n, sqrt(count(*)) AS r FROM documents),
        t AS (SELECT *, CASE WHEN n < 50 THEN greatest(3, least(6, n // 10)) WHEN n < 200 THEN greatest(4, least(10, n // 15))
          WHEN n < 1000 THEN greatest(5, least(20, floor(r * 0.7))) ELSE greatest(10, least(50, floor(log2(n) * 3))) END AS t,
          CASE WHEN n < 1000 THEN greatest(10, n // 50) WHEN n < 10000 THEN greatest(20, n // 100) ELSE greatest(100, n // 200) END AS mt FROM c),
        p AS (SELECT 'sentiment' AS profile, 'topics' AS parameter, t AS value FROM t
        UNION ALL SELECT 'sentiment', 'neighbours', CASE WHEN n < 100 THEN greatest(5, least(15, n // 4))
          WHEN n < 1000 THEN least(30, greatest(15, floor(r * 0.8))) ELSE least(50, greatest(30, floor(r))) END FROM t
        UNION ALL SELECT 'sentiment', 'components', CASE WHEN n < 100 THEN CASE WHEN t > 2 THEN least(3, t) ELSE 2 END
          WHEN n < 1000 THEN CASE WHEN t > 3 THEN least(5, t) ELSE 3 END ELSE least(10, greatest(5, floor(t / 2))) END FROM t
        UNION ALL SELECT 'sentiment', 'min_cluster_size', CASE WHEN n < 100 THEN greatest(2, floor(n / (least(t, greatest(3, n // 10)) * 2)))
          WHEN n < 1000 THEN greatest(5, least(10, n // 30)) ELSE greatest(10, least(10, n // 50)) END FROM t
        UNION ALL SELECT 'sentiment', 'max_features', CASE WHEN n > 1000 THEN 5000 ELSE 1000 END FROM t
        UNION ALL SELECT 'sentiment', 'min_df', CASE WHEN n > 100 THEN 2 ELSE 1 END FROM t
        UNION ALL SELECT 'adaptive', 'neighbours', CASE WHEN n < 500 THEN greatest(2, least(15, n // 10)) ELSE 15 END FROM t
        UNION ALL SELECT 'adaptive', 'clusters', CASE WHEN n < 30 THEN 3 WHEN n < 100 THEN least(8, n // 6) WHEN n < 500 THEN least(15, n // 10) END FROM t
        UNION ALL SELECT 'adaptive', 'max_features', CASE WHEN n < 500 THEN 500 WHEN n < 5000 THEN 2000 ELSE 5000 END FROM t
        UNION ALL SELECT 'adaptive', 'min_df', CASE WHEN n < 500 THEN 1 WHEN n < 5000 THEN 2 ELSE 5 END FROM t
        UNION ALL SELECT 'adaptive', 'min_topic_size', 10 FROM t
        UNION ALL SELECT 'recluster', 'min_topic_size', mt FROM t
        UNION ALL SELECT 'recluster', 'kmeans_topics', greatest(2, least(greatest(5, n // greatest(2, mt)), greatest(5, n // 50))) FROM t
        UNION ALL SELECT 'recluster', 'density_topics', CASE WHEN n < 1000 THEN greatest(5, least(20, n // 50))
          WHEN n < 10000 THEN greatest(10, least(50, n // 200)) ELSE greatest(20, least(100, n // 400)) END FROM t)
        SELECT profile, parameter, value::INT AS value FROM p""",
}
