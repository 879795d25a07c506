"""Vectors, nearest neighbours, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators import embedding as C
from topicloom.operators import search as H
from topicloom.operators import similarity as S
from topicloom.plans.execution import lookup_join, materialise
from topicloom.queries import base as B
from topicloom.queries.analytics_queries import CENTERS, INFO, named_info

# --- Spark ------------------------------------------------------------------------------------


def items(spark, sf):
    return B.vectors(spark, sf).withColumnRenamed("doc_id", "item_id")


def all_as_queries(spark, sf):
    return B.vectors(spark, sf).select(F.col("doc_id").alias("query_id"), "embedding")


def centers(spark, sf):
    return S.stored_centroids(B.vectors(spark, sf))


def embed_norms(spark, sf):
    docs = B.documents(spark, sf)
    return C.embed(docs).select("doc_id", F.round(V.norm(F.col("embedding")), 4).alias("norm"),
                                V.nonzero(F.col("embedding")).alias("has_vector"))


def embed(spark, sf):
    """Sum of entries weighted by position: a fingerprint of each document's vector."""
    pos = F.zip_with("embedding", F.sequence(F.lit(1), F.size("embedding")), lambda x, i: x.cast("double") * i)
    return C.embed(B.documents(spark, sf)).select(
        "doc_id", F.round(F.aggregate(pos, F.lit(0.0), lambda a, x: a + x), 4).alias("weighted_sum"))


def reduce_dims(spark, sf):
    return C.reduce_dims(B.vectors(spark, sf), 5).select("doc_id", F.posexplode("reduced").alias("dim", "value"))


def guided_seeds(spark, sf):
    """Seeds: the mean vector of each language."""
    lang = B.table(spark, sf, "documents").select("doc_id", F.ascii(F.substring("lang", 1, 1)).alias("seed_id"))
    seeds = S.centroids(B.vectors(spark, sf).join(lang, "doc_id"), "seed_id").select("seed_id", F.col("centroid").alias("embedding"))
    moved = C.guide_with_seeds(B.vectors(spark, sf), seeds)
    return moved.select("doc_id", "seed_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 5))


def vector_math(spark, sf):
    """Every vector against the centroid of its topic."""
    paired = lookup_join(B.vectors(spark, sf), centers(spark, sf), ["topic"], stored=True)
    a, b = F.col("embedding"), F.col("centroid")
    return paired.select("doc_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.cosine(a, b), 6).alias("cosine"),
                         F.round(V.squared_l2(a, b), 6).alias("squared_l2"))


def knn_exact(spark, sf):
    """Ten nearest others of every vector."""
    hits = H.knn(all_as_queries(spark, sf), items(spark, sf), 10, exclude_self=True)
    return hits.withColumn("distance", F.round("distance", 6))


def knn_pruned(spark, sf):
    """The same by cells and the triangle inequality, the queries as a table."""
    hits = H.knn_pruned(all_as_queries(spark, sf), items(spark, sf), 10, exclude_self=True, pivots=16)
    return hits.withColumn("distance", F.round("distance", 6))


def core_distance(spark, sf):
    """Distance to the fifth neighbour."""
    hits = H.neighbours(items(spark, sf), 5).where("rank = 5")
    return hits.select(F.col("query_id").alias("doc_id"), F.round(F.sqrt("distance"), 6).alias("core_distance"))


def ivf_plan(spark, sf):
    """One plan for the vectors, one for the rows of the largest table."""
    both = H.ivf_plan(items(spark, sf)).withColumn("name", F.lit("embeddings"))
    return both.unionByName(H.ivf_plan(B.table(spark, sf, "lineitem")).withColumn("name", F.lit("lineitem")))


def _cells(spark, sf):
    """Topics as cells and their centroids as cell centers."""
    index = items(spark, sf).withColumn("cell", F.col("topic"))
    return index, centers(spark, sf).select(F.col("topic").alias("cell"), F.col("centroid").alias("center"))


def knn_ivf(spark, sf):
    index, cells = _cells(spark, sf)
    hits = H.knn_ivf(all_as_queries(spark, sf), index, cells, 5, 3, exclude_self=True)
    return hits.withColumn("distance", F.round("distance", 6))


def knn_cell_join(spark, sf):
    """The same search as a join by cell and block."""
    index, cells = _cells(spark, sf)
    hits = H.knn_join(all_as_queries(spark, sf), index, cells, 5, 3, exclude_self=True, block=32)
    return hits.withColumn("distance", F.round("distance", 6))


def ivf_cells(spark, sf):
    """Sizes of learned cells."""
    index, _ = H.build_ivf(items(spark, sf), 22)
    return index.groupBy("cell").agg(F.count("*").alias("n"))


def knn_in_topic(spark, sf):
    """Each topic's centroid asks inside the topic; one more query asks in a topic that has no vectors."""
    queries = centers(spark, sf).select(F.col("topic").cast("bigint").alias("query_id"), F.col("centroid").alias("embedding"),
                                        F.when(F.col("topic") == 9, 99).otherwise(F.col("topic")).alias("topic_filter"))
    return H.knn(queries, items(spark, sf), 10, in_topic=True).withColumn("distance", F.round("distance", 6))


def semantic_search(spark, sf):
    """Each topic's centroid searches everything, its own topic, and an empty topic that falls back to everything."""
    base = centers(spark, sf).select("topic", F.col("centroid").alias("embedding"))
    queries = base.select((F.col("topic") * 10).cast("bigint").alias("query_id"), "embedding", F.lit(None).cast("int").alias("scope")).unionByName(
        base.select((F.col("topic") * 10 + 1).cast("bigint").alias("query_id"), "embedding", F.col("topic").alias("scope"))).unionByName(
        base.select((F.col("topic") * 10 + 2).cast("bigint").alias("query_id"), "embedding", F.lit(-1).alias("scope")))
    return H.semantic_search(queries, items(spark, sf), 50)


def search_variants(spark, sf):
    """Query per topic; its phrasings are its centroid and, for even topics, the next topic's centroid."""
    base = centers(spark, sf).select("topic", F.col("centroid").alias("embedding"))
    second = base.select((F.col("topic") - 1).alias("topic"), "embedding").where("topic >= 0 AND topic % 2 = 0")
    variants = base.select(F.col("topic").cast("bigint").alias("query_id"), F.lit(0).alias("variant"), "embedding").unionByName(
        second.select(F.col("topic").cast("bigint").alias("query_id"), F.lit(1).alias("variant"), "embedding"))
    return H.search_variants(variants, items(spark, sf), 20).withColumn("distance", F.round("distance", 6))


def retrieved(spark, sf, k=15):
    """Benchmark texts as questions over the documents, both with the hashed encoder."""
    docs = B.documents(spark, sf)
    vocabulary = materialise(C.fit_encoder(docs), "vocabulary")
    found = C.encode(docs, vocabulary, stored=True).select(F.col("doc_id").alias("item_id"), "embedding")
    asked = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    queries = C.encode(asked, vocabulary, stored=True).select(F.col("doc_id").alias("query_id"), "embedding")
    hits = materialise(H.knn(queries, found, k), "hits")
    texts = lookup_join(docs.select(F.col("doc_id").alias("item_id"), "text"), hits, ["item_id"], stored=True)
    return texts.join(asked.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text")), "query_id")


def hits_with_topic(spark, sf, k=15):
    hits = retrieved(spark, sf, k)
    return hits.join(B.assignment(spark, sf).withColumnRenamed("doc_id", "item_id"), "item_id")


def text_search(spark, sf):
    return retrieved(spark, sf).select("query_id", "rank", "item_id", F.round("distance", 4).alias("distance"))


def rerank(spark, sf):
    return H.rerank(retrieved(spark, sf), 5, threshold=0.5).select(
        "query_id", "rank", "item_id", F.round("rerank_score", 4).alias("rerank_score"))


def build_context(spark, sf):
    hits = hits_with_topic(spark, sf).withColumn("current_topic", (F.col("query_id") % 12).cast("int"))
    return H.build_context(hits, named_info(spark, sf), 10)


def build_sources(spark, sf):
    return H.build_sources(hits_with_topic(spark, sf))


def lift_chunks(spark, sf):
    """Chunk hits: every chunk of every document stands as a hit of the query with its document's number modulo 7."""
    from topicloom.operators.preprocess import chunk_documents

    chunks = chunk_documents(B.documents(spark, sf)).select(
        (F.col("doc_id") * 1000 + F.col("chunk_no")).alias("item_id"), "doc_id")
    hits = chunks.select((F.col("doc_id") % 7).alias("query_id"), "item_id")
    return H.lift_chunks(hits, chunks, B.assignment(spark, sf)).select("query_id", "item_id", "doc_id", "topic")


QUERIES = {
    f.__name__: f for f in (
        embed_norms, embed, reduce_dims, guided_seeds, vector_math, knn_exact, knn_pruned, core_distance, ivf_plan, knn_ivf,
        knn_cell_join, ivf_cells, knn_in_topic, semantic_search, search_variants, text_search, rerank, build_context,
        build_sources, lift_chunks)
}

# --- DuckDB -----------------------------------------------------------------------------------

VEC = "v AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS x, label AS topic FROM embeddings)"
CEN_ARR = "cl AS (SELECT topic, list(value ORDER BY dim) AS c, any_value(n) AS n FROM cen GROUP BY topic)"


def l2_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def encoder_sql() -> str:
    """``vocab(term, idf, slot, sign)`` and macros of the hashed encoder over ``documents``."""
    return f"""et_k AS (SELECT doc_id, unnest({B.words_sql('text')}) AS term FROM documents),
et AS (SELECT doc_id, term, count(*) AS n FROM et_k GROUP BY 1, 2),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf,
  (('0x' || substring(md5('42:' || term), 1, 8))::BIGINT % 64)::INT AS slot,
  CASE WHEN substring(md5('42:' || term), 9, 1) IN ('0','1','2','3','4','5','6','7') THEN 1.0 ELSE -1.0 END::DOUBLE AS sign
  FROM et GROUP BY term)"""


def encode_sql(name: str, counts: str, source: str) -> str:
    """``name(doc_id, x)``: unit vectors from ``counts(doc_id, term, n)`` for every row of ``source(doc_id)``."""
    return f"""{name}_s AS (SELECT doc_id, slot, sum(n * idf * sign) AS x FROM {counts} JOIN vocab USING (term) GROUP BY 1, 2),
{name}_n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM {name}_s GROUP BY 1),
{name}_g AS (SELECT d.doc_id, r.i AS slot, coalesce(round(s.x / nullif(n.norm, 0), 7), 0)::FLOAT::DOUBLE AS x
  FROM {source} d CROSS JOIN range(64) r(i) LEFT JOIN {name}_s s ON d.doc_id = s.doc_id AND s.slot = r.i
  LEFT JOIN {name}_n n ON d.doc_id = n.doc_id),
{name} AS (SELECT doc_id, list(x ORDER BY slot) AS x FROM {name}_g GROUP BY 1)"""


ENC = encoder_sql()
DOCVEC = encode_sql("dv", "et", "documents")
BENCH = f"""bq AS (SELECT item_id AS doc_id, text FROM benchmark),
bt_k AS (SELECT doc_id, unnest({B.words_sql('text')}) AS term FROM bq),
bt AS (SELECT doc_id, term, count(*) AS n FROM bt_k GROUP BY 1, 2)"""
QVEC = encode_sql("qv", "bt", "bq")
HITS = f"""dist AS (SELECT q.doc_id AS query_id, d.doc_id AS item_id, round({l2_sql('q.x', 'd.x')}, 10) AS distance FROM qv q CROSS JOIN dv d),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM dist QUALIFY rank <= 15)"""
FULL_HITS = f"""{ENC}, {DOCVEC}, {BENCH}, {QVEC}, {HITS},
ht AS (SELECT h.*, d.text, b.text AS query_text FROM hits h JOIN documents d ON h.item_id = d.doc_id JOIN benchmark b ON h.query_id = b.item_id)"""
TOPIC_HITS = "htt AS (SELECT ht.*, a.topic FROM ht JOIN assign a ON ht.item_id = a.doc_id)"
PAIRS = f"""pr AS (SELECT a.item_id AS query_id, b.item_id, b.topic AS cell, round({l2_sql('a.x', 'b.x')}, 10) AS distance
  FROM v a JOIN v b ON a.item_id <> b.item_id)"""
PROBES = f"""pb AS (SELECT v.item_id AS query_id, cl.topic AS cell FROM v CROSS JOIN cl
  QUALIFY row_number() OVER (PARTITION BY v.item_id ORDER BY round({l2_sql('v.x', 'cl.c')}, 10), cl.topic) <= 3)"""
_IVF = B.with_sql(VEC, CENTERS, CEN_ARR, PAIRS, PROBES, body="""SELECT query_id, (row_number() OVER (PARTITION BY query_id
    ORDER BY distance, item_id))::INT AS rank, item_id, round(distance, 6) AS distance
    FROM pr JOIN pb USING (query_id, cell) QUALIFY rank <= 5""")
_PLAN = """SELECT '{0}' AS name, count(*) AS items, CASE WHEN count(*) > 50000 THEN 'ivf' ELSE 'flat' END AS kind,
    CASE WHEN count(*) > 50000 THEN least(floor(sqrt(count(*)))::INT, 4096) ELSE 1 END AS cells,
    CASE WHEN count(*) > 50000 THEN least(32, greatest(least(floor(sqrt(count(*)))::INT, 4096) // 4, 1)) ELSE 1 END AS probes FROM {0}"""

_KNN_EXACT = B.with_sql(VEC, PAIRS, body="""SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id))::INT
        AS rank, item_id, round(distance, 6) AS distance FROM pr QUALIFY rank <= 10""")
ORACLES = {
    "embed_norms": B.with_sql(ENC, DOCVEC, body="""SELECT doc_id, round(sqrt(list_dot_product(x, x)), 4) AS norm,
        len(list_filter(x, lambda e: e <> 0)) > 0 AS has_vector FROM dv"""),
    "embed": B.with_sql(ENC, DOCVEC, body="""SELECT doc_id, round(list_sum(list_transform(x, lambda e, i: e * i)), 4) AS weighted_sum FROM dv"""),
    "guided_seeds": B.with_sql(
        "ev AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS x, ascii(lang) AS seed FROM embeddings JOIN documents ON vec_id = documents.doc_id)",
        "ed AS (SELECT doc_id, seed, unnest(x) AS e, generate_subscripts(x, 1) AS dim FROM ev)",
        "sm AS (SELECT seed, dim, avg(e) AS m FROM ed GROUP BY 1, 2)",
        "ad AS (SELECT unnest(embedding::DOUBLE[]) AS e, generate_subscripts(embedding, 1) AS dim FROM embeddings)",
        "sd AS (SELECT seed, list(m ORDER BY dim) AS c FROM sm GROUP BY seed UNION ALL SELECT -1, list(m ORDER BY dim) FROM (SELECT dim, avg(e) AS m FROM ad GROUP BY dim))",
        "av AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS x FROM embeddings)",
        """pk AS (SELECT doc_id, x, seed, c FROM av CROSS JOIN sd QUALIFY row_number() OVER (PARTITION BY doc_id
          ORDER BY round(list_cosine_similarity(x, c), 10) DESC, seed) = 1)""",
        "mv AS (SELECT doc_id, seed, CASE WHEN seed = -1 THEN x ELSE list_transform(list_zip(x, c), lambda p: ((p[1] + p[2]) / 2)::FLOAT::DOUBLE) END AS y FROM pk)",
        body="SELECT doc_id, seed::BIGINT AS seed_id, (generate_subscripts(y, 1) - 1)::INT AS dim, round(unnest(y), 5) AS value FROM mv"),
    "vector_math": B.with_sql(VEC, CENTERS, CEN_ARR, body=f"""SELECT item_id AS doc_id, round({dot_sql('x', 'c')}, 6) AS dot,
        round(list_cosine_similarity(x, c), 6) AS cosine, round({l2_sql('x', 'c')}, 6) AS squared_l2 FROM v JOIN cl ON v.topic = cl.topic"""),
    "knn_exact": _KNN_EXACT,
    "knn_pruned": _KNN_EXACT,
    "core_distance": B.with_sql(VEC, PAIRS, body="""SELECT query_id AS doc_id, round(sqrt(distance), 6) AS core_distance FROM pr
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) = 5"""),
    "ivf_plan": _PLAN.format("embeddings") + " UNION ALL " + _PLAN.format("lineitem"),
    "knn_ivf": _IVF,
    "knn_cell_join": _IVF,
    "knn_in_topic": B.with_sql(VEC, CENTERS, CEN_ARR, body=f"""SELECT cl.topic::BIGINT AS query_id, (row_number() OVER (PARTITION BY cl.topic
        ORDER BY round({l2_sql('x', 'c')}, 10), item_id))::INT AS rank, item_id, round({l2_sql('x', 'c')}, 6) AS distance
        FROM cl JOIN v ON v.topic = CASE WHEN cl.topic = 9 THEN 99 ELSE cl.topic END QUALIFY rank <= 10"""),
    "semantic_search": B.with_sql(VEC, CENTERS, CEN_ARR,
        """q AS (SELECT topic * 10 AS query_id, c, NULL AS scope FROM cl UNION ALL SELECT topic * 10 + 1, c, topic FROM cl
          UNION ALL SELECT topic * 10 + 2, c, NULL FROM cl)""",
        body=f"""SELECT query_id::BIGINT AS query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round({dot_sql('x', 'c')}, 10) DESC, item_id))::INT AS rank,
        item_id, round(round({dot_sql('x', 'c')}, 10), 3) AS similarity FROM q JOIN v ON q.scope IS NULL OR q.scope = v.topic QUALIFY rank <= 50"""),
    "search_variants": B.with_sql(VEC, CENTERS, CEN_ARR,
        """vr AS (SELECT topic AS query_id, 0 AS variant, c FROM cl UNION ALL SELECT topic - 1, 1, c FROM cl
          WHERE topic - 1 >= 0 AND (topic - 1) % 2 = 0)""",
        "vn AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM vr)",
        f"""h AS (SELECT query_id, variant, n, item_id, round({l2_sql('x', 'c')}, 10) AS distance FROM vn CROSS JOIN v),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY distance, item_id) AS r FROM h
          QUALIFY r <= CASE WHEN n > 1 THEN 40 ELSE 20 END),
        m AS (SELECT query_id, item_id, min(distance) AS distance FROM t GROUP BY 1, 2)""",
        body="""SELECT query_id::BIGINT AS query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id))::INT AS rank, item_id,
        round(distance, 6) AS distance FROM m QUALIFY rank <= 20"""),
    "text_search": B.with_sql(FULL_HITS, body="SELECT query_id, rank::INT AS rank, item_id, round(distance, 4) AS distance FROM ht"),
    "rerank": B.with_sql(FULL_HITS,
        f"hw AS (SELECT query_id, item_id, distance, list_distinct({B.words_sql('query_text')}) AS q, {B.words_sql('text')} AS t FROM ht)",
        "sz AS (SELECT query_id, count(*) AS hits, avg(len(t)) AS mean_len FROM hw GROUP BY 1)",
        "mt AS (SELECT query_id, item_id, len(t) AS len, unnest(list_filter(t, lambda w: list_contains(q, w))) AS term FROM hw)",
        "tf AS (SELECT query_id, item_id, len, term, count(*) AS n_tf FROM mt GROUP BY query_id, item_id, len, term)",
        "df AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS n_df FROM tf)",
        """sc AS (SELECT query_id, item_id, round(sum(ln(1 + (sz.hits - n_df + 0.5) / (n_df + 0.5)) * n_tf * 2.5 / (n_tf + 1.5 * (0.25 + 0.75 * len / mean_len))), 6) AS s
          FROM df JOIN sz USING (query_id) GROUP BY 1, 2)""",
        body="""SELECT query_id, r::INT AS rank, item_id, rerank_score FROM (SELECT h.query_id, h.item_id, round(s, 4) AS rerank_score,
        row_number() OVER (PARTITION BY h.query_id ORDER BY s DESC, h.distance, h.item_id) AS r
        FROM ht h JOIN sc ON h.query_id = sc.query_id AND h.item_id = sc.item_id WHERE s >= 0.5) WHERE r <= 5"""),
    "build_context": B.with_sql(INFO, FULL_HITS, TOPIC_HITS,
        """ln AS (SELECT query_id, string_agg('[Doc ' || rank || '] [from Topic ' || topic || ']: ' ||
          CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END, chr(10) ORDER BY rank) AS body
          FROM htt WHERE rank <= 10 GROUP BY 1)""",
        body="""SELECT query_id, coalesce('Currently viewing Topic ' || i.topic || ': ' || i.human_label || chr(10) || 'Keywords: '
        || i.keywords || chr(10), '') || body AS context FROM ln LEFT JOIN info i ON i.topic = query_id % 12 AND i.topic <> -1"""),
    "build_sources": B.with_sql(B.ASSIGN, FULL_HITS, TOPIC_HITS,
        body="""SELECT query_id, string_agg(rank || '. ' || CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END
        || ' [Topic ' || topic || ']', chr(10) ORDER BY rank) AS sources
        FROM htt WHERE rank <= 3 GROUP BY 1"""),
    "lift_chunks": B.with_sql(B.ASSIGN, f"""k AS (SELECT doc_id, len(list_filter(string_split_regex(text, '{B.WS}'), lambda w: w <> '')) AS n FROM documents)""",
        "c AS (SELECT doc_id, unnest(range(CASE WHEN n > 512 THEN len(range(0, n - 128, 384)) ELSE 1 END)) AS no FROM k WHERE n > 0)",
        body="SELECT c.doc_id % 7 AS query_id, c.doc_id * 1000 + no AS item_id, c.doc_id, topic FROM c JOIN assign a ON c.doc_id = a.doc_id"),
}
