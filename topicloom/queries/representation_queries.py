"""Keywords ranked by similarity and by marginal relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import embedding as C
from topicloom.operators import representation as R
from topicloom.operators import terms as M
from topicloom.plans.execution import materialise
from topicloom.queries import base as B
from topicloom.queries.search_queries import DOCVEC, ENC, l2_sql
from topicloom.queries.term_queries import CT, WEIGHT


def candidates(spark, sf):
    """Thirty class-TF-IDF words per topic, with hashed vectors of words and documents."""
    docs = B.topic_documents(spark, sf)
    vocabulary = materialise(C.fit_encoder(docs), "vocabulary")
    encoded = C.encode_known(docs, vocabulary)
    vectors = materialise(encoded.join(docs.select("doc_id", "topic"), "doc_id").where("topic <> -1"), "vectors")
    terms = M.top_terms(M.ctfidf(M.topic_terms(docs)), 30).where("topic <> -1")
    return R.scored_candidates(terms, vectors, lambda rows: C.encode_known(rows, vocabulary))


def keywords_similarity(spark, sf):
    return R.keywords_by_similarity(candidates(spark, sf)).withColumn("similarity", F.round("similarity", 4))


def mmr_round1(spark, sf):
    """The first two picks."""
    return R.mmr(candidates(spark, sf), 2, 0.3)


def mmr(spark, sf):
    return R.mmr(candidates(spark, sf), 10, 0.4)


QUERIES = {f.__name__: f for f in (keywords_similarity, mmr_round1, mmr)}

SCORED = f"""{B.TDOCS}, {CT}, {WEIGHT}, {ENC}, {DOCVEC},
cd AS (SELECT topic, term FROM wt WHERE topic <> -1
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(weight, 10) DESC, term) <= 30),
tv AS (SELECT t.topic, dv.doc_id, dv.x FROM dv JOIN tdocs t ON dv.doc_id = t.doc_id WHERE t.topic <> -1),
te AS (SELECT topic, generate_subscripts(x, 1) AS dim, unnest(x) AS e FROM tv),
tc AS (SELECT topic, list(m ORDER BY dim) AS c FROM (SELECT topic, dim, avg(e) AS m FROM te GROUP BY 1, 2) GROUP BY topic),
nr AS (SELECT tv.topic, tv.doc_id, tv.x FROM tv JOIN tc ON tv.topic = tc.topic
  QUALIFY row_number() OVER (PARTITION BY tv.topic ORDER BY round({l2_sql('tv.x', 'tc.c')}, 10), tv.doc_id) <= 5),
ne AS (SELECT topic, generate_subscripts(x, 1) AS dim, unnest(x) AS e FROM nr),
nc AS (SELECT topic, list(m ORDER BY dim) AS c FROM (SELECT topic, dim, avg(e) AS m FROM ne GROUP BY 1, 2) GROUP BY topic),
sc AS (SELECT cd.topic, cd.term, vc.slot, vc.sign, round(vc.sign * c[vc.slot + 1] / sqrt(list_dot_product(c, c)), 6) AS similarity
  FROM cd JOIN vocab vc ON cd.term = vc.term JOIN nc ON cd.topic = nc.topic)"""

ORACLES = {
    "keywords_similarity": B.with_sql(SCORED, body="""SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, term))::INT AS rank,
        term, round(similarity, 4) AS similarity FROM sc QUALIFY rank <= 10"""),
    "mmr_round1": B.with_sql(SCORED,
        "p1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, term) = 1)",
        """s2 AS (SELECT sc.topic, sc.term, round(0.7 * sc.similarity - 0.3 * CASE WHEN sc.slot = p1.slot THEN sc.sign * p1.sign ELSE 0 END, 6) AS value
          FROM sc JOIN p1 ON sc.topic = p1.topic WHERE sc.term <> p1.term)""",
        body="""SELECT topic, 1 AS rank, term FROM p1 UNION ALL
        SELECT topic, 2, term FROM (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY value DESC, term) = 1)"""),
}
