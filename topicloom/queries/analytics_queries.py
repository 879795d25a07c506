"""Counts, shares, rankings, views and questions over the assignment of the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import analytics as A
from topicloom.operators import keywords as K
from topicloom.operators import preprocess as P
from topicloom.operators import similarity as S
from topicloom.queries import base as B


def named_info(spark, sf):
    """Topic table whose label is the keyword list: every column can be checked in SQL."""
    keywords = K.stored_keywords(B.topic_documents(spark, sf))
    labels = keywords.select("topic", F.col("keywords").alias("human_label"))
    return K.topic_info(B.assignment(spark, sf), keywords, labels)


def topic_keywords(spark, sf):
    return K.topic_keywords(B.topic_documents(spark, sf))


def topic_info(spark, sf):
    return named_info(spark, sf)


def topic_distribution(spark, sf):
    return A.topic_distribution(B.assignment(spark, sf))


def topic_summary(spark, sf):
    return A.topic_summary(B.assignment(spark, sf))


def balance_summary(spark, sf):
    return A.balance(B.assignment(spark, sf))


def oversized_topics(spark, sf):
    """Languages as topics: one language holds most documents."""
    by_lang = B.table(spark, sf, "documents").select("doc_id", F.ascii(F.col("lang")).alias("topic"))
    return A.oversized_topics(by_lang)


def top_topics_others(spark, sf):
    """Document sources as topics: more than twenty of them."""
    by_source = B.table(spark, sf, "documents").select(
        "doc_id", F.regexp_extract("source", r"(\d+)$", 1).try_cast("int").alias("topic"))
    return A.top_and_others(by_source)


def largest_topics(spark, sf):
    return A.leaderboard(named_info(spark, sf), 5, True)


def smallest_topics(spark, sf):
    return A.leaderboard(named_info(spark, sf), 5, False)


def topic_lookup(spark, sf):
    return A.topic_lookup(named_info(spark, sf), [0, 3, 99])


def browse_topic(spark, sf):
    return A.browse(B.topic_documents(spark, sf), topic=3, n=1000)


def attach_topics(spark, sf):
    cleaned = P.clean_documents(B.documents(spark, sf)).select("doc_id")
    seen = B.assignment(spark, sf).join(cleaned, "doc_id", "left_semi")
    rows = B.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return A.attach_topics(rows, seen, named_info(spark, sf).where(F.col("topic") != 7))


def topic_menu(spark, sf):
    return A.topic_menu(named_info(spark, sf))


def topic_groups(spark, sf):
    """Labels ``<id>_<first keyword>_...`` of every document."""
    info = named_info(spark, sf)
    label = F.when(F.col("topic") == -1, "Outliers").otherwise(
        F.concat_ws("_", F.col("topic").cast("string"), F.split("keywords", ", ")))
    labels = info.select("topic", label.alias("topic_label"))
    return A.topic_groups(A.lookup_join(B.assignment(spark, sf), labels, ["topic"]))


def samples_per_topic(spark, sf):
    return A.samples_per_topic(B.topic_documents(spark, sf), 10)


def topic_centroids(spark, sf):
    centers = S.centroids(B.vectors(spark, sf))
    return centers.select("topic", "n", F.posexplode("centroid").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


def topic_similarity(spark, sf):
    return A.topic_similarity(S.centroids(B.vectors(spark, sf)))


def timed_documents(spark, sf):
    stamps = B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    return B.topic_documents(spark, sf).join(stamps, "doc_id")


def topics_over_time(spark, sf):
    rows = A.topics_over_time(timed_documents(spark, sf), bins=10)
    return rows.withColumn("words", F.array_join("words", ", "))


def document_map_sample(spark, sf):
    return A.document_map_sample(B.assignment(spark, sf), 5000)


def new_topics(spark, sf):
    """Topics of the documents that no rated document has."""
    rated = B.assignment(spark, sf).join(B.table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return A.new_topics(B.assignment(spark, sf), rated.groupBy("topic").count())


def chunk_stats(spark, sf):
    return A.chunk_stats(P.chunk_documents(B.documents(spark, sf)), B.assignment(spark, sf))


# Question texts by kind; every third turn asks one of them, the others keep their own text.
QUESTIONS = [
    "How many topics are there?", "How many documents do you have?", "Count them", "Which topics are the largest?",
    "What is the smallest one?", "Tell me about topic 3", "Tell me about topic 77", "Give me an overview",
    "Explain the hierarchy of labels", "Please help", "Hello there", "Tell me more about this topic", "Zzz",
]


def route_questions(spark, sf):
    """Every conversation turn as a question; the current topic is the turn number."""
    turns = B.table(spark, sf, "conversations")
    pick = (F.col("conv_id") + F.col("turn")) % len(QUESTIONS)
    asked = turns.select(
        "conv_id", "turn",
        F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(F.get(F.array(*map(F.lit, QUESTIONS)), pick.cast("int")))
        .alias("text"),
        F.when(F.col("turn") % 2 == 0, F.col("turn").cast("int")).alias("current_topic"))
    routed = A.route_questions(asked, named_info(spark, sf))
    return routed.select("conv_id", "turn", "route", "topic", "answer")


QUERIES = {
    f.__name__: f for f in (
        topic_info, topic_keywords, topic_distribution, topic_summary, balance_summary, oversized_topics,
        top_topics_others, largest_topics, smallest_topics, topic_lookup, browse_topic, attach_topics, topic_menu,
        topic_groups, samples_per_topic, topic_centroids, topic_similarity, topics_over_time, document_map_sample,
        new_topics, chunk_stats, route_questions)
}

KEYWORDS = f"""kw_docs AS (
  SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS rn, {B.spaces_sql('text')} AS toks
  FROM tdocs WHERE topic <> -1),
kw_tok AS (SELECT topic, rn, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM kw_docs),
kw_n AS (SELECT topic, token, count(*) AS n, min(rn * 10000000 + pos) AS seen FROM kw_tok
  WHERE length(token) > 2 AND token NOT IN ({B.COMMON_SQL}) GROUP BY topic, token),
kw AS (SELECT topic, string_agg(token, ', ' ORDER BY r) AS keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, seen) AS r FROM kw_n) WHERE r <= 5 GROUP BY topic),
keywords AS (SELECT t.topic, coalesce(kw.keywords, 'topic, ' || t.topic) AS keywords
  FROM (SELECT DISTINCT topic FROM tdocs WHERE topic <> -1) t LEFT JOIN kw ON t.topic = kw.topic)"""
COUNTS = "counts AS (SELECT topic, count(*) AS count FROM assign GROUP BY topic)"
INFO = f"""{B.TDOCS}, {B.ASSIGN}, {COUNTS}, {KEYWORDS},
info AS (SELECT c.topic, c.count, CASE WHEN c.topic = -1 THEN 'Outliers' ELSE coalesce(k.keywords, '') END AS keywords,
  CASE WHEN c.topic = -1 THEN 'Outliers' ELSE coalesce(k.keywords, 'Topic ' || c.topic) END AS human_label,
  '' AS analysis FROM counts c LEFT JOIN keywords k ON c.topic = k.topic)"""
LEADER = """lead AS (SELECT topic, human_label, count, round(100.0 * count / sum(count) OVER (), 1) AS percentage, keywords FROM info)"""


def _leader(direction: str, n: int) -> str:
    return B.with_sql(INFO, LEADER, body=f"""SELECT (row_number() OVER (ORDER BY count {direction}, topic))::INT AS position,
        topic, human_label, count, percentage FROM lead QUALIFY position <= {n}""")


CENTERS = """dims AS (SELECT label AS topic, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
cen AS (SELECT topic, dim, avg(x) AS value, count(*) AS n FROM dims GROUP BY topic, dim)"""
CLEAN_IDS = B.clean_sql("text")
_QLIST = "[" + B.sql_list(QUESTIONS) + "]"
_SAYS = {k: "(" + " OR ".join(f"contains(q, '{p}')" for p in v) + ")" for k, v in A.QUESTION_PHRASES.items()}
_LINE = "human_label || ' (Topic ' || topic || '): ' || count || ' documents, ' || printf('%.1f', percentage) || '%'"


def _listing(direction: str, n: int) -> str:
    return f"""(SELECT string_agg({_LINE}, '; ' ORDER BY p) FROM (SELECT *, row_number() OVER (
        ORDER BY count {direction}, topic) AS p FROM lead) WHERE p <= {n})"""


ORACLES = {
    "topic_keywords": B.with_sql(B.TDOCS, KEYWORDS, body="SELECT topic, keywords FROM keywords"),
    "topic_info": B.with_sql(INFO, body="SELECT topic, count, keywords, human_label, human_label AS name, analysis FROM info"),
    "topic_distribution": B.with_sql(B.ASSIGN, COUNTS, body="""SELECT topic, count,
        round(100.0 * count / sum(count) OVER (), 2) AS percentage FROM counts"""),
    "topic_summary": B.with_sql(B.ASSIGN, body="""SELECT count(*) AS documents,
        count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS topics, count(*) FILTER (topic = -1) AS outliers,
        round(100.0 * count(*) FILTER (topic <> -1) / count(*), 1) AS coverage,
        round(count(*) FILTER (topic <> -1)::DOUBLE / count(DISTINCT CASE WHEN topic <> -1 THEN topic END), 2) AS mean_docs
        FROM assign"""),
    "balance_summary": B.with_sql(B.ASSIGN, COUNTS,
        "r AS (SELECT *, count::DOUBLE / (SELECT sum(count) FROM counts WHERE topic <> -1) AS ratio FROM counts WHERE topic <> -1)",
        body="""SELECT count(*) FILTER (ratio > 0.30) = 0 AND count(*) > 0 AS balanced,
        round(1 - stddev_pop(ratio), 6) AS balance_score, count(*) FILTER (ratio > 0.30) AS oversized, count(*) AS topics,
        round((SELECT count(*) FILTER (topic = -1)::DOUBLE / count(*) FROM assign), 6) AS outlier_ratio FROM r"""),
    "oversized_topics": """WITH c AS (SELECT ascii(lang) AS topic, count(*) AS count FROM documents GROUP BY 1),
        r AS (SELECT *, count::DOUBLE / sum(count) OVER () AS ratio FROM c)
        SELECT topic, count, round(ratio, 6) AS ratio, greatest(2, floor(ratio / 0.20)::INT) AS suggested_splits
        FROM r WHERE ratio > 0.30""",
    "top_topics_others": """WITH c AS (SELECT TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS topic, count(*) AS count
          FROM documents GROUP BY 1),
        o AS (SELECT *, (row_number() OVER (ORDER BY count DESC, topic))::INT AS position,
          round(100.0 * count / sum(count) OVER (), 1) AS percentage, sum(count) OVER () AS total FROM c)
        SELECT 'top' AS section, position, topic::VARCHAR AS name, count, percentage FROM o WHERE position <= 20
        UNION ALL SELECT 'share', position, topic::VARCHAR, count, percentage FROM o WHERE position <= 10
        UNION ALL SELECT 'share', 11, 'Others', sum(count)::BIGINT, round(100.0 * sum(count) / max(total), 1)
          FROM o WHERE position > 10 HAVING sum(count) > 0""",
    "largest_topics": _leader("DESC", 5),
    "smallest_topics": _leader("ASC", 5),
    "topic_lookup": B.with_sql(INFO, LEADER, body="""SELECT topic, human_label, count, percentage, keywords FROM lead
        WHERE topic IN (0, 3, 99)"""),
    "browse_topic": B.with_sql(B.TDOCS, body="SELECT doc_id, text, topic FROM tdocs WHERE topic = 3 ORDER BY doc_id LIMIT 1000"),
    "attach_topics": B.with_sql(INFO, *CLEAN_IDS,
        "seen AS (SELECT a.* FROM assign a WHERE doc_id IN (SELECT doc_id FROM cleaned))",
        "tag AS (SELECT d.doc_id, lang, source, n_chars, coalesce(s.topic, -1) AS topic, s.topic IS NOT NULL AS ok "
        "FROM documents d LEFT JOIN seen s ON d.doc_id = s.doc_id)",
        body="""SELECT t.doc_id, lang, source, n_chars, t.topic,
        CASE WHEN t.topic = -1 THEN 'Outlier' ELSE 'Topic ' || t.topic END AS topic_label,
        coalesce(i.human_label, CASE WHEN t.topic = -1 THEN 'Outlier' ELSE 'Topic ' || t.topic END) AS topic_human_label,
        coalesce(i.keywords, 'N/A') AS topic_keywords, coalesce(i.analysis, '') AS topic_analysis, ok AS valid_document
        FROM tag t LEFT JOIN (SELECT * FROM info WHERE topic <> 7) i ON t.topic = i.topic"""),
    "topic_menu": B.with_sql(INFO, body="""SELECT 0 AS position, 'All Topics' AS entry, 'all' AS topic
        UNION ALL SELECT (row_number() OVER (ORDER BY topic = -1, topic))::INT,
        CASE WHEN topic = -1 THEN 'Outliers (' || count || ' docs)'
          ELSE 'Topic ' || topic || ': ' || human_label || ' (' || count || ' docs)' END, topic::VARCHAR FROM info"""),
    "topic_groups": B.with_sql(INFO, body="""SELECT CASE WHEN topic = -1 THEN 'Outliers'
        ELSE split_part(keywords, ', ', 1) END AS group_name, count(*) AS topics, sum(count)::BIGINT AS documents
        FROM info GROUP BY 1"""),
    "samples_per_topic": B.with_sql(B.TDOCS, body="""SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY doc_id))::INT
        AS rank, doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview
        FROM tdocs QUALIFY rank <= 10"""),
    "topic_centroids": B.with_sql(CENTERS, body="SELECT topic, n, dim::INT AS dim, round(value, 6) AS value FROM cen"),
    "topic_similarity": B.with_sql(CENTERS, body="""SELECT a.topic AS topic_a, b.topic AS topic_b,
        round(sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))), 6) AS similarity
        FROM cen a JOIN cen b ON a.dim = b.dim GROUP BY a.topic, b.topic"""),
    "topics_over_time": B.with_sql(B.TDOCS,
        "timed AS (SELECT t.*, epoch_us(e.ts) AS us FROM tdocs t JOIN events e ON t.doc_id = e.event_id)",
        "span AS (SELECT min(us) AS lo, greatest(1, (max(us) - min(us) + 9) // 10) AS width FROM timed)",
        """binned AS (SELECT topic, least((us - lo) // width, 9)::INT AS bin, text, lo, width FROM timed, span)""",
        "freq AS (SELECT topic, bin, count(*) AS frequency, min(make_timestamp(lo + bin * width)) AS bin_start FROM binned GROUP BY 1, 2)",
        f"""raw AS (SELECT topic, bin, unnest(list_filter({B.words_sql('text')}, lambda w: length(w) >= 2
          AND w NOT IN ({B.STOP_SQL}))) AS term FROM binned)""",
        "cnt AS (SELECT topic, bin, term, count(*) AS n FROM raw GROUP BY 1, 2, 3)",
        "mw AS (SELECT avg(w) AS mean_words FROM (SELECT topic, sum(n) AS w FROM cnt GROUP BY topic))",
        """wt AS (SELECT topic, bin, term, round(n::DOUBLE / sum(n) OVER (PARTITION BY topic, bin)
          * ln(1 + (SELECT mean_words FROM mw) / sum(n) OVER (PARTITION BY term)), 10) AS weight FROM cnt)""",
        """best AS (SELECT topic, bin, string_agg(term, ', ' ORDER BY r) AS words FROM (SELECT *, row_number() OVER (
          PARTITION BY topic, bin ORDER BY weight DESC, term) AS r FROM wt) WHERE r <= 5 GROUP BY 1, 2)""",
        body="""SELECT f.topic, f.bin, f.bin_start, f.frequency, b.words FROM freq f
        LEFT JOIN best b ON f.topic = b.topic AND f.bin = b.bin"""),
    "document_map_sample": B.with_sql(B.ASSIGN, body="""SELECT doc_id, topic FROM assign
        ORDER BY md5(doc_id || '|42') LIMIT 5000"""),
    "new_topics": B.with_sql(B.ASSIGN, body="""SELECT DISTINCT topic FROM assign WHERE topic NOT IN (
        SELECT topic FROM assign WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""),
    "chunk_stats": B.with_sql(B.ASSIGN, f"""k AS (SELECT doc_id, len(list_filter(string_split_regex(text, '{B.WS}'),
          lambda w: w <> '')) AS n FROM documents)""",
        "c AS (SELECT doc_id, CASE WHEN n > 512 THEN len(range(0, n - 128, 384)) ELSE 1 END AS chunks FROM k WHERE n > 0)",
        body="""SELECT a.topic, sum(chunks)::BIGINT AS chunks, count(*) AS documents,
        round(sum(chunks) / count(*), 4) AS expansion FROM c JOIN assign a ON c.doc_id = a.doc_id GROUP BY a.topic"""),
    "route_questions": B.with_sql(INFO, LEADER,
        f"""asked AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text
          ELSE {_QLIST}[((conv_id + turn) % {len(QUESTIONS)} + 1)::INT] END AS text,
          CASE WHEN turn % 2 = 0 THEN turn END AS cur FROM conversations)""",
        """q AS (SELECT *, lower(text) AS q, TRY_CAST(nullif(regexp_extract(lower(text), 'topic\\s+(\\d+)', 1), '') AS INT) AS named
          FROM asked)""",
        """f AS (SELECT sum(count)::BIGINT AS docs, count(*) FILTER (topic <> -1) AS topics FROM info)""",
        f"""j AS (SELECT q.*, f.*, c.topic IS NOT NULL AS has_cur, c.count AS cur_count, c.human_label AS cur_label,
          c.human_label || ': ' || c.count || ' documents (' || printf('%.1f', c.percentage) || '%), keywords: ' || c.keywords AS cur_detail,
          n.human_label || ': ' || n.count || ' documents (' || printf('%.1f', n.percentage) || '%), keywords: ' || n.keywords AS named_detail
          FROM q CROSS JOIN f LEFT JOIN lead c ON q.cur = c.topic LEFT JOIN lead n ON q.named = n.topic)""",
        f"""r AS (SELECT *, CASE WHEN {_SAYS['current_topic']} AND has_cur THEN 'current_topic'
          WHEN {_SAYS['greeting']} THEN 'greeting'
          WHEN {_SAYS['counting']} AND contains(q, 'topic') THEN 'topic_count'
          WHEN {_SAYS['counting']} AND contains(q, 'doc') THEN 'document_count'
          WHEN {_SAYS['counting']} THEN 'unanswered'
          WHEN {_SAYS['largest']} THEN 'largest' WHEN {_SAYS['smallest']} THEN 'smallest'
          WHEN named IS NOT NULL AND named_detail IS NOT NULL THEN 'topic' WHEN named IS NOT NULL THEN 'unknown_topic'
          WHEN {_SAYS['overview']} THEN 'overview' WHEN {_SAYS['label_format']} THEN 'label_format'
          WHEN {_SAYS['help']} THEN 'help' ELSE 'other' END AS route FROM j)""",
        body=f"""SELECT conv_id, turn, route, named AS topic, CASE route
          WHEN 'current_topic' THEN cur_detail
          WHEN 'greeting' THEN 'Hello.' || coalesce(' You are viewing ' || cur_label || '.', '')
          WHEN 'topic_count' THEN topics || ' topics'
          WHEN 'document_count' THEN coalesce('this topic: ' || cur_count || ', ', '') || 'all: ' || docs
          WHEN 'largest' THEN {_listing('DESC', 5)} WHEN 'smallest' THEN {_listing('ASC', 5)}
          WHEN 'topic' THEN named_detail WHEN 'unknown_topic' THEN 'There is no topic ' || named
          WHEN 'overview' THEN docs || ' documents in ' || topics || ' topics. ' || {_listing('DESC', 3)}
          WHEN 'label_format' THEN 'Labels read: main category - specific details'
          WHEN 'unanswered' THEN NULL
          ELSE 'Ask about topic sizes, one topic, or an overview of ' || docs || ' documents in ' || topics || ' topics' END AS answer
          FROM r"""),
}
