"""Term statistics, keywords, labels and sentiment over the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.constants import LABEL_COMMON_WORDS, NEGATIVE_WORDS, POSITIVE_WORDS, TITLE_ACRONYMS, TITLE_SMALL_WORDS
from topicloom.operators import keywords as K
from topicloom.operators import labels as L
from topicloom.operators import sentiment as E
from topicloom.operators import terms as M
from topicloom.queries import base as B
from topicloom.queries.analytics_queries import INFO, KEYWORDS, named_info


# --- Spark ------------------------------------------------------------------------------------

def inliers(spark, sf):
    return B.topic_documents(spark, sf).where(F.col("topic") != -1)


def term_counts(spark, sf):
    return M.count_terms(B.documents(spark, sf), 1, 3, min_df=2, max_df=0.95)


def top_phrases(spark, sf):
    rows = M.top_phrases(inliers(spark, sf), 2, 3, 5)
    return rows.withColumn("score", F.round("score", 6))


def weights(spark, sf, **options):
    return M.ctfidf(M.topic_terms(B.topic_documents(spark, sf)), **options)


def ctfidf(spark, sf):
    return M.top_terms(weights(spark, sf), 10).withColumn("weight", F.round("weight", 8))


def ctfidf_seeded(spark, sf):
    """Words of the benchmark texts count three times as much; frequent words are damped."""
    from topicloom.operators.preprocess import tokenize

    seeds = tokenize(B.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(
        F.col("token").alias("term"))
    rows = M.top_terms(weights(spark, sf, seeds=seeds, multiplier=3.0, reduce_frequent_words=True), 10)
    return rows.withColumn("weight", F.round("weight", 8))


def topic_words(spark, sf):
    return M.topic_words(weights(spark, sf), 3)


def default_names(spark, sf):
    return K.default_names(M.top_terms(weights(spark, sf), 10))


def normalize_topic_info(spark, sf):
    """A topic table with words and some names, but no keywords, labels or counts."""
    terms = M.top_terms(weights(spark, sf), 10)
    words = terms.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("p")).select(
        "topic", F.transform("p", lambda x: x["term"]).alias("representation"),
        F.when(F.col("topic") % 2 == 0, F.concat(F.lit("Group "), F.col("topic").cast("string"))).alias("name"))
    return K.normalize_topic_info(words, B.assignment(spark, sf))


def extend_topic_info(spark, sf):
    """Topics 0 to 4 are known, the others came from a split."""
    info = named_info(spark, sf).where(F.col("topic") < 5)
    return K.extend_topic_info(info, B.topic_documents(spark, sf))


def label_inputs(spark, sf):
    return L.label_inputs(B.topic_documents(spark, sf), K.stored_keywords(B.topic_documents(spark, sf)))


def human_labels(spark, sf):
    return L.human_labels(label_inputs(spark, sf)).select("topic", "human_label")


def flat_labels(spark, sf):
    return L.flat_labels(label_inputs(spark, sf)).select("topic", "flat_label")


def dedupe_labels(spark, sf):
    """Labels before: one or two keywords, the same for odd topics; one round after padding."""
    keywords = K.stored_keywords(B.topic_documents(spark, sf))
    start = keywords.select(
        "topic", F.when(F.col("topic") % 2 == 1, "Service").otherwise(
            F.concat(F.lit("Group - "), F.split("keywords", ", ")[0])).alias("human_label"), "keywords",
        F.lit(None).cast("array<string>").alias("phrases12"))
    return L.dedupe_round(L.pad_labels(start)).select("topic", "human_label")


def topic_labels(spark, sf):
    docs = B.topic_documents(spark, sf)
    return L.topic_labels(docs, K.stored_keywords(docs))


def sentiment_lexicon(spark, sf):
    return E.score_lexicon(B.documents(spark, sf))


def sentiment_stars(spark, sf):
    """Ratings derived from the text length."""
    label = F.concat((F.col("n_chars") % 5 + 1).cast("string"), F.lit(" stars"))
    rows = B.table(spark, sf, "documents").select("doc_id", label.alias("original_label"))
    return rows.withColumn("sentiment", E.map_stars(F.col("original_label")))


def sentiment_threshold(spark, sf):
    """A binary label and a score derived from the ratings and the text length, at both thresholds."""
    docs = B.documents(spark, sf).join(B.table(spark, sf, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "NEGATIVE").otherwise("POSITIVE")
    score = (F.length("text") % 100) / 100
    return docs.select(
        "doc_id", E.map_confidence(label, score).alias("at_75"), E.map_confidence(label, score, 0.65, F.col("text")).alias("at_65"))


def rated_documents(spark, sf):
    return B.assignment(spark, sf).join(B.sentiment(spark, sf), "doc_id")


def sentiment_by_topic(spark, sf):
    return E.sentiment_by_topic(rated_documents(spark, sf))


def _names(spark, sf):
    return K.default_names(M.top_terms(weights(spark, sf), 10)).select("topic", "name")


def sentiment_labels(spark, sf):
    return E.decorate_labels(_names(spark, sf), rated_documents(spark, sf))


def sentiment_labels_majority(spark, sf):
    return E.decorate_majority(_names(spark, sf), rated_documents(spark, sf))


def sentiment_topic_names(spark, sf):
    return E.topic_names(B.topic_documents(spark, sf), B.sentiment(spark, sf))


def split_by_sentiment(spark, sf):
    return E.split_by_sentiment(rated_documents(spark, sf))


def choose_representation(spark, sf):
    """Aspects present for some topics only: MMR for even ones, similarity for every third, POS for every fifth."""
    from topicloom.operators import representation as R

    terms = M.top_terms(weights(spark, sf), 10).select("topic", "rank", "term")
    aspects = {
        "mmr": terms.where(F.col("topic") % 2 == 0), "similarity": terms.where(F.col("topic") % 3 == 0),
        "pos": terms.where(F.col("topic") % 5 == 0), "c_tf_idf": terms,
    }
    return R.choose_representation(aspects).withColumn("keywords", F.array_join("keywords", ", "))


QUERIES = {
    f.__name__: f for f in (
        term_counts, top_phrases, ctfidf, ctfidf_seeded, topic_words, default_names, normalize_topic_info,
        extend_topic_info, human_labels, flat_labels, dedupe_labels, topic_labels, sentiment_lexicon, sentiment_stars,
        sentiment_threshold, sentiment_by_topic, sentiment_labels, sentiment_labels_majority, sentiment_topic_names,
        split_by_sentiment, choose_representation)
}


# --- DuckDB -----------------------------------------------------------------------------------

def grams_sql(toks: str, low: int, high: int) -> str:
    def one(n: int) -> str:
        if n == 1:
            return toks
        return (f"list_transform(range(1, greatest(len({toks}) - {n - 2}, 1)), "
                f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))")

    parts = [one(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"


def terms_sql(name: str, src: str, keys: str, low: int = 1, high: int = 1) -> str:
    """``name(keys, term, n)`` from ``src(keys, text)``."""
    kept = f"list_filter({B.words_sql('text')}, lambda w: length(w) >= 2 AND w NOT IN ({B.STOP_SQL}))"
    return f"""{name}_k AS (SELECT {keys}, {kept} AS toks FROM {src}),
{name}_g AS (SELECT {keys}, unnest({grams_sql('toks', low, high)}) AS term FROM {name}_k),
{name} AS (SELECT {keys}, term, count(*) AS n FROM {name}_g GROUP BY {keys}, term)"""


def phrases_sql(name: str, src: str, low: int, high: int, k: int, min_df: int = 2) -> str:
    """``name(topic, term, score, rank)``."""
    return f"""{terms_sql(name + '_p', src, 'topic, doc_id', low, high)},
{name}_s AS (SELECT topic, count(*) AS docs FROM {src} GROUP BY topic),
{name}_v AS (SELECT topic, term, count(*) AS df FROM {name}_p GROUP BY topic, term HAVING count(*) >= {min_df}),
{name}_w AS (SELECT p.topic, p.doc_id, p.term, p.n * (ln((1 + s.docs)::DOUBLE / (1 + v.df)) + 1) AS w
  FROM {name}_p p JOIN {name}_v v ON p.topic = v.topic AND p.term = v.term JOIN {name}_s s ON p.topic = s.topic),
{name}_u AS (SELECT topic, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic, doc_id)) AS x FROM {name}_w),
{name}_t AS (SELECT topic, term, round(sum(x), 9) AS score FROM {name}_u GROUP BY topic, term),
{name} AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term DESC) AS rank FROM {name}_t
  QUALIFY rank <= {k})"""


INL = "inl AS (SELECT topic, doc_id, text FROM tdocs WHERE topic <> -1)"
CT = terms_sql("ct", "tdocs", "topic")
WEIGHT = """tot AS (SELECT *, avg(words) OVER () AS mean_words FROM (SELECT topic, sum(n) AS words FROM ct GROUP BY topic)),
wf AS (SELECT ct.*, sum(n) OVER (PARTITION BY term) AS f, words, mean_words FROM ct JOIN tot ON ct.topic = tot.topic),
wt AS (SELECT topic, term, n::DOUBLE / words * ln(1 + mean_words / f) AS weight FROM wf)"""
RANKED = """rk AS (SELECT topic, term, round(weight, 10) AS weight,
  row_number() OVER (PARTITION BY topic ORDER BY round(weight, 10) DESC, term) AS rank FROM wt QUALIFY rank <= 10)"""
NAMES = """nm AS (SELECT topic, topic || '_' || string_agg(term, '_' ORDER BY rank) AS name FROM rk WHERE rank <= 4 GROUP BY topic)"""
RATED = f"""{B.ASSIGN}, {B.SENT},
rated AS (SELECT a.doc_id, a.topic, s.sentiment FROM assign a JOIN sent s ON a.doc_id = s.doc_id),
bt AS (SELECT topic, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
  count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) AS total FROM rated GROUP BY topic)"""
_ACR = B.sql_list(a for a in TITLE_ACRONYMS if a == a.upper())
_SMALL = B.sql_list(TITLE_SMALL_WORDS)
_bare = "regexp_replace(x, '[^\\p{L}\\p{N}_-]', '', 'g')"


def title_sql(expr: str) -> str:
    return f"""array_to_string(list_transform(list_filter(string_split({expr}, ' '), lambda x: x <> ''), lambda x, i: CASE
      WHEN upper({_bare}) IN ({_ACR}) THEN upper({_bare})
      WHEN i > 1 AND lower({_bare}) IN ({_SMALL}) THEN lower({_bare})
      ELSE CASE substring({_bare}, 1, 1) WHEN 'ß' THEN 'Ss' ELSE upper(substring({_bare}, 1, 1)) END
        || lower(substring({_bare}, 2)) END), ' ')"""


def set_sql(expr: str) -> str:
    return f"list_distinct(list_filter(string_split(lower({expr}), ' '), lambda x: x <> ''))"


def subset_sql(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda z: NOT list_contains({b}, z))) = 0"


def overlap_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


def cut_sql(expr: str) -> str:
    return f"CASE WHEN length({expr}) > 70 THEN rtrim(substring({expr}, 1, 70)) || '…' ELSE {expr} END"


_phrase = B.squeeze_sql("regexp_replace(p, '[^\\p{L}\\p{N}_\\s-]', ' ', 'g')")
LABEL_IN = f"""{B.TDOCS}, {INL}, {KEYWORDS}, {phrases_sql('ph', 'inl', 2, 3, 5)}, {phrases_sql('pu', 'inl', 1, 1, 10)},
li AS (SELECT k.topic, k.keywords,
  list_filter(list_transform(coalesce(a.p, []), lambda p: {_phrase}), lambda p: length(p) > 3) AS p23,
  list_filter(list_transform(coalesce(b.p, []), lambda p: {_phrase}), lambda p: length(p) > 2) AS p1,
  list_filter(list_transform(string_split(k.keywords, ','), lambda x: trim(x)), lambda x: x <> '') AS kw
  FROM keywords k LEFT JOIN (SELECT topic, list(term ORDER BY rank) AS p FROM ph GROUP BY topic) a ON k.topic = a.topic
  LEFT JOIN (SELECT topic, list(term ORDER BY rank) AS p FROM pu GROUP BY topic) b ON k.topic = b.topic)"""
_join2 = "array_to_string({0}[1:2], ' ')"
HUMAN = [
    f"h1 AS (SELECT *, {title_sql('p23[1]')} AS l1 FROM li)",
    f"h2 AS (SELECT *, {set_sql('l1')} AS w1 FROM h1)",
    f"""h3 AS (SELECT *, list_filter(p23[2:4], lambda p: NOT {subset_sql(set_sql('p'), 'w1')} AND NOT {subset_sql('w1', set_sql('p'))}
      AND {overlap_sql('w1', set_sql('p'))} < 0.4)[1] AS second FROM h2)""",
    f"h4 AS (SELECT *, {title_sql('second')} AS l2 FROM h3)",
    f"h5 AS (SELECT *, CASE WHEN l2 IS NULL THEN w1 ELSE list_concat(w1, {set_sql('l2')}) END AS used FROM h4)",
    """h6 AS (SELECT *, list_filter(CASE WHEN l2 IS NULL THEN p1[1:4] ELSE p1[1:6] END,
      lambda w: NOT list_contains(used, lower(w))) AS d, list_filter(kw[1:3], lambda w: NOT list_contains(used, lower(w))) AS dk0 FROM h5)""",
    f"""h7 AS (SELECT *, list_transform(dk0, lambda k: {title_sql('k')}) AS dk FROM h6)""",
    f"""h8 AS (SELECT *, CASE WHEN len(d) > 0 THEN {title_sql(_join2.format('d'))} WHEN len(dk) > 0 THEN {_join2.format('dk')} END AS detail FROM h7)""",
    f"""h9 AS (SELECT *, l1 || ' - ' || l2 || ' - ' || detail AS three, 70 - length(l1) - length(l2) - 6 AS room,
      l1 || ' - ' || l2 AS head, l1 || ' - ' || coalesce(detail, 'General') AS two,
      CASE WHEN len(p1) >= 3 THEN p1 WHEN len(kw) >= 3 THEN kw END AS src FROM h8)""",
    f"""h10 AS (SELECT *, CASE WHEN src IS NOT NULL THEN {title_sql("array_to_string(src[1:2], ' ')")} || ' - ' || {title_sql("array_to_string(src[3:4], ' ')")}
      ELSE CASE WHEN len(p1) > 0 THEN {title_sql("array_to_string(p1[1:2], ' ')")} ELSE 'Miscellaneous' END || ' - Topics' END AS tail FROM h9)""",
    f"""h11 AS (SELECT topic, CASE WHEN l1 IS NULL THEN {cut_sql('tail')} WHEN l2 IS NULL THEN {cut_sql('two')}
      WHEN detail IS NULL THEN {cut_sql('head')} WHEN length(three) <= 70 THEN three
      WHEN room > 5 THEN head || ' - ' || rtrim(substring(detail, 1, room)) || '…' ELSE {cut_sql('three')} END AS lab FROM h10)""",
]
_first3 = "list_filter({0}, lambda w, i: list_position(list_transform({0}, lambda q: lower(q)), lower(w)) = i)[1:3]"
FLAT = [
    f"f1 AS (SELECT *, p23[1] AS one, {set_sql('p23[1]')} AS fw FROM li)",
    f"""f2 AS (SELECT *, list_filter(list_transform(list_filter(p23, lambda p: len(string_split(p, ' ')) >= 3), lambda t: {title_sql('t')}),
      lambda t: length(t) <= 70)[1] AS tri,
      list_filter(list_transform(p23[2:3], lambda s: CASE WHEN {subset_sql(set_sql('s'), 'fw')} THEN NULL
        WHEN {subset_sql('fw', set_sql('s'))} THEN {title_sql('s')}
        WHEN {overlap_sql('fw', set_sql('s'))} < 0.5 THEN {title_sql("one || ' & ' || s")} END),
        lambda t: t IS NOT NULL AND length(t) <= 70)[1] AS pair,
      {_first3.format('p1')} AS u1, {_first3.format('kw')} AS uk FROM f1)""",
    f"""f3 AS (SELECT *, {title_sql('one')} AS t1, {title_sql("array_to_string(u1, ' ')")} AS t2, {title_sql("array_to_string(uk, ' ')")} AS t3 FROM f2)""",
]
_LC = B.sql_list(LABEL_COMMON_WORDS)
_letters = """array_to_string(list_transform(regexp_extract_all(k, '(\\p{L}+|[^\\p{L}]+)'),
      lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), '')"""


def detail_sql(name: str, src: str, fallback: str) -> str:
    return f"""{name}_k AS (SELECT *, list_filter(list_filter(list_transform(string_split(keywords, ','), lambda x: trim(x)),
        lambda x: x <> '')[1:10], lambda k: lower(k) NOT IN ({_LC})
        AND len(list_filter({set_sql('lab')}, lambda w: contains(w, lower(k)))) = 0) AS ks FROM {src}),
{name} AS (SELECT *, CASE WHEN len(ks) > 0 THEN array_to_string(list_transform(ks[1:2], lambda k: {_letters}), ' ')
        ELSE {fallback} END AS detail FROM {name}_k)"""


def pad_sql(name: str, src: str) -> str:
    return f"""{detail_sql(name + '_d', src, "'Details'")},
{name} AS (SELECT topic, keywords, CASE WHEN len(string_split(lab, ' - ')) < 3 THEN lab || ' - ' || detail ELSE lab END AS lab FROM {name}_d)"""


def base_label_sql(expr: str) -> str:
    long = f"list_filter(CASE WHEN regexp_matches(string_split({expr}, '_')[1], '^\\d+$') THEN string_split({expr}, '_')[2:] ELSE string_split({expr}, '_') END, lambda w: length(w) > 2)"
    firsts = f"list_filter({long}, lambda w, i: list_position(list_transform({long}, lambda q: lower(q)), lower(w)) = i)"
    return f"CASE WHEN contains({expr}, '_') THEN array_to_string({firsts}[1:4], ' ') ELSE {expr} END"


_POS, _NEG = B.sql_list(POSITIVE_WORDS), B.sql_list(NEGATIVE_WORDS)

ORACLES = {
    "term_counts": B.with_sql(terms_sql("p", "documents", "doc_id", 1, 3), body="""SELECT term, sum(n)::BIGINT AS n, count(*) AS df
        FROM p GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents)"""),
    "top_phrases": B.with_sql(B.TDOCS, INL, phrases_sql("ph", "inl", 2, 3, 5),
        body="SELECT topic, rank::INT AS rank, term, round(score, 6) AS score FROM ph"),
    "ctfidf": B.with_sql(B.TDOCS, CT, WEIGHT, RANKED, body="SELECT topic, rank::INT AS rank, term, round(weight, 8) AS weight FROM rk"),
    "ctfidf_seeded": B.with_sql(B.TDOCS, CT, f"seeds AS (SELECT DISTINCT unnest({B.words_sql('text')}) AS term FROM benchmark)",
        WEIGHT.replace("n::DOUBLE / words * ln(1 + mean_words / f) AS weight FROM wf",
                       "sqrt(n::DOUBLE / words) * ln(1 + mean_words / f) * CASE WHEN term IN (SELECT term FROM seeds) THEN 3 ELSE 1 END AS weight FROM wf"),
        RANKED, body="SELECT topic, rank::INT AS rank, term, round(weight, 8) AS weight FROM rk"),
    "topic_words": B.with_sql(B.TDOCS, CT, WEIGHT, RANKED,
        body="SELECT rank::INT AS rank, term, round(weight, 4) AS weight FROM rk WHERE topic = 3"),
    "default_names": B.with_sql(B.TDOCS, CT, WEIGHT, RANKED, NAMES,
        body="SELECT topic, name, array_to_string(string_split(name, '_')[2:], ' ') AS display FROM nm"),
    "normalize_topic_info": B.with_sql(B.TDOCS, B.ASSIGN, CT, WEIGHT, RANKED,
        "r5 AS (SELECT topic, list(term ORDER BY rank) AS kw, string_agg(term, ', ' ORDER BY rank) AS keywords FROM rk WHERE rank <= 5 GROUP BY topic)",
        "cn AS (SELECT topic, count(*) AS count FROM assign GROUP BY topic)",
        f"""lb AS (SELECT r5.topic, keywords, coalesce(count, 0) AS count, CASE WHEN r5.topic % 2 = 0 THEN 'Group ' || r5.topic
          ELSE {title_sql("array_to_string(kw[1:2], ' ')")} || ' - ' || {title_sql("array_to_string(kw[3:4], ' ')")} END AS lab
          FROM r5 LEFT JOIN cn ON r5.topic = cn.topic)""",
        body=f"SELECT topic, count, keywords, CASE WHEN topic % 2 = 0 THEN lab ELSE {cut_sql('lab')} END AS human_label, '' AS analysis FROM lb"),
    "extend_topic_info": B.with_sql(INFO,
        "fresh AS (SELECT * FROM tdocs WHERE topic <> -1 AND topic NOT IN (SELECT topic FROM info WHERE topic < 5))",
        terms_sql("ft", "fresh", "topic"),
        "f5 AS (SELECT topic, term FROM ft QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) <= 5)",
        "f3 AS (SELECT topic, array_to_string(list(term ORDER BY term)[1:3], '_') AS w FROM f5 GROUP BY topic)",
        body="""SELECT topic, count, human_label AS name FROM info WHERE topic < 5
        UNION ALL SELECT c.topic, c.n, c.topic || '_' || coalesce(f3.w, 'split_topic')
        FROM (SELECT topic, count(*) AS n FROM fresh GROUP BY topic) c LEFT JOIN f3 ON c.topic = f3.topic"""),
    "human_labels": B.with_sql(LABEL_IN, *HUMAN, body=f"SELECT topic, {B.squeeze_sql('lab')} AS human_label FROM h11"),
    "flat_labels": B.with_sql(LABEL_IN, *FLAT, body="""SELECT topic, coalesce(tri, pair, CASE WHEN length(t1) <= 70 THEN t1 END,
        CASE WHEN len(u1) >= 2 AND length(t2) <= 70 THEN t2 END, CASE WHEN len(uk) >= 2 AND length(t3) <= 70 THEN t3 END,
        'Miscellaneous Topic') AS flat_label FROM f3"""),
    "dedupe_labels": B.with_sql(B.TDOCS, KEYWORDS,
        "s0 AS (SELECT topic, keywords, CASE WHEN topic % 2 = 1 THEN 'Service' ELSE 'Group - ' || split_part(keywords, ', ', 1) END AS lab FROM keywords)",
        pad_sql("s1", "s0"), pad_sql("s2", "s1"),
        "s3 AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(lab))) AS same, row_number() OVER (PARTITION BY lower(trim(lab)) ORDER BY topic) AS nth FROM s2)",
        detail_sql("s4", "s3", "'Variant ' || nth"),
        body="SELECT topic, CASE WHEN same > 1 THEN lab || ' - ' || detail ELSE lab END AS human_label FROM s4"),
    "sentiment_lexicon": f"""WITH t AS (SELECT doc_id, {B.words_sql('text')} AS t FROM documents),
        c AS (SELECT doc_id, len(list_filter(t, lambda w: w IN ({_POS}))) AS p, len(list_filter(t, lambda w: w IN ({_NEG}))) AS n FROM t)
        SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
        round(coalesce(greatest(p, n)::DOUBLE / nullif(p + n, 0), 0.0), 6) AS confidence, '+' || p || '/-' || n AS original_label FROM c""",
    "sentiment_stars": """SELECT doc_id, (n_chars % 5 + 1) || ' stars' AS original_label, CASE WHEN n_chars % 5 + 1 >= 4 THEN 'positive'
        WHEN n_chars % 5 + 1 <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM documents""",
    "sentiment_threshold": """WITH j AS (SELECT d.doc_id, text, toxic, (length(text) % 100) / 100.0 AS s FROM documents d
          JOIN labels l ON d.doc_id = l.doc_id)
        SELECT doc_id, CASE WHEN s <= 0.75 THEN 'neutral' WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS at_75,
        CASE WHEN s <= 0.65 OR length(trim(text)) < 3 THEN 'neutral' WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS at_65 FROM j""",
    "sentiment_by_topic": B.with_sql(RATED, body="SELECT topic, positive, negative, neutral FROM bt"),
    "sentiment_labels": B.with_sql(B.TDOCS, CT, WEIGHT, RANKED, NAMES, RATED,
        f"""b AS (SELECT nm.topic, {base_label_sql('name')} AS base, positive::DOUBLE / total AS pos, negative::DOUBLE / total AS neg
          FROM nm LEFT JOIN bt ON nm.topic = bt.topic)""",
        body="""SELECT topic, CASE WHEN topic = -1 THEN '📊 Outliers' WHEN pos > 0.7 THEN '😊 ' || base WHEN neg > 0.7 THEN '😔 ' || base
        WHEN pos > 0.4 AND neg > 0.4 THEN '😐 ' || base || ' (mixed)' ELSE '📝 ' || base END AS label FROM b"""),
    "sentiment_labels_majority": B.with_sql(B.TDOCS, CT, WEIGHT, RANKED, NAMES, RATED,
        "b AS (SELECT nm.topic, name, positive::DOUBLE / total AS pos, negative::DOUBLE / total AS neg FROM nm LEFT JOIN bt ON nm.topic = bt.topic)",
        body="""SELECT topic, CASE WHEN topic = -1 THEN 'Outliers' WHEN pos IS NULL THEN name WHEN pos > 0.6 THEN '😊 ' || name
        WHEN neg > 0.6 THEN '😞 ' || name ELSE '😐 ' || name END AS label FROM b"""),
    "sentiment_topic_names": B.with_sql(B.TDOCS, INL, B.SENT,
        """ct AS (SELECT topic, count(*) AS count, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'negative') AS n,
          count(*) FILTER (coalesce(sentiment, 'neutral') = 'neutral') AS z FROM inl LEFT JOIN sent ON inl.doc_id = sent.doc_id GROUP BY topic)""",
        "dm AS (SELECT *, CASE WHEN p >= n AND p >= z THEN 'positive' WHEN n >= z THEN 'negative' ELSE 'neutral' END AS dom FROM ct)",
        phrases_sql("ph", "inl", 1, 2, 5, min_df=1),
        f"""jd AS (SELECT ph.topic, dom, term, rank, CASE dom WHEN 'positive' THEN term IN ({_NEG}) WHEN 'negative' THEN term IN ({_POS})
          ELSE term IN ({_POS}) OR term IN ({_NEG}) END AS clash FROM ph JOIN dm ON ph.topic = dm.topic)""",
        """ch AS (SELECT topic, dom, CASE WHEN count(*) FILTER (NOT clash) >= 2 THEN (list(term ORDER BY rank) FILTER (NOT clash))[1:3]
          ELSE list(term ORDER BY rank)[1:3] END AS w FROM jd GROUP BY topic, dom)""",
        body="""SELECT dm.topic, dm.count, coalesce(dm.topic || '_' || lower(replace(
          CASE ch.dom WHEN 'positive' THEN '😊' WHEN 'negative' THEN '😔' ELSE '😐' END || ' ' || array_to_string(w, ' '), ' ', '_')),
          dm.topic || '_topic') AS name FROM dm LEFT JOIN ch ON dm.topic = ch.topic
        UNION ALL SELECT -1, count(*), '-1_outliers' FROM tdocs WHERE topic = -1 HAVING count(*) > 0"""),
    "split_by_sentiment": B.with_sql(RATED,
        """sp AS (SELECT topic, neutral > positive AS own FROM bt WHERE topic <> -1 AND positive >= 1 AND negative >= 1
          AND ((positive::DOUBLE / total > 0.15 AND negative::DOUBLE / total > 0.15) OR total <= 5))""",
        """pl AS (SELECT topic, own, (SELECT max(topic) FROM rated) + 1 + coalesce(sum(CASE WHEN own THEN 3 ELSE 2 END)
          OVER (ORDER BY topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sp)""",
        body="""SELECT doc_id, coalesce(start + CASE WHEN sentiment = 'negative' THEN 1 WHEN sentiment = 'neutral' AND own THEN 2 ELSE 0 END,
        r.topic)::INT AS topic FROM rated r LEFT JOIN pl ON r.topic = pl.topic"""),
    "choose_representation": B.with_sql(B.TDOCS, CT, WEIGHT, RANKED,
        "w8 AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS keywords, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 3) AS first3 FROM rk WHERE rank <= 8 GROUP BY topic)",
        body="""SELECT topic, CASE WHEN topic % 2 = 0 THEN 'mmr' WHEN topic % 3 = 0 THEN 'similarity' WHEN topic % 5 = 0 THEN 'pos' ELSE 'c_tf_idf' END AS source,
        keywords, 'Topic: ' || first3 AS label FROM w8"""),
}
