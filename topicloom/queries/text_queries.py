"""Cleaning, tokens, chunks and text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.constants import ENGLISH_STOP_WORDS, TITLE_ACRONYMS, TITLE_SMALL_WORDS
from topicloom.functions import text as T
from topicloom.operators import preprocess as P
from topicloom.queries import base as B


def clean_text(spark, sf):
    return P.clean_documents(B.documents(spark, sf))


def clean_pages(spark, sf):
    pages = B.spread(B.table(spark, sf, "pages")).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return P.clean_documents(pages)


def preprocess_stats(spark, sf):
    return P.preprocess_stats(B.documents(spark, sf), min_length=40)


def filter_documents(spark, sf):
    return P.filter_documents(B.documents(spark, sf), min_rows=10)


def clean_for_prompt(spark, sf):
    return P.clean_for_prompt(B.topic_documents(spark, sf))


def tokenize(spark, sf):
    """Token counts and positions per document, in both modes."""
    docs = B.documents(spark, sf)

    def shape(mode):
        return P.token_shapes(P.tokenize(docs, mode)).withColumn("mode", F.lit(mode))

    return shape("words").unionByName(shape("whitespace"))


def stopword_filter(spark, sf):
    """Words left after the stop lists; texts of the benchmark give the user's extra words."""
    extra = P.tokenize(B.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "whitespace")
    kept = P.remove_stopwords(P.tokenize(B.documents(spark, sf), "whitespace"), extra)
    return kept.groupBy("token").agg(F.count("*").alias("n"))


def ngram_counts(spark, sf):
    return P.ngram_counts(B.documents(spark, sf), 1, 3, ENGLISH_STOP_WORDS)


def chunk_documents(spark, sf):
    return P.chunk_documents(B.documents(spark, sf))


def parse_seeds(spark, sf):
    seeds = P.parse_seeds(B.documents(spark, sf))
    return seeds.select("doc_id", "seed_id", F.size("words").alias("n_words"), F.array_join("words", "|").alias("words"))


def title_case(spark, sf):
    """Every line of the conversations as a phrase."""
    lines = B.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "phrase"))
    cleaned = lines.withColumn("clean", T.clean_phrase(F.col("phrase")))
    return cleaned.select("conv_id", "turn", "line", "clean", T.title_case(F.col("clean")).alias("title"))


def validate_vectors(spark, sf):
    return P.validate_vectors(B.table(spark, sf, "documents"), B.vectors(spark, sf))


def zero_vectors(spark, sf):
    """Every document, with a zero vector where it has none."""
    ids = B.table(spark, sf, "documents").select("doc_id")
    filled = ids.join(B.vectors(spark, sf), "doc_id", "left").select(
        "doc_id",
        F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)).alias("embedding"),
        F.col("topic").alias("label"),
    )
    marked = P.mark_zero_vectors(filled)
    return marked.select("doc_id", "is_zero", F.when(F.col("is_zero"), -1).otherwise(F.col("label")).alias("topic"))


def excerpt(spark, sf):
    docs = B.documents(spark, sf)
    cuts = [T.excerpt(F.col("text"), n).alias(f"first_{n}") for n in (100, 150, 200, 300, 500)]
    shown = F.pmod("doc_id", F.lit(50)) + 1
    length = T.prompt_excerpt_length(shown)
    return docs.select("doc_id", *cuts, length.alias("prompt_chars"))


def parse_topic_ref(spark, sf):
    """User turns that name a topic; the topic number comes from the turn itself."""
    turns = B.table(spark, sf, "conversations").where(F.col("role") == "user")
    asked = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.col("text")).otherwise(
        F.concat(F.lit("About Topic  "), F.length("text") % 14, F.lit(": "), F.col("text")))
        .alias("text"))
    topics = B.table(spark, sf, "embeddings").select(F.col("label").alias("topic")).distinct()
    return P.resolve_topic_refs(asked, topics).select("conv_id", "turn", "topic_filter")


def query_key(spark, sf):
    turns = B.table(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return P.distinct_queries(turns, "key")


QUERIES = {
    "clean_text": clean_text,
    "clean_pages": clean_pages,
    "preprocess_stats": preprocess_stats,
    "filter_documents": filter_documents,
    "clean_for_prompt": clean_for_prompt,
    "tokenize": tokenize,
    "stopword_filter": stopword_filter,
    "ngram_counts": ngram_counts,
    "chunk_documents": chunk_documents,
    "parse_seeds": parse_seeds,
    "title_case": title_case,
    "validate_vectors": validate_vectors,
    "zero_vectors": zero_vectors,
    "excerpt": excerpt,
    "parse_topic_ref": parse_topic_ref,
    "query_key": query_key,
}



def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{B.WS}|{B.WS}$', '', 'g')"


_ACRONYMS = B.sql_list(a for a in TITLE_ACRONYMS if a == a.upper())
_SMALL = B.sql_list(TITLE_SMALL_WORDS)


def _ngram_sql(tokens: str, n: int) -> str:
    return (f"list_transform(range(1, greatest(len({tokens}) - {n - 2}, 1)), "
            f"lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))")


def _token_shape(split: str, mode: str) -> str:
    return f"""SELECT doc_id, len(toks) AS n_tokens, (len(toks) - 1)::INT AS last_pos, toks[-1] AS last_token,
      list_min(toks) AS least_token, '{mode}' AS mode FROM (SELECT doc_id, {split} AS toks FROM documents)
      WHERE len(toks) > 0"""


ORACLES = {
    "clean_text": B.with_sql(*B.clean_sql("text"), body="SELECT doc_id, text FROM cleaned"),
    "clean_pages": B.with_sql(
        *[c.replace("doc_id", "page_id").replace("documents", "pages") for c in B.clean_sql("html")],
        body="SELECT page_id AS doc_id, text FROM cleaned"),
    "preprocess_stats": B.with_sql(
        *B.clean_sql("text", min_length=40),
        body=f"""SELECT count(*) AS total, count(c.doc_id) AS valid,
          count(*) FILTER (c.doc_id IS NULL AND coalesce({B.squeeze_sql('d.text')}, '') = '') AS empty_removed,
          count(*) FILTER (c.doc_id IS NULL AND coalesce({B.squeeze_sql('d.text')}, '') <> ''
            AND length({_strip('d.text')}) < 40) AS too_short,
          0::BIGINT AS too_long_truncated,
          0::BIGINT AS type_converted
        FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id"""),
    "filter_documents": f"""SELECT doc_id, {_strip('text')} AS text FROM documents
        WHERE length({_strip('text')}) > 10""",
    # RE2 has no back-references: runs of equal words are found with windows instead.
    "clean_for_prompt": B.with_sql(
        B.TDOCS,
        "firsts AS (SELECT * FROM tdocs)",
        "plain AS (SELECT topic, doc_id, regexp_replace(text, '<[^>]+>', '', 'g') AS t FROM firsts)",
        """bits AS (SELECT topic, doc_id, unnest(l) AS bit, generate_subscripts(l, 1) AS i FROM (
          SELECT topic, doc_id, regexp_extract_all(t, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_]+') AS l FROM plain))""",
        """marked AS (SELECT *, regexp_matches(bit, '^[\\p{L}\\p{N}\\p{M}_]') AS is_word,
          lag(bit, 1) OVER w AS sep, lag(bit, 2) OVER w AS prev FROM bits
          WINDOW w AS (PARTITION BY doc_id ORDER BY i))""",
        """runs AS (SELECT *, sum(CASE WHEN is_word AND NOT coalesce(bit = prev AND regexp_matches(sep, '^\\s+$'), false)
          THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)""",
        """sized AS (SELECT *, count(*) FILTER (is_word) OVER (PARTITION BY doc_id, run) AS words,
          row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS nth,
          max(CASE WHEN is_word THEN i END) OVER (PARTITION BY doc_id, run) AS last_word FROM runs)""",
        """rebuilt AS (SELECT topic, doc_id, string_agg(bit, '' ORDER BY i)
          FILTER (NOT (run > 0 AND words >= 3 AND nth > 1 AND i <= last_word)) AS t FROM sized GROUP BY topic, doc_id)""",
        body=f"""SELECT topic, doc_id, {B.squeeze_sql('t')} AS text FROM rebuilt WHERE length({B.squeeze_sql('t')}) > 20"""),
    "tokenize": _token_shape(B.words_sql("text"), "words") + " UNION ALL " + _token_shape(B.spaces_sql("text"), "whitespace"),
    "stopword_filter": f"""WITH t AS (SELECT unnest({B.spaces_sql('text')}) AS token FROM documents),
        x AS (SELECT DISTINCT unnest({B.spaces_sql('text')}) AS token FROM benchmark)
        SELECT token, count(*) AS n FROM t WHERE length(token) > 2 AND token NOT IN ({B.COMMON_SQL})
          AND token NOT IN (SELECT token FROM x) GROUP BY token""",
    "ngram_counts": f"""WITH k AS (SELECT list_filter({B.words_sql('text')}, lambda w: w NOT IN ({B.STOP_SQL})) AS toks
          FROM documents),
        g AS (SELECT unnest(list_concat(toks, {_ngram_sql('toks', 2)}, {_ngram_sql('toks', 3)})) AS term FROM k)
        SELECT term, count(*) AS n FROM g GROUP BY term""",
    "chunk_documents": f"""WITH k AS (SELECT doc_id, text,
          list_filter(string_split_regex(text, '{B.WS}'), lambda w: w <> '') AS toks FROM documents),
        s AS (SELECT *, len(toks) AS n, CASE WHEN len(toks) > 512 THEN range(0, len(toks) - 128, 384) ELSE [0] END AS starts
          FROM k WHERE len(toks) > 0),
        c AS (SELECT doc_id, text, toks, n, unnest(starts) AS st, generate_subscripts(starts, 1) - 1 AS chunk_no FROM s)
        SELECT doc_id, chunk_no::INT AS chunk_no,
          CASE WHEN n > 512 THEN array_to_string(toks[st + 1:st + 512], ' ') ELSE text END AS text,
          (CASE WHEN n > 512 THEN st ELSE 0 END)::INT AS start_pos,
          (CASE WHEN n > 512 THEN least(st + 512, n) ELSE length(text) END)::INT AS end_pos FROM c""",
    "parse_seeds": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seed_id FROM documents),
        w AS (SELECT doc_id, seed_id, list_filter(list_transform(string_split(line, ','), lambda x: trim(x)),
          lambda x: x <> '') AS ws FROM l)
        SELECT doc_id, seed_id::INT AS seed_id, len(ws)::INT AS n_words, array_to_string(ws, '|') AS words FROM w
        WHERE len(ws) > 0""",
    "title_case": f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS phrase,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations),
        c AS (SELECT *, {B.squeeze_sql("regexp_replace(phrase, '[^\\p{L}\\p{N}_\\s-]', ' ', 'g')")} AS clean FROM l),
        w AS (SELECT *, list_filter(string_split(clean, ' '), lambda x: x <> '') AS ws FROM c),
        b AS (SELECT *, list_transform(ws, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_-]', '', 'g')) AS bs FROM w)
        SELECT conv_id, turn, line::INT AS line, clean, array_to_string(list_transform(bs, lambda x, i: CASE
          WHEN upper(x) IN ({_ACRONYMS}) THEN upper(x)
          WHEN i > 1 AND lower(x) IN ({_SMALL}) THEN lower(x)
          ELSE CASE substring(x, 1, 1) WHEN 'ß' THEN 'Ss' ELSE upper(substring(x, 1, 1)) END || lower(substring(x, 2)) END), ' ') AS title FROM b""",
    "validate_vectors": """WITH j AS (SELECT d.doc_id AS d, e.vec_id AS v,
          e.vec_id IS NOT NULL AND len(list_filter(e.embedding, lambda x: x <> 0)) = 0 AS z
          FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id),
        a AS (SELECT count(d) AS documents, count(v) AS vectors,
          count(*) FILTER (d IS NOT NULL AND v IS NOT NULL) AS paired, count(*) FILTER (z) AS zero_vectors FROM j)
        SELECT *, CASE WHEN documents <> vectors OR paired <> documents THEN 'misaligned'
          WHEN zero_vectors > 0.5 * vectors THEN 'mostly_zero' ELSE 'ok' END AS status FROM a""",
    "zero_vectors": """SELECT d.doc_id, e.vec_id IS NULL OR len(list_filter(e.embedding, lambda x: x <> 0)) = 0 AS is_zero,
        CASE WHEN e.vec_id IS NULL OR len(list_filter(e.embedding, lambda x: x <> 0)) = 0 THEN -1 ELSE e.label END AS topic
        FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
    "excerpt": "SELECT doc_id, " + ", ".join(
        f"CASE WHEN length(text) > {n} THEN substring(text, 1, {n}) || '...' ELSE text END AS first_{n}"
        for n in (100, 150, 200, 300, 500)) + """,
        CASE WHEN doc_id % 50 + 1 >= 40 THEN 400 WHEN doc_id % 50 + 1 >= 20 THEN 500 WHEN doc_id % 50 + 1 >= 10 THEN 600
        ELSE 800 END AS prompt_chars FROM documents""",
    "parse_topic_ref": """WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN text
          ELSE 'About Topic  ' || (length(text) % 14) || ': ' || text END AS text FROM conversations WHERE role = 'user'),
        n AS (SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(lower(text), 'topic\\s+(\\d+)', 1), '') AS INT) AS t FROM q)
        SELECT conv_id, turn, k.label AS topic_filter FROM n
        LEFT JOIN (SELECT DISTINCT label FROM embeddings) k ON n.t = k.label""",
    "query_key": """SELECT md5(lower(trim(text))) AS query_key, min(conv_id * 1000 + turn) AS first_id, count(*) AS uses
        FROM conversations GROUP BY 1""",
}
