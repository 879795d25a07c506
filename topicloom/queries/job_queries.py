"""Documents chosen for a model, prompts, responses, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import embedding as C
from topicloom.operators import keywords as K
from topicloom.operators import model_jobs as I
from topicloom.operators import preprocess as P
from topicloom.plans import topic_run as R
from topicloom.plans.execution import materialise, scratch_path
from topicloom.queries import base as B
from topicloom.queries.analytics_queries import CENTERS, INFO, KEYWORDS, named_info
from topicloom.queries.search_queries import BENCH, CEN_ARR, ENC, QVEC, VEC, encode_sql, l2_sql
from topicloom.constants import ANSWER_OPENERS, LABEL_PLACEHOLDERS, SUMMARY_LEAD_INS

# --- Spark ------------------------------------------------------------------------------------


def representatives(spark, sf):
    return I.select_representatives(B.vectors(spark, sf), 10)


def nearest_docs(spark, sf):
    return I.with_raw_text(I.nearest_docs(B.vectors(spark, sf), 8), B.table(spark, sf, "documents"))


def sample_positions(spark, sf):
    return I.sample_positions(B.assignment(spark, sf), 8)


def sample_7_7_6(spark, sf):
    return I.sample_7_7_6(B.assignment(spark, sf))


def _first_samples(spark, sf, n):
    from topicloom.plans.execution import top_k

    docs = B.topic_documents(spark, sf).where("topic <> -1")
    return top_k(docs.select("topic", "doc_id", "text"), ["topic"], [F.col("doc_id")], n).select(
        "topic", F.col("rank").alias("pos"), "text")


def label_prompts(spark, sf):
    keywords = K.stored_keywords(B.topic_documents(spark, sf))
    return I.label_prompts(_first_samples(spark, sf, 8), keywords, 8, 4).withColumn(
        "topics", F.array_join(F.transform("topics", lambda t: t.cast("string")), ","))


def summary_prompts(spark, sf):
    docs = B.topic_documents(spark, sf)
    chosen = materialise(I.sample_7_7_6(B.assignment(spark, sf)), "chosen")
    samples = I.with_raw_text(chosen, docs).select("topic", F.col("doc_id").alias("pos"), "text")
    return I.summary_prompts(samples, named_info(spark, sf).where("topic <> -1"))


def _length_model():
    """A stand-in model: fails once on prompts of odd length, always on very short ones."""
    def call(prompt: str, attempt: int) -> str | None:
        if len(prompt) < 20 or (len(prompt) % 2 == 1 and attempt == 0):
            raise TimeoutError
        return f"{len(prompt)} characters"
    return call


def apply_model(spark, sf):
    prompts = B.documents(spark, sf).withColumnRenamed("text", "prompt")
    return I.apply_model(prompts, _length_model, key="doc_id")


def turns(spark, sf):
    return B.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("batch"), "conv_id", "turn", "text")


def parse_labels(spark, sf):
    """Every conversation turn as a response: its lines numbered 1 to 4 round and round; batches have three topics."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i % 4 + 1).cast("string"), F.lit(": "), x))
    rows = turns(spark, sf).select("batch", F.array_join(lines, "\n").alias("response"))
    return I.parse_labels(rows, sizes=rows.select("batch", F.lit(3).alias("size")))


def parse_labels_strict(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Topic "), (i % 4 + 1).cast("string"), F.lit(": "), x))
    rows = turns(spark, sf).select("batch", F.array_join(lines, "\n").alias("response"))
    return I.parse_labels(rows, strict=True, sizes=rows.select("batch", F.lit(3).alias("size")))


def clean_summaries(spark, sf):
    rows = turns(spark, sf).withColumn("kind", (F.col("conv_id") + F.col("turn")) % 5)
    text = F.col("text")
    response = (
        F.when(F.col("kind") == 0, F.concat(F.lit("Answer: "), text)).when(F.col("kind") == 1, F.concat(F.lit('"'), text, F.lit('"')))
        .when(F.col("kind") == 2, F.concat(F.lit("In this topic, "), text))
        .when(F.col("kind") == 3, F.concat(F.lit(" Summary:\n\n"), text, F.lit("\n\n"), text)).otherwise(text))
    return rows.select("batch", I.clean_summary(response).alias("summary"))


def labels_with_fallback(spark, sf):
    """Model labels for even topics, keywords for the others."""
    keywords = K.stored_keywords(B.topic_documents(spark, sf))
    model = keywords.where("topic % 2 = 0").select("topic", F.concat(F.lit("Model label "), F.col("topic").cast("string")).alias("label"))
    rows = I.labels_with_fallback(model, keywords.select("topic", F.col("keywords").alias("label")))
    counts = I.label_counts(rows)
    return rows.crossJoin(counts)  # one row of counts


def attach_analysis(spark, sf):
    info = materialise(named_info(spark, sf), "info")
    summaries = info.where("topic % 3 = 0").select("topic", F.concat(F.lit("About "), F.col("keywords")).alias("summary"))
    shown = info.select("topic", F.least(F.col("count"), F.lit(8)).alias("shown"))
    return I.attach_analysis(info, summaries, shown).select("topic", "count", "human_label", "analysis")


def extract_answer(spark, sf):
    rows = turns(spark, sf).withColumn("kind", (F.col("conv_id") + F.col("turn")) % 5)
    text, question = F.col("text"), F.lit("What is it about?")
    response = (
        F.when(F.col("kind") == 0, F.concat(F.lit("Documents\nAnswer: "), text))
        .when(F.col("kind") == 1, F.concat(F.lit("Documents\nUser Question: "), question, F.lit(" Based on these. "), text))
        .when(F.col("kind") == 2, F.concat(F.lit("Documents\nUser Question: none\n"), text))
        .when(F.col("kind") == 3, F.concat(text, F.lit("\nAccording to these:\n"), text)).otherwise(text))
    return rows.select("batch", I.extract_answer(response, question).alias("answer"))


def _count_answer(prompts):
    """A stand-in for a model: says how long the context is."""
    return prompts.withColumn("answer", F.concat(F.lit("context of "), F.length("context").cast("string"), F.lit(" characters")))


def answer_batch(spark, sf):
    """Benchmark texts as questions; every second one names a topic.  Chunks are retrieved and reranked."""
    docs = B.topic_documents(spark, sf)
    vocabulary = materialise(C.fit_encoder(docs), "vocabulary")
    encode = lambda rows: C.encode_in_rows(rows, vocabulary, 64)
    items = R.chunk_items(docs, docs, encode, scratch_path(spark, "chunks"))
    asked = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    named = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Topic "), (F.col("doc_id") % 14).cast("string"), F.lit(": "), F.col("text"))).otherwise(
        F.col("text"))
    questions = encode(asked).join(asked.select("doc_id", named.alias("text")), "doc_id").withColumnRenamed("doc_id", "query_id")
    return R.answer_batch(questions, items, named_info(spark, sf), _count_answer, k=5)


QUERIES = {
    f.__name__: f for f in (
        representatives, nearest_docs, sample_positions, sample_7_7_6, label_prompts, summary_prompts, apply_model,
        parse_labels, parse_labels_strict, clean_summaries, labels_with_fallback, attach_analysis, extract_answer, answer_batch)
}

# --- DuckDB -----------------------------------------------------------------------------------

DIST = f"ds AS (SELECT v.topic, v.item_id AS doc_id, round({l2_sql('x', 'c')}, 10) AS d FROM v JOIN cl ON v.topic = cl.topic)"
RN = """rn AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY topic) AS n
  FROM assign WHERE topic <> -1)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def trim_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{B.WS}|{B.WS}$', '', 'g')"


def _parse(prefix: str, strict: bool) -> str:
    line = f"{prefix}((i - 1) % 4 + 1) || ': ' || x"
    if strict:
        number = "regexp_replace(regexp_extract(t, '(?is)^(topic [^:]*):.*$', 1), '[^0-9]', '', 'g')"
        label = "regexp_replace(trim(regexp_extract(t, '(?is)^topic [^:]*:(.*)$', 1)), '^[\"''.,;]+|[\"''.,;]+$', '', 'g')"
        limits, bad = (5, 70, 2, 8), LABEL_PLACEHOLDERS
    else:
        pat = r"'(?is)^(?:topic\s*)?(\d+)[\s:.)]+(.+)$'"
        number = f"regexp_extract(t, {pat}, 1)"
        strip = r"[ \"''.,;\[\](){}]"
        label = B.squeeze_sql(f"regexp_replace(trim(regexp_extract(t, {pat}, 2)), '^{strip}+|{strip}+$', '', 'g')")
        label = f"regexp_replace({label}, '(?i)^(category name|label):\\s*', '')"
        limits, bad = (5, 200, 2, 20), ["help buy", "question buy", "[", "]"]
    no_bad = " AND ".join(f"NOT contains(lower(label), '{b}')" for b in bad)
    final = "label" if strict else """CASE WHEN NOT contains(label, ' - ') AND len(w) >= 3 THEN array_to_string(w[1:len(w) // 2], ' ') || ' - '
        || array_to_string(w[len(w) // 2 + 1:], ' ') ELSE label END"""
    return f"""WITH s AS (SELECT conv_id * 1000 + turn AS batch, string_split(array_to_string(list_transform(string_split(text, chr(10)),
          lambda x, i: {line}), chr(10)), chr(10)) AS ls FROM conversations),
        l AS (SELECT batch, {trim_sql('unnest(ls)')} AS t, generate_subscripts(ls, 1) AS line FROM s),
        p AS (SELECT batch, line, TRY_CAST(nullif({number}, '') AS INT) AS number, {label} AS label FROM l),
        q AS (SELECT *, list_filter(string_split_regex(label, '{B.WS}'), lambda x: x <> '') AS w FROM p),
        f AS (SELECT * FROM q WHERE number BETWEEN 1 AND 3 AND length(label) BETWEEN {limits[0]} AND {limits[1]}
          AND len(w) BETWEEN {limits[2]} AND {limits[3]} AND {no_bad}),
        a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY batch, lower(label) ORDER BY line) = 1),
        b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY batch, number ORDER BY line DESC) = 1)
        SELECT batch, number, {final} AS label FROM b"""


def _lead_in(expr: str) -> str:
    cases = ""
    for lead in SUMMARY_LEAD_INS:
        rest = f"regexp_replace({trim_sql(f'substring({expr}, {len(lead) + 1})')}, '^[:,.\\- ]+', '')"
        cases += f" WHEN starts_with({expr}, '{lead}') AND length({rest}) > 10 THEN {rest}"
    return f"CASE{cases} ELSE {expr} END"




def _strip_summary(expr: str) -> str:
    edge = "[\"''\\[\\](){}]+"
    return f"regexp_replace({expr}, '^{edge}|{edge}$', '', 'g')"


def _lines(expr: str) -> str:
    return f"list_filter(list_transform(string_split({expr}, chr(10)), lambda x: {trim_sql('x')}), lambda x: x <> '')"


_OPEN = "|".join(ANSWER_OPENERS)
_docs_block = "string_agg('{0}' || pos || '. ' || substring(text, 1, {1}), chr(10) ORDER BY pos)"

ORACLES = {
    "representatives": B.with_sql(VEC, CENTERS, CEN_ARR, DIST,
        "nr AS (SELECT topic, doc_id FROM ds QUALIFY row_number() OVER (PARTITION BY topic ORDER BY d, doc_id) <= 7)",
        """rs AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY topic) AS n
          FROM ds WHERE doc_id NOT IN (SELECT doc_id FROM nr))""",
        body="""SELECT topic, doc_id, 'near' AS kind FROM nr UNION ALL SELECT topic, doc_id, 'spaced' FROM rs
        WHERE r % greatest(1, n // 3) = 0 AND r // greatest(1, n // 3) < 3"""),
    "nearest_docs": B.with_sql(VEC, CENTERS, CEN_ARR, DIST, body="""SELECT d.doc_id, d.text, ds.topic,
        (row_number() OVER (PARTITION BY ds.topic ORDER BY d, ds.doc_id))::INT AS rank FROM ds JOIN documents d ON ds.doc_id = d.doc_id
        QUALIFY rank <= 8""".replace("ORDER BY d,", "ORDER BY ds.d,")),
    "sample_positions": B.with_sql(B.ASSIGN, RN,
        "fx AS (SELECT topic, doc_id FROM rn WHERE n > 8 AND r IN (0, n // 4, n // 2, 3 * n // 4, n - 1))",
        """ex AS (SELECT topic, doc_id FROM rn WHERE n > 8 AND doc_id NOT IN (SELECT doc_id FROM fx)
          QUALIFY row_number() OVER (PARTITION BY topic ORDER BY md5(doc_id || '|42')) <= 3)""",
        body="SELECT * FROM fx UNION ALL SELECT * FROM ex UNION ALL SELECT topic, doc_id FROM rn WHERE n <= 8"),
    "sample_7_7_6": B.with_sql(B.ASSIGN, RN, body="""SELECT topic, doc_id FROM rn WHERE n <= 20 OR r < 7 OR r >= n - 6
        OR r BETWEEN n // 2 - 3 AND n // 2 + 3"""),
    "label_prompts": B.with_sql(B.TDOCS, KEYWORDS,
        "ft AS (SELECT topic, text, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS pos FROM tdocs WHERE topic <> -1 QUALIFY pos <= 8)",
        f"bl AS (SELECT topic, {_docs_block.format('Document ', 800)} AS block FROM ft GROUP BY topic)",
        "nb AS (SELECT k.topic, keywords, block, row_number() OVER (ORDER BY k.topic) - 1 AS n FROM keywords k JOIN bl ON k.topic = bl.topic)",
        body=f"""SELECT (n // 4)::INT AS batch, string_agg(topic::VARCHAR, ',' ORDER BY n) AS topics,
        {quoted(I.LABEL_TASK)} || chr(10) || chr(10) || string_agg('Topic ' || (n % 4 + 1) || chr(10) || 'Keywords: ' || keywords || chr(10) || block,
          chr(10) || chr(10) ORDER BY n) AS prompt FROM nb GROUP BY n // 4"""),
    "summary_prompts": B.with_sql(INFO, RN,
        """ch AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS pos FROM rn
          WHERE n <= 20 OR r < 7 OR r >= n - 6 OR r BETWEEN n // 2 - 3 AND n // 2 + 3)""",
        f"bl AS (SELECT ch.topic, {_docs_block.format('', 300)} AS block, count(*) AS shown FROM ch JOIN documents d ON ch.doc_id = d.doc_id GROUP BY ch.topic)",
        body=f"""SELECT i.topic, {quoted(I.SUMMARY_TASK)} || chr(10) || chr(10) || 'Label: ' || human_label || chr(10) || 'Keywords: ' || keywords
        || chr(10) || 'Documents shown: ' || shown || chr(10) || block AS prompt FROM info i JOIN bl ON i.topic = bl.topic"""),
    "apply_model": """SELECT doc_id, CASE WHEN length(text) >= 20 THEN length(text) || ' characters' END AS response,
        CASE WHEN length(text) < 20 THEN 3 WHEN length(text) % 2 = 1 THEN 2 ELSE 1 END AS tries FROM documents""",
    "parse_labels": _parse("", False),
    "parse_labels_strict": _parse("'Topic ' || ", True),
    "clean_summaries": f"""WITH r AS (SELECT conv_id * 1000 + turn AS batch, {trim_sql("""CASE (conv_id + turn) % 5 WHEN 0 THEN 'Answer: ' || text
          WHEN 1 THEN '"' || text || '"' WHEN 2 THEN 'In this topic, ' || text
          WHEN 3 THEN ' Summary:' || chr(10) || chr(10) || text || chr(10) || chr(10) || text ELSE text END""")} AS t FROM conversations),
        u AS (SELECT batch, {_lead_in('t')} AS t FROM r),
        x AS (SELECT batch, {_strip_summary("array_to_string(" + _lines('t') + ", chr(10))")} AS t FROM u)
        SELECT batch, CASE WHEN length(t) >= 5 AND len(list_filter(string_split_regex(t, '{B.WS}'), lambda w: w <> '')) >= 2 THEN
          CASE WHEN length(t) > 2000 THEN {trim_sql("regexp_replace(substring(t, 1, 2000), '(?s)^(.*) .*$', '\\1')")} || '...' ELSE t END END AS summary FROM x""",
    "labels_with_fallback": B.with_sql(B.TDOCS, KEYWORDS, body="""SELECT topic, CASE WHEN topic % 2 = 0 THEN 'Model label ' || topic ELSE keywords END AS label,
        CASE WHEN topic % 2 = 0 THEN 'model' ELSE 'fallback' END AS source, count(*) FILTER (topic % 2 = 0) OVER () AS model_count,
        count(*) FILTER (topic % 2 <> 0) OVER () AS fallback_count, count(*) OVER () AS total FROM keywords"""),
    "attach_analysis": B.with_sql(INFO, body="""SELECT topic, count, human_label, CASE WHEN topic = -1 THEN '' WHEN topic % 3 = 0 THEN 'About ' || keywords
        ELSE 'Topic related to ' || keywords || '. Contains ' || least(count, 8) || ' documents discussing ' || lower(human_label) || '.' END AS analysis FROM info"""),
    "extract_answer": f"""WITH r AS (SELECT conv_id * 1000 + turn AS batch, (conv_id + turn) % 5 AS kind, text FROM conversations),
        z AS (SELECT batch, kind, text, CASE kind WHEN 3 THEN text || chr(10) || 'According to these:' || chr(10) || text ELSE text END AS resp FROM r),
        y AS (SELECT *, {_lines('resp')} AS ls FROM z),
        x AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(lower(x), '{_OPEN}')), true) AS f FROM y)
        SELECT batch, CASE kind WHEN 0 THEN {trim_sql('text')} WHEN 1 THEN {trim_sql('text')} WHEN 2 THEN {trim_sql("'none' || chr(10) || text")}
          ELSE CASE WHEN f > 0 THEN array_to_string(ls[f:], chr(10)) ELSE {trim_sql('substring(resp, floor(length(resp) * 0.6)::INT + 1)')} END END AS answer FROM x""",
    "answer_batch": B.with_sql(INFO, ENC, f"""ck_t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{B.WS}'), lambda w: w <> '') AS toks FROM documents),
        ck_s AS (SELECT *, len(toks) AS n, CASE WHEN len(toks) > 512 THEN range(0, len(toks) - 128, 384) ELSE [0] END AS starts FROM ck_t WHERE len(toks) > 0),
        ck_c AS (SELECT doc_id, text, toks, n, unnest(starts) AS st, generate_subscripts(starts, 1) - 1 AS chunk_no FROM ck_s),
        ck AS (SELECT doc_id AS parent, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS doc_id,
          CASE WHEN n > 512 THEN array_to_string(toks[st + 1:st + 512], ' ') ELSE text END AS text FROM ck_c),
        cw_k AS (SELECT doc_id, unnest({B.words_sql('text')}) AS term FROM ck),
        cw AS (SELECT doc_id, term, count(*) AS n FROM cw_k GROUP BY 1, 2)""", encode_sql("cv", "cw", "ck"), BENCH, QVEC,
        "tp AS (SELECT DISTINCT topic FROM assign)",
        """qs AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN 'Topic ' || (doc_id % 14) || ': ' || text ELSE text END AS query_text,
          CASE WHEN doc_id % 2 = 0 AND (doc_id % 14) IN (SELECT topic FROM tp) THEN (doc_id % 14)::INT END AS topic_filter FROM bq)""",
        f"""hz AS (SELECT qs.query_id, qs.query_text, c.doc_id AS item_id, c.text, a.topic, round({l2_sql('q.x', 'd.x')}, 10) AS distance
          FROM qs JOIN qv q ON qs.query_id = q.doc_id JOIN assign a ON qs.topic_filter IS NULL OR a.topic = qs.topic_filter JOIN ck c ON c.parent = a.doc_id
          JOIN cv d ON d.doc_id = c.doc_id QUALIFY row_number() OVER (PARTITION BY qs.query_id ORDER BY distance, c.doc_id) <= 15)""",
        f"hw AS (SELECT query_id, item_id, list_distinct({B.words_sql('query_text')}) AS q, {B.words_sql('text')} AS t FROM hz)",
        "sz AS (SELECT query_id, count(*) AS hits, avg(len(t)) AS mean_len FROM hw GROUP BY 1)",
        "mt AS (SELECT query_id, item_id, len(t) AS len, unnest(list_filter(t, lambda w: list_contains(q, w))) AS term FROM hw)",
        "tf AS (SELECT query_id, item_id, len, term, count(*) AS n_tf FROM mt GROUP BY query_id, item_id, len, term)",
        "df AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS n_df FROM tf)",
        """sc AS (SELECT query_id, item_id, round(sum(ln(1 + (sz.hits - n_df + 0.5) / (n_df + 0.5)) * n_tf * 2.5 / (n_tf + 1.5 * (0.25 + 0.75 * len / mean_len))), 6) AS s
          FROM df JOIN sz USING (query_id) GROUP BY 1, 2)""",
        """ht AS (SELECT hz.*, coalesce(s, 0) AS score, row_number() OVER (PARTITION BY hz.query_id ORDER BY coalesce(s, 0) DESC, distance, hz.item_id) AS r
          FROM hz LEFT JOIN sc ON hz.query_id = sc.query_id AND hz.item_id = sc.item_id QUALIFY r <= 5)""",
        """cx AS (SELECT query_id, string_agg('[Doc ' || r || '] [from Topic ' || topic || ']: ' || CASE WHEN length(text) > 300
          THEN substring(text, 1, 300) || '...' ELSE text END, chr(10) ORDER BY r) AS context,
          string_agg(r || '. ' || CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END
          || ' [Topic ' || topic || '] (relevance: ' || printf('%.3f', score) || ')', chr(10) ORDER BY r) FILTER (r <= 3) AS sources FROM ht GROUP BY 1)""",
        """hd AS (SELECT qs.query_id, topic_filter, coalesce('Currently viewing Topic ' || i.topic || ': ' || i.human_label || chr(10) || 'Keywords: '
          || i.keywords || chr(10), '') || context AS context, sources FROM qs LEFT JOIN cx ON qs.query_id = cx.query_id
          LEFT JOIN info i ON i.topic = topic_filter AND i.topic <> -1)""",
        body="SELECT query_id, topic_filter, context, 'context of ' || length(context) || ' characters' AS answer, sources FROM hd"),
}
