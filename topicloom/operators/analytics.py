"""Counts, shares, balance, rankings and views over an assignment ``(doc_id, topic)``.

Row-sized tables are aggregated before anything else; windows without a
partition run on topic-sized tables only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators.similarity import score_pairs
from topicloom.operators.terms import document_terms
from topicloom.plans.execution import lookup_join, materialise, top_k


def every():
    """The whole table as one window; used on topic-sized tables only."""
    return Window.partitionBy()


def is_outlier() -> Column:
    return F.col("topic") == -1


def topic_counts(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("topic").agg(F.count("*").alias("count"))


def topic_distribution(assignment: DataFrame, digits: int = 2, with_outliers: bool = True) -> DataFrame:
    """(topic, count, percentage)."""
    counts = topic_counts(assignment)
    shares = counts.withColumn(
        "percentage", F.round(100.0 * F.col("count") / F.sum("count").over(every()), digits))
    return shares if with_outliers else shares.where(~is_outlier())


def _summary_columns(total: Column, outliers: Column, topics: Column) -> list[Column]:
    return [
        total.alias("documents"), topics.alias("topics"), outliers.alias("outliers"),
        F.round(F.try_divide(100.0 * (total - outliers), total), 1).alias("coverage"),
        F.round(F.try_divide((total - outliers).cast("double"), topics), 2).alias("mean_docs"),
    ]


def topic_summary(assignment: DataFrame) -> DataFrame:
    """One row: documents, topics, outliers, coverage %, mean documents per topic."""
    counts = topic_counts(assignment)
    return counts.agg(
        F.sum("count").alias("total"),
        F.coalesce(F.sum(F.when(is_outlier(), F.col("count"))), F.lit(0)).cast("bigint").alias("out"),
        F.count_if(~is_outlier()).alias("n"),
    ).select(*_summary_columns(F.col("total"), F.col("out"), F.col("n")))


def _ratios(assignment: DataFrame) -> DataFrame:
    counts = topic_counts(assignment).where(~is_outlier())
    return counts.withColumn("ratio", F.col("count") / F.sum("count").over(every()))


def oversized_topics(assignment: DataFrame, max_ratio: float = 0.30, ideal_ratio: float = 0.20) -> DataFrame:
    """(topic, count, ratio, suggested_splits) of topics above ``max_ratio``."""
    big = _ratios(assignment).where(F.col("ratio") > max_ratio)
    splits = F.greatest(F.lit(2), F.floor(F.col("ratio") / ideal_ratio).cast("int"))
    return big.select("topic", "count", F.round("ratio", 6).alias("ratio"), splits.alias("suggested_splits"))


def balance(assignment: DataFrame, max_ratio: float = 0.30) -> DataFrame:
    """One row: is any topic oversized, balance score, number of topics, outlier ratio."""
    counts = topic_counts(assignment)
    inlier = F.when(~is_outlier(), F.col("count"))
    with_total = counts.withColumn("kept", F.sum(inlier).over(every())).withColumn("ratio", inlier / F.col("kept"))
    spread = F.coalesce(F.stddev_pop("ratio"), F.lit(0.0))
    return with_total.agg(
        (F.count_if(F.col("ratio") > max_ratio) == 0).alias("no_big"),
        F.count("ratio").alias("topics"),
        F.round(1 - spread, 6).alias("score"),
        F.count_if(F.col("ratio") > max_ratio).alias("oversized"),
        F.round(1 - F.coalesce(F.sum(inlier), F.lit(0)) / F.sum("count"), 6).alias("outlier_ratio"),
    ).select(
        (F.col("no_big") & (F.col("topics") > 0)).alias("balanced"),
        F.when(F.col("topics") > 0, F.col("score")).alias("balance_score"),
        "oversized", "topics", "outlier_ratio",
    )


def top_and_others(assignment: DataFrame, shown: int = 10, bars: int = 20) -> DataFrame:
    """(section, position, name, count, percentage): the largest topics, and the largest plus ``Others``."""
    shares = topic_distribution(assignment, 1)
    ordered = materialise(shares.withColumn(
        "position", F.row_number().over(Window.orderBy(F.col("count").desc(), "topic"))), "topic-order")
    name = F.col("topic").cast("string").alias("name")
    top = ordered.where(F.col("position") <= bars).select(
        F.lit("top").alias("section"), "position", name, "count", "percentage")
    pie = ordered.where(F.col("position") <= shown).select(
        F.lit("share").alias("section"), "position", name, "count", "percentage")
    rest = ordered.agg(
        F.sum(F.when(F.col("position") > shown, F.col("count"))).alias("count"), F.sum("count").alias("total")
    ).where(F.col("count") > 0).select(
        F.lit("share").alias("section"), F.lit(shown + 1).alias("position"), F.lit("Others").alias("name"),
        "count", F.round(100.0 * F.col("count") / F.col("total"), 1).alias("percentage"))
    return top.unionByName(pie).unionByName(rest)


def leaderboard(info: DataFrame, n: int = 5, largest: bool = True) -> DataFrame:
    """(position, topic, human_label, count, percentage) of the n largest or smallest topics."""
    total = F.sum("count").over(every())
    rows = info.select("topic", "human_label", "count", F.round(100.0 * F.col("count") / total, 1).alias("percentage"))
    size = F.col("count").desc() if largest else F.col("count").asc()
    position = F.row_number().over(Window.orderBy(size, "topic"))
    return rows.select(position.alias("position"), "*").where(F.col("position") <= n)


def topic_lookup(info: DataFrame, topics: list[int]) -> DataFrame:
    total = F.sum("count").over(every())
    rows = info.withColumn("percentage", F.round(100.0 * F.col("count") / total, 1))
    return rows.where(F.col("topic").isin(topics)).select("topic", "human_label", "count", "percentage", "keywords")


def browse(rows: DataFrame, topic: int | None = None, n: int = 1000) -> DataFrame:
    """The first n rows of one topic, or of all."""
    chosen = rows if topic is None else rows.where(F.col("topic") == topic)
    return chosen.orderBy("doc_id").limit(n)


def attach_topics(rows: DataFrame, assignment: DataFrame, info: DataFrame) -> DataFrame:
    """Every input row with its topic, labels, keywords, analysis and a flag for cleaned documents."""
    seen = assignment.select("doc_id", F.col("topic").alias("_topic"))
    tagged = rows.join(seen, "doc_id", "left").withColumn("topic", F.coalesce("_topic", F.lit(-1)))
    named = info.select("topic", "human_label", "keywords", "analysis")
    label = F.when(is_outlier(), "Outlier").otherwise(F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    full = lookup_join(tagged, named, ["topic"], "left")
    return full.select(
        *rows.columns, "topic",
        label.alias("topic_label"),
        F.coalesce("human_label", label).alias("topic_human_label"),
        F.coalesce("keywords", F.lit("N/A")).alias("topic_keywords"),
        F.coalesce("analysis", F.lit("")).alias("topic_analysis"),
        F.col("_topic").isNotNull().alias("valid_document"),
    )


def topic_menu(info: DataFrame) -> DataFrame:
    """(position, entry, topic): all topics first, ids ascending, outliers last."""
    label = F.coalesce("human_label", F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    docs = F.concat(F.lit(" ("), F.col("count").cast("string"), F.lit(" docs)"))
    entry = F.when(is_outlier(), F.concat(F.lit("Outliers"), docs)).otherwise(
        F.concat(F.lit("Topic "), F.col("topic").cast("string"), F.lit(": "), label, docs))
    rows = info.select(
        (F.row_number().over(Window.orderBy(is_outlier(), "topic"))).alias("position"), entry.alias("entry"),
        F.col("topic").cast("string").alias("topic"))
    everything = info.agg(F.count("*")).select(
        F.lit(0).alias("position"), F.lit("All Topics").alias("entry"), F.lit("all").alias("topic"))
    return everything.unionByName(rows)


def topic_groups(labels: DataFrame) -> DataFrame:
    """(group_name, topics, documents) by the first word of the label after its numeric id.

    ``labels`` is ``(doc_id, topic_label)``.
    """
    per_label = labels.groupBy("topic_label").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("topic_label", r"^-?\d+_", "")
    name = F.when(F.contains("topic_label", F.lit("Outliers")), "Outliers").otherwise(F.split(bare, "_")[0])
    return per_label.groupBy(name.alias("group_name")).agg(
        F.count("*").alias("topics"), F.sum("n").alias("documents"))


def samples_per_topic(rows: DataFrame, k: int = 5, preview: int = 200) -> DataFrame:
    """(topic, rank, doc_id, preview): the first k documents of each topic."""
    first = top_k(rows.select("topic", "doc_id", "text"), ["topic"], [F.col("doc_id")], k)
    return first.select("topic", "rank", "doc_id", T.excerpt(F.col("text"), preview).alias("preview"))


def topic_similarity(centers: DataFrame) -> DataFrame:
    """(topic_a, topic_b, similarity): cosine of every two topic centroids."""
    centers = materialise(centers, "centers")
    pairs = score_pairs(centers.select("topic", "centroid"), "centroid", centers, "topic", "centroid", "cosine",
                        "topic_b", "similarity")
    return pairs.select(F.col("topic").alias("topic_a"), F.col("topic_b").cast("int").alias("topic_b"),
                        F.round("similarity", 6).alias("similarity"))


def new_topics(assignment: DataFrame, info: DataFrame) -> DataFrame:
    return assignment.select("topic").distinct().join(info.select("topic"), "topic", "left_anti")


def chunk_stats(chunks: DataFrame, assignment: DataFrame) -> DataFrame:
    """(topic, chunks, documents, expansion): chunks per topic and how many times a document grew."""
    per_document = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = per_document.join(assignment, "doc_id")
    return joined.groupBy("topic").agg(
        F.sum("n").alias("chunks"), F.count("*").alias("documents"),
        F.round(F.sum("n") / F.count("*"), 4).alias("expansion"))


def topics_over_time(docs: DataFrame, bins: int = 10, words: int = 5, stop_words=None) -> DataFrame:
    """(topic, bin, bin_start, frequency, words) over equal-width time bins.

    ``docs`` is (doc_id, topic, ts, text).  Words of a (topic, bin) are the heaviest
    class-TF-IDF terms: term share inside the group times the corpus-wide idf.
    """
    from topicloom.constants import ENGLISH_STOP_WORDS

    stop_words = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    naive = docs.schema["ts"].dataType.typeName() == "timestamp_ntz"
    docs = docs.withColumn("ts", F.col("ts").cast("timestamp"))
    span = docs.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    low, width = span["lo"], max(1, -(-(span["hi"] - span["lo"]) // bins))
    bin_no = F.least(F.floor((F.unix_micros("ts") - low) / width).cast("int"), F.lit(bins - 1))
    binned = docs.withColumn("bin", bin_no)
    frequency = binned.groupBy("topic", "bin").agg(F.count("*").alias("frequency"))
    counts = materialise(document_terms(binned, keys=("topic", "bin"), stop_words=stop_words), "bin-terms")
    group_words = counts.groupBy("topic", "bin").agg(F.sum("n").alias("group_words"))
    mean_words = counts.groupBy("topic").agg(F.sum("n").alias("w")).agg(F.avg("w")).first()[0]
    with_f = counts.withColumn("f", F.sum("n").over(Window.partitionBy("term")))
    weighted = lookup_join(with_f, group_words, ["topic", "bin"]).select(
        "topic", "bin", "term",
        F.round(F.col("n") / F.col("group_words") * F.log(1 + F.lit(mean_words) / F.col("f")), 10).alias("weight"))
    best = top_k(weighted, ["topic", "bin"], [F.col("weight").desc(), F.col("term")], words)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    named = best.groupBy("topic", "bin").agg(F.transform(pairs, lambda p: p["term"]).alias("words"))
    start = F.timestamp_micros(F.lit(low) + F.col("bin") * F.lit(width))
    return frequency.join(named, ["topic", "bin"], "left").select(
        "topic", "bin", (start.cast("timestamp_ntz") if naive else start).alias("bin_start"),
        "frequency", "words")


def document_map_sample(assignment: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """At most n documents, chosen by a hash of the id: the same ones in every run."""
    draw = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(seed))))
    return assignment.withColumn("_draw", draw).orderBy("_draw").limit(n).drop("_draw")


# --- questions answered by rule ---------------------------------------------------------------

# Phrases that decide how a question is answered, tried in this order.
QUESTION_PHRASES = {
    "current_topic": ["current topic", "this topic", "about this"],
    "greeting": ["hello", "hi", "hey"],
    "counting": ["how many", "number of", "count"],
    "largest": ["largest", "biggest", "most common"],
    "smallest": ["smallest", "least common"],
    "overview": ["main theme", "overview", "summary", "what are"],
    "label_format": ["hierarchical", "hierarchy", "label format"],
    "help": ["help", "what can you"],
}


def _says(text: Column, route: str) -> Column:
    found = F.lit(False)
    for phrase in QUESTION_PHRASES[route]:
        found = found | F.contains(text, F.lit(phrase))
    return found


def route_questions(questions: DataFrame, info: DataFrame) -> DataFrame:
    """Add (route, topic, answer) to each question ``(..., text, current_topic)``."""
    info = materialise(info, "topic-info")
    facts = info.agg(F.sum("count").alias("_docs"), F.count_if(~is_outlier()).alias("_topics"))

    def listing(n: int, largest: bool, out: str) -> DataFrame:
        line = F.concat(F.col("human_label"), F.lit(" (Topic "), F.col("topic").cast("string"), F.lit("): "),
                        F.col("count").cast("string"), F.lit(" documents, "),
                        F.format_number("percentage", 1), F.lit("%"))
        rows = leaderboard(info, n, largest).select("position", line.alias("line"))
        ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
        return rows.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "; ").alias(out))

    one_row = facts.join(listing(5, True, "_large")).join(listing(5, False, "_small")).join(listing(3, True, "_main"))
    detail = F.concat(F.col("human_label"), F.lit(": "), F.col("count").cast("string"), F.lit(" documents ("),
                      F.format_number("percentage", 1), F.lit("%), keywords: "), F.col("keywords"))
    total = F.sum("count").over(every())
    details = info.withColumn("percentage", F.round(100.0 * F.col("count") / total, 1)).select(
        "topic", detail.alias("_detail"), F.col("count").alias("_count"), F.col("human_label").alias("_label"))

    q = F.lower("text")
    named = T.topic_reference(F.col("text"))
    asked = questions.withColumn("_q", q).withColumn("_named", named)
    current = details.select(F.col("topic").alias("current_topic"), F.col("_detail").alias("_cur_detail"),
                             F.col("_count").alias("_cur_count"), F.col("_label").alias("_cur_label"))
    by_name = details.select(F.col("topic").alias("_named"), F.col("_detail").alias("_named_detail"))
    asked = asked.join(F.broadcast(one_row))  # exactly one row
    asked = lookup_join(asked, current, ["current_topic"], "left")
    asked = lookup_join(asked, by_name, ["_named"], "left")
    text = F.col("_q")
    counting = _says(text, "counting")
    route = (
        F.when(_says(text, "current_topic") & F.col("_cur_detail").isNotNull(), "current_topic")
        .when(_says(text, "greeting"), "greeting")
        .when(counting & F.contains(text, F.lit("topic")), "topic_count")
        .when(counting & F.contains(text, F.lit("doc")), "document_count")
        .when(counting, "unanswered")
        .when(_says(text, "largest"), "largest")
        .when(_says(text, "smallest"), "smallest")
        .when(F.col("_named").isNotNull() & F.col("_named_detail").isNotNull(), "topic")
        .when(F.col("_named").isNotNull(), "unknown_topic")
        .when(_says(text, "overview"), "overview")
        .when(_says(text, "label_format"), "label_format")
        .when(_says(text, "help"), "help")
        .otherwise("other")
    )
    docs, topics = F.col("_docs").cast("string"), F.col("_topics").cast("string")
    routed = asked.withColumn("route", route)
    r = F.col("route")
    answer = (
        F.when(r == "current_topic", F.col("_cur_detail"))
        .when(r == "greeting", F.concat(F.lit("Hello."), F.coalesce(
            F.concat(F.lit(" You are viewing "), F.col("_cur_label"), F.lit(".")), F.lit(""))))
        .when(r == "topic_count", F.concat(topics, F.lit(" topics")))
        .when(r == "document_count", F.concat(F.coalesce(
            F.concat(F.lit("this topic: "), F.col("_cur_count").cast("string"), F.lit(", ")), F.lit("")),
            F.lit("all: "), docs))
        .when(r == "largest", F.col("_large"))
        .when(r == "smallest", F.col("_small"))
        .when(r == "topic", F.col("_named_detail"))
        .when(r == "unknown_topic", F.concat(F.lit("There is no topic "), F.col("_named").cast("string")))
        .when(r == "overview", F.concat(docs, F.lit(" documents in "), topics, F.lit(" topics. "), F.col("_main")))
        .when(r == "label_format", F.lit("Labels read: main category - specific details"))
        .when(r.isin("help", "other"), F.concat(
            F.lit("Ask about topic sizes, one topic, or an overview of "), docs, F.lit(" documents in "), topics, F.lit(" topics")))
    )
    return routed.select(*questions.columns, "route", F.col("_named").alias("topic"), answer.alias("answer"))
