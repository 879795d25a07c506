"""Jobs around a user's text model: documents to show, prompts, calls, and what comes back.

Prompts and responses are tables; the model itself is a callable that a task loads once.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.constants import ANSWER_OPENERS, LABEL_PLACEHOLDERS, SUMMARY_LEAD_INS, WHITESPACE
from topicloom.functions import text as T
from topicloom.operators.similarity import SCORE_DIGITS, stored_centroids
from topicloom.functions import vectors as V
from topicloom.plans.execution import lookup_join, materialise, rows_at_ranks, top_k


# --- documents to show ------------------------------------------------------------------------

def _to_centroid(vectors: DataFrame) -> DataFrame:
    """(topic, doc_id, distance) to the topic's own centroid."""
    centers = stored_centroids(vectors).select("topic", "centroid")
    tagged = lookup_join(vectors.select("topic", "doc_id", "embedding"), centers, ["topic"], stored=True)
    return tagged.select("topic", "doc_id", F.round(V.squared_l2(F.col("embedding"), F.col("centroid")), SCORE_DIGITS).alias("distance"))


def nearest_docs(vectors: DataFrame, n: int) -> DataFrame:
    """(topic, doc_id, rank): the n documents of each topic nearest to its centroid."""
    return top_k(_to_centroid(vectors.where("topic <> -1")), ["topic"], [F.col("distance"), F.col("doc_id")], n).select("topic", "doc_id", "rank")


def with_raw_text(chosen: DataFrame, raw: DataFrame) -> DataFrame:
    """Add the original, uncleaned text to chosen documents."""
    return lookup_join(raw.select("doc_id", "text"), chosen, ["doc_id"])


def select_representatives(vectors: DataFrame, n: int) -> DataFrame:
    """(topic, doc_id, kind): 70 % of n nearest to the centroid, the rest evenly spaced over what remains."""
    inlier = vectors.where("topic <> -1")
    near = materialise(nearest_docs(inlier, max(1, int(n * 0.7))), "near")
    taken = near.groupBy("topic").agg(F.count("*").alias("taken"))
    sizes = inlier.groupBy("topic").agg(F.count("*").alias("size"))
    plan = sizes.join(taken, "topic").select(
        "topic", (F.lit(n) - F.col("taken")).alias("want"), (F.col("size") - F.col("taken")).alias("rest")).where("want > 0 AND rest > 0")
    step = F.greatest(F.lit(1), F.floor(F.col("rest") / F.col("want")))
    slots = plan.select("topic", "want", "rest", step.alias("step")).select(
        "topic", "rest", F.explode(F.sequence(F.lit(0), F.col("want") - 1)).alias("i"), "step").select(
        "topic", (F.col("i") * F.col("step")).cast("bigint").alias("pos"), "rest").where("pos < rest").select("topic", "pos")
    ids = inlier.select("topic", "doc_id")
    remaining = lookup_join(ids, near.select("doc_id"), ["doc_id"], "left_anti")
    spaced = rows_at_ranks(remaining, "topic", "doc_id", materialise(slots, "slots"))
    return near.select("topic", "doc_id", F.lit("near").alias("kind")).unionByName(
        spaced.select("topic", "doc_id", F.lit("spaced").alias("kind")))


def _positions(assignment: DataFrame, more_than: int, positions: list[Column]) -> DataFrame:
    sizes = assignment.where("topic <> -1").groupBy("topic").agg(F.count("*").alias("n"))
    return materialise(sizes.where(F.col("n") > more_than).select("topic", F.explode(F.array_distinct(F.array(*[
        F.floor(p).cast("bigint") for p in positions]))).alias("pos")), "positions")


def _whole_small(assignment: DataFrame, at_most: int) -> DataFrame:
    sizes = assignment.where("topic <> -1").groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") <= at_most)
    return lookup_join(assignment.select("topic", "doc_id"), sizes.select("topic"), ["topic"]).select("topic", "doc_id")


def sample_positions(assignment: DataFrame, n: int = 8, seed: int = 42) -> DataFrame:
    """(topic, doc_id): documents at 0, 1/4, 1/2, 3/4 and the end, topped up to n by hash order; small topics whole."""
    size = F.col("n")
    spots = _positions(assignment, n, [F.lit(0), size / 4, size / 2, 3 * size / 4, size - 1])
    fixed = materialise(rows_at_ranks(assignment.where("topic <> -1"), "topic", "doc_id", spots).select("topic", "doc_id"), "fixed")
    large = spots.select("topic").distinct()
    others = lookup_join(lookup_join(assignment, large, ["topic"]), fixed.select("doc_id"), ["doc_id"], "left_anti")
    draw = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(seed))))
    extra = top_k(others.select("topic", "doc_id", draw.alias("_d")), ["topic"], [F.col("_d")], max(n - 5, 0)).select("topic", "doc_id")
    chosen = fixed if n <= 5 else fixed.unionByName(extra)
    return chosen.unionByName(_whole_small(assignment, n))


def sample_7_7_6(assignment: DataFrame) -> DataFrame:
    """(topic, doc_id, pos): first 7, middle 7 and last 6 documents of topics with more than 20, else all."""
    size = F.col("n")
    middle = F.floor(size / 2)
    spots = [*[F.lit(i) for i in range(7)], *[middle + i for i in range(-3, 4)], *[size - i for i in range(6, 0, -1)]]
    chosen = rows_at_ranks(assignment.where("topic <> -1"), "topic", "doc_id", _positions(assignment, 20, spots)).select("topic", "doc_id")
    return chosen.unionByName(_whole_small(assignment, 20))


# --- prompts ----------------------------------------------------------------------------------

LABEL_TASK = (
    "Name each topic below. Write one line per topic as 'number: main theme - detail - further detail', "
    "with names that differ from each other and say what the documents are about."
)
SUMMARY_TASK = "Summarise the topic below in three to five sentences: its main theme, common patterns and notable points."


def _documents_block(samples: DataFrame, length: Column | int, numbered: str) -> DataFrame:
    """(topic, block, shown): the sampled documents of each topic as one text, in order."""
    length = length if isinstance(length, Column) else F.lit(length)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    grouped = samples.groupBy("topic").agg(ordered.alias("docs"), F.count("*").alias("shown"))
    lines = F.transform("docs", lambda d, i: F.concat(
        F.lit(numbered), (i + 1).cast("string"), F.lit(". "), F.substring(d["text"], F.lit(1), length)))
    return grouped.select("topic", F.array_join(lines, "\n").alias("block"), "shown")


def label_prompts(samples: DataFrame, keywords: DataFrame, docs_per_topic: int = 8, per_batch: int = 10) -> DataFrame:
    """(batch, topics, prompt): at most ten topics per prompt, numbered from one inside the batch.

    ``samples`` is (topic, pos, text), at most ``docs_per_topic`` rows per topic.
    """
    blocks = _documents_block(samples, T.prompt_excerpt_length(docs_per_topic), "Document ")
    rows = keywords.join(blocks, "topic")
    order = Window.orderBy("topic")  # topic-sized
    numbered = rows.withColumn("_n", F.row_number().over(order) - 1).select(
        F.floor(F.col("_n") / per_batch).cast("int").alias("batch"), (F.col("_n") % per_batch + 1).cast("int").alias("slot"),
        "topic", "keywords", "block", "shown")
    part = F.concat(F.lit("Topic "), F.col("slot").cast("string"), F.lit("\nKeywords: "), F.col("keywords"), F.lit("\n"), F.col("block"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", part.alias("part"), "topic")))
    return numbered.groupBy("batch").agg(ordered.alias("p")).select(
        "batch", F.transform("p", lambda r: r["topic"]).alias("topics"),
        F.concat(F.lit(LABEL_TASK + "\n\n"), F.array_join(F.transform("p", lambda r: r["part"]), "\n\n")).alias("prompt"))


def summary_prompts(samples: DataFrame, info: DataFrame) -> DataFrame:
    """(topic, prompt): one prompt per topic over excerpts of 300 characters."""
    blocks = _documents_block(samples, 300, "")
    return info.join(blocks, "topic").select("topic", F.concat(
        F.lit(SUMMARY_TASK + "\n\nLabel: "), F.col("human_label"), F.lit("\nKeywords: "), F.col("keywords"),
        F.lit("\nDocuments shown: "), F.col("shown").cast("string"), F.lit("\n"), F.col("block")).alias("prompt"))


def within(seconds: float | None, call: Callable, *arguments):
    """The result of a call, or TimeoutError; a call that hangs goes on in a thread that nobody waits for."""
    if seconds is None:
        return call(*arguments)
    answer: queue.SimpleQueue = queue.SimpleQueue()

    def work() -> None:
        try:
            answer.put((call(*arguments), None))
        except Exception as error:  # handed to the caller
            answer.put((None, error))

    threading.Thread(target=work, daemon=True).start()
    try:
        value, error = answer.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError from None
    if error is not None:
        raise error
    return value


def apply_model(prompts: DataFrame, load: Callable[[], Callable], key: str = "topic", attempts: int = 3,
                parallel: int | None = None, timeout: float | None = 60.0, batch_size: int | None = None) -> DataFrame:
    """(key, response, tries) from a user model ``(prompt, attempt) -> text``.

    With ``batch_size`` the model is ``(prompts, attempt) -> texts`` and gets lists of that length; prompts that
    failed are asked again together.  An exception, a call of more than ``timeout`` seconds or an empty text
    counts as a failure; after the last attempt the response is null.  Parallelism is the number of partitions.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            asked = list(batch["prompt"])
            texts: list[str | None] = [None] * len(asked)
            tries = [0] * len(asked)
            for used in range(attempts):
                open_rows = [i for i, t in enumerate(texts) if not t]
                size = batch_size or 1
                for at in range(0, len(open_rows), size):
                    rows = open_rows[at:at + size]
                    try:
                        if batch_size is None:
                            answers = [within(timeout, model, asked[rows[0]], used)]
                        else:
                            answers = within(timeout, model, [asked[i] for i in rows], used)
                    except Exception:  # a failed call is tried again
                        answers = [None] * len(rows)
                    for i, text in zip(rows, answers):
                        texts[i] = text or None
                    for i in rows:
                        tries[i] = used + 1
            yield pd.DataFrame({key: batch[key], "response": texts, "tries": tries})

    rows = prompts.select(key, "prompt")
    if parallel is not None:
        rows = rows.repartition(parallel)
    return rows.mapInPandas(run, f"{key} {kind}, response string, tries int")


# --- responses --------------------------------------------------------------------------------

def _strip_chars(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


# Fixed values of the response formats: characters stripped from labels, limits (characters, words), refused texts.
STRICT_STRIP, LENIENT_STRIP = "\"'.,;", r" \"'.,;\[\](){}"
LENIENT_LINE = r"(?is)^(?:topic\s*)?(\d+)[\s:.)]+(.+)$"
STRICT_LIMITS, LENIENT_LIMITS = (5, 70, 2, 8), (5, 200, 2, 20)
LENIENT_REFUSED = ["help buy", "question buy", "[", "]"]


def parse_labels(responses: DataFrame, id_column: str = "batch", strict: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(id, number, label) from response texts of lines ``number: label``.

    Too short, too long, repeated or bracketed labels are dropped.  The lenient form adds
    ``-`` between two halves of a label that has none; the strict form takes lines that
    begin with ``topic`` and refuses placeholders.  ``sizes`` is (id, size): numbers
    outside 1..size do not count.
    """
    lines = responses.select(id_column, F.posexplode(F.split("response", "\n")).alias("line", "_t"))
    lines = lines.withColumn("_t", F.regexp_replace("_t", f"^{WHITESPACE}|{WHITESPACE}$", ""))
    if strict:
        head = F.regexp_extract("_t", r"(?is)^(topic [^:]*):.*$", 1)
        number = F.regexp_replace(head, r"[^0-9]", "")
        label = _strip_chars(F.trim(F.regexp_extract("_t", r"(?is)^topic [^:]*:(.*)$", 1)), STRICT_STRIP)
        low_chars, high_chars, low_words, high_words = STRICT_LIMITS
        bad = LABEL_PLACEHOLDERS
    else:
        number = F.regexp_extract("_t", LENIENT_LINE, 1)
        label = T.squeeze(_strip_chars(F.trim(F.regexp_extract("_t", LENIENT_LINE, 2)), LENIENT_STRIP))
        label = F.regexp_replace(label, r"(?i)^(category name|label):\s*", "")
        low_chars, high_chars, low_words, high_words = LENIENT_LIMITS
        bad = LENIENT_REFUSED
    rows = lines.select(id_column, "line", number.try_cast("int").alias("number"), label.alias("label"))
    words = F.filter(F.split("label", WHITESPACE), lambda w: w != "")
    rows = rows.withColumn("_w", words).withColumn("_low", F.lower("label"))
    fine = F.col("number").isNotNull() & F.length("label").between(low_chars, high_chars) & F.size("_w").between(low_words, high_words)
    for text in bad:
        fine = fine & ~F.col("_low").contains(text)
    rows = rows.where(fine)
    if sizes is not None:
        rows = rows.join(sizes.select(id_column, "size"), id_column).where(F.col("number").between(1, F.col("size"))).drop("size")
    # the first line wins among equal labels, the last one among equal numbers
    first = rows.groupBy(id_column, "_low").agg(F.min_by(F.struct("line", "number", "label", "_w"), "line").alias("f"))
    last = first.groupBy(id_column, F.col("f.number").alias("number")).agg(F.max_by("f", "f.line").alias("f"))
    label = F.col("f.label")
    if not strict:
        half = F.floor(F.size("f._w") / 2).cast("int")
        halves = F.concat(F.array_join(F.slice("f._w", F.lit(1), half), " "), F.lit(" - "),
                          F.array_join(F.slice("f._w", half + 1, F.size("f._w")), " "))
        label = F.when(~label.contains(" - ") & (F.size("f._w") >= 3), halves).otherwise(label)
    return last.select(id_column, "number", label.alias("label"))


def labels_by_topic(parsed: DataFrame, batches: DataFrame) -> DataFrame:
    """(topic, label): numbers inside a batch become topic ids; numbers out of range are dropped."""
    slots = batches.select("batch", F.posexplode("topics").alias("number", "topic")).withColumn("number", F.col("number") + 1)
    return parsed.join(slots, ["batch", "number"]).select("topic", "label")


def clean_summary(text: Column, max_length: int = 2000) -> Column:
    """A response without lead-in, blank lines, quotes or brackets; null when too little is left."""
    trim = lambda c: F.regexp_replace(c, f"^{WHITESPACE}|{WHITESPACE}$", "")
    plain = trim(text)

    def without_lead_in(t: Column) -> Column:
        result = t
        for lead in reversed(SUMMARY_LEAD_INS):
            rest = F.regexp_replace(trim(F.substring(t, F.lit(len(lead) + 1), F.length(t))), r"^[:,.\- ]+", "")
            result = F.when(t.startswith(lead) & (F.length(rest) > 10), rest).otherwise(result)
        return result

    def tidy(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n"), lambda x: trim(x)), lambda x: x != "")
        return _strip_chars(F.array_join(lines, "\n"), "\"'\\[\\](){}")

    def judge(t: Column) -> Column:
        words = F.filter(F.split(t, WHITESPACE), lambda w: w != "")
        head = F.substring(t, 1, max_length)
        cut = F.concat(trim(F.regexp_replace(head, r"(?s)^(.*) .*$", "$1")), F.lit("..."))
        kept = F.when(F.length(t) > max_length, cut).otherwise(t)
        return F.when((F.length(t) >= 5) & (F.size(words) >= 2), kept)

    return T.let(T.let(T.let(plain, without_lead_in), tidy), judge)


def labels_with_fallback(model: DataFrame, fallback: DataFrame) -> DataFrame:
    """(topic, label, source): the model's label where there is one."""
    both = fallback.select("topic", F.col("label").alias("_f")).join(model.select("topic", F.col("label").alias("_m")), "topic", "left")
    return both.select("topic", F.coalesce("_m", "_f").alias("label"),
                       F.when(F.col("_m").isNotNull(), "model").otherwise("fallback").alias("source"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.col("source") == "model").alias("model_count"),
                      F.count_if(F.col("source") == "fallback").alias("fallback_count"), F.count("*").alias("total"))


def attach_analysis(info: DataFrame, summaries: DataFrame, shown: DataFrame) -> DataFrame:
    """Add ``analysis``: the summary, else one sentence from the keywords, else empty.

    ``shown`` is (topic, shown): the number of documents the model was given.
    """
    joined = info.drop("analysis").join(summaries.select("topic", "summary"), "topic", "left").join(shown, "topic", "left")
    sentence = F.concat(F.lit("Topic related to "), F.col("keywords"), F.lit(". Contains "), F.coalesce("shown", F.lit(0)).cast("string"),
                        F.lit(" documents discussing "), F.lower("human_label"), F.lit("."))
    return joined.withColumn("analysis", F.when(F.col("topic") == -1, "").otherwise(F.coalesce(
        F.when(F.trim("summary") != "", F.col("summary")), F.when(F.col("keywords") != "", sentence), F.lit("")))).drop("summary", "shown")


def extract_answer(response: Column, question: Column) -> Column:
    """The answer inside a response: after ``Answer:``, else after the question, else from an opening phrase on, else the tail."""
    trim = lambda c: F.regexp_replace(c, f"^{WHITESPACE}|{WHITESPACE}$", "")
    after_question = F.substring_index(response, "User Question:", -1)
    at = F.instr(after_question, question)
    asked = trim(F.substring(after_question, at + F.length(question), F.length(after_question)))
    skipped = F.when(at <= 0, trim(after_question)).when(asked.startswith("Based on") & asked.contains(". "), trim(F.substring(
        asked, F.instr(asked, ". ") + 2, F.length(asked)))).otherwise(asked)
    lines = F.filter(F.transform(F.split(response, "\n"), lambda x: trim(x)), lambda x: x != "")
    opens = lambda x: F.lower(x).rlike("|".join(ANSWER_OPENERS))

    def from_opening(ls: Column) -> Column:
        first = F.array_position(F.transform(ls, opens), F.lit(True)).cast("int")
        tail = F.substring(response, F.floor(F.length(response) * 0.6).cast("int") + 1, F.length(response))
        return F.when(first > 0, F.array_join(F.slice(ls, F.greatest(first, F.lit(1)), F.size(ls)), "\n")).otherwise(trim(tail))

    return F.when(response.contains("Answer:"), trim(F.substring_index(response, "Answer:", -1))).when(
        response.contains("User Question:"), skipped).otherwise(T.let(lines, from_opening))
