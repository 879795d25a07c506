"""Term statistics: counts with document-frequency limits, TF-IDF phrases, class-based TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.constants import ENGLISH_STOP_WORDS
from topicloom.functions import text as T
from topicloom.plans.execution import lookup_join, materialise, top_k


def _terms(tokens: Column, low: int, high: int) -> Column:
    return tokens if (low, high) == (1, 1) else T.ngrams(tokens, low, high)


def counted(terms: Column) -> Column:
    """array<struct<term, n>> of an array of terms: sorted, then the lengths of its runs."""
    def runs(ordered: Column) -> Column:
        first = lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))
        starts = F.filter(F.sequence(F.lit(1), F.size(ordered)), first)
        return T.let(starts, lambda at: F.transform(at, lambda p, j: F.struct(
            F.get(ordered, p - 1).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(ordered) + 1) - p).cast("bigint").alias("n"))))

    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return F.when(F.size(terms) > 0, T.let(F.sort_array(terms), runs)).otherwise(none)


def _term_rows(df: DataFrame, low: int, high: int, keys: tuple[str, ...], stop_words: list[str], min_chars: int) -> DataFrame:
    """(keys..., terms): the n-grams of each row's text, repeats included."""
    tokens = df.select(*keys, T.without(T.word_tokens(F.col("text")), stop_words, min_chars).alias("tokens"))
    return tokens.select(*keys, _terms(F.col("tokens"), low, high).alias("terms"))


def document_terms(df: DataFrame, low: int = 1, high: int = 1, keys: tuple[str, ...] = ("doc_id",),
                   stop_words: list[str] = ENGLISH_STOP_WORDS, min_chars: int = 2) -> DataFrame:
    """(keys..., term, n): n-gram counts per document, or per topic, after stop words are dropped.

    A document is one row, so its counts come from the row itself, without an exchange.
    """
    rows = _term_rows(df, low, high, keys, stop_words, min_chars)
    if "doc_id" in keys:
        return rows.select(*keys, F.inline(counted(F.col("terms"))))
    return rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def count_terms(df: DataFrame, low: int = 1, high: int = 1, min_df: int = 1, max_df: float = 1.0,
                max_features: int | None = None, stop_words: list[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """(term, n, df): the vocabulary after the document-frequency limits and the size cap."""
    per_document = document_terms(df, low, high, stop_words=stop_words)
    vocabulary = per_document.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
    total = df.count()
    kept = vocabulary.where((F.col("df") >= min_df) & (F.col("df") <= max_df * total))
    if max_features is not None:
        # ordered by corpus count: a distributed top-k, the result is as small as the cap
        kept = kept.orderBy(F.col("n").desc(), "term").limit(max_features)
    return kept


PHRASE_TERMS = 1_000_000  # 32 bytes each
ROW_BYTES = 64 << 20      # text up to which the n-grams of all documents are counted as strings
CHUNK_BYTES = 8 << 20     # text of a chunk of documents; a task holds the n-grams of one


def top_phrases(df: DataFrame, low: int, high: int, k: int, min_df: int = 2, max_features: int | None = None, stop_words: list[str] = ENGLISH_STOP_WORDS,
                words_apart: bool = False, in_rows: int = PHRASE_TERMS, row_bytes: int = ROW_BYTES, chunk_bytes: int = CHUNK_BYTES, stored: bool = False) -> DataFrame:
    """(topic, rank, term, score): the terms of each topic with the largest summed TF-IDF.

    Smooth idf inside the topic, each document's vector has length one; all topics in
    one job.  With ``words_apart`` single words and longer phrases are scored and
    ranked apart, told by a column ``phrase``.  Texts are read twice: once for the
    vocabulary, once for the scores of its terms only, which is cheaper than keeping
    every n-gram of every document.  Up to ``in_rows`` terms (counted; 32 MB) the vocabulary travels to the tasks, a document
    is scored in its row and a task hands on one sum for each term; a larger one is joined by term.
    More than ``row_bytes`` of text are scored chunk by chunk (``_best_in_chunks``); texts that are not ``stored`` are stored for it.
    """
    is_phrase = F.contains("term", F.lit(" ")) if words_apart else F.lit(False)
    group, keys = ["topic", "phrase"], ("topic", "doc_id")
    sizes = materialise(df.groupBy("topic").agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")), "topic-sizes")
    size = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    sizes = sizes.drop("bytes")
    if max_features is None and size > row_bytes:
        chunks = -(-size // chunk_bytes)
        best = _best_in_chunks(lookup_join(df.select("topic", "doc_id", "text"), sizes, ["topic"], stored=True), low, high, k, min_df, stop_words, words_apart, chunks, in_rows, stored)
        best = top_k(best, group, [F.col("score").desc(), F.col("term").desc()], k)
        return best if words_apart else best.drop("phrase")
    pairs = document_terms(df, low, high, keys=keys, stop_words=stop_words)
    vocabulary = pairs.groupBy("topic", "term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    vocabulary = vocabulary.where(F.col("df") >= min_df).withColumn("phrase", is_phrase)
    if max_features is not None:
        vocabulary = top_k(vocabulary, group, [F.col("total").desc(), F.col("term")], max_features).drop("rank")
    idf = materialise(lookup_join(vocabulary, sizes, ["topic"], stored=True).select(
        *group, "term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"),
        (F.col("df") > 0.01 * F.col("docs")).alias("hot")), "idf")
    if idf.limit(in_rows + 1).count() <= in_rows:
        summed = _sums_in_rows(_term_rows(df, low, high, keys, stop_words, 2), idf)
    else:
        counts = document_terms(df, low, high, keys=keys, stop_words=stop_words)
        known = lookup_join(counts, idf, ["topic", "term"], stored=True, hot=F.col("hot"))
        weighted = known.select(*keys, "phrase", "term", (F.col("n") * F.col("idf")).alias("w"))
        per_document = Window.partitionBy(*keys, "phrase")
        scored = weighted.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_document)))
        summed = scored.groupBy(*group, "term").agg(F.round(F.sum("w"), 9).alias("score"))
    best = top_k(summed, group, [F.col("score").desc(), F.col("term").desc()], k)
    return best if words_apart else best.drop("phrase")


def _sums_in_rows(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """(topic, phrase, term, score): summed weights of the known terms of (topic, doc_id, terms), each document's vector of length one.

    A term is known by two hashes of (topic, term), so another one is not taken for it.
    """
    hashes = lambda topic, term: (F.xxhash64(topic, term), F.xxhash64(term, topic))
    one, two = hashes(F.col("topic"), F.col("term"))
    keyed = idf.select("topic", "phrase", "term", one.alias("h"), two.alias("g"), "idf")
    packed = keyed.select("h", "g", "idf", "phrase").orderBy("h").toArrow()  # counted by the caller
    shared = rows.sparkSession.sparkContext.broadcast(tuple(packed.column(i).to_numpy() for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g, weight, phrase = shared.value
        total = np.zeros(len(h))
        for batch in batches:
            if not batch.num_rows or not len(h):
                continue
            pairs = batch.column(0).flatten()
            first, second = (pairs.field(i).to_numpy() for i in range(2))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
            at = np.minimum(np.searchsorted(h, first), len(h) - 1)
            hit = (h[at] == first) & (g[at] == second)
            # how often a document has a term: the runs of equal (document, term)
            pair = np.sort(owner[hit] * len(h) + at[hit])
            starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, int)
            n, (owner, at) = np.diff(np.append(starts, len(pair))), np.divmod(pair[starts], len(h))
            part, w = owner * 2 + phrase[at], n * weight[at]
            length = np.sqrt(np.bincount(part, w * w, 2 * batch.num_rows).astype("float64"))
            total += np.bincount(at, w / length[part], len(h))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(h[used]), pa.array(g[used]), pa.array(total[used])], names=["h", "g", "w"])

    hashed = F.transform("terms", lambda t: F.struct(F.xxhash64("topic", t).alias("h"), F.xxhash64(t, "topic").alias("g")))
    arrays = rows.select(hashed.alias("pairs"))
    parts = arrays.mapInArrow(run, "h bigint, g bigint, w double").groupBy("h", "g").agg(F.round(F.sum("w"), 9).alias("score"))
    return parts.join(keyed, ["h", "g"]).select("topic", "phrase", "term", "score")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit numbers spread over all 64 (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_grams(topic: np.ndarray, tokens: pa.Array, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(h, g, row, first token, size) of all n-grams of rows of hashed tokens, ordered by row inside each size.

    ``h`` has 64 bits of the topic and the n-gram, ``g`` 16 more from a second hash of the tokens, so another n-gram is not taken for it.
    """
    row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    flat = tokens.flatten()
    one, two = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy().astype(np.int64).view(np.uint64)
    salt = _mixed(topic.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[row]
    h, g, parts = _mixed(one ^ salt), _mixed(two + salt), []
    for size in range(1, high + 1):
        if size > 1:  # a shorter n-gram and the token after it
            h = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[size - 1:] + np.uint64(size)) if len(h) else h
            g = _mixed(g[:-1] * np.uint64(0xD6E8FEB86659FD93) + two[size - 1:] + np.uint64(size)) if len(g) else g
        if size >= low and len(h):
            first = np.flatnonzero(row[:len(h)] == row[size - 1:])
            parts.append((h[first].view(np.int64), (g[first] >> np.uint64(48)).astype(np.int32), row[first], first, np.full(len(first), size, np.int8)))
    kinds = (np.int64, np.int32, np.int64, np.int64, np.int8)
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else tuple(np.zeros(0, t) for t in kinds)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(keys[0]) - 1, bool)
    for key in keys:
        changed |= key[1:] != key[:-1]
    return np.flatnonzero(np.r_[True, changed])


def _chunk_terms(rows: pa.Table, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(h, g, row, size, n) of the different n-grams of each row of a chunk, ordered by (h, g, row)."""
    topic = rows.column("topic").to_numpy()
    h, g, row, _, size = _hashed_grams(topic, rows.column("tokens").combine_chunks(), low, high)
    order = np.lexsort((row, g, h))
    h, g, row, size = h[order], g[order], row[order], size[order]
    start = _runs(h, g, row)
    return h[start], g[start], row[start], size[start], np.diff(np.append(start, len(h)))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length by byte planes, compressed: most high bytes are zero."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(data: bytes, rows: int, *kinds: str) -> list[np.ndarray]:
    widths = [np.dtype(kind).itemsize for kind in kinds]
    raw, at, columns = np.frombuffer(pa.decompress(data, rows * sum(widths), codec="zstd", asbytes=True), np.uint8), 0, []
    for kind, width in zip(kinds, widths):
        columns.append(np.ascontiguousarray(raw[at:at + rows * width].reshape(width, rows).T).view(kind).ravel())
        at += rows * width
    return columns


PACKED = "bucket int, chunk int, rows int, data binary"


def _packed(rows: list[tuple]) -> pa.Table:
    """Rows of PACKED."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["bucket", "chunk", "rows", "data"])


def _bucket_cuts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, bounds) of sorted hashes: a bucket is a range of them."""
    high = (h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    bucket = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    bounds = np.append(_runs(bucket), len(bucket))
    return bucket[bounds[:-1]], bounds


def _asked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(chunk, h, g, n) that the chunks ask for in one bucket, chunk by chunk."""
    rows = rows.sort_by("chunk")
    chunk, sizes = rows.column("chunk").to_numpy(), rows.column("rows").to_numpy()
    parts = [_unpack(data, n, "<u8", "<u2", "<u4") for n, data in zip(sizes.tolist(), rows.column("data").to_pylist())]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64).view(np.int64) for p in parts])
    return np.repeat(chunk, sizes), h, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _documents_with(h: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by n-gram, documents with the n-gram of each row, over all chunks, in that order)."""
    order = np.lexsort((g, h))
    start = _runs(h[order], g[order])
    return order, np.repeat(np.add.reduceat(n[order].astype(np.int64), start), np.diff(np.append(start, len(h))))


def _best_in_chunks(df: DataFrame, low: int, high: int, k: int, min_df: int, stop_words: list[str], words_apart: bool, chunks: int, in_rows: int, stored: bool) -> DataFrame:
    """(topic, phrase, term, score): the k best terms of each topic, and all that tie with the last, of (topic, doc_id, text, docs).

    Documents stand in chunks, hashes of n-grams in as many buckets, each a range of them.  A chunk asks a bucket once for its different n-grams there, sorted and compressed, with the number of its documents that have
    them.  Both sides keep that order: the bucket answers with the numbers over all documents, the chunk hands on the sums of the weights of those that reach ``min_df``, and neither sends a hash again.  The texts of the best
    n-grams are looked up at the end.  Every n-gram is counted and scored, and no task holds more than a chunk or a bucket.
    """
    tokens = F.transform(T.without(T.word_tokens(F.col("text")), stop_words, 2), lambda t: F.struct(F.xxhash64(t).alias("h"), F.hash(t).alias("g")))
    dealt = df.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    dealt = dealt if stored else materialise(dealt, "chunks")
    texts = dealt.repartition(chunks, "chunk").select("chunk", F.col("topic").cast("bigint").alias("topic"), "docs", tokens.alias("tokens"))

    def ask(rows: pa.Table) -> pa.Table:
        h, g, _, _, _ = _chunk_terms(rows, low, high)
        start, chunk = _runs(h, g), rows.column("chunk")[0].as_py()
        found = np.diff(np.append(start, len(h))).astype("<u4")
        h, g = h[start], g[start].astype("<u2")
        bucket, bounds = _bucket_cuts(h, chunks)
        return _packed([(x, chunk, b - a, _pack(np.diff(h[a:b].view(np.uint64), prepend=np.uint64(0)), g[a:b], found[a:b])) for x, a, b in zip(bucket, bounds[:-1], bounds[1:])])

    def answer(rows: pa.Table) -> pa.Table:
        chunk, h, g, n = _asked(rows)
        order, total = _documents_with(h, g, n)
        df = np.empty(len(h), "<u8")
        df[order] = np.where(total >= min_df, total, 0)
        bounds, bucket = np.append(_runs(chunk), len(chunk)), rows.column("bucket")[0].as_py()
        return _packed([(bucket, chunk[a], b - a, _pack(df[a:b])) for a, b in zip(bounds[:-1], bounds[1:])])

    asked = texts.groupBy("chunk").applyInArrow(ask, PACKED).repartition(chunks, "bucket")
    answered = asked.groupBy("bucket").applyInArrow(answer, PACKED).repartition(chunks, "chunk")

    def weigh(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows or not replies.num_rows:
            return _packed([])
        h, g, row, size, n = _chunk_terms(rows, low, high)
        replies, start, chunk = replies.sort_by("bucket"), _runs(h, g), rows.column("chunk")[0].as_py()
        known = np.concatenate([_unpack(data, n, "<u8")[0] for n, data in zip(replies.column("rows").to_pylist(), replies.column("data").to_pylist())]).astype(np.int64)
        df = np.repeat(known, np.diff(np.append(start, len(h))))
        hit = df > 0
        h, g, row, size, n, df = h[hit], g[hit], row[hit], size[hit], n[hit], df[hit]
        docs, topic = rows.column("docs").to_numpy()[row], rows.column("topic").to_numpy()[row]
        phrase = (size > 1) & words_apart
        w = n * (np.log((1 + docs) / (1 + df)) + 1)
        part = row * 2 + phrase
        w = w / np.sqrt(np.bincount(part, w * w, 2 * rows.num_rows))[part]
        start = _runs(h, g)
        total = np.add.reduceat(w, start) if len(start) else np.zeros(0)
        h, topic, phrase = h[start], topic[start].astype("<i8"), phrase[start].astype("u1")
        bucket, bounds = _bucket_cuts(h, chunks)
        return _packed([(x, chunk, b - a, _pack(topic[a:b], phrase[a:b], total[a:b].astype("<f8"))) for x, a, b in zip(bucket, bounds[:-1], bounds[1:])])

    weights = texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(weigh, PACKED).repartition(chunks, "bucket")

    def heaviest(rows: pa.Table, weighed: pa.Table) -> pa.Table:
        names = ["topic", "phrase", "h", "g", "score"]
        if not rows.num_rows or not weighed.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.float64())], names=names)
        _, h, g, n = _asked(rows)
        weighed = weighed.sort_by("chunk")
        parts = [_unpack(data, n, "<i8", "u1", "<f8") for n, data in zip(weighed.column("rows").to_pylist(), weighed.column("data").to_pylist())]
        order, total = _documents_with(h, g, n)
        known = np.empty(len(h), bool)
        known[order] = total >= min_df
        order = order[known[order]]
        place = (np.cumsum(known) - 1)[order]
        topic, phrase, w = (np.concatenate([p[i] for p in parts])[place] for i in range(3))
        h, g = h[order], g[order]
        start = _runs(h, g)
        topic, phrase, h, g, score = topic[start], phrase[start].astype(np.int8), h[start], g[start].astype(np.int32), np.round(np.add.reduceat(w, start), 9)
        order = np.lexsort((-score, phrase, topic))
        topic, phrase, h, g, score = topic[order], phrase[order], h[order], g[order], score[order]
        first = _runs(topic, phrase)
        last = np.minimum(first + k, np.append(first[1:], len(topic))) - 1
        kept = score >= np.repeat(score[last], np.diff(np.append(first, len(topic))))
        return pa.table([pa.array(c[kept]) for c in (topic, phrase, h, g, score)], names=names)

    local = asked.groupBy("bucket").cogroup(weights.groupBy("bucket")).applyInArrow(heaviest, "topic bigint, phrase tinyint, h bigint, g int, score double")
    place = F.rank().over(Window.partitionBy("topic", "phrase").orderBy(F.col("score").desc()))
    best = materialise(local.withColumn("_place", place).where(F.col("_place") <= k).drop("_place"), "best-terms")
    named = _terms_of(dealt, best.select("h", "g"), low, high, stop_words, in_rows)
    kind = df.schema["topic"].dataType
    return best.join(named, ["h", "g"]).select(F.col("topic").cast(kind).alias("topic"), (F.col("phrase") == 1).alias("phrase"), "term", "score")


def _terms_of(df: DataFrame, wanted: DataFrame, low: int, high: int, stop_words: list[str], in_rows: int) -> DataFrame:
    """(h, g, term): the texts of hashed n-grams, looked up in the documents; ``in_rows`` hashes travel to the tasks at once."""
    spark = df.sparkSession
    words = T.without(T.word_tokens(F.col("text")), stop_words, 2)
    rows = df.select(F.col("topic").cast("bigint").alias("topic"), words.alias("words")).select(
        "topic", "words", F.transform("words", lambda t: F.struct(F.xxhash64(t).alias("h"), F.hash(t).alias("g"))).alias("tokens"))
    blocks, parts = max(1, -(-wanted.count() // max(1, in_rows))), []
    for block in range(blocks):
        some = wanted.where(F.pmod("h", F.lit(blocks)) == block).orderBy("h", "g").toArrow()
        shared = spark.sparkContext.broadcast(tuple(some.column(i).to_numpy() for i in range(2)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kh, kg = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    if not len(kh):
                        break
                    batch = whole.slice(at, 256)
                    h, g, _, first, size = _hashed_grams(batch.column(0).to_numpy(), batch.column(2), low, high)
                    near = np.searchsorted(kh, h)
                    found: dict[int, int] = {}
                    for i in np.flatnonzero(kh[np.minimum(near, len(kh) - 1)] == h):
                        for j in range(near[i], np.searchsorted(kh, h[i], "right")):
                            if kg[j] == g[i]:
                                found.setdefault(j, i)
                    if found:
                        words_of_batch, at_known = batch.column(1).flatten(), np.fromiter(found, np.int64, len(found))
                        texts = [" ".join(words_of_batch.slice(first[i], size[i]).to_pylist()) for i in found.values()]
                        yield pa.RecordBatch.from_arrays([pa.array(kh[at_known]), pa.array(kg[at_known]), pa.array(texts)], names=["h", "g", "term"])
                        kh, kg = np.delete(kh, at_known), np.delete(kg, at_known)

        parts.append(rows.mapInArrow(run, "h bigint, g int, term string"))
    named = parts[0]
    for part in parts[1:]:
        named = named.unionByName(part)
    return named.distinct()


def topic_terms(df: DataFrame, low: int = 1, high: int = 1, keys: tuple[str, ...] = ("topic",),
                stop_words: list[str] = ENGLISH_STOP_WORDS, min_chars: int = 2) -> DataFrame:
    """(keys..., term, n): counts over all documents of a topic."""
    return document_terms(df, low, high, keys=keys, stop_words=stop_words, min_chars=min_chars)


def ctfidf(counts: DataFrame, seeds: DataFrame | None = None, multiplier: float = 1.0,
           reduce_frequent_words: bool = False, with_idf: bool = False) -> DataFrame:
    """(topic, term, weight[, idf]): tf(t, c) · ln(1 + A / f(t)).

    tf is the share of the term in its topic, f its count over all topics and A
    the mean number of words per topic.  ``seeds`` is a table with column ``term``.
    """
    counts = materialise(counts, "topic-terms")
    every = Window.partitionBy()  # topic-sized
    totals = counts.groupBy("topic").agg(F.sum("n").alias("words")).withColumn("mean_words", F.avg("words").over(every))
    with_f = counts.withColumn("f", F.sum("n").over(Window.partitionBy("term")))
    joined = lookup_join(with_f, totals, ["topic"])
    tf = F.col("n") / F.col("words")
    if reduce_frequent_words:
        tf = F.sqrt(tf)
    idf = F.log(1 + F.col("mean_words") / F.col("f"))
    if seeds is not None:
        boosted = seeds.select("term").distinct().withColumn("_m", F.lit(float(multiplier)))
        joined = joined.join(boosted, "term", "left")
        idf = idf * F.coalesce("_m", F.lit(1.0))
    return joined.select("topic", "term", (tf * idf).alias("weight"), *([idf.alias("idf")] if with_idf else []))


def top_terms(weights: DataFrame, k: int = 10, digits: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the k heaviest terms of each topic; ties by term."""
    rounded = weights.withColumn("weight", F.round("weight", digits))
    return top_k(rounded, ["topic"], [F.col("weight").desc(), F.col("term")], k)


def topic_words(weights: DataFrame, topic: int, k: int = 10) -> DataFrame:
    """(rank, term, weight): the words of one topic, weights to four decimals."""
    one = top_terms(weights.where(F.col("topic") == topic), k)
    return one.select("rank", "term", F.round("weight", 4).alias("weight"))
