"""Language identification with bit-sliced Bloom filters (operator 1).

Training counts letter trigrams of all labelled texts for each language.  A trigram belongs to a language when it is among the most frequent ones, which make up
``covered`` of the language's text whatever its alphabet, and its share is not far below that in the language where it is most common.  One array of slots holds the filters of all languages, bit L of a
slot being the slice of language L: the AND of the k slots of a trigram is the mask of all languages that contain it.  A text gets, for each
language, the number of its trigrams with that bit.  The count is corrected by the false positive rate of the slice, which follows from how full it is, and the highest
corrected count decides; ties go to the language with more training trigrams, then by name.

Size: the filter has ``slots_per_entry`` slots for each trigram of the fullest language, up to 2 ** ``slot_bits``.  Beyond that no trigram is left out: the slices are
fuller, and the correction takes the higher false positive rates away.

``keep_identified`` judges a text by what its language reaches: ``own`` is the share of the language's training trigrams that its slice holds.

Defined cases: a null text and a text without letters give ``und`` and score 0; letters without any known trigram give the
most common language and score 0; null labels are not learned; without a labelled text everything is ``und``; an empty table gives an empty one; a very long text is
a slice of its own and read whole; repeated rows are counted and answered one by one; other columns are ignored or, in ``keep_identified``, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import arrow_rows, materialise

UNKNOWN = "und"
CHUNK = 1 << 20     # code points handled at once
SLOT_BITS = 63      # languages in one word of the filter


@dataclass(frozen=True)
class FilterRules:
    covered: float = 0.995       # share of a language's text that its trigrams make up
    relative_share: float = 0.1  # of the share in the language that uses the trigram most
    hashes: int = 3
    slots_per_entry: int = 16    # slots for each trigram of the fullest language
    slot_bits: int = 23          # log2 of the most slots: 64 MB for up to 63 languages
    min_score: float = 0.5       # ``keep_identified`` rejects texts below this part of what the language reaches


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]   # by training trigrams, most first
    words: np.ndarray            # (number of words, slots) of uint64
    rates: np.ndarray            # false positive rate of each slice
    own: np.ndarray              # share of the training trigrams of each language that its slice holds
    rules: FilterRules


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the batch: (first text, texts, number of trigrams of each text, codes).  A code packs three code points of 21 bits.

    Anything but letters counts as a space; a trigram has a letter in its middle.  Very long texts are slices of their own.
    """
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= CHUNK):
            size += len(texts[stop] or "") + 2
            stop += 1
        lowered = [(t or "").lower() for t in texts[start:stop]]
        joined = " " + " ".join(lowered) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points[~_letters()[points]] = 32
        centre = np.flatnonzero(points != 32)
        ends = np.cumsum([len(t) + 1 for t in lowered])
        counts = np.diff(np.searchsorted(centre, ends, "right"), prepend=0)
        yield start, stop - start, counts, (points[centre - 1] << 42) | (points[centre] << 21) | points[centre + 1]
        start = stop


def _hash(codes: np.ndarray, number: int, slots: int) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (number + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(slots - 1)).astype(np.int64)


def count_trigrams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, code, n) over all labelled texts; counted in each batch before the shuffle."""
    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        number = {n: i for i, n in enumerate(names)}
        tags = np.array([number[x] for x in langs])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first, size, counts, codes in trigrams(batch.column(0).to_pylist()):
            of = np.repeat(tags[first:first + size], counts)
            for tag in np.unique(of):
                values, n = np.unique(codes[of == tag], return_counts=True)
                found.append((np.full(len(values), tag), values, n))
        if not found:
            return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["lang", "code", "n"])
        tag, code, n = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((code, tag))
        tag, code, n = tag[order], code[order], n[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(tag) != 0) | (np.diff(code) != 0)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, object)[tag[starts]], pa.string()), pa.array(code[starts]), pa.array(np.add.reduceat(n, starts))],
            names=["lang", "code", "n"])

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    return arrow_rows(labelled, rows_of, "lang string, code long, n long", 16 << 20).groupBy("lang", "code").agg(F.sum("n").alias("n"))


def least_count(by_size: dict[int, int], covered: float) -> int:
    """The largest power of two such that trigrams seen so often make up ``covered`` of all; ``by_size`` has the total of each power."""
    wanted, held = covered * sum(by_size.values()), 0
    for size in sorted(by_size, reverse=True):
        held += by_size[size]
        if held >= wanted:
            return 1 << size
    return 1


def train_filter(docs: DataFrame, rules: FilterRules = FilterRules(), text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """The bit-sliced filter of the languages named in ``lang_col``."""
    counts = materialise(count_trigrams(docs, text_col, lang_col), "trigrams")
    sizes = counts.groupBy("lang", (F.length(F.bin("n")) - 1).alias("size")).agg(F.sum("n").alias("total")).collect()  # at most 64 rows for each language
    by_size: dict[str, dict[int, int]] = {}
    for r in sizes:
        by_size.setdefault(r.lang, {})[r["size"]] = r.total
    languages = tuple(sorted(by_size, key=lambda lang: (-sum(by_size[lang].values()), lang)))
    if not languages:
        return LanguageFilter((), np.zeros((1, 1), np.uint64), np.zeros(0), np.zeros(0), rules)
    spark = docs.sparkSession
    known = spark.createDataFrame([(lang, i, float(sum(by_size[lang].values())), least_count(by_size[lang], rules.covered)) for i, lang in enumerate(languages)],
                                  "lang string, place int, total double, least long")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total")).where("n >= least")
    best = shares.groupBy("code").agg(F.max("share").alias("best"))
    chosen = shares.join(best, "code").where(F.col("share") >= rules.relative_share * F.col("best"))
    word = F.floor(F.col("place") / SLOT_BITS).cast("int")
    masks = chosen.groupBy("code", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, place % {SLOT_BITS})")).alias("mask"))
    held = chosen.groupBy("place").agg(F.count("*").alias("entries"), F.sum("share").alias("own")).collect()  # one row for each language
    own = np.zeros(len(languages))
    own[[r.place for r in held]] = [r.own for r in held]
    slots = 1 << min(rules.slot_bits, int(rules.slots_per_entry * max(r.entries for r in held) - 1).bit_length())

    def slots_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = batch.column(0).to_numpy()
        where = np.concatenate([_hash(codes, k, slots) for k in range(rules.hashes)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(batch.column(1).to_numpy(), rules.hashes)), pa.array(where), pa.array(np.tile(batch.column(2).to_numpy(), rules.hashes))],
            names=["word", "slot", "mask"])

    cells = arrow_rows(masks.select("code", "word", "mask"), slots_of, "word int, slot long, mask long")
    cells = cells.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most the size of the filter
    words = np.zeros(((len(languages) - 1) // SLOT_BITS + 1, slots), np.uint64)
    words[cells.column(0).to_numpy(), cells.column(1).to_numpy()] = cells.column(2).to_numpy().astype(np.uint64)
    fill = np.array([np.count_nonzero(words[i // SLOT_BITS] >> np.uint64(i % SLOT_BITS) & np.uint64(1)) for i in range(len(languages))]) / slots
    return LanguageFilter(languages, words, np.minimum(fill ** rules.hashes, 0.999), own, rules)


def _narrow(words: np.ndarray, languages: int) -> np.ndarray:
    """The smallest integer type that holds the bits keeps the filter in the CPU's cache."""
    if len(words) == 1:
        for kind, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)):
            if languages <= bits:
                return words.astype(kind)
    return words


def popcounts(texts: list[str | None], model: LanguageFilter) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of each text, counts of the languages' bits of each text)."""
    words, k = _narrow(model.words, len(model.languages)), model.rules.hashes
    total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)), np.int64)
    for first, size, counts, codes in trigrams(texts):
        total[first:first + size] = counts
        filled = np.flatnonzero(counts)
        if not len(filled):
            continue
        starts = (np.cumsum(counts) - counts)[filled]
        where = [_hash(codes, i, words.shape[1]) for i in range(k)]
        for w in range(len(words)):
            mask = words[w][where[0]]
            for x in where[1:]:
                mask = mask & words[w][x]
            for i in range(w * SLOT_BITS, min(len(model.languages), (w + 1) * SLOT_BITS)):
                bits = (mask >> mask.dtype.type(i % SLOT_BITS)) & mask.dtype.type(1)
                hits[first + filled, i] = np.add.reduceat(bits, starts, dtype=np.int64)
    return total, hits


def decide(texts: list[str | None], model: LanguageFilter) -> tuple[list[str], list[float], np.ndarray]:
    """(language, score, trigrams): the score is the corrected share of the text's trigrams that the language has."""
    total, hits = popcounts(texts, model)
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), total
    n = np.maximum(total, 1)[:, None]
    corrected = np.clip((hits / n - model.rates) / (1 - model.rates), 0.0, 1.0)
    best = corrected.argmax(axis=1)
    score = corrected[np.arange(len(texts)), best]
    names = [model.languages[b] if t else UNKNOWN for b, t in zip(best, total)]
    return names, [float(s) if t else 0.0 for s, t in zip(score, total)], total


def predictor(docs: DataFrame, model: LanguageFilter) -> Callable[[list[str | None]], tuple]:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and slot_bits
    return lambda texts: decide(texts, shared.value)


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_trigrams) of every text."""
    predict = predictor(docs, model)

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, total = predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(total)],
                                          names=["doc_id", "lang_pred", "score", "n_trigrams"])

    chosen = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return arrow_rows(chosen, rows_of, "doc_id long, lang_pred string, score double, n_trigrams long")


def keep_identified(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """Rows whose text is in one of the learned languages: not ``und``, and its score is at least ``min_score`` of what the language's own texts reach."""
    predict, place = predictor(docs, model), docs.columns.index(text_col)
    least = {lang: model.rules.min_score * float(own) for lang, own in zip(model.languages, model.own)}

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, _ = predict(batch.column(place).to_pylist())
        return batch.filter(pa.array([n != UNKNOWN and s >= least[n] for n, s in zip(names, scores)], pa.bool_()))

    return arrow_rows(docs, rows_of, docs.schema)
