"""Personal data: patterns and information-theoretic sanitisation (operator 3).

Patterns find the protected entities: e-mail and IP addresses, payment cards, phone numbers.  Terms of the documents that hold an entity may reveal it
although it is masked.  How strongly is estimated from the whole corpus: with document counts n(e), n(t) and n(e, t), the disclosure of
entity e by term t is PMI(e; t) / IC(e) = log(n(e, t) N / (n(e) n(t))) / log(N / n(e)), which is 1 when the term occurs only beside that entity, shrunk by the
factor n(e, t) / (n(e, t) + prior): few meetings are little evidence, and a name beside an entity in several documents beats a rare word that stands there once.
Every pair is scored, also those of an entity or a term that is seen once; with the default prior a pair seen once is generalised at most, and one seen three times can be removed.
Terms at or above ``disclosure`` are generalised to their shape, those at or above ``removal`` are removed, wherever they stand in the documents that hold the
entity.  All counts are of whole documents.  Documents without an entity stay as they are.

Terms are runs of word characters of any length.

What is shuffled: the distinct terms of documents with an entity, pairs of entity and term, counts of candidate terms, and rows of documents with an entity.  A pair
is formed only when n(e, t) = n(e) would reach the threshold, so frequent words meet no entity; no disclosing pair is lost by that.  The entities of a document are dealt to
parts of ``PART`` before they meet its terms, so a page with thousands of addresses is spread over tasks.  A Bloom filter of fixed size,
the only thing sent to every task, keeps other words out of the term count; the count itself is joined exactly.

Defined cases: a null text is empty and has no spans; a corpus in which every document holds an entity gives IC = 0 and no terms; repeated rows count as
documents of their own and get equal spans; a very long text is scanned whole, in linear time; an empty table gives an empty one; other columns are kept by ``sanitise`` and ignored by ``find_spans``; ids may be null.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from topicloom.llm.common import arrow_rows, materialise

KINDS = ["email", "ip", "card", "phone", "term"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"\w+")
PART = 256  # entities of one document that meet its terms in one task
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class Disclosure:
    min_support: int = 1      # documents in which a pair of entity and term must be seen: 1 scores every pair, more is a limit of the caller
    prior: float = 0.15       # meetings that count against a pair's own
    disclosure: float = 0.8   # from here on a term is generalised
    removal: float = 0.95     # from here on it is removed
    filter_bits: int = 22     # log2 of the slots of the Bloom filter: 512 KB


def _emails(text: str):
    """Leftmost matches, found from each at-sign: the local part reaches back to the last match at most."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds by start, then kind; code points, end exclusive."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def entity_of(text: str, span: tuple[int, int, int]) -> int:
    """Signed 64-bit hash of kind and value; writing variants of a number count as one entity."""
    start, kind, end = span
    value = text[start:end].lower() if kind < 2 else re.sub("[^0-9]", "", text[start:end])
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


def contexts(text: str, spans: list[tuple[int, int, int]], window: int | None = None) -> list[tuple[int, str, int, bool]]:
    """(start, term, end, first of its kind in the document) of every term outside the spans; with ``window`` only of those so many words beside one."""
    words = [m.span() for m in _TERM.finditer(text)]
    starts = [w[0] for w in words]
    masked, near = [False] * len(words), [window is None] * len(words)
    for s, _, e in spans:
        left, right = bisect_left(starts, s), bisect_left(starts, e)
        for i in range(max(0, left - 1), right):
            masked[i] = masked[i] or words[i][1] > s
        for i in range(max(0, left - window), min(len(words), right + window)) if window is not None else ():
            near[i] = True
    found, seen = [], set()
    for i, (s, e) in enumerate(words):
        if near[i] and not masked[i]:
            term = text[s:e].lower()
            found.append((s, term, e, term not in seen))
            seen.add(term)
    return found


def text_key(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def span_string(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans array<struct<start:int,kind:int,end:int>>, entities array<long>, "
    "near array<struct<start:int,term:string,end:int,first:boolean>>"
)


def find_entities(docs: DataFrame, limits: Disclosure, id_col: str, text_col: str) -> DataFrame:
    """One row per document: base spans, their entities and, beside an entity, all terms."""
    arrow = to_arrow_schema(StructType.fromDDL(FOUND))

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py() or ""
            spans = base_spans(text)
            kinds = [k for _, k, _ in spans]
            near = contexts(text, spans) if spans else []
            rows.append({
                "doc_id": doc_id, "text_key": text_key(text), "n_email": kinds.count(0), "n_ip": kinds.count(1), "n_card": kinds.count(2),
                "n_phone": kinds.count(3), "base_sha256": hashlib.sha256(span_string(spans).encode()).hexdigest(),
                "spans": [dict(zip(("start", "kind", "end"), s)) for s in spans],
                "entities": sorted({entity_of(text, s) for s in spans}),
                "near": [dict(zip(("start", "term", "end", "first"), n)) for n in near],
            })
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    return arrow_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows_of, FOUND)


def _slots(terms: list[str], bits: int) -> np.ndarray:
    """Two slots of the Bloom filter for each term."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64, len(terms))
    mask = np.uint64((1 << bits) - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask]).astype(np.int64)


def count_terms(docs: DataFrame, candidates: DataFrame, bits: int, text_col: str) -> DataFrame:
    """(term, n_term): in how many documents each candidate term occurs, over all documents."""
    def slots_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch.column(0).to_pylist(), bits)))], names=["slot"])

    # at most 2^bits rows whatever the corpus
    slots = arrow_rows(candidates.select("term"), slots_of, "slot long", 16 << 20).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(1 << bits, bool)
    table[slots] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def hits_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        member = np.unpackbits(packed.value).view(bool)
        counts: dict[str, int] = {}
        for value in batch.column(0):
            words = list(set(_TERM.findall((value.as_py() or "").lower())))
            if words:
                first, second = _slots(words, bits)
                for i in np.flatnonzero(member[first] & member[second]):
                    counts[words[i]] = counts.get(words[i], 0) + 1
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    hits = arrow_rows(docs.select(F.col(text_col).cast("string")), hits_of, "term string, n long", 16 << 20)
    return hits.groupBy("term").agg(F.sum("n").alias("n_term")).join(candidates, "term", "left_semi")


def meetings(docs: DataFrame, found: DataFrame, limits: Disclosure, text_col: str) -> tuple[DataFrame, float]:
    """(stored rows (doc_id, text_key, entity, term, n_entity, n_term) of entities and terms in one document, number of documents).

    n(e, t) is at most n(e), so a pair can reach the threshold only with n(t) <= n(e) (N / n(e)) ** (1 - disclosure (n(e) + prior) / n(e)): the others are left out.
    """
    total = float(max(1, found.count()))
    held = found.where(F.size("entities") > 0).select("doc_id", "text_key", "entities", "near", F.ceil(F.size("entities") / PART).cast("int").alias("parts"))
    held = materialise(held.withColumn("row", F.monotonically_increasing_id()), "held")
    entities = held.select("row", "doc_id", "text_key", "parts", F.explode("entities").alias("entity")).withColumn("part", F.pmod("entity", "parts").cast("int")).drop("parts")
    counts = entities.groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = F.col("n_entity")
    most = n * F.pow(F.lit(total) / n, 1.0 - limits.disclosure * (n + limits.prior) / n) * (1 + 1e-9)
    entities = materialise(entities.join(counts, "entity").withColumn("most", most), "placed")
    ceilings = entities.groupBy("row").agg(F.max("most").alias("ceiling"))
    near = held.select("row", "parts", F.explode("near").alias("x")).where("x.first").select("row", "parts", "x.term")
    terms = materialise(count_terms(docs, materialise(near.select("term").distinct(), "candidates"), limits.filter_bits, text_col), "terms")
    rare = near.join(terms, "term").join(ceilings, "row").where("n_term <= ceiling").drop("ceiling")
    rare = rare.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = rare.join(entities, ["row", "part"]).where("n_term <= most").select("doc_id", "text_key", "entity", "term", "n_entity", "n_term")
    return materialise(met, "pairs"), total


def disclosing(met: DataFrame, total: float, limits: Disclosure) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above the threshold."""
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("n_pair"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    pmi = F.log(F.col("n_pair") * F.lit(total) / (F.col("n_entity") * F.col("n_term")))
    content = F.log(F.lit(total) / F.col("n_entity"))
    trust = F.col("n_pair") / (F.col("n_pair") + F.lit(limits.prior))
    scored = pairs.where(F.col("n_pair") >= limits.min_support).withColumn("disclosure", F.when(content > 0, pmi / content * trust).otherwise(0.0))
    return scored.where(F.col("disclosure") >= limits.disclosure).select("entity", "term", "disclosure")


def disclosed_terms(docs: DataFrame, found: DataFrame, limits: Disclosure, text_col: str = "text") -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above the threshold."""
    return disclosing(*meetings(docs, found, limits, text_col), limits)


def term_spans(docs: DataFrame, found: DataFrame, limits: Disclosure, text_col: str) -> DataFrame:
    """(doc_id, text_key, terms): spans of disclosing terms of each document that has some, every occurrence."""
    met, total = meetings(docs, found, limits, text_col)
    hits = met.join(materialise(disclosing(met, total, limits), "disclosed"), ["entity", "term"])
    hits = hits.groupBy("doc_id", "text_key", "term").agg(F.max("disclosure").alias("disclosure")).alias("h")
    near = found.where(F.size("entities") > 0).select("doc_id", "text_key", F.explode("near").alias("x")).alias("w")
    same = F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w.text_key") == F.col("h.text_key")) & (F.col("w.x.term") == F.col("h.term"))
    one = near.join(hits, same).groupBy("w.doc_id", "w.text_key", F.col("w.x.start").alias("start"), F.col("w.x.end").alias("end")).agg(
        F.max("h.disclosure").alias("disclosure"))
    span = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "disclosure")
    return one.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(span)).alias("terms"))


def find_spans(docs: DataFrame, limits: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    found = materialise(find_entities(docs, limits, id_col, text_col), "entities")
    terms = materialise(term_spans(docs, found, limits, text_col), "terms")
    marked = found.where(F.size("spans") > 0).alias("f").join(
        terms.alias("t"), F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.text_key") == F.col("t.text_key")), "left"
    ).select("f.*", "t.terms")
    plain = found.where(F.size("spans") == 0).withColumn("terms", F.lit(None).cast(terms.schema["terms"].dataType))
    bare = F.transform(F.coalesce("terms", F.expr("from_json('[]', 'array<struct<start:int,kind:int,end:int,disclosure:double>>')")),
                       lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = F.array_join(F.transform(F.array_sort(F.concat("spans", bare)), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return marked.unionByName(plain).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"), F.size(bare).cast("long").alias("n_term"))


def rewrite(text: str, terms: list[dict] | None, removal: float) -> str:
    """The text with entities masked, disclosing terms generalised to their shape or removed."""
    spans = [(s, k, e, 0.0) for s, k, e in base_spans(text)]
    spans += [(t["start"], t["kind"], t["end"], t["disclosure"]) for t in terms or []]
    parts, last = [], 0
    for start, kind, end, disclosure in sorted(spans):
        if end <= last:
            continue
        start = max(start, last)
        parts.append(text[last:start])
        if kind != KINDS.index("term"):
            parts.append(f"[{KINDS[kind].upper()}]")
        elif disclosure < removal:
            word = text[start:end]
            parts.append("[CODE]" if _DIGITS.search(word) else "[NAME]" if word[:1].isupper() else "[WORD]")
        last = end
    return "".join(parts) + text[last:]


def sanitise(docs: DataFrame, limits: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their columns and rows, the texts sanitised.  Only rows with an entity are shuffled."""
    found = find_entities(docs, limits, id_col, text_col).select("doc_id", "text_key", "spans", "entities", "near")
    found = materialise(found, "entities")
    terms = materialise(term_spans(docs, found, limits, text_col), "terms")
    place, arrow = docs.columns.index(text_col), to_arrow_schema(docs.schema)

    def with_entity(wanted: bool):
        def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([bool(base_spans(t.as_py() or "")) == wanted for t in batch.column(place)], pa.bool_()))
        return rows_of

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.array([text_key(t.as_py()) for t in batch.column(2)], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, keys], names=["_row", "_id", "_text", "_key"])

    def rewritten(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column(0)
        texts = pa.array([rewrite(t.as_py(), s.as_py(), limits.removal) for t, s in zip(batch.column(1), batch.column(2))], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == place else row.field(i) for i in range(row.type.num_fields)], schema=arrow)

    held = arrow_rows(docs, with_entity(True), docs.schema).select(
        F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    held = arrow_rows(held, keyed, StructType([*held.schema.fields, StructField("_key", LongType())]))
    joined = held.join(terms, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left")
    masked = arrow_rows(joined.select("_row", "_text", F.col("terms").alias("_terms")), rewritten, docs.schema)
    return arrow_rows(docs, with_entity(False), docs.schema).unionByName(masked)
